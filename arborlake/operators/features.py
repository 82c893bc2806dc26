"""The texts of a fork that are embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.text import normalize_diff

MERGE = r"(?im)^\s*Merge\b"


def fork_features(files: DataFrame, commits: DataFrame, most: int = 2000) -> DataFrame:
    """fork_id, paths, commits, diff, truncated: a row for each fork with files.

    Paths are distinct and sorted.  Commit texts come in their order without
    merges and without repeats in any case.  The diff holds the largest changes
    first, ``most`` characters, and is normalised after the cut.
    """
    p = F.col("path")
    line = F.concat(F.lit("--- a/"), p, F.lit("\n+++ b/"), p, F.format_string("\n@@ -0,%d +0,%d @@", "deletions", "additions"))
    item = F.struct((-(F.col("additions") + F.col("deletions"))).alias("o"), "path", "additions", line.alias("t"))
    diff = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n")
    changed = files.groupBy("fork_id").agg(F.array_join(F.array_sort(F.collect_set(F.nullif("path", F.lit("")))), "\n").alias("paths"), diff.alias("whole"))
    said = commits.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter((F.col("text") != "") & ~F.col("text").rlike(MERGE))
    once = said.groupBy("fork_id", F.lower("text").alias("low")).agg(F.min(F.struct("at", "doc_id", "text")).alias("c"))
    told = once.groupBy("fork_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["text"]), "\n").alias("commits"))
    cut = F.when(F.length("whole") > most, F.regexp_replace(F.left("whole", F.lit(most)), "\n$", "")).otherwise(F.col("whole"))
    return changed.join(told, "fork_id", "left").select("fork_id", "paths", F.coalesce("commits", F.lit("")).alias("commits"), normalize_diff(cut).alias("diff"), (F.length("whole") > most).alias("truncated"))
