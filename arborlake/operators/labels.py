"""Names of clusters of forks: their main directory and the words that set them apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and path parts that say nothing, and marks at the edges of words.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "this",
    "that", "into", "have", "will", "when", "what",
    "your", "their", "there", "should", "would",
    "could", "merge", "branch", "master", "main",
    "fix", "update", "updated", "updates", "change",
    "changes", "remove", "removed", "removes", "add",
    "added", "adds", "use", "used", "uses",
)
STOP_PARTS = ("src", "lib", "pkg", "internal", "test", "tests", "docs", "doc", "main", "index", "util", "utils", "common", "core")
EDGE_MARKS = ".,!?:;()[]\"'`"
DEEP_SHARE = 0.6
SEPARATOR = "  ·  "


def phrases(text: Column) -> Column:
    """Words of four characters at least that say something, and pairs of neighbours among them, line by line."""
    marks = "[" + "".join("\\" + c if c in ".?()[]" else c for c in EDGE_MARKS) + "]"

    def words(line: Column) -> Column:
        bare = F.transform(F.split(line, r"\s+"), lambda w: F.lower(F.regexp_replace(w, f"^{marks}+|{marks}+$", "")))
        return F.filter(bare, lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))

    def pairs(kept: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        both = F.transform(places, lambda i: F.concat(F.get(kept, i - 1), F.lit(" "), F.get(kept, i)))
        return F.concat(kept, F.filter(both, lambda x: x.isNotNull()))

    return F.flatten(F.transform(F.transform(F.split(text, "\n"), words), pairs))


def path_parts(path: Column) -> Column:
    """Directories and the stem of a path, three characters at least, without those that every project has."""
    parts = F.split(F.regexp_replace(F.lower(path), r"(?<=[^/])\.[^./]*$", ""), "/")
    return F.filter(parts, lambda p: (F.length(p) >= 3) & ~p.isin(*STOP_PARTS))


def main_directory(paths: DataFrame) -> DataFrame:
    """(cluster, directory) of the paths (cluster, fork_id, path) of members.

    The first directory that most paths share, if more than one does, or the
    second level of it that holds at least 60 % of them.
    """
    one, two = F.regexp_extract("path", "^([^/]*/)", 1), F.regexp_extract("path", "^([^/]*/[^/]*/)", 1)
    dirs = paths.select("cluster", one.alias("one"), two.alias("two")).filter("one <> ''").groupBy("cluster", "one", "two").agg(F.count("*").alias("n"))
    first = lambda c: F.min(F.struct((-F.col("n")).alias("o"), F.col(c).alias("dir")))
    wide = dirs.groupBy("cluster", "one").agg(F.sum("n").alias("n")).filter("n > 1")
    wide = wide.groupBy("cluster").agg(first("one").alias("w")).select("cluster", F.col("w.dir").alias("one"), (-F.col("w.o")).alias("all"))
    deep = dirs.filter("two <> ''").join(wide, ["cluster", "one"]).groupBy("cluster").agg(first("two").alias("d"))
    both = wide.join(deep, "cluster", "left").withColumn("n", -F.col("d.o"))
    return both.select("cluster", F.when((F.col("n") > 1) & (F.col("n") >= DEEP_SHARE * F.col("all")), F.col("d.dir")).otherwise(F.col("one")).alias("directory"))


def set_apart(tokens: DataFrame, members: DataFrame, cut: Callable[[DataFrame], DataFrame], n: int = 3, overlapping: bool = False) -> DataFrame:
    """(cluster, words): the ``n`` tokens of most tf-idf against all forks that are no members.

    ``tokens`` has cluster, fork_id, token and uses, any number of rows for a
    token of a fork; ``members`` has cluster and fork_id.  A token that shares a word with one taken before
    is passed over unless ``overlapping``.  Each of the ``n`` steps is a minimum
    by cluster, so no list of a cluster's tokens is made; ``cut`` writes the
    weighed tokens, which every step reads, and the words taken, one row a cluster.
    """
    used = tokens.groupBy("cluster", "token", "fork_id").agg(F.sum("uses").alias("c")).groupBy("cluster", "token").agg(F.sum("c").alias("c"), F.count("*").alias("inside"))
    spread = used.groupBy("token").agg(F.sum("inside").alias("df"))
    total = used.groupBy("cluster").agg(F.sum("c").alias("total"))
    forks = members.agg(F.count_distinct("fork_id").alias("forks"))
    sizes = members.groupBy("cluster").agg(F.count_distinct("fork_id").alias("size")).crossJoin(F.broadcast(forks))  # one row
    tf_idf = F.col("c") / F.col("total") * F.log((1.0 + F.col("forks") - F.col("size")) / (1.0 + F.col("df") - F.col("inside")))
    weighed = used.join(spread, "token").join(total, "cluster").join(sizes, "cluster").select("cluster", "token", F.struct((-F.round(tf_idf, 9)).alias("o"), "token").alias("place"))
    left = cut(weighed)
    taken = members.select("cluster").distinct().withColumn("words", F.array().cast("array<string>"))
    for _ in range(n):
        shared = F.arrays_overlap(F.split("token", " "), F.flatten(F.transform("words", lambda w: F.split(w, " "))))
        clash = F.array_contains("words", F.col("token")) if overlapping else shared
        best = left.join(taken, "cluster").filter(~clash).groupBy("cluster").agg(F.min("place")["token"].alias("next"))
        taken = cut(taken.join(best, "cluster", "left").select("cluster", F.when(F.col("next").isNull(), F.col("words")).otherwise(F.array_append("words", F.col("next"))).alias("words")))
    return taken


def cluster_labels(members: DataFrame, paths: DataFrame, commits: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(cluster, directory, words, label) of each cluster of forks.

    ``members`` is (cluster, fork_id), ``paths`` (fork_id, path) and ``commits``
    (fork_id, message).  Where the commits of a cluster have no words, the
    parts of its paths stand in, without those of its directory.
    """
    members = cut(members)
    located = cut(members.join(paths.select("fork_id", "path").distinct(), "fork_id"))
    directory = cut(main_directory(located))
    said = commits.groupBy("fork_id", "message").agg(F.count("*").alias("uses")).join(members, "fork_id")
    said = said.select("cluster", "fork_id", "uses", F.explode(phrases(F.col("message"))).alias("token"))
    parts = located.join(directory, "cluster", "left").select("cluster", "fork_id", "directory", F.lit(1).alias("uses"), F.explode(path_parts(F.col("path"))).alias("token"))
    words = set_apart(said, members, cut).join(directory, "cluster", "left")
    inside = F.split(F.lower(F.rtrim("directory", F.lit("/"))), "/")
    spare = set_apart(parts.filter(F.col("directory").isNull() | ~F.array_contains(inside, F.col("token"))), members, cut, overlapping=True).withColumnRenamed("words", "spare")
    both = words.join(spare, "cluster").select("cluster", "directory", F.array_join(F.when(F.size("words") > 0, F.col("words")).otherwise(F.col("spare")), ", ").alias("words"))
    return both.withColumn("label", F.concat_ws(SEPARATOR, "directory", F.nullif("words", F.lit(""))))
