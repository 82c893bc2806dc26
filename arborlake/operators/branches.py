"""Which branch of a fork carries its work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lane(is_default: Column, ahead: Column, upstreamed: Column) -> Column:
    """0 default with own work, 1 side with own work, 2 default merged, 3 side merged, null none."""
    own, merged = (ahead > 0) & ~upstreamed, (ahead > 0) & upstreamed
    return F.when(is_default & own, 0).when(own, 1).when(is_default & merged, 2).when(merged, 3)


def select_branch(branches: DataFrame, key: str) -> DataFrame:
    """The branch that carries the fork's work.

    ``branches`` has key, name, is_default, ahead, upstreamed, tip_at.  Within a
    lane the newest tip wins; with no work anywhere the default branch is
    returned with ahead 0 and needs no further request.
    """
    df = branches.withColumn("lane", F.coalesce(lane(F.col("is_default"), F.col("ahead"), F.col("upstreamed")), F.when(F.col("is_default"), F.lit(4))))
    order = Window.partitionBy(key).orderBy("lane", F.desc("tip_at"), "name")
    df = df.filter("lane is not null").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return df.select(key, "name", F.when(F.col("lane") == 4, F.lit(0)).otherwise(F.col("ahead")).alias("ahead"), (F.col("lane") < 4).alias("needs_rest"), (F.col("lane").isin(1, 3)).alias("side"))


def post_fork(branches: Column, created: Column) -> Column:
    """Branches without those whose known tip is older than the fork."""
    return F.filter(branches, lambda b: b["tip_at"].isNull() | (b["tip_at"] >= created))


def newest_sides(branches: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The newest dated branches beside the default one."""
    order = Window.partitionBy(key).orderBy(F.desc("tip_at"), "name")
    return branches.filter(~F.col("is_default") & F.col("tip_at").isNotNull()).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)


def fingerprint(tips: Column) -> Column:
    """Sixteen hex digits of the sorted distinct tip ids."""
    return F.left(F.sha2(F.array_join(F.array_sort(tips), "\n"), 256), F.lit(16))
