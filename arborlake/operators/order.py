"""Positions and running sums over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: list[str], value: str, name: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows before each in ``order``, which must be unique.

    Rows are dealt into ranges of ``order`` and cut; each range sums its own
    rows, and one total for each range goes to the driver and back.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("range_at", F.spark_partition_id()))
    totals = dict(placed.groupBy("range_at").agg(F.sum(value)).collect())
    most = max(totals, default=0)
    before = list(accumulate((int(totals.get(i) or 0) for i in range(most)), initial=0))
    own = Window.partitionBy("range_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.get(F.array(*(F.lit(n).cast("long") for n in before)), F.col("range_at"))
    return placed.withColumn(name, (first + F.coalesce(F.sum(value).over(own), F.lit(0))).cast("long")).drop("range_at")


def with_percentiles(df: DataFrame, by: list[str], values: list[str], size: str = "set_size") -> DataFrame:
    """``df`` with ``size``, the rows of its set, and for each value its midpoint percentile ``<value>_pct``.

    Equal values are counted before they move, so a window holds the distinct
    values of a set and not its rows.  Values are numbers; nulls come first.
    """
    columns = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.col(v).cast("double").alias("x")) for i, v in enumerate(values))))
    counts = df.select(*by, columns.alias("v")).groupBy(*by, "v.at", "v.x").agg(F.count("*").alias("n"))
    each = Window.partitionBy(*by, "at")
    below = F.coalesce(F.sum("n").over(each.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(each)
    counts = counts.select(*by, "at", "x", total.alias("total"), ((below + F.col("n") / 2.0) / total).alias("pct"))
    for i, v in enumerate(values):
        names = {c: f"of_{c}" for c in by}
        own = counts.filter(F.col("at") == i).select(*(F.col(c).alias(n) for c, n in names.items()), F.col("x").alias("of_x"), F.col("pct").alias(f"{v}_pct"), *([F.col("total").alias(size)] if i == 0 else []))
        same = [df[c].eqNullSafe(own[n]) for c, n in names.items()]
        df = df.join(own, [*same, df[v].cast("double").eqNullSafe(own["of_x"])]).drop(*names.values(), "of_x")
    return df


def positions(df: DataFrame, by: list[str], order: list[str], name: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``name``, the place of each row in its set from 1, and ``total``, the rows of the set.

    Sets are dealt into ranges, so one that holds most rows is not one task.  The
    smallest place of a set is its start; ``order`` must be unique.
    """
    placed = running(df.withColumn("one", F.lit(1)), [*by, *order], "one", name, cut)
    first = placed.groupBy(*by).agg(F.min(name).alias("first"), F.count("*").alias("total"))
    names = {c: f"of_{c}" for c in by}
    first = first.select(*(F.col(c).alias(n) for c, n in names.items()), "first", "total")
    same = [placed[c].eqNullSafe(first[n]) for c, n in names.items()]
    return placed.join(first, same).withColumn(name, F.col(name) - F.col("first") + 1).drop("one", "first", *names.values())
