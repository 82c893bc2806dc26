"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.skew import join_counted


def _largest(df: DataFrame, rows: int) -> DataFrame:
    """Link every larger neighbour of u to the smallest of u and its neighbours."""
    both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_counted(both.filter("v > u"), low, ["u"], 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smallest(df: DataFrame, rows: int) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    low = df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_counted(df, low, ["u"], rows).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, cut: Callable[[DataFrame], DataFrame], rounds: int = 60, per_task: int = 250_000) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node.

    The number of rounds grows with the logarithm of the longest path.  ``cut``
    ends the lineage of a step; only a count and a sum go to the driver.  A node
    with many neighbours is met by broadcast, as there are few of them.  A round
    has a partition for every ``per_task`` links, so few links make few files.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    pairs, seen = cut(pairs), None
    for _ in range(rounds):
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        tasks = -(-state[0] // per_task)
        larger = cut(_largest(pairs.coalesce(tasks), state[0]).coalesce(tasks))
        pairs, seen = cut(_smallest(larger, state[0]).coalesce(tasks)), state
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
