"""PageRank with uniform dangling mass and a personal teleport."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.skew import join_counted


def _dense(src: np.ndarray, dst: np.ndarray, teleport: np.ndarray, damping: float, rounds: int) -> np.ndarray:
    n = len(teleport)
    out = np.bincount(src, minlength=n)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        share = np.divide(rank, out, out=np.zeros(n), where=out > 0)
        moved = np.bincount(dst, weights=share[src], minlength=n)
        rank = (1 - damping) * teleport + damping * (moved + rank[out == 0].sum() / n)
    return rank


def _in_one_group(nodes: DataFrame, edges: DataFrame, damping: float, rounds: int) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("node").reset_index(drop=True)
        at = pd.Series(left.index, index=left["node"])
        rank = _dense(at[right["src"]].to_numpy(), at[right["dst"]].to_numpy(), left["tp"].to_numpy(), damping, rounds)
        return pd.DataFrame({"node": left["node"], "rank": rank})

    one = F.lit(1).alias("g")
    kind = dict(nodes.dtypes)["node"]
    return nodes.select(one, "node", "tp").groupBy("g").cogroup(edges.select(one, "src", "dst").groupBy("g")).applyInPandas(run, f"node {kind}, rank double")


def pagerank(nodes: DataFrame, edges: DataFrame, cut: Callable[[DataFrame], DataFrame], damping: float = 0.85, rounds: int = 50, small: int = 200_000) -> DataFrame:
    """(node, rank) after a fixed number of rounds.

    ``nodes`` has node and weight (teleport; no positive weight is uniform);
    ``edges`` has distinct src and dst, and those that leave the nodes are not
    followed.  Graphs of up to ``small`` nodes and edges together run as one
    numpy group.  In larger ones a round is two joins and its result is cut, so
    no plan grows; the mass of nodes without links goes to the driver as one
    number.  Both ways compute the same sums.
    """
    total = nodes.agg(F.count("*").alias("n"), F.sum(F.greatest("weight", F.lit(0.0))).alias("w")).first()
    n, w = total["n"], total["w"] or 0.0
    share = F.greatest("weight", F.lit(0.0)) / w if w > 0 else F.lit(1.0 / max(n, 1))
    nodes = nodes.select("node", share.alias("tp"))
    known = nodes.select("node")
    edges = edges.select("src", "dst").join(known.withColumnRenamed("node", "src"), "src").join(known.withColumnRenamed("node", "dst"), "dst").select("src", "dst")
    links = edges.count()
    if n + links <= small:
        return _in_one_group(nodes, edges, damping, rounds)
    edges = cut(edges)
    degree = edges.groupBy("src").agg(F.count("*").alias("n"))
    ranks = cut(nodes.join(degree, nodes["node"] == degree["src"], "left").select("node", "tp", F.col("n").alias("out"), F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        loose = ranks.filter("out is null").agg(F.sum("rank")).first()[0] or 0.0
        shares = ranks.filter("out is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("share"), F.col("out").alias("n"))
        moved = join_counted(edges, shares, ["src"], links).groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("moved"))
        value = (1 - damping) * F.col("tp") + damping * (F.coalesce("moved", F.lit(0.0)) + F.lit(loose / n))
        ranks = cut(ranks.join(moved, "node", "left").select("node", "tp", "out", value.alias("rank")))
    return ranks.select("node", "rank")
