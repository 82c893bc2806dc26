"""Ranks under a Gaussian utility model, and empirical-Bayes shrinkage.

Pools are bounded (200 of a network at most), so a network's pairs are too;
sums over all members are taken without pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions.numeric import lit, win_probability

POOL_CAP = 200
POTH_LEAST = 3


def pool(df: DataFrame, by: list[str], score: str = "heat", key: str = "fork_id", cap: int = POOL_CAP) -> DataFrame:
    """The ``cap`` best of each network with their place ``idx``."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return df.withColumn("idx", F.row_number().over(order)).filter(F.col("idx") <= min(cap, POOL_CAP))


def win_matrix(rows: DataFrame, by: list[str], mu: str = "mu", sd: str = "sd") -> DataFrame:
    """p that i beats j for every two members of a pool."""
    left = rows.select(*by, F.col("idx").alias("i"), F.col(mu).alias("mu_i"), F.col(sd).alias("sd_i"))
    right = rows.select(*by, F.col("idx").alias("j"), F.col(mu).alias("mu_j"), F.col(sd).alias("sd_j"))
    pairs = left.join(right, by).filter("i <> j")
    return pairs.select(*by, "i", "j", win_probability(F.col("mu_i"), F.col("mu_j"), F.col("sd_i"), F.col("sd_j")).alias("p"))


def expected_ranks(wins: DataFrame, by: list[str]) -> DataFrame:
    """Expected rank and P-score of each member."""
    n = F.count("*").over(Window.partitionBy(*by))
    df = wins.groupBy(*by, "i").agg(F.sum(1.0 - F.col("p")).alias("lost"), F.sum("p").alias("won")).withColumn("n", n)
    rank = 1 + F.col("lost")
    score = F.when(F.col("n") == 1, lit(1)).otherwise(F.least(F.greatest((F.col("n") - rank) / (F.col("n") - 1), lit(0)), lit(1)))
    return df.select(*by, F.col("i").alias("idx"), "n", rank.alias("expected_rank"), score.alias("p_score"), "won")


def poth(wins: DataFrame, by: list[str]) -> DataFrame:
    """Precision of the hierarchy of each pool; null under three members."""
    means = wins.groupBy(*by, "i").agg(F.avg("p").alias("m"))
    out = means.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("m") - 0.5) * (F.col("m") - 0.5)).alias("s"))
    return out.select(*by, "n", F.when(F.col("n") >= POTH_LEAST, 12.0 * (F.col("n") - 1) / (F.col("n") + 1) * F.col("s")).alias("poth"))


def poth_residuals(wins: DataFrame, by: list[str]) -> DataFrame:
    """How much each member adds to the precision: poth less poth without it."""
    sums = wins.groupBy(*by, "i").agg(F.sum("p").alias("s"))
    n = F.count("*").over(Window.partitionBy(*by))
    rest = wins.join(sums, [*by, "i"]).withColumn("d", F.col("s") - F.col("p"))
    sizes = sums.withColumn("n", n).select(*by, "i", "n")
    without = rest.join(sizes.withColumnRenamed("i", "j"), [*by, "j"])
    q = F.col("d") / (F.col("n") - 2) - 0.5
    out = without.groupBy(*by, "j", "n").agg(F.avg(q * q).alias("q")).filter("n > 3")
    left = 12.0 * (F.col("n") - 2) / F.col("n") * F.col("q")
    return out.join(poth(wins, by).select(*by, "poth"), by).select(*by, F.col("j").alias("idx"), (F.col("poth") - left).alias("residual"))


def tie_bands(df: DataFrame, by: list[str], order: str = "place", mu: str = "mu", sd: str = "sd", factor: float = 0.4) -> DataFrame:
    """Whether a member cannot be told from a neighbour in the order."""
    w = Window.partitionBy(*by).orderBy(order)
    close = lambda step: F.coalesce(F.abs(F.col(mu) - step(mu)) < factor * F.hypot(F.col(sd), step(sd)), F.lit(False))
    return df.withColumn("tied", close(lambda c: F.lag(c).over(w)) | close(lambda c: F.lead(c).over(w)))


def normal_cdf(x: np.ndarray, step: float = 1 / 256, edge: float = 10.0) -> np.ndarray:
    """The normal distribution by cubic interpolation of a table with its slopes; the error is under 1e-12."""
    grid, cdf, slope = _cdf_table(step, edge)
    x = np.clip(x, -edge, edge)
    at = np.minimum(((x + edge) / step).astype(np.int64), len(grid) - 2)
    t = (x - grid[at]) / step
    low, high, left, right = cdf[at], cdf[at + 1], slope[at] * step, slope[at + 1] * step
    return low + t * (left + t * (3 * (high - low) - 2 * left - right + t * (2 * (low - high) + left + right)))


@lru_cache(maxsize=2)
def _cdf_table(step: float, edge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grid = -edge + step * np.arange(int(2 * edge / step) + 2)
    cdf = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in grid])
    return grid, cdf, np.exp(-grid * grid / 2) / math.sqrt(2 * math.pi)


def win_sums(rows: DataFrame, key: str, mu: str, sd: str, cut: Callable[[DataFrame], DataFrame], width: float = 0.5, block: int = 4096) -> DataFrame:
    """key, won: the sum of p that a member beats each of another key (N1), without its pairs.

    Equal strengths are counted once.  Opponents of one spread are gathered in
    cells of ``width`` spreads, of which their number and the powers of their
    distances from the middle are kept; a Taylor series of the normal
    distribution about the middle gives a cell's sum to 1e-12 an opponent.  Work
    grows with members times cells, and cells with the range of the scores.
    Unknown scores are passed over; keys without an opponent have no row.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(mu).cast("double").alias("mu"), F.col(sd).cast("double").alias("sd")).filter("key IS NOT NULL")
    strengths = cut(rows.filter("mu IS NOT NULL AND sd IS NOT NULL").groupBy("mu", "sd").agg(F.count("*").alias("n")))
    wide = width * F.abs("sd")
    middle = F.when((wide > 0) & (F.abs("mu") < float("inf")) & (wide < float("inf")), (F.floor(F.col("mu") / wide) + 0.5) * wide).otherwise(F.col("mu"))
    off = F.when(F.col("mu") == F.col("at"), lit(0)).otherwise(F.col("mu") - F.col("at"))
    powers = [F.sum(F.col("n") * off**p if p else F.col("n").cast("double")) for p in range(_TERMS)]
    cells = cut(strengths.withColumn("at", middle).groupBy("sd", "at").agg(F.array(*powers).alias("powers")))

    def blocks(df: DataFrame, names: list[str], of: str) -> DataFrame:
        deal = F.pmod(F.xxhash64(*names[:2]), F.lit(-(-df.count() // block) or 1))
        return df.groupBy(deal.alias("deal")).agg(F.collect_list(F.struct(*names)).alias(of)).select(of)

    met = blocks(strengths, ["mu", "sd"], "members").crossJoin(blocks(cells, ["at", "sd", "powers"], "cells"))
    parts = met.repartition(met.sparkSession.sparkContext.defaultParallelism).mapInArrow(_cell_sums, "mu double, sd double, won double")
    total = rows.join(parts.groupBy("mu", "sd").agg(F.sum("won").alias("won")), ["mu", "sd"], "left").groupBy("key").agg(F.sum("won").alias("won"))
    twin = rows.select("key", F.col("mu").alias("mu_b"), F.col("sd").alias("sd_b"))
    own = rows.join(twin, "key").groupBy("key").agg(F.sum(win_probability(F.col("mu"), F.col("mu_b"), F.col("sd"), F.col("sd_b"))).alias("own"))
    several = rows.agg((F.min("key") < F.max("key")).alias("several")).filter("several")
    return total.join(own, "key").crossJoin(F.broadcast(several)).select(F.col("key").alias(key), (F.col("won") - F.coalesce("own", lit(0))).alias("won"))


#: powers of a cell, the number of its opponents first
_TERMS = 13


def _cell_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of members (mu, sd) and cells (at, sd, powers) to each member's sum over the cells."""
    for batch in batches:
        for row in range(batch.num_rows):
            members, cells = (batch.column(i)[row].values for i in range(2))
            mu, sd = (members.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            at, spread = (cells.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            powers = cells.field(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, _TERMS)
            won, step = np.empty(len(mu)), max(1, (1 << 19) // max(1, len(at)))
            for low in range(0, len(mu), step):
                high = low + step
                s = np.maximum(np.hypot(sd[low:high, None], spread), 1e-9)
                with np.errstate(invalid="ignore"):  # equal infinities
                    z = np.clip((mu[low:high, None] - at) / s, -38, 38)
                known = np.nan_to_num(z)
                part = np.where(np.isnan(z), np.nan, normal_cdf(known) * powers[:, 0])
                # the p-th derivative is (-1) ** (p - 1) He_{p-1}(z) bell(z), an opponent's distance d gives (-d / s) ** p
                scale, last, hermite = np.exp(-known * known / 2) / math.sqrt(2 * math.pi), np.zeros_like(z), np.ones_like(z)
                for p in range(1, _TERMS):
                    scale = scale / (p * s)
                    part -= scale * hermite * powers[:, p]
                    last, hermite = hermite, known * hermite - (p - 1) * last
                won[low:high] = part.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(mu), pa.array(sd), pa.array(won)], ["mu", "sd", "won"])


def rank_distribution(mu: np.ndarray, sd: np.ndarray, panels: int = 48) -> np.ndarray:
    """P(rank of i is r + 1) by integrating a Poisson-binomial over i's own value."""
    n = len(mu)
    nodes, weights = np.polynomial.legendre.leggauss(8)
    edges = np.linspace(-8, 8, panels + 1)
    half = (edges[1] - edges[0]) / 2
    z = (edges[:-1, None] + half + half * nodes).ravel()
    w = np.tile(weights * half, panels) * np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    out = np.zeros((n, n))
    for i in range(n):
        others = np.flatnonzero(np.arange(n) != i)
        better = normal_cdf((mu[others, None] - (mu[i] + sd[i] * z)) / sd[others, None])
        dist = np.zeros((n, len(z)))
        dist[0] = 1
        for m, p in enumerate(better):  # ranks beyond m + 1 are still empty
            now = dist[: m + 2]
            moved = now[:-1] * p
            now *= 1 - p
            now[1:] += moved
        out[i] = dist @ w
    return out / out.sum(axis=1, keepdims=True)


def rank_interval(dist: np.ndarray, level: float = 0.95) -> tuple[int, int]:
    """Smallest ranks that leave at most half the rest in each tail."""
    tail = (1 - level) / 2
    low = int(np.argmax(np.cumsum(dist) > tail)) + 1
    high = len(dist) - int(np.argmax(np.cumsum(dist[::-1]) > tail))
    return low, max(low, high)


def rank_report(rows: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """pTopK, pFirst and the 95 % interval of each pool member."""

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        dist = rank_distribution(pdf["mu"].to_numpy(float), pdf["sd"].to_numpy(float))
        spans = [rank_interval(d) for d in dist]
        ranks = np.arange(1, len(pdf) + 1)
        return pdf[[*by, "idx"]].assign(expected_rank=dist @ ranks, p_top_k=dist[:, :k].sum(axis=1), p_first=dist[:, 0], low=[a for a, _ in spans], high=[b for _, b in spans])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*by, "idx"]), "expected_rank double, p_top_k double, p_first double, low int, high int"])
    return rows.select(*by, "idx", "mu", "sd").groupBy(*by).applyInPandas(report, schema)


def shrink(df: DataFrame, by: list[str], y: str = "y", sd: str = "sd") -> DataFrame:
    """DerSimonian-Laird shrinkage of scores within each set.

    Adds m, tau2, regime, theta, post_sd, b, residual and influential.  Sets
    under three are ``insufficient``; no spread beyond the noise is ``pooled``.
    """
    w = 1 / (F.col(sd) * F.col(sd))
    med = df.groupBy(*by).agg(F.median(y).alias("med"))
    mad = df.join(med, by).groupBy(*by).agg((1.4826 * F.median(F.abs(F.col(y) - F.col("med")))).alias("mad"))
    one = df.groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col(y)).alias("swy"))
    one = one.withColumn("yw", F.col("swy") / F.col("sw")).withColumn("den", F.col("sw") - F.col("sw2") / F.col("sw"))
    q = df.join(one, by).groupBy(*by).agg(F.sum(w * (F.col(y) - F.col("yw")) * (F.col(y) - F.col("yw"))).alias("q"))
    fit = one.join(q, by).join(mad, by)
    raw = F.when(F.col("den") > 1e-9, (F.col("q") - (F.col("k") - 1)) / F.col("den")).otherwise(lit(0))
    cap = F.when((F.col("mad") > 0) & (2 * F.col("mad") < 25), 2 * F.col("mad")).otherwise(lit(25))
    fit = fit.withColumns({"raw": raw, "cap": cap})
    regime = F.when(F.col("k") < 3, "insufficient").when(F.col("raw") <= 0, "pooled").when(F.sqrt(F.greatest(F.col("raw"), lit(0))) > F.col("cap"), "clamped").otherwise("heterogeneous")
    fit = fit.withColumn("regime", regime).withColumn("tau2", F.when(F.col("regime") == "clamped", F.col("cap") * F.col("cap")).when(F.col("regime") == "heterogeneous", F.col("raw")))
    fit = fit.select(*by, "k", "yw", "regime", "tau2")
    df = df.join(fit, by)
    v = 1 / (F.col(sd) * F.col(sd) + F.col("tau2"))
    mean = df.groupBy(*by).agg((F.sum(v * F.col(y)) / F.sum(v)).alias("m_re"))
    df = df.join(mean, by).withColumn("m", F.coalesce("m_re", "yw")).drop("m_re", "yw")
    s2 = F.col(sd) * F.col(sd)
    df = df.withColumn("b", F.col("tau2") / (F.col("tau2") + s2)).withColumn("theta", F.col("m") + F.col("b") * (F.col(y) - F.col("m")))
    df = df.withColumn("post_sd", F.sqrt(1 / (1 / s2 + 1 / F.col("tau2")))).withColumn("residual", (F.col(y) - F.col("theta")) / F.col(sd))
    return df.withColumn("influential", F.col("residual") * F.col("residual") + F.col("b") > 3)
