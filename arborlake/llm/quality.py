"""Operator 4: text quality by a sparse ensemble of rules.

Statistics of whole texts come from one pass over their bytes and words.  Small
boosted trees are grown on labelled rows; every path from a root to a node is a
rule, a conjunction of comparisons.  A logistic model over the rules is fitted
with an L1 penalty, which leaves few; those are compiled into one Spark column
expression over the statistics, so scoring needs no model object.

Fitting uses at most ``rows`` labelled rows, those with the smallest hashes of
their id; the label table is filtered first, so only their texts are read.

Nulls: null and empty texts have statistics zero and are scored by the same
rules.  Labels that are null or not 0 or 1, or whose ids have no document, are
not used; a row repeated in the labels counts as often as it is there.  Without
labels of both kinds the score is their mean, or 0.5 without any.  Repeated
document rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import slices, table, utf8
from arborlake.llm.language import split_of

STATISTICS = ("n_bytes", "n_words", "word_length", "symbol_share", "upper_share", "digit_share", "stop_share", "bang_share", "distinct_share", "repeat_share", "line_length", "wide_share")


def statistics(text: bytes) -> tuple[float, ...]:
    """The statistics of a UTF-8 text, in the order of ``STATISTICS``."""
    words = text.split()
    if not words:
        return (float(len(text)), *(0.0,) * (len(STATISTICS) - 1))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    ink = int(count.sum() - count[[9, 10, 11, 12, 13, 32]].sum())
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    digits, wide = int(count[48:58].sum()), int(count[128:].sum())
    stops, bangs = int(count[[44, 46, 58, 59, 63]].sum()), int(count[33])
    symbols = ink - upper - lower - digits - wide - stops - bangs
    n = len(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return (
        float(len(text)), float(n), ink / n, symbols / ink, upper / max(1, upper + lower), digits / ink, stops / ink, bangs / ink,
        len(set(words)) / n, repeats / n, len(text) / (1 + int(count[10])), wide / ink,
    )


def _statistics(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.array([statistics(t) for t in utf8(batch.column(text_at))])
            kept = [i for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(c) for c in rows.T)], [*(batch.schema.names[i] for i in kept), *STATISTICS])

    return run


def with_statistics(docs: DataFrame) -> DataFrame:
    """The statistics instead of ``text``; other columns stay."""
    docs = docs.drop(*STATISTICS)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != "text"), *(f"{n} double" for n in STATISTICS)])
    return docs.mapInArrow(_statistics(docs.columns.index("text")), schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is it above, bound) and so on


@dataclass(frozen=True)
class RuleModel:
    base: float
    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = ()

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(self.base)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for at, above, bound in rule:
                value = F.col(STATISTICS[at])
                holds = holds & ((value > bound) if above else (value <= bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        text = lambda rule: " and ".join(f"{STATISTICS[at]} {'>' if above else '<='} {bound:.4g}" for at, above, bound in rule)
        return [f"{weight:+.3f} if {text(rule)}" for rule, weight in sorted(zip(self.rules, self.weights, strict=True), key=lambda x: -abs(x[1]))]


def grow(codes: np.ndarray, bounds: list[np.ndarray], target: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on binned statistics: rules of all its nodes, and its prediction."""
    rules: list[Rule] = []
    fit = np.zeros(len(target))

    def split(rows: np.ndarray, path: Rule) -> None:
        y = target[rows]
        fit[rows] = y.mean()
        if path:
            rules.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            return
        best, total = (1e-9, -1, -1), y.sum()
        for at, bound in enumerate(bounds):
            if not len(bound):
                continue
            n = np.cumsum(np.bincount(codes[rows, at], minlength=len(bound) + 1))[:-1]
            s = np.cumsum(np.bincount(codes[rows, at], weights=y, minlength=len(bound) + 1))[:-1]
            m = len(rows) - n
            gain = np.where((n >= least) & (m >= least), s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1) - total**2 / len(rows), 0)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), at, k))
        _, at, k = best
        if at < 0:
            return
        above, bound = codes[rows, at] > k, float(bounds[at][k])
        split(rows[~above], (*path, (at, False, bound)))
        split(rows[above], (*path, (at, True, bound)))

    split(np.arange(len(target)), ())
    return rules, fit


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for at, above, bound in rule:
        out &= (x[:, at] > bound) if above else (x[:, at] <= bound)
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss plus ``penalty`` times the L1 norm (FISTA)."""
    n, k = x.shape
    size = 4 * n / max(1.0, float(np.linalg.norm(np.c_[np.ones(n), x], 2)) ** 2)
    w = v = np.zeros(k + 1)
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    t = 1.0
    v = w.copy()
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(v[0] + x @ v[1:]))) - y
        moved = v - size * np.r_[error.mean(), x.T @ error / n]
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - size * penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = moved + (t - 1) / t_next * (moved - w)
        w, t = moved, t_next
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, penalty: float = 1e-3, seed: int = 7) -> RuleModel:
    if not len(y):
        return RuleModel(0.0)
    mean = float(y.mean())
    if mean in (0.0, 1.0):
        return RuleModel(30.0 if mean else -30.0)
    rng = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
    bounds = [b[b < c.max()] for b, c in zip(bounds, x.T, strict=True)]
    codes = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bounds, x.T, strict=True)], axis=1)
    rules: dict[Rule, None] = {}
    guess = np.full(len(y), np.log(mean / (1 - mean)))
    least = max(5, len(y) // 500)
    for _ in range(trees):
        rows = rng.random(len(y)) < 0.5
        if rows.sum() < 4 * least:
            rows[:] = True
        residual = y - 1 / (1 + np.exp(-guess))
        found, _ = grow(codes[rows], bounds, residual[rows], int(rng.integers(1, 4)), least)
        rules |= dict.fromkeys(found)
        leaves = [r for r in found if not any(len(o) > len(r) and o[: len(r)] == r for o in found)]
        for leaf in leaves:
            inside = _holds(leaf, x)
            guess[inside] += 0.5 * float(residual[inside & rows].sum() / max(1e-6, (np.abs(residual) * (1 - np.abs(residual)))[inside & rows].sum()))
        guess = np.clip(guess, -8, 8)
    made = {r: _holds(r, x) for r in rules}
    kept: dict[bytes, Rule] = {}
    for rule, holds in made.items():
        kept.setdefault(np.packbits(holds).tobytes(), rule)
    chosen = list(kept.values())
    if not chosen:
        return RuleModel(float(np.log(mean / (1 - mean))))
    base, weights = lasso_logistic(np.stack([made[r] for r in chosen], axis=1).astype(float), y, penalty)
    used = [i for i in range(len(chosen)) if abs(weights[i]) > 1e-6]
    return RuleModel(base, tuple(chosen[i] for i in used), tuple(float(weights[i]) for i in used))


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 20_000) -> RuleModel:
    """Fit on the ``rows`` labelled ids with the smallest hashes; docs has doc_id and text.

    Of rows that share an id and a label one is used, that of the least statistics,
    so at most ``rows`` go to the driver however often an id repeats.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    # at most ``rows`` ids and labels
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "y", "text")
    one = with_statistics(texts).groupBy("doc_id", "y").agg(F.min(F.struct(*STATISTICS)).alias("x"))
    got = sorted(one.collect())
    x = np.array([r["x"] for r in got], dtype=float).reshape(len(got), len(STATISTICS))
    return fit_rules(x, np.array([r["y"] for r in got], dtype=float))


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` without ``text``, with ``score`` and ``predicted``."""
    kept = [c for c in docs.columns if c not in ("text", "score", "predicted", *STATISTICS)]
    scored = with_statistics(docs.select(*kept, "text")).select(*kept, model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = split_of(F.col("doc_id"), 5) == 0
    model = learn_quality(docs.filter(~held_out), labels.filter(split_of(F.col("doc_id"), 5) != 0))
    return score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
