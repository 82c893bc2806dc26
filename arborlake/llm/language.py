"""Operator 10: language identification by rank-order n-gram profiles.

A profile is the list of the ``size`` most frequent character n-grams (one to
three characters of lower-cased words, with blanks at word ends), ordered by
count and then by n-gram.  A document's own list is compared with each language
profile: every n-gram costs the distance between its two ranks, or ``size`` when
the language lacks it.  The language with the smallest sum wins (ties: the first
name); ``score`` is one less the sum's share of the largest possible sum.

Profiles count the n-grams of all training rows: each task adds up its own
counts by language and n-gram in a table of bounded size, Spark sums them, and only ``size`` entries for
each language reach the driver.  Learned languages are limited to ``languages``
distinct names, which bounds what is sent to the tasks; more is an error.

Nulls: a text that is null or has no letter gets ``und`` and score 0; rows whose
``lang`` is null, or whose text has no letter, teach nothing.  With nothing to
learn from, a text with letters has a null language and score 0.  Null ``doc_id`` counts as the empty string in
the split.  Repeated rows are scored each; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.llm.common import slices, table

BLANK = 32
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank where it is no letter."""
    out = np.full(0x110000, BLANK, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def gram_counts(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, n-gram) pairs, in order, and their counts.

    ``owner[i]`` is the group that text i belongs to.  An n-gram is its code
    points, 21 bits each; no letter stands at the front of shorter ones.
    """
    joined = " " + " ".join(texts) + " "
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    symbols = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    of = np.concatenate([owner[:1], np.repeat(owner, lengths)])
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK)
    symbols, of = symbols[keep], of[keep]
    alphabet = np.flatnonzero(np.bincount(symbols, minlength=BLANK + 1))
    dense = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
    dense[alphabet] = np.arange(1, len(alphabet) + 1)
    s, a = dense[symbols], len(alphabet) + 1
    blank = int(dense[BLANK])
    of = of.astype(np.int64) * a**3
    one, two, three = s[1:-1], s[:-1] * a + s[1:], s[:-2] * a * a + s[1:-1] * a + s[2:]
    # the group of an n-gram is that of its first letter: a text's leading blank belongs to the text before it
    middle = s[1:-1] != blank
    first = np.where(s[:-1] != blank, of[:-1], of[1:])
    keys = np.concatenate([(of[1:-1] + one)[middle], first + two, (of[1:-1] + three)[middle]])
    if (int(owner.max()) + 1) * a**3 < 2**31:
        keys = keys.astype(np.int32)
    keys, n = np.unique(keys, return_counts=True)
    keys = keys.astype(np.int64)
    group, gram = keys // a**3, keys % a**3
    points = np.concatenate([[0], alphabet]).astype(np.int64)
    code = (points[gram // (a * a)] << 42) | (points[gram // a % a] << 21) | points[gram % a]
    return group, code, n


def _count(most: int = 1 << 18):
    """Counts of a task by language and n-gram, put out whenever there are more than ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        totals: dict[tuple[int, int], int] = {}

        def flush() -> pa.RecordBatch:
            back = list(names)
            columns = [back[g] for g, _ in totals], [c for _, c in totals], list(totals.values())
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, GRAMS, strict=True)], schema=GRAMS)
            totals.clear()
            names.clear()
            return out

        for batch in slices(batches, "text", limit=1 << 19):
            langs = batch.column(1).to_pylist()
            owner = np.array([names.setdefault(x, len(names)) for x in langs], dtype=np.int64)
            for group, code, n in zip(*(x.tolist() for x in gram_counts(batch.column(0).to_pylist(), owner)), strict=True):
                totals[group, code] = totals.get((group, code), 0) + n
            if len(totals) > most:
                yield flush()
        if totals:
            yield flush()

    return run


def learn_profiles(labelled: DataFrame, size: int = 300, languages: int = 1000) -> dict[str, list[int]]:
    """``labelled`` (text, lang) -> language -> its n-grams in rank order."""
    rows = labelled.filter("text is not null and lang is not null").select("text", "lang")
    grams = rows.mapInArrow(_count(), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    found: dict[str, list[int]] = {}
    for row in sorted(top.limit(languages * size + 1).collect(), key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(row["lang"], []).append(row["gram"])
    if len(found) > languages:
        raise ValueError(f"more than {languages} languages to learn")
    return found


class Profiles:
    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.size, self.names = size, sorted(ranked)
        self.grams = np.unique(np.array([g for x in ranked.values() for g in x], dtype=np.int64))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.grams, ranked[name])] = np.arange(len(ranked[name]))

    def classify(self, texts: list[str]) -> tuple[list[str | None], np.ndarray]:
        """Language and score of each text."""
        n = len(texts)
        doc, gram, count = gram_counts(texts, np.arange(n, dtype=np.int64))
        order = np.lexsort((gram, -count, doc))
        doc, gram = doc[order], gram[order]
        start = np.searchsorted(doc, np.arange(n))
        rank = np.arange(len(doc)) - start[doc]
        keep = rank < self.size
        doc, gram, rank = doc[keep], gram[keep], rank[keep]
        most = np.bincount(doc, minlength=n) * self.size
        lettered = np.bincount(doc, weights=gram != (BLANK << 21 | BLANK), minlength=n) > 0
        if not self.names:
            return [None if ok else "und" for ok in lettered.tolist()], np.zeros(n)
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        sums = np.empty((len(self.names), n))
        for i in range(len(self.names)):
            there = self.ranks[i][at]
            sums[i] = np.bincount(doc, weights=np.where(there < 0, self.size, np.abs(there - rank)), minlength=n)
        best = sums.argmin(axis=0)
        score = np.where(lettered, 1 - sums[best, np.arange(n)] / np.maximum(most, 1), 0.0)
        return [self.names[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def _classify(profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in slices(batches, "text", limit=1 << 19, rows=512):
            at = batch.schema.get_field_index("text")
            lang, score = profiles.value.classify(pc.fill_null(batch.column(at), "").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return run


def _keep(profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in slices(batches, "text", limit=1 << 19, rows=512):
            lang, _ = profiles.value.classify(pc.fill_null(batch.column(batch.schema.get_field_index("text")), "").to_pylist())
            yield batch.filter(pa.array([x != "und" for x in lang]))

    return run


def in_some_language(docs: DataFrame, ranked: dict[str, list[int]], size: int = 300) -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not call ``und``, with their own columns only."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(Profiles(ranked, size))), schema)


def identify(docs: DataFrame, ranked: dict[str, list[int]], size: int = 300) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; other columns are kept as they are."""
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "lang_pred string", "score double"])
    return docs.mapInArrow(_classify(docs.sparkSession.sparkContext.broadcast(Profiles(ranked, size))), schema)


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = split_of(F.col("doc_id"), 3) == 1
    profiles = learn_profiles(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
