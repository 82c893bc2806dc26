"""Operator 6: benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-gram hashes the smallest is kept (the
last of equals).  The choice depends on those words alone, so a run of
``window`` words that a document shares with an item makes the same choice in
both: one kept fingerprint falls in it on each side, at the same place.  Kept
fingerprints of documents are joined with those of the benchmark; each hit is
extended to all windows that contain it, and a window counts when its words
occur in an item.  Items of fewer words than a window are windows of their own
and use k equal to their length, where winnowing keeps every k-gram.

The benchmark is dealt into blocks by the hash of the item; a block holds up to
``block_bytes`` of texts (a longer item is a block with what shares its hash),
which is checked, and about 15 times that in the tables that are sent to the
tasks.  The documents are read once for each block.  Benchmarks of one block,
the usual case, take one pass and no shuffle.  With more blocks the hit word runs of a document are
merged over blocks by its row key.

Nulls: null texts have no words; a null ``item_id`` is left out of the item
list but its windows still hit.  Equal items all count.  Rows that repeat a
``doc_id`` are judged one by one.  Empty benchmark: nothing is contaminated.
Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import slices, table, utf8
from arborlake.llm.words import WordHashes, alnum_words, gram_hashes

HITS_DDL = "doc_id long, row_key long, n_words long, hit_runs array<struct<first:long,last:long>>, item_ids array<string>"
RUN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
HITS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("hit_runs", pa.list_(RUN)), ("item_ids", pa.list_(pa.string()))])


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Sorted positions of the smallest (last of equals) in every w consecutive values."""
    n = len(grams) - w + 1
    if n <= 0 or w == 1:
        return np.arange(max(0, n))
    best, at = grams[w - 1 :].copy(), np.arange(w - 1, len(grams))
    for j in range(w - 2, -1, -1):
        less = grams[j : j + n] < best
        best[less] = grams[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at)


class Block:
    """Windows of some items, by length, with the fingerprints that lead to them.

    The words of all items lie one after the other in ``words``; a window is a
    place there.  For each length, ``keys`` are the sorted hashes of all
    windows, ``at`` and ``item`` their places and items.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int, k: int):
        self.window, self.k = window, k
        self.names = [item_id for item_id, _ in items]
        hashes = WordHashes()
        parts: list[bytes] = []
        starts: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, int, np.ndarray]]] = {}
        base = first = 0
        for i, (_, text) in enumerate(items):
            words = alnum_words(text.encode())
            n = min(window, len(words))
            if not n:
                continue
            h = np.array([hashes[w] for w in words], dtype=np.uint64)
            gram, wide = self.shape(n)
            grams = gram_hashes(h, gram)
            keys = gram_hashes(h, n)
            found.setdefault(n, []).append((keys, first + np.arange(len(keys)), i, grams[winnow(grams, wide)]))
            lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
            starts.append(base + np.cumsum(lengths) - lengths)
            parts.append(b" ".join(words))
            base, first = base + int(lengths.sum()), first + len(words)
        self.words = b" ".join(parts) + b" "
        self.starts = np.concatenate([*starts, [base]]).astype(np.int64)
        self.prints, self.keys, self.at, self.item = {}, {}, {}, {}
        for n, rows in found.items():
            keys = np.concatenate([r[0] for r in rows])
            order = np.argsort(keys, kind="stable")
            self.keys[n] = keys[order]
            self.at[n] = np.concatenate([r[1] for r in rows])[order]
            self.item[n] = np.repeat(np.array([r[2] for r in rows], dtype=np.int32), [len(r[0]) for r in rows])[order]
            self.prints[n] = np.unique(np.concatenate([r[3] for r in rows]))

    def shape(self, n: int) -> tuple[int, int]:
        """k and the winnowing width for windows of n words."""
        k = self.k if n == self.window else n
        return k, n - k + 1

    def window_items(self, n: int, key: np.uint64, run: bytes) -> np.ndarray:
        """Items (by number, repeats included) that hold the words ``run``, whose hash is ``key``."""
        a, b = np.searchsorted(self.keys[n], key), np.searchsorted(self.keys[n], key, side="right")
        same = [self.words[self.starts[p] : self.starts[p + n] - 1] == run for p in self.at[n][a:b].tolist()]
        return self.item[n][a:b][same]

    def match(self, words: list[bytes], h: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, last) and the items whose windows occur."""
        covered, items = [], set()
        for n, prints in self.prints.items():
            if len(words) < n:
                continue
            k, wide = self.shape(n)
            grams = gram_hashes(h, k)
            at = winnow(grams, wide)
            hit = at[_among(grams[at], prints)]
            if not len(hit):
                continue
            starts = np.unique((hit[:, None] - np.arange(wide)).ravel())
            starts = starts[(starts >= 0) & (starts <= len(words) - n)]
            first, last = int(starts[0]), int(starts[-1])
            values = gram_hashes(h[first : last + n], n)[starts - first]
            ok = _among(values, self.keys[n])
            known: dict[tuple[int, bytes], bool] = {}
            for i, value in zip(starts[ok].tolist(), values[ok], strict=True):
                window = int(value), b" ".join(words[i : i + n])
                if window not in known:
                    mine = np.unique(self.window_items(n, value, window[1]))
                    known[window] = len(mine) > 0
                    items.update(mine.tolist())
                if known[window]:
                    covered.append((i, i + n - 1))
        return merge_runs(covered), {self.names[i] for i in items} - {None}


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _match(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, items = WordHashes(), block.value
        for batch in slices(batches, "text"):
            n_words, runs, ids = [], [], []
            for text in utf8(batch.column(2)):
                words = alnum_words(text)
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                hit, found = items.match(words, h)
                n_words.append(len(words))
                runs.append([{"first": a, "last": b} for a, b in hit])
                ids.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(ids, pa.list_(pa.string()))], schema=HITS)

    return run


def _keep_clean(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, items = WordHashes(), block.value
        for batch in slices(batches, "text"):
            clean = []
            for text in utf8(batch.column(batch.schema.get_field_index("text"))):
                words = alnum_words(text)
                clean.append(not items.match(words, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))[0])
            yield batch.filter(pa.array(clean))

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of at most ``block_bytes`` of text, or of one hash; each is read from the table by its number."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    hashed = F.xxhash64("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_bytes))
    longest = items.agg(F.max(F.octet_length("text"))).first()[0] or 0
    while n > 1:  # uneven hashes: more blocks, until the largest is small enough
        largest = items.groupBy(F.pmod(hashed, F.lit(n)).alias("b")).agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= max(2 * block_bytes, longest + block_bytes):
            break
        n *= 2
    for i in range(n):
        part = items.filter(F.pmod(hashed, F.lit(n)) == i) if n > 1 else items
        yield [(r[0], r[1]) for r in part.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """For each row of ``docs``: word count, runs of hit words and the items hit."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"), "text")
    parts = [rows.mapInArrow(_match(sc.broadcast(Block(items, window, k))), HITS_DDL) for items in _blocks(benchmark, block_bytes)]
    if len(parts) == 1:
        return parts[0]
    every = parts[0].withColumn("copies", F.lit(1))
    for part in parts[1:]:
        every = every.unionByName(part.withColumn("copies", F.lit(0)))
    merged = every.groupBy("doc_id", "row_key").agg(F.max("n_words").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("hit_runs")))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.sum("copies").alias("copies"))
    # runs in order of their starts; a run joins the last one when it begins in it or right after it
    joined = F.aggregate(
        "runs",
        F.array().cast("array<struct<first:long,last:long>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (x["first"] <= F.element_at(out, -1)["last"] + 1),
            F.concat(
                F.slice(out, F.lit(1), F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["last"], x["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(out, F.array(x))),
    )
    each = merged.withColumn("hit_runs", joined).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "row_key", "n_words", "hit_runs", "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no window of ``benchmark``, with their own columns; nothing is shuffled."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    for items in _blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(_keep_clean(docs.sparkSession.sparkContext.broadcast(Block(items, window, k))), schema)
    return docs


def contamination_report(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def empty_digest() -> str:
    """``items_sha256`` of a document that no item hits."""
    return hashlib.sha256(b"").hexdigest()
