"""Operator 9: approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest of ``pivots`` pivots, in
order.  ``write_index`` posts all vectors once: a row of its Parquet table is a
segment of about ``segment`` vectors with its pivot inverted files, which are
for each pivot the entries that have it among their nearest and at which place.
A query walks the files of its own nearest pivots in every segment, which gives
Spearman's footrule between the two orders (a pivot that the other order lacks
counts as at place ``prefix``); the best ``share`` of the segment by footrule is
reranked by exact distance, and the best k of all segments are the result.

A task holds one segment at a time.  Queries come in blocks of ``block`` rows;
each block is sent to the tasks and its findings are written before the next
one, so plans do not grow with the number of queries.

Equal vectors are one entry that keeps its k + 1 smallest ids, which is all
that a list of k others can need, so a very common vector costs one entry.
Pivots are a bounded sample of the distinct vectors; every vector is indexed.

Nulls: vectors that are null, zero or hold null or non-finite components take
no part, and neither does a null ``vec_id``.  The index is of the most common
length (of equals the longest); vectors of another length have no distance to
the others and take no part.  Equal ids with equal vectors are one row.  Fewer
candidates than k give fewer rows; an empty table gives none.  Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.llm.common import materialize, scratch_path, table

NEAR_DDL = "query_id long, vec_id long, score double"
SEGMENT = pa.schema([("n", pa.int64()), ("prefix", pa.int32()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("ends", pa.binary()), ("entries", pa.binary()), ("places", pa.binary())])
SEGMENT_DDL = "n long, prefix int, vectors binary, ids array<array<long>>, ends binary, entries binary, places binary"


@dataclass(frozen=True)
class Settings:
    pivots: int = 512
    prefix: int = 64
    share: float = 0.2
    least: int = 200
    segment: int = 16_384
    block: int = 8192


def usable(vector: Column) -> Column:
    """Not null, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    d = (pivots**2).sum(axis=1) - 2 * (vectors @ pivots.T)
    near = np.argpartition(d, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(len(pivots)), (len(vectors), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)


class InvertedFiles:
    """For each pivot the entries that have it among their nearest, and the place."""

    def __init__(self, n: int, prefix: int, ends: np.ndarray, entries: np.ndarray, places: np.ndarray):
        self.n, self.prefix, self.ends, self.entries, self.places = n, prefix, ends, entries, places

    @classmethod
    def of(cls, order: np.ndarray, pivots: int) -> InvertedFiles:
        n, prefix = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        return cls(n, prefix, np.searchsorted(flat[by], np.arange(pivots + 1)), by // prefix, by % prefix)

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule from one order to those of all entries."""
        out = np.full(self.n, self.prefix * (self.prefix + 1), dtype=np.int32)
        for place, pivot in enumerate(query.tolist()):
            a, b = self.ends[pivot], self.ends[pivot + 1]
            there = self.places[a:b].astype(np.int32)
            # both lack nothing here: take back two absences, add the distance of the places
            out[self.entries[a:b]] += np.abs(there - place) - (self.prefix - there) - (self.prefix - place)
        return out


def _post(pivots, settings: Settings):
    """Entries (v, ids) to segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.value
        prefix = min(settings.prefix, len(centres))
        vectors: list[np.ndarray] = []
        ids: list[list[int]] = []

        def segment() -> pa.RecordBatch:
            data = np.concatenate(vectors)
            files = InvertedFiles.of(orders(data, centres, prefix), len(centres))
            row = {
                "n": len(ids), "prefix": prefix, "vectors": data.tobytes(), "ids": ids, "ends": files.ends.astype("<i4").tobytes(),
                "entries": files.entries.astype("<i4").tobytes(), "places": files.places.astype("<i2").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT)

        for batch in batches:
            for at in range(0, batch.num_rows, settings.segment):
                part = batch.slice(at, settings.segment)
                vectors.append(matrix(part.column(0)))
                ids += part.column(1).to_pylist()
                if len(ids) >= settings.segment:
                    yield segment()
                    vectors, ids = [], []
        if ids:
            yield segment()

    return run


def _search(queries, pivots, k: int, settings: Settings):
    """Segments to the k nearest entries of each query in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.value
        q_ids, q_vectors = queries.value
        q_orders = None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                n, prefix = row["n"], row["prefix"]
                if q_orders is None:
                    q_orders = orders(q_vectors, centres, prefix)
                data = np.frombuffer(row["vectors"], "<f8").reshape(n, -1)
                files = InvertedFiles(n, prefix, np.frombuffer(row["ends"], "<i4"), np.frombuffer(row["entries"], "<i4"), np.frombuffer(row["places"], "<i2"))
                take, ids = min(n, max(settings.least, int(np.ceil(settings.share * n)))), row["ids"]
                out: list[tuple] = []
                for q_id, q, order in zip(q_ids, q_vectors, q_orders, strict=True):
                    rule = files.footrule(order)
                    near = np.argpartition(rule, take - 1)[:take] if take < n else np.arange(n)
                    d = np.sqrt(((data[near] - q) ** 2).sum(axis=1))
                    kth = min(k, len(d) - 1)
                    best = np.flatnonzero(d <= np.partition(d, kth)[kth])
                    found = sorted((float(d[i]), v) for i in best.tolist() for v in ids[near[i]] if v != q_id)[:k]
                    out += [(q_id, v, s) for s, v in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id and v, as double, of the rows that take part."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())


def write_index(vectors: DataFrame, path: str, k: int = 10, settings: Settings = Settings()) -> np.ndarray:
    """Post ``vectors`` (vec_id, embedding) in the index table ``path``; the pivots, one row each.

    The index serves lists of up to ``k``.  Without vectors nothing is written.
    """
    rows = _rows(vectors)
    common = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if not common:
        return np.zeros((0, 0))
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    entries = rows.filter(F.size("v") == common["size"]).groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(ids.alias("ids"))
    entries = materialize(entries.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")))
    chosen = np.array([r["v"] for r in entries.select("v").orderBy(F.xxhash64("v"), "v").limit(settings.pivots).collect()])
    entries.mapInArrow(_post(vectors.sparkSession.sparkContext.broadcast(chosen), settings), SEGMENT_DDL).write.parquet(path)
    return chosen


def search_index(spark: SparkSession, path: str, pivots: np.ndarray, queries: DataFrame, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of the index for each of ``queries``."""
    sc = spark.sparkContext
    found = spark.createDataFrame([], NEAR_DDL)
    if len(pivots):
        index, sent, out = spark.read.schema(SEGMENT_DDL).parquet(path), sc.broadcast(pivots), scratch_path(spark, "nearest")
        asked = materialize(_rows(queries).filter(F.size("v") == pivots.shape[1]).distinct())
        blocks = -(-asked.count() // settings.block)
        for i in range(blocks):
            got = sorted(tuple(r) for r in asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect())
            if got:
                block = sc.broadcast(([g[0] for g in got], np.array([g[1] for g in got])))
                index.mapInArrow(_search(block, sent, k, settings), NEAR_DDL).write.mode("append").parquet(out)
                block.destroy()
        if blocks:
            found = spark.read.schema(NEAR_DDL).parquet(out)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """The k nearest found of ``vectors`` for each of ``queries`` (vec_id, embedding both).

    A query's own id is left out.
    """
    path = scratch_path(vectors.sparkSession, "permutation-index")
    return search_index(vectors.sparkSession, path, write_index(vectors, path, k, settings), queries, k, settings)


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
