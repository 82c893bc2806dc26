"""Operator 2: token ids in directly addressable code files.

Ids are split into 8-bit chunks, low chunk first.  Level ``l`` holds chunk ``l``
of every id that has one; a bitmap of the level says which of its ids go on to
the next level, and a rank directory (ones before each 512-bit block) turns a
position on one level into the position on the next.  So id ``i`` is read with
one chunk access and one rank per level, and no block is decoded.

File format: a Parquet data set, one file for each range of ``doc_id``, one row
for each segment of consecutive documents.  A row holds ``part`` (number of the
range), ``seq`` (number in the range), ``before`` (ids earlier in the range),
``n_tokens``, ``doc_ids``, ``doc_ends`` (running id counts in the segment) and
``levels`` (width, count, chunks, bitmap, ranks).  Spark's writers commit whole
files, so a lost executor leaves no half segment.

``token_at`` and ``tokens_at`` turn positions in the whole data set into a
segment and an offset, and read single ids there without decoding others.

Nulls: a null text is an empty one; null ``doc_id`` sorts first.  Repeated
``doc_id`` rows stay apart, in the order of a hash of their text, so that rows
of one id can be dealt to several ranges.  A text longer than a segment has one
of its own.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import scratch_path, table

BLOCK = 512
LEVEL = pa.struct([("width", pa.int32()), ("count", pa.int64()), ("chunks", pa.binary()), ("bitmap", pa.binary()), ("ranks", pa.binary())])
SEGMENT = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("levels", pa.list_(LEVEL))]
)
SEGMENT_DDL = "part int, seq int, before long, n_tokens long, doc_ids array<long>, doc_ends array<long>, levels array<struct<width:int,count:long,chunks:binary,bitmap:binary,ranks:binary>>"
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def encode_levels(ids: np.ndarray, width: int = 8) -> list[dict]:
    """Chunk levels of ``ids`` (unsigned), each with its bitmap and rank directory."""
    levels, rest, low = [], ids.astype(np.uint32), np.uint32((1 << width) - 1)
    while True:
        more = rest > low
        bits = np.packbits(more, bitorder="little")
        ones = np.zeros(-(-max(len(rest), 1) // BLOCK) + 1, dtype="<u4")
        if len(rest):
            per = np.add.reduceat(_ONES[bits].astype(np.uint32), np.arange(0, len(bits), BLOCK // 8))
            ones[1 : len(per) + 1] = np.cumsum(per)
        levels.append({"width": width, "count": len(rest), "chunks": (rest & low).astype(np.uint8).tobytes(), "bitmap": bits.tobytes(), "ranks": ones.tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(width)


class Segment:
    """Random access to the ids of one segment."""

    def __init__(self, levels: list[dict]):
        self.levels = [(x["width"], np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["bitmap"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def __len__(self) -> int:
        return len(self.levels[0][1])

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit ``i`` of a level."""
        _, _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        at = block * BLOCK // 8
        whole = int(_ONES[bitmap[at : i // 8]].sum())
        part = int(_ONES[bitmap[i // 8] & ((1 << i % 8) - 1)]) if i % 8 else 0
        return int(ranks[block]) + whole + part

    def __getitem__(self, i: int) -> int:
        value = shift = 0
        for k, (width, chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(k, i), shift + width
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, reached through the rank directories."""
        spans = [(start, stop)]
        for k, (_, _, bitmap, _) in enumerate(self.levels[:-1]):
            a, b = spans[-1]
            first = self._rank(k, a) if a < b else 0
            on = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].sum(dtype=np.int64) if a < b else 0
            spans.append((first, first + int(on)))
        out = np.zeros(0, dtype=np.uint32)
        for k in range(len(self.levels) - 1, -1, -1):
            width, chunks, bitmap, _ = self.levels[k]
            a, b = spans[k]
            value = chunks[a:b].astype(np.uint32)
            if k + 1 < len(self.levels) and a < b:
                on = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
                value[on] |= out << np.uint32(width)
            out = value
        return out


def _segments(path: str, end_id: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from arborlake.llm.tokenization import encoder

        encode, end = encoder(path).encode, np.array([end_id], dtype="<u4").tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, ends, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "before": before, "n_tokens": size, "doc_ids": ids, "doc_ends": ends, "levels": encode_levels(np.frombuffer(b"".join(parts), "<u4"))}
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code = encode(text.as_py()) + end
                size += len(code) // 4
                ids.append(doc_id)
                ends.append(size)
                parts.append(code)
                if size >= limit:
                    yield flush()
                    seq, before = seq + 1, before + size
                    ids, ends, parts, size = [], [], [], 0
        if ids:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_tokens: int = 1 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write the files in ascending ``doc_id`` order.

    One range shuffle of the texts orders them; encoding, splitting and writing
    share its stage.  A task holds one segment at a time.
    """
    # equal rows are told apart by their place in the input; which of them comes first makes no difference
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("nth"))
    order = ["doc_id", "text_hash", "nth"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer, end_id, segment_tokens), SEGMENT_DDL).write.mode("errorifexists").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            segment, at, out = Segment(row["levels"]), 0, []
            for doc_id, end in zip(row["doc_ids"], row["doc_ends"], strict=True):
                crc = zlib.crc32(segment.range(at, end).astype("<u4").tobytes())
                out.append((doc_id, row["first"] + at, end - at, crc, row["part"], row["seq"], at))
                at = end
            columns = zip(*out, strict=True)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()]
            names = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "seq", "segment_offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _first_of_files(files: DataFrame) -> list[tuple[int, int]]:
    """(part, ids in all files before it): one number for each written file."""
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    ends = list(accumulate((n for _, n in totals), initial=0))
    return [(part, first) for (part, _), first in zip(totals, ends, strict=False)]


def _with_first(files: DataFrame) -> DataFrame:
    """Segments with ``first``, the ids of the data set before each."""
    first = F.broadcast(files.sparkSession.createDataFrame(_first_of_files(files), "part int, part_first long"))
    return files.join(first, "part").withColumn("first", F.col("part_first") + F.col("before")).drop("part_first")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at ``position`` of the data set; only its segment is read."""
    files = spark.read.schema(SEGMENT_DDL).parquet(path)
    firsts = _first_of_files(files)
    i = bisect_right([first for _, first in firsts], position) - 1
    if i >= 0:
        part, first = firsts[i]
        inside = (F.col("part") == part) & (F.col("before") <= position - first) & (F.col("before") + F.col("n_tokens") > position - first)
        if row := files.filter(inside).select("before", "levels").first():
            return Segment(row["levels"])[position - first - row["before"]]
    raise IndexError(position)


def _lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            segment = Segment(row["levels"])
            ids = [segment[p - row["first"]] for p in row["positions"]]
            yield pa.RecordBatch.from_arrays([pa.array(row["positions"], pa.int64()), pa.array(ids, pa.int64())], ["position", "token_id"])


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position, token_id for each distinct ``position`` inside the data set; others and nulls are left out.

    Segments are entered in all cells of ``width`` positions that they overlap,
    so a position finds its segment by an equi-join.  The positions of a
    segment meet in one row, which its size bounds.
    """
    segments = _with_first(spark.read.schema(SEGMENT_DDL).parquet(path)).filter("n_tokens > 0")
    width = segments.agg(F.max("n_tokens")).first()[0] or 1
    stop = F.col("first") + F.col("n_tokens")
    places = segments.select("first", stop.alias("stop"), F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((stop - 1) / width))).alias("cell"))
    asked = positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("cell", F.floor(F.col("position") / width))
    found = asked.join(places, "cell").filter("position >= first and position < stop").groupBy("first").agg(F.collect_list("position").alias("positions"))
    return segments.select("first", "levels").join(found, "first").mapInArrow(_lookups, "position long, token_id long")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document: its global start, length and the crc of its ids.

    What goes to the driver is one number for each written file.
    """
    rows = _with_first(spark.read.schema(SEGMENT_DDL).parquet(path))
    return rows.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int, segment_offset long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
