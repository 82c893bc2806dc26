"""Operator 8: vector bin packing of examples into training sequences.

An example asks for a vector (tokens, segments, loss-bearing tokens) and a
sequence has a limit for each.  The dot-product heuristic keeps one sequence
open and always places the example that fits and whose vector, scaled by the
limits, has the largest dot product with what the sequence has left; when none
fits the sequence is closed.  Examples with equal vectors are interchangeable,
so the choice is among distinct vectors.

A sequence that its segments or loss fill first is padded, as is any of whole
examples.  Plain documents may be cut (``cut=True``): whole sequences come off the front
of long ones, a gap that no example fits is filled with the front of one, and
what is left at the end of a partition goes to sequences whose lengths are
powers of two, which need no padding.  Conversations are not cut.

Each task packs the rows of its own partition in windows of bounded size and
carries the open rest over, so nothing is shuffled and a lost task is simply
run again on the same rows.

Nulls: a null text is an empty one (it still has its end id); a null or
repeated ``doc_id`` is carried as it is, each row being a document of its own.
An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import slices, table

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("segment", pa.int32()), ("offset", pa.int64()), ("ids", pa.binary())]
)
PIECES_DDL = "doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, segment int, offset long, ids binary"


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


class Packer:
    """Packs items (key, start, length, loss); ``put`` takes them, ``close`` gives sequences.

    A sequence is a list of items in order.  ``key`` is any object.
    """

    def __init__(self, limits: Limits, cut: bool):
        if cut and limits.loss < limits.tokens:
            raise ValueError("cut examples bear loss on every token, so loss must not be under tokens")
        self.limits, self.cut = limits, cut
        self.pool: dict[tuple[int, int], list[tuple]] = {}
        self.slots: dict[tuple[int, int], int] = {}
        self.vectors = np.zeros((0, 3))
        self.free: list[int] = []

    def put(self, key: object, start: int, length: int, loss: int) -> None:
        if length > self.limits.tokens or loss > self.limits.loss:
            raise ValueError(f"an example of {length} tokens, {loss} with loss, is over the limits {self.limits}")
        kind = (length, loss)
        if kind not in self.pool:
            self.pool[kind] = []
            if not self.free:
                n = len(self.vectors)
                self.vectors = np.vstack([self.vectors, np.full((max(64, n), 3), np.inf)])
                self.free = list(range(len(self.vectors) - 1, n - 1, -1))
            at = self.slots[kind] = self.free.pop()
            self.vectors[at] = (length / self.limits.tokens, 1 / self.limits.segments, loss / max(1, self.limits.loss))
        self.pool[kind].append((key, start, length, loss))

    def _take(self, kind: tuple[int, int]) -> tuple:
        item = self.pool[kind].pop()
        if not self.pool[kind]:
            del self.pool[kind]
            at = self.slots.pop(kind)
            self.vectors[at] = np.inf
            self.free.append(at)
        return item

    def _best(self, left: np.ndarray) -> tuple[int, int] | None:
        fits = (self.vectors <= left + 1e-12).all(axis=1)
        if not fits.any():
            return None
        at = int(np.argmax(np.where(fits, np.where(fits[:, None], self.vectors, 0) @ left, -1)))
        return (round(self.vectors[at, 0] * self.limits.tokens), round(self.vectors[at, 2] * max(1, self.limits.loss)))

    def sequences(self, last: bool) -> Iterator[list[tuple]]:
        """Closed sequences; unless ``last``, the open rest goes back to the pool."""
        top = self.limits
        while self.pool:
            items, left = [], np.ones(3)
            tokens = segments = loss = 0
            while self.pool and segments < top.segments and tokens < top.tokens:
                kind = self._best(left)
                if kind is None:
                    if not self.cut:
                        break
                    gap = top.tokens - tokens
                    key, start, length, _ = self._take(max(self.pool))
                    self.put(key, start + gap, length - gap, length - gap)
                    item = (key, start, gap, gap)
                else:
                    item = self._take(kind)
                items.append(item)
                tokens, segments, loss = tokens + item[2], segments + 1, loss + item[3]
                left = np.array([(top.tokens - tokens) / top.tokens, (top.segments - segments) / top.segments, (top.loss - loss) / max(1, top.loss)])
            if not self.pool and tokens < top.tokens and segments < top.segments:
                if not last:
                    for item in items:
                        self.put(*item)
                    return
                if self.cut:
                    yield from _powers_of_two(items, tokens)
                    return
            yield items


def _powers_of_two(items: list[tuple], tokens: int) -> Iterator[list[tuple]]:
    """The items again, cut into sequences whose lengths are the powers of two in ``tokens``."""
    queue = items[::-1]
    for bit in range(tokens.bit_length() - 1, -1, -1):
        room, out = tokens & 1 << bit, []
        while room:
            key, start, length, _ = queue.pop()
            n = min(room, length)
            out.append((key, start, n, n))
            if n < length:
                queue.append((key, start + n, length - n, length - n))
            room -= n
        if out:
            yield out


def _pack_documents(path: str, end_id: int, limits: Limits, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from arborlake.llm.tokenization import encoder

        encode, end = encoder(path).encode, np.array([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 33
        packer, held, rows = Packer(limits, cut=True), 0, []

        def emit(items: list[tuple]) -> None:
            nonlocal number
            at = 0
            for segment, ((doc_id, code), start, length, loss) in enumerate(items):
                rows.append((doc_id, start, length, len(code) // 4, loss, number, segment, at, code[4 * start : 4 * (start + length)]))
                at += length
            number += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)
            rows.clear()
            return out

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code = encode(text.as_py()) + end
                n, start, key = len(code) // 4, 0, (doc_id, code)
                while n - start >= limits.tokens:
                    emit([(key, start, limits.tokens, limits.tokens)])
                    start += limits.tokens
                if start < n:
                    packer.put(key, start, n - start, n - start)
                    held += n
            if held >= window:
                for items in packer.sequences(last=False):
                    emit(items)
                held = 0
            if rows:
                yield flush()
        for items in packer.sequences(last=True):
            emit(items)
        if rows:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits(), window_tokens: int = 1 << 22) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their ids and their place in a sequence.

    ``sequence_id`` is unique over all partitions.  ``window_tokens`` bounds the
    ids that a task holds.
    """
    return docs.select("doc_id", "text").mapInArrow(_pack_documents(tokenizer, end_id, limits, window_tokens), PIECES_DDL)


def _pack_items(limits: Limits, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        packer, held = Packer(limits, cut=False), 0

        def rows(last: bool) -> list[tuple]:
            nonlocal number
            out = []
            for items in packer.sequences(last):
                at = 0
                for segment, (key, _, length, loss) in enumerate(items):
                    out.append((key, length, loss, number, segment, at))
                    at += length
                number += 1
            return out

        def block(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            names = ["item_id", "tokens", "loss_tokens", "sequence_id", "segment", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            over = []
            for key, length, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                length, loss = length or 0, loss or 0
                if length > limits.tokens or loss > limits.loss:
                    over.append((key, length, loss, None, None, None))
                else:
                    packer.put(key, 0, length, loss)
                    held += 1
            if over:
                yield block(over)
            if held >= window and (out := rows(last=False)):
                held = 0
                yield block(out)
        if out := rows(last=True):
            yield block(out)

    return run


def pack_items(items: DataFrame, limits: Limits, window_items: int = 1 << 17) -> DataFrame:
    """Pack whole examples ``items`` (item_id, tokens, loss_tokens), as for instruction data.

    Null counts are zero; an example over a limit fits nowhere and has a null sequence.
    """
    return items.select("item_id", "tokens", "loss_tokens").mapInArrow(_pack_items(limits, window_items), "item_id long, tokens long, loss_tokens long, sequence_id long, segment int, offset long")


def _turn_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from arborlake.llm.tokenization import encoder

        encode = encoder(path).encode
        for batch in slices(batches, "text"):
            n = pa.array([len(encode(t.as_py())) // 4 + 1 for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["item_id", "bears_loss", "tokens"])

    return run


def conversation_items(turns: DataFrame, tokenizer: str) -> DataFrame:
    """item_id, tokens, loss_tokens of each conversation of ``turns`` (conv_id, role, text).

    A turn has the ids of its text (null: none) and an end id; those of the
    assistant bear loss.  Turns without conv_id are one conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("item_id"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("bears_loss"), "text")
    counted = rows.mapInArrow(_turn_tokens(tokenizer), "item_id long, bears_loss boolean, tokens long")
    loss = F.when(F.col("bears_loss"), F.col("tokens")).otherwise(0)
    return counted.groupBy("item_id").agg(F.sum("tokens").alias("tokens"), F.sum(loss).alias("loss_tokens"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in sequences of 1024 tokens, 16 segments and 640 tokens with loss; longer ones have none."""
    import public_tokenizers

    items = conversation_items(table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack_items(items, Limits(1024, 16, 640))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens")
