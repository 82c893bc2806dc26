"""What the operators share: table access, shared scratch space, batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arborlake.session import checkpointed, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    return checkpointed(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which readers can prune."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@lru_cache(maxsize=1)
def _trim() -> Callable[[], object]:
    import ctypes

    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda: None
    return lambda: trim(0)


def give_back() -> None:
    """Return memory that earlier tasks of this worker process have freed to the machine."""
    pa.default_memory_pool().release_unused()
    _trim()()


def slices(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20, rows: int = 1 << 14
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``text``.

    A single longer text forms a batch of its own, so memory follows the
    longest text and not the number of rows in a batch.  What a worker process
    has freed is given back before and after.
    """
    import numpy as np
    import pyarrow.compute as pc

    give_back()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, base + limit, side="right"))
            to = min(max(to, at + 1), at + rows, n)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8 bytes, null as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches, "text"):
        packed = pa.array(map(pack, utf8(batch.column(2))), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["doc_id", "row_key", "packed"])


def zipped(keyed: DataFrame) -> DataFrame:
    """Texts before a shuffle, compressed one by one: (doc_id, row_key, text) to (doc_id, row_key, packed)."""
    return keyed.select("doc_id", "row_key", "text").mapInArrow(_zip, "doc_id long, row_key long, packed binary")


def unzip(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column ``packed``."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(x.as_py()) for x in column)
