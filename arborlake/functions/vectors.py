"""Vector functions over array columns."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null where lengths differ."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), d)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(scale, F.lit(0.0)))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: (x / F.nullif(n, F.lit(0.0))).cast("float")))


def valid_vector(a: Column, size: int) -> Column:
    """Right length, finite, not zero."""
    return (F.size(a) == size) & F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(a, lambda x: x != 0)


def one_hot(value: Column, values: list[str]) -> Column:
    """A one at the value's place; all zero for an unknown one."""
    return F.array(*(F.when(value == v, F.lit(1.0)).otherwise(F.lit(0.0)) for v in values))


def concat_blocks(blocks: list[tuple[Column, float, int]]) -> Column:
    """Blocks (vector or null, weight, size) side by side, scaled, unit length."""

    def scaled(v: Column, weight: float) -> Column:
        return F.transform(v, lambda x: (x * weight).cast("float"))

    parts = [F.coalesce(scaled(v, weight), F.array_repeat(F.lit(0.0).cast("float"), n)) for v, weight, n in blocks]
    return l2_normalize(F.concat(*parts))


def pack_floats(values: list[float]) -> bytes:
    """Little-endian float32, as vectors are stored."""
    return struct.pack(f"<{len(values)}f", *values)


def unpack_floats(blob: bytes) -> list[float]:
    if len(blob) % 4:
        raise ValueError("a vector blob is a whole number of float32")
    return list(struct.unpack(f"<{len(blob) // 4}f", blob))


#: Primary languages with a place of their own; all others share the last.
LANGUAGES = ["Go", "Python", "JavaScript", "TypeScript", "Java", "Rust", "C++", "C#", "Ruby", "PHP", "Shell", "Kotlin", "Swift", "Solidity"]


def language_one_hot(language: Column) -> Column:
    """A place for each of ``LANGUAGES`` and one for any other."""
    other = F.coalesce(language.isin(LANGUAGES), F.lit(False))
    return F.concat(one_hot(language, LANGUAGES), F.array(F.when(other, F.lit(0.0)).otherwise(F.lit(1.0))))
