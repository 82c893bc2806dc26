"""Hashes and repairs that Spark has no expression for, as vectorised UDFs."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a_64(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(T.LongType())
def fnv_signed(tokens: pd.Series) -> pd.Series:
    """FNV-1a 64 of a token as a signed long; distinct tokens are hashed once."""
    made = {t: fnv1a_64(t.encode()) for t in tokens.unique() if t is not None}
    return tokens.map(lambda t: None if t is None else made[t] - (1 << 64) if made[t] >> 63 else made[t]).astype("Int64")


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_byte", _one_byte)


def repair_utf8(data: bytes | None) -> str | None:
    """Text in which every byte that is no UTF-8 is one replacement character."""
    return None if data is None else bytes(data).decode("utf-8", "one_byte")


@F.pandas_udf(T.StringType())
def repaired(data: pd.Series) -> pd.Series:
    codecs.register_error("one_byte", _one_byte)
    return data.map(repair_utf8)


def fnv1a_32(text: Column) -> Column:
    """FNV-1a of 32 bits as a long; products stay below 2^57, so no Python is needed."""
    data = F.encode(text, "UTF-8")
    at = F.filter(F.sequence(F.lit(0), F.octet_length(text)), lambda i: i > 0)
    octets = F.transform(at, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(2_166_136_261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16_777_619)).bitwiseAND(F.lit(0xFFFFFFFF)))
