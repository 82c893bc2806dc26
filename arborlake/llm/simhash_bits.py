"""SimHash fingerprints of whole texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from arborlake.llm.common import slices, utf8
from arborlake.llm.words import MIX, mix

#: byte -> eight bits in 16-bit lanes: lanes 0-3 of the first row, 4-7 of the second
_LANES = np.array([[sum((b >> (4 * half + i) & 1) << 16 * i for i in range(4)) for b in range(256)] for half in range(2)], dtype=np.uint64)
#: a 16-bit lane counts this many values without overflow
_MOST = 65_535


def fingerprint_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit majority of each run of ``lengths`` consecutive hashes (none: zero).

    A bit is one if more than half of the run's hashes have it.
    """
    out = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    if not len(used):
        return out
    sizes = lengths[used]
    parts = -(-sizes // _MOST)  # long runs are summed in parts
    of = np.repeat(np.arange(len(used)), parts)
    within = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + within * _MOST
    first = np.cumsum(parts) - parts
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        column = np.ascontiguousarray(columns[:, byte])
        for half in range(2):
            sums = np.add.reduceat(_LANES[half][column], starts)
            counts = np.add.reduceat(sums.view("<u2").reshape(-1, 4).astype(np.int64), first, axis=0)
            for lane in range(4):
                bit = np.uint64(8 * byte + 4 * half + lane)
                out[used] |= (2 * counts[:, lane] > sizes).astype(np.uint64) << bit
    return out


def shingles(text: bytes, k: int) -> list[bytes]:
    """k-word shingles of the A-Z-lowered text, joined by one blank, repeats included."""
    words = text.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def fingerprints(k: int, seed: int = 42, bands: int = 1):
    """A ``mapInArrow`` function: (doc_id, text) to (doc_id, fingerprint as signed long).

    With several ``bands`` the second column is an array: the fingerprint, and
    those of the same hashes after different mixings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_digest
        for batch in slices(batches, "text", limit=1 << 20):
            made, lengths = [], []
            for text in utf8(batch.column(1)):
                units = shingles(text, k)
                lengths.append(len(units))
                made.append(b"".join(map(digest, units, repeat(seed))))
            hashes = np.frombuffer(b"".join(made), ">u8").astype("<u8")
            counts = np.array(lengths, dtype=np.int64)
            bits = [fingerprint_bits(hashes if not b else mix(hashes + np.uint64(b) * MIX), counts) for b in range(bands)]
            if bands == 1:
                column = pa.array(bits[0].view(np.int64))
            else:
                flat = pa.array(np.stack(bits, axis=1).ravel().view(np.int64))
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(counts) + 1, bands), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc_id", "fp"])

    return run
