"""MinHash keys and SimHash fingerprints of shingle sets, and the sets as hashes, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from arborlake.llm.common import slices, unzip, utf8
from arborlake.llm.simhash_bits import fingerprint_bits, shingles
from arborlake.llm.words import MIX, mix

SKETCH_DDL = "doc_id long, row_key long, node long, fp long, keys array<long>"


def sketches(k: int, bands: int, rows: int, seed: int = 42):
    """A ``mapInArrow`` function: (doc_id, row_key, text) to ``SKETCH_DDL``.

    ``node`` hashes the set of k-word shingles, ``fp`` is its SimHash; each of the
    ``bands`` keys hashes the least of the set under ``rows`` orders.  Two sets of
    similarity s share a key with probability 1 - (1 - s ** rows) ** bands.  A
    text without words has node and fingerprint zero and no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_digest
        orders = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * MIX + np.uint64(seed)) | np.uint64(1)
        for batch in slices(batches, "text", limit=1 << 19):
            made, lengths = [], []
            for text in utf8(batch.column(2)):
                units = set(shingles(text, k))
                lengths.append(len(units))
                made.append(b"".join(map(digest, units, repeat(seed))))
            hashes = np.frombuffer(b"".join(made), ">u8").astype("<u8")
            counts = np.array(lengths, dtype=np.int64)
            used = np.flatnonzero(counts)
            node, keys = np.zeros(len(counts), dtype=np.uint64), np.zeros((len(used), bands), dtype=np.uint64)
            if len(used):
                starts = (np.cumsum(counts) - counts)[used]
                node[used] = np.add.reduceat(mix(hashes + MIX), starts)
                for band in range(bands):
                    key = np.full(len(used), band, dtype=np.uint64)
                    for order in orders[band * rows : (band + 1) * rows]:
                        key = mix(key * MIX ^ np.minimum.reduceat(hashes * order, starts))
                    keys[:, band] = key
            ends = np.concatenate([[0], np.cumsum((counts > 0) * bands)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            fp = fingerprint_bits(hashes, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(fp), lists], ["doc_id", "row_key", "node", "fp", "keys"])

    return run


def shingle_hashes(k: int, seed: int = 42):
    """A ``mapInArrow`` function: (node, packed) to (node, size, hashes of its set of shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_digest
        for batch in slices(batches, "packed", limit=1 << 19):
            made = [b"".join(map(digest, set(shingles(text, k)), repeat(seed))) for text in unzip(batch.column(1))]
            ends = np.cumsum([0, *map(len, made)]) // 8
            flat = np.frombuffer(b"".join(made), ">i8").astype("<i8")
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), lists], ["node", "size", "hashes"])

    return run


def spanning_links(similarity: float):
    """A ``mapInArrow`` function: sets sorted by task to links (a, b) that join all similar sets of a task.

    Columns are node, key, lo, hi, crossed, side, hashes.  A task is a run of
    equal (key, lo, hi, crossed).  Crossed tasks compare side -1 with the others,
    tasks of one block all their pairs, any other the block lo with the block hi.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sides, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            pairs = _links(np.array(nodes), np.array(sides), sets, now, similarity)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], ["a", "b"])

        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            tasks = list(zip(*(column[n].to_pylist() for n in ("key", "lo", "hi", "crossed")), strict=True))
            for i, (task, node, side) in enumerate(zip(tasks, column["node"].to_pylist(), column["side"].to_pylist(), strict=True)):
                if task != now:
                    if nodes:
                        yield links()
                    now, nodes, sides, sets = task, [], [], []
                nodes.append(node)
                sides.append(side)
                sets.append(column["hashes"][i].values.to_numpy())
        if nodes:
            yield links()

    return run


def _links(nodes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], task: tuple, similarity: float) -> list[tuple[int, int]]:
    """Links that join all similar sets of a task; shared hashes are counted through the postings of its left side."""
    _, lo, hi, crossed = task
    left = np.flatnonzero(sides == (-1 if crossed else lo))
    right = np.flatnonzero(sides != -1) if crossed else np.flatnonzero(sides == hi)
    if not len(left) or not len(right):
        return []
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate([sets[i] for i in left])
    owner = np.repeat(np.arange(len(left)), sizes[left])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    root, out = np.arange(len(nodes)), []
    for j in right:
        first, last = np.searchsorted(flat, sets[j]), np.searchsorted(flat, sets[j], side="right")
        n = last - first
        both = np.bincount(owner[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(left))
        for k in np.flatnonzero(both >= similarity * (sizes[left] + sizes[j] - both)):
            i = left[k]
            if root[i] != root[j]:
                out.append((int(nodes[i]), int(nodes[j])))
                root[root == root[j]] = root[i]
    return out
