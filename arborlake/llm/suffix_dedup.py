"""Operator 7: exact removal of byte strings of ``length`` that occur twice.

Sorting every suffix of a corpus is not needed to find its repeated strings of
400 bytes.  Each window of 400 bytes has an anchor: of its first ``span``
32-byte grams the one with the smallest hash (the last of equals).  Equal
windows have equal grams, so they have their anchors at the same place.  Hence
windows can only be equal if their anchors share the ``core``, the bytes from
the anchor on that every one of its windows holds.  The steps:

1. Anchors of all texts, each with the run of windows it serves, the hash of
   its core and of its union (all bytes of those windows).
2. Anchors are counted by core and union.  A core seen once is done.  A union
   seen twice makes all its windows repeated; unions with a thousandth of all
   anchors are few and meet their anchors by broadcast.  What is left are cores with
   several unions, near the ends of repeated passages; one suffix for each
   such union goes on.
3. Distributed merge sort: tasks sort these suffixes into runs and exchange
   them front-coded; the receivers merge runs with a loser tree that reuses
   known common prefixes (``lcp_merge``).  Neighbours that share a core form a
   group; the prefixes between neighbours give the common bytes R of any two
   members to the right, a second sort of what precedes the anchors the common
   bytes L to the left, and windows from p - L to p + R - 400 are repeated.
4. Cores with more than ``group`` unions would make groups of any size; their
   windows are hashed one by one (128 bits) and dealt by that hash instead,
   which is exact too and splits the hottest passage over all tasks.  Windows
   that a task holds twice are settled there and one of each goes on, so a
   bucket gets at most one of a kind from each lot of a task.
5. Runs of repeated windows are merged by document and cut from its bytes.

A repeated row sends its suffixes twice, but only such as are repeated anyway.

Nulls: a null text has no bytes.  A null ``doc_id`` is carried.  Rows with equal
``doc_id`` and text are two documents: their windows occur twice and all go.
Texts under 400 bytes are untouched; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import scratch_path, slices, table, unzip, utf8, zipped
from arborlake.llm.lcp_merge import common_prefix, front_code, front_decode, merge, sorted_run
from arborlake.llm.words import mix
from arborlake.operators.skew import join_counted

GRAM = 32
ANCHORS_DDL = "row_key long, p long, lo long, hi long, core long, u1 long, u2 long"
SORTED, HASHED, SETTLED = 0, 1, 2  # what a row of RUNS holds
RUNS = pa.schema(
    [("bucket", pa.int64()), ("kind", pa.int32()), ("row_keys", pa.binary()), ("places", pa.binary()), ("shared", pa.binary()), ("sizes", pa.binary()), ("rests", pa.binary()), ("before", pa.binary())]
)
RUNS_DDL = "bucket long, kind int, row_keys binary, places binary, shared binary, sizes binary, rests binary, before binary"
SPANS_DDL = "row_key long, start long, stop long"


def anchors(data: bytes, ends: np.ndarray, length: int, span: int) -> np.ndarray:
    """Rows (text, anchor, first window, last window) of texts that end at ``ends`` in ``data``.

    Places are in ``data``; windows never leave their text.
    """
    n = len(data)
    if n < length:
        return np.zeros((0, 4), dtype=np.int64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    step, power = 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while step < GRAM:
            h = h[:-step] * power + h[step:]
            power, step = power * power, 2 * step
    low = np.uint64((1 << 31) - 1)  # places; a column holds less than 2 GB
    key = (mix(h) & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    best, wide = key, 1
    while 2 * wide <= span:
        best = np.minimum(best[:-wide], best[wide:])
        wide *= 2
    if wide < span:
        best = np.minimum(best[: len(best) - (span - wide)], best[span - wide :])
    at = (low - (best & low)).astype(np.int64)[: n - length + 1]
    text = np.searchsorted(ends, np.arange(len(at)), side="right")
    inside = np.arange(len(at)) + length <= ends[text]
    starts = np.flatnonzero(inside & np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1]])
    stops = np.flatnonzero(inside & np.r_[(at[1:] != at[:-1]) | ~inside[1:], True])
    return np.stack([text[starts], at[starts], starts, stops], axis=1)


def _anchor_rows(length: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        core = length - span + 1
        one, two = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in slices(batches, "text", limit=4 << 20):
            texts = utf8(batch.column(1))
            for first, last in _parts([len(t) for t in texts]):
                data = b"".join(texts[first:last])
                ends = np.cumsum([len(t) for t in texts[first:last]])
                rows = anchors(data, ends, length, span)
                base = np.r_[0, ends[:-1]][rows[:, 0]] if len(rows) else np.zeros(0, dtype=np.int64)
                cores = [one(data[p : p + core]) for p in rows[:, 1].tolist()]
                unions = b"".join([two(data[a : b + length]) for a, b in rows[:, 2:].tolist()])
                u = np.frombuffer(unions, "<i8").reshape(-1, 2)
                keys = batch.column(0).take(pa.array(rows[:, 0] + first))
                columns = [keys, *(pa.array(rows[:, i] - base) for i in (1, 2, 3)), pa.array(np.array(cores, dtype=np.uint64).view(np.int64)), pa.array(u[:, 0]), pa.array(u[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["row_key", "p", "lo", "hi", "core", "u1", "u2"])

    return run


def _parts(sizes: list[int], most: int = 12 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive texts of at most ``most`` bytes, or one longer text."""
    first = total = 0
    for i, size in enumerate(sizes):
        if total + size > most and i > first:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def _runs(length: int, span: int, buckets: int, flush: int = 48 << 20):
    """(row_key, packed, picks) to front-coded sorted runs, and to hashed windows of hot cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        suffixes: dict[int, list] = defaultdict(list)
        windows: list[tuple[int, int, bytes]] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for bucket, items in suffixes.items():
                done = sorted_run(items)
                shared, rests = front_code(done)
                carried = [c for _, _, c in done]
                row = {
                    "bucket": bucket, "kind": SORTED, "row_keys": np.array([c[0] for c in carried], "<i8").tobytes(), "places": np.array([c[1:4] for c in carried], "<i8").tobytes(),
                    "shared": np.array(shared, "<u2").tobytes(), "sizes": np.array([(len(r), len(c[4])) for r, c in zip(rests, carried, strict=True)], "<u2").tobytes(),
                    "rests": b"".join(rests), "before": b"".join(c[4] for c in carried),
                }
                yield pa.RecordBatch.from_pylist([row], schema=RUNS)
            if windows:
                digests = np.frombuffer(b"".join(w[2] for w in windows), "<u8").reshape(-1, 2)
                place = np.array([w[:2] for w in windows], "<i8")
                again, sent = repeats(digests)
                spans = joined(place[again, 0], place[again, 1], place[again, 1])
                for bucket, part in parted(spans[:, 0].view(np.uint64) % np.uint64(buckets)):
                    row = {"bucket": bucket, "kind": SETTLED, "row_keys": spans[part, 0].tobytes(), "places": spans[part, 1:].tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=RUNS)
                for bucket, part in parted(digests[sent, 0] % np.uint64(buckets)):
                    part = sent[part]
                    row = {"bucket": bucket, "kind": HASHED, "row_keys": place[part, 0].tobytes(), "places": place[part, 1].tobytes(), "rests": digests[part].tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=RUNS)
            suffixes.clear()
            windows.clear()

        for batch in batches:
            picks = batch.column(2).to_pylist()
            for row_key, text, mine in zip(batch.column(0).to_pylist(), unzip(batch.column(1)), picks, strict=True):
                for x in mine:
                    p, lo, hi = x["p"], x["lo"], x["hi"]
                    if x["hot"]:
                        windows += [(row_key, a, xxhash.xxh3_128_digest(text[a : a + length])) for a in range(lo, hi + 1)]
                        held += 120 * (hi + 1 - lo)
                    else:
                        before = text[max(0, p - span) : p][::-1]
                        suffixes[x["core"] % buckets].append((text[p : p + length], (row_key, p, lo, hi, before)))
                        held += 800
                if held > flush:
                    yield from rows()
                    held = 0
        yield from rows()

    return run


def repeats(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose digest is there twice or more, and the first row of each digest."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    same = np.r_[False, (digests[order[1:]] == digests[order[:-1]]).all(axis=1)] if len(order) else np.zeros(0, dtype=bool)
    return order[same | np.r_[same[1:], False]] if len(order) else order, order[~same]


def parted(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the rows that it has."""
    order = np.argsort(buckets, kind="stable")
    if len(order):
        for part in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1):
            yield int(buckets[part[0]]), part


def pair_lengths(neighbours: list[int]) -> np.ndarray:
    """Common prefixes of any two of sorted strings from those of neighbours (smallest between)."""
    n = len(neighbours)
    out = np.zeros((n, n), dtype=np.int64)
    for i in range(n - 1):
        out[i, i + 1 :] = np.minimum.accumulate(neighbours[i + 1 :])
    return np.maximum(out, out.T)


def group_spans(members: list[tuple[bytes, tuple]], shared: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(row_key, first, last) repeated windows of suffixes of one core, in sorted order."""
    n = len(members)
    right = pair_lengths(shared)
    order = sorted(range(n), key=lambda i: members[i][1][4])
    before = [members[i][1][4] for i in order]
    left = np.empty((n, n), dtype=np.int64)
    left[np.ix_(order, order)] = pair_lengths([0, *(common_prefix(a, b) for a, b in zip(before, before[1:], strict=False))])
    for i, (_, (row_key, p, lo, hi, _)) in enumerate(members):
        first = np.maximum(lo, p - left[i])
        last = np.minimum(hi, p + right[i] - length)
        first[i], last[i] = 1, 0
        for a, b in {(int(a), int(b)) for a, b in zip(first, last, strict=True) if a <= b}:
            yield row_key, a, b


def _merge_runs(length: int, span: int):
    core = length - span + 1

    def decode(row: dict) -> Iterator[tuple[int, bytes, tuple]]:
        sizes = np.frombuffer(row["sizes"], "<u2").reshape(-1, 2).astype(np.int64)
        cuts = np.r_[[[0, 0]], np.cumsum(sizes, axis=0)].tolist()
        rests = [row["rests"][a[0] : b[0]] for a, b in zip(cuts, cuts[1:], strict=False)]
        before = [row["before"][a[1] : b[1]] for a, b in zip(cuts, cuts[1:], strict=False)]
        places = np.frombuffer(row["places"], "<i8").reshape(-1, 3).tolist()
        keys = np.frombuffer(row["row_keys"], "<i8").tolist()
        carried = [(k, *p, b) for k, p, b in zip(keys, places, before, strict=True)]
        return front_decode(np.frombuffer(row["shared"], "<u2").tolist(), rests, carried)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        spans: list[tuple[int, int, int]] = []
        members: list[tuple[bytes, tuple]] = []
        shared: list[int] = []
        for n, text, carried in merge([decode(r) for r in rows if r["kind"] == SORTED]):
            if n < core:
                if len(members) > 1:
                    spans += group_spans(members, shared, length)
                members, shared = [], []
            members.append((text, carried))
            shared.append(n)
        if len(members) > 1:
            spans += group_spans(members, shared, length)
        out = [np.array(spans, dtype=np.int64).reshape(-1, 3)]
        for r in rows:
            if r["kind"] == SETTLED:
                out.append(np.c_[np.frombuffer(r["row_keys"], "<i8"), np.frombuffer(r["places"], "<i8").reshape(-1, 2)])
        if hashed := [r for r in rows if r["kind"] == HASHED]:
            digests = np.concatenate([np.frombuffer(r["rests"], "<u8") for r in hashed]).reshape(-1, 2)
            keys = np.concatenate([np.frombuffer(r["row_keys"], "<i8") for r in hashed])
            place = np.concatenate([np.frombuffer(r["places"], "<i8") for r in hashed])
            twice, _ = repeats(digests)
            out.append(joined(keys[twice], place[twice], place[twice]))
        spans = np.concatenate(out)
        return pa.table([pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.array(spans[:, 2] + length)], names=["row_key", "start", "stop"])

    return run


def joined(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows (key, first, last) with runs of consecutive windows made one."""
    if not len(keys):
        return np.zeros((0, 3), dtype=np.int64)
    order = np.lexsort((first, keys))
    keys, first, last = keys[order], first[order], last[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (first[1:] > last[:-1] + 1)]
    at = np.flatnonzero(new)
    return np.stack([keys[at], first[at], np.maximum.reduceat(last, at)], axis=1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = unzip(batch.column(1)), batch.column(2).to_pylist()
        out: list[tuple] = []
        for text, mine in zip(texts, spans, strict=True):
            kept, gone, at, last = [], 0, 0, None
            runs = []
            for s in sorted((x["start"], x["stop"]) for x in mine or ()):
                if last is not None and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
                last = s
            for a, b in runs:
                kept.append(text[at:a])
                gone, at = gone + b - a, b
            rest = b"".join(kept) + text[at:]
            out.append((len(text), gone, len(runs), [{"start": a, "stop": b} for a, b in runs], rest))
        n_bytes, n_removed, n_spans, removed, rest = zip(*out, strict=True) if out else ((),) * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip((n_bytes, n_removed, n_spans, removed, rest), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])


def repeated_spans(keyed: DataFrame, length: int = 400, span: int = 256, group: int = 200, per_bucket: int = 20_000) -> DataFrame:
    """(row_key, start, stop) byte spans made of repeated windows; spans may overlap.

    ``keyed`` has row_key and text.  The number of buckets follows the number of
    suffixes that are left after counting.
    """
    spark = keyed.sparkSession
    path = scratch_path(spark, "anchors")
    keyed.select("row_key", "text").mapInArrow(_anchor_rows(length, span), ANCHORS_DDL).write.parquet(path)
    found = spark.read.schema(ANCHORS_DDL).parquet(path)
    unions_path = scratch_path(spark, "unions")
    place = F.struct("row_key", "p", "lo", "hi")
    found.groupBy("core", "u1", "u2").agg(F.count("*").alias("n"), F.min(place).alias("one")).write.parquet(unions_path)
    unions = spark.read.parquet(unions_path)
    cores = unions.groupBy("core").agg(F.count("*").alias("unions"), F.min("n").alias("least")).filter("unions > 1 and least = 1").select("core", (F.col("unions") > group).alias("hot"))
    left = unions.join(cores, "core").select("one.row_key", F.struct("one.p", "one.lo", "one.hi", "core", "hot").alias("pick"))
    picks_path = scratch_path(spark, "picks")
    left.groupBy("row_key").agg(F.collect_list("pick").alias("picks")).write.parquet(picks_path)
    picks = spark.read.parquet(picks_path)
    buckets = 1 + (picks.agg(F.sum(F.size("picks"))).first()[0] or 0) // per_bucket * 16 + 63
    texts = zipped(keyed).select("row_key", "packed").join(picks, "row_key")
    runs = texts.mapInArrow(_runs(length, span, buckets), RUNS_DDL)
    partial = runs.groupBy("bucket").applyInArrow(_merge_runs(length, span), SPANS_DDL)
    total = unions.agg(F.sum("n")).first()[0] or 0
    full = join_counted(found, unions.filter("n > 1").select("core", "u1", "u2", "n"), ["core", "u1", "u2"], total).select("row_key", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
    return full.unionByName(partial)


def suffix_dedup(docs: DataFrame, length: int = 400, **settings: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (byte spans) and the kept bytes of each row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed, length, **settings).groupBy("row_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = zipped(keyed).join(spans, "row_key", "left").select("doc_id", "packed", "spans")
    return rows.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,stop:long>>, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """What ``op7`` returns for a list of texts, from a table of all windows."""
    seen: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for i, text in enumerate(texts):
        for a in range(len(text) - length + 1):
            seen[text[a : a + length]].append((i, a))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                gone[i][a : a + length] = b"\1" * length
    out = []
    for text, mask in zip(texts, gone, strict=True):
        kept = bytes(c for c, m in zip(text, mask, strict=True) if not m)
        out.append((len(text), sum(mask), sum(1 for i, m in enumerate(mask) if m and (not i or not mask[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out
