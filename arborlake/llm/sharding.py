"""Operator 5: sharding by a hierarchical weighted hash tree (law ``key``).

Shards are leaves under racks under regions, and an inner node weighs what its
leaves weigh.  A key descends one level at a time: every child of the node it
has reached makes a draw ``-ln(u) / weight``, with u from the hash of key, level
and path, and the smallest wins.  So a key costs as many hashes as there are
regions, racks in a region and shards in a rack, not one for each shard.

A weight that grows lowers the draws of the nodes above it and of no others:
rows move into the regions, racks and shards whose weight grew, and between no
others on any level; a weight that shrinks sends rows out and moves no others.
Inside a region that gained rows those are spread over all its racks.  Where a
new shard must take rows only into itself it opens a region of its own, which is
what ``grown`` does; ``layout`` builds whole regions, then opens one for each
shard over ``base``.

Slots number the rows of a shard from 0 without a gap.  Equal rows (id, size and
crc) are counted before they move, and a shard is split by a hash of all three
into parts of about ``part_rows`` rows; the counts of the parts give each its
first slot.  So neither a shard nor a key is sorted in one task, and no text is
shuffled.

Only DataFrame functions are used.  Nulls: a null text has size 8 and the crc of
no bytes; null keys hash alike and share a shard.  Equal keys share a shard and
are numbered by part, size and crc.  Empty tables give no rows; extra columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.llm.common import free_name, materialize, table


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    weight: float = 1.0


def layout(shards: int, per_rack: int = 4, racks: int = 2, base: int = 24) -> list[Shard]:
    """A tree for so many shards: regions filled rack by rack up to ``base`` shards, then a region for each."""
    whole = [Shard(s // (per_rack * racks), s // per_rack % racks) for s in range(min(shards, base))]
    return grown(whole, shards - len(whole))


def grown(shards: list[Shard], more: int = 1) -> list[Shard]:
    """The tree with ``more`` shards, each in a new region."""
    first = 1 + max((s.region for s in shards), default=-1)
    return [*shards, *(Shard(first + i, 0) for i in range(more))]


def _winner(key: list[Column], names: list[Column], weights: list[Column]) -> Column:
    """The number of the child with the smallest draw; a child of weight zero makes none.

    53 bits of the hash of key and child's name make u, which is never 0.
    """
    draws = []
    for child, (name, weight) in enumerate(zip(names, weights, strict=True)):
        bits = F.shiftrightunsigned(F.xxhash64(*key, name), 11).cast("double")
        draw = -F.log((bits + 0.5) / float(1 << 53)) / weight
        draws.append(F.when(weight > 0, F.struct(draw.alias("draw"), F.lit(child).alias("child"))))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]


def _children(rows: list[list], none: object, parent: Column) -> list[Column]:
    """The i-th value of the row of ``parent``, for each i."""
    size = max(map(len, rows))
    return [F.get(F.array(*(F.lit(row[i] if i < len(row) else none) for row in rows)), parent) for i in range(size)]


def place(df: DataFrame, key: Column, shards: list[Shard], name: str) -> DataFrame:
    """``df`` with the shard of ``key`` in the new column ``name``; one step for each level."""
    regions = sorted({s.region for s in shards})
    racks = [sorted({s.rack for s in shards if s.region == r}) for r in regions]
    leaves = [[i for i, s in enumerate(shards) if (s.region, s.rack) == (r, q)] for r, mine in zip(regions, racks, strict=True) for q in mine]
    weights = [[max(0.0, float(shards[i].weight)) for i in x] for x in leaves]
    before = [sum(map(len, racks[:i])) for i in range(len(racks))]  # racks of the regions before each
    heavy = [[sum(weights[b + j]) for j in range(len(mine))] for b, mine in zip(before, racks, strict=True)]
    region_at, rack_at = free_name(df, "region_at"), free_name(df, "rack_at")
    region, rack = F.col(region_at), F.col(rack_at)
    out = df.withColumn(region_at, _winner([key, F.lit("region")], [F.lit(r) for r in regions], [F.lit(sum(row)) for row in heavy]))
    at_rack = [key, F.lit("rack"), F.get(F.array(*map(F.lit, regions)), region)]
    child = _winner(at_rack, _children(racks, -1, region), _children(heavy, 0.0, region))
    out = out.withColumn(rack_at, F.get(F.array(*map(F.lit, before)), region) + child)
    child = _winner([key, F.lit("shard")], _children(leaves, -1, rack), _children(weights, 0.0, rack))
    return out.withColumn(name, F.get(F.get(F.array(*(F.array(*map(F.lit, x)) for x in leaves)), rack), child)).drop(region_at, rack_at)


def assign(docs: DataFrame, shards: list[Shard], more: list[Shard] | None = None, part_rows: int = 1 << 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``."""
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id")
    rows = docs.select(key.cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    splits = max(1, -(-docs.count() // (len(shards) * part_rows)))
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    placed = place(equal, key, shards, "shard")
    placed = place(placed, key, more, "grown_shard") if more else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = materialize(placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("slot")), F.lit(splits))))
    counts = placed.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # len(shards) * splits rows, a number for each part_rows rows at most
    first = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("nth", F.coalesce(F.sum("n").over(order), F.lit(0))).join(first, ["shard", "part"])
    # equal rows are made again from their number, in lots that fit an array
    lot, at = 1 << 16, F.col("first") + F.col("nth")
    lots = numbered.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / lot))))
    slots = F.sequence(at + F.col("lot") * lot, at + F.least(F.col("n"), (F.col("lot") + 1) * lot) - 1)
    return lots.withColumn("slot", F.explode(slots)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), layout(24), layout(25))
