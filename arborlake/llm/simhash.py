"""Operator 3: SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the numbers of ones
in them form a vector, packed two bits each.  Two fingerprints that differ in d
bits have vectors at Manhattan distance d at most, so that distance is a lower
bound.  With d <= 3 one half of the vector (16 segments) is at distance 1 at
most.  The grid over a half has a cell for every vector, and the range join
looks into the cell itself and the cells one step up; a pair one step apart is
found from its lower end.  Every candidate is then checked exactly.  Cells are
plain integers, so the join is an equi-join and the planner splits hot cells.

Copies are folded first: the join and the components run on distinct
fingerprints.  Documents get the smallest ``doc_id`` of their component.
Fingerprints and components with very many rows meet them by broadcast.

Nulls and texts without words have fingerprint zero and link like any other;
null ``doc_id`` is passed over by the smallest id, and stands alone as null only
where a whole component has no id.  Repeated rows are returned each.  An empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.graph.components import connected_components
from arborlake.llm.common import materialize, table, written, zipped
from arborlake.llm.minhash import SKETCH_DDL, shingle_hashes, sketches, spanning_links
from arborlake.llm.simhash_bits import fingerprints
from arborlake.operators.skew import join_counted

SEGMENTS_PER_HALF = 16


def embed(half: Column) -> Column:
    """Ones in each two-bit segment of a 32-bit value, two bits a count."""
    odd = F.lit(0x55555555)
    return half.bitwiseAND(odd) + F.shiftrightunsigned(half, 1).bitwiseAND(odd)


def halves(fp: Column) -> list[Column]:
    return [embed(fp.bitwiseAND(F.lit(0xFFFFFFFF))), embed(F.shiftrightunsigned(fp, 32))]


def _steps(cell: Column) -> Column:
    """The cell and each cell with one segment count higher by one."""
    up = [F.when(F.shiftright(cell, 2 * i).bitwiseAND(F.lit(3)) < 2, cell + F.lit(1 << 2 * i)) for i in range(SEGMENTS_PER_HALF)]
    return F.array_compact(F.array(cell, *up))


def near_pairs(prints: DataFrame, bits: int = 3, node: str = "fp", band: str | None = None) -> DataFrame:
    """Pairs (a, b) of ``node`` whose fingerprints ``fp`` differ in at most ``bits`` <= 3 bits.

    Fingerprints are compared within a ``band``, if there is one; ``node`` tells
    the rows of a band apart.
    """
    if not 0 <= bits <= 3:
        raise ValueError("a half at Manhattan distance 1 is certain for 3 bits at most")
    bands = [band] if band else []
    cells = [F.struct(F.lit(i).alias("half"), c.alias("cell")) for i, c in enumerate(halves(F.col("fp")))]
    at = prints.select(F.col(node).alias("node"), F.col("fp").alias("print"), *bands, F.explode(F.array(*cells)).alias("at"))
    at = at.select("node", "print", *bands, "at.half", "at.cell")
    grid = at.select(F.col("node").alias("b"), F.col("print").alias("fp_b"), *(F.col(c).alias("in_band") for c in bands), F.col("half").alias("in_half"), F.col("cell").alias("in_cell"))
    looks = at.select(F.col("node").alias("a"), F.col("print").alias("fp_a"), *bands, "half", F.col("cell").alias("own"), F.explode(_steps(F.col("cell"))).alias("cell"))
    same = (F.col("half") == F.col("in_half")) & (F.col("cell") == F.col("in_cell"))
    if band:
        same = same & (F.col(band) == F.col("in_band"))
    near = (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= bits) & ((F.col("own") != F.col("cell")) | (F.col("a") < F.col("b")))
    return looks.join(grid, same & near).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed), component_id for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(rows.mapInArrow(fingerprints(words, seed), "doc_id long, fp long"))
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    total = prints.agg(F.count("*").alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    parts = connected_components(near_pairs(prints, bits), "a", "b", materialize)
    of = materialize(prints.join(parts, prints["fp"] == parts["node"], "left").select("fp", "first_id", F.col("n").alias("copies"), F.coalesce("component", "fp").alias("component")))
    least = of.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    ids = join_counted(of, least, ["component"], total["prints"]).select("fp", "component_id", F.col("copies").alias("n"))
    return join_counted(rows, ids, ["fp"], total["rows"]).select("doc_id", "fp", "component_id")


def near_prints(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b), a < b, that join all nodes of (node, fp) whose fingerprints differ in at most ``bits`` bits.

    The least node of a fingerprint stands for it: it meets the others of its
    fingerprint, and those that stand for near ones.
    """
    least = materialize(prints.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    near = near_pairs(least, bits, "first").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    same = join_counted(prints, least, ["fp"], prints.count()).select(F.col("first").alias("a"), F.col("node").alias("b"))
    return near.union(same.filter("a < b"))


def similar_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 20, order: int = 5, seed: int = 42, block: int = 256, bits: int = 3) -> DataFrame:
    """doc_id, row_key, component of each row of ``docs``, linked by exact similarity.

    Candidates are the texts whose SimHash fingerprints differ in at most ``bits``
    bits.  That leaves out most pairs of similarity 0.8 or 0.9, which are at about
    ten bits, so pairs that share one of ``bands`` MinHash keys are candidates
    too; these miss 0.035 % at 0.8.  Texts with equal sets of ``words``-word
    shingles are folded; a candidate is linked when the Jaccard similarity of its
    sets, counted in full on 64-bit hashes, is ``similarity`` or more.

    In a bucket (the texts of a key) each text is compared with the first and the
    last; SimHash pairs are then compared unless that has joined them.  Where the
    others of a bucket are then still in several components, and of equal buckets
    among these in one only, all pairs are compared that can join components:
    texts outside the first one's component with those in it and with one another.
    They meet in tasks of two blocks of about ``block`` texts, which put out links
    that span what they join, so neither a task nor its output grows with the
    bucket.  ``row_key`` hashes doc_id and text.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"), "text")
    rows = written(keyed.mapInArrow(sketches(words, bands, order, seed), SKETCH_DDL), "sketches")
    prints = written(rows.filter("node <> 0").select("node", "fp").distinct(), "prints")
    near = written(near_prints(prints, bits), "near")
    nodes = rows.groupBy("node").agg(F.first("keys").alias("keys"))
    single = written(nodes.select("node", F.explode("keys").alias("key")), "buckets")
    ends = single.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low < high")
    members = written(join_counted(single, ends, ["key"], single.count()), "members")
    needed = members.select("node").union(near.select("a")).union(near.select("b")).distinct()
    reps = rows.groupBy("node").agg(F.min("row_key").alias("row_key")).join(needed, "node")
    texts = zipped(keyed).drop("doc_id").join(reps, "row_key").dropDuplicates(["row_key", "node"]).select("node", "packed")  # where the join has put them
    sets = written(texts.mapInArrow(shingle_hashes(words, seed), "node long, size long, hashes array<long>"), "sets")
    of = lambda c, *more: sets.select(F.col("node").alias(c), *(F.col(m).alias(f"{m}_{c}") for m in more))

    ordered = [F.least("node", end).alias("a") for end in ("low", "high")], [F.greatest("node", end).alias("b") for end in ("low", "high")]
    to_low, to_high = (members.select(a, b).filter("a < b") for a, b in zip(*ordered, strict=True))

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(of("a", "size"), "a").join(of("b", "size"), "b").filter(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))
        both = F.size(F.array_intersect("hashes_a", "hashes_b"))
        enough = both >= similarity * (F.col("size_a") + F.col("size_b") - both)
        return materialize(pairs.join(of("b", "hashes"), "b").join(of("a", "hashes"), "a").filter(enough).select("a", "b"))

    links = alike(to_low.union(to_high).distinct())
    parts = materialize(connected_components(links, "a", "b", materialize))
    for end in ("a", "b"):
        near = near.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}")), end, "left")
    apart = F.coalesce("in_a", "a") != F.coalesce("in_b", "b")
    more = alike(near.filter(apart).select("a", "b"))
    if not more.isEmpty():
        links = links.union(more)
        parts = materialize(connected_components(links, "a", "b", materialize))
    of_low = parts.select(F.col("node").alias("low"), F.col("component").alias("first"))
    others = members.filter("node <> low and node <> high").join(parts, "node", "left").join(of_low, "low", "left")
    others = written(others.select("key", "node", F.coalesce("component", "node").alias("component"), F.coalesce("first", "low").alias("first")), "others")
    inside = F.col("component") == F.col("first")
    shape = others.groupBy("key").agg(
        F.count("*").alias("n"), F.count_if(inside).alias("inner"), F.min("component").alias("c0"), F.max("component").alias("c1"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"),
    )
    shape = shape.filter("c0 < c1").groupBy("n", "inner", "sum", "xor").agg(F.min("key").alias("key"))
    blocks = shape.select("key", "n", F.ceil(F.col("inner") / block).alias("ins"), F.ceil((F.col("n") - F.col("inner")) / block).alias("outs"))
    held = join_counted(others, blocks, ["key"], others.count())
    mine = F.pmod(F.xxhash64("node", F.lit(2)), F.when(inside, F.col("ins")).otherwise(F.col("outs")))
    first_to = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), n), lambda i: i < n)
    task = lambda lo, hi, crossed: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(crossed).alias("crossed"))
    of_inner = F.transform(first_to(F.col("outs")), lambda i: task(F.col("mine"), i, True))
    of_outer = F.concat(
        F.transform(first_to(F.col("ins")), lambda i: task(i, F.col("mine"), True)),
        F.transform(first_to(F.col("outs")), lambda i: task(F.least(i, F.col("mine")), F.greatest(i, F.col("mine")), False)),
    )
    met = held.withColumn("mine", mine).select("node", "key", F.explode(F.when(inside, of_inner).otherwise(of_outer)).alias("task"), F.when(inside, F.lit(-1)).otherwise(F.col("mine")).alias("side"))
    met = met.select("key", "task.lo", "task.hi", "task.crossed", "side", "node").join(of("node", "hashes"), "node").withColumnRenamed("hashes_node", "hashes")
    one_task = ["key", "lo", "hi", "crossed"]
    compared = met.repartition(*one_task).sortWithinPartitions(*one_task, "side").mapInArrow(spanning_links(similarity), "a long, b long")
    parts = connected_components(links.union(materialize(compared)), "a", "b", materialize).withColumnRenamed("node", "member")
    return rows.join(parts, F.col("node") == F.col("member"), "left").select("doc_id", "row_key", F.coalesce("component", "node").alias("component"))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id of each row: the smallest id of those linked by ``similar_rows``."""
    rows = materialize(similar_rows(docs, words, similarity))
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select("doc_id", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
