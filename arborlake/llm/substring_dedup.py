"""Operator 1: substring dedup by hashing lines and sentences.

A text is cut into lines, a line into sentences (a run of other characters
with the ``.``, ``!``, ``?`` that end it).  Units are the sentences and, where
a line has several, the line; each is lower-cased with blanks collapsed, and
those of fewer than ``min_words`` words and ``min_chars`` characters (which
count where a script has no blanks) are left alone.  Equal digests are over all documents; the occurrence with the smallest (doc_id, start)
stays and the others go.  The first occurrence of a sentence is never inside a
line that goes (the first occurrence of that line would hold it earlier), so
one pass decides both levels.  A line goes with its line break; a line of which
only blanks are left goes too.  Spans are character offsets in the input text.

Occurrences are counted by digest before any of them moves, and only digests
with two or more are joined back.  Digests with a thousandth of all occurrences
are few and are broadcast, so those occurrences stay where they are.

Nulls: a null text stays null and has no units; a null ``doc_id`` ranks last.
Rows with equal doc_id and text are one document, so neither copy loses to the
other.  Empty texts and tables pass.  All other columns are kept as they are,
but for one named ``removed``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import free_name, scratch_path, slices, table
from arborlake.operators.skew import join_counted

SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")
UNITS_DDL = "doc_id long, row_key long, d1 long, d2 long, start long, stop long"


def units(text: str, min_words: int, min_chars: int) -> Iterator[tuple[int, int, str]]:
    """(start, stop, normalised unit) of each unit that is long enough."""
    at, least = 0, min(2 * min_words - 1, min_chars)
    for line in text.split("\n"):
        if len(line) >= least:
            start, found = at, 0
            for piece in SENTENCE.findall(line):
                found += 1
                if len(piece) >= least:
                    words = piece.lower().split()
                    unit = " ".join(words)
                    if len(words) >= min_words or len(unit) >= min_chars:
                        yield start, start + len(piece), unit
                start += len(piece)
            if found > 1:
                words = line.lower().split()
                unit = " ".join(words)
                if len(words) >= min_words or len(unit) >= min_chars:
                    yield at, at + len(line), unit
        at += len(line) + 1


def _digests(min_words: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in slices(batches, "text", limit=2 << 20):
            of, starts, stops, made = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for start, stop, unit in units(text or "", min_words, min_chars):
                    of.append(i)
                    starts.append(start)
                    stops.append(stop)
                    made.append(digest(unit))
            both = np.frombuffer(b"".join(made), "<i8").reshape(-1, 2)
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["doc_id", "row_key", "d1", "d2", "start", "stop"])

    return run


def _cut(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone = [], []
            for text, spans in zip(batch.column(text_at), batch.column(spans_at).to_pylist(), strict=True):
                text = text.as_py()
                out, removed = (text, []) if text is None or not spans else cut(text, [(s["start"], s["stop"]) for s in spans])
                kept.append(out)
                gone.append([{"start": a, "stop": b} for a, b in removed])
            columns = list(batch.columns)
            columns[text_at] = pa.array(kept, pa.string())
            columns[spans_at] = pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without ``spans`` of units, and the character spans that went."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    lines, gone, at, i = [], [], 0, 0
    for line in text.split("\n"):
        end, parts, from_, cuts = at + len(line), [], at, []
        while i < len(merged) and merged[i][0] < end:
            parts.append(text[from_ : merged[i][0]])
            cuts.append(merged[i])
            from_, i = merged[i][1], i + 1
        rest = "".join(parts) + text[from_:end]
        if cuts and not rest.strip():
            gone.append((at, min(end + 1, len(text))))
        else:
            lines.append(rest)
            gone += cuts
        at = end + 1
    return "\n".join(lines), gone


def substring_dedup(docs: DataFrame, min_words: int = 8, min_chars: int = 40) -> DataFrame:
    """``docs`` with repeated units cut from ``text`` and their spans in ``removed``.

    The digests of units are written once to the shared folder and read twice:
    to count them, and to find the occurrences that go.
    """
    spark = docs.sparkSession
    docs = docs.drop("removed")
    key, id_key, spans_at = free_name(docs, "row_key"), free_name(docs, "id_key"), free_name(docs, "spans")
    keyed = docs.withColumn(id_key, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(id_key, "text"))
    path = scratch_path(spark, "units")
    keyed.select(F.col(id_key).alias("doc_id"), F.col(key).alias("row_key"), "text").mapInArrow(_digests(min_words, min_chars), UNITS_DDL).write.parquet(path)
    found = spark.read.schema(UNITS_DDL).parquet(path)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "stop", "row_key")
    twice_path = scratch_path(spark, "repeated-units")
    found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").write.parquet(twice_path)
    twice = spark.read.parquet(twice_path)
    later = join_counted(found, twice, ["d1", "d2"], twice.agg(F.sum("n")).first()[0] or 0).filter(place != F.col("first"))
    spans = later.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias(spans_at))
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("row_key").alias("span_key"), spans_at)
    mine = keyed[id_key].eqNullSafe(spans["span_id"]) & (keyed[key] == spans["span_key"])
    out = keyed.join(spans, mine, "left").select(*(keyed[c] for c in docs.columns), F.col(spans_at).alias("removed"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "removed array<struct<start:long,stop:long>>"])
    return out.mapInArrow(_cut(docs.columns.index("text"), len(docs.columns)), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n_chars")))
    spans = F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string")))
    return out.select("doc_id", "n_chars", F.length("text").cast("long").alias("kept_chars"), F.size("removed").cast("long").alias("n_spans"), F.array_join(spans, ",").alias("removed_spans"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, line_no, line,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_at
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
), pieces AS (
  SELECT doc_id, line_no, no, piece,
         line_at + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, line_no ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         count(*) OVER (PARTITION BY doc_id, line_no) AS n
  FROM (SELECT doc_id, line_no, line_at, unnest(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+')) AS piece,
               generate_subscripts(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+'), 1) AS no FROM lines WHERE line <> '')
), units AS (
  SELECT doc_id, start, start + length(piece) AS stop, trim(regexp_replace(lower(piece), '\s+', ' ', 'g')) AS unit FROM pieces
  UNION ALL
  SELECT l.doc_id, l.line_at, l.line_at + length(l.line), trim(regexp_replace(lower(l.line), '\s+', ' ', 'g'))
  FROM lines l WHERE EXISTS (SELECT 1 FROM pieces p WHERE p.doc_id = l.doc_id AND p.line_no = l.line_no AND p.n > 1)
), later AS (
  SELECT doc_id, start, stop FROM (
    SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, start, stop) AS nth FROM units WHERE len(string_split(unit, ' ')) >= 8 OR length(unit) >= 40)
  WHERE nth > 1
), marked AS (
  SELECT p.*, EXISTS (SELECT 1 FROM later r WHERE r.doc_id = p.doc_id AND r.start <= p.start AND r.stop >= p.start + length(p.piece)) AS gone FROM pieces p
), kept AS (
  SELECT l.doc_id, l.line_no, l.line_at, l.line, any_value(l.text) AS text,
         coalesce(string_agg(m.piece, '' ORDER BY m.no) FILTER (WHERE NOT m.gone), '') AS rest, coalesce(bool_or(m.gone), false) AS touched
  FROM lines l LEFT JOIN marked m ON m.doc_id = l.doc_id AND m.line_no = l.line_no GROUP BY ALL
), runs AS (
  SELECT doc_id, start, stop FROM (
    SELECT doc_id, line_no, min(start) AS start, max(start + length(piece)) AS stop FROM (
      SELECT m.*, no - row_number() OVER (PARTITION BY m.doc_id, m.line_no ORDER BY no) AS grp
      FROM marked m JOIN kept k ON k.doc_id = m.doc_id AND k.line_no = m.line_no WHERE m.gone AND NOT (k.touched AND trim(k.rest) = ''))
    GROUP BY doc_id, line_no, grp)
  UNION ALL
  SELECT doc_id, line_at, least(line_at + length(line) + 1, length(text)) FROM kept WHERE touched AND trim(rest) = ''
), spans AS (
  SELECT doc_id, count(*) AS n_spans, string_agg(CAST(start AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY start) AS removed_spans FROM runs GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(string_agg(rest, chr(10) ORDER BY line_no) FILTER (WHERE NOT (touched AND trim(rest) = '')), '') AS kept FROM kept GROUP BY doc_id
)
SELECT d.doc_id, length(d.text) AS n_chars, length(t.kept) AS kept_chars, coalesce(s.n_spans, 0) AS n_spans, coalesce(s.removed_spans, '') AS removed_spans, sha256(t.kept) AS kept_sha256
FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN spans s USING (doc_id)
"""
