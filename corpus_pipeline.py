"""From raw documents to packed training sequences in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all
that its predecessor kept; ``run`` writes the result of each as Parquet in the
shared folder and reads it again.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import free_name, scratch_path, table
from arborlake.llm.decontaminate import drop_contaminated
from arborlake.llm.language import in_some_language, learn_profiles, split_of
from arborlake.llm.packing import pack_documents
from arborlake.llm.simhash import similar_rows
from arborlake.llm.substring_dedup import substring_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: null texts and texts without a letter.

    That holds with nothing to learn from too.  Null ids, repeated rows, ties,
    long texts and extra columns pass as they are; an empty table stays empty.
    """
    profiles = learn_profiles(docs.filter(split_of(F.col("doc_id"), 3) != 1))
    return in_some_language(docs, profiles)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep one row, that of the smallest id.

    Candidates by SimHash at 3 bits, and by MinHash where that falls short; all are
    held against five-word shingles, similarity 0.8.  Groups are of rows, so unrelated texts
    that share an id, or have none, each stay.  A null id ranks last, rows of a
    group with equal ids rank by a hash of their text, and rows equal in both
    are one.  Null and empty texts are copies of one another, as are texts of
    equal words.  An empty table stays empty; extra columns are kept.
    """
    key, id_key = free_name(docs, "row_key"), free_name(docs, "id_key")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    kept = similar_rows(docs).groupBy("component").agg(F.min(place).alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.row_key").alias("kept_key"))
    keyed = docs.withColumn(id_key, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(id_key, "text"))
    wanted = keyed[id_key].eqNullSafe(kept["kept_id"]) & (keyed[key] == kept["kept_key"])
    return keyed.join(kept, wanted, "left_semi").dropDuplicates([id_key, key]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines and sentences; drop documents of which nothing is left.

    The occurrence of the smallest (doc_id, offset) stays, null ids last.  Null
    and empty texts, which lose nothing, pass.  ``n_chars`` follows the text; an
    extra column named ``removed`` is not kept, any other is.
    """
    out = substring_dedup(docs)
    left = out.filter((F.size("removed") == 0) | (F.trim("text") != ""))
    columns = [c for c in docs.columns if c != "removed"]
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else left.select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Null and empty texts hold none; an empty benchmark drops nothing.  Rows are
    judged one by one, so repeated and null ids pass; extra columns are kept.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens.

    A null text has its end id only; null and repeated ids are carried, each row
    being a document of its own.  An empty table gives no rows.
    """
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL has neither the tokenizer nor XXH64, so the pipeline is tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
