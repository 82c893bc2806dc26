"""Merges of incoming rows into stored tables, and freshness of derived rows.

Plain Parquet has no MERGE, so a merge is a join that gives the new table; the
caller writes it beside the old one and swaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], keep_when_null: tuple[str, ...] = (), keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Incoming rows win; ``keep_when_null`` columns fall back to the stored value
    and ``keep_first`` columns never change once stored (K4, K9)."""
    new = incoming.select(*(F.col(c).alias(f"new_{c}") for c in incoming.columns))
    on = [stored[k].eqNullSafe(new[f"new_{k}"]) for k in key]
    both = stored.withColumn("was", F.lit(True)).join(new.withColumn("comes", F.lit(True)), on, "full_outer")

    def value(c: str) -> Column:
        fresh, old = F.col(f"new_{c}"), F.col(c)
        if c in key:
            return F.coalesce(old, fresh)
        if c in keep_first:
            return F.when(F.col("was"), old).otherwise(fresh)
        if c in keep_when_null:
            return F.coalesce(fresh, old)
        return F.when(F.col("comes"), fresh).otherwise(old)

    return both.select(*(value(c).alias(c) for c in stored.columns))


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str, present: DataFrame) -> DataFrame:
    """Children of parents in ``present`` are replaced, all others preserved (K4)."""
    return stored.join(present.select(parent).distinct(), parent, "left_anti").unionByName(incoming.join(present.select(parent).distinct(), parent, "left_semi"))


def purge_other_scope(forks: DataFrame, repos: DataFrame, key: str, scope: str) -> DataFrame:
    """Without the forks of repositories whose known scope differs (K5)."""
    changed = repos.filter(F.col(scope).isNotNull() & (F.col(scope) != "")).select(key, F.col(scope).alias("now"))
    other = forks.join(changed, key).filter((F.col(scope) != "") & (F.col(scope) != F.col("now"))).select(key).distinct()
    return forks.join(other, key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def pending(documents: DataFrame, embeddings: DataFrame, key: str, digest: str) -> DataFrame:
    """Documents with no embedding of their present content."""
    fresh = embeddings.select(key, digest)
    return documents.join(fresh, [key, digest], "left_anti")


def coverage(documents: DataFrame, embeddings: DataFrame, key: str, digest: str, model: str) -> DataFrame:
    """Per document and model, whether its embedding is fresh."""
    e = embeddings.select(key, F.col(digest).alias("at_digest"), model)
    return documents.join(e, key).select(key, model, (F.col("at_digest") == F.col(digest)).alias("fresh"))


def embedding_mark(configured: Column, fresh: Column) -> Column:
    """What a row shows about its embedding."""
    return F.when(~configured, "not configured").when(fresh.isNull(), "missing").when(fresh, "fresh").otherwise("stale")


def guarded_upsert(embeddings: DataFrame, incoming: DataFrame, documents: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Write an embedding only while the document's content is still what it was made from (K7)."""
    valid = incoming.join(documents.select(key[0], digest), [key[0], digest], "left_semi")
    return upsert(embeddings, valid.select(*embeddings.columns), key)
