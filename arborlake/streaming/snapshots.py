"""Incremental runs: daily counts of a stream, and indexing of changed documents.

Both are ``foreachBatch`` sinks over bounded state: a merged table of days or of
embeddings on shared storage, written beside the old one and swapped by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborlake.operators.store import pending
from arborlake.session import checkpointed

DAYS = "fork_id long, day date, n long, bought long"


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events by fork and day; rows later than ``late`` are no longer counted."""
    w = F.window("ts", "1 day")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = timed.withWatermark("ts", late).groupBy(w.alias("w"), F.col("user_id").alias("fork_id"))
    return counted.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought")).select("fork_id", F.to_date("w.start").alias("day"), "n", "bought")


class Versions:
    """A table kept as numbered folders; readers see the newest whole one."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def newest(self, before: int | None = None) -> int:
        """The newest whole version, of those before a number if one is given; -1 without any."""
        fs, root = self._fs()
        if not fs.exists(root):
            return -1
        jvm = self.spark.sparkContext._jvm
        found = [int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((v for v in found if before is None or v < before), default=-1)

    def read(self, before: int | None = None) -> DataFrame:
        at = self.newest(before)
        return self.spark.createDataFrame([], self.schema) if at < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/{at}")

    def version_of(self, query: str | None, number: int) -> int:
        """The version of batch ``number`` of a streaming query, by the id that its checkpoint keeps.

        The first version of a query is marked in the table's folder before it is
        written: a query with a new checkpoint goes on after the newest version,
        and one that is started again finds its own numbers.
        """
        if not query:
            return number
        fs, root = self._fs()
        mark = f"_from-{query}-"
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        first = next((int(n.removeprefix(mark)) for n in names if n.startswith(mark)), None)
        if first is None:
            first = self.newest() + 1 - number
            fs.mkdirs(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"{mark}{first}"))
        return first + number

    def write(self, df: DataFrame, version: int) -> None:
        """A batch that is run again writes the same version again."""
        df.write.mode("overwrite").parquet(f"{self.path}/{version}")


def query_id(batch: DataFrame) -> str | None:
    """The id of the streaming query that a batch belongs to; none outside of one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def accumulate_days(table: Versions) -> Callable[[DataFrame, int], None]:
    """Merge finished days into the table; the batch number tells the version, so a retry is harmless."""

    def sink(batch: DataFrame, number: int) -> None:
        number = table.version_of(query_id(batch), number)
        old = table.read(before=number)
        both = old.unionByName(batch.select(*old.columns))
        table.write(both.groupBy("fork_id", "day").agg(F.sum("n").alias("n"), F.sum("bought").alias("bought")), number)

    return sink


def start_days(events: DataFrame, table: Versions, checkpoint: str) -> StreamingQuery:
    stream = daily_counts(events).writeStream.outputMode("append").foreachBatch(accumulate_days(table))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_changes(table: Versions, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Embed the documents of a batch whose content has no embedding yet (T4).

    ``embed`` maps (doc_id, digest, text) to the columns of the table; it runs
    once for each of them, and what it leaves out keeps its old row.
    """

    def sink(batch: DataFrame, number: int) -> None:
        number = table.version_of(query_id(batch), number)
        known = table.read(before=number)
        todo = pending(batch, known.select("doc_id", "digest"), "doc_id", "digest")
        fresh = checkpointed(embed(todo))
        kept = known.join(fresh.select("doc_id"), "doc_id", "left_anti")
        table.write(kept.unionByName(fresh.select(*known.columns)), number)

    return sink


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
