from pyspark.sql import functions as F

from arborlake.streaming import snapshots as S

SF = "/root/testdata/sf0.001"


def test_daily_counts_of_a_stream_are_those_of_the_table(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/events.parquet")
    last = whole.agg(F.max("ts")).first()[0]
    parts = tmp_path / "in"
    for i in range(3):
        whole.filter(F.dayofmonth("ts") % 3 == i).write.parquet(str(parts / f"{i}"))
    end = whole.limit(1).withColumn("ts", F.lit(last) + F.expr("interval 9 days")).withColumn("user_id", F.lit(-1).cast("long"))
    end.write.parquet(str(parts / "9"))
    stream = spark.readStream.schema(whole.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(str(parts))
    table = S.Versions(spark, str(tmp_path / "days"), S.DAYS)
    S.start_days(stream, table, str(tmp_path / "ckpt")).awaitTermination()
    got = sorted(map(tuple, table.read().filter("fork_id >= 0").select("fork_id", F.col("day").cast("string"), "n", "bought").collect()))
    want = whole.groupBy("user_id", F.to_date("ts").cast("string")).agg(F.count("*"), F.count_if(F.col("event_type") == "purchase")).collect()
    assert got == sorted(map(tuple, want))


def test_only_changed_documents_are_embedded(spark, tmp_path):
    table = S.Versions(spark, str(tmp_path / "emb"), "doc_id long, digest string, size int")
    seen = []

    def embed(df):
        seen.append(df.count())
        return df.select("doc_id", "digest", F.length("text").alias("size"))

    sink = S.index_changes(table, embed)
    sink(spark.createDataFrame([(1, "a", "x"), (2, "b", "yy")], "doc_id long, digest string, text string"), 0)
    sink(spark.createDataFrame([(1, "a", "x"), (2, "c", "zzz"), (3, "d", "")], "doc_id long, digest string, text string"), 1)
    assert seen == [2, 2] and sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "c", 3), (3, "d", 0)]


def test_a_document_is_embedded_once(spark, tmp_path):
    table = S.Versions(spark, str(tmp_path / "emb"), "doc_id long, digest string, size long")
    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def size(text):
        runs.add(1)
        return len(text)

    sink = S.index_changes(table, lambda df: df.select("doc_id", "digest", size("text").alias("size")))
    sink(spark.createDataFrame([(1, "a", "x"), (2, "b", "yy")], "doc_id long, digest string, text string"), 0)
    sink(spark.createDataFrame([(2, "c", "zzz")], "doc_id long, digest string, text string"), 1)
    assert runs.value == 3 and sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "c", 3)]


def test_a_new_checkpoint_goes_on_after_the_newest_version(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/events.parquet")
    last = whole.agg(F.max("ts")).first()[0]
    end = whole.limit(1).withColumn("ts", F.lit(last) + F.expr("interval 9 days")).withColumn("user_id", F.lit(-1).cast("long"))
    table = S.Versions(spark, str(tmp_path / "days"), S.DAYS)
    for i in range(2):
        part = str(tmp_path / f"in{i}")
        whole.filter(F.col("user_id") % 2 == i).unionByName(end).write.parquet(part)
        for _ in range(2):  # the second start finds nothing new
            stream = spark.readStream.schema(whole.schema).parquet(part)
            S.start_days(stream, table, str(tmp_path / f"ckpt{i}")).awaitTermination()
    got = table.read().filter("fork_id >= 0").agg(F.sum("n")).first()[0]
    assert got == whole.count() and table.newest() >= 1
