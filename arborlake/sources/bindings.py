"""The entities of a fork network, bound to the supplied tables.

The operators take tables of forks, files, commits, days and so on.  The bound
tables stand in for them: a customer is a fork, its lines are changed files,
documents are commits, events are daily counts, conversations are threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-08-02"
EXTENSIONS = (".go", ".py", ".md", ".json", ".lock", ".pb.go", ".min.js", ".txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forks(spark: SparkSession, sf: str) -> DataFrame:
    """fork_id, owner, segment, stars, sub_forks, releases, pushed_at, created_at."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("stars"),
        F.count_distinct(F.year("o_orderdate")).alias("sub_forks"),
        F.count_if(F.col("o_orderstatus") == "F").alias("releases"),
        F.max("o_orderdate").alias("pushed_at"),
        F.min("o_orderdate").alias("created_at"),
    )
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("fork_id"), F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return customer.join(orders, customer["fork_id"] == orders["o_custkey"]).drop("o_custkey")


FORKS_SQL = """forks AS (
  SELECT c_custkey AS fork_id, c_nationkey AS owner, c_mktsegment AS segment, c_acctbal, count(*) AS stars, count(DISTINCT year(o_orderdate)) AS sub_forks,
         count(*) FILTER (o_orderstatus = 'F') AS releases, max(o_orderdate) AS pushed_at, min(o_orderdate) AS created_at
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def path_of_part():
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), F.col("p_size") % 8 + 1)
    path = F.concat(F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), ext)
    return F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("vendor/"), path)).otherwise(path)


def files(spark: SparkSession, sf: str) -> DataFrame:
    """fork_id, path, additions, deletions, flag, shipped: one row for each changed file."""
    part = table(spark, sf, "part").select("p_partkey", path_of_part().alias("path"))
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", F.floor("l_quantity").cast("long").alias("additions"), F.floor(F.col("l_extendedprice") / 5000).cast("long").alias("deletions"),
        F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("shipped"),
    )
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("fork_id"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(part, lines["l_partkey"] == part["p_partkey"]).select("fork_id", "path", "additions", "deletions", "flag", "shipped")


PATH_SQL = """(CASE WHEN p_size % 10 = 0 THEN 'vendor/' ELSE '' END) || lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_')
      || list_extract(['.go', '.py', '.md', '.json', '.lock', '.pb.go', '.min.js', '.txt'], p_size % 8 + 1)"""
FILES_SQL = f"""files AS (
  SELECT o_custkey AS fork_id, {PATH_SQL} AS path, CAST(floor(l_quantity) AS BIGINT) AS additions, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS deletions,
         l_returnflag AS flag, l_shipdate AS shipped
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """fork_id, sha, message, author, at: a document is a commit of the fork of its source."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("fork_id"), "doc_id", F.substring_index("text", "\n", 1).alias("message"), F.col("text"), F.concat_ws("-", "lang", (F.col("doc_id") % 7).cast("string")).alias("author"),
        F.timestamp_seconds(F.lit(978_307_200) + F.col("doc_id") * 3607).alias("at"),
    )


COMMITS_SQL = """commits AS (
  SELECT source AS fork_id, doc_id, split_part(text, chr(10), 1) AS message, text, lang || '-' || (doc_id % 7) AS author,
         make_timestamp((978307200 + doc_id * 3607) * 1000000) AS "at" FROM documents)"""


# an order is a commit of its customer's fork: its priority is the form of the message, its status and price the hands in it
FORMS = {"1-URGENT": "Add urgent handling of orders", "2-HIGH": "feat: rank high orders", "3-MEDIUM": "Merge branch main", "5-LOW": "Revert the low order"}


def fork_commits(spark: SparkSession, sf: str) -> DataFrame:
    """fork_id, doc_id, message, text, author, at: the commits of the forks that ``forks`` returns."""
    message = F.lit("wip")
    for priority, text in FORMS.items():
        message = F.when(F.col("o_orderpriority") == priority, text).otherwise(message)
    guest = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0)
    rows = table(spark, sf, "orders").withColumn("message", message)
    return rows.select(
        F.col("o_custkey").alias("fork_id"), F.col("o_orderkey").alias("doc_id"), "message", F.when(F.col("o_totalprice") > 495_000, F.concat("message", F.lit("\nCo-authored-by: guest"))).otherwise(F.col("message")).alias("text"),
        F.when(guest, "guest").otherwise("owner").alias("author"), F.col("o_orderdate").cast("timestamp").alias("at"),
    )


FORK_COMMITS_SQL = f"""fork_commits AS (SELECT *, CASE WHEN o_totalprice > 495000 THEN line || chr(10) || 'Co-authored-by: guest' ELSE line END AS text FROM (
  SELECT o_custkey AS fork_id, o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'guest' ELSE 'owner' END AS author, o_orderdate AS "at", o_totalprice,
    CASE o_orderpriority {" ".join(f"WHEN '{p}' THEN '{t}'" for p, t in FORMS.items())} ELSE 'wip' END AS line FROM orders))"""


def fork_days(spark: SparkSession, sf: str) -> DataFrame:
    """fork_id, day, stars, sub_forks: running counts of a user's events by day."""
    from pyspark.sql import Window

    daily = table(spark, sf, "events").groupBy(F.col("user_id").alias("fork_id"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("b"))
    run = Window.partitionBy("fork_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("fork_id", "day", F.sum("n").over(run).alias("stars"), F.sum("b").over(run).alias("sub_forks"))


DAYS_SQL = """fork_days AS (
  SELECT fork_id, day, CAST(sum(n) OVER w AS BIGINT) AS stars, CAST(sum(b) OVER w AS BIGINT) AS sub_forks FROM (
    SELECT user_id AS fork_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS b FROM events GROUP BY ALL)
  WINDOW w AS (PARTITION BY fork_id ORDER BY day ROWS UNBOUNDED PRECEDING))"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """id, cluster, score, novelty, positive: labelled rows for the ranking metrics."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("cluster"), F.col("source"), F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") % 1000 / 999.0).alias("novelty"), (F.col("quality") == 1).alias("positive"), "toxic",
    )


JUDGED_SQL = """judged AS (
  SELECT doc_id AS id, lang AS cluster, source, CAST(n_chars AS DOUBLE) AS score, (n_chars % 1000) / 999.0::DOUBLE AS novelty, quality = 1 AS positive, toxic
  FROM documents JOIN labels USING (doc_id))"""


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """id, resolved, outdated, comments: a conversation is a review thread."""
    turns = table(spark, sf, "conversations")
    comment = F.struct("turn", "role", "text")
    return turns.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(comment)).alias("comments")).withColumns({"resolved": F.col("id") % 2 == 1, "outdated": F.col("id") % 3 == 0})
