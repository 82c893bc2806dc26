"""Queries of joins, store merges, branches, ordering, sets and data shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.operators import branches as BR
from arborlake.operators import decisions, store
from arborlake.operators.behaviour import has_co_author
from arborlake.operators.order import running
from arborlake.operators.skew import join_counted
from arborlake.plans.core import Catalog, r6
from arborlake.session import checkpointed
from arborlake.sources import bindings as B

catalog = Catalog()
T = B.table

# documents are indexed texts, embeddings their vectors; an odd vec_id is out of date
DOCS_SQL = "docs AS (SELECT doc_id, source, lang, md5(text) AS digest, n_chars FROM documents)"
EMB_SQL = "emb AS (SELECT vec_id AS doc_id, CASE WHEN vec_id % 3 = 0 THEN 'old' ELSE md5(text) END AS digest, 'm' || (label % 2) AS model FROM embeddings JOIN documents ON doc_id = vec_id)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "documents").select("doc_id", "source", "lang", F.md5("text").alias("digest"), "n_chars")


def emb(spark: SparkSession, sf: str) -> DataFrame:
    e, d = T(spark, sf, "embeddings"), docs(spark, sf)
    df = e.join(d, e["vec_id"] == d["doc_id"])
    return df.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("digest")).alias("digest"), F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"))


@catalog.add("s13_embedding_scan", f"WITH {DOCS_SQL}, {EMB_SQL} SELECT d.doc_id, model, source FROM emb e JOIN docs d ON d.doc_id = e.doc_id AND d.digest = e.digest WHERE lower(source) = 'src3' OR model = 'm0'")
def s13(spark, sf):
    return emb(spark, sf).join(docs(spark, sf), ["doc_id", "digest"]).filter((F.lower("source") == "src3") | (F.col("model") == "m0")).select("doc_id", "model", "source")


@catalog.add("j1_embedding_join", f"WITH {DOCS_SQL}, {EMB_SQL} SELECT l.quality, model, count(*) AS n FROM emb e JOIN docs d ON d.doc_id = e.doc_id AND d.digest = e.digest JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL")
def j1(spark, sf):
    df = emb(spark, sf).join(docs(spark, sf), ["doc_id", "digest"]).join(T(spark, sf, "labels"), "doc_id")
    return df.groupBy("quality", "model").agg(F.count("*").alias("n"))


@catalog.add("j2_pending_documents", f"WITH {DOCS_SQL}, {EMB_SQL} SELECT d.doc_id FROM docs d LEFT JOIN emb e ON e.doc_id = d.doc_id WHERE e.doc_id IS NULL OR e.digest <> d.digest")
def j2(spark, sf):
    return store.pending(docs(spark, sf), emb(spark, sf), "doc_id", "digest").select("doc_id")


@catalog.add("j3_pending_for_keys", f"WITH {DOCS_SQL}, {EMB_SQL} SELECT d.doc_id FROM docs d LEFT JOIN emb e ON e.doc_id = d.doc_id WHERE (e.doc_id IS NULL OR e.digest <> d.digest) AND d.doc_id IN (SELECT doc_id FROM labels)")
def j3(spark, sf):
    return store.pending(docs(spark, sf), emb(spark, sf), "doc_id", "digest").join(T(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id")


@catalog.add("j4_coverage", f"WITH {DOCS_SQL}, {EMB_SQL} SELECT d.doc_id, model, e.digest = d.digest AS fresh FROM docs d JOIN emb e ON e.doc_id = d.doc_id")
def j4(spark, sf):
    return store.coverage(docs(spark, sf), emb(spark, sf), "doc_id", "digest", "model")


@catalog.add("d13_embedding_mark", f"WITH {DOCS_SQL}, {EMB_SQL} SELECT d.doc_id, CASE WHEN d.doc_id % 50 = 0 THEN 'not configured' WHEN e.doc_id IS NULL THEN 'missing' WHEN e.digest = d.digest THEN 'fresh' ELSE 'stale' END AS mark FROM docs d LEFT JOIN emb e ON e.doc_id = d.doc_id")
def d13(spark, sf):
    fresh = store.coverage(docs(spark, sf), emb(spark, sf), "doc_id", "digest", "model").select("doc_id", "fresh")
    return docs(spark, sf).join(fresh, "doc_id", "left").select("doc_id", store.embedding_mark(F.col("doc_id") % 50 != 0, F.col("fresh")).alias("mark"))


@catalog.add("a1_count_by_model", f"WITH {DOCS_SQL}, {EMB_SQL} SELECT model, count(*) AS n FROM emb e JOIN docs d ON d.doc_id = e.doc_id AND d.digest = e.digest GROUP BY model")
def a1(spark, sf):
    return emb(spark, sf).join(docs(spark, sf), ["doc_id", "digest"]).groupBy("model").agg(F.count("*").alias("n"))


@catalog.add("j5_files_by_fork", f"WITH {B.FILES_SQL}, {B.FORKS_SQL} SELECT f.fork_id, count(*) AS n, min(path) AS first_path FROM files f JOIN forks k ON k.fork_id = f.fork_id WHERE segment = 'BUILDING' GROUP BY f.fork_id")
def j5(spark, sf):
    return B.files(spark, sf).join(B.forks(spark, sf).filter("segment = 'BUILDING'").select("fork_id"), "fork_id").groupBy("fork_id").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@catalog.add("j6_semi_history", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def j6(spark, sf):
    keys = T(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return T(spark, sf, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@catalog.add("j7_exists_guard", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority LIKE '1%') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)")
def j7(spark, sf):
    o = T(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = T(spark, sf, "customer").join(o.filter(F.col("o_orderpriority").startswith("1")), "c_custkey", "left_semi")
    return c.join(o.filter("o_totalprice > 400000"), "c_custkey", "left_anti").select("c_custkey")


@catalog.add("j8_rows_with_judgments", f"WITH {B.JUDGED_SQL} SELECT id, cluster, positive FROM judged")
def j8(spark, sf):
    return B.judged(spark, sf).select("id", "cluster", "positive")


@catalog.add("j11_assignment_lookup", "SELECT doc_id, coalesce('c' || label, 'noise') AS cluster FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def j11(spark, sf):
    e = T(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return T(spark, sf, "documents").join(e, "doc_id", "left").select("doc_id", F.coalesce(F.concat(F.lit("c"), F.col("label").cast("string")), F.lit("noise")).alias("cluster"))


@catalog.add("j18_cache_reconcile", f"WITH {B.FORKS_SQL} SELECT fork_id, CASE WHEN s_suppkey IS NULL THEN 'unresolved' WHEN s_acctbal < 0 THEN 'invalidate' WHEN stars > 10 THEN 'refresh_behind' ELSE 'accept' END AS verdict FROM forks LEFT JOIN supplier ON s_suppkey = fork_id")
def j18(spark, sf):
    s = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("fork_id"), "s_acctbal")
    verdict = F.when(F.col("s_acctbal").isNull(), "unresolved").when(F.col("s_acctbal") < 0, "invalidate").when(F.col("stars") > 10, "refresh_behind").otherwise("accept")
    return B.forks(spark, sf).join(s, "fork_id", "left").select("fork_id", verdict.alias("verdict"))


@catalog.add("j19_rest_minus_streamed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j19(spark, sf):
    return T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@catalog.add("j20_union_of_semi_joins", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 1) UNION SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j20(spark, sf):
    d = T(spark, sf, "documents").select("doc_id")
    one = d.join(T(spark, sf, "embeddings").filter("label = 1").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return one.union(d.join(T(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi")).distinct()


@catalog.add("j21_full_outer", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM (SELECT * FROM customer WHERE c_nationkey < 15) c FULL OUTER JOIN (SELECT * FROM supplier WHERE s_nationkey > 8) s ON c_nationkey = s_nationkey GROUP BY ALL")
def j21(spark, sf):
    c = T(spark, sf, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = T(spark, sf, "supplier").filter("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    zero = F.lit(0).cast("long")
    return c.join(s, "nation", "full_outer").select("nation", F.coalesce("customers", zero).alias("customers"), F.coalesce("suppliers", zero).alias("suppliers"))


# store merges -------------------------------------------------------------------------------

STORED_SQL = "stored AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS first_seen FROM customer WHERE c_custkey % 3 <> 0), incoming AS (SELECT c_custkey AS k, upper(c_name) AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 1 END AS bal, 'new' AS first_seen FROM customer WHERE c_custkey % 2 = 0)"


def stored(spark, sf):
    c = T(spark, sf, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("first_seen"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") + 1).alias("bal"), F.lit("new").alias("first_seen"))
    return old, new


@catalog.add("k4_snapshot_upsert", f"WITH {STORED_SQL} SELECT coalesce(s.k, i.k) AS k, CASE WHEN i.k IS NOT NULL THEN i.name ELSE s.name END AS name, round(coalesce(i.bal, s.bal), 6) AS bal FROM stored s FULL OUTER JOIN incoming i ON s.k = i.k")
def k4(spark, sf):
    return store.upsert(*stored(spark, sf), ["k"], keep_when_null=("bal",)).select("k", "name", r6(F.col("bal")).alias("bal"))


@catalog.add("k9_lineage_upsert", f"WITH {STORED_SQL} SELECT coalesce(s.k, i.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.first_seen ELSE i.first_seen END AS first_seen, CASE WHEN i.k IS NOT NULL THEN i.name ELSE s.name END AS last_name FROM stored s FULL OUTER JOIN incoming i ON s.k = i.k")
def k9(spark, sf):
    return store.upsert(*stored(spark, sf), ["k"], keep_first=("first_seen",)).select("k", "first_seen", F.col("name").alias("last_name"))


@catalog.add("k4_replace_children", "WITH present AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM present) UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 2 FROM lineitem WHERE l_linenumber > 1 AND l_orderkey IN (SELECT o_orderkey FROM present)")
def k4c(spark, sf):
    lines = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    present = T(spark, sf, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.replace_children(lines, lines.filter("l_linenumber > 1").withColumn("q", F.col("q") * 2), "l_orderkey", present)


@catalog.add("k5_scope_purge", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN (SELECT DISTINCT c_nationkey, CASE WHEN c_nationkey % 4 = 0 THEN 'a' WHEN c_nationkey % 4 = 1 THEN '' ELSE 'b' END AS scope FROM customer) ON c_nationkey = n_nationkey WHERE n_nationkey % 3 > 0 AND scope <> '' AND scope <> CASE WHEN n_nationkey % 3 = 1 THEN 'a' ELSE 'b' END)")
def k5(spark, sf):
    key = F.col("c_nationkey")
    forks = T(spark, sf, "customer").withColumn("scope", F.when(key % 4 == 0, "a").when(key % 4 == 1, "").otherwise("b")).select("c_custkey", "c_nationkey", "scope")
    n = F.col("n_nationkey")
    repos = T(spark, sf, "nation").select(n.alias("c_nationkey"), F.when(n % 3 == 1, "a").when(n % 3 == 2, "b").alias("scope"))
    return store.purge_other_scope(forks, repos, "c_nationkey", "scope").select("c_custkey")


@catalog.add("k6_compare_invalidation", f"WITH {B.FORKS_SQL} SELECT fork_id, CASE WHEN fork_id % 4 = 0 THEN NULL ELSE stars END AS ahead, CASE WHEN fork_id % 4 = 0 THEN NULL WHEN releases > 3 THEN sub_forks + 1 ELSE sub_forks END AS behind FROM forks")
def k6(spark, sf):
    t2 = F.struct(F.col("stars").alias("ahead"), F.col("sub_forks").alias("behind"))
    df = B.forks(spark, sf).withColumn("t2", F.when(F.col("fork_id") % 4 != 0, t2))
    df = df.withColumn("t2", F.when(F.col("releases") > 3, F.col("t2").withField("behind", F.col("t2.behind") + 1)).otherwise(F.col("t2")))
    return df.select("fork_id", "t2.ahead", "t2.behind")


@catalog.add("k7_guarded_embedding_upsert", f"WITH {DOCS_SQL}, {EMB_SQL}, inc AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN digest ELSE 'gone' END AS digest, 'm0' AS model FROM docs), ok AS (SELECT i.* FROM inc i JOIN docs d ON d.doc_id = i.doc_id AND d.digest = i.digest) SELECT coalesce(e.doc_id, o.doc_id) AS doc_id, coalesce(o.digest, e.digest) AS digest, coalesce(e.model, o.model) AS model FROM emb e FULL OUTER JOIN ok o ON o.doc_id = e.doc_id AND o.model = e.model")
def k7(spark, sf):
    d = docs(spark, sf)
    inc = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("digest")).otherwise("gone").alias("digest"), F.lit("m0").alias("model"))
    return store.guarded_upsert(emb(spark, sf), inc, d, ["doc_id", "model"], "digest")


@catalog.add("k11_cache_prune", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY AND user_id IN (SELECT doc_id FROM documents)")
def k11(spark, sf):
    keys = T(spark, sf, "documents").select(F.col("doc_id").alias("user_id"))
    return T(spark, sf, "events").filter(F.col("ts") >= F.expr("timestamp '2024-01-31' - interval 10 days")).join(keys, "user_id", "left_semi").select("event_id")


@catalog.add("k12_cascade_cleanup", "WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 450000) SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone)")
def k12(spark, sf):
    o = T(spark, sf, "orders")
    gone = T(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")).union(o.filter("o_totalprice > 450000").select("o_custkey")).distinct()
    return o.join(gone, "o_custkey", "left_anti").select("o_orderkey")


@catalog.add("s3_listing_union", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0)) ORDER BY n_chars DESC, doc_id")
def s3(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "n_chars")
    streamed = d.filter("doc_id % 3 > 0")
    return streamed.unionByName(d.filter("doc_id % 2 = 0").join(streamed, "doc_id", "left_anti").select("doc_id", "n_chars")).orderBy(F.desc("n_chars"), "doc_id")


@catalog.add("s7_acquisition_report", "SELECT source, count(*) AS raw, count(DISTINCT md5(text)) AS unique_rows, count(*) - count(DISTINCT md5(text)) AS duplicates FROM documents GROUP BY source")
def s7(spark, sf):
    d = T(spark, sf, "documents").withColumn("h", F.md5("text"))
    return d.groupBy("source").agg(F.count("*").alias("raw"), F.count_distinct("h").alias("unique_rows"), (F.count("*") - F.count_distinct("h")).alias("duplicates"))


@catalog.add("s12_scope_exact_scan", "SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def s12(spark, sf):
    return T(spark, sf, "customer").filter("c_nationkey = 7 and c_mktsegment = 'BUILDING' and c_acctbal > 0").select("c_custkey")


@catalog.add("s11_snapshot_scan", "SELECT o_custkey AS fork_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS commits FROM orders GROUP BY o_custkey")
def s11(spark, sf):
    item = F.struct("o_orderdate", "o_orderkey")
    keys = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["o_orderkey"].cast("string"))
    return T(spark, sf, "orders").groupBy(F.col("o_custkey").alias("fork_id")).agg(F.array_join(keys, ",").alias("commits"))


@catalog.add("s18_repo_search_page", "WITH d AS (SELECT lower(p_name) AS full_name, min(p_partkey) AS k, max(p_retailprice) AS stars FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY stars DESC, full_name) AS nth FROM d) SELECT full_name, k, CASE WHEN 20 * 2 < (SELECT count(*) FROM d) AND 20 * 2 < 1000 THEN 3 END AS next_page FROM r WHERE nth > 20 AND nth <= 40")
def s18(spark, sf):
    page, size = 2, 20
    d = T(spark, sf, "part").groupBy(F.lower("p_name").alias("full_name")).agg(F.min("p_partkey").alias("k"), F.max("p_retailprice").alias("stars"))
    total = d.agg(F.count("*").alias("total"))
    rows = d.orderBy(F.desc("stars"), "full_name").offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row
    return rows.select("full_name", "k", F.when((page * size < F.col("total")) & (F.lit(page * size) < 1000), F.lit(page + 1)).alias("next_page"))


# branches -----------------------------------------------------------------------------------

BRANCH_SQL = "branches AS (SELECT o_custkey AS fork_id, 'b' || o_orderkey AS name, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS is_default, (o_orderkey % 4)::BIGINT AS ahead, o_orderkey % 3 = 0 AS upstreamed, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS tip_at FROM orders)"


def branches(spark, sf):
    o = T(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("fork_id"), F.concat(F.lit("b"), key.cast("string")).alias("name"), (key == F.min(key).over(Window.partitionBy("o_custkey"))).alias("is_default"),
        (key % 4).alias("ahead"), (key % 3 == 0).alias("upstreamed"), F.when(key % 13 != 0, F.col("o_orderdate")).alias("tip_at"),
    )


LANE_SQL = "lanes AS (SELECT *, CASE WHEN is_default AND ahead > 0 AND NOT upstreamed THEN 0 WHEN ahead > 0 AND NOT upstreamed THEN 1 WHEN is_default AND ahead > 0 THEN 2 WHEN ahead > 0 THEN 3 WHEN is_default THEN 4 END AS lane FROM branches)"


@catalog.add("f24_branch_selection", f"WITH {BRANCH_SQL}, {LANE_SQL} SELECT fork_id, name, CASE WHEN lane = 4 THEN 0 ELSE ahead END AS ahead, lane < 4 AS needs_rest, lane IN (1, 3) AS side FROM lanes WHERE lane IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fork_id ORDER BY lane, tip_at DESC NULLS LAST, name) = 1")
def f24(spark, sf):
    return BR.select_branch(branches(spark, sf), "fork_id")


@catalog.add("f4_newest_side_branches", f"WITH {BRANCH_SQL} SELECT fork_id, name FROM branches WHERE NOT is_default AND tip_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fork_id ORDER BY tip_at DESC, name) <= 5")
def f4(spark, sf):
    return BR.newest_sides(branches(spark, sf), "fork_id").select("fork_id", "name")


@catalog.add("w6_newest_per_lane", f"WITH {BRANCH_SQL}, {LANE_SQL} SELECT fork_id, lane, name FROM lanes WHERE lane IN (1, 3) QUALIFY row_number() OVER (PARTITION BY fork_id, lane ORDER BY tip_at DESC NULLS LAST, name) = 1")
def w6(spark, sf):
    df = branches(spark, sf).withColumn("lane", BR.lane(F.col("is_default"), F.col("ahead"), F.col("upstreamed"))).filter("lane in (1, 3)")
    return store.latest(df, ["fork_id", "lane"], [F.desc("tip_at"), F.col("name")]).select("fork_id", "lane", "name")


@catalog.add("f3_post_fork_branches", f"WITH {BRANCH_SQL}, c AS (SELECT fork_id, median(tip_at) AS created FROM branches GROUP BY fork_id) SELECT fork_id, count(*) FILTER (tip_at IS NULL OR tip_at >= TIMESTAMP '1998-06-01') AS n FROM branches GROUP BY fork_id")
def f3(spark, sf):
    df = branches(spark, sf).groupBy("fork_id").agg(F.collect_list(F.struct("name", "tip_at")).alias("b"))
    return df.select("fork_id", F.size(BR.post_fork(F.col("b"), F.lit("1998-06-01").cast("timestamp"))).cast("long").alias("n"))


@catalog.add("a27_branch_fingerprint", f"WITH {BRANCH_SQL} SELECT fork_id, left(sha256(string_agg(DISTINCT name, chr(10) ORDER BY name)), 16) AS fp FROM branches WHERE ahead > 0 GROUP BY fork_id")
def a27(spark, sf):
    return branches(spark, sf).filter("ahead > 0").groupBy("fork_id").agg(BR.fingerprint(F.collect_set("name")).alias("fp"))


@catalog.add("a28_divergent_branches", f"WITH {BRANCH_SQL} SELECT fork_id, CASE WHEN count(*) FILTER (tip_at IS NOT NULL) > 0 THEN count(*) FILTER (tip_at IS NOT NULL AND ahead > 0) END AS divergent FROM branches GROUP BY fork_id")
def a28(spark, sf):
    known = F.col("tip_at").isNotNull()
    return branches(spark, sf).groupBy("fork_id").agg(F.when(F.count_if(known) > 0, F.count_if(known & (F.col("ahead") > 0))).alias("divergent"))


@catalog.add("g9_linear_history", "WITH h AS (SELECT o_custkey AS fork_id, list(1 + (o_orderkey % 7 = 0)::INT) AS parents FROM orders GROUP BY 1) SELECT fork_id, list_max(parents) <= 1 AS linear, len(parents) >= 100 AS truncated, len(list_filter(parents, lambda x: x >= 2)) AS merges FROM h")
def g9(spark, sf):
    h = T(spark, sf, "orders").groupBy(F.col("o_custkey").alias("fork_id")).agg(F.collect_list(1 + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("parents"))
    out = decisions.linear_history(F.col("parents"))
    return h.select("fork_id", out["linear"].alias("linear"), out["truncated"].alias("truncated"), F.size(F.filter("parents", lambda x: x >= 2)).cast("long").alias("merges"))


@catalog.add("b9_batch_resolution", f"WITH {BRANCH_SQL}, {LANE_SQL}, s AS (SELECT * FROM lanes WHERE lane IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fork_id ORDER BY lane, tip_at DESC NULLS LAST, name) = 1) SELECT CASE WHEN lane = 4 THEN 'synthesised' ELSE 'selected' END AS outcome, count(*) AS n FROM s GROUP BY ALL")
def b9(spark, sf):
    s = BR.select_branch(branches(spark, sf), "fork_id")
    return s.groupBy(F.when(F.col("needs_rest"), "selected").otherwise("synthesised").alias("outcome")).agg(F.count("*").alias("n"))


@catalog.add("b5_batch_estimate", f"WITH {BRANCH_SQL}, f AS (SELECT fork_id, bool_or(ahead > 0) AS divergent, bool_or(tip_at IS NULL) AS open FROM branches GROUP BY fork_id) SELECT (count(*) FILTER (divergent) + 2 * count(*) FILTER (NOT open) + 5 * count(*) FILTER (open))::BIGINT AS requests FROM f")
def b5(spark, sf):
    f = branches(spark, sf).groupBy("fork_id").agg(F.bool_or(F.col("ahead") > 0).alias("d"), F.bool_or(F.col("tip_at").isNull()).alias("o"))
    return f.agg((F.count_if("d") + 2 * F.count_if(~F.col("o")) + 5 * F.count_if("o")).alias("requests"))


@catalog.add("b4_request_estimate", "SELECT tier, n * CASE tier WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 5 END AS requests FROM (SELECT (c_custkey % 3 + 1)::INT AS tier, count(*) AS n FROM customer GROUP BY 1)")
def b4(spark, sf):
    c = T(spark, sf, "customer").groupBy((F.col("c_custkey") % 3 + 1).cast("int").alias("tier")).agg(F.count("*").alias("n"))
    return c.select("tier", (F.col("n") * F.when(F.col("tier") == 1, 0).when(F.col("tier") == 2, 3).otherwise(5)).alias("requests"))


@catalog.add("b7_commit_file_budget", "SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, o_orderdate, o_orderkey) AS nth FROM orders JOIN customer ON c_custkey = o_custkey) WHERE nth <= 100")
def b7(spark, sf):
    df = T(spark, sf, "orders").join(T(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "o_orderdate", "o_orderkey")
    return df.withColumn("nth", F.row_number().over(w)).filter("nth <= 100").select("o_orderkey")


@catalog.add("b8_owner_profile_cap", "SELECT segment, owner FROM (SELECT c_mktsegment AS segment, c_nationkey AS owner, max(c_acctbal) AS b FROM customer GROUP BY ALL) QUALIFY dense_rank() OVER (PARTITION BY segment ORDER BY b DESC, owner) <= 30")
def b8(spark, sf):
    df = T(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("owner")).agg(F.max("c_acctbal").alias("b"))
    w = Window.partitionBy("segment").orderBy(F.desc("b"), "owner")
    return df.withColumn("nth", F.dense_rank().over(w)).filter("nth <= 30").select("segment", "owner")


@catalog.add("b11_cache_validity", f"WITH {B.FORKS_SQL} SELECT fork_id, pushed_at = created_at AND (owner % 2 = 0 OR releases > 1) AS valid FROM forks")
def b11(spark, sf):
    return B.forks(spark, sf).select("fork_id", ((F.col("pushed_at") == F.col("created_at")) & ((F.col("owner") % 2 == 0) | (F.col("releases") > 1))).alias("valid"))


@catalog.add("f6_truncated_file_list", f"WITH {B.FILES_SQL} SELECT fork_id, fork_id % 29 = 0 OR count(*) >= 300 AS truncated FROM files GROUP BY fork_id")
def f6(spark, sf):
    f = B.files(spark, sf).groupBy("fork_id").agg(F.count("*").alias("n"))
    return f.select("fork_id", decisions.files_truncated(F.col("fork_id") % 29 == 0, F.col("n")).alias("truncated"))


@catalog.add("f25_compare_baseline", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND regexp_matches(source, '^src[0-9]+$') THEN source ELSE 'upstream' END AS base FROM documents")
def f25(spark, sf):
    return T(spark, sf, "documents").select("doc_id", F.when((F.col("doc_id") % 2 == 0) & F.col("source").rlike("^src[0-9]+$"), F.col("source")).otherwise("upstream").alias("base"))


@catalog.add("f22_upstreamed", "SELECT c_custkey, first_pr FROM (SELECT c_custkey, min(o_orderkey) AS first_pr FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND lower(o_orderpriority) = lower('1-URGENT') GROUP BY c_custkey)")
def f22(spark, sf):
    merged = T(spark, sf, "orders").filter((F.col("o_orderstatus") == "F") & (F.lower("o_orderpriority") == F.lower(F.lit("1-URGENT"))))
    return merged.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_pr"))


@catalog.add("f21_co_author", "SELECT doc_id FROM documents WHERE regexp_matches(CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || 'Co-Authored-By: x' ELSE text END, '(?im)^co-authored-by:')")
def f21(spark, sf):
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\nCo-Authored-By: x"))).otherwise(F.col("text"))
    return T(spark, sf, "documents").filter(has_co_author(text)).select("doc_id")


@catalog.add("f18_bot_filter", "WITH l AS (SELECT conv_id, lower(CASE turn % 4 WHEN 0 THEN 'Renovate' WHEN 1 THEN role || '[bot]' WHEN 2 THEN role ELSE upper(role) END) AS login FROM conversations) SELECT conv_id, count(DISTINCT login) AS humans FROM l WHERE NOT (login LIKE '%[bot]' OR login IN ('renovate', 'stale', 'dependabot')) GROUP BY conv_id")
def f18(spark, sf):
    turn, role = F.col("turn") % 4, F.col("role")
    login = F.when(turn == 0, "Renovate").when(turn == 1, F.concat(role, F.lit("[bot]"))).when(turn == 2, role).otherwise(F.upper(role))
    df = T(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(login).alias("logins"))
    return df.select("conv_id", F.size(decisions.humans(F.col("logins"))).cast("long").alias("humans")).filter("humans > 0")


# threads ------------------------------------------------------------------------------------

THREAD_SQL = "threads AS (SELECT conv_id AS id, conv_id % 2 = 1 AS resolved, conv_id % 3 = 0 AS outdated, count(*) AS n, min(turn) AS first_turn, arg_max(role, turn) AS last_role, bool_and(role <> 'user') AS all_bots FROM conversations GROUP BY conv_id)"


@catalog.add("f16_thread_filters", f"WITH {THREAD_SQL} SELECT 'all' AS mode, count(*) AS n FROM threads UNION ALL SELECT 'unresolved', count(*) FROM threads WHERE NOT resolved UNION ALL SELECT 'resolved', count(*) FROM threads WHERE resolved UNION ALL SELECT 'outdated', count(*) FROM threads WHERE NOT resolved AND outdated UNION ALL SELECT 'unresolved_current', count(*) FROM threads WHERE NOT resolved AND NOT outdated")
def f16(spark, sf):
    t = B.threads(spark, sf)
    counts = t.agg(*(F.count_if(decisions.thread_filter(m, F.col("resolved"), F.col("outdated"))).alias(m) for m in decisions.THREAD_FILTERS))
    return counts.unpivot([], list(decisions.THREAD_FILTERS), "mode", "n")


@catalog.add("f17_thread_body_policy", f"WITH {THREAD_SQL} SELECT id, NOT all_bots AS body_required FROM threads")
def f17(spark, sf):
    return B.threads(spark, sf).select("id", F.coalesce(~F.forall("comments", lambda c: c["role"] != "user"), F.lit(True)).alias("body_required"))


@catalog.add("d17_bulk_partition", f"WITH {THREAD_SQL} SELECT CASE WHEN NOT outdated THEN 'not_outdated' WHEN NOT all_bots THEN 'requires_body' ELSE 'to_resolve' END AS part, count(*) AS n FROM threads WHERE NOT resolved GROUP BY ALL")
def d17(spark, sf):
    t = B.threads(spark, sf).filter(~F.col("resolved"))
    bots = F.forall("comments", lambda c: c["role"] != "user")
    return t.groupBy(F.when(~F.col("outdated"), "not_outdated").when(~bots, "requires_body").otherwise("to_resolve").alias("part")).agg(F.count("*").alias("n"))


@catalog.add("d18_next_thread", "SELECT id, at_time FROM (SELECT conv_id AS id, min(turn * 100 + conv_id % 7) AS at_time FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id) ORDER BY at_time, id LIMIT 1")
def d18(spark, sf):
    c = T(spark, sf, "conversations").filter("conv_id % 2 = 0").groupBy(F.col("conv_id").alias("id")).agg(F.min(F.col("turn") * 100 + F.col("conv_id") % 7).alias("at_time"))
    return c.orderBy("at_time", "id").limit(1)


@catalog.add("d19_reply_satisfied", f"WITH {THREAD_SQL} SELECT id, last_role = 'assistant' AS satisfied FROM threads")
def d19(spark, sf):
    return B.threads(spark, sf).select("id", (F.element_at("comments", -1)["role"] == "assistant").alias("satisfied"))


@catalog.add("w13_first_comment_order", "SELECT conv_id AS id, CASE WHEN conv_id % 9 = 0 THEN '9999-12-31' ELSE strftime(TIMESTAMP '2024-01-01' + to_days((conv_id % 50)::INT), '%Y-%m-%d') END AS first_at FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY first_at, id")
def w13(spark, sf):
    """Threads by the time of their first comment; those without one come last."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")), "yyyy-MM-dd")
    ids = T(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return ids.select("id", F.coalesce(F.when(F.col("id") % 9 != 0, day), F.lit("9999-12-31")).alias("first_at")).orderBy("first_at", "id")


@catalog.add("f23_strip_verbose", "SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def f23(spark, sf):
    t = B.threads(spark, sf).withColumn("lean", F.transform("comments", lambda c: c.dropFields("text")))
    chars = F.aggregate("comments", F.lit(0).cast("long"), lambda s, c: s + F.length(c["text"]))
    return t.select(F.col("id").alias("conv_id"), F.size("lean").cast("long").alias("n"), chars.alias("chars"))


# orders, sets, groups -----------------------------------------------------------------------


@catalog.add("o1_default_order", f"WITH {B.FORKS_SQL} SELECT segment, fork_id, row_number() OVER (PARTITION BY segment ORDER BY stars DESC, fork_id) AS place FROM forks")
def o1(spark, sf):
    return B.forks(spark, sf).select("segment", "fork_id", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("stars"), "fork_id")).cast("long").alias("place"))


@catalog.add("o2_query_order", f"WITH {B.FORKS_SQL} SELECT segment, fork_id, row_number() OVER (PARTITION BY segment ORDER BY releases DESC, stars DESC, fork_id) AS place FROM forks")
def o2(spark, sf):
    return B.forks(spark, sf).select("segment", "fork_id", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("releases"), F.desc("stars"), "fork_id")).cast("long").alias("place"))


@catalog.add("o3_prior_lanes", f"WITH {B.FORKS_SQL} SELECT segment, fork_id, row_number() OVER (PARTITION BY segment ORDER BY (releases > 2) DESC, stars DESC, fork_id) AS place FROM forks")
def o3(spark, sf):
    return B.forks(spark, sf).select("segment", "fork_id", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc(F.col("releases") > 2), F.desc("stars"), "fork_id")).cast("long").alias("place"))


@catalog.add("o4_touching_lanes", f"WITH {B.FORKS_SQL} SELECT segment, fork_id, row_number() OVER (PARTITION BY segment ORDER BY CASE WHEN releases > 4 THEN 0 WHEN releases > 2 THEN 1 ELSE 2 END, CASE WHEN releases > 4 THEN -stars END NULLS FIRST, fork_id) AS place FROM forks")
def o4(spark, sf):
    lane = F.when(F.col("releases") > 4, 0).when(F.col("releases") > 2, 1).otherwise(2)
    w = Window.partitionBy("segment").orderBy(lane, F.when(lane == 0, -F.col("stars")).asc_nulls_first(), "fork_id")
    return B.forks(spark, sf).select("segment", "fork_id", F.row_number().over(w).cast("long").alias("place"))


@catalog.add("o9_sort_with_unknown", f"WITH {B.FORKS_SQL} SELECT segment, fork_id, row_number() OVER (PARTITION BY segment ORDER BY coalesce(CASE WHEN fork_id % 4 > 0 THEN stars END, -1) DESC, fork_id) AS place FROM forks")
def o9(spark, sf):
    w = Window.partitionBy("segment").orderBy(F.desc(F.coalesce(F.when(F.col("fork_id") % 4 > 0, F.col("stars")), F.lit(-1))), "fork_id")
    return B.forks(spark, sf).select("segment", "fork_id", F.row_number().over(w).cast("long").alias("place"))


@catalog.add("o10_cluster_grouped_sort", f"WITH {B.FORKS_SQL} SELECT segment, fork_id, row_number() OVER (PARTITION BY segment ORDER BY CASE WHEN owner = 0 THEN 2 WHEN owner > 20 THEN 1 ELSE 0 END, owner, stars DESC, fork_id) AS place FROM forks")
def o10(spark, sf):
    lane = F.when(F.col("owner") == 0, 2).when(F.col("owner") > 20, 1).otherwise(0)
    return B.forks(spark, sf).select("segment", "fork_id", F.row_number().over(Window.partitionBy("segment").orderBy(lane, "owner", F.desc("stars"), "fork_id")).cast("long").alias("place"))


@catalog.add("o11_topic_selection", "WITH l AS (SELECT p_brand AS repo, 'type' AS lane, p_retailprice AS s FROM part UNION ALL SELECT p_brand, 'size', p_size FROM part WHERE p_size > 25) SELECT repo, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes, round(max(s), 6) AS score FROM l GROUP BY repo ORDER BY score DESC, repo LIMIT 10")
def o11(spark, sf):
    p = T(spark, sf, "part")
    lanes = p.select(F.col("p_brand").alias("repo"), F.lit("type").alias("lane"), F.col("p_retailprice").alias("s")).union(p.filter("p_size > 25").select("p_brand", F.lit("size"), F.col("p_size").cast("double")))
    out = lanes.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"), r6(F.max("s")).alias("score"))
    return out.orderBy(F.desc("score"), "repo").limit(10)


@catalog.add("o8_pool_cap", f"WITH {B.FORKS_SQL} SELECT fork_id FROM forks ORDER BY stars DESC, fork_id LIMIT 200")
def o8(spark, sf):
    return B.forks(spark, sf).orderBy(F.desc("stars"), "fork_id").limit(200).select("fork_id")


@catalog.add("o15_keep_first", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(lower(text)) ORDER BY doc_id) = 1")
def o15(spark, sf):
    return T(spark, sf, "documents").groupBy(F.sha2(F.lower("text"), 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@catalog.add("o16_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def o16(spark, sf):
    return T(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(T(spark, sf, "supplier").select("s_nationkey")).distinct()


@catalog.add("o17_difference", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def o17(spark, sf):
    return T(spark, sf, "documents").select("doc_id").exceptAll(T(spark, sf, "labels").select("doc_id"))


@catalog.add("o18_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def o18(spark, sf):
    return T(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(T(spark, sf, "supplier").filter("s_acctbal < 0").select("s_nationkey"))


@catalog.add("o19_sorted_reasons", "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS reasons FROM conversations GROUP BY conv_id")
def o19(spark, sf):
    return T(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("role"))), ",").alias("reasons"))


GROUP_SQL = "g AS (SELECT doc_id, sha256(text) AS h, n_chars, count(*) OVER (PARTITION BY sha256(text)) AS size, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents)"


def groups(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "n_chars")
    per = d.groupBy("h").agg(F.count("*").alias("size"), F.min("doc_id").alias("first_id"))
    return d.join(per, "h")


@catalog.add("g8_duplicate_groups", f"WITH {GROUP_SQL} SELECT doc_id, first_id, size FROM g WHERE size >= 2")
def g8(spark, sf):
    return groups(spark, sf).filter("size >= 2").select("doc_id", "first_id", "size")


@catalog.add("w7_group_primary", f"WITH {GROUP_SQL} SELECT doc_id, doc_id = first_id AS is_primary FROM g WHERE size >= 2")
def w7(spark, sf):
    return groups(spark, sf).filter("size >= 2").select("doc_id", (F.col("doc_id") == F.col("first_id")).alias("is_primary"))


@catalog.add("w8_gather_groups", f"WITH {GROUP_SQL} SELECT doc_id, row_number() OVER (ORDER BY first_id, doc_id) AS position FROM g")
def w8(spark, sf):
    rows = groups(spark, sf).select("first_id", "doc_id", F.lit(1).alias("one"))
    return running(rows, ["first_id", "doc_id"], "one", "before", checkpointed).select("doc_id", (F.col("before") + 1).alias("position"))


@catalog.add("w9_gutter_ordinals", f"WITH {GROUP_SQL} SELECT doc_id, dense_rank() OVER (ORDER BY first_id) AS ordinal FROM g WHERE size >= 2")
def w9(spark, sf):
    multi = groups(spark, sf).filter("size >= 2")
    firsts = running(multi.select("first_id", F.lit(1).alias("one")).distinct(), ["first_id"], "one", "before", checkpointed)
    return multi.join(firsts, "first_id").select("doc_id", (F.col("before") + 1).alias("ordinal"))


@catalog.add("a31_dedup_counts", "SELECT count(*) - count(DISTINCT lower(p_name)) AS duplicates FROM part")
def a31(spark, sf):
    return T(spark, sf, "part").agg((F.count("*") - F.count_distinct(F.lower("p_name"))).alias("duplicates"))


@catalog.add("a24_cluster_labels", "SELECT label, count(*) FILTER (vec_id % 2 = 0) AS visible, min(vec_id) AS first_member FROM embeddings GROUP BY label")
def a24(spark, sf):
    return T(spark, sf, "embeddings").groupBy("label").agg(F.count_if(F.col("vec_id") % 2 == 0).alias("visible"), F.min("vec_id").alias("first_member"))


@catalog.add("a26_owner_profile_counts", "SELECT c_nationkey AS owner, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS forks, count(*) FILTER (c_acctbal > 0 AND c_custkey % 2 = 0) AS recent, count(*) FILTER (c_acctbal <= 0) AS own, count(*) < 70 AS complete FROM customer GROUP BY ALL")
def a26(spark, sf):
    fork = F.col("c_acctbal") > 0
    return T(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("owner")).agg(F.count("*").alias("total"), F.count_if(fork).alias("forks"), F.count_if(fork & (F.col("c_custkey") % 2 == 0)).alias("recent"), F.count_if(~fork).alias("own"), (F.count("*") < 70).alias("complete"))


@catalog.add("a32_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a32(spark, sf):
    return T(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("q"))


@catalog.add("a32_rollup", "SELECT year(o_orderdate)::INT AS y, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate)::INT, o_orderstatus)")
def a32r(spark, sf):
    return T(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("s")).rollup("y", "s").agg(F.count("*").alias("n"))


@catalog.add("a32_approx_distinct")
def a32a(spark, sf):
    return T(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


# data shaping -------------------------------------------------------------------------------


@catalog.add("d7_path_last_touch", f"WITH {B.FILES_SQL} SELECT path, max(shipped) AS last_touch, count(*) FILTER (shipped > TIMESTAMP '1998-01-01') AS later FROM files GROUP BY path")
def d7(spark, sf):
    return B.files(spark, sf).groupBy("path").agg(F.max("shipped").alias("last_touch"), F.count_if(F.col("shipped") > F.lit("1998-01-01").cast("timestamp")).alias("later"))


@catalog.add("d8_vanished", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE toxic = 1 END AS gone FROM documents LEFT JOIN labels l USING (doc_id)".replace("l.doc_id IS NULL", "toxic IS NULL"))
def d8(spark, sf):
    return T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id", "left").select("doc_id", (F.col("toxic") == 1).alias("gone"))


@catalog.add("d14_cluster_peers", "SELECT vec_id, peer, nth FROM (SELECT a.vec_id, b.vec_id AS peer, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id DESC) AS nth FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE nth <= 5")
def d14(spark, sf):
    e = T(spark, sf, "embeddings").select("vec_id", "label")
    last = e.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id")))).filter("nth <= 6")
    last = last.groupBy("label").agg(F.sort_array(F.collect_list("vec_id"), asc=False).alias("last"))
    counts = e.groupBy("label").agg(F.count("*").alias("n"))
    rows = join_counted(e, last.join(counts, "label"), ["label"], e.count())
    peers = F.slice(F.filter("last", lambda x: x != F.col("vec_id")), 1, 5)
    return rows.select("vec_id", F.posexplode(peers).alias("at", "peer")).select("vec_id", "peer", (F.col("at") + 1).cast("long").alias("nth"))


@catalog.add("d15_line_window", "SELECT doc_id, array_to_string(string_split(text, chr(10))[greatest(1, 3 - 1):3 + 1], '|') AS lines FROM documents")
def d15(spark, sf):
    lines = F.split("text", "\n")
    return T(spark, sf, "documents").select("doc_id", F.array_join(F.slice(lines, 2, 3), "|").alias("lines"))


@catalog.add("d16_line_range_replace", "SELECT doc_id, md5(array_to_string(list_concat(string_split(text, chr(10))[1:1], ['new', 'lines'], string_split(text, chr(10))[3:]), chr(10))) AS h FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def d16(spark, sf):
    lines = F.split("text", "\n")
    put = F.concat(F.slice(lines, 1, 1), F.array(F.lit("new"), F.lit("lines")), F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))))
    return T(spark, sf, "documents").filter(F.size(lines) >= 2).select("doc_id", F.md5(F.array_join(put, "\n")).alias("h"))


@catalog.add("d20_shortlist_signature", f"WITH {B.FORKS_SQL} SELECT segment, sha256(string_agg(fork_id || ':' || stars || ':' || releases, ';' ORDER BY fork_id)) AS signature FROM forks GROUP BY segment")
def d20(spark, sf):
    item = F.struct("fork_id", F.concat_ws(":", F.col("fork_id").cast("string"), F.col("stars").cast("string"), F.col("releases").cast("string")).alias("t"))
    return B.forks(spark, sf).groupBy("segment").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ";"), 256).alias("signature"))


@catalog.add("d21_p_score_cell", f"WITH {B.FORKS_SQL} SELECT fork_id, CASE WHEN fork_id % 10 = 0 THEN '-' ELSE least(floor(stars * 100.0 / 25 + 0.5), 99)::INT::VARCHAR || CASE WHEN fork_id % 3 = 0 THEN '~' ELSE '' END END AS cell FROM forks")
def d21(spark, sf):
    pct = F.least(F.floor(F.col("stars") * 100.0 / 25 + 0.5), F.lit(99)).cast("int").cast("string")
    return B.forks(spark, sf).select("fork_id", F.when(F.col("fork_id") % 10 == 0, "-").otherwise(F.concat(pct, F.when(F.col("fork_id") % 3 == 0, "~").otherwise(""))).alias("cell"))


@catalog.add("d24_next_page", "SELECT p_size AS page, CASE WHEN p_size * 30 < 1000 THEN p_size + 1 END AS next_page FROM part GROUP BY ALL")
def d24(spark, sf):
    return T(spark, sf, "part").select(F.col("p_size").alias("page")).distinct().select("page", F.when(F.col("page") * 30 < 1000, F.col("page") + 1).alias("next_page"))


@catalog.add("d25_candidate_text", "SELECT source, md5(left(string_agg(split_part(text, chr(10), 1), chr(10) ORDER BY doc_id), 2000)) AS h FROM documents GROUP BY source")
def d25(spark, sf):
    item = F.struct("doc_id", F.substring_index("text", "\n", 1).alias("t"))
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"])
    return T(spark, sf, "documents").groupBy("source").agg(F.md5(F.left(F.array_join(lines, "\n"), F.lit(2000))).alias("h"))
