"""Queries of single functions and of the remaining operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions import hashing, numeric, paths, text, vectors
from arborlake.operators import behaviour, ranking, store
from arborlake.operators import signals as SG
from arborlake.plans import content, heat, rank
from arborlake.plans.core import Catalog, r6, sql_decay
from arborlake.plans.relational import BRANCH_SQL, branches
from arborlake.sources import bindings as B
from arborlake.sources import diffs as D

catalog = Catalog()
tab = B.table
C = heat.COMMIT_SQL


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return behaviour.commit_facts(heat.messages(spark, sf))


@catalog.add("a7_commit_span", f"WITH {C} SELECT fork_id, round(span_days, 6) AS span_days, floor(span_days)::BIGINT AS whole_days FROM cfacts")
def a7(spark, sf):
    return facts(spark, sf).select("fork_id", r6(F.col("span_days")).alias("span_days"), F.floor("span_days").alias("whole_days"))


@catalog.add("a8_unique_authors", f"WITH {C} SELECT fork_id, authors FROM cfacts")
def a8(spark, sf):
    return facts(spark, sf).select("fork_id", "authors")


@catalog.add("a9_message_quality", f"WITH {C} SELECT fork_id, round(quality, 6) AS quality FROM cfacts")
def a9(spark, sf):
    return facts(spark, sf).select("fork_id", r6(F.col("message_quality")).alias("quality"))


@catalog.add("a10_revert_count", f"WITH {C} SELECT fork_id, reverts FROM cfacts")
def a10(spark, sf):
    return facts(spark, sf).select("fork_id", "reverts")


@catalog.add("j9_baseline_join", f"WITH {heat.MOMENTUM_SQL} SELECT fork_id, is_new, CAST(ds AS BIGINT) AS grown FROM moved")
def j9(spark, sf):
    return heat.momentum(spark, sf).select("fork_id", F.col("b_stars").isNull().alias("is_new"), F.col("ds").alias("grown"))


@catalog.add("w10_cumulative_header", "SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations")
def w10(spark, sf):
    run = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return tab(spark, sf, "conversations").select("conv_id", "turn", F.count_if(F.col("role") == "user").over(run).alias("header"))


@catalog.add("w12_mass_interval", "WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY day) / sum(n) OVER (PARTITION BY user_id) AS up, sum(n) OVER (PARTITION BY user_id ORDER BY day DESC) / sum(n) OVER (PARTITION BY user_id) AS down FROM d) SELECT user_id, min(day) FILTER (up > 0.025) AS low, max(day) FILTER (down > 0.025) AS high FROM c GROUP BY user_id")
def w12(spark, sf):
    d = tab(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("user_id")
    total = F.sum("n").over(by)
    c = d.withColumns({"up": F.sum("n").over(by.orderBy("day")) / total, "down": F.sum("n").over(by.orderBy(F.desc("day"))) / total})
    return c.groupBy("user_id").agg(F.min(F.when(F.col("up") > 0.025, F.col("day"))).alias("low"), F.max(F.when(F.col("down") > 0.025, F.col("day"))).alias("high"))


@catalog.add("m2_decay", f"SELECT p_partkey, round({sql_decay('p_size', '30.0')}, 6) AS x FROM part")
def m2(spark, sf):
    return tab(spark, sf, "part").select("p_partkey", r6(numeric.decay(F.col("p_size"), F.lit(30.0))).alias("x"))


@catalog.add("m3_clamp_ratio", "SELECT p_partkey, round(greatest(0, least(1, (p_size - 10) / 20.0::DOUBLE)), 6) AS x FROM part")
def m3(spark, sf):
    return tab(spark, sf, "part").select("p_partkey", r6(numeric.clamp_ratio(F.col("p_size"), 10, 30)).alias("x"))


@catalog.add("m5_degenerate_win", "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 1.0::DOUBLE WHEN s_acctbal < 5000 THEN 0 ELSE 0.5 END AS p FROM supplier")
def m5(spark, sf):
    return tab(spark, sf, "supplier").select("s_suppkey", numeric.win_probability(F.col("s_acctbal"), F.lit(5000.0), F.lit(0.0), F.lit(0.0)).alias("p"))


@catalog.add("m6_cap_sum", "SELECT p_partkey, round(least(p_size + p_retailprice / 100, 40), 6) AS x FROM part")
def m6(spark, sf):
    return tab(spark, sf, "part").select("p_partkey", r6(numeric.cap_sum([F.col("p_size").cast("double"), F.col("p_retailprice") / 100], 40)).alias("x"))


@catalog.add("m7_safe_ratio", "SELECT p_partkey, round(coalesce(p_retailprice / nullif(p_size % 4, 0), 0), 6) AS x FROM part")
def m7(spark, sf):
    return tab(spark, sf, "part").select("p_partkey", r6(numeric.ratio(F.col("p_retailprice"), (F.col("p_size") % 4).cast("double"))).alias("x"))


@catalog.add("m11_confidence_sigma", "SELECT c_custkey, round(greatest(10 * (1 - CASE c_custkey % 4 WHEN 2 THEN 0.7 WHEN 3 THEN 0.9 ELSE 0.3 END), 1e-6), 6)::DOUBLE AS sd FROM customer")
def m11(spark, sf):
    return tab(spark, sf, "customer").select("c_custkey", r6(numeric.sigma(numeric.tier_confidence(F.col("c_custkey") % 4))).alias("sd"))


@catalog.add("m13_sanitize_score", "SELECT s_suppkey, round(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE greatest(0, least(1, s_acctbal / 9000)) END, 6) AS x FROM supplier")
def m13(spark, sf):
    x = F.when(F.col("s_suppkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal") / 9000)
    return tab(spark, sf, "supplier").select("s_suppkey", r6(numeric.sanitize_score(x)).alias("x"))


@catalog.add("x3_clone_command", "SELECT doc_id, 'git clone https://github.com/' || source || '/' || lang || '.git' || CASE WHEN doc_id % 2 = 0 THEN ' && git checkout b' || doc_id ELSE '' END AS command FROM documents")
def x3(spark, sf):
    branch = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("b"), F.col("doc_id").cast("string")))
    clone = F.concat(F.lit("git clone https://github.com/"), F.concat_ws("/", "source", "lang"), F.lit(".git"))
    return tab(spark, sf, "documents").select("doc_id", F.concat(clone, F.coalesce(F.concat(F.lit(" && git checkout "), branch), F.lit(""))).alias("command"))


@catalog.add("x6_extension", f"SELECT p_partkey, regexp_extract({B.PATH_SQL}, '([.][^./]*)$', 1) AS ext FROM part")
def x6(spark, sf):
    return tab(spark, sf, "part").select("p_partkey", paths.extension(B.path_of_part()).alias("ext"))


@catalog.add("x8_label_tokens", r"SELECT t, count(*) AS n FROM (SELECT unnest(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '^[-.,:;!?()\[\]{}\"''`/\\_*+=<>|~@#$%^&]+|[-.,:;!?()\[\]{}\"''`/\\_*+=<>|~@#$%^&]+$', '', 'g'))) AS t FROM benchmark) WHERE length(t) >= 4 AND t NOT IN ('with', 'from') GROUP BY t")
def x8(spark, sf):
    return tab(spark, sf, "benchmark").select(F.explode(text.label_tokens(F.col("text"), ("with", "from"))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))


@catalog.add("x12_diff_chunk", f"WITH {B.FILES_SQL}, t AS (SELECT fork_id, string_agg('--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -0,' || deletions || ' +0,' || additions || ' @@', chr(10) ORDER BY additions + deletions DESC, path, additions) AS body FROM files GROUP BY fork_id) SELECT fork_id, md5(CASE WHEN length(body) > 2000 THEN regexp_replace(left(body, 2000), chr(10) || '$', '') ELSE body END) AS h, length(body) > 2000 AS truncated FROM t")
def x12(spark, sf):
    """The largest changes of a fork, 2000 characters; no line break is left at the end."""
    p = F.col("path")
    line = F.concat(F.lit("--- a/"), p, F.lit("\n+++ b/"), p, F.format_string("\n@@ -0,%d +0,%d @@", "deletions", "additions"))
    item = F.struct((-(F.col("additions") + F.col("deletions"))).alias("o"), "path", "additions", line.alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n")
    df = B.files(spark, sf).groupBy("fork_id").agg(body.alias("body"))
    cut = F.when(F.length("body") > 2000, F.regexp_replace(F.left("body", F.lit(2000)), "\n$", "")).otherwise(F.col("body"))
    return df.select("fork_id", F.md5(cut).alias("h"), (F.length("body") > 2000).alias("truncated"))


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def suggested(body: str) -> list[str]:
    return D.suggestions(body or "")


@catalog.add("x15_suggestions", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN md5(replace(text, chr(13), '')) END AS h FROM conversations")
def x15(spark, sf):
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("see\n````suggestion\n"), "text", F.lit("\n````\nok"))).otherwise(F.concat(F.lit("````go\n"), "text", F.lit("\n````")))
    return tab(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.get(suggested(body), F.lit(0))).alias("h"))


@catalog.add("x18_owner_recency", "SELECT o_orderkey, o_orderdate > TIMESTAMP '2001-08-02' - INTERVAL 365 DAY AS recent FROM orders")
def x18(spark, sf):
    days = numeric.days_between(F.lit(B.NOW).cast("timestamp"), F.col("o_orderdate"))
    return tab(spark, sf, "orders").select("o_orderkey", (days < 365).alias("recent"))


@catalog.add("x22_l2_normalize", "SELECT vec_id, round(sqrt(list_inner_product(e, e)), 4) AS was, 1.0::DOUBLE AS n FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS e FROM embeddings)")
def x22(spark, sf):
    v = F.transform("embedding", lambda x: x * 3)
    return tab(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(v), 4).alias("was"), F.round(vectors.norm(vectors.l2_normalize(v)), 4).alias("n"))


@catalog.add("x25_config_fingerprint", "SELECT n_nationkey, sha256('{\"eps\":' || n_nationkey || ',\"model\":\"' || n_name || '\"}') AS fp FROM nation")
def x25(spark, sf):
    config = F.struct(F.col("n_nationkey").alias("eps"), F.col("n_name").alias("model"))
    return tab(spark, sf, "nation").select("n_nationkey", F.sha2(F.to_json(config), 256).alias("fp"))


@catalog.add("h17_query_relevance", "SELECT a.vec_id, round(greatest(0, least(1, list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 5) AS relevance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) q")
def h17(spark, sf):
    e = tab(spark, sf, "embeddings")
    q = e.filter("vec_id = 1").select(F.col("embedding").alias("q"))
    cos = vectors.dot(F.col("embedding"), F.col("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)), 5).alias("relevance"))  # one query row


@catalog.add("n3_p_score", f"WITH {rank.ER_SQL} SELECT segment, i::INT AS idx, round(least(greatest((n - erank) / (n - 1), 0), 1), 6) AS p_score FROM er")
def n3(spark, sf):
    return ranking.expected_ranks(rank.wins(spark, sf), heat.NET).select("segment", "idx", r6(F.col("p_score")).alias("p_score"))


@catalog.add("n5_top_k_probability")
def n5(spark, sf):
    rows = rank.pool(spark, sf, ranking.POOL_CAP)
    return ranking.rank_report(rows, heat.NET, k=5).select("segment", "idx", "p_top_k", "p_first", "low", "high")


@catalog.add("n7_shortlist_report", f"WITH {rank.ER_SQL}, s AS (SELECT segment, i, row_number() OVER (PARTITION BY segment ORDER BY round(erank, 6), i) AS place FROM er QUALIFY place <= 10), j AS (SELECT s.segment, s.i, place, mu, sd FROM s JOIN pool p ON p.segment = s.segment AND p.idx = s.i) SELECT segment, i::INT AS idx, place::INT AS place, coalesce(abs(mu - lag(mu) OVER w) < 0.4 * sqrt(sd * sd + pow(lag(sd) OVER w, 2)), false) OR coalesce(abs(mu - lead(mu) OVER w) < 0.4 * sqrt(sd * sd + pow(lead(sd) OVER w, 2)), false) AS tied FROM j WINDOW w AS (PARTITION BY segment ORDER BY place)")
def n7(spark, sf):
    return ranking.tie_bands(rank.o6(spark, sf).join(rank.pool(spark, sf), ["segment", "idx"]), heat.NET).select("segment", "idx", "place", "tied")


# the owner stands for the primary language of a fork, segment and customer for its name
LANG_SQL = f"list_extract({[*vectors.LANGUAGES, 'Haskell']}, owner % 15 + 1)"
FNV_SQL = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
E6_SQL = f"""{B.FILES_SQL}, seen AS (SELECT fork_id, lower(path) AS p, additions, deletions, regexp_extract(lower(path), '([.][^./]*)$', 1) AS ext FROM files),
kinds AS (SELECT fork_id, CASE WHEN bool_or(regexp_matches(p, '{SG.SECURITY}')) THEN 'security' WHEN bool_or(regexp_matches(p, '{SG.MIGRATION}')) THEN 'migration' WHEN bool_or(regexp_matches(p, '{SG.PLUGIN}')) THEN 'plugin'
  WHEN bool_and(regexp_matches(p, '{SG.TESTS}')) THEN 'test' WHEN bool_and(regexp_matches(p, '{SG.DOCS}')) THEN 'docs' WHEN bool_and(regexp_matches(p, '{SG.CONFIG}')) THEN 'config'
  WHEN count(*) >= 5 AND abs(sum(additions) - sum(deletions)) < 0.1::DOUBLE * (sum(additions) + sum(deletions)) THEN 'refactor' ELSE 'general' END AS kind, list(CASE WHEN list_contains({SG.EXTENSIONS}, ext) THEN ext ELSE 'other' END) AS exts FROM seen GROUP BY fork_id),
named AS (SELECT c_custkey AS fork_id, c_nationkey AS owner, list_transform(list_filter(regexp_split_to_array(lower(c_mktsegment || '-' || c_name), '[-_/ .]'), lambda w: w <> ''), lambda w: {FNV_SQL} % 16) AS slots FROM customer),
counted AS (SELECT *, list_transform(range(16), lambda i: len(list_filter(slots, lambda s: s = i))::DOUBLE) AS counts FROM named),
v AS (SELECT fork_id, list_concat(list_transform({SG.ARCHETYPES}, lambda x: CASE WHEN x = coalesce(kind, 'general') THEN 0.2::DOUBLE ELSE 0 END), list_transform({[*vectors.LANGUAGES, 'Haskell']}, lambda x: CASE WHEN x = {LANG_SQL} THEN 0.1::DOUBLE ELSE 0 END),
  list_transform({[*SG.EXTENSIONS, 'other']}, lambda e: coalesce(len(list_filter(exts, lambda y: y = e)) / len(exts)::DOUBLE * 0.15::DOUBLE, 0)), list_transform(counts, lambda c: c / sqrt(list_sum(list_transform(counts, lambda k: k * k))) * 0.05::DOUBLE), [least(greatest(coalesce(impact, 0), 0), 1) * 0.5::DOUBLE]) AS v
  FROM counted LEFT JOIN kinds USING (fork_id) LEFT JOIN ({content.catalog.oracles["g6_touched_directories"]}) USING (fork_id))"""


@catalog.add("e6_weak_signals", f"WITH {E6_SQL} SELECT fork_id, array_to_string(list_transform(v, lambda x: round(x * 1000000)::BIGINT), ',') AS signals FROM v")
def e6(spark, sf):
    """All five blocks of each fork, in millionths."""
    forks = tab(spark, sf, "customer").select(F.col("c_custkey").alias("fork_id"), F.element_at(F.array(*map(F.lit, [*vectors.LANGUAGES, "Haskell"])), F.col("c_nationkey") % 15 + 1).alias("language"), F.concat_ws("-", "c_mktsegment", "c_name").alias("name"))
    df = forks.join(SG.file_signals(B.files(spark, sf)), "fork_id", "left").join(content.g6(spark, sf), "fork_id", "left")
    v = SG.weak_signals(*(F.col(c) for c in ("archetype", "language", "extensions", "name", "impact")))
    return df.select("fork_id", F.array_join(F.transform(v, lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",").alias("signals"))


@catalog.add("e11_zero_shot", "WITH s AS (SELECT e.vec_id, a.vec_id AS anchor, round(list_inner_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS s FROM embeddings e, embeddings a WHERE a.vec_id < 9) SELECT vec_id, CASE WHEN max(s) >= 0.25 THEN arg_max(anchor, s) END AS category FROM s GROUP BY vec_id")
def e11(spark, sf):
    e = tab(spark, sf, "embeddings")
    anchors = e.filter("vec_id < 9").select(F.col("vec_id").alias("anchor"), F.col("embedding").alias("w"))  # nine anchors
    s = e.crossJoin(F.broadcast(anchors)).select("vec_id", "anchor", r6(vectors.dot(F.col("embedding"), F.col("w"))).alias("s"))
    return s.groupBy("vec_id").agg(F.when(F.max("s") >= 0.25, F.max_by("anchor", "s")).alias("category"))


@catalog.add("e12_sibling_search", "SELECT e.label, count(*) AS n, round(max(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 5) AS best FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 2) q WHERE e.vec_id <> q.vec_id AND e.label <> q.label GROUP BY e.label")
def e12(spark, sf):
    e = tab(spark, sf, "embeddings")
    q = e.filter("vec_id = 2").select(F.col("vec_id").alias("qi"), F.col("label").alias("ql"), F.col("embedding").alias("q"))
    df = e.crossJoin(F.broadcast(q)).filter("vec_id <> qi and label <> ql")  # one query row
    return df.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max(vectors.dot(F.col("embedding"), F.col("q"))), 5).alias("best"))


@catalog.add("g10_merge_base", "WITH w AS (SELECT o_custkey AS fork_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM orders) SELECT fork_id, coalesce(min(nth) FILTER (o_orderkey % 4 = 0) - 1, count(*)) AS ahead, min(nth) FILTER (o_orderkey % 4 = 0) IS NULL AS lower_bound FROM w GROUP BY fork_id")
def g10(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    walk = tab(spark, sf, "orders").withColumn("nth", F.row_number().over(w).cast("long"))
    first = F.min(F.when(F.col("o_orderkey") % 4 == 0, F.col("nth")))
    return walk.groupBy(F.col("o_custkey").alias("fork_id")).agg(F.coalesce(first - 1, F.count("*")).alias("ahead"), first.isNull().alias("lower_bound"))


@catalog.add("d4_ordered_branch_scan", f"WITH {BRANCH_SQL} SELECT fork_id, arg_min(name, o) AS name FROM (SELECT fork_id, name, row_number() OVER (PARTITION BY fork_id ORDER BY CASE WHEN is_default THEN 0 WHEN NOT upstreamed THEN 1 ELSE 2 END, tip_at DESC NULLS LAST, name) AS o FROM branches WHERE ahead > 0) GROUP BY fork_id")
def d4(spark, sf):
    lane = F.when(F.col("is_default"), 0).when(~F.col("upstreamed"), 1).otherwise(2)
    return store.latest(branches(spark, sf).filter("ahead > 0"), ["fork_id"], [lane, F.desc("tip_at"), F.col("name")]).select("fork_id", "name")


@catalog.add("d6_divergence_assembly", f"WITH {BRANCH_SQL} SELECT fork_id, bool_or(is_default AND tip_at IS NOT NULL) AS resolved, count(*) FILTER (NOT is_default AND tip_at IS NOT NULL) AS sides FROM branches GROUP BY fork_id")
def d6(spark, sf):
    known = F.col("tip_at").isNotNull()
    return branches(spark, sf).groupBy("fork_id").agg(F.bool_or(F.col("is_default") & known).alias("resolved"), F.count_if(~F.col("is_default") & known).alias("sides"))


@catalog.add("d11_merge_count", "SELECT o_custkey AS fork_id, count(*) FILTER (o_orderkey % 7 = 0) AS merges, count(*) FILTER (o_orderkey % 7 = 0) = 0 AS linear FROM orders GROUP BY ALL")
def d11(spark, sf):
    h = tab(spark, sf, "orders").groupBy(F.col("o_custkey").alias("fork_id")).agg(F.collect_list(1 + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("p"))
    merges = F.size(F.filter("p", lambda x: x >= 2)).cast("long")
    return h.select("fork_id", merges.alias("merges"), (merges == 0).alias("linear"))


# budgets: B1 to B3 are reconstructions from what is written about them ---------------------


@catalog.add("b1_compare_promise", f"WITH {B.FORKS_SQL} SELECT fork_id, round(0.1 * ln(1 + stars) + CASE WHEN releases > 2 THEN 10 ELSE 0 END, 6) AS promise FROM forks")
def b1(spark, sf):
    return B.forks(spark, sf).select("fork_id", r6(0.1 * F.log(1.0 + F.col("stars")) + F.when(F.col("releases") > 2, 10).otherwise(0)).alias("promise"))


@catalog.add("b2_optimal_stopping", f"WITH {B.FORKS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY fork_id) AS arrival, count(*) OVER (PARTITION BY segment) AS n FROM forks), m AS (SELECT *, max(stars) FILTER (arrival <= floor(n / 2.718281828459045)) OVER (PARTITION BY segment) AS bar FROM a), c AS (SELECT *, arrival > floor(n / 2.718281828459045) AND stars > coalesce(bar, 0) AS good FROM m), g AS (SELECT segment, fork_id, row_number() OVER (PARTITION BY segment ORDER BY good DESC, CASE WHEN good THEN arrival END, stars DESC, fork_id) AS nth FROM c) SELECT segment, fork_id FROM g WHERE nth <= 30")
def b2(spark, sf):
    """Watch the first n/e arrivals, then take what beats them; the budget left goes to the best of the rest."""
    by = Window.partitionBy("segment")
    df = B.forks(spark, sf).withColumns({"arrival": F.row_number().over(by.orderBy("fork_id")), "n": F.count("*").over(by)})
    seen = F.col("arrival") <= F.floor(F.col("n") / 2.718281828459045)
    df = df.withColumn("good", ~seen & (F.col("stars") > F.coalesce(F.max(F.when(seen, F.col("stars"))).over(by), F.lit(0))))
    order = by.orderBy(F.desc("good"), F.when(F.col("good"), F.col("arrival")).asc_nulls_last(), F.desc("stars"), "fork_id")
    return df.withColumn("nth", F.row_number().over(order)).filter("nth <= 30").select("segment", "fork_id")


@catalog.add("b3_dispatch_priority", f"WITH {B.FORKS_SQL} SELECT fork_id, round(stars / (1.0::DOUBLE + releases) - CASE WHEN pushed_at <= created_at THEN 1e6 ELSE 0 END, 6) AS priority FROM forks")
def b3(spark, sf):
    never = F.when(F.col("pushed_at") <= F.col("created_at"), 1e6).otherwise(0.0)
    return B.forks(spark, sf).select("fork_id", r6(F.col("stars") / (1.0 + F.col("releases")) - never).alias("priority"))


@catalog.add("b6_rate_reserve", f"WITH {B.FORKS_SQL} SELECT fork_id, CASE WHEN sum(sub_forks) OVER (PARTITION BY segment ORDER BY stars DESC, fork_id) > 0.9 * 500 THEN 'reserve' END AS skip_reason FROM forks")
def b6(spark, sf):
    spent = F.sum("sub_forks").over(Window.partitionBy("segment").orderBy(F.desc("stars"), "fork_id"))
    return B.forks(spark, sf).select("fork_id", F.when(spent > 0.9 * 500, "reserve").alias("skip_reason"))


@catalog.add("b12_last_touch_gate", f"WITH {B.FILES_SQL}, l AS (SELECT path, count(*) AS since FROM files WHERE shipped > TIMESTAMP '1999-01-01' GROUP BY path), f AS (SELECT DISTINCT fork_id, path FROM files WHERE flag = 'R') SELECT fork_id, bool_and(fork_id % 9 <= coalesce(since, 0)) AS skip FROM f LEFT JOIN l USING (path) GROUP BY fork_id")
def b12(spark, sf):
    f = B.files(spark, sf)
    since = f.filter(F.col("shipped") > F.lit("1999-01-01").cast("timestamp")).groupBy("path").agg(F.count("*").alias("since"))
    mine = f.filter("flag = 'R'").select("fork_id", "path").distinct().join(since, "path", "left")
    return mine.groupBy("fork_id").agg(F.bool_and(F.col("fork_id") % 9 <= F.coalesce("since", F.lit(0))).alias("skip"))


# sources and sinks --------------------------------------------------------------------------


@catalog.add("s8_export_scan", f"WITH {B.FORKS_SQL} SELECT segment || fork_id AS name, stars::DOUBLE AS heat, CASE fork_id % 3 + 1 WHEN 2 THEN 0.7 WHEN 3 THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence FROM forks WHERE fork_id % 7 > 0")
def s8(spark, sf):
    """Records of an export as JSON text; those without heat or name go."""
    key = F.col("fork_id")
    record = F.to_json(F.struct(F.concat("segment", key.cast("string")).alias("name"), F.when(key % 7 > 0, F.col("stars").cast("double")).alias("heat"), (key % 3 + 1).alias("tier")))
    parsed = B.forks(spark, sf).select(F.from_json(record, "name string, heat double, tier int, confidence double").alias("r"))
    return parsed.filter("r.heat is not null and r.name is not null").select("r.name", "r.heat", F.coalesce("r.confidence", numeric.tier_confidence(F.col("r.tier"))).alias("confidence"))


@catalog.add("s9_judgment_scan", "SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'novel' ELSE 'established' END AS novelty FROM labels")
def s9(spark, sf):
    item = F.struct(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "novel").otherwise("established").alias("novelty"))
    files = tab(spark, sf, "labels").groupBy(F.pmod("doc_id", F.lit(16))).agg(F.to_json(F.struct(F.collect_list(item).alias("forks"))).alias("j"))
    return files.select(F.explode(F.from_json("j", "forks array<struct<id:long,novelty:string>>")["forks"]).alias("f")).select("f.id", "f.novelty")


@F.udf(T.BooleanType(), useArrow=True)
def patch_valid(patch: str) -> bool:
    return D.parse_patch_valid(patch or "")


@catalog.add("s17_patch_validation", f"SELECT p_partkey, p_size % 5 + p_size % 3 > 0 AND p_partkey % 4 > 0 AS valid FROM part")
def s17(spark, sf):
    a, d = (F.col("p_size") % 5).cast("int"), (F.col("p_size") % 3).cast("int")
    told = F.when(F.col("p_partkey") % 4 == 0, a + 1).otherwise(a)
    patch = F.when(a + d > 0, F.rtrim(F.concat(F.format_string("@@ -1,%d +1,%d @@\n", d, told), F.array_join(F.concat(F.array_repeat(F.lit("-y"), d), F.array_repeat(F.lit("+x"), a)), "\n")))).otherwise("")
    return tab(spark, sf, "part").select("p_partkey", patch_valid(patch).alias("valid"))


@catalog.add("k3_export_json")
def k3(spark, sf):
    df = heat.penalised(spark, sf)
    record = F.struct("fork_id", F.struct(r6(F.col("score")).alias("score"), "penalties", r6(F.col("trust")).alias("trust")).alias("heat"), F.struct("stars", "sub_forks").alias("t1"))
    return df.select(F.to_json(record).alias("record"))


@catalog.add("k8_cluster_save", "SELECT vec_id, CASE WHEN label % 2 = 0 THEN CASE WHEN label = 4 THEN NULL ELSE 'n' || label END ELSE 'o' || label END AS cluster FROM embeddings")
def k8(spark, sf):
    """Clusters of repositories in a new run replace the old ones; noise is null."""
    e = tab(spark, sf, "embeddings")
    old = e.select("label", "vec_id", F.concat(F.lit("o"), F.col("label").cast("string")).alias("cluster"))
    new = e.filter("label % 2 = 0").select("label", "vec_id", F.when(F.col("label") != 4, F.concat(F.lit("n"), F.col("label").cast("string"))).alias("cluster"))
    return store.replace_children(old, new, "label", new.select("label")).select("vec_id", "cluster")


@catalog.add("k10_touched_units", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS units FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def k10(spark, sf):
    rows = tab(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return store.upsert(rows.filter("o_orderkey % 3 = 0").withColumn("units", F.lit("old")), rows.filter("o_orderkey % 2 = 0").withColumn("units", F.lit("new")), ["o_orderkey", "o_custkey"])


@catalog.add("k13_diagnostics", "SELECT 'unreadable_vector' AS code, count(*) FILTER (len(embedding) <> 64) AS n, false AS retryable FROM embeddings UNION ALL SELECT 'short_document', count(*) FILTER (n_chars < 50), false FROM documents")
def k13(spark, sf):
    one = tab(spark, sf, "embeddings").agg(F.count_if(F.size("embedding") != 64).alias("n")).select(F.lit("unreadable_vector").alias("code"), "n", F.lit(False).alias("retryable"))
    two = tab(spark, sf, "documents").agg(F.count_if(F.col("n_chars") < 50).alias("n")).select(F.lit("short_document"), "n", F.lit(False))
    return one.union(two)


O14_SQL = f"{content.LEX_SQL}, c AS (SELECT item_id, token, count(*) AS n FROM tk GROUP BY ALL)"


@catalog.add("o14_distinct_word_labels", f"WITH {O14_SQL} SELECT item_id, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list([token] ORDER BY n DESC, token)), lambda acc, x: CASE WHEN len(acc) < 3 AND NOT list_has_any(string_split(array_to_string(acc, ' '), ' '), string_split(x[1], ' ')) THEN list_concat(acc, x) ELSE acc END), ', ') AS label FROM c GROUP BY item_id")
def o14(spark, sf):
    """Of ranked phrases the first three that share no word with one taken before."""
    ranked = tab(spark, sf, "benchmark").select("item_id", F.explode(text.lexical_tokens(F.col("text"))).alias("t")).groupBy("item_id", "t").agg(F.count("*").alias("n"))
    item = F.struct((-F.col("n")).alias("o"), "t")

    def step(taken, x):
        clash = F.exists(taken, lambda y: F.arrays_overlap(F.split(y, " "), F.split(x["t"], " ")))
        return F.when((F.size(taken) < 3) & ~clash, F.concat(taken, F.array(x["t"]))).otherwise(taken)

    lists = ranked.groupBy("item_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return lists.select("item_id", F.array_join(F.aggregate("x", F.array().cast("array<string>"), step), ", ").alias("label"))


@catalog.add("s21_workspace_remotes", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^?#]*)', 1)) AS remote FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS url FROM pages)")
def s21(spark, sf):
    return tab(spark, sf, "pages").select("page_id", text.remote_url(F.regexp_replace("url", r"[?#].*$", "")).alias("remote"))


@catalog.add("t1_emit_order", f"WITH {B.FORKS_SQL} SELECT fork_id, row_number() OVER (PARTITION BY segment ORDER BY pushed_at, fork_id) AS emitted FROM forks")
def t1(spark, sf):
    return B.forks(spark, sf).select("fork_id", F.row_number().over(Window.partitionBy("segment").orderBy("pushed_at", "fork_id")).cast("long").alias("emitted"))
