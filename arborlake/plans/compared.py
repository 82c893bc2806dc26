"""Queries of comparisons, caches, labels, features and checked inputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions import paths, vectors
from arborlake.operators import branches as BR
from arborlake.operators import compare, features, labels, store
from arborlake.plans.core import Catalog, r6
from arborlake.plans.more import patch_valid
from arborlake.plans.relational import BRANCH_SQL, branches
from arborlake.session import checkpointed
from arborlake.sources import bindings as B
from arborlake.sources import code

catalog = Catalog()
tab = B.table
lit = F.lit

# comparisons ----------------------------------------------------------------------------------

LISTED = 12  # a comparison lists the first commits of a fork


@catalog.add("d1_compare_totals", f"WITH {B.FILES_SQL}, t AS (SELECT fork_id, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM files GROUP BY fork_id), c AS (SELECT o_custkey AS fork_id, count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS tip, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS base, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'P') AS merged FROM orders GROUP BY 1) SELECT fork_id, additions, deletions, CASE WHEN n <= {LISTED} THEN tip::VARCHAR END AS head, coalesce(merged, base)::VARCHAR AS base FROM t JOIN c USING (fork_id)")
def d1(spark, sf):
    """Totals of files; the head only if all commits are listed; the last merged commit is the merge base."""
    totals = B.files(spark, sf).groupBy("fork_id").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    o = tab(spark, sf, "orders").select(F.col("o_custkey").alias("fork_id"), F.struct("o_orderdate", F.col("o_orderkey").alias("sha")).alias("c"), "o_orderstatus")
    nth = F.row_number().over(Window.partitionBy("fork_id").orderBy("c"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= LISTED, F.col("c")))), lambda c: c["sha"].cast("string"))
    name = lambda c: c["sha"].cast("string")
    merged = F.coalesce(name(F.max(F.when(F.col("o_orderstatus") == "P", F.col("c")))), lit(""))
    c = o.withColumn("nth", nth).groupBy("fork_id").agg(listed.alias("listed"), F.count("*").alias("total"), merged.alias("merged"), name(F.min("c")).alias("first"))
    out = compare.head_and_base(F.col("listed"), F.col("total"), F.col("merged"), F.col("first"))
    return totals.join(c, "fork_id").select("fork_id", "additions", "deletions", out["head"].alias("head"), out["base"].alias("base"))


D2_SQL = f"""{B.FILES_SQL}, whole AS (SELECT fork_id, path, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, 'diff' AS patch FROM files WHERE shipped >= TIMESTAMP '1996-01-01' GROUP BY ALL),
listed AS (SELECT fork_id, path, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, max(CASE flag WHEN 'R' THEN 'rest' ELSE '' END) AS patch FROM files WHERE flag IN ('R', 'A') GROUP BY fork_id, path),
judged AS (SELECT fork_id, coalesce(any_value(complete) AND any_value(found) >= count(*), false) AS replaced FROM listed LEFT JOIN (SELECT fork_id, count(*) AS found, sum(additions + deletions) < 4000 AS complete FROM whole GROUP BY fork_id) USING (fork_id) GROUP BY fork_id),
filled AS (SELECT w.fork_id, w.additions, w.deletions, coalesce(nullif(l.patch, ''), w.patch) AS patch, true AS replaced FROM whole w JOIN judged j ON j.fork_id = w.fork_id AND replaced LEFT JOIN listed l ON l.fork_id = w.fork_id AND l.path = w.path
  UNION ALL SELECT l.fork_id, additions, deletions, patch, false FROM listed l JOIN judged j ON j.fork_id = l.fork_id AND NOT replaced)"""


@catalog.add("d2_backfill_files", f"WITH {D2_SQL} SELECT fork_id, replaced, count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, count(*) FILTER (patch = 'rest') AS kept FROM filled GROUP BY ALL")
def d2(spark, sf):
    """A diff of 4,000 lines or more is cut off; it reaches back to 1996."""
    f = B.files(spark, sf)
    sums = [F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")]
    full = f.filter(F.col("shipped") >= lit("1996-01-01").cast("timestamp")).groupBy("fork_id", "path").agg(*sums, lit("diff").alias("patch"))
    listed = f.filter("flag in ('R', 'A')").groupBy("fork_id", "path").agg(*sums, F.max(F.when(F.col("flag") == "R", "rest").otherwise("")).alias("patch"))
    complete = full.groupBy("fork_id").agg((F.sum(F.col("additions") + F.col("deletions")) < 4000).alias("complete"))
    out = compare.backfill_files(listed, full, complete, "fork_id")
    return out.groupBy("fork_id", "replaced").agg(F.count("*").alias("files"), *sums, F.count_if(F.col("patch") == "rest").alias("kept"))


D3_SQL = "SELECT p_partkey, CASE WHEN told_a <> a OR d <> told_d THEN 'got +' || a || '/-' || d || ' lines, want +' || told_a || '/-' || told_d WHEN a + d = 0 THEN 'empty' WHEN p_size % 7 = 0 THEN 'bad hunks' ELSE 'accepted' END AS outcome FROM (SELECT p_partkey, p_size, p_size % 5 AS a, p_size % 3 AS d, p_size % 5 + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS told_a, p_size % 3 AS told_d FROM part)"


@catalog.add("d3_patch_fill", D3_SQL)
def d3(spark, sf):
    """A patch is taken only if its lines count what was listed and its hunks hold them."""
    a, d = (F.col("p_size") % 5).cast("int"), (F.col("p_size") % 3).cast("int")
    said = d + F.when(F.col("p_size") % 7 == 0, 1).otherwise(0)
    body = F.array_join(F.concat(F.array_repeat(lit("-y"), d), F.array_repeat(lit("+x"), a)), "\n")
    patch = F.when(a + d > 0, F.concat(F.format_string("@@ -1,%d +1,%d @@\n", said, a), body)).otherwise("")
    rows = tab(spark, sf, "part").select("p_partkey", patch.alias("patch"), (a + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)).alias("a"), d.alias("d"))
    rows = rows.withColumn("valid", patch_valid("patch"))
    return rows.select("p_partkey", compare.patch_outcome(F.col("patch"), F.col("a"), F.col("d"), F.col("valid")).alias("outcome"))


@catalog.add("d5_two_sided_compare", f"WITH {B.FILES_SQL}, s AS (SELECT o_custkey AS fork_id, l_partkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('R', 'A') GROUP BY ALL), n AS (SELECT fork_id, count(DISTINCT path) FILTER (starts_with(path, 'vendor/')) AS renamed FROM files GROUP BY fork_id) SELECT fork_id, count(*) FILTER (r AND NOT a) AS ahead, count(*) FILTER (a AND NOT r) AS behind, any_value(renamed) AS renamed FROM s JOIN n USING (fork_id) GROUP BY fork_id")
def d5(spark, sf):
    """Returned parts are a fork's commits, accepted ones the upstream's; a path moved under vendor is renamed."""
    lines = tab(spark, sf, "lineitem").filter("l_returnflag in ('R', 'A')").select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "R", "fork").otherwise("upstream").alias("side"))
    orders = tab(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("fork_id"))
    sides = compare.two_sided(lines.join(orders, "l_orderkey").withColumnRenamed("l_partkey", "sha"), "fork_id")
    status = compare.change_status(F.regexp_replace("path", "^vendor/", ""), F.col("path"))
    renamed = B.files(spark, sf).groupBy("fork_id").agg(F.count_distinct(F.when(status == "renamed", F.col("path"))).alias("renamed"))
    return sides.join(renamed, "fork_id")


PARENTS = "1 + (o_orderkey % 7 = 0)::INT"


@catalog.add("d10_linearity", f"WITH c AS (SELECT o_custkey AS fork_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN NULL ELSE {PARENTS} END AS parents, o_orderstatus FROM orders), h AS (SELECT fork_id, count(*) AS n, bool_and(o_orderstatus = 'F') AS behind, arg_min(CASE WHEN parents IS NULL THEN 0 ELSE 1 END, nth) FILTER (parents IS NULL OR parents > 1) AS telling FROM c GROUP BY fork_id) SELECT fork_id, CASE WHEN n > 20 THEN NULL WHEN behind OR telling IS NULL THEN true WHEN telling = 1 THEN false END AS linear FROM h")
def d10(spark, sf):
    """Twenty commits are listed; a fork whose orders are all filled is behind."""
    o = tab(spark, sf, "orders").select(F.col("o_custkey").alias("fork_id"), "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    parents = F.when((F.col("o_orderstatus") != "P") | (F.col("o_totalprice") <= 400000), 1 + (F.col("o_orderkey") % 7 == 0).cast("int"))
    nth = F.row_number().over(Window.partitionBy("fork_id").orderBy("o_orderdate", "o_orderkey"))
    c = o.select("fork_id", nth.alias("nth"), parents.alias("parents"), "o_orderstatus")
    listed = F.array_sort(F.collect_list(F.when(F.col("nth") <= 20, F.struct("nth", "parents"))))
    h = c.groupBy("fork_id").agg(F.count("*").alias("n"), F.when(F.bool_and(F.col("o_orderstatus") == "F"), "behind").otherwise("ahead").alias("status"), F.transform(listed, lambda x: x["parents"]).alias("parents"))
    return h.select("fork_id", compare.linearity(F.col("n"), F.col("status"), F.col("parents")).alias("linear"))


D12_SQL = f"{BRANCH_SQL}, f AS (SELECT fork_id, CASE WHEN count(tip_at) > 0 THEN count(*) FILTER (tip_at IS NOT NULL AND ahead > 0) END AS divergent, count(*) = count(tip_at) AS known FROM branches GROUP BY fork_id)"


@catalog.add("d12_sweep_needed", f"WITH {D12_SQL} SELECT fork_id, divergent IS NULL OR (divergent > 0 AND NOT known) AS branches, divergent IS NULL AS history FROM f")
def d12(spark, sf):
    """Without a dated tip nothing is known of a fork; a fingerprint needs the tips of all branches."""
    known = F.col("tip_at").isNotNull()
    some, every = F.count_if(known) > 0, F.count_if(~known) == 0
    f = branches(spark, sf).groupBy("fork_id").agg(
        F.when(some, F.count_if(known & (F.col("ahead") > 0))).alias("divergent"), F.when(every, BR.fingerprint(F.collect_set(F.when(F.col("ahead") > 0, F.col("name"))))).alias("print"),
        F.when(some, F.collect_list(F.col("ahead"))).alias("parents"),
    )
    linear = F.forall("parents", lambda p: p < 2)
    return f.select("fork_id", compare.needs_branch_sweep(F.col("divergent"), F.col("print")).alias("branches"), compare.needs_history_sweep(linear, F.col("parents")).alias("history"))


@catalog.add("d22_centrality_method", f"WITH {B.FILES_SQL}, m AS (SELECT DISTINCT path, 1 AS module FROM files WHERE flag = 'R' AND regexp_matches(path, '[.](go|py)$')), t AS (SELECT DISTINCT fork_id, path FROM files WHERE shipped > TIMESTAMP '2000-06-01') SELECT fork_id, CASE WHEN count(module) > 0 THEN 'mdg' WHEN impact IS NOT NULL THEN 'directory' ELSE '' END AS method FROM (SELECT DISTINCT fork_id FROM files) LEFT JOIN t USING (fork_id) LEFT JOIN m USING (path) LEFT JOIN (SELECT fork_id, 1 AS impact FROM t GROUP BY fork_id) USING (fork_id) GROUP BY fork_id, impact")
def d22(spark, sf):
    """Sources that were returned are nodes of the module graph; late changes are the touched files."""
    f = B.files(spark, sf)
    modules = f.filter((F.col("flag") == "R") & F.col("path").rlike("[.](go|py)$")).select("path", lit(1).alias("module")).distinct()
    touched = f.filter(F.col("shipped") > lit("2000-06-01").cast("timestamp")).select("fork_id", "path").distinct().join(modules, "path", "left")
    found = touched.groupBy("fork_id").agg(F.max("module").alias("module"), lit(1).alias("impact"))
    return f.select("fork_id").distinct().join(found, "fork_id", "left").select("fork_id", compare.centrality_method(F.col("module"), F.col("impact")).alias("method"))


LANE_CASE = "CASE WHEN is_default AND ahead > 0 AND NOT upstreamed THEN 0 WHEN ahead > 0 AND NOT upstreamed THEN 1 WHEN is_default AND ahead > 0 THEN 2 WHEN ahead > 0 THEN 3 WHEN is_default THEN 4 END"
EARLIER = "1999-01-01"


def chosen_sql(name: str, where: str) -> str:
    seen = f"SELECT *, {LANE_CASE} AS lane, rank() OVER (PARTITION BY fork_id ORDER BY tip_at DESC NULLS LAST) - 1 AS behind FROM branches WHERE {where}"
    return f"{name}_all AS ({seen}), {name} AS (SELECT * FROM {name}_all WHERE lane IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fork_id ORDER BY lane, tip_at DESC NULLS LAST, name) = 1)"


B10_SQL = f"{BRANCH_SQL}, {chosen_sql('cur', 'true')}, {chosen_sql('old', f"tip_at < TIMESTAMP '{EARLIER}'")}, part_known AS (SELECT fork_id, bool_or(tip_at IS NULL) AS counts_only FROM branches GROUP BY fork_id)"


@catalog.add("b10_cached_refresh", f"WITH {B10_SQL} SELECT o.fork_id, CASE WHEN NOT counts_only AND (c.lane = 4 OR c.name <> o.name) THEN 'invalidate' WHEN b.behind <> o.behind THEN 'refresh_behind' ELSE 'accept' END AS verdict FROM old o JOIN cur c USING (fork_id) JOIN part_known USING (fork_id) JOIN cur_all b ON b.fork_id = o.fork_id AND b.name = o.name")
def b10(spark, sf):
    """What was chosen among the tips before 1999 is cached; a fork with a branch of unknown tip gives counts only."""
    behind = (F.rank().over(Window.partitionBy("fork_id").orderBy(F.desc("tip_at"))) - 1).alias("behind")

    def ranked(rows):
        return rows.select("*", behind)

    def chosen(rows):
        lane = F.coalesce(BR.lane(F.col("is_default"), F.col("ahead"), F.col("upstreamed")), F.when(F.col("is_default"), 4))
        return store.latest(ranked(rows).withColumn("lane", lane).filter("lane is not null"), ["fork_id"], [F.col("lane"), F.desc("tip_at"), F.col("name")])

    rows = branches(spark, sf)
    cached = chosen(rows.filter(F.col("tip_at") < lit(EARLIER).cast("timestamp"))).select("fork_id", F.col("name").alias("was_tip"), F.col("ahead").alias("was_ahead"), F.col("behind").alias("was_behind"))
    now = chosen(rows).select("fork_id", F.col("name").alias("work"), (F.col("lane") < 4).alias("needs_rest"))
    known = rows.groupBy("fork_id").agg(F.bool_or(F.col("tip_at").isNull()).alias("counts_only"))
    each = ranked(rows).select("fork_id", F.col("name").alias("tip"), "ahead", "behind")
    df = cached.join(now, "fork_id").join(known, "fork_id").join(each, (cached["fork_id"] == each["fork_id"]) & (F.col("tip") == F.col("was_tip")), "left").drop(each["fork_id"])
    found = F.when(F.col("tip").isNotNull(), F.struct("ahead", "tip", "behind", "was_ahead", "was_tip", "was_behind"))
    same = F.col("needs_rest") & (F.col("work") == F.col("was_tip"))
    return df.select("fork_id", compare.cached_refresh(lit(True), F.col("counts_only"), same, found).alias("verdict"))


# clusters, caches and searches ------------------------------------------------------------------


@catalog.add("e13_skip_codes", f"WITH {B.FORKS_SQL} SELECT segment, CASE WHEN count(*) FILTER (owner < 6 AND releases > 5) = 0 THEN 'no_eligible_forks' WHEN count(*) FILTER (owner < 6 AND releases > 5) < 10 THEN 'insufficient_candidates' WHEN median(stars) > 10 THEN 'invalid_config' END AS code FROM forks GROUP BY segment")
def e13(spark, sf):
    """Forks of six owners with releases are eligible; a set of many stars has an epsilon out of range."""
    n = B.forks(spark, sf).groupBy("segment").agg(F.count_if((F.col("owner") < 6) & (F.col("releases") > 5)).alias("eligible"), F.median("stars").alias("m"))
    epsilon = F.when(F.col("m") > 10, 2.5).otherwise(0.55)
    return n.select("segment", compare.skip_code(lit(True), F.col("eligible"), epsilon, lit(3), F.col("eligible")).alias("code"))


@catalog.add("e14_cluster_cache", "SELECT event_id FROM events WHERE event_id % 3 > 0 AND event_type = 'view' AND user_id % 4 IN (0, 1) AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR")
def e14(spark, sf):
    """An event is a cached result: its type the model, its user the endpoint, every third of an old layout."""
    key, mark = F.col("event_id"), F.col("user_id") % 4
    cached = {"schema": F.when(key % 3 > 0, compare.CACHE_SCHEMA).otherwise(compare.CACHE_SCHEMA - 1), "fingerprint": F.sha2(F.concat(lit("eps=.62,model="), F.col("event_type")), 256), "computed": F.col("ts"), "model": F.concat("event_type", lit(":v"), F.col("user_id").cast("string")), "endpoint": F.when(mark == 0, "").otherwise(F.concat(lit("host"), mark.cast("string")))}
    wanted = {"fingerprint": F.sha2(lit("eps=.62,model=view"), 256), "model": lit("VIEW"), "endpoint": lit("host1")}
    return tab(spark, sf, "events").filter(compare.cache_usable(cached, wanted, F.lit("2024-01-31").cast("timestamp"))).select("event_id")


@catalog.add("e17_empty_result", "WITH c AS (SELECT 'm' || (label % 3) AS model, count(*) AS n FROM embeddings GROUP BY 1) SELECT n_nationkey AS search, coalesce(c.n, 0) AS indexed, CASE WHEN n_regionkey < 2 AND coalesce(c.n, 0) > 0 THEN 'semantic_repo_filter_empty' WHEN c.n IS NULL AND (SELECT count(*) FROM c) > 0 THEN 'semantic_model_mismatch' ELSE 'semantic_empty' END AS reason FROM nation LEFT JOIN c ON c.model = 'm' || (n_nationkey % 5)")
def e17(spark, sf):
    """A nation is a search: its key picks the model, its region whether a repository is named."""
    counts = tab(spark, sf, "embeddings").groupBy(F.concat(lit("m"), (F.col("label") % 3).cast("string")).alias("model")).agg(F.count("*").alias("n"))
    searches = tab(spark, sf, "nation").select(F.col("n_nationkey").alias("search"), F.concat(lit("m"), (F.col("n_nationkey") % 5).cast("string")).alias("model"), (F.col("n_regionkey") < 2).alias("filtered"))
    return compare.empty_search(counts, searches).select("search", "indexed", "reason")


@catalog.add("o12_search_order", "SELECT vec_id, score FROM (SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 5) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) q) ORDER BY score DESC, vec_id LIMIT 25")
def o12(spark, sf):
    """Top 25 by cosine to one query row, equal cosines by id."""
    e = tab(spark, sf, "embeddings")
    q = e.filter("vec_id = 3").select(F.col("embedding").alias("q"))
    rows = e.crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("score"))  # one query row
    return compare.search_order(rows, "score", "vec_id", 25)


def sql_phrases(column: str) -> str:
    marks = r"[.,!?:;()\[\]\"''`]"
    kept = f"list_filter(list_transform(regexp_split_to_array({column}, '\\s+'), lambda w: lower(regexp_replace(w, '^{marks}+|{marks}+$', '', 'g'))), lambda w: length(w) >= 4 AND NOT list_contains({list(labels.STOP_WORDS)}, w))"
    return f"list_concat({kept}, list_transform(range(1, len({kept})), lambda i: ({kept})[i] || ' ' || ({kept})[i + 1]))"


E10_SQL = f"""{B.FILES_SQL}, member AS (SELECT DISTINCT c_nationkey AS cluster, fork_id FROM files JOIN customer ON c_custkey = fork_id),
said AS (SELECT o_custkey AS fork_id, p_name || ' ' || lower(p_type) AS message FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'),
tok AS (SELECT cluster, fork_id, unnest({sql_phrases('message')}) AS token FROM said JOIN member USING (fork_id)),
used AS (SELECT cluster, token, count(*) AS c, count(DISTINCT fork_id) AS inside FROM tok GROUP BY ALL),
scored AS (SELECT cluster, token, round(c / sum(c) OVER (PARTITION BY cluster)::DOUBLE * ln((1.0::DOUBLE + (SELECT count(*) FROM member) - size) / (1.0::DOUBLE + sum(inside) OVER (PARTITION BY token) - inside)), 9) AS s FROM used JOIN (SELECT cluster, count(*) AS size FROM member GROUP BY cluster) USING (cluster)),
words AS (SELECT cluster, list_reduce(list_prepend([]::VARCHAR[], list([token] ORDER BY s DESC, token)), lambda acc, x: CASE WHEN len(acc) < 3 AND NOT list_has_any(string_split(array_to_string(acc, ' '), ' '), string_split(x[1], ' ')) THEN list_concat(acc, x) ELSE acc END) AS words FROM scored GROUP BY cluster),
loc AS (SELECT DISTINCT cluster, fork_id, path FROM files JOIN member USING (fork_id)),
one AS (SELECT cluster, regexp_extract(path, '^([^/]*/)', 1) AS one, count(*) AS n FROM loc GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, one) = 1),
two AS (SELECT loc.cluster, regexp_extract(path, '^([^/]*/[^/]*/)', 1) AS two, count(*) AS m FROM loc JOIN one ON one.cluster = loc.cluster WHERE starts_with(path, one.one) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY loc.cluster ORDER BY m DESC, two) = 1),
dirs AS (SELECT cluster, CASE WHEN m > 1 AND m >= 0.6 * one.n THEN two ELSE one END AS directory FROM one JOIN two USING (cluster) WHERE one.n > 1)"""


@catalog.add("e10_cluster_label", f"WITH {E10_SQL} SELECT cluster, directory || '{labels.SEPARATOR}' || array_to_string(words, ', ') AS label FROM words JOIN dirs USING (cluster)")
def e10(spark, sf):
    """The forks of an owner are a cluster; names of returned parts are their commit messages."""
    files = B.files(spark, sf)
    members = files.select("fork_id").distinct().join(tab(spark, sf, "customer").select(F.col("c_custkey").alias("fork_id"), F.col("c_nationkey").alias("cluster")), "fork_id").select("cluster", "fork_id")
    lines = tab(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    orders = tab(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("fork_id"))
    part = tab(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_name", lit(" "), F.lower("p_type")).alias("message"))
    return labels.cluster_labels(members, files, lines.join(orders, "l_orderkey").join(part, "l_partkey").select("fork_id", "message"), checkpointed).select("cluster", "label")


E3_SQL = rf"""{B.FILES_SQL}, {B.FORK_COMMITS_SQL}, p AS (SELECT fork_id, md5(string_agg(DISTINCT path, chr(10) ORDER BY path)) AS paths FROM files GROUP BY fork_id),
c AS (SELECT fork_id, md5(string_agg(text, chr(10) ORDER BY "at", doc_id)) AS commits FROM (SELECT * FROM fork_commits WHERE NOT regexp_matches(text, '(?im)^\s*Merge\b') QUALIFY row_number() OVER (PARTITION BY fork_id, lower(text) ORDER BY "at", doc_id) = 1) GROUP BY fork_id),
t AS (SELECT fork_id, string_agg('--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -0,' || deletions || ' +0,' || additions || ' @@', chr(10) ORDER BY additions + deletions DESC, path, additions) AS body FROM files GROUP BY fork_id),
d AS (SELECT fork_id, length(body) > 2000 AS truncated, regexp_replace(CASE WHEN length(body) > 2000 THEN regexp_replace(left(body, 2000), chr(10) || '$', '') ELSE body END, '(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@', '@@@@', 'g') AS diff FROM t)"""


@catalog.add("e3_fork_features", f"WITH {E3_SQL} SELECT fork_id, paths, coalesce(commits, md5('')) AS commits, md5(array_to_string(list_transform(string_split(diff, chr(10)), lambda l: array_to_string(list_transform(string_split(regexp_replace(l, '[ \\t]+', ' ', 'g'), ' '), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_]*$') THEN lower(t) ELSE t END), ' ')), chr(10))) AS diff, truncated FROM p JOIN d USING (fork_id) LEFT JOIN c USING (fork_id)")
def e3(spark, sf):
    out = features.fork_features(B.files(spark, sf), B.fork_commits(spark, sf))
    return out.select("fork_id", *(F.md5(c).alias(c) for c in ("paths", "commits", "diff")), "truncated")


# checked inputs -----------------------------------------------------------------------------------


@catalog.add("s24_topic_idf", "SELECT lang AS topic, round(greatest(1, least(8, CASE WHEN n >= 20 THEN ln((SELECT count(*) FROM documents) / n::DOUBLE) + 1 ELSE 1 END)), 6) AS idf, n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def s24(spark, sf):
    """The corpus is one JSON object, made of the languages that 20 documents have; unknown topics weigh 1."""
    d = tab(spark, sf, "documents").groupBy(F.col("lang").alias("topic")).agg(F.count("*").alias("n"))
    total = d.agg(F.sum("n").alias("all"))
    known = d.filter("topic is not null and n >= 20").crossJoin(F.broadcast(total))  # one row
    pairs = F.map_from_entries(F.collect_list(F.struct("topic", F.log(F.col("all") / F.col("n")) + 1)))
    corpus = known.agg(F.to_json(pairs).alias("corpus")).select(F.explode(code.topic_idf(F.col("corpus"))).alias("topic", "idf"))
    found = d.join(corpus, "topic", "left")
    return found.select("topic", r6(F.greatest(lit(1.0), F.least(lit(8.0), F.coalesce("idf", lit(1.0))))).alias("idf"), "n")


WEIGHT_LIST = [*code.WEIGHT_NAMES, "moon"]


@catalog.add("s10_weight_scan", f"SELECT p_partkey, CASE WHEN p_size % 14 < 13 AND price <= 2 THEN price END AS weight FROM (SELECT p_partkey, p_size, round(p_retailprice / 1000, 2) AS price FROM part)")
def s10(spark, sf):
    """Weights as JSON text: unknown names and numbers beyond 0 to 2 make the whole input bad."""
    name = F.element_at(F.array(*map(lit, WEIGHT_LIST)), F.col("p_size") % 14 + 1)
    rows = tab(spark, sf, "part").select("p_partkey", name.alias("name"), F.to_json(F.create_map(name, F.round(F.col("p_retailprice") / 1000, 2))).alias("text"))
    return rows.select("p_partkey", F.try_element_at(code.weights(F.col("text")), F.col("name")).alias("weight"))


@catalog.add("d23_lane_parser", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN lower(left(c_mktsegment, 4)) || ',new' WHEN 2 THEN 'new,' || lower(left(c_mktsegment, 4)) ELSE 'new' END AS lanes FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def d23(spark, sf):
    word = F.left("c_mktsegment", lit(4))
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(word, lit(",moon"))).when(F.col("c_custkey") % 4 == 1, F.concat(lit(" "), word, lit(", new,,"), word)).when(F.col("c_custkey") % 4 == 2, F.concat(lit("New, "), word)).otherwise(" NEW ")
    rows = tab(spark, sf, "customer").filter("c_mktsegment in ('BUILDING', 'MACHINERY')")
    return rows.select("c_custkey", F.array_join(code.lanes(raw, ("new", "buil", "mach")), ",").alias("lanes"))


@catalog.add("f8_pattern_normalise", f"SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1) THEN NULL ELSE path END AS pattern FROM (SELECT p_partkey, p_size, {B.PATH_SQL} AS path FROM part)")
def f8(spark, sf):
    path = B.path_of_part()
    kind = F.col("p_size") % 5
    raw = F.when(kind == 0, F.concat(lit("/"), path)).when(kind == 1, F.concat(lit("../"), path)).when(kind == 2, F.concat(lit("././"), path)).when(kind == 3, F.concat(lit(" "), path, lit("// "))).otherwise(path)
    return tab(spark, sf, "part").select("p_partkey", paths.normalized_pattern(raw).alias("pattern"))


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def go_imports(source: str) -> list[str]:
    return code.go_imports(source or "")


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def python_imports(source: str, module: str) -> list[str]:
    return code.python_imports(source or "", module or "")


BRAND = "lower(replace(p_brand, '#', ''))"


@catalog.add("s19_go_packages", f"SELECT p_partkey, 'example.org/' || {BRAND} || CASE WHEN p_size % 2 = 0 THEN ',other.dev/' || {BRAND} ELSE '' END AS imports FROM part")
def s19(spark, sf):
    """A part's brand is the package that its source imports; the standard library stays out."""
    brand = F.lower(F.replace("p_brand", lit("#"), lit("")))
    more = F.when(F.col("p_size") % 2 == 0, F.concat(lit('  y "other.dev/'), brand, lit('"\n'))).otherwise("")
    source = F.concat(lit('package a\nimport "fmt"\nimport (\n  "os"\n  // "no.example/c"\n  "example.org/'), brand, lit('"\n'), more, lit(")\n"))
    return tab(spark, sf, "part").select("p_partkey", F.array_join(go_imports(source), ",").alias("imports"))


@catalog.add("s20_python_modules", f"SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'numpy,pkg.' || {BRAND} || ',pkg.sub.' || {BRAND} END AS imports FROM part")
def s20(spark, sf):
    """Absolute and relative imports; a text that is no Python has none."""
    brand = F.lower(F.replace("p_brand", lit("#"), lit("")))
    source = F.concat(lit("import os, numpy\nfrom ."), brand, lit(" import x\nfrom .sub."), brand, lit(" import y\n"), F.when(F.col("p_size") % 7 == 0, "def (").otherwise(""))
    return tab(spark, sf, "part").select("p_partkey", F.array_join(python_imports(source, lit("pkg.a")), ",").alias("imports"))
