"""Queries over texts, paths, vectors, graphs and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.functions import hashing, paths, text, vectors
from arborlake.functions.numeric import lit, log_norm
from arborlake.graph import clustering
from arborlake.graph.pagerank import pagerank
from arborlake.operators import ranking, store
from arborlake.operators.evaluation import pair_auc
from arborlake.plans.core import Catalog, r6, sql_cdf, sql_log_norm
from arborlake.session import checkpointed
from arborlake.sources import bindings as B
from arborlake.sources import diffs as D

catalog = Catalog()
T = B.table

# paths --------------------------------------------------------------------------------------

PARTS_SQL = f"parts AS (SELECT p_partkey, p_size, p_brand, {B.PATH_SQL} AS path FROM part)"


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return T(spark, sf, "part").select("p_partkey", "p_size", "p_brand", B.path_of_part().alias("path"))


PATTERNS = ["vendor", "**/*.go", "standard*/*/x*", "promo/**"]
MATCH_SQL = "CASE WHEN path = 'vendor' OR starts_with(path, 'vendor/') THEN 'vendor' WHEN regexp_matches(path, '^(?:[^/]+/)*[^/]*[.]go$') THEN '**/*.go' WHEN regexp_matches(path, '^standard[^/]*/[^/]*/x[^/]*$') THEN 'standard*/*/x*' WHEN regexp_matches(path, '^promo/(?:.*)$') THEN 'promo/**' END"


@catalog.add("f9_path_match", f"WITH {PARTS_SQL} SELECT p_partkey FROM parts WHERE {MATCH_SQL} IS NOT NULL")
def f9(spark, sf):
    hit = paths.matches(F.col("path"), PATTERNS[0])
    for p in PATTERNS[1:]:
        hit = hit | paths.matches(F.col("path"), p)
    return parts(spark, sf).filter(hit).select("p_partkey")


@catalog.add("f10_first_pattern", f"WITH {PARTS_SQL} SELECT p_partkey, {MATCH_SQL} AS pattern FROM parts")
def f10(spark, sf):
    return parts(spark, sf).select("p_partkey", paths.first_match(F.col("path"), PATTERNS).alias("pattern"))


@catalog.add("f11_text_filter", f"WITH {PARTS_SQL} SELECT p_partkey FROM parts WHERE contains(lower(path), 'brand12') OR path = 'vendor' OR starts_with(path, 'vendor/')")
def f11(spark, sf):
    return parts(spark, sf).filter(F.lower("path").contains("brand12") | paths.matches(F.col("path"), "vendor")).select("p_partkey")


TOUCH_SQL = f"{B.FILES_SQL}, touched AS (SELECT fork_id, count(*) AS n, count(*) FILTER (m IS NOT NULL) AS hits, count(DISTINCT m) AS kinds FROM (SELECT *, {MATCH_SQL} AS m FROM files) GROUP BY fork_id), status AS (SELECT *, CASE WHEN fork_id % 13 = 0 THEN 'unknown' WHEN fork_id % 17 = 0 THEN 'never_pushed' WHEN hits > 0 THEN 'matched' ELSE 'unmatched' END AS status, n >= 45 AS partial FROM touched)"


def touched(spark, sf):
    f = B.files(spark, sf).withColumn("m", paths.first_match(F.col("path"), PATTERNS))
    df = f.groupBy("fork_id").agg(F.count("*").alias("n"), F.count("m").alias("hits"), F.count_distinct("m").alias("kinds"))
    status = F.when(F.col("fork_id") % 13 == 0, "unknown").when(F.col("fork_id") % 17 == 0, "never_pushed").when(F.col("hits") > 0, "matched").otherwise("unmatched")
    return df.withColumn("status", status).withColumn("partial", F.col("n") >= 45)


@catalog.add("h19_touching_match", f"WITH {TOUCH_SQL} SELECT fork_id, status, partial, hits, kinds FROM status")
def h19(spark, sf):
    return touched(spark, sf).select("fork_id", "status", "partial", "hits", "kinds")


@catalog.add("a25_touching_summary", f"WITH {TOUCH_SQL} SELECT status, count(*) AS n, count(*) FILTER (partial) AS partial FROM status GROUP BY status")
def a25(spark, sf):
    return touched(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.count_if("partial").alias("partial"))


@catalog.add("f15_emit_rule", f"WITH {TOUCH_SQL} SELECT fork_id FROM status WHERE status = 'matched' OR (status = 'unmatched' AND (partial OR fork_id % 5 = 0))")
def f15(spark, sf):
    return touched(spark, sf).filter("status = 'matched' or (status = 'unmatched' and (partial or fork_id % 5 = 0))").select("fork_id")


@catalog.add("h16_priors_score", f"WITH {B.FILES_SQL}, p AS (SELECT fork_id, bool_or(starts_with(path, 'vendor/')) AS hit, bool_or(contains(path, 'brand12')) AS word FROM files GROUP BY fork_id) SELECT fork_id, round(CASE WHEN fork_id % 50 = 0 THEN 0 ELSE (hit::INT + word::INT + (fork_id % 3 = 0)::INT) / 3.0 END, 6)::DOUBLE AS score, concat_ws(',', CASE WHEN word THEN 'keyword:brand12' END, CASE WHEN fork_id % 3 = 0 THEN 'language:go' END, CASE WHEN fork_id % 50 = 0 THEN 'owner_deny:x' END, CASE WHEN hit THEN 'path:vendor' END) AS reasons FROM p")
def h16(spark, sf):
    df = B.files(spark, sf).groupBy("fork_id").agg(F.bool_or(paths.matches(F.col("path"), "vendor")).alias("hit"), F.bool_or(F.col("path").contains("brand12")).alias("word"))
    go, deny = F.col("fork_id") % 3 == 0, F.col("fork_id") % 50 == 0
    named = [("hit", "path:vendor"), ("word", "keyword:brand12")]
    reasons = F.array_compact(F.array(*(F.when(F.col(c), F.lit(n)) for c, n in named), F.when(go, F.lit("language:go")), F.when(deny, F.lit("owner_deny:x"))))
    score = (F.col("hit").cast("int") + F.col("word").cast("int") + go.cast("int")) / 3.0
    return df.select("fork_id", r6(F.when(deny, lit(0)).otherwise(score)).alias("score"), F.array_join(F.array_sort(F.array_distinct(reasons)), ",").alias("reasons"))


@catalog.add("x4_path_parts", f"WITH {PARTS_SQL} SELECT p_partkey, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '([.][^./]*)$', 1) AS ext FROM parts")
def x4(spark, sf):
    p = F.col("path")
    return parts(spark, sf).select("p_partkey", paths.parent_dir(p).alias("dir"), paths.base_name(p).alias("base"), paths.extension(p).alias("ext"))


ANCESTOR_SQL = f"{PARTS_SQL}, anc AS (SELECT p_partkey, array_to_string(string_split(path, '/')[1:i], '/') || '/' AS dir FROM (SELECT p_partkey, path, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS i FROM parts))"


@catalog.add("x5_ancestors", f"WITH {ANCESTOR_SQL} SELECT p_partkey, dir FROM anc")
def x5(spark, sf):
    return parts(spark, sf).select("p_partkey", F.explode(paths.ancestors(F.col("path"))).alias("dir"))


@catalog.add("a23_directory_counts", f"WITH {ANCESTOR_SQL} SELECT dir, count(*) AS n FROM anc GROUP BY dir")
def a23(spark, sf):
    return parts(spark, sf).select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


TOKENS_SQL = r"toks AS (SELECT t, count(*) AS c FROM (SELECT unnest(list_filter(list_transform(regexp_split_to_array(lower(p_name), '\s+'), lambda x: trim(x, '.,:;!?()[]{}')), lambda x: x <> '')) AS t FROM part) GROUP BY t), total AS (SELECT sum(c) AS total FROM toks)"
DIRS_SQL = f"{ANCESTOR_SQL}, {TOKENS_SQL}, dirs AS (SELECT dir, count(*) AS n FROM anc GROUP BY dir), kw AS (SELECT d.dir, n, coalesce(t.c, 0) / (SELECT total FROM total) AS k FROM dirs d LEFT JOIN toks t ON t.t = list_extract(string_split(rtrim(dir, '/'), '/'), -1)), sc AS (SELECT dir, CASE WHEN (SELECT max(k) FROM kw) = 0 THEN n / (SELECT max(n) FROM kw) ELSE 0.6 * n / (SELECT max(n) FROM kw) + 0.4 * k / (SELECT max(k) FROM kw) END AS score FROM kw)"


def directory_scores(spark, sf):
    """Share of files and of message words that name the directory."""
    dirs = parts(spark, sf).select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))
    toks = T(spark, sf, "part").select(F.explode(text.message_tokens(F.col("p_name"))).alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    total = toks.agg(F.sum("c").alias("total"))
    last = F.element_at(F.split(F.regexp_replace("dir", "/$", ""), "/"), -1)
    kw = dirs.withColumn("t", last).join(toks, "t", "left").crossJoin(F.broadcast(total)).select("dir", "n", (F.coalesce("c", F.lit(0)) / F.col("total")).alias("k"))  # one row
    top = kw.agg(F.max("n").alias("mn"), F.max("k").alias("mk"))
    both = kw.crossJoin(F.broadcast(top))  # one row
    share = F.col("n") / F.col("mn")
    return both.select("dir", F.when(F.col("mk") == 0, share).otherwise(0.6 * share + 0.4 * F.try_divide(F.col("k"), F.col("mk"))).alias("score"))


@catalog.add("g5_directory_centrality", f"WITH {DIRS_SQL} SELECT dir, round(score, 6) AS score FROM sc")
def g5(spark, sf):
    return directory_scores(spark, sf).select("dir", r6(F.col("score")).alias("score"))


@catalog.add("o13_top_directories", f"WITH {DIRS_SQL} SELECT dir, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, dir LIMIT 10")
def o13(spark, sf):
    return directory_scores(spark, sf).select("dir", r6(F.col("score")).alias("score")).orderBy(F.desc("score"), "dir").limit(10)


@catalog.add("g6_touched_directories", f"WITH {DIRS_SQL}, {B.FILES_SQL}, fd AS (SELECT DISTINCT fork_id, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir FROM files) SELECT fork_id, round(avg(coalesce(score, 0)), 6) AS impact FROM fd LEFT JOIN sc USING (dir) WHERE dir <> '' GROUP BY fork_id")
def g6(spark, sf):
    fd = B.files(spark, sf).select("fork_id", paths.parent_dir(F.col("path")).alias("dir")).filter("dir <> ''").distinct()
    return fd.join(directory_scores(spark, sf), "dir", "left").groupBy("fork_id").agg(r6(F.avg(F.coalesce("score", lit(0)))).alias("impact"))


@catalog.add("a30_extension_distribution", f"WITH {B.FILES_SQL} SELECT fork_id, ext, round(count(*) / sum(count(*)) OVER (PARTITION BY fork_id), 6) AS share FROM (SELECT fork_id, CASE WHEN regexp_extract(path, '([.][^./]*)$', 1) IN ('.go', '.py', '.md', '.json', '.js') THEN regexp_extract(path, '([.][^./]*)$', 1) ELSE 'other' END AS ext FROM files) GROUP BY fork_id, ext")
def a30(spark, sf):
    ext = paths.extension(F.col("path"))
    df = B.files(spark, sf).select("fork_id", F.when(ext.isin(".go", ".py", ".md", ".json", ".js"), ext).otherwise("other").alias("ext")).groupBy("fork_id", "ext").agg(F.count("*").alias("n"))
    return df.select("fork_id", "ext", r6(F.col("n") / F.sum("n").over(Window.partitionBy("fork_id"))).alias("share"))


@catalog.add("e7_content_archetype", f"WITH {B.FILES_SQL}, a AS (SELECT fork_id, bool_or(regexp_matches(path, 'auth|security|jwt|oauth|crypto|password|token')) AS sec, bool_and(regexp_matches(path, '([.]md|[.]rst|[.]txt)$')) AS docs, count(*) AS n, sum(additions) AS a, sum(deletions) AS d FROM files GROUP BY fork_id) SELECT fork_id, CASE WHEN sec THEN 'security' WHEN docs THEN 'docs' WHEN n >= 5 AND a + d > 0 AND abs(a - d) / (a + d) < 0.1 THEN 'refactor' ELSE 'general' END AS archetype FROM a")
def e7(spark, sf):
    p, a, d = F.col("path"), F.sum("additions"), F.sum("deletions")
    df = B.files(spark, sf).groupBy("fork_id").agg(F.bool_or(p.rlike("auth|security|jwt|oauth|crypto|password|token")).alias("sec"), F.bool_and(paths.ends_with(p, (".md", ".rst", ".txt"))).alias("docs"), F.count("*").alias("n"), a.alias("a"), d.alias("d"))
    even = (F.col("n") >= 5) & (F.col("a") + F.col("d") > 0) & (F.abs(F.col("a") - F.col("d")) / F.nullif(F.col("a") + F.col("d"), F.lit(0)) < 0.1)
    return df.select("fork_id", F.when(F.col("sec"), "security").when(F.col("docs"), "docs").when(even, "refactor").otherwise("general").alias("archetype"))


# texts --------------------------------------------------------------------------------------

LEX_SQL = r"lx AS (SELECT item_id, line_no, w, row_number() OVER (PARTITION BY item_id, line_no ORDER BY i) AS i FROM (SELECT item_id, line_no, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, line_no, list_filter(regexp_extract_all(line, '[\p{L}\p{Nd}]+'), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$')) AS ws FROM (SELECT item_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) AS line_no FROM benchmark)))), tk AS (SELECT item_id, w AS token FROM lx UNION ALL SELECT a.item_id, a.w || ' ' || b.w FROM lx a JOIN lx b ON a.item_id = b.item_id AND a.line_no = b.line_no AND b.i = a.i + 1)"


def lexical(spark, sf):
    return T(spark, sf, "benchmark").select("item_id", F.explode(text.lexical_tokens(F.col("text"))).alias("token"))


@catalog.add("x7_lexical_tokens", f"WITH {LEX_SQL} SELECT item_id, token, count(*) AS n FROM tk GROUP BY ALL")
def x7(spark, sf):
    return lexical(spark, sf).groupBy("item_id", "token").agg(F.count("*").alias("n"))


@catalog.add("a29_document_frequency", f"WITH {LEX_SQL} SELECT token, count(DISTINCT item_id) AS df, count(*) AS n FROM tk GROUP BY token")
def a29(spark, sf):
    return lexical(spark, sf).groupBy("token").agg(F.count_distinct("item_id").alias("df"), F.count("*").alias("n"))


@catalog.add("a13_mean_idf", f"WITH {LEX_SQL}, df AS (SELECT token, count(DISTINCT item_id) AS df FROM tk GROUP BY token), i AS (SELECT item_id, greatest(1, least(8, ln(40.0 / df))) AS idf FROM (SELECT DISTINCT item_id, token FROM tk) JOIN df USING (token)) SELECT item_id, round(avg(idf), 6) AS mean_idf, round(median(idf), 6) AS median_idf FROM i GROUP BY item_id")
def a13(spark, sf):
    t = lexical(spark, sf).distinct()
    df = t.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(lit(1), F.least(lit(8), F.log(40.0 / F.col("df"))))
    return t.join(df, "token").withColumn("idf", idf).groupBy("item_id").agg(r6(F.avg("idf")).alias("mean_idf"), r6(F.median("idf")).alias("median_idf"))


def sql_fnv64(word: str) -> str:
    """FNV-1a of 64 bits as a signed number, byte by byte in 128-bit arithmetic."""
    octets = f"list_transform(range(strlen({word})), lambda i: ('0x' || substr(hex(encode({word})), (2 * i + 1)::INT, 2))::INT::HUGEINT)"
    h = f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {octets}), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    return f"(({h} + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT"


E1_SQL = f"""{LEX_SQL}, c AS (SELECT item_id, token, count(*) AS c FROM tk GROUP BY ALL), df AS (SELECT token, count(*) AS df, {sql_fnv64("token")} AS h FROM c GROUP BY token),
cells AS (SELECT item_id, (h & 511)::INT AS place, sum((1 + ln(c::DOUBLE)) * (1 + ln((1.0::DOUBLE + (SELECT count(*) FROM benchmark)) / (1.0::DOUBLE + df))) * CASE WHEN h < 0 THEN -1 ELSE 1 END) AS x FROM c JOIN df USING (token) GROUP BY ALL)"""


@catalog.add("e1_lexical_embedder", f"WITH {E1_SQL} SELECT item_id, place, round(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 0), 6) + 0.0::DOUBLE AS weight FROM cells")
def e1(spark, sf):
    """Signed feature hashing of tf-idf weights into 512 places, unit length (item, place, weight)."""
    t = lexical(spark, sf).groupBy("item_id", "token").agg(F.count("*").alias("c"))
    n = T(spark, sf, "benchmark").agg(F.count("*").alias("n"))
    df = t.groupBy("token").agg(F.count("*").alias("df"))
    hashed = df.select("token", "df", hashing.fnv_signed("token").alias("h")).crossJoin(F.broadcast(n))  # one row
    w = (1 + F.log(F.col("c").cast("double"))) * (1 + F.log((1.0 + F.col("n")) / (1.0 + F.col("df")))) * F.when(F.col("h") < 0, -1).otherwise(1)
    cells = t.join(hashed, "token").groupBy("item_id", F.col("h").bitwiseAND(F.lit(511)).cast("int").alias("place")).agg(F.sum(w).alias("x"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item_id")))
    return cells.select("item_id", "place", r6(F.col("x") / F.nullif(size, lit(0))).alias("weight"))


@catalog.add("x10_message_tokens", f"WITH {TOKENS_SQL} SELECT t, c FROM toks")
def x10(spark, sf):
    return T(spark, sf, "part").select(F.explode(text.message_tokens(F.col("p_name"))).alias("t")).groupBy("t").agg(F.count("*").alias("c"))


@catalog.add("x9_path_tokens", f"WITH {PARTS_SQL} SELECT t, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(path), '[.][^./]*$', ''), '[-/_.]+')) AS t FROM parts) WHERE length(t) >= 3 AND t NOT IN ('src', 'lib', 'internal', 'test') GROUP BY t")
def x9(spark, sf):
    return parts(spark, sf).select(F.explode(text.path_tokens(F.col("path"))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))


@catalog.add("x11_normalize_diff", r"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_transform(string_split(regexp_replace(l, '[ \t]+', ' ', 'g'), ' '), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_]*$') THEN lower(t) ELSE t END), ' ')), chr(10))) AS h FROM documents")
def x11(spark, sf):
    return T(spark, sf, "documents").select("doc_id", F.md5(text.normalize_diff(F.col("text"))).alias("h"))


@catalog.add("x13_truncation", "SELECT doc_id, md5(left(text, 2000)) AS a, md5(left(text, 1500)) AS b FROM documents")
def x13(spark, sf):
    return T(spark, sf, "documents").select("doc_id", F.md5(F.left("text", F.lit(2000))).alias("a"), F.md5(F.left("text", F.lit(1500))).alias("b"))


@catalog.add("x14_semantic_document", "SELECT doc_id, sha256(array_to_string(list_filter([source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END, text], lambda s: s <> ''), chr(10) || chr(10))) AS h FROM documents")
def x14(spark, sf):
    body = text.semantic_document(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.col("text"))
    return T(spark, sf, "documents").select("doc_id", F.sha2(body, 256).alias("h"))


@catalog.add("x2_format_stars", "SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0::DOUBLE) WHEN n >= 10000 THEN printf('%.0fK', (n // 1000)::DOUBLE) WHEN n >= 1000 THEN printf('%.1fK', (n // 100) / 10.0::DOUBLE) ELSE n::VARCHAR END AS stars FROM (SELECT o_orderkey, CASE WHEN n >= 1000000 THEN n // 100000 * 100000 ELSE n END AS n FROM (SELECT o_orderkey, (floor(o_totalprice) * CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 1 END)::BIGINT // 1000 * 1000 // CASE WHEN o_orderkey % 5 = 0 THEN 1000 ELSE 1 END // 100 * 100 AS n FROM orders))")
def x2(spark, sf):
    n = F.floor("o_totalprice").cast("long") * F.when(F.col("o_orderkey") % 3 == 0, 10).otherwise(1)
    n = F.floor(n / 1000) * 1000
    n = F.floor(F.floor(n / F.when(F.col("o_orderkey") % 5 == 0, 1000).otherwise(1)) / 100) * 100
    n = F.when(n >= 1_000_000, F.floor(n / 100_000) * 100_000).otherwise(n)
    return T(spark, sf, "orders").select("o_orderkey", text.format_stars(n).alias("stars"))


URL_SQL = "regexp_extract(url, '^[^:]+://([^/:?#]+)', 1)"


@catalog.add("s22_repo_url", f"SELECT page_id, lower({URL_SQL}) AS host, CASE WHEN len(p) >= 2 THEN array_to_string(p[1:len(p) - 1], '/') END AS owner, CASE WHEN len(p) >= 2 THEN regexp_replace(p[len(p)], '[.]git$', '') END AS repo FROM (SELECT page_id, url, string_split(trim(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), '/') AS p FROM pages)")
def s22(spark, sf):
    u = text.repo_url(F.col("url"))
    return T(spark, sf, "pages").select("page_id", u["host"].alias("host"), u["owner"].alias("owner"), u["repo"].alias("repo"))


@catalog.add("s23_pr_reference", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN source END AS owner, CASE WHEN doc_id % 3 < 2 THEN lang END AS repo, CASE WHEN doc_id % 3 < 2 THEN doc_id::INT END AS number FROM documents")
def s23(spark, sf):
    form = F.col("doc_id") % 3
    ref = F.when(form == 0, F.format_string("%s/%s#%d", "source", "lang", "doc_id")).when(form == 1, F.format_string("https://github.com/%s/%s/pull/%d/files", "source", "lang", "doc_id")).otherwise("nothing here")
    p = text.pr_reference(F.col("ref"))
    return T(spark, sf, "documents").withColumn("ref", ref).select("doc_id", p["owner"].alias("owner"), p["repo"].alias("repo"), p["number"].alias("number"))


@catalog.add("x16_remote_url", "SELECT doc_id, 'host.org/' || source || '/' || lang AS remote FROM documents")
def x16(spark, sf):
    form = F.col("doc_id") % 3
    raw = F.when(form == 0, F.format_string("git@host.org:%s/%s.git", "source", "lang")).when(form == 1, F.format_string("https://host.org/%s/%s.git", "source", "lang")).otherwise(F.format_string("ssh://git@host.org/%s/%s/", "source", "lang"))
    return T(spark, sf, "documents").select("doc_id", text.remote_url(raw).alias("remote"))


@catalog.add("x17_day_arithmetic", "SELECT event_id, DATE '2024-01-31' - ts::DATE BETWEEN 0 AND 30 AS retained, (DATE '2024-01-31' - ts::DATE)::INT AS days FROM events")
def x17(spark, sf):
    days = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return T(spark, sf, "events").select("event_id", days.between(0, 30).alias("retained"), days.alias("days"))


@catalog.add("x19_json_field", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def x19(spark, sf):
    return T(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@catalog.add("x24_repo_key", "SELECT page_id, lower('github:' || regexp_extract(url, '^[^:]+://([^/:?#]+)', 1) || ':' || page_id) AS k FROM pages")
def x24(spark, sf):
    return T(spark, sf, "pages").select("page_id", F.lower(F.concat_ws(":", F.lit("github"), text.repo_url(F.col("url"))["host"], F.col("page_id").cast("string"))).alias("k"))


@catalog.add("s15_simple_diff", f"WITH {PARTS_SQL} SELECT p_brand AS key, path, sum(p_size % 5)::BIGINT AS additions, sum(p_size % 3)::BIGINT AS deletions FROM parts GROUP BY p_brand, path, p_partkey")
def s15(spark, sf):
    return D.simple_diff_counts(part_diffs(spark, sf))


def part_diffs(spark, sf):
    """A diff for each brand with a file for each of its parts."""
    p = F.col("path")
    a, d = (F.col("p_size") % 5).cast("int"), (F.col("p_size") % 3).cast("int")
    head = F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n"))
    body = F.when(a + d > 0, F.concat(F.format_string("@@ -1,%d +1,%d @@\n", d, a), F.repeat(F.lit("-old\n"), d), F.repeat(F.lit("+new\n"), a))).otherwise("")
    one = F.struct("p_partkey", F.concat(head, body).alias("t"))
    return parts(spark, sf).groupBy(F.col("p_brand").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "").alias("diff"))


@catalog.add("s14_unified_diff", f"WITH {PARTS_SQL} SELECT p_brand AS key, path, 'modified' AS status, (p_size % 5)::BIGINT AS additions, (p_size % 3)::BIGINT AS deletions FROM parts")
def s14(spark, sf):
    return D.diff_files(part_diffs(spark, sf)).select("key", "path", "status", "additions", "deletions")


# vectors ------------------------------------------------------------------------------------


@catalog.add("x21_cosine", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 5) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def x21(spark, sf):
    e = T(spark, sf, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))  # one query row


@catalog.add("e16_vector_search", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round(list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) DESC, a.vec_id LIMIT 20")
def e16(spark, sf):
    e = T(spark, sf, "embeddings").filter(vectors.valid_vector(F.col("embedding"), 64))
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("q")), 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)  # one query row


@catalog.add("x20_vector_validation", "SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64) AS valid FROM embeddings")
def x20(spark, sf):
    return T(spark, sf, "embeddings").agg(F.count("*").alias("n"), F.count_if(vectors.valid_vector(F.col("embedding"), 64)).alias("valid"))


@catalog.add("e2_multimodal_concat", "SELECT vec_id, round(sqrt(0.3 * 0.3 / (0.3 * 0.3 + CASE WHEN vec_id % 2 = 0 THEN 0.2 * 0.2 ELSE 0 END)), 4) AS share, 128::BIGINT AS size FROM embeddings")
def e2(spark, sf):
    second = F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))
    v = vectors.concat_blocks([(F.col("embedding"), 0.3, 64), (second, 0.2, 64)])
    return T(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(vectors.norm(F.slice("v", 1, 64)), 4).alias("share"), F.size("v").cast("long").alias("size"))


# a document's language stands for the primary language of a fork; Haskell is in no bucket
SPOKEN = {"en": "Go", "de": "Python", "fr": "Solidity", "es": "Haskell"}
SPOKEN_SQL = f"CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SPOKEN.items())} END"


@catalog.add("x23_one_hot", f"SELECT doc_id, array_to_string(list_concat(list_transform({vectors.LANGUAGES}, lambda x: CASE WHEN x = spoken THEN 1 ELSE 0 END), [CASE WHEN coalesce(list_contains({vectors.LANGUAGES}, spoken), false) THEN 0 ELSE 1 END]), ',') AS v FROM (SELECT doc_id, {SPOKEN_SQL} AS spoken FROM documents)")
def x23(spark, sf):
    spoken = F.create_map(*(F.lit(x) for pair in SPOKEN.items() for x in pair))[F.col("lang")]
    return T(spark, sf, "documents").select("doc_id", F.array_join(F.transform(vectors.language_one_hot(spoken), lambda x: x.cast("int").cast("string")), ",").alias("v"))


EPSILON = 0.62
PAIRS_SQL = f"pr AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE 1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {EPSILON})"
REACH_SQL = f"RECURSIVE {PAIRS_SQL}, e AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y), c AS (SELECT x AS id, least(x, min(y)) AS c FROM r GROUP BY x), s AS (SELECT c FROM c GROUP BY c HAVING count(*) >= 3), member AS (SELECT id, c FROM c JOIN s USING (c))"


def points(spark, sf):
    return T(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@catalog.add("j12_epsilon_pairs", f"WITH {PAIRS_SQL} SELECT a, b FROM pr")
def j12(spark, sf):
    return clustering.close_pairs(points(spark, sf), EPSILON)


@catalog.add("e8_single_linkage", f"WITH {REACH_SQL} SELECT vec_id AS id, c AS cluster FROM embeddings LEFT JOIN member ON id = vec_id")
def e8(spark, sf):
    return clustering.cluster(points(spark, sf), EPSILON, checkpointed)


CENTROID_SQL = f"{REACH_SQL}, mean AS (SELECT c, i, avg(x)::FLOAT AS x FROM (SELECT c, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM member JOIN embeddings ON vec_id = id) GROUP BY c, i), len AS (SELECT c, sqrt(sum(x::DOUBLE * x)) AS n FROM mean GROUP BY c)"


@catalog.add("a22_centroids", f"WITH {CENTROID_SQL} SELECT c AS cluster, (i - 1)::INT AS place, round(x / n, 4)::DOUBLE AS x FROM mean JOIN len USING (c)")
def a22(spark, sf):
    p = points(spark, sf)
    c = clustering.centroids(p, clustering.cluster(p, EPSILON, checkpointed))
    return c.select("cluster", F.posexplode("centroid").alias("place", "x")).select("cluster", "place", F.round(F.col("x").cast("double"), 4).alias("x"))


@catalog.add("e9_novelty", f"WITH {CENTROID_SQL}, d AS (SELECT id, 1 - sum(v * (x / n)) AS d FROM (SELECT id, c, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM member JOIN embeddings ON vec_id = id) JOIN mean USING (c, i) JOIN len USING (c) GROUP BY id) SELECT vec_id AS id, round(CASE WHEN d IS NULL THEN 1 ELSE greatest(0, least(1, d / {EPSILON})) END, 4) AS novelty FROM embeddings LEFT JOIN d ON id = vec_id")
def e9(spark, sf):
    p = points(spark, sf)
    members = checkpointed(clustering.cluster(p, EPSILON, checkpointed))
    c = clustering.centroids(p, members)
    d = 1 - vectors.dot(F.col("vec"), F.col("centroid"))
    df = members.join(p, "id").join(c, "cluster", "left")
    return df.select("id", F.round(F.when(F.col("cluster").isNull(), lit(1)).otherwise(F.greatest(lit(0), F.least(lit(1), d / EPSILON))), 4).alias("novelty"))


@catalog.add("e18_same_label_auc", "WITH p AS (SELECT a.label = b.label AS same, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), r AS (SELECT same, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM p) SELECT round((sum(r) FILTER (same) - count(*) FILTER (same) * (count(*) FILTER (same) + 1) / 2) / (count(*) FILTER (same) * count(*) FILTER (NOT same)), 4) AS auc FROM r")
def e18(spark, sf):
    """Whether vectors of one label are nearer: AUC of pair cosines, by counts of equal values."""
    points = T(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return pair_auc(clustering.pair_values(points), "value", checkpointed).select(F.round("auc", 4).alias("auc"))


@catalog.add("j15_sibling_similarity", "SELECT a.vec_id, round(max(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS best FROM embeddings a, embeddings b WHERE b.vec_id < 20 AND a.vec_id <> b.vec_id GROUP BY a.vec_id")
def j15(spark, sf):
    e = T(spark, sf, "embeddings")
    candidates = e.filter("vec_id < 20").select(F.col("vec_id").alias("o"), F.col("embedding").alias("w"))  # twenty siblings
    pairs = e.join(F.broadcast(candidates), F.col("vec_id") != F.col("o"))
    return pairs.groupBy("vec_id").agg(F.round(F.max(vectors.dot(F.col("embedding"), F.col("w"))), 5).alias("best"))


@catalog.add("e15_incremental_indexing", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND d.doc_id % 3 > 0)")
def e15(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    e = T(spark, sf, "embeddings").join(d, F.col("vec_id") == F.col("doc_id")).select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("digest")).otherwise("old").alias("digest"))
    return store.pending(d, e, "doc_id", "digest").select("doc_id")


# graphs -------------------------------------------------------------------------------------


def supply_graph(spark, sf):
    """Suppliers, brands and types; a line links its supplier to its brand, a brand to its types."""
    part = T(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    line = T(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    first = line.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.col("p_brand").alias("dst"))
    edges = first.union(part.select("p_brand", "p_type")).distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes, edges


@catalog.add("g1_graph_build", "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, p_brand AS dst FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT DISTINCT p_brand, p_type FROM part) SELECT src, count(*) AS degree FROM e GROUP BY src")
def g1(spark, sf):
    _, edges = supply_graph(spark, sf)
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


@catalog.add("g2_pagerank")
def g2(spark, sf):
    nodes, edges = supply_graph(spark, sf)
    return pagerank(nodes.withColumn("weight", lit(0)), edges, checkpointed)


@catalog.add("g3_entry_point_teleport")
def g3(spark, sf):
    nodes, edges = supply_graph(spark, sf)
    return pagerank(nodes.withColumn("weight", F.when(F.col("node").startswith("s"), lit(1)).otherwise(lit(0))), edges, checkpointed)


LINEAGE_SQL = "links AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@catalog.add("g7_lineage_depth", f"WITH RECURSIVE {LINEAGE_SQL}, d(node, depth) AS (SELECT child, 1 FROM links WHERE parent LIKE 'r%' UNION ALL SELECT child, depth + 1 FROM links JOIN d ON parent = node WHERE depth < 5) SELECT node, min(depth)::INT AS depth FROM d GROUP BY node")
def g7(spark, sf):
    links = T(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
    links = links.union(T(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))))
    level = links.filter(F.col("parent").startswith("r")).select(F.col("child").alias("node"), F.lit(1).alias("depth"))
    every = level
    for depth in range(2, 4):  # the depth bound of a listing
        level = level.join(links, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), F.lit(depth).alias("depth"))
        every = every.union(level)
    return every.groupBy("node").agg(F.min("depth").alias("depth"))


@catalog.add("s4_bounded_traversal", f"WITH RECURSIVE {LINEAGE_SQL}, d(node, depth) AS (SELECT child, 1 FROM links WHERE parent = 'r1' UNION ALL SELECT child, depth + 1 FROM links JOIN d ON parent = node WHERE depth < 2) SELECT depth::INT AS depth, count(DISTINCT node) AS n FROM d GROUP BY depth")
def s4(spark, sf):
    first = T(spark, sf, "nation").filter("n_regionkey = 1").select("n_nationkey")
    second = T(spark, sf, "customer").join(first, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return first.agg(F.count("*").alias("n")).select(F.lit(1).alias("depth"), "n").union(second.agg(F.count("*")).select(F.lit(2), "count(1)"))


@catalog.add("g4_touched_modules", "WITH f AS (SELECT l_suppkey AS file, p_brand AS module, p_retailprice AS score FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT module, max(score) AS score FROM f GROUP BY module) SELECT file, round(least(avg(m.score) / (SELECT max(score) FROM m), 1), 6) AS impact FROM (SELECT DISTINCT file, module FROM f) JOIN m USING (module) GROUP BY file")
def g4(spark, sf):
    f = T(spark, sf, "lineitem").join(T(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("file"), F.col("p_brand").alias("module"), F.col("p_retailprice").alias("score"))
    m = f.groupBy("module").agg(F.max("score").alias("score"))
    top = m.agg(F.max("score").alias("top"))
    each = f.select("file", "module").distinct().join(m, "module").crossJoin(F.broadcast(top))  # one row
    return each.groupBy("file").agg(r6(F.least(F.avg("score") / F.first("top"), lit(1))).alias("impact"))


@catalog.add("j16_file_to_module", f"WITH {PARTS_SQL} SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN 'file:' || path END, 'dir:' || regexp_extract(path, '^(.*/)[^/]*$', 1)) AS module FROM parts")
def j16(spark, sf):
    p = parts(spark, sf)
    by_file = p.filter("p_size % 2 = 0").select("path", F.concat(F.lit("file:"), "path").alias("fm")).distinct()
    dirs = p.select(paths.parent_dir(F.col("path")).alias("dir")).distinct().withColumn("dm", F.concat(F.lit("dir:"), "dir"))
    df = p.withColumn("dir", paths.parent_dir(F.col("path"))).join(by_file, "path", "left").join(dirs, "dir", "left")
    return df.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.coalesce("fm", "dm")).otherwise(F.col("dm")).alias("module"))


@catalog.add("j17_path_pattern_join", f"WITH {PARTS_SQL}, pt(pattern, re) AS (VALUES ('go', '[.]go$'), ('md', '[.]md$'), ('vendor', '^vendor/')) SELECT pattern, count(*) AS n FROM parts JOIN pt ON regexp_matches(path, re) GROUP BY pattern")
def j17(spark, sf):
    rules = spark.createDataFrame([("go", "[.]go$"), ("md", "[.]md$"), ("vendor", "^vendor/")], "pattern string, re string")
    return parts(spark, sf).join(F.broadcast(rules), F.expr("path rlike re")).groupBy("pattern").agg(F.count("*").alias("n"))


@catalog.add("j13_win_pairs", f"WITH a AS (SELECT s_suppkey AS k, s_acctbal / 100 AS m, 1 + s_suppkey % 5 AS sd FROM supplier), g AS (SELECT a.k, (a.m - b.m) / sqrt(a.sd * a.sd + b.sd * b.sd) AS z FROM a JOIN a b ON a.k <> b.k) SELECT k, round(sum({sql_cdf('z')}), 5) AS won FROM g GROUP BY k")
def j13(spark, sf):
    a = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 100).alias("m"), (1 + F.col("s_suppkey") % 5).cast("double").alias("sd"))
    return ranking.win_sums(a, "k", "m", "sd", checkpointed).select("k", F.round("won", 5).alias("won"))


@catalog.add("m1_log_norm", f"SELECT p_partkey, round({sql_log_norm('p_retailprice', 1000)}, 6) AS x, round(1 - {sql_log_norm('p_size', 20)}, 6) AS inverse FROM part")
def m1(spark, sf):
    return T(spark, sf, "part").select("p_partkey", r6(log_norm(F.col("p_retailprice"), 1000)).alias("x"), r6(1 - log_norm(F.col("p_size"), 20)).alias("inverse"))


@catalog.add("m4_normal_cdf", f"SELECT s_suppkey, round({sql_cdf('(s_acctbal / 2500)')}, 6) AS p FROM supplier")
def m4(spark, sf):
    from arborlake.functions.numeric import normal_cdf

    return T(spark, sf, "supplier").select("s_suppkey", r6(normal_cdf(F.col("s_acctbal") / 2500)).alias("p"))


@catalog.add("m12_fnv1a", f"SELECT n_name, {sql_fnv64('n_name')} AS h FROM nation")
def m12(spark, sf):
    return T(spark, sf, "nation").select("n_name", hashing.fnv_signed("n_name").alias("h"))


@catalog.add("x1_utf8_repair", "SELECT doc_id, left(text, k) || repeat(chr(65533), (least(41, strlen(text)) - strlen(left(text, k)))::INT) AS head FROM (SELECT doc_id, text, list_max(list_filter(range(42), lambda k: strlen(left(text, k::INT)) <= 41))::INT AS k FROM documents)")
def x1(spark, sf):
    cut = F.substring(F.encode("text", "UTF-8"), 1, 41)
    return T(spark, sf, "documents").select("doc_id", hashing.repaired(cut).alias("head"))


@catalog.add("s16_html_scrape", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a\\s')) AS links FROM pages")
def s16(spark, sf):
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return T(spark, sf, "pages").select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)(<a\s)"), 1)).cast("long").alias("links"))


@catalog.add("k2_csv_batch", f"WITH {B.FORKS_SQL} SELECT printf('%d,%s,%.2f,%.3f', fork_id, coalesce(segment, ''), c_acctbal, stars / 100.0::DOUBLE) AS line FROM forks")
def k2(spark, sf):
    return B.forks(spark, sf).select(F.format_string("%d,%s,%.2f,%.3f", "fork_id", F.coalesce("segment", F.lit("")), "c_acctbal", F.col("stars") / 100.0).alias("line"))


@catalog.add("k1_ndjson_records", f"""WITH {B.FORKS_SQL} SELECT '{{"fork_id":' || fork_id || coalesce(',"segment":"' || segment || '"', '') || ',"stars":' || stars || CASE WHEN releases > 0 THEN ',"releases":' || releases ELSE '' END || ',"pushed_at":"' || strftime(pushed_at, '%Y-%m-%dT%H:%M:%S.%g') || '"}}' AS record FROM forks""")
def k1(spark, sf):
    """One JSON record for each fork; keys without a value are left out."""
    f = B.forks(spark, sf).withColumn("releases", F.nullif("releases", F.lit(0)))
    return f.select(F.to_json(F.struct("fork_id", "segment", "stars", "releases", "pushed_at")).alias("record"))


@catalog.add("w11_greedy_batches", "WITH i AS (SELECT source, list([{'doc_id': doc_id, 'n': n_chars, 'batch': 0, 'count': 1, 'size': n_chars}] ORDER BY doc_id) AS items FROM documents GROUP BY source), b AS (SELECT source, unnest(list_reduce(items, lambda acc, x: list_append(acc, {'doc_id': x[1].doc_id, 'n': x[1].n, 'batch': acc[-1].batch + CASE WHEN acc[-1].count >= 32 OR acc[-1].size + x[1].n > 20000 THEN 1 ELSE 0 END, 'count': CASE WHEN acc[-1].count >= 32 OR acc[-1].size + x[1].n > 20000 THEN 1 ELSE acc[-1].count + 1 END, 'size': CASE WHEN acc[-1].count >= 32 OR acc[-1].size + x[1].n > 20000 THEN x[1].n ELSE acc[-1].size + x[1].n END}))) AS r FROM i) SELECT source, r.doc_id AS doc_id, r.batch::INT AS batch FROM b")
def w11(spark, sf):
    """Documents of a source in batches of at most 32 rows and 20,000 characters, in order."""
    item = F.struct("doc_id", "n_chars")
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("rows"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<doc_id:bigint,batch:int>>").alias("out"))

    def step(s, x):
        full = (s["rows"] > 0) & ((s["rows"] >= 32) | (s["size"] + x["n_chars"] > 20_000))
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        row = F.struct(x["doc_id"].alias("doc_id"), batch.alias("batch"))
        return F.struct(batch.alias("batch"), F.when(full, 1).otherwise(s["rows"] + 1).alias("rows"), F.when(full, x["n_chars"]).otherwise(s["size"] + x["n_chars"]).alias("size"), F.concat(s["out"], F.array(row)).alias("out"))

    df = T(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return df.select("source", F.explode(F.aggregate("items", start, step)["out"]).alias("x")).select("source", "x.doc_id", "x.batch")


# events: substrate, not derived from the reference ------------------------------------------


@catalog.add("t3_tumbling_day", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def t3(spark, sf):
    w = F.window("ts", "1 day")
    return T(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("w.start").alias("day"), "event_type", "n", "v")


@catalog.add("t3_session_window", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def t3s(spark, sf):
    w = F.session_window("ts", "6 hours")
    return T(spark, sf, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
