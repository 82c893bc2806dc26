"""Queries of the heat score: tiers, trust, penalties, ranks, labels.

A network of forks is a market segment, so every set operation runs by segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.functions import numeric as N
from arborlake.operators import behaviour, decisions, scoring
from arborlake.operators.order import positions, with_percentiles
from arborlake.plans.core import Catalog, r6, sql_class, sql_days, sql_decay, sql_log_norm, sql_percentile
from arborlake.session import checkpointed
from arborlake.sources import bindings as B

catalog = Catalog()
NET = ["segment"]
NOW_SQL = f"TIMESTAMP '{B.NOW}'"


def tier1(spark: SparkSession, sf: str) -> DataFrame:
    """Forks with days since the push, first-tier points (``p_`` columns) and score ``t1``."""
    forks = B.forks(spark, sf)
    now = F.lit(B.NOW).cast("timestamp")
    newest = forks.agg(F.max("pushed_at").alias("upstream_at"))
    forks = forks.crossJoin(F.broadcast(newest))  # one row
    forks = forks.withColumns({"days": N.days_between(now, F.col("pushed_at")), "upstream_days": N.days_between(now, F.col("upstream_at"))})
    points = scoring.tier1_points(F.col("days"), F.col("upstream_days"), F.col("stars"), F.col("sub_forks"), F.col("releases"))
    return forks.withColumns({f"p_{k}": v for k, v in points.items()} | {"t1": scoring.tier_score(points, 1)})


T1_SQL = f"""{B.FORKS_SQL}, up AS (SELECT max(pushed_at) AS upstream_at FROM forks),
t AS (SELECT f.*, upstream_at, {sql_days(NOW_SQL, "pushed_at")} AS days, {sql_days(NOW_SQL, "upstream_at")} AS upstream_days FROM forks f, up),
tier1 AS (SELECT *, least(40, recency + star_pts + fork_pts + release_pts) AS t1 FROM (
  SELECT *, {sql_decay("days", "(CASE WHEN upstream_days > 365 THEN greatest(30, upstream_days * 0.25) ELSE 30 END)")} * 12 AS recency,
    {sql_log_norm("stars", 10000)} * 12 AS star_pts, least(sub_forks * 2.0::DOUBLE, 8) AS fork_pts, {sql_log_norm("releases", 20)} * 8 AS release_pts FROM t))"""


@catalog.add("h1_tier1_components", f"WITH {T1_SQL} SELECT fork_id, round(recency, 6) AS recency, round(star_pts, 6) AS stars, round(fork_pts, 6) AS sub_forks, round(release_pts, 6) AS releases, round(t1, 6) AS t1 FROM tier1")
def h1(spark, sf):
    return tier1(spark, sf).select("fork_id", *(r6(F.col(f"p_{k}")).alias(k) for k in ("recency", "stars", "sub_forks", "releases")), r6(F.col("t1")).alias("t1"))


@catalog.add("h4_weighted_score", f"WITH {T1_SQL} SELECT fork_id, round(least(40, recency * 0.5 + star_pts * 2 + fork_pts + release_pts), 6) AS score, 0.3::DOUBLE AS confidence FROM tier1")
def h4(spark, sf):
    df = tier1(spark, sf)
    points = scoring.weighted({k: F.col(f"p_{k}") for k in ("recency", "stars", "sub_forks", "releases")}, {"recency": 0.5, "stars": 2.0})
    return df.select("fork_id", r6(scoring.tier_score(points, 1)).alias("score"), N.tier_confidence(F.lit(1)).alias("confidence"))


@catalog.add("w3_percentile_ranks", f"WITH {T1_SQL} SELECT fork_id, round({sql_percentile('stars', 'segment')}, 6) AS stars_pct, round({sql_percentile('sub_forks', 'segment')}, 6) AS forks_pct, round(1 - {sql_percentile('days', 'segment')}, 6) AS recency_pct FROM tier1")
def w3(spark, sf):
    df = trusted(spark, sf)
    return df.select("fork_id", r6(F.col("stars_pct")).alias("stars_pct"), r6(F.col("sub_forks_pct")).alias("forks_pct"), r6(F.col("recency_pct")).alias("recency_pct"))


@catalog.add("a14_midpoint_percentile", f"WITH {B.FORKS_SQL} SELECT fork_id, round({sql_percentile('releases', 'segment')}, 6) AS pct FROM forks")
def a14(spark, sf):
    return with_percentiles(B.forks(spark, sf), NET, ["releases"]).select("fork_id", r6(F.col("releases_pct")).alias("pct"))


def trusted(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.with_trust(tier1(spark, sf).withColumn("score", F.col("t1")), NET)


TRUST_SQL = f"""{T1_SQL}, trusted AS (SELECT *, CASE WHEN set_size < 10 THEN t1 ELSE least(t1 * (0.7 + 0.3 * trust), 100) END AS score FROM (
  SELECT *, count(*) OVER (PARTITION BY segment) AS set_size, {sql_percentile("stars", "segment")} * 0.7 + {sql_percentile("sub_forks", "segment")} * 0.3 AS trust,
         1 - {sql_percentile("days", "segment")} AS recency_pct FROM tier1))"""


@catalog.add("h5_trust", f"WITH {TRUST_SQL} SELECT fork_id, round(trust, 6) AS trust, round(score, 6) AS score FROM trusted")
def h5(spark, sf):
    return trusted(spark, sf).select("fork_id", r6(F.col("trust")).alias("trust"), r6(F.col("score")).alias("score"))


@catalog.add("h7_tiny_set", f"WITH {T1_SQL} SELECT fork_id, n AS set_size, round(CASE WHEN n < 10 THEN t1 ELSE least(t1 * (0.7 + 0.3 * ({sql_percentile('stars', 'owner, segment')} * 0.7 + {sql_percentile('sub_forks', 'owner, segment')} * 0.3)), 100) END, 6) AS score FROM (SELECT *, count(*) OVER (PARTITION BY owner, segment) AS n FROM tier1)")
def h7(spark, sf):
    df = scoring.with_trust(tier1(spark, sf).withColumn("score", F.col("t1")), ["owner", "segment"])
    return df.select("fork_id", "set_size", r6(F.col("score")).alias("score"))


def penalised(spark: SparkSession, sf: str) -> DataFrame:
    """Scores after penalties; ahead, upstreamed and archived are bound to the fork's numbers."""
    df = trusted(spark, sf)
    ahead = F.when(F.col("fork_id") % 11 == 0, F.lit(None)).otherwise(F.col("releases") % 9)
    farmer = scoring.farmer_penalty(F.lit(True), F.col("stars"), F.col("releases") % 3, F.col("sub_forks") / F.col("stars"))
    topic = scoring.topic_penalty((F.col("fork_id") % 10) / 10.0, F.col("stars"), (F.col("fork_id") % 4).cast("double"))
    out = scoring.penalised(F.col("score"), ahead, F.col("fork_id") % 17 == 0, F.col("fork_id") % 5 == 0, F.col("recency_pct"), topic, farmer)
    return df.withColumn("out", out).withColumns({"score": F.col("out.score"), "penalties": F.col("out.penalties")}).drop("out")


PENALTY_SQL = f"""{TRUST_SQL}, pens AS (SELECT *, (CASE WHEN fork_id % 11 = 0 THEN NULL ELSE releases % 9 END) AS ahead, fork_id % 17 = 0 AS merged, fork_id % 5 = 0 AS archived,
  CASE WHEN set_size < 10 THEN 1.0 ELSE recency_pct END AS rp,
  greatest(-5.0 * least((fork_id % 10) / 10.0::DOUBLE, 0.5) / 0.5 + (CASE WHEN stars > 10 AND fork_id % 4 < 2 THEN -2 ELSE 0 END), -7) AS topic,
  CASE WHEN stars >= 5 AND releases % 3 < 2 AND sub_forks / stars < 0.4 THEN -10.0 * (1 - (sub_forks / stars) / 0.4) ELSE 0 END AS farmer FROM trusted),
pen2 AS (SELECT *, CASE WHEN archived THEN least(score, 30) ELSE score END * CASE WHEN rp < 0.2 THEN 0.7 ELSE 1 END AS s2 FROM pens),
pen3 AS (SELECT *, CASE WHEN topic < 0 THEN greatest(s2 + topic, 0) ELSE s2 END AS s3 FROM pen2),
penalised AS (SELECT * EXCLUDE (score), CASE WHEN ahead = 0 OR merged THEN 0 ELSE greatest(CASE WHEN farmer < 0 THEN greatest(s3 + farmer, 0) ELSE s3 END, 0) END AS score,
  CASE WHEN ahead = 0 THEN ['no_ahead'] WHEN merged THEN ['upstreamed'] ELSE list_filter([CASE WHEN archived THEN 'archived' END, CASE WHEN rp < 0.2 THEN 'low_recency' END, CASE WHEN topic < 0 THEN 'topic_tag' END, CASE WHEN farmer < 0 THEN 'fork_farmer' END], lambda x: x IS NOT NULL) END AS penalties FROM pen3)"""


@catalog.add("h6_penalties", f"WITH {PENALTY_SQL} SELECT fork_id, round(score, 6) AS score, array_to_string(penalties, ',') AS penalties FROM penalised")
def h6(spark, sf):
    return penalised(spark, sf).select("fork_id", r6(F.col("score")).alias("score"), F.array_join("penalties", ",").alias("penalties"))


@catalog.add("h10_topic_penalty", f"WITH {B.FORKS_SQL} SELECT fork_id, round(greatest(-5.0 * least((fork_id % 10) / 10.0::DOUBLE, 0.5) / 0.5 + (CASE WHEN stars > 10 AND fork_id % 4 < 2 THEN -2 ELSE 0 END), -7) * 1.5, 6) AS penalty FROM forks")
def h10(spark, sf):
    return B.forks(spark, sf).select("fork_id", r6(scoring.topic_penalty((F.col("fork_id") % 10) / 10.0, F.col("stars"), (F.col("fork_id") % 4).cast("double"), 1.5)).alias("penalty"))


@catalog.add("h11_fork_farmer", f"WITH {B.FORKS_SQL} SELECT fork_id, round(CASE WHEN fork_id % 3 > 0 AND stars >= 5 AND releases % 3 < 2 AND sub_forks / stars < 0.4 THEN -10.0 * (1 - (sub_forks / stars) / 0.4) ELSE 0 END, 6) AS penalty FROM forks")
def h11(spark, sf):
    return B.forks(spark, sf).select("fork_id", r6(scoring.farmer_penalty(F.col("fork_id") % 3 > 0, F.col("stars"), F.col("releases") % 3, F.col("sub_forks") / F.col("stars"))).alias("penalty"))


@catalog.add("h12_novelty_bonus", f"WITH {TRUST_SQL} SELECT fork_id, round(least(score + least(greatest((fork_id % 13) / 10.0::DOUBLE, 0), 1) * 5, 100), 6) AS score FROM trusted")
def h12(spark, sf):
    return trusted(spark, sf).select("fork_id", r6(scoring.with_bonus(F.col("score"), (F.col("fork_id") % 13) / 10.0, F.lit(0.0))).alias("score"))


@catalog.add("h13_sibling_bonus", f"WITH {TRUST_SQL} SELECT fork_id, round(least(least(score + n, 100) + least(least((fork_id % 7) / 6.0::DOUBLE, 1) * 5, greatest(7.5 - n, 0)), 100), 6) AS score FROM (SELECT *, least((fork_id % 13) / 10.0::DOUBLE, 1) * 5 AS n FROM trusted)")
def h13(spark, sf):
    return trusted(spark, sf).select("fork_id", r6(scoring.with_bonus(F.col("score"), (F.col("fork_id") % 13) / 10.0, (F.col("fork_id") % 7) / 6.0)).alias("score"))


@catalog.add("h20_topic_repo_score", f"WITH {T1_SQL} SELECT fork_id, round(({sql_log_norm('stars', 50000)} * 40 + {sql_log_norm('sub_forks', 5000)} * 40 + {sql_decay('days', '180')} * 20) * CASE WHEN fork_id % 5 = 0 THEN 0.5 ELSE 1 END, 6) AS score FROM tier1 WHERE sub_forks > 1")
def h20(spark, sf):
    df = tier1(spark, sf).filter("sub_forks > 1")
    return df.select("fork_id", r6(scoring.topic_repo_score(F.col("stars"), F.col("sub_forks"), F.col("days"), F.col("fork_id") % 5 == 0)).alias("score"))


@catalog.add("h18_coverage_gap", f"WITH {B.FORKS_SQL} SELECT segment, greatest(sum(stars) - sum(releases) * 3, 0)::BIGINT AS gap FROM forks GROUP BY segment")
def h18(spark, sf):
    return B.forks(spark, sf).groupBy("segment").agg(F.greatest(F.sum("stars") - F.sum("releases") * 3, F.lit(0)).alias("gap"))


def ranked(df: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """position, total and percentile in the network, best score first, then key."""
    df = positions(df.withColumn("low", -F.col(score)), by, ["low", key], "position", checkpointed).drop("low")
    return df.withColumn("percentile", (F.col("total") - F.col("position") + 1) / F.col("total"))


RANK_SQL = """ranked AS (SELECT *, (total - position + 1) / total AS percentile FROM (SELECT *, round(score, 6) AS heat, row_number() OVER (PARTITION BY segment ORDER BY round(score, 6) DESC, fork_id) AS position, count(*) OVER (PARTITION BY segment) AS total FROM {0}))"""
BAND_SQL = "CASE WHEN total < 10 THEN 'tiny_set' WHEN percentile >= 0.99 THEN 'top_1_pct' WHEN percentile >= 0.95 THEN 'top_5_pct' WHEN percentile >= 0.9 THEN 'top_10_pct' WHEN percentile >= 0.75 THEN 'top_25_pct' WHEN percentile >= 0.5 THEN 'top_50_pct' ELSE 'bottom_50_pct' END"


@catalog.add("w1_network_rank", f"WITH {TRUST_SQL}, {RANK_SQL.format('trusted')} SELECT fork_id, position, total, round(percentile, 6) AS percentile FROM ranked")
def w1(spark, sf):
    df = ranked(trusted(spark, sf).withColumn("heat", r6(F.col("score"))), NET, "heat", "fork_id")
    return df.select("fork_id", F.col("position").cast("long"), "total", r6(F.col("percentile")).alias("percentile"))


@catalog.add("w2_rank_band", f"WITH {TRUST_SQL}, {RANK_SQL.format('trusted')} SELECT fork_id, {BAND_SQL} AS band FROM ranked")
def w2(spark, sf):
    df = ranked(trusted(spark, sf).withColumn("heat", r6(F.col("score"))), NET, "heat", "fork_id")
    return df.select("fork_id", decisions.rank_band(F.col("total"), F.col("percentile")).alias("band"))


@catalog.add("flagship_fork_ranking", f"WITH {PENALTY_SQL}, {RANK_SQL.format('penalised')} SELECT fork_id, segment, heat, position, {BAND_SQL} AS band, array_to_string(penalties, ',') AS penalties FROM ranked WHERE position <= 20")
def flagship(spark, sf):
    """The twenty best forks of each network with their heat, band and penalties."""
    order = Window.partitionBy(*NET).orderBy(F.desc("heat"), "fork_id")  # limited in each partition before it moves
    df = penalised(spark, sf).withColumn("heat", r6(F.col("score"))).withColumn("position", F.row_number().over(order)).filter("position <= 20")
    percentile = (F.col("set_size") - F.col("position") + 1) / F.col("set_size")
    return df.select("fork_id", "segment", "heat", F.col("position").cast("long"), decisions.rank_band(F.col("set_size"), percentile).alias("band"), F.array_join("penalties", ",").alias("penalties"))


@catalog.add("f12_visibility", f"WITH {PENALTY_SQL} SELECT fork_id, CASE WHEN fork_id % 23 = 0 THEN 'pinned' WHEN len(penalties) = 0 THEN 'visible' WHEN list_has_any(penalties, ['no_ahead', 'upstreamed']) THEN 'hidden' ELSE 'demoted' END AS status, array_to_string(CASE WHEN fork_id % 23 = 0 THEN list_concat(['touching:src/**'], penalties) ELSE penalties END, ',') AS reasons FROM penalised")
def f12(spark, sf):
    marks = F.when(F.col("fork_id") % 23 == 0, F.array(F.lit("src/**"), F.lit("src/**"))).otherwise(F.array().cast("array<string>"))
    v = decisions.visibility(marks, F.col("penalties"))
    return penalised(spark, sf).select("fork_id", v["status"].alias("status"), F.array_join(v["reasons"], ",").alias("reasons"))


@catalog.add("f13_degraded_stages", f"WITH {B.FORKS_SQL} SELECT fork_id, concat_ws(',', CASE WHEN fork_id % 2 = 0 THEN 'cluster:too_few' END, CASE WHEN fork_id % 3 = 0 THEN 'compare:budget' END, CASE WHEN fork_id % 5 = 0 THEN 'owner_profile:cap' END) AS stages FROM forks")
def f13(spark, sf):
    when = lambda n, text: F.when(F.col("fork_id") % n == 0, F.lit(text))
    stages = decisions.degraded_stages({"cluster": when(2, "too_few"), "compare": when(3, "budget"), "contributors": F.lit(None).cast("string"), "owner_profile": when(5, "cap")})
    return B.forks(spark, sf).select("fork_id", F.array_join(stages, ",").alias("stages"))


@catalog.add("f14_profile_label", f"WITH {PENALTY_SQL} SELECT fork_id, CASE WHEN list_has_any(penalties, ['no_ahead', 'upstreamed']) THEN 'hidden' WHEN fork_id % 19 = 0 THEN 'focused_change' WHEN fork_id % 13 = 0 THEN 'emerging_active' WHEN list_has_any(penalties, ['archived', 'low_recency']) THEN 'stale' WHEN fork_id % 4 > 0 THEN 'matches_priors' ELSE 'standard' END AS profile FROM penalised")
def f14(spark, sf):
    df = penalised(spark, sf)
    status = decisions.visibility(F.array().cast("array<string>"), F.col("penalties"))["status"]
    arch = F.when(F.col("fork_id") % 19 == 0, "Sniper").otherwise("none")
    moving = F.when(F.col("fork_id") % 13 == 0, "rising").otherwise("flat")
    return df.select("fork_id", decisions.profile(status, arch, moving, F.col("penalties"), F.col("fork_id") % 4).alias("profile"))


@catalog.add("f1_ghost_forks", f"WITH {T1_SQL} SELECT fork_id FROM tier1 WHERE NOT (fork_id % 5 = 0 OR pushed_at = upstream_at)")
def f1(spark, sf):
    return tier1(spark, sf).filter((F.col("fork_id") % 5 != 0) & (F.col("pushed_at") != F.col("upstream_at"))).select("fork_id")


@catalog.add("f2_never_pushed", f"WITH {B.FORKS_SQL} SELECT fork_id FROM forks WHERE created_at IS NOT NULL AND pushed_at <= created_at")
def f2(spark, sf):
    return B.forks(spark, sf).filter("created_at is not null and pushed_at <= created_at").select("fork_id")


@catalog.add("f5_cluster_candidates", f"WITH {TRUST_SQL} SELECT fork_id, round(score, 6) AS heat FROM trusted WHERE fork_id % 5 <> 0 AND releases > 0 ORDER BY round(score, 6) DESC, fork_id LIMIT 100")
def f5(spark, sf):
    return trusted(spark, sf).filter("fork_id % 5 <> 0 and releases > 0").select("fork_id", r6(F.col("score")).alias("heat")).orderBy(F.desc("heat"), "fork_id").limit(100)


@catalog.add("o5_top_n_eligibility", f"WITH {T1_SQL} SELECT fork_id, row_number() OVER (PARTITION BY segment ORDER BY round(t1, 6) DESC, fork_id) <= 25 AS eligible FROM tier1")
def o5(spark, sf):
    order = Window.partitionBy("segment").orderBy(F.desc(r6(F.col("t1"))), "fork_id")
    return tier1(spark, sf).select("fork_id", (F.row_number().over(order) <= 25).alias("eligible"))


# changed files ------------------------------------------------------------------------------

KIND_SQL = f"{B.FILES_SQL}, kinds AS (SELECT *, {sql_class('path')} AS kind FROM files), weights AS (SELECT *, CASE kind WHEN 'source' THEN 1.0::DOUBLE WHEN 'docs' THEN 0.5 ELSE 0 END AS w FROM kinds)"
TYPE_SQL = "CASE WHEN regexp_matches(path, '[.](go|rs|ts|tsx|js|jsx|py|c|cpp|cc|h|hpp|java|swift|kt|rb|cs)$') THEN 1.0::DOUBLE WHEN regexp_matches(path, '[.](md|yaml|yml|json|toml|sql)$') THEN 0.3 WHEN kind IN ('junk', 'generated') THEN 0.05 ELSE 0.3 END"
FACTS_SQL = f"""{KIND_SQL}, facts AS (SELECT fork_id, count(*) AS n_files, CAST(floor(greatest(0, sum((additions - deletions) * w))) AS BIGINT) AS mna,
  CAST(sum(floor(greatest(additions - deletions, 0) * w)) AS BIGINT) AS mna_by_file, avg((kind <> 'source')::INT) AS junk_ratio,
  sum(additions * w) AS wa, CAST(sum(additions) AS BIGINT) AS a, sum(deletions * w) AS wd, CAST(sum(deletions) AS BIGINT) AS d, count(DISTINCT regexp_extract(path, '^(.*/)[^/]*$', 1)) AS dirs,
  avg({TYPE_SQL}) AS type_weight, list_extract(list_sort(list(additions + deletions)), CAST(floor(count(*) / 2) AS BIGINT) + 1) AS median_lines FROM weights GROUP BY fork_id)"""


@catalog.add("f7_file_class", f"WITH {KIND_SQL} SELECT kind, path, count(*) AS n FROM kinds GROUP BY ALL")
def f7(spark, sf):
    from arborlake.functions.paths import file_class

    return B.files(spark, sf).groupBy(file_class(F.col("path")).alias("kind"), "path").agg(F.count("*").alias("n"))


@catalog.add("a2_meaningful_net_additions", f"WITH {FACTS_SQL} SELECT fork_id, mna, round(junk_ratio, 6) AS junk_ratio FROM facts")
def a2(spark, sf):
    return behaviour.file_facts(B.files(spark, sf)).select("fork_id", "mna", r6(F.col("junk_ratio")).alias("junk_ratio"))


@catalog.add("a3_net_additions_by_file", f"WITH {FACTS_SQL} SELECT fork_id, mna_by_file FROM facts")
def a3(spark, sf):
    return behaviour.file_facts(B.files(spark, sf)).select("fork_id", "mna_by_file")


@catalog.add("a4_junk_heavy", f"WITH {FACTS_SQL} SELECT fork_id, junk_ratio > 0.5 AS half_junk, junk_ratio > 0.9 AS junk_heavy FROM facts")
def a4(spark, sf):
    return behaviour.file_facts(B.files(spark, sf)).select("fork_id", (F.col("junk_ratio") > 0.5).alias("half_junk"), (F.col("junk_ratio") > 0.9).alias("junk_heavy"))


@catalog.add("a5_weighted_lines", f"WITH {FACTS_SQL} SELECT fork_id, round(wa, 6) AS weighted_additions, a AS additions, round(wd, 6) AS weighted_deletions, d AS deletions FROM facts")
def a5(spark, sf):
    return behaviour.file_facts(B.files(spark, sf)).select("fork_id", r6(F.col("weighted_additions")).alias("weighted_additions"), "additions", r6(F.col("weighted_deletions")).alias("weighted_deletions"), "deletions")


@catalog.add("a11_upper_median", f"WITH {FACTS_SQL} SELECT fork_id, median_lines, median_lines < 3 AS formatter_only FROM facts")
def a11(spark, sf):
    return behaviour.file_facts(B.files(spark, sf)).select("fork_id", "median_lines", (F.col("median_lines") < 3).alias("formatter_only"))


@catalog.add("m9_file_type_weight", f"WITH {FACTS_SQL} SELECT fork_id, round(type_weight + 1e-9, 6) AS type_weight, dirs FROM facts")
def m9(spark, sf):
    return behaviour.file_facts(B.files(spark, sf)).select("fork_id", r6(F.col("type_weight") + 1e-9).alias("type_weight"), "dirs")


H2_SQL = f"""{FACTS_SQL}, side AS (SELECT fork_id, count(*) FILTER (flag = 'R') AS ahead, count(*) FILTER (flag = 'A') AS behind FROM files GROUP BY fork_id),
own AS (SELECT o_custkey AS fork_id, avg((o_orderpriority <> '3-MEDIUM')::INT) AS feature_ratio FROM orders GROUP BY o_custkey),
t2 AS (SELECT fork_id, mna, ahead, behind, {sql_log_norm("mna", 20000)} * 15 * h AS mna_pts, ahead / (ahead + sqrt(behind) + 1) * 15 * h AS sync_pts, coalesce(own.feature_ratio, 0) * 10 * h AS feature_pts
  FROM (SELECT *, CASE WHEN junk_ratio > 0.9 THEN 0.5 ELSE 1 END AS h FROM facts JOIN side USING (fork_id)) LEFT JOIN own USING (fork_id))"""


def tier2(spark: SparkSession, sf: str) -> DataFrame:
    files = B.files(spark, sf)
    side = files.groupBy("fork_id").agg(F.count_if(F.col("flag") == "R").alias("ahead"), F.count_if(F.col("flag") == "A").alias("behind"))
    own = behaviour.commit_facts(B.fork_commits(spark, sf)).select("fork_id", "feature_ratio")
    df = behaviour.file_facts(files).join(side, "fork_id").join(own, "fork_id", "left")
    points = scoring.tier2_points(F.col("mna"), F.col("ahead"), F.col("behind"), F.coalesce("feature_ratio", F.lit(0.0)), F.col("junk_ratio") > 0.9)
    return df.withColumns({f"p_{k}": v for k, v in points.items()} | {"t2": scoring.tier_score(points, 2)})


@catalog.add("h2_tier2_components", f"WITH {H2_SQL} SELECT fork_id, round(mna_pts, 6) AS mna, round(sync_pts, 6) AS sync_ratio, round(feature_pts, 6) AS feature_ratio, round(least(40, mna_pts + sync_pts + feature_pts), 6) AS t2 FROM t2")
def h2(spark, sf):
    return tier2(spark, sf).select("fork_id", *(r6(F.col(f"p_{k}")).alias(k) for k in ("mna", "sync_ratio", "feature_ratio")), r6(F.col("t2")).alias("t2"))


# commits ------------------------------------------------------------------------------------

MERGE_SQL = "regexp_matches(lower(line), '^(merge branch|merge pull request|merge remote-tracking|sync with upstream|sync upstream|revert \"merge)')"
FEATURE_SQL = "(NOT regexp_matches(line, '(?i)^(fix typo|update readme|bump version|initial commit|wip|todo|temp|test commit|merge (pull request|branch))') AND regexp_matches(line, '(?i)(^(add|implement|create|introduce|support|enable|new|build|design|integrate)\\b|^feat(\\(|:|\\s)|\\b(feature|enhancement|capability|module|integration)\\b)'))"
MESSAGES = "CASE doc_id % 9 WHEN 0 THEN 'Add ' || message WHEN 1 THEN 'Merge branch main' WHEN 2 THEN 'feat: ' || message WHEN 3 THEN 'Revert the change' WHEN 4 THEN 'wip' ELSE message END"
TOLD_SQL = f"""told AS (SELECT *, {MERGE_SQL} AS is_merge, {FEATURE_SQL} AS feature FROM lines),
cfacts AS (SELECT fork_id, count(*) AS n_commits, count(*) FILTER (NOT is_merge) AS meaningful, avg((NOT is_merge)::INT) AS feature_ratio, count(DISTINCT author) AS authors,
  CASE WHEN count(*) FILTER (NOT is_merge) < 2 THEN 0 ELSE (epoch_us(max("at") FILTER (NOT is_merge)) - epoch_us(min("at") FILTER (NOT is_merge))) / 86400000000.0::DOUBLE END AS span_days,
  least(1, sum(CASE WHEN strlen(line) < 10 OR is_merge THEN 0 WHEN feature THEN 2 WHEN strlen(line) >= 20 THEN 1 ELSE 0 END) / (2.0::DOUBLE * count(*))) AS quality,
  count(*) FILTER (starts_with(lower(line), 'revert ')) AS reverts, bool_or(regexp_matches(text, '(?im)^co-authored-by:')) AS co FROM told GROUP BY fork_id)"""
COMMIT_SQL = f"""{B.COMMITS_SQL}, lines AS (SELECT fork_id, doc_id, author, "at", text, trim({MESSAGES}) AS line FROM commits), {TOLD_SQL}"""
FORK_COMMIT_SQL = f"{B.FORK_COMMITS_SQL}, lines AS (SELECT * FROM fork_commits), {TOLD_SQL}"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Commits whose messages take all the forms that the rules know."""
    m = F.col("message")
    form = F.col("doc_id") % 9
    text = F.when(form == 0, F.concat(F.lit("Add "), m)).when(form == 1, "Merge branch main").when(form == 2, F.concat(F.lit("feat: "), m)).when(form == 3, "Revert the change").when(form == 4, "wip").otherwise(m)
    return B.commits(spark, sf).withColumn("message", text)


@catalog.add("a6_commit_facts", f"WITH {COMMIT_SQL} SELECT fork_id, n_commits, meaningful, round(feature_ratio, 6) AS feature_ratio, authors, round(span_days, 6) AS span_days, round(quality, 6) AS message_quality, reverts FROM cfacts")
def a6(spark, sf):
    df = behaviour.commit_facts(messages(spark, sf))
    return df.select("fork_id", "n_commits", "meaningful", r6(F.col("feature_ratio")).alias("feature_ratio"), "authors", r6(F.col("span_days")).alias("span_days"), r6(F.col("message_quality")).alias("message_quality"), "reverts")


@catalog.add("f19_merge_predicate", f"WITH {COMMIT_SQL} SELECT doc_id FROM told WHERE is_merge")
def f19(spark, sf):
    return messages(spark, sf).filter(behaviour.is_merge(F.col("message"))).select("doc_id")


@catalog.add("f20_feature_commit", f"WITH {COMMIT_SQL} SELECT doc_id FROM told WHERE feature")
def f20(spark, sf):
    return messages(spark, sf).filter(behaviour.is_feature(F.col("message"))).select("doc_id")


@catalog.add("m8_span_multiplier", f"WITH {COMMIT_SQL} SELECT fork_id, round(CASE WHEN span_days < 1 THEN 0.7 WHEN span_days > 14 THEN 1.2 ELSE 0.7 + 0.3 * (span_days - 1) / 13 END, 6) AS factor FROM cfacts")
def m8(spark, sf):
    return behaviour.commit_facts(messages(spark, sf)).select("fork_id", r6(N.span_multiplier(F.col("span_days"))).alias("factor"))


WOLF_SQL = f"""{T1_SQL}, {FACTS_SQL}, {FORK_COMMIT_SQL}, wolf AS (SELECT *, meaningful <= 2 AND mna >= 200 AND n_files >= 5 AS squash FROM (
  SELECT f.fork_id, n_files, mna, dirs, type_weight, median_lines, days AS dsp, authors AS humans, co, meaningful, reverts, span_days, quality
  FROM facts f JOIN tier1 t USING (fork_id) JOIN cfacts USING (fork_id))),
w2 AS (SELECT *, humans = 1 AND NOT co AND meaningful >= (CASE WHEN squash THEN 1 ELSE 3 END) AND mna >= 300 AS ok, least(dirs / 10.0::DOUBLE, 1) * CASE WHEN median_lines < 3 THEN 0.3 ELSE 1 END AS spread,
  {sql_log_norm("(mna / greatest(meaningful, 1))", 500)} AS density, least(ln(1.0::DOUBLE + meaningful) / ln(21.0::DOUBLE), 1) AS pers, coalesce(reverts / nullif(meaningful, 0)::DOUBLE, 0) AS rr FROM wolf),
w3 AS (SELECT *, least(spread * type_weight * (CASE WHEN squash THEN least(density * 1.5, 1) ELSE density END) * 0.5 + (CASE WHEN rr > 0.25 THEN pers * (1 - rr) ELSE pers END) * 0.3 + {sql_decay("dsp", "30")} * 0.2, 1) AS base FROM w2),
w4 AS (SELECT *, CASE WHEN ok THEN greatest(0, least(1, least(base + 0.15 * quality, 1) * CASE WHEN span_days < 1 THEN 0.7 WHEN span_days > 14 THEN 1.2 ELSE 0.7 + 0.3 * (span_days - 1) / 13 END)) ELSE 0 END AS strength FROM w3),
wolves AS (SELECT *, strength > 0 AS detected, CASE WHEN NOT ok THEN 'none' WHEN meaningful <= 2 AND mna < 1000 THEN 'Sniper' WHEN meaningful >= 20 AND mna >= 5000 AND n_files >= 20 THEN 'Drifter'
  WHEN meaningful BETWEEN 3 AND 15 AND span_days > 14 THEN 'Feature Builder' WHEN meaningful >= 3 AND mna BETWEEN 100 AND 5000 THEN 'Feature Builder' ELSE 'none' END AS archetype FROM w4)"""


def wolves(spark: SparkSession, sf: str) -> DataFrame:
    """The detector on the facts of each fork's files and commits."""
    facts = behaviour.file_facts(B.files(spark, sf)).select("fork_id", "n_files", "mna", "dirs", "type_weight", "median_lines")
    commits = behaviour.commit_facts(B.fork_commits(spark, sf)).withColumnRenamed("authors", "humans")
    pushed = tier1(spark, sf).select("fork_id", F.col("days").alias("days_since_push"))
    return behaviour.lone_wolf(facts.join(commits, "fork_id").join(pushed, "fork_id"))


@catalog.add("h8_lone_wolf", f"WITH {WOLF_SQL} SELECT fork_id, detected, squash, round(strength, 6) AS strength FROM wolves")
def h8(spark, sf):
    return wolves(spark, sf).select("fork_id", "detected", "squash", r6(F.col("strength")).alias("strength"))


@catalog.add("h9_archetype", f"WITH {WOLF_SQL} SELECT fork_id, archetype FROM wolves")
def h9(spark, sf):
    return wolves(spark, sf).select("fork_id", "archetype")


@catalog.add("h3_tier3_components", f"WITH {WOLF_SQL}, p AS (SELECT fork_id, least(CASE WHEN detected THEN strength * 7 * CASE WHEN archetype = 'Drifter' THEN 0.8 ELSE 1 END ELSE 0 END, 7) AS lone_wolf, {sql_log_norm('span_days', 180)} * 8 AS span, least((fork_id % 11) / 10.0::DOUBLE, 1) * 5 AS novelty FROM wolves) SELECT fork_id, round(lone_wolf, 6) AS lone_wolf, round(span, 6) AS span, round(novelty, 6) AS novelty, round(least(20, lone_wolf + span + novelty), 6) AS t3 FROM p")
def h3(spark, sf):
    points = scoring.tier3_points(F.col("detected"), F.col("strength"), F.col("archetype"), F.col("span_days"), (F.col("fork_id") % 11) / 10.0)
    return wolves(spark, sf).select("fork_id", *(r6(v).alias(k) for k, v in points.items()), r6(scoring.tier_score(points, 3)).alias("t3"))


H14_SQL = f"""{WOLF_SQL}, {H2_SQL.replace(FACTS_SQL + ",", "")}, t3 AS (SELECT fork_id, least(20, least(CASE WHEN detected THEN strength * 7 * CASE WHEN archetype = 'Drifter' THEN 0.8 ELSE 1 END ELSE 0 END, 7) + {sql_log_norm("floor(span_days)", 180)} * 8) AS t3 FROM wolves)"""


@catalog.add("h14_rescore", f"WITH {H14_SQL} SELECT fork_id, CASE WHEN t3 IS NOT NULL THEN 3 WHEN mna_pts IS NOT NULL THEN 2 ELSE 1 END AS tier, round(t1 + coalesce(least(40, mna_pts + sync_pts + feature_pts), 0) + coalesce(t3, 0), 6) AS score FROM tier1 LEFT JOIN t2 USING (fork_id) LEFT JOIN t3 USING (fork_id)")
def h14(spark, sf):
    """All tiers: changes with the share of feature commits, the detector and whole days of work where there are commits."""
    wolf = wolves(spark, sf)
    points = scoring.tier3_points(F.col("detected"), F.col("strength"), F.col("archetype"), F.floor("span_days").cast("double"), F.lit(0.0))
    third = wolf.select("fork_id", scoring.tier_score(points, 3).alias("t3"))
    df = tier1(spark, sf).join(tier2(spark, sf).select("fork_id", "t2"), "fork_id", "left").join(third, "fork_id", "left")
    tier = F.when(F.col("t3").isNotNull(), 3).when(F.col("t2").isNotNull(), 2).otherwise(1)
    return df.select("fork_id", tier.alias("tier"), r6(F.col("t1") + F.coalesce("t2", F.lit(0.0)) + F.coalesce("t3", F.lit(0.0))).alias("score"))


D9_SQL = f"""{WOLF_SQL}, r AS (SELECT fork_id, list_filter([
  CASE WHEN n_commits > 0 THEN '+' || n_commits || ' commits ahead of upstream' END, CASE WHEN f.n_files > 0 THEN f.n_files || ' files changed' END, CASE WHEN f.a > 100 THEN '+' || f.a || ' lines added' END,
  CASE WHEN authors = 1 THEN 'Single contributor' WHEN authors > 1 THEN authors || ' contributors' END, CASE WHEN detected THEN archetype || ': strength ' || printf('%.0f', strength * 100) || '%' END,
  CASE WHEN t.stars > 0 THEN t.stars || ' stars' END, 'Last pushed ' || strftime(t.pushed_at, '%Y-%m-%d')], lambda x: x IS NOT NULL)[1:5] AS reasons
  FROM tier1 t LEFT JOIN cfacts USING (fork_id) LEFT JOIN facts f USING (fork_id) LEFT JOIN (SELECT fork_id, detected, archetype, strength FROM wolves) USING (fork_id))"""


@catalog.add("d9_distinctness_reasons", f"WITH {D9_SQL} SELECT fork_id, array_to_string(reasons, '; ') AS reasons FROM r")
def d9(spark, sf):
    """Reasons from a fork's commits, files, detector and listing."""
    commits = behaviour.commit_facts(B.fork_commits(spark, sf)).select("fork_id", "n_commits", "authors")
    files = behaviour.file_facts(B.files(spark, sf)).select("fork_id", "n_files", "additions")
    wolf = wolves(spark, sf).select("fork_id", "detected", "archetype", "strength")
    df = tier1(spark, sf).join(commits, "fork_id", "left").join(files, "fork_id", "left").join(wolf, "fork_id", "left")
    columns = (F.col(c) for c in ("n_commits", "n_files", "additions", "authors", "detected", "archetype", "strength", "stars"))
    reasons = decisions.distinct_reasons(*columns, F.date_format("pushed_at", "yyyy-MM-dd"))
    return df.select("fork_id", F.array_join(reasons, "; ").alias("reasons"))


# momentum -----------------------------------------------------------------------------------

TODAY = "2024-01-30"
MOMENTUM_SQL = f"""{B.DAYS_SQL}, retained AS (SELECT * FROM fork_days WHERE day BETWEEN DATE '{TODAY}' - 30 AND DATE '{TODAY}'), today AS (SELECT fork_id, max_by(stars, day) AS stars, max_by(sub_forks, day) AS sub_forks FROM retained GROUP BY fork_id),
base AS (SELECT fork_id, stars AS b_stars, sub_forks AS b_forks, day FROM retained WHERE day = (SELECT min(day) FROM retained WHERE day < DATE '{TODAY}')),
moved AS (SELECT t.fork_id, b_stars IS NULL AS is_new, stars - coalesce(b_stars, 0) AS ds, sub_forks - coalesce(b_forks, 0) AS df, DATE '{TODAY}' - (SELECT min(day) FROM retained) AS observed FROM today t LEFT JOIN base USING (fork_id))"""


def momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Growth of each fork since the oldest retained day."""
    today = F.lit(TODAY).cast("date")
    days = B.fork_days(spark, sf).filter(F.col("day").between(F.date_sub(today, 30), today))
    now = days.groupBy("fork_id").agg(F.max_by("stars", "day").alias("stars"), F.max_by("sub_forks", "day").alias("sub_forks"))
    first = days.filter(F.col("day") < today).agg(F.min("day").alias("first"))
    base = days.join(F.broadcast(first), days["day"] == first["first"]).select("fork_id", F.col("stars").alias("b_stars"), F.col("sub_forks").alias("b_forks"))
    df = now.join(base, "fork_id", "left").crossJoin(F.broadcast(first))  # one row
    return df.select(
        "fork_id", "b_stars", (F.col("stars") - F.coalesce("b_stars", F.lit(0))).alias("ds"), (F.col("sub_forks") - F.coalesce("b_forks", F.lit(0))).alias("df"),
        F.datediff(today, "first").alias("observed"), F.col("first").isNotNull().alias("known"),
    )


@catalog.add("h15_momentum_status", f"WITH {MOMENTUM_SQL} SELECT fork_id, CASE WHEN is_new THEN 'new' WHEN ds > 0 OR df > 0 THEN 'rising' WHEN ds < 0 OR df < 0 THEN 'falling' ELSE 'flat' END AS status, CAST(ds AS BIGINT) AS stars_delta, CAST(df AS BIGINT) AS forks_delta, CAST(observed AS INTEGER) AS observed_days FROM moved")
def h15(spark, sf):
    status = decisions.momentum_status(F.col("known"), F.col("b_stars"), F.col("ds"), F.col("df"))
    return momentum(spark, sf).select("fork_id", status.alias("status"), F.col("ds").alias("stars_delta"), F.col("df").alias("forks_delta"), F.col("observed").alias("observed_days"))


@catalog.add("m10_momentum_signal", f"WITH {MOMENTUM_SQL} SELECT fork_id, round(least(1, ln(1 + greatest(ds, 0) + 2 * greatest(df, 0)) / ln(21)), 6) AS signal FROM moved")
def m10(spark, sf):
    return momentum(spark, sf).select("fork_id", r6(N.momentum_signal(F.col("ds"), F.col("df"), F.col("observed"))).alias("signal"))


@catalog.add("w5_retained_days", f"WITH {B.DAYS_SQL} SELECT fork_id, day, stars, sub_forks FROM (SELECT *, dense_rank() OVER (PARTITION BY fork_id ORDER BY day DESC) AS nth FROM fork_days WHERE day BETWEEN DATE '{TODAY}' - 30 AND DATE '{TODAY}') WHERE nth <= 31")
def w5(spark, sf):
    today = F.lit(TODAY).cast("date")
    newest = Window.partitionBy("fork_id").orderBy(F.desc("day"))
    return B.fork_days(spark, sf).filter(F.col("day").between(F.date_sub(today, 30), today)).withColumn("nth", F.dense_rank().over(newest)).filter("nth <= 31").drop("nth")


@catalog.add("j10_baseline_day", f"WITH {MOMENTUM_SQL} SELECT fork_id, b_stars AS stars, b_forks AS sub_forks, day FROM base")
def j10(spark, sf):
    today = F.lit(TODAY).cast("date")
    days = B.fork_days(spark, sf).filter(F.col("day").between(F.date_sub(today, 30), today))
    first = days.filter(F.col("day") < today).agg(F.min("day").alias("day"))
    return days.join(F.broadcast(first), "day").select("fork_id", "stars", "sub_forks", "day")
