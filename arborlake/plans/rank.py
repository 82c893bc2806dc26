"""Queries of the rank model, shrinkage and the metrics of an ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.functions import numeric as N
from arborlake.operators import evaluation as E
from arborlake.operators import ranking as R
from arborlake.plans.core import Catalog, r6, sql_cdf
from arborlake.plans.heat import NET, TRUST_SQL, trusted
from arborlake.session import checkpointed
from arborlake.sources import bindings as B

catalog = Catalog()
CAP = R.POOL_CAP


def pool(spark: SparkSession, sf: str, cap: int = CAP) -> DataFrame:
    """The best forks of each network with mu and sd; the tier is bound to the id.

    A pool is small and its scores are dear, so it is made once.
    """
    df = trusted(spark, sf).withColumn("heat", r6(F.col("score")))
    df = R.pool(df, NET, cap=cap)
    return checkpointed(df.select("segment", "fork_id", "idx", F.col("heat").alias("mu"), N.sigma(N.tier_confidence(F.col("fork_id") % 3 + 1)).alias("sd")))


POOL_SQL = f"""{TRUST_SQL}, pool AS (SELECT segment, fork_id, idx, heat AS mu, greatest(10 * (1 - CASE fork_id % 3 + 1 WHEN 2 THEN 0.7 WHEN 3 THEN 0.9 ELSE 0.3 END), 1e-6)::DOUBLE AS sd FROM (
  SELECT *, round(score, 6) AS heat, row_number() OVER (PARTITION BY segment ORDER BY round(score, 6) DESC, fork_id) AS idx FROM trusted) WHERE idx <= {CAP}),
gaps AS (SELECT a.segment, a.idx AS i, b.idx AS j, (a.mu - b.mu) / sqrt(a.sd * a.sd + b.sd * b.sd) AS z FROM pool a JOIN pool b ON a.segment = b.segment AND a.idx <> b.idx),
wins AS (SELECT segment, i, j, {sql_cdf('z')} AS p FROM gaps)"""
ER_SQL = f"{POOL_SQL}, er AS (SELECT segment, i, 1 + sum(1 - p) AS erank, count(*) + 1 AS n, sum(p) AS won FROM wins GROUP BY ALL)"


def wins(spark, sf):
    return R.win_matrix(pool(spark, sf), NET)


@catalog.add("n1_win_probability", f"WITH {POOL_SQL} SELECT segment, i::INT AS i, j::INT AS j, round(p, 6) AS p FROM wins")
def n1(spark, sf):
    return wins(spark, sf).select("segment", "i", "j", r6(F.col("p")).alias("p"))


@catalog.add("n2_expected_rank", f"WITH {ER_SQL} SELECT segment, i::INT AS idx, round(erank, 6) AS expected_rank, round(least(greatest((n - erank) / (n - 1), 0), 1), 6) AS p_score FROM er")
def n2(spark, sf):
    return R.expected_ranks(wins(spark, sf), NET).select("segment", "idx", r6(F.col("expected_rank")).alias("expected_rank"), r6(F.col("p_score")).alias("p_score"))


@catalog.add("n6_poth", f"WITH {POOL_SQL}, m AS (SELECT segment, i, avg(p) AS m FROM wins GROUP BY ALL) SELECT segment, count(*) AS n, round(12.0 * (count(*) - 1) / (count(*) + 1) * avg((m - 0.5) * (m - 0.5)), 6) AS poth FROM m GROUP BY segment")
def n6(spark, sf):
    return R.poth(wins(spark, sf), NET).select("segment", "n", r6(F.col("poth")).alias("poth"))


@catalog.add("n6_poth_residuals", f"WITH {POOL_SQL}, m AS (SELECT segment, i, avg(p) AS m, sum(p) AS s FROM wins GROUP BY ALL), whole AS (SELECT segment, count(*) AS n, 12.0 * (count(*) - 1) / (count(*) + 1) * avg((m - 0.5) * (m - 0.5)) AS poth FROM m GROUP BY segment), rest AS (SELECT w.segment, w.j, n, poth, avg(pow((s - p) / (n - 2) - 0.5, 2)) AS q FROM wins w JOIN m USING (segment, i) JOIN whole USING (segment) GROUP BY ALL) SELECT segment, j::INT AS idx, round(poth - 12.0 * (n - 2) / n * q, 6) AS residual FROM rest")
def n6r(spark, sf):
    return R.poth_residuals(wins(spark, sf), NET).select("segment", "idx", r6(F.col("residual")).alias("residual"))


@catalog.add("n4_rank_distribution")
def n4(spark, sf):
    return R.rank_report(pool(spark, sf, R.POOL_CAP).select("segment", "idx", "mu", "sd"), NET)


@catalog.add("w4_tie_bands", f"WITH {POOL_SQL} SELECT segment, idx::INT AS idx, coalesce(abs(mu - lag(mu) OVER w) < 0.4 * sqrt(sd * sd + pow(lag(sd) OVER w, 2)), false) OR coalesce(abs(mu - lead(mu) OVER w) < 0.4 * sqrt(sd * sd + pow(lead(sd) OVER w, 2)), false) AS tied FROM pool WINDOW w AS (PARTITION BY segment ORDER BY idx)")
def w4(spark, sf):
    return R.tie_bands(pool(spark, sf), NET, order="idx").select("segment", "idx", "tied")


@catalog.add("o6_shortlist", f"WITH {ER_SQL} SELECT segment, i::INT AS idx, row_number() OVER (PARTITION BY segment ORDER BY round(erank, 6), i)::INT AS place FROM er QUALIFY place <= 10")
def o6(spark, sf):
    order = Window.partitionBy("segment").orderBy(r6(F.col("expected_rank")), "idx")
    return R.expected_ranks(wins(spark, sf), NET).withColumn("place", F.row_number().over(order)).filter("place <= 10").select("segment", "idx", "place")


@catalog.add("o7_keep_all_order", f"WITH {ER_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(erank, 6), i) AS place FROM er) SELECT segment, i::INT AS idx, row_number() OVER (PARTITION BY segment ORDER BY (place <= 10) DESC, round(erank, 6), i)::INT AS out_place FROM p")
def o7(spark, sf):
    by = Window.partitionBy("segment")
    df = R.expected_ranks(wins(spark, sf), NET).withColumn("erank", r6(F.col("expected_rank")))
    df = df.withColumn("picked", F.row_number().over(by.orderBy("erank", "idx")) <= 10)
    return df.select("segment", "idx", F.row_number().over(by.orderBy(F.desc("picked"), "erank", "idx")).alias("out_place"))


EB_SQL = f"""{POOL_SQL}, s AS (SELECT segment, fork_id, mu AS y, sd FROM pool WHERE mu > 0), med AS (SELECT segment, median(y) AS med FROM s GROUP BY segment),
mad AS (SELECT segment, 1.4826 * median(abs(y - med)) AS mad FROM s JOIN med USING (segment) GROUP BY segment),
o AS (SELECT segment, count(*) AS k, sum(1 / (sd * sd)) AS sw, sum(pow(1 / (sd * sd), 2)) AS sw2, sum(y / (sd * sd)) / sum(1 / (sd * sd)) AS yw FROM s GROUP BY segment),
f AS (SELECT segment, k, yw, mad, CASE WHEN sw - sw2 / sw > 1e-9 THEN (q - (k - 1)) / (sw - sw2 / sw) ELSE 0 END AS raw, CASE WHEN mad > 0 AND 2 * mad < 25 THEN 2 * mad ELSE 25 END AS cap
  FROM o JOIN mad USING (segment) JOIN (SELECT segment, sum(pow(y - yw, 2) / (sd * sd)) AS q FROM s JOIN o USING (segment) GROUP BY segment) USING (segment)),
g AS (SELECT *, CASE WHEN k < 3 THEN 'insufficient' WHEN raw <= 0 THEN 'pooled' WHEN sqrt(greatest(raw, 0)) > cap THEN 'clamped' ELSE 'heterogeneous' END AS regime FROM f),
h AS (SELECT *, CASE regime WHEN 'clamped' THEN cap * cap WHEN 'heterogeneous' THEN raw END AS tau2 FROM g),
e AS (SELECT s.*, regime, tau2, tau2 / (tau2 + sd * sd) AS b, coalesce(m, yw) AS m FROM s JOIN h USING (segment) JOIN (SELECT segment, sum(y / (sd * sd + tau2)) / sum(1 / (sd * sd + tau2)) AS m FROM s JOIN h USING (segment) GROUP BY segment) USING (segment)),
eb AS (SELECT *, m + b * (y - m) AS theta, sqrt(1 / (1 / (sd * sd) + 1 / tau2)) AS post_sd FROM e)"""


def shrunk(spark, sf):
    return R.shrink(pool(spark, sf).filter("mu > 0").withColumn("y", F.col("mu")), NET)


@catalog.add("n8_empirical_bayes", f"WITH {EB_SQL} SELECT fork_id, regime, round(tau2, 6) AS tau2, round(m, 6) AS m, round(theta, 6) AS theta, round(post_sd, 6) AS post_sd, round(b, 6) AS b FROM eb")
def n8(spark, sf):
    return shrunk(spark, sf).select("fork_id", "regime", *(r6(F.col(c)).alias(c) for c in ("tau2", "m", "theta", "post_sd", "b")))


@catalog.add("n9_influence", f"WITH {EB_SQL} SELECT fork_id, pow((y - theta) / sd, 2) + b > 3 AS influential FROM eb")
def n9(spark, sf):
    return shrunk(spark, sf).select("fork_id", "influential")


@catalog.add("a21_pool_totals", f"WITH {POOL_SQL} SELECT segment, round(sum(1 / (sd * sd)), 6) AS sw, round(sum(pow(1 / (sd * sd), 2)), 6) AS sw2, round(sum(mu / (sd * sd)), 6) AS swy FROM pool GROUP BY segment")
def a21(spark, sf):
    w = 1 / (F.col("sd") * F.col("sd"))
    return pool(spark, sf).groupBy("segment").agg(r6(F.sum(w)).alias("sw"), r6(F.sum(w * w)).alias("sw2"), r6(F.sum(w * F.col("mu"))).alias("swy"))


@catalog.add("a12_median_mad", f"WITH {B.FORKS_SQL}, m AS (SELECT segment, median(c_acctbal) AS med FROM forks GROUP BY segment) SELECT segment, round(any_value(med), 6) AS med, round(1.4826 * median(abs(c_acctbal - med)), 4) AS mad FROM forks JOIN m USING (segment) GROUP BY segment")
def a12(spark, sf):
    df = B.forks(spark, sf)
    med = df.groupBy("segment").agg(F.median("c_acctbal").alias("med"))
    return df.join(med, "segment").groupBy("segment").agg(r6(F.first("med")).alias("med"), F.round(1.4826 * F.median(F.abs(F.col("c_acctbal") - F.col("med"))), 4).alias("mad"))


# metrics ------------------------------------------------------------------------------------

J = B.JUDGED_SQL


@catalog.add("a15_novelty_histogram", f"WITH {J}, b AS (SELECT least(floor(novelty * 10), 9)::INT AS tenth FROM judged) SELECT CASE WHEN tenth = 9 THEN '[0.9, 1.0]' ELSE '[0.' || tenth || ', 0.' || (tenth + 1) || ')' END AS bucket, count(*) AS n FROM b GROUP BY ALL")
def a15(spark, sf):
    return B.judged(spark, sf).groupBy(E.novelty_bucket(F.col("novelty")).alias("bucket")).agg(F.count("*").alias("n"))


@catalog.add("a16_confusion", f"WITH {J}, c AS (SELECT cluster, count(*) FILTER (positive AND p) AS tp, count(*) FILTER (NOT positive AND p) AS fp, count(*) FILTER (positive AND NOT p) AS fn, count(*) FILTER (NOT positive AND NOT p) AS tn FROM (SELECT *, score > 1500 AS p FROM judged) GROUP BY cluster), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce(tn / nullif(tn + fp, 0), 0) AS sp FROM c) SELECT cluster, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round((re + sp) / 2, 6) AS balanced_accuracy FROM r")
def a16(spark, sf):
    out = E.confusion(B.judged(spark, sf), ["cluster"], F.col("positive"), F.col("score") > 1500)
    return out.select("cluster", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "balanced_accuracy")))


@catalog.add("a17_adjusted_rand", f"WITH {J}, c AS (SELECT cluster, positive, count(*) AS c FROM judged GROUP BY ALL), s AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM c) AS s, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(c) AS x FROM c GROUP BY cluster)) AS r, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(c) AS x FROM c GROUP BY positive)) AS k, (SELECT sum(c) FROM c) AS n), e AS (SELECT *, r * k / (n * (n - 1) / 2) AS e FROM s) SELECT round(coalesce((s - e) / nullif(0.5 * (r + k) - e, 0), 0), 6) AS ari FROM e")
def a17(spark, sf):
    return E.adjusted_rand(B.judged(spark, sf), "cluster", "positive").select(r6(F.col("ari")).alias("ari"))


@catalog.add("a18_ndcg", f"WITH {J}, g AS (SELECT cluster, positive, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, id) AS a, row_number() OVER (PARTITION BY cluster ORDER BY positive DESC, id) AS b FROM judged) SELECT cluster, round(CASE WHEN bool_and(positive) THEN 0 ELSE coalesce(sum(CASE WHEN positive THEN 1 / log2(a + 1) END) / sum(CASE WHEN positive THEN 1 / log2(b + 1) END), 0) END, 6) AS ndcg FROM g GROUP BY cluster")
def a18(spark, sf):
    return E.ndcg(B.judged(spark, sf), ["cluster"], "score", "positive", "id").select("cluster", r6(F.col("ndcg")).alias("ndcg"))


@catalog.add("a19_roc_auc", f"WITH {J} SELECT c.cluster, round(coalesce(avg(CASE WHEN p.id IS NULL OR n.id IS NULL THEN NULL WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 0), 6) AS auc FROM (SELECT DISTINCT cluster FROM judged) c LEFT JOIN judged p ON p.cluster = c.cluster AND p.positive LEFT JOIN judged n ON n.cluster = c.cluster AND NOT n.positive GROUP BY c.cluster")
def a19(spark, sf):
    return E.roc_auc(B.judged(spark, sf), ["cluster"], "score", "positive").select("cluster", r6(F.col("auc")).alias("auc"))


@catalog.add("j14_pair_auc", f"WITH {J} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auc FROM judged p JOIN judged n ON p.positive AND NOT n.positive")
def j14(spark, sf):
    by_value = B.judged(spark, sf).groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    return E.pair_auc(by_value, "score", checkpointed).select(r6(F.col("auc")).alias("auc"))


@catalog.add("a20_precision_at_k", f"WITH {J}, p AS (SELECT 'score' AS policy, id, score, positive FROM judged UNION ALL SELECT 'novelty', id, novelty, positive FROM judged UNION ALL SELECT 'mixed', id, score * novelty, positive FROM judged), t AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY round(score, 6) DESC, id) AS nth FROM p) SELECT policy, round(count(*) FILTER (positive) / 10.0, 6)::DOUBLE AS precision, string_agg(id::VARCHAR, ',' ORDER BY nth) AS top_ids FROM t WHERE nth <= 10 GROUP BY policy")
def a20(spark, sf):
    rows = B.judged(spark, sf)
    each = rows.select("id", "positive", F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), r6(c).alias("s")) for n, c in (("score", F.col("score")), ("novelty", F.col("novelty")), ("mixed", F.col("score") * F.col("novelty")))))).alias("x"))
    return E.precision_at(each.select("id", "positive", "x.policy", "x.s"), ["policy"], "s", "positive", "id", 10)


@catalog.add("n10_variant_evaluation", f"WITH {EB_SQL}, v AS (SELECT 'heat' AS variant, fork_id, y AS s FROM eb UNION ALL SELECT 'shrunk', fork_id, coalesce(theta, y) FROM eb UNION ALL SELECT 'expected_rank', fork_id, -erank FROM (SELECT p.fork_id, 1 + sum(1 - w.p) AS erank FROM pool p JOIN wins w ON w.segment = p.segment AND w.i = p.idx GROUP BY ALL) WHERE fork_id IN (SELECT fork_id FROM eb)), l AS (SELECT *, fork_id % 3 = 0 AS pos FROM v), gg AS (SELECT variant, pos, row_number() OVER (PARTITION BY variant ORDER BY round(s, 6) DESC, fork_id) AS a, row_number() OVER (PARTITION BY variant ORDER BY pos DESC, fork_id) AS b FROM l) SELECT variant, round(sum(CASE WHEN pos THEN 1 / log2(a + 1) END) / sum(CASE WHEN pos THEN 1 / log2(b + 1) END), 6) AS ndcg FROM gg GROUP BY variant")
def n10(spark, sf):
    eb = shrunk(spark, sf)
    ranks = R.expected_ranks(wins(spark, sf), NET).join(pool(spark, sf).select("segment", "idx", "fork_id"), ["segment", "idx"]).join(eb.select("fork_id"), "fork_id", "left_semi")
    parts = [eb.select(F.lit("heat").alias("variant"), "fork_id", F.col("y").alias("s")), eb.select(F.lit("shrunk"), "fork_id", F.coalesce("theta", "y")), ranks.select(F.lit("expected_rank"), "fork_id", -F.col("expected_rank"))]
    df = parts[0].union(parts[1]).union(parts[2]).select("variant", "fork_id", r6(F.col("s")).alias("s"), (F.col("fork_id") % 3 == 0).alias("pos"))
    return E.ndcg(df, ["variant"], "s", "pos", "fork_id").select("variant", r6(F.col("ndcg")).alias("ndcg"))
