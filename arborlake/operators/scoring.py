"""Heat of a fork: capped additive tiers, trust within the set, ordered penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.numeric import cap_sum, clamp, decay, lit, log_norm_range
from arborlake.operators.order import with_percentiles

NO_WEIGHTS: dict[str, float] = {}


def weighted(points: dict[str, Column], weights: dict[str, float]) -> dict[str, Column]:
    """Points times their weight; names without one keep theirs (H4)."""
    return {name: p * weights[name] if name in weights else p for name, p in points.items()}


def tier1_points(days_since_push: Column, upstream_days: Column, stars: Column, sub_forks: Column, releases: Column) -> dict[str, Column]:
    """Recency, stars, sub-forks and releases (H1)."""
    half = F.when(upstream_days > 365, F.greatest(lit(30), upstream_days * 0.25)).otherwise(lit(30))
    return {
        "recency": decay(days_since_push, half) * 12,
        "stars": log_norm_range(stars.cast("double"), 10000, 12),
        "sub_forks": F.least(sub_forks * 2.0, lit(8)),
        "releases": log_norm_range(releases.cast("double"), 20, 8),
    }


def tier2_points(mna: Column, ahead: Column, behind: Column, feature_ratio: Column, junk_heavy: Column) -> dict[str, Column]:
    """Net additions, ownership of the divergence, feature share; half of each for junk-heavy work (H2)."""
    share = ahead / (ahead + F.sqrt(behind.cast("double")) + 1)
    half = F.when(junk_heavy, lit(0.5)).otherwise(lit(1))
    return {"mna": log_norm_range(mna.cast("double"), 20000, 15) * half, "sync_ratio": share * 15 * half, "feature_ratio": feature_ratio * 10 * half}


def tier3_points(detected: Column, strength: Column, archetype: Column, span_days: Column, novelty: Column) -> dict[str, Column]:
    """Lone-wolf strength, commit span and novelty (H3)."""
    wolf = F.when(detected, strength * 7 * F.when(archetype == "Drifter", lit(0.8)).otherwise(lit(1))).otherwise(lit(0))
    return {"lone_wolf": F.least(wolf, lit(7)), "span": log_norm_range(span_days, 180, 8), "novelty": clamp(novelty) * 5}


TIER_CAPS = (40.0, 40.0, 20.0)


def tier_score(points: dict[str, Column], tier: int) -> Column:
    return cap_sum(list(points.values()), TIER_CAPS[tier - 1])


def with_trust(df: DataFrame, by: list[str], score: str = "score", stars: str = "stars", sub_forks: str = "sub_forks", days: str = "days", strength: str | None = None) -> DataFrame:
    """Scale the score by the fork's standing in its set (H5); sets under ten are left alone (H7).

    Adds set_size, trust and recency_pct, which is 1 less the percentile of the
    days since the last push, and 1 in sets under ten (W3).
    """
    df = with_percentiles(df, by, [stars, sub_forks, days])
    tiny = F.col("set_size") < 10
    factor = 0.7 + 0.3 * F.col("trust")
    if strength:
        factor = factor * F.when(F.col(strength) > 0.6, 1.1 + 0.2 * F.col(strength)).otherwise(lit(1))
    trust = F.col(f"{stars}_pct") * 0.7 + F.col(f"{sub_forks}_pct") * 0.3
    df = df.withColumns({"trust": F.when(~tiny, trust), "recency_pct": F.when(tiny, lit(1)).otherwise(1.0 - F.col(f"{days}_pct"))})
    return df.withColumn(score, F.when(tiny, F.col(score)).otherwise(F.least(F.col(score) * factor, lit(100))))


def penalised(score: Column, ahead: Column, upstreamed: Column, archived: Column, recency_pct: Column, topic: Column, farmer: Column) -> Column:
    """Struct (score, penalties) after the penalties in their order (H6).

    ``ahead`` null means unknown.  ``topic`` and ``farmer`` are points, 0 or less.
    """
    none, merged = ahead.isNotNull() & (ahead == 0), F.coalesce(upstreamed, F.lit(False))
    s = F.when(archived, F.least(score, lit(30))).otherwise(score)
    s = F.when(recency_pct < 0.2, s * 0.7).otherwise(s)
    s = F.when(topic < 0, F.greatest(s + topic, lit(0))).otherwise(s)
    s = F.when(farmer < 0, F.greatest(s + farmer, lit(0))).otherwise(s)
    named = [(archived, "archived"), (recency_pct < 0.2, "low_recency"), (topic < 0, "topic_tag"), (farmer < 0, "fork_farmer")]
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in named)))
    names = F.when(none, F.array(F.lit("no_ahead"))).when(merged, F.array(F.lit("upstreamed"))).otherwise(names)
    return F.struct(F.when(none | merged, lit(0)).otherwise(F.greatest(s, lit(0))).alias("score"), names.alias("penalties"))


def topic_penalty(deviation: Column, n_topics: Column, median_idf: Column, weight: float = 1.0) -> Column:
    """Points off for topics far from the parent's, and for many common topics."""
    far = -5.0 * F.least(deviation, lit(0.5)) / 0.5
    many = F.when((n_topics > 10) & (median_idf < 2), lit(-2)).otherwise(lit(0))
    return F.greatest(far + many, lit(-7)) * weight


def farmer_penalty(complete: Column, forks: Column, non_forks: Column, signal_share: Column) -> Column:
    """Points off for owners of many forks and few own repositories."""
    holds = complete & (forks >= 5) & (non_forks < 2) & (signal_share < 0.4)
    return F.when(holds, -10.0 * (1 - signal_share / 0.4)).otherwise(lit(0))


def with_bonus(score: Column, novelty: Column, sibling: Column, novelty_weight: float = 1.0, sibling_weight: float = 1.0) -> Column:
    """Novelty and sibling bonus, 7.5 points together at most; the score stays within 100."""
    first = clamp(novelty) * 5 * novelty_weight
    second = F.least(clamp(sibling) * 5 * sibling_weight, F.greatest(7.5 - first, lit(0)))
    return F.least(F.least(score + first, lit(100)) + second, lit(100))


def topic_repo_score(stars: Column, forks: Column, days: Column, archived: Column) -> Column:
    """Standing of a repository found by topic."""
    s = log_norm_range(stars.cast("double"), 50000, 40) + log_norm_range(forks.cast("double"), 5000, 40) + decay(days, lit(180)) * 20
    return F.when(archived, s * 0.5).otherwise(s)
