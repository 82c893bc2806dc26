"""Commit messages, authorship and the lone-wolf detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.numeric import clamp, decay, lit, log_norm, ratio, span_multiplier
from arborlake.functions.paths import class_weight, file_class, parent_dir, type_weight

# Message forms.
MERGE_FORMS = r"(?i)^(merge branch|merge pull request|merge remote-tracking|sync with upstream|sync upstream|revert \"merge)"
TRIVIAL_FORMS = r"(?i)^(fix typo|update readme|bump version|initial commit|wip|todo|temp|test commit|merge (pull request|branch))"
FEATURE_FORMS = r"(?i)(^(add|implement|create|introduce|support|enable|new|build|design|integrate)\b|^feat(\(|:|\s)|\b(feature|enhancement|capability|module|integration)\b)"
CO_AUTHOR = r"(?im)^co-authored-by:"


def first_line(message: Column) -> Column:
    return F.trim(F.substring_index(F.ltrim(message), "\n", 1))


def is_merge(message: Column) -> Column:
    return first_line(message).rlike(MERGE_FORMS)


def is_feature(message: Column) -> Column:
    line = first_line(message)
    return ~line.rlike(TRIVIAL_FORMS) & line.rlike(FEATURE_FORMS)


def has_co_author(message: Column) -> Column:
    return message.rlike(CO_AUTHOR)


def is_revert(message: Column) -> Column:
    return F.lower(first_line(message)).startswith("revert ")


def message_points(message: Column) -> Column:
    """2 for a feature, 1 for a long line, 0 for the short and for merges."""
    line = first_line(message)
    size = F.octet_length(line)
    return F.when((size < 10) | is_merge(message), 0).when(is_feature(message), 2).when(size >= 20, 1).otherwise(0)


def commit_facts(commits: DataFrame, by: str = "fork_id") -> DataFrame:
    """Counts of a fork's commits (A6-A10): fork, n, meaningful, features, authors, span, quality, reverts."""
    own = ~is_merge(F.col("message"))
    days = (F.unix_micros(F.max(F.when(own, F.col("at")))) - F.unix_micros(F.min(F.when(own, F.col("at"))))) / 86_400_000_000.0
    return commits.groupBy(by).agg(
        F.count("*").alias("n_commits"), F.count_if(own).alias("meaningful"), F.avg(own.cast("double")).alias("feature_ratio"),
        F.count_distinct("author").alias("authors"), F.when(F.count_if(own) < 2, lit(0)).otherwise(days).alias("span_days"),
        F.least(lit(1), F.sum(message_points(F.col("message"))) / (2.0 * F.count("*"))).alias("message_quality"),
        F.count_if(is_revert(F.col("message"))).alias("reverts"), F.bool_or(has_co_author(F.col("text"))).alias("co_authored"),
    )


def file_facts(files: DataFrame, by: str = "fork_id") -> DataFrame:
    """Sums over a fork's changed files."""
    kind = file_class(F.col("path"))
    df = files.withColumn("kind", kind).withColumn("w", class_weight(kind))
    df = df.withColumn("changed", F.col("additions") + F.col("deletions"))
    a, d, w = F.col("additions"), F.col("deletions"), F.col("w")
    return df.groupBy(by).agg(
        F.count("*").alias("n_files"), F.floor(F.greatest(lit(0), F.sum((a - d) * w))).cast("long").alias("mna"),
        F.sum(F.floor(F.greatest(a - d, F.lit(0)) * w)).cast("long").alias("mna_by_file"), F.avg((F.col("kind") != "source").cast("double")).alias("junk_ratio"),
        F.sum(a * w).alias("weighted_additions"), F.sum(a).alias("additions"), F.sum(d * w).alias("weighted_deletions"), F.sum(d).alias("deletions"),
        F.count_distinct(parent_dir(F.col("path"))).alias("dirs"), F.avg(type_weight(F.col("path"), F.col("kind"))).alias("type_weight"),
        F.expr("percentile_disc(0.5) within group (order by changed desc)").cast("long").alias("median_lines"),  # the upper one, from counts by value
    )


def archetype(meaningful: Column, mna: Column, n_files: Column, span_days: Column) -> Column:
    """The pattern of a fork's work; the first rule that holds (H9)."""
    return (
        F.when((meaningful <= 2) & (mna < 1000), "Sniper")
        .when((meaningful >= 20) & (mna >= 5000) & (n_files >= 20), "Drifter")
        .when(meaningful.between(3, 15) & (span_days > 14), "Feature Builder")
        .when((meaningful >= 3) & mna.between(100, 5000), "Feature Builder")
        .otherwise("none")
    )


def lone_wolf(df: DataFrame) -> DataFrame:
    """detected, strength and archetype from commit and file facts (H8).

    ``df`` has humans, days_since_push and the columns of both fact tables.
    """
    m, mna = F.col("meaningful"), F.col("mna")
    squash = (m <= 2) & (mna >= 200) & (F.col("n_files") >= 5)
    gates = (F.col("humans") == 1) & ~F.col("co_authored") & (m >= F.when(squash, 1).otherwise(3)) & (mna >= 300)
    spread = F.least(F.col("dirs") / 10.0, lit(1)) * F.when(F.col("median_lines") < 3, lit(0.3)).otherwise(lit(1))
    density = log_norm(mna / F.greatest(m, F.lit(1)), 500)
    density = F.when(squash, F.least(density * 1.5, lit(1))).otherwise(density)
    persistence = F.least(F.log(1.0 + m) / F.log(lit(21)), lit(1))
    reverts = ratio(F.col("reverts").cast("double"), m.cast("double"))
    persistence = F.when(reverts > 0.25, persistence * (1 - reverts)).otherwise(persistence)
    base = F.least(spread * F.col("type_weight") * density * 0.5 + persistence * 0.3 + decay(F.col("days_since_push"), lit(30)) * 0.2, lit(1))
    strength = clamp(F.least(base + 0.15 * F.col("message_quality"), lit(1)) * span_multiplier(F.col("span_days")))
    return df.withColumns({"squash": squash, "strength": F.when(gates, strength).otherwise(lit(0))}).withColumns(
        {"detected": F.col("strength") > 0, "archetype": F.when(gates, archetype(m, mna, F.col("n_files"), F.col("span_days"))).otherwise("none")}
    )
