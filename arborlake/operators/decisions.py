"""Labels that follow from a fork's facts: bands, visibility, profile, momentum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Logins that are bots without the [bot] ending.
KNOWN_BOTS = (
    "dependabot", "renovate", "renovate-bot", "greenkeeper", "snyk-bot", "imgbot", "semantic-release-bot",
    "allcontributors", "mergify", "github-actions", "deepsource-autofix", "whitesource-bolt", "stale",
)


def rank_band(total: Column, percentile: Column) -> Column:
    """The band of a place in its network; small sets have none."""
    out = F.when(total < 10, "tiny_set")
    for bound, name in ((0.99, "top_1_pct"), (0.95, "top_5_pct"), (0.90, "top_10_pct"), (0.75, "top_25_pct"), (0.50, "top_50_pct")):
        out = out.when(percentile >= bound, name)
    return out.otherwise("bottom_50_pct")


def visibility(matched_patterns: Column, penalties: Column) -> Column:
    """Struct (status, reasons): pinned, hidden, demoted or visible."""
    pinned = F.size(matched_patterns) > 0
    hidden = F.arrays_overlap(penalties, F.array(F.lit("no_ahead"), F.lit("upstreamed")))
    status = F.when(pinned, "pinned").when(F.size(penalties) == 0, "visible").when(hidden, "hidden").otherwise("demoted")
    marks = F.transform(F.array_distinct(matched_patterns), lambda p: F.concat(F.lit("touching:"), p))
    return F.struct(status.alias("status"), F.when(pinned, F.concat(marks, penalties)).otherwise(penalties).alias("reasons"))


def degraded_stages(reasons: dict[str, Column]) -> Column:
    """The skipped stages in their order, each with its reason."""
    return F.array_compact(F.array(*(F.when(r.isNotNull(), F.concat(F.lit(f"{stage}:"), r)) for stage, r in reasons.items())))


def profile(status: Column, archetype: Column, momentum: Column, penalties: Column, prior: Column) -> Column:
    """One word for a fork; the first rule that holds."""
    stale = F.arrays_overlap(penalties, F.array(F.lit("archived"), F.lit("low_recency")))
    return (
        F.when(status == "pinned", "touches_target").when(status == "hidden", "hidden").when(archetype == "Sniper", "focused_change")
        .when(archetype == "Feature Builder", "focused_feature").when(archetype == "Drifter", "broad_maintenance")
        .when(momentum.isin("rising", "new"), "emerging_active").when(stale, "stale").when(prior > 0, "matches_priors").otherwise("standard")
    )


def momentum_status(known: Column, base: Column, stars: Column, forks: Column) -> Column:
    """new, rising, falling or flat against the baseline day; unknown without one."""
    return F.when(~known, "unknown").when(base.isNull(), "new").when((stars > 0) | (forks > 0), "rising").when((stars < 0) | (forks < 0), "falling").otherwise("flat")


def is_bot(login: Column, allowed: tuple[str, ...] = ()) -> Column:
    low = F.lower(login)
    return ~low.isin(*allowed, "") & (low.endswith("[bot]") | low.isin(*KNOWN_BOTS))


def humans(logins: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case logins that are no bots."""
    return F.filter(F.array_distinct(F.transform(logins, F.lower)), lambda x: ~is_bot(x, allowed))


THREAD_FILTERS = ("all", "unresolved", "resolved", "outdated", "unresolved_current")


def thread_filter(mode: str, resolved: Column, outdated: Column) -> Column:
    """Whether a thread belongs to a filter mode (F16)."""
    modes = {"all": F.lit(True), "unresolved": ~resolved, "resolved": resolved, "outdated": ~resolved & outdated, "unresolved_current": ~resolved & ~outdated}
    return modes[mode]


def linear_history(parents: Column, limit: int = 100) -> Column:
    """Struct (linear, truncated) of a vector of parent counts."""
    return F.struct((~F.exists(parents, lambda x: x > 1)).alias("linear"), (F.size(parents) >= limit).alias("truncated"))


#: Fixed value: the longest file list that one comparison returns.
COMPARE_FILES_CAP = 300


def files_truncated(marked: Column, listed: Column) -> Column:
    """Whether a list of changed files may lack some."""
    return marked | (listed >= COMPARE_FILES_CAP)


def distinct_reasons(ahead: Column, files: Column, added: Column, authors: Column, detected: Column, archetype: Column, strength: Column, stars: Column, pushed: Column, most: int = 5) -> Column:
    """Why a fork stands out, the first ``most`` that hold, in a fixed order.

    Null counts are those of a fork that was not compared; ``pushed`` is a text.
    """
    said = [
        F.when(ahead > 0, F.format_string("+%d commits ahead of upstream", ahead)),
        F.when(files > 0, F.format_string("%d files changed", files)),
        F.when(added > 100, F.format_string("+%d lines added", added)),
        F.when(authors == 1, "Single contributor").when(authors > 1, F.format_string("%d contributors", authors)),
        F.when(detected, F.format_string("%s: strength %.0f%%", archetype, strength * 100)),
        F.when(stars > 0, F.format_string("%d stars", stars)),
        F.concat(F.lit("Last pushed "), pushed),
    ]
    return F.slice(F.array_compact(F.array(*said)), 1, most)
