"""Comparisons of a fork with its upstream: totals, file lists, patches, cached results, search indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the layout of cached clusters.
CACHE_SCHEMA = 4


def head_and_base(commits: Column, total: Column, merge_base: Column, base: Column) -> Column:
    """Struct (head, base): the last of ``commits`` if all are listed, the merge base or else the base."""
    n = F.size(commits)
    head = F.when((n > 0) & (n == total), F.try_element_at(commits, F.lit(-1)))
    return F.struct(head.alias("head"), F.coalesce(F.nullif(merge_base, F.lit("")), base).alias("base"))


def backfill_files(listed: DataFrame, full: DataFrame, complete: DataFrame, key: str) -> DataFrame:
    """A capped list of files replaced by the whole one where that can be trusted.

    ``listed`` and ``full`` have key, path, additions, deletions and patch, a path
    once for each key; ``complete`` has key and complete.  The whole list counts
    if it is complete and not shorter; patches that were listed stay.  A key
    with no row in ``full`` keeps its list.
    """
    sizes = listed.groupBy(key).agg(F.count("*").alias("had")).join(full.groupBy(key).agg(F.count("*").alias("found")), key, "left")
    sizes = sizes.join(complete.select(key, "complete"), key, "left")
    judged = sizes.select(key, F.coalesce(F.col("complete") & (F.col("found") >= F.col("had")), F.lit(False)).alias("replaced"))
    known = listed.select(key, "path", F.nullif("patch", F.lit("")).alias("known"))
    new = full.join(judged.filter("replaced"), key).join(known, [key, "path"], "left").withColumn("patch", F.coalesce("known", "patch"))
    columns = [key, "path", "additions", "deletions", "patch", "replaced"]
    return new.select(columns).union(listed.join(judged.filter("not replaced"), key).select(columns))


def patch_outcome(patch: Column, additions: Column, deletions: Column, valid: Column) -> Column:
    """accepted, empty, or why a patch that was found elsewhere is left out (D3)."""
    lines = F.split(patch, "\n")
    plus, minus = (F.size(F.filter(lines, lambda x: x.startswith(sign))) for sign in ("+", "-"))
    miscounted = (plus != additions) | (minus != deletions)
    said = F.format_string("got +%d/-%d lines, want +%d/-%d", plus, minus, additions, deletions)
    return F.when(miscounted, said).when(patch == "", "empty").when(valid, "accepted").otherwise("bad hunks")


def two_sided(commits: DataFrame, key: str, sha: str = "sha") -> DataFrame:
    """(key, ahead, behind): commits that only the fork has, and that only the upstream has.

    ``commits`` has key, sha and side, which is fork or upstream.
    """
    on = lambda side: F.max((F.col("side") == side).cast("int")) == 1
    sides = commits.groupBy(key, sha).agg(on("fork").alias("mine"), on("upstream").alias("theirs"))
    return sides.groupBy(key).agg(F.count_if(F.col("mine") & ~F.col("theirs")).alias("ahead"), F.count_if(F.col("theirs") & ~F.col("mine")).alias("behind"))


def change_status(old_path: Column, new_path: Column) -> Column:
    return F.when(old_path != new_path, "renamed").otherwise("modified")


def linearity(total: Column, status: Column, parents: Column) -> Column:
    """Whether history is linear; null if ``parents``, counts of the listed commits, do not tell."""
    telling = F.try_element_at(F.filter(parents, lambda p: p.isNull() | (p > 1)), F.lit(1))
    found = F.size(F.filter(parents, lambda p: p.isNull() | (p > 1))) > 0
    return F.when(total > F.size(parents), F.lit(None)).when(status.isin("behind", "identical") | ~found, True).when(telling.isNotNull(), False)


def needs_branch_sweep(divergent: Column, fingerprint: Column) -> Column:
    """Branches were not counted, or divergent ones have no fingerprint."""
    return divergent.isNull() | ((divergent > 0) & (F.coalesce(fingerprint, F.lit("")) == ""))


def needs_history_sweep(linear: Column, parents: Column) -> Column:
    return linear.isNull() & parents.isNull()


def centrality_method(modules: Column, directories: Column) -> Column:
    """Which scores weigh a fork's files: those of modules, of directories, or none."""
    return F.when(modules.isNotNull(), "mdg").when(directories.isNotNull(), "directory").otherwise("")


def cached_refresh(resolved: Column, counts_only: Column, same_work: Column, found: Column) -> Column:
    """accept, refresh_behind or invalidate a cached comparison.

    ``same_work`` is whether a full batch selects just what was compared.
    ``found`` is a struct of that branch now and then: ahead, tip, behind, and
    was_ahead, was_tip, was_behind; it is null where the branch is not found.
    """
    moved = (found["ahead"] != found["was_ahead"]) | ((found["tip"] != "") & (found["was_tip"] != "") & (found["tip"] != found["was_tip"]))
    behind = F.when(found["behind"] != found["was_behind"], "refresh_behind").otherwise("accept")
    whole = F.when(same_work, behind).otherwise("invalidate")
    unknown = (found["tip"] == "") | (found["was_tip"] == "")
    counted = F.when(moved, "invalidate").when(unknown, "accept").otherwise(behind)
    return F.when(resolved & ~counts_only, whole).when(~resolved | found.isNull(), "accept").otherwise(counted)


def skip_code(enabled: Column, eligible: Column, epsilon: Column, min_size: Column, top: Column, least: int = 10) -> Column:
    """Why a network is not clustered, null if it is."""
    bounds = (epsilon >= 0) & (epsilon < 2) & ~F.isnan(epsilon) & (min_size >= 2) & (top >= 1) & F.lit(least >= 1)
    return F.when(~enabled, "disabled").when(eligible == 0, "no_eligible_forks").when(eligible < least, "insufficient_candidates").when(~F.coalesce(bounds, F.lit(False)), "invalid_config")


def cache_usable(cached: dict[str, Column], wanted: dict[str, Column], now: Column, hours: int = 24) -> Column:
    """Whether cached clusters may be used.

    Both have fingerprint, model and endpoint, ``cached`` schema and computed
    too.  Models agree by the name before a tag, in any case; an empty wanted
    model, or an empty endpoint of either side, agrees with all.
    """
    base = lambda model: F.lower(F.substring_index(model, ":", 1))
    model = (wanted["model"] == "") | (base(cached["model"]) == base(wanted["model"]))
    endpoint = (cached["endpoint"] == "") | (wanted["endpoint"] == "") | (cached["endpoint"] == wanted["endpoint"])
    fresh = cached["computed"] >= now - F.make_dt_interval(hours=F.lit(hours))
    return F.coalesce((cached["schema"] == CACHE_SCHEMA) & (cached["fingerprint"] == wanted["fingerprint"]) & fresh & model & endpoint, F.lit(False))


def empty_search(counts: DataFrame, searches: DataFrame, model: str = "model") -> DataFrame:
    """Searches with the reason for which they found nothing.

    ``counts`` has model and n, its vectors; ``searches`` has model and filtered,
    whether a repository was named.
    """
    stored = counts.agg(F.count("*").alias("models"))
    df = searches.join(counts.select(model, F.col("n").alias("indexed")), model, "left").crossJoin(F.broadcast(stored))  # one row
    mine = F.coalesce("indexed", F.lit(0))
    reason = F.when(F.col("filtered") & (mine > 0), "semantic_repo_filter_empty").when((F.col("models") > 0) & (mine == 0), "semantic_model_mismatch").otherwise("semantic_empty")
    return df.withColumn("reason", reason).withColumn("indexed", mine.cast("long")).drop("models")


def search_order(rows: DataFrame, score: str, key: str, top: int) -> DataFrame:
    """The best ``top`` rows, equal scores by key."""
    return rows.orderBy(F.desc(score), key).limit(top)
