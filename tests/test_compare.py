"""Comparisons, caches, labels and features on small cases."""

import pytest
from pyspark.sql import functions as F

from arborlake.functions import paths
from arborlake.operators import compare, features, labels
from arborlake.sources import code


def one(spark, column, **values):
    names = {k: (v if hasattr(v, "alias") else F.lit(v)) for k, v in values.items()}
    return spark.range(1).select(*(c.alias(k) for k, c in names.items())).select(column).first()[0]


def test_head_and_base(spark):
    out = compare.head_and_base(F.array(F.lit("a"), F.lit("b")), F.col("n"), F.col("m"), F.lit("base"))
    assert tuple(one(spark, out, n=2, m="")) == ("b", "base")
    assert tuple(one(spark, out, n=3, m="mb")) == (None, "mb")


def test_backfill_takes_whole_lists_only(spark):
    ddl = "fork long, path string, additions long, deletions long, patch string"
    listed = spark.createDataFrame([(1, "a", 1, 0, "rest"), (1, "b", 1, 0, ""), (2, "a", 1, 0, None), (2, "b", 1, 0, None), (3, "a", 1, 0, "rest"), (4, "z", 2, 2, None)], ddl)
    full = spark.createDataFrame([(1, "a", 5, 0, "x"), (1, "b", 5, 0, "y"), (1, "c", 5, 0, "z"), (2, "a", 9, 9, "x"), (3, "a", 9, 9, "x")], ddl)
    complete = spark.createDataFrame([(1, True), (2, True), (3, False)], "fork long, complete boolean")
    got = sorted((r["fork"], r["path"], r["additions"], r["patch"], r["replaced"]) for r in compare.backfill_files(listed, full, complete, "fork").collect())
    assert got == [(1, "a", 5, "rest", True), (1, "b", 5, "y", True), (1, "c", 5, "z", True), (2, "a", 1, None, False), (2, "b", 1, None, False), (3, "a", 1, "rest", False), (4, "z", 2, None, False)]


def test_patch_outcome(spark):
    out = compare.patch_outcome(F.col("p"), F.lit(1), F.lit(0), F.col("v"))
    assert one(spark, out, p="@@\n+x", v=True) == "accepted" and one(spark, out, p="@@\n+x", v=False) == "bad hunks"
    assert one(spark, out, p="", v=False) == "got +0/-0 lines, want +1/-0"


def test_two_sided(spark):
    rows = spark.createDataFrame([(1, "a", "fork"), (1, "a", "upstream"), (1, "b", "fork"), (1, "b", "fork"), (1, "c", "upstream"), (2, "c", "upstream")], "k long, sha string, side string")
    assert sorted(map(tuple, compare.two_sided(rows, "k").collect())) == [(1, 1, 1), (2, 0, 1)]


@pytest.mark.parametrize(("total", "status", "parents", "want"), [(3, "ahead", [1, 1], None), (2, "identical", [2, 2], True), (2, "ahead", [1, 1], True), (2, "ahead", [2, None], False), (2, "ahead", [None, 2], None), (0, "ahead", [], True)])
def test_linearity(spark, total, status, parents, want):
    found = F.array(*(F.lit(p).cast("int") for p in parents)).cast("array<int>")
    assert one(spark, compare.linearity(F.col("n"), F.col("s"), F.col("p")), n=total, s=status, p=found) is want


def test_sweeps(spark):
    out = compare.needs_branch_sweep(F.col("d"), F.col("f"))
    none = F.lit(None).cast("string")
    assert [one(spark, out, d=d, f=f) for d, f in ((F.lit(None).cast("int"), "x"), (0, none), (2, none), (2, ""), (2, "x"))] == [True, False, True, True, False]


@pytest.mark.parametrize(
    ("resolved", "only", "same", "found", "want"),
    [
        (True, False, True, (2, "t", 5, 2, "t", 5), "accept"), (True, False, True, (2, "t", 6, 2, "t", 5), "refresh_behind"), (True, False, False, (2, "t", 6, 2, "t", 5), "invalidate"),
        (True, True, False, (2, "t", 6, 2, "t", 5), "refresh_behind"), (True, True, False, (3, "t", 5, 2, "t", 5), "invalidate"), (True, True, False, (2, "u", 5, 2, "t", 5), "invalidate"),
        (True, True, False, (2, "", 6, 2, "t", 5), "accept"), (False, False, False, (3, "t", 6, 2, "t", 5), "accept"), (True, True, False, None, "accept"),
    ],
)
def test_cached_refresh(spark, resolved, only, same, found, want):
    row = spark.createDataFrame([(resolved, only, same, found)], "r boolean, o boolean, s boolean, f struct<ahead:int,tip:string,behind:int,was_ahead:int,was_tip:string,was_behind:int>")
    assert row.select(compare.cached_refresh(*(F.col(c) for c in "rosf"))).first()[0] == want


def test_skip_codes(spark):
    out = compare.skip_code(F.col("on"), F.col("n"), F.col("e"), F.col("m"), F.col("n"))
    cases = [(False, 50, 0.5, 3), (True, 0, 0.5, 3), (True, 9, 0.5, 3), (True, 10, 2.0, 3), (True, 10, float("nan"), 3), (True, 10, 0.5, 1), (True, 10, 0.0, 2)]
    assert [one(spark, out, on=a, n=b, e=c, m=d) for a, b, c, d in cases] == ["disabled", "no_eligible_forks", "insufficient_candidates", *["invalid_config"] * 3, None]


def test_cache_usable(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")

    def usable(schema=4, fp="f", at="2024-01-01 00:00:00", model="Nomic:latest", endpoint="h", want="nomic", at_host="h"):
        cached = {"schema": F.lit(schema), "fingerprint": F.lit(fp), "computed": F.lit(at).cast("timestamp"), "model": F.lit(model), "endpoint": F.lit(endpoint)}
        return spark.range(1).select(compare.cache_usable(cached, {"fingerprint": F.lit("f"), "model": F.lit(want), "endpoint": F.lit(at_host)}, now)).first()[0]

    assert usable() and usable(want="") and usable(endpoint="") and usable(at_host="") and usable(want="NOMIC:x")
    assert not any((usable(schema=3), usable(fp="g"), usable(at="2023-12-31 23:59:59"), usable(at=None), usable(model="other"), usable(endpoint="i")))


def test_empty_search(spark):
    counts = spark.createDataFrame([("a", 3)], "model string, n long")
    searches = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "model string, filtered boolean")
    reasons = lambda c: {(r["model"], r["filtered"]): r["reason"] for r in compare.empty_search(c, searches).collect()}
    assert reasons(counts) == {("a", True): "semantic_repo_filter_empty", ("a", False): "semantic_empty", ("b", True): "semantic_model_mismatch"}
    assert set(reasons(counts.limit(0)).values()) == {"semantic_empty"}


def test_cluster_labels(spark):
    members = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("z", 4)], "cluster string, fork_id long")
    paths_ = spark.createDataFrame([(1, "internal/auth/a.go"), (1, "internal/auth/token.go"), (2, "internal/auth/a.go"), (2, "internal/x.go"), (3, "web/View.tsx"), (3, "web/deep/Panel.tsx"), (3, "web/deep2/b.c"), (4, "README")], "fork_id long, path string")
    commits = spark.createDataFrame([(1, "Add rate limit\nfix (rate) limit"), (2, "rate limit tokens"), (4, "merge main")], "fork_id long, message string")
    got = {r["cluster"]: r for r in labels.cluster_labels(members, paths_, commits, lambda df: df).collect()}
    assert got["x"]["directory"] == "internal/auth/" and got["x"]["label"] == "internal/auth/  ·  limit, rate, tokens"
    assert got["y"]["directory"] == "web/" and got["y"]["words"] == "deep, deep2, panel"
    assert got["z"]["directory"] is None and got["z"]["label"] == "readme"


def test_phrases(spark):
    assert one(spark, labels.phrases(F.col("t")), t="Some WORDS, here\n(alone)") == ["some", "words", "here", "some words", "words here", "alone"]
    assert one(spark, labels.phrases(F.col("t")), t="") == []


def test_fork_features(spark):
    files = spark.createDataFrame([(1, "b", 1, 0), (1, "a", 5, 5), (1, "a", 1, 1)], "fork_id long, path string, additions long, deletions long")
    commits = spark.createDataFrame([(1, 1, "Second", 2), (1, 2, " first ", 1), (1, 3, "second", 3), (1, 4, "x\n  merge y", 0), (1, 5, "  ", 0)], "fork_id long, doc_id long, text string, at long")
    row = features.fork_features(files, commits).first()
    assert (row["paths"], row["commits"], row["truncated"]) == ("a\nb", "first\nSecond", False)
    assert row["diff"].startswith("--- a/a\n+++ b/a\n@@@@\n--- a/a") and features.fork_features(files, commits, 10).first()["truncated"]


def test_checked_inputs(spark):
    assert one(spark, code.weights(F.col("t")), t='{"stars": 2, "novelty": 0.5}') == {"stars": 2.0, "novelty": 0.5}
    assert [one(spark, code.weights(F.col("t")), t=t) for t in ('{"stars": 3}', '{"moon": 1}', '{"stars": "x"}', '{"stars": true}', "nonsense")] == [None] * 5
    assert one(spark, code.lanes(F.col("t"), ("a", "b")), t=" A, b,a") == ["a", "b"] and one(spark, code.lanes(F.col("t"), ("a",)), t="c") is None and one(spark, code.lanes(F.col("t"), ("a",)), t=" ,") is None
    assert one(spark, code.topic_idf(F.col("t")), t='{"go": 1.5}') == {"go": 1.5} and one(spark, code.topic_idf(F.col("t")), t="{") in ({}, {"": None})
    for raw in (" ./a/b// ", "././x", "/abs", "a/../b", "", "./", "..", "*.go"):
        try:
            want = paths.normalize_pattern(raw)
        except ValueError:
            want = None
        assert one(spark, paths.normalized_pattern(F.col("t")), t=raw) == want, raw
