import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.graph.clustering import cluster, pair_values
from arborlake.graph.components import connected_components
from arborlake.graph.pagerank import pagerank
from arborlake.functions.hashing import fnv1a_32
from arborlake.operators import branches, decisions, ranking, scoring, signals, store
from arborlake.operators.evaluation import pair_auc
from arborlake.operators.order import positions, running, with_percentiles
from arborlake.operators.skew import join_counted
from arborlake.session import checkpointed
from arborlake.sources import diffs


def test_two_sure_items_and_three_equal_ones():
    d = ranking.rank_distribution(np.array([10.0, 0.0]), np.array([1.0, 1.0]))
    assert d[0, 0] == pytest.approx(1, abs=1e-9) and d[1, 1] == pytest.approx(1, abs=1e-9)
    d = ranking.rank_distribution(np.zeros(3), np.ones(3))
    assert np.allclose(d, 1 / 3, atol=1e-9)
    assert ranking.rank_interval(d[0]) == (1, 3)


def test_rank_distribution_agrees_with_simulation():
    rng = np.random.default_rng(1)
    mu, sd = np.array([3.0, 2.5, 0.0, 1.0]), np.array([1.0, 2.0, 0.5, 3.0])
    draws = rng.normal(mu, sd, (200_000, 4))
    ranks = (-draws).argsort(axis=1).argsort(axis=1)
    seen = np.array([[np.mean(ranks[:, i] == r) for r in range(4)] for i in range(4)])
    d = ranking.rank_distribution(mu, sd)
    assert np.abs(d - seen).max() < 0.01 and np.allclose(d.sum(axis=0), 1, atol=1e-6)
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    for i in range(4):
        e = 1 + sum(phi((mu[j] - mu[i]) / math.hypot(sd[i], sd[j])) for j in range(4) if j != i)
        assert d[i] @ np.arange(1, 5) == pytest.approx(e, abs=1e-7)


def test_shrinkage_regimes(spark):
    rows = [("few", 1.0, 1.0), ("few", 2.0, 1.0)] + [("same", 5.0, 3.0)] * 5 + [("wide", float(x), 1.0) for x in (0, 10, 20, 30, 40)]
    got = {r["g"]: r for r in ranking.shrink(spark.createDataFrame(rows, "g string, y double, sd double"), ["g"]).collect()}
    assert got["few"]["regime"] == "insufficient" and got["few"]["theta"] is None
    assert got["same"]["regime"] == "pooled" and got["wide"]["regime"] in ("heterogeneous", "clamped")


def test_penalties_stop_at_no_ahead(spark):
    df = spark.createDataFrame([(90.0, 0), (90.0, None), (90.0, 3)], "s double, ahead int")
    no = F.lit(False)
    out = scoring.penalised(F.col("s"), F.col("ahead"), no, F.lit(True), F.lit(0.1), F.lit(-5.0), F.lit(-10.0))
    got = [(r[0]["score"], r[0]["penalties"]) for r in df.select(out).collect()]
    assert got[0] == (0, ["no_ahead"])
    assert got[1] == got[2] == (pytest.approx(6), ["archived", "low_recency", "topic_tag", "fork_farmer"])


def test_branch_lanes(spark):
    rows = [("a", "main", True, 0, False, 1), ("a", "x", False, 2, False, 5), ("a", "y", False, 2, False, 9), ("b", "main", True, 1, True, 1), ("b", "x", False, 1, True, 5), ("c", "main", True, 0, False, 1)]
    df = spark.createDataFrame(rows, "k string, name string, is_default boolean, ahead int, upstreamed boolean, tip_at int")
    got = {r["k"]: (r["name"], r["ahead"], r["needs_rest"]) for r in branches.select_branch(df, "k").collect()}
    assert got == {"a": ("y", 2, True), "b": ("main", 1, True), "c": ("main", 0, False)}


def test_upsert_keeps_what_is_unknown(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, x double")
    new = spark.createDataFrame([(2, "B", None), (3, "c", 3.0)], "k int, name string, x double")
    got = sorted(map(tuple, store.upsert(old, new, ["k"], keep_when_null=("x",)).collect()))
    assert got == [(1, "a", 1.0), (2, "B", 2.0), (3, "c", 3.0)]


def test_bots(spark):
    df = spark.createDataFrame([(["Ann", "ann", "x[bot]", "Renovate", "Stale"],)], "l array<string>")
    assert df.select(decisions.humans(F.col("l"), ("stale",))).first()[0] == ["ann", "stale"]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", checkpointed).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 150))
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", checkpointed).count() == 0


def slow_pagerank(nodes, edges, teleport, rounds):
    out = {n: [d for s, d in edges if s == n and d in nodes] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        loose = sum(rank[n] for n in nodes if not out[n]) / len(nodes)
        rank = {n: 0.15 * teleport[n] + 0.85 * (loose + sum(rank[m] / len(out[m]) for m in nodes if n in out[m])) for n in nodes}
    return rank


@pytest.mark.parametrize("small", [0, 1000])
@pytest.mark.parametrize("entry", [0.0, 1.0])
def test_pagerank(spark, small, entry):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "elsewhere")] + [("hub", f"n{i}") for i in range(30)] + [("a", "hub")]
    nodes = ["a", "b", "c", "d", "hub", *(f"n{i}" for i in range(30))]
    df = spark.createDataFrame([(n, entry if n in "ab" else 0.0) for n in nodes], "node string, weight double")
    got = dict(map(tuple, pagerank(df, spark.createDataFrame(edges, "src string, dst string"), checkpointed, rounds=8, small=small).collect()))
    want = slow_pagerank(nodes, edges, {n: 1 / len(nodes) if not entry else 0.5 * (n in "ab") for n in nodes}, 8)
    assert sum(got.values()) == pytest.approx(1) and got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=1e-9) for n in nodes)


def test_pagerank_plans_do_not_grow(spark):
    sizes = []

    def cut(df):
        sizes.append(len(df._jdf.queryExecution().analyzed().toString()))
        return checkpointed(df)

    nodes = spark.createDataFrame([(c, 0.0) for c in "abcd"], "node string, weight double")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    pagerank(nodes, edges, cut, rounds=5, small=0)
    assert len(sizes) == 7 and max(sizes[2:]) < 1.2 * min(sizes[2:])


def test_components_of_a_hub_and_a_path(spark):
    links = [(i, 0) for i in range(1, 600)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 2001), (2001, 2000)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(map(tuple, connected_components(df, "a", "b", checkpointed).collect()))
    assert got == {i: 0 for i in range(600)} | {1000 + i: 1000 for i in range(41)} | {2000: 2000, 2001: 2000}


def test_join_counted_splits_hot_keys(spark):
    left = spark.createDataFrame([(1 if i < 700 else i, i) for i in range(1000)] + [(None, -1)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).filter("k is null or k <> 999")
    got = join_counted(left, right, ["k"], 1001).select("k", "v", "top").collect()
    top = {1: 699} | {i: i for i in range(700, 999)}
    assert sorted(map(tuple, got)) == sorted((1 if i < 700 else i, i, top[1 if i < 700 else i]) for i in range(999))


def test_running_sums_over_ranges(spark):
    rows = [(i * 7 % 500, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = running(df, ["k"], "v", "before", checkpointed).collect()
    at = {k: v for k, v in rows}
    assert {r["k"]: r["before"] for r in got} == {k: sum(at[j] for j in range(k)) for k in at}
    assert running(df.filter("false"), ["k"], "v", "before", checkpointed).count() == 0


def test_percentiles_from_counts(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", None), ("a", 5.0), (None, 2.0), (None, 3.0), ("b", -0.0), ("b", 0.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = sorted((r["g"] or "", r["x"] if r["x"] is not None else -1, r["x_pct"], r["set_size"]) for r in with_percentiles(df, ["g"], ["x"]).collect())
    assert got == [("", 2.0, 0.25, 2), ("", 3.0, 0.75, 2), ("a", -1, 0.125, 4), ("a", 1.0, 0.5, 4), ("a", 1.0, 0.5, 4), ("a", 5.0, 0.875, 4), ("b", 0.0, 0.5, 2), ("b", 0.0, 0.5, 2)]
    assert with_percentiles(df.limit(0), ["g"], ["x"]).count() == 0


def test_positions_in_sets(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("g"), (F.col("id") * 7919 % 101).alias("x"))
    got = {r["k"]: (r["at"], r["total"]) for r in positions(df, ["g"], ["x", "k"], "at", checkpointed).collect()}
    for g in ("small", "hot"):
        order = sorted(((i * 7919 % 101, i) for i in range(3000) if (i % 50 == 0) == (g == "small")))
        assert [got[i] for _, i in order] == [(n + 1, len(order)) for n in range(len(order))]
    assert positions(df.limit(0), ["g"], ["x", "k"], "at", checkpointed).count() == 0


def test_pair_values_and_auc(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, v[i].tolist(), int(label[i])) for i in range(60)], "id long, vec array<double>, label int")
    got = pair_auc(pair_values(df, block=16), "value", checkpointed).first()["auc"]
    pairs = [(round(float(v[i] @ v[j]), 6), label[i] == label[j]) for i in range(60) for j in range(i)]
    p, n = [s for s, same in pairs if same], [s for s, same in pairs if not same]
    assert got == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n]), abs=1e-9)


def test_normal_cdf():
    x = np.linspace(-12, 12, 4001)
    want = np.array([0.5 * math.erfc(-min(10, max(-10, t)) / math.sqrt(2)) for t in x])
    assert np.abs(ranking.normal_cdf(x) - want).max() < 1e-11


def test_clusters_and_noise(spark):
    pts = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.96, 0.28]), (4, [0.0, 1.0]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(pts, "id long, vec array<float>")
    assert dict(map(tuple, cluster(df, 0.1, checkpointed).collect())) == {1: 1, 2: 1, 3: 1, 4: None, 5: None}


DIFF = """diff --git a/a.txt b/a.txt
--- a/a.txt
+++ b/a.txt
@@ -1,2 +1,3 @@
 keep
-diff --git a/x b/x
+--- a/evil
+new
diff --git "a/wei\\303\\237.txt" "b/wei\\303\\237.txt"
new file mode 100644
--- /dev/null
+++ "b/wei\\303\\237.txt"
@@ -0,0 +1 @@
+x
diff --git a/old b/new
similarity index 100%
rename from old
rename to new
diff --git a/p.png b/p.png
Binary files a/p.png and b/p.png differ
diff --git a/gone b/gone
deleted file mode 100644
--- a/gone
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


def test_unified_diff():
    got = [(f["path"], f["previous_path"], f["status"], f["additions"], f["deletions"]) for f in diffs.parse_diff(DIFF)]
    assert got == [("a.txt", None, "modified", 2, 1), ("weiß.txt", None, "added", 1, 0), ("new", "old", "renamed", 0, 0), ("p.png", None, "modified", 0, 0), ("gone", None, "removed", 0, 1)]
    assert diffs.parse_diff("") == [] and diffs.parse_diff(DIFF, oversize=5)[0]["patch"] == ""


def test_patch_validation():
    assert diffs.parse_patch_valid("@@ -1,2 +1,2 @@\n a\n-b\n+c")
    assert not diffs.parse_patch_valid("@@ -1,2 +1,2 @@\n a\n-b") and not diffs.parse_patch_valid("")
    assert not diffs.parse_patch_valid("@@ -9 +9 @@\n-a\n+b\n@@ -1 +1 @@\n-a\n+b")


def test_suggestions():
    body = "hi\r\n```suggestion\r\na\r\nb\r\n```\n~~~~ Suggestion\nx\n~~~\n~~~~\n```go\nno\n```\n```suggestion\nopen"
    assert diffs.suggestions(body) == ["a\nb", "x\n~~~", "open"]


def test_signals_of_a_fork(spark):
    rows = [(1, "auth/x.go", 5, 1), (1, "b.go", 5, 1), (2, "Docs/a.md", 9, 9), (2, "README", 1, 1), (3, "tests/a.py", 1, 0), (4, "src/Makefile", 1, 0), (4, "x.YAML", 1, 0), *((5, f"s{i}.rs", 10, 10) for i in range(5)), (6, "db/migrate/1.sql", 1, 0), (7, "s.rs", 10, 10)]
    df = spark.createDataFrame(rows, "fork_id long, path string, additions long, deletions long")
    got = {r["fork_id"]: r for r in signals.file_signals(df).collect()}
    assert {i: r["archetype"] for i, r in got.items()} == {1: "security", 2: "docs", 3: "test", 4: "config", 5: "refactor", 6: "migration", 7: "general"}
    assert got[1]["extensions"][0] == 1 and sum(got[2]["extensions"]) == 1 and got[2]["extensions"][-1] == 0.5 and len(got[1]["extensions"]) == 25
    names = spark.createDataFrame([("My-repo.go",), ("",), (None,), ("a_a",)], "name string")
    slots = [r[0] for r in names.select(signals.name_slots(F.col("name"))).collect()]
    assert sum(slots[1]) == sum(slots[2]) == 0 and max(slots[3]) == 1 and sum(x * x for x in slots[0]) == pytest.approx(1)
    words = spark.createDataFrame([("",), ("a",), ("foobar",), ("ü",)], "w string").select(fnv1a_32(F.col("w"))).collect()
    assert [w[0] for w in words[:3]] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    v = names.select(signals.weak_signals(F.lit(None).cast("string"), F.lit("Go"), F.lit(None).cast("array<double>"), F.col("name"), F.lit(7.0))).first()[0]
    assert len(v) == 8 + 15 + 25 + 16 + 1 and v[0] == 0.2 and v[8] == 0.1 and v[-1] == 0.5


def test_reasons_of_distinctness(spark):
    row = "select {} as a, {} as f, {} as l, {} as u, {} as d, 'Sniper' as k, 0.456D as s, {} as t"
    said = lambda *x: spark.sql(row.format(*x)).select(decisions.distinct_reasons(*(F.col(c) for c in "afludkst"), F.lit("2024-01-02"))).first()[0]
    assert said(3, 2, 101, 1, "true", 9) == ["+3 commits ahead of upstream", "2 files changed", "+101 lines added", "Single contributor", "Sniper: strength 46%"]
    assert said(0, 0, 100, 4, "false", 0) == ["4 contributors", "Last pushed 2024-01-02"]
    assert said("null", "null", "null", "null", "cast(null as boolean)", 2) == ["2 stars", "Last pushed 2024-01-02"]


def test_win_sums_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(m), float(s)) for k, m, s in zip(rng.integers(0, 900, 1000), rng.normal(0, 40, 1000), rng.integers(0, 6, 1000), strict=True)]
    rows += [(2000, 1e7, 1.0), (2001, -1e7, 0.0), (2002, 5.0, 0.0), (2003, 5.0, 0.0), (2004, None, 2.0), (None, 3.0, 1.0)]
    known = [r for r in rows if None not in r]
    k, m, s = (np.array(x) for x in zip(*known, strict=True))
    spread = np.hypot(s[:, None], s)
    with np.errstate(all="ignore"):
        z = np.where(spread < 1e-9, np.inf * np.sign(m[:, None] - m), (m[:, None] - m) / spread)
    p = np.array([[0.5 if np.isnan(x) else 0.5 * math.erfc(-x / math.sqrt(2)) for x in row] for row in z])
    each = np.where(k[:, None] != k, p, 0).sum(axis=1)
    want = {int(i): float(each[k == i].sum()) for i in set(k)}
    got = {r["k"]: r["won"] for r in ranking.win_sums(spark.createDataFrame(rows, "k long, m double, sd double"), "k", "m", "sd", checkpointed, block=64).collect()}
    assert got.pop(2004) is None and got == pytest.approx(want, abs=1e-7)
    alone = spark.createDataFrame([(1, 2.0, 1.0), (1, 3.0, 1.0)], "k long, m double, sd double")
    assert ranking.win_sums(alone, "k", "m", "sd", checkpointed).count() == 0
