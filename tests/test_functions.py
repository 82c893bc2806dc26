import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import hashing, numeric, paths, text, vectors


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normal_cdf_is_double_precision(spark):
    xs = [float(x) for x in np.linspace(-12, 12, 97)] + [0.0, 7.0710678, 7.0710679]
    got = values(spark, numeric.normal_cdf(F.col("x")), [(x,) for x in xs], "x double")
    for x, p in zip(xs, got, strict=True):
        assert p == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-12)


def test_log_norm_and_decay(spark):
    assert values(spark, numeric.log_norm(F.col("x"), 100), [(0.0,), (-1.0,), (100.0,), (1e9,)], "x double") == [0, 0, 1, 1]
    assert values(spark, numeric.decay(F.col("x"), F.lit(30.0)), [(0.0,), (-2.0,), (30.0,)], "x double") == [1, 1, pytest.approx(math.exp(-0.693))]
    assert values(spark, numeric.decay(F.col("x"), F.lit(0.0)), [(5.0,)], "x double") == [0]


def test_win_probability_without_spread(spark):
    p = numeric.win_probability(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0))
    assert values(spark, p, [(2.0, 1.0), (1.0, 2.0), (1.0, 1.0)], "a double, b double") == [1, 0, 0.5]


def test_midpoint_percentile_has_ties_in_the_middle(spark):
    df = spark.createDataFrame([("n", 1.0), ("n", 1.0), ("n", 3.0), ("n", 4.0)], "g string, x double")
    got = sorted(r[0] for r in df.select(numeric.midpoint_percentile(F.col("x"), ["g"])).collect())
    assert got == [0.25, 0.25, 0.625, 0.875]


@pytest.mark.parametrize(
    ("path", "kind"),
    [("vendor/a.md", "junk"), ("x/y.min.js", "junk"), ("a/go.sum", "junk"), ("generated/a.go", "generated"), ("a/b.pb.go", "generated"), (".github/a.go", "docs"), ("README.MD", "docs"), ("a/.gitignore", "docs"), ("src/a.go", "source"), ("a/vendor/b.go", "source")],
)
def test_file_class(spark, path, kind):
    assert values(spark, paths.file_class(F.col("p")), [(path,)], "p string") == [kind]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("src", "src/a.go", True), ("src", "srcx/a.go", False), ("src/", "src", True), ("./src", "src/a", True), ("*.go", "a.go", True), ("*.go", "b/a.go", False), ("**/*.go", "a.go", True), ("**/*.go", "b/c/a.go", True), ("a/**", "a/b/c", True), ("a/**", "ab/c", False), ("a/?.go", "a/b.go", True), ("a/[bc].go", "a/c.go", True), ("a/[bc].go", "a/d.go", False)],
)
def test_path_patterns(spark, pattern, path, hit):
    assert values(spark, paths.matches(F.col("p"), pattern), [(path,)], "p string") == [hit]


@pytest.mark.parametrize("pattern", ["", "/abs", "../x", "a/../b", "  "])
def test_bad_patterns(pattern):
    with pytest.raises(ValueError):
        paths.normalize_pattern(pattern)


def test_ancestors(spark):
    assert values(spark, paths.ancestors(F.col("p")), [("a/b/c.go",), ("top.go",)], "p string") == [["a/", "a/b/"], []]


def test_lexical_tokens(spark):
    got = values(spark, text.lexical_tokens(F.col("t")), [("Go 12 x ab\ncd Été",), ("",)], "t string")
    assert got == [["go", "ab", "go ab", "cd", "été", "cd été"], []]


def test_fnv_and_utf8_repair():
    assert hashing.fnv1a_64(b"") == 0xCBF29CE484222325 and hashing.fnv1a_64(b"a") == 0xAF63DC4C8601EC8C
    assert hashing.repair_utf8(b"a\xe2\x82b\xff") == "a��b�" and hashing.repair_utf8(None) is None


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    row = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.norm(vectors.l2_normalize(F.col("a"))), vectors.l2_normalize(F.col("b"))).first()
    assert row[0] == 0 and row[1] == pytest.approx(1, abs=1e-6) and row[2] == [0, 0]
    assert vectors.unpack_floats(vectors.pack_floats([1.5, -2.0])) == [1.5, -2.0]
    with pytest.raises(ValueError):
        vectors.unpack_floats(b"abc")


def test_concat_blocks_weighs_and_fills(spark):
    df = spark.createDataFrame([([1.0, 0.0], None)], "a array<float>, b array<float>")
    got = df.select(vectors.concat_blocks([(F.col("a"), 0.3, 2), (F.col("b"), 0.2, 2)])).first()[0]
    assert got == [pytest.approx(1), 0, 0, 0]


def test_urls_and_references(spark):
    rows = [("https://gitlab.example.org/a/b/c.git",), ("o/r",), ("codeberg.org/o/r",), ("x",)]
    got = values(spark, text.repo_url(F.col("u")), rows, "u string")
    assert [tuple(g) for g in got] == [("gitlab.example.org", "a/b", "c", "gitlab"), ("github.com", "o", "r", "github"), ("codeberg.org", "o", "r", "gitea"), ("github.com", None, None, "github")]
    refs = values(spark, text.pr_reference(F.col("u")), [("o/r#12",), ("https://github.com/o/r/pull/7",), ("#3",)], "u string")
    assert [tuple(g) for g in refs] == [("o", "r", 12), ("o", "r", 7), (None, None, None)]
