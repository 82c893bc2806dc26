"""Queries that must take all rows, on tables larger than the smallest."""

import duckdb
import pytest

import arborlake.registry as registry

BIG, MID = "/root/testdata/sf0.1", "/root/testdata/sf0.01"


def test_win_pairs_take_every_supplier(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{BIG}/supplier.parquet'")
    want = dict(c.execute(f"SELECT k, won FROM ({registry.ORACLES['j13_win_pairs']})").fetchall())
    got = {r["k"]: r["won"] for r in registry.QUERIES["j13_win_pairs"](spark, BIG).collect()}
    assert len(want) == 1000 and got == pytest.approx(want, abs=2e-5)


@pytest.mark.parametrize("name", ["g2_pagerank", "g3_entry_point_teleport"])
def test_every_supplier_is_a_node(spark, name):
    nodes = {r["node"] for r in registry.QUERIES[name](spark, MID).collect()}
    keys = duckdb.sql(f"SELECT DISTINCT l_suppkey FROM '{MID}/lineitem.parquet'").fetchall()
    assert len(keys) == 100 and {f"s{k}" for (k,) in keys} <= nodes


@pytest.mark.parametrize("name", ["n4_rank_distribution", "n5_top_k_probability"])
def test_rank_reports_hold_the_whole_pool(spark, name):
    rows = registry.QUERIES[name](spark, MID).groupBy("segment").count().collect()
    sizes = duckdb.sql(f"SELECT c_mktsegment, least(count(*), 200) FROM '{MID}/customer.parquet' GROUP BY ALL").fetchall()
    assert sorted(r["count"] for r in rows) == sorted(n for _, n in sizes)
