"""Queries that must hold the whole range of their input, counted without their SQL."""

import duckdb

from tickloom.plans import queries

SF = "/root/testdata/sf0.001"


def test_active_days_span_all_memberships(spark):
    spans = duckdb.sql(
        f"""SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b
        FROM '{SF}/orders.parquet' JOIN '{SF}/customer.parquet' ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment"""
    ).fetchall()
    wanted = sum((a.toordinal() + k - 1) % 7 < 5 for a, b in spans for k in range((b - a).days))
    assert queries.QUERIES["active_days_whole"](spark, SF).count() == wanted


def test_pivot_holds_every_month(spark):
    cells = duckdb.sql(f"SELECT DISTINCT year(o_orderdate), month(o_orderdate) FROM '{SF}/orders.parquet'").fetchall()
    found = queries.QUERIES["pivot_year_all_months"](spark, SF).collect()
    assert {(r[0], k) for r in found for k in range(1, 13) if r[k] is not None} == set(cells)


def test_all_lookbacks_and_tails_are_registered(spark):
    found = queries.QUERIES["lookback_pct_all"](spark, SF)
    assert found.columns == ["symbol", "ts", "pct_0", "pct_32", "pct_224", "pct_896", "pct_3584", "pct_11680"]
    assert "tail_returns_30d" in queries.QUERIES
