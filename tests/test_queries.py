"""Each registered plan against its DuckDB statement on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tickloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(
        tuple("null" if pd.isna(x) else f"{x:.5f}" if isinstance(x, float) else str(pd.Timestamp(x)) if hasattr(x, "year") else str(x) for x in r)
        for r in frame.itertuples(index=False)
    )


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_gives_rows_again(spark, name):
    """What SQL cannot say gives the same rows twice."""
    key = lambda f: sorted(str(r) for r in f.collect())
    first = key(queries.QUERIES[name](spark, SF))
    assert first and first == key(queries.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, db, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    wanted = db.execute(queries.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert normal(found) == normal(wanted)
