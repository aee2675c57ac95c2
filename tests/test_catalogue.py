"""Every query of the catalogue runs, and agrees with its SQL twin in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from spanmill.plans import catalogue

SF = "/root/testdata/sf0.001"
ORACLE = catalogue.oracle_sql()


def rows(frame):
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(str(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in clean.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    got = catalogue.queries()[name](spark, SF)
    if name not in ORACLE:
        assert got.limit(1).count() == 1
        return
    with duckdb.connect() as con:
        for f in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        assert rows(got.toPandas()) == rows(con.execute(ORACLE[name]).df())


def test_oracles_have_queries():
    assert set(ORACLE) <= set(catalogue.queries())
