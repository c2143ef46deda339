"""Every query with SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import duckdb
import pytest

from cairn.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(df, columns):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, small, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got)
    if name in ORACLES:
        want = oracle.sql(ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)
