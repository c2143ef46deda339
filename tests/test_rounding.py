"""Scores that lie between two rounded values: rows of the queries are those of their SQL there too."""

from __future__ import annotations

import duckdb
import pytest

from cairn.plans import bindings
from cairn.plans.queries import ORACLES, QUERIES

#: Means of 300,000 (k + 0.5) / 10,000: the double nearest to such a share is under or over it.
TIES = [300_000 * (k + 0.5) / 10_000 for k in (7040, 7011, 7111, 9676, 7614, 5, 1, 2, 4824, 3333)]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tied"))
    rows = [(10 * k + j, 20 * k + 8, price) for k, price in enumerate(TIES) for j in range(2)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


def agreed(spark, folder, name):
    got = QUERIES[name](spark, folder)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert len(want) and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_baseline_deltas_of_ties(spark, tied):
    agreed(spark, tied, "baseline_deltas")


def test_leaderboard_of_ties(spark, tied):
    agreed(spark, tied, "leaderboard")


def test_means_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    cents = [26_737_191, 8_129_939, 19_981_007, 31_400_013, 12_345_671, 45_101_203, 9_876_549]
    cents.append(8 * 30 * (7711 * 100 + 50) - sum(cents))  # the mean is 300,000 x 0.77115
    for k, own in enumerate((cents, cents[::-1], sorted(cents))):
        spark.createDataFrame([(i, k, c / 100) for i, c in enumerate(own)], "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert {r["auc"] for r in bindings.order_metrics(spark, str(tmp_path)).collect()} == {0.7712}
