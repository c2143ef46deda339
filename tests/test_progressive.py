"""Orders of display are whole, and shells take turns."""

from __future__ import annotations

import random

from cairn.operators import progressive
from cairn.plans.ranking import ranked


def test_ranks_are_places(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0.0, 1.5, rng.random() * 9]), k % 3) for k in range(700)]
    got = {r["pid"]: r["rank"] for r in ranked(spark.createDataFrame(rows, "pid long, v double, g int"), "v", ["pid"], ["g"]).collect()}
    for g in range(3):
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[1], r[0]))
        assert [got[r[0]] for r in own] == list(range(len(own)))


def test_shells_take_turns(spark):
    rng = random.Random(2)
    cloud = spark.createDataFrame([(k, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(400)], "pid long, x double, y double, z double")
    got = sorted(progressive.distance_shells(cloud, 83, 50).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(400))
    assert [r["shell"] for r in got[:83]] == [k % 8 for k in range(83)]
    rest = [r["shell"] for r in got[83:]]
    assert rest == sorted(rest) and got[-1]["chunk"] == 1 + (399 - 83) // 50
    assert progressive.reduced(cloud, 50, 0.1).count() <= 50
