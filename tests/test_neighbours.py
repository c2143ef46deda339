"""Nearest neighbours against brute force: clusters, far and equal points, groups, ties, null, NaN and infinite coordinates."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import kdtree
from cairn.operators import neighbours

POINT = "pid long, x double, y double, z double"


def cloud(n, base=0):
    rng = np.random.default_rng(n + base)
    spread, dense, equal = rng.uniform(0, 10, (n // 2, 3)), rng.normal(5, 0.001, (n // 3, 3)), rng.integers(0, 3, (n // 6, 3)).astype(float)
    rows = [*np.concatenate([spread, dense, equal]).tolist(), [1e3, 1e3, -1e3], [None, 1.0, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0]]
    return [(base + i, *x) for i, x in enumerate(rows)]


def sound(p):
    return all(x is not None and math.isfinite(x) for x in p[1:])


def plain(source, target, k, apart):
    out = {}
    for i, *p in filter(sound, source):
        near = sorted((math.dist(p, q), j) for j, *q in filter(sound, target) if not (apart and i == j))
        out |= {(i, rank): (j, d) for rank, (d, j) in enumerate(near[:k], 1)}
    return out


def sizes(monkeypatch, small=20, bucket=16, part=12, chunk=30, leaf=4):
    """Buckets, parts and leaves of a few points."""
    for name, value in (("SMALL", small), ("BUCKET", bucket), ("PART", part), ("CHUNK", chunk), ("EACH", 2)):
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(kdtree, "LEAF", leaf)
    monkeypatch.setattr(kdtree, "QUERIES", 50)


@pytest.mark.parametrize(("k", "apart", "n", "small"), [(1, False, 240, 20), (1, False, 240, 10_000), (3, False, 240, 20), (4, True, 240, 20), (4, True, 240, 10_000), (300, False, 60, 20), (300, False, 60, 10_000), (2, True, 0, 20)])
def test_neighbours_equal_brute_force(spark, monkeypatch, k, apart, n, small):
    sizes(monkeypatch, small, part=12 if k == 1 else 2_000)
    source = cloud(n)
    target = source if apart else cloud(n, 10_000)[:-5]
    got = {(r["pid"], r["rank"]): (r["other"], r["d"]) for r in neighbours.nearest(spark.createDataFrame(source, POINT), spark.createDataFrame(target, POINT), k=k, apart=apart).collect()}
    want = plain(source, target, k, apart)
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=1e-12) for x in want)


@pytest.mark.parametrize("small", [20, 10_000])
def test_groups_meet_within_themselves(spark, monkeypatch, small):
    sizes(monkeypatch, small)
    clouds = {"a": cloud(120), "b": cloud(30, 500), "c": cloud(6, 900), "only target": cloud(40, 77)}
    rows = [(g, *p) for g, points in clouds.items() for p in points]
    source = spark.createDataFrame([*[r for r in rows if r[0] != "only target"], ("only source", 1, 0.0, 0.0, 0.0), (None, 2, 0.0, 0.0, 0.0)], f"file string, {POINT}")
    target = spark.createDataFrame([(g, 7 * i, None if x is None else x + 0.25, y, z) for g, i, x, y, z in rows], f"file string, {POINT}")
    got = {(r["file"], r["pid"], r["rank"]): (r["other"], r["d"]) for r in neighbours.nearest(source, target, k=2, by="file").collect()}
    want = {}
    for g, points in clouds.items():
        if g != "only target":
            want |= {(g, *x): v for x, v in plain(points, [(7 * i, None if x is None else x + 0.25, y, z) for i, x, y, z in points], 2, False).items()}
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=1e-12) for x in want)


def test_a_hot_place_is_no_burden(spark):
    """Most points of both clouds in one place, and a source point far away from all."""
    source = spark.range(30_000).selectExpr("id AS pid", "if(id % 3 < 2, 1.0, id / 7e3) AS x", "if(id = 29999, 1e9, 0.0) AS y", "0.0 AS z")
    out = neighbours.nearest(source, source, k=2, apart=True)
    assert out.count() == 60_000
    assert out.filter("pid % 3 < 2 AND pid <> 29999 AND d <> 0").count() == 0
    none = spark.createDataFrame([(1, None, 1.0, 1.0)], POINT)
    assert neighbours.nearest(none, source).count() == 0 and neighbours.nearest(source, none).count() == 0


@pytest.mark.parametrize("small", [300_000, 10_000])
def test_a_far_point_costs_nothing(spark, monkeypatch, small):
    """80,000 points against 80,000, evenly spread, with and without one target far away: broadcast, and in buckets."""
    monkeypatch.setattr(neighbours, "SMALL", small)
    monkeypatch.setattr(neighbours, "BUCKET", 5_000)
    unit = lambda seed: [((F.xxhash64("pid", F.lit(f"{seed}{c}")) % 1_000_000) / 2e6 + 0.5).alias(c) for c in "xyz"]
    source, target = (spark.range(80_000).withColumnRenamed("id", "pid").select("pid", *unit(s)) for s in "st")
    far = target.withColumn("x", F.when(F.col("pid") == 79_999, 1e6).otherwise(F.col("x")))
    took = []
    for cloud_ in (target, target, far):
        began = time.time()
        row = neighbours.nearest(source, cloud_).agg(F.count("*").alias("n"), F.max("d").alias("d")).first()
        took.append(time.time() - began)
        assert row["n"] == 80_000 and row["d"] < 0.2
    assert took[2] < 2 * took[1] + 3


@pytest.mark.parametrize(("n", "need"), [(0, 1), (1, 3), (700, 1), (700, 5)])
def test_the_tree_equals_brute_force(n, need):
    rng = np.random.default_rng(n + need)
    points = np.concatenate([rng.integers(0, 4, (n // 2, 3)).astype(float), rng.normal(0, 1, (n - n // 2, 3))])
    ids = rng.permutation(n).astype(np.int64)
    queries = np.concatenate([rng.integers(-1, 5, (60, 3)).astype(float), rng.normal(0, 2, (60, 3)), [[1e9, 0, 0]]])
    d2, other = kdtree.KdTree(points, ids, need).nearest(queries)
    for q, d, o in zip(queries, d2, other, strict=True):
        want = sorted((float(((q - p) ** 2).sum()), int(i)) for p, i in zip(points, ids, strict=True))[:need]
        assert [x for x in o.tolist() if x != kdtree.NONE] == [i for _, i in want]
        assert np.allclose(d[: len(want)], [x for x, _ in want])


def test_visits_miss_no_bucket():
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (2_000, 3))
    tree = neighbours.planes(points[:300], 5)
    bucket = tree.bucket(points)
    assert np.bincount(bucket, minlength=32).max() < 250
    own = [points[bucket == k] for k in range(32)]
    boxes = neighbours.Boxes.of(5, np.arange(32), np.array([p.min(axis=0) for p in own]), np.array([p.max(axis=0) for p in own]), np.array([len(p) for p in own]))
    queries = rng.normal(0, 1.5, (200, 3))
    home = tree.bucket(queries)
    for need, bound in ((1, np.full(200, np.inf)), (3, np.full(200, np.inf)), (1, rng.uniform(0, 1, 200))):
        rows, buckets, _ = boxes.visits(queries, home, bound, need)
        seen = set(zip(rows.tolist(), buckets.tolist(), strict=True))
        for i, q in enumerate(queries):
            d2 = ((points - q) ** 2).sum(axis=1)
            wanted = d2.argsort()[:need] if np.isinf(bound[i]) else np.flatnonzero(d2 <= bound[i])[:1]
            assert all((i, int(bucket[j])) in seen or bucket[j] == home[i] or d2[j] > bound[i] for j in wanted)
        assert len(seen) < 200 * 31
