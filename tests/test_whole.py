"""Queries over whole tables, held against plain rules."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import gates
from cairn.plans import bindings, ranking
from cairn.plans.queries import QUERIES


@pytest.fixture(scope="module")
def tables(small):
    return lambda columns, name: duckdb.sql(f"SELECT {columns} FROM '{small}/{name}.parquet'").fetchall()


def test_the_whole_graph_is_read(spark, small, tables):
    edges, ids = tables("l_partkey, l_suppkey", "lineitem"), {r[0] for r in tables("p_partkey", "part")}
    root = {n: n for n in ids.union(*edges)}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        u, v = sorted((find(a), find(b)))
        root[v] = u
    assert {(r["id"], r["component"]) for r in QUERIES["graph_components"](spark, small).collect()} == {(n, find(n)) for n in ids}
    proper = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    loops = sum(a == b for a, b in edges)
    want = {"vertices": len(ids), "isolated": len(ids - set().union(*proper)), "edges": len(edges), "self_loops": loops, "duplicates": len(edges) - loops - len(proper), "missing": len(set().union(*edges) - ids)}
    assert QUERIES["graph_summary"](spark, small).first().asDict() == want


def test_every_order_line_is_a_box(spark, small, tables):
    cols = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag"
    frames, pairs = {}, {}
    for line in sorted(tables(cols, "lineitem")):
        frames.setdefault(line[0], []).append(line)
    for frame, lines in frames.items():
        for i, r in enumerate(lines, 1):
            for j, e in enumerate(lines, 1):
                if r[8] == e[8]:
                    gaps = abs(r[4] - e[4] - 40 * e[7]), 5 * abs(r[1] - e[1]), 100 * abs(r[6] - e[6])
                    both = max(4 - gaps[0], 0) * max(4 - gaps[1], 0) * max(4 - gaps[2], 0)
                    pairs[frame, r[8], i, j] = both / (128 - both)
    got = {tuple(r)[:4]: r["iou"] for r in QUERIES["oriented_box_iou"](spark, small).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[k] - v) < 2e-6 for k, v in pairs.items())
    near = {tuple(r)[:4] for r in QUERIES["box_pairs"](spark, small).collect()}
    assert near >= {k for k, v in pairs.items() if v > 0.1 + 1e-9} and near <= {k for k, v in pairs.items() if v > 0.1 - 1e-9}
    lines = sum(frames.values(), [])
    assert tuple(QUERIES["sequence_counts"](spark, small).first()) == (len(frames), len(lines), len({x[3] for x in lines}))
    assert sum(r["n_ref"] for r in QUERIES["average_precision"](spark, small).collect()) == len(lines)
    assert sum(r["n_ref"] for r in QUERIES["detection_scores"](spark, small).collect()) == len(lines)
    assert QUERIES["tracking_scores"](spark, small).first()["n_ref"] == len(lines)


def test_fronts_have_no_end(spark):
    chain = spark.createDataFrame([(i, float(i), float(-i)) for i in range(1_200)], "name long, size double, auc double")
    assert sorted((r["name"], r["front"]) for r in gates.pareto_fronts(chain, "size", "auc", block=500).collect()) == [(i, i + 1) for i in range(1_200)]


def test_fronts_equal_peeling(spark):
    rng = random.Random(7)
    rows = [(i, float(rng.randint(0, 15)), float(rng.randint(0, 15))) for i in range(300)] + [(300, None, 1.0), (301, 1.0, None), (302, 3.0, float("-inf"))]
    want, left, k = {}, [r for r in rows if None not in r], 0
    while left:
        k += 1
        front = [a for a in left if not any((b[1] < a[1] and b[2] >= a[2]) or (b[1] <= a[1] and b[2] > a[2]) for b in left)]
        want |= {a[0]: k for a in front}
        left = [a for a in left if a not in front]
    items = spark.createDataFrame(rows, "name long, size double, auc double")
    for block in (40, 1_000):
        out = gates.pareto_fronts(items, "size", "auc", block=block)
        assert out.columns == ["name", "size", "auc", "front"]
        assert {r["name"]: r["front"] for r in out.collect()} == want
    assert gates.pareto_fronts(items.limit(0), "size", "auc").count() == 0


def test_every_failing_run_has_a_front(spark, small):
    runs = QUERIES["triage"](spark, small).select("run")
    assert {r["run"] for r in QUERIES["pareto_fronts"](spark, small).collect()} == {r["run"] for r in runs.collect()}


def test_every_event_has_a_normal(spark, small, tables):
    assert {r["pid"] for r in QUERIES["surface_normals"](spark, small).select("pid").collect()} == {r[0] for r in tables("event_id", "events")}


def test_a_hot_key_is_cut_into_ranges(spark):
    hot = spark.range(40_000).select(F.lit(7).alias("key"), F.col("id").alias("pid"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranking.ranges(hot, "key", "pid").groupBy("__r").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 20_000
    assert ranking.ranked(hot, "key", ["pid"]).filter("rank <> pid").count() == 0


def test_quantiles_equal_percentile(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([float(rng.randint(0, 5)), rng.gauss(0, 3), None])) for g in ("a", "b", None) for _ in range(rng.randint(90, 120))]
    df, at = spark.createDataFrame(rows, "g string, v double"), [0.0, 0.01, 1 / 3, 0.5, 0.99, 1.0]
    for by in (["g"], []):
        got = {tuple(r)[:-1]: r["p"] for r in ranking.quantiles(df, "v", at, by).collect()}
        want = {tuple(r)[:-1]: r["p"] for r in df.groupBy(*by).agg(F.percentile("v", at).alias("p")).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert ranking.quantiles(df.limit(0), "v", at).first()["p"] == [None] * len(at)


def _cloud(frame):
    df = frame.toPandas()
    return df, df[["x", "y", "z"]].to_numpy(float)


def _voxels(x, size):
    out: dict = {}
    for k, key in enumerate(map(tuple, np.floor(x / size).astype(int).tolist())):
        out.setdefault(key, []).append(k)
    return out


def test_plane_patches_of_the_whole_table(spark, small):
    _, x = _cloud(bindings.dense_cloud(spark, small))
    want = {}
    for key, own in _voxels(x, 4.0).items():
        if len(own) >= 12:
            w = np.linalg.eigvalsh(np.cov(x[own].T))
            flat = (w[1] - w[0]) / w[2] if w[2] > 0 else 0.0
            if flat >= 0.1:
                want[key] = (len(own), flat)
    got = {(r["vx"], r["vy"], r["vz"]): (r["n"], r["planarity"]) for r in QUERIES["plane_patches"](spark, small).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and got[k][1] == pytest.approx(f, abs=1e-4) for k, (n, f) in want.items())


def test_normals_of_the_whole_table(spark, small):
    """Each normal is a direction in which its point's ten neighbours vary least."""
    df, x = _cloud(bindings.events_cloud(spark, small))
    ids = df["pid"].to_numpy()
    place = {i: k for k, i in enumerate(ids.tolist())}
    rows = QUERIES["surface_normals"](spark, small).collect()
    assert len(rows) == len(x)
    for r in rows[::7]:
        d2 = ((x - x[place[r["pid"]]]) ** 2).sum(axis=1)
        near = np.lexsort((ids, np.sqrt(d2)))[:10]
        cov, n = np.cov(x[near].T, ddof=0), np.array([r["nx"], r["ny"], r["nz"]])
        w = np.linalg.eigvalsh(cov)
        assert np.linalg.norm(n) == pytest.approx(1, abs=2e-3) and n @ cov @ n <= w[0] + 4e-3 * w[2] + 1e-9
        assert r["nz"] >= 0


def test_voxel_distances_of_the_whole_table(spark, small):
    df, x = _cloud(bindings.dense_cloud(spark, small))
    ref = df["ref_ground"].to_numpy(bool)

    def root(m):
        w, q = np.linalg.eigh(m)
        return (q * np.sqrt(np.maximum(w, 1e-6))) @ q.T

    def stats(side):
        own = x[side]
        return {k: (own[v].mean(axis=0), np.cov(own[v].T)) for k, v in _voxels(own, 10.0).items() if len(v) >= 20}

    a, b, distances = stats(ref), stats(~ref), {}
    for key in a.keys() & b.keys():
        (ma, ca), (mb, cb) = a[key], b[key]
        full = lambda m: root(m) @ root(m)
        square = ((ma - mb) ** 2).sum() + np.trace(full(ca) + full(cb) - 2 * root(root(ca) @ full(cb) @ root(ca)))
        distances[key] = np.sqrt(max(square, 0.0))
    scores = []
    for key in distances:
        near = [w for k, w in distances.items() if k != key and max(abs(i - j) for i, j in zip(k, key, strict=True)) <= 5]
        if near:
            scores.append(np.std(near) / np.mean(near) if np.mean(near) > 0 else 0.0)
    r = QUERIES["voxel_wasserstein"](spark, small).first()
    assert r["n_awd"] == len(distances) > 0 and r["awd"] == pytest.approx(np.mean(list(distances.values())), abs=2e-4)
    assert r["n_scs"] == len(scores) and r["scs"] == pytest.approx(np.mean(scores), abs=2e-4)
