"""What SQL does not check of planes, clusters, images, sweeps, registration and suites: brute force and known answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cairn.operators import align, boxes, graph, images, points, structure, suite, trajectory
from tests.test_operators import BOX, box

POINT = "pid long, x double, y double, z double"


def test_clusters_equal_plain_flooding(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), *(rng.gauss(c, 0.4) for c in rng.choice([(0, 0, 0), (3, 0, 0), (0, 4, 1)]))) for k in range(150)] + [(200, "a", 50.0, 0.0, 0.0)]
    got = {(r["label"], r["rank"]): r for r in boxes.clusters(spark.createDataFrame(rows, "pid long, label string, x double, y double, z double"), 0.5, 5).collect()}
    want = {}
    for label in "ab":
        own = {r[0]: r[2:] for r in rows if r[1] == label}
        near = {i: [j for j in own if math.dist(own[i], own[j]) <= 0.5] for i in own}
        cores, seen, found = {i for i in own if len(near[i]) >= 5}, set(), []
        for i in sorted(cores):
            if i not in seen:
                group, todo = set(), [i]
                while todo:
                    k = todo.pop()
                    if k not in group:
                        group.add(k)
                        todo += [j for j in near[k] if j in cores]
                seen |= group
                found.append((i, group))
        of = {k: i for i, g in found for k in g}
        members = {i: set(g) for i, g in found}
        for i in own:
            if i not in cores and (mine := [j for j in near[i] if j in cores]):
                members[of[min(mine)]].add(i)
        for rank, (_, g) in enumerate(sorted(members.items(), key=lambda m: (-len(m[1]), m[0])), 1):
            want[label, rank] = (len(g), *[max(max(own[k][c] for k in g) - min(own[k][c] for k in g), 0.15) for c in range(3)])
    assert got.keys() == want.keys()
    assert all((got[k]["n"], *[got[k][f"s{c}"] for c in "xyz"]) == pytest.approx(v) for k, v in want.items())


def test_planes_of_alike_normals(spark):
    """Two parallel floors, one of them in two patches with normals either way round, and a wall."""
    rows = [(1, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 2.0), (2, 0.0, 0.0, -1.0, 3.0, 0.0, 0.1, 2.0), (3, 0.0, 0.0, 1.0, 0.0, 0.0, 5.0, 1.0), (4, 1.0, 0.0, 0.0, 9.0, 9.0, 9.0, 1.0)]
    patches = spark.createDataFrame(rows, "id long, nx double, ny double, nz double, mx double, my double, mz double, weight double")
    assert {tuple(r) for r in structure.normal_edges(patches).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {tuple(r) for r in structure.normal_edges(patches, apart=0.2).collect()} == {(1, 2)}
    got = structure.plane_consistency(patches).first()
    assert (got["patches"], got["normal_groups"], got["coplanar_groups"]) == (4, 2, 1)
    assert abs(got["normal_dispersion"]) < 1e-9 and abs(got["offset_rmse"] - 0.05) < 1e-9
    assert structure.plane_consistency(patches.limit(1)).first()["normal_dispersion"] is None


def test_normal_edges_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    n = rng.normal(size=(120, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    rows = [(k, *map(float, v), *map(float, rng.normal(size=3)), 1.0) for k, v in enumerate(n)]
    df = spark.createDataFrame(rows, "id long, nx double, ny double, nz double, mx double, my double, mz double, weight double")
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if abs(n[a] @ n[b]) >= math.cos(math.radians(20))}
    assert {tuple(r) for r in structure.normal_edges(df, 20.0).collect()} == want


def test_image_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    a = rng.random((4, 9, 7))
    b = np.clip(a + rng.normal(0, 0.1, a.shape), 0, 1)
    b[1], b[2], a[3] = a[1], 0.5, 0.25
    b[3] = 0.5
    rows = [(k, a[k].ravel().tolist(), b[k].ravel().tolist()) for k in range(4)] + [(9, [0.0], [0.0])]
    got = {r["k"]: r for r in images.compared(spark.createDataFrame(rows, "k int, a array<double>, b array<double>"), "k", 9, 7).collect()}
    assert got.keys() == {0, 1, 2, 3}
    mirror = lambda i, n: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
    w = [math.exp(-0.5 * (k / 1.5) ** 2) for k in range(-5, 6)]
    w = [x / sum(w) for x in w]

    def blur(x):
        rows_ = [[sum(w[k + 5] * x[mirror(i + k, 9)][j] for k in range(-5, 6)) for j in range(7)] for i in range(9)]
        return np.array([[sum(w[k + 5] * rows_[i][mirror(j + k, 7)] for k in range(-5, 6)) for j in range(7)] for i in range(9)])

    for k in range(4):
        ma, mb = blur(a[k]), blur(b[k])
        va, vb, c = blur(a[k] ** 2) - ma**2, blur(b[k] ** 2) - mb**2, blur(a[k] * b[k]) - ma * mb
        ssim = ((2 * ma * mb + 1e-4) * (2 * c + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4))).mean()
        assert abs(got[k]["ssim"] - ssim) < 1e-9
    assert got[1]["fcm"] == 0 and got[1]["ssim"] == pytest.approx(1)
    kernel = lambda i, j: (i * i + j * j - 2) * math.exp(-(i * i + j * j) / 2)
    at = lambda x, i, j: x[i][j] if 0 <= i < 9 and 0 <= j < 7 else 0.0
    edge = lambda x: np.array([[sum(kernel(u, v) * at(x, i + u, j + v) for u in range(-2, 3) for v in range(-2, 3)) for j in range(7)] for i in range(9)])
    for k in (0, 2, 3):
        ea, eb = edge(a[k]), edge(b[k])
        assert abs(got[k]["fcm"] - min(1, np.linalg.norm(ea - eb) / np.linalg.norm(eb))) < 1e-9


def test_sweep_is_made_of_single_thresholds(spark):
    rng = random.Random(1)
    ref = spark.createDataFrame([box(f, i, 3 * i, rng.choice("ab")) for f in range(6) for i in range(3)], BOX)
    est = spark.createDataFrame([box(f, i, 3 * i + rng.uniform(0, 1.2), rng.choice("ab"), rng.random()) for f in range(6) for i in range(3)], BOX)
    got = boxes.detection_sweep(ref, est, (0.25, 0.5))
    one = {t: boxes.detection(ref, est, t).collect() for t in (0.25, 0.5)}
    ap = [sum(r["ap"] for r in boxes.average_precision(ref, est, t).collect()) / 2 for t in (0.25, 0.5)]
    tp, fp, fn = (sum(r[c] for r in one[0.5]) for c in ("tp", "fp", "fn"))
    row = got.first()
    assert row["mean_ap"] == pytest.approx(sum(ap) / 2) and row["precision"] == pytest.approx(tp / (tp + fp)) and row["recall"] == pytest.approx(tp / (tp + fn)) and row["best_threshold"] == 0.25


def test_meshes_give_points_on_their_triangles(spark):
    rows = [(1, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0, 0.0), (2, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    mesh = spark.createDataFrame(rows, "pid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    got = points.mesh_samples(mesh, 1700).collect()
    count = {k: sum(r["pid"] == k for r in got) for k in (1, 2, 3)}
    assert count[3] == 0 and abs(count[1] - 1600) <= 1 and abs(count[2] - 100) <= 1
    assert all(r["x"] >= 0 and r["y"] >= 0 and r["x"] + r["y"] <= (4 if r["pid"] == 1 else 1) + 1e-9 and abs(r["z"] - (r["pid"] == 2)) < 1e-9 for r in got)
    assert abs(sum(r["x"] for r in got if r["pid"] == 1) / count[1] - 4 / 3) < 0.1
    assert points.adapted(mesh, "mesh", 0.5, 200).first()["filters"] == "triangles:200,voxels:0.5"


def test_poses_from_matrices_turn_like_them(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        q = rng.normal(size=4) if k else np.array([0.0, 1.0, 0.0, 0.0])
        w, x, y, z = q / np.linalg.norm(q)
        r = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 1.0], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2.0], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y), 3.0]]
        rows.append((1, k, [float(v) for row in r for v in row]))
    lines = spark.createDataFrame([*rows, (1, 99, [1.0])], "run int, idx long, v array<double>")
    poses = trajectory.from_rows(lines, 10.0, ["run"])
    assert poses.count() == 60
    scans = spark.createDataFrame([(k, 0.3, -1.2, 2.5) for k in range(60)], "scan_id long, x double, y double, z double")
    named = poses.selectExpr("bigint(round(t * 10)) AS scan_id", "x AS tx", "y AS ty", "z AS tz", "qx", "qy", "qz", "qw")
    got = {r["scan_id"]: r for r in points.placed_scans(scans, named).collect()}
    for _, k, v in rows:
        want = np.array(v).reshape(3, 4) @ [0.3, -1.2, 2.5, 1.0]
        assert [got[k][c] for c in "xyz"] == pytest.approx(want.tolist(), abs=1e-9)


def test_suite_says_what_is_wrong(spark):
    checks = spark.createDataFrame([("a", "k", "error", False), ("b", "k", "warn", False), ("c", "other", "error", False), ("d", "k", "error", True)], "check_id string, kind string, severity string, skipped boolean")
    allowed = spark.createDataFrame([("k", "min_auc"), ("k", "max_chamfer")], "kind string, key string")
    defaults = spark.createDataFrame([("min_auc", "0.5"), ("max_chamfer", "word")], "key string, value string")
    own = spark.createDataFrame([("b", "max_chamfer", "0.1"), ("a", "min_auc", None)], "check_id string, key string, value string")
    effective = suite.effective_gates(checks, defaults, own, allowed)
    assert sorted((r["check_id"], r["key"], r["threshold"]) for r in effective.collect()) == [("b", "max_chamfer", 0.1), ("b", "min_auc", 0.5), ("d", "min_auc", 0.5)]
    metrics = spark.createDataFrame([("b", "auc", 0.4), ("b", "chamfer", float("nan"))], "check_id string, metric string, value double")
    got = {r["check_id"]: (r["status"], r["reasons"]) for r in suite.run_suite(checks, metrics, effective).collect()}
    assert got == {"a": ("info", ""), "b": ("warn", "auc under min_auc; chamfer unavailable"), "c": ("info", ""), "d": ("skip", "")}
    with pytest.raises(ValueError):
        suite.effective_gates(checks, spark.createDataFrame([("min_nothing", "1")], "key string, value string"), own, allowed)
    with pytest.raises(ValueError):
        suite.history_series(spark.createDataFrame([("x", 1, 0.1), ("y", 2, 0.2)], "kind string, at int, auc double"), "kind", "at", ["auc"])
    with pytest.raises(ValueError):
        suite.decide(checks, "kind", "check_id", "none")


def test_sessions_name_their_problems(spark):
    row = spark.createDataFrame([(4, 2, 0, 1, 0, 2)], "vertices long, components long, missing long, isolated long, duplicates long, edges long")
    poses = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "t double, x double")
    assert {(r["level"], r["problem"]) for r in graph.session(row, poses, 3).collect()} == {("error", "several components"), ("warning", "isolated vertices"), ("warning", "fewer key frames than vertices"), ("error", "poses share a time")}


def test_registration_in_stages(spark):
    """Three scans of one room, each a little farther on, end in one map."""
    rng = np.random.default_rng(7)
    room = rng.uniform(0, 6, (90, 3))
    scans = [spark.createDataFrame([(100 * k + i, *map(float, p - np.array([0.05 * k, 0, 0]))) for i, p in enumerate(room)], POINT) for k in range(3)]
    whole, moves = align.merged(scans, 1.0, steps=6)
    assert whole.count() == 270 and [round(m[0][3], 3) for m in moves] == [0.0, 0.05, 0.1]


def test_generalized_icp_slides_along_surfaces(spark):
    """Two samplings of the same three walls, a little apart: points have no exact partners, surfaces have."""
    rng = np.random.default_rng(11)

    def walls(n):
        u, v = rng.uniform(0, 4, (2, n))
        zero = np.zeros(n)
        return np.concatenate([np.stack([u, v, zero], axis=1), np.stack([u, zero, v], axis=1), np.stack([zero, u, v], axis=1)])

    a, b, shift = walls(250), walls(250), np.array([0.08, -0.05, 0.06])
    source = spark.createDataFrame([(k, *map(float, p - shift)) for k, p in enumerate(a)], POINT)
    target = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(b)], POINT)
    matrix, share, _ = align.gicp(source, target, 1.0, steps=5)
    assert share == 1.0 and np.abs(np.array(matrix)[:3, 3] - shift).max() < 0.02
