"""Alignment and structure on known answers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import align, structure

CLOUD = "pid long, x double, y double, z double"


def turned(points, angle, shift):
    c, s = math.cos(angle), math.sin(angle)
    return [(k, c * x - s * y + shift[0], s * x + c * y + shift[1], z + shift[2]) for k, x, y, z in points]


def test_rigid_alignment_undoes_a_turn(spark):
    rng = np.random.default_rng(1)
    a = [(k, *map(float, rng.normal(size=3))) for k in range(30)]
    b = turned(a, 1.1, (5.0, -2.0, 1.0))
    rows = [(k % 2, *p[1:], *q[1:]) for k, (p, q) in enumerate(zip(a, b, strict=True))]
    matched = spark.createDataFrame(rows, "run int, ex double, ey double, ez double, rx double, ry double, rz double")
    assert all(r["rmse"] < 1e-9 for r in align.rmse(align.aligned(matched, ["run"]), ["run"]).collect())


def test_icp_finds_a_small_move(spark):
    rng = np.random.default_rng(2)
    a = [(k, *map(float, rng.uniform(0, 10, size=3))) for k in range(120)]
    source, target = spark.createDataFrame(a, CLOUD), spark.createDataFrame(turned(a, 0.02, (0.1, 0.05, -0.05)), CLOUD)
    matrix, share, rmse = align.icp(source, target, 2.0, steps=12)
    assert share == 1.0 and rmse < 1e-6 and abs(matrix[0][3] - 0.1) < 1e-6


def test_wasserstein_of_gaussians_on_axes():
    """Along common axes the square is that of the means' distance and of the deviations' differences."""
    a, b = np.diag([2.25, 0.25, 6.25])[None], np.diag([0.49, 1.44, 4.0])[None]
    assert abs(structure.gaussian_distance(np.array([[0.3, -0.4, 1.2]]), a, b)[0] - math.sqrt(1.69 + 0.64 + 0.49 + 0.25)) < 1e-9
    assert structure.gaussian_distance(np.zeros((1, 3)), b, b)[0] == 0


def test_planes_and_normals(spark):
    flat = spark.createDataFrame([(k, (k % 20) * 0.04, (k // 20) * 0.04, 0.5) for k in range(400)], CLOUD)
    patch = structure.plane_patches(flat).first()
    assert abs(patch["nz"] - 1) < 1e-9 and patch["planarity"] > 0.9
    assert structure.normals(flat.limit(60), 8).filter(F.abs(F.col("nz") - 1) > 1e-6).count() == 0


def overlap_by_clipping(a, b):
    """Area that two turned rectangles (cx, cy, sx, sy, yaw) share, one half-plane after the other."""

    def corners(cx, cy, sx, sy, yaw):
        c, s = math.cos(yaw), math.sin(yaw)
        return [(cx + c * u * sx / 2 - s * v * sy / 2, cy + s * u * sx / 2 + c * v * sy / 2) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))]

    shape, window = corners(*a), corners(*b)
    for k in range(4):
        (px, py), (qx, qy) = window[k], window[(k + 1) % 4]
        height = [(qx - px) * (y - py) - (qy - py) * (x - px) for x, y in shape]
        cut = []
        for i, h in enumerate(height):
            j = (i + 1) % len(shape)
            if h >= 0:
                cut.append(shape[i])
            if (h >= 0) != (height[j] >= 0):
                t = h / (h - height[j])
                cut.append((shape[i][0] + t * (shape[j][0] - shape[i][0]), shape[i][1] + t * (shape[j][1] - shape[i][1])))
        shape = cut
    return abs(sum(shape[i][0] * shape[(i + 1) % len(shape)][1] - shape[(i + 1) % len(shape)][0] * shape[i][1] for i in range(len(shape)))) / 2


def test_oriented_iou_equals_clipping(spark):
    rng = np.random.default_rng(9)
    rows = [[*rng.uniform(-2, 2, 3), *rng.uniform(0.5, 4, 3), rng.uniform(-4, 4), *rng.uniform(-2, 2, 3), *rng.uniform(0.5, 4, 3), rng.uniform(-4, 4)] for _ in range(300)]
    rows += [[0, 0, 0, 3, 1.5, 1, 0.7, 0, 0, 0, 3, 1.5, 1, 0.7], [0, 0, 0, 3, 1, 1, 0, 0, 0, 0, 3, 1, 1, math.pi], [0, 0, 0, 1, 1, 1, 0, 9, 0, 0, 1, 1, 1, 0.4], [0, 0, 0, 5, 5, 1, 0.2, 0.1, 0, 0, 1, 1, 1, 1.0], [0, 0, 0, 1, 1, 1, 0, 0, 0, 3, 1, 1, 1, 0]]
    names = [f"{s}{f}" for s in "ab" for f in ("cx", "cy", "cz", "sx", "sy", "sz", "yaw")]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} double" for n in names))
    got = {r["k"]: r["iou"] for r in structure.oriented_iou(df).collect()}
    for k, r in enumerate(rows):
        high = max(0.0, min(r[2] + r[5] / 2, r[9] + r[12] / 2) - max(r[2] - r[5] / 2, r[9] - r[12] / 2))
        both = high * overlap_by_clipping((r[0], r[1], r[3], r[4], r[6]), (r[7], r[8], r[10], r[11], r[13]))
        assert abs(got[k] - both / (r[3] * r[4] * r[5] + r[10] * r[11] * r[12] - both)) < 1e-7
    assert structure.oriented_iou(df.limit(0)).count() == 0
