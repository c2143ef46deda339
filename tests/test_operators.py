"""Known answers and brute force for what SQL does not check."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from cairn.operators import boxes, evaluate, gates, graph, ground, images, points, trajectory

BOX = "frame long, idx long, label string, cx double, cy double, cz double, sx double, sy double, sz double, score double, track long"


def box(frame, idx, cx, label="car", score=1.0, track=None, size=2.0):
    return (frame, idx, label, float(cx), 0.0, 0.0, size, size, size, score, idx if track is None else track)


def test_iou_of_shifted_boxes(spark):
    r, e = spark.createDataFrame([box(0, 0, 0)], BOX), spark.createDataFrame([box(0, 0, 0.5)], BOX)
    assert abs(boxes.candidates(r, e, 0.0).first()["iou"] - 6 / 10) < 1e-12


def test_greedy_equals_a_plain_loop(spark, monkeypatch):
    rng = random.Random(3)
    ref = [box(f, i, rng.uniform(0, 6), rng.choice("ab")) for f in range(12) for i in range(5)]
    est = [box(f, i, rng.uniform(0, 6), rng.choice("ab"), rng.random()) for f in range(12) for i in range(5)]
    pairs = boxes.candidates(spark.createDataFrame(ref, BOX), spark.createDataFrame(est, BOX), 0.1)
    expected, ap = set(), set()
    for f in range(12):
        own = [p for p in pairs.collect() if p["frame"] == f]
        for order, out in ((lambda p: (-p["iou"], -p["score"], p["ref_idx"], p["est_idx"]), expected), (lambda p: (-p["score"], p["est_idx"], -p["iou"], p["ref_idx"]), ap)):
            used = set()
            for p in sorted(own, key=order):
                if ("r", p["ref_idx"]) not in used and ("e", p["est_idx"]) not in used:
                    used |= {("r", p["ref_idx"]), ("e", p["est_idx"])}
                    out.add((f, p["ref_idx"], p["est_idx"]))
    assert {(r["frame"], r["ref_idx"], r["est_idx"]) for r in boxes.greedy(pairs).collect()} == expected
    assert {(r["frame"], r["ref_idx"], r["est_idx"]) for r in boxes.best_reference(pairs).collect()} == ap
    assert boxes.greedy(pairs.limit(0)).count() == 0
    for few in (0, 10):  # all frames by rounds; some of them
        monkeypatch.setattr(boxes, "FOLD", few)
        assert {(r["frame"], r["ref_idx"], r["est_idx"]) for r in boxes.greedy(pairs).collect()} == expected


def test_average_precision_credits_unreached_recall(spark):
    r = spark.createDataFrame([box(0, 0, 0), box(1, 0, 0)], BOX)
    assert boxes.average_precision(r, spark.createDataFrame([box(0, 0, 0)], BOX), 0.5).first()["ap"] == 1.0
    wrong_first = spark.createDataFrame([box(0, 0, 50, score=0.9), box(1, 0, 0, score=0.5)], BOX)
    assert boxes.average_precision(r, wrong_first, 0.5).first()["ap"] == 0.5


def test_average_precision_steps_one_prediction_at_a_time(spark):
    """Many equal scores over several ranges, against running lists."""
    rng = random.Random(8)
    ref = [box(f, 0, 0, label=rng.choice("ab")) for f in range(150)]
    est = [box(f, i, rng.choice([0, 0, 50]), label=ref[f][2], score=rng.choice([0.2, 0.5, 0.9])) for f in range(150) for i in range(rng.randint(0, 3))]
    got = {r["label"]: r["ap"] for r in boxes.average_precision(spark.createDataFrame(ref, BOX), spark.createDataFrame(est, BOX), 0.5).collect()}
    for label in "ab":
        n, used, hits, precision, recall = sum(r[2] == label for r in ref), set(), 0, [], []
        for k, e in enumerate(sorted((e for e in est if e[2] == label), key=lambda e: (-e[9], e[0], e[1])), 1):
            if e[3] == 0 and e[0] not in used and not any(o[0] == e[0] and o[3] == 0 and (-o[9], o[1]) < (-e[9], e[1]) for o in est):
                used.add(e[0])
                hits += 1
            precision.append(hits / k)
            recall.append(hits / n)
        envelope = [max(precision[k:]) for k in range(len(precision))]
        steps, heights = [0.0, *recall, 1.0], [envelope[0], *envelope]
        assert abs(got[label] - sum((b - a) * h for a, b, h in zip(steps, steps[1:], heights, strict=False))) < 1e-9


def test_long_trajectories_take_linear_time(spark):
    """40,000 poses of one trajectory on either side."""
    ref = spark.range(40_000).selectExpr("1L AS user_id", "id / 10.0D AS t", "id / 1.0D AS x", "0D AS y", "0D AS z")
    est = spark.range(40_000).selectExpr("1L AS user_id", "id / 10.0D + 0.05D AS t", "id / 1.0D + 0.5D AS x", "0D AS y", "0D AS z")
    out = trajectory.interpolated_join(ref, est, 0.2, ["user_id"])
    assert out.count() == 40_000 and out.filter("abs(ex - rx) > 1e-6").count() == 1  # the first pose is before all estimates


def test_tracking_counts_switches_over_gaps(spark):
    ref = spark.createDataFrame([box(f, 0, 0, track=1) for f in range(5)], BOX)
    est = spark.createDataFrame([box(0, 0, 0, track=7), box(1, 0, 0, track=7), box(2, 0, 90, track=7), box(3, 0, 0, track=8), box(4, 0, 0, track=8)], BOX)
    got = boxes.tracking(ref, est).first()
    assert (got["id_switches"], got["fragmentations"], got["mostly_tracked"], got["fn"], got["fp"]) == (1, 1, 1, 1, 1)
    assert abs(got["mota"] - (1 - 3 / 5)) < 1e-12
    assert boxes.tracking(ref, ref).first()["mota"] == 1.0


def line(spark, n, dx=0.0, dy=0.0, step=1.0):
    return spark.createDataFrame([(1, k * step, k * step + dx, dy, 0.0) for k in range(n)], "user_id long, t double, x double, y double, z double")


def test_trajectory_offsets(spark):
    along = trajectory.evaluate(line(spark, 4), line(spark, 4, dx=0.1), 0.05, ["user_id"]).first()
    assert abs(along["ate_rmse"] - 0.1) < 1e-9 and along["rpe_rmse"] < 1e-9 and along["drift"] < 1e-9 and along["lateral_rmse"] < 1e-6 and abs(along["longitudinal_rmse"] - 0.1) < 1e-9
    across = trajectory.evaluate(line(spark, 4), line(spark, 4, dy=0.2), 0.05, ["user_id"]).first()
    assert abs(across["lateral_rmse"] - 0.2) < 1e-9 and abs(across["longitudinal_rmse"]) < 1e-9
    shifted = trajectory.evaluate(line(spark, 4), line(spark, 4, dx=5.0, dy=-2.0), 0.05, ["user_id"], origin=True).first()
    assert shifted["ate_rmse"] < 1e-9


def test_interpolation_between_sparse_estimates(spark):
    matched = trajectory.interpolated_join(line(spark, 5, step=0.5), line(spark, 3), 0.5, ["user_id"])
    assert matched.count() == 5 and matched.filter("abs(ex - rx) > 1e-9").count() == 0
    # a gap with one near neighbour stays unmatched, an end is held
    est = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (1, 10.0, 10.0, 0.0, 0.0)], "user_id long, t double, x double, y double, z double")
    ref = spark.createDataFrame([(1, -0.3, 0.0, 0.0, 0.0), (1, 0.3, 0.0, 0.0, 0.0), (1, 10.2, 0.0, 0.0, 0.0)], "user_id long, t double, x double, y double, z double")
    assert sorted(r["t"] for r in trajectory.interpolated_join(ref, est, 0.5, ["user_id"]).collect()) == [-0.3, 10.2]


def test_nees_of_unit_errors(spark):
    states = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0)] * 10, "run long, x double, y double, z double, xx double, xy double, xz double, yy double, yz double, zz double")
    got = trajectory.nees(states, ["run"]).first()
    assert abs(got["mean_nees"] - 1) < 1e-12 and abs(got["normalized"] - 1 / 3) < 1e-12 and got["coverage"] == 1


def test_nearest_equals_brute_force_with_far_points(spark):
    rng = random.Random(5)
    a = [(k, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(80)] + [(80, 500.0, 0.0, 0.0)]
    b = [(k, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(60)] + [(60, -900.0, 3.0, 0.0), (61, 0.0, 0.0, 0.0), (62, 0.0, 0.0, 0.0)]
    schema = "pid long, x double, y double, z double"
    source, target = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for k in (1, 5):
        expected = {(p, r + 1): d for p, *s in a for r, d in enumerate(sorted(math.dist(s, t) for _, *t in b)[:k])}
        got = {(r["pid"], r["rank"]): r["d"] for r in points.nearest(source, target, k=k, size=0.05).collect()}
        assert got.keys() == expected.keys() and all(abs(got[x] - expected[x]) < 1e-9 for x in got)
    assert points.nearest(source, target.limit(0)).count() == 0 and points.nearest(source.limit(0), target).count() == 0
    same = points.nearest(target, target, apart=True).filter("pid IN (61, 62)").collect()
    assert all(r["d"] == 0 and r["other"] in (61, 62) and r["other"] != r["pid"] for r in same)


def test_identical_clouds_are_perfect(spark):
    cloud = spark.createDataFrame([(k, k * 0.37 % 1, k * 0.71 % 1, k * 0.13 % 1) for k in range(50)], "pid long, x double, y double, z double")
    got = evaluate.evaluate(cloud, cloud).first()
    assert got["chamfer"] == 0 and got["hausdorff"] == 0 and abs(got["auc"] - 1) < 1e-12


def test_label_transfer_of_itself(spark):
    cloud = spark.createDataFrame([(k, float(k), 0.0, 0.0, k % 2 == 0) for k in range(20)], "pid long, x double, y double, z double, ground boolean")
    got = ground.transfer_confusion(cloud, cloud).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (10, 0, 0, 10)


def test_pareto_and_recommendation(spark):
    items = spark.createDataFrame([("p", 3.0, 0.62), ("q", 7.5, 0.41), ("r", 1.25, 0.58), ("s", 6.0, 0.71), ("t", 6.0, 0.70)], "name string, size double, auc double")
    assert sorted(r["name"] for r in gates.pareto(items, "size", "auc").collect()) == ["p", "r", "s"]
    assert gates.recommended(items, "size", "auc", {"min_auc": 0.6}, ["name"]).first()["name"] == "p"
    assert gates.recommended(items, "size", "auc", {"min_auc": 2.0}, ["name"]).count() == 0
    rng = random.Random(2)
    many = [(str(k), round(rng.random(), 2), round(rng.random(), 2)) for k in range(300)]
    expected = sorted(n for n, s, a in many if not any((t < s and b >= a) or (t <= s and b > a) for _, t, b in many))
    assert sorted(r["name"] for r in gates.pareto(spark.createDataFrame(many, items.schema), "size", "auc").collect()) == expected


def test_gates_tell_unavailable_from_failed(spark):
    df = spark.createDataFrame([(0.9, 0.1), (None, 0.1), (float("nan"), 0.9)], "auc double, chamfer double")
    got = [(r["passed"], list(r["reasons"])) for r in gates.wide_gate(df, {"min_auc": 0.5, "max_chamfer": 0.2}).collect()]
    assert got[0] == (True, []) and got[1] == (False, ["auc unavailable"]) and got[2][0] is False and len(got[2][1]) == 2
    assert [r["passed"] for r in gates.wide_gate(df, {"min_auc": None}).collect()] == [None] * 3


def test_components_and_psnr(spark):
    edges = spark.createDataFrame([(0, 1), (2, 3), (3, 3)], "a long, b long")
    vertices = spark.range(5).select("id")
    assert {r["id"]: r["component"] for r in graph.components_with_isolated(vertices, edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    pixels = spark.createDataFrame([(0, 0.5, 0.3)] * 4 + [(1, 0.5, 0.5)] * 4, "image long, a double, b double")
    got = {r["image"]: r["psnr"] for r in images.psnr(pixels, ["image"]).collect()}
    assert abs(got[0] - 10 * math.log10(25)) < 1e-9 and got[1] == float("inf")


def test_ellipsoids_of_round_splats_lie_on_spheres(spark):
    splat = spark.createDataFrame([(1, 1.0, 2.0, 3.0, *[math.log(0.5)] * 3, 0.3, 0.1, 0.7, 0.2)], "pid long, x double, y double, z double, scale_0 double, scale_1 double, scale_2 double, rot_0 double, rot_1 double, rot_2 double, rot_3 double")
    got = points.ellipsoid_samples(splat, 16)
    assert got.count() == 16
    assert got.filter(F.abs(F.sqrt((F.col("x") - 1) ** 2 + (F.col("y") - 2) ** 2 + (F.col("z") - 3) ** 2) - 0.5) > 1e-9).count() == 0
