"""Configurations, metrics by path, diagnosis, dispatch and batches against plain versions; joins in time by ranges."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import boxes, dispatch, evaluate, structure, summaries, trajectory
from cairn.plans import ranking
from cairn.sources import configs
from tests.test_operators import BOX, box


def docs(spark, *rows):
    return summaries.parsed(spark.createDataFrame([(f"/conf/suite{k}.json", x if isinstance(x, str) or x is None else json.dumps(x)) for k, x in enumerate(rows)], "path string, doc string"))


GOOD = {"kind": "map", "source": "a.ply", "reference": "/abs/../r.ply"}


@pytest.mark.parametrize(
    ("doc", "want"),
    [
        (None, [(None, "not a document")]),
        ("{", [(None, "not a document")]),
        ("null", [(None, "empty"), (None, "checks must be a list")][:1]),
        ("[1]", [(None, "config must be a mapping")]),
        ({"checks": []}, [(None, "checks must contain at least one item")]),
        ({"checks": 5}, [(None, "checks must be a list")]),
        ({"version": 3, "checks": [GOOD]}, [(None, "unsupported version")]),
        ({"version": "1", "checks": [GOOD]}, [(None, "unsupported version")]),
        ({"version": 1, "checks": [GOOD]}, []),
        ({"checks": [GOOD, 7, {"kind": " "}, {"kind": "other"}]}, [(1, "check must be a mapping"), (2, "check.kind must be a non-empty string"), (3, "unsupported check.kind")]),
        ({"checks": [GOOD | {"id": " ", "alignment": "up", "severity": "loud", "recursive": 1, "thresholds": []}]}, [(0, "id must be a non-empty string"), (0, "alignment must be one of: none, origin, rigid"), (0, "severity is unknown"), (0, "recursive must be true or false"), (0, "thresholds must be a non-empty list of numbers")]),
        ({"checks": [GOOD | {"thresholds": ["x"], "gate": 3}]}, [(0, "thresholds must be a non-empty list of numbers"), (0, "gate must be a mapping")]),
        ({"defaults": {"gate": {"min_ate": 1}}, "checks": [GOOD]}, [(0, "unsupported gate key: min_ate")]),
        ({"checks": [GOOD | {"gate": {"min_auc": "x", "max_chamfer": None, "voxel_size": 0, "max_ate": "unused here", "severity": "warn"}}]}, [(0, "gate.min_auc must be a number"), (0, "gate.voxel_size must be > 0")]),
        ({"checks": [{"kind": "loop-closure", "before": "b", "reference": "r", "gate": {"require_posegraph_ok": 1}}]}, [(0, "gate.require_posegraph_ok must be true or false"), (0, "check.after_map is missing")]),
        ({"checks": [{"kind": "run", "map": 3, "map_reference": " ", "trajectory": "t"}]}, [(0, "check.map must be a non-empty string"), (0, "check.map_reference must be a non-empty string"), (0, "check.trajectory_reference is missing")]),
    ],
)
def test_each_fault_has_its_row(spark, doc, want):
    got = [(r["at"], r["problem"]) for r in configs.problems(docs(spark, doc)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_configurations_as_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"defaults": {"gate": {"min_auc": 0.5, "severity": "soft-fail"}, "thresholds": [0.5, 0.1], "recursive": True}, "checks": [GOOD | {"gate": {"min_auc": None, "max_chamfer": "0.25"}}, {"kind": "object_tracking", "name": "t", "estimated": "../e/./x.json", "reference": "s3://b/r.json", "severity": "warn", "gate": {"min_mota": 0.3}}]}))
    (tmp_path / "b.yaml").write_text("checks:\n  - kind: trajectory\n    id: y\n    source: s.tum\n    reference: r.tum\n    max_time_delta: 0.2\n    alignment: Rigid\n")
    found = configs.load(spark, str(tmp_path))
    rows = {r["check_id"]: r for r in configs.checks(found).collect()}
    assert set(rows) == {"artifact-1", "t", "y"}
    assert (rows["artifact-1"]["severity"], rows["artifact-1"]["thresholds"], rows["artifact-1"]["recursive"], rows["artifact-1"]["max_time_delta"]) == ("soft_fail", [0.1, 0.5], True, 0.05)
    assert (rows["t"]["severity"], rows["t"]["thresholds"], rows["y"]["alignment"], rows["y"]["max_time_delta"]) == ("warn", None, "rigid", 0.2)
    gates = {(r["check_id"], r["key"]): r["threshold"] for r in configs.gates(found).collect()}
    assert gates == {("artifact-1", "max_chamfer"): 0.25, ("t", "min_mota"): 0.3}
    paths = {(r["check_id"], r["input"]): r["value"] for r in configs.inputs(found).collect()}
    folder, above = str(tmp_path), str(tmp_path.parent)
    assert paths == {("artifact-1", "source"): f"file:{folder}/a.ply", ("artifact-1", "reference"): "/r.ply", ("t", "source"): f"file:{above}/e/x.json", ("t", "reference"): "s3://b/r.json", ("y", "source"): f"file:{folder}/s.tum", ("y", "reference"): f"file:{folder}/r.tum"}
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(ValueError, match="c.json: checks must be a list"):
        configs.load(spark, str(tmp_path))


def test_metrics_by_path(spark):
    run = {"map": {"auc": 0.5, "best_f1": {"f1": True}, "chamfer_distance": "0.2"}, "trajectory": {"ate": {"rmse": 3}, "drift": 4}}
    got = {(r["id"], r["metric"]): r["value"] for r in summaries.run_metrics(summaries.parsed(spark.createDataFrame([(1, json.dumps(run)), (2, "{"), (3, None)], "id int, doc string"))).collect()}
    assert got == {(1, "map.auc"): 0.5, (1, "map.best_f1.f1"): 1.0, (1, "trajectory.ate.rmse"): 3.0}
    suite = {"checks": [
        {"id": "a", "kind": "artifact", "passed": True, "summary": {"auc": 0.5, "chamfer_distance": 1, "awd_m": None}, "result": {"quality_gate": {"min_auc": 0.4, "passed": True, "max_chamfer": None}}},
        {"check_id": "b", "kind": "trajectory_batch", "result": [{"ate": {"rmse": 1}, "coverage_ratio": 0.5}, {"ate": {"rmse": 2}}], "summary": {"quality_gate": {"max_ate": 3}}},
        {"kind": "artifact", "summary": {"auc": 1}}, 5, {"id": "a", "kind": "trajectory", "summary": {"ate_rmse": 7, "auc": 1}},
    ]}
    checks = summaries.checks_of(summaries.parsed(spark.createDataFrame([(1, json.dumps(suite)), (2, "{}")], "id int, doc string")))
    assert {(r["check_id"], r["kind"], r["passed"]) for r in checks.collect()} == {("a", "trajectory", False), ("b", "trajectory_batch", False)}
    first = summaries.checks_of(summaries.parsed(spark.createDataFrame([(1, json.dumps({"checks": suite["checks"][:3]}))], "id int, doc string")))
    got = {(r["check_id"], r["metric"]): r["value"] for r in summaries.check_metrics(first).collect()}
    assert got == {("a", "auc"): 0.5, ("a", "chamfer"): 1.0, ("b", "ate"): 1.5, ("b", "coverage"): None, ("b", "rpe"): None, ("b", "drift"): None}
    assert {(r["check_id"], r["key"], r["threshold"]) for r in summaries.check_gates(first).collect()} == {("a", "min_auc", 0.4), ("b", "max_ate", 3.0)}
    assert {(r["check_id"], r["metric"], r["value"]) for r in summaries.history_metrics(first).collect()} == {("a", "auc", 0.5), ("a", "chamfer_distance", 1.0), ("b", None, None)}


def test_reasons_and_missing_signals(spark):
    frames = spark.createDataFrame([(1, True, None, False, 1.23456, 0.5), (2, False, None, True, None, None)], "frame int, failed boolean, error string, low_quality boolean, rmse double, rejection double")
    got = {r["frame"]: r["reasons"] for r in summaries.reasons(frames).collect()}
    assert got == {1: ["scan_match_failed:unknown", "rmse=1.235", "rejection=0.5"], 2: ["low_quality:unknown"]}
    told = {r["frame"]: (r["label"], r["confidence"], r["secondary"]) for r in summaries.diagnosed(frames.withColumn("low_quality", F.col("low_quality").cast("int"))).collect()}
    assert told == {1: ("needs_review", "low", []), 2: ("scan_quality_issue", "high", [])}


def test_joins_in_time_by_ranges(spark):
    rng = random.Random(6)
    left = [(rng.choice("ab"), k, float(rng.randint(0, 400))) for k in range(300)] + [("c", 999, 1.0)]
    right = [(rng.choice("abd"), float(t), t) for t in rng.sample(range(400), 120)]
    got = ranking.brackets(spark.createDataFrame(left, "g string, k int, t double"), spark.createDataFrame(right, "g string, t double, v int"), ["g"], "t", ["t", "v"]).collect()
    assert len(got) == len(left)
    for r in got:
        own = sorted(v for g, _, v in right if g == r["g"])
        before, after = [v for v in own if v < r["ref"]["t"]], [v for v in own if v >= r["ref"]["t"]]
        assert (r["p"] and r["p"]["v"]) == (before[-1] if before else None) and (r["q"] and r["q"]["v"]) == (after[0] if after else None)
    order = [(g, t, v) for g, t, v in right]
    for r in ranking.beside(spark.createDataFrame(order, "g string, t double, v int"), ["g"], ["t"], ["v"]).collect():
        own = sorted(v for g, _, v in right if g == r["g"])
        i = own.index(r["v"])
        assert (r["before"] and r["before"]["v"]) == (own[i - 1] if i else None) and (r["after"] and r["after"]["v"]) == (own[i + 1] if i + 1 < len(own) else None)


def test_a_long_trajectory_is_many_tasks(spark):
    """One trajectory of 300,000 poses: no range holds more than its share, and the nearest pose is exact."""
    poses = spark.range(300_000).selectExpr("'one' AS run", "CAST(id AS DOUBLE) AS t", "CAST(id % 7 AS DOUBLE) AS x", "0.0 AS y", "0.0 AS z").repartition(4)
    frames = spark.range(20_000).selectExpr("'one' AS run", "id AS frame", "id * 15.5 - 100 AS t")
    got = trajectory.nearest_pose(frames, poses, ["run"])
    assert got.count() == 20_000
    for r in got.sample(0.02, 3).collect():
        t = r["frame"] * 15.5 - 100
        assert r["pose"] == min(max(math.ceil(t - 0.5), 0), 299_999) and abs(r["dt"] - abs(t - r["pose"])) < 1e-9
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in ranking.ranges(poses, "run", "t").groupBy("__r").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sizes) == 4 and max(sizes) < 150_000
    assert trajectory.nearest_pose(frames, poses.limit(0), ["run"]).count() == 0


def test_distance_decimation_equals_the_plain_pass(spark):
    rng = random.Random(8)
    rows = [(run, float(k), *(rng.gauss(0, 1) * (k % 5 == 0) for _ in range(3))) for run, n in (("a", 400), ("b", 9), ("c", 1), ("d", 60)) for k in range(n)] + [("still", float(k), 1.0, 1.0, 1.0) for k in range(30)]
    got: dict = {}
    for r in trajectory.by_distance(spark.createDataFrame(rows, "run string, t double, x double, y double, z double"), 20, ["run"]).collect():
        got.setdefault(r["run"], []).append(r["t"])
    for run, times in got.items():
        own = [r[1:] for r in rows if r[0] == run]
        assert len(times) <= max(20, min(20, len(own))) and {own[0][0], own[-1][0]} <= set(times)
    assert len(got["b"]) == 9 and got["c"] == [0.0]


def cloud(rng, n, shift=0.0):
    return [(k, *(rng.gauss(0, 1) + shift for _ in range(3))) for k in range(n)]


def test_batches_of_files_equal_single_runs(spark):
    rng = random.Random(2)
    reference = cloud(rng, 60)
    files = {f"f{k}": cloud(rng, 20 + 10 * k, 0.2 * k) for k in range(5)}
    rows = spark.createDataFrame([(n, *p) for n, ps in files.items() for p in ps], "name string, pid long, x double, y double, z double")
    sizes = spark.createDataFrame([(f"f{k}", 100 * (k < 4), 40 + 10 * k) for k in range(5)], "name string, baseline_bytes long, compressed_bytes long")
    ref = spark.createDataFrame(reference, "pid long, x double, y double, z double")
    got = {r["name"]: r for r in evaluate.batch(rows, ref, {"max_chamfer": 0.9}, sizes=sizes).collect()}
    assert set(got) == set(files)
    for name, points in files.items():
        one = evaluate.evaluate(spark.createDataFrame(points, "pid long, x double, y double, z double"), ref).first()
        r = got[name]
        assert all(r[c] == pytest.approx(one[c], abs=1e-12) for c in ("chamfer", "hausdorff", "auc", "best_f1", "best_threshold")) and r["points"] == len(points)
        assert r["passed"] == (r["chamfer"] <= 0.9)
        assert r["best"] == (not any(o["size_ratio"] <= r["size_ratio"] and o["auc"] >= r["auc"] and (o["size_ratio"], -o["auc"]) != (r["size_ratio"], -r["auc"]) for o in got.values()))
    assert got["f4"]["size_ratio"] == 0 and got["f1"]["saving"] == pytest.approx(0.5)
    fit = [r for r in got.values() if r["best"] and r["passed"]]
    assert [r["name"] for r in got.values() if r["recommended"]] == [min(fit, key=lambda r: (r["size_ratio"], -r["auc"], r["name"]))["name"]]


def test_dispatch_equals_the_operators_one_by_one(spark):
    rng = random.Random(3)
    clouds = {"m1": cloud(rng, 900), "m2": cloud(rng, 900, 0.1), "ref": cloud(rng, 900)}
    tables = spark.createDataFrame([(n, *p) for n, ps in clouds.items() for p in ps], "name string, pid long, x double, y double, z double")
    poses = spark.createDataFrame([(n, k + 0.25 * (n != "pr"), rng.gauss(k, 0.1), 0.0, 0.0) for n in ("p1", "p2", "pr") for k in range(40)], "name string, t double, x double, y double, z double")
    frame = lambda n: [(n, *r) for r in [box(f, i, 5.0 * i + (0.4 if n != "br" else 0) * (f % 3), "car" if i % 2 else "bus", track=i) for f in range(6) for i in range(4)]]
    boxed = spark.createDataFrame([r for n in ("b1", "br") for r in frame(n)], f"name string, {BOX}")
    checks = spark.createDataFrame([("a1", "artifact", "m1", "ref"), ("a2", "artifact", "m2", "ref"), ("a3", "artifact", "gone", "ref"), ("t1", "trajectory", "p1", "pr"), ("t2", "trajectory", "p2", "pr"), ("d", "detection", "b1", "br"), ("k", "tracking", "b1", "br"), ("x", "image", "i", "j")], "check_id string, kind string, source string, reference string")
    got = {(r["check_id"], r["metric"]): r["value"] for r in dispatch.metrics(checks, tables, poses, boxed, most=1.0, voxel=1.0, least=10).collect()}
    own = lambda n: tables.filter(F.col("name") == n).drop("name")
    for check, source in (("a1", "m1"), ("a2", "m2")):
        one = evaluate.evaluate(own(source), own("ref")).first()
        w = structure.consistency(structure.voxel_distances(own(source), own("ref"), 1.0, 10)).first()
        assert got[check, "auc"] == pytest.approx(one["auc"]) and got[check, "chamfer"] == pytest.approx(one["chamfer"])
        assert w["n_awd"] > 5 and got[check, "awd"] == pytest.approx(w["awd"]) and got[check, "scs"] == pytest.approx(w["scs"])
    for check, source in (("t1", "p1"), ("t2", "p2")):
        one = trajectory.evaluate(poses.filter("name = 'pr'").withColumn("name", F.lit(source)), poses.filter(F.col("name") == source), 1.0, ["name"]).first()
        assert got[check, "ate"] == pytest.approx(one["ate_rmse"]) and got[check, "coverage"] == pytest.approx(one["coverage"]) and got[check, "lateral"] == pytest.approx(one["lateral_rmse"])
    b, r = (boxed.filter(F.col("name") == n).drop("name") for n in ("b1", "br"))
    one, hits = boxes.tracking(r, b, 0.5).first(), boxes.detection(r, b, 0.5).agg(F.sum("tp"), F.sum("n_est")).first()
    assert got["k", "mota"] == pytest.approx(one["mota"]) and got["k", "id_switches"] == one["id_switches"]
    assert got["d", "precision"] == pytest.approx(hits[0] / hits[1]) and got["d", "map"] == pytest.approx(boxes.average_precision(r, b, 0.5).agg(F.avg("ap")).first()[0])
    assert not any(k[0] in ("a3", "x") for k in got)
    gates = spark.createDataFrame([(c, k, k[4:], k[:3], v) for c, k, v in (("a1", "max_awd", 1e-9), ("a2", "max_scs", 1e9), ("a3", "max_awd", 5.0), ("t1", "max_ate", 1e9), ("k", "max_id_switches", 99.0))], "check_id string, key string, metric string, side string, threshold double")
    out = {r["check_id"]: (r["status"], r["reasons"]) for r in dispatch.run_checks(checks.withColumn("severity", F.lit("fail")), gates, clouds=tables, poses=poses, boxes_=boxed, most=1.0, voxel=1.0, least=10).collect()}
    assert out["a1"] == ("fail", "awd over max_awd") and out["a2"][0] == "pass" and out["a3"] == ("fail", "awd unavailable") and out["t1"][0] == out["k"][0] == "pass" and out["x"][0] == "info"


def test_benchmarks_resolve_sequences_and_gates(spark):
    runs = spark.createDataFrame([("r1", "s", None, "m", "t"), ("r2", "s", "late", "m", "t")], "check_id string, suite string, sequence string, map string, trajectory string")
    sequences = spark.createDataFrame([("s", "early", 0, "mr0", "tr0"), ("s", "late", 1, "mr1", "tr1")], "suite string, sequence string, place int, map_reference string, trajectory_reference string")
    gate = spark.createDataFrame([("s", "min_auc", 0.5), ("s", "max_ate", 1.0)], "suite string, key string, value double")
    own = spark.createDataFrame([("r2", "min_auc", None), ("r2", "max_drift", 2.0)], "check_id string, key string, value double")
    checks, gates = dispatch.benchmark_checks(runs, sequences, gate, own)
    assert {r["check_id"]: (r["sequence"], r["map_reference"], r["kind"]) for r in checks.collect()} == {"r1": ("early", "mr0", "run"), "r2": ("late", "mr1", "run")}
    assert {(r["check_id"], r["key"], r["threshold"]) for r in gates.collect()} == {("r1", "min_auc", 0.5), ("r1", "max_ate", 1.0), ("r2", "max_ate", 1.0), ("r2", "max_drift", 2.0)}
    rng = random.Random(1)
    clouds = spark.createDataFrame([(n, *p) for n in ("m", "mr0", "mr1") for p in cloud(rng, 50)], "name string, pid long, x double, y double, z double")
    poses = spark.createDataFrame([(n, float(k), float(k), 0.0, 0.0) for n in ("t", "tr0", "tr1") for k in range(9)], "name string, t double, x double, y double, z double")
    out = {r["check_id"]: (r["gated"], r["failed"]) for r in dispatch.run_checks(checks, gates, clouds=clouds, poses=poses).collect()}
    assert out["r2"] == (2, 0) and out["r1"][0] == 2
    with pytest.raises(ValueError, match="no sequence 'none'"):
        dispatch.benchmark_checks(runs.withColumn("sequence", F.lit("none")), sequences, gate, own)




def test_boxes_of_two_kinds_are_matched_once(spark, monkeypatch):
    seen, plain = [], boxes.candidates
    monkeypatch.setattr(boxes, "candidates", lambda *a: (seen.append(1), plain(*a))[1])
    rng = random.Random(8)
    rows = {n: [box(f, i, 3 * i + shift * rng.random(), rng.choice("ab"), rng.random()) for f in range(5) for i in range(3)] for n, shift in (("r", 0), ("e", 1.5), ("g", 0.5))}
    frames = {n: spark.createDataFrame(r, BOX) for n, r in rows.items()}
    tables = frames["r"].withColumn("name", F.lit("r")).unionByName(frames["e"].withColumn("name", F.lit("e"))).unionByName(frames["g"].withColumn("name", F.lit("g")))
    checks = spark.createDataFrame([("d1", "detection", "e", "r"), ("d2", "detection", "g", "r"), ("t1", "tracking", "e", "r"), ("t2", "tracking", "g", "r"), ("t3", "tracking", "g", "r")], "check_id string, kind string, source string, reference string")
    got = {(r["check_id"], r["metric"]): r["value"] for r in dispatch.metrics(checks, boxes_=tables, threshold=0.25).collect()}
    assert len(seen) == 1
    apart = dispatch.detection_metrics(checks.filter("kind = 'detection'"), tables, 0.25).union(dispatch.tracking_metrics(checks.filter("kind = 'tracking'"), tables, 0.25))
    assert got == {(r["check_id"], r["metric"]): r["value"] for r in apart.collect()} and len(got) == 17
    seen.clear()
    boxes.detection_sweep(frames["r"], frames["e"], (0.25, 0.5, 0.75)).collect()
    assert len(seen) == 1
