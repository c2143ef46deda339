"""Readers on small files."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pytest

from cairn.sources import clouds, runs


def test_points_from_ply_pcd_and_bin(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(clouds.ply_bytes(np.array([[1, 2, 3], [4, 5, 6], [np.nan, 0, 0]])))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n1 2 3 9\n4 5 6 9\n")
    (tmp_path / "c.pcd").write_text("VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA ascii\n7 8 9\n")
    (tmp_path / "d.bin").write_bytes(struct.pack("<8f", 1, 2, 3, 0.5, 4, 5, 6, 0.5))
    got = clouds.read_points(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["x"], r["y"], r["z"]))
    two = [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    assert {k: sorted(v) for k, v in by.items()} == {"a.ply": two, "b.ply": two, "c.pcd": [(7.0, 8.0, 9.0)], "d.bin": two}


def test_cut_short_files_are_refused():
    whole = clouds.ply_bytes(np.ones((4, 3)))
    with pytest.raises(ValueError):
        clouds.parse_ply(whole[:-5])
    with pytest.raises(ValueError):
        clouds.parse_ply(whole.replace(b"little", b"big"))


def test_csv_points_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,X_m,Y_m,Z_m\n9,1,2,3\n9,nan,2,3\n")
    (tmp_path / "b.csv").write_text("1,2,3\n4,5\n4,5,6\n")
    got = sorted((r["path"][-5:], r["x"], r["y"], r["z"]) for r in clouds.read_csv_points(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 1.0, 2.0, 3.0), ("b.csv", 1.0, 2.0, 3.0), ("b.csv", 4.0, 5.0, 6.0)]


def test_trajectories_boxes_labels_and_graphs(spark, tmp_path):
    poses = tmp_path / "p"
    poses.mkdir()
    (poses / "a.tum").write_text("# comment\n0.0 1 2 3 0 0 0 1\n0.1 2 2 3 0 0 0 1\n")
    (poses / "b.csv").write_text("x,timestamp,y,z\n5,0.5,6,7\n")
    assert sorted((r["t"], r["x"]) for r in clouds.read_trajectories(spark, str(poses)).collect()) == [(0.0, 1.0), (0.1, 2.0), (0.5, 5.0)]
    (tmp_path / "boxes.json").write_text(json.dumps({"frames": [{"id": "f0", "boxes": [{"class": "car", "position": [1, 2, 3], "extent": [4, 5, 6]}]}]}))
    b = clouds.read_boxes(spark, str(tmp_path / "boxes.json")).first()
    assert (b["frame"], b["label"], b["cx"], b["sz"], b["score"], b["yaw"]) == ("f0", "car", 1.0, 6.0, 1.0, 0.0)
    (tmp_path / "000001.txt").write_text("Car 0 0 0 0 0 0 0 1.5 1.6 4.0 2.0 1.0 10.0 0.1\nDontCare 0 0 0 0 0 0 0 1 1 1 1 1 1 1\n")
    k = clouds.read_kitti(spark, str(tmp_path / "000001.txt")).collect()
    assert len(k) == 1 and (k[0]["cx"], k[0]["cy"], k[0]["cz"], k[0]["sx"], k[0]["yaw"]) == (10.0, -2.0, -0.25, 4.0, -0.1)
    (tmp_path / "g.g2o").write_text("VERTEX_SE3:QUAT 0 0 0 0\nVERTEX_SE3:QUAT 1 0 0 0\nEDGE_SE3:QUAT 0 1 0\nEDGE_SE3:QUAT bad\n")
    v, e = clouds.read_graph(spark, str(tmp_path / "g.g2o"))
    assert v.count() == 2 and [tuple(r) for r in e.collect()] == [(0, 1)]


def test_cameras_take_what_is_there(spark, tmp_path):
    eye = [[1, 0, 0, 5], [0, 1, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1]]
    (tmp_path / "c.json").write_text(json.dumps({"w": 800, "h": 600, "camera_angle_x": 1.0, "frames": [{"file_path": "a.png", "transform_matrix": eye}, {"file_path": "b.png", "transform_matrix": eye, "fl_x": 300, "fl_y": 310, "w": 640}, {"file_path": "bad.png", "transform_matrix": [[1]]}]}))
    got = {r["file"]: r for r in runs.read_cameras(spark, str(tmp_path / "c.json")).collect()}
    assert got.keys() == {"a.png", "b.png"} and (got["a.png"]["m03"], got["a.png"]["m23"]) == (5, 7)
    assert abs(got["a.png"]["fl_x"] - 400 / math.tan(0.5)) < 1e-9 and got["a.png"]["fl_y"] == got["a.png"]["fl_x"] and got["a.png"]["cy"] == 300
    assert (got["b.png"]["fl_x"], got["b.png"]["fl_y"], got["b.png"]["cx"]) == (300, 310, 320)
    half = math.sqrt(0.5)
    (tmp_path / "images.txt").write_text(f"# list\n1 {half} 0 0 {half} 1 2 3 9 a.png\n0.5 0.5 -1\n")
    r = runs.read_image_poses(spark, str(tmp_path / "images.txt")).collect()
    # world-to-camera is a quarter turn and (1, 2, 3); its inverse takes (1, 2, 3) back to the origin
    turn = [[r[0][f"m{i}{j}"] for j in range(4)] for i in range(3)]
    assert len(r) == 1 and np.allclose(np.array(turn) @ [1, 2, 3, 1], 0) and np.allclose(np.array(turn)[:, :3] @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]]), np.eye(3))


def test_states_are_checked(spark, tmp_path):
    state = lambda t, **k: {"timestamp": t, "position": [1, 2, 3], "covariance": [[1, 0.5, 0], [0.5, 2, 0], [0, 0, 3]]} | k
    meta = {"covariance_frame": "world", "error_convention": "estimate_minus_reference"}
    write = lambda name, body: (tmp_path / name).write_text(json.dumps(body)) and str(tmp_path / name)
    got = runs.read_states(spark, write("ok.json", {"metadata": meta, "states": [state(0.0), state(1.0)]})).orderBy("t").collect()
    assert [r["t"] for r in got] == [0.0, 1.0] and (got[0]["xy"], got[0]["zz"], got[0]["frame"]) == (0.5, 3.0, "world")
    for name, body in {"order": {"metadata": meta, "states": [state(1.0), state(1.0)]}, "shape": {"metadata": meta, "states": [state(0.0, position=[1, 2])]}, "meta": {"metadata": {}, "states": [state(0.0)]}}.items():
        with pytest.raises(ValueError):
            runs.read_states(spark, write(f"{name}.json", body))


def test_scan_tables_frames_and_poses(spark, tmp_path):
    (tmp_path / "m.csv").write_text("scan_id,rmse,failed\n1,0.5,Yes\n2,bad,no\n3,,1\n")
    rows = runs.read_scan_table(spark, str(tmp_path / "m.csv"), ("rmse",), ("failed",)).orderBy("scan_id").collect()
    assert [(r["rmse"], r["failed"]) for r in rows] == [(0.5, True), (None, False), (None, True)]
    scans = tmp_path / "scans"
    scans.mkdir()
    for name in ("b.PCD", "a.pcd", "z.ply", "note.txt"):
        (scans / name).write_text("x")
    assert [r["name"] for r in runs.frames_of(spark, str(scans)).collect()] == ["a.pcd", "b.PCD"]
    assert [r["name"] for r in runs.files_of(spark, str(scans), ("txt",)).collect()] == ["note.txt"]
    poses = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 1.0), ("b", 0.0, 1.0), ("c", 0.0, 1.0), ("c", 0.0, 2.0), ("d", 0.0, float("nan")), ("d", 1.0, 1.0)], "run string, t double, x double").selectExpr("*", "x AS y", "x AS z")
    assert {r["run"]: r["problem"] for r in runs.sound_poses(poses, ["run"]).collect()} == {"b": "fewer than 2 poses", "c": "times that repeat", "d": "values that are not finite"}
    placed = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 2.0), ("b", 0, 1.0), ("b", 1, 2.0)], "run string, idx int, t double").selectExpr("*", "1.0 AS x", "1.0 AS y", "1.0 AS z")
    assert [tuple(r) for r in runs.sound_poses(placed, ["run"]).collect()] == [("a", "times that go back")]
    (tmp_path / "cameras.txt").write_text("# list\n1 PINHOLE 640 480 500 510 320 240\n2 SIMPLE_RADIAL 800 600 700 400 300 0.1\n")
    assert sorted(tuple(r) for r in runs.read_intrinsics(spark, str(tmp_path / "cameras.txt")).collect()) == [(1, "PINHOLE", 640.0, 480.0, 500.0, 510.0, 320.0, 240.0), (2, "SIMPLE_RADIAL", 800.0, 600.0, 700.0, 700.0, 400.0, 300.0)]
    (tmp_path / "odd.txt").write_text("1 OTHER 640 480 500 510 320\n")
    with pytest.raises(ValueError, match="OTHER"):
        runs.read_intrinsics(spark, str(tmp_path / "odd.txt"))


def test_points_round_trip_through_text(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, *map(float, rng.normal(size=3))) for k in range(250)]
    cloud = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    runs.write_ply(cloud, str(tmp_path / "ply"), rows=100)
    texts = sorted((tmp_path / "ply").glob("file=*/part-*.txt"))
    back = [clouds.parse_ply(p.read_bytes()) for p in texts]
    assert [len(b["x"]) for b in back] == [100, 100, 50]
    assert np.array_equal(np.concatenate([np.stack([b[c] for c in "xyz"], axis=1) for b in back]), np.array(rows)[:, 1:])
    runs.write_csv(cloud, str(tmp_path / "csv"))
    assert sorted((r["x"], r["y"], r["z"]) for r in clouds.read_csv_points(spark, str(tmp_path / "csv")).collect()) == sorted(r[1:] for r in rows)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ply").write_bytes(clouds.ply_bytes(np.ones((7, 3))))
    assert runs.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), "csv") == 7 and runs.known_files(spark, str(tmp_path / "in")).count() == 1
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "b.ply").write_bytes(b"")
    (tmp_path / "none" / "c.txt").write_text("1 2 3")
    for bad in (lambda: runs.known_files(spark, str(tmp_path / "none")), lambda: runs.convert(spark, str(tmp_path / "in"), str(tmp_path / "o"), "laz")):
        with pytest.raises(ValueError):
            bad()
