"""Point and mesh files by byte ranges against plain parses, cut at every odd place, and what writers leave."""

from __future__ import annotations

import io
import math
import struct

import numpy as np
import pytest

from cairn.sources import clouds, meshes, records, runs

X = np.random.default_rng(3).normal(0, 50, (1_003, 3))


def ply(x, extra=True, before=False):
    fields = "property float x\nproperty uchar red\nproperty double y\nproperty float z\n" if extra else "property float x\nproperty float y\nproperty float z\n"
    first = "element camera 3\nproperty int id\nproperty double f\n" if before else ""
    head = f"ply\nformat binary_little_endian 1.0\ncomment made by a test\n{first}element vertex {len(x)}\n{fields}end_header\n".encode()
    kind = [("x", "<f4"), ("red", "u1"), ("y", "<f8"), ("z", "<f4")] if extra else [(c, "<f4") for c in "xyz"]
    rows = np.zeros(len(x), np.dtype(kind))
    for k, c in enumerate("xyz"):
        rows[c] = x[:, k]
    if extra:
        rows["red"] = np.arange(len(x)) % 251
    return head + (b"\0" * 36 if before else b"") + rows.tobytes()


def pcd(x, data="binary"):
    head = f"# .PCD\nVERSION .7\nFIELDS x normal y z\nSIZE 4 4 8 4\nTYPE F F F F\nCOUNT 1 3 1 1\nWIDTH {len(x)}\nHEIGHT 1\nPOINTS {len(x)}\nDATA {data}\n".encode()
    if data == "ascii":
        return head + "".join(f"{a} 0 0 0 {b} {c}\n" for a, b, c in x.tolist()).encode()
    rows = np.zeros(len(x), np.dtype([("x", "<f4"), ("n", "<f4", (3,)), ("y", "<f8"), ("z", "<f4")]))
    rows["x"], rows["y"], rows["z"] = x.T
    return head + rows.tobytes()


def las(x, form=3, minor=2, pad=7, scale=0.001):
    """A file of any format and version, with a gap after its header and bytes of its own after each record."""
    size = {2: 227, 3: 235, 4: 375}[minor]
    head = bytearray(size + pad)
    head[:4] = b"LASF"
    head[24], head[25], head[104] = 1, minor, form
    struct.pack_into("<HI", head, 94, size, size + pad)
    struct.pack_into("<H", head, 105, records.LAS_BYTES[form] + 3)
    struct.pack_into("<I", head, 107, len(x) if minor < 4 else 0)
    struct.pack_into("<6d", head, 131, scale, scale, 2 * scale, 10.0, -20.0, 5.0)
    if minor == 4:
        struct.pack_into("<Q", head, 247, len(x))
    body = b""
    for k, (a, b, c) in enumerate(x.tolist()):
        row = bytearray(records.LAS_BYTES[form] + 3)
        struct.pack_into("<3iH", row, 0, round((a - 10) / scale), round((b + 20) / scale), round((c - 5) / (2 * scale)), k % 999)
        row[16 if form >= 6 else 15] = k % 7
        if form in records.LAS_TIME:
            struct.pack_into("<d", row, records.LAS_TIME[form], k / 8)
        if form in records.LAS_COLOURS:
            struct.pack_into("<3H", row, records.LAS_COLOURS[form], k, k + 1, k + 2)
        body += bytes(row)
    return bytes(head) + body


def ranged(data, kind, wanted, split):
    """Points of all ranges, by their place."""
    out = {}
    for begin in range(0, len(data), split):
        for at, n, columns in records.points(io.BytesIO(data), kind, len(data), wanted, begin, min(begin + split, len(data))):
            for k in range(n):
                assert at + k not in out
                out[at + k] = tuple(float(columns[c][k]) for c in wanted if c in columns)
    return out


@pytest.mark.parametrize("split", [1, 13, 997, 1 << 20])
@pytest.mark.parametrize(("kind", "data"), [("ply", ply(X[:90])), ("ply", ply(X[:90], before=True)), ("pcd", pcd(X[:90])), ("las", las(X[:90])), ("bin", np.hstack([X[:90], X[:90, :1]]).astype("<f4").tobytes())])
def test_ranges_give_each_point_once(monkeypatch, kind, data, split):
    monkeypatch.setattr(records, "PIECE", 500)
    if split == 1:
        data = data[:700] if kind == "bin" else data
    whole = records.parsed(data, kind, ("x", "y", "z"))
    got = ranged(data, kind, ["x", "y", "z"], split)
    assert got == dict(enumerate(zip(*(whole[c].tolist() for c in "xyz"), strict=True)))


def test_parses_equal_what_was_written():
    for kind, data in (("ply", ply(X)), ("ply", ply(X, before=True)), ("pcd", pcd(X)), ("pcd", pcd(X, "ascii"))):
        got = records.parsed(data, kind, ("x", "y", "z", "none"))
        assert set(got) == {"x", "y", "z"}
        assert np.allclose(np.stack([got[c] for c in "xyz"], axis=1), X, rtol=1e-6)
    assert records.parsed(ply(X), "ply", ("red",))["red"].tolist() == [k % 251 for k in range(len(X))]
    text = "ply\nformat ascii 1.0\nelement junk 2\nproperty int a\nelement vertex 3\nproperty float z\nproperty float x\nproperty float y\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n7\n8\n3 1 2\n\n6 4 5\n9 7 8\n3 0 1 2\n"
    assert {c: v.tolist() for c, v in records.parsed(text.encode(), "ply", ("x", "y", "z")).items()} == {"x": [1, 4, 7], "y": [2, 5, 8], "z": [3, 6, 9]}


@pytest.mark.parametrize(("form", "minor"), [(0, 2), (1, 3), (2, 2), (3, 4), (5, 3), (6, 4), (7, 4), (10, 4)])
def test_las_formats(form, minor):
    got = records.parsed(las(X, form, minor), "las", ("x", "y", "z", "intensity", "classification", "gps_time", "red", "green", "blue"))
    assert np.allclose(np.stack([got[c] for c in "xyz"], axis=1), X, atol=0.0011)
    assert got["intensity"].tolist() == [k % 999 for k in range(len(X))] and got["classification"].tolist() == [k % 7 for k in range(len(X))]
    assert ("gps_time" in got) == (form in (1, 3, 4, 5, 6, 7, 8, 9, 10)) and ("red" in got) == (form in (2, 3, 5, 7, 8, 10))
    assert "red" not in got or got["blue"].tolist() == [k + 2 for k in range(len(X))]
    assert "gps_time" not in got or got["gps_time"][9] == 9 / 8


@pytest.mark.parametrize("bad", [las(X)[:-4], las(X)[:100], b"LASX" + las(X)[4:], las(X[:5]).replace(b"LASF", b"LASF", 1)[:24] + b"\x02" + las(X[:5])[25:], las(X[:5])[:104] + bytes([0x83]) + las(X[:5])[105:], las(X[:5])[:104] + bytes([42]) + las(X[:5])[105:]])
def test_unsound_las_is_refused(bad):
    with pytest.raises(ValueError):
        records.parsed(bad, "las", ("x", "y", "z"))


def test_unsound_files_are_refused():
    for kind, bad in (("ply", ply(X)[:-1]), ("ply", b"ply\nformat binary_little_endian 1.0\n"), ("pcd", pcd(X)[:-1]), ("pcd", pcd(X, "binary_compressed")), ("pcd", b"FIELDS x\n"), ("ply", b"plx"), ("pcd", pcd(X, "ascii")[:-400])):
        with pytest.raises(ValueError):
            records.parsed(bad, kind, ("x", "y", "z"))


def test_a_file_larger_than_a_split_is_several_tasks(spark, tmp_path):
    for name, data in (("a.ply", ply(X)), ("b.pcd", pcd(X)), ("c.las", las(X)), ("d.pcd", pcd(X, "ascii")), ("e.bin", np.hstack([X, X[:, :1]]).astype("<f4").tobytes())):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "notes.txt").write_text("no points")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "F.PLY").write_bytes(ply(np.vstack([X[:5], [[np.nan, 0, 0]]])))
    one = clouds.read_points(spark, str(tmp_path))
    many = clouds.read_points(spark, str(tmp_path), split=1_000)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 80
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, many.collect())) and len(rows) == 5 * len(X) + 5
    assert {r[0].rsplit("/", 1)[1] for r in rows} == {"a.ply", "b.pcd", "c.las", "d.pcd", "e.bin", "F.PLY"}
    got = clouds.read_points(spark, str(tmp_path), ("intensity", "z"), split=5_000).filter("path LIKE '%c.las'").orderBy("pid").collect()
    assert [r["intensity"] for r in got] == [k % 999 for k in range(len(X))] and got[0].__fields__ == ["path", "pid", "intensity", "z"]
    assert clouds.read_points(spark, str(tmp_path / "a.ply"), ("red",)).filter("red IS NOT NULL").count() == len(X)
    for bad in (lambda: clouds.read_points(spark, str(tmp_path), strict=True), lambda: clouds.read_points(spark, str(tmp_path / "notes.txt")), lambda: clouds.read_points(spark, str(tmp_path / "none")), lambda: clouds.read_points(spark, str(tmp_path), required=("opacity",))):
        with pytest.raises(Exception, match="notes.txt|none|opacity"):
            bad().count()


@pytest.mark.parametrize("kind", ["ply", "pcd", "las"])
def test_written_files_come_back(spark, tmp_path, kind):
    cloud = spark.createDataFrame([(k, *v) for k, v in enumerate(X.tolist())] + [(9_000, float("nan"), 0.0, 0.0), (9_001, None, 0.0, 0.0)], "pid long, x double, y double, z double").repartition(3)
    clouds.write_points(cloud, str(tmp_path / "out"), kind, rows=100)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(files) > 10 and all(n.startswith("part-") and n.endswith(kind) for n in files)
    back = sorted(tuple(r) for r in clouds.read_points(spark, str(tmp_path / "out")).select("x", "y", "z").collect())
    assert len(back) == len(X) and np.allclose(back, sorted(map(tuple, X.tolist())), atol=1e-6 if kind == "las" else 0, rtol=0)
    clouds.write_points(cloud.limit(3), str(tmp_path / "out"), kind)
    assert clouds.read_points(spark, str(tmp_path / "out")).count() == 3
    clouds.write_points(cloud.filter("pid < 2"), str(tmp_path / "out"), kind, overwrite=False)
    assert clouds.read_points(spark, str(tmp_path / "out")).count() == 5
    with pytest.raises(Exception, match="laz"):
        clouds.write_points(cloud, str(tmp_path / "bad"), "laz")


def test_las_steps_follow_the_extent():
    wide = np.array([[0.0, 0, 0], [1e7, 1, 1], [5e6 + 0.25, 1, 1]])
    got = records.parsed(records.las_bytes(wide), "las", ("x", "y", "z"))
    assert np.abs(got["x"] - wide[:, 0]).max() <= 0.05


def test_splats_have_colours_and_what_they_need(spark, tmp_path):
    names = ["x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
    write = lambda name, fields, rows: (tmp_path / name).write_bytes(f"ply\nformat binary_little_endian 1.0\nelement vertex {len(rows)}\n{''.join(f'property float {c}\n' for c in fields)}end_header\n".encode() + np.array(rows, "<f4").tobytes()) and str(tmp_path / name)
    plain = clouds.read_splats(spark, write("a.ply", names, [range(11)])).first()
    assert (plain["r"], plain["rot_3"]) == (0.75, 10)
    got = clouds.read_splats(spark, write("b.ply", [*names, "f_dc_0", "f_dc_1", "f_dc_2"], [[*range(11), 1, -9, 9]])).first()
    assert (got["r"], got["g"], got["b"]) == (pytest.approx(0.5 + clouds.DC), 0, 1)
    with pytest.raises(Exception, match="rot_3"):
        clouds.read_splats(spark, write("c.ply", names[:-1], [range(10)])).count()


CUBE = [[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)]
QUADS = [[0, 1, 3, 2], [4, 6, 7, 5], [0, 4, 5, 1], [2, 3, 7, 6], [0, 2, 6, 4], [1, 5, 7, 3]]


def mesh_ply(vertices, faces, kind="binary_little_endian"):
    head = f"ply\nformat {kind} 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty uchar flag\nproperty list uchar int vertex_indices\nproperty float area\nend_header\n".encode()
    if kind == "ascii":
        head = head.replace(b"property uchar flag\n", b"").replace(b"property float area\n", b"")
        return head + "".join(" ".join(map(str, v)) + "\n" for v in vertices).encode() + "".join(f"{len(f)} {' '.join(map(str, f))}\n" for f in faces).encode()
    return head + np.array(vertices, "<f4").tobytes() + b"".join(struct.pack(f"<BB{len(f)}if", 1, len(f), *f, 2.5) for f in faces)


def area(rows):
    total = 0.0
    for r in rows:
        a, b, c = (np.array([r[f"{n}{k}"] for k in "xyz"]) for n in "abc")
        total += np.linalg.norm(np.cross(b - a, c - a)) / 2
    return total


@pytest.mark.parametrize("kind", ["binary_little_endian", "ascii"])
def test_ply_faces(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(meshes, "PIECE", 40)
    mixed = [[0, 1, 3], [0, 3, 2], *QUADS[1:4], [0, 2, 6], [0, 6, 4], *QUADS[5:]]
    (tmp_path / "m.ply").write_bytes(mesh_ply(CUBE, mixed, kind))
    got = meshes.read_ply_mesh(spark, str(tmp_path)).collect()
    assert len(got) == 12 and area(got) == pytest.approx(6) and sorted(r["pid"] for r in got) == list(range(12))
    triangles = np.concatenate(list(meshes.ply_triangles(io.BytesIO(mesh_ply(CUBE, mixed, kind)), len(mesh_ply(CUBE, mixed, kind)))))
    assert triangles.tolist() == [[f[0], f[k], f[k + 1]] for f in mixed for k in range(1, len(f) - 1)]
    with pytest.raises(ValueError):
        list(meshes.ply_triangles(io.BytesIO(mesh_ply(CUBE, mixed, kind)[:-9]), len(mesh_ply(CUBE, mixed, kind)) - 9))
    (tmp_path / "none.ply").write_bytes(ply(X[:4]))
    assert meshes.read_ply_mesh(spark, str(tmp_path / "none.ply")).count() == 0


def test_obj_meshes(spark, tmp_path):
    lines = ["# cube", "o a"] + [f"v {x} {y} {z}" for x, y, z in CUBE] + ["vn 0 0 1"] + [f"f {' '.join(f'{i + 1}/7/1' for i in q)}" for q in QUADS[:5]] + ["f -7 -3 -1 -5", "f 1 2", "f 1 2 99"]
    (tmp_path / "a.obj").write_text("\n".join(lines))
    (tmp_path / "b.obj").write_text("v 0 0 0\nv 2 0 0\nv 0 2 0\nf 1 2 3\nv 5 5 5\nf -4 -3 -2\n")
    got = meshes.read_obj_mesh(spark, str(tmp_path)).collect()
    cube = [r for r in got if r["path"].endswith("a.obj")]
    assert len(cube) == 12 and area(cube) == pytest.approx(6)
    flat = [r for r in got if r["path"].endswith("b.obj")]
    assert len(flat) == 2 and area(flat) == pytest.approx(4)


def test_large_obj_files_are_cut(spark, tmp_path):
    n = 3_000
    (tmp_path / "big.obj").write_text("".join(f"v {k} {k % 7} {k % 11}\n" for k in range(n)) + "".join(f"f {k + 1} {k + 2} {k + 3}\n" for k in range(n - 2)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = meshes.read_obj_mesh(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == n - 2 and all((r["ax"], r["bx"], r["cx"]) == (r["pid"] // 4096, r["pid"] // 4096 + 1, r["pid"] // 4096 + 2) for r in got)


def test_conversion_to_binary_kinds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ply").write_bytes(ply(X[:50]))
    assert runs.convert(spark, str(tmp_path / "in"), str(tmp_path / "text"), "text-ply") == 50
    for kind in ("ply", "pcd", "las"):
        assert runs.convert(spark, str(tmp_path / "in"), str(tmp_path / kind), kind) == 50
        back = clouds.read_points(spark, str(tmp_path / kind))
        assert back.count() == 50 and math.isclose(back.agg({"x": "sum"}).first()[0], float(X[:50, 0].astype("<f4").sum(dtype=float)), abs_tol=1e-3)
