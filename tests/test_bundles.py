"""Images, bundles and locks: files that the test writes, end to end."""

from __future__ import annotations

import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import images, suite
from cairn.sources import bundles
from cairn.sources.images import read_images


def png(x):
    """A PNG of (height, width, channels) bytes: grey, colour or colour with alpha."""
    height, width, channels = x.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    rows = b"".join(b"\0" + x[k].tobytes() for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def plain_ssim(a, b):
    at = np.arange(-5, 6)
    w = np.exp(-0.5 * (at / 1.5) ** 2)
    w /= w.sum()

    def mean(x):
        wide = np.pad(x, 5, mode="symmetric")
        return np.array([[sum(w[i] * w[j] * wide[r + i, c + j] for i in range(11) for j in range(11)) for c in range(x.shape[1])] for r in range(x.shape[0])])

    ma, mb = mean(a), mean(b)
    va, vb, cov = mean(a * a) - ma**2, mean(b * b) - mb**2, mean(a * b) - ma * mb
    return (((2 * ma * mb + 1e-4) * (2 * cov + 9e-4)) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4))).mean()


def test_image_files_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(1)
    made, real = tmp_path / "made", tmp_path / "real"
    made.mkdir()
    real.mkdir()
    a = {"c.png": rng.integers(0, 256, (9, 12, 3), np.uint8), "g.PNG": rng.integers(0, 256, (11, 7, 1), np.uint8), "a.png": rng.integers(0, 256, (6, 8, 4), np.uint8), "size.png": rng.integers(0, 256, (4, 4, 3), np.uint8), "alone.png": rng.integers(0, 256, (3, 3, 3), np.uint8)}
    b = {"c.png": np.clip(a["c.png"].astype(int) + 9, 0, 255).astype(np.uint8), "g.PNG": np.repeat(a["g.PNG"], 3, axis=2), "a.png": rng.integers(0, 256, (6, 8, 4), np.uint8), "size.png": rng.integers(0, 256, (5, 4, 3), np.uint8)}
    for folder, files in ((made, a), (real, b)):
        for name, x in files.items():
            (folder / name).write_bytes(png(x))
    (made / "broken.png").write_bytes(b"no image")
    (made / "notes.txt").write_text("x")
    left, right = read_images(spark, str(made)), read_images(spark, str(real))
    assert {(r["name"], r["width"], r["height"], r["channels"]) for r in left.collect()} == {(n, x.shape[1], x.shape[0], x.shape[2]) for n, x in a.items()}
    assert tuple(suite.pair_images(left, right).first()) == (3, 1, 1)
    got = {r["name"]: r for r in images.files_compared(left, right).collect()}
    assert {n: r["problem"] for n, r in got.items()} == {"c.png": None, "g.PNG": None, "a.png": None, "size.png": "mismatched", "alone.png": "missing"}
    assert got["g.PNG"]["psnr"] == float("inf") and got["g.PNG"]["ssim"] == pytest.approx(1) and got["g.PNG"]["fcm"] == pytest.approx(0)
    for name in ("c.png", "a.png"):
        x, y = (z[:, :, :3] / 255.0 for z in (a[name], b[name]))
        assert got[name]["psnr"] == pytest.approx(10 * np.log10(1 / ((x - y) ** 2).mean()))
        assert got[name]["ssim"] == pytest.approx(np.mean([plain_ssim(x[:, :, k], y[:, :, k]) for k in range(3)]))
        grey = lambda z: (z @ np.array([0.299, 0.587, 0.114]))[None]
        assert got[name]["fcm"] == pytest.approx(images.frequency_consistency(grey(x), grey(y))[0])
    assert left.filter("name = 'size.png'").first()["data"][:3] == bytes(a["size.png"][0, 0, ::-1])


def test_bundles_come_back_and_a_changed_byte_is_named(spark, tmp_path):
    rows = [("r1", "summary.json", json.dumps({"report": "/data/run/out/a.html", "root": "/data/run", "other": "/data/runs/x"}).encode()), ("r1", "reports/a.html", b"\xff\x00binary"), ("r1", "empty.txt", b""), ("r2", "summary.json", b"{}"), ("r2", "none", None)]
    members = spark.createDataFrame(rows, "bundle string, member string, content binary")
    out = {r["bundle"]: r for r in bundles.pack(members, str(tmp_path / "out"), ["/data/run", "/data"]).collect()}
    assert out["r1"]["members"] == 3 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["r1.zip", "r2.zip"]
    back = bundles.unpack(spark, str(tmp_path / "out"))
    got = {(r["bundle"], r["member"]): bytes(r["content"]) for r in back.collect()}
    assert got["r1", "reports/a.html"] == b"\xff\x00binary" and got["r1", "empty.txt"] == b"" and got["r2", "none"] == b""
    assert json.loads(got["r1", "summary.json"]) == {"report": "out/a.html", "root": ".", "other": "runs/x"}
    assert b"/data" not in b"".join(got.values()) and bundles.faults(back).count() == 0
    first = (tmp_path / "out" / "r1.zip").read_bytes()
    bundles.pack(members.repartition(3), str(tmp_path / "again"), ["/data/run", "/data"]).collect()
    assert (tmp_path / "again" / "r1.zip").read_bytes() == first
    with zipfile.ZipFile(tmp_path / "out" / "r2.zip") as old:
        kept = {n: old.read(n) for n in old.namelist()}
    with zipfile.ZipFile(tmp_path / "out" / "r2.zip", "w") as new:
        for n, x in kept.items():
            if n != "none":
                new.writestr(n, b"{ }" if n == "summary.json" else x)
        new.writestr("more", b"x")
    told = {(r["bundle"], r["member"]): r["problem"] for r in bundles.faults(bundles.unpack(spark, str(tmp_path / "out"))).collect()}
    assert told == {("r2", "summary.json"): "changed", ("r2", "none"): "missing", ("r2", "more"): "extra"}
    for bad in ("/abs", "../up", bundles.MANIFEST, ""):
        with pytest.raises(Exception, match="not allowed"):
            bundles.pack(spark.createDataFrame([("b", bad, b"x")], members.schema), str(tmp_path / "bad")).collect()


def test_content_hashes_see_values_alone(spark):
    rows = [(k, f"x{k % 5}", None if k % 7 == 0 else k / 3, [k, k + 1]) for k in range(500)] + [(1, "x1", 1 / 3, [1, 2])]
    table = spark.createDataFrame(rows, "k int, s string, v double, a array<int>")
    of = lambda df: df.agg(bundles.content_hash(df)).first()[0]
    first = of(table)
    assert first == of(table.repartition(7)) == of(table.orderBy(F.desc("v"))) == of(table.select("a", "v", "s", "k"))
    for other in (table.withColumn("v", F.when(F.col("k") == 3, 1.0000001).otherwise(F.col("v"))), table.limit(500), table.withColumn("s", F.when(F.col("k") == 3, None).otherwise(F.col("s"))), table.withColumnRenamed("s", "t"), table.withColumn("a", F.when(F.col("k") == 9, F.array(F.lit(9))).otherwise(F.col("a")))):
        assert of(other) != first
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string")
    assert len({of(pair("x;b=1:y", "")), of(pair("x", "y")), of(pair(None, "-")), of(pair("-", None))}) == 4
    assert of(table.limit(0)) == of(table.filter("k < 0").repartition(2))


def test_suites_are_locked(spark, tmp_path):
    tables = {"map": spark.range(50).selectExpr("id AS pid", "id / 3 AS x"), "gate": spark.createDataFrame([("min_auc", 0.5)], "key string, value double")}
    held = bundles.materialise(tables, str(tmp_path / "s"))
    assert {r["name"]: r["rows"] for r in held.collect()} == {"map": 50, "gate": 1}
    assert bundles.opened(spark, str(tmp_path / "s"))["map"].count() == 50
    spark.range(50).selectExpr("id AS pid", "IF(id = 7, 0.0, id / 3) AS x").write.mode("overwrite").parquet(str(tmp_path / "s" / "map"))
    with pytest.raises(ValueError, match="map is not what its lock says"):
        bundles.opened(spark, str(tmp_path / "s"))
