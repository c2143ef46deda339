"""Files of points, boxes, poses and graphs as data frames, and back.

Text formats go through Spark's own readers; PLY, PCD, BIN and LAS files through the data source of cairn.sources.records, by
byte ranges. Where pyarrow has no file system for a path, such files come from Spark's binary file source instead: one task a
file, of 2 GB at most.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources import records

XYZ = ("x", "y", "z")
#: Fixed value: the factor of a splat's first colour coefficients.
DC = 0.28209479177387814


def parse_ply(data: bytes, wanted: tuple[str, ...] = XYZ) -> dict[str, np.ndarray]:
    """The wanted vertex properties that a PLY file has; ascii and binary_little_endian. Truncated files raise ValueError."""
    return records.parsed(data, "ply", wanted)


def parse_pcd(data: bytes, wanted: tuple[str, ...] = XYZ) -> dict[str, np.ndarray]:
    """The wanted fields of a PCD file with ascii or binary data."""
    return records.parsed(data, "pcd", wanted)


def parse_bin(data: bytes, wanted: tuple[str, ...] = XYZ) -> dict[str, np.ndarray]:
    """Scans of four little-endian floats a point."""
    return records.parsed(data, "bin", wanted)


def read_points(spark: SparkSession, path: str, columns: tuple[str, ...] = XYZ, split: int = records.SPLIT, strict: bool = False, required: tuple[str, ...] = ()) -> DataFrame:
    """(path, pid, columns...) of all PLY, PCD, BIN and LAS files under path; missing columns are null, points that are not finite
    are dropped, pid is a point's place in its file. A single file of another kind raises an error, as with `strict` any such
    file under a folder does, and as does a file without one of the `required` columns."""
    schema = "path string, pid long, " + ", ".join(f"{c} double" for c in columns)
    if records.reachable(path):
        records.register(spark)
        return spark.read.format("points").schema(schema).option("split", split).option("strict", str(strict).lower()).option("required", ",".join(required)).load(path)
    return _whole_files(spark, path, columns, schema)


def _whole_files(spark: SparkSession, path: str, columns: tuple[str, ...], schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = files.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).filter(F.col("kind").isin(*records.KINDS))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, kind in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = records.parsed(content, kind, tuple(dict.fromkeys([*columns, *XYZ])))
                ok = np.flatnonzero(np.all([np.isfinite(v) for v in found.values()], axis=0)) if found else np.zeros(0, int)
                for at in range(0, len(ok), records.ROWS):
                    own = ok[at : at + records.ROWS]
                    values = [pa.array(found[c][own]) if c in found else pa.nulls(len(own), pa.float64()) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(own.astype(np.int64)), *values], ["path", "pid", *columns])

    return files.mapInArrow(parse, schema)


def read_splats(spark: SparkSession, path: str) -> DataFrame:
    """(path, pid, x, y, z, opacity, scale_0 .. 2, rot_0 .. 3, r, g, b) of splats. A file without one of the first ten columns
    raises an error; colours are those of the first coefficients, held between 0 and 1, or grey (0.75) without them."""
    shape = (*XYZ, "opacity", *[f"scale_{k}" for k in range(3)], *[f"rot_{k}" for k in range(4)])
    colours = [f"f_dc_{k}" for k in range(3)]
    rows = read_points(spark, path, (*shape, *colours), required=shape)
    known = F.lit(True)
    for c in colours:
        known = known & F.col(c).isNotNull()
    return rows.select("path", "pid", *shape, *[F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + DC * F.col(c)))).otherwise(0.75).alias(n) for c, n in zip(colours, "rgb", strict=True)])


def write_points(cloud: DataFrame, path: str, kind: str = "ply", rows: int = records.FILE_ROWS, overwrite: bool = True) -> None:
    """The points (x, y, z) as binary PLY or PCD or as LAS 1.4, each task its own files of `rows` points at most; those that are
    not finite are left out. LAS keeps steps of 1e-6, larger ones where a file's extent needs them."""
    records.register(cloud.sparkSession)
    cloud.select(*XYZ).write.format("points").mode("overwrite" if overwrite else "append").option("kind", kind).option("rows", rows).save(path)


def read_csv_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z) of CSV files with a header of x, y, z or x_m, y_m, z_m in any case, or without a header."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s*,\s*").alias("f"))
    numbers = F.forall(F.slice("f", 1, 3), lambda v: F.expr("true") & v.try_cast("double").isNotNull())
    heads = lines.filter((F.size("f") >= 3) & ~numbers)
    place = lambda c: F.coalesce(F.nullif(F.array_position(F.transform("f", lambda v: F.lower(v)), c), F.lit(0)), F.nullif(F.array_position(F.transform("f", lambda v: F.lower(v)), f"{c}_m"), F.lit(0))).cast("int")
    named = heads.groupBy("path").agg(*[F.first(place(c)).alias(f"i{c}") for c in XYZ])
    rows = lines.filter((F.size("f") >= 3) & numbers).join(named, "path", "left")
    value = [F.get("f", F.coalesce(F.col(f"i{c}"), F.lit(k + 1)) - 1).try_cast("double").alias(c) for k, c in enumerate(XYZ)]
    out = rows.select("path", *value)
    for c in XYZ:
        out = out.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return out


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """(path, t, x, y, z) of pose files: four or eight numbers a line, or CSV with a header of time and coordinates."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).filter("line <> '' AND line NOT LIKE '#%'")
    parts = lines.withColumn("f", F.split("line", r"[\s,]+"))
    head = parts.filter(F.col("line").rlike("^[A-Za-z]"))
    first = lambda names: F.coalesce(*[F.nullif(F.array_position(F.transform("f", lambda v: F.lower(v)), n), F.lit(0)) for n in names]).cast("int")
    wanted = {"t": ("timestamp", "timestamp_sec", "time", "t"), "x": ("x", "x_m"), "y": ("y", "y_m"), "z": ("z", "z_m")}
    named = head.groupBy("path").agg(*[F.first(first(n)).alias(f"i{c}") for c, n in wanted.items()])
    rows = parts.filter(~F.col("line").rlike("^[A-Za-z]")).join(named, "path", "left")
    return rows.select("path", *[F.get("f", F.coalesce(F.col(f"i{c}"), F.lit(k + 1)) - 1).try_cast("double").alias(c) for k, c in enumerate(wanted)]).dropna()


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of JSON sequences (frames with boxes; other usual names of the fields are understood)."""
    box = "STRUCT<label: STRING, class: STRING, category: STRING, center: ARRAY<DOUBLE>, position: ARRAY<DOUBLE>, size: ARRAY<DOUBLE>, dimensions: ARRAY<DOUBLE>, extent: ARRAY<DOUBLE>, score: DOUBLE, yaw: DOUBLE, rotation_y: DOUBLE, track_id: STRING>"
    schema = f"frames ARRAY<STRUCT<frame_id: STRING, id: STRING, name: STRING, timestamp: STRING, boxes: ARRAY<{box}>>>"
    frames = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode("frames").alias("ord", "fr"))
    rows = frames.select("path", "ord", F.coalesce("fr.frame_id", "fr.id", "fr.name", "fr.timestamp", F.col("ord").cast("string")).alias("frame"), F.posexplode("fr.boxes").alias("idx", "b"))
    center, size = F.coalesce("b.center", "b.position"), F.coalesce("b.size", "b.dimensions", "b.extent")
    return rows.select(
        "path", "ord", "frame", F.col("idx").cast("long").alias("idx"), F.coalesce("b.label", "b.class", "b.category").alias("label"),
        *[F.get(center, k).alias(f"c{c}") for k, c in enumerate(XYZ)], *[F.get(size, k).alias(f"s{c}") for k, c in enumerate(XYZ)],
        F.coalesce("b.score", F.lit(1.0)).alias("score"), F.coalesce("b.yaw", "b.rotation_y", F.lit(0.0)).alias("yaw"), F.col("b.track_id").alias("track"),
    )


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of label files (one a frame) in the sensor's axes, rounded to six digits."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("frame"), F.split(F.trim("value"), r"\s+").alias("f")).filter("size(f) >= 15 AND NOT f[0] IN ('DontCare', 'Misc')")
    h, w, length, cx, cy, cz, ry = (F.col("f")[k].cast("double") for k in (8, 9, 10, 11, 12, 13, 14))
    values = {"cx": cz, "cy": -cx, "cz": -(cy - h / 2), "sx": length, "sy": w, "sz": h, "yaw": -ry}
    return lines.select("frame", F.col("f")[0].alias("label"), *[F.round(v, 6).alias(k) for k, v in values.items()], F.coalesce(F.get("f", 15).cast("double"), F.lit(1.0)).alias("score"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) and edges (a, b) of pose-graph text files; lines that don't parse are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    v = parts.filter(F.col("f")[0].startswith("VERTEX")).select(F.get("f", 1).try_cast("long").alias("id")).dropna()
    e = parts.filter(F.col("f")[0].startswith("EDGE")).select(F.get("f", 1).try_cast("long").alias("a"), F.get("f", 2).try_cast("long").alias("b")).dropna()
    return v, e


def write_poses(poses: DataFrame, path: str) -> None:
    """Poses (t, x, y, z, qx, qy, qz, qw) as text of six decimals."""
    poses.select(F.format_string(" ".join(["%.6f"] * 8), "t", "x", "y", "z", "qx", "qy", "qz", "qw").alias("value")).write.mode("overwrite").text(path)


def ply_bytes(x: np.ndarray) -> bytes:
    """A binary PLY file of rows of three coordinates."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(x)}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    return head.encode() + b"".join(struct.pack("<3f", *map(float, r)) for r in x)
