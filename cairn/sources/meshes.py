"""Meshes: faces of PLY files as a Spark data source, OBJ text, and triangles as rows.

Faces are lists of any length, so a PLY file's faces are read as a stream by one task a file: runs of faces of one length at
once. OBJ is text that Spark splits; a vertex's place in its file comes from counts by block, not from one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from cairn.functions.geometry import AXES
from cairn.plans.storage import written
from cairn.sources.records import PIECE, ROWS, _lines, listed, ply_header, register, store


def _fans(faces: np.ndarray) -> np.ndarray:
    """Rows of k corners as k - 2 triangles each, all from their first corner."""
    k = faces.shape[1]
    if k < 3:
        return np.empty((0, 3), np.int64)
    first = np.repeat(faces[:, :1], k - 2, axis=1)
    return np.stack([first, faces[:, 1:-1], faces[:, 2:]], axis=2).reshape(-1, 3)


def _binary(file, start: int, size: int, count: int, properties: list[tuple[str, ...]], name: str) -> Iterator[np.ndarray]:
    """Triangles of `count` faces from byte `start` on."""
    parts = []
    for p in properties:
        parts.append((p[0], p[1:]))
    lists = [p for p in properties if len(p) == 3]
    if len(lists) != 1:
        raise ValueError("a face has one list, of its corners")
    left, data, at = count, b"", start

    def kind(k: int) -> np.dtype:
        return np.dtype([x for n, of in parts for x in ([(f"{n} n", f"<{of[0]}"), (n, f"<{of[1]}", (k,))] if len(of) == 2 else [(n, f"<{of[0]}")])])

    head = np.dtype([x for n, of in parts[: [len(of) for _, of in parts].index(2)] for x in [(n, f"<{of[0]}")]]).itemsize
    length = np.dtype(f"<{lists[0][1]}")
    while left:
        if len(data) < head + length.itemsize or len(data) < kind(int(np.frombuffer(data, length, 1, head)[0])).itemsize:
            file.seek(at)
            more = file.read(PIECE)
            if not more:
                raise ValueError(f"{count} faces announced, {count - left} found")
            data, at = data + more, at + len(more)
            continue
        record = kind(int(np.frombuffer(data, length, 1, head)[0]))
        rows = np.frombuffer(data, record, min(left, len(data) // record.itemsize))
        same = rows[f"{lists[0][0]} n"] == rows[f"{lists[0][0]} n"][0]
        n = len(rows) if same.all() else int(same.argmin())
        yield _fans(rows[lists[0][0]][:n].astype(np.int64))
        data, left = data[n * record.itemsize :], left - n


def _text(file, start: int, skip: int, count: int) -> Iterator[np.ndarray]:
    rows, left = [], count
    for line in _lines(file, start) if count else ():
        words = line.split()
        if not words:
            continue
        if skip:
            skip -= 1
            continue
        k = int(words[0])
        if len(words) <= k:
            raise ValueError(f"face {count - left} is cut short")
        rows.append(_fans(np.array([words[1 : k + 1]], np.int64).reshape(1, -1)))
        left -= 1
        if len(rows) == ROWS or not left:
            yield np.concatenate(rows)
            rows = []
        if not left:
            break
    if left:
        raise ValueError(f"{count} faces announced, {count - left} found")


def ply_triangles(file, size: int) -> Iterator[np.ndarray]:
    """Triangles (rows of three places of vertices) of an open PLY file; none where it has no faces."""
    take = 1 << 16
    while (header := ply_header(file.read(min(take, size)))) is None:
        if take >= size:
            raise ValueError("a ply header without an end")
        take *= 8
        file.seek(0)
    start, skip = header.start, 0
    for name, count, properties in header.elements:
        if name == "face":
            yield from _text(file, start, skip, count) if header.kind == "ascii" else _binary(file, start, size, count, properties, name)
            return
        skip += count
        if header.kind != "ascii":
            if any(len(p) == 3 for p in properties):
                raise ValueError("lists before the faces are not read")
            start += count * sum(np.dtype(p[1]).itemsize for p in properties)


class FaceReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.names, options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in listed(self.path, ("ply",))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        system, _ = store(self.path)
        path, size = partition.value
        named = f"file:{path}" if "://" not in self.path else path
        with system.open_input_file(path) as file:
            at = 0
            for rows in ply_triangles(file, size):
                for k in range(0, len(rows), ROWS):
                    own = rows[k : k + ROWS]
                    values = {"path": [named] * len(own), "triangle": np.arange(at, at + len(own)), **{c: own[:, j] for j, c in enumerate("abc")}}
                    yield pa.RecordBatch.from_arrays([pa.array(values[c]) for c in self.names], self.names)
                    at += len(own)


class FaceFiles(DataSource):
    """Format `faces`: the triangles (a, b, c: places of vertices) of PLY files; polygons are fanned from their first corner."""

    @classmethod
    def name(cls) -> str:
        return "faces"

    def schema(self) -> str:
        return "path string, triangle long, a long, b long, c long"

    def reader(self, schema: StructType) -> FaceReader:
        return FaceReader(schema, self.options)


def joined(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(path, pid, ax .. cz): triangles with the coordinates of their corners; vertices (path, pid, x, y, z) meet the corners in
    one join. A triangle with a corner that is no vertex is left out."""
    corners = faces.select("path", "triangle", F.posexplode(F.array("a", "b", "c")).alias("corner", "pid"))
    met = corners.join(vertices.select("path", "pid", *AXES), ["path", "pid"])
    value = [F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{n}{c}") for k, n in enumerate("abc") for c in AXES]
    return met.groupBy("path", "triangle").agg(F.count("*").alias("n"), *value).filter("n = 3").withColumnRenamed("triangle", "pid").drop("n")


def read_ply_mesh(spark: SparkSession, path: str) -> DataFrame:
    """(path, pid, ax .. cz): the triangles of all PLY files under path."""
    from cairn.sources.clouds import read_points

    register(spark)
    return joined(read_points(spark, path), spark.read.format("faces").load(path))


def read_obj_mesh(spark: SparkSession, path: str) -> DataFrame:
    """(path, pid, ax .. cz): the triangles of OBJ files. Corners count vertices from 1, or back from the line's own place if
    negative; polygons are fanned; what follows a slash (texture, normal) is left out, as are lines of other kinds."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.split(F.trim("value"), r"\s+").alias("f"))
    lines = written(lines.filter(F.col("f")[0].isin("v", "f")), "obj")
    own = Window.partitionBy("path", "block").orderBy("at")
    vertex = (F.col("f")[0] == "v").cast("long")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as blocks
    blocks = lines.groupBy("path", "block").agg(F.sum(vertex).alias("v"), F.sum(1 - vertex).alias("n"))
    blocks = blocks.select("path", "block", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("f0"))
    placed = lines.withColumns({"v": F.sum(vertex).over(own), "n": F.sum(1 - vertex).over(own)}).join(blocks, ["path", "block"])
    vertices = placed.filter("f[0] = 'v'").select("path", (F.col("v0") + F.col("v") - 1).alias("pid"), *[F.get("f", F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate(AXES)])
    seen = F.col("v0") + F.col("v")
    index = F.transform(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda x: F.element_at(F.split(x, "/"), 1).try_cast("long"))
    faces = placed.filter("f[0] = 'f'").select("path", (F.col("f0") + F.col("n") - 1).alias("face"), seen.alias("seen"), index.alias("i")).filter(F.size("i") >= 3)
    corner = lambda x: F.when(x < 0, F.col("seen") + x).otherwise(x - 1)
    fan = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("i") - 2), lambda k: F.struct(F.get("i", F.lit(0)).alias("a"), F.get("i", k).alias("b"), F.get("i", k + 1).alias("c"))))
    triangles = faces.select("path", "face", "seen", fan.alias("k", "t"))
    # a number for each triangle that runs agree on: its face, then its place in the fan
    number = F.row_number().over(Window.partitionBy("path", "face").orderBy("k")) - 1
    named = triangles.select("path", (F.col("face") * 4096 + number).alias("triangle"), *[corner(F.col(f"t.{c}")).alias(c) for c in "abc"])
    return joined(vertices, named)
