"""Bundles: archives of a run's summary and files as rows, with a manifest; tables under a lock of content hashes."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.records import store

#: The member that lists the others.
MANIFEST = "manifest.json"


def portable(text: Column, roots: list[str]) -> Column:
    """Text with the roots, and what stands before paths below them, taken out; longer roots first."""
    for root in sorted((r.rstrip("/") for r in roots if r.rstrip("/")), key=len, reverse=True):
        text = F.replace(text, F.lit(f"{root}/"), F.lit(""))
        text = F.regexp_replace(text, r"(?<![\w./-])" + "".join(c if c.isalnum() or c == "/" else f"\\{c}" for c in root) + r"(?![\w./-])", ".")
    return text


def _zipped(members: list[tuple[str, bytes]]) -> bytes:
    """An archive with a manifest; equal members give equal bytes."""
    listed = [{"member": n, "size": len(x), "sha256": hashlib.sha256(x).hexdigest()} for n, x in members]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in [(MANIFEST, json.dumps(listed, indent=1).encode()), *members]:
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def pack(members: DataFrame, path: str, roots: list[str] | None = None) -> DataFrame:
    """Writes an archive for each bundle (bundle, member, content) to the folder and returns (bundle, path, members, size).

    An archive is made by one task and must fit there. Members that are text, that is UTF-8, are freed of the roots' paths.
    Absolute names, names with steps up, the manifest's name and a name twice raise an error.
    """
    system, base = store(path)
    system.create_dir(base)
    as_text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = members.select("bundle", "member", F.col("content").cast("binary").alias("content"))
    if roots:
        rows = rows.withColumn("content", F.coalesce(portable(as_text, roots).cast("binary"), F.col("content")))

    def write(group: pa.Table) -> pa.Table:
        found = sorted(zip(group.column("member").to_pylist(), group.column("content").to_pylist(), strict=True), key=lambda x: x[0])
        names, bundle = [n for n, _ in found], group.column("bundle")[0].as_py()
        if len(set(names)) < len(names) or any(not n or n.startswith("/") or ".." in n.split("/") or n == MANIFEST for n in names):
            raise ValueError(f"bundle {bundle!r} has a member twice or one whose name is not allowed")
        data, to = _zipped([(n, x or b"") for n, x in found]), f"{base}/{bundle}.zip"
        with store(path)[0].open_output_stream(to) as out:
            out.write(data)
        return pa.table({"bundle": [bundle], "path": [to], "members": pa.array([len(names)], pa.int64()), "size": pa.array([len(data)], pa.int64())})

    return rows.groupBy("bundle").applyInArrow(write, "bundle string, path string, members long, size long")


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, member, size, sha256, content) of the members of all archives under path, the manifests among them; an archive
    that cannot be read raises an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for info in archive.infolist():
                        content = archive.read(info)
                        row = [name.rsplit("/", 1)[1].removesuffix(".zip"), info.filename, len(content), hashlib.sha256(content).hexdigest(), content]
                        yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]]), pa.array([row[2]], pa.int64()), pa.array([row[3]]), pa.array([row[4]], pa.binary())], ["bundle", "member", "size", "sha256", "content"])

    return files.mapInArrow(members, "bundle string, member string, size long, sha256 string, content binary")


def faults(members: DataFrame) -> DataFrame:
    """(bundle, member, problem) of what archives' members are not as their manifests say: changed, missing, or extra."""
    listed = members.filter(F.col("member") == MANIFEST).select("bundle", F.explode(F.from_json(F.col("content").cast("string"), "array<struct<member: string, size: long, sha256: string>>")).alias("m"))
    listed = listed.select("bundle", F.col("m.member").alias("member"), F.col("m.sha256").alias("said"))
    there = members.filter(F.col("member") != MANIFEST).select("bundle", "member", "sha256")
    both = there.join(listed, ["bundle", "member"], "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("said").isNull(), "extra").when(F.col("said") != F.col("sha256"), "changed")
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select("bundle", "member", "problem")


def content_hash(table: DataFrame) -> Column:
    """An aggregate: a hash of a table's rows that no order of rows or partitions changes, and any value does.

    Each row's text names its columns and gives lengths, so that no two rows share one; the sums of two parts of its sha256 and
    the number of rows make the hash.
    """
    part = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    names = sorted(table.columns)
    row = F.sha2(F.concat(*[x for n in names for x in (F.lit(f"{n}="), part(f"`{n}`") if table.schema[n].dataType.simpleString().split("<")[0] not in ("struct", "map", "array") else F.to_json(f"`{n}`"), F.lit(";"))]).cast("binary"), 256)
    total = lambda at: F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)"))
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), F.coalesce(total(1), F.lit(0)).cast("string"), F.coalesce(total(13), F.lit(0)).cast("string")).cast("binary"), 256)


def lock(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, hash) of tables; the names are the caller's list."""
    out = None
    for name, table in sorted(tables.items()):
        row = table.agg(F.count("*").alias("rows"), content_hash(table).alias("hash")).select(F.lit(name).alias("name"), "rows", "hash")
        out = row if out is None else out.union(row)
    return out


def materialise(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes the tables of a suite (reference map, reference poses, gate ...) below path with their lock, and returns the lock."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    held = lock({name: spark.read.parquet(f"{path}/{name}") for name in tables})
    held.write.mode("overwrite").json(f"{path}/lock")
    return spark.read.schema("name string, rows long, hash string").json(f"{path}/lock")


def opened(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a materialised suite, checked against its lock; an error that names the first that differs."""
    said = {r["name"]: (r["rows"], r["hash"]) for r in spark.read.schema("name string, rows long, hash string").json(f"{path}/lock").collect()}  # a row a table
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in said}
    for r in lock(tables).collect():
        if said[r["name"]] != (r["rows"], r["hash"]):
            raise ValueError(f"{path}/{r['name']} is not what its lock says: {r['rows']} rows of {said[r['name']][0]}")
    return tables
