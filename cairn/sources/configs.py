"""Configurations of check suites: nested documents read as VARIANT, held against tables of what is allowed, and as rows.

Nothing is read by a list of files on the driver: any number of configurations is one scan, a row for each check, input, gate
value and fault.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.summaries import NUMBERS, text

#: Kinds of checks by the names that a configuration may use.
KINDS = {
    "artifact": "artifact", "map": "artifact", "artifact_batch": "artifact_batch", "map_batch": "artifact_batch",
    "trajectory": "trajectory", "trajectory_batch": "trajectory_batch", "detection": "detection", "object_detection": "detection",
    "tracking": "tracking", "object_tracking": "tracking", "run": "run", "run_batch": "run_batch",
    "ground": "ground", "ground_segmentation": "ground", "loop_closure": "loop_closure", "loop-closure": "loop_closure", "manual_loop_closure": "loop_closure",
    "image": "image", "image_evaluate": "image", "photometric": "image", "rendered": "rendered", "rendered_evaluate": "rendered", "3dgs": "rendered",
    "structure": "structure", "plane_consistency": "structure", "uncertainty": "uncertainty", "slam_uncertainty": "uncertainty",
}
_MAP, _POSES = ("min_auc", "max_chamfer"), ("max_ate", "max_rpe", "max_drift", "min_coverage", "max_lateral", "max_longitudinal")
#: Gate keys by kind.
GATES = {
    "artifact": (*_MAP, "max_awd", "max_scs", "voxel_size"), "artifact_batch": (*_MAP, "max_awd", "max_scs", "voxel_size"),
    "trajectory": _POSES, "trajectory_batch": _POSES, "run": (*_MAP, *_POSES), "run_batch": (*_MAP, *_POSES),
    "detection": ("min_map", "min_precision", "min_recall", "min_f1"), "tracking": ("min_mota", "min_recall", "max_id_switches"),
    "ground": ("min_precision", "min_recall", "min_f1", "min_iou", "voxel_size"),
    "loop_closure": ("min_auc_gain", "max_after_chamfer", "min_ate_gain", "max_after_ate", "require_posegraph_ok"),
    "image": ("min_psnr", "min_ssim", "max_dreamsim_distance", "max_frequency_consistency"),
    "rendered": ("min_psnr", "min_ssim", "max_lpips", "max_dreamsim_distance", "max_frequency_consistency", "min_auc", "max_chamfer"),
    "structure": ("max_plane_normal_dispersion", "max_coplanar_offset_rmse", "voxel_size"),
    "uncertainty": ("max_mean_position_nees", "min_normalized_mean_position_nees", "min_coverage_95"),
}
_PAIR = (("source", ("estimated", "source"), True), ("reference", ("reference",), True))
_own = lambda *names, required=True: tuple((n, (n,), required) for n in names)
#: Inputs by kind: name, the fields that may hold it (the first that is there), whether it must be there.
INPUTS = {
    "artifact": (("source", ("source", "path", "artifact"), True), ("reference", ("reference",), True)),
    "artifact_batch": (("directory", ("directory", "dir"), True), ("reference", ("reference",), True)),
    "trajectory": _PAIR, "detection": _PAIR, "tracking": _PAIR, "uncertainty": _PAIR,
    "trajectory_batch": (("directory", ("directory", "dir"), True), ("reference_dir", ("reference_dir", "reference-directory"), True)),
    "run": _own("map", "map_reference", "trajectory", "trajectory_reference"),
    "run_batch": _own("map_dir", "map_reference_dir", "trajectory_dir", "trajectory_reference_dir"),
    "ground": _own("estimated_ground", "estimated_nonground", "reference_ground", "reference_nonground"),
    "image": _own("rendered_dir", "reference_dir"), "structure": (("source", ("source", "path"), True),),
    "rendered": (("splat", ("splat", "splat_path"), True), ("cameras", ("cameras", "cameras_path"), True), ("reference_dir", ("reference_dir",), True), ("reference_pointcloud", ("reference_pointcloud", "reference", "reference_pcd"), False), ("rendered_dir", ("rendered_dir",), False)),
    "loop_closure": (("reference_map", ("reference_map", "reference"), True), ("before_map", ("before_map", "before", "before_session_root"), True), ("after_map", ("after_map", "after", "after_session_root"), True), ("before_trajectory", ("before_traj", "before_trajectory"), False), ("after_trajectory", ("after_traj", "after_trajectory"), False), ("reference_trajectory", ("ref_traj", "reference_traj", "reference_trajectory"), False)),
}
SEVERITIES, ALIGNMENTS = ("fail", "warn", "soft_fail", "skip", "not_applicable"), ("none", "origin", "rigid")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc) of JSON and YAML files: doc is VARIANT, null where a file holds no document. YAML needs its library on the
    executors; anchors and tags beyond plain values are not read."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def from_yaml(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            out = []
            for x in frame["value"]:
                try:
                    out.append(json.dumps(yaml.safe_load(x), default=str))
                except yaml.YAMLError:
                    out.append(None)
            yield pd.DataFrame({"path": frame["path"], "value": pd.Series(out, dtype=object, index=frame.index)})

    named = F.lower(F.col("path")).rlike(r"\.ya?ml$")
    every = files.filter(~named).union(files.filter(named).mapInPandas(from_yaml, "path string, value string"))
    return every.select("path", F.try_parse_json("value").alias("doc"))


def absolute(folder: Column, raw: Column) -> Column:
    """A path within a folder, or an absolute one as it stands, without steps to the same folder or back up."""
    whole = F.when(raw.startswith("/") | raw.contains("://"), raw).otherwise(F.concat(folder, F.lit("/"), raw))
    scheme = F.regexp_extract(whole, "^[a-z0-9]+:(//[^/]*)?", 0)
    parts = F.filter(F.split(whole.substr(F.length(scheme) + 1, F.length(whole)), "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(scheme, F.lit("/"), F.array_join(kept, "/"))


def _kind_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, F.lit(path), "variant")


def _listed(doc: Column) -> Column:
    return F.try_variant_get(doc, F.lit("$.checks"), "array<variant>")


def _checks(docs: DataFrame) -> DataFrame:
    """(path, at, c, defaults, kind, check_id) of each entry of `checks`; kind is null where it is none that is known."""
    rows = docs.select("path", F.try_variant_get("doc", F.lit("$.defaults"), "variant").alias("defaults"), F.posexplode(_listed(F.col("doc"))).alias("at", "c"))
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    rows = rows.withColumn("kind", names[F.lower(F.trim(text(F.col("c"), "$.kind")))])
    own = F.coalesce(text(F.col("c"), "$.id"), text(F.col("c"), "$.name"))
    return rows.withColumn("check_id", F.coalesce(F.nullif(F.trim(own), F.lit("")), F.concat("kind", F.lit("-"), (F.col("at") + 1).cast("string"))))


def _gate_rows(checks: DataFrame) -> DataFrame:
    """(path, at, kind, key, v): gate values in force, a check's own over the defaults."""
    as_map = lambda v: F.coalesce(F.try_variant_get(v, F.lit("$.gate"), "map<string, variant>"), F.create_map().cast("map<string, variant>"))
    own, shared = as_map(F.col("c")), as_map(F.col("defaults"))
    merged = F.map_concat(F.map_filter(shared, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)
    return checks.select("path", "at", "check_id", "kind", F.explode(merged).alias("key", "v"))


def _input_rows(checks: DataFrame) -> DataFrame:
    """(path, at, kind, check_id, input, required, v): the inputs that each check's kind has, v null where none is there."""
    spark = checks.sparkSession
    table = spark.createDataFrame([(k, n, list(fields), need) for k, rows in INPUTS.items() for n, fields, need in rows], "kind string, input string, fields array<string>, required boolean")
    rows = checks.join(F.broadcast(table), "kind")
    values = F.transform("fields", lambda f: F.try_variant_get(F.col("c"), F.concat(F.lit("$['"), f, F.lit("']")), "variant"))
    there = F.filter(values, lambda v: v.isNotNull() & (F.schema_of_variant(v) != "VOID"))
    return rows.select("path", "at", "kind", "check_id", "input", "required", F.try_element_at(there, F.lit(1)).alias("v"))


def problems(docs: DataFrame) -> DataFrame:
    """(path, at, problem): everything that is wrong in configurations; at is the check's place (from 0), null for the file.

    A file: not a document, empty, version not 1, checks missing, empty or no list. A check: no mapping, kind missing or
    unknown, an id, alignment, severity, thresholds, recursive or gate of the wrong type, gate keys that no kind has, gate
    values that are no numbers, inputs missing or no text.
    """
    doc = F.col("doc")
    version = _get(doc, "$.version")
    of_file = F.filter(
        F.array(
            F.when(doc.isNull(), "not a document").when(_kind_of(doc) == "VOID", "empty").when(~_kind_of(doc).startswith("OBJECT"), "config must be a mapping"),
            F.when(version.isNotNull() & ~(F.coalesce(F.try_variant_get(version, F.lit("$"), "double") == 1, F.lit(False)) & _kind_of(version).rlike(NUMBERS)), "unsupported version"),
            F.when(_kind_of(doc).startswith("OBJECT") & _listed(doc).isNull(), "checks must be a list").when(F.size(_listed(doc)) == 0, "checks must contain at least one item"),
        ),
        lambda p: p.isNotNull(),
    )
    out = docs.select("path", F.lit(None).cast("int").alias("at"), F.explode(of_file).alias("problem"))
    checks = _checks(docs)
    c = F.col("c")

    def wrong(path: str, fine: Column, said: str) -> Column:
        v = _get(c, path)
        return F.when(v.isNotNull() & (_kind_of(v) != "VOID") & ~F.coalesce(fine, F.lit(False)), said)

    numbers = F.try_variant_get(c, F.lit("$.thresholds"), "array<double>")
    of_check = F.filter(
        F.array(
            F.when(~_kind_of(c).startswith("OBJECT"), "check must be a mapping"),
            F.when(_kind_of(c).startswith("OBJECT") & F.coalesce(F.trim(text(c, "$.kind")) == "", F.lit(True)), "check.kind must be a non-empty string").when(_kind_of(c).startswith("OBJECT") & F.col("kind").isNull(), "unsupported check.kind"),
            wrong("$.id", F.trim(text(c, "$.id")) != "", "id must be a non-empty string"),
            wrong("$.alignment", F.lower(F.trim(text(c, "$.alignment"))).isin(*ALIGNMENTS), "alignment must be one of: none, origin, rigid"),
            wrong("$.severity", F.replace(F.lower(F.trim(text(c, "$.severity"))), F.lit("-"), F.lit("_")).isin(*SEVERITIES), "severity is unknown"),
            wrong("$.recursive", _kind_of(_get(c, "$.recursive")) == "BOOLEAN", "recursive must be true or false"),
            wrong("$.thresholds", (F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull()), "thresholds must be a non-empty list of numbers"),
            wrong("$.gate", _kind_of(_get(c, "$.gate")).startswith("OBJECT"), "gate must be a mapping"),
        ),
        lambda p: p.isNotNull(),
    )
    out = out.union(checks.select("path", "at", F.explode(of_check).alias("problem")))
    known = sorted({k for keys in GATES.values() for k in keys} | {"severity"})
    gates = _gate_rows(checks.filter("kind IS NOT NULL")).join(_allowed(docs.sparkSession), ["kind", "key"], "left")
    value = F.try_variant_get("v", F.lit("$"), "double")
    said = F.when(~F.col("key").isin(*known), F.concat(F.lit("unsupported gate key: "), "key")).when(F.col("may") & (_kind_of(F.col("v")) != "VOID"), F.when(F.col("key") == "require_posegraph_ok", F.when(_kind_of(F.col("v")) != "BOOLEAN", "gate.require_posegraph_ok must be true or false")).when(value.isNull(), F.concat(F.lit("gate."), "key", F.lit(" must be a number"))).when((F.col("key") == "voxel_size") & (value <= 0), "gate.voxel_size must be > 0"))
    out = out.union(gates.select("path", "at", said.alias("problem")).filter("problem IS NOT NULL"))
    inputs = _input_rows(checks.filter("kind IS NOT NULL"))
    bad = F.when(F.col("v").isNull(), F.when(F.col("required"), F.concat(F.lit("check."), "input", F.lit(" is missing")))).when(F.coalesce(F.trim(text(F.col("v"), "$")) == "", F.lit(True)), F.concat(F.lit("check."), "input", F.lit(" must be a non-empty string")))
    return out.union(inputs.select("path", "at", bad.alias("problem")).filter("problem IS NOT NULL"))


def _allowed(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, key, True) for k, keys in GATES.items() for key in keys], "kind string, key string, may boolean"))


def checks(docs: DataFrame) -> DataFrame:
    """(path, at, check_id, kind, severity, alignment, recursive, max_time_delta, thresholds) of the checks whose kind is known; what
    a check does not say comes from its file's defaults. Detection and tracking take no thresholds from there."""
    c, d = F.col("c"), F.col("defaults")
    first = lambda read, *places: F.coalesce(*[read(v, p) for v, p in places])
    numbers = lambda v, p: F.array_sort(F.try_variant_get(v, F.lit(p), "array<double>"))
    flag = lambda v, p: F.try_variant_get(v, F.lit(p), "boolean")
    value = lambda v, p: F.try_variant_get(v, F.lit(p), "double")
    severity = F.replace(F.lower(F.trim(first(text, (c, "$.severity"), (c, "$.gate.severity"), (d, "$.severity"), (d, "$.gate.severity")))), F.lit("-"), F.lit("_"))
    rows = _checks(docs).filter("kind IS NOT NULL")
    return rows.select(
        "path", "at", "check_id", "kind", F.coalesce(severity, F.lit("fail")).alias("severity"),
        F.coalesce(F.lower(F.trim(first(text, (c, "$.alignment"), (d, "$.alignment")))), F.lit("none")).alias("alignment"),
        F.coalesce(first(flag, (c, "$.recursive"), (d, "$.recursive")), F.lit(False)).alias("recursive"),
        F.coalesce(first(value, (c, "$.max_time_delta"), (d, "$.max_time_delta")), F.lit(0.05)).alias("max_time_delta"),
        F.coalesce(numbers(c, "$.thresholds"), F.when(~F.col("kind").isin("detection", "tracking"), numbers(d, "$.thresholds"))).alias("thresholds"),
    )


def inputs(docs: DataFrame) -> DataFrame:
    """(path, at, check_id, kind, input, value): the paths that checks name, made absolute from their file's folder."""
    rows = _input_rows(_checks(docs).filter("kind IS NOT NULL")).withColumn("raw", text(F.col("v"), "$")).filter(F.trim("raw") != "")
    return rows.select("path", "at", "check_id", "kind", "input", absolute(F.regexp_replace("path", "/[^/]*$", ""), F.col("raw")).alias("value"))


def gates(docs: DataFrame) -> DataFrame:
    """(path, at, check_id, key, metric, side, threshold): the numeric thresholds in force, as gates of a suite; keys that a check's
    kind does not have are left out, null values take a threshold away."""
    rows = _gate_rows(_checks(docs).filter("kind IS NOT NULL")).join(_allowed(docs.sparkSession), ["kind", "key"])
    out = rows.select("path", "at", "check_id", "key", F.substring("key", 5, 200).alias("metric"), F.substring("key", 1, 3).alias("side"), F.try_variant_get("v", F.lit("$"), "double").alias("threshold"))
    return out.filter(F.col("threshold").isNotNull() & F.col("key").rlike("^(min|max)_"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all configurations under path; an error that names the first fault where there is one."""
    docs = read_documents(spark, path)
    if first := problems(docs).orderBy("path", "at", "problem").first():
        raise ValueError(f"{first['path']}: {'' if first['at'] is None else f'checks[{first['at']}]: '}{first['problem']}")
    return docs
