"""Summaries of checks and runs, held as nested documents: metrics and gates by path, frames by ordered rules, configurations.

Documents are JSON text parsed once into VARIANT; what is looked up in them is a table of paths, so that one join serves any
number of documents and of kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where the summary of a single run holds its metrics; a metric is named by its path.
RUN_PATHS = (
    "map.auc", "map.chamfer_distance", "map.hausdorff_distance", "map.best_f1.f1",
    "trajectory.ate.rmse", "trajectory.rpe_translation.rmse", "trajectory.drift.endpoint", "trajectory.matching.coverage_ratio",
)
#: The metrics of a check's summary that a history keeps, by kind; kinds that are not named are artifacts.
ARTIFACT_KEYS = ("auc", "chamfer_distance", "hausdorff_distance", "f1", "precision", "recall")
TRAJECTORY_KEYS = ("ate_rmse", "rpe_translation_rmse", "drift_endpoint", "coverage_ratio")
HISTORY_KEYS = {"trajectory": TRAJECTORY_KEYS, "run": (*ARTIFACT_KEYS, *TRAJECTORY_KEYS), "": ARTIFACT_KEYS}
#: Of each kind of check its metrics and where they are: in its summary, or for batches in the items of its
#: result, over which they are averaged.
CHECK_PATHS = {
    "artifact": {"auc": "auc", "chamfer": "chamfer_distance", "awd": "awd_m", "scs": "scs"},
    "trajectory": {"ate": "ate_rmse", "rpe": "rpe_rmse", "drift": "drift_endpoint", "coverage": "coverage_ratio"},
    "detection": {"map": "map", "precision": "precision", "recall": "recall", "f1": "f1"},
    "tracking": {"mota": "mota", "recall": "recall", "id_switches": "id_switches"},
    "run": {"map_auc": "map_auc", "map_chamfer": "map_chamfer_distance", "trajectory_ate": "trajectory_ate_rmse", "trajectory_rpe": "trajectory_rpe_rmse", "trajectory_drift": "trajectory_drift_endpoint", "coverage": "coverage_ratio"},
    "image": {"psnr": "psnr_mean", "ssim": "ssim_mean", "dreamsim_distance": "dreamsim_distance_mean", "frequency_consistency": "frequency_consistency_mean"},
    "rendered": {"psnr": "psnr_mean", "ssim": "ssim_mean", "lpips": "lpips_mean", "dreamsim_distance": "dreamsim_distance_mean", "frequency_consistency": "frequency_consistency_mean", "auc": "auc", "chamfer": "chamfer_distance"},
    "structure": {"plane_normal_dispersion": "plane_normal_dispersion", "coplanar_offset_rmse": "coplanar_offset_rmse"},
    "uncertainty": {"mean_position_nees": "mean_position_nees", "normalized_mean_position_nees": "normalized_mean_position_nees", "coverage_95": "coverage_95"},
    "loop_closure": {"map_auc_gain": "map_auc_gain", "after_map_chamfer": "after_chamfer_distance", "trajectory_ate_gain": "trajectory_ate_gain", "after_trajectory_ate": "after_trajectory_ate_rmse"},
}
BATCH_PATHS = {
    "artifact_batch": {"auc": "auc", "chamfer": "chamfer_distance"},
    "trajectory_batch": {"ate": "ate.rmse", "rpe": "rpe_translation.rmse", "drift": "drift.endpoint", "coverage": "coverage_ratio"},
    "run_batch": {"map_auc": "map.auc", "map_chamfer": "map.chamfer_distance", "trajectory_ate": "trajectory.ate.rmse", "trajectory_rpe": "trajectory.rpe_translation.rmse", "trajectory_drift": "trajectory.drift.endpoint", "coverage": "trajectory.matching.coverage_ratio"},
}
#: Where a check's gate is; kinds that are not named have it in their summary.
GATE_PATHS = {**dict.fromkeys(("artifact", "trajectory", "detection", "tracking", "image", "rendered", "structure", "uncertainty"), "$.result.quality_gate"), "run": "$.result.overall_quality_gate", "": "$.summary.quality_gate"}
NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"


def number(doc: Column, path: Column | str) -> Column:
    """The number (true counts as 1) at a path ($.a.b) of a document; null where there is none or something else."""
    path = F.lit(path) if isinstance(path, str) else path
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    return F.when(kind.rlike(NUMBERS), F.try_variant_get(doc, path, "double"))


def text(doc: Column, path: str) -> Column:
    """The text at a path of a document; null where there is none or something else."""
    return F.when(F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == "STRING", F.try_variant_get(doc, path, "string"))


def parsed(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """docs with their JSON text as VARIANT; null where it is none."""
    return docs.withColumn(doc, F.try_parse_json(doc))


def _paths(spark: SparkSession, table: dict[str, dict[str, str]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, m, f"$.{p}") for k, own in table.items() for m, p in own.items()], "kind string, metric string, path string"))


def run_metrics(summaries: DataFrame) -> DataFrame:
    """(id, metric, value) of summaries (id, doc: VARIANT) of single runs: the metrics that they hold, named by their paths."""
    found = F.explode(F.array(*[F.struct(F.lit(p).alias("metric"), number(F.col("doc"), f"$.{p}").alias("value")) for p in RUN_PATHS]))
    return summaries.select("id", found.alias("m")).select("id", "m.*").filter("value IS NOT NULL")


def checks_of(summaries: DataFrame) -> DataFrame:
    """(id, check_id, kind, passed, doc: VARIANT) of the checks in summaries of suites; those without an id are left out, of
    equal ids in one summary the last one stays."""
    listed = summaries.select("id", F.posexplode(F.try_variant_get("doc", F.lit("$.checks"), "array<variant>")).alias("at", "doc"))
    name = F.coalesce(F.nullif(F.try_variant_get("doc", F.lit("$.id"), "string"), F.lit("")), F.try_variant_get("doc", F.lit("$.check_id"), "string"))
    rows = listed.select("id", "at", name.alias("check_id"), F.coalesce(F.try_variant_get("doc", F.lit("$.kind"), "string"), F.lit("")).alias("kind"), F.coalesce(F.try_variant_get("doc", F.lit("$.passed"), "boolean"), F.lit(False)).alias("passed"), "doc")
    last = F.row_number().over(Window.partitionBy("id", "check_id").orderBy(F.desc("at")))
    return rows.filter("check_id <> ''").withColumn("__r", last).filter("__r = 1").drop("__r", "at")


def history_metrics(checks: DataFrame) -> DataFrame:
    """(id, check_id, kind, passed, metric, value): what a history keeps of checks; a check without any has one row of nulls."""
    spark = checks.sparkSession
    keys = F.broadcast(spark.createDataFrame([(k, m) for k, own in HISTORY_KEYS.items() for m in own], "of string, metric string"))
    known = [k for k in HISTORY_KEYS if k]
    rows = checks.withColumn("__of", F.when(F.col("kind").isin(*known), F.col("kind")).otherwise(""))
    value = number(F.col("doc"), F.concat(F.lit("$.summary."), F.col("metric")))
    held = rows.join(keys, F.col("__of") == F.col("of")).select("id", "check_id", "kind", "passed", "metric", value.alias("value")).filter("value IS NOT NULL")
    none = rows.select("id", "check_id", "kind", "passed").join(held.select("id", "check_id"), ["id", "check_id"], "left_anti")
    return held.unionByName(none.withColumns({"metric": F.lit(None).cast("string"), "value": F.lit(None).cast("double")}))


def check_metrics(checks: DataFrame) -> DataFrame:
    """(id, check_id, kind, metric, value): each check's metric vector; those of batches are means over the items of their result,
    and null if an item lacks the value."""
    spark = checks.sparkSession
    single = checks.join(_paths(spark, CHECK_PATHS), "kind").select("id", "check_id", "kind", "metric", number(F.try_variant_get("doc", F.lit("$.summary"), "variant"), F.col("path")).alias("value")).filter("value IS NOT NULL")
    items = checks.filter(F.col("kind").isin(*BATCH_PATHS)).select("id", "check_id", "kind", F.explode(F.try_variant_get("doc", F.lit("$.result"), "array<variant>")).alias("item"))
    each = items.join(_paths(spark, BATCH_PATHS), "kind").select("id", "check_id", "kind", "metric", number(F.col("item"), F.col("path")).alias("value"))
    means = each.groupBy("id", "check_id", "kind", "metric").agg(F.when(F.count("value") == F.count("*"), F.avg("value")).alias("value"))
    return single.unionByName(means)


def check_gates(checks: DataFrame) -> DataFrame:
    """(id, check_id, kind, key, threshold): the numeric thresholds (min_ and max_) of each check's gate."""
    at = F.lit(GATE_PATHS[""])
    for kind, path in GATE_PATHS.items():
        if kind:
            at = F.when(F.col("kind") == kind, F.lit(path)).otherwise(at)
    gate = F.try_variant_get("doc", at, "map<string, variant>")
    rows = checks.select("id", "check_id", "kind", F.explode(gate).alias("key", "v"))
    kept = rows.filter(F.col("key").rlike("^(min|max)_"))
    return kept.select("id", "check_id", "kind", "key", number(F.col("v"), "$").alias("threshold")).filter("threshold IS NOT NULL")


#: The rules of frame diagnosis in their order: label, confidence, conditions that all hold. A condition is a
#: signal, a comparison and a threshold; a list of conditions holds if one of them does.
RULES = (
    ("sparse_raw_scan", "high", [("raw_points", "<", 50)]),
    ("filtering_too_aggressive", "high", [("raw_points", ">=", 1000), ("filtered_points", "<", 50), ("filtered_ratio", "<", 0.02)]),
    ("scan_quality_issue", "high", [[("low_quality", ">=", 1), ("filtered_points", "<", 50)]]),
    ("map_too_sparse", "high", [("map_points", "<", 100)]),
    ("bad_initial_guess", "high", [("improvement", ">=", 0.5), ("after_mean", "<=", 0.75), ("initial_delta", ">=", 0.5)]),
    ("scan_match_cost_hotspot", "medium", [("has_debug", ">=", 1), ("cost", ">=", 1.5), ("fitness", ">=", 0.95), ("inlier_rmse", "<=", 0.25)]),
    ("weak_geometry", "medium", [("has_debug", ">=", 1), ("cost", ">=", 2.0), ("improvement", "<", 0.1), ("inlier_rmse", ">=", 0.5)]),
    ("registration_local_minimum", "medium", [("has_debug", ">=", 1), ("rmse", ">=", 2.0), ("improvement", ">=", 0.25), [("prediction_delta", ">=", 0.75), ("initial_delta", ">=", 0.75)]]),
    ("scan_match_debug_error", "medium", [("has_debug_error", ">=", 1)]),
)
COMPARE = {"<": Column.__lt__, "<=": Column.__le__, ">=": Column.__ge__}


def diagnosed(frames: DataFrame, rules: tuple = RULES) -> DataFrame:
    """frames with label and confidence of the first rule that holds (needs_review, low, if none does) and the labels of the
    others that hold, in their order. A condition on a signal that is null, or that frames have no column for, does not hold.

    cost is weighted_rmse, else rmse; filtered_ratio is filtered_points over raw_points.
    """
    has = lambda c: F.col(c).cast("double") if c in frames.columns else F.lit(None).cast("double")
    signal = {"cost": F.coalesce(has("weighted_rmse"), has("rmse")), "filtered_ratio": F.when(has("raw_points") != 0, has("filtered_points") / has("raw_points"))}

    def holds(condition) -> Column:
        if isinstance(condition, list):
            out = F.lit(False)
            for c in condition:
                out = out | holds(c)
            return out
        name, how, limit = condition
        return F.coalesce(COMPARE[how](signal.get(name, has(name)), F.lit(float(limit))), F.lit(False))

    hits = []
    for label, confidence, conditions in rules:
        every = F.lit(True)
        for c in conditions:
            every = every & holds(c)
        hits.append(F.when(every, F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))))
    found = frames.withColumn("__hits", F.filter(F.array(*hits), lambda h: h.isNotNull()))
    first = F.try_element_at("__hits", F.lit(1))
    return found.select(*frames.columns, F.coalesce(first["label"], F.lit("needs_review")).alias("label"), F.coalesce(first["confidence"], F.lit("low")).alias("confidence"), F.transform(F.slice("__hits", 2, 99), lambda h: h["label"]).alias("secondary"))


def reasons(frames: DataFrame) -> DataFrame:
    """frames with reasons: why each is worth a look, in a fixed order, with its figures."""
    has = lambda c: F.col(c) if c in frames.columns else F.lit(None)
    said = lambda c, what: F.concat(F.lit(what), F.coalesce(F.nullif(has(c).cast("string"), F.lit("")), F.lit("unknown")))

    def figure(c: str, what: str, digits: int, unit: str = "") -> Column:
        number = F.format_string(f"%.{digits}g", has(c).cast("double"))
        short = F.regexp_replace(F.regexp_replace(number, r"(\.[0-9]*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")  # no zeros at the end
        return F.when(has(c).isNotNull(), F.concat(F.lit(what), short, F.lit(unit)))

    listed = [F.when(has("failed").cast("boolean"), said("error", "scan_match_failed:")), F.when(has("low_quality").cast("boolean"), said("quality_reason", "low_quality:"))]
    listed += [figure("rmse", "rmse=", 4), figure("weighted_rmse", "weighted_rmse=", 4), figure("rejection", "rejection=", 3), figure("prediction_delta", "prediction_delta=", 4, "m"), figure("initial_delta", "initial_delta=", 4, "m")]
    return frames.withColumn("reasons", F.filter(F.array(*listed), lambda r: r.isNotNull()))
