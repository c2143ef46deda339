"""Queries of suites, runs, decimation, matching, meshes and scans over the benchmark tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import align, boxes, evaluate, gates, graph, ground, images, points, progressive, structure, suite, summaries, trajectory
from cairn.plans import bindings as B
from cairn.plans.registry import query, rounded

DAY, USER = 86_400.0, ["user_id"]

# suites and decisions

#: Checks of three kinds, one for each run; the suite's default gate, and what single checks say about it.
_CHECKS = """checks AS (SELECT run AS check_id, CASE run % 3 WHEN 0 THEN 'artifact' WHEN 1 THEN 'trajectory' ELSE 'run' END AS kind, CASE WHEN run % 5 = 0 THEN 'warn' ELSE 'error' END AS severity, run % 11 = 0 AS skipped FROM wide
), allowed AS (SELECT * FROM (VALUES ('artifact', 'min_auc'), ('artifact', 'max_chamfer'), ('trajectory', 'min_coverage'), ('run', 'min_auc'), ('run', 'max_chamfer'), ('run', 'min_coverage')) a(kind, key)
), own AS (SELECT run AS check_id, 'min_auc' AS key, CASE WHEN run % 14 = 0 THEN NULL ELSE '0.45' END AS value FROM wide WHERE run % 7 = 0
), gate AS (
  SELECT c.check_id, c.kind, a.key, substr(a.key, 5) AS metric, substr(a.key, 1, 3) AS side, CASE WHEN o.check_id IS NOT NULL THEN o.value::DOUBLE ELSE d.value END AS threshold
  FROM checks c JOIN allowed a USING (kind) LEFT JOIN own o ON o.check_id = c.check_id AND o.key = a.key LEFT JOIN (VALUES ('max_chamfer', 0.25::DOUBLE), ('min_auc', 0.4), ('min_coverage', 0.45)) d(key, value) ON d.key = a.key
), gates AS (SELECT check_id, key, metric, side, threshold FROM gate WHERE threshold IS NOT NULL
), long AS (SELECT run AS check_id, metric, value FROM (UNPIVOT wide ON auc, chamfer, coverage INTO NAME metric VALUE value) WHERE NOT (run % 17 = 0 AND metric = 'coverage')
), met AS (
  SELECT g.*, l.value, l.value IS NULL AS gone, coalesce(CASE side WHEN 'min' THEN value < threshold ELSE value > threshold END, true) AS bad FROM gates g LEFT JOIN long l USING (check_id, metric)
), verdict AS (
  SELECT check_id, count(*) AS gated, count(*) FILTER (WHERE bad) AS failed, coalesce(string_agg(CASE WHEN gone THEN metric || ' unavailable' ELSE metric || CASE side WHEN 'min' THEN ' under ' ELSE ' over ' END || key END, '; ' ORDER BY CASE WHEN gone THEN metric || ' unavailable' ELSE metric || CASE side WHEN 'min' THEN ' under ' ELSE ' over ' END || key END) FILTER (WHERE bad), '') AS reasons FROM met GROUP BY 1
), suite AS (
  SELECT check_id, kind, severity, coalesce(gated, 0) AS gated, coalesce(failed, 0) AS failed, CASE WHEN gated > 0 AND NOT skipped THEN failed = 0 END AS passed,
    CASE WHEN skipped THEN 'skip' WHEN gated IS NULL THEN 'info' WHEN failed = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status, CASE WHEN gated > 0 AND NOT skipped THEN reasons ELSE '' END AS reasons
  FROM checks LEFT JOIN verdict USING (check_id))"""


def _suite(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    wide = B.order_metrics(spark, sf_dir)
    kind = F.when(F.col("run") % 3 == 0, "artifact").when(F.col("run") % 3 == 1, "trajectory").otherwise("run")
    checks = wide.select(F.col("run").alias("check_id"), kind.alias("kind"), F.when(F.col("run") % 5 == 0, "warn").otherwise("error").alias("severity"), (F.col("run") % 11 == 0).alias("skipped"))
    allowed = spark.createDataFrame([("artifact", "min_auc"), ("artifact", "max_chamfer"), ("trajectory", "min_coverage"), ("run", "min_auc"), ("run", "max_chamfer"), ("run", "min_coverage")], "kind string, key string")
    defaults = spark.createDataFrame([(k, str(v)) for k, v in B.GATE.items()], "key string, value string")
    own = wide.filter("run % 7 = 0").select(F.col("run").alias("check_id"), F.lit("min_auc").alias("key"), F.when(F.col("run") % 14 != 0, "0.45").alias("value"))
    long = wide.unpivot(["run"], ["auc", "chamfer", "coverage"], "metric", "value").withColumnRenamed("run", "check_id").filter("NOT (check_id % 17 = 0 AND metric = 'coverage')")
    return checks, long, suite.effective_gates(checks, defaults, own, allowed)


@query(f"WITH {B.METRICS}, {_CHECKS} SELECT * FROM gates")
def effective_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suite(spark, sf_dir)[2]


@query(f"WITH {B.METRICS}, {_CHECKS} SELECT * REPLACE (passed::VARCHAR AS passed) FROM suite")
def check_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.run_suite(*_suite(spark, sf_dir)).withColumn("passed", F.col("passed").cast("string"))


@query(
    f"""WITH {B.METRICS}, {_CHECKS} SELECT kind, count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'warn') AS n_warn, 0::BIGINT AS n_soft_fail, count(*) FILTER (WHERE status = 'info') AS n_info, count(*) FILTER (WHERE status = 'skip') AS n_skip,
  count(*) > count(*) FILTER (WHERE status IN ('pass', 'skip')) AS blocked, (count(*) > count(*) FILTER (WHERE status IN ('pass', 'skip')))::INT AS exit_code FROM suite GROUP BY 1"""
)
def check_suite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.policy(suite.run_suite(*_suite(spark, sf_dir)), "strict", ["kind"])


@query(
    f"""WITH {B.METRICS}, {_CHECKS}, p AS (SELECT check_id, metric, value * CASE check_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 1.1 END AS previous FROM long WHERE check_id % 9 <> 0)
SELECT check_id, metric, value, round(previous, 9) AS previous, CASE WHEN previous IS NULL THEN NULL WHEN abs(value - previous) < 1e-6 THEN 'still' WHEN value > previous THEN 'up' ELSE 'down' END AS move FROM long LEFT JOIN p USING (check_id, metric)"""
)
def baseline_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _suite(spark, sf_dir)[1]
    factor = F.when(F.col("check_id") % 4 == 0, 1.0).when(F.col("check_id") % 4 == 1, 0.9).otherwise(1.1)
    out = suite.deltas(long, long.filter("check_id % 9 <> 0").withColumn("value", F.col("value") * factor), ["check_id", "metric"])
    return out.withColumn("previous", F.round("previous", 9))


_RUNS = "runs AS (SELECT *, series % 4 AS dataset, series AS sequence, CASE WHEN series % 5 = 0 AND run % 2 = 0 THEN NULL ELSE series % 3 END AS version, series % 2 = 0 OR run % 49 > 0 AS gate FROM wide)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(~((F.col("series") % 5 == 0) & (F.col("run") % 2 == 0)), F.col("series") % 3)
    return B.order_metrics(spark, sf_dir).withColumns({"dataset": F.col("series") % 4, "sequence": F.col("series"), "version": version, "gate": (F.col("series") % 2 == 0) | (F.col("run") % 49 > 0)})


@query(f"WITH {B.METRICS}, {_RUNS} SELECT dataset, sequence, run, auc, chamfer, row_number() OVER (PARTITION BY dataset, sequence ORDER BY auc DESC, chamfer, run)::INT AS place FROM runs")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suite.leaderboard(_runs(spark, sf_dir), ["dataset", "sequence"], [F.desc("auc"), F.asc("chamfer"), F.asc("run")])
    return out.select("dataset", "sequence", "run", "auc", "chamfer", "place")


@query(f"WITH {B.METRICS}, {_RUNS} SELECT dataset, sequence, count(DISTINCT coalesce(version::VARCHAR, '-') || gate::VARCHAR) AS versions, count(*) AS runs FROM runs GROUP BY 1, 2 HAVING versions > 1")
def incomparable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.incomparable(_runs(spark, sf_dir), ["dataset", "sequence"], ["version", "gate"], "run")


@query(f"WITH {B.METRICS} SELECT series, run, row_number() OVER w::INT AS step, round(auc - lag(auc) OVER w, 6) AS d_auc, round(chamfer - lag(chamfer) OVER w, 6) AS d_chamfer FROM wide WINDOW w AS (PARTITION BY series ORDER BY run)")
def history_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = B.order_metrics(spark, sf_dir).withColumn("kind", F.lit("single_run"))
    return rounded(suite.history_series(bundles, "kind", "run", ["auc", "chamfer"], ["series"]).select("series", "run", "step", "d_auc", "d_chamfer"))


@query(
    f"""WITH {B.METRICS}, a AS (SELECT run AS pair, auc, chamfer, coverage AS ate FROM wide), b AS (SELECT run - 1 AS pair, auc, chamfer, coverage AS ate FROM wide WHERE run % 6 <> 0),
j AS (SELECT pair, b.auc - a.auc AS delta_auc, b.chamfer AS after_chamfer, b.ate - a.ate AS delta_ate, b.ate AS after_ate FROM a FULL JOIN b USING (pair))
SELECT pair, round(delta_auc, 6) AS delta_auc, round(delta_ate, 6) AS delta_ate, coalesce(delta_auc >= 0.01, false) AND coalesce(after_chamfer <= 0.3, false) AND coalesce(-delta_ate >= 0, false) AND coalesce(after_ate <= 0.6, false) AS passed,
  4 - coalesce((delta_auc >= 0.01)::INT, 0) - coalesce((after_chamfer <= 0.3)::INT, 0) - coalesce((-delta_ate >= 0)::INT, 0) - coalesce((after_ate <= 0.6)::INT, 0) AS n_reasons FROM j"""
)
def loop_closure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = B.order_metrics(spark, sf_dir).withColumnRenamed("coverage", "ate")
    before, after = wide.withColumnRenamed("run", "pair"), wide.filter("run % 6 <> 0").select((F.col("run") - 1).alias("pair"), "auc", "chamfer", "ate")
    report = suite.closure_report(before, after, ["pair"], ["auc", "chamfer", "ate"])
    out = suite.closure_gate(report, min_auc_gain=0.01, max_after_chamfer=0.3, min_ate_gain=0.0, max_after_ate=0.6)
    return rounded(out.select("pair", "delta_auc", "delta_ate", "passed", F.size("reasons").alias("n_reasons")))


_POINTS = f"""{B.METRICS}, m AS (UNPIVOT wide ON auc, chamfer, coverage INTO NAME metric VALUE value), margins AS (
  SELECT run, series, CASE side WHEN 'min' THEN value - threshold ELSE threshold - value END / threshold AS margin FROM m JOIN (VALUES ('chamfer', 'max', 0.25::DOUBLE), ('auc', 'min', 0.4), ('coverage', 'min', 0.45)) g(metric, side, threshold) USING (metric)
), stats AS (SELECT run, series, round(avg(margin), 4) AS mean_margin, round(min(margin), 4) AS worst_margin, round(avg((margin >= 0)::INT), 4) AS pass_ratio, count(*) FILTER (WHERE margin < 0) AS failed, min(margin) >= -0.6 AS passed FROM margins GROUP BY 1, 2)"""


@query(
    f"""WITH {_POINTS}, h AS (
  SELECT s.run, s.series, count(o.run) AS history, count(*) FILTER (WHERE o.mean_margin >= s.mean_margin AND o.worst_margin >= s.worst_margin AND o.pass_ratio >= s.pass_ratio AND o.failed <= s.failed AND (o.mean_margin > s.mean_margin OR o.worst_margin > s.worst_margin OR o.pass_ratio > s.pass_ratio OR o.failed < s.failed)) AS beaten_by,
    count(*) FILTER (WHERE s.mean_margin >= o.mean_margin AND s.worst_margin >= o.worst_margin AND s.pass_ratio >= o.pass_ratio AND s.failed <= o.failed AND (s.mean_margin > o.mean_margin OR s.worst_margin > o.worst_margin OR s.pass_ratio > o.pass_ratio OR s.failed < o.failed)) AS beats
  FROM stats s LEFT JOIN stats o ON o.series = s.series AND o.run < s.run GROUP BY 1, 2)
SELECT run, series, history, beaten_by, beats, CASE WHEN NOT passed THEN 'reject' WHEN history = 0 OR beaten_by > 0 THEN 'keep' WHEN beats >= 1 THEN 'promote' ELSE 'keep' END AS decision FROM h JOIN stats USING (run, series)"""
)
def baseline_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = B.order_metrics(spark, sf_dir).unpivot(["run", "series"], ["auc", "chamfer", "coverage"], "metric", "value")
    m = gates.margins(long, gates.gate_rows(spark, B.GATE), ["run", "series"])
    stats = m.groupBy("run", "series").agg(F.round(F.avg("margin"), 4).alias("mean_margin"), F.round(F.min("margin"), 4).alias("worst_margin"), F.round(F.avg((F.col("margin") >= 0).cast("double")), 4).alias("pass_ratio"), F.count_if(F.col("margin") < 0).alias("failed"), (F.min("margin") >= -0.6).alias("passed"))
    return suite.decide(stats, "series", "run", "pareto").select("run", "series", "history", "beaten_by", "beats", "decision")


@query(
    f"""WITH {B.METRICS}, a AS (SELECT series, round(avg(auc), 9) AS auc, round(avg(chamfer), 9) AS chamfer, round(avg(coverage), 9) AS coverage FROM wide GROUP BY 1),
r AS (SELECT series, row_number() OVER (ORDER BY auc DESC, series)::INT AS auc_rank, row_number() OVER (ORDER BY chamfer, series)::INT AS chamfer_rank, row_number() OVER (ORDER BY coverage DESC, series)::INT AS coverage_rank FROM a)
SELECT *, round(auc_rank * 0.5 + chamfer_rank * 0.3 + coverage_rank * 0.2, 3)::DOUBLE AS composite FROM r"""
)
def strategy_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suite.composite_rank(B.order_metrics(spark, sf_dir), "series", {"auc": 0.5, "chamfer": 0.3, "coverage": 0.2}, ("auc", "coverage"))
    return out.select("series", "auc_rank", "chamfer_rank", "coverage_rank", "composite")


_FILES = """l AS (SELECT DISTINCT 'd' || (o_custkey % 9) || '/m' || (o_orderkey % 400) || CASE WHEN o_orderkey % 3 = 0 THEN '.pcd' ELSE '.ply' END AS path FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT DISTINCT 'd' || (o_custkey % 9) || '/m' || (o_orderkey % 500) || CASE WHEN o_orderkey % 5 = 0 THEN '.pcd' ELSE '.ply' END AS path FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 10 = 0)"""


@query(
    f"""WITH {_FILES}, lk AS (SELECT path, regexp_replace(path, '\\.[^./]*$', '') AS bare, regexp_extract(regexp_replace(path, '\\.[^./]*$', ''), '[^/]*$') AS stem FROM l), rk AS (SELECT path, regexp_replace(path, '\\.[^./]*$', '') AS bare, regexp_extract(regexp_replace(path, '\\.[^./]*$', ''), '[^/]*$') AS stem FROM r),
lc AS (SELECT *, count(*) OVER (PARTITION BY bare) AS nb, count(*) OVER (PARTITION BY stem) AS ns FROM lk), rb AS (SELECT bare, min(path) AS by_bare FROM rk GROUP BY 1 HAVING count(*) = 1), rs AS (SELECT stem, min(path) AS by_stem FROM rk GROUP BY 1 HAVING count(*) = 1),
j AS (SELECT lc.path, r.path AS same, CASE WHEN nb = 1 THEN by_bare END AS by_bare, CASE WHEN ns = 1 THEN by_stem END AS by_stem FROM lc LEFT JOIN r ON r.path = lc.path LEFT JOIN rb USING (bare) LEFT JOIN rs USING (stem))
SELECT path, coalesce(same, by_bare, by_stem) AS match, CASE WHEN same IS NOT NULL THEN 'path' WHEN by_bare IS NOT NULL THEN 'bare' WHEN by_stem IS NOT NULL THEN 'stem' END AS how FROM j"""
)
def artifact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders")
    path = lambda n, k: F.concat(F.lit("d"), (F.col("o_custkey") % 9).cast("string"), F.lit("/m"), (F.col("o_orderkey") % n).cast("string"), F.when(F.col("o_orderkey") % k == 0, ".pcd").otherwise(".ply"))
    return suite.artifact_match(o.filter("o_orderkey % 2 = 0").select(path(400, 3).alias("path")), o.filter("o_orderkey % 2 = 1 OR o_orderkey % 10 = 0").select(path(500, 5).alias("path")))


@query("WITH r AS (SELECT l_orderkey AS frame, count(*) AS n_ref FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1), e AS (SELECT l_orderkey AS frame, count(*) AS n_est FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT frame, coalesce(n_ref, 0) AS n_ref, coalesce(n_est, 0) AS n_est FROM r FULL JOIN e USING (frame)")
def frame_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = B.boxes(spark, sf_dir)
    return suite.frame_join(base.filter("label <> 'A'"), base.filter("label <> 'R'"))


@query("WITH a AS (SELECT page_id AS name, length(html) % 7 AS w, length(url) % 3 AS h FROM pages), b AS (SELECT page_id AS name, length(html) % 7 AS w, (length(url) + (page_id % 4 = 0)::INT) % 3 AS h FROM pages WHERE page_id % 5 <> 0) SELECT count(*) FILTER (WHERE a.w = b.w AND a.h = b.h) AS pairs, count(*) FILTER (WHERE b.w IS NULL) AS missing, count(*) FILTER (WHERE b.w IS NOT NULL AND NOT (a.w = b.w AND a.h = b.h)) AS mismatched FROM a LEFT JOIN b USING (name)")
def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "pages")
    made = p.select(F.col("page_id").alias("name"), (F.length("html") % 7).alias("width"), (F.length("url") % 3).alias("height"))
    other = p.filter("page_id % 5 <> 0").select(F.col("page_id").alias("name"), (F.length("html") % 7).alias("width"), ((F.length("url") + (F.col("page_id") % 4 == 0).cast("int")) % 3).alias("height"))
    return suite.pair_images(made, other)


@query("SELECT f.event_id AS scan_id, m.timestamp, m.file, p.value AS pose_x FROM events f LEFT JOIN (SELECT event_id, (event_id % 1000)::VARCHAR AS timestamp, 'scan' || event_id || '.csv' AS file FROM events WHERE event_id % 3 <> 0) m ON m.event_id = f.event_id LEFT JOIN (SELECT event_id::VARCHAR AS timestamp, value FROM events WHERE event_id < 900) p ON p.timestamp = m.timestamp")
def scan_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events")
    manifest = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("scan_id"), (F.col("event_id") % 1000).cast("string").alias("timestamp"), F.concat(F.lit("scan"), F.col("event_id").cast("string"), F.lit(".csv")).alias("file"))
    poses = e.filter("event_id < 900").select(F.col("event_id").cast("string").alias("timestamp"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return suite.with_scan(e.select(F.col("event_id").alias("scan_id")), manifest, poses).select("scan_id", "timestamp", "file", "pose_x")


@query(
    f"""WITH {B.MATCHED}, d AS (SELECT user_id, sqrt((ex - rx) ** 2 + (ey - ry) ** 2 + (ez - rz) ** 2) AS e FROM hit), t AS (SELECT user_id AS run, sqrt(avg(e ** 2)) AS ate FROM d GROUP BY 1 HAVING count(*) > 1), {B.METRICS}
SELECT run, (auc >= 0.4 AND chamfer <= 0.25)::VARCHAR AS map_passed, (ate <= 4)::VARCHAR AS track_passed, (CASE WHEN auc IS NULL THEN ate <= 4 WHEN ate IS NULL THEN auc >= 0.4 AND chamfer <= 0.25 ELSE auc >= 0.4 AND chamfer <= 0.25 AND ate <= 4 END)::VARCHAR AS overall FROM wide FULL JOIN t USING (run)"""
)
def run_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = trajectory.evaluate(*B.trajectories(spark, sf_dir), DAY, USER).select(F.col("user_id").alias("run"), F.col("ate_rmse").alias("ate"))
    maps = B.order_metrics(spark, sf_dir).select("run", "auc", "chamfer")
    return suite.evaluate_runs(maps, tracks, "run", {"min_auc": 0.4, "max_chamfer": 0.25}, {"max_ate": 4.0}).select("run", *[F.col(c).cast("string").alias(c) for c in ("map_passed", "track_passed", "overall")])


@query(
    f"""WITH {B.MATCHED}, d AS (SELECT user_id, sqrt((ex - rx) ** 2 + (ey - ry) ** 2 + (ez - rz) ** 2) AS e FROM hit)
SELECT user_id, count(*) AS n, round(sqrt(avg(e * e)), 5) AS rmse, round(avg(e), 5) AS mean, round(min(e), 5) AS least, round(max(e), 5) AS most, round(stddev_pop(e), 5) AS std, round(quantile_cont(e, 0.5), 5) AS median, round(quantile_cont(e, 0.95), 5) AS p95 FROM d GROUP BY 1"""
)
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trajectory.errors(trajectory.interpolated_join(*B.trajectories(spark, sf_dir), DAY, USER), USER)
    return rounded(suite.error_summary(e, "error", USER), 5)


@query(
    f"""WITH {B.MATCHED}, d AS (SELECT user_id, sqrt((ex - rx) ** 2 + (ey - ry) ** 2 + (ez - rz) ** 2) AS e FROM hit), a AS (SELECT user_id, sqrt(avg(e ** 2)) AS ate, count(*) AS matched FROM d GROUP BY 1 HAVING count(*) > 1), c AS (SELECT user_id, count(*) AS poses FROM ref GROUP BY 1)
SELECT user_id, ate <= 4 AND matched / poses >= 0.9 AS passed, (ate > 4)::INT + (matched / poses < 0.9)::INT AS n_reasons FROM a JOIN c USING (user_id)"""
)
def trajectory_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = trajectory.evaluate(*B.trajectories(spark, sf_dir), DAY, USER)
    return gates.wide_gate(scores, {"max_ate_rmse": 4.0, "min_coverage": 0.9}).select("user_id", "passed", F.size("reasons").alias("n_reasons"))


@query(
    f"""WITH {B.DENSE}, f AS (SELECT floor(x / 2)::BIGINT AS vx, floor(y / 2)::BIGINT AS vy, floor(z / 2)::BIGINT AS vz, bool_or(eg) AS eg, bool_or(NOT eg) AS en, bool_or(rg) AS rg, bool_or(NOT rg) AS rn FROM dense GROUP BY ALL), c AS (SELECT count(*) FILTER (WHERE eg AND rg) AS tp, count(*) FILTER (WHERE eg AND rn) AS fp, count(*) FILTER (WHERE en AND rg) AS fn FROM f)
SELECT tp, fp, fn, tp / (tp + fp) >= 0.5 AND tp / (tp + fn) >= 0.5 AND tp / (tp + fp + fn) >= 0.6 AS passed FROM c"""
)
def ground_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ground.voxel_confusion(B.dense_cloud(spark, sf_dir), 2.0)
    return gates.wide_gate(scores, {"min_precision": 0.5, "min_recall": 0.5, "min_iou": 0.6}).select("tp", "fp", "fn", "passed")


@query(f"WITH {B.METRICS}, c AS (SELECT run, unnest(range(4)) AS copy, auc FROM wide) SELECT run, copy::INT AS copy, round(auc * (1 + 0.05 * (('0x' || substr(md5('5:' || copy || ':' || run), 1, 8))::BIGINT / 2147483648.0 - 1)), 9) AS value FROM c")
def perturbed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(suite.perturbed(B.order_metrics(spark, sf_dir).select("run", F.col("auc").alias("value")), ["run"], 0.05, 4).select("run", "copy", "value"), 9)


# clouds, meshes and scans


@query(f"WITH {B.CLOUD} SELECT round((min(x) + max(x)) / 2, 6) AS center_x, round((min(y) + max(y)) / 2, 6) AS center_y, round((min(z) + max(z)) / 2, 6) AS center_z, round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 6) AS extent FROM cloud WHERE cloud_id IN ('click', 'view')")
def scene_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.scene_bounds(*B.cloud_pair(spark, sf_dir)))


@query(f"WITH {B.CLOUD} SELECT pid, cloud_id FROM cloud WHERE sqrt(x * x + y * y + z * z) <= 15")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.in_range(B.events_cloud(spark, sf_dir), 15.0).select("pid", "cloud_id")


@query(f"WITH {B.CLOUD}, n AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS i, count(*) OVER () AS n FROM cloud), k AS (SELECT DISTINCT round_even(j * ((SELECT max(n) FROM n) - 1) / 299, 0) AS i FROM range(300) r(j)) SELECT pid FROM n JOIN k USING (i)")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.evenly_spaced(B.events_cloud(spark, sf_dir), 300).select("pid")


@query(f"WITH {B.CLOUD} SELECT pid FROM (SELECT pid FROM cloud ORDER BY md5('3:' || pid), pid LIMIT 400)")
def budget_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.budgeted(B.events_cloud(spark, sf_dir), 400, 3).select("pid")


@query("WITH p AS (SELECT page_id, lower(regexp_extract(url, '[a-z]+$')) AS tail, length(html) % 4 AS k FROM pages), f AS (SELECT page_id, CASE k WHEN 0 THEN 'obj' WHEN 3 THEN 'pcd' ELSE 'ply' END AS suffix, page_id % 3 = 0 AS splat, page_id % 2 = 0 AS face FROM p) SELECT page_id, CASE WHEN suffix = 'obj' THEN 'mesh' WHEN suffix = 'ply' AND splat THEN 'gaussian-points' WHEN suffix = 'ply' AND face THEN 'mesh' ELSE 'point-cloud' END AS kind FROM f")
def representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.length("html") % 4
    path = F.concat(F.lit("a/b."), F.when(k == 0, "OBJ").when(k == 3, "pcd").otherwise("ply"))
    fields = F.filter(F.array(F.lit("x"), F.when(F.col("page_id") % 3 == 0, "opacity"), F.when(F.col("page_id") % 2 == 0, "face")), lambda f: f.isNotNull())
    return points.representation(B.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), fields.alias("fields"))).select("page_id", "kind")


@query(
    f"""WITH {B.CLOUD}, t AS (SELECT *, 0.5 * sqrt((y * z - 0.25) ** 2 + (0.25 - x * z) ** 2 + (0.5 * x - y * 0.5) ** 2) AS area FROM (SELECT pid, x / 10 AS x, y / 24 AS y, z / 31 AS z FROM cloud)),
d AS (SELECT pid, area / sum(area) OVER () * 3000 AS share, ('0x' || substr(md5('7n:' || pid || ':-1'), 1, 8))::BIGINT / 4294967296.0 AS u FROM t)
SELECT pid, (floor(share) + (u < share - floor(share))::INT)::BIGINT AS n FROM d WHERE floor(share) + (u < share - floor(share))::INT > 0"""
)
def mesh_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle for each event, from the origin; how many samples each gets."""
    c = B.events_cloud(spark, sf_dir).select("pid", (F.col("x") / 10).alias("u"), (F.col("y") / 24).alias("v"), (F.col("z") / 31).alias("w"))
    corners = {f"a{k}": F.lit(0.0) for k in "xyz"} | {"bx": F.col("u"), "by": F.col("v"), "bz": F.lit(0.5), "cx": F.lit(0.5), "cy": F.lit(0.5), "cz": F.col("w")}
    return points.mesh_samples(c.withColumns(corners), 3000).groupBy("pid").agg(F.count("*").alias("n"))


@query(
    f"""WITH {B.CLOUD}, w AS (SELECT cloud_id, -y + 1 AS x, x + 2 AS y, z - 3 AS z FROM cloud WHERE cloud_id <> 'error')
SELECT floor(x / 2)::BIGINT AS vx, floor(y / 2)::BIGINT AS vy, floor(z / 2)::BIGINT AS vz, count(*) AS n, round(avg(x) + 1e-9, 5) AS x, round(avg(y) + 1e-9, 5) AS y, round(avg(z) + 1e-9, 5) AS z FROM w GROUP BY 1, 2, 3"""
)
def map_from_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan for each event type, all at one pose, a quarter turn about z; one scan has no pose."""
    scans = B.events_cloud(spark, sf_dir).withColumnRenamed("cloud_id", "scan_id")
    half = 0.5**0.5
    poses = scans.select("scan_id").distinct().filter("scan_id <> 'error'").select("scan_id", *[F.lit(v).alias(k) for k, v in {"tx": 1.0, "ty": 2.0, "tz": -3.0, "qx": 0.0, "qy": 0.0, "qz": half, "qw": half}.items()])
    world = points.placed_scans(scans, poses).select("scan_id", *[F.round(c, 9).alias(c) for c in "xyz"])
    thin = points.voxel_downsample(world, 2.0)
    return rounded(thin.withColumns({c: F.col(c) + 1e-9 for c in "xyz"}), 5)  # means end in halves of the last digit


@query(
    f"""WITH {B.CLOUD}, near AS (SELECT s.pid, arg_min(t.pid, (sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2), t.pid)) AS other FROM dst s, src t GROUP BY 1), b AS (SELECT t.y < 12 AS eg, s.y < 12 AS rg FROM near n JOIN dst s ON s.pid = n.pid JOIN src t ON t.pid = n.other),
c AS (SELECT count(*) FILTER (WHERE eg AND rg) AS tp, count(*) FILTER (WHERE eg AND NOT rg) AS fp, count(*) FILTER (WHERE NOT eg AND rg) AS fn, count(*) FILTER (WHERE NOT eg AND NOT rg) AS tn FROM b), m AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c)
SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(tp / (tp + fp + fn), 6) AS iou, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM m"""
)
def ground_label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = (df.withColumn("ground", F.col("y") < 12) for df in B.cloud_pair(spark, sf_dir))
    return rounded(ground.transfer_confusion(source, target))


def _sphere_sql(n: int) -> str:
    return ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for a, b, c in points.fibonacci_sphere(n))


@query(
    f"""WITH {B.CLOUD}, q AS (SELECT *, sqrt(x * x + (x + 1) ** 2 + (x + 2) ** 2 + (x + 3) ** 2) AS l FROM cloud), u AS (SELECT pid, x AS px, y AS py, z AS pz, x / l AS w, (x + 1) / l AS i, (x + 2) / l AS j, (x + 3) / l AS k FROM q),
s AS (SELECT * FROM u, (VALUES {_sphere_sql(8)}) t(ta, tb, tc)), e AS (SELECT *, ta * 0.1 AS a, tb * 0.2 AS b, tc * 0.3 AS c FROM s)
SELECT pid, round(1e-9 + px + (1 - 2 * (j * j + k * k)) * a + 2 * (i * j - w * k) * b + 2 * (i * k + w * j) * c, 4) + 0.0 AS x, round(1e-9 + py + 2 * (i * j + w * k) * a + (1 - 2 * (i * i + k * k)) * b + 2 * (j * k - w * i) * c, 4) + 0.0 AS y, round(1e-9 + pz + 2 * (i * k - w * j) * a + 2 * (j * k + w * i) * b + (1 - 2 * (i * i + j * j)) * c, 4) + 0.0 AS z FROM e"""
)
def ellipsoid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    splats = B.events_cloud(spark, sf_dir).withColumns({f"scale_{k}": F.log(F.lit(0.1) * (k + 1)) for k in range(3)} | {f"rot_{k}": F.col("x") + k for k in range(4)})
    return rounded(points.ellipsoid_samples(splats, 8).select("pid", *[(F.col(c) + 1e-9).alias(c) for c in "xyz"]), 4)  # zeros of either sign


# order of display


@query(
    f"""WITH {B.CLOUD}, b AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS w FROM cloud),
c AS (SELECT pid, (least(floor((x - x0) / w * 6), 5)::BIGINT * 6 + least(floor((y - y0) / w * 6), 5)::BIGINT) * 6 + least(floor((z - z0) / w * 6), 5)::BIGINT AS tile FROM cloud, b),
l AS (SELECT pid, tile, row_number() OVER (PARTITION BY tile ORDER BY pid) AS level FROM c), r AS (SELECT pid, row_number() OVER (ORDER BY level, tile * 2654435761 % 4294967296, tile) - 1 AS rank FROM l)
SELECT pid, rank, CASE WHEN rank < 200 THEN 0 ELSE 1 + (rank - 200) // 100 END AS chunk FROM r"""
)
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive.grid_tiles(B.events_cloud(spark, sf_dir), 200, 100)


@query(
    f"""WITH {B.CLOUD}, b AS (SELECT 0.85 * ((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) / 200) ** (1.0::DOUBLE / 3) AS size FROM cloud),
v AS (SELECT floor(x / size)::BIGINT AS vx, floor(y / size)::BIGINT AS vy, floor(z / size)::BIGINT AS vz, count(*) AS n FROM cloud, b GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (ORDER BY vx, vy, vz) - 1 AS i, count(*) OVER () AS m FROM v),
k AS (SELECT DISTINCT round_even(j * ((SELECT max(m) FROM o) - 1) / 199, 0) AS i FROM range(200) r(j)) SELECT vx, vy, vz, n FROM o WHERE m <= 200 OR i IN (SELECT i FROM k)"""
)
def hybrid_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive.hybrid(B.events_cloud(spark, sf_dir), 200).select("vx", "vy", "vz", "n")


@query(f"WITH {B.CLOUD}, near AS (SELECT s.pid, min(sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)) AS d FROM cloud s, src t GROUP BY 1) SELECT round(avg(d), 6) AS mean, round(max(d), 6) AS most, round(quantile_cont(d, 0.95), 6) AS quantile FROM near")
def coverage_of_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(progressive.coverage(B.events_cloud(spark, sf_dir), B.cloud_pair(spark, sf_dir)[0]))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT count(*) AS chunks, round(stddev_pop(n), 6) AS spread FROM c")
def chunk_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.when(F.col("event_type") == "click", 0).otherwise(F.length("event_type") * 1000 + F.ascii("event_type"))
    return rounded(progressive.chunk_spread(B.table(spark, sf_dir, "events").select(chunk.alias("chunk"))))


@query(
    f"""WITH {B.CLOUD}, c AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cloud), f AS (SELECT pid, sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) AS r FROM cloud, c), q AS (SELECT quantile_cont(r, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS cuts FROM f),
s AS (SELECT pid, r, len(list_filter(cuts, lambda c: r >= c)) AS shell FROM f, q), o AS (SELECT pid, shell, row_number() OVER (PARTITION BY shell ORDER BY r, pid) - 1 AS own, count(*) OVER (PARTITION BY shell) AS n FROM s)
SELECT pid, shell::INT AS shell FROM o"""
)
def distance_shell_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive.distance_shells(B.events_cloud(spark, sf_dir), 200, 100).select("pid", "shell")


# trajectories

_PLACED = f"{B.TRACKS}, d AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, x - lag(x) OVER w AS px, y - lag(y) OVER w AS py, z - lag(z) OVER w AS pz, lead(x) OVER w - x AS nx, lead(y) OVER w - y AS ny, lead(z) OVER w - z AS nz FROM ref WINDOW w AS (PARTITION BY user_id ORDER BY t)), s AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS a, sqrt(nx * nx + ny * ny + nz * nz) AS b FROM d), scored AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN acos(greatest(-1, least(1, (px * nx + py * ny + pz * nz) / (a * b)))) * least(a, b) ELSE 0 END AS score FROM s)"


def _filled_sql(marked: str, budget: int) -> str:
    """SQL of the poses kept: those of `marked` (user_id, i, n, keep), and others evenly between them."""
    return f"""g AS (SELECT user_id, i, n, lead(i) OVER (PARTITION BY user_id ORDER BY i) AS j, count(*) OVER (PARTITION BY user_id) AS kept FROM {marked} WHERE keep
), h AS (SELECT *, j - i - 1 AS free, sum(j - i - 1) OVER (PARTITION BY user_id) AS total, least({budget}, n) - kept AS extra FROM g WHERE j IS NOT NULL
), e AS (SELECT *, CASE WHEN total > 0 AND extra > 0 THEN extra * (free / total) ELSE 0 END AS exact FROM h
), q AS (SELECT *, floor(exact)::BIGINT AS base, greatest(extra, 0) - sum(floor(exact)::BIGINT) OVER (PARTITION BY user_id) AS rest, row_number() OVER (PARTITION BY user_id ORDER BY exact - floor(exact) DESC, i DESC) AS turn FROM e
), p AS (SELECT *, base + (turn <= rest AND base < free)::INT AS quota FROM q
), added AS (SELECT user_id, floor(i + k * ((j - i) / (quota + 1)))::BIGINT AS i FROM (SELECT *, unnest(range(1, quota + 1)) AS k FROM p WHERE quota > 0)
), chosen AS (SELECT user_id, i FROM {marked} WHERE keep UNION SELECT user_id, i FROM added)"""


@query(
    f"""WITH {_PLACED}, f AS (SELECT *, i = 0 OR i = n - 1 AS fixed FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fixed, score DESC, i DESC) AS sharp, ceil(greatest(12 - sum(fixed::INT) OVER (PARTITION BY user_id), 0) * 0.45::DOUBLE) AS turns FROM f),
marked AS (SELECT user_id, i, n, fixed OR (sharp <= turns AND score > 0) OR n <= 12 AS keep FROM r), {_filled_sql("marked", 12)} SELECT user_id, round(t, 3) AS t FROM scored JOIN chosen USING (user_id, i)"""
)
def turn_aware_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.turn_aware(B.trajectories(spark, sf_dir)[0], 12, USER).select("user_id", F.round("t", 3).alias("t"))


@query(
    f"""WITH RECURSIVE {_PLACED}, part AS (SELECT user_id, i, n, coalesce(a, 0) AS step, sum(coalesce(a, 0)) OVER (PARTITION BY user_id) / 9 AS part FROM s
), walk AS (SELECT user_id, i, n, part, true AS hit, 0.0::DOUBLE AS far FROM part WHERE i = 0
  UNION ALL SELECT p.user_id, p.i, p.n, p.part, p.i = p.n - 1 OR p.n <= 10 OR w.far + p.step >= p.part, CASE WHEN p.i = p.n - 1 OR p.n <= 10 OR w.far + p.step >= p.part THEN 0 ELSE w.far + p.step END FROM walk w JOIN part p ON p.user_id = w.user_id AND p.i = w.i + 1
), hits AS (SELECT user_id, i AS place, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM walk WHERE hit
), marked AS (SELECT *, i = 0 OR i = n - 1 OR n <= 10 AS keep FROM hits), {_filled_sql("marked", 10)} SELECT user_id, round(t, 3) AS t FROM chosen JOIN hits USING (user_id, i) JOIN s ON s.user_id = hits.user_id AND s.i = hits.place"""
)
def distance_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.by_distance(B.trajectories(spark, sf_dir)[0], 10, USER).select("user_id", F.round("t", 3).alias("t"))


@query(f"WITH {B.TRACKS}, a AS (SELECT user_id, x, y, z, row_number() OVER (PARTITION BY user_id ORDER BY t) AS idx FROM ref), b AS (SELECT user_id, x, y, z, row_number() OVER (PARTITION BY user_id ORDER BY t) AS idx FROM est) SELECT user_id, count(*) AS n, round(sqrt(avg((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 5) AS rmse FROM a JOIN b USING (user_id, idx) GROUP BY 1")
def index_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, est = (df.selectExpr("*", "row_number() OVER (PARTITION BY user_id ORDER BY t) AS idx") for df in B.trajectories(spark, sf_dir))
    return rounded(trajectory.index_error(ref, est, USER), 5)


@query(
    """WITH m AS (SELECT vec_id, embedding FROM embeddings), a AS (SELECT vec_id, embedding[1]::DOUBLE * 3 AS w FROM m)
SELECT vec_id, vec_id / 10.0::DOUBLE AS t, round(w, 6) AS x, round(abs(cos(w / 2)), 6) AS qw, round(CASE WHEN abs(cos(w / 2)) > 1e-12 THEN sign(cos(w / 2)) ELSE 1 END * sin(w / 2), 6) AS qz FROM a"""
)
def poses_from_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn about z for each vector, by three times its first component, and a shift by it along x."""
    w = F.get("embedding", F.lit(0)).cast("double") * 3
    zero, one = F.lit(0.0), F.lit(1.0)
    v = F.array(F.cos(w), -F.sin(w), zero, w, F.sin(w), F.cos(w), zero, zero, zero, zero, one, zero)
    lines = B.table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("idx"), v.alias("v"))
    return rounded(trajectory.from_rows(lines, 10.0, ["vec_id"]).select("vec_id", "t", "x", "qw", "qz"))


# boxes: greedy matching in SQL, one candidate of each frame after the other


def _greedy_sql(name: str, by: str, order: str, least: float = 0.25) -> str:
    on = " AND ".join(f"c.{k} = g.{k}" for k in by.split(", "))
    return f"""c_{name} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM cand WHERE iou >= {least}
), g_{name} AS (SELECT {", ".join(f"c.{k}" for k in by.split(", "))}, rn, [ref_idx] AS rs, [est_idx] AS es, true AS hit FROM c_{name} c WHERE rn = 1
  UNION ALL SELECT {", ".join(f"c.{k}" for k in by.split(", "))}, c.rn, CASE WHEN list_contains(rs, ref_idx) OR list_contains(es, est_idx) THEN rs ELSE list_append(rs, ref_idx) END, CASE WHEN list_contains(rs, ref_idx) OR list_contains(es, est_idx) THEN es ELSE list_append(es, est_idx) END, NOT (list_contains(rs, ref_idx) OR list_contains(es, est_idx))
  FROM g_{name} g JOIN c_{name} c ON {on} AND c.rn = g.rn + 1
), m_{name} AS (SELECT c.* FROM c_{name} c JOIN g_{name} g ON {on} AND c.rn = g.rn AND g.hit)"""


_BEST = _greedy_sql("best", "frame", "iou DESC, score DESC, ref_idx, est_idx")
_AP = _greedy_sql("ap", "frame, label", "score DESC, est_idx, iou DESC, ref_idx")


@query(
    f"""WITH RECURSIVE {B.BOXES}, {_BEST}, d AS (SELECT label, count(*) AS n FROM base GROUP BY 1), h AS (SELECT m.label, count(*) AS tp, avg(iou) AS mean_iou, avg(sqrt((r.cx - e.cx - 40 * e.tax) ** 2 + (r.cy - e.cy) ** 2 + (r.cz - e.cz) ** 2)) AS mean_center_d FROM m_best m JOIN base r ON r.frame = m.frame AND r.idx = m.ref_idx JOIN base e ON e.frame = m.frame AND e.idx = m.est_idx GROUP BY 1)
SELECT label, n AS n_ref, n AS n_est, tp, round(mean_iou, 6) AS mean_iou, round(mean_center_d, 6) AS mean_center_d, n - tp AS fp, n - tp AS fn, round(tp / n, 6) AS precision, round(tp / n, 6) AS recall, round(tp / n, 6) AS f1 FROM d JOIN h USING (label)"""
)
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.detection(*B.boxes(spark, sf_dir), 0.25))


@query(
    f"""WITH RECURSIVE {B.BOXES}, {_AP}, f AS (SELECT b.label, b.score, b.frame, b.idx, (m.est_idx IS NOT NULL)::INT AS tp, count(*) OVER (PARTITION BY b.label) AS n FROM base b LEFT JOIN m_ap m ON m.frame = b.frame AND m.label = b.label AND m.est_idx = b.idx
), r AS (SELECT *, row_number() OVER w AS seen, sum(tp) OVER w AS hits FROM f WINDOW w AS (PARTITION BY label ORDER BY score DESC, frame, idx)
), v AS (SELECT *, hits / seen AS precision, hits / n AS recall FROM r
), e AS (SELECT *, max(precision) OVER (PARTITION BY label ORDER BY seen DESC) AS envelope, coalesce(lead(recall) OVER (PARTITION BY label ORDER BY seen), 1.0) AS next FROM v)
SELECT label, max(n) AS n_ref, round(sum(envelope * (next - recall)) + sum(CASE WHEN seen = 1 THEN envelope * recall END), 6) AS ap FROM e GROUP BY 1"""
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.average_precision(*B.boxes(spark, sf_dir), 0.25))


@query(
    f"""WITH RECURSIVE {B.BOXES}, {_BEST}, s AS (SELECT b.frame, b.idx, b.track, m.est_track FROM base b LEFT JOIN m_best m ON m.frame = b.frame AND m.ref_idx = b.idx
), l AS (SELECT *, last_value(est_track IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, lag(est_track IS NOT NULL) OVER (PARTITION BY track ORDER BY frame, idx) AS before FROM s
), t AS (SELECT track, count(*) AS n, count(est_track) AS hits, count(*) FILTER (WHERE est_track <> last) AS switches, greatest(count(*) FILTER (WHERE est_track IS NOT NULL AND NOT coalesce(before, false)) - 1, 0) AS fragments FROM l GROUP BY 1
), a AS (SELECT sum(n)::BIGINT AS n_ref, sum(hits)::BIGINT AS tp, sum(switches)::BIGINT AS id_switches, sum(fragments)::BIGINT AS fragmentations, count(*) FILTER (WHERE hits >= 0.8 * n) AS mostly_tracked, count(*) AS tracks FROM t)
SELECT *, n_ref AS n_est, n_ref - tp AS fn, n_ref - tp AS fp, round(tp / n_ref, 6) AS recall, round(1 - (2 * (n_ref - tp) + id_switches) / n_ref, 6) AS mota FROM a"""
)
def tracking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.tracking(*B.boxes(spark, sf_dir), 0.25))


@query()
def detection_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.detection_sweep(*B.boxes(spark, sf_dir)))


@query()
def box_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = B.events_cloud(spark, sf_dir).withColumnRenamed("cloud_id", "label")
    return rounded(boxes.clusters(cloud, 2.5, 4).drop("cluster"))


@query(f"WITH RECURSIVE {B.BOXES}, {_BEST}, c AS (SELECT count(*) AS n FROM base), m AS (SELECT count(*) AS tp FROM m_best) SELECT round(tp / n, 6) AS precision, round(tp / n, 6) AS recall, tp / n >= 0.75 AND tp / n >= 0.9 AS passed, (tp / n < 0.75)::INT + (tp / n < 0.9)::INT AS n_reasons FROM c, m")
def detection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = boxes.detection(*B.boxes(spark, sf_dir), 0.25).agg((F.sum("tp") / F.sum("n_est")).alias("precision"), (F.sum("tp") / F.sum("n_ref")).alias("recall"))
    return rounded(gates.wide_gate(d, {"min_precision": 0.75, "min_recall": 0.9}).select("precision", "recall", "passed", F.size("reasons").alias("n_reasons")))


# structure, graphs, images


@query()
def plane_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = structure.plane_patches(B.dense_cloud(spark, sf_dir), 4.0, 12, 0.1).withColumn("id", F.xxhash64("vx", "vy", "vz"))
    return rounded(structure.plane_consistency(patches), 4)


@query("WITH RECURSIVE d AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem UNION SELECT l_suppkey, l_partkey FROM lineitem), r AS (SELECT p_partkey AS node, p_partkey AS reached FROM part UNION SELECT r.node, d.b FROM r JOIN d ON d.a = r.reached) SELECT 'error' AS level, 'several components' AS problem WHERE (SELECT count(DISTINCT c) FROM (SELECT min(reached) AS c FROM r GROUP BY node)) > 1 UNION ALL SELECT 'error', 'edges name missing vertices' AS problem WHERE (SELECT count(*) FROM (SELECT l_partkey AS a FROM lineitem UNION SELECT l_suppkey FROM lineitem) WHERE a NOT IN (SELECT p_partkey FROM part)) > 0 UNION ALL SELECT 'warning', 'isolated vertices' WHERE (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey <> l_suppkey UNION SELECT l_suppkey FROM lineitem WHERE l_partkey <> l_suppkey)) > 0 UNION ALL SELECT 'warning', 'repeated edges' WHERE (SELECT count(*) FROM lineitem WHERE l_partkey <> l_suppkey) > (SELECT count(*) FROM (SELECT DISTINCT least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) FROM lineitem WHERE l_partkey <> l_suppkey)) UNION ALL SELECT 'warning', 'fewer key frames than vertices'")
def graph_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = B.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    vertices = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    components = graph.components_with_isolated(vertices, edges).agg(F.countDistinct("component").alias("components"))
    return graph.session(graph.summary(vertices, edges).crossJoin(components), key_frames=1)  # one row each


@query()
def image_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of 8 x 8, each against the next one."""
    grey = B.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v.cast("double") + 1) / 2).alias("a"))
    pairs = grey.join(grey.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return rounded(images.compared(pairs, "vec_id", 8, 8))


@query()
def cloud_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view cloud, moved a little, brought back onto itself."""
    _, target = B.cloud_pair(spark, sf_dir)
    moved = points.transform(target, [[1, 0, 0, 0.05], [0, 1, 0, -0.03], [0, 0, 1, 0.02], [0, 0, 0, 1]])
    matrix, share, rmse = align.icp(moved, target, 1.0, steps=8)
    return spark.createDataFrame([(round(share, 3), round(rmse, 3), *[round(matrix[k][3], 2) + 0.0 for k in range(3)])], "share double, rmse double, tx double, ty double, tz double")


_NEAR = "near AS (SELECT s.pid, min(sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)) AS d FROM src s, dst t GROUP BY 1)"


@query(f"WITH {B.CLOUD}, {_NEAR} SELECT pid, round(d, 6) AS d, d > 0.4 AS beyond, round(least(d / 0.4, 1), 6) AS r, round(1 - least(d / 0.4, 1), 6) AS g, 0.0::DOUBLE AS b FROM near")
def compare_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.compared(*B.cloud_pair(spark, sf_dir), 0.4))


_THIN = "SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {} GROUP BY floor(x / 1)::BIGINT, floor(y / 1)::BIGINT, floor(z / 1)::BIGINT"


@query(
    f"""WITH {B.CLOUD}, a AS ({_THIN.format("(SELECT * FROM src WHERE sqrt(x * x + y * y + z * z) <= 25)")}), b AS ({_THIN.format("(SELECT * FROM dst WHERE sqrt(x * x + y * y + z * z) <= 25)")}),
p AS (SELECT min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM a, b GROUP BY a.x, a.y, a.z), q AS (SELECT min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM a, b GROUP BY b.x, b.y, b.z)
SELECT round((SELECT avg(d) FROM p) + (SELECT avg(d) FROM q), 6) AS chamfer, round((SELECT avg((d <= 0.5)::INT) FROM p), 6) AS accuracy_0, round((SELECT avg((d <= 0.5)::INT) FROM q), 6) AS completeness_0"""
)
def filter_downsample_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = (points.in_range(df, 25.0) for df in B.cloud_pair(spark, sf_dir))
    return rounded(evaluate.evaluate_map(source, target, 1.0, (0.5,)).select("chamfer", "accuracy_0", "completeness_0"))


@query(
    f"""WITH {B.CLOUD}, s AS ({_THIN.format("src")}), f AS (SELECT x + 0.5 AS x, y, z, x + 0.5 - 0.25 AS ax FROM s),
nb AS (SELECT min(x) - 2 AS x0, max(x) + 2 AS x1, min(ax) - 2 AS a0, max(ax) + 2 AS a1, min(y) - 2 AS y0, max(y) + 2 AS y1, min(z) - 2 AS z0, max(z) + 2 AS z1 FROM f),
w1 AS ({_THIN.format("(SELECT dst.* FROM dst, nb WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1)")}), w2 AS ({_THIN.format("(SELECT dst.* FROM dst, nb WHERE x BETWEEN a0 AND a1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1)")}),
p AS (SELECT min(sqrt((f.x - w.x) ** 2 + (f.y - w.y) ** 2 + (f.z - w.z) ** 2)) AS d FROM f, w1 w GROUP BY f.x, f.y, f.z), q AS (SELECT min(sqrt((f.ax - w.x) ** 2 + (f.y - w.y) ** 2 + (f.z - w.z) ** 2)) AS d FROM f, w2 w GROUP BY f.x, f.y, f.z)
SELECT round(avg(d), 6) AS before, round((SELECT avg(d) FROM q), 6) AS after, round(avg(d) - (SELECT avg(d) FROM q), 6) AS improvement FROM p"""
)
def scan_match_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, world = B.cloud_pair(spark, sf_dir)
    shift = lambda v: [[1.0, 0, 0, v], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    return rounded(evaluate.match_debug(scan, world, shift(0.5), shift(-0.25), 1.0, 2.0))


@query(
    f"""WITH {B.CLOUD}, near AS (SELECT s.cloud_id, s.pid, min(sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)) AS d FROM cloud s, dst t GROUP BY 1, 2), back AS (SELECT s.cloud_id, t.pid, min(sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)) AS d FROM cloud s, dst t GROUP BY 1, 2),
a AS (SELECT cloud_id, avg(d) AS m, max(d) AS x, count(*) AS n FROM near GROUP BY 1), b AS (SELECT cloud_id, avg(d) AS m, max(d) AS x FROM back GROUP BY 1),
l AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 1.0])::DOUBLE AS threshold), pr AS (SELECT cloud_id, threshold, avg((d <= threshold)::INT) AS p FROM near, l GROUP BY 1, 2), re AS (SELECT cloud_id, threshold, avg((d <= threshold)::INT) AS r FROM back, l GROUP BY 1, 2),
f AS (SELECT cloud_id, threshold, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr JOIN re USING (cloud_id, threshold)),
g AS (SELECT *, lead(threshold) OVER w AS nt, lead(f1) OVER w AS nf FROM f WINDOW w AS (PARTITION BY cloud_id ORDER BY threshold)),
u AS (SELECT cloud_id, sum((nt - threshold) * (nf + f1) / 2) / (max(threshold) - min(threshold)) AS auc, max(f1) AS best_f1, arg_min(threshold, (-f1, threshold)) AS best_threshold FROM g GROUP BY 1),
z AS (SELECT cloud_id, sum(event_id % 7 + 1) / (count(*) * 12.0) AS size_ratio FROM events JOIN cloud ON event_id = pid GROUP BY 1),
e AS (SELECT cloud_id AS name, (a.m + b.m) / 2 AS chamfer, greatest(a.x, b.x) AS hausdorff, auc, best_f1, best_threshold, a.n AS points, size_ratio, (a.m + b.m) / 2 <= 0.5 AND auc >= 0.5 AS passed FROM a JOIN b USING (cloud_id) JOIN u USING (cloud_id) JOIN z USING (cloud_id)),
t AS (SELECT *, NOT EXISTS (SELECT 1 FROM e o WHERE o.size_ratio <= e.size_ratio AND o.auc >= e.auc AND (o.size_ratio < e.size_ratio OR o.auc > e.auc)) AS best FROM e)
SELECT name, round(chamfer, 6) AS chamfer, round(hausdorff, 6) AS hausdorff, round(auc, 6) AS auc, round(best_f1, 6) AS best_f1, best_threshold::DOUBLE AS best_threshold, points, round(size_ratio, 6) AS size_ratio, round(1 - size_ratio, 6) AS saving, passed, best,
  best AND passed AND row_number() OVER (PARTITION BY best AND passed ORDER BY size_ratio, auc DESC, name) = 1 AS recommended FROM t"""
)
def batch_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cloud against the views, in the same jobs."""
    cloud = B.events_cloud(spark, sf_dir).withColumnRenamed("cloud_id", "name")
    sizes = cloud.groupBy("name").agg((F.count("*") * 12).alias("baseline_bytes"), F.sum(F.col("pid") % 7 + 1).alias("compressed_bytes"))
    out = evaluate.batch(cloud, B.cloud_pair(spark, sf_dir)[1], {"max_chamfer": 0.5, "min_auc": 0.5}, sizes=sizes)
    return rounded(out.select("name", "chamfer", "hausdorff", "auc", "best_f1", "best_threshold", "points", "size_ratio", "saving", "passed", "best", "recommended"))


@query(
    f"""WITH {B.TRACKS}, f AS (SELECT user_id, event_id AS frame, epoch_us(ts) / 1e6 + event_id % 13 AS t FROM events WHERE event_type IN ('error', 'signup', 'purchase')), i AS (SELECT user_id, t, min(i) AS pose FROM (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM ref) GROUP BY 1, 2),
j AS (SELECT f.user_id, frame, f.t, p.t AS pt, p.pose AS pp, q.t AS qt, q.pose AS qp FROM f ASOF LEFT JOIN i p ON f.user_id = p.user_id AND f.t > p.t ASOF LEFT JOIN i q ON f.user_id = q.user_id AND f.t <= q.t)
SELECT user_id, frame, CASE WHEN qt IS NULL OR t - pt <= qt - t THEN pp ELSE qp END AS pose, round(CASE WHEN qt IS NULL OR t - pt <= qt - t THEN t - pt ELSE qt - t END, 6) AS dt FROM j WHERE pt IS NOT NULL OR qt IS NOT NULL"""
)
def nearest_time_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all users with the place of the nearest pose in time."""
    e = B.table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup", "purchase"))
    frames = e.select("user_id", F.col("event_id").alias("frame"), (F.expr(B._SECONDS) + F.col("event_id") % 13).alias("t"))
    return rounded(trajectory.nearest_pose(frames, B.trajectories(spark, sf_dir)[0], ["user_id"]).select("user_id", "frame", "pose", "dt"))


_DOC = """docs AS (SELECT run, CASE run % 4 WHEN 0 THEN 'artifact' WHEN 1 THEN 'trajectory' WHEN 2 THEN 'artifact_batch' ELSE 'run' END AS kind, auc, chamfer, coverage FROM wide)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite's summary for each customer, as JSON text, with one check of one of four kinds; the trajectory's coverage is text in
    one of seven, which is no number."""
    w = B.order_metrics(spark, sf_dir)
    kind = F.expr("CASE run % 4 WHEN 0 THEN 'artifact' WHEN 1 THEN 'trajectory' WHEN 2 THEN 'artifact_batch' ELSE 'run' END")
    number = lambda c: F.col(c).cast("string")
    text = F.when(F.col("run") % 7 == 0, F.concat(F.lit('"'), number("coverage"), F.lit('"'))).otherwise(number("coverage"))
    summary = F.expr("CASE run % 4 WHEN 0 THEN concat('{\"auc\":', auc, ',\"chamfer_distance\":', chamfer, '}') WHEN 2 THEN '{}' END")
    summary = F.coalesce(summary, F.when(F.col("run") % 4 == 1, F.concat(F.lit('{"ate_rmse":'), number("chamfer"), F.lit(',"rpe_rmse":0.5,"drift_endpoint":1,"coverage_ratio":'), text, F.lit("}"))), F.concat(F.lit('{"map_auc":'), number("auc"), F.lit(',"map_chamfer_distance":'), number("chamfer"), F.lit(',"coverage_ratio":'), text, F.lit("}")))
    item = lambda factor: F.concat(F.lit('{"auc":'), (F.col("auc") * factor).cast("string"), F.lit(',"chamfer_distance":'), (F.col("chamfer") * factor).cast("string"), F.lit("}"))
    gate = F.concat(F.lit('{"min_auc":0.4,"passed":true,"max_chamfer":'), F.when(F.col("run") % 3 == 0, "null").otherwise("0.25"), F.lit("}"))
    result = F.when(F.col("run") % 4 == 2, F.concat(F.lit("["), item(1.0), F.lit(","), item(0.5), F.lit("]"))).otherwise(F.concat(F.lit('{"quality_gate":'), gate, F.lit(',"overall_quality_gate":'), gate, F.lit("}")))
    check = F.concat(F.lit('{"checks":[{"id":"c","kind":"'), kind, F.lit('","passed":true,"summary":'), summary, F.lit(',"result":'), result, F.lit("}]}"))
    return w.select(F.col("run").alias("id"), check.alias("doc"))


@query(
    f"""WITH {B.METRICS}, {_DOC}, long AS (
  SELECT run, kind, 'auc' AS metric, auc AS value FROM docs WHERE kind = 'artifact' UNION ALL SELECT run, kind, 'chamfer', chamfer FROM docs WHERE kind = 'artifact'
  UNION ALL SELECT run, kind, 'ate', chamfer FROM docs WHERE kind = 'trajectory' UNION ALL SELECT run, kind, 'rpe', 0.5 FROM docs WHERE kind = 'trajectory' UNION ALL SELECT run, kind, 'drift', 1 FROM docs WHERE kind = 'trajectory'
  UNION ALL SELECT run, kind, 'coverage', coverage FROM docs WHERE kind IN ('trajectory', 'run') AND run % 7 <> 0
  UNION ALL SELECT run, kind, 'auc', auc * 0.75 FROM docs WHERE kind = 'artifact_batch' UNION ALL SELECT run, kind, 'chamfer', chamfer * 0.75 FROM docs WHERE kind = 'artifact_batch'
  UNION ALL SELECT run, kind, 'map_auc', auc FROM docs WHERE kind = 'run' UNION ALL SELECT run, kind, 'map_chamfer', chamfer FROM docs WHERE kind = 'run')
SELECT run AS id, kind, metric, round(value, 6)::DOUBLE AS value FROM long WHERE value IS NOT NULL"""
)
def check_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = summaries.checks_of(summaries.parsed(_documents(spark, sf_dir)))
    return rounded(summaries.check_metrics(checks).select("id", "kind", "metric", "value"))


@query(f"WITH {B.METRICS}, {_DOC} SELECT run AS id, kind, 'min_auc' AS key, 0.4::DOUBLE AS threshold FROM docs WHERE kind <> 'artifact_batch' AND auc IS NOT NULL UNION ALL SELECT run, kind, 'max_chamfer', 0.25 FROM docs WHERE kind <> 'artifact_batch' AND run % 3 <> 0")
def check_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = summaries.checks_of(summaries.parsed(_documents(spark, sf_dir)))
    return summaries.check_gates(checks).select("id", "kind", "key", "threshold")


@query(
    """WITH f AS (
  SELECT event_id AS frame, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 1300 END AS raw, event_id % 211 AS filtered, event_type = 'error' AND value < 20 AS low, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 1009 END AS map_points,
    value / 40 AS rmse, CASE WHEN event_id % 3 = 0 THEN value / 30 END AS weighted, (event_id % 31) / 20.0 AS improvement, (event_id % 7) / 4.0 AS after_mean, (event_id % 11) / 8.0 AS initial_delta, (event_id % 13) / 10.0 AS prediction_delta,
    0.9 + (event_id % 19) / 190.0 AS fitness, (event_id % 23) / 30.0 AS inlier, event_id % 2 AS debug, event_id % 29 = 0 AS debug_error FROM events
), s AS (SELECT *, coalesce(weighted, rmse) AS cost FROM f), h AS (
  SELECT frame, list_filter([
    CASE WHEN raw < 50 THEN 'sparse_raw_scan' END, CASE WHEN raw >= 1000 AND filtered < 50 AND filtered / raw < 0.02 THEN 'filtering_too_aggressive' END, CASE WHEN low OR filtered < 50 THEN 'scan_quality_issue' END, CASE WHEN map_points < 100 THEN 'map_too_sparse' END,
    CASE WHEN improvement >= 0.5 AND after_mean <= 0.75 AND initial_delta >= 0.5 THEN 'bad_initial_guess' END, CASE WHEN debug = 1 AND cost >= 1.5 AND fitness >= 0.95 AND inlier <= 0.25 THEN 'scan_match_cost_hotspot' END,
    CASE WHEN debug = 1 AND cost >= 2.0 AND improvement < 0.1 AND inlier >= 0.5 THEN 'weak_geometry' END, CASE WHEN debug = 1 AND rmse >= 2.0 AND improvement >= 0.25 AND (prediction_delta >= 0.75 OR initial_delta >= 0.75) THEN 'registration_local_minimum' END,
    CASE WHEN debug_error THEN 'scan_match_debug_error' END], lambda x: x IS NOT NULL) AS hits FROM s)
SELECT frame, coalesce(hits[1], 'needs_review') AS label, CASE WHEN hits[1] IS NULL THEN 'low' WHEN hits[1] IN ('sparse_raw_scan', 'filtering_too_aggressive', 'scan_quality_issue', 'map_too_sparse', 'bad_initial_guess') THEN 'high' ELSE 'medium' END AS confidence, array_to_string(hits[2:], ',') AS secondary FROM h"""
)
def frame_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine rules over every event as a frame."""
    i = F.col("event_id")
    e = B.table(spark, sf_dir, "events")
    frames = e.select(
        i.alias("frame"), F.when(i % 17 != 0, i % 1300).alias("raw_points"), (i % 211).alias("filtered_points"), ((F.col("event_type") == "error") & (F.col("value") < 20)).cast("int").alias("low_quality"), F.when(i % 5 != 0, i % 1009).alias("map_points"),
        (F.col("value") / 40).alias("rmse"), F.when(i % 3 == 0, F.col("value") / 30).alias("weighted_rmse"), ((i % 31) / 20.0).alias("improvement"), ((i % 7) / 4.0).alias("after_mean"), ((i % 11) / 8.0).alias("initial_delta"), ((i % 13) / 10.0).alias("prediction_delta"),
        (0.9 + (i % 19) / 190.0).alias("fitness"), ((i % 23) / 30.0).alias("inlier_rmse"), (i % 2).alias("has_debug"), (i % 29 == 0).cast("int").alias("has_debug_error"),
    )
    return summaries.diagnosed(frames).select("frame", "label", "confidence", F.array_join("secondary", ",").alias("secondary"))
