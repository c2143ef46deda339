"""Every operator as a query over the benchmark tables, with the SQL of its rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import align, boxes, evaluate, gates, graph, ground, images, points, progressive, structure, trajectory
from cairn.plans import bindings as B
from cairn.plans.registry import ORACLES, QUERIES, query, rounded
from cairn.streaming import monitor

DAY, USER = 86_400.0, ["user_id"]


# clouds


@query(f"WITH {B.CLOUD} SELECT cloud_id, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z FROM cloud GROUP BY 1")
def cloud_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.info(B.events_cloud(spark, sf_dir), ["cloud_id"]))


_LONG = "long AS (SELECT 'x' AS axis, x AS v FROM cloud UNION ALL SELECT 'y', y FROM cloud UNION ALL SELECT 'z', z FROM cloud)"
_CUTS = "cuts AS (SELECT axis, min(v) AS least, max(v) AS most, quantile_cont(v, 0.01) AS p_low, quantile_cont(v, 0.5) AS p_mid, quantile_cont(v, 0.99) AS p_high FROM long GROUP BY 1)"


@query(
    f"""WITH {B.CLOUD}, {_LONG}, {_CUTS}, o AS (
  SELECT count(*) FILTER (WHERE b) AS n_outside, avg(b::INT) AS outside_ratio FROM (SELECT x < (SELECT p_low FROM cuts WHERE axis = 'x') OR x > (SELECT p_high FROM cuts WHERE axis = 'x') OR y < (SELECT p_low FROM cuts WHERE axis = 'y')
    OR y > (SELECT p_high FROM cuts WHERE axis = 'y') OR z < (SELECT p_low FROM cuts WHERE axis = 'z') OR z > (SELECT p_high FROM cuts WHERE axis = 'z') AS b FROM cloud))
SELECT axis, round(least, 6) AS least, round(most, 6) AS most, round(most - least, 6) AS extent, round(p_low, 6) AS p_low, round(p_mid, 6) AS p_mid, round(p_high, 6) AS p_high, round(p_high - p_low, 6) AS robust_extent, n_outside, round(outside_ratio, 6) AS outside_ratio FROM cuts, o"""
)
def axis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.axis_summary(B.events_cloud(spark, sf_dir)))


@query(f"WITH {B.CLOUD} SELECT pid, cloud_id, x, y, z FROM cloud WHERE x BETWEEN 1 AND 8 AND y BETWEEN 6 AND 18 AND z BETWEEN 3 AND 20")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.crop(B.events_cloud(spark, sf_dir), (1, 6, 3), (8, 18, 20)).select("pid", "cloud_id", "x", "y", "z")


@query(
    f"""WITH {B.CLOUD}, b AS (SELECT min(x) - 0.5 AS x0, max(x) + 0.5 AS x1, min(y) - 0.5 AS y0, max(y) + 0.5 AS y1, min(z) - 0.5 AS z0, max(z) + 0.5 AS z1 FROM src)
SELECT pid, x, y, z FROM dst, b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1"""
)
def crop_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = B.cloud_pair(spark, sf_dir)
    return points.crop_around(target, source, 0.5).select("pid", "x", "y", "z")


@query(f"WITH {B.CLOUD} SELECT pid, round(-y + 1, 9) AS x, round(x + 2, 9) AS y, round(z * 0.5 - 3, 9) AS z FROM cloud")
def transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = points.transform(B.events_cloud(spark, sf_dir), [[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 0.5, -3], [0, 0, 0, 1]])
    return rounded(turned.select("pid", "x", "y", "z"), 9)


@query(f"WITH {B.CLOUD}, m AS (SELECT 'a' AS cloud_id, x FROM src UNION ALL SELECT 'b', x FROM dst) SELECT cloud_id, count(*) AS n, round(min(x), 6) AS least FROM m GROUP BY 1")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = B.cloud_pair(spark, sf_dir)
    return rounded(points.merge(a=source, b=target).groupBy("cloud_id").agg(F.count("*").alias("n"), F.min("x").alias("least")))


@query(f"WITH {B.CLOUD} SELECT pid, x, y, z FROM cloud ORDER BY md5('7:' || pid), pid LIMIT 500")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.sample(B.events_cloud(spark, sf_dir), 500).select("pid", "x", "y", "z")


@query(f"WITH {B.DENSE} SELECT floor(x / 5)::BIGINT AS vx, floor(y / 5)::BIGINT AS vy, floor(z / 5)::BIGINT AS vz, count(*) AS n, round(avg(x), 4) AS x, round(avg(y) + 1e-9, 4) AS y, round(avg(z), 4) AS z FROM dense GROUP BY 1, 2, 3")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = points.voxel_downsample(B.dense_cloud(spark, sf_dir), 5.0)
    return rounded(thin.withColumn("y", F.col("y") + 1e-9), 4)  # prices end in halves of the last digit


@query(
    f"""WITH {B.DENSE} SELECT floor(x / 10)::BIGINT AS vx, floor(y / 10)::BIGINT AS vy, floor(z / 10)::BIGINT AS vz, count(*) AS n, round(avg(x), 5) AS mx, round(avg(y), 5) AS my, round(avg(z), 5) AS mz,
  round(coalesce(covar_samp(x, x), 1e-6), 5) AS cxx, round(coalesce(covar_samp(x, y), 0), 5) AS cxy, round(coalesce(covar_samp(x, z), 0), 5) AS cxz, round(coalesce(covar_samp(y, y), 1e-6), 5) AS cyy, round(coalesce(covar_samp(y, z), 0), 5) AS cyz, round(coalesce(covar_samp(z, z), 1e-6), 5) AS czz
FROM dense GROUP BY 1, 2, 3"""
)
def voxel_gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.voxel_gaussians(B.dense_cloud(spark, sf_dir), 10.0), 5)


@query(
    f"""WITH {B.CLOUD}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, greatest(1, ceil((max(x) - min(x)) / 0.5)) AS nx, greatest(1, ceil((max(y) - min(y)) / 0.5)) AS ny FROM cloud)
SELECT least(floor((x - x0) / ((x1 - x0) / nx)), nx - 1)::BIGINT AS i, least(floor((y - y0) / ((y1 - y0) / ny)), ny - 1)::BIGINT AS j, count(*) AS n FROM cloud, b GROUP BY 1, 2"""
)
def density_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.density_map(B.events_cloud(spark, sf_dir), 0.5)


@query(f"WITH {B.CLOUD}, b AS (SELECT min(x) AS x0, min(y) AS y0 FROM cloud) SELECT floor((x - x0) / 3)::BIGINT AS tile_i, floor((y - y0) / 3)::BIGINT AS tile_j, count(*) AS n, round(min(z), 6) AS low FROM cloud, b GROUP BY 1, 2")
def tile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.tiles(B.events_cloud(spark, sf_dir), 3.0).groupBy("tile_i", "tile_j").agg(F.count("*").alias("n"), F.min("z").alias("low")))


_NEAR = "near AS (SELECT s.pid, min(sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)) AS d FROM src s, dst t GROUP BY 1)"
_BACK = "back AS (SELECT t.pid, min(sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)) AS d FROM src s, dst t GROUP BY 1)"


@query(f"WITH {B.CLOUD}, {_NEAR} SELECT pid, round(d, 9) AS d FROM near")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.nearest(*B.cloud_pair(spark, sf_dir)).select("pid", "d"), 9)


def _knn(k: int) -> str:
    """The k nearest other points of each point of the whole cloud, as the k smallest of (distance, id)."""
    return f"""knn AS (SELECT pid, unnest(list_transform(k, lambda e, i: {{'rank': i, 'd': e.d, 'other': e.other}}), recursive := true) FROM (
  SELECT s.pid, min({{'d': sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2), 'other': t.pid}}, {k}) AS k FROM cloud s JOIN cloud t ON s.pid <> t.pid GROUP BY 1))"""


@query(f"WITH {B.CLOUD}, {_knn(4)} SELECT pid, rank::INT AS rank, round(d, 9) AS d FROM knn")
def nearest_neighbours_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = B.events_cloud(spark, sf_dir)
    return rounded(points.nearest(cloud, cloud, k=4, apart=True).select("pid", "rank", "d"), 9)


@query(f"WITH {B.CLOUD} SELECT s.pid, count(*) AS n FROM src s JOIN dst t ON (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 <= 1.0 GROUP BY 1")
def radius_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.within(*B.cloud_pair(spark, sf_dir), 1.0).groupBy("pid").agg(F.count("*").alias("n"))


@query(f"WITH {B.CLOUD}, {_NEAR} SELECT count(d) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(max(d), 6) AS most, round(min(d), 6) AS least, round(stddev_pop(d), 6) AS std FROM near")
def distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.summary(points.nearest(*B.cloud_pair(spark, sf_dir))))


@query(f"WITH {B.CLOUD}, {_NEAR} SELECT count(d) AS n, count(*) FILTER (WHERE d > 0.3) AS n_beyond, round(avg((d > 0.3)::INT), 6) AS beyond_ratio FROM near")
def threshold_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.exceedance(points.nearest(*B.cloud_pair(spark, sf_dir)), 0.3))


_SCORES = """t AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 1.0]) AS threshold), scores AS (
  SELECT threshold, (SELECT avg((d <= threshold)::INT) FROM near) AS precision, (SELECT avg((d <= threshold)::INT) FROM back) AS recall FROM t
), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM scores)"""


@query(f"WITH {B.CLOUD}, {_NEAR}, {_BACK}, {_SCORES} SELECT threshold::DOUBLE AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def fscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = B.cloud_pair(spark, sf_dir)
    return rounded(evaluate.fscores(points.nearest(source, target), points.nearest(target, source)))


@query(
    f"""WITH {B.CLOUD}, {_NEAR}, {_BACK}, {_SCORES}, a AS (
  SELECT sum((nt - threshold) * (nf + f1) / 2) / (max(threshold) - min(threshold)) AS auc FROM (SELECT *, lead(threshold) OVER (ORDER BY threshold) AS nt, lead(f1) OVER (ORDER BY threshold) AS nf FROM f))
SELECT round(((SELECT avg(d) FROM near) + (SELECT avg(d) FROM back)) / 2, 6) AS chamfer, round(greatest((SELECT max(d) FROM near), (SELECT max(d) FROM back)), 6) AS hausdorff, round((SELECT auc FROM a), 6) AS auc,
  round((SELECT max(f1) FROM f), 6) AS best_f1, (SELECT threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1)::DOUBLE AS best_threshold"""
)
def evaluate_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.evaluate(*B.cloud_pair(spark, sf_dir)))


@query(
    f"""WITH {B.CLOUD}, {_NEAR}, {_BACK}, r AS (
  SELECT (SELECT avg(d) FROM near) + (SELECT avg(d) FROM back) AS chamfer, (SELECT avg((d <= 0.1)::INT) FROM near) AS accuracy_0, (SELECT avg((d <= 0.2)::INT) FROM near) AS accuracy_1, (SELECT avg((d <= 0.5)::INT) FROM near) AS accuracy_2,
    (SELECT avg((d <= 0.1)::INT) FROM back) AS completeness_0, (SELECT avg((d <= 0.2)::INT) FROM back) AS completeness_1, (SELECT avg((d <= 0.5)::INT) FROM back) AS completeness_2)
SELECT round(chamfer, 6) AS chamfer, round(accuracy_0, 6) AS accuracy_0, round(accuracy_1, 6) AS accuracy_1, round(accuracy_2, 6) AS accuracy_2, round(completeness_0, 6) AS completeness_0, round(completeness_1, 6) AS completeness_1, round(completeness_2, 6) AS completeness_2,
  round(CASE WHEN accuracy_0 + completeness_0 > 0 THEN 2 * accuracy_0 * completeness_0 / (accuracy_0 + completeness_0) ELSE 0 END, 6) AS fscore FROM r"""
)
def evaluate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.evaluate_map(*B.cloud_pair(spark, sf_dir)))


@query(
    f"""WITH {B.CLOUD}, {_knn(1)}, b AS (SELECT count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS volume FROM cloud)
SELECT n, round(volume, 6) AS volume, round(n / volume, 6) AS density, (SELECT round(avg(d), 6) FROM knn) AS mean_d, (SELECT round(median(d), 6) FROM knn) AS median_d, (SELECT round(min(d), 6) FROM knn) AS min_d, (SELECT round(max(d), 6) FROM knn) AS max_d, (SELECT round(stddev_pop(d), 6) FROM knn) AS std_d FROM b"""
)
def cloud_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.spacing(B.events_cloud(spark, sf_dir)))


@query(
    f"""WITH {B.CLOUD}, {_knn(9)}, m AS (SELECT pid, sum(d) / 10 AS mean_d FROM knn GROUP BY 1), l AS (SELECT avg(mean_d) + 1.5 * stddev_samp(mean_d) AS limit_d FROM m)
SELECT pid, round(mean_d, 6) AS mean_d, mean_d <= limit_d AS inlier FROM m, l"""
)
def outlier_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.outliers(B.events_cloud(spark, sf_dir), 10, 1.5))


@query(
    f"""WITH {B.CLOUD}, {_knn(10)}, c AS (SELECT k.pid, covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, y) AS yy, covar_samp(y, z) AS yz, covar_samp(z, z) AS zz FROM knn k JOIN cloud c ON c.pid = k.other GROUP BY 1)
SELECT count(*) AS n, round(avg(0.5 * ln(abs(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) + 1e-10)), 4) AS entropy FROM c"""
)
def mean_map_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.mean_map_entropy(B.events_cloud(spark, sf_dir), 10), 4)


@query(
    f"""WITH {B.CLOUD}, k AS (SELECT DISTINCT floor(x / 2)::BIGINT AS x, floor(y / 2)::BIGINT AS y, floor(z / 2)::BIGINT AS z FROM cloud), p AS (
  SELECT a.x, a.y, a.z, count(b.x) / 26.0 AS p FROM k a LEFT JOIN k b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND (a.x, a.y, a.z) <> (b.x, b.y, b.z) GROUP BY 1, 2, 3
), e AS (SELECT CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END AS h FROM p)
SELECT count(*) AS voxels, round(avg(h), 6) AS entropy, round(greatest(0, 1 - avg(h)), 6) AS consistency FROM e"""
)
def voxel_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.voxel_entropy(B.events_cloud(spark, sf_dir), 2.0))


@query(f"WITH {B.CLOUD} SELECT pid, round(least(greatest(x / 7, 0), 1), 6) AS r, round(1 - least(greatest(x / 7, 0), 1), 6) AS g, 0.0::DOUBLE AS b FROM cloud")
def error_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.events_cloud(spark, sf_dir).select("pid", *[v.alias(k) for k, v in points.error_color("x", 7.0).items()]))


@query(f"WITH {B.CLOUD}, v AS (SELECT pid, y / 24 AS v FROM cloud) SELECT pid, round(least(greatest(1.5 - abs(4 * v - 3), 0), 1), 6) AS r, round(least(greatest(1.5 - abs(4 * v - 2), 0), 1), 6) AS g, round(least(greatest(1.5 - abs(4 * v - 1), 0), 1), 6) AS b FROM v")
def colormap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.events_cloud(spark, sf_dir).select("pid", *[v.alias(k) for k, v in points.jet(F.col("y") / 24).items()]))


@query(f"WITH {B.CLOUD} SELECT pid, x FROM cloud WHERE 1 / (1 + exp(-(x - 5))) >= 0.6")
def opacity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.opacity_filter(B.events_cloud(spark, sf_dir).withColumn("opacity", F.col("x") - 5), 0.6).select("pid", "x")


# ground


def _confusion_sql(keys: str = "", tail: str = "") -> str:
    flags = f"f AS (SELECT {keys} floor(x / 2)::BIGINT AS vx, floor(y / 2)::BIGINT AS vy, floor(z / 2)::BIGINT AS vz, bool_or(eg) AS eg, bool_or(NOT eg) AS en, bool_or(rg) AS rg, bool_or(NOT rg) AS rn FROM dense{tail} GROUP BY ALL)"
    return f"""{flags}, c AS (SELECT count(*) FILTER (WHERE eg AND rg) AS tp, count(*) FILTER (WHERE eg AND rn) AS fp, count(*) FILTER (WHERE en AND rg) AS fn, count(*) FILTER (WHERE en AND rn) AS tn FROM f),
m AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c)
SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(tp / (tp + fp + fn), 6) AS iou, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM m"""


@query(f"WITH {B.DENSE}, " + _confusion_sql())
def ground_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ground.voxel_confusion(B.dense_cloud(spark, sf_dir), 2.0))


@query(f"WITH {B.DENSE}, b AS (SELECT min(z) - greatest(0.01 * (max(z) - min(z)), 1e-6) AS z0, (max(z) - min(z) + 2 * greatest(0.01 * (max(z) - min(z)), 1e-6)) / 5 AS w FROM dense), " + _confusion_sql("least(floor((z - z0) / w), 4) AS band,", ", b"))
def ground_height_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ground.band_confusion(B.dense_cloud(spark, sf_dir), 2.0))


# trajectories


@query(f"WITH {B.MATCHED} SELECT user_id, round(t, 3) AS t, round(ex, 6) AS ex, round(ey, 6) AS ey, round(ez, 6) AS ez, round(dt, 3) AS dt FROM hit")
def interpolated_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.interpolated_join(*B.trajectories(spark, sf_dir), DAY, USER)
    return out.select("user_id", F.round("t", 3).alias("t"), *[F.round(f"e{c}", 6).alias(f"e{c}") for c in "xyz"], F.round("dt", 3).alias("dt"))


@query(
    f"""WITH {B.TRACKS}, n AS (
  SELECT e.user_id, e.t, p.t AS pt, p.x AS px, q.t AS qt, q.x AS qx FROM est e ASOF LEFT JOIN ref p ON e.user_id = p.user_id AND e.t > p.t ASOF LEFT JOIN ref q ON e.user_id = q.user_id AND e.t <= q.t
), m AS (SELECT user_id, t, CASE WHEN qt IS NULL OR t - pt <= qt - t THEN pt ELSE qt END AS rt, CASE WHEN qt IS NULL OR t - pt <= qt - t THEN px ELSE qx END AS rx FROM n)
SELECT user_id, round(t, 3) AS t, round(rt, 3) AS rt, round(rx, 6) AS rx FROM m WHERE abs(t - rt) <= 43200"""
)
def nearest_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, est = B.trajectories(spark, sf_dir)
    out = trajectory.nearest_time_join(est, ref, DAY / 2, USER)
    return out.select("user_id", F.round("t", 3).alias("t"), F.round("rt", 3).alias("rt"), F.round("rx", 6).alias("rx"))


_ERRORS = (
    B.MATCHED
    + """, s AS (
  SELECT *, ex - rx AS dx, ey - ry AS dy, ez - rz AS dz, sqrt((ex - rx) ** 2 + (ey - ry) ** 2 + (ez - rz) ** 2) AS error,
    lead(rx) OVER w AS nx, lead(ry) OVER w AS ny, lead(rz) OVER w AS nz, lead(ex) OVER w AS nex, lead(ey) OVER w AS ney, lead(ez) OVER w AS nez, lag(rx) OVER w AS lx, lag(ry) OVER w AS ly, lag(rz) OVER w AS lz
  FROM hit WINDOW w AS (PARTITION BY user_id ORDER BY t)
), g AS (SELECT *, coalesce(nx, rx) - coalesce(lx, rx) AS gx, coalesce(ny, ry) - coalesce(ly, ry) AS gy, coalesce(nz, rz) - coalesce(lz, rz) AS gz FROM s
), h AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS gn FROM g
), e AS (SELECT *, (dx * gx + dy * gy + dz * gz) / CASE WHEN gn < 1e-12 THEN 1 ELSE gn END AS longitudinal, sqrt((nex - ex - nx + rx) ** 2 + (ney - ey - ny + ry) ** 2 + (nez - ez - nz + rz) ** 2) AS step_error, sqrt((nx - rx) ** 2 + (ny - ry) ** 2 + (nz - rz) ** 2) AS step FROM h
), f AS (SELECT *, sqrt(greatest(error ** 2 - longitudinal ** 2, 0)) AS side FROM e)"""
)


@query(
    f"""WITH {_ERRORS}, a AS (
  SELECT user_id, count(*) AS matched, sqrt(avg(error ** 2)) AS ate_rmse, avg(error) AS ate_mean, max(error) AS ate_max, sqrt(avg(step_error ** 2)) AS rpe_rmse, sqrt(avg(side ** 2)) AS lateral_rmse, sqrt(avg(longitudinal ** 2)) AS longitudinal_rmse, coalesce(sum(step), 0) AS length, avg(dt) AS mean_dt,
    sqrt((arg_max(dx, t) - arg_min(dx, t)) ** 2 + (arg_max(dy, t) - arg_min(dy, t)) ** 2 + (arg_max(dz, t) - arg_min(dz, t)) ** 2) AS drift FROM f GROUP BY 1)
SELECT user_id, matched, round(ate_rmse, 5) AS ate_rmse, round(ate_mean, 5) AS ate_mean, round(ate_max, 5) AS ate_max, round(rpe_rmse, 5) AS rpe_rmse, round(lateral_rmse, 5) AS lateral_rmse, round(longitudinal_rmse, 5) AS longitudinal_rmse, round(length, 5) AS length, round(drift, 5) AS drift,
  round(CASE WHEN length > 0 THEN drift / length END, 5) AS drift_ratio, round(matched / poses, 5) AS coverage, round(mean_dt, 3) AS mean_dt
FROM a JOIN (SELECT user_id, count(*) AS poses FROM ref GROUP BY 1) USING (user_id) WHERE matched >= 2"""
)
def trajectory_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.evaluate(*B.trajectories(spark, sf_dir), DAY, USER)
    return rounded(out.drop("mean_dt"), 5).join(out.select("user_id", F.round("mean_dt", 3).alias("mean_dt")), "user_id")


@query(f"WITH {_ERRORS}, w AS (SELECT user_id, t, error, row_number() OVER (PARTITION BY user_id ORDER BY error DESC, t)::INT AS rank FROM f) SELECT user_id, rank, round(error, 5) AS error FROM w WHERE rank <= 5")
def worst_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trajectory.errors(trajectory.interpolated_join(*B.trajectories(spark, sf_dir), DAY, USER), USER)
    return rounded(trajectory.worst(e, USER).drop("t"), 5)


@query(f"WITH {_ERRORS}, o AS (SELECT user_id, t, ex + first_value(rx - ex) OVER w AS ex, ey + first_value(ry - ey) OVER w AS ey FROM hit WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, round(t, 3) AS t, round(ex, 6) AS ex, round(ey, 6) AS ey FROM o")
def origin_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.align_origin(trajectory.interpolated_join(*B.trajectories(spark, sf_dir), DAY, USER), USER)
    return out.select("user_id", F.round("t", 3).alias("t"), F.round("ex", 6).alias("ex"), F.round("ey", 6).alias("ey"))


@query(f"WITH {B.TRACKS}, s AS (SELECT user_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step FROM ref WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, count(*) AS poses, round(coalesce(sum(step), 0), 5) AS length FROM s GROUP BY 1")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trajectory.path_length(B.trajectories(spark, sf_dir)[0], USER), 5)


@query(
    f"""WITH {B.TRACKS}, d AS (SELECT user_id, t, x - lag(x) OVER w AS px, y - lag(y) OVER w AS py, z - lag(z) OVER w AS pz, lead(x) OVER w - x AS nx, lead(y) OVER w - y AS ny, lead(z) OVER w - z AS nz FROM ref WINDOW w AS (PARTITION BY user_id ORDER BY t)),
n AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS a, sqrt(nx * nx + ny * ny + nz * nz) AS b FROM d)
SELECT user_id, round(t, 3) AS t, round(CASE WHEN a > 0 AND b > 0 THEN acos(greatest(-1, least(1, (px * nx + py * ny + pz * nz) / (a * b)))) * least(a, b) ELSE 0 END, 4) AS score FROM n"""
)
def turn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.turn_scores(B.trajectories(spark, sf_dir)[0], USER).select("user_id", F.round("t", 3).alias("t"), F.round("score", 4).alias("score"))


@query(
    f"""WITH {B.TRACKS}, n AS (SELECT user_id, t, x, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ref),
k AS (SELECT DISTINCT user_id, round_even(j * (n - 1) / 19, 0) AS i FROM (SELECT DISTINCT user_id, n FROM n), range(20) r(j))
SELECT user_id, round(t, 3) AS t, x FROM n WHERE n <= 20 OR EXISTS (SELECT 1 FROM k WHERE k.user_id = n.user_id AND k.i = n.i)"""
)
def stride_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.stride(B.trajectories(spark, sf_dir)[0], 20, USER).select("user_id", F.round("t", 3).alias("t"), "x")


@query(f"WITH {B.MATCHED} SELECT user_id, round(t, 3) AS t, round(ex, 6) AS x FROM matched WHERE NOT none")
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, est = B.trajectories(spark, sf_dir)
    return trajectory.reconstruct(ref, est, USER).filter("x IS NOT NULL").select("user_id", F.round("t", 3).alias("t"), F.round("x", 6).alias("x"))


@query(
    f"""WITH {B.MATCHED}, d AS (SELECT user_id, ex - rx AS x, ey - ry AS y, ez - rz AS z FROM hit), v AS (SELECT user_id, var_samp(x) + 1 AS xx, var_samp(y) + 1 AS yy FROM d GROUP BY 1 HAVING count(*) > 1),
n AS (SELECT d.user_id, x * x / xx + y * y / yy + z * z AS nees FROM d JOIN v USING (user_id))
SELECT user_id, count(*) AS n, round(avg(nees), 5) AS mean_nees, round(avg(nees) / 3, 5) AS normalized, round(avg((nees <= 7.814727903251179)::INT), 5) AS coverage FROM n GROUP BY 1"""
)
def uncertainty_nees(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = trajectory.interpolated_join(*B.trajectories(spark, sf_dir), DAY, USER)
    d = hit.select("user_id", *[(F.col(f"e{c}") - F.col(f"r{c}")).alias(c) for c in "xyz"])
    v = d.groupBy("user_id").agg(F.count("*").alias("k"), (F.var_samp("x") + 1).alias("xx"), (F.var_samp("y") + 1).alias("yy")).filter("k > 1").drop("k")
    states = d.join(v, "user_id").withColumns({c: F.lit(0.0) for c in ("xy", "xz", "yz")} | {"zz": F.lit(1.0)})
    return rounded(trajectory.nees(states, USER), 5)


# boxes


@query(f"WITH {B.BOXES} SELECT frame, label, ref_idx, est_idx, round(iou, 6) AS iou FROM cand WHERE iou >= 0.1")
def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.candidates(*B.boxes(spark, sf_dir), 0.1).select("frame", "label", "ref_idx", "est_idx", "iou"))


@query(f"WITH {B.BOXES} SELECT count(DISTINCT frame) AS frames, count(*) AS boxes, count(DISTINCT track) AS tracks FROM base")
def sequence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.counts(B.boxes(spark, sf_dir)[0])


# gates and decisions

_LONG_METRICS = "m AS (UNPIVOT wide ON auc, chamfer, coverage INTO NAME metric VALUE value)"
_GATE_SQL = "gate AS (SELECT * FROM (VALUES ('max_chamfer', 'chamfer', 'max', 0.25::DOUBLE), ('min_auc', 'auc', 'min', 0.4), ('min_coverage', 'coverage', 'min', 0.45)) g(key, metric, side, threshold))"
_MARGINS = f"{B.METRICS}, {_LONG_METRICS}, {_GATE_SQL}, margins AS (SELECT run, series, metric, key, value, threshold, CASE side WHEN 'min' THEN value - threshold ELSE threshold - value END / greatest(abs(threshold), 1e-6) AS margin FROM m JOIN gate USING (metric))"


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = B.order_metrics(spark, sf_dir)
    long = wide.unpivot(["run", "series"], ["auc", "chamfer", "coverage"], "metric", "value")
    return gates.margins(long, gates.gate_rows(spark, B.GATE), ["run", "series"])


@query(f"WITH {B.METRICS} SELECT run, auc >= 0.4 AND chamfer <= 0.25 AND coverage >= 0.45 AS passed, (auc < 0.4)::INT + (chamfer > 0.25)::INT + (coverage < 0.45)::INT AS n_reasons FROM wide")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.wide_gate(B.order_metrics(spark, sf_dir), B.GATE).select("run", "passed", F.size("reasons").alias("n_reasons"))


@query(f"WITH {B.METRICS} SELECT run, auc >= 0.4 AND (coverage >= 0.45) AS overall FROM wide")
def overall_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = B.order_metrics(spark, sf_dir)
    both = gates.wide_gate(wide, {"min_auc": 0.4}).withColumnRenamed("passed", "map_passed")
    both = gates.wide_gate(both, {"min_coverage": 0.45}).withColumnRenamed("passed", "track_passed")
    none = gates.wide_gate(both, {}).withColumnRenamed("passed", "no_gate")
    return gates.overall(none, "map_passed", "track_passed", "no_gate").select("run", "overall")


@query(
    f"""WITH {B.METRICS}, s AS (SELECT series, CASE WHEN run % 13 = 0 THEN 'skip' WHEN run % 7 = 0 THEN 'info' WHEN auc >= 0.45 THEN 'pass' WHEN run % 2 = 0 THEN 'warn' ELSE 'fail' END AS status FROM wide)
SELECT series, count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'warn') AS n_warn, 0::BIGINT AS n_soft_fail, count(*) FILTER (WHERE status = 'info') AS n_info, count(*) FILTER (WHERE status = 'skip') AS n_skip,
  count(*) FILTER (WHERE status = 'fail') > 0 AS blocked, (count(*) FILTER (WHERE status = 'fail') > 0)::INT AS exit_code FROM s GROUP BY 1"""
)
def gate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.order_metrics(spark, sf_dir)
    checks = w.withColumn("status", gates.status(F.when(F.col("run") % 7 != 0, F.col("auc") >= 0.45), F.when(F.col("run") % 2 == 0, "warn").otherwise("error"), F.col("run") % 13 == 0))
    return gates.policy(checks, by=["series"])


@query(f"WITH {_MARGINS} SELECT run, round(avg(margin), 6) AS mean_margin, round(min(margin), 6) AS worst_margin, round(avg((margin >= 0)::INT), 6) AS pass_ratio, count(*) AS gated FROM margins GROUP BY 1")
def normalized_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gates.margin_stats(_margins(spark, sf_dir), ["run"]))


_TRIAGE = f"{_MARGINS}, failed AS (SELECT run, sum(-margin) AS gap, count(*) AS failed, max(-margin) AS max_gap, string_agg(metric, ',' ORDER BY metric) AS signature FROM margins WHERE margin < 0 GROUP BY 1)"


@query(f"WITH {_TRIAGE} SELECT run, failed, round(gap, 6) AS gap, round(max_gap, 6) AS max_gap, signature, round(gap + 0.08 * (failed - 1), 6) AS score FROM failed")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gates.triage(_margins(spark, sf_dir), ["run"]))


@query(f"WITH {_TRIAGE}, c AS (SELECT signature, row_number() OVER (ORDER BY max(round(gap, 6)) DESC, count(*) DESC, signature)::INT AS cluster FROM failed GROUP BY 1) SELECT run, signature, row_number() OVER (PARTITION BY signature ORDER BY round(gap, 6) DESC, run)::INT AS turn, cluster FROM failed JOIN c USING (signature)")
def triage_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = rounded(gates.triage(_margins(spark, sf_dir), ["run"]))
    return gates.round_robin(failed, ["run"]).select("run", "signature", "turn", "cluster")


@query(f"WITH {B.METRICS} SELECT run, chamfer, auc FROM wide a WHERE NOT EXISTS (SELECT 1 FROM wide b WHERE (b.chamfer < a.chamfer AND b.auc >= a.auc) OR (b.chamfer <= a.chamfer AND b.auc > a.auc))")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.pareto(B.order_metrics(spark, sf_dir), "chamfer", "auc").select("run", "chamfer", "auc")


@query(f"WITH {B.METRICS}, p AS (SELECT * FROM wide a WHERE NOT EXISTS (SELECT 1 FROM wide b WHERE (b.chamfer < a.chamfer AND b.auc >= a.auc) OR (b.chamfer <= a.chamfer AND b.auc > a.auc))) SELECT run, chamfer, auc FROM p WHERE auc >= 0.4 ORDER BY chamfer, auc DESC, run LIMIT 1")
def recommended_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.recommended(B.order_metrics(spark, sf_dir), "chamfer", "auc", {"min_auc": 0.4}, ["run"]).select("run", "chamfer", "auc")


_STATS = f"{_MARGINS}, stats AS (SELECT run, series, round(avg(margin), 6) AS mean_margin, round(min(margin), 6) AS worst_margin, min(margin) >= -0.6 AS passed FROM margins GROUP BY 1, 2)"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gates.margin_stats(_margins(spark, sf_dir), ["run", "series"])
    return s.select("run", "series", F.round("mean_margin", 6).alias("mean_margin"), F.round("worst_margin", 6).alias("worst_margin"), (F.col("worst_margin") >= -0.6).alias("passed"))


@query(
    f"""WITH {_STATS}, h AS (SELECT *, sum(passed::INT) OVER w AS streak, mean_margin - avg(mean_margin) OVER w AS mg, worst_margin - avg(worst_margin) OVER w AS wg FROM stats WINDOW w AS (PARTITION BY series ORDER BY run ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))
SELECT run, series, CASE WHEN NOT passed THEN 'reject' WHEN coalesce(streak, 0) < 2 THEN 'keep' WHEN mg >= 0.03 AND wg >= -0.01 THEN 'promote' ELSE 'keep' END AS decision FROM h"""
)
def baseline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.window_decision(_stats(spark, sf_dir), "series", "run").select("run", "series", "decision")


@query(
    f"""WITH {_STATS}, h AS (SELECT *, max(mean_margin) OVER (PARTITION BY series ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM stats)
SELECT run, series, CASE WHEN NOT passed THEN 'reject' WHEN worst_margin >= 0 AND (best IS NULL OR mean_margin - best >= 0.03) THEN 'promote' ELSE 'keep' END AS decision FROM h"""
)
def baseline_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.guard_decision(_stats(spark, sf_dir), "series", "run").select("run", "series", "decision")


@query(f"WITH {B.METRICS} SELECT run, series, row_number() OVER (PARTITION BY series ORDER BY run DESC) <= 10 AS kept FROM wide")
def history_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.rotate(B.order_metrics(spark, sf_dir), "series", "run").select("run", "series", "kept")


@query(
    f"""WITH {B.METRICS}, p AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY run) AS place, auc FROM wide), b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY auc DESC, place) AS best FROM p)
SELECT series, round(sum(auc / place) / sum(auc / best), 6) AS ndcg FROM b GROUP BY 1"""
)
def ranking_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = B.order_metrics(spark, sf_dir).selectExpr("series", "auc", "row_number() OVER (PARTITION BY series ORDER BY run) AS place")
    return rounded(gates.ndcg(ranked, ["series"], "place", "auc"))


@query(f"WITH {B.METRICS}, a AS (SELECT run, auc AS old FROM wide WHERE run % 3 <> 0), b AS (SELECT run, CASE WHEN run % 2 = 0 THEN auc ELSE auc + 1 END AS new FROM wide WHERE run % 5 <> 0) SELECT run, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (run) WHERE old IS DISTINCT FROM new")
def bundle_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.order_metrics(spark, sf_dir)
    old = w.filter("run % 3 <> 0").select("run", F.col("auc").alias("value"))
    return gates.difference(old, w.filter("run % 5 <> 0").select("run", F.when(F.col("run") % 2 == 0, F.col("auc")).otherwise(F.col("auc") + 1).alias("value")), ["run"])


@query(f"WITH {B.METRICS} SELECT series, count(*) AS items, round(avg(auc), 6) AS mean, arg_min(run, (-auc, run)) AS best, arg_min(run, (auc, run)) AS worst FROM wide GROUP BY 1")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gates.best_and_worst(B.order_metrics(spark, sf_dir), ["series"], "auc", "run"))


@query(
    """WITH f AS (SELECT user_id, event_id AS frame, event_type = 'error' AS failed, event_id % 4 AS consecutive, value < 10 AS low_quality, event_id % 3 AS retries, value / 100 AS cost, (event_id % 10) / 10 AS rejection FROM events),
s AS (SELECT *, failed::INT * 1e6 + consecutive * 1e4 + low_quality::INT * 1e3 + retries * 100 + cost * 10 + rejection * 5 AS score FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, frame)::INT AS rank FROM s)
SELECT user_id, frame, rank, CASE WHEN failed THEN 'match failed' WHEN low_quality THEN 'low quality' WHEN retries > 0 THEN 'retried' WHEN rejection > 0.5 THEN 'many rejections' ELSE 'needs review' END AS diagnosis FROM r WHERE rank <= 10"""
)
def slam_frame_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events")
    frames = e.select("user_id", F.col("event_id").alias("frame"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 4).alias("consecutive"), (F.col("value") < 10).alias("low_quality"), (F.col("event_id") % 3).alias("retries"), (F.col("value") / 100).alias("cost"), ((F.col("event_id") % 10) / 10).alias("rejection"), F.lit(0.0).alias("shift"))
    return gates.frame_ranking(frames, USER, 10).select("user_id", "frame", "rank", "diagnosis")


@query()
def pareto_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = gates.margin_stats(_margins(spark, sf_dir), ["run"]).filter("worst_margin < 0")
    return gates.pareto_fronts(items, "worst_margin", "mean_margin").select("run", "front")


# graphs and images

_GRAPH = "edges AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem), vertices AS (SELECT p_partkey AS id FROM part)"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An edge for each order line, between its part and its supplier."""
    e = B.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), e


@query(
    f"""WITH {_GRAPH}, p AS (SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS n FROM edges GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT id) FROM vertices) AS vertices, (SELECT count(DISTINCT id) FROM vertices WHERE id NOT IN (SELECT u FROM p WHERE u <> v UNION SELECT v FROM p WHERE u <> v)) AS isolated, sum(n)::BIGINT AS edges, coalesce(sum(n) FILTER (WHERE u = v), 0)::BIGINT AS self_loops, coalesce(sum(n - 1) FILTER (WHERE u <> v), 0)::BIGINT AS duplicates,
  (SELECT count(*) FROM (SELECT a FROM edges UNION SELECT b FROM edges) WHERE a NOT IN (SELECT id FROM vertices)) AS missing FROM p"""
)
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(*_graph(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_GRAPH}, d AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), r AS (SELECT id AS node, id AS reached FROM vertices UNION SELECT r.node, d.b FROM r JOIN d ON d.a = r.reached)
SELECT node AS id, min(reached) AS component FROM r GROUP BY 1"""
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components_with_isolated(*_graph(spark, sf_dir))


_PIXELS = "p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_MSE = f"{_PIXELS}, m AS (SELECT vec_id, count(*) AS pixels, avg((x / 2 - y / 2) ** 2) AS mse FROM p GROUP BY 1)"


def _psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    long = pairs.select("vec_id", F.explode(F.arrays_zip("embedding", "next")).alias("v")).select("vec_id", ((F.col("v.embedding").cast("double") + 1) / 2).alias("a"), ((F.col("v.next").cast("double") + 1) / 2).alias("b"))
    return images.psnr(long, ["vec_id"])


@query(f"WITH {_MSE} SELECT vec_id, pixels, round(mse, 6) AS mse, round(CASE WHEN mse > 0 THEN 10 * log10(1 / mse) ELSE 'inf'::DOUBLE END, 6) AS psnr FROM m")
def image_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_psnr(spark, sf_dir))


@query(f"WITH {_MSE}, v AS (SELECT CASE WHEN mse > 0 THEN 10 * log10(1 / mse) END AS psnr FROM m) SELECT count(*) AS images, count(psnr) AS finite, round(avg(psnr), 6) AS mean, round(median(psnr), 6) AS median, round(min(psnr), 6) AS least, round(max(psnr), 6) AS most FROM v")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images.finite_summary(_psnr(spark, sf_dir)))


# alignment and structure


@query()
def rigid_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = trajectory.interpolated_join(*B.trajectories(spark, sf_dir), DAY, USER)
    return rounded(align.rmse(align.aligned(matched, USER), USER), 5)


@query()
def voxel_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = B.dense_cloud(spark, sf_dir)
    w = structure.voxel_distances(dense.filter("ref_ground"), dense.filter("NOT ref_ground"), 10.0, 20)
    return rounded(structure.consistency(w), 4)


@query()
def surface_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.normals(B.events_cloud(spark, sf_dir), 10), 3)


@query()
def plane_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.plane_patches(B.dense_cloud(spark, sf_dir), 4.0, 12, 0.1).select("vx", "vy", "vz", "n", "planarity"), 4)


def _oriented(r: DataFrame, e: DataFrame) -> DataFrame:
    part = lambda df, s, i: df.select("frame", "label", F.col("idx").alias(i), *[F.col(p).alias(s + p) for p in boxes.PARTS], F.lit(0.0).alias(f"{s}yaw"))
    pairs = part(r, "a", "ref_idx").join(part(e, "b", "est_idx"), ["frame", "label"])
    return rounded(structure.oriented_iou(pairs).select("frame", "label", "ref_idx", "est_idx", "iou"))


@query(f"WITH {B.BOXES} SELECT frame, label, ref_idx, est_idx, round(iou, 6) AS iou FROM cand")
def oriented_box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes turned by nothing, so that SQL can tell their overlap; turned ones are in the tests."""
    return _oriented(*B.boxes(spark, sf_dir))


# order of display


@query(
    f"""WITH {B.CLOUD}, b AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS w FROM cloud),
c AS (SELECT pid, least(floor((x - x0) / w * 6), 5)::BIGINT AS i, least(floor((y - y0) / w * 6), 5)::BIGINT AS j, least(floor((z - z0) / w * 6), 5)::BIGINT AS k FROM cloud, b),
r AS (SELECT pid, row_number() OVER (ORDER BY ((i * 6 + j) * 6 + k) * 2654435761 % 4294967296, pid) - 1 AS rank FROM c)
SELECT pid, rank, CASE WHEN rank < 200 THEN 0 ELSE 1 + (rank - 200) // 100 END AS chunk FROM r"""
)
def spatial_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive.spatial_shuffle(B.events_cloud(spark, sf_dir), 200, 100)


@query()
def distance_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive.distance_shells(B.events_cloud(spark, sf_dir), 200, 100)


@query()
def voxel_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(progressive.reduced(B.events_cloud(spark, sf_dir), 400, 0.5), 4)


# streams


@query("WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, value FROM events) SELECT event_type, start, count(value) AS n, round(avg(value), 6) AS mean FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = B.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/").withColumn("ts", F.col("ts").cast("timestamp"))
    out = monitor.drained(monitor.windowed(stream, "ts", "value", ["event_type"], "1 day", "1 hour"))
    return rounded(out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "mean"))


from cairn.plans import more, checks  # noqa: E402, F401  register their queries too

__all__ = ["ORACLES", "QUERIES"]
