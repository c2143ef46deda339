"""How the benchmark tables stand for 3D data, as Spark frames and as the same SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.registry import mean, rounded_binary
from cairn.plans.storage import written

_SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each event: value, hour and day."""
    t = F.expr(_SECONDS)
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", t.alias("t"))
    return e.select(F.col("event_id").alias("pid"), F.col("event_type").alias("cloud_id"), (F.col("value") / 10).alias("x"), ((F.col("t") % 86400) / 3600).alias("y"), (F.floor(F.col("t") / 86400) % 31).cast("double").alias("z"))


CLOUD = """cloud AS (
  SELECT event_id AS pid, event_type AS cloud_id, value / 10 AS x, (epoch_us(ts) / 1e6 % 86400) / 3600 AS y, (floor(epoch_us(ts) / 1e6 / 86400) % 31)::DOUBLE AS z FROM events
), src AS (SELECT * FROM cloud WHERE cloud_id = 'click'), dst AS (SELECT * FROM cloud WHERE cloud_id = 'view')"""


def cloud_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cloud = events_cloud(spark, sf_dir)
    return cloud.filter("cloud_id = 'click'"), cloud.filter("cloud_id = 'view'")


def dense_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each order line: quantity, price and discount; the line status splits estimate and reference."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 2000).cast("double").alias("y"), (F.col("l_discount") * 100).cast("double").alias("z"), (F.col("l_returnflag") == "N").alias("est_ground"), (F.col("l_linestatus") == "O").alias("ref_ground"))


DENSE = """dense AS (
  SELECT l_quantity::DOUBLE AS x, (l_extendedprice / 2000)::DOUBLE AS y, (l_discount * 100)::DOUBLE AS z, l_returnflag = 'N' AS eg, l_linestatus = 'O' AS rg FROM lineitem
)"""


def trajectories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A trajectory pair for each user: views and clicks against the other events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.expr(_SECONDS).alias("t"), (F.col("value") / 10).alias("x"), (F.col("event_id") % 97 / 10).cast("double").alias("y"), (F.col("user_id") % 7 / 1.0).cast("double").alias("z"))
    ref = F.col("event_type").isin("view", "click")
    return e.filter(ref).drop("event_type"), e.filter(~ref).drop("event_type")


TRACKS = """poses AS (
  SELECT user_id, event_type IN ('view', 'click') AS is_ref, epoch_us(ts) / 1e6 AS t, value / 10 AS x, (event_id % 97) / 10.0::DOUBLE AS y, (user_id % 7)::DOUBLE AS z FROM events
), ref AS (SELECT * FROM poses WHERE is_ref), est AS (SELECT * FROM poses WHERE NOT is_ref)"""

#: The interpolated time join in SQL: two as-of joins, then the bracket rules. `most` is a day.
MATCHED = (
    TRACKS
    + """, bracket AS (
  SELECT r.user_id, r.t, r.x AS rx, r.y AS ry, r.z AS rz, p.t AS pt, p.x AS px, p.y AS py, p.z AS pz, q.t AS qt, q.x AS qx, q.y AS qy, q.z AS qz
  FROM ref r ASOF LEFT JOIN est p ON r.user_id = p.user_id AND r.t > p.t ASOF LEFT JOIN est q ON r.user_id = q.user_id AND r.t <= q.t
), matched AS (
  SELECT user_id, t, rx, ry, rz,
    CASE WHEN qt - t <= 1e-9 THEN qx WHEN pt IS NULL THEN qx WHEN qt IS NULL THEN px ELSE px + (t - pt) / (qt - pt) * (qx - px) END AS ex,
    CASE WHEN qt - t <= 1e-9 THEN qy WHEN pt IS NULL THEN qy WHEN qt IS NULL THEN py ELSE py + (t - pt) / (qt - pt) * (qy - py) END AS ey,
    CASE WHEN qt - t <= 1e-9 THEN qz WHEN pt IS NULL THEN qz WHEN qt IS NULL THEN pz ELSE pz + (t - pt) / (qt - pt) * (qz - pz) END AS ez,
    CASE WHEN qt - t <= 1e-9 THEN 0 WHEN pt IS NULL THEN qt - t WHEN qt IS NULL THEN t - pt ELSE least(t - pt, qt - t) END AS dt,
    greatest(CASE WHEN qt - t <= 1e-9 THEN 0 ELSE coalesce(t - pt, 0) END, CASE WHEN qt - t <= 1e-9 THEN 0 ELSE coalesce(qt - t, 0) END) AS far, pt IS NULL AND qt IS NULL AS none
  FROM bracket
), hit AS (SELECT user_id, t, rx, ry, rz, ex, ey, ez, dt FROM matched WHERE NOT none AND far <= 86400)"""
)

_BOX = {"x": "l_quantity", "y": "l_linenumber * 5", "z": "l_discount * 100"}


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A box of side 4 for each order line, and the same shifted by its tax as the estimate. Lines are numbered once: a table, as
    boxes are read many times."""
    lines = table(spark, sf_dir, "lineitem")
    idx = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)").cast("long")
    base = lines.select(F.col("l_orderkey").alias("frame"), idx.alias("idx"), F.col("l_returnflag").alias("label"), *[F.expr(f"CAST({v} AS DOUBLE)").alias(f"c{c}") for c, v in _BOX.items()], *[F.lit(4.0).alias(f"s{c}") for c in "xyz"], (1 - F.col("l_discount")).cast("double").alias("score"), F.col("l_suppkey").alias("track"), F.col("l_tax").cast("double").alias("tax"))
    base = written(base.drop("sx", "sy", "sz"), "boxes")
    sides = {f"s{c}": F.lit(4.0) for c in "xyz"}
    base = base.withColumns(sides).select("frame", "idx", "label", "cx", "cy", "cz", *sides, "score", "track", "tax")
    return base.drop("tax"), base.withColumn("cx", F.col("cx") + 40 * F.col("tax")).drop("tax")


BOXES = """base AS (
  SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS idx, l_returnflag AS label,
    l_quantity::DOUBLE AS cx, (l_linenumber * 5)::DOUBLE AS cy, (l_discount * 100)::DOUBLE AS cz, (1 - l_discount)::DOUBLE AS score, l_suppkey AS track, l_tax::DOUBLE AS tax
  FROM lineitem
), pair AS (
  SELECT r.frame, r.label, r.idx AS ref_idx, e.idx AS est_idx, r.track AS ref_track, e.track AS est_track, e.score,
    greatest(least(r.cx + 2, e.cx + 40 * e.tax + 2) - greatest(r.cx - 2, e.cx + 40 * e.tax - 2), 0) * greatest(least(r.cy + 2, e.cy + 2) - greatest(r.cy - 2, e.cy - 2), 0) * greatest(least(r.cz + 2, e.cz + 2) - greatest(r.cz - 2, e.cz - 2), 0) AS both
  FROM base r JOIN base e ON r.frame = e.frame AND r.label = e.label
), cand AS (SELECT frame, label, ref_idx, est_idx, ref_track, est_track, score, CASE WHEN "both" > 0 THEN "both" / (128 - "both") ELSE 0 END AS iou FROM pair)"""


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each customer with its scores: long rows (run, series, at, metric, value)."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(mean("o_totalprice").alias("a"), F.stddev_pop("o_totalprice").alias("s"), F.count("*").alias("n"))
    wide = o.select(F.col("o_custkey").alias("run"), (F.col("o_custkey") % 20).alias("series"), *[rounded_binary(v, 4).alias(k) for k, v in {"auc": F.col("a") / 300000, "chamfer": F.col("s") / 300000, "coverage": F.col("n") / 20}.items()])
    return wide


METRICS = """wide AS (
  SELECT o_custkey AS run, o_custkey % 20 AS series, round(avg(o_totalprice) / 300000, 4) AS auc, round(stddev_pop(o_totalprice) / 300000, 4) AS chamfer, round(count(*) / 20, 4) AS coverage FROM orders GROUP BY o_custkey
)"""

GATE = {"max_chamfer": 0.25, "min_auc": 0.4, "min_coverage": 0.45}
