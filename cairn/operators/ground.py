"""Ground segmentation: estimated and reference ground and other points, compared voxel by voxel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.geometry import AXES, cell, ratio
from cairn.operators.points import nearest


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, IoU and accuracy from tp, fp, fn, tn; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "iou": ratio(tp, tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _flags(points: DataFrame, size: float, keys: list[str]) -> DataFrame:
    """Which of the four sets each key occurs in: one shuffle, whatever the sets' sizes."""
    placed = points.select(*keys, *[cell(F.col(c), size).alias(f"v{c}") for c in AXES], "est_ground", "ref_ground")
    return placed.groupBy(*keys, "vx", "vy", "vz").agg(F.bool_or("est_ground").alias("eg"), F.bool_or(~F.col("est_ground")).alias("en"), F.bool_or("ref_ground").alias("rg"), F.bool_or(~F.col("ref_ground")).alias("rn"))


def _confusion() -> list[F.Column]:
    return [F.count_if(F.col(a) & F.col(b)).alias(n) for a, b, n in (("eg", "rg", "tp"), ("eg", "rn", "fp"), ("en", "rg", "fn"), ("en", "rn", "tn"))]


def voxel_confusion(points: DataFrame, size: float) -> DataFrame:
    """points: x, y, z, est_ground, ref_ground (null: the point is not of that side). A voxel may count more than once."""
    return scores(_flags(points, size, []).agg(*_confusion()))


def band_confusion(points: DataFrame, size: float, bands: int = 5) -> DataFrame:
    """The same within bands of height over the range widened by a hundredth at both ends, and their sum."""
    r = points.agg(F.min("z"), F.max("z")).first()
    low, high = (r[0], r[1]) if r[0] is not None else (0.0, 0.0)
    pad = max(0.01 * (high - low), 1e-6)
    low, width = low - pad, (high - low + 2 * pad) / bands
    banded = points.withColumn("band", F.least(F.floor((F.col("z") - low) / width), F.lit(bands - 1)))
    per = _flags(banded, size, ["band"]).groupBy("band").agg(*_confusion())
    return scores(per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))


def transfer_confusion(estimated: DataFrame, reference: DataFrame) -> DataFrame:
    """estimated and reference: pid, x, y, z, ground. Each reference point takes the nearest estimated point's label."""
    near = nearest(reference, estimated).select("pid", "other")
    both = near.join(reference.select("pid", F.col("ground").alias("rg")), "pid").join(estimated.select(F.col("pid").alias("other"), F.col("ground").alias("eg")), "other")
    names = (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))
    return scores(both.agg(*[F.count_if((F.col("eg") == e) & (F.col("rg") == r)).alias(n) for n, e, r in names]))
