"""Images as long rows: image, y, x, value from 0 to 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.ranking import quantiles


def psnr(pairs: DataFrame, by: list[str], most: float = 1.0) -> DataFrame:
    """Peak signal-to-noise ratio of paired values a and b; infinite for equal images."""
    mse = F.avg((F.col("a") - F.col("b")) ** 2)
    return pairs.groupBy(*by).agg(F.count("*").alias("pixels"), mse.alias("mse")).withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(most * most / F.col("mse"))).otherwise(F.lit(float("inf"))))


def finite_summary(scores: DataFrame, value: str = "psnr") -> DataFrame:
    """Mean, median and bounds of the finite values, nulls if there are none."""
    v = F.when(F.abs(F.col(value)) < float("inf"), F.col(value))
    out = scores.agg(F.count("*").alias("images"), F.count(v).alias("finite"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))
    median = quantiles(scores.select(v.alias("v")), "v", [0.5]).select(F.col("p")[0].alias("median"))
    return out.crossJoin(median).select("images", "finite", "mean", "median", "least", "most")  # one row each


def _smooth(x: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    """Gaussian mean along the last two axes, images mirrored at their edges."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (-2, -1):
        size = x.shape[axis]
        at = np.arange(-radius, size + radius) % (2 * size)
        at = np.where(at < size, at, 2 * size - 1 - at)
        wide = np.take(x, at, axis=axis)
        x = sum(w * np.take(wide, np.arange(k, k + size), axis=axis) for k, w in enumerate(weights))
    return x


def structural_similarity(a: np.ndarray, b: np.ndarray, window: int = 11, sigma: float = 1.5, most: float = 1.0) -> np.ndarray:
    """Of images (n, height, width), each pair's mean structural similarity."""
    radius, c1, c2 = (window - 1) // 2, (0.01 * most) ** 2, (0.03 * most) ** 2
    ma, mb = _smooth(a, sigma, radius), _smooth(b, sigma, radius)
    va, vb, cov = _smooth(a * a, sigma, radius) - ma * ma, _smooth(b * b, sigma, radius) - mb * mb, _smooth(a * b, sigma, radius) - ma * mb
    return ((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean(axis=(1, 2))


def _edges(x: np.ndarray) -> np.ndarray:
    """Images under a 5 x 5 Laplacian of a Gaussian (deviation 1), zero around them."""
    u = np.arange(-2, 3)
    square = u[:, None] ** 2 + u**2
    kernel = (square - 2.0) * np.exp(-square / 2)
    wide = np.pad(x, ((0, 0), (2, 2), (2, 2)))
    return sum(kernel[i, j] * wide[:, i : i + x.shape[1], j : j + x.shape[2]] for i in range(5) for j in range(5))


def frequency_consistency(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of images (n, height, width), how far each one's edges are from the other's, over the other's, 0 to 1. Without edges in
    the other: 0 if neither has any, else 1."""
    ea, eb = _edges(np.clip(a, 0, 1)), _edges(np.clip(b, 0, 1))
    size = lambda e: np.sqrt((e**2).sum(axis=(1, 2)))
    least = np.finfo(float).eps * max(1.0, float(a.shape[1] * a.shape[2]))
    na, nb, gap = size(ea), size(eb), size(ea - eb)
    return np.where(nb <= least, np.where(na <= least, 0.0, 1.0), np.clip(gap / np.where(nb > 0, nb, 1.0), 0.0, 1.0))


def compared(pairs: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, ssim, fcm) of paired grey images of one size (key, a, b: arrays of height * width values, row by row); pairs of
    other sizes are left out."""
    n = height * width
    sound = pairs.filter((F.size("a") == n) & (F.size("b") == n)).select(key, F.col("a").cast("array<double>").alias("a"), F.col("b").cast("array<double>").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width) for k in (1, 2))
            scores = (structural_similarity(a, b), frequency_consistency(a, b)) if len(batch) else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s) for s in scores]], [key, "ssim", "fcm"])

    return sound.mapInArrow(run, sound.select(key, F.lit(0.0).alias("ssim"), F.lit(0.0).alias("fcm")).schema)


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(height, width, 3) red, green and blue from 0 to 1 of an image's bytes (blue, green, red, alpha, or grey)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    x = np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]
    return x / 255.0


def files_compared(rendered: DataFrame, reference: DataFrame) -> DataFrame:
    """(name, problem, psnr, ssim, fcm) of each rendered image (name, width, height, channels, data) against the reference image of
    its name. problem: missing (no such reference), mismatched (another size), else null with scores; alpha counts for nothing,
    structural similarity is the mean of the colours', consistency is that of grey values. Images may differ in size from pair to pair."""
    other = reference.select("name", *[F.col(c).alias(f"r_{c}") for c in ("width", "height", "channels", "data")])
    told = rendered.join(other, "name", "left")
    problem = F.when(F.col("r_width").isNull(), "missing").when((F.col("width") != F.col("r_width")) | (F.col("height") != F.col("r_height")), "mismatched")
    told = told.withColumn("problem", problem)
    grey = np.array([0.299, 0.587, 0.114])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = pixels(r["data"], r["height"], r["width"], r["channels"]), pixels(r["r_data"], r["height"], r["width"], r["r_channels"])
                mse = float(((a - b) ** 2).mean())
                planes = np.moveaxis(a, 2, 0), np.moveaxis(b, 2, 0)
                out.append((10 * np.log10(1 / mse) if mse > 0 else np.inf, structural_similarity(*planes).mean(), frequency_consistency((a @ grey)[None], (b @ grey)[None])[0]))
            columns = np.array(out).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(columns[:, k]) for k in range(3)]], ["name", "psnr", "ssim", "fcm"])

    scores = told.filter("problem IS NULL").select("name", "width", "height", "channels", "data", "r_channels", "r_data").mapInArrow(run, "name string, psnr double, ssim double, fcm double")
    none = [F.lit(None).cast("double").alias(c) for c in ("psnr", "ssim", "fcm")]
    return scores.select("name", F.lit(None).cast("string").alias("problem"), "psnr", "ssim", "fcm").union(told.filter("problem IS NOT NULL").select("name", "problem", *none))
