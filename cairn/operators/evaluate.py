"""Scores of one cloud against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.geometry import AXES, ratio
from cairn.operators.points import adapted, crop_around, detected, error_color, nearest, transform, voxel_downsample
from cairn.plans.ranking import quantiles
from cairn.plans.storage import written

THRESHOLDS = (0.05, 0.1, 0.2, 0.3, 0.5, 1.0)
#: Names of files that are broadcast at most.
BROADCAST_FILES = 100_000


def summary(distances: DataFrame, d: str = "d", by: list[str] | None = None) -> DataFrame:
    """Mean, median, largest, smallest and population standard deviation."""
    by = by or []
    out = distances.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.max(d).alias("most"), F.min(d).alias("least"), F.stddev_pop(d).alias("std"))
    median = quantiles(distances, d, [0.5], by).select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("p")[0].alias("median"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    out = out.join(median, same, "left") if by else out.crossJoin(median)  # one row each
    return out.select(*by, "n", "mean", "median", "most", "least", "std")


def exceedance(distances: DataFrame, threshold: float, d: str = "d") -> DataFrame:
    """How many distances, and which share, are strictly beyond the threshold."""
    return distances.agg(F.count(d).alias("n"), F.count_if(F.col(d) > threshold).alias("n_beyond"), F.avg((F.col(d) > threshold).cast("double")).alias("beyond_ratio"))


def fscores(there: DataFrame, back: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 at each threshold, from distances of source to target and back."""
    by = by or []
    both = there.select(*by, "d", F.lit(True).alias("there")).union(back.select(*by, "d", F.lit(False).alias("there")))
    limits = F.explode(F.array(*[F.lit(float(t)) for t in sorted(thresholds)])).alias("threshold")
    hit = (F.col("d") <= F.col("threshold")).cast("double")
    # one pass with a row for each distance and threshold, summed where it is read
    out = both.select(*by, "d", "there", limits).groupBy(*by, "threshold").agg(F.avg(F.when(F.col("there"), hit)).alias("precision"), F.avg(F.when(~F.col("there"), hit)).alias("recall"))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def area_under(scores: DataFrame, value: str = "f1", by: list[str] | None = None) -> DataFrame:
    """Trapezoid area under value by threshold over the thresholds' range; the value itself for one threshold."""
    by = by or []
    order = Window.partitionBy(*by).orderBy("threshold")  # as many rows as thresholds
    step = scores.withColumns({"__t": F.lead("threshold").over(order), "__v": F.lead(value).over(order)})
    area, width = F.sum((F.col("__t") - F.col("threshold")) * (F.col("__v") + F.col(value)) / 2), F.max("threshold") - F.min("threshold")
    return step.groupBy(*by).agg(F.when(width > 0, area / width).otherwise(F.max(value)).alias("auc"))


def evaluate(source: DataFrame, target: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Chamfer (half the sum of means) and Hausdorff distance, area under F1, and the best F1 with its threshold."""
    there, back = nearest(source, target), nearest(target, source)
    scores = fscores(there, back, thresholds)
    ends = there.agg(F.avg("d").alias("mean_there"), F.max("d").alias("most_there")).crossJoin(back.agg(F.avg("d").alias("mean_back"), F.max("d").alias("most_back")))  # one row each
    best = scores.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b")).select(F.col("b.f1").alias("best_f1"), (-F.col("b.t")).alias("best_threshold"))
    one = ends.select(((F.col("mean_there") + F.col("mean_back")) / 2).alias("chamfer"), F.greatest("most_there", "most_back").alias("hausdorff"))
    return one.crossJoin(area_under(scores)).crossJoin(best)


def cross(source: DataFrame, reference: DataFrame, kind: str = "auto", reference_kind: str = "auto", size: float = 0.0, samples: int = 8, least: float = 0.0, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Scores of one artifact against another of any representation (rows of points, splats or triangles), with where they come
    from: what was asked for and found on either side, rows before, points after, and the filters applied."""
    one, sides = None, {}
    for side, rows, asked in (("source", source, kind), ("reference", reference, reference_kind)):
        found = detected(rows)
        points = written(adapted(rows, found if asked == "auto" else asked, size, samples, least), side)
        said = points.agg(F.count("*").alias(f"{side}_points"), F.max("filters").alias(f"{side}_filters")).crossJoin(rows.agg(F.count("*").alias(f"{side}_rows")))  # one row each
        said = said.withColumns({f"{side}_asked": F.lit(asked), f"{side}_kind": F.lit(found)})
        sides[side] = points
        one = said if one is None else one.crossJoin(said)
    return evaluate(sides["source"], sides["reference"], thresholds).crossJoin(one)


def batch(files: DataFrame, reference: DataFrame, gate: dict[str, float] | None = None, thresholds: tuple[float, ...] = THRESHOLDS, sizes: DataFrame | None = None) -> DataFrame:
    """A row for each file (name, pid, x, y, z) with its scores against the one reference: chamfer, hausdorff, auc, best_f1 with
    its threshold (the first of equal ones), points, passed and reasons of the gate.

    sizes (name, baseline_bytes, compressed_bytes) adds size_ratio and saving. best: none of the others has both a smaller
    size_ratio (without sizes: fewer points) and a larger area, one of them strictly; recommended: of the best ones that pass, the
    one with the smallest. All files go through the same jobs, however many there are; in one direction each reference point
    seeks its neighbour in every file, which is the work asked for. Files without a sound point have no row.
    """
    from cairn.operators.gates import pareto, wide_gate

    rows = written(files.select("name", *AXES).withColumn("pid", F.monotonically_increasing_id()), "files")
    points = written(rows.groupBy("name").agg(F.count("*").alias("points")), "names")
    there = nearest(rows, reference).join(rows.select("pid", "name"), "pid").select("name", "d")
    each = reference.select("pid", *AXES).crossJoin(F.broadcast(points.select("name")) if points.count() <= BROADCAST_FILES else points.select("name"))
    back = nearest(each, rows, by="name").select("name", "d")
    scores = written(fscores(there, back, thresholds, ["name"]), "scores")
    a = there.groupBy("name").agg(F.avg("d").alias("mean_there"), F.max("d").alias("most_there"))
    b = back.groupBy("name").agg(F.avg("d").alias("mean_back"), F.max("d").alias("most_back"))
    best = scores.groupBy("name").agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b")).select("name", F.col("b.f1").alias("best_f1"), (-F.col("b.t")).alias("best_threshold"))
    out = a.join(b, "name").join(area_under(scores, by=["name"]), "name").join(best, "name").join(points, "name")
    out = out.select("name", ((F.col("mean_there") + F.col("mean_back")) / 2).alias("chamfer"), F.greatest("most_there", "most_back").alias("hausdorff"), "auc", "best_f1", "best_threshold", "points")
    less = "points"
    if sizes is not None:
        ratio_ = F.when(F.col("baseline_bytes") > 0, F.col("compressed_bytes") / F.col("baseline_bytes")).otherwise(F.when(F.col("compressed_bytes").isNotNull(), 0.0))
        out = out.join(sizes.select("name", ratio_.alias("size_ratio"), (1 - ratio_).alias("saving")), "name", "left")
        less = "size_ratio"
    gated = written(wide_gate(out, gate or {}), "batch")
    front = written(pareto(gated, less, "auc").select("name", less, "auc", "passed"), "front")
    chosen = front.filter(F.coalesce("passed", F.lit(True))).orderBy(less, F.desc("auc"), "name").limit(1).select("name", F.lit(True).alias("recommended"))
    return gated.join(front.select("name", F.lit(True).alias("best")), "name", "left").join(chosen, "name", "left").na.fill(False, ["best", "recommended"])


def compared(source: DataFrame, target: DataFrame, threshold: float, most: float | None = None) -> DataFrame:
    """Each source point with its distance to the target, whether it is beyond the threshold, and its colour from green to red
    at the threshold; with `most` the source is first brought onto the target (registration)."""
    if most is not None:
        from cairn.operators.align import icp

        source = transform(source.select("pid", *AXES), icp(source, target, most)[0])
    near = nearest(source, target).select("pid", "d", (F.col("d") > threshold).alias("beyond"))
    return near.select("*", *[v.alias(k) for k, v in error_color("d", threshold).items()])


def match_debug(scan: DataFrame, world: DataFrame, initial: list[list[float]], move: list[list[float]], size: float, margin: float) -> DataFrame:
    """How a scan's match improves its fit: mean distance to the map cut around it, before (initial pose) and after it
    (move times initial), and by how much; scan and map as voxel centroids."""
    thin = lambda df: voxel_downsample(df, size).withColumn("pid", F.xxhash64("vx", "vy", "vz")).select("pid", *AXES)
    before = transform(thin(scan), initial)
    after = transform(before, move)
    near = lambda df: nearest(df, thin(crop_around(world, df, margin))).agg(F.avg("d").alias("d"))
    out = near(before).withColumnRenamed("d", "before").crossJoin(near(after).withColumnRenamed("d", "after"))  # one row each
    return out.withColumn("improvement", F.col("before") - F.col("after"))


def evaluate_map(estimated: DataFrame, reference: DataFrame, size: float = 0.0, thresholds: tuple[float, ...] = (0.1, 0.2, 0.5)) -> DataFrame:
    """After voxel centroids: chamfer (sum of means), accuracy and completeness at each threshold, F-score at the first."""

    def thinned(cloud: DataFrame) -> DataFrame:
        return voxel_downsample(cloud, size).withColumn("pid", F.xxhash64("vx", "vy", "vz")) if size > 0 else cloud

    estimated, reference = thinned(estimated), thinned(reference)
    there, back = nearest(estimated, reference), nearest(reference, estimated)
    part = lambda t: F.avg((F.col("d") <= t).cast("double"))
    a = there.agg(F.avg("d").alias("mean_there"), *[part(t).alias(f"accuracy_{k}") for k, t in enumerate(thresholds)])
    b = back.agg(F.avg("d").alias("mean_back"), *[part(t).alias(f"completeness_{k}") for k, t in enumerate(thresholds)])
    out = a.crossJoin(b)  # one row each
    f = ratio(2 * F.col("accuracy_0") * F.col("completeness_0"), F.col("accuracy_0") + F.col("completeness_0"))
    return out.select((F.col("mean_there") + F.col("mean_back")).alias("chamfer"), *[c for c in out.columns if c[0] in "ac"], f.alias("fscore"))
