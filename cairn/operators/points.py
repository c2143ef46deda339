"""Point clouds: columns pid, x, y, z (and what else a cloud carries), one row a point."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.geometry import AXES, affine, cell, determinant, distance, norm, sigmoid
from cairn.operators.neighbours import finite, nearest
from cairn.plans.ranking import quantiles, ranked
from cairn.plans.storage import written

#: Cells of a coordinate around a point that hold its nearest neighbour if it is no farther than one cell.
NEAR = (-1, 0, 1)
PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def crop(cloud: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Points in the box, its faces included."""
    for axis, a, b in zip(AXES, low, high, strict=True):
        cloud = cloud.filter(F.col(axis).between(a, b))
    return cloud


def crop_around(target: DataFrame, source: DataFrame, margin: float | None) -> DataFrame:
    """Target points in the source's bounds widened by margin; all of them without a positive margin."""
    if not margin or margin <= 0:
        return target
    bounds = source.agg(*[F.min(c).alias(f"lo_{c}") for c in AXES], *[F.max(c).alias(f"hi_{c}") for c in AXES])
    inside = target.crossJoin(F.broadcast(bounds))  # one row
    for c in AXES:
        inside = inside.filter(F.col(c).between(F.col(f"lo_{c}") - margin, F.col(f"hi_{c}") + margin))
    return inside.select(*target.columns)


def transform(cloud: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Points moved by a 4 x 4 affine matrix."""
    return cloud.withColumns(dict(zip(AXES, affine(matrix), strict=True)))


def merge(**clouds: DataFrame) -> DataFrame:
    """All points with the name of their cloud."""
    parts = [df.withColumn("cloud_id", F.lit(name)) for name, df in clouds.items()]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def sample(cloud: DataFrame, n: int, seed: int = 7, key: str = "pid") -> DataFrame:
    """n points, the same on every run and engine: those whose hash of seed and id comes first."""
    return cloud.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def opacity_filter(splats: DataFrame, least: float, logit: str = "opacity") -> DataFrame:
    """Splats whose sigmoid of the opacity logit is at least `least`, as a comparison that reaches the scan."""
    if least <= 0:
        return splats
    return splats.filter(F.col(logit) >= math.log(least / (1 - least))) if least < 1 else splats.filter(sigmoid(F.col(logit)) >= least)


def info(cloud: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count and centroid, of each group or of all."""
    return cloud.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in AXES])


def axis_summary(cloud: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Of each axis: bounds, extent, low, middle and high percentile, robust extent; points outside the robust box."""
    long = cloud.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in AXES])).alias("a")).select("a.*")
    out = long.groupBy("axis").agg(F.min("v").alias("least"), F.max("v").alias("most")).join(quantiles(long, "v", [low, 0.5, high], ["axis"]), "axis", "left")
    out = out.select("axis", "least", "most", (F.col("most") - F.col("least")).alias("extent"), *[F.col("p")[k].alias(n) for k, n in enumerate(("p_low", "p_mid", "p_high"))])
    out = out.withColumn("robust_extent", F.col("p_high") - F.col("p_low"))
    wide = out.groupBy().agg(*[F.max(F.when(F.col("axis") == c, F.col(p))).alias(f"{c}_{p}") for c in AXES for p in ("p_low", "p_high")])
    beyond = F.lit(False)
    for c in AXES:
        beyond = beyond | (F.col(c) < F.col(f"{c}_p_low")) | (F.col(c) > F.col(f"{c}_p_high"))
    outside = cloud.crossJoin(F.broadcast(wide)).agg(F.count_if(beyond).alias("n_outside"), F.avg(beyond.cast("double")).alias("outside_ratio"))  # one row
    return out.crossJoin(F.broadcast(outside))


def voxel_downsample(cloud: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), extra: list[str] | None = None) -> DataFrame:
    """Centroid of each voxel with its number of points; other columns in `extra` are averaged too."""
    keys = [cell(F.col(c), size, o).alias(f"v{c}") for c, o in zip(AXES, origin, strict=True)]
    return cloud.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in (*AXES, *(extra or []))])


def voxel_gaussians(cloud: DataFrame, size: float, by: list[str] | None = None) -> DataFrame:
    """Of each voxel (of each group): points, mean, and sample covariance (a tiny sphere for one point)."""
    keys = [cell(F.col(c), size).alias(f"v{c}") for c in AXES]
    spread = [F.coalesce(F.covar_samp(a, b), F.lit(1e-6 if a == b else 0.0)).alias(f"c{a}{b}") for a, b in PAIRS]
    return cloud.groupBy(*(by or []), *keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in AXES], *spread)


def density_map(cloud: DataFrame, resolution: float, axes: tuple[str, str] = ("x", "y"), most_cells: int = 20_000_000) -> DataFrame:
    """Points of each occupied cell of a grid over two axes; cells are no wider than resolution, the last edge belongs in."""
    a, b = axes
    r = cloud.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
    if r[0] is None:
        return cloud.limit(0).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("n"))
    bins = [max(1, math.ceil((hi - lo) / resolution)) for lo, hi in ((r[0], r[1]), (r[2], r[3]))]
    if bins[0] * bins[1] > most_cells:
        raise ValueError(f"{bins[0]} x {bins[1]} cells; choose a coarser resolution")
    edges = [(lo, (hi - lo) / n if hi > lo else 1.0, n) for (lo, hi), n in zip(((r[0], r[1]), (r[2], r[3])), bins, strict=True)]
    keys = [F.least(F.floor((F.col(c) - lo) / w), F.lit(n - 1)).cast("long").alias(k) for c, (lo, w, n), k in zip(axes, edges, "ij", strict=True)]
    return cloud.groupBy(*keys).agg(F.count("*").alias("n"))


def tiles(cloud: DataFrame, size: float, axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Points with the tile they fall in, counted from the smallest coordinates."""
    low = cloud.agg(*[F.min(c).alias(f"__{c}") for c in axes])
    placed = cloud.crossJoin(F.broadcast(low))  # one row
    return placed.select(*cloud.columns, *[F.floor((F.col(c) - F.col(f"__{c}")) / size).cast("long").alias(k) for c, k in zip(axes, ("tile_i", "tile_j"), strict=True)])


def error_color(d: str, most: float) -> dict[str, F.Column]:
    r = F.least(F.greatest(F.col(d) / most, F.lit(0.0)), F.lit(1.0))
    return {"r": r, "g": 1 - r, "b": F.lit(0.0)}


def jet(v: F.Column) -> dict[str, F.Column]:
    """Red, green and blue of a value from 0 to 1: trapezoids a quarter apart."""
    clip = lambda e: F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0))
    return {c: clip(1.5 - F.abs(4 * v - m)) for c, m in (("r", 3), ("g", 2), ("b", 1))}


def scene_bounds(*clouds: DataFrame) -> DataFrame:
    """Centre and largest extent (1 where that is 0) of the box around all clouds."""
    every = clouds[0].select(*AXES)
    for df in clouds[1:]:
        every = every.union(df.select(*AXES))
    size = F.greatest(*[F.max(c) - F.min(c) for c in AXES])
    return every.agg(*[((F.min(c) + F.max(c)) / 2).alias(f"center_{c}") for c in AXES], F.when(size > 0, size).otherwise(1.0).alias("extent"))


def in_range(scans: DataFrame, most: float) -> DataFrame:
    """Points no farther than `most` from their scan's sensor (the origin)."""
    return scans.filter(norm(*[F.col(c) for c in AXES]) <= most)


def evenly_spaced(cloud: DataFrame, most: int, key: str = "pid") -> DataFrame:
    """At most `most` points, evenly spaced in the order of key, the first and the last among them (half-even rounding)."""
    n = cloud.count()
    if n <= most:
        return cloud
    step = (n - 1) / max(most - 1, 1)
    placed = ranked(cloud, key, [], name="__i")
    k = F.bround(F.col("__i") / step)
    hit = F.exists(F.array(k - 1, k, k + 1), lambda j: (j <= most - 1) & (F.bround(j * step) == F.col("__i")))
    return placed.filter(hit).drop("__i")


def budgeted(cloud: DataFrame, most: int, seed: int = 7, key: str = "pid") -> DataFrame:
    """The cloud if it has no more than `most` points, else `most` of them by hash, in the order of key."""
    return cloud if cloud.limit(most + 1).count() <= most else sample(cloud, most, seed, key).orderBy(key)


def representation(files: DataFrame) -> DataFrame:
    """files (path, and the names of a PLY's properties in `fields`) with kind: mesh, gaussian-points or point-cloud.

    A mesh by suffix or by faces; splats are points with an opacity.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    has = lambda name: F.coalesce(F.array_contains("fields", name), F.lit(False))
    kind = F.when(suffix.isin("obj", "stl", "glb", "gltf"), "mesh").when((suffix == "ply") & has("opacity"), "gaussian-points").when((suffix == "ply") & has("face"), "mesh").otherwise("point-cloud")
    return files.withColumn("kind", kind)


def detected(table: DataFrame) -> str:
    """What rows stand for, by their columns: triangles (ax ...) are a mesh, points with opacity and scales are splats."""
    names = set(table.columns)
    return "mesh" if {"ax", "by", "cz"} <= names else "gaussian-points" if {"opacity", "scale_0", "rot_0"} <= names else "point-cloud"


def adapted(cloud: DataFrame, kind: str, size: float = 0.0, samples: int = 8, least: float = 0.0) -> DataFrame:
    """Points (pid, x, y, z) of any representation: splats give surface points of those opaque enough, meshes samples of
    their triangles; with a positive size, voxel centroids of these. pid names a point of the result: a sample's is its own. A column
    `filters` names what was applied, and what was asked for and does not apply."""
    done = []
    if kind == "gaussian-points":
        if least > 0:
            cloud = opacity_filter(cloud, least)
            done.append(f"opacity>={least}")
        cloud = ellipsoid_samples(cloud, samples)
        done.append(f"ellipsoids:{samples}")
    elif kind == "mesh":
        cloud = mesh_samples(cloud, samples)
        done.append(f"triangles:{samples}")
    elif kind != "point-cloud":
        raise ValueError(f"no representation {kind!r}")
    if least > 0 and kind != "gaussian-points":
        done.append(f"opacity ignored ({kind})")
    if size > 0:
        cloud = voxel_downsample(cloud, size).withColumn("pid", F.xxhash64("vx", "vy", "vz"))
        done.append(f"voxels:{size}")
    elif kind != "point-cloud":
        cloud = written(cloud.select(*AXES), "samples").withColumn("pid", F.monotonically_increasing_id())
    return cloud.select("pid", *AXES, F.lit(",".join(done)).alias("filters"))


def mesh_samples(triangles: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """About n points spread evenly by area over triangles (pid, ax .. cz): each gets its share of n, the rest by a hash of its
    id; where in the triangle a point lies follows from hashes too, so that runs agree. Triangles without area get none."""
    p = {k: [F.col(f"{k}{c}") for c in AXES] for k in "abc"}
    u, v = ([y - x for x, y in zip(p["a"], p[k], strict=True)] for k in "bc")
    area = norm(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]) / 2

    def unit(tag: str) -> F.Column:
        text = F.concat_ws(":", F.lit(f"{seed}{tag}"), F.col("pid").cast("string"), F.col("__k").cast("string"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2**32

    sized = triangles.withColumn("__area", area).withColumn("__k", F.lit(-1))
    total = sized.agg(F.sum("__area").alias("__total"))
    share = F.col("__area") / F.col("__total") * n
    dealt = sized.crossJoin(F.broadcast(total)).withColumn("__n", (F.floor(share) + (unit("n") < share - F.floor(share)).cast("long")).cast("int")).filter("__n > 0")  # one row
    spread = dealt.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumns({"__r": F.sqrt(unit("r")), "__t": unit("t")})
    weights = (1 - F.col("__r"), F.col("__r") * (1 - F.col("__t")), F.col("__r") * F.col("__t"))
    return spread.select("pid", *[sum((w * F.col(f"{k}{c}") for w, k in zip(weights[1:], "bc", strict=True)), weights[0] * F.col(f"a{c}")).alias(c) for c in AXES])


def placed_scans(scans: DataFrame, poses: DataFrame, size: float = 0.0) -> DataFrame:
    """Points of all scans (scan_id, x, y, z) in the world, by their poses (scan_id, tx .. tz, qx .. qw); with a positive size
    the voxel centroids of these. Scans without a pose are left out."""
    x, y, z = (F.col(c) for c in AXES)
    a, b, c, w = (F.col(f"q{k}") for k in "xyzw")
    turned = (
        (1 - 2 * (b * b + c * c)) * x + 2 * (a * b - c * w) * y + 2 * (a * c + b * w) * z,
        2 * (a * b + c * w) * x + (1 - 2 * (a * a + c * c)) * y + 2 * (b * c - a * w) * z,
        2 * (a * c - b * w) * x + 2 * (b * c + a * w) * y + (1 - 2 * (a * a + b * b)) * z,
    )
    world = scans.join(poses, "scan_id").select("scan_id", *[(v + F.col(f"t{k}")).alias(k) for v, k in zip(turned, AXES, strict=True)])
    return voxel_downsample(world, size) if size > 0 else world


def within(source: DataFrame, target: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """(pid, other, d): target points no farther than radius, of each source point the nearest `most`."""
    cells = target.select(F.col("pid").alias("other"), *[F.col(c).alias(f"t{c}") for c in AXES], *[cell(F.col(c), radius).alias(f"k{c}") for c in AXES])
    probes = source.select("pid", *[F.col(c).alias(f"s{c}") for c in AXES], *[cell(F.col(c), radius).alias(f"k{c}") for c in AXES])
    for c in AXES:
        probes = probes.withColumn(f"k{c}", F.explode(F.array(*[F.col(f"k{c}") + s for s in NEAR])))
    near = probes.join(cells, [f"k{c}" for c in AXES]).select("pid", "other", distance("s", "t").alias("d")).filter(F.col("d") <= radius)
    if most is None:
        return near
    return near.withColumn("__r", F.row_number().over(Window.partitionBy("pid").orderBy("d", "other"))).filter(F.col("__r") <= most).drop("__r")


def spacing(cloud: DataFrame) -> DataFrame:
    """Volume, density, and how far points lie from their nearest neighbour."""
    near = nearest(cloud, cloud, apart=True)
    d = near.agg(F.avg("d").alias("mean_d"), F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.stddev_pop("d").alias("std_d"))
    d = d.crossJoin(quantiles(near, "d", [0.5]).select(F.col("p")[0].alias("median_d"))).select("mean_d", "median_d", "min_d", "max_d", "std_d")  # one row each
    sides = [F.max(c) - F.min(c) for c in AXES]
    volume = F.when((sides[0] > 0) & (sides[1] > 0) & (sides[2] > 0), sides[0] * sides[1] * sides[2]).otherwise(0.0)
    size = cloud.agg(F.count("*").alias("n"), volume.alias("volume"))
    return size.withColumn("density", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("volume")), F.lit(0.0))).crossJoin(d)  # one row each


def outliers(cloud: DataFrame, k: int = 20, ratio: float = 2.0) -> DataFrame:
    """Points with their mean distance to k neighbours (themselves counted, at 0) and whether it is within mean + ratio * std."""
    near = nearest(cloud, cloud, k=k - 1, apart=True).groupBy("pid").agg((F.sum("d") / k).alias("mean_d"))
    limit = near.agg((F.avg("mean_d") + ratio * F.coalesce(F.stddev_samp("mean_d"), F.lit(0.0))).alias("limit"))
    return near.crossJoin(F.broadcast(limit)).select("pid", "mean_d", (F.col("mean_d") <= F.col("limit")).alias("inlier"))  # one row


def mean_map_entropy(cloud: DataFrame, k: int = 20) -> DataFrame:
    """Mean over points of half the log determinant of their k neighbours' covariance."""
    near = nearest(cloud, cloud, k=k, apart=True).join(cloud.select(F.col("pid").alias("other"), *AXES), "other")
    covs = near.groupBy("pid").agg(F.count("*").alias("n"), *[F.covar_samp(a, b).alias(a + b) for a, b in PAIRS]).filter(F.col("n") == k)
    h = 0.5 * F.log(F.abs(determinant({p: F.col(p) for p in PAIRS})) + 1e-10)
    return covs.agg(F.count("*").alias("n"), F.avg(h).alias("entropy"))


def voxel_entropy(cloud: DataFrame, size: float) -> DataFrame:
    """Mean binary entropy (bits) of how many of an occupied voxel's 26 neighbours are occupied; consistency is 1 less it."""
    keys = cloud.select(*[cell(F.col(c), size).alias(c) for c in AXES]).distinct()
    around = keys.select(*[F.col(c).alias(f"o{c}") for c in AXES], *AXES)
    for c in AXES:
        around = around.withColumn(c, F.explode(F.array(*[F.col(c) + s for s in NEAR])))
    same = (F.col("x") == F.col("ox")) & (F.col("y") == F.col("oy")) & (F.col("z") == F.col("oz"))
    hit = around.filter(~same).join(keys.withColumn("hit", F.lit(1)), list(AXES), "left")
    p = hit.groupBy("ox", "oy", "oz").agg((F.coalesce(F.sum("hit"), F.lit(0)) / 26.0).alias("p"))
    bits = F.when((F.col("p") > 0) & (F.col("p") < 1), -F.col("p") * F.log2("p") - (1 - F.col("p")) * F.log2(1 - F.col("p"))).otherwise(0.0)
    out = p.agg(F.count("*").alias("voxels"), F.avg(bits).alias("entropy"))
    return out.withColumn("consistency", F.greatest(F.lit(0.0), 1 - F.col("entropy")))


def fibonacci_sphere(n: int) -> list[tuple[float, float, float]]:
    """n points spread over the unit sphere."""
    turn = math.pi * (3 - math.sqrt(5))
    out = []
    for k in range(n):
        z = 1 - 2 * (k + 0.5) / n
        r = math.sqrt(max(0.0, 1 - z * z))
        out.append((r * math.cos(turn * k), r * math.sin(turn * k), z))
    return out


def ellipsoid_samples(splats: DataFrame, n: int = 8) -> DataFrame:
    """n surface points of each splat (centre x.., log-scales scale_0.., quaternion rot_0.. as w, x, y, z)."""
    template = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("abc", p, strict=True)]) for p in fibonacci_sphere(n)])
    length = norm(*[F.col(f"rot_{k}") for k in range(4)])
    w, x, y, z = (F.col(f"rot_{k}") / F.when(length > 0, length).otherwise(1.0) for k in range(4))
    spun = splats.withColumns({"__w": w, "__x": x, "__y": y, "__z": z}).withColumn("__p", F.explode(template))
    a, b, c = (F.col(f"__p.{n}") * F.exp(F.col(f"scale_{k}")) for k, n in enumerate("abc"))
    w, x, y, z = (F.col(f"__{n}") for n in "wxyz")
    moved = {
        "x": F.col("x") + (1 - 2 * (y * y + z * z)) * a + 2 * (x * y - w * z) * b + 2 * (x * z + w * y) * c,
        "y": F.col("y") + 2 * (x * y + w * z) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - w * x) * c,
        "z": F.col("z") + 2 * (x * z - w * y) * a + 2 * (y * z + w * x) * b + (1 - 2 * (x * x + y * y)) * c,
    }
    kept = [k for k in splats.columns if k not in AXES]
    return spun.select(*kept, *[v.alias(k) for k, v in moved.items()])
