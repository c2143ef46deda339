"""Order in which a cloud's points are shown: a first set that already looks like the whole, then chunks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.geometry import AXES, norm
from cairn.operators.points import evenly_spaced, nearest, voxel_downsample
from cairn.plans.ranking import quantiles, ranked

#: Fixed value: the multiplier that scatters cell numbers.
SCATTER = 2_654_435_761
SHELLS = 8


def chunked(ordered: DataFrame, first: int, size: int, place: str = "rank") -> DataFrame:
    """ordered with chunk: 0 for the first places, then one number for each `size` of them."""
    return ordered.withColumn("chunk", F.when(F.col(place) < first, 0).otherwise(1 + F.floor((F.col(place) - first) / size)).cast("long"))


def unit_cube(cloud: DataFrame) -> DataFrame:
    """Coordinates moved and scaled to lie between 0 and 1, one scale for all axes."""
    r = cloud.agg(*[F.min(c).alias(f"lo_{c}") for c in AXES], *[F.max(c).alias(f"hi_{c}") for c in AXES]).first()
    if r["lo_x"] is None:
        return cloud
    scale = max(r[f"hi_{c}"] - r[f"lo_{c}"] for c in AXES) or 1.0
    return cloud.withColumns({c: (F.col(c) - r[f"lo_{c}"]) / scale for c in AXES})


def spatial_shuffle(cloud: DataFrame, first: int, size: int) -> DataFrame:
    """(pid, rank, chunk): points in the order of their cell's scattered number, then of their ids."""
    side = max(1, math.ceil(first ** (1 / 3)))
    at = [F.least(F.floor(F.col(c) * side), F.lit(side - 1)).cast("long") for c in AXES]
    key = ((at[0] * side + at[1]) * side + at[2]) * SCATTER % 2**32
    keyed = unit_cube(cloud).select("pid", key.alias("key"))
    return chunked(ranked(keyed, "key", ["pid"]), first, size).select("pid", "rank", "chunk")


def distance_shells(cloud: DataFrame, first: int, size: int) -> DataFrame:
    """(pid, shell, rank, chunk): a first set with equal parts of eight shells of distance from the centroid (nearest
    first, shells in turn), then the rest shell by shell."""
    center = cloud.agg(*[F.avg(c).alias(f"m{c}") for c in AXES])
    far = cloud.crossJoin(F.broadcast(center)).select("pid", norm(*[F.col(c) - F.col(f"m{c}") for c in AXES]).alias("r"))  # one row
    cuts = quantiles(far, "r", [k / SHELLS for k in range(1, SHELLS)]).first()["p"]
    shell = sum((F.when(F.col("r") >= c, 1).otherwise(0) for c in cuts if c is not None), F.lit(0))
    own = ranked(far.withColumn("shell", shell), "r", ["pid"], ["shell"], "own")
    n = {r["shell"]: r["count"] for r in own.groupBy("shell").count().collect()}
    quota, left = dict.fromkeys(n, 0), min(first, sum(n.values()))
    while left:  # shells in turn, until the first set is full
        for s in sorted(n):
            if left and quota[s] < n[s]:
                quota[s] += 1
                left -= 1
    start, before = sum(quota.values()), {}
    for s in sorted(n):
        before[s], start = start - quota[s], start + n[s] - quota[s]
    value = lambda d: F.coalesce(*[F.when(F.col("shell") == s, F.lit(v)) for s, v in d.items()], F.lit(0))
    early = F.col("own") < value(quota)
    # within the first set: how many of all shells come before this turn, and of this turn's shells before this one
    turn = sum((F.least(F.lit(q), F.col("own")) + F.when((F.lit(q) > F.col("own")) & (F.lit(s) < F.col("shell")), 1).otherwise(0) for s, q in quota.items()), F.lit(0))
    return chunked(own.withColumn("rank", F.when(early, turn).otherwise(value(before) + F.col("own")).cast("long")), first, size).select("pid", "shell", "rank", "chunk")


def reduced(cloud: DataFrame, most: int, size: float = 0.01, growth: float = 1.35) -> DataFrame:
    """Voxel centroids, the voxels grown until there are at most `most` (1 at least)."""
    if most < 1 or size <= 0 or growth <= 1:
        raise ValueError("a budget of 1 at least, a positive size and a growth beyond 1")
    before = None
    while True:
        out = voxel_downsample(cloud, size)
        n = out.count()
        if n <= most:
            return out
        size *= growth * 1.25 if before is not None and n >= before else growth
        before = n


def grid_tiles(cloud: DataFrame, first: int, size: int) -> DataFrame:
    """(pid, rank, chunk): the first point of each tile, tiles in hashed order, then the second of each, and so on.

    Tiles are those of the unit cube with ceil(cbrt(first)) on a side (the cloud's points, if they are fewer).
    """
    n = cloud.count()
    side = max(1, math.ceil(round(max(1, min(first, n)) ** (1 / 3), 9)))
    tile = sum((F.least(F.floor(F.col(c) * side), F.lit(side - 1)).cast("long") * side**k for c, k in zip(AXES, (2, 1, 0), strict=True)), F.lit(0).cast("long"))
    tiled = unit_cube(cloud).select("pid", tile.alias("tile"))
    levels = ranked(tiled, "pid", [], ["tile"], "level").withColumn("key", F.col("tile") * SCATTER % 2**32)
    return chunked(ranked(levels, "level", ["key", "tile"]), first, size).select("pid", "rank", "chunk")


def hybrid(cloud: DataFrame, most: int) -> DataFrame:
    """Voxel centroids, with voxels a little smaller than would give `most` of them if points filled the box, and of these at
    most `most`, evenly spaced in the order of their voxels."""
    r = cloud.agg(*[(F.max(c) - F.min(c)) for c in AXES]).first()
    extent = [max(v or 0.0, 1e-6) for v in r]
    thin = voxel_downsample(cloud, 0.85 * (math.prod(extent) / max(most, 1)) ** (1 / 3))
    order = ranked(thin, "vx", ["vy", "vz"], name="pid")
    return evenly_spaced(order, most)


def coverage(cloud: DataFrame, kept: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Mean, this quantile and the largest of the distances from each point to the nearest kept one."""
    d = nearest(cloud, kept)
    return d.agg(F.avg("d").alias("mean"), F.max("d").alias("most")).crossJoin(quantiles(d, "d", [quantile]).select(F.col("p")[0].alias("quantile")))  # one row each


def chunk_spread(chunks: DataFrame) -> DataFrame:
    """Number of chunks and population deviation of their sizes, without the first set."""
    sizes = chunks.filter("chunk > 0").groupBy("chunk").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("chunks"), F.coalesce(F.stddev_pop("n"), F.lit(0.0)).alias("spread"))
