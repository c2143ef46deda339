"""Exact nearest neighbours of points, without cross joins, rounds or copies of the source for its neighbour cells.

A target of up to SMALL points is broadcast as one kd-tree, and the source streams past it in one job. A larger one is dealt
into buckets:

1. Planes. A kd-tree over a bounded sample of the target says where buckets end: planes at medians, so that far points and
   dense places shift no balance. The sample decides about work alone: every point is dealt.
2. At home. Source and target meet by bucket; a kd-tree of the bucket's target gives each source point its nearest there.
3. Visits. Each source point walks down the boxes of the buckets (a complete tree, level by level for whole batches) and visits
   those that its ball meets, bounded by what it has found at home.

Equal target points beyond those that can count are dropped first. Buckets with many source points, or with more target points
than a task should hold, are worked in parts of either side. With `by`, points meet within their group only, groups of any
number in the same jobs: a forest.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.geometry import AXES
from cairn.functions.kdtree import NONE, KdTree
from cairn.plans.storage import written

#: Target points that are broadcast at most; about as many in a bucket; target and source points that one part holds; points of
#: the sample that planes come from, and of it for each bucket at least.
SMALL, BUCKET, PART, CHUNK, SAMPLE, EACH = 300_000, 500_000, 2_000_000, 500_000, 1_000_000, 64


def finite(cloud: DataFrame, by: str | None = None) -> DataFrame:
    """(pid, x, y, z) of the points whose coordinates are all numbers, with their group."""
    out = cloud.select("pid", *[F.col(c).cast("double").alias(c) for c in AXES], *([F.col(by).alias("g")] if by else [F.lit(0).alias("g")]))
    for c in AXES:
        out = out.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out.filter("g IS NOT NULL")


def _points(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in AXES], axis=1)


class Planes(NamedTuple):
    """A group's buckets: the planes of a complete binary tree of `depth` levels, root first."""

    depth: int
    axis: np.ndarray
    at: np.ndarray

    def bucket(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] >= self.at[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def planes(points: np.ndarray, depth: int) -> Planes:
    """Planes at the medians of the widest axes."""
    axis, at, parts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1), [points]
    for node in range(2**depth - 1):
        own = parts.pop(0)
        if len(own):
            axis[node] = int((own.max(axis=0) - own.min(axis=0)).argmax())
            at[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] >= at[node]
        parts += [own[~right], own[right]]
    return Planes(depth, axis, at)


class Boxes(NamedTuple):
    """Of a group's tree: low and high of each node's points and how many there are (0: none), root first."""

    depth: int
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, depth: int, buckets: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> Boxes:
        size, first = 2 ** (depth + 1) - 1, 2**depth - 1
        out = cls(depth, np.full((size, 3), np.inf), np.full((size, 3), -np.inf), np.zeros(size, np.int64))
        out.low[first + buckets], out.high[first + buckets], out.n[first + buckets] = low, high, n
        for node in range(first - 1, -1, -1):
            a, b = 2 * node + 1, 2 * node + 2
            out.low[node], out.high[node], out.n[node] = np.minimum(out.low[a], out.low[b]), np.maximum(out.high[a], out.high[b]), out.n[a] + out.n[b]
        return out

    def visits(self, points: np.ndarray, home: np.ndarray, bound: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, bound): the buckets but for its home that each point's ball (squared bounds) meets. A point without a
        bound gets one from the boxes on its way that hold enough points."""
        bound = bound.copy()
        rows, nodes = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level in range(self.depth + 1):
            if level:
                rows, nodes = np.repeat(rows, 2), np.stack([2 * nodes + 1, 2 * nodes + 2], axis=1).ravel()
            there = self.n[nodes] > 0
            rows, nodes = rows[there], nodes[there]
            own = points[rows]
            gap = np.maximum(np.maximum(self.low[nodes] - own, own - self.high[nodes]), 0.0)
            far = np.maximum(np.abs(self.low[nodes] - own), np.abs(self.high[nodes] - own))
            near, far = (gap * gap).sum(axis=1), (far * far).sum(axis=1) * (1 + 1e-12)
            full = self.n[nodes] >= need
            np.minimum.at(bound, rows[full], far[full])
            keep = near <= bound[rows]
            rows, nodes = rows[keep], nodes[keep]
        buckets = nodes - (2**self.depth - 1)
        away = buckets != home[rows]
        return rows[away], buckets[away], bound[rows[away]]


def _found(groups, pid: np.ndarray, d2: np.ndarray, ids: np.ndarray, more: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows (g, pid, other, d) of what a tree gave."""
    there = ids != NONE
    at = np.flatnonzero(there.any(axis=1))
    counts = there[at].sum(axis=1)
    rows = np.repeat(at, counts)
    columns = {"g": pa.array(groups).take(pa.array(rows)) if isinstance(groups, pa.Array) else pa.array(np.asarray(groups)[rows]), "pid": pid[rows], "other": ids[there], "d": np.sqrt(d2[there])}
    columns |= {k: v[rows] for k, v in (more or {}).items()}
    return pa.table(columns)


def _broadcast(source: DataFrame, target: DataFrame, need: int, size: float) -> DataFrame:
    """(g, pid, other, d) with the whole target, checked to be small, in every task."""
    spark, table = source.sparkSession, target.select("g", "pid", *AXES).toArrow()
    trees, names = {}, table.column("g").to_pylist()
    points, ids = _points(table) if len(table) else np.empty((0, 3)), table.column("pid").to_numpy()
    rows: dict = {}
    for k, name in enumerate(names):
        rows.setdefault(name, []).append(k)
    for name, own in rows.items():
        trees[name] = KdTree(points[own], ids[own], need, size)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            q, pid, groups = _points(batch), batch.column("pid").to_numpy(), batch.column("g")
            d2, other = np.full((len(q), need), np.inf), np.full((len(q), need), NONE)
            code = groups.dictionary_encode()
            for k, name in enumerate(code.dictionary.to_pylist()):
                if name in shared.value:
                    own = np.flatnonzero(code.indices.to_numpy(zero_copy_only=False) == k)
                    d2[own], other[own] = shared.value[name].nearest(q[own])
            yield from _found(groups, pid, d2, other).to_batches()

    kind = source.schema["g"].dataType.simpleString()
    return source.select("pid", *AXES, "g").mapInArrow(run, f"g {kind}, pid long, other long, d double")


def _meet(need: int, size: float, home: bool, kind: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["g", "pid", "other", "d", *(["bucket", "x", "y", "z"] if home else [])]
        if not len(left) or not len(right):
            empty = {"g": pa.array([], kind), **{c: pa.array([], pa.int64() if c in ("pid", "other", "bucket") else pa.float64()) for c in names[1:]}}
            return pa.table(empty)
        tree = KdTree(_points(right), right.column("pid").to_numpy(), need, size)
        q, pid = _points(left), left.column("pid").to_numpy()
        order = np.lexsort(np.floor(q / (np.ptp(q, axis=0) + 1e-300) * 16).T)  # neighbours in space one after another
        bound = None if home else left.column("bound").to_numpy()[order]
        d2, other = tree.nearest(q[order], bound)
        more = {"bucket": left.column("bucket").to_numpy()[order], **{c: q[order, k] for k, c in enumerate(AXES)}} if home else None
        g = left.column("g").combine_chunks()
        return _found(g.take(pa.array(np.zeros(len(q), np.int64))), pid[order], d2, other, more).cast(pa.schema([(c, kind if c == "g" else pa.int64() if c in ("pid", "other", "bucket") else pa.float64()) for c in names]))

    return run


def _met(source: DataFrame, target: DataFrame, need: int, size: float, home: bool) -> DataFrame:
    """What source and target points of the same group and bucket give, either side in parts where it is large."""
    key = ["g", "bucket"]
    parts = source.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("of_source"))
    parts = parts.join(target.groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("of_target")), key).filter("of_source > 1 OR of_target > 1")
    parts = written(parts, "parts")
    if parts.limit(1).count():
        part = lambda n: F.coalesce(F.pmod(F.xxhash64("pid"), F.col(n)), F.lit(0)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        source = source.join(parts, key, "left").withColumn("s", part("of_source")).withColumn("t", each("of_target")).drop("of_source", "of_target")
        target = target.join(parts, key, "left").withColumn("t", part("of_target")).withColumn("s", each("of_source")).drop("of_source", "of_target")
    else:
        source, target = (df.withColumns({"s": F.lit(0), "t": F.lit(0)}) for df in (source, target))
    kind = source.schema["g"].dataType.simpleString()
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]
    schema = f"g {kind}, pid long, other long, d double" + (", bucket long, x double, y double, z double" if home else "")
    return source.groupBy(*key, "s", "t").cogroup(target.groupBy(*key, "s", "t")).applyInArrow(_meet(need, size, home, arrow), schema)


def _dealt(points: DataFrame, shared) -> DataFrame:
    """points with their bucket."""

    def run(batches):
        for batch in batches:
            q, code = _points(batch), batch.column("g").dictionary_encode()
            bucket = np.zeros(len(q), np.int64)
            for k, name in enumerate(code.dictionary.to_pylist()):
                if name in shared.value:
                    own = np.flatnonzero(code.indices.to_numpy(zero_copy_only=False) == k)
                    bucket[own] = shared.value[name].bucket(q[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], [*batch.schema.names, "bucket"])

    return points.mapInArrow(run, points.withColumn("bucket", F.lit(0).cast("long")).schema)


def _by_buckets(source: DataFrame, target: DataFrame, n: int, need: int, size: float) -> DataFrame:
    spark = source.sparkSession
    large = {r["g"]: r["n"] for r in target.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).collect()}  # no more than points / BUCKET
    share = min(1.0, SAMPLE / n)
    drawn = target.filter(F.pmod(F.xxhash64("pid", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * share)).filter(F.col("g").isin(*large)).select("g", *AXES).limit(2 * SAMPLE).toArrow() if large else None
    trees = {}
    if drawn is not None and len(drawn):
        code = drawn.column("g").combine_chunks().dictionary_encode()
        q = _points(drawn)
        for k, name in enumerate(code.dictionary.to_pylist()):
            own = q[code.indices.to_numpy(zero_copy_only=False) == k]
            depth = min(int(np.ceil(np.log2(large[name] / BUCKET))), int(np.log2(max(1, len(own) / EACH))))
            if depth > 0:
                trees[name] = planes(own, depth)
    shared = spark.sparkContext.broadcast(trees)
    there = written(_dealt(target.select("pid", *AXES, "g"), shared), "buckets")
    found = written(_met(_dealt(source.select("pid", *AXES, "g"), shared), there, need, size, True), "home")
    every = found.select("g", "pid", "other", "d")
    if not trees:
        return every
    spans = there.filter(F.col("g").isin(*trees)).groupBy("g", "bucket").agg(F.count("*").alias("n"), *[f(c).alias(f"{s}{c}") for c in AXES for s, f in (("lo_", F.min), ("hi_", F.max))]).toArrow()
    names, boxes = np.array(spans.column("g").to_pylist(), object), {}
    for name, tree in trees.items():
        own = np.flatnonzero(names == name)
        low, high = (np.stack([spans.column(s + c).to_numpy()[own] for c in AXES], axis=1) for s in ("lo_", "hi_"))
        boxes[name] = Boxes.of(tree.depth, spans.column("bucket").to_numpy()[own], low, high, spans.column("n").to_numpy()[own])
    walls = spark.sparkContext.broadcast(boxes)

    def walk(batches):
        for batch in batches:
            code = batch.column("g").dictionary_encode()
            for k, name in enumerate(code.dictionary.to_pylist()):
                own = np.flatnonzero(code.indices.to_numpy(zero_copy_only=False) == k)
                part = batch.take(pa.array(own))
                bound = np.where(part.column("m").to_numpy() >= need, part.column("far").to_numpy() ** 2 * (1 + 1e-12), np.inf)
                rows, bucket, bound = walls.value[name].visits(_points(part), part.column("bucket").to_numpy(), bound, need)
                at = pa.array(rows)
                for a in range(0, len(rows), 100_000):
                    piece = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([*[part.column(c).take(at[piece]) for c in ("pid", *AXES, "g")], pa.array(bucket[piece]), pa.array(bound[piece])], ["pid", *AXES, "g", "bucket", "bound"])

    kind = source.schema["g"].dataType.simpleString()
    homes = found.groupBy("g", "pid").agg(F.count("*").alias("m"), F.max("d").alias("far"), *[F.first(c).alias(c) for c in (*AXES, "bucket")])
    # buckets that only a source point fell into have given it nothing
    dealt = _dealt(source.select("pid", *AXES, "g").filter(F.col("g").isin(*trees)), shared)
    open_points = dealt.join(homes.select("g", "pid", "m", "far"), ["g", "pid"], "left").select("pid", *AXES, "g", "bucket", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("far", F.lit(0.0)).alias("far"))
    visits = written(open_points.mapInArrow(walk, f"pid long, x double, y double, z double, g {kind}, bucket long, bound double"), "visits")
    return every.union(_met(visits, there, need, size, False).select("g", "pid", "other", "d"))


def nearest(source: DataFrame, target: DataFrame, k: int = 1, size: float | None = None, apart: bool = False, by: str | None = None) -> DataFrame:
    """(by, pid, other, rank, d): each source point's k nearest target points, exact; ties by the smaller id.

    apart: a point is not its own neighbour (ids equal). by: a column of both sides (int, long or string) within whose values
    points meet; a null one meets nothing. size: boxes of the trees no wider than this are not split. Fewer than k targets give fewer rows. Points with a coordinate that is null, NaN or
    infinite are nobody's neighbour and have none. pid must be a long and name one source point (of its group).
    """
    source, target = finite(source, by), finite(target, by)
    named = [F.col("g").alias(by)] if by else []
    need = k + apart
    n = target.count()
    if k < 1 or not n:
        return source.limit(0).select(*named, "pid", F.lit(0).cast("long").alias("other"), F.lit(0).alias("rank"), F.lit(0.0).alias("d"))
    if n > SMALL:
        # of equal points only the first ones by id can count
        same = Window.partitionBy("g", *AXES).orderBy("pid")
        target = target.groupBy("g", *AXES).agg(F.min("pid").alias("pid")) if need == 1 else target.withColumn("__r", F.row_number().over(same)).filter(F.col("__r") <= need).drop("__r")
        target = written(target.select("pid", *AXES, "g"), "target")
        n = target.count()
    found = _broadcast(source, target, need, size or 0.0) if n <= SMALL else _by_buckets(source, target, n, need, size or 0.0)
    if apart:
        found = found.filter("pid <> other")
    if k == 1:
        best = found.groupBy("g", "pid").agg(F.min(F.struct("d", "other")).alias("m")).select(*named, "pid", "m.other", F.lit(1).alias("rank"), "m.d")
        return written(best, "nearest")
    order = Window.partitionBy("g", "pid").orderBy("d", "other")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*named, "pid", "other", "rank", "d")
    return written(best, "nearest")
