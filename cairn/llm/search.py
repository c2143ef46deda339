"""Exact top-k search by integer inner product: exhaustive, term at a time.

A query is a sparse row of (component, weight). Tasks turn blocks of candidates into postings, for each component the
candidates where it is not zero; every query row scatters its weight times each posting into a dense array with a score for
each candidate of the block, and a partition selects the best of it. A task carries its best rows from block to block, and
tasks are merged in groups, level by level, so that no group grows with the number of tasks.

Queries go out in bounded broadcasts, one job each; a stated query set against all rows is the work that was asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import table, written
from cairn.llm.vectors import sound, whole
from cairn.plans.ranking import ranked

#: Integer steps of a unit, results of a query; candidates of a block; components and rows of the queries of one broadcast at
#: most; tasks that are merged at once; integers are held within this (components within 2^45).
SCALE, TOP, BLOCK, TERMS, QUERY_ROWS, FAN, HELD = 256, 5, 8_192, 2_000_000, 20_000, 64, 2**53


class Queries(NamedTuple):
    """place and ids: of each query; ends: where its terms end; components and weights: of all queries, one after another."""

    place: np.ndarray
    ids: np.ndarray
    ends: np.ndarray
    components: np.ndarray
    weights: np.ndarray


def _sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, component and weight of all that is not zero in a batch of lists."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    components = np.arange(len(values)) - np.repeat(starts, lengths)
    there = np.flatnonzero(values)
    return rows[there], components[there], values[there]


class Postings:
    """Of a block of candidates, by component: those that have it and their weights; all weights where most have it."""

    def __init__(self, column: pa.Array, kind: type):
        self.n, self.kind = len(column), kind
        rows, components, weights = _sparse(column)
        order = components.argsort(kind="stable")
        rows, weights = rows[order], weights[order].astype(kind)
        names, starts, counts = np.unique(components[order], return_index=True, return_counts=True)
        self.of = {}
        for name, a, n in zip(names.tolist(), starts.tolist(), counts.tolist(), strict=True):
            ids, own = rows[a : a + n], weights[a : a + n]
            if 2 * n > self.n:
                dense = np.zeros(self.n, kind)
                dense[ids] = own
                ids, own = None, dense
            self.of[name] = ids, own

    def scores(self, components: list[int], weights: list[int]) -> np.ndarray:
        total, product = np.zeros(self.n, self.kind), np.empty(self.n, self.kind)
        for name, weight in zip(components, weights, strict=True):
            ids, own = self.of.get(name, (None, None))
            if ids is not None:
                total[ids] += own * self.kind(weight) if self.kind is not object else own * weight
            elif own is not None:
                total += np.multiply(own, weight, out=product)
        return total


def _kind(queries: Queries, most: int) -> type:
    """The narrowest integers that hold every score: of 32 or 64 bits, or Python's."""
    bound = most * sum_of_most(queries)
    return np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object


def sum_of_most(queries: Queries) -> int:
    """The largest sum of the absolute weights of a query."""
    starts = np.append(0, queries.ends[:-1])
    full = starts < queries.ends
    weights = np.abs(queries.weights).astype(object)
    return max(np.add.reduceat(weights, starts[full]).tolist(), default=0) if full.any() else 0


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the smaller id first where they are equal."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(scores))
    return near[sorted(range(len(near)), key=lambda i: (-int(scores[near[i]]), int(ids[near[i]])))[:k]] if len(near) <= 4 * k else _sorted(scores, ids, near, k)


def _sorted(scores: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """The same for many equal scores: first those above the bar, then the smallest ids at it."""
    bar = scores[near].min()
    above, at = near[scores[near] > bar], near[scores[near] == bar]
    at = at[np.argpartition(ids[at], min(k, len(at)) - 1)[:k]] if len(at) > k else at
    near = np.concatenate([above, at])
    return near[sorted(range(len(near)), key=lambda i: (-int(scores[near[i]]), int(ids[near[i]])))[:k]]


def _task(shared, k: int):
    """Best k rows of each query among the candidates of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        starts = np.append(0, queries.ends[:-1]).tolist()
        terms = [(queries.components[a:b].tolist(), queries.weights[a:b].tolist()) for a, b in zip(starts, queries.ends.tolist(), strict=True)]
        held: list[tuple[list[int], list[int]]] = [([], []) for _ in terms]  # scores, falling, and ids
        for whole_batch in batches:
            for at in range(0, len(whole_batch), BLOCK):
                batch = whole_batch.slice(at, BLOCK)
                ids = batch.column(0).to_numpy()
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                most = int(np.abs(values).max()) if len(values) else 0
                postings = Postings(batch.column(1), _kind(queries, most))
                for q, (components, weights) in enumerate(terms):
                    scores = postings.scores(components, weights)
                    best, named = held[q]
                    own = np.flatnonzero(ids == queries.ids[q])
                    full = len(best) >= k
                    near = np.flatnonzero(scores >= best[-1]) if full else None
                    if full and not len(near):
                        continue
                    if near is None:
                        near = np.arange(len(ids))
                    if len(own):
                        near = np.setdiff1d(near, own, assume_unique=True)
                    near = near[_best(scores[near], ids[near], k)]
                    rows = sorted(zip([*best, *map(int, scores[near])], [*named, *map(int, ids[near])], strict=True), key=lambda x: (-x[0], x[1]))[:k]
                    held[q] = [x[0] for x in rows], [x[1] for x in rows]
        sizes = [len(x[0]) for x in held]
        scores = pa.array([s for x in held for s in x[0]], pa.decimal128(38, 0)) if any(abs(s) >= 2**63 for x in held for s in x[0]) else pa.array([s for x in held for s in x[0]], pa.int64()).cast(pa.decimal128(38, 0))
        columns = [pa.array(np.repeat(queries.place, sizes), pa.int64()), pa.array(np.repeat(queries.ids, sizes), pa.int64()), pa.array([i for x in held for i in x[1]], pa.int64()), scores]
        yield pa.RecordBatch.from_arrays(columns, ["place", "query_id", "vec_id", "score"])

    return run


def _merged(found: DataFrame, tasks: int, k: int) -> DataFrame:
    """The best k rows of each query from those of all tasks (__p), merged FAN tasks at a time."""
    order = [F.col("score").desc(), F.col("vec_id")]
    while tasks > FAN:
        found = found.withColumn("__p", F.floor(F.col("__p") / FAN))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("place", "__p").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
        tasks = -(-tasks // FAN)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).filter(F.col("rank") <= k)


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, v) of the rows that take part, v as integers."""
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    return named.filter(F.col("id").isNotNull() & sound(F.col("e"))).select("id", whole(F.col("e"), scale, HELD).alias("v"))


def top(queries: DataFrame, candidates: DataFrame, k: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of the highest integer inner product, ties to the smaller id.

    Both tables have the id and the vector under the same names; other columns are not read. Components become floor(scale * x).
    A candidate with the query's id is not the query's; every other row counts, repeated ones too. Rows whose vector is null or
    holds null or non-finite components, or whose id is null, take no part. Where lengths differ, the shorter vector counts as
    ended by zeros; an empty vector scores 0. Queries of one id with different vectors are different queries; equal ones are
    one. Fewer candidates give fewer rows; a score beyond a long is null and still decides ranks.
    """
    spark = candidates.sparkSession
    asked = integers(queries, vec_id, embedding, scale).dropDuplicates(["id", "v"])
    asked = written(ranked(asked.withColumn("h", F.xxhash64("v")), "id", ["h"], name="place"), "queries")
    n, longest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    rows = integers(candidates, vec_id, embedding, scale)
    at_once = max(1, min(QUERY_ROWS, TERMS // max(longest or 1, 1)))
    parts = []
    for at in range(0, n, at_once):
        chunk = asked.filter(F.col("place").between(at, at + at_once - 1)).select("place", "id", "v").toArrow().combine_chunks()
        _, components, weights, ends = _flat(chunk.column("v"))
        shared = spark.sparkContext.broadcast(Queries(chunk.column("place").to_numpy(), chunk.column("id").to_numpy(), ends, components, weights))
        found = written(rows.mapInArrow(_task(shared, k), "place long, query_id long, vec_id long, score decimal(38,0)").withColumn("__p", F.spark_partition_id()), "found")
        shared.destroy()
        tasks = (found.agg(F.max("__p")).first()[0] or 0) + 1
        parts.append(_merged(found, tasks, k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.select("query_id", "rank", "vec_id", F.expr("try_cast(score AS bigint)").alias("score"))


def _flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As _sparse, of a whole table's column, and where each row's terms end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows, components, weights = _sparse(column)
    return rows, components, weights, np.cumsum(np.bincount(rows, minlength=len(column)))


def op13_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for each embedding whose vec_id is divisible by 50, among all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return top(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

QUERIES = {"op13_top_k_search": op13_top_k_search}
ORACLES = {"op13_top_k_search": ORACLE}
