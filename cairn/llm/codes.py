"""Vector codes: parts of integer vectors named by the nearest entry of a codebook of their position.

Components become integers, so that every distance, sum and mean is exact and no order of tasks shows. A round broadcasts one
kd-tree for each position (parameters bound their size: positions x entries x dimensions); in the tasks whole batches walk a
tree by branch and bound. A cell whose bound equals the best distance is entered too, so that of equally near entries the one
with the lowest index is found. Tasks return a count and a sum for each entry; Spark adds them up, and the driver, which gets
one row an entry, divides. Vectors never leave their tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import table, written
from cairn.llm.vectors import rows_of, sound, whole

#: Integer steps of a unit, parts of a vector, entries of a codebook (two hex digits name one of 256), rounds, entries of a leaf.
SCALE, PARTS, ENTRIES, ROUNDS, LEAF = 4_096, 8, 16, 6, 4
#: Integers are held within this, that is components within 2^50; rows of a batch that are worked at once; labels that are broadcast at most.
HELD, ROWS, BROADCAST_LABELS = 2**62, 4_096, 100_000


class Codebooks(NamedTuple):
    """dims: length of the vectors; ends: where parts end; entries: of each part the entries, as rows of Python integers."""

    dims: int
    ends: tuple[int, ...]
    entries: list[list[list[int]]]

    def digest(self) -> str:
        """sha256 of all components by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()


def _parts(dims: int, parts: int) -> tuple[int, ...]:
    """Where the parts end: of equal length where that goes, else one component apart."""
    return tuple(dims * (k + 1) // parts for k in range(parts))


def _exact(*arrays: np.ndarray) -> bool:
    """Whether squared distances between rows of the arrays, and their sums, stay within 63 bits."""
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    return 4 * most * most * max(1, max(a.shape[-1] for a in arrays)) < 2**62


class Tree:
    """A kd-tree of a codebook's entries."""

    def __init__(self, entries: list[list[int]]):
        self.entries = np.array(entries, np.int64).reshape(len(entries), len(entries[0]) if entries else 0)
        self.root = self._node(np.arange(len(entries)))

    def _node(self, ids: np.ndarray):
        """(low, high, ids, left, right): the box of some entries; ids (ascending) in a leaf, else two nodes."""
        own = self.entries[ids]
        low, high = own.min(axis=0, initial=np.iinfo(np.int64).max), own.max(axis=0, initial=np.iinfo(np.int64).min)
        width = high.astype(object) - low if own.size else np.zeros(1)
        if len(ids) <= LEAF or not own.size or not max(width):
            return low, high, ids, None, None
        axis = int(np.argmax(width))
        order = own[:, axis].argsort(kind="stable")
        half = len(ids) // 2
        return low, high, None, self._node(np.sort(ids[order[:half]])), self._node(np.sort(ids[order[half:]]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry, the lowest of equally near ones, and its squared distance.

        Wide integers are worked as Python's, so that nothing overflows.
        """
        kind = np.int64 if _exact(points, self.entries) else object
        points, entries = points.astype(kind), self.entries.astype(kind)
        best = np.full(len(points), -1, kind)  # -1: none yet
        index = np.full(len(points), len(entries), np.int64)

        def bound(node, rows):
            own = points[rows]
            gap = np.maximum(np.maximum(node[0].astype(kind) - own, own - node[1].astype(kind)), 0)
            return (gap * gap).sum(axis=1)

        def visit(node, rows, least):
            open_ = (best[rows] < 0) | (least <= best[rows])
            rows = rows[open_]
            if not len(rows):
                return
            if node[2] is None:
                left, right = bound(node[3], rows), bound(node[4], rows)
                first = left <= right
                visit(node[3], rows[first], left[first])
                visit(node[4], rows, right)
                visit(node[3], rows[~first], left[~first])
                return
            for i in node[2].tolist():
                apart = points[rows] - entries[i]
                d2 = (apart * apart).sum(axis=1)
                better = (best[rows] < 0) | (d2 < best[rows]) | ((d2 == best[rows]) & (i < index[rows]))
                best[rows[better]], index[rows[better]] = d2[better], i

        everywhere = np.arange(len(points))
        if len(points) and len(entries):
            visit(self.root, everywhere, np.zeros(len(points), kind))
        return index, best


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _first(ints: DataFrame, entries: int) -> list[tuple[int | None, list[int]]]:
    """(id, vector) of the `entries` smallest ids, null last; of an id with several vectors the smallest one."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            bar = max(map(_key, found)) if len(found) >= entries else None
            near = [k for k, i in enumerate(ids) if bar is None or _key(i) <= bar]
            for i, v in zip((ids[k] for k in near), batch.column(1).take(pa.array(near, pa.int64())).to_pylist(), strict=True):
                found[i] = min(found.get(i, v), v)
                if len(found) > 4 * entries:
                    found = {i: found[i] for i in sorted(found, key=_key)[:entries]}
            found = {i: found[i] for i in sorted(found, key=_key)[:entries]}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["id", "v"])

    rows = ints.select("id", "v").mapInArrow(least, "id long, v array<long>").groupBy("id").agg(F.min("v").alias("v"))
    return [tuple(r) for r in rows.orderBy(F.col("id").isNull(), "id").limit(entries).collect()]


def _key(i: int | None) -> tuple[bool, int]:
    return i is None, i or 0


def _integers(vectors: DataFrame, embedding: str, scale: int):
    v = F.col(embedding).cast("array<double>")
    return F.when(sound(v), whole(v, scale, HELD))


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of the vectors, learned from every row.

    They start as the parts of the vectors with the smallest ids. Rows whose vector is null or holds null or non-finite
    components take no part; nor do vectors of another length than the one with the smallest id has. An entry that no part
    chose stays as it is; an empty table gives empty codebooks.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a codebook has 1 to 256 entries, and a vector one part at least")
    spark = vectors.sparkSession
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("e"))
    ints = written(named.select("id", _integers(named, "e", scale).alias("v")).filter("v IS NOT NULL"), "vectors")
    first = _first(ints, 1)
    if not first:
        return Codebooks(0, (0,) * parts, [[] for _ in range(parts)])
    dims = len(first[0][1])
    fitting = ints.filter(F.size("v") == dims)
    ends = _parts(dims, parts)
    spans = list(zip((0, *ends), ends, strict=False))
    seeds = _first(fitting, entries)
    books = [[v[a:b] for _, v in seeds] for a, b in spans]
    widest = max(b - a for a, b in spans)
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Tree(book) for book in books])

        def sums(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((parts, entries), np.int64)
            totals = np.zeros((parts, entries, widest), object)  # Python's integers: no sum is too large
            for batch in _batches(batches):
                rows = rows_of(batch.column(0), dims)
                for p, (a, b) in enumerate(spans):
                    own = rows[:, a:b]
                    index, _ = trees.value[p].nearest(own)
                    order = index.argsort(kind="stable")
                    used, starts, n = np.unique(index[order], return_index=True, return_counts=True)
                    counts[p, used] += n
                    if b > a:
                        wide = own[order].astype(np.int64 if _exact(own) else object)
                        totals[p, used, : b - a] += np.add.reduceat(wide, starts, axis=0)
            at = np.argwhere(counts)
            total = totals[at[:, 0], at[:, 1]] if len(at) else np.zeros((0, widest), object)
            high, low = (pa.array([[int(x) for x in r] for r in t], pa.list_(pa.int64())) for t in (total >> 32, total & (2**32 - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[counts > 0], pa.int64()), high, low], ["part", "entry", "n", "high", "low"])

        found = fitting.select("v").mapInArrow(sums, "part int, entry int, n long, high array<long>, low array<long>")
        added = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for k in range(widest) for c in ("high", "low")]
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # a row an entry
            a, b = spans[r["part"]]
            books[r["part"]][r["entry"]] = [((r[f"high{k}"] << 32) + r[f"low{k}"]) // r["n"] for k in range(b - a)]
        trees.destroy()
    return Codebooks(dims, ends, books)


def encode(vectors: DataFrame, books: Codebooks, embedding: str = "embedding", scale: int = SCALE, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with code (two hex digits a part) and error (long: squared distance to what the code stands for).

    Rows whose vector is null or holds null or non-finite components are dropped. A vector of another length than the
    codebooks' has no code and no error (null); an error beyond a long is null. Repeated rows give repeated rows. Input columns
    named code or error are replaced; all others come back whatever their names.
    """
    names = [c for c in (keep or vectors.columns) if c not in ("code", "error")]
    plain = [f"c{k}" for k in range(len(names))]
    rows = vectors.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain, strict=True)], F.col(f"`{embedding}`").alias("e"))
    rows = rows.withColumn("v", _integers(rows, "e", scale)).drop("e").filter("v IS NOT NULL")
    known = any(books.entries)
    rows = rows.withColumn("v", F.when(F.lit(known) & (F.size("v") == books.dims), F.col("v")))
    shared = vectors.sparkSession.sparkContext.broadcast([Tree(book) for book in books.entries])
    ends, dims, parts = books.ends, books.dims, len(books.ends)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            fits = batch.column(len(plain)).is_valid().to_numpy(zero_copy_only=False)
            own = rows_of(batch.column(len(plain)).drop_null(), dims)
            if not dims:
                own = np.zeros((int(fits.sum()), 0), np.int64)
            codes, errors = np.zeros((len(own), parts), np.uint8), np.zeros(len(own), object)
            for p, (a, b) in enumerate(zip((0, *ends), ends, strict=False)):
                index, d2 = shared.value[p].nearest(own[:, a:b])
                codes[:, p] = index
                errors += d2
            text, at = codes.tobytes().hex(), (np.cumsum(fits) - 1).tolist()
            code = [text[2 * parts * k : 2 * parts * (k + 1)] if ok else None for k, ok in zip(at, fits.tolist(), strict=True)]
            error = [int(errors[k]) if ok and errors[k] < 2**63 else None for k, ok in zip(at, fits.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*plain, "code", "error"])

    schema = rows.select(*plain, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    schema = schema.select(*plain, F.nullif("code", F.lit("")).alias("code"), F.nullif("error", F.lit(0).cast("long")).alias("error")).schema
    return rows.select(*plain, "v").mapInArrow(named, schema).select(*[F.col(p).alias(c) for c, p in zip(names, plain, strict=True)], "code", "error")


def decode(coded: DataFrame, books: Codebooks, code: str = "code", scale: int = SCALE) -> DataFrame:
    """coded with decoded (array of double): what the code stands for, at the middle of each integer's step; null of null."""
    shared = coded.sparkSession.sparkContext.broadcast(books.entries)

    @F.pandas_udf("array<double>")
    def back(codes):
        import pandas as pd

        books = [[[(x + 0.5) / scale for x in entry] for entry in book] for book in shared.value]
        return pd.Series([None if c is None else [x for p, book in enumerate(books) for x in book[int(c[2 * p : 2 * p + 2], 16)]] for c in codes], dtype=object)

    return coded.withColumn("decoded", back(F.col(f"`{code}`")))


def errors_by(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """coded with label_error: the sum of the errors of the rows of equal label, nulls together; null if beyond a long.

    Sums are made before rows move. Up to BROADCAST_LABELS labels their sums are broadcast; beyond that a join deals rows by
    label, and a label with very many rows is a partition that adaptive execution splits.
    """
    total = F.expr("try_cast(sum(cast(error AS decimal(38, 0))) AS bigint)")
    sums = written(coded.select(F.col(f"`{label}`").alias("of"), F.col(f"`{error}`").alias("error")).groupBy("of").agg(total.alias("label_error")), "labels")
    few = sums.count() <= BROADCAST_LABELS
    of = F.col(f"`{label}`")
    return coded.join(F.broadcast(sums) if few else sums, of.eqNullSafe(F.col("of")), "left").drop("of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding, the error of its label, and a digest of the codebooks."""
    vectors = table(spark, sf_dir, "embeddings")
    books = fit(vectors)
    coded = written(encode(vectors, books, keep=["vec_id", "label"]), "codes")
    return errors_by(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB: each round's nearest entries, then its codebooks."""
    d2 = "list_sum(list_transform(range(1, 9), lambda i: (p[i] - e[i]) * (p[i] - e[i])))"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "q AS MATERIALIZED (SELECT vec_id, part, x[8 * part + 1 : 8 * part + 8] AS p FROM v, range(8) AS r(part))",
        "c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS e FROM q WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))",
    ]
    for k in range(7):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, entry, d, p FROM (SELECT vec_id, q.part AS part, entry, {d2} AS d, p, row_number() OVER (PARTITION BY vec_id, q.part ORDER BY {d2}, entry) AS r FROM q JOIN c{k} c ON q.part = c.part) WHERE r = 1)")
        if k < 6:
            mean = ", ".join(f"floor(sum(p[{i}])::HUGEINT / count(*))::BIGINT" for i in range(1, 9))
            steps.append(f"m{k} AS (SELECT part, entry, [{mean}] AS e FROM a{k} GROUP BY 1, 2)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part AS part, c.entry AS entry, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry)")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c6)")
    steps.append("w AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT v.vec_id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN w ON v.vec_id = w.vec_id, h"


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _oracle()}
