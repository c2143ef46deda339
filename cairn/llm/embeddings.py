"""Near duplicates among embeddings: a subspace pigeonhole join, exact for cosine >= threshold.

Unit vectors with cosine c are at squared distance 2 - 2c. After one fixed rotation the coordinates are split into blocks;
a linked pair is, in one block at least, within the block's share of the squared distance (its share of the dimensions).
So each block is range-joined under its own budget: a vector lives in one cell of a grid over the block's first
coordinates, and also visits the later cells that its budget reaches. In each cell all pairs within the budget are
verified by their cosine in double precision.

No pair leaves a cell. A linked pair counts in the first block whose budget it meets, in one cell there, so that link
counts are sums; what a cell returns is, for each of its vectors, a number of links and one link that keeps its component
together. Large cells are worked as pairs of tiles. Equal vectors are one weighted vector all along. Vectors of each length are
joined among themselves, all in the same jobs.

Where the cells of a length hold more pairs than all its vectors do (vectors that fill their dimensions), its vectors meet as
they are: tiles of them are rows of a table, and a product of that table with itself streams each pair of tiles to a task, so
that no vector is written more than once or twice, however many tiles there are. Time then grows with the square of the vectors.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import arrow_rows, table, written
from cairn.llm.components import connected_components

#: Blocks that a vector is split into, coordinates of a block that its grid uses, vectors of a tile, the rounding error
#: that a budget allows for, and the one of the first, coarse distances.
BLOCKS, GRID, TILE, SLACK, COARSE = 4, 3, 8_000, 1e-9, 1e-5
#: In place of a block: whole vectors.
ALL = -1
#: Pairs whose distances are computed at once.
PAIRS = 1_000_000
#: Cells are joined with their sizes by broadcast up to so many of them.
BROADCAST_CELLS = 200_000
#: Vectors of a length at least for plain pairs; tiles that they are cut into at least; partitions of tiles at least, and tiles of
#: one at most.
WHOLE, TILES, DEAL, HELD = 2_000, 24, 12, 8
THRESHOLD = 0.95


@lru_cache(maxsize=8)
def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A fixed random rotation, so that no block holds more of the distances than its share, whatever the input's axes."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _bounds(dims: int) -> np.ndarray:
    return np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)


def _units(packed: bytes, kind: str, dims: int) -> np.ndarray:
    """Vectors scaled to length 1; large and small components neither overflow nor vanish."""
    rows = np.frombuffer(packed, kind).reshape(-1, dims).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _visits(vectors: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(dims, block, cell, id, weight, home, packed): each vector in its own cell and in the later ones its budget reaches."""
    names = ["dims", "block", "cell", "id", "weight", "home", "packed"]

    def of_length(batch: pa.RecordBatch, dims: int):
        bounds = _bounds(dims)
        turned = _units(b"".join(batch.column(3).to_pylist()), kind, dims) @ rotation(dims)
        for block, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            reach = np.sqrt((2 - 2 * threshold) * (b - a) / dims + SLACK)
            side, own = 2 * reach, turned[:, a : min(b, a + GRID)]
            home = np.floor(own / side).astype(np.int64)
            wide = int(np.ceil(1 / side)) + 2  # coordinates lie between -1 and 1
            for step in np.ndindex(*(3,) * own.shape[1]):
                shift = np.array(step) - 1
                if tuple(shift) < (0,) * len(shift):
                    continue  # the other vector visits this one's cell
                # distance of the vector from the shifted cell, along each coordinate
                away = np.where(shift > 0, (home + 1) * side - own, np.where(shift < 0, own - home * side, 0.0))
                near = np.flatnonzero((away**2).sum(axis=1) <= reach**2)
                cells = (home[near] + shift + wide) @ ((2 * wide + 1) ** np.arange(own.shape[1]))
                at = pa.array(near)
                columns = [np.full(len(near), dims, np.int32), np.full(len(near), block, np.int32), cells, batch.column(1).take(at), batch.column(2).take(at), np.full(len(near), not shift.any()), batch.column(3).take(at)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    def run(batches):
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            for dims in np.unique(lengths).tolist():
                yield from of_length(batch.filter(pa.array(lengths == dims)), dims)

    return vectors.mapInArrow(run, "dims int, block int, cell long, id long, weight long, home boolean, packed binary")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position of each position's component under these links."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _cell_links(threshold: float, kind: str):
    def links(group: pa.Table) -> pa.Table:
        """Links of a tile: for each vector its weight of links, and one link to its component's smallest id."""
        dims, block, i, j = (group.column(c)[0].as_py() for c in ("dims", "block", "i", "j"))
        bounds = _bounds(dims)
        budgets = [(2 - 2 * threshold) * (b - a) / dims + SLACK for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        ids, weight, home, tile = (group.column(c).to_numpy() for c in ("id", "weight", "home", "t"))
        unit = _units(b"".join(group.column("packed").to_pylist()), kind, dims)
        n, counts, root = len(ids), np.zeros(len(ids)), np.arange(len(ids))
        if block == ALL:
            flat, most = unit.astype(np.float32), 2 - 2 * threshold + 10 * COARSE
        else:
            turned = unit @ rotation(dims)
            parts = [turned[:, a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            norms = [(x**2).sum(axis=1) for x in parts]
            flat, most = parts[block].astype(np.float32), budgets[block] + COARSE
        square = (flat**2).sum(axis=1)[:, None]
        one, two = np.hstack([-2 * flat, square, np.ones_like(square)]), np.hstack([flat, np.ones_like(square), square])

        def within(k: int, x: np.ndarray, y: np.ndarray, near: np.ndarray) -> np.ndarray:
            """Whether pairs meet block k's budget; every cell decides it by the same sum where it is close."""
            close = np.flatnonzero(np.abs(near - budgets[k]) < 1e-10)
            near[close] = ((parts[k][x[close]] - parts[k][y[close]]) ** 2).sum(axis=1)
            return near <= budgets[k]

        def join(rows: np.ndarray, others: np.ndarray, ordered: bool) -> None:
            """Links between rows and others; ordered: of two vectors that are in both, the earlier must be the row."""
            nonlocal counts, root
            r, c = np.nonzero(one[rows] @ two[others].T <= most)
            x, y = rows[r], others[c]
            if ordered:
                earlier = (x < y) | ~home[y]
                r, c, x, y = r[earlier], c[earlier], x[earlier], y[earlier]
            dense = 20 * len(r) > len(rows) * len(others)
            cosine = (unit[rows] @ unit[others].T)[r, c] if dense else np.einsum("ij,ij->i", unit[x], unit[y])
            hit = np.flatnonzero(cosine >= threshold)
            r, c, x, y = r[hit], c[hit], x[hit], y[hit]
            if not len(x):
                return
            new = np.ones(len(x), bool)
            for k in range(block, ALL, -1):
                if dense:
                    near = (norms[k][rows][:, None] + norms[k][others] - 2 * (parts[k][rows] @ parts[k][others].T))[r, c]
                else:
                    near = ((parts[k][x] - parts[k][y]) ** 2).sum(axis=1)
                new &= within(k, x, y, near) if k == block else ~within(k, x, y, near)
            counts += np.bincount(x[new], weight[y[new]], n) + np.bincount(y[new], weight[x[new]], n)
            apart = root[x] != root[y]
            if apart.any():
                root = _roots(n, np.concatenate([np.arange(n), x[apart]]), np.concatenate([root, y[apart]]))

        # two residents meet once, a resident and a visitor once, two visitors never
        here, there = [np.flatnonzero((tile == t) & home) for t in (i, j)], [np.flatnonzero((tile == t) & ~home) for t in (i, j)]
        if i == j:
            work = [(here[0], np.concatenate([here[0], there[0]]), True)]
        else:
            work = [(here[0], np.concatenate([here[1], there[1]]), False), (there[0], here[1], False)]
        for rows, others, ordered in work:
            size = max(1, PAIRS // max(1, len(others)))
            for at in range(0, len(rows) if len(others) else 0, size):
                join(rows[at : at + size], others[at:] if ordered else others, ordered)
        smallest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(smallest, root, ids)
        kept = (counts > 0) | (smallest[root] != ids)
        return pa.table({"id": ids[kept], "links": counts[kept].astype(np.int64), "least": smallest[root][kept]})

    return links


def _plain_links(classes: DataFrame, lengths: dict[int, int], threshold: float, kind: str) -> DataFrame:
    """(id, links, least) of the pairs of tiles of the vectors of these lengths (with how many vectors there are)."""
    spark = classes.sparkSession
    tiles = {dims: -(-n // max(1, min(TILE, n // TILES))) for dims, n in lengths.items()}
    of = F.create_map(*[F.lit(x) for pair in tiles.items() for x in pair])[F.col("dims")]
    own = classes.filter(F.col("dims").isin(*tiles)).withColumn("t", F.pmod(F.xxhash64("id"), of).cast("int"))
    rows = F.collect_list(F.struct("id", "weight", "packed"))
    packs = written(own.groupBy("dims", "t").agg(rows.alias("rows")), "tiles")
    n = max(min(DEAL, sum(tiles.values())), -(-sum(tiles.values()) // HELD))
    a, b = (packs.select(F.col("dims").alias(f"dims_{k}"), F.col("t").alias(k), F.col("rows").alias(f"rows_{k}")).repartition(n) for k in "ij")
    pairs = a.hint("shuffle_replicate_nl").join(b, (F.col("dims_i") == F.col("dims_j")) & (F.col("i") <= F.col("j"))).select(F.col("dims_i").alias("dims"), "i", "j", "rows_i", "rows_j")
    links = _cell_links(threshold, kind)

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                dims, i, j = (batch.column(c)[k].as_py() for c in ("dims", "i", "j"))
                sides = [batch.column(f"rows_{s}")[k].values for s in ("i", "j")[: 1 if i == j else 2]]
                tile = np.repeat([i, j][: len(sides)], [len(x) for x in sides]).astype(np.int32)
                columns = {c: pa.chunked_array([x.field(c) for x in sides]).combine_chunks() for c in ("id", "weight", "packed")}
                one = {c: pa.array(np.full(len(tile), v, np.int32)) for c, v in (("dims", dims), ("block", ALL), ("i", i), ("j", j), ("t", tile))}
                yield from links(pa.table(one | columns | {"home": pa.array(np.ones(len(tile), bool))})).to_batches()

    with arrow_rows(spark, 1):  # a row is two tiles
        return written(pairs.mapInArrow(run, "id long, links long, least long"), "links")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: links are pairs of rows with cosine >= threshold.

    A vector that is null, empty, zero or holds null or non-finite components links with nothing and is its own
    component. Vectors link only with those of their own length. Equal vectors link with each other. Repeated
    rows count as further vectors; they share the id, so n_links counts them. A row with a null id links with nothing. Other
    columns are not read.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    fit = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fit, F.lit(False)) & F.col("vec_id").isNotNull())
    # -0.0 and 0.0 are equal, as hashes see it too
    keyed = rows.filter("ok").select("vec_id", F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(1)).alias("g"), "v")
    # equal vectors, told by 128 bits of hash, go on as one
    kind = "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"
    groups = keyed.groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v"))

    def packed(batches):
        for batch in batches:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy()
            raw = lists.values.to_numpy().astype(kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(ends), pa.int32()), pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["h", "g", "id", "weight", "dims", "packed"])

    classes = written(groups.mapInArrow(packed, "h long, g long, id long, weight long, dims int, packed binary"), "vectors")
    visits = _visits(classes.select("dims", "id", "weight", "packed"), threshold, kind)
    cell = ["dims", "block", "cell"]
    sizes = written(visits.groupBy(*cell).agg(F.count("*").alias("n"), F.count_if("home").alias("own")).filter("n > 1 AND own > 0"), "cells")
    pairs = sizes.groupBy("dims").agg(F.sum(F.col("own") * (F.col("n") - (F.col("own") + 1) / 2)).alias("pairs"))
    many = classes.groupBy("dims").agg(F.count("*").alias("n")).filter(F.col("n") >= WHOLE).join(pairs, "dims").filter(F.col("pairs") > F.col("n") * (F.col("n") - 1) / 2)
    plain = {r["dims"]: r["n"] for r in many.collect()}  # no more than vectors / WHOLE
    if plain:
        visits, sizes = (df.filter(~F.col("dims").isin(*plain)) for df in (_visits(classes.filter(~F.col("dims").isin(*plain)).select("dims", "id", "weight", "packed"), threshold, kind), sizes))
    sizes = sizes.select(*cell, F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    dealt = visits.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes, cell)
    dealt = dealt.withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = dealt.select(*cell, F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "id", "weight", "home", "packed")
    found = written(tiled.groupBy(*cell, "i", "j").applyInArrow(_cell_links(threshold, kind), "id long, links long, least long"), "links")
    if plain:
        found = found.union(_plain_links(classes, plain, threshold, kind))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    named = classes.select("h", "g", "id", "weight").join(counts, "id", "left").join(components, F.col("id") == F.col("node"), "left")
    named = named.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    one = rows.select("vec_id", F.when(F.col("ok"), F.xxhash64("v")).alias("h"), F.when(F.col("ok"), F.xxhash64("v", F.lit(1))).alias("g"))
    out = one.join(named, ["h", "g"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), e AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.95
), r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached
), c AS (SELECT node AS vec_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT c.vec_id, (SELECT count(*) FROM e WHERE e.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""

QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup}
ORACLES = {"op10_embedding_near_dedup": ORACLE}
