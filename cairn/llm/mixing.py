"""Mixing sources to target weights by Pfair scheduling: each block of a source has a release time and a deadline.

A source of weight w, of weights that sum to W, releases its k-th block at floor(k W / w) and wants it out by
ceil((k + 1) W / w); one block goes out in each slot, of those released the one with the earliest deadline. Every deadline is
met, so after any number of slots a source is less than one block from its share of the stated weights. Weights are taken as
the fractions that they are written as, and W of their smallest whole parts is the period: the schedule repeats, so a block's
slot follows from its number alone. Sources that run out leave their slots empty and the others keep their proportions.

Blocks of equal deadlines go by weight, then by name. So sources of one weight go one after another, and a period is a list
of runs: which block of which weight, from which of its sources on, from which slot on. Its length depends on the weights
alone (distinct ones, as whole parts), not on the number of sources, which stay a table: there may be any number of them.

Only built-in functions over rows. Block numbers come from counts of small hash buckets and places within them, so that no
source is ever in one task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import table, written
from cairn.plans.ranking import ranked

#: Blocks of one period (a block of all sources of a weight counts once) at most; characters of a block; rows of a bucket
#: about; rows that are broadcast at most; seed of the order within a source.
RUNS, BLOCK_CHARS, BUCKET_ROWS, BROADCAST_ROWS, SEED = 1_000_000, 65_536, 4_096, 100_000, "mix"
#: The columns that mixing adds.
ADDED = ("mix_order", "mix_block", "mix_release", "mix_deadline", "mix_slot")


class Run(NamedTuple):
    """Block k of the sources of one weight (part: its whole parts), from the source `first` of them on, from slot `slot` on."""

    part: int
    k: int
    release: int
    deadline: int
    first: int
    n: int
    slot: int


def whole_parts(weights: list[float]) -> dict[float, int]:
    """The smallest whole numbers in proportion to the distinct weights, each read as the fraction it is written as."""
    if not weights or not all(w is not None and 0 < w < math.inf for w in weights):
        raise ValueError("weights must be positive and finite, and there must be one")
    exact = {w: Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for w in weights}
    least = math.lcm(*(x.denominator for x in exact.values()))
    whole = {w: int(x * least) for w, x in exact.items()}
    shared = math.gcd(*whole.values())
    if sum({x // shared for x in whole.values()}) > RUNS:
        raise ValueError(f"the distinct weights' smallest whole parts sum to more than {RUNS}: write them with fewer digits")
    return {w: x // shared for w, x in whole.items()}


def schedule(members: dict[int, int]) -> list[Run]:
    """One period, earliest deadline first among the released blocks. members: of each whole part, how many sources have it."""
    period = sum(part * n for part, n in members.items())
    waiting, ready, out, slot = [(0, part, 0) for part in sorted(members)], [], [], 0
    heapq.heapify(waiting)
    while slot < period:  # parts sum to the period, so some block is always ready
        while waiting and waiting[0][0] <= slot:
            release, part, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // part), part, k, release, 0))
        deadline, part, k, release, first = heapq.heappop(ready)
        n = min(members[part] - first, waiting[0][0] - slot if waiting else period)
        out.append(Run(part, k, release, deadline, first, n, slot))
        slot += n
        if first + n < members[part]:
            heapq.heappush(ready, (deadline, part, k, release, first + n))
        elif k + 1 < part:
            heapq.heappush(waiting, ((k + 1) * period // part, part, k + 1))
    return out


def _small(spark: SparkSession, columns: Iterable, types: dict[str, pa.DataType]) -> DataFrame:
    """A table of the driver's columns, from Arrow: a list of rows would start Python workers of its own on the executors, which
    stay beside the others."""
    return spark.createDataFrame(pa.table({c: pa.array(x, t) for x, (c, t) in zip(columns, types.items(), strict=True)}))


def _turns(spark: SparkSession, sources: DataFrame, weights: DataFrame | dict[str | None, float] | None) -> tuple[DataFrame, list[Run], int, int]:
    """(__of, __part, __i) of each source with a weight: its whole part and its place by name among those of that part, null
    last; then a period's runs, its length and how many sources there are. sources: distinct ones (__source)."""
    if weights is None:
        stated = sources.select(F.col("__source").alias("__of"), F.lit(1.0).alias("__weight"))
    else:
        frame = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, w double") if isinstance(weights, dict) else weights
        source, weight = frame.columns
        stated = written(frame.select(F.col(f"`{source}`").cast("string").alias("__of"), F.col(f"`{weight}`").cast("double").alias("__weight")), "weights")
        if stated.groupBy("__of").count().filter("count > 1").limit(1).count():
            raise ValueError("a source has two weights")
        if missing := [r[0] for r in sources.join(stated, F.col("__source").eqNullSafe(F.col("__of")), "left_anti").select("__source").limit(10).collect()]:
            raise ValueError(f"sources without a weight: {missing}")
    classes = stated.groupBy("__weight").agg(F.count("*").alias("n")).limit(RUNS + 1).collect()
    parts = whole_parts([r["__weight"] for r in classes])
    members: dict[int, int] = {}
    for r in classes:
        members[parts[r["__weight"]]] = members.get(parts[r["__weight"]], 0) + r["n"]
    of = _small(spark, zip(*parts.items(), strict=True), {"__weight": pa.float64(), "__part": pa.int64()})
    named = stated.join(F.broadcast(of) if len(parts) <= BROADCAST_ROWS else of, "__weight").select("__of", "__part", F.col("__of").isNull().cast("int").alias("__last"))
    turns = ranked(named, "__last", ["__of"], ["__part"], "__i").select("__of", "__part", "__i")
    return turns, schedule(members), sum(part * n for part, n in members.items()), sum(members.values())


def mix(docs: DataFrame, weights: DataFrame | dict[str | None, float] | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with mix_block, mix_release, mix_deadline and mix_slot (long): read by (mix_slot, mix_order), sources have their weights.

    weights: of each source, relative, as a dictionary or as a table of two columns (source, weight); None: all alike. Weights
    are of characters; a row belongs to the block in which it begins. Within a source rows follow in the order mix_order (a hash
    of the id, then the id), so runs agree. Every row is kept: sources without a weight, or with two, raise an error, a source
    with a weight and no row keeps its slots, a null source is a source of its own, null texts count as empty, repeated rows
    get places of their own, and rows with a null id come first in their bucket. Input columns with the names of the new ones
    are replaced; all others come back as they are, whatever their names.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ADDED]
    plain = {c: f"c{k}" for k, c in enumerate(names)}  # so that no input column's name is one of those below
    docs = docs.select(*[F.col(f"`{c}`").alias(plain[c]) for c in names])
    doc_id, source, text = plain[doc_id], plain[source], plain[text]
    back = [F.col(plain[c]).alias(c) for c in names]
    # hash order: unrelated to how the table was written, the same on every run and engine
    spread = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.withColumn("mix_order", spread).withColumn("__chars", F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).cast("long")).withColumn("__source", F.col(f"`{source}`").cast("string"))
    sources = written(rows.groupBy("__source").count(), "sources")
    n = sources.agg(F.sum("count")).first()[0]
    if not n:
        return rows.select(*back, "mix_order", *[F.lit(None).cast("long").alias(c) for c in ("mix_block", "mix_release", "mix_deadline", "mix_slot")])
    turns, runs, period, known = _turns(spark, sources, weights)
    digits = max(1, min(8, len(f"{max(1, n // BUCKET_ROWS):x}")))  # a bucket: rows whose hash starts alike
    rows = rows.withColumn("__bucket", F.substring("mix_order", 1, digits))
    sizes = written(rows.groupBy("__source", "__bucket").agg(F.sum("__chars").alias("chars")), "mix")
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__source", "__bucket", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("__before"))
    starts = starts.join(F.broadcast(turns) if known <= BROADCAST_ROWS else turns, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    within = Window.partitionBy("__source", "__bucket").orderBy("mix_order", F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__within", F.coalesce(F.sum("__chars").over(within), F.lit(0)))
    placed = placed.join(starts.withColumnsRenamed({"__source": "__s", "__bucket": "__b"}), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    placed = placed.withColumn("mix_block", F.floor((F.col("__before") + F.col("__within")) / block_chars).cast("long"))
    one = _small(spark, zip(*runs, strict=True), dict.fromkeys(("__of", "__k", "__release", "__deadline", "__first", "__n", "__slot"), pa.int64()))
    own = (F.col("__part") == F.col("__of")) & (F.col("__k") == F.pmod("mix_block", "__part")) & (F.col("__i") >= F.col("__first")) & (F.col("__i") < F.col("__first") + F.col("__n"))
    timed = placed.join(F.broadcast(one) if len(runs) <= BROADCAST_ROWS else one, own)
    rounds = F.floor(F.col("mix_block") / F.col("__part")) * period
    slot = rounds + F.col("__slot") + F.col("__i") - F.col("__first")
    return timed.select(*back, "mix_order", "mix_block", (rounds + F.col("__release")).alias("mix_release"), (rounds + F.col("__deadline")).alias("mix_deadline"), slot.alias("mix_slot"))


def stated_weights(docs: DataFrame, source: str = "source") -> DataFrame:
    """(source, weight): the weights of the query and of the pipeline, of the sources by name (null last) 1, 2, 3, 4, 1 ...; a
    caller's own otherwise. A table, as there may be any number of sources."""
    names = docs.select(F.col(f"`{source}`").cast("string").alias("source")).distinct().withColumn("last", F.col("source").isNull().cast("int"))
    return ranked(names, "last", ["source"], name="i").select("source", (1.0 + F.col("i") % 4).alias("weight"))


def _digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_release").alias("release"), F.col("mix_deadline").alias("deadline"), F.col("mix_slot").alias("slot"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, release, deadline and slot of every document by the stated, unequal weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return _digest(mix(docs, stated_weights(docs)))


def op6_mixing_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, release, deadline and slot of every document, all sources alike: a round by name."""
    return _digest(mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


_PLACED = """s AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)
), d AS (
  SELECT doc_id, source, coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY source ORDER BY md5('mix' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 65536 AS block FROM documents
)"""

#: DuckDB: releases and deadlines from the stated weights; earliest deadline first, slot by slot, by recursion (k has the
#: blocks that each source has sent; of equal deadlines the first by weight, then by name); then each block's round.
ORACLE = f"""
WITH RECURSIVE {_PLACED}, p AS (
  SELECT source, n, 1 + i % 4 AS part, sum(1 + i % 4) OVER ()::BIGINT AS period, row_number() OVER (ORDER BY 1 + i % 4, i) - 1 AS i FROM s
), c AS (SELECT list(part ORDER BY i) AS parts, max(n) AS n, max(period) AS period FROM p
), r AS (
  SELECT -1::BIGINT AS slot, list_transform(parts, lambda x: 0::BIGINT) AS k, NULL::BIGINT AS best FROM c
  UNION ALL
  SELECT slot + 1, list_transform(k, lambda x, j: CASE WHEN best IS NOT NULL AND j = best % n + 1 THEN x + 1 ELSE x END), best FROM (
    SELECT slot, k, n, list_min(list_transform(range(1, n + 1), lambda j: CASE WHEN k[j] < parts[j] AND k[j] * period // parts[j] <= slot + 1 THEN ((k[j] + 1) * period + parts[j] - 1) // parts[j] * n + j - 1 END)) AS best
    FROM r, c WHERE slot + 1 < period)
), t AS (
  SELECT slot, best % c.n AS i, k[best % c.n + 1] - 1 AS k, best // c.n AS deadline FROM r, c WHERE best IS NOT NULL
)
SELECT doc_id, d.source, block::BIGINT AS block, (block // part * period + k * period // part)::BIGINT AS release, (block // part * period + deadline)::BIGINT AS deadline, (block // part * period + slot)::BIGINT AS slot
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN t ON t.i = p.i AND t.k = block % part
"""

#: DuckDB: with equal weights the schedule is a round of the sources by name.
ORACLE_EQUAL = f"""
WITH {_PLACED}
SELECT doc_id, d.source, block::BIGINT AS block, (block * n)::BIGINT AS release, ((block + 1) * n)::BIGINT AS deadline, (block * n + i)::BIGINT AS slot
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
"""

QUERIES = {"op6_mixing": op6_mixing, "op6_mixing_equal": op6_mixing_equal}
ORACLES = {"op6_mixing": ORACLE, "op6_mixing_equal": ORACLE_EQUAL}
