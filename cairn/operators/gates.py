"""Gates over metrics, what failed and by how much, which candidate to prefer, whether a baseline may move.

Metrics are long rows: by (run, check ...), metric, value; gates are rows: (check,) key, threshold, where a key is min_ or
max_ and a metric's name.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.geometry import ratio
from cairn.plans.ranking import ranked, ranges
from cairn.plans.storage import written

#: Gains that move a baseline: mean over the history's best, and worst single margin.
MEAN_GAIN, WORST_GAIN = 0.03, -0.01

#: Items that one task puts on fronts.
FRONT_BLOCK = 200_000


def gate_rows(spark: SparkSession, gate: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, k[4:], k[:3], float(v)) for k, v in sorted(gate.items())], "key string, metric string, side string, threshold double")


def wide_gate(df: DataFrame, gate: dict[str, float | None]) -> DataFrame:
    """df (a column for each metric) with passed and reasons. Without thresholds passed is null; a metric that is null or
    NaN fails as unavailable."""
    reasons = []
    for key, limit in gate.items():
        if limit is None:
            continue
        value, low = F.col(key[4:]).cast("double"), key.startswith("min_")
        bad = value < limit if low else value > limit
        text = F.format_string(f"{key[4:]} %.4f {'<' if low else '>'} {key} %.4f", value, F.lit(float(limit)))
        reasons.append(F.when(value.isNull() | F.isnan(value), F.lit(f"{key[4:]} unavailable")).when(bad, text))
    if not reasons:
        return df.withColumns({"passed": F.lit(None).cast("boolean"), "reasons": F.array().cast("array<string>")})
    out = df.withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull()))
    return out.withColumn("passed", F.size("reasons") == 0)


def overall(df: DataFrame, *gates: str) -> DataFrame:
    """passed of several gates (columns): null if all are null, else whether none of the others failed."""
    known = F.filter(F.array(*map(F.col, gates)), lambda g: g.isNotNull())
    return df.withColumn("overall", F.when(F.size(known) > 0, F.forall(known, lambda g: g)))


def status(passed: Column, severity: Column, skipped: Column) -> Column:
    """skip, pass, info (no gate), warn or fail."""
    return F.when(skipped, "skip").when(passed.isNull(), "info").when(passed, "pass").when(severity.isin("warn", "soft_fail"), severity).otherwise("fail")


def policy(checks: DataFrame, mode: str = "default", by: list[str] | None = None) -> DataFrame:
    """Counts by status, and whether the mode blocks: default on failures, strict on anything but a pass or skip, warn_only never."""
    names = ("pass", "fail", "warn", "soft_fail", "info", "skip")
    out = checks.groupBy(*(by or [])).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in names])
    blocks = {"default": F.col("n_fail") > 0, "warn_only": F.lit(False), "strict": F.col("total") > F.col("n_pass") + F.col("n_skip")}[mode]
    return out.withColumn("blocked", blocks).withColumn("exit_code", F.col("blocked").cast("int"))


def margins(metrics: DataFrame, gates: DataFrame, by: list[str]) -> DataFrame:
    """Each gated metric with its margin: distance from the threshold over the threshold's size, positive if it passes."""
    m = metrics.join(F.broadcast(gates), "metric")  # a gate has a few rows
    signed = F.when(F.col("side") == "min", F.col("value") - F.col("threshold")).otherwise(F.col("threshold") - F.col("value"))
    return m.select(*by, "metric", "key", "value", "threshold", (signed / F.greatest(F.abs("threshold"), F.lit(1e-6))).alias("margin"))


def margin_stats(m: DataFrame, by: list[str]) -> DataFrame:
    return m.groupBy(*by).agg(F.avg("margin").alias("mean_margin"), F.min("margin").alias("worst_margin"), F.avg((F.col("margin") >= 0).cast("double")).alias("pass_ratio"), F.count("*").alias("gated"))


def triage(m: DataFrame, by: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Failed items by severity: weighted sum of their gaps plus a little for each further failed metric."""
    weight = F.coalesce(*[F.when(F.col("metric") == k, F.lit(float(v))) for k, v in (weights or {}).items()], F.lit(1.0))
    gap = F.when(F.col("margin") < 0, -F.col("margin"))
    out = m.groupBy(*by).agg(F.sum(gap * weight).alias("gap"), F.count(gap).alias("failed"), F.max(gap).alias("max_gap"), F.array_join(F.array_sort(F.collect_set(F.when(gap.isNotNull(), F.col("metric")))), ",").alias("signature"))
    return out.filter("failed > 0").withColumn("score", F.round(F.col("gap") + 0.08 * (F.col("failed") - 1), 6))


def round_robin(failed: DataFrame, by: list[str]) -> DataFrame:
    """Failed items with their place when clusters of one signature take turns, worst clusters and items first."""
    turns = ranked(failed.withColumn("__low", -F.col("gap")), "__low", by, ["signature"], "turn").withColumn("turn", (F.col("turn") + 1).cast("int")).drop("__low")
    clusters = failed.groupBy("signature").agg(F.max("gap").alias("__top"), F.count("*").alias("__size"))
    order = Window.orderBy(F.desc("__top"), F.desc("__size"), "signature")  # as many rows as signatures
    return turns.join(clusters.withColumn("cluster", F.row_number().over(order)).select("signature", "cluster"), "signature")


def pareto(items: DataFrame, less: str, more: str) -> DataFrame:
    """Items that no other beats: none with less of `less` and as much of `more`, or as little and more. A running maximum
    over distinct `less` values; items with nulls don't take part."""
    best = items.filter(F.col(less).isNotNull() & F.col(more).isNotNull()).groupBy(less).agg(F.max(more).alias("__best"))
    # the maximum so far, by ranges of `less` and then within each: no range holds more than its share
    ranged = ranges(best, less).withColumnRenamed("__r", "__range")
    tops = ranged.groupBy("__range").agg(F.max("__best").alias("__top"))
    before = tops.select("__range", F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))  # as many rows as ranges
    within = F.max("__best").over(Window.partitionBy("__range").orderBy(less).rowsBetween(Window.unboundedPreceding, -1))
    front = ranged.withColumn("__within", within).join(before, "__range").filter(F.col("__best") > F.coalesce(F.greatest("__before", "__within"), F.lit(float("-inf"))))
    return items.join(front.select(F.col(less).alias("__l"), F.col("__best").alias("__b")), (F.col(less) == F.col("__l")) & (F.col(more) == F.col("__b"))).drop("__l", "__b")


def recommended(items: DataFrame, less: str, more: str, gate: dict[str, float], ties: list[str]) -> DataFrame:
    """Of the front's items that pass the gate, the one with the smallest `less`; no row if none passes."""
    return wide_gate(pareto(items, less, more), gate).filter("passed").orderBy(less, F.desc(more), *ties).limit(1)


def pareto_fronts(items: DataFrame, less: str, more: str, block: int = FRONT_BLOCK) -> DataFrame:
    """Items with the number of their front: the first is the Pareto front, the second that of the rest, and so on.

    An item's front is the length of the longest chain of items that beat one another down to it. Items are taken by `less`
    in blocks; each front's largest `more` so far, a row a front, is all that goes from one block to the next. Items with nulls don't
    take part.
    """
    spark = items.sparkSession
    items = written(items.filter(F.col(less).isNotNull() & F.col(more).isNotNull()), "fronts")
    pairs = items.select(F.col(less).alias("l"), F.col(more).alias("m")).distinct().withColumn("down", -F.col("m").cast("double"))
    pairs = written(ranked(pairs, "l", ["down"], name="place").withColumn("block", F.floor(F.col("place") / block)), "fronts")
    m = pairs.schema["m"].dataType.simpleString()
    tops, out = spark.createDataFrame([], f"front long, m {m}"), None

    def place(key, rows, known):
        # largest first: an item goes to the first front whose largest it exceeds; NaN exceeds all else, as in Spark
        keys = [(0, 0.0) if math.isnan(v) else (1, -float(v)) for v in known.sort_values("front")["m"]]
        rows, fronts = rows.sort_values("place"), []
        for v in rows["m"]:
            k = (0, 0.0) if math.isnan(v) else (1, -float(v))
            i = bisect.bisect_right(keys, k)
            keys[i : i + 1] = [k]
            fronts.append(i + 1)
        return rows.assign(front=fronts)[["l", "m", "front"]]

    for b in range((pairs.agg(F.max("block")).first()[0] or 0) + 1):
        found = pairs.filter(F.col("block") == b).select("l", "m", "place", F.lit(0).alias("one")).groupBy("one").cogroup(tops.withColumn("one", F.lit(0)).groupBy("one"))
        found = written(found.applyInPandas(place, f"l {pairs.schema['l'].dataType.simpleString()}, m {m}, front long"), "front")
        tops = written(tops.union(found.select("front", "m")).groupBy("front").agg(F.max("m").alias("m")), "tops")
        out = found if out is None else out.union(found)
    return items.join(out.withColumn("front", F.col("front").cast("int")), (F.col(less) == F.col("l")) & (F.col(more) == F.col("m"))).drop("l", "m")


def window_decision(stats: DataFrame, series: str, at: str, look: int = 3) -> DataFrame:
    """promote, keep or reject each snapshot (mean_margin, worst_margin, passed) against its series' last ones.

    A failed snapshot is rejected; with fewer than look - 1 passed ones just before it, it is kept; it is promoted when its
    mean margin gains enough on theirs and its worst margin loses little.
    """
    order = Window.partitionBy(series).orderBy(at)
    back = order.rowsBetween(-(look - 1), -1)
    out = stats.withColumns({"streak": F.sum(F.col("passed").cast("int")).over(back), "mean_gain": F.col("mean_margin") - F.avg("mean_margin").over(back), "worst_gain": F.col("worst_margin") - F.avg("worst_margin").over(back)})
    decision = F.when(~F.col("passed"), "reject").when(F.coalesce("streak", F.lit(0)) < look - 1, "keep").when((F.col("mean_gain") >= MEAN_GAIN) & (F.col("worst_gain") >= WORST_GAIN), "promote").otherwise("keep")
    return out.withColumn("decision", decision)


def guard_decision(stats: DataFrame, series: str, at: str) -> DataFrame:
    """promote a passed snapshot that beats the best mean margin before it with no negative margin; the first one too."""
    before = Window.partitionBy(series).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("mean_margin").over(before)
    ok = F.col("passed") & (F.col("worst_margin") >= 0) & (best.isNull() | (F.col("mean_margin") - best >= MEAN_GAIN))
    return stats.withColumn("decision", F.when(~F.col("passed"), "reject").when(ok, "promote").otherwise("keep"))


def rotate(history: DataFrame, series: str, at: str, keep: int = 10) -> DataFrame:
    """History rows with whether they are kept: the newest `keep` of each series."""
    return history.withColumn("kept", F.row_number().over(Window.partitionBy(series).orderBy(F.desc(at))) <= keep)


def ndcg(ranked: DataFrame, by: list[str], place: str, relevance: str) -> DataFrame:
    """Relevance over place, summed, against that of the best order (the divisor is the place itself)."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(relevance), place))
    return ranked.withColumn("__best", best).groupBy(*by).agg(ratio(F.sum(F.col(relevance) / F.col(place)), F.sum(F.col(relevance) / F.col("__best"))).alias("ndcg"))


def difference(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Rows of long key/value tables that differ: added, removed or changed."""
    a, b = old.select(*keys, F.col(value).alias("old"), F.lit(1).alias("__o")), new.select(*keys, F.col(value).alias("new"), F.lit(1).alias("__n"))
    both = a.join(b, keys, "full")
    kind = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(*keys, "old", "new", "kind")


def frame_ranking(frames: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n frames of each run to look at first: failed, then in a row, of low quality, retried, and by cost and shifts."""
    score = F.col("failed").cast("int") * 1e6 + F.col("consecutive") * 1e4 + F.col("low_quality").cast("int") * 1e3 + F.col("retries") * 100 + F.col("cost") * 10 + F.col("rejection") * 5 + F.col("shift")
    reasons = F.filter(F.array(F.when(F.col("failed"), "match failed"), F.when(F.col("low_quality"), "low quality"), F.when(F.col("retries") > 0, "retried"), F.when(F.col("rejection") > 0.5, "many rejections")), lambda r: r.isNotNull())
    scored = frames.withColumns({"score": score, "reasons": F.array_join(reasons, "; "), "diagnosis": F.coalesce(F.try_element_at(reasons, F.lit(1)), F.lit("needs review"))})
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "frame"))).filter(F.col("rank") <= n)


def best_and_worst(items: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Mean of the value, and which item has the largest and the smallest one (the first by name on a tie)."""
    low = F.min(F.struct(F.col(value).alias("v"), F.col(name).alias("n")))
    high = F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
    return items.groupBy(*by).agg(F.count("*").alias("items"), F.avg(value).alias("mean"), high["n"].alias("best"), low["n"].alias("worst"))
