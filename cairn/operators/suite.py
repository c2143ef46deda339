"""Suites of checks: effective gates, what each check comes to, how runs compare with others, and with what was before.

Metrics are long rows (check_id, metric, value); gates are long rows (check_id, key, value), a key being min_ or max_ and a
metric's name. Nothing here is about one check alone: a suite of any number of checks is a few joins and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators.gates import guard_decision, status, wide_gate, window_decision
from cairn.plans.ranking import quantiles

#: A difference smaller than this counts as none.
STILL = 1e-6


def effective_gates(checks: DataFrame, defaults: DataFrame, own: DataFrame, allowed: DataFrame) -> DataFrame:
    """(check_id, key, metric, side, threshold): a check's own gate values over the suite's defaults.

    checks: check_id, kind; defaults: key, value; own: check_id, key, value (strings); allowed: kind, key. A null value takes a
    threshold away, a key that the kind does not have is left out, and values that are no numbers are no thresholds. A key
    that no kind has raises an error.
    """
    known = allowed.select("key").distinct()
    keys = defaults.select("key").union(own.select("key")).distinct()
    if unknown := [r["key"] for r in keys.join(known, "key", "left_anti").orderBy("key").limit(10).collect()]:
        raise ValueError(f"unknown gate keys: {unknown}")
    may = checks.join(allowed, "kind").select("check_id", "key")
    both = may.join(defaults.withColumnRenamed("value", "__d"), "key", "left").join(own.select("check_id", "key", F.struct("value").alias("__o")), ["check_id", "key"], "left")
    value = F.when(F.col("__o").isNotNull(), F.col("__o.value")).otherwise(F.col("__d")).try_cast("double")
    out = both.select("check_id", "key", F.substring("key", 5, 200).alias("metric"), F.substring("key", 1, 3).alias("side"), value.alias("threshold"))
    return out.filter(F.col("threshold").isNotNull() & F.col("side").isin("min", "max"))


def run_suite(checks: DataFrame, metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """(check_id, kind, severity, gated, failed, passed, status, reasons) of each check (check_id, kind, severity, skipped).

    A gated metric that is null, NaN or absent fails as unavailable; a check without thresholds has no verdict (info); a
    skipped one is not looked at. Reasons are sorted texts.
    """
    met = gates.join(metrics.select("check_id", "metric", "value"), ["check_id", "metric"], "left")
    value, limit = F.col("value"), F.col("threshold")
    gone = value.isNull() | F.isnan(value)
    bad = gone | F.when(F.col("side") == "min", value < limit).otherwise(value > limit)
    text = F.when(gone, F.concat("metric", F.lit(" unavailable"))).otherwise(F.concat("metric", F.when(F.col("side") == "min", " under ").otherwise(" over "), "key"))
    verdict = met.groupBy("check_id").agg(F.count("*").alias("gated"), F.count_if(bad).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(bad, text))), "; ").alias("reasons"))
    out = checks.join(verdict, "check_id", "left").na.fill(0, ["gated", "failed"])
    seen = (F.col("gated") > 0) & ~F.col("skipped")
    out = out.withColumn("passed", F.when(seen, F.col("failed") == 0)).withColumn("reasons", F.when(seen, F.col("reasons")).otherwise(""))
    return out.withColumn("status", status(F.col("passed"), F.col("severity"), F.col("skipped"))).select("check_id", "kind", "severity", "gated", "failed", "passed", "status", "reasons")


def deltas(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """current (keys, value) with `previous` of the same keys and `move`: up, down, still, or null without a previous value."""
    both = current.join(baseline.select(*keys, F.col("value").alias("previous")), keys, "left")
    diff = F.col("value") - F.col("previous")
    return both.withColumn("move", F.when(diff.isNull(), None).when(F.abs(diff) < STILL, "still").when(diff > 0, "up").otherwise("down"))


def leaderboard(runs: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """runs with their place within by, in the given order."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def incomparable(runs: DataFrame, by: list[str], signature: list[str], name: str) -> DataFrame:
    """(by, versions, runs): groups whose runs do not share one signature (nulls are values), with how many there are of each."""
    told = F.to_json(F.struct(*signature), {"ignoreNullFields": "false"})
    return runs.groupBy(*by).agg(F.countDistinct(told).alias("versions"), F.countDistinct(name).alias("runs")).filter("versions > 1")


def history_series(bundles: DataFrame, kind: str, at: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """bundles from old to new (of each `by`) with the change of each value since the one before; kinds must be one."""
    if len(kinds := [r[0] for r in bundles.select(kind).distinct().limit(2).collect()]) > 1:
        raise ValueError(f"a history of one kind, not of {sorted(map(str, kinds))}")
    order = Window.partitionBy(*(by or [kind])).orderBy(at)
    return bundles.withColumns({"step": F.row_number().over(order)} | {f"d_{v}": F.col(v) - F.lag(v).over(order) for v in values})


def closure_report(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys with before_, after_ and delta_ (after less before) of each metric; what one side lacks is null."""
    a, b = (df.select(*keys, *[F.col(m).alias(f"{s}_{m}") for m in metrics]) for df, s in ((before, "before"), (after, "after")))
    return a.join(b, keys, "full").withColumns({f"delta_{m}": F.col(f"after_{m}") - F.col(f"before_{m}") for m in metrics})


def closure_gate(report: DataFrame, min_auc_gain: float | None = None, max_after_chamfer: float | None = None, min_ate_gain: float | None = None, max_after_ate: float | None = None) -> DataFrame:
    """report with passed and reasons: a gain of ATE is what it fell by; a missing metric with a limit fails."""
    given = {"min_auc_gain": min_auc_gain, "max_after_chamfer": max_after_chamfer, "min_ate_gain": min_ate_gain, "max_after_ate": max_after_ate}
    columns = {"auc_gain": "delta_auc", "ate_gain": "delta_ate", "after_chamfer": "after_chamfer", "after_ate": "after_ate"}
    made = report
    for key, limit in given.items():
        name = key[4:]
        if limit is not None:
            source = F.col(columns[name]) if columns[name] in report.columns else F.lit(None).cast("double")
            made = made.withColumn(name, -source if name == "ate_gain" else source)
    gated = wide_gate(made, {k: v for k, v in given.items() if v is not None})
    return gated.select(*report.columns, "passed", "reasons")


def pareto_decision(stats: DataFrame, series: str, at: str, least: int = 1) -> DataFrame:
    """stats (mean_margin, worst_margin, pass_ratio, failed, passed) with decision and confidence.

    A snapshot that failed is rejected. One that an earlier one of its series beats in all four respects is kept, as is the
    first; it is promoted when it beats `least` earlier ones. History is a self join within the series.
    """
    values = ("mean_margin", "worst_margin", "pass_ratio", "low_failed")
    own = stats.withColumn("low_failed", -F.col("failed"))
    old = own.select(F.col(series).alias("__s"), F.col(at).alias("__at"), *[F.col(v).alias(f"o_{v}") for v in values])
    pairs = own.select(series, at, *values).join(old, (F.col(series) == F.col("__s")) & (F.col("__at") < F.col(at)))

    def beats(a: str, b: str) -> Column:
        as_good, better = F.lit(True), F.lit(False)
        for v in values:
            as_good, better = as_good & (F.col(a + v) >= F.col(b + v)), better | (F.col(a + v) > F.col(b + v))
        return as_good & better

    counts = pairs.groupBy(series, at).agg(F.count("*").alias("history"), F.count_if(beats("o_", "")).alias("beaten_by"), F.count_if(beats("", "o_")).alias("beats"))
    out = stats.join(counts, [series, at], "left").na.fill(0, ["history", "beaten_by", "beats"])
    decision = F.when(~F.col("passed"), "reject").when(F.col("history") == 0, "keep").when(F.col("beaten_by") > 0, "keep").when(F.col("beats") >= least, "promote").otherwise("keep")
    confidence = F.when(~F.col("passed"), 0.98).when(F.col("history") == 0, 0.71).when(F.col("beaten_by") > 0, 0.79).when(F.col("beats") >= least, 0.8).otherwise(0.75)
    return out.withColumns({"decision": decision, "confidence": confidence})


def decide(stats: DataFrame, series: str, at: str, strategy: str = "window") -> DataFrame:
    """stats with the decision of the named strategy: window, guard or pareto."""
    found = {"window": window_decision, "guard": guard_decision, "pareto": pareto_decision}
    if strategy not in found:
        raise ValueError(f"no strategy {strategy}; there are {sorted(found)}")
    return found[strategy](stats, series, at)


def composite_rank(rows: DataFrame, name: str, weights: dict[str, float], falling: tuple[str, ...] = ()) -> DataFrame:
    """Strategies (name) by the weighted sum of their places by the mean of each metric: place 1 is the smallest mean, of those
    in `falling` the largest. Means count to nine digits, as sums come in any order; equal ones take places by name and no
    place is shared."""
    out = rows.groupBy(name).agg(*[F.round(F.avg(m), 9).alias(m) for m in weights])
    total = F.lit(0.0)
    for m, w in weights.items():
        # as many rows as strategies
        out = out.withColumn(f"{m}_rank", F.row_number().over(Window.orderBy(F.desc(m) if m in falling else F.asc(m), name)))
        total = total + F.col(f"{m}_rank") * w
    return out.withColumn("composite", F.round(total, 3))


def artifact_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (path) with match and how: the right path that is equal, else the only one equal but for the extension, else the
    only one of the same stem; null where there is none or where several would do."""
    bare = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    stem = lambda c: F.regexp_extract(bare(c), "[^/]*$", 0)
    out = left.select("path").distinct().withColumns({"__bare": bare("path"), "__stem": stem("path")})
    other = right.select(F.col("path").alias("match")).distinct()
    out = out.join(other.select(F.col("match").alias("__same")), F.col("path") == F.col("__same"), "left")
    for key, make, got in (("__bare", bare, "__by_bare"), ("__stem", stem, "__by_stem")):
        unique = other.groupBy(make("match").alias(key)).agg(F.count("*").alias("__n"), F.min("match").alias(got)).filter("__n = 1").drop("__n")
        # a left path whose key another left path shares is told apart by neither
        shared = Window.partitionBy(key)
        out = out.withColumn("__k", F.count("*").over(shared)).join(unique, key, "left").withColumn(got, F.when(F.col("__k") == 1, F.col(got))).drop("__k")
    how = F.when(F.col("__same").isNotNull(), "path").when(F.col("__by_bare").isNotNull(), "bare").when(F.col("__by_stem").isNotNull(), "stem")
    return out.select("path", F.coalesce("__same", "__by_bare", "__by_stem").alias("match"), how.alias("how"))


def frame_join(reference: DataFrame, estimated: DataFrame) -> DataFrame:
    """(frame, n_ref, n_est): boxes of each frame that either side has; a side without it has none."""
    r, e = (df.groupBy("frame").agg(F.count("*").alias(n)) for df, n in ((reference, "n_ref"), (estimated, "n_est")))
    return r.join(e, "frame", "full").na.fill(0, ["n_ref", "n_est"])


def pair_images(rendered: DataFrame, reference: DataFrame) -> DataFrame:
    """(pairs, missing, mismatched): of rendered images (name, width, height) those with a reference of the same name and size,
    of none, of another size."""
    r = reference.select("name", F.col("width").alias("rw"), F.col("height").alias("rh"))
    same = (F.col("width") == F.col("rw")) & (F.col("height") == F.col("rh"))
    return rendered.join(r, "name", "left").agg(F.count_if(same).alias("pairs"), F.count_if(F.col("rw").isNull()).alias("missing"), F.count_if(F.col("rw").isNotNull() & ~same).alias("mismatched"))


def with_scan(frames: DataFrame, manifest: DataFrame, poses: DataFrame) -> DataFrame:
    """frames (scan_id) with their file by scan_id and their pose by the manifest's timestamp text, each null if unknown."""
    m = manifest.select("scan_id", "timestamp", "file").dropDuplicates(["scan_id"])
    p = poses.select("timestamp", *[F.col(c).alias(f"pose_{c}") for c in "xyz"]).dropDuplicates(["timestamp"])
    return frames.join(m, "scan_id", "left").join(p, "timestamp", "left")


def evaluate_runs(maps: DataFrame, tracks: DataFrame, key: str, map_gate: dict[str, float], track_gate: dict[str, float]) -> DataFrame:
    """Runs by both their scores: maps (auc, chamfer) and tracks (ate, rpe, drift, coverage ...), each gated, and overall."""
    m = wide_gate(maps, map_gate).withColumnsRenamed({"passed": "map_passed", "reasons": "map_reasons"})
    t = wide_gate(tracks, track_gate).withColumnsRenamed({"passed": "track_passed", "reasons": "track_reasons"})
    both = m.join(t, key, "full")
    known = F.filter(F.array("map_passed", "track_passed"), lambda p: p.isNotNull())
    return both.withColumn("overall", F.when(F.size(known) > 0, F.forall(known, lambda p: p)))


def error_summary(errors: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, rmse, mean, median, p95, least, most and population deviation of each group's errors."""
    v = F.col(value)
    out = errors.groupBy(*by).agg(F.count(v).alias("n"), F.sqrt(F.avg(v * v)).alias("rmse"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("std"))
    q = quantiles(errors, value, [0.5, 0.95], by).select(*by, F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"))
    return out.join(q, by, "left") if by else out.crossJoin(q)  # one row each


def perturbed(metrics: DataFrame, keys: list[str], spread: float, copies: int, seed: int = 5) -> DataFrame:
    """copies of each metric row, its value times 1 + spread * u, u from -1 to 1 by a hash of seed, copy and keys: the same on
    every run and engine."""
    out = metrics.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("copy").cast("string"), *[F.col(k).cast("string") for k in keys])
    unit = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2**31 - 1
    return out.withColumn("value", F.col("value") * (1 + spread * unit))


def stable(decisions: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """keys with the most frequent decision among the copies (the first by name on a tie) and its share."""
    counts = decisions.groupBy(*keys, decision).agg(F.count("*").alias("__n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("m"), F.col(decision).alias("d"))).alias("b"), F.sum("__n").alias("__all"))
    return best.select(*keys, F.col("b.d").alias(decision), (-F.col("b.m") / F.col("__all")).alias("share"))

