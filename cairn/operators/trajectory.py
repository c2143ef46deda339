"""Trajectories: columns of `by` (which trajectory), t (seconds) and x, y, z; many trajectories in one table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.geometry import AXES, norm
from cairn.plans.ranking import beside, brackets, ranked

EXACT = 1e-9


def _brackets(reference: DataFrame, estimated: DataFrame, by: list[str]) -> DataFrame:
    """Each reference pose with the estimated poses before (p) and at or after it (q), by ranges of time."""
    return brackets(reference.select(*by, "t", *AXES), estimated, by, "t", ["t", *AXES])


def interpolated_join(reference: DataFrame, estimated: DataFrame, most: float, by: list[str]) -> DataFrame:
    """Matched poses: by, t, reference r + axis, estimate e + axis, dt.

    An estimate at the reference's time is taken as it is (dt 0). Between two estimates that are both within `most` the
    pose is interpolated and dt is the nearer one's distance. Before the first and after the last estimate that one is
    taken if within `most`. Anything else goes unmatched, also where only one of two neighbours is near enough.
    """
    b = _brackets(reference, estimated, by)
    t = F.col("ref.t")
    left, right = t - F.col("p.t"), F.col("q.t") - t
    at = F.col("q").isNotNull() & (F.abs(right) <= EXACT)
    inner = F.col("p").isNotNull() & F.col("q").isNotNull()
    share = left / F.when(inner, F.col("q.t") - F.col("p.t"))
    dt = F.when(at, 0.0).when(inner, F.when((left <= most) & (right <= most), F.least(left, right))).when(F.col("p").isNull(), F.when(right <= most, right)).otherwise(F.when(left <= most, left))
    value = lambda c: F.when(at, F.col(f"q.{c}")).when(inner, F.col(f"p.{c}") + share * (F.col(f"q.{c}") - F.col(f"p.{c}"))).otherwise(F.coalesce(F.col(f"p.{c}"), F.col(f"q.{c}")))
    out = b.select(*by, t.alias("t"), *[F.col(f"ref.{c}").alias(f"r{c}") for c in AXES], *[value(c).alias(f"e{c}") for c in AXES], dt.alias("dt"))
    return out.filter(F.col("dt").isNotNull())


def nearest_time_join(estimated: DataFrame, reference: DataFrame, most: float, by: list[str]) -> DataFrame:
    """Each estimated pose with the reference pose nearest in time (the earlier one on a tie) if within `most`."""
    b = _brackets(estimated.select(*by, "t", *AXES), reference, by)
    left, right = F.col("ref.t") - F.col("p.t"), F.col("q.t") - F.col("ref.t")
    take = F.when(F.col("q").isNull() | (left <= right), F.col("p")).otherwise(F.col("q"))
    out = b.select(*by, F.col("ref.t").alias("t"), *[F.col(f"ref.{c}").alias(f"e{c}") for c in AXES], take.alias("n"))
    out = out.withColumn("dt", F.abs(F.col("t") - F.col("n.t"))).filter(F.col("dt") <= most)
    return out.select(*by, "t", *[f"e{c}" for c in AXES], F.col("n.t").alias("rt"), *[F.col(f"n.{c}").alias(f"r{c}") for c in AXES], "dt")


def nearest_pose(frames: DataFrame, poses: DataFrame, by: list[str]) -> DataFrame:
    """frames (by, frame, t) with the place (from 0, in time) of the pose nearest in time, the earlier one on a tie, and how far it
    is; at any distance. Frames without a time, and those of a trajectory without poses, are left out."""
    placed = ranked(poses.filter("t IS NOT NULL").select(*by, "t"), "t", [], by, "pose").groupBy(*by, "t").agg(F.min("pose").alias("pose"))
    b = brackets(frames.filter("t IS NOT NULL").select(*by, "frame", "t"), placed, by, "t", ["t", "pose"])
    left, right = F.col("ref.t") - F.col("p.t"), F.col("q.t") - F.col("ref.t")
    take = F.when(F.col("q").isNull() | (left <= right), F.col("p")).otherwise(F.col("q"))
    out = b.select(*by, F.col("ref.frame").alias("frame"), F.col("ref.t").alias("t"), take.alias("n")).filter("n IS NOT NULL")
    return out.select(*by, "frame", "t", F.col("n.pose").alias("pose"), F.abs(F.col("t") - F.col("n.t")).alias("dt"))


def align_origin(matched: DataFrame, by: list[str]) -> DataFrame:
    """Estimates shifted so that the first matched pose of each trajectory agrees with its reference."""
    first = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return matched.withColumns({f"e{c}": F.col(f"e{c}") + F.first(F.col(f"r{c}") - F.col(f"e{c}")).over(first) for c in AXES})


def errors(matched: DataFrame, by: list[str]) -> DataFrame:
    """Of each matched pose: error, lateral and longitudinal part, step error to the next matched pose, step length."""
    out = beside(matched, by, ["t"], ["t", *[f"{s}{c}" for s in "re" for c in AXES]])
    out = out.withColumns({f"n{c}": F.col(f"after.r{c}") for c in AXES} | {f"l{c}": F.col(f"before.r{c}") for c in AXES} | {f"ne{c}": F.col(f"after.e{c}") for c in AXES} | {"nt": F.col("after.t")})
    out = out.withColumns({f"d{c}": F.col(f"e{c}") - F.col(f"r{c}") for c in AXES} | {f"g{c}": F.coalesce(f"n{c}", f"r{c}") - F.coalesce(f"l{c}", f"r{c}") for c in AXES})
    tangent = norm(*[F.col(f"g{c}") for c in AXES])
    unit = F.when(tangent < 1e-12, 1.0).otherwise(tangent)
    along = sum((F.col(f"d{c}") * F.col(f"g{c}") for c in AXES[1:]), F.col("dx") * F.col("gx")) / unit
    out = out.withColumns({"error": norm(*[F.col(f"d{c}") for c in AXES]), "longitudinal": along})
    out = out.withColumns(
        {
            "lateral": F.sqrt(F.greatest(F.col("error") ** 2 - F.col("longitudinal") ** 2, F.lit(0.0))),
            "step_error": norm(*[(F.col(f"ne{c}") - F.col(f"e{c}")) - (F.col(f"n{c}") - F.col(f"r{c}")) for c in AXES]),
            "step_time": (F.col("t") + F.col("nt")) / 2,
            "step": norm(*[F.col(f"n{c}") - F.col(f"r{c}") for c in AXES]),
        }
    )
    return out.select(*by, "t", "dt", *[f"{s}{c}" for s in "re" for c in AXES], "error", "lateral", "longitudinal", "step_error", "step_time", "step")


def _rms(c: str) -> Column:
    return F.sqrt(F.avg(F.col(c) ** 2))


def evaluate(reference: DataFrame, estimated: DataFrame, most: float, by: list[str], origin: bool = False) -> DataFrame:
    """Scores of each trajectory with two matched poses at least: ATE and RPE, lateral and longitudinal RMSE, end-point
    drift and its share of the reference's length, coverage, mean time distance."""
    matched = interpolated_join(reference, estimated, most, by)
    e = errors(align_origin(matched, by) if origin else matched, by)
    offset = lambda pick: [pick(F.col(f"e{c}") - F.col(f"r{c}"), "t").alias(f"{pick.__name__}_{c}") for c in AXES]
    out = e.groupBy(*by).agg(F.count("*").alias("matched"), _rms("error").alias("ate_rmse"), F.avg("error").alias("ate_mean"), F.max("error").alias("ate_max"), _rms("step_error").alias("rpe_rmse"), _rms("lateral").alias("lateral_rmse"), _rms("longitudinal").alias("longitudinal_rmse"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.avg("dt").alias("mean_dt"), *offset(F.min_by), *offset(F.max_by))
    drift = norm(*[F.col(f"max_by_{c}") - F.col(f"min_by_{c}") for c in AXES])
    out = out.filter("matched >= 2").join(reference.groupBy(*by).agg(F.count("*").alias("poses")), by)
    return out.select(*by, "matched", "ate_rmse", "ate_mean", "ate_max", "rpe_rmse", "lateral_rmse", "longitudinal_rmse", "length", drift.alias("drift"), F.try_divide(drift, F.col("length")).alias("drift_ratio"), (F.col("matched") / F.col("poses")).alias("coverage"), "mean_dt")


def worst(e: DataFrame, by: list[str], value: str = "error", n: int = 5) -> DataFrame:
    """The n poses of each trajectory with the largest value, the earlier first on a tie."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(value), "t")
    return e.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(*by, "rank", "t", value)


def path_length(poses: DataFrame, by: list[str]) -> DataFrame:
    step = norm(*[F.col(c) - F.col(f"before.{c}") for c in AXES])
    return beside(poses.select(*by, "t", *AXES), by, ["t"], list(AXES)).select(*by, "t", step.alias("step")).groupBy(*by).agg(F.count("*").alias("poses"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def turn_scores(poses: DataFrame, by: list[str]) -> DataFrame:
    """Of each pose the angle between its steps times the shorter one; 0 at the ends and where a step is 0."""
    out = beside(poses, by, ["t"], list(AXES))
    out = out.withColumns({f"p{c}": F.col(c) - F.col(f"before.{c}") for c in AXES} | {f"n{c}": F.col(f"after.{c}") - F.col(c) for c in AXES})
    a, b = (norm(*[F.col(f"{s}{c}") for c in AXES]) for s in "pn")
    dot = sum((F.col(f"p{c}") * F.col(f"n{c}") for c in AXES[1:]), F.col("px") * F.col("nx"))
    out = out.withColumns({"a": a, "b": b, "dot": dot})
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dot") / (F.col("a") * F.col("b")))))
    return out.select(*by, "t", F.when((F.col("a") > 0) & (F.col("b") > 0), angle * F.least("a", "b")).otherwise(0.0).alias("score"))


def stride(poses: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """At most `budget` poses of each trajectory, evenly spaced in order, the ends among them (half-even rounding)."""
    order, whole = Window.partitionBy(*by).orderBy("t"), Window.partitionBy(*by)
    out = poses.withColumns({"__i": F.row_number().over(order) - 1, "__n": F.count("*").over(whole)})
    step = (F.col("__n") - 1) / (budget - 1)
    k = F.bround(F.col("__i") / step)
    hit = F.exists(F.array(k - 1, k, k + 1), lambda j: F.bround(j * step) == F.col("__i"))
    return out.filter((F.col("__n") <= budget) | hit).drop("__i", "__n")


def reconstruct(times: DataFrame, poses: DataFrame, by: list[str]) -> DataFrame:
    """Poses at given times, interpolated between neighbours and held at the ends."""
    b = _brackets(times.select(*by, "t", *[F.lit(0.0).alias(c) for c in AXES]), poses, by)
    t = F.col("ref.t")
    share = (t - F.col("p.t")) / (F.col("q.t") - F.col("p.t"))
    value = lambda c: F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), F.col(f"p.{c}") + share * (F.col(f"q.{c}") - F.col(f"p.{c}"))).otherwise(F.coalesce(F.col(f"p.{c}"), F.col(f"q.{c}")))
    return b.select(*by, t.alias("t"), *[value(c).alias(c) for c in AXES])


def nees(states: DataFrame, by: list[str], quantile: float = 7.814727903251179) -> DataFrame:
    """Of states with error x, y, z and covariance xx .. zz: mean of e' S^-1 e, that over 3, and the share under the quantile."""
    from cairn.functions.geometry import determinant

    m = {p: F.col(p) for p in ("xx", "xy", "xz", "yy", "yz", "zz")}
    cof = {
        "xx": m["yy"] * m["zz"] - m["yz"] ** 2, "xy": m["xz"] * m["yz"] - m["xy"] * m["zz"], "xz": m["xy"] * m["yz"] - m["xz"] * m["yy"],
        "yy": m["xx"] * m["zz"] - m["xz"] ** 2, "yz": m["xy"] * m["xz"] - m["xx"] * m["yz"], "zz": m["xx"] * m["yy"] - m["xy"] ** 2,
    }
    x, y, z = (F.col(c) for c in AXES)
    square = (cof["xx"] * x * x + cof["yy"] * y * y + cof["zz"] * z * z + 2 * (cof["xy"] * x * y + cof["xz"] * x * z + cof["yz"] * y * z)) / determinant(m)
    return states.withColumn("nees", square).groupBy(*by).agg(F.count("*").alias("n"), F.avg("nees").alias("mean_nees"), (F.avg("nees") / 3).alias("normalized"), F.avg((F.col("nees") <= quantile).cast("double")).alias("coverage"))


def _filled(poses: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """poses with `keep`: those marked, and between them others, evenly, until there are `budget`; gaps share by their length,
    by largest remainders (the later gap first on a tie). __i is the place and __n the number of poses."""
    own = Window.partitionBy(*by).orderBy("__i")
    gaps = poses.filter("keep").select(*by, "__i", F.lead("__i").over(own).alias("__to"), F.count("*").over(Window.partitionBy(*by)).alias("__kept"), "__n").filter("__to IS NOT NULL")
    gaps = gaps.withColumn("__free", F.col("__to") - F.col("__i") - 1).withColumns({"__all": F.sum("__free").over(Window.partitionBy(*by)), "__extra": F.least(F.lit(budget), F.col("__n")) - F.col("__kept")})
    exact = F.when((F.col("__all") > 0) & (F.col("__extra") > 0), F.col("__extra") * (F.col("__free") / F.col("__all"))).otherwise(0.0)
    gaps = gaps.withColumn("__exact", exact).withColumn("__quota", F.floor("__exact"))
    left = F.greatest(F.col("__extra"), F.lit(0)) - F.sum("__quota").over(Window.partitionBy(*by))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("__exact") - F.col("__quota")), F.desc("__i")))
    more = ((turn <= left) & (F.col("__quota") < F.col("__free"))).cast("long")
    gaps = gaps.withColumn("__left", left).withColumn("__quota", F.col("__quota") + more).filter("__quota > 0")
    step = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__quota")))
    added = gaps.select(*by, "__i", "__to", "__quota", step.alias("__j")).select(*by, F.floor(F.col("__i") + F.col("__j") * ((F.col("__to") - F.col("__i")) / (F.col("__quota") + 1))).alias("__i"), F.lit(True).alias("__add"))
    return poses.join(added, [*by, "__i"], "left").withColumn("keep", F.col("keep") | F.coalesce("__add", F.lit(False))).drop("__add")


def _placed(poses: DataFrame, by: list[str]) -> DataFrame:
    return poses.withColumns({"__i": F.row_number().over(Window.partitionBy(*by).orderBy("t")).cast("long") - 1, "__n": F.count("*").over(Window.partitionBy(*by))})


def turn_aware(poses: DataFrame, budget: int, by: list[str], share: float = 0.45, anchor: str | None = None) -> DataFrame:
    """At most `budget` poses of each trajectory: its ends and anchors (a boolean column), the sharpest turns for a share of the
    rest, and others evenly between these. Trajectories of no more poses stay whole."""
    placed = _placed(poses, by).join(turn_scores(poses, by), [*by, "t"])
    fixed = (F.col("__i") == 0) | (F.col("__i") == F.col("__n") - 1) | (F.coalesce(F.col(anchor), F.lit(False)) if anchor else F.lit(False))
    placed = placed.withColumn("__fixed", fixed)
    number = F.sum(F.col("__fixed").cast("int")).over(Window.partitionBy(*by))
    sharp = F.row_number().over(Window.partitionBy(*by).orderBy("__fixed", F.desc("score"), F.desc("__i")))
    turns = F.ceil(F.greatest(F.lit(budget) - number, F.lit(0)) * F.lit(share))
    marked = placed.withColumns({"__turn": sharp, "__turns": turns}).withColumn("keep", F.col("__fixed") | ((F.col("__turn") <= F.col("__turns")) & (F.col("score") > 0)))
    kept = _filled(marked.withColumn("keep", F.col("keep") | (F.col("__n") <= budget)), budget, by)
    return kept.filter("keep").select(*poses.columns)


def by_distance(poses: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """At most `budget` poses of each trajectory, one after each `budget`-th part of its length, counted anew from each pose
    that is kept; the ends stay. What carries the distance on is a search in the running lengths for each pose that is kept, of a
    trajectory's step lengths alone."""
    steps = beside(_placed(poses, by), by, ["t"], list(AXES))
    steps = steps.withColumn("__step", F.coalesce(norm(*[F.col(c) - F.col(f"before.{c}") for c in AXES]), F.lit(0.0))).drop("before", "after")
    lengths = steps.groupBy(*by).agg((F.sum("__step") / max(budget - 1, 1)).alias("__part"))
    same = F.lit(True)
    for c in by:
        same = same & steps[c].eqNullSafe(lengths[c])
    steps = steps.join(lengths, same).select(steps["*"], "__part")

    def pass_(rows):
        rows = rows.sort_values("__i")
        step, part, n = rows["__step"].to_numpy(), rows["__part"].iloc[0], len(rows)
        keep = np.zeros(n, bool)
        keep[[0, n - 1]] = True
        if n <= budget or part <= 0:
            keep[:] = True
        along, i = np.cumsum(step), 0
        while not keep.all() and i < n:
            i = max(i + 1, int(np.searchsorted(along, along[i] + part * (1 - 1e-12))))  # sums of another order round otherwise
            if i < n:
                keep[i] = True
        return rows[[*by, "__i"]].assign(keep=keep)

    kept = steps.select(*by, "__i", "__step", "__part").groupBy(*by).applyInPandas(pass_, steps.select(*by, "__i", F.lit(True).alias("keep")).schema).filter("keep").select(*by, "__i")
    own = Window.partitionBy(*by).orderBy("__i")
    chosen = steps.join(kept, [*by, "__i"]).withColumns({"__i": F.row_number().over(own).cast("long") - 1, "__n": F.count("*").over(Window.partitionBy(*by))})
    # one too many can be left: then those evenly spaced among them
    ends = (F.col("__i") == 0) | (F.col("__i") == F.col("__n") - 1)
    return _filled(chosen.withColumn("keep", ends | (F.col("__n") <= budget)), budget, by).filter("keep").select(*poses.columns)


def index_error(reference: DataFrame, estimated: DataFrame, by: list[str], at: str = "idx") -> DataFrame:
    """(by, n, rmse): distance of poses of the same index, over those that both have."""
    e = estimated.select(*by, at, *[F.col(c).alias(f"e{c}") for c in AXES])
    d = norm(*[F.col(f"e{c}") - F.col(c) for c in AXES])
    return reference.select(*by, at, *AXES).join(e, [*by, at]).groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"))


def from_rows(lines: DataFrame, rate: float, by: list[str]) -> DataFrame:
    """Poses (by, t, x, y, z, qx .. qw) from lines (by, idx, v: twelve numbers, a 3 x 4 matrix row by row), idx / rate seconds.

    The quaternion has a positive first non-zero part, w first; lines of other lengths are left out.
    """
    m = lambda i, j: F.get("v", F.lit(4 * i + j))
    trace = m(0, 0) + m(1, 1) + m(2, 2)
    zero = F.lit(0.0)
    size = {"w": 1 + trace, "x": 1 + m(0, 0) - m(1, 1) - m(2, 2), "y": 1 - m(0, 0) + m(1, 1) - m(2, 2), "z": 1 - m(0, 0) - m(1, 1) + m(2, 2)}
    q = {k: F.sqrt(F.greatest(v, zero)) / 2 for k, v in size.items()}
    pairs = {"xy": m(0, 1) + m(1, 0), "xz": m(0, 2) + m(2, 0), "yz": m(1, 2) + m(2, 1), "wx": m(2, 1) - m(1, 2), "wy": m(0, 2) - m(2, 0), "wz": m(1, 0) - m(0, 1)}
    other = lambda a, b: pairs.get(a + b, pairs.get(b + a)) / (4 * q[a])
    most = F.greatest(*size.values())
    # from the largest part, which loses no digits
    parts = {k: F.coalesce(*[F.when(size[a] == most, q[a] if a == k else other(a, k)) for a in "wxyz"]) for k in "wxyz"}
    sign = F.coalesce(*[F.when(F.abs(parts[k]) > 1e-12, F.signum(parts[k])) for k in "wxyz"])
    return lines.filter(F.size("v") == 12).select(*by, (F.col("idx") / rate).alias("t"), *[m(i, 3).alias(c) for i, c in enumerate(AXES)], *[(parts[k] * sign).alias(f"q{k}") for k in "xyzw"])
