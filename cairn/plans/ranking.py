"""Ranks over whole tables without one task for all rows: ranges of about equal size, counted, then ranked apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.plans.storage import written


def ranges(df: DataFrame, *order: str) -> DataFrame:
    """df as a table with the number __r of each row's range by all of `order` together: many equal keys are cut too."""
    return written(df.repartitionByRange(*order).withColumn("__r", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, order: str, ties: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with the place (from 0) of each row by `order` (a number), then `ties`, within `by` groups of any size."""
    by = by or []
    ranged = ranges(df, order, *ties)
    before = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, "__r").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*by, "__r").orderBy(order, *ties)
    return ranged.withColumn("__w", F.row_number().over(within) - 1).join(sizes, [*by, "__r"]).withColumn(name, F.col("__before") + F.col("__w")).select(*df.columns, name)


def quantiles(df: DataFrame, value: str, at: list[float], by: list[str] | None = None) -> DataFrame:
    """(by ..., p): exact quantiles of the values that are not null, interpolated as F.percentile does; without `by` one row.

    Distinct values are counted, and only the counts of their ranges and the wanted places go on: no task holds all values.
    """
    by = by or []
    counts = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    ranged = ranges(counts, "__v")
    group = Window.partitionBy(*by)
    sizes = ranged.groupBy(*by, "__r").agg(F.sum("__n").alias("__size"))
    sizes = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__r").alias("__s"), F.sum("__size").over(group).alias("__total"), (F.sum("__size").over(group.orderBy("__r")) - F.col("__size")).alias("__before"))
    same = F.col("__r") == F.col("__s")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    within = F.sum("__n").over(Window.partitionBy(*by, "__r").orderBy("__v"))
    placed = ranged.withColumn("__end", within).join(sizes, same).withColumn("__end", F.col("__end") + F.col("__before"))

    def held(place):
        return F.max(F.when((F.col("__end") - F.col("__n") <= place) & (place < F.col("__end")), F.col("__v")))

    parts = []
    for q in at:
        place = F.lit(float(q)) * (F.col("__total") - 1)
        low, high, part = held(F.floor(place)), held(F.ceil(place)), F.max(place - F.floor(place))
        parts.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part))
    return placed.groupBy(*by).agg(F.array(*parts).alias("p"))


def _same(by: list[str]):
    out = F.col("__r") == F.col("__r2")
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return out


def _by_ranges(df: DataFrame, by: list[str], order: list[str], ends) -> tuple[DataFrame, DataFrame, Window]:
    """df by ranges of (by, order); a row for each group's part of a range with what `ends` (columns by name) says of it, and the
    window over these: as many rows as a group has ranges."""
    ranged = ranges(df, *by, *order)
    parts = ranged.groupBy(*by, "__r").agg(*[v.alias(k) for k, v in ends.items()])
    parts = parts.select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("__r").alias("__r2"), *ends)
    return ranged, parts, Window.partitionBy(*[f"__of_{c}" for c in by]).orderBy("__r2")


def beside(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """df with `before` and `after`: of the row before and the row after within its group, a struct of columns; null at the ends.

    Ranges of the order are worked apart and their ends handed on, so that no task holds a group. Rows equal in all of `order`
    follow in any order.
    """
    own = F.struct(*columns)
    key = F.struct(*order)
    ranged, parts, over = _by_ranges(df, by, order, {"__head": F.min_by(own, key), "__tail": F.max_by(own, key)})
    parts = parts.withColumns({"__before": F.lag("__tail").over(over), "__after": F.lead("__head").over(over)}).drop("__head", "__tail")
    within = Window.partitionBy(*by, "__r").orderBy(*order)
    out = ranged.withColumns({"__b": F.lag(own).over(within), "__a": F.lead(own).over(within)}).join(parts, _same(by))
    return out.select(*df.columns, F.coalesce("__b", "__before").alias("before"), F.coalesce("__a", "__after").alias("after"))


def brackets(left: DataFrame, right: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """(by, left's columns as struct `ref`, p, q): each left row with the last right row before it (p) and the first at or after it
    (q), structs of `columns`, of its group; null where there is none. An as-of join to both sides.

    One sort of both sides by ranges of (by, order): a range's last right row is carried to the ranges after it and its first one
    to those before it, so that no task holds a group, however long.
    """
    struct = F.struct(*columns)
    kind = right.select(struct.alias("e")).schema[0].dataType
    rest = [c for c in left.columns if c not in by]
    both = left.select(*by, F.col(order).alias("__t"), F.struct(*rest).alias("ref"), F.lit(None).cast(kind).alias("est"), F.lit(0).alias("__side"))
    both = both.union(right.select(*by, F.col(order).alias("__t"), F.lit(None).cast(both.schema["ref"].dataType).alias("ref"), struct.alias("est"), F.lit(1).alias("__side")))
    at = F.when(F.col("est").isNotNull(), F.col("__t"))
    # at equal times the left row comes first, so that a right row of that time is after it
    ranged, parts, over = _by_ranges(both, by, ["__t", "__side"], {"__head": F.min_by("est", at), "__tail": F.max_by("est", at)})
    back = Window.partitionBy(*[f"__of_{c}" for c in by]).orderBy(F.desc("__r2"))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"__p": F.last("__tail", ignorenulls=True).over(until(over)), "__q": F.last("__head", ignorenulls=True).over(until(back))}).drop("__head", "__tail")
    within = Window.partitionBy(*by, "__r")
    out = ranged.withColumns({"p": F.last("est", ignorenulls=True).over(until(within.orderBy("__t", "__side"))), "q": F.last("est", ignorenulls=True).over(until(within.orderBy(F.desc("__t"), F.desc("__side"))))})
    return out.filter(F.col("ref").isNotNull()).join(parts, _same(by)).select(*by, "ref", F.coalesce("p", "__p").alias("p"), F.coalesce("q", "__q").alias("q"))
