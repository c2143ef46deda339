"""The queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums come in another order on another engine."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_binary(value: Column, digits: int) -> Column:
    """value rounded as the SQL's engine does: the product with the power of ten goes to the nearest whole number, so that the
    double nearest to 0.70405 gives 0.704. F.round looks at the decimal that a double is written as and gives 0.7041."""
    product = value * 10.0**digits
    return F.when(F.abs(product) < 2.0**52, F.round(product, 0) / 10.0**digits).otherwise(value)


def mean(name: str) -> Column:
    """Mean of a double whatever the order of rows: whole parts and what is left of them are summed apart, so that cents add up
    to the double nearest to their sum."""
    value = F.col(name)
    rest = F.when(F.abs(value) < float("inf"), value - F.rint(value)).when(value.isNotNull(), 0.0)
    return (F.sum(F.rint(value)) + F.sum(rest)) / F.count(value)
