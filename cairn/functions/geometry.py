"""Column expressions on points, vectors and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def distance(a: str, b: str) -> Column:
    """Euclidean distance of the points in columns a + axis and b + axis."""
    return norm(*[F.col(a + c) - F.col(b + c) for c in AXES])


def cell(axis: Column, size: float, origin: Column | float = 0.0) -> Column:
    return F.floor((axis - origin) / size).cast("long")


def affine(matrix: list[list[float]], axes: tuple[str, ...] = AXES) -> list[Column]:
    """The three coordinates of matrix (4 x 4) times the point."""
    return [sum((F.col(c) * float(matrix[r][k]) for k, c in enumerate(axes)), F.lit(float(matrix[r][3]))) for r in range(3)]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def aabb_iou(a: str, b: str) -> Column:
    """Intersection over union of axis-aligned boxes with centre and size columns a/b + cx.. and sx..; 0 if apart."""
    overlap, left, right = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for c in AXES:
        low = F.greatest(F.col(f"{a}c{c}") - F.col(f"{a}s{c}") / 2, F.col(f"{b}c{c}") - F.col(f"{b}s{c}") / 2)
        high = F.least(F.col(f"{a}c{c}") + F.col(f"{a}s{c}") / 2, F.col(f"{b}c{c}") + F.col(f"{b}s{c}") / 2)
        overlap = overlap * F.greatest(high - low, F.lit(0.0))
        left, right = left * F.col(f"{a}s{c}"), right * F.col(f"{b}s{c}")
    return F.when(overlap > 0, overlap / (left + right - overlap)).otherwise(0.0)


def determinant(m: dict[str, Column]) -> Column:
    """Of the symmetric 3 x 3 matrix with entries xx, xy, xz, yy, yz, zz."""
    return m["xx"] * (m["yy"] * m["zz"] - m["yz"] ** 2) - m["xy"] * (m["xy"] * m["zz"] - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - m["yy"] * m["xz"])


def ratio(over: Column, under: Column) -> Column:
    """over / under, 0 where under is 0."""
    return F.coalesce(F.try_divide(over.cast("double"), under.cast("double")), F.lit(0.0))
