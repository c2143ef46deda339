"""Rigid alignment: sums by group in Spark, one small decomposition for each group's sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.geometry import AXES, norm
from cairn.operators.points import nearest, transform
from cairn.plans.storage import written

_CROSS = [f"s{a}{b}" for a in AXES for b in AXES]


def rigid(matched: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, m00 .. m23): the rotation and shift that bring e + axis onto r + axis with the least squares.

    Groups of fewer than three pairs, or on one line, get the best rotation there is; never a mirror image.
    """
    means = [F.avg(f"{s}{c}").alias(f"{s}{c}") for s in "er" for c in AXES]
    cross = [F.covar_pop(f"e{a}", f"r{b}").alias(f"s{a}{b}") for a in AXES for b in AXES]
    sums = matched.groupBy(*by).agg(F.count("*").alias("n"), *means, *cross).na.fill(0.0, _CROSS)
    names = [f"m{i}{j}" for i in range(3) for j in range(4)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            h = np.stack([column(c) for c in _CROSS], axis=1).reshape(-1, 3, 3)
            e, r = (np.stack([column(f"{s}{c}") for c in AXES], axis=1) for s in "er")
            u, _, vt = np.linalg.svd(h)
            v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
            flip = np.stack([np.ones(len(h)), np.ones(len(h)), np.sign(np.linalg.det(v @ ut))], axis=1)
            turn = (v * flip[:, None, :]) @ ut
            shift = r - np.einsum("nij,nj->ni", turn, e)
            m = np.concatenate([turn, shift[:, :, None]], axis=2).reshape(-1, 12)
            head = [batch.column(k) for k in range(len(by) + 1)]
            yield pa.RecordBatch.from_arrays([*head, *[pa.array(m[:, k]) for k in range(12)]], [*by, "n", *names])

    return sums.mapInArrow(solve, sums.select(*by, "n", *[F.lit(0.0).alias(c) for c in names]).schema)


def aligned(matched: DataFrame, by: list[str]) -> DataFrame:
    """matched with e + axis moved by its group's rigid alignment."""
    m = rigid(matched, by).drop("n")
    out = matched.join(m, by) if by else matched.crossJoin(F.broadcast(m))  # one row
    moved = {f"e{c}": F.col(f"m{i}0") * F.col("ex") + F.col(f"m{i}1") * F.col("ey") + F.col(f"m{i}2") * F.col("ez") + F.col(f"m{i}3") for i, c in enumerate(AXES)}
    return out.withColumns(moved).select(*matched.columns)


def icp(source: DataFrame, target: DataFrame, most: float, steps: int = 30, tolerance: float = 1e-6) -> tuple[list[list[float]], float, float]:
    """Matrix (4 x 4) that brings source onto target, share of points with a neighbour within `most`, and their RMSE.

    Each step joins nearest points, sums them and solves for one rigid move; the moved points are written, and the loop
    ends when share and RMSE no longer change.
    """
    total, now, before = np.eye(4), source.select("pid", *AXES), (0.0, 0.0)
    n = source.count()
    there = target.select(F.col("pid").alias("other"), *[F.col(c).alias(f"r{c}") for c in AXES])
    for _ in range(steps):
        near = nearest(now, target).filter(F.col("d") <= most)
        pairs = written(near.join(now.select("pid", *[F.col(c).alias(f"e{c}") for c in AXES]), "pid").join(there, "other"), "icp")
        r = pairs.agg(F.count("*").alias("k"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rmse")).first()
        score = (r["k"] / n if n else 0.0, r["rmse"] or 0.0)
        if not r["k"] or max(abs(a - b) for a, b in zip(score, before, strict=True)) < tolerance:
            return total.tolist(), *score
        m = np.vstack([_matrix(rigid(pairs, [])), [0, 0, 0, 1]])
        total, before = m @ total, score
        now = written(transform(now, m.tolist()), "icp")
    return total.tolist(), *before


def gicp(source: DataFrame, target: DataFrame, most: float, k: int = 10, steps: int = 20, flat: float = 1e-3, tolerance: float = 1e-6) -> tuple[list[list[float]], float, float]:
    """As icp, by generalized ICP: each point stands for a small disc along the surface (its normal from k neighbours), and
    pairs count by how far they are apart across both discs.

    A step is one Gauss-Newton step; each batch of pairs adds to a 6 x 6 system, and the driver solves the sum.
    """
    from cairn.operators.structure import normals

    own = written(source.select("pid", *AXES).join(normals(source, k), "pid"), "gicp")
    there = written(target.select("pid", *AXES).join(normals(target, k), "pid").select(F.col("pid").alias("other"), *[F.col(c).alias(f"r{c}") for c in AXES], *[F.col(f"n{c}").alias(f"q{c}") for c in AXES]), "gicp")
    total, before, n = np.eye(4), (0.0, 0.0), source.count()
    names = [f"e{c}" for c in AXES] + [f"n{c}" for c in AXES] + [f"r{c}" for c in AXES] + [f"q{c}" for c in AXES]

    def system(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, m, r, q = (np.stack([batch.column(3 * g + i).to_numpy() for i in range(3)], axis=1) for g in range(4))
            disc = lambda v: np.eye(3) - (1 - flat) * v[:, :, None] * v[:, None, :]
            weight = np.linalg.inv(disc(m) + disc(q)) if len(e) else np.zeros((0, 3, 3))
            jac = np.zeros((len(e), 3, 6))
            for i, (a, b) in enumerate(((1, 2), (2, 0), (0, 1))):  # turning moves a point by the cross product
                jac[:, a, i], jac[:, b, i] = -e[:, b], e[:, a]
                jac[:, i, 3 + i] = 1
            h = np.einsum("nia,nij,njb->ab", jac, weight, jac)
            g = np.einsum("nia,nij,nj->a", jac, weight, r - e)
            yield pa.RecordBatch.from_arrays([pa.array([list(map(float, [*h.ravel(), *g]))], pa.list_(pa.float64()))], ["v"])

    for _ in range(steps):
        now = transform(own, total.tolist()).select("pid", *AXES)
        turned = own.select("pid", *[sum((F.col(f"n{c}") * float(total[i][j]) for j, c in enumerate(AXES)), F.lit(0.0)).alias(f"n{a}") for i, a in enumerate(AXES)])
        near = nearest(now, target).filter(F.col("d") <= most)
        pairs = written(near.join(now.select("pid", *[F.col(c).alias(f"e{c}") for c in AXES]), "pid").join(turned, "pid").join(there, "other").select("d", *names), "gicp")
        r = pairs.agg(F.count("*").alias("k"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rmse")).first()
        score = (r["k"] / n if n else 0.0, r["rmse"] or 0.0)
        if not r["k"] or max(abs(a - b) for a, b in zip(score, before, strict=True)) < tolerance:
            return total.tolist(), *score
        sums = pairs.select(*names).mapInArrow(system, "v array<double>").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(42)]).first()
        h, g = np.array(sums[:36]).reshape(6, 6), np.array(sums[36:])
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        angle = np.linalg.norm(step[:3])
        a, b, c = step[:3] / angle if angle > 0 else (0.0, 0.0, 0.0)
        cross = np.array([[0, -c, b], [c, 0, -a], [-b, a, 0]])
        move = np.eye(4)
        move[:3, :3] += np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
        move[:3, 3] = step[3:]
        total, before = move @ total, score
    return total.tolist(), *before


def merged(clouds: list[DataFrame], most: float, steps: int = 30) -> tuple[DataFrame, list[list[list[float]]]]:
    """All clouds (pid, x, y, z) in the frame of the first, each brought onto what is there before it, and their matrices."""
    whole, moves = written(clouds[0].select("pid", *AXES), "merged"), [np.eye(4).tolist()]
    for cloud in clouds[1:]:
        move = icp(cloud, whole, most, steps)[0]
        moves.append(move)
        whole = written(whole.union(transform(cloud.select("pid", *AXES), move)), "merged")
    return whole, moves


def _matrix(solved: DataFrame) -> np.ndarray:
    row = solved.first()
    return np.array([[row[f"m{i}{j}"] for j in range(4)] for i in range(3)])


def drift(matrix: list[list[float]], other: list[list[float]]) -> float:
    """Distance between two matrices' shifts."""
    return float(np.linalg.norm(np.array(matrix)[:3, 3] - np.array(other)[:3, 3]))


def rmse(matched: DataFrame, by: list[str]) -> DataFrame:
    e = norm(*[F.col(f"e{c}") - F.col(f"r{c}") for c in AXES])
    return matched.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))
