"""Graphs of poses: vertices (id) and edges (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.storage import discard, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable.

    Alternating large-star and small-star steps until the edges are stars. Links with a null end or to the node itself
    count for nothing; without links the result is empty. Each step writes its edges to the shared folder; nothing reaches
    the driver but a sum of hashes that tells when the edges no longer change.
    """
    edges = links.filter(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices, edges, self loops, repeated undirected edges, vertices without a proper edge, edge ends that are missing."""
    pairs = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    e = pairs.groupBy("u", "v").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("n"))), F.lit(0)).alias("self_loops"), F.coalesce(F.sum(F.when(F.col("u") != F.col("v"), F.col("n") - 1)), F.lit(0)).alias("duplicates"))
    proper = pairs.filter("u <> v").select(F.col("u").alias("id")).union(pairs.filter("u <> v").select("v")).distinct()
    every = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    known = vertices.select("id").distinct()
    v = known.join(proper.withColumn("p", F.lit(1)), "id", "left").agg(F.count("*").alias("vertices"), F.count_if(F.col("p").isNull()).alias("isolated"))
    return v.crossJoin(e).crossJoin(every.join(known, "id", "left_anti").agg(F.count("*").alias("missing")))  # one row each


def components_with_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges)
    return vertices.select("id").distinct().join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def session(summary_row: DataFrame, poses: DataFrame | None = None, key_frames: int | None = None) -> DataFrame:
    """(level, problem) of a pose graph's session, from its summary, its poses (t, x, y, z) and how many key frames lie there.

    Errors: no vertices, edges to missing vertices, more than one component, poses out of time. Warnings: isolated vertices,
    repeated edges, fewer key frames than vertices. Without problems there is no row.
    """
    s = summary_row
    rules = [
        ("error", "no vertices", F.col("vertices") == 0),
        ("error", "edges name missing vertices", F.col("missing") > 0),
        ("error", "several components", F.col("components") > 1),
        ("warning", "isolated vertices", F.col("isolated") > 0),
        ("warning", "repeated edges", F.col("duplicates") > 0),
    ]
    if key_frames is not None:
        rules.append(("warning", "fewer key frames than vertices", F.lit(key_frames) < F.col("vertices")))
    found = F.array(*[F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(text).alias("problem"))) for level, text, bad in rules])
    out = s.select(F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).select("r.*")
    if poses is not None:
        order = poses.agg(F.count("*").alias("n"), F.countDistinct("t").alias("times"))
        out = out.union(order.filter("n > times").select(F.lit("error").alias("level"), F.lit("poses share a time").alias("problem")))
    return out
