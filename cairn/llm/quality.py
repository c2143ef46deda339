"""Quality: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A document classifier (logistic regression on a few shape features, fitted on a bounded sample of labelled rows) gives
each text its evidence. Its probabilities, summed by host and by path within the host, are counts of good and bad texts;
a host's share is shrunk toward the global one and a path's toward its host's, each by a prior strength that the spread
of the shares beyond chance gives (method of moments). A text's score moves its own log-odds by how far its site's
posterior odds, without the text itself, lie from the global odds.

Texts are read once: their evidence goes on as a table without them. Everything but the fit of a dozen coefficients is built-in functions: sums by (host, path, salt), then path, then host,
so that a host with a third of all rows is summed in many tasks, and joins of the small site tables back.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounded, remainder, table, written

#: Labelled rows that the classifier is fitted on at most; salts of a site; weight of a site's log-odds beside the
#: document's own; bounds of a prior's strength in documents.
TRAIN_ROWS, SALTS, SITE_WEIGHT, STRENGTH = 20_000, 32, 0.5, (2.0, 10_000.0)


def shape_features(text: Column) -> dict[str, Column]:
    """Shares and lengths that tell prose from junk; 0 for an empty text."""
    body = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(body), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(body, pattern, ""))) / n

    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(x)) > 20)
    words = F.length(body) - F.length(F.regexp_replace(body, r"\s+\S", "x"))
    return {
        "symbols": F.when(F.length(body) > 0, share(r"[^\p{L}\p{N}\s.,;:'\"()?-]")).otherwise(0.0),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{N}"),
        "space": share(r"\s"),
        "stops": share(r"[.,]"),
        "length": F.log1p(F.length(body)) / 10,
        "repeated": F.when(F.size(lines) > 0, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0),
        "words": F.log1p(F.greatest(words, F.lit(0))) / 10,
    }


class QualityModel(NamedTuple):
    names: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]  # of each standardised feature and of its square
    bias: float

    def log_odds(self, text: Column) -> Column:
        total = F.lit(self.bias)
        found = shape_features(text)
        for k, name in enumerate(self.names):
            z = F.greatest(F.least((found[name] - self.mean[k]) / self.scale[k], F.lit(5.0)), F.lit(-5.0))
            total = total + z * self.weights[k] + z * z * self.weights[k + len(self.names)]
        return total


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", most: int = TRAIN_ROWS) -> QualityModel:
    """A classifier from at most about `most` labels (key and 0 or 1) and their texts in docs (Newton's method with a small
    ridge). The sample is drawn from the labels, so that few rows, broadcast, are sought among the texts.

    Without labels of both kinds it holds all texts equally likely good.
    """
    found = shape_features(F.col(text))
    drawn = bounded(labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).dropDuplicates(["key"]), "key", most)
    rows = docs.select(F.col(key).alias("key"), F.col(text)).join(F.broadcast(drawn), "key").select("key", *[c.alias(k) for k, c in found.items()], "y")
    data = rows.orderBy("key").toPandas()
    names, y = list(found), data["y"].to_numpy(float)
    x = data[names].to_numpy(float)
    if len(set(y.tolist())) < 2:
        return QualityModel(names, [0.0] * len(names), [1.0] * len(names), [0.0] * 2 * len(names), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -5, 5)
    z = np.hstack([z, z**2, np.ones((len(z), 1))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1]) * 1.0
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return QualityModel(names, mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def _strength(sites: DataFrame, above: Column) -> float:
    """Documents that a prior is worth: what the sites' shares vary by beyond chance, from two grouped sums."""
    own = sites.withColumn("m", above)
    part = F.col("good") / F.col("n")
    row = own.filter("n > 1").agg(F.count("*").alias("k"), F.sum((part - F.col("m")) ** 2 * F.col("n")).alias("s"), F.sum(F.col("m") * (1 - F.col("m"))).alias("v"), F.sum("n").alias("n")).first()
    if not row["k"] or not row["v"]:
        return STRENGTH[1]
    chance = row["v"] / row["k"]  # of one document
    beyond = max(row["s"] - row["v"], 0.0) / row["n"]
    return float(min(STRENGTH[1], max(STRENGTH[0], chance / beyond - 1))) if beyond > 0 else STRENGTH[1]


def site_quality(docs: DataFrame, model: QualityModel, host: str = "host", path: str = "path", text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all of docs) with evidence (the text's own probability), site (its path's posterior without it)
    and quality (both combined).

    A null host or path is a site of its own; a null or empty text counts as empty; repeated rows each count. Probabilities
    lie between 0 and 1. Input columns named evidence, site or quality are replaced, all others come back as they are.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("evidence", "site", "quality")]
    own = {c: f"c{k}" for k, c in enumerate(kept)}  # so that no input column's name is one of those below
    evidence = 1 / (1 + F.exp(-F.greatest(F.least(model.log_odds(F.col(f"`{text}`")), F.lit(12.0)), F.lit(-12.0))))
    columns = [F.col(f"`{c}`").alias(own[c]) for c in kept]
    scored = written(docs.select(*columns, F.col(f"`{host}`").alias("h"), F.col(f"`{path}`").alias("p"), F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(SALTS)).alias("salt"), evidence.alias("evidence")), "evidence")
    salted = scored.groupBy("h", "p", "salt").agg(F.sum("evidence").alias("good"), F.count("*").alias("n"))
    paths = written(salted.groupBy("h", "p").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "paths")
    hosts = written(paths.groupBy("h").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "hosts")
    whole = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    top = whole["good"] / whole["n"] if whole["n"] else 0.5
    host_worth = _strength(hosts, F.lit(top))
    shrunk = hosts.select(F.col("h").alias("hh"), ((F.col("good") + host_worth * top) / (F.col("n") + host_worth)).alias("prior"))
    nested = paths.join(shrunk, F.col("h").eqNullSafe(F.col("hh"))).drop("hh")
    path_worth = _strength(nested, F.col("prior"))
    sites = nested.select(F.col("h").alias("sh"), F.col("p").alias("sp"), "good", "n", "prior")
    joined = scored.join(sites, F.col("h").eqNullSafe(F.col("sh")) & F.col("p").eqNullSafe(F.col("sp")))
    without = (F.col("good") - F.col("evidence") + path_worth * F.col("prior")) / (F.col("n") - 1 + path_worth)
    site = F.greatest(F.least(without, F.lit(1 - 1e-6)), F.lit(1e-6))

    def odds(p: Column) -> Column:
        return F.log(p / (1 - p))

    limit = min(max(top, 1e-6), 1 - 1e-6)
    total = odds(F.greatest(F.least(F.col("evidence"), F.lit(1 - 1e-9)), F.lit(1e-9))) + SITE_WEIGHT * (odds(site) - odds(F.lit(limit)))
    return joined.select(*[F.col(own[c]).alias(c) for c in kept], "evidence", site.alias("site"), (1 / (1 + F.exp(-total))).alias("quality"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; hosts are the sources, paths their language sections. The classifier learns from labels
    whose crc32(doc_id) mod 5 is not 0; the others are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(F.coalesce(remainder(F.col("doc_id"), 5), F.lit(1)) != 0))
    sited = docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    out = site_quality(sited, model, keep=["doc_id"])
    held = (F.coalesce(remainder(F.col("doc_id"), 5), F.lit(1)) == 0).alias("held_out")
    return out.select("doc_id", held, "evidence", "site", F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
