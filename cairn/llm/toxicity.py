"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words hash to buckets; buckets that the training sample shows in few texts have no embedding and read as one unknown
word. Filters of widths one to three slide over the embeddings, each filter's largest value over the text is kept, and
one layer turns these into a logit. Languages differ in what a logit means, so each has its own threshold, calibrated on
part of the sample; a text's language is told from the text itself.

Training sees a bounded sample of labelled rows, as arrays of buckets, on the driver; the model is broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import language
from cairn.llm.common import release, remainder, table, written

#: Texts of either label that a model is trained on at most; the part of them that thresholds are calibrated on.
TRAIN_TOXIC, TRAIN_CLEAN, CALIBRATE = 4_000, 8_000, 0.2
#: Characters of the sample about, at most: rows are drawn thinner where texts are long; longer texts than TRAIN_LONGEST are not learned from.
TRAIN_CHARS, TRAIN_LONGEST = 100_000_000, 1_000_000
#: Hash buckets; texts that a word must occur in to be embedded; embedding size; filters of each width.
BUCKETS, LEAST_TEXTS, DIMS, FILTERS, WIDTHS = 1 << 20, 3, 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 10, 64, 0.01, 5
#: Spread of the random start of embeddings and of filters: small embeddings let the few words that tell pull first.
START, FILTER_START = 0.02, 0.3
#: Words that a worker remembers, and words that are scored at once.
MEMO_WORDS, BLOCK_WORDS = 400_000, 100_000
_WORD = re.compile(r"[^\W\d_]+")


def buckets(text: str) -> list[int]:
    """Hash buckets of a text's words (runs of letters, in lower case)."""
    return [zlib.crc32(w.encode()) & (BUCKETS - 1) for w in _WORD.findall(text.lower())]


class ToxicityModel(NamedTuple):
    known: np.ndarray  # sorted buckets with an embedding
    embedding: np.ndarray  # (1 + len(known), DIMS), the first row is of unknown words and stays zero
    filters: list[np.ndarray]  # for each width (width, DIMS, FILTERS)
    filter_bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    weights: np.ndarray  # (len(WIDTHS) * FILTERS,)
    bias: float
    thresholds: dict[str, float]
    languages: language.LanguageModel


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' embedding rows one after the other, each followed by unknown words; where each starts, and the place behind
    the last from which no filter reaches the next text (one place of unknown words is left to each)."""
    gap = np.zeros(max(WIDTHS), np.int32)
    starts = np.cumsum([0, *(len(x) + len(gap) for x in rows)])[:-1]
    return np.concatenate([y for x in rows for y in (x, gap)]), starts, starts + [len(x) + 1 for x in rows]


def _filtered(embedding: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each filter's value at each position."""
    x = embedding[rows]
    columns = []
    for f in filters:
        value = x @ f[0]
        for k in range(1, len(f)):
            value[:-k] += x[k:] @ f[k]
        columns.append(value)
    return np.concatenate(columns, axis=1) + bias


def logits(model: ToxicityModel, rows: list[np.ndarray]) -> np.ndarray:
    """Of texts as embedding rows, about BLOCK_WORDS of those at once."""
    found, at = [np.zeros(0)], 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size + len(rows[end]) <= BLOCK_WORDS):
            size += len(rows[end])
            end += 1
        flat, starts, ends = _padded(rows[at:end])
        value = _filtered(model.embedding, model.filters, model.filter_bias, flat)
        top = np.maximum.reduceat(value, np.stack([starts, ends], axis=1).ravel()[: -1 if ends[-1] == len(flat) else None], axis=0)[::2]
        found.append(np.maximum(top, 0) @ model.weights + model.bias)
        at = end
    return np.concatenate(found)


def _known_rows(known: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, hashed), max(len(known) - 1, 0))
    return np.where(known[at] == hashed, at + 1, 0).astype(np.int32) if len(known) else np.zeros(len(hashed), np.int32)


def train(texts: list[np.ndarray], toxic: np.ndarray) -> ToxicityModel:
    """A model (without thresholds) from texts as bucket arrays and their 0/1 labels, by Adam on the logistic loss from a
    random start."""
    rng = np.random.default_rng(SEED)
    count = np.zeros(BUCKETS, np.int32)
    for x in texts:
        count[np.unique(x)] += 1
    known = np.flatnonzero(count >= LEAST_TEXTS)
    share = toxic.mean() if len(toxic) else 0.0
    embedding = rng.normal(0, START, (len(known) + 1, DIMS))
    embedding[0] = 0
    filters = [rng.normal(0, FILTER_START, (w, DIMS, FILTERS)) for w in WIDTHS]
    n = len(WIDTHS) * FILTERS
    state = {"e": embedding, "c": np.zeros(n), "w": np.abs(rng.normal(0, 0.1, n)), "b": np.full(1, -1.0)} | {f"f{k}": f for k, f in enumerate(filters)}
    first, second = ({k: np.zeros_like(v) for k, v in state.items()} for _ in range(2))
    rows = [_known_rows(known, x) for x in texts]
    balance = np.where(toxic == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) if 0 < share < 1 else np.ones(len(toxic))
    step = 0
    for _ in range(EPOCHS if len(texts) else 0):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            flat, starts, ends = _padded([rows[k] for k in batch])
            value = _filtered(state["e"], [state[f"f{k}"] for k in range(len(WIDTHS))], state["c"], flat)
            where = np.stack([a + value[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])  # (texts, filters)
            top = np.maximum(np.take_along_axis(value, where, axis=0), 0)
            p = 1 / (1 + np.exp(-np.clip(top @ state["w"] + state["b"][0], -30, 30)))
            slope = (p - toxic[batch]) * balance[batch] / len(batch)
            grad = {"w": top.T @ slope + 1e-4 * state["w"], "b": np.array([slope.sum()])}
            back = slope[:, None] * state["w"] * (top > 0)
            grad["c"] = back.sum(axis=0)
            touched, pulls = [], []
            for k, w in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                f, g, d = state[f"f{k}"], np.zeros_like(state[f"f{k}"]), back[:, own]
                for o in range(w):
                    r = flat[np.minimum(where[:, own] + o, len(flat) - 1)]  # (texts, FILTERS)
                    g[o] = np.einsum("tfd,tf->df", state["e"][r], d)
                    touched.append(r.ravel())
                    pulls.append((d[:, :, None] * f[o].T[None]).reshape(-1, DIMS))
                grad[f"f{k}"] = g + 1e-4 * f
            touched, where_to = np.unique(np.concatenate(touched), return_inverse=True)
            pull = np.zeros((len(touched), DIMS))
            np.add.at(pull, where_to, np.concatenate(pulls))
            pull[touched == 0] = 0
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                state[k] = state[k] - RATE * (first[k] / fix1) / (np.sqrt(second[k] / fix2) + 1e-8)
            # rows that no filter chose keep their state
            first["e"][touched] = 0.9 * first["e"][touched] + 0.1 * pull
            second["e"][touched] = 0.999 * second["e"][touched] + 0.001 * pull**2
            state["e"][touched] -= RATE * 0.3 * (first["e"][touched] / fix1) / (np.sqrt(second["e"][touched] / fix2) + 1e-8)
            state["e"][0] = 0
    filters = [state[f"f{k}"].astype(np.float32) for k in range(len(WIDTHS))]
    none = language.LanguageModel([], np.zeros(0), np.zeros((language.BUCKETS, 0), np.float32))
    return ToxicityModel(known, state["e"].astype(np.float32), filters, state["c"].astype(np.float32), state["w"].astype(np.float32), float(state["b"][0]), {"": 0.0}, none)


def _best_threshold(values: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The logit at which the weighted errors of both kinds are fewest, halfway between neighbours."""
    if not len(values):
        return 0.0
    order = np.argsort(values)
    v, cost = values[order], np.where(toxic[order] == 1, weight[order], -weight[order])
    errors = np.append(0, np.cumsum(cost))  # as the threshold passes each text
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    edges = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
    return float(np.median(edges[best]))


def calibrated(model: ToxicityModel, texts: list[np.ndarray], toxic: np.ndarray, langs: list[str], weight: np.ndarray) -> ToxicityModel:
    """The model with a threshold for each language that has enough texts, and one for the others."""
    values = logits(model, [_known_rows(model.known, x) for x in texts])
    both = _best_threshold(values, toxic, weight)
    thresholds = {"": both}
    for lang in sorted(set(langs)):
        own = np.array([x == lang for x in langs])
        trust = min(toxic[own].sum(), (1 - toxic[own]).sum())
        thresholds[lang] = (trust * _best_threshold(values[own], toxic[own], weight[own]) + 10 * both) / (trust + 10)
    return model._replace(thresholds=thresholds)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", lang: str = "lang", key: str = "doc_id") -> ToxicityModel:
    """A model from a bounded sample of the labels (key and 0 or 1) and their texts in docs; null texts count as empty.

    The sample is drawn from the labels, so that only its rows, few enough to broadcast, are sought among the texts. It is
    bounded in rows (TRAIN_TOXIC, TRAIN_CLEAN) and in characters (TRAIN_CHARS, TRAIN_LONGEST), as its words go to the driver. With
    no row, or rows of one label only, the model knows no word and the threshold decides alone.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).filter("toxic IN (0, 1) AND key IS NOT NULL").dropDuplicates(["key"])
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bound = {0: TRAIN_CLEAN, 1: TRAIN_TOXIC}
    per = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1_000_000))
    most = {k: int(1_000_000 * min(1, bound[k] / max(1, totals.get(k, 0)))) for k in bound}
    drawn = known.filter(F.when(F.col("toxic") == 1, per < most[1]).otherwise(per < most[0]))
    texts_of = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"))
    sample = written(texts_of.filter(F.length("text") <= TRAIN_LONGEST).join(F.broadcast(drawn), "key").select("key", "text", "toxic", "lang"), "toxic")
    chars = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > TRAIN_CHARS:
        sample = sample.filter(F.pmod(F.xxhash64("key", F.lit(SEED + 1)), F.lit(1_000_000)) < int(1_000_000 * TRAIN_CHARS / chars))
    languages = language.fit(sample.filter("lang <> ''"), key="key")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            words = [np.array(buckets(x), np.int32).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(language.score(languages, texts)[0], pa.string()), pa.array(words, pa.binary())], ["key", "toxic", "lang", "words"])

    got = sample.select("key", "toxic", "text").mapInArrow(hashed, "key long, toxic int, lang string, words binary").orderBy("key", "toxic").toPandas()
    texts = [np.frombuffer(x, np.int32) for x in got["words"]]
    toxic = got["toxic"].to_numpy(np.int64)
    weight = np.array([totals[t] / max(1, (toxic == t).sum()) for t in toxic.tolist()])
    apart = np.array([zlib.crc32(str(k).encode()) % 1000 < 1000 * CALIBRATE for k in got["key"]], bool)
    if len(set(toxic[~apart].tolist())) < 2 or len(set(toxic[apart].tolist())) < 2:
        apart = np.zeros(len(toxic), bool)
    model = train([x for x, a in zip(texts, apart, strict=True) if not a], toxic[~apart])
    check = apart if apart.any() else np.ones(len(toxic), bool)
    model = calibrated(model, [x for x, a in zip(texts, check, strict=True) if a], toxic[check], got["lang"][check].tolist(), weight[check])
    return model._replace(languages=languages)


class _Rows(dict):
    """Embedding rows of words."""

    def __init__(self, known: np.ndarray):
        super().__init__()
        self.rows = dict(zip(known.tolist(), range(1, len(known) + 1), strict=True))

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = self.rows.get(zlib.crc32(word.encode()) & (BUCKETS - 1), 0)
        return value


def predict(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row's kept columns with score (0 to 1, from the text alone) and predicted (1 from a score of 0.5 on).

    A null text counts as empty; it gets the score of a text without known words. Repeated rows give repeated rows; input
    columns named score or predicted are replaced, all others come back whatever their names.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = [f"c{k}" for k in range(len(kept))]  # so that no input column's name is one of those below
    back = [F.col(p).alias(c) for p, c in zip(plain, kept, strict=True)]
    source = docs.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, kept, strict=True)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = source.select(*plain, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def scores(texts: list[str], rows: _Rows) -> np.ndarray:
        own = shared.value
        names, _ = language.score(own.languages, texts)
        words = (_WORD.findall(x.lower()) for x in texts)
        values = logits(own, [np.fromiter(map(rows.__getitem__, w), np.int32, len(w)) for w in words])
        above = values - np.array([own.thresholds.get(x, own.thresholds[""]) for x in names])
        return 1 / (1 + np.exp(-np.clip(above, -30, 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(shared.value.known)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                score = scores(batch.column(len(kept)).to_pylist(), rows)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*plain, "score", "predicted"])
        rows.clear()
        release()

    return source.mapInArrow(run, schema).select(*back, "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text, learned from labels whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    out = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (F.coalesce(remainder(F.col("doc_id"), 5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
