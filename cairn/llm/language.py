"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is one matrix of log-probabilities (hash buckets by languages) and the log-priors. It is fitted on a bounded
sample of labelled rows, counted inside tasks, and broadcast; its size follows from the parameters and the number of
languages. Texts are scored in numpy, a bounded number of characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounded, release, remainder, table

#: Hash buckets, a power of two; labelled rows that a model is fitted on at most; languages that a model holds at most;
#: characters that are scored at once; n-grams of a text beyond which more of them say less.
BUCKETS, TRAIN_ROWS, LANGUAGES, BLOCK_CHARS, EVIDENCE = 1 << 16, 20_000, 1_000, 200_000, 200.0
UNDETERMINED = "und"


class LanguageModel(NamedTuple):
    languages: list[str]
    log_prior: np.ndarray  # (languages,)
    log_prob: np.ndarray  # (BUCKETS, languages)


def _plain_letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane; a space for anything else."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(65536)], np.uint32)


_LETTERS: list[np.ndarray] = []


def _buckets(padded: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each character (rows: orders), and which characters are letters."""
    if not _LETTERS:
        _LETTERS.append(_plain_letters())
    codes = np.frombuffer(padded.encode("utf-32-le", "replace"), np.uint32)
    far = np.flatnonzero(codes > 65535)
    first = _LETTERS[0][np.minimum(codes, 65535)]
    first[far] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in codes[far].tolist()]
    second, third = np.append(first[1:], 32), np.append(first[2:], [32, 32])[: len(first)]
    one = first * np.uint32(0x9E3779B1)
    two = (one ^ (second + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA77)
    three = (two ^ (third + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE3D)
    mixed = [(x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) for x in (one, two, three)]
    return np.stack([(x >> np.uint32(16)) & np.uint32(BUCKETS - 1) for x in mixed]), first != 32


#: What stands around a text: n-grams of its last letters end in spaces, and none reaches the next text.
_BEFORE, _AFTER = " ", "   "


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts, about BLOCK_CHARS characters at a time: buckets (orders, places), the places where texts start, the
    positions of those texts, and which of these pieces hold letters. A longer text comes in several pieces, whose n-grams
    together are the text's."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > BLOCK_CHARS:
            padded = f"{_BEFORE}{texts[at]}{_AFTER[:2]}"
            for k in range(0, len(padded) - 2, BLOCK_CHARS):
                buckets, letters = _buckets(padded[k : k + BLOCK_CHARS + 2])
                yield buckets[:, :-2], np.zeros(1, np.int64), np.array([at]), np.array([letters[:-2].any()])
            at += 1
            continue
        end, chars = at, 0
        while end < len(texts) and len(texts[end]) <= BLOCK_CHARS and (end == at or chars + len(texts[end]) <= BLOCK_CHARS):
            chars += len(texts[end])
            end += 1
        sizes = np.array([len(x) + 2 for x in texts[at:end]])
        buckets, letters = _buckets("".join(f"{_BEFORE}{x}{_AFTER}" for x in texts[at:end]))
        # the last two places of each text are there for the n-grams before them only
        ends = np.cumsum(sizes + 2)
        inside = np.ones(buckets.shape[1], bool)
        inside[np.concatenate([ends - 1, ends - 2, ends - 3])] = False
        starts = np.cumsum(sizes - 1) - (sizes - 1)
        yield buckets[:, inside], starts, np.arange(at, end), np.logical_or.reduceat(letters[inside], starts)
        at = end


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = TRAIN_ROWS) -> LanguageModel:
    """A model of the languages in `lang`, from at most about `most` rows; rows without text or language count for nothing.

    Without a usable row the model has no language and every text is undetermined. Repeated rows count each. Tasks count,
    one group a language adds up, and the driver gets one row of counts a language: LANGUAGES of them at most, else an error.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sample = bounded(rows, "key", most).select("text", "lang").repartition(8)  # counts of few tasks reach the driver

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for x, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(x)
            for name, texts in by.items():
                total = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                docs[name] = docs.get(name, 0) + len(texts)
                for buckets, *_ in _pieces(texts):
                    total += np.bincount(buckets.ravel(), minlength=BUCKETS)
        columns = [pa.array(list(counts), pa.string()), pa.array([docs[x] for x in counts], pa.int64()), pa.array([x.tobytes() for x in counts.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "docs", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for x in group.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
        docs = sum(group.column("docs").to_pylist())
        return pa.table({"lang": group.column("lang").slice(0, 1), "docs": pa.array([docs], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    kinds = "lang string, docs long, counts binary"
    found = sample.mapInArrow(count, kinds).groupBy("lang").applyInArrow(add, kinds).limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the matrix of the model is made for so many")
    languages = sorted({r["lang"] for r in found})
    counts, docs = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    for r in found:
        k = languages.index(r["lang"])
        counts[:, k] += np.frombuffer(r["counts"], np.int64)
        docs[k] += r["docs"]
    smooth = counts + 0.5
    return LanguageModel(languages, np.log(np.maximum(docs, 1) / max(docs.sum(), 1)), np.log(smooth / smooth.sum(axis=0)).astype(np.float32))


def score(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text, from all its n-grams.

    N-grams of one text depend on each other, so its log-odds are divided by 1 + n / EVIDENCE (n n-grams): that smooths the
    probability and leaves the order of the languages as it is.
    """
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    sums, n, has_letters = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for buckets, starts, rows, letters in _pieces(texts):
        for order in buckets:
            sums[rows] += np.add.reduceat(model.log_prob[order], starts, axis=0, dtype=np.float64)
        n[rows] += 3.0 * np.diff(np.append(starts, buckets.shape[1]))
        has_letters[rows] |= letters
    logits = (sums + model.log_prior) / (1 + n / EVIDENCE)[:, None]
    logits -= logits.max(axis=1, keepdims=True) if len(texts) else 0
    prob = np.exp(logits)
    prob /= prob.sum(axis=1, keepdims=True)
    names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(prob.argmax(axis=1), has_letters, strict=True)]
    return names, np.where(has_letters, prob.max(axis=1), 0.0)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row's kept columns with lang_pred and score. A text that is null or has no letter is `und` with score 0.

    Repeated rows give repeated rows; input columns named lang_pred or score are replaced, all others come back whatever their names.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = [f"c{k}" for k in range(len(kept))]  # so that no input column's name is one of those below
    back = [F.col(p).alias(c) for p, c in zip(plain, kept, strict=True)]
    source = docs.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, kept, strict=True)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = source.select(*plain, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score(shared.value, batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*plain, "lang_pred", "score"])
        release()

    return source.mapInArrow(run, schema).select(*back, "lang_pred", "score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    out = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (F.coalesce(remainder(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language": op3_language}
ORACLES: dict[str, str] = {}
