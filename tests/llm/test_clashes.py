"""Input columns with clashing and dotted names, long secrets, and the bounds of a training sample."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, language, private, toxicity

NAMES = ("__text", "c0", "a.b", "key", "words", "v")


def extra(docs):
    return docs.withColumns({c: F.lit(c) for c in NAMES})


def kept(rows):
    return all(r[c] == c for r in rows for c in NAMES)


TEXTS = [("the quick brown fox and the dog", "en"), ("der schnelle braune Fuchs und der Hund", "de"), ("", None), (None, None), ("the end of the day", "en")]


def test_other_columns_come_back_whatever_their_names(spark):
    docs = extra(spark.createDataFrame([(k, *x) for k, x in enumerate(TEXTS)], "doc_id long, text string, lang string"))
    ranks, pattern = bpe.multi_language_vocabulary()
    tokens = bpe.tokenize(docs.withColumn("token_ids", F.lit(1)), ranks, pattern)
    assert sorted(tokens.columns) == sorted([*docs.columns, "token_ids", "decoded"])
    rows = tokens.collect()
    assert kept(rows) and all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in rows)
    model = language.fit(docs.filter("lang IS NOT NULL"))
    rows = language.predict(docs.withColumn("score", F.lit("x")), model).collect()
    assert kept(rows) and {r["doc_id"]: r["lang_pred"] for r in rows} == {0: "en", 1: "de", 2: "und", 3: "und", 4: "en"}
    labels = spark.createDataFrame([(0, 0), (1, 1), (4, 0)], "doc_id long, toxic int")
    rows = toxicity.predict(docs.withColumn("predicted", F.lit("x")), toxicity.fit(docs, labels)).collect()
    assert kept(rows) and len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("n", [19, 20, 127, 128, 129, 152, 5_000, 200_000])
def test_secrets_of_any_length(spark, n):
    text = "use the token " + ("a1" * n)[:n] + " for it"
    out = private.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert out == ("use the token [secret] for it" if n >= 20 else text)


def test_long_runs_that_are_no_secret_cost_linear_time(spark):
    texts = ["a" * 400_000, "1" * 400_000, "_-" * 200_000]
    out = private.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["text"] for r in sorted(out, key=lambda r: r["doc_id"])] == texts


def test_a_training_sample_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 4_000)
    monkeypatch.setattr(toxicity, "TRAIN_LONGEST", 5_000)
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append(len(texts)) or train(texts, toxic))
    rows = [(k, ("vile brute " if k % 2 else "kind friend ") * 10) for k in range(400)] + [(1_000 + k, "vile " * 2_000) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    model = toxicity.fit(docs, spark.createDataFrame([(i, int("vile" in x)) for i, x in rows], "doc_id long, toxic int"))
    assert 10 < seen[0] < 80
    assert model is not None
