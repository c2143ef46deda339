"""The pipeline against a plain version of its rules."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from cairn.llm import bpe, common, language, mixing
from tests.llm.test_operators import components_of, shingle_set


def test_stages_keep_the_columns_and_order_of_work(spark, small):
    docs = common.table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), small)
        assert out.columns == docs.columns and out.count() == 0, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "pii", "mixing", "bpe"]


def test_pipeline_equals_plain_rules(spark, small):
    docs = common.table(spark, small, "documents")
    rows = docs.collect()
    # rows that the data may not have: no letters, no text, a repeat, personal data
    more = [(900_000, "1234 !!", "en", "src1", 7), (900_001, None, "en", "src1", None), (900_002, rows[0]["text"], "en", None, 1), (900_003, "Write to a@b.com or +1 (555) 010-9999 about the thing that was there.", "en", "src2", 1)]
    docs = docs.union(spark.createDataFrame(more, docs.schema)).union(docs.limit(1))
    kept, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = common.written(stage(spark, kept, small), name)
        steps[name] = kept.collect()

    model = language.fit(docs.filter(common.remainder(F.col("doc_id"), 4) != 2))
    all_rows = docs.collect()
    named = dict(zip([r["doc_id"] for r in all_rows], language.score(model, [r["text"] or "" for r in all_rows])[0], strict=True))
    expected = [r for r in all_rows if named[r["doc_id"]] != "und"]
    assert sorted((r["doc_id"], r["lang"]) for r in steps["language_id"]) == sorted((r["doc_id"], named[r["doc_id"]]) for r in expected)
    assert {900_000, 900_001}.isdisjoint(r["doc_id"] for r in steps["language_id"])

    distinct = sorted({r["doc_id"]: r["text"] for r in expected}.items())
    sets = [shingle_set(t) for _, t in distinct]
    links = []
    for a in range(len(sets)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) > 0 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links.append((b, a))
    root = components_of(len(sets), links)
    survivors = {distinct[k][0]: distinct[k][1] for k in range(len(sets)) if root[k] == k}
    assert sorted(r["doc_id"] for r in steps["ngram_jaccard"]) == sorted(survivors)

    private = {r["doc_id"]: r for r in steps["pii"]}
    assert private.keys() == survivors.keys()
    if 900_003 in private:
        assert private[900_003]["text"].startswith("Write to [email] or [phone] about")
    assert all(r["n_chars"] == len(r["text"]) for r in private.values())
    assert all(r["text"] == survivors[i] for i, r in private.items() if not re.search(r"@|\+[0-9]|[0-9]\.[0-9]|[0-9][ -]?[0-9]", survivors[i]))

    assert sorted(map(tuple, steps["mixing"])) == sorted(map(tuple, steps["pii"]))
    before = spark.createDataFrame(steps["pii"], docs.schema)
    slots = {r["doc_id"]: (r["mix_slot"], r["mix_order"]) for r in mixing.mix(before, mixing.stated_weights(before)).collect()}
    files = sorted(corpus_order(spark, small, steps["pii"], docs.schema))
    assert [slots[i] for _, i in files] == sorted(slots.values())

    path, pattern = bpe.multi_language_vocabulary()
    encoder = bpe.TextEncoder(bpe.load_ranks(path), pattern)
    assert all(r["token_ids"] == encoder.encode(r["text"]).tolist() and r["n_tokens"] == len(r["token_ids"]) for r in steps["bpe"])
    assert zlib.crc32(b"7") % 4 == spark.range(7, 8).select(common.remainder(F.col("id"), 4)).first()[0]


def corpus_order(spark, small, rows, schema):
    """(place in the mixed output, doc_id)."""
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, schema), small)
    return [(r["at"], r["doc_id"]) for r in out.select(F.monotonically_increasing_id().alias("at"), "doc_id").collect()]


def test_run_gives_what_its_stages_give(spark, small):
    """The registered query itself, on the smallest tables."""
    docs = common.table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, small), name)
    out = corpus_pipeline.run(spark, small)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["n_tokens"], r["text"]) for r in out.collect()) == sorted((r["doc_id"], r["n_tokens"], r["text"]) for r in docs.collect())


def test_the_mixed_order_reaches_the_end(spark, small):
    """Files of unlike sizes, as Spark reads large ones first: places are those that mixing gave."""
    rows = common.table(spark, small, "documents").select(*corpus_pipeline.COLUMNS).filter("text IS NOT NULL").limit(150)
    before = common.written(rows.unionByName(rows.withColumns({"doc_id": F.col("doc_id") + 500_000, "text": F.repeat("text", 3)})), "texts")
    slots = {r["doc_id"]: (r["mix_slot"], r["mix_order"], r["doc_id"]) for r in mixing.mix(before, mixing.stated_weights(before)).collect()}
    out = corpus_pipeline.encode(spark, common.written(corpus_pipeline.mix_sources(spark, before, small), "mixing"), small).select("doc_id", "mix_place").collect()
    assert sorted(r["mix_place"] for r in out) == list(range(300))
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["mix_place"])] == sorted(slots, key=slots.get)
    loose = corpus_pipeline.placed(spark.createDataFrame([(1,), (2,)], "doc_id long")).collect()
    assert [r["doc_id"] for r in sorted(loose, key=lambda r: r["mix_place"])] == [1, 2]
