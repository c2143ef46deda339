"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import textwrap
import zlib
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import bpe, components, embeddings, fingerprint, jaccard, language, license, mixing, private, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, x, lang, source, None) for i, x in enumerate(texts)], DOCS)


def components_of(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies(rng, sizes, vocabulary=4000):
    """Texts with copies edited by ever more words, around the threshold."""
    texts = [None, "", "  \t", "one", "ONE", "one two three four", "one two three four five", "one two three four five six"]
    for n in sizes:
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (0, 1, max(1, n // 60), max(1, n // 45), max(1, n // 30)):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(n)] = f"x{rng.randrange(vocabulary)}"
            texts.append(" ".join(words))
        texts.append(" ".join(base[: int(n * 0.85)]))
        texts.append(" ".join(base[: n // 2] + [f"y{rng.randrange(vocabulary)}" for _ in range(n // 2)]))
    return texts


def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(1)
    texts = near_copies(rng, [4, 5, 8, 12, 15, 17, 19, 20, 22, 25, 31, 33, 40, 60, 63, 64, 70, 100, 130, 250, 500, 1100])
    sets = [shingle_set(x) for x in texts]
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    expected = components_of(len(texts), links)
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == expected


@pytest.mark.parametrize("seed", range(3))
def test_every_linked_pair_shares_a_key(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n = rng.choice([rng.randint(1, 40), rng.randint(15, 140), rng.randint(100, 2500)])
        base = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        lost, more = rng.randint(0, n // 9 + 1), rng.randint(0, n // 8 + 1)
        other = np.concatenate([base[lost:], np.array([rng.getrandbits(64) for _ in range(more)], np.uint64)])
        a, b = np.unique(base), np.unique(other)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert set(jaccard.keys(a).tolist()) & set(jaccard.keys(b).tolist())
            assert 9 * jaccard.overlap_bound(jaccard.point(a), jaccard.point(b)) >= 4 * (len(a) + len(b))


def test_tree_finds_what_the_bound_lets_through():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(50, 90, 120)]
    for k in range(60, 120):
        sets[k] = np.unique(np.concatenate([sets[k - 60][5:], sets[k][:3]]))
    points, sizes, labels = np.stack([jaccard.point(x) for x in sets]), np.array([len(x) for x in sets]), rng.integers(0, 100, 120)
    left = rng.random(120) < 0.5
    ok = lambda a, b: labels[a] != labels[b] and 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b]) and 9 * int(jaccard.overlap_bound(points[a], points[b])) >= 4 * (sizes[a] + sizes[b])
    for side, pairs in ((np.ones(120, bool), combinations(range(120), 2)), (left, [(a, b) for a in range(120) for b in range(120) if left[a] and not left[b]])):
        a, b = jaccard.tree_pairs(points, sizes, labels, side)
        assert {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset(p) for p in pairs if ok(*p)}
    a, b = jaccard.few_pairs(points, sizes, labels, np.array([0, 30, 60]), np.array([30, 30, 60]))
    runs = [p for s, e in ((0, 30), (30, 60), (60, 120)) for p in combinations(range(s, e), 2)]
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset(p) for p in runs if ok(*p)}


def test_the_last_bound_drops_no_link():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [base] + [np.unique(np.concatenate([base[rng.random(len(base)) < share], rng.integers(0, 2**63, 60).astype(np.uint64)])) for share in np.linspace(0.5, 1, 60)]
    sets.append(np.unique(rng.integers(0, 2**63, jaccard.FINE + 5).astype(np.uint64)))
    sizes = np.array([len(x) for x in sets])
    a, b = (np.array(x) for x in zip(*combinations(range(len(sets)), 2), strict=True))
    ok = jaccard.sharper([jaccard.fine_groups(x) for x in sets], sizes, a, b)
    for i, j, let in zip(a.tolist(), b.tolist(), ok.tolist(), strict=True):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert let or 100 * both < 80 * (sizes[i] + sizes[j] - both)
        assert let == (9 * both >= 4 * (sizes[i] + sizes[j])) or max(sizes[i], sizes[j]) > jaccard.FINE or abs(9 * both - 4 * (sizes[i] + sizes[j])) < 60
    assert len(jaccard.sharper([], sizes, a[:0], b[:0])) == 0


def test_hot_keys_are_tiled(spark, monkeypatch):
    """A passage that many documents share, and copies of copies, with tiles of a few sets."""
    monkeypatch.setattr(jaccard, "TILE", 5)
    monkeypatch.setattr(jaccard, "STAR", 2)
    monkeypatch.setattr(jaccard, "FAN", 3)
    monkeypatch.setattr(jaccard, "PART_CHARS", 2_000)
    monkeypatch.setattr(jaccard, "SLOT_ROWS", 20)
    monkeypatch.setattr(jaccard, "FINE", 70)  # some sets list their groups, some do not
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 10)
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(passage + [f"a{k}x{rng.randrange(9999)}" for k in range(18)]) for _ in range(40)]
    for k in range(40):
        words = texts[k].split()
        words[-(k % 3) - 1] = f"q{k}"
        texts.append(" ".join(words))
    sets = [shingle_set(x) for x in texts]
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == components_of(len(texts), links)


def test_jaccard_takes_empty_tables_repeats_and_other_columns(spark):
    assert jaccard.jaccard_components(docs_of(spark, ["x"]).limit(0)).count() == 0
    twice = docs_of(spark, ["a b c d e f", "a b c d e f"]).union(docs_of(spark, ["a b c d e f"])).withColumn("sig", F.lit(1)).withColumn("key", F.lit(2))
    assert sorted(map(tuple, jaccard.jaccard_components(twice).collect())) == [(0, 2, 0), (0, 2, 0), (1, 2, 0)]


def test_jaccard_of_one_id_with_two_texts(spark):
    """Each text of an id is a document of its own: its links are neither lost nor mixed with the other's."""
    one, two = ([f"{c}{k}" for k in range(60)] for c in "ab")
    near = lambda words: " ".join([*words[:-1], "z"])
    rows = [(1, " ".join(one)), (2, near(one)), (2, " ".join(two)), (3, near(two)), (None, near(two)), (None, "alone here")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 56, 1), (2, 56, 1), (2, 56, 2), (3, 56, 2), (None, 56, 2), (None, 1, None)], key=str)


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = components_of(500, links)
    assert all(got.get(k, k) == expected[k] for k in range(500))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_equals_the_library_and_round_trips(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.multi_language_vocabulary()
    ranks = bpe.load_ranks(path)
    own, other = bpe.TextEncoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    parts = ["a", "th", "ing", "é", "ß", "  ", "\n", " ", "\t", "\x1c", "\x85", "\xa0", "1", "23", "½", "'s", "'ll", "'", "!", "***", "文字", "😀", "ñ", "\r\n", "_", "é"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert own.encode(text).tolist() == other.encode_ordinary(text)
    texts = [None, "", "aaab" * 5000, "Hello there.", "Hello there."]
    rows = bpe.tokenize(docs_of(spark, texts).withColumn("decoded", F.lit(3)), path, pattern).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in rows] == [x or "" for x in texts]
    assert [r["token_ids"] for r in rows] == [other.encode_ordinary(x or "") for x in texts]
    assert bpe.tokenize(docs_of(spark, texts).limit(0), path, pattern).count() == 0
    twice = bpe.tokenize(docs_of(spark, ["Hello there."]).union(docs_of(spark, ["Hello there."])), path, pattern).collect()
    assert len(twice) == 2 and twice[0]["token_ids"] == twice[1]["token_ids"]


def test_prefix_tables_take_appends_and_edits():
    encoder = bpe.PrefixEncoder(bpe.load_ranks(bpe.multi_language_vocabulary()[0]))
    rng = random.Random(6)
    for _ in range(60):
        old = bytes(rng.choice(b"abcdehinorst ") for _ in range(rng.randint(1, 300)))
        table = encoder.last_tokens(old)
        more = old + b"ending"
        assert encoder.last_tokens(more, table) == encoder.last_tokens(more)
        at = rng.randrange(len(old))
        new = old[:at] + b"zq" + old[min(len(old), at + rng.randint(0, 4)) :]
        assert encoder.after_edit(old, table, new, at, len(new) - len(old)) == encoder.last_tokens(new)


def test_language_on_held_out_rows_and_odd_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.fit(docs.filter("doc_id % 4 <> 2"))
    held = language.predict(docs.filter("doc_id % 4 = 2"), model)
    assert held.filter("lang = lang_pred").count() / held.count() > 0.95
    odd = language.predict(docs_of(spark, [None, "", "123 !?", "😀", "x" * 300_000]).withColumn("score", F.lit("clash")), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd][:4] == ["und"] * 4 and odd[4]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in odd)
    none = language.fit(docs.limit(0))
    assert language.predict(docs.limit(2), none).select("lang_pred").distinct().collect() == [T.Row(lang_pred="und")]
    batch = ["the thing was there", "der die das und nicht", "", "a", "ab", "x. "]
    names, scores = language.score(model, batch)
    for x, name, value in zip(batch, names, scores, strict=True):
        assert language.score(model, [x])[0] == [name] and abs(language.score(model, [x])[1][0] - value) < 1e-12


def plain_grams(text):
    """Counts of the 1-, 2- and 3-grams of a text, each character in turn; letters in lower case, all else a space."""
    plain = [c.lower()[0] if c.isalpha() else " " for c in f" {text}"] + [" ", " "]
    return [("".join(plain[i : i + n])) for i in range(len(plain) - 2) for n in (1, 2, 3)]


def test_language_scores_equal_plain_naive_bayes(spark, monkeypatch):
    """Fit and scores by hand: repeated rows, nulls, texts cut into pieces; one language twice as common."""
    monkeypatch.setattr(language, "BLOCK_CHARS", 50)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["the", "of", "and", "öl", "ß", "x1", "😀"], k=rng.choice([2, 9, 60]))), "en") for k in range(20)]
    rows += [(k, " ".join(rng.choices(["der", "und", "öl", "ist", "-"], k=rng.choice([2, 9, 60]))), "de") for k in range(20, 30)]
    rows += [rows[0], rows[0], (40, None, "en"), (41, "of no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    bucket = {}

    def of(gram):
        if gram not in bucket:  # the hash is the operator's own; everything else is done anew
            bucket[gram] = int(language._buckets(gram + "  ")[0][len(gram) - 1][0])
        return bucket[gram]

    counts = {"en": np.zeros(language.BUCKETS), "de": np.zeros(language.BUCKETS)}
    number = {"en": 0, "de": 0}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            number[lang] += 1
            for g in plain_grams(text):
                counts[lang][of(g)] += 1
    assert model.languages == ["de", "en"]
    log = {x: np.log((counts[x] + 0.5) / (counts[x] + 0.5).sum()) for x in counts}
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for i, text, _ in rows:
        grams = plain_grams(text or "")
        odds = {x: (sum(log[x][of(g)] for g in grams) + np.log(number[x] / sum(number.values()))) / (1 + len(grams) / language.EVIDENCE) for x in log}
        best = max(odds, key=odds.get)
        if any(c.isalpha() for c in text or ""):
            assert got[i]["lang_pred"] == best and abs(got[i]["score"] - 1 / (1 + np.exp(min(odds.values()) - odds[best]))) < 1e-4
        else:
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0


def test_language_query_holds_out_and_repeats(spark, small):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = language.op3_language(spark, small).collect()
    assert len(out) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"] and r["lang_pred"] != "und" and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.95


def base_spans(text):
    """The base spans as plainly as they are specified."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, s[::-1]))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m.group())]


def test_personal_data_equals_plain_search(spark):
    rng = random.Random(5)
    parts = ["a", "é", "😀", "@", ".", "-", " ", "_", "+", "1", "23", "255", "256", "a@b.c", "x.y@z-1.com", "1.2.3.4", "4111 1111 1111 1111", "5500005555555559", "+1 (555) 010-9999", "\n", "GB82 WEST 1234 5698 7654 32"]
    texts = [None, "", "a@b.c@d.e", "a@b.com_x@y.z", "1.2.3.4.5.6.7.8", "9" * 50_000, "a." * 20_000 + "@b.c", "+" + "1 " * 20_000]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(1500)]
    rows = private.find_private(docs_of(spark, texts).withColumn("pii", F.lit("clash"))).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        found = [f"{s['kind']}:{s['start']}:{s['end']}" for s in row["pii"]]
        assert [x for x in found if x.split(":")[0] in private.BASE] == base_spans(text or ""), text
    iban = private.find_private(docs_of(spark, ["my iban GB82 WEST 1234 5698 7654 32.", "GB83 WEST 1234 5698 7654 32", "ssn 123-45-6789", "part 123-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac"', "04dbebab91ab85687d33eeaaf9ac"])).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["pii"]] for r in iban] == [["iban"], [], ["ssn"], [], ["secret"], []]
    redacted = private.redact(docs_of(spark, ["mail a@b.com or 1.2.3.4!", None, "plain", "version 1.2.3.4 é", "é😀 call +1 (555) 010-9999 1.2.3.4 and a@b.com."])).orderBy("doc_id").collect()
    assert [r["text"] for r in redacted] == ["mail [email] or [ip]!", None, "plain", "version 1.2.3.4 é", "é😀 call [phone] and [email]."]


def test_scores_follow_words_on_either_side(spark):
    texts = ["at 1.2.3.4 x", "server 1.2.3.4", "1.2.3.4 is a host", "version 1.2.3.4", "1.2.3.4 (release)", "host " + "x" * 50 + " 1.2.3.4", "server 1.2.3.4 5.6.7.8", "4111 1111 1111 1111", "visa 4111 1111 1111 1111", "serial 4111 1111 1111 1111"]
    rows = private.find_private(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [[s["score"] for s in r["pii"]] for r in rows] == [[0.6], [0.9], [0.9], [0.3], [0.3], [0.6], [0.9, 0.9], [0.6], [0.9], [0.3]]


def test_very_many_spans(spark):
    """Places and replacements over several blocks of spans; the work is linear, so this ends soon."""
    n = 20_000
    texts = ["é a@b.com " * n, "1.2.3.4 " * (2 * private.BLOCK), "a@b.com " * private.BLOCK + "1.2.3.4", "a@b.com"]
    rows = private.find_private(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [(s["start"], s["end"]) for s in rows[0]["pii"]] == [(10 * k + 2, 10 * k + 9) for k in range(n)]
    assert [(s["start"], s["end"]) for s in rows[1]["pii"]] == [(8 * k, 8 * k + 7) for k in range(2 * private.BLOCK)]
    out = [r["text"] for r in private.redact(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert out == ["é [email] " * n, "[ip] " * (2 * private.BLOCK), "[email] " * private.BLOCK + "[ip]", "[email]"]


def test_personal_data_query_digests(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = private.op4_personal_data(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in private.BASE] == [sum(x.startswith(k + ":") for x in found) for k in private.BASE]
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if x.split(":")[0] in private.BASE] == found and len(spans) == len([x for x in r["scores"].split(",") if x])
    assert private.find_private(docs_of(spark, ["x"]).limit(0)).count() == 0 and private.redact(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_site_quality_shrinks_small_sites(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels)
    out = quality.site_quality(docs, model)
    assert out.count() == docs.count() and out.filter("quality BETWEEN 0 AND 1 AND site BETWEEN 0 AND 1").count() == docs.count()
    right = out.select("doc_id", F.col("quality").alias("q")).join(labels, "doc_id").filter((F.col("q") >= 0.5) == (F.col("quality") == 1)).count()
    assert right / labels.count() > 0.9
    prose, junk = docs.filter("doc_id = 0").first()["text"], "@@@ ### $$$ %%% " * 50
    rows = [(i, junk, "bad", "p") for i in range(40)] + [(i, prose, "good", "p") for i in range(40, 80)] + [(80, prose, "bad", "p"), (81, prose, "new", "p"), (82, None, None, None)]
    got = {r["doc_id"]: r for r in quality.site_quality(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), model).collect()}
    assert got[80]["site"] < got[81]["site"] < got[41]["site"]
    assert quality.site_quality(docs.limit(0), model).count() == 0
    assert quality.fit(docs, labels.limit(0)).bias == 0.0


def test_site_posteriors_equal_plain_sums(spark, small):
    """Shrinkage of hosts and paths by hand, over many sparse sites, a hot one, nulls, repeats, clashing names, a long text."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    rng = random.Random(21)
    rows = [(k, rng.choice(texts), f"h{rng.randrange(12)}" if k % 3 else "hot", rng.choice(["p", "q", None])) for k in range(150)]
    rows += [rows[0], rows[0], (900, None, None, None), (901, "", None, "p"), (902, "word, " * 100_000, "alone", "p")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").withColumns({c: F.lit("clash") for c in ("h", "p", "n", "good", "prior", "salt", "evidence", "site", "c0", "hh")})
    out = quality.site_quality(frame, model)
    assert sorted(out.columns) == sorted({*frame.columns, "quality"}) and out.filter("h = 'clash' AND c0 = 'clash' AND n = 'clash'").count() == len(rows)
    got = out.select("doc_id", "host", "path", "evidence", F.col("site").alias("s"), F.col("quality").alias("q")).collect()
    paths, hosts = {}, {}
    for r in got:
        for table, key in ((paths, (r["host"], r["path"])), (hosts, r["host"])):
            good, n = table.get(key, (0.0, 0))
            table[key] = (good + r["evidence"], n + 1)
    top = sum(r["evidence"] for r in got) / len(got)

    def worth(sites, prior):
        many = [(g, n, prior(k)) for k, (g, n) in sites.items() if n > 1]
        spread, chance = sum((g / n - m) ** 2 * n for g, n, m in many), sum(m * (1 - m) for _, _, m in many)
        beyond = max(spread - chance, 0) / sum(n for _, n, _ in many)
        return min(quality.STRENGTH[1], max(quality.STRENGTH[0], chance / len(many) / beyond - 1)) if beyond else quality.STRENGTH[1]

    host_worth = worth(hosts, lambda _: top)
    prior = {h: (g + host_worth * top) / (n + host_worth) for h, (g, n) in hosts.items()}
    path_worth = worth(paths, lambda key: prior[key[0]])
    odds = lambda x: np.log(x / (1 - x))
    for r in got:
        good, n = paths[r["host"], r["path"]]
        site = (good - r["evidence"] + path_worth * prior[r["host"]]) / (n - 1 + path_worth)
        total = odds(min(max(r["evidence"], 1e-9), 1 - 1e-9)) + quality.SITE_WEIGHT * (odds(min(max(site, 1e-6), 1 - 1e-6)) - odds(top))
        assert abs(r["s"] - min(max(site, 1e-6), 1 - 1e-6)) < 1e-9 and abs(r["q"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"  # of smaller tables only a handful of bad texts is held out
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in quality.op5_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert len(held) == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in labels)
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.95


def within_a_block(mixed, weights, source="source"):
    """While all sources last, after every slot each source is less than one block from its share by its stated weight."""
    first = mixed.drop_duplicates([source, "mix_block"])
    assert first["mix_slot"].is_unique and ((mixed["mix_release"] <= mixed["mix_slot"]) & (mixed["mix_slot"] < mixed["mix_deadline"])).all()
    total = sum(Fraction(w) for w in weights.values())
    for name, own in first.groupby(source, dropna=False):
        share = Fraction(weights[name if isinstance(name, str) else None]) / total
        for block, slot in zip(own["mix_block"].tolist(), own["mix_slot"].tolist(), strict=True):  # just before and just after it goes out
            assert -1 < block - slot * share < 1 and -1 < block + 1 - (slot + 1) * share < 1


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 3.0, "c": 1.0, None: 1.0}, {"a": 0.5, "b": 0.25, "c": 0.125, None: 0.125, "none": 0.0625}])
def test_mixing_keeps_every_source_within_a_block(spark, weights):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab" "c") if i % 11 else None, "x" * rng.randint(0, 90), "clash") for i in range(900)] + [(5, "a", "x" * 10, "clash")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot string").withColumns({c: F.lit(c) for c in ("slot", "k", "release", "part", "source.name", "__source", "__of", "__bucket", "__i", "__first")})
    out = mixing.mix(docs, weights, block_chars=100)
    assert sorted(out.columns) == sorted({*docs.columns, *mixing.ADDED}) and out.filter("slot = 'slot' AND k = 'k' AND __of = '__of'").count() == len(rows)
    out = out.toPandas()
    assert len(out) == len(rows) and sorted(out["doc_id"]) == sorted(r[0] for r in rows)
    within_a_block(out, weights or {"a": 1, "b": 1, "c": 1, None: 1})
    # a slot holds one block of one source
    assert (out.fillna("-").groupby("mix_slot")[["source", "mix_block"]].nunique() == 1).all().all()
    assert mixing.mix(docs.limit(0)).count() == 0
    for bad in ({"a": 1.0}, {"a": 0.0, "b": 1.0, "c": 1.0, None: 1.0}, {"a": 1e-9, "b": 0.1234567891, "c": 3.0, None: 1.0}):
        with pytest.raises(ValueError):
            mixing.mix(docs, bad)
    twice = spark.createDataFrame([(s, w) for s in ("a", "b", "c", None) for w in (1.0, 2.0)], "source string, weight double")
    with pytest.raises(ValueError):
        mixing.mix(docs, twice)


@pytest.mark.parametrize("members", [{1: 4}, {1: 1, 3: 1, 5: 1}, {1: 5, 2: 5, 3: 5, 4: 5}, {7: 3, 2: 1, 11: 2}, {1: 30, 29: 1}])
def test_schedule_is_earliest_deadline_first(members):
    """Every slot of a period against a slot by slot search among all released blocks, and every window kept."""
    period = sum(p * n for p, n in members.items())
    got = {}
    for r in mixing.schedule(members):
        for j in range(r.n):
            got[r.slot + j] = (r.part, r.first + j, r.k, r.release, r.deadline)
    assert sorted(got) == list(range(period))
    sent = {(p, i): 0 for p, n in members.items() for i in range(n)}
    for slot in range(period):
        ready = [(-(-(k + 1) * period // p), p, k, i) for (p, i), k in sent.items() if k < p and k * period // p <= slot]
        deadline, p, k, i = min(ready)
        assert got[slot] == (p, i, k, k * period // p, deadline) and slot < deadline
        sent[p, i] += 1
    assert len(mixing.schedule({p: n * 1_000 for p, n in members.items()})) <= 3 * sum(members)


def test_mixing_query_keeps_the_stated_weights(spark, small):
    """Over many periods, with short blocks."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text")
    names = sorted((r[0] for r in docs.select("source").distinct().collect()), key=lambda s: (s is None, s or ""))
    weights = {s: 1.0 + i % 4 for i, s in enumerate(names)}
    assert {r["source"]: r["weight"] for r in mixing.stated_weights(docs).collect()} == weights and len(set(weights.values())) == 4
    out = mixing.mix(docs, mixing.stated_weights(docs), block_chars=40).toPandas()
    assert out["mix_slot"].max() > 20 * sum(weights.values())
    within_a_block(out, weights)
    assert mixing.op6_mixing(spark, small).select("slot").distinct().count() > 1


def test_mixing_takes_any_number_of_sources(spark):
    """Host-like sources: more than a thousand, one of them null."""
    names = [f"h{i:04d}" for i in range(1_200)] + [None]
    docs = spark.createDataFrame([(2 * i + j, s, "x" * 60) for i, s in enumerate(names) for j in range(2)], "doc_id long, source string, text string")
    even = mixing.mix(docs, block_chars=50).collect()
    assert sorted(r["mix_slot"] for r in even) == list(range(2 * len(names)))
    assert all(r["mix_slot"] % len(names) == names.index(r["source"]) for r in even)
    weights = {s: 1.0 + i % 4 for i, s in enumerate(names)}
    mixed = mixing.mix(docs, weights, block_chars=50).toPandas()
    assert len(mixed) == 2 * len(names)
    within_a_block(mixed, weights)
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    again = mixing.mix(docs, table, block_chars=50).toPandas()
    assert sorted(zip(again["doc_id"], again["mix_slot"], strict=True)) == sorted(zip(mixed["doc_id"], mixed["mix_slot"], strict=True))


def test_fingerprints_are_steady_and_near_the_truth(spark):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(400)]
    other = base[:200] + [f"z{rng.randrange(9999)}" for _ in range(200)]
    texts = [None, "", " \n ", "one two", "ONE  two", " ".join(base), " ".join(base), " ".join(other), "q" * 200_000]
    rows = fingerprint.with_fingerprint(docs_of(spark, texts).withColumn("fp", F.lit(1)), "text", "fp").orderBy("doc_id").collect()
    fp = [r["fp"] for r in rows]
    assert fp[0] == fp[1] == fp[2] == "" and fp[3] == fp[4] != fp[5] == fp[6] and all(len(x) == 128 for x in fp[3:])
    pairs = spark.createDataFrame([(fp[5], fp[6]), (fp[5], fp[7]), (fp[3], fp[5]), (fp[0], fp[0]), (fp[0], fp[5])], "a string, b string")
    near = [r[0] for r in pairs.select(fingerprint.likeness("a", "b")).collect()]
    assert near[0] == 1 and abs(near[1] - 196 / 596) < 0.15 and near[2] < 0.15 and near[3:] == [1, 0]


def test_edited_texts_equal_brute_force(spark):
    """Ends are replaced by the next document's beginning, with null ids, null and empty texts, repeats and one id twice."""
    rng = random.Random(12)
    words = [f"w{k}é" for k in range(300)]
    rows = [(k * k * 7 - 90, " ".join(rng.choices(words, k=rng.randrange(0, 90)))) for k in range(40)]
    rows += [(5_000, None), (5_001, ""), (None, "a row without id 😀😀😀"), (70_000, "q w e r t y " * 20_000), (80_000, "short")]
    got = {r["doc_id"]: r for r in fingerprint.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1))).collect()}
    assert len(got) == len(rows)
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + [r for r in rows if r[0] is None]
    prints = {}
    edits = []
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        moved = len(text) // 3
        edits.append((i, text[: len(text) - moved] + after[:moved], after))
        prints[i] = text
    plain = spark.createDataFrame([(i, prints[i], e, a) for i, e, a in edits], "doc_id long, text string, edited string, after string")
    for c in ("text", "edited", "after"):
        plain = fingerprint.with_fingerprint(plain, c, f"fp_{c}")
    plain = plain.select("*", fingerprint.likeness("fp_text", "fp_edited").alias("near_edited"), fingerprint.likeness("fp_text", "fp_after").alias("near_next"))
    for r in plain.collect():
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(r["text"]) and g["edited_sha256"] == hashlib.sha256(r["edited"].encode()).hexdigest()
        assert (g["fingerprint"], g["edited_fingerprint"], g["near_edited"], g["near_next"]) == (r["fp_text"], r["fp_edited"], r["near_edited"], r["near_next"])
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (None, None), (None, None)], "doc_id long, text string")
    out = [tuple(r) for r in fingerprint.edited_likeness(again).collect()]
    assert len(out) == 5 and len(set(out)) == 3
    assert fingerprint.edited_likeness(again.limit(0)).count() == 0
    alone = fingerprint.edited_likeness(spark.createDataFrame([(3, "a b c")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1 and alone["edited_sha256"] == hashlib.sha256(b"a b a").hexdigest()


def test_fingerprints_of_one_permutation_by_hand(spark):
    """Bins, borrowing and digits as plain loops over the shingle hashes."""
    rng = random.Random(13)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(50)], k=n)) for n in (1, 4, 5, 6, 20, 300)]
    rows = fingerprint.with_fingerprint(docs_of(spark, texts), "text", "fp").orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        words = text.split()
        frame = spark.createDataFrame([tuple(words[k : k + 5]) for k in range(len(words) - 4)] or [tuple(words)], [f"c{k}" for k in range(min(5, len(words)))])
        if len(words) >= 5:
            hashes = [r[0] & (2**63 - 1) for r in frame.select(F.xxhash64(*[F.xxhash64(c) for c in frame.columns])).collect()]
        else:
            seed = F.lit(7).cast("long")
            for c in frame.columns:
                seed = F.xxhash64(seed, F.xxhash64(c))
            hashes = [frame.select(seed).first()[0] & (2**63 - 1)]
        bins = {}
        for h in hashes:
            b = h >> (63 - 7)
            bins[b] = min(bins.get(b, h), h)
        digits = ""
        for i in range(fingerprint.BINS):
            at, step = i, 0
            while at not in bins:
                at = (fingerprint.FACTOR[i] * step + fingerprint.OFFSET[i]) % fingerprint.BINS
                step += 1
            digits += f"{bins[at] & 15:x}"
        assert row["fp"] == digits


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter("doc_id % 5 <> 0"))
    held = toxicity.predict(docs.join(labels.filter("doc_id % 5 = 0"), "doc_id"), model).toPandas()
    assert held.loc[held.toxic == 0, "predicted"].mean() < 0.05
    assert held.loc[held.toxic == 1, "score"].mean() > held.loc[held.toxic == 0, "score"].mean()
    odd = toxicity.predict(docs_of(spark, [None, "", "😀" * 1000, "you " * 100_000]), model).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.predict(docs.limit(3), none).count() == 3
    assert toxicity.predict(docs.limit(0), model).count() == 0
    # repeated rows, clashing names
    few = docs.limit(3).withColumn("score", F.lit("clash")).withColumn("__text", F.lit("kept"))
    twice = toxicity.predict(few.union(few), model, keep=["doc_id", "score"]).collect()
    assert len(twice) == 6 and len({tuple(r) for r in twice}) == 3 and twice[0].asDict().keys() == {"doc_id", "score", "predicted"}


def test_toxicity_query_recalls_held_out_rows(spark):
    """The query itself on the largest of the small tables: labels of its held-out rows, which it has not seen."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op8_toxicity(spark, sf).filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    toxic, clean = ([r["predicted"] for r in rows if labels.get(r["doc_id"]) == k] for k in (1, 0))
    assert sum(toxic) / len(toxic) > 0.75 and sum(clean) / len(clean) < 0.01


def test_toxicity_learns_phrases():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 500, rng.integers(5, 60)).astype(np.int64) for _ in range(600)]
    toxic = np.arange(600) % 2
    for x in (t for t, y in zip(texts, toxic, strict=True) if y):
        x[rng.integers(0, len(x))] = 700 + rng.integers(0, 5)
    model = toxicity.train(texts[:400], toxic[:400])
    values = toxicity.logits(model, [toxicity._known_rows(model.known, x) for x in texts[400:]])
    assert ((values > np.median(values)) == toxic[400:]).mean() > 0.95


def test_toxicity_needs_its_wide_filters(monkeypatch):
    """Two words that mean nothing apart: only filters over several words tell their order."""
    rng = np.random.default_rng(2)
    texts, toxic = [], np.arange(1200) % 2
    for y in toxic:
        x = rng.integers(0, 300, 30).astype(np.int64)
        at = rng.integers(0, 28)
        x[at : at + 2] = (900, 901) if y else (901, 900)
        texts.append(x)

    def right():
        model = toxicity.train(texts[:900], toxic[:900])
        values = toxicity.logits(model, [toxicity._known_rows(model.known, x) for x in texts[900:]])
        return ((values > 0) == toxic[900:]).mean()

    monkeypatch.setattr(toxicity, "EPOCHS", 60)
    assert right() > 0.9
    monkeypatch.setattr(toxicity, "WIDTHS", (1,))
    assert right() < 0.65


def test_convolution_equals_plain_loops():
    """Logits by hand: every filter at every place, the largest value, one layer."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, n).astype(np.int64) for n in (0, 1, 2, 7, 40)] + [rng.integers(0, 50, 30).astype(np.int64) for _ in range(40)]
    model = toxicity.train(texts, np.arange(len(texts)) % 2)
    rows = [toxicity._known_rows(model.known, x) for x in texts]
    for r, value in zip(rows, toxicity.logits(model, rows), strict=True):
        padded = np.concatenate([model.embedding[r], np.zeros((max(toxicity.WIDTHS), toxicity.DIMS))])
        total, at = model.bias, 0
        for f in model.filters:
            for k in range(f.shape[2]):
                places = [(padded[i : i + len(f)] * f[: len(padded) - i, :, k]).sum() for i in range(len(r) + 1)]
                total += max(0.0, max(places) + model.filter_bias[at]) * model.weights[at]
                at += 1
        assert abs(total - value) < 1e-3


def test_licenses_named_and_others_left(spark):
    lines = {
        "apache": "Licensed under the Apache License, Version 2.0.",
        "cc": "Licensed under CC BY-NC 4.0.",
        "mit": "Released under the MIT License.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "bsd": "SPDX-License-Identifier: BSD-3-Clause",
    }
    texts = [f"Some words here.\n{x}\nMore of them." for x in lines.values()] + [None, "", "the and of\nhe lost his license", "x " * 100_000]
    rows = license.scan(docs_of(spark, texts).withColumn("licenses", F.lit(1))).orderBy("doc_id").collect()
    assert [[(s["paragraph"], s["family"], s["confirmed"]) for s in r["licenses"]] for r in rows] == [[(1, k, True)] for k in lines] + [[]] * 4


def test_licenses_in_wordings_not_trained_on(spark):
    """Notices as projects write them; wrapped lines; near misses that grant nothing."""
    named = {
        "GNU Lesser General Public License Version 2.1": "lgpl",
        "Licensed under the EUPL, Version 1.2 or later": "eupl",
        "This file is part of Foo. Foo is distributed under the Eclipse Public License - v 2.0": "epl",
        "// SPDX-License-Identifier: ISC": "isc",
        "All content is CC-BY-SA 4.0 unless otherwise noted": "cc",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "bsd",
        "You should have received a copy of the GNU General Public License along with this program.": "gpl",
        'Licensed under the Apache License, Version 2.0 (the "License");': "apache",
        "(c) 2019 Foo Inc. All rights reserved.": "proprietary",
    }
    rows = license.scan(docs_of(spark, list(named))).orderBy("doc_id").collect()
    assert [[s["family"] for s in r["licenses"]] for r in rows] == [[x] for x in named.values()]
    wrapped = "First line here.\nThis is distributed under the GNU Lesser\nGeneral Public License, version 2.1.\n\nThe last line."
    none = ["he got a license to drive", "the general public was there", "see the terms of the contract", "words\n\nmore of the words"]
    texts = [wrapped, *none]
    rows = license.scan(docs_of(spark, texts).union(docs_of(spark, texts))).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert bool(r["licenses"]) == (r["text"] == wrapped)
    assert license.scan(docs_of(spark, ["x"]).limit(0)).count() == 0
    number, right, gap = license.trained().held_out
    assert number > 500 and right > 0.85 and gap < 0.05


def test_license_query_equals_plain_scoring(spark, small):
    """Families of every paragraph as the model and the templates give them, line by line outside Spark."""
    model, grams = license.trained(), license.templates()

    def plain(line):
        z = np.array(model.bias) + sum((np.array(model.weights[f]) for f in license.features_of(license.words_of(line)) if f in model.weights), np.zeros(len(model.bias)))
        p = np.exp((z - z.max()) / model.temperature)
        best = model.families[p.argmax()]
        return best if best != "unknown" and p.max() / p.sum() >= license.ACCEPT else None

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    some = 0
    for r in license.op9_license_scan(spark, small).collect():
        lines, want, start = texts[r["doc_id"]].split("\n"), [], 0
        while start < len(lines):
            end = start + 1
            while end < len(lines) and lines[end].strip(" \t\r\f\x0b"):
                end += 1
            own, seen = lines[start:end], set()
            alone = [plain(x) for x in own]
            for k, x in enumerate(own):
                after = own[k + 1] if k + 1 < len(own) else ""
                family = alone[k] or (plain(f"{x} {after}") if x.strip(" ") and after.strip(" ") and not alone[k + 1] else None)
                if family and family not in seen:
                    want.append(f"{start + k}:{family}")
                    seen.add(family)
            words = license.words_of(" ".join(own))
            threes = {" ".join(w) for w in zip(words, words[1:], words[2:], strict=False)}
            for family, gram in grams:
                if family not in seen and len(threes & set(gram)) / len(gram) >= license.CONFIRM:
                    want.append(f"{start}:{family}")
                    seen.add(family)
            start = end
        some += len(want)
        listed = r["paragraphs"].split(",") if r["paragraphs"] else []
        assert sorted(x.split(":")[1] for x in listed) == sorted(x.split(":")[1] for x in want) and r["n_license"] == len(want)
        assert {x for x in listed if x.split(":")[1] not in dict(grams)} == {x for x in want if x.split(":")[1] not in dict(grams)}
    assert some >= 5


@pytest.mark.parametrize("width", [30, 40, 60, 2_000])
def test_license_notices_of_any_width_come_once_and_confirmed(spark, width):
    """Grants of real notices, wrapped, in their own paragraphs between others."""
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice appears",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    }
    texts = [f"Some words\nof the file.\n \t\n{textwrap.fill(x, width)}\n\n\nMore words here." for x in notices.values()]
    rows = license.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    for family, text, r in zip(notices, texts, rows, strict=True):
        mine = [s for s in r["licenses"] if s["family"] == family]
        assert len(mine) == 1 and mine[0]["confirmed"] and 3 <= mine[0]["paragraph"] < len(text.split("\n")) - 3, (family, r["licenses"])


def test_narrative_and_denied_licenses_are_unknown(spark):
    texts = [
        "This article is about the history of the Apache License and how it was written by a foundation",
        "The MIT License is not used here; all code is not free",
        "A talk on the history of the GNU General Public License was given last year",
        "The files are not licensed under the Mozilla Public License.",
    ]
    assert [r["licenses"] for r in license.scan(docs_of(spark, texts)).orderBy("doc_id").collect()] == [[]] * len(texts)
    both = license.scan(docs_of(spark, ["Licensed under the MIT License.\nIt was here.\nReleased under the MIT License.\n\nReleased under WTFPL\nand under the Microsoft Public License (Ms-PL)"])).first()["licenses"]
    assert [(s["paragraph"], s["family"]) for s in both] == [(0, "mit"), (4, "wtfpl"), (5, "mspl")]


def test_template_marks_lose_nothing():
    marks = set(license.template_marks())
    for _, grams in license.templates():
        assert sum(marks.isdisjoint(g.split()) for g in grams) < license.CONFIRM * len(grams)


def test_license_anchors_lose_nothing():
    model, rng = license.trained(), random.Random(1)
    hint = re.compile(r"(?<![a-z0-9])(?:" + "|".join(model.anchors()) + r")(?![a-z0-9])")
    words = sorted({w for f in model.weights for w in f.split()})
    for _ in range(5000):
        line = rng.choices(words, k=rng.randint(1, 12))
        total = np.array(model.bias) + sum((np.array(model.weights[f]) for f in license.features_of(line) if f in model.weights), np.zeros(len(model.bias)))
        p = np.exp(total / model.temperature) / np.exp(total / model.temperature).sum()
        assert hint.search(" ".join(line)) or p[:-1].max() < license.ACCEPT


def vectors_of(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, 64))
    near = [b + rng.standard_normal(64) * s for b in base[:20] for s in (0.02, 0.2, 0.25, 0.3, 0.33, 0.36, 0.4)]
    hot = [base[50] + rng.standard_normal(64) * 0.05 for _ in range(150)]
    rows = [*base.tolist(), *[x.tolist() for x in near], *[x.tolist() for x in hot], base[0].tolist(), (base[0] * 2).tolist(), None, [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0] * 3, [1e-300] * 64, [1e300] * 64]
    return [[None if x is None else float(x) for x in r] if r is not None else None for r in rows]


@pytest.mark.parametrize("tile", [8_000, 7])
def test_embedding_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "PAIRS", 500)
    rows = vectors_of()
    ok = [k for k, r in enumerate(rows) if r and len(r) == 64 and all(x is not None and np.isfinite(x) for x in r) and any(r)]
    unit = np.array([np.array(rows[k]) / np.abs(rows[k]).max() for k in ok])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = [(ok[a], ok[b]) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)), strict=True)]
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    df = spark.createDataFrame([(k, r, 1) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(0))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert [got[k]["n_links"] for k in range(len(rows))] == degree.tolist()
    assert [got[k]["component_id"] for k in range(len(rows))] == components_of(len(rows), links)
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_embeddings_of_several_lengths(spark):
    """Each length is joined within itself; an id twice, a null id and a hot length beside rare ones."""
    rng = np.random.default_rng(8)
    rows = []
    for dims, n in ((2, 40), (3, 25), (5, 25), (1, 4)):
        base = rng.standard_normal((max(1, n // 5), dims))
        rows += [(base[rng.integers(len(base))] + rng.standard_normal(dims) * 0.1).tolist() for _ in range(n)]
    rows += [rows[0], [x * 3 for x in rows[1]], rows[45]]
    unit = [np.array(r) / np.linalg.norm(r) for r in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if len(rows[a]) == len(rows[b]) and float(unit[a] @ unit[b]) >= 0.95]
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    df = spark.createDataFrame([*enumerate(rows), (None, rows[0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert [got[k]["n_links"] for k in range(len(rows))] == degree.tolist() and got[None]["n_links"] == 0
    assert [got[k]["component_id"] for k in range(len(rows))] == components_of(len(rows), links)
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [1.0, 1.0, 0.0]), (5, [1.0, 1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(few).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_embeddings_take_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(3, None), (4, [1.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(one).collect()) == [(3, 0, 3), (4, 1, 4), (5, 1, 4)]


def test_bpe_query_digests(spark, small):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.multi_language_vocabulary()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in bpe.op2_bpe_encoding(spark, small).collect():
        ids = other.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_tiles_give_fewer_rows_than_they_read(spark, monkeypatch):
    """Without first links, every link comes from the tiles: those that join components, not all pairs."""
    monkeypatch.setattr(jaccard, "STAR", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 2_000)
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(150)]
    texts = [" ".join([*passage[: k % 15 + 120], *(f"a{rng.randrange(10**6)}" for _ in range(6 + k % 13))]) for k in range(60)]
    texts += texts[:5]
    docs = docs_of(spark, texts).union(docs_of(spark, texts[:3]))
    made, written, checked = [], jaccard.written, jaccard._checked
    monkeypatch.setattr(jaccard, "written", lambda df, name: made.append((name, written(df, name))) or made[-1][1])
    monkeypatch.setattr(jaccard, "_checked", lambda *x: checked(*x) if any(name == "held" for name, _ in made) else checked(*x).withColumn("linked", F.lit(False)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    sets = [shingle_set(x) for x in texts]
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 8 * len(texts)
    assert [got[i] for i in range(len(texts))] == components_of(len(texts), links)
    counts = {name: df.count() for name, df in made if name in ("tiled", "near", "joined")}
    assert 0 < counts["joined"] < counts["near"] <= counts["tiled"]


def test_joining_gives_a_forest_of_the_linked_pairs():
    rng = np.random.default_rng(21)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < share], rng.integers(0, 2**63, 25).astype(np.uint64)])) for share in np.linspace(0.6, 1, 70)]
    sets.append(np.unique(np.concatenate([base, rng.integers(0, 2**63, jaccard.FINE).astype(np.uint64)])))
    sizes, labels = np.array([len(x) for x in sets]), np.arange(len(sets)) // 2
    a, b = (np.array(x) for x in zip(*combinations(range(len(sets)), 2), strict=True))
    linked = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if 100 * (both := len(np.intersect1d(sets[x], sets[y]))) >= 80 * (sizes[x] + sizes[y] - both)]
    same = [(x, x + 1) for x in range(0, len(sets) - 1, 2)]
    label = labels.copy()
    left, right = jaccard.joining(sets, [jaccard.fine_groups(x) for x in sets], sizes, label, np.append(a, b), np.append(b, a))
    found = list(zip(left, right, strict=True))
    expected = components_of(len(sets), linked + same)
    assert set(found) <= set(linked) and len(found) == len(set(labels.tolist())) - len(set(expected))
    assert len(found) < len(linked) / 4 and components_of(len(sets), found + same) == expected
    assert [[x == y for y in label] for x in label] == [[x == y for y in expected] for x in expected]
    none = np.empty(0, np.int64)
    assert jaccard.joining([], [], none, none, none, none) == ([], [])


def test_small_tables_of_mixing_start_no_python_workers(spark):
    """Rows of the driver go to the executors without a Python job of their own."""
    got = mixing._small(spark, [(1.0, 0.5), (2, 1)], {"w": mixing.pa.float64(), "part": mixing.pa.int64()})
    assert got.dtypes == [("w", "double"), ("part", "bigint")] and sorted(map(tuple, got.collect())) == [(0.5, 1), (1.0, 2)]
    assert "PythonRDD" not in got._jdf.queryExecution().toRdd().toDebugString()


def test_bpe_chunks_by_bytes_are_those_of_the_pattern():
    rng = random.Random(5)
    parts = [*"\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\u200b\u3001\x1c\x00\t\n€éÂ😀", "th", "'s", "!", "\r\n", *[" ", "a"] * 12]
    for _ in range(800):
        texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 2, 3, 5, 30]))) for _ in range(rng.randint(0, 6))]
        bounds, chunks = bpe.chunks_of(bpe.pa.array(["before", *texts]).slice(1))
        assert [chunks.to_pylist()[a:b] for a, b in itertools.pairwise(bounds)] == [bpe._CHUNK.findall(x) for x in texts]


def test_bpe_new_pieces_fill_their_tables_together(monkeypatch):
    """Short pieces that are new cost no table each; ids are those of a table each, with few places for pairs too."""
    path, pattern = bpe.multi_language_vocabulary()
    ranks, rng = bpe.load_ranks(path), random.Random(12)
    parts = ["a", "th", "ing", "tion", "é", "ß", "文", "😀", "9", "_", "qu", "\x00", "\u0301", "λ"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    texts = [*(" ".join(words[k : k + 50]) + rng.choice([",", "'s!", "\u2003", "aaab" * 40]) for k in range(0, 3000, 50)), "", "don't  ", " "]
    plain = bpe.TextEncoder(ranks, pattern)
    expected = [plain.encode(x).tolist() for x in texts]
    for remember in (bpe.REMEMBER, 300):
        encoder, alone = bpe.TextEncoder(ranks, pattern, remember), []
        monkeypatch.setattr(encoder.pieces_encoder, "encode", lambda x, old=encoder.pieces_encoder.encode, alone=alone: alone.append(x) or old(x))
        for group in (texts, texts[::-1], texts[:1], []):
            ids, offsets = encoder.encode_all(bpe.pa.array(group, bpe.pa.string()))
            got = bpe.pa.ListArray.from_arrays(offsets, ids).to_pylist()
            assert got == (expected if group is texts else expected[::-1] if len(group) > 1 else expected[: len(group)])
            assert [x.decode() for x in encoder.decode_all(ids, offsets).to_pylist()] == group
            if group is texts:
                assert all(len(x) > bpe.SHORT_BYTES for x in alone)


def test_bpe_without_decoding(spark):
    path, pattern = bpe.multi_language_vocabulary()
    docs = docs_of(spark, [None, "Hello there.", "one two"])
    whole, ids = (bpe.tokenize(docs, path, pattern, decode=x) for x in (True, False))
    assert ids.columns == [c for c in whole.columns if c != "decoded"]
    assert sorted(map(str, ids.collect())) == sorted(map(str, whole.drop("decoded").collect()))
