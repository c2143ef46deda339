"""Fill-in-the-middle, vector codes and top-k search against plain versions, with nulls, ties, repeats, extremes and clashing names."""

from __future__ import annotations

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import codes, embeddings, infill, search

VECTORS = "vec_id long, embedding array<double>, label int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_infill(doc_id, text, rate=100, spm=50, seed="7"):
    """The contract, line by line."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", "\n", "\n\n\n", "one line", "one\n", "a\nb", "a\r\nb\r\n", "x <P> y\nz", "<M>", "<P", "S>\n<", "<\n<P\n>", "é\n漢字\n🙂🙂\nz", "\n".join(f"line {k}" for k in range(3_000)), "w" * 300_000, "a\n" * 50_000, "\x0b\x0c \x85\n-"]


@pytest.mark.parametrize(("rate", "spm", "seed"), [(100, 50, "7"), (40, 0, "x"), (100, 100, "7")])
def test_infill_equals_the_plain_version(spark, rate, spm, seed):
    rows = [(8 * k + j, x, "kept") for k, x in enumerate(TEXTS) for j in range(8)] + [(None, "a\nb\nc", "kept"), (3, "a\nb", "kept"), (3, "a\nb", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").withColumns({c: F.lit(c) for c in ("made", "c0", "a.b", "__text")})
    settings = infill.Settings(rate=rate, spm=spm, seed=seed)
    out = infill.transform(docs, settings=settings)
    assert sorted(out.columns) == sorted([*[c for c in docs.columns if c != "form"], *infill.ADDED])
    out = out.withColumn("again", infill.restored(F.col("output"), F.col("form"), settings)).collect()
    got = sorted((str(r["doc_id"]), r["n_units"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in out)
    want = sorted((str(i), n, form, str(a), str(b), x) for i, text, _ in rows for n, form, a, b, x in [plain_infill(i, text, rate, spm, seed)])
    assert got == want
    assert all(r["again"] == (r["text"] or "") and r["made"] == "made" and r["a.b"] == "a.b" and r["c0"] == "c0" for r in out)
    assert {r["form"] for r in out} >= {"plain", "psm" if spm < 50 else "spm"}


def test_infill_units_markers_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, "one two  three four") for k in range(60)], "doc_id long, text string")
    settings = infill.Settings(unit=r"\S+\s*", prefix="[pre]", suffix="[suf]", middle="[mid]")
    out = infill.transform(docs, settings=settings).withColumn("again", infill.restored(F.col("output"), F.col("form"), settings)).collect()
    assert {r["n_units"] for r in out} == {4} and {r["prefix_chars"] for r in out} == {0, 4, 9, 15, 19}
    assert all(r["again"] == r["text"] and "[mid]" in r["output"] for r in out)
    assert infill.transform(docs.limit(0)).count() == 0
    assert spark.range(1).select(infill.restored(F.lit(None).cast("string"), F.lit("psm")), infill.digest(F.lit(None).cast("string"))).first() == (None, None)
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("", "b", "c"), ("xay", "a", "c")):
        with pytest.raises(ValueError):
            infill.transform(docs, settings=infill.Settings(prefix=bad[0], suffix=bad[1], middle=bad[2]))


def test_infill_query_is_exact(spark, small):
    got = {r["doc_id"]: r for r in infill.op11_fill_in_middle(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        n, form, a, b, output = plain_infill(r["doc_id"], r["text"])
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], n, form, a, b, sha(output), sha(r["text"] or ""))


def ok(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract in Python's integers: {position of the row: (code, error)} and the codebooks."""
    kept = [(k, i, [math.floor(scale * x) if abs(x) < 1e200 else int(x) * scale for x in v]) for k, (i, v, _) in enumerate(rows) if ok(v)]
    kept = [(k, i, [max(-codes.HELD, min(codes.HELD, x)) for x in v]) for k, i, v in kept]
    first: dict = {}
    for _, i, v in kept:
        first[i] = min(first.get(i, v), v)
    ids = sorted(first, key=lambda i: (i is None, i or 0))
    if not ids:
        return {}, []
    dims = len(first[ids[0]])
    fits = [(k, v) for k, _, v in kept if len(v) == dims]
    ids = [i for i in ids if any(j == i and len(v) == dims for _, j, v in kept)]
    first = {i: min(v for _, j, v in kept if j == i and len(v) == dims) for i in ids}
    ends = [dims * (p + 1) // parts for p in range(parts)]
    spans = list(zip([0, *ends], ends, strict=False))
    books = [[first[i][a:b] for i in ids[:entries]] for a, b in spans]

    def named(v):
        return [min((sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)), j) for j, e in enumerate(books[p])) for p, (a, b) in enumerate(spans)]

    for _ in range(rounds):
        chosen: dict = {}
        for _, v in fits:
            for p, (_, j) in enumerate(named(v)):
                chosen.setdefault((p, j), []).append(v[spans[p][0] : spans[p][1]])
        for (p, j), own in chosen.items():
            books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = {k: (None, None) for k, _, _ in kept}
    for k, v in fits:
        found = named(v)
        out[k] = ("".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found))
    return out, books


def cloud(n, dims, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (6, dims))
    vectors = (centres[rng.integers(0, 6, n)] + rng.normal(0, 0.02, (n, dims))).tolist()
    rows = [(3 * k + 1, v, k % 3 if k % 7 else None) for k, v in enumerate(vectors)]
    grid = rng.integers(-1, 2, (40, dims)).astype(float).tolist()  # many equal distances
    rows += [(1_000 + k, v, 9) for k, v in enumerate(grid)]
    odd = [None, [None] * dims, [float("nan")] + [0.0] * (dims - 1), [float("inf")] * dims, [float("-inf")] + [1.0] * (dims - 1)]
    rows += [(2_000 + k, v, 1) for k, v in enumerate(odd)]
    return [*rows, rows[0], rows[1], (None, vectors[2], None)]


@pytest.mark.parametrize(("dims", "extra"), [(16, []), (19, []), (16, [1e6, -3e9]), (16, [1e30, -1e300]), (5, [])])
def test_codes_equal_the_plain_version(spark, dims, extra):
    rows = cloud(80, dims) + [(5_000 + k, [x] * dims, 4) for k, x in enumerate(extra)] + [(7_000, [0.5] * (dims + 1), 4), (7_001, [], 4)]
    vectors = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], VECTORS + ", at int").withColumns({c: F.lit(c) for c in ("code", "v", "e", "c1", "x.y")}).repartition(3)
    books = codes.fit(vectors)
    out = codes.encode(vectors, books)
    assert sorted(out.columns) == sorted([*[c for c in vectors.columns if c != "code"], "code", "error"])
    got, (want, entries) = {r["at"]: r for r in out.collect()}, plain_codes(rows)
    assert books.entries == entries
    assert got.keys() == want.keys() and all(r["x.y"] == "x.y" and r["v"] == "v" and r["c1"] == "c1" for r in got.values())
    for k, (code, error) in want.items():
        assert got[k]["code"] == code
        assert got[k]["error"] == (error if error is None or error < 2**63 else None)
    sums: dict = {}
    for k, (_, error) in want.items():
        if error is not None and error < 2**63:
            sums[rows[k][2]] = sums.get(rows[k][2], 0) + error
    labelled = codes.errors_by(out.select("at", "label", "error"))
    assert {r["at"]: r["label_error"] for r in labelled.collect()} == {k: sums.get(rows[k][2]) if sums.get(rows[k][2], 0) < 2**63 else None for k in want}
    back = codes.decode(out.filter("code IS NOT NULL"), books).first()["decoded"]
    assert len(back) == dims


def test_codes_of_few_and_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    books = codes.fit(empty)
    assert codes.encode(empty, books).count() == 0 and books.entries == [[]] * 8
    nothing = spark.createDataFrame([(1, None, 2)], VECTORS)
    assert codes.encode(nothing, codes.fit(nothing)).count() == 0
    rows = [(2, [0.25] * 8, None), (2, [0.5] * 8, None), (1, [-1.0] * 8, 3)]
    few = spark.createDataFrame(rows, VECTORS)
    got = sorted((r["code"], r["error"]) for r in codes.encode(few, codes.fit(few)).collect())
    assert got == sorted(plain_codes(rows)[0].values())
    with pytest.raises(ValueError):
        codes.fit(few, entries=300)


def test_codes_with_other_parameters(spark):
    rows = cloud(60, 12, seed=8)
    vectors = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], VECTORS + ", at int")
    books = codes.fit(vectors, parts=3, entries=40, rounds=2, scale=64)
    want, entries = plain_codes(rows, parts=3, entries=40, rounds=2, scale=64)
    assert books.entries == entries
    assert {r["at"]: (r["code"], r["error"]) for r in codes.encode(vectors, books, scale=64).collect()} == want


@pytest.mark.parametrize("wide", [False, True])
def test_a_tree_finds_the_lowest_of_the_nearest(wide):
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 16, 200):
        entries = rng.integers(-2, 3, (k, 4)) * (2**40 if wide else 1)
        points = rng.integers(-3, 4, (300, 4)) * (2**40 if wide else 1)
        index, d2 = codes.Tree(entries.tolist()).nearest(points)
        for p, i, d in zip(points.astype(object), index.tolist(), d2.tolist(), strict=True):
            assert (d, i) == min((sum((p - e) ** 2), j) for j, e in enumerate(entries.astype(object)))


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 2)
    coded = spark.createDataFrame([(k, k % 5 or None, 10 * k) for k in range(50)], "vec_id long, label int, error long")
    got = {r["vec_id"]: r["label_error"] for r in codes.errors_by(coded).collect()}
    assert got == {k: sum(10 * j for j in range(50) if j % 5 == k % 5) for k in range(50)}


def plain_top(queries, candidates, k, scale=256):
    """Every query row against every candidate, in Python's integers."""
    held = search.HELD
    ints = lambda v: [max(-held, min(held, math.floor(scale * x) if abs(x) < 1e200 else int(x) * scale)) for x in v]
    asked = {(i, tuple(ints(v))) for i, v, _ in queries if i is not None and ok(v)}
    there = [(i, ints(v)) for i, v, _ in candidates if i is not None and ok(v)]
    out = []
    for i, q in asked:
        scored = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in there if j != i)
        out += [(i, rank, j, -s if abs(s) < 2**63 else None) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "block", "fan", "extra"), [(5, 8_192, 64, []), (3, 7, 2, []), (5, 50, 2, [1e7, -2e9]), (4, 50, 64, [1e30, -1e300]), (500, 30, 3, [])])
def test_top_k_equals_brute_force(spark, monkeypatch, k, block, fan, extra):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "FAN", fan)
    monkeypatch.setattr(search, "QUERY_ROWS", 9)
    rows = cloud(120, 8) + [(5_000 + j, [x] * 8, 4) for j, x in enumerate(extra)] + [(7_000, [0.5] * 11, 4), (7_001, [], 4), (7_002, [0.0] * 8, 4), (7_004, [0.001] + [0.0] * 7, 1)]
    vectors = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(c) for c in ("v", "id", "place", "score", "x.y")}).repartition(7)
    queries = [r for r in rows if r[0] is None or r[0] % 5 == 0 or r[0] >= 7_000 or r[0] == 1]
    got = search.top(spark.createDataFrame(queries, VECTORS), vectors, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_top(queries, rows, k)


def test_top_k_of_equal_and_of_no_rows(spark):
    same = spark.range(20_000).selectExpr("id AS vec_id", "array(0.5D, 0.25D) AS embedding", "1 AS label")
    got = search.top(same.filter("vec_id IN (0, 3, 19999)"), same).collect()
    assert sorted(tuple(r) for r in got) == sorted((q, r, j, 128 * 128 + 64 * 64) for q in (0, 3, 19_999) for r, j in enumerate([j for j in range(7) if j != q][:5], 1))
    empty = same.limit(0)
    assert search.top(empty, same).count() == 0 and search.top(same.limit(3), empty).count() == 0
    assert search.top(same.limit(1), same.limit(1)).count() == 0


@pytest.mark.parametrize("module", [infill, codes, search])
def test_queries_equal_their_sql(spark, small, module):
    connection = duckdb.connect()
    for t in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, run in module.QUERIES.items():
        got, want = run(spark, small).toPandas(), connection.sql(module.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns) and len(got)
        plain = lambda df: sorted(tuple("" if x is None or x != x else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False))
        assert plain(got) == plain(want)


def test_vectors_that_fill_their_dimensions_meet_in_tiles_once(spark, monkeypatch):
    """Where cells hold more pairs than all vectors do, tiles are not copied for each pair of them, and links are the same."""
    used, plain = [], embeddings._plain_links
    monkeypatch.setattr(embeddings, "WHOLE", 100)
    monkeypatch.setattr(embeddings, "_plain_links", lambda classes, lengths, *a: (used.append(lengths), plain(classes, lengths, *a))[1])
    rng = np.random.default_rng(9)
    rows = []
    for dims, n in ((32, 400), (24, 250), (3, 150)):
        v = rng.normal(size=(n, dims))
        near = v[: n // 3] + rng.normal(scale=0.22, size=(n // 3, dims))
        rows += [*v, *near, *(2 * v[:5]), *v[:7]]
    order = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(i, [float(x) for x in rows[k]]) for i, k in enumerate(order)] + [(9_000, None), (9_001, [0.0] * 32)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df.repartition(5)).collect()}
    assert len(used) == 1 and 32 in used[0] and 3 not in used[0]
    unit = [rows[k] / np.linalg.norm(rows[k]) for k in order]
    links = [[j for j in range(len(order)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(order))]
    root: dict = {}
    for i in range(len(order)):
        todo = [] if i in root else [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += links[k]
    assert got == {i: (len(links[i]), root[i], root[i] == i) for i in range(len(order))} | {i: (0, i, True) for i in (9_000, 9_001)}
