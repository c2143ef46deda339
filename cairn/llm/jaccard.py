"""N-gram Jaccard join: documents whose sets of word 5-grams are at least 0.8 alike, by their group counts.

A document's set is hashed into groups; the counts per group are its point. Two sets of a and b shingles can share no
more than the sum of the smaller count of each group, and they link only if they share at least 4 (a + b) / 9, so their
symmetric difference is (a + b) / 9 at most.

1. Routing. Sizes fall into bands (powers of two); a band's sets are cut into as many fine groups, by ranges of the
   shingle hash, that linked sets differ in fewer groups than the smaller one emits: the first a // 4 + 1 groups that are
   not empty. So they agree, shingle by shingle, in one of these at least, and the group's signature is the key that
   brings them together. A set within 4/5 of its band's upper end emits to the next band too. Sets under 20 shingles, and the
   few with too many empty groups, emit their a // 5 + 1 smallest hashes instead (no set of the other kind needs those).
   Keys travel packed, a few large binary rows for each task, and a task emits the keys of equal sets once. A key that a
   task meets in more than STAR sets is settled there: its sets hang on the smallest of them, and only that one goes on, so
   that no key of many sets ever meets in one task.
2. First links. All sets of a key are compared with its smallest one only (or with their task's, which is compared with
   that): the coordinate bound drops pairs, the rest are verified on whole sets. Connected sets need nothing more.
3. The rest. Keys that still hold sets of several components go to a packed R-tree over the group counts (large keys
   in pairs of tiles): nodes bound the overlap by summed minima with their largest counts and are skipped where all of
   theirs are connected already. What survives, sets of up to FINE shingles, is bounded once more by counts of FINE_GROUPS
   groups, of which a set lists those it fills. A set comes to its tiles once for all of their keys. Of tiles, the sets that
   are left in pairs come out, not the pairs; then these alone come as whole sets, pairs are verified where they meet, and a
   link joins its components there at once. So neither step gives more rows than it reads. Components are formed again.

Every pair that can link is compared or already connected, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import arrow_rows, release, table, written
from cairn.llm.components import connected_components

WORDS = 5
#: Coordinates of a point, and of its coarse form in the tree; sets under SMALL emit hashes, from BAND on they emit fine
#: groups (both between them).
GROUPS, COARSE, SMALL, BAND = 512, 64, 20, 16
#: Groups of the last bound, and the most shingles of a set that lists its own of them.
FINE_GROUPS, FINE = 1 << 16, 2_048
#: Beyond so many shingles counts may not fit a byte, and sizes alone decide what is verified.
LARGE = 60_000
#: Words that a worker remembers, keys that a task packs at once, sets of a key in one pack from which it is settled there,
#: sets of one key that are compared in one tile, sets that are verified against one, keys of the same sets that are worked
#: at once (keys of the same sets find the same pairs, which are verified once then; ALIKE_ROWS bounds their rows), the most rows of a table of ids that is broadcast, and rows of a batch of texts.
MEMO_WORDS, PACK_KEYS, STAR, TILE, FAN, ALIKE, ALIKE_ROWS, BROADCAST_ROWS, BATCH_ROWS = 50_000, 500_000, 8, 2_000, 64, 16, 12_000, 500_000, 500
#: Characters whose keys and documents meet in one part, and rows of tiles and shingles of their sets that meet in one slot
#: about: the numbers of parts and slots follow from the input. Shingles of a tile's sets, bytes of sets in a batch.
PART_CHARS, SLOT_ROWS, SLOT_SHINGLES, TILE_SHINGLES, BATCH_BYTES = 32_000_000, 20_000, 6_000_000, 2_000_000, 4_000_000
_U = np.uint64
_STEP, _MIX_A, _MIX_B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX_A
    x = (x ^ (x >> _U(27))) * _MIX_B
    return x ^ (x >> _U(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of five words (of all its words, if they are fewer)."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    value = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        value = value * _STEP + codes[k : n - width + 1 + k]
    return np.unique(_mix(value))


def signature(hashes: np.ndarray) -> int:
    """An order-free signature of a set."""
    return int(np.add.reduce(_mix(hashes + _STEP)) ^ _U(len(hashes)))


def point(hashes: np.ndarray) -> np.ndarray:
    """Group counts as bytes. A set with a count beyond a byte gets the largest point, which bounds nothing but its size."""
    counts = np.bincount((hashes & _U(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return (counts if counts.max() < 256 else np.full(GROUPS, 255)).astype(np.uint8)


def _fine_groups(upper: int) -> int:
    """Fine groups of the band whose sets have fewer than `upper` shingles: linked sets fill enough of them."""
    return int(upper / 4 * 1.15) + 5


def _group_keys(hashes: np.ndarray, band: int) -> tuple[np.ndarray, bool]:
    """The keys of the first groups that are not empty, and whether there were enough of those."""
    group = ((hashes >> _U(32)) * _U(_fine_groups(BAND << (band + 1)))) >> _U(32)
    first = np.flatnonzero(np.diff(group, prepend=_U(1 << 40)))
    need = len(hashes) // 4 + 1
    filled = len(first) >= need
    end = first[need] if len(first) > need else len(hashes)
    first = first[:need]
    sums = np.add.reduceat(_mix(hashes[:end] ^ _STEP), first)
    return _mix(sums + (group[first] + (_U(band + 1) << _U(32))) * _MIX_A), filled


def keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set: two sets that link share one at least."""
    n = len(hashes)
    found, enough = [], n >= SMALL
    if n >= BAND:
        band = (n // BAND).bit_length() - 1
        bands = [band, band + 1] if 5 * n >= 4 * (BAND << (band + 1)) else [band]
        for x in bands:
            own, filled = _group_keys(hashes, x)
            found.append(own)
            enough &= filled
    if n and not enough:
        found.append(_mix(hashes[: n // 5 + 1] + _MIX_B))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _by_key(key: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, sig) in order; of each its key's smallest sig, and how many that key has."""
    order = np.lexsort((sig, key))
    key, sig = key[order], sig[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
    key, sig = key[fresh], sig[fresh]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    sizes = np.diff(np.append(starts, len(key)))
    return key, sig, np.repeat(sig[starts], sizes), np.repeat(sizes, sizes)


def _analysed(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of documents (doc_id, n, sig, point), of packed keys and of packed stars, each with a part, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        found: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = dealt = 0

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal size, dealt
            key, sig, pivot, number = _by_key(np.concatenate(found), np.concatenate(owners))
            found.clear(), owners.clear()
            size = 0
            here = (number > STAR) & (sig != pivot)  # of these the pivot alone goes on
            stars = np.stack([key[here], pivot[here], sig[here]])
            cut = [stars[:, k : k + PACK_KEYS // 50] for k in range(0, stars.shape[1], PACK_KEYS // 50)]
            if cut:
                part = [(dealt + k) % parts for k in range(len(cut))]
                dealt += len(cut)
                yield _rows(None, None, None, None, part, None, [x.tobytes() for x in cut], len(cut))
            key, sig = key[~here], sig[~here]
            part = ((key >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)  # in order, as keys are
            ends = np.cumsum(np.bincount(part, minlength=parts))
            both = np.stack([key, sig])
            rows = [(k, both[:, a:b].tobytes()) for k, (a, b) in enumerate(zip(np.append(0, ends), ends, strict=False)) if b > a]
            yield _rows(None, None, None, None, [k for k, _ in rows], [x for _, x in rows], None, len(rows))

        for batch in batches:
            n, sig, points = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text)
                n.append(len(hashes))
                sig.append(signature(hashes) if len(hashes) else 0)
                points.append(point(hashes))
                if len(hashes) and sig[-1] not in seen:
                    seen.add(sig[-1])
                    found.append(keys(hashes))
                    owners.append(np.full(len(found[-1]), sig[-1], np.uint64))
                    size += len(found[-1])
                    if size >= PACK_KEYS:
                        yield from pack()
            packed = [x.tobytes() for x in points]
            part = (np.arange(dealt, dealt + len(n)) % parts).astype(np.int32)  # documents ride along, evenly
            dealt += len(n)
            yield _rows(batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array(packed, pa.binary()), part, None, None, len(n))
        if size:
            yield from pack()
        _words.clear()
        release()

    return docs.mapInArrow(run, "doc_id long, n long, sig long, point binary, part int, packed binary, stars binary")


def _rows(doc_id, n, sig, points, part, packed, stars, count: int) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
    names = ("doc_id", "n", "sig", "point", "part", "packed", "stars")
    columns = [pa.nulls(count, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip((doc_id, n, sig, points, part, packed, stars), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def _unpacked(column: pa.ChunkedArray, rows: int) -> list[np.ndarray]:
    chunks = [np.frombuffer(x, np.uint64).reshape(rows, -1) for x in column.to_pylist() if x is not None]
    return [np.concatenate([np.empty(0, np.uint64), *(x[k] for x in chunks)]) for k in range(rows)]


def _members(group: pa.Table) -> pa.Table:
    """A part's documents as they are and, of its keys, those of several sets: the key, its smallest set, each other one; stars too."""
    docs = group.filter(group.column("n").is_valid())
    key, sig, pivot, _ = _by_key(*_unpacked(group.column("packed"), 2))
    several = sig != pivot
    made = [np.concatenate([x, y[several]]) for x, y in zip(_unpacked(group.column("stars"), 3), (key, pivot, sig), strict=True)]
    keys = {c: x.view(np.int64) for c, x in zip(("key", "pivot", "sig"), made, strict=True)}
    return pa.concat_tables([pa.table(keys), docs.select(["doc_id", "n", "sig", "point"])], promote_options="default").select(["doc_id", "n", "sig", "point", "key", "pivot"])


def overlap_bound(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The most shingles that sets with these group counts can share: summed coordinate minima."""
    return np.minimum(one, two).sum(axis=-1, dtype=np.int64)


def _points(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, GROUPS)


def _bounded(points: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of positions the bound lets through, a bounded number at a time."""
    parts = []
    for k in range(0, len(a), 4096):
        x, y = a[k : k + 4096], b[k : k + 4096]
        parts.append((9 * overlap_bound(points[x], points[y]) >= 4 * (sizes[x] + sizes[y])) | (sizes[x] > LARGE))
    return np.concatenate(parts) if parts else np.zeros(0, bool)


class _Tree:
    """A packed R-tree of one level over coarse points, in order of label, size and leading counts."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = 32):
        self.rows = rows[np.lexsort((points[rows, 1], points[rows, 0], sizes[rows], labels[rows]))]
        self.starts = np.arange(0, len(rows), leaf)
        self.ends = np.minimum(self.starts + leaf, len(rows))
        self.top = np.maximum.reduceat(points[self.rows], self.starts, axis=0)
        (self.least, self.low), (self.most, self.high) = ([f.reduceat(x[self.rows], self.starts) for x in (sizes, labels)] for f in (np.minimum, np.maximum))


def tree_pairs(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of positions) with different labels that the bound lets through, one end in `left` and one outside it, or
    any two where `left` holds all."""
    whole = bool(left.all())
    coarse = points.reshape(len(points), COARSE, -1).sum(axis=2, dtype=np.int16)
    mine = np.flatnonzero(left)
    others = mine if whole else np.flatnonzero(~left)
    none = np.empty(0, np.int64)
    if not len(mine) or not len(others):
        return none, none
    query = _Tree(coarse, sizes, labels, mine)
    index = query if whole else _Tree(coarse, sizes, labels, others)
    a, b = [none], [none]
    for q, (start, end) in enumerate(zip(query.starts, query.ends, strict=True)):
        near = (5 * query.most[q] >= 4 * index.least) & (5 * index.most >= 4 * query.least[q])
        near &= ~((index.low == index.high) & (query.low[q] == query.high[q]) & (index.low == query.low[q]))
        if whole:
            near[:q] = False
        nodes = np.flatnonzero(near)
        nodes = nodes[(9 * overlap_bound(index.top[nodes], query.top[q]) >= 4 * (query.least[q] + index.least[nodes])) | (index.most[nodes] > LARGE)]
        if not len(nodes):
            continue
        x = query.rows[start:end]
        y = index.rows[np.concatenate([np.arange(index.starts[k], index.ends[k]) for k in nodes])]
        ok = (5 * sizes[x][:, None] >= 4 * sizes[y]) & (5 * sizes[y] >= 4 * sizes[x][:, None]) & (labels[x][:, None] != labels[y])
        if whole and nodes[0] == q:
            ok[:, : end - start] &= np.tri(end - start, k=-1, dtype=bool).T
        r, c = np.nonzero(ok)
        keep = _bounded(coarse, sizes, x[r], y[c])
        a.append(x[r[keep]]), b.append(y[c[keep]])
    a, b = np.concatenate(a), np.concatenate(b)
    keep = _bounded(points, sizes, a, b)
    return a[keep], b[keep]


def few_pairs(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same within each of many short runs of positions, all runs at once."""
    first = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rest = np.repeat(starts + lengths, lengths) - first - 1
    a = np.repeat(first, rest)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(rest) - rest, rest)
    ok = (labels[a] != labels[b]) & (5 * sizes[a] >= 4 * sizes[b]) & (5 * sizes[b] >= 4 * sizes[a])
    a, b = a[ok], b[ok]
    keep = _bounded(points, sizes, a, b)
    return a[keep], b[keep]


def fine_groups(hashes: np.ndarray) -> np.ndarray:
    """The groups that a set's shingles fall into, one for each shingle; none for a set of more than FINE."""
    return ((hashes >> _U(16)) & _U(FINE_GROUPS - 1)).astype(np.uint16) if len(hashes) <= FINE else np.empty(0, np.uint16)


def sharper(fine: list[np.ndarray], sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of positions can share enough: at most as many shingles as b has in groups that a fills too."""
    ok = np.ones(len(a), bool)
    if not len(a):
        return ok
    order = np.argsort(a, kind="stable")
    mark = np.zeros(FINE_GROUPS, bool)
    starts = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))
    for s, e in zip(starts, np.append(starts[1:], len(a)), strict=True):
        own = fine[a[order[s]]]
        rows = order[s:e][sizes[b[order[s:e]]] <= FINE]
        if not len(own) or not len(rows):
            continue
        mark[own] = True
        lists = [fine[k] for k in b[rows]]
        hits = np.add.reduceat(mark[np.concatenate(lists)], np.cumsum([0, *map(len, lists)])[:-1], dtype=np.int64)
        mark[own] = False
        ok[rows] = 9 * hits >= 4 * (sizes[a[rows]] + sizes[b[rows]])
    return ok


def joining(hashes: list[np.ndarray], fine: list[np.ndarray], sizes: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of pairs of positions, those whose whole sets link and whose labels differ by then: label changes as links join them, so
    there are fewer of these than labels."""
    left, right = [], []
    if not len(a):
        return left, right
    a, b = np.divmod(np.unique(np.minimum(a, b) * len(sizes) + np.maximum(a, b)), len(sizes))
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    for s, e in zip(starts.tolist(), np.append(starts[1:], len(a)).tolist(), strict=True):
        x = int(a[s])
        for k in range(s, e, FAN):
            y = b[k : min(k + FAN, e)]
            y = y[label[y] != label[x]]
            y = y[sharper(fine, sizes, np.full(len(y), x), y)]
            if not len(y):
                continue
            own, other = hashes[x], np.concatenate([hashes[v] for v in y.tolist()])
            same = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
            both = np.add.reduceat(same, np.cumsum([0, *sizes[y]])[:-1], dtype=np.int64)
            for v in y[100 * both >= 80 * (sizes[x] + sizes[y] - both)].tolist():
                if label[v] != label[x]:
                    left.append(x), right.append(v)
                    label[label == label[v]] = label[x]
    return left, right


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b of signatures) with `linked`: whether their whole sets are 0.8 alike. Sets come from the texts again,
    from one document of each in a pair (an id may have other texts: the signature tells them), and meet in groups of one
    set and at most FAN others."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("fans"))
    fans = pairs.join(spread, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("fans")).alias("fan"))
    needs = fans.select("a", "fan", F.col("b").alias("need")).union(fans.select("a", "fan", F.col("a").alias("need")).distinct())
    needs = written(needs.join(classes.select(F.col("sig").alias("need"), "rep"), "need"), "needs")
    small = needs.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(needs) if small else needs, docs["doc_id"] == needs["rep"]).select("a", "fan", "need", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(x) for x in batch.column(3).to_pylist()]
            own = np.array([signature(x) if len(x) else 0 for x in hashes], np.uint64).view(np.int64)
            rows = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in hashes], pa.binary())], ["a", "fan", "need", "hashes"])
            yield rows.filter(pa.array(own == batch.column(2).to_numpy()))
        _words.clear()
        release()

    def compare(group: pa.Table) -> pa.Table:
        a, need = group.column("a")[0].as_py(), group.column("need").to_pylist()
        own = {k: np.frombuffer(x, np.uint64) for k, x in zip(need, group.column("hashes").to_pylist(), strict=True)}
        others = [k for k in own if k != a]
        pivot, linked = own[a], []
        for k in others:
            both = len(np.intersect1d(pivot, own[k], assume_unique=True))
            linked.append(100 * both >= 80 * (len(pivot) + len(own[k]) - both))
        return pa.table({"a": pa.array([a] * len(others), pa.int64()), "b": pa.array(others, pa.int64()), "linked": pa.array(linked, pa.bool_())})

    return texts.mapInArrow(sets, "a long, fan long, need long, hashes binary").groupBy("a", "fan").applyInArrow(compare, "a long, b long, linked boolean")


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return written(_verified(written(pairs, "pairs"), classes, docs), "links")


def _bounded_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of signatures without those that sizes or the overlap bound rule out."""
    x = classes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    y = classes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    joined = pairs.join(x, "a").join(y, "b").filter("5 * na >= 4 * nb AND 5 * nb >= 4 * na").select("a", "b", "na", "nb", "pa", "pb")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            one, two = (_points(batch.column(k).to_pylist()) for k in (4, 5))
            yield batch.select([0, 1]).filter(pa.array((9 * overlap_bound(one, two) >= 4 * (na + nb)) | (na > LARGE)))

    return joined.mapInArrow(bound, "a long, b long")


def _sets_by_slot(tiled: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, whole: bool) -> DataFrame:
    """(slot, doc, label, n, point, own) of each slot of a doc in tiled; own: its hashes if whole, else its fine groups. Sets
    come from the texts again, made once for all slots."""
    uses = tiled.groupBy("doc").agg(F.collect_set("slot").alias("slots")).join(labels.select("doc", "label"), "doc")
    uses = written(uses.join(classes.select(F.col("sig").alias("doc"), "rep"), "doc"), "uses")
    small = uses.agg(F.coalesce(F.sum(F.size("slots")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(uses) if small else uses, docs["doc_id"] == uses["rep"]).select("doc", "label", "slots", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a row may be repeated
        rows: list[tuple] = []
        size = 0

        def cut() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["slot", "doc", "label", "n", "point", "own"])
            rows.clear()
            size = 0
            return out

        for batch in batches:
            for doc, label, slots, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = shingles(text)
                if doc in seen or not len(hashes) or np.uint64(signature(hashes)).view(np.int64) != doc:
                    continue
                seen.add(doc)
                counts, own = point(hashes).tobytes(), (hashes if whole else fine_groups(hashes)).tobytes()
                for slot in slots:
                    rows.append((slot, doc, label, len(hashes), counts, own))
                    size += GROUPS + len(own)
                    if size >= BATCH_BYTES:
                        yield cut()
        if rows:
            yield cut()
        _words.clear()
        release()

    return texts.mapInArrow(run, "slot int, doc long, label long, n long, point binary, own binary")


def _tiled_links(held: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of keys' sets (key, doc; labels has a doc's label and n), links between sets of different labels: of each slot of tiles
    as many as join the labels that links there can join. So a slot gives fewer rows than it reads."""
    weighed = held.join(labels.select("doc", "n"), "doc").groupBy("key").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"), F.min("doc").alias("low"))
    tiles = F.least("sets", F.greatest(F.ceil(F.col("sets") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES))).cast("int")
    sizes = written(weighed.withColumn("tiles", tiles), "sets")
    # keys of the same documents are worked together, a few at a time, so that a pair is compared few times
    share = [F.ceil(F.sum(F.col(c) / F.col("tiles")) / most) for c, most in (("sets", ALIKE_ROWS), ("shingles", SLOT_SHINGLES))]
    alike = sizes.groupBy("low", "tiles").agg(F.greatest(F.ceil(F.count("*") / ALIKE), *share).cast("int").alias("parts"))
    sizes = written(sizes.join(alike, ["low", "tiles"]).select("key", "sets", "shingles", "tiles", F.xxhash64("low", "tiles", F.pmod("key", "parts")).alias("near")), "sizes")
    rows, weight = sizes.agg(*[F.coalesce(F.sum(F.col(c) * F.col("tiles")), F.lit(0)) for c in ("sets", "shingles")]).first()
    slots = max(8 * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SLOT_ROWS), -(-weight // SLOT_SHINGLES))
    dealt = held.join(sizes, "key").groupBy("near", "tiles", "doc").agg(F.collect_list("key").alias("keys"))
    dealt = dealt.withColumn("t", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = dealt.select("near", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "doc", "keys")
    tiled = written(tiled.withColumn("slot", F.pmod(F.xxhash64("near", "i", "j"), F.lit(slots)).cast("int")), "tiled")

    def compare(group: pa.Table, sets: pa.Table, whole: bool) -> pa.Table:
        """Of a slot, the sets that the bounds leave in pairs or, where whole sets are there, links between them."""
        doc, first = np.unique(sets.column("doc").to_numpy(), return_index=True)
        sets = sets.take(pa.array(first))
        own = [np.frombuffer(x, np.uint64 if whole else np.uint16) for x in sets.column("own").to_pylist()]
        fine = [fine_groups(x) for x in own] if whole else own
        size, points = sets.column("n").to_numpy(), _points(sets.column("point").to_pylist())
        label = np.unique(sets.column("label").to_numpy(), return_inverse=True)[1]
        listed = group.column("keys").combine_chunks()
        at = np.repeat(np.arange(len(group)), listed.value_lengths().to_numpy())  # a row for each key
        key = listed.flatten().to_numpy()
        i, j, t = (group.column(c).to_numpy()[at] for c in ("i", "j", "t"))
        place = np.searchsorted(doc, group.column("doc").to_numpy())[at]
        order = np.lexsort((j, i, key))
        key, i, j, t, place = (x[order] for x in (key, i, j, t, place))
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(key)])
        lengths = np.diff(np.append(starts, len(key)))
        few = (lengths <= 32) & (i[starts] == j[starts])
        near, left, right = np.zeros(len(doc), bool), [], []

        def take(a: np.ndarray, b: np.ndarray) -> None:
            if whole:
                for found, more in zip((left, right), joining(own, fine, size, label, a, b), strict=True):
                    found.extend(more)
            else:
                ok = sharper(fine, size, a, b)
                near[a[ok]] = near[b[ok]] = True

        a, b = few_pairs(points[place], size[place], label[place], starts[few], lengths[few])
        take(place[a], place[b])
        for s, e in zip(starts[~few].tolist(), (starts + lengths)[~few].tolist(), strict=True):
            here = place[s:e]
            a, b = tree_pairs(points[here], size[here], label[here], t[s:e] == i[s] if i[s] != j[s] else np.ones(e - s, bool))
            take(here[a], here[b])
        if whole:
            return pa.table({"a": doc[np.array(left, np.int64)], "b": doc[np.array(right, np.int64)]})
        return pa.table({"slot": pa.array(np.full(near.sum(), group.column("slot")[0].as_py()), pa.int32()), "doc": doc[near]})

    def bounded(group: pa.Table, sets: pa.Table) -> pa.Table:
        return compare(group, sets, False)

    def linked(group: pa.Table, sets: pa.Table) -> pa.Table:
        return compare(group, sets, True)

    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        near = written(tiled.groupBy("slot").cogroup(_sets_by_slot(tiled, labels, classes, docs, False).groupBy("slot")).applyInArrow(bounded, "slot int, doc long"), "near")
        left = written(tiled.join(near, ["slot", "doc"], "left_semi"), "left")
        return written(left.groupBy("slot").cogroup(_sets_by_slot(left, labels, classes, docs, True).groupBy("slot")).applyInArrow(linked, "a long, b long"), "joined")


def _labelled(classes: DataFrame, found: DataFrame) -> DataFrame:
    return classes.join(found, classes["sig"] == found["node"], "left").select("sig", "n", F.coalesce("component", "sig").alias("label"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    A null or wordless text is empty: 0 shingles, linked with nothing, its own component. Copies share a component; rows
    repeated come back repeated. doc_id must be a long; where it is null, the row keeps its size and component_id is null
    or that of its copies. An id with several texts is a document for each of them: links of one text are not those of the
    other. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    chars = source.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    # one table of both kinds, so that the texts are read and cut into words once
    with arrow_rows(spark, 4 * BATCH_ROWS):
        analysed = written(_analysed(source, parts).groupBy("part").applyInArrow(_members, "doc_id long, n long, sig long, point binary, key long, pivot long"), "keys")
    sets, members = analysed.filter("key IS NULL").select("doc_id", "n", "sig", "point"), analysed.filter("key IS NOT NULL").select("key", "pivot", "sig")
    classes = written(sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.first("point").alias("point")), "classes")

    pairs = members.select(F.col("pivot").alias("a"), F.col("sig").alias("b")).distinct()
    near = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "sig")
    first = _checked(_bounded_pairs(pairs, classes.join(near, "sig", "left_semi")), classes, source)
    links = first.filter("linked").select("a", "b")
    found = written(connected_components(links), "components")

    # keys that hold several components
    labels = _labelled(classes, found)
    short = labels.select("sig", "label")
    apart = members.join(short.select(F.col("sig").alias("pivot"), F.col("label").alias("of")), "pivot").join(short, "sig").filter("label <> of")
    apart = written(apart.select("key").distinct(), "apart")
    if apart.limit(1).count():
        held = members.join(apart, "key", "left_semi")
        held = held.select("key", "sig").union(held.select("key", F.col("pivot").alias("sig"))).distinct()
        # of keys with the same sets one is enough
        lists = held.groupBy("key").agg(F.sum(F.shiftright(F.xxhash64("sig"), 12)).alias("h"), F.sum(F.shiftright(F.xxhash64("sig", F.lit(1)), 12)).alias("g"))
        held = written(held.join(lists.groupBy("h", "g").agg(F.min("key").alias("key")).select("key"), "key", "left_semi").withColumnRenamed("sig", "doc"), "held")
        again = _tiled_links(held, labels.withColumnRenamed("sig", "doc"), classes, source)
        if again.limit(1).count():
            found = connected_components(links.union(again))
    named = written(classes.join(found, classes["sig"] == found["node"], "left").select("sig", "n", "rep", F.coalesce("component", "sig").alias("label")), "named")
    first_of = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(first_of, "label").select("sig", "n", "component_id")
    return sets.join(named, ["sig", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


#: DuckDB: candidate pairs share a shingle; sizes and shared counts decide; components by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, d.b FROM r JOIN d ON d.a = r.reached)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""

QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
ORACLES = {"op1_ngram_jaccard": ORACLE}
