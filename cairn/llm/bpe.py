"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes exactly one token can be the last of that prefix's encoding. A token t that ends
at byte i and starts at byte j is that token when t may follow the last token of the prefix of length j, that is, when
no merge that BPE would have made earlier crosses the border between them. The table of last tokens makes appends
exact (it only grows) and limits the work after an edit to the bytes from the edit on, up to where old and new tables
agree over the longest token's length. Many short pieces fill their tables together, a byte position at a time.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import release, table

#: White space as Unicode's White_Space property has it, for character classes.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Those of more than one byte.
_SPACED = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Runs without white space, with one space before; the pattern's matches never cross their borders.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Chunks that are letters (of Latin blocks; others are left to the pattern), then perhaps marks: a piece each.
_WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\\[-`{-~]*)").fullmatch
#: White space of several bytes in UTF-8, by its first byte.
_WIDE_SPACE = {x[0]: [y for y in map(str.encode, _SPACED) if y[0] == x[0]] for x in map(str.encode, _SPACED)}
#: Half the chunks and pieces that a task remembers at most (and 3/4 of its pairs of neighbours), and the longest.
REMEMBER, MEMO_CHARS = 350_000, 64
#: Texts are encoded together up to so many bytes (16 for each string remembered, if less); pieces so long at most and at least so many fill tables together.
GROUP_BYTES, SHORT_BYTES, FEW = 1_000_000, 64, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class PrefixEncoder:
    """Encodes byte pieces by ranks; whole pieces that are tokens stay whole."""

    def __init__(self, ranks: dict[bytes, int], pairs: int = 3 * REMEMBER // 2):
        self.ranks, self.pairs = ranks, pairs
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.longest = max(map(len, ranks))
        self.halves, self.merges = {}, {}
        for token in sorted(self.bytes_of):
            parts = self._halves(token)
            if len(parts) < 3:
                self.halves[token] = (parts[0], parts[-1])
                if len(parts) == 2:
                    self.merges[parts[0], parts[1]] = token
        self.lengths = {x: len(self.bytes_of[x]) for x in self.halves}
        self._fits: dict[int, bool] = {}

    @cached_property
    def made(self) -> ahocorasick.Automaton:
        """Finds the tokens that merges make by their bytes; others occur as whole pieces only."""
        made = ahocorasick.Automaton()
        for token in self.halves:
            made.add_word(self.bytes_of[token].decode("latin-1"), token)
        made.make_automaton()
        return made

    def _halves(self, token: int) -> list[int]:
        """The two tokens whose merge makes this one, itself for a byte, more if merges never make it."""
        parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
        while len(parts) > 2:
            merged = [self.merges.get(pair, token) for pair in zip(parts, parts[1:], strict=False)]
            best = min(merged)
            if best >= token:
                break
            i = merged.index(best)
            parts[i : i + 2] = [best]
        return parts

    def border_holds(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between these two neighbours."""
        bound, halves, merges = len(self.ranks) + 256, self.halves, self.merges
        while True:
            merged = merges.get((left, right))
            if merged is not None and merged < bound:  # merges of a later rank come too late to cross the border
                return False
            # undo the later of the two merges; a byte has none
            inner_left, inner_right = halves[left][1], halves[right][0]
            if inner_left != left and (left > right or inner_right == right):
                bound, left = left, inner_left
            elif inner_right != right:
                bound, right = right + 1, inner_right
            else:
                return True

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix (index: its length); `known` is such a table of a prefix of this piece."""
        last = list(known or [-1])
        made, fits, longest, lengths, holds = self.made, self._fits, self.longest, self.lengths, self.border_holds
        if len(fits) > self.pairs:
            fits.clear()
        base, done = max(0, len(last) - 1 - longest), len(last) - 1
        for at, token in made.iter(piece[base:].decode("latin-1")):  # those that end at the same byte: longest first
            end = base + at + 1
            if end <= done:
                continue
            start = end - lengths[token]
            if start:
                pair = last[start] << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = holds(last[start], token)
                if not fit:
                    continue
            last.append(token)
            done = end
        return last

    def after_edit(self, old: bytes, table: list[int], new: bytes, start: int, shift: int) -> list[int]:
        """The table of `new`, which equals `old` before byte `start` and, from some later byte on, `old` moved by shift."""
        last, same = table[: start + 1], 0
        tail = 0
        while tail < min(len(old), len(new)) - start and old[len(old) - 1 - tail] == new[len(new) - 1 - tail]:
            tail += 1
        while len(last) <= len(new):
            last = self.last_tokens(new[: len(last)], last)
            end = len(last) - 1
            agrees = end > len(new) - tail and 0 < end - shift < len(table) and table[end - shift] == last[end]
            same = same + 1 if agrees else 0
            if same > self.longest:
                return last + table[end - shift + 1 :]
        return last

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last, ids, end = self.last_tokens(piece), [], len(piece)
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return ids[::-1]

    @cached_property
    def _side_by_side(self) -> SideBySide:
        return SideBySide(self)

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed, four bytes each."""
        found = [None if (whole := self.ranks.get(x)) is None else whole.to_bytes(4, sys.byteorder) for x in pieces]
        short = [k for k, x in enumerate(pieces) if found[k] is None and len(x) <= SHORT_BYTES]
        if len(short) >= FEW:
            for k, ids in zip(short, self._side_by_side.encode([pieces[k] for k in short]), strict=True):
                found[k] = ids
        return [array("i", self.encode(x)).tobytes() if ids is None else ids for x, ids in zip(pieces, found, strict=True)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class SideBySide:
    """The tables of many pieces at once: at each byte position, all pieces try the tokens that end there, longest first."""

    def __init__(self, encoder: PrefixEncoder):
        self.holds = encoder.border_holds
        # a trie of the tokens that merges make; node 0 is the root
        child, token = {}, [-1]
        for made in encoder.halves:
            node = 0
            for byte in encoder.bytes_of[made]:
                node = child.setdefault(node << 8 | byte, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = made
        edges = np.fromiter(child, np.int64, len(child))  # by child: a node's number is larger than its parent's
        parent, byte = np.append(0, edges >> 8), np.append(0, edges & 255)
        self.token = np.array(token, np.int32)
        order = np.argsort(edges)
        self.edges, self.below = edges[order], (order + 1).astype(np.int32)
        # each node's longest proper suffix in the trie, level by level
        self.suffix, self.ends, self.shorter, self.depth = (np.zeros(len(token), np.int32) for _ in range(4))
        level, depth = np.zeros(1, np.int64), 0
        while len(level):
            up = self.suffix[level]
            self.depth[level] = depth
            self.shorter[level] = self.ends[up]
            self.ends[level] = np.where(self.token[level] >= 0, level, self.ends[up])
            below = np.flatnonzero(np.isin(parent, level))
            below = below[below > 0]
            self.suffix[below] = self.move(self.suffix[parent[below]], byte[below]) if depth else 0
            level, depth = below, depth + 1
        self.lengths = np.zeros(max(encoder.bytes_of) + 1, np.int32)
        self.lengths[list(encoder.lengths)] = list(encoder.lengths.values())
        #: Pairs whose border has been looked at; a later pair takes an earlier one's place.
        self.bits = max(10, encoder.pairs.bit_length())
        self.pairs, self.fit = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, bool)

    def move(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node of the longest suffix of each node's string and the byte."""
        to, open_ = np.zeros(len(node), np.int32), np.arange(len(node))
        while len(open_):
            edge = node.astype(np.int64) << 8 | byte
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            there = self.edges[at] == edge
            to[open_[there]] = self.below[at[there]]
            on = ~there & (node > 0)
            open_, node, byte = open_[on], self.suffix[node[on]], byte[on]
        return to

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border of each pair; left is -1 at a piece's start."""
        pair = left.astype(np.int64) << 32 | right
        place = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)
        fit = self.fit[place] | (left < 0)
        new = np.flatnonzero((self.pairs[place] != pair) & (left >= 0))
        if len(new):
            some, back = np.unique(pair[new], return_inverse=True)
            held = np.array([self.holds(x >> 32, x & 0xFFFFFFFF) for x in some.tolist()])[back]
            fit[new] = held
            place, pair = place[new], pair[new]
            self.pairs[place] = pair
            stays = self.pairs[place] == pair  # of pairs for one place, the one that it holds now
            self.fit[place[stays]] = held[stays]
        return fit

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")  # so that at each position those that go on come first
        sizes, widest = sizes[order], int(sizes.max())
        padded = np.frombuffer(b"".join(pieces[k].ljust(widest, b"\0") for k in order.tolist()), np.uint8)
        columns = np.ascontiguousarray(padded.reshape(len(pieces), widest).T)
        last = np.full((widest + 1, len(pieces)), -1, np.int32)
        node = np.zeros(len(pieces), np.int32)
        for end in range(1, widest + 1):
            going = int(np.searchsorted(-sizes, -end, side="right"))
            node = self.move(node[:going], columns[end - 1, :going])
            open_, tried = np.arange(going), self.ends[node]
            while len(open_):
                token = self.token[tried]
                fit = self.fits(last[end - self.depth[tried], open_], token)
                last[end, open_[fit]] = token[fit]
                open_, tried = open_[~fit], self.shorter[tried[~fit]]
        # from the last token of the whole piece back to its first one
        rounds, at, open_ = [], sizes.copy(), np.arange(len(pieces))
        while len(open_):
            token = last[at[open_], open_]
            rounds.append((open_, token))
            at[open_] -= self.lengths[token]
            open_ = open_[at[open_] > 0]
        counts = np.zeros(len(pieces), np.int64)
        for open_, _ in rounds:
            counts[open_] += 1
        stops = np.cumsum(counts)
        ids = np.empty(int(counts.sum()), np.int32)
        for k, (open_, token) in enumerate(rounds, 1):
            ids[stops[open_] - k] = token
        packed, found = ids.tobytes(), [b""] * len(pieces)
        for k, start, stop in zip(order.tolist(), (4 * (stops - counts)).tolist(), (4 * stops).tolist(), strict=True):
            found[k] = packed[start:stop]
        return found


class Memo(dict):
    """A function's results (bytes) for short strings. At a bound the older half goes, but for what is asked for again."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value


class TextEncoder:
    """Encodes texts; remembers the ids (packed, four bytes each) of chunks and pieces seen before.

    A chunk that is one piece has that piece's ids, and a piece by itself is one piece, so both are remembered together.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = REMEMBER):
        spelled = pattern.replace("[^\\s", f"[^{_SPACE}").replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]")
        self.pieces_encoder = PrefixEncoder(ranks, 3 * remember // 2)
        self.find, self.words = regex.compile(spelled).findall, " ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+" in pattern
        self.known = Memo(lambda chunk: b"".join(self.pieces_encoder.encode_all([x.encode() for x in self.find(chunk)])), 2 * remember)

    def encode(self, text: str) -> array:
        return array("i", b"".join(map(self.known.__getitem__, _CHUNK.findall(text))))

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The ids of all texts (none of them null) and the offsets of each text's; a chunk is looked up once."""
        bounds, chunks = chunks_of(texts)
        coded = chunks.dictionary_encode()
        ids = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        _, ends, packed = ids.buffers()
        offsets = np.frombuffer(ends, np.int64, len(ids) + 1)[bounds] // 4 if len(ids) else np.zeros(len(bounds), np.int64)
        return pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, packed]), pa.array(offsets, pa.int32())

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of chunks; all that is new among them is encoded together."""
        known, find, made = self.known, self.find, {}
        found, cut = list(map(known.get, chunks)), []
        for k, chunk in enumerate(chunks):
            if found[k] is None and (ids := known.old.get(chunk)) is not None:
                found[k] = made[chunk] = ids
            elif found[k] is None:
                word = self.words and _WORD(chunk)
                cut.append((k, tuple(filter(None, word.groups())) if word else tuple(find(chunk))))
        fresh = {x for _, parts in cut for x in parts} - made.keys()
        made |= {x: ids for x in fresh if (ids := known.get(x) or known.old.get(x))}
        fresh = [x for x in fresh if x not in made]
        made |= zip(fresh, self.pieces_encoder.encode_all([x.encode() for x in fresh]), strict=True)
        for k, parts in cut:
            made[chunks[k]] = found[k] = made[parts[0]] if len(parts) == 1 else b"".join([made[x] for x in parts])
        for x, ids in made.items():
            if len(x) <= MEMO_CHARS:
                known.put(x, ids)
        return found

    def decode(self, ids) -> bytes:
        return self.pieces_encoder.decode(ids)

    @cached_property
    def _spelled(self) -> pa.Array:
        bytes_of = self.pieces_encoder.bytes_of
        return pa.array(map(bytes_of.get, range(max(bytes_of) + 1)), pa.binary())

    def decode_all(self, ids: pa.Array, offsets: pa.Array) -> pa.Array:
        """The bytes of each run of ids between offsets."""
        bytes_ = self._spelled.take(ids)
        _, ends, data = bytes_.buffers()
        ends = pa.Array.from_buffers(pa.int32(), len(ids) + 1, [None, ends])
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends.take(offsets).buffers()[1], data])


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The chunks of all texts (none of them null) in one array, and each text's bounds in it: what _CHUNK finds, by bytes."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32, len(texts) + 1, 4 * texts.offset)
    data = data.slice(int(ends[0]), int(ends[-1] - ends[0])) if data else pa.py_buffer(b"")
    ends, byte = ends - ends[0], np.frombuffer(data, np.uint8)
    space = (byte == 32) | (byte - np.uint8(9) < 5)
    last = byte == 32  # where a white space begins that is one byte, at first
    last |= space
    for first, some in _WIDE_SPACE.items():
        at = np.flatnonzero(byte == first)
        for wide in some if len(at) else ():
            fits = at[at + len(wide) <= len(byte)]
            for k in range(1, len(wide)):
                fits = fits[byte[fits + k] == wide[k]]
            last[fits] = True
            for k in range(len(wide)):
                space[fits + k] = True
    begins = np.zeros(len(byte) + 1, bool)  # of texts, then of chunks
    begins[ends] = True
    before = np.concatenate(([False], space[:-1])) if len(byte) else space
    turn = np.flatnonzero(space != before)
    turn = turn[~begins[turn]]
    into, out_of = turn[space[turn]], turn[~space[turn]]  # where white space begins and where it ends
    begins[into] = True
    begins[out_of[byte[out_of - 1] != 32]] = True  # a space belongs to what follows
    for k in (1, 2, 3):  # the last white space before something else stands alone, or goes with it
        begins[out_of[last[out_of - k]] - k] = True
        out_of = out_of[~last[out_of - k]]
    starts = np.flatnonzero(begins)
    if len(byte) == 0:
        starts = np.zeros(1, np.int64)
    chunks = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), data])
    return np.searchsorted(starts, ends), chunks


@lru_cache(maxsize=1)
def _encoder(packed: bytes, pattern: str, remember: int) -> TextEncoder:
    """One encoder for a Python worker."""
    return TextEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines())}, pattern, remember)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, remember: int = REMEMBER, decode: bool = True) -> DataFrame:
    """Each row's kept columns with token_ids (array of int) and, with decode, decoded (binary, made from those ids).

    A null text counts as empty: no ids, no bytes. Repeated rows give repeated rows. Input columns named token_ids or
    decoded are replaced, all others come back whatever their names. The rank file is read on the driver and broadcast; a vocabulary bounds its size. remember trades a
    worker's memory for time.
    """
    spark, kept = docs.sparkSession, [c for c in (keep or docs.columns) if c not in ("token_ids", "decoded")]
    with open(ranks_path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    plain = [f"c{k}" for k in range(len(kept))]  # so that no input column's name is one of those below
    back = [F.col(p).alias(c) for p, c in zip(plain, kept, strict=True)]
    source = docs.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, kept, strict=True)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    made = ["token_ids", "decoded"] if decode else ["token_ids"]
    schema = source.select(*plain, *[F.lit(None).cast(t).alias(c) for c, t in zip(made, ("array<int>", "binary"), strict=False)]).schema

    together = min(GROUP_BYTES, 16 * remember)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern, remember)
        for whole in batches:
            texts, at = whole.column(len(kept)).cast(pa.string()), 0
            ends = pc.binary_length(texts).to_numpy().cumsum(dtype=np.int64)
            while at < len(whole):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + together, side="right")))
                ids, offsets = encoder.encode_all(texts.slice(at, stop - at))
                decoded = [encoder.decode_all(ids, offsets)] if decode else []
                columns = [x.slice(at, stop - at) for x in whole.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, ids), *decoded], [*plain, *made])
                at = stop
        if remember < REMEMBER:  # memory is short: nothing stays for the worker's next task
            del encoder
            _encoder.cache_clear()
            release()

    return source.mapInArrow(run, schema).select(*back, *made)


def multi_language_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    tokens = tokenize(table(spark, sf_dir, "documents"), *multi_language_vocabulary(), keep=["doc_id"])
    return tokens.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("token_ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op2_bpe_encoding": op2_bpe_encoding}
ORACLES: dict[str, str] = {}
