"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move the score.

Only built-in functions. A kind's matches and the text between them come from the same expression (regexp_extract_all and
split); running sums of their lengths, made in blocks so that the work is linear in the spans, give each match's place in
code points. A text without a kind's tell-tale characters is not scanned for it.

A span's score is its kind's, more where a checksum held, more where words that go with the kind stand within REACH
characters on either side, less where words stand there that go with something else.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import let, table


class Kind(NamedTuple):
    name: str
    pattern: str
    #: A cheap expression that every match meets.
    hint: str
    score: float
    #: Whether a checksum must hold.
    checked: bool
    #: Beginnings of words that speak for the kind, and of those that speak against it.
    words: tuple[str, ...]
    against: tuple[str, ...] = ()


#: The first four are the base. Their patterns are the plain ones with each start tied to the start of a run (or to the end of
#: the match before) and with possessive repeats, so that long runs cost linear time and no stack; they find the same.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, False, ("mail", "e-mail", "contact", "write")),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, False, ("ip", "server", "host", "address"), ("version", "release", "section", "chapter")),
    Kind("card", r"[0-9]++(?:[ -][0-9]++)*+", r"[0-9](?:[ -]?[0-9]){15}", 0.3, True, ("card", "visa", "pay", "credit"), ("isbn", "serial", "tracking")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, False, ("phone", "call", "tel", "mobile")),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.3, True, ("iban", "bank", "account"), ("serial", "tracking")),
    Kind("ssn", r"\b(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, False, ("ssn", "social", "security")),
    Kind("secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{20,}+", r"[A-Za-z0-9_/+-]{20}", 0.3, False, ("token", "secret", "api", "key", "password", "bearer", "credential")),
)
BASE = ("email", "ip", "card", "phone")
#: What a checksum that holds adds, what words nearby add or take, how many characters on either side count as nearby, the
#: score from which a span counts, and spans of a block.
CHECKED, NEARBY, REACH, LEAST, BLOCK = 0.3, 0.3, 40, 0.5, 256


def _blocks(items: Column) -> Column:
    """Consecutive pieces of an array that is not empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))


def running(items: Column, measure: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> Column:
    """For each item, the measures (int) of all items before it, combined from 0 on; in time linear in the items but for
    their number squared by BLOCK squared. Null for an empty array."""

    def before(values: Column, start: Column, of: Callable[[Column], Column]) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, first, lambda a, x: F.struct(combine(a["at"], of(x)).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: combine(a, measure(x)).cast("int")))
        starts = before(totals, F.lit(0), lambda x: x)
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: before(b, s, measure)))

    return F.when(F.size(items) > 0, let(_blocks(items), joined))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits holds."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return (n > 0) & (total % 10 == 0)


def mod_97(code: Column) -> Column:
    """Whether an account number's check digits hold: moved to its end, letters as numbers from 10, the rest modulo 97 is 1."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    rest = F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda x: x.cast("double") > 255)
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod_97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def _spans(kind: Kind, text: Column) -> Column:
    """The kind's spans that hold: array of (kind, start, end, score), by start."""
    words, against = (r"(?<![a-z])(?:" + "|".join(x) + ")" for x in (kind.words, kind.against))

    def scored(pairs: Column, s: Column) -> Column:
        def part(step: int, name: str) -> Column:
            return F.coalesce(F.get(pairs, s["i"] + step)[name], F.lit(""))

        before = F.right(F.concat(F.right(part(-1, "gap"), F.lit(REACH)), part(-1, "match"), part(0, "gap")), F.lit(REACH))
        after = F.left(F.concat(part(1, "gap"), part(1, "match"), F.left(part(2, "gap"), F.lit(REACH))), F.lit(REACH))
        near = F.lower(F.concat(before, F.lit("\n"), after))

        def score(x: Column) -> Column:
            total = F.lit(kind.score + CHECKED * kind.checked) + F.when(x.rlike(words), NEARBY).otherwise(0.0)
            if kind.against:
                total = total - F.when(x.rlike(against), NEARBY).otherwise(0.0)
            return F.round(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)), 2)

        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), let(near, score).alias("score"))

    def placed(pairs: Column, at: Column) -> Column:
        each = F.transform(pairs, lambda p, i: F.struct(i.alias("i"), (F.get(at, i) + F.length(p["gap"])).alias("start"), p["match"].alias("match")))
        held = F.filter(each, lambda s: s["match"].isNotNull() & _holds(kind.name, s["match"]))
        return F.transform(held, lambda s: scored(pairs, s))

    size = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))
    zipped = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("match"))
    found = let(zipped, lambda pairs: let(running(pairs, size, lambda a, x: a + x), lambda at: placed(pairs, at)))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(text.rlike(kind.hint) if kind.hint != "@" else F.contains(text, F.lit("@")), found).otherwise(empty)


def find_private(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with pii: array of (kind, start, end, score) in code points (end exclusive), by kind as in KINDS, then start.

    Base kinds always come, with their scores; the others from a score of `least` on. A null or empty text has no spans;
    repeated rows stay; an input column named pii is replaced. Texts may hold any number of spans.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = [_spans(k, body) if k.name in BASE else F.filter(_spans(k, body), lambda s: s["score"] >= least) for k in KINDS]
    return docs.withColumn("pii", F.concat(*found))


def redact(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with each piece of personal data of score `least` or more in the text replaced by its kind in brackets.

    Overlapping spans go as one, by the first's kind. Null texts stay null; rows and other columns stay as they are, but for
    one named pii or __kept, which goes.
    """
    body = F.col(f"`{text}`")
    ordered = F.array_sort(F.transform(F.filter("pii", lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def apart(spans: Column) -> Column:
        """Spans that begin behind all before them, with where the text before them begins."""
        ends = running(spans, lambda s: s["end"], lambda a, x: F.greatest(a, x))
        each = let(ends, lambda at: F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.get(at, i).alias("at"))))
        return F.filter(each, lambda s: s["start"] >= s["at"])

    def piece(block: Column) -> Column:
        low, high = F.get(block, F.lit(0))["at"], F.element_at(block, -1)["start"]
        own = lambda part: F.transform(block, lambda s: F.concat(F.substring(part, s["at"] - low + 1, s["start"] - s["at"]), F.lit("["), s["kind"], F.lit("]")))
        return let(F.substring(body, low + 1, high - low), lambda part: F.array_join(own(part), ""))

    end = F.array_max(F.transform("__kept", lambda s: s["end"]))
    last = F.array_max(F.transform(F.filter("pii", lambda s: s["score"] >= least), lambda s: s["end"]))
    joined = F.concat(F.array_join(F.transform(_blocks(F.col("__kept")), piece), ""), F.substring(body, F.greatest(end, last) + 1, F.length(body)))
    found = find_private(docs, text, least).withColumn("__kept", let(ordered, apart))
    return found.withColumn(text, F.when(F.size("__kept") > 0, joined).otherwise(body)).drop("pii", "__kept")


def _of_kind(kind: str) -> Column:
    return F.filter("pii", lambda s: s["kind"] == kind)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest, list and scores of the spans of every whole text; n_sure counts those of any kind that score LEAST or more."""
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    sure = F.size(F.filter("pii", lambda s: s["score"] >= LEAST)).cast("long").alias("n_sure")
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(F.encode(_listed(base), "UTF-8"), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"), sure, scores)


QUERIES = {"op4_personal_data": op4_personal_data}
ORACLES: dict[str, str] = {}
