"""Fill-in-the-middle: texts cut at unit ends into prefix, middle and suffix, and put in another order behind markers.

Arrow-batched pandas UDFs: finditer of the regex library puts the end offsets of a text's units (lines, unless the caller
says otherwise) into one compact array, two look-ups there give the cuts, and hashlib makes the seeds from the document's id.
Nothing but the id and the text decides, so runs, partitionings and retried tasks agree. Texts are never copied beyond their
batch, whose size Spark bounds in rows and bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import table

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: The columns that the transformation adds.
ADDED = ("n_units", "form", "prefix_chars", "middle_chars", "output")


class Settings(NamedTuple):
    """unit: pattern of a unit; prefix, suffix, middle: markers; rate: of 100 documents so many are cut; spm: of 100 cut ones
    so many begin with the suffix; seed: what ids are hashed with."""

    unit: str = r"[^\n]*\n|[^\n]+"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    spm: int = 50
    seed: str = "7"

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _checked(settings: Settings) -> Settings:
    """Markers that could begin within one another, or at its end, would make an output ambiguous."""
    for a in settings.markers:
        for b in settings.markers:
            if not a or any(a[:n] == b[-n:] for n in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                raise ValueError(f"markers must be told apart wherever they stand: {settings.markers}")
    if len(set(settings.markers)) < 3:
        raise ValueError("markers must differ")
    return settings


def seeds(doc_id: str, seed: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def arranged(doc_id: str, text: str, unit, settings: Settings) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of prefix and of middle (None: plain) and the output of one text."""
    ends = array("q", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    n = len(ends) - 1
    h1, h2, h3, h4 = seeds(doc_id, settings.seed)
    if not text or h3 % 100 >= settings.rate or any(m in text for m in settings.markers):
        return n, PLAIN, None, None, text
    a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < settings.spm:
        return n, SPM, a, b - a, f"{settings.suffix}{suffix}{settings.prefix}{prefix}{settings.middle}{middle}"
    return n, PSM, a, b - a, f"{settings.prefix}{prefix}{settings.suffix}{suffix}{settings.middle}{middle}"


def rebuilt(output: str, form: str, settings: Settings) -> str:
    """The text that gave the output."""
    if form == PLAIN:
        return output
    first, second = (settings.prefix, settings.suffix) if form == PSM else (settings.suffix, settings.prefix)
    i = output.index(second, len(first))
    j = output.index(settings.middle, i + len(second))
    one, two, middle = output[len(first) : i], output[i + len(second) : j], output[j + len(settings.middle) :]
    return f"{one}{middle}{two}" if form == PSM else f"{two}{middle}{one}"


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """docs with n_units (long), form (plain, psm or spm), prefix_chars, middle_chars (long, null if plain) and output.

    A null text counts as empty and an empty text stays plain, as does one that holds a marker. A null id is hashed as an empty
    one. Repeated rows give repeated rows. Input columns with the names of the new ones are replaced; all others come back as
    they are, whatever their names.
    """
    settings = _checked(settings)
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(ADDED, kinds, strict=True)])

    @F.pandas_udf(schema)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        unit = regex.compile(settings.unit)
        rows = [arranged(i, x, unit, settings) for i, x in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=list(ADDED))
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    names = [c for c in docs.columns if c not in ADDED]
    plain = {c: f"c{k}" for k, c in enumerate(names)}  # so that no input column's name is one of those below
    rows = docs.select(*[F.col(f"`{c}`").alias(plain[c]) for c in names])
    made = rows.withColumn("made", cut(F.coalesce(F.col(plain[doc_id]).cast("string"), F.lit("")), F.coalesce(F.col(plain[text]), F.lit(""))))
    return made.select(*[F.col(plain[c]).alias(c) for c in names], *[F.col("made")[c].alias(c) for c in ADDED])


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The exact text, from output and form alone; null where either is null."""
    settings = _checked(settings)

    @F.pandas_udf(T.StringType())
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else rebuilt(o, f, settings) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return back(output, form)


def digest(text: Column) -> Column:
    """Lowercase hex of the sha256 of a text's UTF-8 bytes; null of null."""

    @F.pandas_udf(T.StringType())
    def sha256(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else hashlib.sha256(x.encode()).hexdigest() for x in texts], dtype=object)

    return sha256(text)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form, cuts and digests of every whole text's output and of the text rebuilt from it."""
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


_H = "('0x' || substr(h, {at}, 8))::BIGINT"
#: DuckDB: lines by their feeds; the characters of the first k lines are those of the first k pieces and their feeds.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), l AS (
  SELECT doc_id, t, string_split(t, chr(10)) AS lines, length(t) - length(replace(t, chr(10), '')) + (t <> '' AND right(t, 1) <> chr(10))::BIGINT AS n,
    {_H.format(at=1)} AS h1, {_H.format(at=9)} AS h2, {_H.format(at=17)} AS h3, {_H.format(at=25)} AS h4 FROM d
), c AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM l
), p AS (
  SELECT *, CASE WHEN a = 0 THEN 0 ELSE least(length(t), list_sum(list_transform(lines[1:a], lambda x: length(x) + 1))) END::BIGINT AS i,
    CASE WHEN b = 0 THEN 0 ELSE least(length(t), list_sum(list_transform(lines[1:b], lambda x: length(x) + 1))) END::BIGINT AS j FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
    ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i) END AS output FROM p
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": ORACLE}
