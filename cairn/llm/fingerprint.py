"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Only built-in functions. Each shingle is hashed once; the hash's upper bits name its bin and each bin keeps its smallest
hash. An empty bin borrows from the first bin that is not empty along its own fixed walk over all bins (a universal hash
of bin and step), so that two sets borrow alike. Of each bin the lowest four bits are kept, as one hexadecimal digit; the
share of equal digits is corrected for those that agree by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import WORD_SPACE, table, written

#: Words of a shingle; bins, a power of two; bits that are kept of a bin; ids of a range in which neighbours are sought.
WORDS, BINS, BITS, RANGE_ROWS = 5, 128, 4, 1_000_000
_CHOICE = random.Random(29)
#: Bin i's walk: step t leads to bin (FACTOR[i] * t + OFFSET[i]) mod BINS; with an odd factor it meets every bin once.
FACTOR = [_CHOICE.randrange(1, BINS, 2) for _ in range(BINS)]
OFFSET = [_CHOICE.randrange(BINS) for _ in range(BINS)]
INVERSE = [pow(x, -1, BINS) for x in FACTOR]


def _constants(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column `out`: BINS hexadecimal digits, or nothing for a text without words (or null).

    Equal texts have equal fingerprints; letter case and white space don't matter. Repeated rows stay; an input column named
    out is replaced, and so are columns named __h, __s, __f and __b.
    """
    names = [c for c in df.columns if c not in (out, "__h", "__s", "__f", "__b")]
    kept = names_of(names)
    words = F.filter(F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), f"[{WORD_SPACE}]+"), lambda w: w != "")
    hashed = df.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("__h"))
    h, n = F.col("__h"), F.size("__h")
    # a text of fewer words is one shingle; hashes lose their sign, so that sorting brings each bin together
    shingles = F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]).bitwiseAND(F.lit(2**63 - 1))))
    whole = F.array(F.aggregate(h, F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x)).bitwiseAND(F.lit(2**63 - 1)))
    sorted_ = hashed.select(*names_of(names), F.sort_array(F.when(n == 0, F.array().cast("array<bigint>")).when(n < WORDS, whole).otherwise(shingles)).alias("__s"))
    s, shift = F.col("__s"), 63 - (BINS.bit_length() - 1)
    least = sorted_.select(*names_of(names), F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift))).alias("__f"))
    binned = least.select(*names_of(names), "__f", F.transform("__f", lambda x: F.shiftright(x, shift).cast("int")).alias("__b"))
    f, b = F.col("__f"), F.col("__b")

    def digit(i: Column, factor: Column, offset: Column, inverse: Column) -> Column:
        own = F.array_position(b, i).cast("int")
        step = F.array_min(F.transform(b, lambda j: ((j - offset + BINS) * inverse) % BINS))
        lent = F.array_position(b, ((step * factor + offset) % BINS).cast("int")).cast("int")
        return F.lower(F.hex(F.get(f, F.when(own > 0, own).otherwise(lent) - 1).bitwiseAND(F.lit(2**BITS - 1))))

    walks = F.arrays_zip(F.sequence(F.lit(0), F.lit(BINS - 1)).alias("i"), _constants(FACTOR).alias("factor"), _constants(OFFSET).alias("offset"), _constants(INVERSE).alias("inverse"))
    digits = F.transform(walks, lambda w: digit(w["i"], w["factor"], w["offset"], w["inverse"]))
    return binned.select(*names_of(names), F.when(F.size(b) > 0, F.array_join(digits, "")).otherwise("").alias(out))


def names_of(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def likeness(one: str, two: str) -> Column:
    """Estimate of the sets' Jaccard similarity, 0 to 1; 1 for two texts without words, 0 for one of them."""
    same = F.zip_with(F.split(F.col(one), ""), F.split(F.col(two), ""), lambda x, y: F.when((x == y) & (x != ""), 1).otherwise(0))
    share, chance = F.aggregate(same, F.lit(0), lambda a, x: a + x) / BINS, 2.0**-BITS
    near = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when((F.col(one) == "") | (F.col(two) == ""), (F.col(one) == F.col(two)).cast("double")).otherwise(near)


def _following(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(__key, __content, next_key, next_content) of distinct rows: the row after each by descending key, then content; after
    the last comes the first, null keys come last.

    Only these two longs move. They are cut into ranges sized from their number, and each range is lent the first row of
    the range after it.
    """
    spark = rows.sparkSession
    falling = F.struct(F.col("__key").isNull().alias("none"), F.bitwise_not("__key").alias("key"), F.col("__content").alias("content"))  # ~key falls as key rises, without overflow
    slim = written(rows.select(F.col(key).alias("__key"), F.col(content).alias("__content")).distinct().select("__key", "__content", falling.alias("__order")), "order")
    n = slim.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    ranged = written(slim.repartitionByRange(parts, "__order").withColumn("__range", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("__range").agg(F.min("__order").alias("head"))
    above = Window.orderBy("__range")  # as many rows as ranges
    lent = heads.select(F.col("__range").alias("__of"), F.coalesce(F.lead("head").over(above), F.min("head").over(Window.partitionBy())).alias("__lent"))
    own = F.lead("__order").over(Window.partitionBy("__range").orderBy("__order"))
    after = ranged.withColumn("__own", own).join(lent, F.col("__range") == F.col("__of")).withColumn("__next", F.coalesce("__own", "__lent"))
    return after.select("__key", "__content", F.when(~F.col("__next.none"), F.bitwise_not("__next.key")).alias("next_key"), F.col("__next.content").alias("next_content"))


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs.

    The edited text has the last third of the code points (rounded down) replaced by the first as many of the next document
    by descending doc_id (after the last: the first). Null texts count as empty. Rows with a null id come last. Of rows with
    the same id those of different texts follow each other in a fixed order, and repeated rows, which come back repeated,
    are one document in it. A document alone is its own next. doc_id must be a long; other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__hash", F.xxhash64("__text"))
    # each text is hashed once; what goes on is small and carries no text
    light = written(with_fingerprint(rows.withColumn("__chars", F.length("__text").cast("long")), "__text", "fingerprint").drop("__text"), "fingerprints")
    links = _following(light, "__id", "__hash")
    ends = light.select("__id", "__hash", "__chars", "fingerprint")
    one = ends.dropDuplicates(["__id", "__hash"])
    links = links.join(one, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__content") == F.col("__hash"))).drop("__id", "__hash")
    next_one = one.select(F.col("__id").alias("__nid"), F.col("__hash").alias("__nhash"), F.col("fingerprint").alias("next_fingerprint"))
    links = links.join(next_one, F.col("next_key").eqNullSafe(F.col("__nid")) & (F.col("next_content") == F.col("__nhash"))).drop("__nid", "__nhash")
    links = written(links.withColumn("__moved", F.floor(F.col("__chars") / 3).cast("int")), "links")
    # the beginnings of the next texts, as long as they are needed, then the texts themselves
    beginnings = rows if light.count() == links.count() else rows.dropDuplicates(["__id", "__hash"])
    lent = links.join(beginnings, F.col("next_key").eqNullSafe(F.col("__id")) & (F.col("next_content") == F.col("__hash")))
    lent = lent.select("__key", "__content", "__chars", "__moved", "fingerprint", "next_fingerprint", F.substring("__text", F.lit(1), F.col("__moved")).alias("__lent"))
    both = rows.join(lent, F.col("__id").eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__content")))
    kept = F.substring("__text", F.lit(1), (F.col("__chars") - F.col("__moved")).cast("int"))
    edited = both.select(F.col("__id").alias("doc_id"), F.col("__chars").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(kept, "__lent").alias("__edited"))
    edited = edited.withColumn("edited_sha256", F.sha2(F.encode("__edited", "UTF-8"), 256))
    done = with_fingerprint(edited, "__edited", "edited_fingerprint")
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how near they are to it and to the next text."""
    return edited_likeness(table(spark, sf_dir, "documents"))


QUERIES = {"op7_fingerprint": op7_fingerprint}
ORACLES: dict[str, str] = {}
