"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.storage import shared_dir, written

__all__ = ["arrow_rows", "bounded", "let", "release", "remainder", "shared_dir", "table", "written"]

#: The words of a text: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within, batches for Python hold so many rows at most: for jobs whose rows are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """At a task's end: gives back what the worker no longer uses, as an idle worker shares its executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def remainder(col, n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % n


def bounded(df: DataFrame, key: str, most: int, seed: int = 17) -> DataFrame:
    """About `most` rows of df, chosen by a hash of `key`; all rows if there are no more."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
