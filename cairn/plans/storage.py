"""Tables between jobs: written to the folder that driver and executors share, read back, lineage cut."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SEEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. A local one only for a local master without any (tests);
    on a cluster it must be named."""
    folder, session = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder and session not in _OWN:
        _OWN[session] = tempfile.mkdtemp(prefix="cairn-")
    return folder or _OWN[session]


def _deleted(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has written here: when its results are no longer needed."""
    _deleted(spark, f"{shared_dir(spark)}/cairn-{spark.sparkContext.applicationId}")


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        clear(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: a lost executor costs no more than the jobs after it.

    The application's tables lie in one folder, which goes when its driver ends.
    """
    spark = df.sparkSession
    session = spark.sparkContext.applicationId
    if session not in _SEEN:
        _SEEN.add(session)
        atexit.register(_at_exit, spark)
    path = f"{shared_dir(spark)}/cairn-{session}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that written() gave, before the application ends: for those that a loop has done with."""
    _deleted(df.sparkSession, df._table_path)
