"""Scores of runs as they arrive: windowed summaries with a watermark, and the gate over each window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.gates import wide_gate
from cairn.plans.storage import shared_dir


def windowed(stream: DataFrame, at: str, value: str, by: list[str], width: str, late: str) -> DataFrame:
    """Count, mean and bounds of value by group and tumbling window; rows later than `late` are left out."""
    out = stream.withWatermark(at, late).groupBy(F.window(at, width), *by)
    out = out.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(*by, F.col("window.start").alias("start"), "n", "mean", "least", "most")


def gated(summary: DataFrame, gate: dict[str, float]) -> DataFrame:
    return wide_gate(summary, gate)


def drained(stream: DataFrame, name: str = "stream") -> DataFrame:
    """What a stream gives once all that is there has arrived, as a table in the shared folder (windows still open stay out)."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
