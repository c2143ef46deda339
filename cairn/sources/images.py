"""Folders of images through Spark's image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of images.
SUFFIXES = ("png", "jpg", "jpeg", "bmp")


def read_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, name, width, height, channels, data) of the images of a folder; data has rows of pixels, of a pixel blue, green, red
    (and alpha) bytes, or one grey byte. Files that are no images are left out."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(path).select(F.col("image.origin").alias("path"), F.col("image.width").cast("long").alias("width"), F.col("image.height").cast("long").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    named = rows.withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    return named.filter(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*suffixes)).select("path", "name", "width", "height", "channels", "data")
