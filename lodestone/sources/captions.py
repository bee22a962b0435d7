"""Caption tables and image files."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["image_name", "comment_number", "caption"]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_captions(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A table with ``|`` between fields and a header; all values are stripped and the columns get fixed names. row_pos gives the order of rows."""
    raw = spark.read.option("sep", "|").option("header", header).option("quote", "").schema("a string, b string, c string").csv(path)
    named = raw.select(*[F.trim(c).alias(n) for c, n in zip("abc", COLUMNS, strict=True)])
    return named.withColumn("row_pos", F.monotonically_increasing_id())


def load_if_there(spark: SparkSession, captions: str, images: str | None = None) -> DataFrame | None:
    """None, with a warning, if the caption table is missing; a missing image folder only warns."""
    if images and not exists(spark, images):
        warnings.warn(f"no image folder at {images}", stacklevel=2)
    if not exists(spark, captions):
        warnings.warn(f"no captions at {captions}", stacklevel=2)
        return None
    return load_captions(spark, captions)


def image_blobs(spark: SparkSession, names: DataFrame, folder: str) -> DataFrame:
    """The names (column image_name) with the files' content; null where there is no file."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("image_name"), "content", "length")
    return names.join(files, "image_name", "left")


def only_available(candidates: DataFrame, available: DataFrame, on: str = "image_name") -> DataFrame:
    return candidates.join(available.select(on), on, "left_semi")


def data_report(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """name, path, there, n_jpg for each folder."""
    rows = []
    for name, path in folders.items():
        there = exists(spark, path)
        n = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path).select("path").count() if there else 0
        rows.append((name, path, there, n))
    return spark.createDataFrame(rows, "name string, path string, there boolean, n_jpg long")
