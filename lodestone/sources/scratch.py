"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the one in ``spark.checkpoint.dir``; where that is unset, a new one is set in local mode, and else it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes a query's shuffle files at its end. Else they stay until the driver happens to collect its garbage.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write a table, ``rows_a_file`` rows to a file if given, and read it again: it is worked out once, its plan is a scan, and a lost executor costs nothing.
    The write leaves no shuffle files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEAN_KEY, None)
    spark.conf.set(CLEAN_KEY, "true")
    try:
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    finally:
        spark.conf.unset(CLEAN_KEY) if before is None else spark.conf.set(CLEAN_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def drop(*kept: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for df in kept:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._kept)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def among(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in wanted. Its distinct keys are written to the shared folder: what is known to be small is broadcast, and df isn't shuffled."""
    return df.join(keep(wanted.select(key).distinct(), "wanted"), key, "left_semi")
