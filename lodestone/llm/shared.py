"""Places that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` as a full URI. Where it is unset, local mode gets a new folder; a cluster, whose executors couldn't see it, raises."""
    ship(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def new_dir(spark: SparkSession, name: str) -> str:
    """A path of its own for one run of an operator; it isn't made yet."""
    return f"{shared_dir(spark).rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes a query's shuffle files at its end. Else they stay until the driver happens to collect its garbage.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors. The write leaves no shuffle files."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    before = spark.conf.get(CLEAN_KEY, None)
    spark.conf.set(CLEAN_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_KEY) if before is None else spark.conf.set(CLEAN_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete tables made by ``stash`` once all that reads them is written. A path that is gone already is no error."""
    for df in stashed:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._stashed)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_store(uri: str):
    """(file system, path) for a URI, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, parts: list[bytes]) -> None:
    """Write a file under another name and move it to its place, so that a repeated task can't leave half a file."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        for x in parts:
            out.write(x)
    store.move(part, path)
