"""Sinks and sources for embeddings, indices, graphs, results and settings.

A store is a folder with a sub-folder for each version and a file ``_CURRENT`` that names the one in force. A version is written whole before that
file is replaced by an atomic rename, so a reader sees the old version or the new one, and a writer that dies leaves the old one in force. The version
before is kept for readers that have begun; older ones are deleted.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    """(file system, path, Hadoop settings)."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at, conf


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at, _ = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at, _ = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def new_version(path: str) -> str:
    """Where to write the next version of a store."""
    return f"{path}/v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Put a version in force; the one before is kept, older ones go."""
    before = current(spark, path)
    draft = f"{path}/{POINTER}.{uuid.uuid4().hex}"
    _write_text(spark, draft, version.rpartition("/")[2])
    jvm = spark.sparkContext._jvm
    fs, root, conf = _fs(spark, path)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(root).toUri(), conf)
    qualified = lambda p: fs.makeQualified(jvm.org.apache.hadoop.fs.Path(p))
    context.rename(qualified(draft), qualified(f"{path}/{POINTER}"), how)
    keep = {version.rpartition("/")[2], (before or "").rpartition("/")[2]}
    for x in fs.listStatus(root):
        name = x.getPath().getName()
        if name.startswith("v-") and name not in keep:
            fs.delete(x.getPath(), True)


def current(spark: SparkSession, path: str) -> str | None:
    """The version in force; None if there is none."""
    fs, at, _ = _fs(spark, f"{path}/{POINTER}")
    return f"{path}/{_read_text(spark, f'{path}/{POINTER}').strip()}" if fs.exists(at) else None


def _held(spark: SparkSession, path: str) -> str:
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(f"nothing stored at {path}")
    return found


def save_embeddings(df: DataFrame, path: str, metadata: dict | None = None) -> None:
    """(id, embedding) with metadata."""
    version = new_version(path)
    df.write.parquet(f"{version}/rows")
    if metadata is not None:
        _write_text(df.sparkSession, f"{version}/metadata.json", json.dumps(metadata))
    publish(df.sparkSession, path, version)


def load_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, dict | None]:
    version = _held(spark, path)
    fs, at, _ = _fs(spark, f"{version}/metadata.json")
    return spark.read.parquet(f"{version}/rows"), json.loads(_read_text(spark, f"{version}/metadata.json")) if fs.exists(at) else None


@dataclass(frozen=True)
class IndexSpec:
    """What an index is; its rows are (id, embedding[, list_id])."""

    dimension: int
    index_type: str = "flat"
    metric: str = "cosine"
    nlist: int = 100
    nprobe: int = 1

    def __post_init__(self) -> None:
        if self.index_type not in ("flat", "ivf", "lsh") or self.metric not in ("cosine", "euclidean"):
            raise ValueError(f"unknown index {self.index_type} / {self.metric}")


def save_index(df: DataFrame, spec: IndexSpec, path: str, centroids: DataFrame | None = None) -> None:
    """Rows (by list if they have one), centroids and the spec, put in force together."""
    version = new_version(path)
    (df.write.partitionBy("list_id") if "list_id" in df.columns else df.write).parquet(f"{version}/rows")
    if centroids is not None:
        centroids.write.parquet(f"{version}/centroids")
    _write_text(df.sparkSession, f"{version}/spec.json", json.dumps(asdict(spec)))
    publish(df.sparkSession, path, version)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, IndexSpec]:
    version = _held(spark, path)
    rows = spark.read.parquet(f"{version}/rows")
    if "list_id" in rows.columns:
        rows = rows.withColumn("list_id", F.col("list_id").cast("long"))
    return rows, IndexSpec(**json.loads(_read_text(spark, f"{version}/spec.json")))


def load_centroids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{_held(spark, path)}/centroids")


def index_stats(df: DataFrame, spec: IndexSpec) -> DataFrame:
    lit = {k: F.lit(v) for k, v in asdict(spec).items() if k in ("dimension", "index_type", "metric")}
    return df.agg(F.count("*").alias("n_vectors")).select("n_vectors", *[v.alias(k) for k, v in lit.items()])


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two tables, put in force together; texts are kept with the nodes."""
    version = new_version(path)
    nodes.write.partitionBy("node_type").parquet(f"{version}/nodes")
    edges.write.partitionBy("edge_type").parquet(f"{version}/edges")
    publish(nodes.sparkSession, path, version)


def load_graph(spark: SparkSession, path: str, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Raises FileNotFoundError for a missing table, ValueError for wrong types, dimensions or edges without nodes."""
    version = _held(spark, path)
    missing = [t for t in ("nodes", "edges") if not _fs(spark, f"{version}/{t}")[0].exists(_fs(spark, f"{version}/{t}")[1])]
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    nodes, edges = spark.read.parquet(f"{version}/nodes"), spark.read.parquet(f"{version}/edges")
    if dict(nodes.dtypes).get("embedding") != "array<float>":
        raise ValueError("embedding must be array<float>")
    if dict(edges.dtypes).get("weight") not in ("float", "double"):
        raise ValueError("weight must be float")
    from ..operators.graph import validation_report

    bad = [r.check for r in validation_report(nodes, edges, dim).collect() if r.violations]
    if bad:
        raise ValueError("the graph fails: " + ", ".join(bad))
    return nodes, edges


def save_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Where settings lie unless a path is given: beside the package.
DEFAULT_CONFIG = str(Path(__file__).resolve().parents[2] / "config.json")


def load_config(path: str | None = None) -> dict:
    """Settings from YAML or JSON; FileNotFoundError if there is no such file."""
    path = path or DEFAULT_CONFIG
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package; use JSON") from e
    return yaml.safe_load(text)


def save_config(config: dict, path: str | None = None) -> None:
    path = path or DEFAULT_CONFIG
    with open(path, "w", encoding="utf-8") as f:
        if path.endswith(".json"):
            json.dump(config, f, indent=2)
        else:
            import yaml

            yaml.safe_dump(config, f)
