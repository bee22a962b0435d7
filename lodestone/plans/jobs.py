"""Offline jobs: embed a corpus, build an index, build a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, ingest, knn, search
from ..sources import stores


def embed_captions(captions: DataFrame, make: Callable[[], search.Encoder], path: str, batch: int = search.TEXT_BATCH) -> DataFrame:
    """Encode the valid captions of (id, caption, ...), store and read back (id, text, embedding)."""
    rows = ingest.valid_captions(captions).select("id", F.col("caption").alias("text"))
    return _embed(rows, "text", make, path, batch)


def embed_images(images: DataFrame, make: Callable[[], search.Encoder], path: str, batch: int = search.IMAGE_BATCH) -> DataFrame:
    """Encode the images of (id, content) that have content, store and read back (id, embedding)."""
    return _embed(images.where(F.col("content").isNotNull()).select("id", "content"), "content", make, path, batch)


def _embed(rows: DataFrame, column: str, make: Callable[[], search.Encoder], path: str, batch: int) -> DataFrame:
    spark = rows.sparkSession
    out = search.encode(rows, column, make, batch)
    stores.save_embeddings(out.drop("content"), path, search.model_info(make()))
    return stores.load_embeddings(spark, path)[0]


def build_index(corpus: DataFrame, spec: stores.IndexSpec, path: str, train_rows: int = 100_000) -> None:
    """Store corpus (id, embedding) as an index of the kind in ``spec``; inverted lists are trained on at most about ``train_rows`` rows."""
    if spec.index_type == "ivf":
        lists, centroids = knn.build_ivf(corpus, spec.nlist, train_rows)
        stores.save_index(lists, spec, path, centroids)
    else:
        stores.save_index(corpus.select("id", "embedding"), spec, path)


def open_index(spark: SparkSession, path: str) -> Callable[[DataFrame, int], DataFrame]:
    """A search (queries, k) over a stored index, in the way its spec says."""
    rows, spec = stores.load_index(spark, path)
    if spec.index_type == "ivf":
        centroids = stores.load_centroids(spark, path)
        return lambda queries, k: knn.ivf_search(queries, rows, centroids, k, spec.nprobe)
    if spec.index_type == "lsh":
        return lambda queries, k: knn.lsh_search(queries, rows, k)
    return lambda queries, k: knn.knn_join(queries, rows, k, spec.metric)


def build_stored_graph(captions: DataFrame, images: DataFrame, path: str, k: int = 16, cap: int = 16, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Build, store, read back and check a graph (see ``graph.build_graph``)."""
    nodes, edges = graph.build_graph(captions, images, k, cap, dim)
    stores.save_graph(nodes, edges, path)
    return stores.load_graph(captions.sparkSession, path, dim)


def random_vectors(ids: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """ids (id) with unit vectors that depend on id and seed alone: a stand-in where no embeddings are stored."""
    from ..functions.vectors import l2_normalize

    part = lambda j: F.xxhash64("id", F.lit(seed), F.lit(j)).cast("double") / F.lit(2.0**63)
    return ids.select("id", l2_normalize(F.array(*[part(j) for j in range(dim)])).cast("array<float>").alias("embedding"))
