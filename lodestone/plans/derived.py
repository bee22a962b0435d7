"""Retrieval inputs derived from the driver's tables: images are ``embeddings``, captions ``documents``, queries ``benchmark``.

Each DataFrame has its counterpart among the CTEs of ``oracles.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import combine, l2_normalize
from ..operators import graph as g
from ..operators.knn import semantic_edges
from ..session import ship
from ..sources.scratch import keep, scratch  # noqa: F401

#: Bytes of a Parquet row group, as writers make them by default.
UNCUT = 128 << 20
_kept: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str, dealt: bool = True) -> DataFrame:
    """A table of the input; documents are dealt out (``spread``), unless what follows only joins them."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, f"{sf_dir}/{name}.parquet") if name == "documents" and dealt else df


def spread(df: DataFrame, path: str) -> DataFrame:
    """Texts in a file too small to be cut (one row group) would all be worked on by one task: such a table is dealt to all cores first, any other is left as it is."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return df.repartition(spark.sparkContext.defaultParallelism) if size < UNCUT else df


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _pick(df: DataFrame, vectors: DataFrame, key: str, to: str) -> DataFrame:
    return df.join(vectors.select(F.col("id").alias(key), F.col("embedding").alias(to)), key)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "queries", lambda: make_queries(spark, sf_dir))


def caption_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, image, embedding): the captions without their texts."""
    return kept(spark, sf_dir, "captions", lambda: make_caption_vectors(spark, sf_dir))


def caption_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of all documents, also of those that are no captions as their images aren't known."""
    return table(spark, sf_dir, "documents", dealt=False).select(F.col("doc_id").alias("id"), "text")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, image, embedding): texts are shuffled once, where both they and the vectors are read."""
    return caption_texts(spark, sf_dir).join(caption_vectors(spark, sf_dir).dropDuplicates(["id"]), "id")


def make_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, gt, embedding): a blend of the true image's vector and two others."""
    i, b = images(spark, sf_dir), table(spark, sf_dir, "benchmark")
    n = i.count()
    q = b.select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") * 37 % n).alias("gt"), ((F.col("item_id") * 53 + 11) % n).alias("b"), ((F.col("item_id") * 71 + 29) % n).alias("c"))
    q = _pick(_pick(_pick(q, i, "gt", "v1"), i, "b", "v2"), i, "c", "v3")
    w = F.lit(0.2) + F.lit(0.1) * (F.col("query_id") % 4)
    return q.select("query_id", "text", "gt", l2_normalize(combine((w, F.col("v1")), (0.35, F.col("v2")), (0.3, F.col("v3")))).alias("embedding"))


def _caption_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = images(spark, sf_dir).count()
    return table(spark, sf_dir, "documents", dealt=False).select(F.col("doc_id").alias("id"), (F.col("doc_id") % n).alias("image"), ((F.col("doc_id") * 31 + 7) % n).alias("b"))


def caption_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, image) of the captions, from ids alone."""
    known = images(spark, sf_dir).select("id")
    c = _caption_ids(spark, sf_dir).join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    return c.join(known.withColumnRenamed("id", "image"), "image", "left_semi").select("id", "image")


def make_caption_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, image, embedding): document d belongs to image d mod n."""
    i = images(spark, sf_dir)
    c = _pick(_pick(_caption_ids(spark, sf_dir), i, "image", "v1"), i, "b", "v2")
    return c.select("id", "image", l2_normalize(combine((0.8, F.col("v1")), (0.2, F.col("v2")))).alias("embedding"))


def caption_table(spark: SparkSession, sf_dir: str, by: str = "source") -> DataFrame:
    """A caption table; ``source`` or the image of each document names its image."""
    d = table(spark, sf_dir, "documents")
    name = F.col("source") if by == "source" else F.concat(F.lit("img"), (F.col("doc_id") % images(spark, sf_dir).count()).cast("string"))
    return d.select(name.alias("image_name"), F.col("doc_id").cast("string").alias("comment_number"), F.col("text").alias("caption"), F.col("doc_id").alias("row_pos"))


def image_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir)
    return i.select(F.lit(g.IMAGE).alias("node_type"), F.col("id").alias("node_idx"), F.col("id").cast("string").alias("ext_id"), F.lit(None).cast("string").alias("text"), F.col("embedding"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captions(spark, sf_dir)
    return image_nodes(spark, sf_dir).unionByName(c.select(F.lit(g.CAPTION).alias("node_type"), F.col("id").alias("node_idx"), F.col("id").cast("string").alias("ext_id"), "text", F.col("embedding").cast("array<float>").alias("embedding")))


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries read, made once for a session and input and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = keep(make(), name)
    return _kept[key]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's edges: images 8 nearest, captions 4 nearest, pairs and co-occurrence."""

    def make() -> DataFrame:
        i, c = images(spark, sf_dir), caption_vectors(spark, sf_dir)
        cap = c.select(F.col("id").alias("node_idx"), F.col("image").alias("image_id"))
        img = i.select(F.col("id").alias("ext_id"), F.col("id").alias("node_idx"))
        parts = [semantic_edges(i, 8, 8, g.IMAGE), semantic_edges(c, 4, 4, g.CAPTION), g.paired_edges(cap, img), g.cooccur_edges(cap)]
        return reduce(DataFrame.unionByName, [p.select(*g.EDGE) for p in parts])

    return kept(spark, sf_dir, "edges", make)


def synthetic_scores(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("s2", ((F.col("id") * 7 + F.col("query_id") * 13) % 101) / F.lit(101.0))
