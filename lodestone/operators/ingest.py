"""Filters, samples and keys of caption tables: (image_name, comment_number, caption, row_pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def captions_of(captions: DataFrame, image: str) -> DataFrame:
    return captions.where(F.col("image_name") == image).orderBy("row_pos")


def search_captions(captions: DataFrame, pattern: str, case_sensitive: bool = False, max_results: int | None = None) -> DataFrame:
    """Captions that hold a match of a regular expression, in row order; a null caption matches nothing."""
    found = captions.where(F.coalesce(F.col("caption").rlike(("" if case_sensitive else "(?i)") + pattern), F.lit(False)))
    return found if max_results is None else found.orderBy("row_pos").limit(max_results)


def valid_captions(captions: DataFrame) -> DataFrame:
    """Not null, not blank, not the word nan."""
    return captions.where(F.col("caption").isNotNull() & (F.trim("caption") != "") & (F.col("caption") != "nan"))


def image_order(captions: DataFrame) -> DataFrame:
    """Distinct images with the position at which each one first appears."""
    return captions.groupBy("image_name").agg(F.min("row_pos").alias("first_pos"))


def first_images(captions: DataFrame, n: int) -> DataFrame:
    """All captions of the first n images."""
    return captions.join(image_order(captions).orderBy("first_pos").limit(n), "image_name", "left_semi")


def with_caption_key(captions: DataFrame) -> DataFrame:
    return captions.withColumn("caption_id", F.concat_ws("#", "image_name", "comment_number"))


def captions_by_image(captions: DataFrame) -> DataFrame:
    """Each image with its caption ids in row order."""
    pairs = F.sort_array(F.collect_list(F.struct("row_pos", "caption_id")))
    return with_caption_key(captions).groupBy("image_name").agg(pairs.alias("p")).select("image_name", F.col("p.caption_id").alias("caption_ids"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the same ones for the same seed at any partitioning: the first by md5 of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), key).limit(n)


def test_queries(captions: DataFrame, n: int = 25, seed: int = 2025) -> DataFrame:
    """n images with a caption: the first caption is the query, the image its ground truth, the other captions alternatives."""
    ordered = F.sort_array(F.collect_list(F.struct("row_pos", "caption")))
    per = captions.where("caption is not null").groupBy("image_name").agg(ordered.alias("p"))
    picked = hash_sample(per, "image_name", n, seed)
    return picked.select(F.col("p")[0]["caption"].alias("query"), F.col("image_name").alias("ground_truth"), F.slice(F.col("p.caption"), F.lit(2), F.size("p")).alias("alternatives"))


def positions(df: DataFrame, order: str, cell: int = 1_000_000, tie: str | None = None) -> DataFrame:
    """The rows with their place (column _k, from 0) in the order of a number, then of ``tie``: places within cells of that number, plus the rows in the cells before."""
    rows = df.withColumn("_cell", F.floor(F.col(order) / cell))
    counts = rows.groupBy("_cell").agg(F.count("*").alias("_n"))  # a row per cell
    before = counts.select("_cell", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_cell").orderBy(*[c for c in (order, tie) if c])) - 1)
    return ranked.join(before, "_cell").withColumn("_k", F.col("_base") + F.col("_r")).drop("_cell", "_r", "_base")


def every_nth(df: DataFrame, order: str, n_samples: int) -> DataFrame:
    """Systematic sample: of N rows in order, each (N / n_samples)-th from the first. Positions come from a table of the order column alone."""
    step = max(1, df.count() // n_samples)
    place = positions(df.select(order), order)
    return df.join(place.where(F.col("_k") % step == 0).select(order), order, "left_semi")
