"""Aggregates over captions, scores and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count


def caption_counts(captions: DataFrame) -> DataFrame:
    return captions.agg(F.countDistinct("image_name").alias("n_images"), F.count("*").alias("n_captions"))


def caption_profile(captions: DataFrame) -> DataFrame:
    """Captions per image, and lengths of captions in characters and words. One pass: images are summed up before they are averaged."""
    n, words = F.length("caption"), word_count(F.col("caption"))
    own = captions.select("image_name", n.alias("chars"), words.alias("words"))
    per = own.groupBy("image_name").agg(F.count("*").alias("n"), F.count("chars").alias("m"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.min("words").alias("lo"), F.max("words").alias("hi"))
    return per.agg(
        F.count("*").alias("n_images"), F.sum("n").alias("n_captions"), F.avg("n").alias("captions_per_image"), F.min("n").alias("min_captions"), F.max("n").alias("max_captions"),
        (F.sum("chars") / F.sum("m")).alias("avg_chars"), (F.sum("words") / F.sum("m")).alias("avg_words"), F.min("lo").alias("min_words"), F.max("hi").alias("max_words"),
    )


def duplicate_ratio(df: DataFrame, column: str) -> DataFrame:
    return df.agg((1 - F.countDistinct(column) / F.count("*")).alias("duplicate_ratio"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most common values with their counts, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n) over equal bins from the least to the greatest value; the last bin holds its upper edge."""
    edges = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / width)))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # edges: one row


def latency_summary(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Per stage: count, mean, median, 95th and 99th percentile with linear interpolation."""
    return df.groupBy(stage).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.percentile(value, F.lit(0.99)).alias("p99"))


def score_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("var"), F.min(value).alias("min"), F.max(value).alias("max"))


def closest_setting(profiled: DataFrame, setting: str, latency: str, target: float) -> DataFrame:
    """One row: the setting whose latency is closest to the target, of equally close ones the first by name."""
    return profiled.agg(F.min_by(setting, F.struct(F.abs(F.col(latency) - target), setting)).alias(setting))


def hit_rates(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """Per group: look-ups, hits, and the share of look-ups that hit."""
    n = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return n.withColumn("hit_rate", F.col("hits") / F.col("n"))


def hit_rate(hits: int, misses: int) -> float:
    """Hits among all look-ups, 0 if there were none."""
    return hits / (hits + misses) if hits + misses else 0.0
