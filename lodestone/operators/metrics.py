"""Retrieval metrics over (query_id, rank), rank null where the truth wasn't found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth_ranks(results: DataFrame, truth: DataFrame) -> DataFrame:
    """The rank of each query's truth (query_id, id) in results (query_id, rank, id)."""
    return truth.join(results.select("query_id", "id", "rank"), ["query_id", "id"], "left").select("query_id", "rank")


def recall_at(k: int) -> Column:
    return F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))


def ndcg_at(k: int) -> Column:
    return F.avg(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))


def metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: n, recall_at_k, mrr, map (equal to mrr with one truth), ndcg_at_10."""
    mrr = F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0)))
    return ranks.agg(F.count("*").alias("n"), *[recall_at(k).alias(f"recall_at_{k}") for k in ks], mrr.alias("mrr"), mrr.alias("map"), ndcg_at(10).alias("ndcg_at_10"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, base, other, delta, percent) of two rows of metrics; percent null where the base is 0."""

    def long(d: DataFrame, to: str) -> DataFrame:
        names = [c for c in d.columns if c != "n"]
        return d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias(to)) for c in names])).alias("x")).select("x.*")

    both = long(a, "base").join(long(b, "other"), "metric")
    delta = F.col("other") - F.col("base")
    return both.select("metric", "base", "other", delta.alias("delta"), F.try_divide(delta * 100, F.col("base")).alias("percent"))
