"""Score normalisation, agreement and fusion.

Candidates are rows (query_id, id, rank1, s1, s2): stage-1 rank and score, and a stage-2 score that is null where none was given. All
windows are over query_id, so one shuffle serves them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("weighted", "rank_fusion", "replace")


@dataclass(frozen=True)
class FusionConfig:
    """inversion and weak: below the one, stage 2 is turned round; within the other, ranks are fused whatever the method."""

    method: str = "weighted"
    stage1_weight: float = 0.6
    stage2_weight: float = 0.4
    higher_is_better: bool = True
    inversion: float = -0.20
    weak: float = 0.15
    rrf_k: int = 60

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown fusion method {self.method}")


def min_max(x: Column, over) -> Column:
    """0 to 1 over the window; all zero where the values differ by less than 1e-8."""
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    return F.when(hi - lo < 1e-8, F.lit(0.0)).otherwise(F.try_divide(x - lo, hi - lo))


def correlation(a: Column, b: Column, over) -> Column:
    """Pearson's correlation over the window: 0 for three rows or fewer, null where either is constant."""
    flat = (F.max(a).over(over) == F.min(a).over(over)) | (F.max(b).over(over) == F.min(b).over(over))
    rho = F.try_divide(F.covar_pop(a, b).over(over), F.stddev_pop(a).over(over) * F.stddev_pop(b).over(over))
    return F.when(F.count(F.lit(1)).over(over) <= 3, F.lit(0.0)).when(~flat, rho)


def ordinal_ranks(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """row_number and dense_rank of a score, descending."""
    w = Window.partitionBy(group).orderBy(F.desc(score))
    return df.withColumn("ordinal", F.row_number().over(w.orderBy(F.desc(score), tie))).withColumn("dense", F.dense_rank().over(w))


def fuse(candidates: DataFrame, k: int, config: FusionConfig = FusionConfig()) -> DataFrame:
    """(query_id, rank, id, score, branch): the best k of each query.

    Stage 2 is oriented so that more is better. If it disagrees with stage 1 (correlation below ``inversion``) it is turned round and weighted .6 to
    .4; if they hardly correlate, reciprocal ranks are fused; else, or where the correlation is undefined, the configured method holds. A query
    without any stage-2 score keeps its stage-1 order. Ties go to the better stage-1 rank, then to the lesser id.
    """
    w = Window.partitionBy("query_id")
    s2 = F.col("s2") if config.higher_is_better else -F.col("s2")
    rows = candidates.withColumn("s2", s2).withColumn("_any", F.count("s2").over(w)).where((F.col("_any") == 0) | F.col("s2").isNotNull())
    rows = rows.withColumn("rho", correlation(F.col("s1"), F.col("s2"), w))
    branch = F.when(F.col("_any") == 0, "stage1").when(F.col("rho") < config.inversion, "inverted").when(F.abs("rho") < config.weak, "rank_fusion").otherwise(config.method)
    rows = rows.withColumn("branch", branch).withColumn("s2", F.when(F.col("branch") == "inverted", -F.col("s2")).otherwise(F.col("s2")))
    rows = rows.withColumn("n1", min_max(F.col("s1"), w)).withColumn("n2", min_max(F.col("s2"), w))
    rows = rows.withColumn("r1", F.row_number().over(w.orderBy(F.desc("s1"), "rank1", "id"))).withColumn("r2", F.row_number().over(w.orderBy(F.desc("s2"), "rank1", "id")))
    score = (
        F.when(F.col("branch") == "stage1", F.col("s1"))
        .when(F.col("branch") == "inverted", 0.6 * F.col("n1") + 0.4 * F.col("n2"))
        .when(F.col("branch") == "rank_fusion", 1 / (config.rrf_k + F.col("r1")) + 1 / (config.rrf_k + F.col("r2")))
        .when(F.col("branch") == "weighted", config.stage1_weight * F.col("n1") + config.stage2_weight * F.col("n2"))
        .otherwise(F.col("s2"))
    )
    rows = rows.withColumn("score", score)
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "rank1", "id"))).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "id", "score", "branch")


def fuse_signals(candidates: DataFrame, k: int, weights: tuple[float, float, float] = (0.7, 0.2, 0.1), weak: float = 0.15, skip: float = 0.05, rrf_k: int = 60) -> DataFrame:
    """Three signals (query_id, id, rank1, s1, s2, kg), missing ones null and counted as 0.

    Min-max of each and a weighted sum; with weak agreement of s1 and s2 reciprocal ranks over the signals there are; without any (below ``skip``) stage 2 is left out.
    """
    w = Window.partitionBy("query_id")
    rows = candidates.withColumn("rho", correlation(F.col("s1"), F.col("s2"), w))
    drop = F.coalesce(F.abs("rho") < skip, F.lit(False))
    rows = rows.withColumn("s2", F.when(~drop, F.col("s2")))
    parts = {"s1": weights[0], "s2": weights[1], "kg": weights[2]}
    linear, ranks = F.lit(0.0), F.lit(0.0)
    for c, weight in parts.items():
        rows = rows.withColumn(f"n_{c}", F.coalesce(min_max(F.col(c), w), F.lit(0.0))).withColumn(f"r_{c}", F.row_number().over(w.orderBy(F.desc_nulls_last(c), "rank1", "id")))
        linear, ranks = linear + weight * F.col(f"n_{c}"), ranks + F.when(F.col(c).isNotNull(), 1 / (rrf_k + F.col(f"r_{c}"))).otherwise(0.0)
    rows = rows.withColumn("score", F.when(F.abs("rho") < weak, ranks).otherwise(linear))
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "rank1", "id"))).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "id", "score")
