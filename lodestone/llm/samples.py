"""Folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sample_ids(rows: DataFrame, group: str, most: int) -> DataFrame:
    """(doc_id, group) of at most ``most`` rows of each of a few groups, the first by the id's hash.

    A threshold on the hash, from each group's count, leaves little more than ``most`` rows of a group to be ranked.
    """
    sizes = rows.groupBy(group).count().collect()  # a row per group
    h, steps = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), 1 << 30
    below = F.lit(0)
    for r in sizes:
        below = F.when(F.col(group) == r[0], int(min(1.0, (1.2 * most + 200) / r[1]) * steps)).otherwise(below)
    near = rows.select("doc_id", group).where(h < below)
    order = Window.partitionBy(group).orderBy(h, "doc_id")
    # the least hashes, of those below the threshold
    return near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
