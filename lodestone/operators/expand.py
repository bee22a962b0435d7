"""Multi-hop expansion, graph scores and context."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import among, drop, keep
from .graph import CAPTION, IMAGE

TYPE_WEIGHTS = {"sem_sim": 1.0, "cooccur": 0.7, "paired_with": 1.0}


def _typed(edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return edges.where(F.col("edge_type").isin(list(weights))).select(F.col("src_type").alias("node_type"), F.col("src").alias("node_idx"), "dst_type", "dst", (F.col("weight").cast("double") * w[F.col("edge_type")]).alias("w"))


def beam_expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, beam: int = 20, decay: float = 0.85, most: int = 200, least_gain: float = 1e-3, weights: dict[str, float] = TYPE_WEIGHTS, cap_ms: float | None = None) -> DataFrame:
    """(query_id, node_type, node_idx, score, hop) from seeds (query_id, node_type, node_idx, score).

    On hop h a node passes score * decay ** h * edge weight * type weight to its neighbours; a node keeps its greatest score and first hop; the ``beam`` best
    new nodes with at least ``least_gain`` go on, and the ``most`` best nodes of each query are returned. What a hop reads several times is
    written to the shared folder and read again; there are a few thousand rows of it per query at most. With ``cap_ms`` no hop begins after so many milliseconds.
    """
    began = time.perf_counter()
    typed = _typed(edges, weights)
    keys = ["query_id", "node_type", "node_idx"]
    found = seeds.groupBy(*keys).agg(F.max("score").alias("score")).withColumn("hop", F.lit(0))
    front = found = keep(found, "found")
    for h in range(1, hops + 1):
        if cap_ms is not None and h > 1 and (time.perf_counter() - began) * 1000 > cap_ms:
            break
        step = front.join(typed, ["node_type", "node_idx"]).select("query_id", F.col("dst_type").alias("node_type"), F.col("dst").alias("node_idx"), (F.col("score") * decay**h * F.col("w")).alias("score"))
        step = keep(step.groupBy(*keys).agg(F.max("score").alias("score")).where(F.col("score") >= least_gain), "step")
        fresh = step.join(found.select(*keys), keys, "left_anti")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_type", "node_idx")
        before = front, found
        front = keep(fresh.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= beam).drop("_r").withColumn("hop", F.lit(h)), "front")
        again = step.join(found.select(*keys, "hop"), keys)
        found = keep(found.unionByName(again).unionByName(front).groupBy(*keys).agg(F.max("score").alias("score"), F.min("hop").alias("hop")), "found")
        drop(step, *before)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_type", "node_idx")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def candidate_images(expanded: DataFrame) -> DataFrame:
    return expanded.where(F.col("node_type") == IMAGE).groupBy("query_id", F.col("node_idx").alias("id")).agg(F.max("score").alias("score"))


def hop_scores(expanded: DataFrame) -> DataFrame:
    """1 / (1 + fewest hops from any seed)."""
    return expanded.select("query_id", "node_type", "node_idx", (1 / (1 + F.col("hop"))).alias("kg"))


def pagerank(seeds: DataFrame, edges: DataFrame, rounds: int = 3, restart: float = 0.15) -> DataFrame:
    """Personalised PageRank (query_id, node_type, node_idx, score) by a fixed number of rounds from equal mass on the seeds; mass at nodes without edges is lost."""
    keys = ["query_id", "node_type", "node_idx"]
    n = Window.partitionBy("query_id")
    start = seeds.select(*keys).distinct().withColumn("base", 1 / F.count("*").over(n))
    out = edges.select(F.col("src_type").alias("node_type"), F.col("src").alias("node_idx"), "dst_type", "dst").distinct()
    degree = out.groupBy("node_type", "node_idx").agg(F.count("*").alias("degree"))
    out = out.join(degree, ["node_type", "node_idx"])
    rank = start.withColumnRenamed("base", "score")
    for _ in range(rounds):
        spread = rank.join(out, ["node_type", "node_idx"]).select("query_id", F.col("dst_type").alias("node_type"), F.col("dst").alias("node_idx"), ((1 - restart) * F.col("score") / F.col("degree")).alias("score"))
        rank = spread.unionByName(start.select(*keys, (restart * F.col("base")).alias("score"))).groupBy(*keys).agg(F.sum("score").alias("score"))
    return rank


def edges_summary(expanded: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, edges_summary): a map from edge type to how many edges join two nodes that were reached for the query."""
    a = expanded.select("query_id", F.col("node_type").alias("src_type"), F.col("node_idx").alias("src"))
    b = expanded.select("query_id", F.col("node_type").alias("dst_type"), F.col("node_idx").alias("dst"))
    n = edges.join(a, ["src_type", "src"]).join(b, ["query_id", "dst_type", "dst"]).groupBy("query_id", "edge_type").agg(F.count("*").alias("n"))
    return n.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("edge_type", "n")))).alias("edges_summary"))


def context(expanded: DataFrame, captions: DataFrame, n_texts: int = 5, n_images: int = 4, chars: int = 120) -> DataFrame:
    """(query_id, texts, image_ids, caption_ids): the best captions' texts, cut, and the best images; captions (id, text)."""
    order = Window.partitionBy("query_id", "node_type").orderBy(F.desc("score"), "node_idx")
    top = expanded.withColumn("_r", F.row_number().over(order)).where(((F.col("node_type") == CAPTION) & (F.col("_r") <= n_texts)) | ((F.col("node_type") == IMAGE) & (F.col("_r") <= n_images)))
    top = keep(top, "top")
    wanted = top.where(F.col("node_type") == CAPTION).select(F.col("node_idx").alias("id"))
    named = top.join(among(captions, wanted, "id").select(F.col("id").alias("node_idx"), F.lit(CAPTION).alias("node_type"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text")), ["node_type", "node_idx"], "left")

    def listed(kind: str, column: str):
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("node_type") == kind, F.struct("_r", F.col(column).alias("v"))))), lambda x: x["v"])

    return named.groupBy("query_id").agg(listed(CAPTION, "text").alias("texts"), listed(IMAGE, "node_idx").alias("image_ids"), listed(CAPTION, "node_idx").alias("caption_ids"))
