"""Search by the graph, its evaluation and its ablation grid."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, replace
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import expand, fusion, metrics, seeds
from ..operators.search import Scorer, stage1


@dataclass(frozen=True)
class GraphConfig:
    k_seed: int = 10
    beam: int = 20
    hops: int = 2
    decay: float = 0.85
    kg_weight: float = 0.1
    rerank: bool = True


#: The settings that are tried against each other.
GRID = {"beam": [10, 20], "hops": [1, 2], "k_seed": [5, 10, 15], "decay": [0.8, 0.85, 0.9], "kg_weight": [0.05, 0.1, 0.2]}


def grid(base: GraphConfig = GraphConfig(), options: dict[str, list] = GRID) -> list[GraphConfig]:
    return [replace(base, **dict(zip(options, values, strict=True))) for values in product(*options.values())]


def graph_search(queries: DataFrame, images: DataFrame, captions: DataFrame, edges: DataFrame, scorer: Scorer, k: int = 10, k1: int = 30, config: GraphConfig = GraphConfig()) -> DataFrame:
    """(query_id, rank, id, score): seeds, guided expansion, images reached beside the k1 nearest ones, and a fusion of similarity, scorer and hops; without
    ``rerank`` the images reached come in order of their scores in the expansion."""
    start = seeds.seed_nodes(queries, images, captions, edges, config.k_seed)
    reached = expand.beam_expand(start, edges, config.hops, config.beam, config.decay)
    if not config.rerank:
        from ..operators.knn import top_k

        return top_k(expand.candidate_images(reached).select("query_id", "id", "score"), k)
    kg = expand.hop_scores(reached.where("node_type = 'image'")).select("query_id", F.col("node_idx").alias("id"), "kg")
    near = stage1(queries, images, k1)
    scored = scorer(near.select("query_id", "id")).select("query_id", "id", "s2")
    rows = near.join(scored, ["query_id", "id"], "left").join(kg, ["query_id", "id"], "left")
    left = 1 - config.kg_weight
    return fusion.fuse_signals(rows, k, (round(left * 7 / 9, 12), round(left * 2 / 9, 12), config.kg_weight))


def evaluate(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Metrics of results against each query's true image (column gt)."""
    return metrics.metrics(metrics.truth_ranks(results, queries.select("query_id", F.col("gt").alias("id"))))


def ablation(queries: DataFrame, images: DataFrame, captions: DataFrame, edges: DataFrame, scorer: Scorer, configs: list[GraphConfig]) -> list[dict]:
    """Settings, metrics, changes against plain similarity and milliseconds a query of each configuration; a job for each."""
    n = max(queries.count(), 1)
    base = evaluate(queries, stage1(queries, images, 10).select("query_id", F.col("rank1").alias("rank"), "id")).first().asDict()
    out = []
    for config in configs:
        began = time.perf_counter()
        got = evaluate(queries, graph_search(queries, images, captions, edges, scorer, config=config)).first().asDict()
        out.append(asdict(config) | got | {f"{m}_change": got[m] - base[m] for m in got if m != "n"} | {"ms": (time.perf_counter() - began) * 1000 / n})
    return out
