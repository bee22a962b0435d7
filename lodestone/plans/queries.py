"""One query per operator over the driver's tables, by name; ``oracles.py`` has the SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import vectors as fv
from ..operators import expand as ex
from ..operators import fusion as fu
from ..operators import graph as g
from ..operators import ingest, knn, metrics, profile, search, seeds
from ..sources import captions as src
from ..sources import stores
from ..streaming.search import windowed_latency
from . import derived as d
from . import graph_mode, jobs
from .engine import settings_grid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6


def query(run: Query) -> Query:
    """Registers a query; doubles are rounded and counts are longs, as in the oracle."""

    @wraps(run)
    def out(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        kinds = {"double": lambda c: F.round(c, DIGITS), "float": lambda c: F.round(F.col(c).cast("double"), DIGITS), "int": lambda c: F.col(c).cast("long"), "tinyint": lambda c: F.col(c).cast("long")}
        return df.select(*[kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])

    QUERIES[run.__name__] = out
    return out


def _near(spark: SparkSession, sf: str, k: int = 10, metric: str = "cosine") -> DataFrame:
    return knn.knn_join(d.queries(spark, sf), d.images(spark, sf), k, metric)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return d.synthetic_scores(search.stage1(d.queries(spark, sf), d.images(spark, sf), 30))


def _hybrid(spark: SparkSession, sf: str, available: DataFrame | None = None) -> DataFrame:
    return search.hybrid_search(d.queries(spark, sf), d.images(spark, sf), d.synthetic_scores, 30, 10, available=available)


def _seeds(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    return d.kept(spark, sf, f"seeds{k}", lambda: seeds.seed_nodes(d.queries(spark, sf), d.images(spark, sf), d.caption_vectors(spark, sf), d.edges(spark, sf), k))


def _expanded(spark: SparkSession, sf: str) -> DataFrame:
    return ex.beam_expand(_seeds(spark, sf), d.edges(spark, sf), 2, 20)


# captions


@query
def caption_counts(spark, sf):
    return profile.caption_counts(d.caption_table(spark, sf))


@query
def captions_of_image(spark, sf):
    return ingest.captions_of(d.caption_table(spark, sf), "src3").select("row_pos", "caption")


@query
def caption_regex_search(spark, sf):
    return ingest.search_captions(d.caption_table(spark, sf), "th[ae]r+e", False, 50).select("row_pos", "image_name")


@query
def valid_captions(spark, sf):
    return ingest.valid_captions(d.caption_table(spark, sf)).select("row_pos")


@query
def first_n_images(spark, sf):
    return ingest.first_images(d.caption_table(spark, sf), 5).select("image_name", "row_pos")


@query
def caption_key(spark, sf):
    return ingest.with_caption_key(d.caption_table(spark, sf)).select("row_pos", "caption_id")


@query
def captions_by_image(spark, sf):
    return ingest.captions_by_image(d.caption_table(spark, sf)).select("image_name", F.concat_ws(",", "caption_ids").alias("caption_ids"))


@query
def hash_sample(spark, sf):
    return ingest.hash_sample(d.table(spark, sf, "documents"), "doc_id", 20, 42).select("doc_id")


@query
def test_queries(spark, sf):
    return ingest.test_queries(d.caption_table(spark, sf, "image"), 25).select("query", "ground_truth", F.size("alternatives").alias("n_alternatives"))


@query
def systematic_sample(spark, sf):
    return ingest.every_nth(d.table(spark, sf, "documents"), "doc_id", 10).select("doc_id")


@query
def available_captions(spark, sf):
    good = d.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("row_pos"))
    return d.caption_table(spark, sf).join(good, "row_pos", "left_semi").select("row_pos", "image_name")


@query
def caption_profile(spark, sf):
    return profile.caption_profile(d.caption_table(spark, sf))


@query
def unique_images(spark, sf):
    return ingest.image_order(d.caption_table(spark, sf))


@query
def duplicate_ratio(spark, sf):
    return profile.duplicate_ratio(d.caption_table(spark, sf), "caption")


@query
def top_captions(spark, sf):
    return profile.top_values(d.caption_table(spark, sf), "caption", 10)


@query
def caption_histogram(spark, sf):
    return profile.histogram(d.table(spark, sf, "documents"), "n_chars", 50)


@query
def latency_summary(spark, sf):
    return profile.latency_summary(d.table(spark, sf, "events"), "event_type", "value")


@query
def score_summary(spark, sf):
    return profile.score_summary(d.table(spark, sf, "events"), "event_type", "value")


@query
def windowed_latencies(spark, sf):
    return windowed_latency(d.table(spark, sf, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "mean")


# vectors


@query
def l2_normalize(spark, sf):
    v = d.images(spark, sf).select("id", fv.l2_normalize(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return v.select("id", F.col("v")[0].alias("first"), fv.norm(F.col("v")).alias("norm"))


@query
def unit_norm_check(spark, sf):
    return fv.unit_norm_report(d.images(spark, sf))


@query
def vector_checks(spark, sf):
    return d.images(spark, sf).agg(F.count_if(~fv.is_finite(F.col("embedding"))).alias("not_finite"), F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim"))


@query
def query_vectors(spark, sf):
    return d.queries(spark, sf).select("query_id", "gt", F.col("embedding")[0].alias("first"), fv.total(F.col("embedding")).alias("total"))


# nearest neighbours


@query
def knn_cosine_top10(spark, sf):
    return _near(spark, sf)


@query
def knn_cosine_top10_sql(spark, sf):
    units = d.images(spark, sf).withColumn("embedding", fv.l2_normalize(F.col("embedding")))
    return knn.knn_join_sql(d.queries(spark, sf), units, 10)


@query
def knn_euclidean_top10(spark, sf):
    return _near(spark, sf, metric="euclidean")


@query
def ivf_probe_topk(spark, sf):
    i = d.images(spark, sf)
    c = knn.label_centroids(i)
    return knn.ivf_search(d.queries(spark, sf), i.select("id", "embedding", F.col("label").cast("long").alias("list_id")), c, 10, 2)


@query
def lsh_topk(spark, sf):
    return knn.lsh_search(d.queries(spark, sf), d.images(spark, sf), 10)


@query
def semantic_edges(spark, sf):
    return knn.semantic_edges(d.images(spark, sf), 16, 8, g.IMAGE).select("src", "dst", "rank", "weight")


# search and fusion


@query
def stage1_retrieve(spark, sf):
    return search.stage1(d.queries(spark, sf), d.images(spark, sf), 30)


@query
def jaccard_rerank(spark, sf):
    q, c = d.queries(spark, sf), d.caption_vectors(spark, sf)
    return search.jaccard_scorer(q, d.caption_texts(spark, sf))(search.stage1(q, c, 20)).select("query_id", "id", "rank1", "s2")


@query
def yesno_probability(spark, sf):
    e = d.table(spark, sf, "events")
    logits = e.select("event_id", F.array(F.col("value") / 50, F.col("event_id") % 7 / 3).alias("yes"), F.array(F.col("value") / 40, F.lit(0.5)).alias("no"))
    return logits.select("event_id", ft.yes_probability(F.col("yes"), F.col("no")).alias("p"))


@query
def prompts(spark, sf):
    return d.table(spark, sf, "benchmark").select("item_id", ft.yes_no_prompt(F.col("text")).alias("prompt"))


@query
def names_and_numbers(spark, sf):
    p = d.table(spark, sf, "part")
    return p.select("p_partkey", ft.safe_name(F.col("p_brand"), F.col("p_type")).alias("name"), ft.grouped_number(F.col("p_partkey") * 1000).alias("shown"))


@query
def minmax_norm(spark, sf):
    w = Window.partitionBy("l_suppkey")
    return d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fu.min_max(F.col("l_extendedprice"), w).alias("z"))


@query
def agreement_corr(spark, sf):
    w = Window.partitionBy("query_id")
    return _candidates(spark, sf).withColumn("rho", fu.correlation(F.col("s1"), F.col("s2"), w)).groupBy("query_id").agg(F.first("rho").alias("rho"))


def _plain(spark, sf, method):
    return fu.fuse(_candidates(spark, sf), 10, fu.FusionConfig(method, inversion=-2, weak=-1)).drop("branch")


@query
def fusion_weighted(spark, sf):
    return _plain(spark, sf, "weighted")


@query
def fusion_rrf(spark, sf):
    return _plain(spark, sf, "rank_fusion")


@query
def fusion_replace(spark, sf):
    return _plain(spark, sf, "replace")


@query
def hybrid_search(spark, sf):
    return _hybrid(spark, sf)


@query
def hybrid_gate_branches(spark, sf):
    return _hybrid(spark, sf).groupBy("branch").agg(F.countDistinct("query_id").alias("n"))


@query
def hybrid_with_missing(spark, sf):
    return _hybrid(spark, sf, d.images(spark, sf).where("id % 3 = 0"))


@query
def ordinal_and_dense_rank(spark, sf):
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("price"))
    return fu.ordinal_ranks(o, "o_orderstatus", "price", "o_orderkey")


@query
def text_to_image(spark, sf):
    return search.batch_search(d.queries(spark, sf), d.images(spark, sf), "text_to_image", 5)


@query
def image_to_text(spark, sf):
    q = d.images(spark, sf).select(F.col("id").alias("query_id"), "embedding")
    return search.image_to_text(q, d.caption_vectors(spark, sf), 3, d.caption_texts(spark, sf))


@query
def image_to_image(spark, sf):
    q = d.images(spark, sf).select(F.col("id").alias("query_id"), "embedding")
    return search.image_to_image(q, d.images(spark, sf), 5, exclude_self=True)


@query
def image_to_image_hybrid(spark, sf):
    q = d.images(spark, sf).select(F.col("id").alias("query_id"), "embedding")
    return search.image_to_image_hybrid(q, d.images(spark, sf), 50, 10)


@query
def mmr_top5(spark, sf):
    near = _near(spark, sf, 30).join(d.images(spark, sf), "id")
    return search.mmr(near.select("query_id", "id", "score", "embedding"), 5)


# graph


@query
def node_index(spark, sf):
    return g.node_index(d.caption_table(spark, sf), "image_name", "row_pos")


@query
def paired_edges(spark, sf):
    c = d.caption_images(spark, sf).select(F.col("id").alias("node_idx"), F.col("image").alias("image_id"))
    i = d.images(spark, sf).select(F.col("id").alias("ext_id"), F.col("id").alias("node_idx"))
    return g.paired_edges(c, i).select("src", "dst")


@query
def unpaired_captions(spark, sf):
    c = d.caption_images(spark, sf).select(F.col("id").alias("node_idx"), F.col("image").alias("image_id"))
    i = d.images(spark, sf).where("label <> 1").select(F.col("id").alias("ext_id"), F.col("id").alias("node_idx"))  # images of one class aren't known
    return g.unpaired(c, i).select("node_idx")


@query
def cooccur_edges(spark, sf):
    return g.cooccur_edges(d.caption_images(spark, sf).select(F.col("id").alias("node_idx"), F.col("image").alias("image_id"))).select("src", "dst")


@query
def graph_edge_counts(spark, sf):
    return g.edge_counts(d.edges(spark, sf))


@query
def graph_validation(spark, sf):
    return g.validation_report(d.nodes(spark, sf), d.edges(spark, sf))


@query
def out_degree(spark, sf):
    return g.out_degree(d.nodes(spark, sf), d.edges(spark, sf))


@query
def cross_type_links(spark, sf):
    c = d.caption_vectors(spark, sf).select(F.col("id").alias("query_id"), "embedding")
    return knn.knn_join(c, d.images(spark, sf), 2)


@query
def seed_nodes(spark, sf):
    return _seeds(spark, sf)


@query
def token_counts(spark, sf):
    t = d.table(spark, sf, "documents").select(F.explode(ft.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


@query
def neighbour_captions(spark, sf):
    return seeds.neighbour_captions(_seeds(spark, sf), d.edges(spark, sf))


def _terms(spark, sf):
    gathered = seeds.neighbour_captions(_seeds(spark, sf), d.edges(spark, sf))
    return seeds.top_terms(seeds.term_counts(gathered, d.caption_texts(spark, sf)), 5)


@query
def bigram_top_terms(spark, sf):
    return _terms(spark, sf).select("query_id", "term_rank", "term", "n")


@query
def enrich_query(spark, sf):
    return seeds.enrich(d.queries(spark, sf), _terms(spark, sf))


@query
def tfidf_terms(spark, sf):
    return seeds.tfidf_terms(d.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 3)


# evaluation


def _ranks(spark, sf, results):
    return metrics.truth_ranks(results, d.queries(spark, sf).select("query_id", F.col("gt").alias("id")))


@query
def truth_rank(spark, sf):
    return _ranks(spark, sf, _near(spark, sf))


@query
def eval_metrics(spark, sf):
    return metrics.metrics(_ranks(spark, sf, _near(spark, sf)))


@query
def method_compare(spark, sf):
    one, two = (metrics.metrics(_ranks(spark, sf, r)) for r in (_near(spark, sf), _hybrid(spark, sf)))
    return metrics.compare(one, two)


@query
def settings(spark, sf):
    k1 = spark.createDataFrame([(20,), (50,), (100,)], "k1 long")
    return settings_grid(k1, spark.createDataFrame([(5,), (10,), (50,)], "k2 long"))


@query
def closest_setting(spark, sf):
    e = d.table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("ms"))
    return profile.closest_setting(e, "event_type", "ms", 50)


# expansion


@query
def beam_expand(spark, sf):
    return _expanded(spark, sf)


@query
def candidate_images(spark, sf):
    return ex.candidate_images(_expanded(spark, sf))


@query
def kg_min_hops(spark, sf):
    return ex.hop_scores(_expanded(spark, sf))


@query
def kg_ppr(spark, sf):
    rank = ex.pagerank(_seeds(spark, sf), d.edges(spark, sf).where("edge_type <> 'cooccur'"), 3)
    return rank.select("query_id", "node_type", "node_idx", F.log("score").alias("log_score"))  # scores are short decimals, which sums in another order round both ways


@query
def kg_fusion(spark, sf):
    kg = ex.hop_scores(_expanded(spark, sf)).where("node_type = 'image'").select("query_id", F.col("node_idx").alias("id"), "kg")
    return fu.fuse_signals(_candidates(spark, sf).join(kg, ["query_id", "id"], "left"), 10)


@query
def context_payload(spark, sf):
    c = ex.context(_expanded(spark, sf), d.caption_texts(spark, sf))
    return c.select("query_id", F.concat_ws("|", "texts").alias("texts"), F.concat_ws(",", F.col("image_ids").cast("array<string>")).alias("image_ids"), F.concat_ws(",", F.col("caption_ids").cast("array<string>")).alias("caption_ids"))


# sources and sinks


@query
def load_captions(spark, sf):
    path = d.scratch(spark, "captions")
    p = d.table(spark, sf, "part").select(F.concat(F.col("p_brand"), F.lit(" | "), F.col("p_partkey").cast("string"), F.lit(" |  "), F.col("p_name"), F.lit(" ")).alias("value"))
    p.write.text(path)
    return src.load_captions(spark, path, header=False).select("image_name", "comment_number", "caption")


@query
def load_captions_counts(spark, sf):
    path = d.scratch(spark, "captions")
    p = d.table(spark, sf, "part").select(F.concat_ws(" | ", "p_brand", F.col("p_partkey").cast("string"), "p_name").alias("value"))
    p.write.text(path)
    return profile.caption_counts(src.load_captions(spark, path, header=False))


@query
def embeddings_store(spark, sf):
    path = d.scratch(spark, "embeddings")
    stores.save_embeddings(d.images(spark, sf).select("id", "embedding"), path, {"model": "given"})
    rows, meta = stores.load_embeddings(spark, path)
    return rows.select("id", fv.total(fv.doubles(F.col("embedding"))).alias("total"), F.lit(meta["model"]).alias("model"))


@query
def index_store(spark, sf):
    path = d.scratch(spark, "index")
    i = d.images(spark, sf).select("id", "embedding", F.col("label").cast("long").alias("list_id"))
    stores.save_index(i, stores.IndexSpec(64, "ivf", nlist=10, nprobe=2), path, knn.label_centroids(d.images(spark, sf)))
    return jobs.open_index(spark, path)(d.queries(spark, sf), 10)


@query
def index_stats(spark, sf):
    path = d.scratch(spark, "index")
    jobs.build_index(d.images(spark, sf), stores.IndexSpec(64), path)
    rows, spec = stores.load_index(spark, path)
    more = rows.select((F.col("id") + 1_000_000).alias("id"), "embedding")
    return stores.index_stats(knn.add_rows(rows, more), spec)


@query
def index_add_keeps_ids(spark, sf):
    i = d.images(spark, sf).select("id", "embedding")
    grown = knn.add_rows(i, i.select((F.col("id") + 1_000_000).alias("id"), "embedding"))
    return knn.knn_join(d.queries(spark, sf), grown, 4)


@query
def ivf_trained_recall(spark, sf):
    lists, centroids = knn.build_ivf(d.images(spark, sf), 16)
    found = knn.ivf_search(d.queries(spark, sf), lists, centroids, 10, 12)
    return knn.recall(found, _near(spark, sf)).select("n", (F.col("recall") >= 0.9).alias("enough"))


@query
def lsh_recall(spark, sf):
    found = knn.lsh_search(d.queries(spark, sf), d.images(spark, sf), 10)
    return knn.recall(found, _near(spark, sf)).select("n", (F.col("recall") >= 0.9).alias("enough"))


@query
def search_without_index(spark, sf):
    return knn.search_index(d.queries(spark, sf), d.images(spark, sf), 10, None)


@query
def graph_store(spark, sf):
    path = d.scratch(spark, "graph")
    stores.save_graph(d.nodes(spark, sf), d.edges(spark, sf), path)
    nodes, edges = stores.load_graph(spark, path, 64)
    n = nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n"), F.count("text").alias("n_texts"))
    return n.unionByName(edges.groupBy(F.concat_ws("-", "src_type", "edge_type").alias("kind")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_texts")))


@query
def graph_pipeline(spark, sf):
    c = d.captions(spark, sf).select("id", F.col("image").alias("image_id"), "text", "embedding", F.col("id").alias("row_pos"))
    i = d.images(spark, sf).select(F.col("id").alias("image_id"), "embedding")
    nodes, edges = jobs.build_stored_graph(c, i, d.scratch(spark, "graph"), 8, 8, 64)
    return g.edge_counts(edges)


@query
def results_store(spark, sf):
    path = d.scratch(spark, "results")
    stores.save_results(metrics.metrics(_ranks(spark, sf, _near(spark, sf))), path)
    return spark.read.json(path).select("n", "recall_at_10", "mrr")


@query
def node_json(spark, sf):
    return g.node_json(d.image_nodes(spark, sf)).select("node_idx", F.get_json_object("json", "$.ext_id").alias("ext_id"), F.get_json_object("json", "$.node_type").alias("node_type"))


# alignment, scorers and gates


@query
def aligned_vectors(spark, sf):
    threefold = d.images(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    return fv.aligned(threefold, 64).select("id", F.col("embedding")[0].alias("first"), fv.norm(F.col("embedding")).alias("norm"))


@query
def encode_given_vectors(spark, sf):
    given = d.images(spark, sf).select("id", F.transform("embedding", lambda x: x.cast("double") * 2).alias("query"))
    return search.encode_query(given, "vector", 64).select("id", F.col("embedding")[1].alias("second"), fv.norm(F.col("embedding")).alias("norm"))


@query
def fusion_lower_is_better(spark, sf):
    return fu.fuse(_candidates(spark, sf), 10, fu.FusionConfig(higher_is_better=False))


@query
def fusion_constant_scores(spark, sf):
    return fu.fuse(_candidates(spark, sf).withColumn("s2", F.lit(0.5)), 10)


@query
def yesno_missing(spark, sf):
    e = d.table(spark, sf, "events")
    none = F.lit(None).cast("array<double>")
    logits = e.select("event_id", F.when(F.col("event_type") != "click", F.array(F.col("value") / 50)).otherwise(none).alias("yes"), F.array(F.lit(0.5)).alias("no"))
    return logits.select("event_id", ft.yes_probability(F.col("yes"), F.col("no")).alias("p"))


@query
def hit_rates(spark, sf):
    return profile.hit_rates(d.table(spark, sf, "events"), "event_type", F.col("value") < 20)


@query
def hybrid_captions_jaccard(spark, sf):
    q, c = d.queries(spark, sf), d.caption_vectors(spark, sf)
    return search.hybrid_search(q, c, search.jaccard_scorer(q, d.caption_texts(spark, sf)), 30, 10)


# graph mode


@query
def edges_summary(spark, sf):
    s = ex.edges_summary(_expanded(spark, sf), d.edges(spark, sf))
    return s.select("query_id", F.concat_ws(",", F.transform(F.array_sort(F.map_entries("edges_summary")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))).alias("edges_summary"))


@query
def graph_mode_metrics(spark, sf):
    q, i, c, e = d.queries(spark, sf), d.images(spark, sf), d.caption_vectors(spark, sf), d.edges(spark, sf)
    return graph_mode.evaluate(q, graph_mode.graph_search(q, i, c, e, d.synthetic_scores, config=graph_mode.GraphConfig(k_seed=5)))


@query
def ablation_grid(spark, sf):
    rows = [(c.beam, c.hops, c.k_seed, c.decay, c.kg_weight) for c in graph_mode.grid()]
    return spark.createDataFrame(rows, "beam long, hops long, k_seed long, decay double, kg_weight double")
