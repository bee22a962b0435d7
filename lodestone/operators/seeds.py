"""Seed nodes of a query and its enrichment by the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import among, keep
from .graph import CAPTION, COOCCUR, IMAGE, PAIRED_WITH, SEM_SIM
from .knn import knn_join


def seed_nodes(queries: DataFrame, images: DataFrame, captions: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(query_id, seed_rank, node_type, node_idx, score): the best k of each query's k nearest images, k nearest captions, and the captions
    paired with those images that aren't among them, which have their image's score. Ties: images, captions, paired ones, then by index."""
    per = [knn_join(queries, nodes, k).select("query_id", F.lit(kind).alias("node_type"), F.col("id").alias("node_idx"), "score", F.lit(i).alias("source")) for i, (kind, nodes) in enumerate(((IMAGE, images), (CAPTION, captions)))]
    base = per[0].unionByName(per[1])
    pairs = edges.where(F.col("edge_type") == PAIRED_WITH).select(F.col("dst").alias("node_idx"), F.col("src").alias("caption"))
    extra = per[0].join(pairs, "node_idx").groupBy("query_id", "caption").agg(F.max("score").alias("score"))
    extra = extra.select("query_id", F.lit(CAPTION).alias("node_type"), F.col("caption").alias("node_idx"), "score", F.lit(2).alias("source")).join(per[1].select("query_id", "node_idx"), ["query_id", "node_idx"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "node_idx")
    both = base.unionByName(extra).withColumn("seed_rank", F.row_number().over(order)).where(F.col("seed_rank") <= k)
    return both.select("query_id", "seed_rank", "node_type", "node_idx", "score")


def neighbour_captions(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, seed_rank, path, via, caption), with repeats: for an image its captions (path 0), then those of similar images (1); for a caption similar captions
    (2), those of the same image by co-occurrence (3), then the captions of its images, itself among them (4)."""

    def of(kind: str, src: str) -> DataFrame:
        return edges.where((F.col("edge_type") == kind) & (F.col("src_type") == src)).select("src", "dst")

    pair = of(PAIRED_WITH, CAPTION)
    back = pair.select(F.col("dst").alias("image"), F.col("src").alias("caption"))
    i = seeds.where(F.col("node_type") == IMAGE).select("query_id", "seed_rank", F.col("node_idx").alias("src"))
    c = seeds.where(F.col("node_type") == CAPTION).select("query_id", "seed_rank", F.col("node_idx").alias("src"))

    def path(df: DataFrame, n: int, via: str) -> DataFrame:
        return df.select("query_id", "seed_rank", F.lit(n).alias("path"), F.col(via).alias("via"), "caption")

    own = path(i.withColumnRenamed("src", "image").join(back, "image"), 0, "image")
    near = path(i.join(of(SEM_SIM, IMAGE), "src").withColumnRenamed("dst", "image").join(back, "image"), 1, "image")
    sem = path(c.join(of(SEM_SIM, CAPTION), "src").withColumn("caption", F.col("dst")), 2, "src")
    co = path(c.join(of(COOCCUR, CAPTION), "src").withColumn("caption", F.col("dst")), 3, "src")
    same = path(c.join(pair, "src").withColumnRenamed("dst", "image").join(back, "image"), 4, "image")
    return own.union(near).union(sem).union(co).union(same)


def term_counts(gathered: DataFrame, captions: DataFrame) -> DataFrame:
    """(query_id, term, n, is_bigram, first_pos) over the gathered captions' tokens in order, bigrams across caption ends too; captions (id, text).

    A caption's tokens stay one row until they are counted; the last token before each caption comes with it for the bigram between them.
    """
    gathered = keep(gathered, "gathered")  # only what was gathered is cut into tokens
    texts = among(captions, gathered.select(F.col("caption").alias("id")), "id").select(F.col("id").alias("caption"), tokens(F.coalesce("text", F.lit(""))).alias("tok"))
    order = Window.partitionBy("query_id").orderBy("seed_rank", "path", "via", "caption")
    rows = gathered.join(texts, "caption").where(F.size("tok") > 0)
    rows = rows.withColumn("base", F.coalesce(F.sum(F.size("tok")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("before", F.lag(F.element_at("tok", -1)).over(order))
    # a token beside the one before it, which makes its bigram: one scan gives both
    shifted = F.concat(F.array("before"), F.slice("tok", F.lit(1), F.size("tok") - 1))
    each = rows.select("query_id", "base", F.posexplode(F.arrays_zip(F.col("tok").alias("tok"), shifted.alias("prev"))).alias("at", "w"))
    pos = F.col("base") + F.col("at")
    terms = F.array(F.struct(F.col("w.tok").alias("term"), F.lit(0).alias("is_bigram"), pos.alias("pos")), F.struct(F.when(F.col("w.prev").isNotNull(), F.concat_ws(" ", "w.prev", "w.tok")).alias("term"), F.lit(1).alias("is_bigram"), (pos - 1).alias("pos")))
    both = each.select("query_id", F.inline(terms)).where("term is not null")
    return both.groupBy("query_id", "term", "is_bigram").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def top_terms(counts: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "is_bigram", "first_pos", "term")
    return counts.withColumn("term_rank", F.row_number().over(order)).where(F.col("term_rank") <= n)


def enrich(queries: DataFrame, top: DataFrame) -> DataFrame:
    """(query_id, enriched): the text with ``; term`` for each top term in order; as it was for a query without terms."""
    listed = top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term_rank", "term"))).alias("t"))
    return queries.join(listed, "query_id", "left").select("query_id", F.when(F.col("t").isNull(), F.col("text")).otherwise(F.concat_ws("; ", "text", F.col("t.term"))).alias("enriched"))


def tfidf_terms(docs: DataFrame, n: int) -> DataFrame:
    """(id, term, tfidf, term_rank): the n terms of each document (id, text) by count * ln((N + 1) / (df + 1))."""
    tf = docs.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads tf, so that its shuffle is used for both
    total = docs.agg(F.count("*").alias("total"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(total)).withColumn("tfidf", F.col("tf") * F.log((F.col("total") + 1) / (F.col("df") + 1)))  # total: one row
    order = Window.partitionBy("id").orderBy(F.desc(F.round("tfidf", 9)), "term")
    return scored.withColumn("term_rank", F.row_number().over(order)).where(F.col("term_rank") <= n).select("id", "term", "tfidf", "term_rank")
