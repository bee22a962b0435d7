"""The property graph: nodes(node_type, node_idx, ext_id, text, embedding) and edges(src_type, src, edge_type, dst_type, dst, weight)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from .ingest import positions
from .knn import semantic_edges

IMAGE, CAPTION, REGION = "image", "caption", "region"
SEM_SIM, PAIRED_WITH, COOCCUR = "sem_sim", "paired_with", "cooccur"
#: Kinds of nodes, kinds of edges.
NODE_TYPES, EDGE_TYPES = (IMAGE, CAPTION, REGION), (SEM_SIM, PAIRED_WITH, COOCCUR)
EDGE = ["src_type", "src", "edge_type", "dst_type", "dst", "weight"]


def node_index(df: DataFrame, ext_id: str, position: str) -> DataFrame:
    """Dense indices from 0 in order of first appearance: ranks within ranges of positions, plus the rows in ranges before."""
    firsts = df.groupBy(F.col(ext_id).alias("ext_id")).agg(F.min(position).alias("first_pos"))
    return positions(firsts, "first_pos", tie="ext_id").select("ext_id", F.col("_k").cast("long").alias("node_idx"))


def _edges(df: DataFrame, src_type: str, kind: str, dst_type: str) -> DataFrame:
    return df.select(F.lit(src_type).alias("src_type"), "src", F.lit(kind).alias("edge_type"), F.lit(dst_type).alias("dst_type"), "dst", F.lit(1.0).cast("float").alias("weight"))


def paired_edges(captions: DataFrame, images: DataFrame) -> DataFrame:
    """captions (node_idx, image_id) to images (node_idx, ext_id); captions of unknown images have none."""
    i = images.select(F.col("ext_id").alias("image_id"), F.col("node_idx").alias("dst"))
    return _edges(captions.select(F.col("node_idx").alias("src"), "image_id").join(i, "image_id"), CAPTION, PAIRED_WITH, IMAGE)


def unpaired(captions: DataFrame, images: DataFrame) -> DataFrame:
    return captions.join(images.select(F.col("ext_id").alias("image_id")), "image_id", "left_anti")


def cooccur_edges(captions: DataFrame) -> DataFrame:
    """All ordered pairs of different captions (node_idx, image_id) of one image: the result itself has a row per pair."""
    a = captions.where("image_id is not null").select("image_id", F.col("node_idx").alias("src"))
    return _edges(a.join(a.withColumnRenamed("src", "dst"), "image_id").where("src <> dst"), CAPTION, COOCCUR, CAPTION)


def assemble(nodes: DataFrame, *edges: DataFrame, dim: int | None = None, normalize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and all edges as two tables, with a check of both. Raises ValueError."""
    if normalize:
        nodes = nodes.withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>"))
    joined = reduce(DataFrame.unionByName, [e.select(*EDGE) for e in edges])
    bad = [r.check for r in validation_report(nodes, joined, dim).collect() if r.violations]
    if bad:
        raise ValueError("the graph fails: " + ", ".join(bad))
    return nodes, joined


def validation_report(nodes: DataFrame, edges: DataFrame, dim: int | None = None) -> DataFrame:
    """(check, violations): dimensions, finite values, dense indices, edges without nodes, loops and null weights."""
    from ..functions.vectors import is_finite

    size = F.size("embedding")
    per = nodes.groupBy("node_type").agg(F.count("*").alias("n"), F.countDistinct("node_idx").alias("d"), F.min("node_idx").alias("lo"), F.max("node_idx").alias("hi"), F.min(size).alias("a"), F.max(size).alias("b"), F.count_if(~F.coalesce(is_finite(F.col("embedding")), F.lit(True))).alias("bad"))
    known = nodes.select("node_type", "node_idx")

    def orphans(side: str) -> DataFrame:
        keys = known.select(F.col("node_type").alias(f"{side}_type"), F.col("node_idx").alias(side))
        return edges.join(keys, [f"{side}_type", side], "left_anti").agg(F.lit(f"{side}_without_node").alias("check"), F.count("*").alias("violations"))

    wanted = F.lit(dim) if dim else F.col("a")
    of_nodes = per.agg(F.count_if((F.col("a") != F.col("b")) | (F.col("a") != wanted)).alias("dimension"), F.sum("bad").alias("not_finite"), F.count_if((F.col("n") != F.col("d")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)).alias("not_dense"))
    loops = edges.agg(F.count_if((F.col("src_type") == F.col("dst_type")) & (F.col("src") == F.col("dst"))).alias("loop"), F.count_if(F.col("weight").isNull()).alias("null_weight"))
    def long(d: DataFrame) -> DataFrame:
        return d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in d.columns])).alias("x")).select("x.*")
    return long(of_nodes).union(long(loops)).union(orphans("src")).union(orphans("dst"))


def node_json(nodes: DataFrame) -> DataFrame:
    """(node_type, node_idx, json): what a node is, without its vector."""
    return nodes.select("node_type", "node_idx", F.to_json(F.struct(*[c for c in nodes.columns if c != "embedding"])).alias("json"))


def build_graph(captions: DataFrame, images: DataFrame, k: int = 16, cap: int = 16, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from captions (id, image_id, text, embedding, row_pos) and image vectors (image_id, embedding): dense indices in order of appearance,
    similar images and captions, pairs, captions of one image, all checked. Images without a caption are no nodes; captions of images without a vector are
    nodes without a pair. Raises ValueError if a check fails or a node has more than ``min(k, cap)`` similar ones."""
    shown = captions.join(images.select("image_id"), "image_id", "left_semi")
    i = node_index(shown, "image_id", "row_pos").join(images.select(F.col("image_id").alias("ext_id"), "embedding"), "ext_id")
    c = node_index(captions, "id", "row_pos").join(captions.select(F.col("id").alias("ext_id"), "image_id", "text", "embedding"), "ext_id")
    parts = [n.select(F.lit(kind).alias("node_type"), "node_idx", F.col("ext_id").cast("string").alias("ext_id"), text.alias("text"), l2_normalize(F.col("embedding")).cast("array<float>").alias("embedding")) for kind, n, text in ((IMAGE, i, F.lit(None).cast("string")), (CAPTION, c, F.col("text")))]
    near = [semantic_edges(n.select(F.col("node_idx").alias("id"), "embedding"), k, cap, kind) for kind, n in ((IMAGE, i), (CAPTION, c))]
    own = c.select("node_idx", "image_id")
    nodes, edges = assemble(parts[0].unionByName(parts[1]), *near, paired_edges(own, i.select("ext_id", "node_idx")), cooccur_edges(own), dim=dim)
    most = out_degree(nodes, edges).where((F.col("edge_type") == SEM_SIM) & (F.col("max_degree") > min(k, cap)))
    if most.count():
        raise ValueError(f"a node has more than {min(k, cap)} similar ones")
    return nodes, edges


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_type", "edge_type", "dst_type").agg(F.count("*").alias("n_edges"))


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_type, edge_type, max_degree, mean_degree) over all nodes of the type, those without edges too."""
    per = edges.groupBy("src_type", "edge_type", "src").agg(F.count("*").alias("degree"))
    summed = per.groupBy("src_type", "edge_type").agg(F.max("degree").alias("max_degree"), F.sum("degree").alias("total"))
    n = nodes.groupBy(F.col("node_type").alias("src_type")).agg(F.count("*").alias("n"))
    return summed.join(n, "src_type").select(F.col("src_type").alias("node_type"), "edge_type", "max_degree", (F.col("total") / F.col("n")).alias("mean_degree"))
