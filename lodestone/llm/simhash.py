"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check.

A 64-bit fingerprint is cut into 32 segments of two bits, embedded as their bit counts. The Manhattan distance of two
embeddings is at most the fingerprints' Hamming distance. With radius r the 32 coordinates are cut into m blocks: of two
embeddings within r, at least m - r blocks are equal, so fingerprints meet in the grid cells that m - r blocks span. m follows the number of
fingerprints, so that a cell holds little but what is near: 4 blocks up to two million for radius 2, 9 for 10^10. Pairs in a
cell are held against the Manhattan bound and then checked bit by bit. Equal fingerprints are one row throughout.

A cell with more than ``cell_cap`` fingerprints (a group of near copies) isn't paired: its fingerprints go by midpoints. Each one
is listed under every fingerprint within r / 2 of it; those listed together are within r of each other and are linked to the
smallest, and any two within r are listed together at some midpoint. That keeps components, with rows in proportion to fingerprints.

``near_copy_components`` takes these links as candidates and verifies them by exact similarity of shingle sets. The pairs of that
similarity whose fingerprints are further apart come from ``set_join``, so that none is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .bpe import release
from .components import connected_components
from .set_join import similar_components
from .shared import discard, stash, table

SEGMENTS = 32


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the text's shingles, repeats included; 0 without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        digests = [xxhash.xxh64_digest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, w), np.int64, len(w))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(w) - words + 1].tolist()
        digest = xxhash.xxh64_digest
        digests = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    most = bits.sum(0, dtype=np.int64) * 2 > len(digests)
    return int.from_bytes(np.packbits(most).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) per row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fps = np.array([fingerprint(x or "", words, seed) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embed(fp: Column) -> Column:
    """Bit counts of the two-bit segments in unary: 00, 01, 11. The Hamming distance of these is the Manhattan distance of the counts."""
    low, high = F.lit(0x5555555555555555), F.lit(_signed(0xAAAAAAAAAAAAAAAA))
    some = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
    both = fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(high)
    return some.bitwiseOR(both)


def _blocks(count: int) -> list[int]:
    """Masks of the blocks of segments."""
    cuts = np.linspace(0, SEGMENTS, count + 1).round().astype(int).tolist()
    return [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(cuts, cuts[1:], strict=False)]


def blocks_for(fingerprints: int, radius: int) -> int:
    """The fewest blocks with which a cell's counts (1.5 bits a segment) number some eight times the fingerprints; at most 200 cells for each."""
    m = radius + 2
    while 1.5 * SEGMENTS * (m - radius) / m < log2(max(fingerprints, 1)) + 3 and comb(m + 1, radius) <= 200:
        m += 1
    return m


def links(nodes: DataFrame, radius: int = 2, cell_cap: int = 64, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes (node long, fp long, fps distinct) that join just what fingerprints within ``radius`` (0, 2 or 4) join."""
    if radius not in (0, 2, 4):
        raise ValueError("radius must be 0, 2 or 4")
    blocks = blocks or blocks_for(nodes.count(), radius)
    masks = [_signed(sum(x)) for x in combinations(_blocks(blocks), blocks - radius)]
    grid = nodes.withColumn("emb", embed(F.col("fp")))
    cells = [F.struct(F.lit(k).cast("short").alias("k"), F.col("emb").bitwiseAND(F.lit(m)).alias("at")) for k, m in enumerate(masks)]
    rows = grid.select("node", "fp", "emb", F.explode(F.array(*cells)).alias("cell")).select("node", "fp", "emb", "cell.k", "cell.at")
    # counts are a table of their own: a join with a crowded cell can then be split
    full = stash(rows.groupBy("k", "at").count().where("count > 1"), "cell-counts")
    held = stash(rows.join(full, ["k", "at"]), "cells")
    discard(full)
    x = held.where(F.col("count") <= cell_cap)
    y = x.select("k", "at", F.col("node").alias("node2"), F.col("fp").alias("fp2"), F.col("emb").alias("emb2"))
    pairs = x.join(y, ["k", "at"]).where("node < node2")
    near = pairs.where(F.bit_count(F.col("emb").bitwiseXOR(F.col("emb2"))) <= radius).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    edges = near.select(F.col("node").alias("a"), F.col("node2").alias("b"))
    hot = held.where(F.col("count") > cell_cap).select("node", "fp").distinct()
    ball = [0] + [1 << i for i in range(64)] * (radius >= 2) + [1 << i | 1 << j for i, j in combinations(range(64), 2)] * (radius >= 4)
    mids = hot.select("node", F.explode(F.transform(F.array(*[F.lit(_signed(m)) for m in ball]), lambda m: m.bitwiseXOR(F.col("fp")))).alias("mid"))
    least = mids.groupBy("mid").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")
    edges = stash(edges.union(mids.join(least, "mid").where("node <> b").select(F.col("node").alias("a"), "b")).distinct(), "links")
    discard(held)
    return edges


class _WordHashes(dict):
    """XXH3 of words, each worked out once; emptied when it has grown."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_set(text: str, words: int, known: dict | None = None) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; the whole sequence if there are fewer words."""
    w = text.lower().encode("utf-8", "surrogatepass").split()
    if len(w) <= words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))], np.uint64).view(np.int64)
    known = _WordHashes() if known is None else known
    each = np.array([known[x] for x in w], np.uint64)
    n = len(w) - words + 1
    h = np.zeros(n, np.uint64)
    for j in range(words):
        h = (h ^ each[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def text_digest(text: Column) -> Column:
    """16 bytes; a null text counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


#: The names of ``id_keys``.
ID_KEYS = ["id_or_zero", "no_id"]


def id_keys(name: str) -> list[Column]:
    """An id that may be null as columns that aren't. Rows joined by these and then grouped by them are shuffled once, which a null-safe comparison doesn't allow."""
    return [F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(ID_KEYS[0]), F.col(name).isNull().alias(ID_KEYS[1])]


def near_copy_components(docs: DataFrame, words: int = 5, least: float = 0.8, cell_cap: int = 64, radius: int = 2) -> DataFrame:
    """(doc_id, digest, component_id, kept): documents linked by a Jaccard similarity of their sets of ``words``-word shingles of at least ``least``.

    Candidates are texts whose SimHash over the same shingles lies within ``radius`` bits (``links``), and those that ``set_join`` adds; all are verified by
    their sets, and all pairs of that similarity count. A row for each id with each of its texts, the text by its digest; texts are the nodes, so an id shared by
    different texts links nothing. component_id is the smallest id of the component, null if none of its rows has an id. kept marks one row of each component:
    that of the smallest id, null only if there is no other, and the least digest. Null texts count as empty, and blank texts are linked.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", text_digest(F.col("text")))
    ids = stash(rows.select("doc_id", "digest").distinct(), "digests")
    heads = stash(ids.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "heads")
    own = heads.select("digest", *id_keys("first"), "node")
    texts = rows.select("digest", *id_keys("doc_id"), "text").join(own, ["digest", *ID_KEYS]).dropDuplicates(["digest", *ID_KEYS]).select("node", "text")
    texts = stash(texts, "texts")

    fps = stash(fingerprints(texts, words, id_col="node"), "fingerprints")
    of_fp = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    close = links(of_fp, radius, cell_cap)
    same = fps.join(of_fp, "fp").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    candidates = stash(close.union(same), "candidates")
    discard(fps, of_fp, close)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = _WordHashes()
        for batch in batches:
            sets = [shingle_set(x, words, known) for x in batch.column(1).to_pylist()]
            ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["node", "s"])

    def to_sets(t: DataFrame, then: Callable = iter, schema: str = "node long, s array<bigint>") -> DataFrame:
        return t.select("node", "text").mapInArrow(lambda batches: then(run(batches)), schema)

    found = similar_components(texts, to_sets, least, cell_cap, candidates=candidates)
    discard(texts, candidates)
    by_text = stash(heads.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "by-text")
    best = by_text.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest")).alias("best"))
    by_text = by_text.join(best, "component").select("digest", F.col("best.first").alias("component_id"), F.col("best.digest").alias("best"))
    kept = (F.col("digest") == F.col("best")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return ids.join(by_text, "digest").select("doc_id", "digest", "component_id", kept.alias("kept"))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, cell_cap: int = 64, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most ``radius`` bits).

    Null and blank texts have fingerprint zero and are linked as such. Rows with a null id get no component and link nothing. Repeated ids: each row has its own fingerprint.
    """
    fps = stash(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    nodes = stash(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    # one id with several fingerprints (repeated ids): its rows are one node of the graph
    same = fps.join(nodes, "fp").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    own = fps.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    found = connected_components(links(nodes, radius, cell_cap).union(same.join(own.withColumnRenamed("doc_id", "a"), "a").select("a", "b")))
    by_fp = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = fps.join(by_fp, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
