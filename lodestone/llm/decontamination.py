"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask picks some positions of a window of words and ignores the others. Documents and benchmark items are hashed under each
mask at every window; equal hashes give a diagonal (how far the item is shifted in the document). Along each
diagonal the words are compared one by one, and an item counts as found where, of ``overlap`` words in a row, at
least ``share`` agree: substitutions are tolerated, also at the ignored positions.

The masks miss nothing that this rule accepts: wherever two of 13 words are replaced, a window under one of the masks holds neither. Items of
fewer words have masks of their own, for two of 10 to 12 words and one of 8 or 9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash, table
from .words import word_hashes

#: 1: the word counts; 0: any word will do. For items of 13 words or more, and for shorter ones.
MASKS, SHORT_MASKS = ("1111011", "110010111"), ("11010011", "10011101", "1110101")
#: Bytes up to which a stored table is broadcast; larger ones are joined by a shuffle, in which a frequent seed can be split.
BROADCAST_BYTES = 32 << 20


def _small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """A stored table of longs (and words, of ``size`` in all), to be broadcast if its bytes, which are summed up here, allow."""
    each = F.lit(16 + 16 * len(df.columns)) if size is None else F.lit(64) + 8 * size
    return F.broadcast(df) if (df.agg(F.sum(each.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def seeds(rows: DataFrame, h: str, masks: tuple[str, ...]) -> DataFrame:
    """The rows without their array of hashes ``h`` but with pos and seed: a row for each mask at each window of its length.

    Neighbouring words come as columns of one row, so that hashing needs no lambda.
    """
    span, keep = max(map(len, masks)), [c for c in rows.columns if c != h]
    n = F.size(h)
    padded = F.concat(F.col(h), F.array_repeat(F.lit(None).cast("long"), span - 1))
    near = F.arrays_zip(*[F.slice(padded, F.lit(j + 1), n).alias(f"w{j}") for j in range(span)])
    each = rows.where(n > 0).select(*keep, n.alias("_n"), F.posexplode(near).alias("pos", "w"))
    picked = [F.when(F.col("pos") + len(m) <= F.col("_n"), F.xxhash64(F.lit(m), *[F.col("w")[f"w{j}"] for j, bit in enumerate(m) if bit == "1"])) for m in masks]
    return each.select(*keep, "pos", F.explode(F.array(*picked)).alias("seed")).where("seed is not null")


def contamination(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, share: float = 0.8, least: int = 8, masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS) -> DataFrame:
    """Rows (doc_id, item_id, matched, overlap, doc_start, item_start): documents (doc_id, text) that hold part of an item (item_id, text).

    ``overlap`` words of an item, or all of a shorter item of at least ``least`` words, lie in the document with at
    least ``share`` of them equal; the best place of each pair is given, the earliest if several are. Null and short texts and null ids
    match nothing. Rows that share an id count as that id's texts, each by itself, and give one row for each pair. Other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("item"))
    items = stash(items.where((F.size("item") >= least) & F.col("item_id").isNotNull()), "items")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = rows.select("doc_id", word_hashes(F.col("text")).alias("h"))
    short = F.size("item") < overlap
    kinds = [(masks, items.where(~short))] + [(short_masks, items.where(short))] * bool(items.where(short).limit(1).count())
    found = None
    for own_masks, some in kinds:
        own = stash(seeds(some, "item", own_masks).withColumnRenamed("pos", "item_pos"), "seeds")
        one = seeds(words, "h", own_masks).join(_small(own), "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
        found = one if found is None else found.union(one)
    hits = stash(found.distinct(), "hits")
    hit_ids = stash(hits.select("doc_id").distinct(), "hit-ids")
    texts = rows.join(_small(hit_ids), "doc_id", "left_semi").select("doc_id", word_hashes(F.col("text")).alias("h"))
    pairs = texts.join(hits, "doc_id").join(_small(items, F.size("item")), "item_id")
    window = F.least(F.lit(overlap), F.size("item"))
    same = F.transform(F.col("item"), lambda x, j: F.when(F.col("shift") + j >= 0, F.coalesce((F.get(F.col("h"), F.greatest(F.col("shift") + j, F.lit(0))) == x).cast("int"), F.lit(0))).otherwise(0))
    aligned = pairs.select("doc_id", "item_id", "shift", window.alias("overlap"), same.alias("same"))
    sums = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("overlap")), lambda i: F.struct(F.aggregate(F.slice("same", i + 1, F.col("overlap")), F.lit(0), lambda a, b: a + b).alias("matched"), (-F.col("shift") - i).alias("before"), (-i).alias("i")))
    best = aligned.withColumn("best", F.array_max(sums)).where(F.col("best.matched") >= F.ceil(F.lit(share) * F.col("overlap")))
    top = best.groupBy("doc_id", "item_id", "overlap").agg(F.max("best").alias("best"))
    return top.select("doc_id", "item_id", F.col("best.matched").alias("matched"), "overlap", (-F.col("best.before")).alias("doc_start"), (-F.col("best.i")).alias("item_start"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
