"""Packing of token sequences by minimum bin slack.

Documents longer than a sequence are cut into full sequences and a rest; the rests are packed. What packing needs of the
corpus is how many rests have each length: at most ``capacity - 1`` counts, whatever its size. For each window, a subset-sum
over bitsets finds the multiset of remaining lengths that comes closest to the capacity, backtracking gives how
many of each length it takes, and the window is repeated as often as the counts allow. Every rest then finds its place from
its rank among the rests of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .bpe import Encoder, default_path
from .shared import stash, table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: full ones from a document's start, then its rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.at(tokenizer)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            for i, ids, off in enc.chunks(batch.column(1)):
                cols: list[list] = [[] for _ in range(6)]
                for j, name in enumerate(batch.column(0).slice(i, len(off) - 1).to_pylist()):
                    raw = ids[off[j] : off[j + 1]].astype("<u4").tobytes() + end
                    n = len(raw) // 4
                    for s in range(0, n, capacity):
                        part = raw[4 * s : 4 * (s + capacity)]
                        for c, x in zip(cols, (name, s, len(part) // 4, zlib.crc32(part), n, np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None), strict=True):
                            c.append(x)
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + ([pa.array(cols[5], pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def best_fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths (1 to capacity; counts[k] of length k) whose sum is closest to the capacity from below: {length: how many}.

    Bit s of a bitset says that sum s can be reached by the lengths so far. A length's copies are added in powers of two, and
    the bitset before each such step is kept for the way back. Long lengths come first, so that they are used up early.
    """
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for k in np.flatnonzero(counts)[::-1].tolist():
        left, take = min(int(counts[k]), capacity // k), 1
        while left:
            take = min(take, left)
            steps.append((k, take, reach))
            reach |= (reach << (k * take)) & full
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for k, take, before in reversed(steps):
        if not before >> at & 1:
            at -= k * take
            out[k] = out.get(k, 0) + take
    return out


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows ({length: how many}, how often) that use up the counts. Each one uses up a length, so there are at most ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    out = []
    while left.any():
        fill = best_fill(left, capacity)
        times = min(int(left[k]) // n for k, n in fill.items())
        out.append((fill, times))
        for k, n in fill.items():
            left[k] -= n * times
    return out


def _places(windows: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, how many in a window, first sequence, offset), in order of length and rank."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for fill, times in windows:
        at = 0
        for k in sorted(fill, reverse=True):
            rows.append((k, rank.get(k, 0), fill[k], first, at))
            rank[k] = rank.get(k, 0) + fill[k] * times
            at += k * fill[k]
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with doc_id, start and length; the table is read three times."""
    cells = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(4096))  # a length may hold a third of all rows: rank it in cells
    rows = pieces.withColumn("_cell", cells)
    per_cell = rows.groupBy("length", "_cell").agg(F.count("*").alias("n"))
    per_cell = stash(per_cell, "cells")
    counts = {r.length: r.n for r in per_cell.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length up to the capacity
    places = _places(plan_windows(counts, capacity))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = per_cell.select("length", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_cell").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(order).cast("long")).join(base, ["length", "_cell"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_base")).drop("_cell", "_base")
    names = [f.name for f in pieces.schema.fields]
    big = 1 << 40

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = places[:, 0] * big + places[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            p = places[np.searchsorted(keys, length * big + rank, "right") - 1]
            k = rank - p[:, 1]
            out = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(p[:, 3] + k // p[:, 2]), pa.array(p[:, 4] + k % p[:, 2] * length)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every id of every document in exactly one piece, each piece with its sequence and offset there.

    A null text counts as empty (its end id alone). Rows of one id are packed each by itself. An empty table gives no piece.
    """
    pieces = stash(tokenize(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return assign(pieces, capacity)


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to the capacity unless their number is a power of two; ``pieces`` has ids. A sequence has at most ``capacity`` pieces."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
    n = F.size("ids")
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(capacity) - n)
    return ids.select("sequence_id", n.alias("n_ids"), F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
