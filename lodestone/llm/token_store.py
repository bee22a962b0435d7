"""Token-ID files of directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the low chunk of every id and a bitmap that says which ids go on; level
1 holds the next chunk of those, with a bitmap of its own, and so on. A rank directory (set bits before every 512th bit)
gives an id's place on the next level, so any id is read by itself, without decoding a block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .bpe import Encoder, default_path
from .shared import new_dir, open_store, put_file, stash, table

MAGIC, BLOCK = b"LSDAC001", 512
#: Ids in a file, at most, but for a longer document. A task holds one file's ids at a time.
FILE_IDS = 4 << 20
#: Tasks that read files, at most; a task reads its files one by one.
MOST_TASKS = 100_000


def pack(ids: np.ndarray, doc_ids: list[int | None], offsets: np.ndarray) -> list[bytes]:
    """A file's parts: header, document ids, validity and offsets, then for each level its chunks, bitmap and directory."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8 + 8, np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64))]) if len(more) else np.zeros(1, np.int64)
        levels.append((rest.astype(np.uint8), bits, ranks.astype("<u4")))
        if not more.any():
            break
        rest = rest[more] >> 8
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = struct.pack("<8sQQQ", MAGIC, len(doc_ids), len(ids), len(levels)) + b"".join(struct.pack("<QQQ", *map(len, x)) for x in levels)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    return [head, names.tobytes(), known.tobytes(), np.asarray(offsets, "<i8").tobytes(), *(x.tobytes() for level in levels for x in level)]


class TokenFile:
    """Random access to one file's ids."""

    def __init__(self, data: bytes):
        magic, n, self.n_ids, k = struct.unpack_from("<8sQQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        sizes = [struct.unpack_from("<QQQ", data, 32 + 24 * i) for i in range(k)]
        at = 32 + 24 * k

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        names, known = take("<i8", n), take("u1", n)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(names, known, strict=True)]
        self.offsets = take("<i8", n + 1)
        self.levels = [(take("u1", a), take("u1", b), take("<u4", c)) for a, b, c in sizes]
        if at != len(data) or self.offsets[-1] != self.n_ids:
            raise ValueError("a token file of the wrong length")

    def __getitem__(self, where) -> np.ndarray:
        """The ids at these positions."""
        pos = np.atleast_1d(np.asarray(where, np.int64))
        out, still, shift = np.zeros(len(pos), np.uint32), np.arange(len(pos)), 0
        for chunks, bits, ranks in self.levels:
            out[still] |= chunks[pos].astype(np.uint32) << shift
            more = (bits[pos >> 3] >> (pos & 7)) & 1 == 1
            pos, still, shift = pos[more], still[more], shift + 8
            if not len(pos):
                break
            block = pos // BLOCK
            words = bits[: len(bits) // 8 * 8].view("<u8")
            first = block * (BLOCK // 64)
            rank = ranks[block].astype(np.int64)
            for k in range(BLOCK // 64):  # whole words of the block before this bit
                ahead = first + k < pos >> 6
                rank[ahead] += np.bitwise_count(words[first[ahead] + k])
            below = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
            pos = rank + np.bitwise_count(words[pos >> 6] & below)
        return out

    def document(self, k: int) -> np.ndarray:
        return self[np.arange(self.offsets[k], self.offsets[k + 1])]


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, append ``end_id`` and write files under ``out_dir`` in ascending order of ids.

    Returns the manifest: file, part and k (which give the order of files), first_doc, n_docs, n_ids. A null text counts as empty; a null id comes first and is kept; rows of
    one id lie beside each other, ordered by text.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, k = Encoder.at(tokenizer), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        rows: list[dict] = []

        def flush() -> None:
            nonlocal k
            if names:
                path = f"{out_dir}/{part:06d}-{k:05d}.dac"
                ids = np.concatenate(held)
                put_file(path, pack(ids, names, np.concatenate([[0], np.cumsum(sizes)])))
                rows.append({"file": path, "part": part, "k": k, "first_doc": names[0], "n_docs": len(names), "n_ids": len(ids)})
                k += 1
                names.clear(), held.clear(), sizes.clear()

        total = 0
        for batch in batches:
            for i, ids, off in enc.chunks(batch.column(1)):
                for j, name in enumerate(batch.column(0).slice(i, len(off) - 1).to_pylist()):
                    if total and total + off[j + 1] - off[j] + 1 > file_ids:
                        flush()
                        total = 0
                    one = np.append(ids[off[j] : off[j + 1]], np.uint32(end_id))
                    names.append(name), held.append(one), sizes.append(len(one))
                    total += len(one)
        flush()
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("k", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(write, "file string, part int, k int, first_doc long, n_docs long, n_ids long")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it over all files), n_tokens, ids_crc32 and, if asked for, ids. The manifest is a stored table.

    A file's start is the sum over the parts before its own, of which there is one for each task that wrote, and over the files before it in its part.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    ahead = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", ahead(Window.orderBy("part")).alias("base"))
    files = manifest.withColumn("within", ahead(Window.partitionBy("part").orderBy("k"))).join(parts, "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                with store.open_input_stream(path, compression=None) as f:
                    tokens = TokenFile(f.read())
                off, crcs, ids = tokens.offsets, [], []
                for k in range(len(tokens.doc_ids)):
                    one = tokens.document(k)
                    crcs.append(zlib.crc32(one.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(one.astype(np.int32))
                out = {"doc_id": pa.array(tokens.doc_ids, pa.int64()), "start": pa.array(off[:-1] + row["start"]), "n_tokens": pa.array(np.diff(off)), "ids_crc32": pa.array(crcs, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    listed = files.select("file", (F.col("base") + F.col("within")).alias("start"))
    return listed.repartition(max(1, min(manifest.count(), MOST_TASKS))).mapInArrow(read, schema)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, new_dir(spark, "tokens"), default_path("byte_bpe_50k.json"))
    return read_tokens(stash(manifest, "manifest"))
