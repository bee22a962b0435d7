"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

The reader loads the dictionary, walks the frames by their block headers, decodes one frame per record and validates the
record's version, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .shared import new_dir, open_store, put_file, stash, table

#: Fixed values of the zstd and WARC formats.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION, REVISIT_PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in a file, at most, but for a longer record.
FILE_BYTES = 16 << 20


class WarcError(ValueError):
    pass


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary from a sample of payloads; none if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One record; a revisit has no block, but its payload's digest and size."""
    block = payload if kind == "response" else b""
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", "WARC-Target-URI: " + re.sub(r"[\r\n]", "", uri), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return b"\r\n".join(x if isinstance(x, bytes) else x.encode() for x in head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstd frame at ``at`` ends."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise WarcError(f"no zstd frame at {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if len(data) < pos + 3:
            raise WarcError("a frame is cut short")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise WarcError("a frame is cut short")
    return pos


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and block; raises WarcError if anything is amiss."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0].encode() != VERSION:
        raise WarcError("no WARC/1.1 header")
    fields = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if not colon or name.lower() in fields:
            raise WarcError(f"a bad header line: {x[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the length isn't that of Content-Length")
    block = rest[:-4]
    if fields["warc-block-digest"] != "sha1:" + base32_sha1(block):
        raise WarcError("the block's digest is another")
    if fields["warc-type"] == "response" and (fields["warc-payload-digest"] != fields["warc-block-digest"] or fields.get("x-payload-length", str(len(block))) != str(len(block))):
        raise WarcError("the payload's digest or length is another")
    if fields["warc-type"] == "revisit" and "warc-refers-to" not in fields:
        raise WarcError("a revisit of nothing")
    return fields, block


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    view, at, known = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        at = 8 + size
        if at > len(data):
            raise WarcError("the dictionary is cut short")
        raw = bytes(view[8:at])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # it may be packed itself
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(view, at)
        try:
            raw = reader.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        yield parse(raw)
        at = end


def record_id(page_id: int | None) -> str:
    return f"urn:lodestone:page:{'null' if page_id is None else page_id}"


def _page(name: str) -> int | None:
    last = name.strip("<>").rpartition(":")[2]
    return None if last == "null" else int(last)


def write_archives(pages: DataFrame, out_dir: str, least: int = 0, sample_rows: int = 2000, dict_bytes: int = 64 << 10, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) to ``.warc.zst`` files under ``out_dir``; returns (file, records).

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is a response and the others revisit it.
    A null html is an empty payload, a null url an empty URI. A null page_id is never the response that others revisit, unless
    all are null: then all are responses. Of rows that repeat the smallest page_id each is a response. The dictionary is learned from the starts of about ``sample_rows`` rows
    picked by hash, twice as many at most.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    first = rows.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"))
    share = min(1.0, sample_rows / max(pages.count(), 1))
    picked = rows.where(F.octet_length("payload").between(1, 64 << 10) & (F.pmod(F.xxhash64("page_id", "sha1"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    sample = picked.select(F.substring("payload", 1, 8 << 10).alias("payload")).limit(2 * sample_rows)
    learned = train(sorted(bytes(r.payload) for r in sample.collect()), dict_bytes)
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size, held, out = TaskContext.get().partitionId(), 0, 0, [], []
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(learned)) if learned else zstandard.ZstdCompressor(level=3)
        lead = [struct.pack("<II", DICT_MAGIC, len(learned)), learned] if learned else []

        def flush() -> None:
            nonlocal k, size
            if held:
                path = f"{out_dir}/{part:06d}-{k:05d}.warc.zst"
                put_file(path, [*lead, *held])
                out.append({"file": path, "records": len(held)})
                k, size = k + 1, 0
                held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                page, payload = row["page_id"], row["payload"]
                revisit = row["first"] is not None and row["first"] != page
                raw = record("revisit" if revisit else "response", record_id(page), row["url"], stamp, payload, base64.b32encode(row["sha1"]).decode(), len(payload), record_id(row["first"]) if revisit else None)
                held.append(packer.compress(raw))
                size += len(held[-1])
                if size >= file_bytes:
                    flush()
        flush()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return rows.join(first, "sha1", "left").select("page_id", "url", "payload", "sha1", "first").mapInArrow(write, "file string, records long")


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (column file of a stored table): page_id, payload_bytes, payload_digest, record_type, refers_to, uri, date and, if asked for, payload."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "date"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = open_store(name)
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows: list[tuple] = []
                for h, block in read_archive(data):
                    to = h.get("warc-refers-to")
                    rows.append((_page(h["warc-record-id"]), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], _page(to) if to else None, h["warc-target-uri"], h["warc-date"], block)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, date string" + ", payload binary" * with_payload
    return files.select("file").repartition(max(1, min(files.count(), 100_000))).mapInArrow(read, schema)  # a file or more for each task


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stash(write_archives(table(spark, sf_dir, "pages"), new_dir(spark, "warc")), "archives")
    return read_archives(files)


