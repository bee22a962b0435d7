"""Removal of repeated passages by threshold-bounded interval expansion over Burrows-Wheeler transforms.

Every string of ``width`` bytes that starts at two places is found and all bytes it covers are removed. Shorter repeats can be counted beside
that: of each string of ``passage`` bytes one k-gram at least is looked for in all texts.

1. Equal texts are one row with a number of copies.
2. Windows of ``width`` bytes are dealt out by content: each belongs to the k-gram in it with the least hash, so equal windows have
   equal k-grams at equal places. Windows in a row with the same k-gram are a segment; a segment whose k-gram is nowhere else holds no
   repeat. Equal segments are one row with a number of copies.
3. Segments that share a k-gram meet in one task, which builds the Burrows-Wheeler transform of some megabytes of them, and
   expands intervals breadth first by backward extension: the boundaries between suffixes with a common prefix of 0, 1, 2, ...
   bytes, in this order, up to ``width`` - 1. Suffixes that no boundary parts then share ``width`` bytes or more. A k-gram whose segments
   are all copies of one needs no transform.
4. A k-gram with more than ``cap`` different segments (a passage in a large part of all texts) would be too much for one task: the windows of
   its segments are counted by their 128-bit hashes instead, each window by itself.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, stash, table

WIDTH, GRAM, CAP = 400, 128, 4000
#: Width and k-gram that find repeated passages of 50 words, of which most take 250 to 350 bytes.
PASSAGE, PASSAGE_GRAM = 240, 64
#: Bytes of segments in one transform, but for a single k-gram's, and windows of a text that are dealt out at once.
CHUNK, SPAN = 2 << 20, 1 << 19
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * ODD[0]
    return h ^ (h >> np.uint64(29))


def gram_hashes(b: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the k bytes at each place, by doubling."""
    h, n = _mix(b.astype(np.uint64) + np.uint64(seed)), 1
    while 2 * n <= k:
        h, n = _mix(h[:-n] * ODD[1] + h[n:]), 2 * n
    return _mix(h[: len(h) - (k - n)] * ODD[2] + h[k - n :]) if n < k else h


def segments(b: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, first window, last window, k-gram) of the segments of a text, some at a time; windows and k-grams are named by their starts."""
    low = np.uint64((1 << 20) - 1)
    for at in range(0, len(b) - width + 1, SPAN):
        h = gram_hashes(b[at : at + SPAN + width - 1], gram)
        m, n, w = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, width - gram + 1
        while 2 * n <= w:
            m, n = np.minimum(m[:-n], m[n:]), 2 * n
        if n < w:
            m = np.minimum(m[: len(m) - (w - n)], m[w - n :])
        place = (m & low).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first, last = np.append(0, cut), np.append(cut, len(place)) - 1
        yield h[place[first]].view(np.int64), first + at, last + at, place[first] + at


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``s`` (numbers below 2**15) in the order of their first ``depth`` numbers or more, by prefix doubling over those not told apart yet."""
    n = len(s)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    key = (t[:n] << 45) | (t[1 : n + 1] << 30) | (t[2 : n + 2] << 15) | t[3 : n + 3]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    h = 4
    while h < depth:
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(at):
            break
        suffix = order[at]
        key = rank[suffix].astype(np.int64) * (n + 2) + rank[np.minimum(suffix + h, n)] + 1
        o = np.argsort(key, kind="stable")
        suffix, key = suffix[o], key[o]
        order[at] = suffix
        fresh = np.append(True, key[1:] != key[:-1])
        new[at] = fresh
        rank[suffix] = np.maximum.accumulate(np.where(fresh, at, 0))
        h *= 2
    return order


def long_neighbours(bwt: np.ndarray, ends: int, widths: list[int]) -> list[np.ndarray]:
    """For each of ``widths`` (ascending) and each suffix in order: whether it shares less than that with the one before it. Numbers below ``ends`` in the
    transform are ends of texts, each unique.

    Boundaries come by increasing common prefix. Suffixes r - 1 and r that begin with the same byte c lie at psi[r - 1] and psi[r]
    without it; they get a boundary one level after the first one between those two. Most lie side by side, and a new boundary between them goes
    straight on to them. The others, fewer on every level, look for one between them.
    """
    n = len(bwt)
    psi = np.argsort(bwt, kind="stable").astype(np.int32)
    first = bwt[psi]
    parted = np.append(True, (first[1:] != first[:-1]) | (first[1:] < ends))
    back = np.empty(n, np.int32)
    back[psi] = np.arange(n, dtype=np.int32)
    fresh = np.flatnonzero(parted).astype(np.int32)
    r = np.flatnonzero(~parted).astype(np.int32)
    r = r[psi[r] != psi[r - 1] + 1]
    r = r[np.argsort(psi[r])]
    wide, low, high = r, psi[r - 1], psi[r]  # by high
    out = []
    for level in range(1, widths[-1] + 1):
        if level in widths:
            out.append(parted.copy())
        if level == widths[-1] or not len(fresh):
            break
        r = back[fresh]
        found = [r[~parted[r] & (psi[r - 1] == fresh - 1)]]
        if len(wide):
            if len(wide) * 16 < n:
                new = np.sort(fresh)
                hit = np.searchsorted(new, high, "right") > np.searchsorted(new, low, "right")
            else:
                upto = np.cumsum(parted, dtype=np.int32)
                hit = upto[high] > upto[low]
            found.append(wide[hit])
            keep = ~hit
            wide, low, high = wide[keep], low[keep], high[keep]
        fresh = np.concatenate(found)
        parted[fresh] = True
    return out + [parted] * (len(widths) - len(out))


def repeated_windows(texts: list[bytes], windows: list[int], copies: list[int], widths: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each text runs (first, last, k): its windows of widths[k] bytes that start anywhere else among the first ``windows`` places of these texts, its
    own included. Only those places are judged; all windows of a text with copies are repeated."""
    parts, starts, ends, n = [], [], len(texts), 0
    if ends >= 1 << 14:
        raise ValueError("too many texts for one transform")
    for k, t in enumerate(texts):
        starts.append(n)
        parts += [np.frombuffer(t, np.uint8).astype(np.int16) + ends, np.array([k], np.int16)]
        n += len(t) + 1
    if not n:
        return [[] for _ in texts]
    s = np.concatenate(parts)
    judged = np.zeros(n, bool)
    for a, m in zip(starts, windows, strict=True):
        judged[a : a + m] = True
    order = suffix_order(s, widths[-1])
    parted = long_neighbours(s[order - 1], ends, widths)
    del s
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    mine = judged[order]
    for k, cut in enumerate(parted):
        group = np.cumsum(cut) - 1
        often = np.bincount(group, mine, group[-1] + 1)[group] > 1
        repeated = np.zeros(n + 1, bool)
        repeated[order[often & mine]] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], repeated]).astype(np.int8))).reshape(-1, 2)
        which = np.searchsorted(starts, edges[:, 0], "right") - 1  # an end of a text parts runs
        for t, a, b in zip(which.tolist(), edges[:, 0].tolist(), edges[:, 1].tolist(), strict=True):
            out[t].append((a - starts[t], b - 1 - starts[t], k))
    lasts = [[(0, min(m, len(t) - w + 1) - 1, k) for k, w in enumerate(widths)] for t, m in zip(texts, windows, strict=True)]
    return [[x for x in last if x[1] >= 0] if c > 1 else runs for last, c, runs in zip(lasts, copies, out, strict=True)]


RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("k", pa.int8())]))
RUNS_SQL = "array<struct<a:int,b:int,k:tinyint>>"


def _texts_with(t: DataFrame, lists: DataFrame, run, schema: str) -> DataFrame:
    return t.join(lists, "digest").mapInArrow(run, schema)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _spans(cuts: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs covered by (start, end) pairs."""
    spans: list[list[int]] = []
    for a, b in sorted(cuts):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return spans


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, passage: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, kept: the remaining text, without the pieces of
    characters that were cut. With ``passage`` (above ``gram``) also n_repeated: the bytes covered by strings of ``gram`` bytes that start elsewhere too, looked for
    at so many places that each repeated string of ``passage`` bytes has one of them; these aren't removed.

    A null text counts as empty. Texts shorter than ``width`` lose nothing. Rows are judged on the input: a text that another row repeats loses all that is
    covered, in both rows. Null and repeated ids: each row is judged by itself.
    """
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    digest = F.substring(F.unhex(F.sha2(raw, 256)), 1, 16)
    rows = stash(docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest")), "rows")
    name = f"lodestone_texts_{uuid.uuid4().hex}"
    texts = docs.select(digest.alias("digest"), raw.alias("raw")).groupBy("digest").agg(F.first("raw").alias("raw"), F.count("*").alias("copies"))
    # bucketed by digest: read again and again, never dealt out again
    texts.write.option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "digest").saveAsTable(name)
    try:
        done = _per_text(spark.table(name), [width], gram, cap, with_text, passage)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return rows.join(done if passage else done.drop("n_repeated"), "digest").drop("digest")


def _repeated_grams(t: DataFrame, passage: int, gram: int) -> DataFrame:
    """(digest, grams): the starts of k-grams that stand elsewhere too, of one or more in each window of ``passage`` bytes."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, keys, places = [], [], []
            for i, raw in enumerate(batch.column(1)):
                for key, _, _, place in segments(np.frombuffer(raw.as_buffer(), np.uint8), passage, gram):
                    fresh = np.append(True, place[1:] != place[:-1])
                    which.append(np.full(int(fresh.sum()), i)), keys.append(key[fresh]), places.append(place[fresh])
            if which:
                take = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places).astype(np.int32))], ["digest", "copies", "key", "place"])

    picked = stash(t.where(F.octet_length("raw") >= passage).mapInArrow(pick, "digest binary, copies long, key long, place int"), "grams")
    shared = stash(picked.groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1").select("key"), "shared-grams")
    out = stash(picked.join(shared, "key", "left_semi").groupBy("digest").agg(F.sort_array(F.collect_set("place")).alias("grams")), "repeated-grams")
    discard(picked, shared)
    return out


def _per_text(t: DataFrame, widths: list[int], gram: int, cap: int, with_text: bool, passage: int | None) -> DataFrame:
    least, width = widths[0], widths[-1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, cols = [], ([], [], [])
            for i, raw in enumerate(batch.column(1)):
                for got in segments(np.frombuffer(raw.as_buffer(), np.uint8), least, gram):
                    which.append(np.full(len(got[0]), i))
                    for c, x in zip(cols, got[:3], strict=True):
                        c.append(x)
            if which:
                take = pa.array(np.concatenate(which))
                key, first, last = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(key), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["digest", "copies", "key", "first", "last"])

    long = t.where(F.octet_length("raw") >= least)
    parts = stash(long.mapInArrow(cut, "digest binary, copies long, key long, first int, last int"), "segments")
    # counts by key are tables of their own: a join with a key that many segments have can then be split
    shared = stash(parts.groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1").select("key"), "shared-keys")
    wanted = parts.join(shared, "key", "left_semi").groupBy("digest").agg(F.collect_list(F.struct("key", "first", "last")).alias("list"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                raw = row["raw"]
                for x in row["list"]:
                    n = x["last"] - x["first"] + 1
                    d = hashlib.blake2b(raw[x["first"] : x["last"] + width] + n.to_bytes(4, "little"), digest_size=16).digest()
                    out.append((x["key"], d, row["digest"], row["copies"], x["first"], n, min(x["first"] + n, len(raw) - width + 1) - x["first"]))
            if out:
                yield _batch(out, [("key", pa.int64()), ("mark", pa.binary()), ("digest", pa.binary()), ("copies", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("n_wide", pa.int32())])

    marked = stash(_texts_with(t, wanted, mark, "key long, mark binary, digest binary, copies long, first int, n int, n_wide int"), "marked")
    discard(parts, shared)
    reps = stash(marked.groupBy("key", "mark").agg(F.sum("copies").alias("copies"), F.min(F.struct("digest", "first", "n", "n_wide")).alias("at")), "representatives")
    per_key = stash(reps.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).where("total > 1").select("key", "kinds"), "keys")
    sized = stash(reps.join(per_key, "key"), "sized")
    discard(reps, per_key)
    listed = F.collect_list(F.struct("key", "mark", F.least("copies", F.lit(2)).alias("copies"), "at.first", "at.n")).alias("list")

    def lists(which: Column) -> DataFrame:
        return sized.where(which).groupBy("at.digest").agg(listed)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(x["key"], x["mark"], x["copies"], x["n"], row["raw"][x["first"] : x["first"] + x["n"] - 1 + width]) for row in batch.to_pylist() for x in row["list"]]
            if out:
                yield _batch(out, [("key", pa.int64()), ("mark", pa.binary()), ("copies", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = repeated_windows([x[4] for x in held], [x[3] for x in held], [x[2] for x in held], widths)
            out = [(x[0], x[1], [{"a": a, "b": b, "k": k} for a, b, k in f]) for x, f in zip(held, found, strict=True) if f]
            held.clear()
            return _batch(out, [("key", pa.int64()), ("mark", pa.binary()), ("runs", RUNS)])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != last and (size >= CHUNK or len(held) >= 4000):
                    yield flush()
                    size = 0
                held.append(row)
                size, last = size + len(row[4]), row[0]
        if held:
            yield flush()

    few = F.col("kinds").between(2, cap)
    bytes_ = _texts_with(t, lists(few), fetch, "key long, mark binary, copies long, n int, bytes binary")
    runs = bytes_.repartition("key").sortWithinPartitions("key").mapInArrow(expand, f"key long, mark binary, runs {RUNS_SQL}")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for x in row["list"]:
                    b = np.frombuffer(row["raw"], np.uint8)[x["first"] : x["first"] + x["n"] - 1 + width]
                    for k, w in enumerate(widths):
                        n = min(x["n"], len(b) - w + 1)
                        if n > 0:
                            one, two = gram_hashes(b, w, 1 + k).view(np.int64)[:n], gram_hashes(b[::-1], w, 77 + k)[::-1].view(np.int64)[:n]
                            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(n, k, np.int8)), pa.array(np.full(n, x["key"])), pa.array([x["mark"]] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, x["copies"]))], ["one", "two", "k", "key", "mark", "a", "copies"])

    # all copies of one segment: nothing to compare
    whole = F.array(*[F.struct(F.lit(0).alias("a"), (F.col("at.n_wide" if w == width else "at.n") - 1).alias("b"), F.lit(k).cast("tinyint").alias("k")) for k, w in enumerate(widths)])
    runs = runs.union(sized.where("kinds = 1").select("key", "mark", F.filter(whole, lambda x: x["b"] >= 0).alias("runs")))
    many, each = F.col("kinds") > cap, None
    if sized.where(many).limit(1).count():
        each = stash(_texts_with(t, lists(many), windows, "one long, two long, k tinyint, key long, mark binary, a int, copies long"), "windows")
        twice = each.groupBy("one", "two", "k").agg(F.sum("copies").alias("m")).where("m > 1").drop("m")
        alone = each.join(twice, ["one", "two", "k"]).groupBy("key", "mark").agg(F.collect_list(F.struct("a", F.col("a").alias("b"), "k")).alias("runs"))
        runs = runs.union(alone)
    runs = stash(runs, "runs")
    discard(sized, *([each] if each else []))
    spots = marked.select("key", "mark", "digest", "first").join(runs, ["key", "mark"]).groupBy("digest").agg(F.collect_list(F.struct("first", "runs")).alias("list"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = row["raw"]
                cuts = [_spans([(x["first"] + r["a"], x["first"] + r["b"] + w) for x in row["list"] or [] for r in x["runs"] if r["k"] == k]) for k, w in enumerate(widths)]
                ends = [0, *(b for _, b in cuts[-1])]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in cuts[-1]), len(raw)], strict=True))
                near = sum(b - a for a, b in _spans([(p, p + gram) for p in row["grams"] or []])) if passage else 0
                out.append((row["digest"], len(raw), len(raw) - len(kept), len(cuts[-1]), hashlib.sha256(kept).hexdigest(), near, kept.decode("utf-8", "ignore"))[: 6 + with_text])
            yield _batch(out, [("digest", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated", pa.int64()), ("kept", pa.string())][: 6 + with_text])

    both = t.join(spots, "digest", "left")
    if passage:
        both = both.join(_repeated_grams(t, passage, gram), "digest", "left")
    done = both.mapInArrow(finish, "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long" + ", kept string" * with_text)
    done = stash(done, "repeats")
    discard(marked, runs)
    return done


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns at 400 bytes, and beside them n_repeated, which is above 0 wherever a passage of 240 bytes (some 50 words) or more repeats."""
    return remove_repeats(table(spark, sf_dir, "documents"), passage=PASSAGE)
