"""Packing, token store and token counts against the library and plain Python."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing, token_counts, token_store
from lodestone.llm.bpe import Encoder, default_path
from lodestone.llm.shared import new_dir

BYTE, WORD = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")
TEXTS = ["don't 'tis  I'LL\n\n x", "", None, "<|endoftext|> a", "日本語 é", "a b\x85c", "the cat " * 900, "x" * 3000, "x" * 3000]
SCHEMA = "text string, n_tokens int, doc_id long, ids string"  # clashing names


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 'stmdrevlLS\n\t1²éÀ<|>İ \x1c中") | st.characters(max_codepoint=0x250), max_size=25), max_size=5))
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_same_ids_as_library(path, texts):
    enc = Encoder.at(path)
    for i, ids, off in enc.chunks(pa.array(texts, pa.string())):
        for k in range(len(off) - 1):
            assert ids[off[k] : off[k + 1]].tolist() == enc.tokenizer.encode(texts[i + k], add_special_tokens=False).ids


def _docs(spark):
    return spark.createDataFrame([(t, 1, i if i < 8 else 7, "x") for i, t in enumerate(TEXTS)] + [("null id", 0, None, "")], SCHEMA)


def _ids(path, text):
    return Encoder.at(path).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [7, 2048])
def test_packing(spark, capacity):
    got = packing.pack_documents(_docs(spark), BYTE, capacity, with_ids=True).collect()
    want = sorted(tuple(_ids(BYTE, t)) + (1,) for t in [*TEXTS, "null id"])
    by_doc: dict = {}
    for r in got:
        assert 0 < r.length <= capacity == max(capacity, r.offset + r.length) and len(r.ids) == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in [*((i, t) for i, t in enumerate(TEXTS) if i < 7), (None, "null id")]:  # each id in one piece: pieces follow each other and give the whole
        rows, ids = sorted(by_doc.pop(d), key=lambda r: r.start), (*_ids(BYTE, t), 1)
        assert [r.start for r in rows] == [sum(q.length for q in rows[:k]) for k in range(len(rows))]
        assert tuple(x for r in rows for x in r.ids) == ids and all(r.doc_tokens == len(ids) for r in rows)
    twice = (*_ids(BYTE, TEXTS[7]), 1)  # two rows of one id and text: each piece is there twice
    assert set(by_doc) == {7} and TEXTS[7] == TEXTS[8]
    pieces = sorted((r.start, tuple(r.ids)) for r in by_doc[7])
    assert pieces == sorted(2 * [(s, twice[s : s + capacity]) for s in range(0, len(twice), capacity)])
    assert sum(r.length for r in got) == sum(map(len, want))
    for s in {r.sequence_id for r in got}:  # gapless from 0
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert packing.pack_documents(_docs(spark).limit(0), BYTE).count() == 0
    whole = packing.sequences(packing.pack_documents(_docs(spark), BYTE, capacity, with_ids=True), capacity).collect()
    assert all(len(r.ids) in (r.n_ids, capacity) and r.ids[: r.n_ids] for r in whole)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=6), st.integers(30, 40))
def test_best_fill(counts, capacity):
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= capacity}
    fill = packing.best_fill(left, capacity)
    assert sum(k * n for k, n in fill.items()) == max(sums) and all(n <= counts[k] for k, n in fill.items())
    used: dict = {}
    for f, times in packing.plan_windows(counts, capacity):
        for k, n in f.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**20), max_size=40), max_size=5))
def test_token_file(docs):
    flat = np.array([x for d in docs for x in d], np.uint32)
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(int)
    f = token_store.TokenFile(b"".join(token_store.pack(flat, list(range(len(docs))), off)))
    assert [f.document(k).tolist() for k in range(len(docs))] == docs
    if len(flat):
        assert f[len(flat) // 2].tolist() == [flat[len(flat) // 2]]


def test_token_file_long():
    ids = np.random.default_rng(0).integers(0, 70000, 20000).astype(np.uint32)
    data = b"".join(token_store.pack(ids, [5], [0, len(ids)]))
    f = token_store.TokenFile(data)
    at = np.random.default_rng(1).integers(0, 20000, 500)
    assert (f[at] == ids[at]).all()
    with pytest.raises(ValueError):
        token_store.TokenFile(data + b"x")
    with pytest.raises(ValueError):
        token_store.TokenFile(b"y" + data[1:])


def test_token_store(spark):
    manifest = token_store.write_tokens(_docs(spark), new_dir(spark, "t"), BYTE, file_ids=50)
    got = token_store.read_tokens(manifest.cache(), with_ids=True).orderBy("start").collect()
    rows = sorted([(-1, "null id")] + [(i if i < 8 else 7, t or "") for i, t in enumerate(TEXTS)])
    at = 0
    for r, (d, t) in zip(got, rows, strict=True):
        ids = [*_ids(BYTE, t), 0]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (None if d < 0 else d, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_store.read_tokens(token_store.write_tokens(_docs(spark).limit(0), new_dir(spark, "t"), BYTE)).count() == 0


def test_token_counts(spark):
    cache = new_dir(spark, "c")
    got = token_counts.token_counts(_docs(spark), cache, WORD, limit=100).collect()
    want = sorted((len((t or "").encode()), len(_ids(WORD, t)), len(_ids(WORD, t)) > 100) for t in [*TEXTS, "null id"])
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len(set(TEXTS))  # a null and an empty text are one, and "null id" is new
    token_counts.token_counts(_docs(spark), cache, WORD).count()
    assert spark.read.parquet(cache).count() == stored  # all hits
    assert token_counts.token_counts(_docs(spark).limit(0), new_dir(spark, "c"), WORD).count() == 0
