"""Classifiers by held-out accuracy, WARC by round trips, and the pipeline."""

import os
import re
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id, quality, warc
from lodestone.llm.shared import new_dir, stash

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.op5_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.97 * n and n > 100


def test_language_edges(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de")] * 6)] + [(90, None, None), (91, "", "en"), (92, "12 !?", "fr"), (93, "der hund", None), (None, "le chat", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs), ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 93, 90, 91, 92)] == ["en", "fr", "de", "de", "und", "und", "und"] and all(0 <= r.score <= 1 for r in got.values())
    none = docs.where("lang is null")
    assert {r.lang_pred for r in language_id.predict(none, language_id.train(none), ["doc_id"]).collect()} == {"und"}


@needs_data
def test_every_language_is_learned(spark):
    rows = [(200 * k + i, f"l{k:02d}", f"{chr(97 + k % 26)}{chr(97 + k // 26)}qx " * 20) for k in range(33) for i in range(33 - k + 5)]
    rows += [(9000 + i, "zz", "zhuzhu wowo " * 1000) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(docs)
    assert {m for members in model.families.values() for m in members} == {r[1] for r in rows}
    assert model.predict("zhuzhu wowo")[0] == "zz" and model.predict(rows[-50][2])[0] == rows[-50][1]


def test_stages_of_the_pipeline(spark):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 …", None, "s", 4), (3, None, None, "s", 0), (None, "é", None, "s", 1)], kinds)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == ["1", "None"]
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcde"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (0, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2].upper()), (None, texts[3]), (2, texts[4])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], kinds)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    got = sorted((str(r.doc_id), r.text.lower()) for r in kept.collect())
    assert got == sorted([("0", texts[0]), ("1", texts[1]), ("None", texts[2]), ("None", texts[3]), ("2", texts[4])])
    more = spark.createDataFrame([(1, texts[0], "en", "s", 9), (1, texts[1], "en", "s", 9), (None, texts[2], "en", "s", 9), (1, texts[1], "en", "s", 9), (2, None, None, "s", 0), (3, "", None, "s", 0)], kinds)
    assert corpus_pipeline.drop_repeats(spark, more, "").count() == 6
    long = " ".join(f"word{i}" for i in range(60))
    more = spark.createDataFrame([(1, texts[0] + long, "en", "s", 9), (2, long + texts[1], "en", "s", 9), (3, long, "en", "s", 9), (4, long, "en", "s", 9)], kinds)
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, more, "").collect()} == {1: texts[0], 2: texts[1]}
    item = " ".join(f"item{i}" for i in range(15))
    bench = new_dir(spark, "bench")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{bench}/benchmark.parquet")
    more = spark.createDataFrame([(1, texts[0] + " " + item, "en", "s", 9), (1, texts[1], "en", "s", 9), (1, texts[1], "en", "s", 9), (None, item, "en", "s", 9), (2, None, None, "s", 0), (3, "", None, "s", 0)], kinds)
    left = corpus_pipeline.decontaminate(spark, more, bench)
    assert left.columns == corpus_pipeline.COLUMNS and sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(str(x) for x in [(1, texts[1]), (1, texts[1]), (2, None), (3, "")])
    nothing = spark.createDataFrame([], kinds)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, bench).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert language_id.train(docs) is None and language_id.predict(docs, None, ["doc_id"]).count() == 0
    assert quality.score(docs, quality.train(docs, labels), ["doc_id"]).count() == 0


def test_repeated_ids_teach_once(spark):
    rows = [(1, "good words here. " * 5), (2, "BAD!! " * 9)]
    docs = spark.createDataFrame(rows + [rows[0]] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.train(docs, labels).base == quality.train(spark.createDataFrame(rows, docs.schema), labels).base


def test_features_of_long_texts():
    text = "der hund und die katze, " * 5000
    assert abs(language_id.features(text) - language_id.features(text, 1000)).max() < 1e-7


def test_many_languages_stay_within_the_sample(spark):
    rows = [(10 * k + i, f"l{k:02d}", f"{chr(97 + k % 26)}{chr(97 + k // 26)}qx " * 20) for k in range(40) for i in range(10)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), most=100)
    assert sum(map(len, model.families.values())) == 40


def test_quality(spark):
    got = quality.op3_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert right >= 0.95 * n and n > 50


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, "good words here. " * 5 if i % 2 else "BAD!! " * 9, "x") for i in range(60)] + [(60, None, ""), (61, "", ""), (None, "x", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, ["doc_id"]).collect()
    assert len(got) == 63 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert quality.score(docs, quality.train(docs, labels.limit(0)), ["doc_id"]).count() == 63


def test_warc(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é\r\n\r\nx" * 50, "y" * 200_000, "<p>a</p>"]
    rows = [(i + 5, f"http://h/{i}", h) for i, h in enumerate(html)] + [(1, None, "<p>a</p>"), (None, "u", "<p>a</p>"), (5, "again", "<p>a</p>")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload_bytes int")
    files = warc.write_archives(pages, new_dir(spark, "w"), file_bytes=200).cache()
    got = warc.read_archives(files, with_payload=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(p), len((h or "").encode()), warc.base32_sha1((h or "").encode())) for p, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    kind = {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 8}
    assert kind == {(1, "response", None), (5, "revisit", 1), (8, "revisit", 1), (11, "revisit", 1), (None, "revisit", 1)}
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for h in html}
    assert warc.read_archives(warc.write_archives(pages.limit(0), new_dir(spark, "w"))).count() == 0
    high = warc.read_archives(warc.write_archives(pages, new_dir(spark, "w"), least=100).cache())
    assert high.where("record_type = 'revisit'").count() == 0


def test_warc_errors():
    import zstandard

    raw = warc.record("response", "urn:lodestone:page:1", "u", "2020-01-01T00:00:00Z", b"abc", warc.base32_sha1(b"abc"), 3)
    pack = zstandard.ZstdCompressor().compress
    lead = struct.pack("<II", warc.DICT_MAGIC, 4)
    assert warc.parse(raw)[1] == b"abc" and len(list(warc.read_archive(pack(raw) + pack(raw)))) == 2
    for bad in (raw.replace(b"abc", b"abd"), raw.replace(b"Length: 3", b"Length: 4"), raw.replace(b"WARC/1.1", b"WARC/9.9"), raw.replace(b"WARC-Date", b"Other"), raw[:-1]):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    for data in (pack(raw)[:-3], b"junk!!!!", lead, pack(raw) + b"x"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(data))


def _kept_by_brute_force(rows):
    """Of (doc_id, text), those of the smallest id in each group of texts alike in four fifths of their five-word shingles."""
    sets = []
    for _, t in rows:
        w = t.lower().encode().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(rows) if find(i) == i]


def _without_repeats(rows, width):
    raws = [t.encode() for _, t in rows]
    counts = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (d, t), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if counts[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        left = bytes(x for x, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left.strip() or not any(gone):
            out.append((d, left if any(gone) else t))
    return out


def _holds_item(text, items):
    w = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    at = defaultdict(set)
    for i, x in enumerate(w):
        at[x].add(i)
    for item in items:
        n = min(13, len(item))
        hits = Counter()
        for j, x in enumerate(item):
            for i in at[x]:
                hits[i - j] += 1
        for shift, m in hits.items():
            if m >= -(-4 * n // 5) and any(5 * sum(0 <= shift + j < len(w) and w[shift + j] == item[j] for j in range(a, a + n)) >= 4 * n for a in range(len(item) - n + 1)):
                return True
    return False


@needs_data
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from lodestone.llm.bpe import Encoder, default_path

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= corpus_pipeline.SURE]
    items = [re.sub(r"[^\w]+|_", " ", r.text.lower()).split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [rows]
    want.append(_kept_by_brute_force(want[-1]))
    want.append(_without_repeats(want[-1], 240))
    want.append([r for r in want[-1] if not _holds_item(r[1], [x for x in items if len(x) >= 8])])
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stash(stage(spark, docs, sf), name)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == rows, name
    enc = Encoder.at(default_path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    tokens = {d: len(enc.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want[-1]}
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert total == tokens and max(Counter(r.sequence_id for r in pieces).values()) > 1


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        path = new_dir(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    assert docs.select("doc_id").distinct().count() == sizes[-1]
