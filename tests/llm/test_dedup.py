"""SimHash, suffix dedup, decontamination and SpotSigs against brute force."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import set_join, shared, simhash, spotsigs, suffix_dedup
from lodestone.llm.components import connected_components
from lodestone.llm.decontamination import contamination


def _groups(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _groups(edges, {x for e in edges for x in e})
    assert all(got.get(n, n) == c for n, c in want.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _print(text):
    w = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(60, None, 1), (61, "", 1), (62, " \n", 1), (63, "É É", 1), (64, texts[0].upper(), 1), (64, texts[1], 1), (None, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    prints = [(d, _print(t or "")) for d, t, _ in rows]
    known = [(d, f) for d, f in prints if d is not None]
    want = _groups([(a, b) for i, (a, x) in enumerate(known) for b, y in known[:i] if (x ^ y).bit_count() <= 2], {d for d, _ in known})
    for cap in (2, 64):
        got = simhash.simhash_components(df, cell_cap=cap).collect()
        assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d), f"{f:016x}") for d, f in prints)
        assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_links_of_larger_radius(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {}
    for i in range(200):
        x = rng.choice(base)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        prints.setdefault(x, i)
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for x, i in prints.items()], "node long, fp long")
    items = [(i, x) for x, i in prints.items()]
    for cap in (3, 64):
        found = {r.node: r.component for r in connected_components(simhash.links(nodes, 4, cap)).collect()}
        want = _groups([(a, b) for k, (a, x) in enumerate(items) for b, y in items[:k] if (x ^ y).bit_count() <= 4], {i for i, _ in items})
        assert all(found.get(i, i) == c for i, c in want.items())


def test_near_copies(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    docs = [" ".join(word() for _ in range(120)) for _ in range(30)]
    rows = list(enumerate(docs))
    for i in range(10):  # one word of 120 changed: a similarity of 0.92
        w = docs[i].split()
        w[60] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, docs[20].upper()), (201, None), (202, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[100 + i] == i for i in range(10)) >= 9 and got[200] == 20 and got[202] == 201
    assert all(got[i] == i for i in range(30))


def _alike(texts, words=5, least=0.8):
    """Components of the ids of (doc_id, text) by brute force."""
    sets = []
    for d, t in texts:
        w = t.lower().split()
        sets.append((d, {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}))
    return _groups([(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if 5 * len(x & y) >= 4 * len(x | y)], [d for d, _ in texts])


def test_near_copies_in_crowded_cells(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = []
    for family in range(3):  # edits of edits of a template, of which many are alike only among themselves
        made = [[word() for _ in range(100)]]
        for _ in range(40):
            w = list(rng.choice(made))
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            made.append(w)
        rows += [(100 * family + i, " ".join(w)) for i, w in enumerate(made)]
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), _alike(rows)
    assert 3 < len(set(want.values())) < 100
    for cap in (3, 64):
        assert {r.doc_id: r.component_id for r in simhash.near_copy_components(df, cell_cap=cap).collect()} == want


def test_near_copies_of_every_kind_of_edit(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(40):  # a block appended, a block cut, a short text with words added: just over and just under the threshold
        n = rng.choice([12, 30, 200])
        w = [word() for _ in range(n)]
        more = round((n - 4) * rng.uniform(0.1, 0.3))
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w + [word() for _ in range(more)])), (3 * i + 2, " ".join(w[more // 2 :]))]
    want = _alike(rows)
    assert 40 < len(set(want.values())) < 120
    got = {r.doc_id: r.component_id for r in simhash.near_copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def _spied(monkeypatch, module):
    """The rows of each table that the module writes from now on, by name."""
    made, stash = collections.defaultdict(list), module.stash

    def spy(df, name):
        out = stash(df, name)
        made[name].append(out.count())
        return out

    monkeypatch.setattr(module, "stash", spy)
    return made


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _variants(rng, base, edits):
    """Sets with so many elements of base replaced by new ones."""
    return [sorted(set(rng.sample(base, len(base) - n)) | {rng.getrandbits(60) for _ in range(n)}) for n in edits]


def _to_sets(t, then=iter, schema="node long, s array<bigint>"):
    return t.select("node", "s").mapInArrow(lambda batches: then(batches), schema)


def _like(x, y):
    return 5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y))


def test_crowded_cells_of_the_same_sets_are_one(spark, monkeypatch):
    rng = random.Random(18)
    base = [rng.getrandbits(60) for _ in range(100)]
    # a large component, and sets outside it that share elements of its prefixes but are like few others
    sets = _variants(rng, base, [rng.randint(1, 4) for _ in range(60)] + [rng.randint(9, 14) for _ in range(40)])
    rows = list(enumerate(sets))
    want = _groups([(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if _like(x, y)], range(100))
    made = _spied(monkeypatch, set_join)
    found = {r.node: r.component for r in set_join.similar_components(spark.createDataFrame(rows, "node long, s array<bigint>"), _to_sets, 0.8, cell_cap=8).collect()}
    assert {i: found.get(i, i) for i in range(100)} == want and 10 < len(set(want.values())) < 60
    assert 0 < sum(made["crowded-sets"]) <= 200  # a row for each set and cell were 1172


def test_blocks_of_joint_and_of_separate_cells(spark, monkeypatch):
    rng = random.Random(19)
    base = [rng.getrandbits(60) for _ in range(50)]
    sets = dict(enumerate(_variants(rng, base, [1] * 10 + [8, 3, 9, 2, 7, 4, 8, 3, 9, 2, 6, 4, 7, 3, 9, 2, 8, 5, 7, 4])))
    left = []
    for token, nodes in ((1, range(10, 15)), (2, range(15, 20))):  # one main component, but other sets outside it: apart is less
        left += [(token, n, 0 if n < 10 else n, 0, 15) for n in [*range(10), *nodes]]
    for token in range(3, 8):  # the same sets in five cells
        left += [(token, n, 5 if n < 10 else n, 5, 20) for n in [*range(10), *range(20, 30)]]
    df = spark.createDataFrame(left, "token long, node long, c long, main long, count long")
    rows = spark.createDataFrame(list(sets.items()), "node long, s array<bigint>")
    true = [(a[1], b[1]) for a in left if a[2] != a[3] for b in left if a[0] == b[0] and a[2] != b[2] and _like(sets[a[1]], sets[b[1]])]
    made = _spied(monkeypatch, set_join)
    for block in (3, 256):
        links = [tuple(r) for r in set_join._by_blocks(df, rows, _to_sets, 0.8, block).collect()]
        assert set(links) <= set(true) and 2 < len({a for a, _ in true}) < 20
        own = [(i, 0) for i in range(10)]
        assert _groups(links + own, range(30)) == _groups(true + own, range(30))
    assert made["crowded-sets"] == [50, 50]


def test_prefixes_in_one_pass(spark, monkeypatch):
    plans, stash = {}, set_join.stash
    monkeypatch.setattr(set_join, "stash", lambda df, name: (plans.setdefault(name, _plan(df)), stash(df, name))[1])
    rows = [(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 5]), (3, [9])]
    found = set_join.similar_components(spark.createDataFrame(rows, "node long, s array<bigint>"), _to_sets, 0.8).collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 1)]
    assert plans["prefixes"].count("MapInArrow") == 1  # else two Python workers for each core


def test_tables_leave_no_shuffle_files(spark):
    files = lambda: [f.getName() for f in list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())) if f.getName().startswith("shuffle_")]
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, on = set(files()), spark.conf.get(key, None)
    kept = spark.range(50_000).repartition(7, "id")
    out = shared.stash(kept.groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    for _ in range(50):  # files go soon after
        if set(files()) <= before:
            break
        time.sleep(0.1)
    assert set(files()) <= before and out.count() == 1000 and spark.conf.get(key, None) == on
    shared.discard(out)


def test_near_copies_shuffle_texts_once(spark, monkeypatch):
    plans, stash = {}, simhash.stash
    monkeypatch.setattr(simhash, "stash", lambda df, name: (plans.setdefault(name, _plan(df)), stash(df, name))[1])
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i % 7 or None, f"text {i % 9} of some words here", "en", "s", 1) for i in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        out = corpus_pipeline.drop_near_copies(spark, docs, "")
        plans["out"] = _plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert plans["texts"].count("Exchange hashpartitioning") == 2  # the texts and their heads
    assert "Exchange hashpartitioning" not in plans["out"].split("LeftSemi")[0]
    want = {(d, t) for d, t, *_ in rows}
    assert {(r.doc_id, r.text) for r in out.collect()} <= want and out.count() == 9 and out.where("doc_id is null").count() <= 1


def _brute(texts, width):
    counts = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def test_repeated_windows():
    rng = random.Random(3)
    for trial in range(60):
        width = rng.choice([3, 5, 8, 20])
        widths = sorted({rng.randint(2, width), width})
        base = [bytes(rng.choice(b"ab" if trial % 2 else b"abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(6)]
        texts = [rng.choice(base)[rng.randint(0, 20) :] + rng.choice(base) for _ in range(8)]
        copies = [rng.choice([1, 1, 2]) for _ in texts]
        judged = [max(0, len(t) - widths[0] + 1 - rng.choice([0, 0, 9])) for t in texts]  # windows beyond these belong to another segment
        all_ = [*zip(texts, judged, strict=True), *((t, n) for t, n, c in zip(texts, judged, copies, strict=True) if c > 1)]
        found = suffix_dedup.repeated_windows(texts, judged, copies, widths)
        for k, w in enumerate(widths):
            counts = collections.Counter(t[i : i + w] for t, n in all_ for i in range(min(n, len(t) - w + 1)))
            for t, n, runs in zip(texts, judged, found, strict=True):
                assert {i for a, b, j in runs if j == k for i in range(a, b + 1)} == {i for i in range(min(n, len(t) - w + 1)) if counts[t[i : i + w]] > 1}


def test_suffix_dedup(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice(["ab", "cd ", "éx", "zz\n", "q", "the "]) for _ in range(rng.randint(5, 80))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(base) for _ in range(rng.randint(0, 4)))) for i in range(150)]
    rows += [(300, None), (301, ""), (302, "a" * 500), (303, rows[5][1]), (303, rows[6][1]), (None, rows[7][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    texts = [(t or "").encode() for _, t in rows]
    want = sorted(str((d, *b)) for (d, _), b in zip(rows, _brute(texts, 40), strict=True))
    for cap in (3, 4000):
        got = suffix_dedup.remove_repeats(df, 40, 16, cap).collect()
        assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, 40, 10, passage=25).collect()}
    assert sorted(str((d, *b)) for (d, _), b in zip(rows, _brute(texts, 40), strict=True)) == sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got.values())
    some, all_ = ({d for (d, _), b in zip(rows, _brute(texts, w), strict=True) if b[1]} for w in (25, 10))
    assert some <= {d for d, r in got.items() if r.n_repeated} <= all_ and all(r.n_repeated <= b[1] for r, b in zip((got[i] for i in range(len(rows))), _brute(texts, 10), strict=True))
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_dedup_of_a_text_of_several_spans(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPAN", 1000)
    rng = random.Random(15)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(6000))) for i in range(3)]
    rows += [(3, rows[0][1][900:1100] + "".join(rng.choice("xyz") for _ in range(2500)) + rows[1][1][1950:2050]), (4, rows[2][1][10:5900])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(str((d, *b)) for (d, _), b in zip(rows, _brute([t.encode() for _, t in rows], 40), strict=True))
    got = suffix_dedup.remove_repeats(df, 40, 16, passage=30).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    items = [[word() for _ in range(n)] for n in (30, 20, 9, 5)]
    text = lambda w: " ".join(word() for _ in range(40)) + ", " + " ".join(w) + ". " + " ".join(word() for _ in range(40))
    swapped = list(items[0])
    swapped[5] = swapped[14] = "other"
    rows = [(0, text(items[0])), (1, text(swapped)), (2, text(items[1][:13]).upper()), (3, text(items[1][:9])), (4, text(items[2])), (5, text(items[3])), (6, text([])), (7, None), (8, ""), (0, text(items[1])), (None, text(items[0])), (9, text(items[0] * 50))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in contamination(docs, bench).collect()}
    assert got == {(0, 0): 13, (0, 1): 13, (1, 0): 13, (2, 1): 13, (4, 2): 9, (9, 0): 13}
    assert contamination(docs.limit(0), bench).count() == 0 and contamination(docs, bench.limit(0)).count() == 0


def test_masks_miss_no_replacement():
    from itertools import combinations

    from lodestone.llm.decontamination import MASKS, SHORT_MASKS

    for n in range(8, 20):
        masks, window = (MASKS, 13) if n >= 13 else (SHORT_MASKS, n)
        lost = window - -(-4 * window // 5)
        spots = [{i + j for j, bit in enumerate(m) if bit == "1"} for m in masks for i in range(window - len(m) + 1)]
        for k in range(lost + 1):
            assert all(any(not s & set(gone) for s in spots) for gone in combinations(range(window), k))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(18)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(25)]
    word = lambda: rng.choice(vocabulary)
    items = [[word() for _ in range(n)] for n in (8, 8, 9, 10, 11, 12, 13, 14, 20, 40, 7, 0)]
    rows = []
    for d in range(150):
        w = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)
            a = rng.randint(0, max(0, len(item) - 13))
            part = list(item[a : a + 13]) if rng.random() < 0.7 else list(item)
            for _ in range(rng.randint(0, 4)):
                if part:
                    part[rng.randrange(len(part))] = word()
            w += part + [word() for _ in range(rng.randint(0, 9))]
        rows.append((d if d % 9 else 0, " ".join(w)))
    want: dict = {}
    for d, t in rows:
        w = t.split()
        for k, item in enumerate(items):
            n = min(13, len(item))
            for i in range(len(item) - n + 1) if len(item) >= 8 else ():
                for at in range(-n, len(w)):
                    m = sum(0 <= at + j < len(w) and w[at + j] == item[i + j] for j in range(n))
                    if 5 * m >= 4 * n:
                        want[d, k] = max(want.get((d, k), (0,)), (m, -at, -i))
    assert len(want) > 60
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, -r.doc_start, -r.item_start) for r in contamination(docs, bench).collect()}
    assert got == want


def test_spotsigs(spark):
    rng = random.Random(10)
    word = lambda: rng.choice(["the", "a", "of"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    rows = [(2 * i, " ".join(word() for _ in range(rng.randint(0, 80)))) for i in range(40)] + [(3, None), (5, ""), (7, "…"), (9, "é" * 7), (0, "tie"), (None, "no id")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars int")
    got = spotsigs.edited_fingerprints(df).collect()
    ordered = sorted(((-1 if d is None else d, t or "") for d, t in rows))
    want = []
    for k, (d, t) in enumerate(ordered):
        n = len(t) // 4
        edited = t[: len(t) - n] + ordered[(k + 1) % len(ordered)][1][:n]
        want.append((None if d < 0 else d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 200]
    assert min(r.near_edited for r in long) > max(r.near_next for r in long)
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    assert spotsigs.edited_fingerprints(df.limit(0)).count() == 0 and spotsigs.edited_fingerprints(df.where("doc_id = 3")).first().near_next == 1.0


def test_spotsigs_of_long_texts(spark):
    rng = random.Random(13)
    content = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(4000)]
    w = [x for c in content for x in ("the", c)]  # some 4000 signatures
    swapped = list(w)
    swapped[4001] = "unlikeanyother"
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(swapped))], "doc_id long, text string")
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(df).collect()}
    assert got[1].fingerprint != got[2].fingerprint
    sets = [{(a[i + 1], a[i + 3] if i + 3 < len(a) else "") for i in range(0, len(a), 2)} for a in (w, swapped)]
    assert abs(got[1].near_next - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 1e-12 and got[1].near_next < 1


def _signatures(text):
    """Signatures of a text by plain Python: a spot with the next two content words among the eight words after it."""
    w = re.sub(r"[^a-zäöüßéèêçñóíáàùû0-9]+", " ", (text or "").lower()).split()
    common = lambda x: len(x) <= 3 or x in spotsigs.SPOTS
    out = set()
    for i, x in enumerate(w):
        after = [y for y in w[i + 1 : i + 9] if not common(y)][:2]
        if common(x) and after:
            out.add((x, *after))
    return out or set(w) or {text or ""}


def test_spotsigs_likeness_against_plain_python(spark):
    rng = random.Random(16)
    word = lambda: rng.choice(["the", "a", "of", "nicht", "with"]) if rng.random() < 0.4 else "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 5, 60, 900])))) for i in range(60)]
    rows += [(100, rows[3][1] + " the end of it"), (101, rows[3][1]), (102, None), (103, "")]
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    for k, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        assert abs(got[d].near_edited - jaccard(_signatures(t), _signatures(edited))) < 1e-12
        assert abs(got[d].near_next - jaccard(_signatures(t), _signatures(nxt))) < 1e-12


def test_spotsigs_next_document_with_a_frequent_id(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(rng.choice([-(1 << 62), 7, 7, 7, i, 1 << 62]), f"{i:06d} the {word()} {word()}") for i in range(400)]  # a quarter is the first six characters
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spotsigs.edited_fingerprints(df).select("doc_id", "edited_sha256").collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    cut = lambda t, u: t[: len(t) - len(t) // 4] + u[: len(t) // 4]
    known = {sha(cut(t, u)): (t, u) for _, t in rows for _, u in rows}
    follow = {known[r.edited_sha256][0]: known[r.edited_sha256][1] for r in got}
    # a cycle over all rows, in ascending order of ids; the order of rows of one id is open
    prefixes = {t[:6] for _, t in rows}
    assert len(follow) == len(rows) == len(prefixes)
    at, seen = rows[0][1], []
    ids = {t: d for d, t in rows}
    for _ in rows:
        seen.append(ids[at])
        at = follow[at]
    assert at == rows[0][1] and sum(b < a for a, b in zip(seen, [*seen[1:], seen[0]], strict=True)) == 1


def test_spotsigs_classes(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for family in range(4):
        made = [[word() for _ in range(60)]]
        for _ in range(20):
            a = list(rng.choice(made))
            for _ in range(rng.randint(1, 4)):
                a[rng.randrange(len(a))] = word()
            made.append(a[: rng.randint(50, 60)])
        rows += [(7 * i + family, " ".join(f"the {x}" for x in a)) for i, a in enumerate(made)]
    rows += [(1000, None), (1001, ""), (None, rows[3][1])]
    named = [(d, [x for x in t.split() if x != "the"]) for d, t in rows if t and d is not None]
    sets = [(d, {tuple(a[i : i + 2]) for i in range(len(a))}) for d, a in named]
    want = _groups([(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if 5 * len(x & y) >= 4 * len(x | y)], [d for d, _ in named])
    assert 4 < len(set(want.values())) < 70
    for cap in (3, 64):
        got = {r.doc_id: r.class_id for r in spotsigs.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), cell_cap=cap).collect()}
        assert got == want | {1000: 1000, 1001: 1000, None: want[rows[3][0]]}


def test_picked_rows_are_not_shuffled(spark, monkeypatch):
    rows = spark.range(1000).select(F.col("id").alias("node"), F.lit("some text").alias("text"))
    nodes = spark.createDataFrame([(3,), (5,), (3,), (2000,)], "node long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, kind in ((10, "BroadcastHashJoin"), (1, "SortMergeJoin")):
            monkeypatch.setattr(set_join, "PICKED", most)
            got, wanted = set_join._picked(rows, nodes, nodes.where("node > 3"))
            assert kind in got._jdf.queryExecution().executedPlan().toString()
            assert sorted(r.node for r in got.collect()) == [3, 5] and wanted.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
