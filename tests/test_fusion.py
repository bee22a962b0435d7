import pytest

from lodestone.operators import fusion, metrics, search
from lodestone.plans.engine import HybridConfig, HybridEngine

SCHEMA = "query_id long, id long, rank1 int, s1 double, s2 double"


def _rows(spark, s1, s2):
    return spark.createDataFrame([(0, i, i + 1, a, b) for i, (a, b) in enumerate(zip(s1, s2, strict=True))], SCHEMA)


def _order(df):
    return [(r.id, r.branch) for r in df.orderBy("rank").collect()]


def test_constant_stage2_keeps_order(spark):
    got = _order(fusion.fuse(_rows(spark, [0.9, 0.7, 0.5, 0.3, 0.1], [0.5] * 5), 5))
    assert got == [(i, "weighted") for i in range(5)]


def test_few_candidates_use_ranks(spark):
    assert {b for _, b in _order(fusion.fuse(_rows(spark, [0.9, 0.5, 0.1], [0.1, 0.5, 0.9]), 3))} == {"rank_fusion"}


def test_inversion(spark):
    got = _order(fusion.fuse(_rows(spark, [0.9, 0.7, 0.5, 0.3], [0.1, 0.2, 0.6, 0.9]), 4))
    assert got == [(i, "inverted") for i in range(4)]


def test_missing_stage2(spark):
    assert _order(fusion.fuse(_rows(spark, [0.9, 0.7], [None, None]), 1)) == [(0, "stage1")]
    assert [i for i, _ in _order(fusion.fuse(_rows(spark, [0.9, 0.7, 0.6], [None, 0.2, 0.4]), 5))] == [1, 2]


def test_unknown_method():
    with pytest.raises(ValueError):
        fusion.FusionConfig("best")


def test_ranks(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([0.8, 0.5, 0.9, 0.5])], "g int, id long, s double")
    got = [(r.ordinal, r.dense) for r in fusion.ordinal_ranks(df, "g", "s", "id").orderBy("id").collect()]
    assert got == [(2, 2), (3, 3), (1, 1), (4, 3)]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 1), (1, 10), (2, 11), (3, None)], "query_id long, rank int")
    r = metrics.metrics(df).first()
    assert r.n == 4 and r.recall_at_1 == 0.25 and r.recall_at_10 == 0.5
    assert abs(r.mrr - (1 + 0.1 + 1 / 11) / 4) < 1e-12 and abs(r.ndcg_at_10 - (1 + 1 / 3.4594316186372973) / 4) < 1e-9


def test_engine(spark):
    x = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, embedding array<double>")
    engine = HybridEngine(x, lambda p: p.selectExpr("query_id", "id", "cast(id as double) as s2"), HybridConfig(k1=5, k2=2))
    first = engine.search_one([5.0, 1.0])
    assert len(first) == 2 and engine.search_one([5.0, 1.0]) == first and engine.statistics()["hit_rate"] == 0.5
    with pytest.raises(ValueError):
        engine.update_config(k1=1, k2=5)
    assert engine.config.k1 == 5
    with pytest.warns(UserWarning):
        engine.update_config(colour=1)
    with pytest.raises(ValueError):
        search.batch_search(x, x, "sound_to_image")
    sizes: list = []

    def make(batch):
        sizes.append(batch)
        return lambda p: p.selectExpr("query_id", "id", "cast(id as double) as s2")

    other = HybridEngine(x, config=HybridConfig(k1=5, k2=2), make_scorer=make)
    q = spark.createDataFrame([(0, [5.0, 1.0])], "query_id long, embedding array<double>")
    found = other.profile(q, [5], [2, 9], [3, 4])
    assert sizes == [3, 4] and len(found) == 2 and other.config.batch_size == 8
    assert other.optimize(found, 0).batch_size == found[0]["batch_size"]
    assert other.search_text("a b", search.HashEncoder(2)) == other.search_one(search.HashEncoder(2).encode(["a b"])[0])
    assert set(other.last) == {"encode_ms", "search_ms", "total_ms", "qps"} and other.statistics()["hits"] == 1
    with pytest.raises(ValueError):
        HybridEngine(x)


def test_encode(spark):
    df = search.encode(spark.createDataFrame([("a b",), ("",), ("a b",)], "t string"), "t", lambda: search.HashEncoder(8))
    v = [r.embedding for r in df.collect()]
    assert v[0] == v[2] and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and v[1] == [0.0] * 8
