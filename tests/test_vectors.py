import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as ft
from lodestone.functions import vectors as fv
from lodestone.operators import knn, search


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(fv.l2_normalize(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0], [1.0, 0.0]]


def test_checks(spark):
    df = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [1.0, 1.0]), (3, [float("inf"), 0.0])], "i int, v array<double>")
    assert [r[0] for r in df.select(fv.is_finite(F.col("v"))).collect()] == [False, True, False]
    with pytest.raises(Exception, match="finite"):
        df.select(fv.checked(F.col("v"), 2)).collect()


def test_combine(spark):
    row = spark.createDataFrame([([1.0, 2.0], [10.0, 20.0])], "a array<double>, b array<double>").select(fv.combine((2.0, F.col("a")), (0.5, F.col("b")))).first()
    assert row[0] == [7.0, 14.0]


def _points(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_knn_edges(spark):
    x = _points(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)])
    q = x.withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.id for r in knn.knn_join(q, x, 5).collect()}
    assert got[(0, 1)] == 0 and got[(0, 2)] == 1 and got[(0, 3)] == 2 and len(got) == 9  # ties by id, k above N, null left out
    others = {(r.query_id, r["rank"]): r.id for r in knn.knn_join(q, x, 1, exclude_self=True).collect()}
    assert others == {(0, 1): 1, (1, 1): 0, (2, 1): 0}
    assert knn.knn_join(q.limit(0), x, 3).count() == 0 and knn.knn_join(q, x.limit(0), 3).count() == 0
    one = x.where("id = 0")
    assert knn.semantic_edges(one, 3, 3, "image").count() == 0
    with pytest.raises(ValueError):
        knn.knn_join(q, x, 1, metric="taxicab")


def test_knn_paths_agree(spark):
    import random

    rng = random.Random(1)
    x = _points(spark, [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)])
    q = x.where("id < 7").withColumnRenamed("id", "query_id")
    unit = lambda d: d.withColumn("embedding", fv.l2_normalize(F.col("embedding")))
    a = knn.knn_join(unit(q), unit(x), 5).select("query_id", "rank", "id")
    b = knn.knn_join_sql(unit(q), unit(x), 5).select("query_id", "rank", "id")
    assert a.exceptAll(b).count() == 0 and a.count() == 35


def test_lsh_recall(spark):
    import random

    rng = random.Random(2)
    x = _points(spark, [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(80)])
    q = x.where("id < 10").withColumnRenamed("id", "query_id")
    exact, near = knn.knn_join(q, x, 5), knn.lsh_search(q, x, 5)
    assert exact.join(near, ["query_id", "id"]).count() >= 0.9 * exact.count()


def test_text(spark):
    df = spark.createDataFrame([("A b-c,  d!",), ("  ",), (None,)], "t string")
    assert [r[0] for r in df.select(ft.tokens(F.col("t"))).collect()] == [["a", "bc", "d"], [], []]
    p = spark.range(1).select(ft.yes_probability(F.array(F.lit(1.0)), F.array(F.lit(1.0))).alias("a"), ft.yes_probability(F.lit(None).cast("array<double>"), F.array(F.lit(1.0))).alias("b")).first()
    assert p.a == 0.5 and p.b is None


def test_knn_sql_takes_all_queries(spark):
    q = spark.range(1500).selectExpr("id AS query_id", "array(1D, CAST(id AS double)) AS embedding")
    x = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, embedding array<double>")
    for block in (100, knn.BLOCK):
        knn.BLOCK, held = block, knn.BLOCK
        got = knn.knn_join_sql(q, x, 1).collect()
        knn.BLOCK = held
        assert sorted(r.query_id for r in got) == list(range(1500)) and all(r.id == (r.query_id > 1) or r.query_id == 1 for r in got)


def test_blocks_beyond_a_broadcast(spark, monkeypatch):
    import random

    rng = random.Random(5)
    x = _points(spark, [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(120)])
    q = x.withColumnRenamed("id", "query_id")
    for metric in ("cosine", "euclidean"):
        want = sorted(map(tuple, knn.knn_join(q, x, 7, metric, exclude_self=True).collect()))
        monkeypatch.setattr(knn, "BROADCAST", 10)
        monkeypatch.setattr(knn, "BLOCK", 60)
        assert sorted(map(tuple, knn.knn_join(q, x, 7, metric, exclude_self=True).collect())) == want
        monkeypatch.undo()
    assert all(r[2] != r[0] for r in want) and len(want) == 7 * 120


def test_trained_lists(spark):
    import random

    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    x = _points(spark, [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 6]]) for i in range(300)])
    q = x.where("id < 40").withColumnRenamed("id", "query_id")
    lists, centroids = knn.build_ivf(x, 6)
    assert lists.count() == 300 and lists.select("list_id").distinct().count() == 6
    exact = knn.knn_join(q, x, 10)
    assert knn.recall(knn.ivf_search(q, lists, centroids, 10, 2), exact).first().recall >= 0.9
    assert sorted(map(tuple, knn.ivf_search(q, lists, centroids, 10, 6).collect())) == sorted(map(tuple, exact.collect()))
    assert sorted(map(tuple, knn.search_index(q, x, 10, (lists, centroids), 6, exact_up_to=10).collect())) == sorted(map(tuple, exact.collect()))
    with pytest.warns(UserWarning, match="index not used"):
        assert knn.search_index(q, x, 10, (None, None)).count() == exact.count()


def test_encoders_and_scorers(spark):
    sizes: list = []

    def tight(items):
        sizes.append(len(items))
        if len(items) > 3:
            raise MemoryError
        return [len(x) for x in items]

    assert search.in_batches(tight, ["a"] * 10, 8) == [1] * 10 and sizes == [8, 4, 2, 2, 2, 2, 2]
    with pytest.raises(MemoryError):
        search.in_batches(lambda x: (_ for _ in ()).throw(MemoryError), ["a"], 4)

    class Model:
        higher_is_better = True

        def score(self, texts, images):
            if "bad" in texts:
                raise RuntimeError
            return [len(t) / (len(i) + len(t)) for t, i in zip(texts, images, strict=True)]

    q = spark.createDataFrame([(0, "abc"), (1, "bad"), (2, None)], "query_id long, content string")
    c = spark.createDataFrame([(7, bytearray(b"x"))], "id long, content binary")
    pairs = spark.createDataFrame([(0, 7), (1, 7), (2, 7), (0, 8)], "query_id long, id long")
    got = {(r.query_id, r.id): r.s2 for r in search.pair_scorer(q, c, Model)(pairs).collect()}
    assert got == {(0, 7): 0.75, (1, 7): None, (2, 7): None, (0, 8): None}
    swapped = search.pair_scorer(c.withColumnRenamed("id", "query_id"), q.withColumnRenamed("query_id", "id"), Model, "image", "text")
    assert swapped(spark.createDataFrame([(7, 0)], "query_id long, id long")).first().s2 == 0.75
    with pytest.raises(NotImplementedError):
        search.pair_scorer(q, c, Model, "text", "text")
    with pytest.raises(ValueError):
        search.pair_scorer(q, c, Model, "sound", "image")
    with pytest.raises(ValueError):
        search.encode_query(q, "sound", 4)
    given = spark.createDataFrame([([3.0, 4.0],)], "query array<double>")
    assert [round(x, 6) for x in search.encode_query(given, "vector", 2).first().embedding] == [0.6, 0.8]
    with pytest.raises(Exception, match="finite"):
        search.encode_query(given, "vector", 3).collect()


def test_yes_no_tokens(spark):
    ids = {"yes": [5, 1], " yes": [6], "Yes": [5], " Yes": [], "no": [8], " no": [9], "No": [8], " No": [10]}
    assert ft.yes_no_ids(ids.get) == ([5, 6], [8, 9, 10])
    with pytest.raises(ValueError):
        ft.yes_no_ids(lambda s: [])
    row = spark.range(1).select(ft.picked_logits(F.array(*map(F.lit, [0.1, 0.2, 0.3])), [2, 0, 9]).alias("x")).first()
    assert row.x == [0.3, 0.1]


def test_alignment_warns(spark):
    x = _points(spark, [(0, [3.0, 4.0]), (1, [1.0, 0.0])])
    with pytest.warns(UserWarning, match="1 vectors"):
        assert fv.aligned(x, 2, renorm=False, check_unit_norm=True).where("id = 0").first().embedding == [3.0, 4.0]
