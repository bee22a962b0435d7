"""What travels: vectors and texts aren't shuffled where a query doesn't need it."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import vectors as fv
from lodestone.operators import knn, search
from lodestone.plans import derived

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _points(spark, n, dim=6, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, [float(rng.randint(-2, 2)) for _ in range(dim)]) for i in range(n)], "id long, embedding array<float>")


def test_vectors_beyond_a_broadcast_are_not_shuffled(spark, monkeypatch):
    x = _points(spark, 150)
    q = x.withColumnRenamed("id", "query_id")
    want = {m: sorted(map(tuple, knn.knn_join(q, x, 7, m, exclude_self=True).collect())) for m in ("cosine", "euclidean")}
    plans, keep = {}, knn.keep
    monkeypatch.setattr(knn, "keep", lambda df, name, **more: plans.update({name: _plan(df)}) or keep(df, name, **more))
    monkeypatch.setattr(knn, "BROADCAST", 10)
    monkeypatch.setattr(knn, "BLOCK", 60)
    monkeypatch.setattr(knn, "BEST", 40)
    for held in (10, 4_000_000):  # also where a task gives its best out early
        monkeypatch.setattr(knn, "HELD", held)
        for m in want:
            assert sorted(map(tuple, knn.knn_join(q, x, 7, m, exclude_self=True).collect())) == want[m]
    assert "CartesianProduct" in plans["nearest"] and "Generate" not in plans["nearest"]
    assert plans["nearest"].count("Exchange") == plans["nearest"].count("Exchange hashpartitioning(query_id") == 1
    assert "Exchange" not in plans["queries"] and "Exchange" not in plans["corpus"]


def test_a_task_keeps_the_best_of_all_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 60)  # 15 blocks of corpus for each query
    x = _points(spark, 150).coalesce(1)
    found = []
    monkeypatch.setattr(knn, "top_k", lambda scored, k, ascending=False: found.append(scored.count()) or scored)
    knn.knn_join(x.withColumnRenamed("id", "query_id"), x, 3)
    assert found == [150 * 3]


def test_lsh_without_a_row_for_each_table(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = random.Random(3)
    x = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(90)], "id long, embedding array<double>")
    q = x.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    got = knn.lsh_search(q, x, 8, bucket=0.1, tables=3)
    assert "Generate" not in _plan(got)

    def vec(d):
        return d.withColumn("unit", fv.l2_normalize(F.col("embedding"))).withColumn("features", array_to_vector(fv.l2_normalize(F.col("embedding"))))

    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.1, numHashTables=3, seed=42).fit(vec(x))
    pairs = model.approxSimilarityJoin(vec(q), vec(x), 2.0, "distance")
    scored = pairs.select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.id").alias("id"), F.round(fv.dot(F.col("datasetA.unit"), F.col("datasetB.unit")), 12).alias("score"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn.top_k(scored, 8).collect()))
    assert scored.count() < 90 * 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_edges_by_ids_alone(spark, tmp_path):
    at = str(tmp_path / "sf")
    os.symlink(DATA, at)
    for name in ("cooccur_edges", "paired_edges", "unpaired_captions", "node_json"):
        read = re.findall(r"ReadSchema: struct<([^\n]*)>", _plan(entry.queries()[name](spark, at)))
        assert read and not any("text" in columns for columns in read), name
    assert not [k for k in derived._kept if k[1] == at]
    entry.queries()["cross_type_links"](spark, at)
    assert "text" not in derived._kept[(spark.sparkContext.applicationId, at, "captions")].columns


def test_texts_are_not_shuffled_for_few_pairs(spark):
    q = spark.createDataFrame([(0, "a b c")], "query_id long, text string")
    c = spark.range(5000).selectExpr("id", "concat('a b ', id) AS text")
    pairs = spark.createDataFrame([(0, 7), (0, 9), (0, 5001)], "query_id long, id long")
    got = search.jaccard_scorer(q, c)(pairs)
    texts = [line for line in _plan(got).splitlines() if "LeftSemi" in line]
    assert texts and all("BroadcastHashJoin" in line for line in texts)
    assert {r.id: r.s2 for r in got.collect()} == {7: 0.5, 9: 0.5, 5001: None}
