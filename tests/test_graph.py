import pytest

from lodestone.operators import graph, ingest, profile, search, seeds
from lodestone.plans import jobs
from lodestone.sources import captions as src
from lodestone.sources import stores


@pytest.fixture(scope="module")
def captions(spark):
    rows = [("b", "0", "The Dog runs", 0), ("b", "1", None, 1), ("a", "0", "nan", 2), ("a", "1", "a dig", 3), ("c", "0", " ", 4)]
    return spark.createDataFrame(rows, "image_name string, comment_number string, caption string, row_pos long")


def test_captions(spark, captions, tmp_path):
    assert [r.row_pos for r in ingest.search_captions(captions, "d.g").orderBy("row_pos").collect()] == [0, 3]
    assert [r.row_pos for r in ingest.valid_captions(captions).orderBy("row_pos").collect()] == [0, 3]
    assert {r.image_name for r in ingest.first_images(captions, 1).collect()} == {"b"}
    assert [(r.ext_id, r.node_idx) for r in graph.node_index(captions, "image_name", "row_pos").orderBy("node_idx").collect()] == [("b", 0), ("a", 1), ("c", 2)]
    assert profile.caption_counts(captions).first().n_images == 3
    assert profile.hit_rate(0, 0) == 0 and profile.hit_rate(1, 3) == 0.25
    path = tmp_path / "c.csv"
    path.write_text("image_name| comment_number| comment\nx.jpg | 0 | two dogs \n")
    r = src.load_captions(spark, str(path)).first()
    assert (r.image_name, r.comment_number, r.caption) == ("x.jpg", "0", "two dogs")
    with pytest.warns(UserWarning):
        assert src.load_if_there(spark, str(tmp_path / "none.csv")) is None


def _graph(spark):
    nodes = spark.createDataFrame([("image", i, f"i{i}", None, [1.0, float(i)]) for i in range(2)] + [("caption", i, f"c{i}", f"caption {i} two", [0.5, float(i)]) for i in range(4)], "node_type string, node_idx long, ext_id string, text string, embedding array<float>")
    caps = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(9, 7)], "node_idx long, image_id long")
    imgs = spark.createDataFrame([(0, 0), (1, 1)], "ext_id long, node_idx long")
    return nodes, caps, imgs


def test_graph(spark, tmp_path):
    nodes, caps, imgs = _graph(spark)
    pair = graph.paired_edges(caps, imgs)
    assert sorted((r.src, r.dst) for r in pair.collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)] and graph.unpaired(caps, imgs).count() == 1
    co = graph.cooccur_edges(caps.where("node_idx < 4"))
    assert sorted((r.src, r.dst) for r in co.collect()) == [(0, 2), (1, 3), (2, 0), (3, 1)]
    n, e = graph.assemble(nodes, pair, co, dim=2)
    stores.save_graph(n, e, str(tmp_path / "g"))
    n2, e2 = stores.load_graph(spark, str(tmp_path / "g"), 2)
    assert n2.count() == 6 and e2.count() == 8 and n2.where("text = 'caption 3 two'").count() == 1
    with pytest.raises(ValueError):
        graph.assemble(nodes, pair, co, dim=3)
    with pytest.raises(FileNotFoundError):
        stores.load_graph(spark, str(tmp_path / "none"))


def test_terms(spark):
    gathered = spark.createDataFrame([(0, 1, 0, 0, 1), (0, 1, 0, 0, 2), (0, 2, 0, 0, 1)], "query_id long, seed_rank int, path int, via long, caption long")
    caps = spark.createDataFrame([(1, "a b"), (2, "b")], "id long, text string")
    got = {(r.term, r.n, r.first_pos) for r in seeds.term_counts(gathered, caps).collect()}
    assert got == {("a", 2, 0), ("b", 3, 1), ("a b", 2, 0), ("b b", 1, 1), ("b a", 1, 2)}
    top = seeds.top_terms(seeds.term_counts(gathered, caps), 2)
    q = spark.createDataFrame([(0, "q"), (1, "r")], "query_id long, text string")
    assert {r.query_id: r.enriched for r in seeds.enrich(q, top).collect()} == {0: "q; b; a", 1: "r"}


def test_stores(spark, tmp_path):
    x = spark.createDataFrame([(0, [1.0])], "id long, embedding array<float>")
    stores.save_embeddings(x, str(tmp_path / "e"), {"model": "m"})
    df, meta = stores.load_embeddings(spark, str(tmp_path / "e"))
    assert df.count() == 1 and meta == {"model": "m"}
    stores.save_index(x, stores.IndexSpec(1), str(tmp_path / "i"))
    assert stores.load_index(spark, str(tmp_path / "i"))[1] == stores.IndexSpec(1)
    with pytest.raises(ValueError):
        stores.IndexSpec(1, "tree")


def test_stores_are_atomic(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = (spark.createDataFrame([(i, [1.0])], "id long, embedding array<float>") for i in (1, 2))
    stores.save_embeddings(one, path)
    held = stores.load_embeddings(spark, path)[0]
    version = stores.new_version(path)
    two.write.parquet(f"{version}/rows")  # a writer that dies before it publishes
    assert stores.load_embeddings(spark, path)[0].first().id == 1
    stores.save_embeddings(two, path)
    assert stores.load_embeddings(spark, path)[0].first().id == 2 and held.first().id == 1  # who has begun reads on
    stores.save_embeddings(one, path)
    assert len([x for x in (tmp_path / "s").iterdir() if x.name.startswith("v-")]) == 2
    with pytest.raises(FileNotFoundError):
        stores.load_index(spark, str(tmp_path / "none"))


def test_graph_of_another_type_is_refused(spark, tmp_path):
    nodes, caps, imgs = _graph(spark)
    edges = graph.paired_edges(caps, imgs)
    stores.save_graph(nodes.withColumn("embedding", nodes.embedding.cast("array<double>")), edges, str(tmp_path / "d"))
    with pytest.raises(ValueError, match="float"):
        stores.load_graph(spark, str(tmp_path / "d"))


def test_jobs(spark, tmp_path):
    caps = spark.createDataFrame([(0, "a dog runs"), (1, None), (2, "a cat"), (3, " ")], "id long, caption string")
    rows = jobs.embed_captions(caps, lambda: search.HashEncoder(8), str(tmp_path / "t"))
    assert sorted(r.id for r in rows.collect()) == [0, 2] and stores.load_embeddings(spark, str(tmp_path / "t"))[1] == {"model_type": "HashEncoder", "dim": 8}
    images = spark.createDataFrame([(0, b"x"), (1, None)], "id long, content binary")
    assert jobs.embed_images(images, lambda: search.HashEncoder(8), str(tmp_path / "i")).count() == 1
    points = jobs.random_vectors(spark.range(40), 6)
    assert points.collect() == jobs.random_vectors(spark.range(40), 6).collect()
    q = points.where("id < 5").withColumnRenamed("id", "query_id")
    for kind in ("flat", "ivf", "lsh"):
        jobs.build_index(points, stores.IndexSpec(6, kind, nlist=4, nprobe=4), str(tmp_path / kind))
        found = jobs.open_index(spark, str(tmp_path / kind))(q, 1)
        assert {(r.query_id, r.id) for r in found.collect()} == {(i, i) for i in range(5)}
    with pytest.raises(ValueError):
        jobs.build_index(points, stores.IndexSpec(6, "ivf", nlist=99), str(tmp_path / "few"))


def test_stored_graph(spark, tmp_path):
    caps = spark.createDataFrame([(i, i % 3, f"caption {i}", [1.0, float(i), 2.0], i) for i in range(9)], "id long, image_id long, text string, embedding array<double>, row_pos long")
    images = spark.createDataFrame([(i, [float(i), 1.0, 0.0]) for i in (0, 1, 5)], "image_id long, embedding array<double>")
    nodes, edges = jobs.build_stored_graph(caps, images, str(tmp_path / "g"), 2, 2, 3)
    assert {(r.src_type, r.edge_type): r.n_edges for r in graph.edge_counts(edges).collect()} == {("image", "sem_sim"): 2, ("caption", "sem_sim"): 18, ("caption", "paired_with"): 6, ("caption", "cooccur"): 18}
    assert nodes.where("node_type = 'caption' AND text = 'caption 8'").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"abc")
    names = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "image_name string")
    assert {r.image_name: r.content and bytes(r.content) for r in src.image_blobs(spark, names, str(tmp_path / "img")).collect()} == {"a.jpg": b"abc", "b.jpg": None}
    report = {r.name: (r.there, r.n_jpg) for r in src.data_report(spark, {"x": str(tmp_path / "img"), "y": str(tmp_path / "no")}).collect()}
    assert report == {"x": (True, 1), "y": (False, 0)}
    stores.save_config({"a": 1}, str(tmp_path / "c.json"))
    assert stores.load_config(str(tmp_path / "c.json")) == {"a": 1}
    with pytest.raises(FileNotFoundError):
        stores.load_config(str(tmp_path / "no.json"))
