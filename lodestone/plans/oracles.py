"""SQL for DuckDB that gives the rows of ``queries.py``."""

from __future__ import annotations

UNIT = "list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"
TOKENS = r"list_filter(list_transform(regexp_split_to_array(lower({t}), '\s+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '')"

#: Named CTEs with what they need.
CTES: dict[str, tuple[list[str], str]] = {
    "raw": ([], "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings"),
    "img": (["raw"], f"SELECT id, {UNIT.format(v='v')} AS v, label FROM raw"),
    "size": ([], "SELECT count(*) AS n FROM embeddings"),
    "qraw": (["raw", "size"], """SELECT b.item_id AS query_id, b.text, (b.item_id * 37) % n AS gt,
        list_transform(list_zip(x.v, y.v, z.v), lambda p: p[1] * (0.2::DOUBLE + 0.1::DOUBLE * (b.item_id % 4)) + p[2] * 0.35::DOUBLE + p[3] * 0.3::DOUBLE) AS v
        FROM benchmark b CROSS JOIN size JOIN raw x ON x.id = (b.item_id * 37) % n JOIN raw y ON y.id = (b.item_id * 53 + 11) % n JOIN raw z ON z.id = (b.item_id * 71 + 29) % n"""),
    "q": (["qraw"], f"SELECT query_id, text, gt, {UNIT.format(v='v')} AS v FROM qraw"),
    "craw": (["raw", "size"], """SELECT d.doc_id AS id, d.text, d.doc_id % n AS image, list_transform(list_zip(x.v, y.v), lambda p: p[1] * 0.8::DOUBLE + p[2] * 0.2::DOUBLE) AS v
        FROM documents d CROSS JOIN size JOIN raw x ON x.id = d.doc_id % n JOIN raw y ON y.id = (d.doc_id * 31 + 7) % n"""),
    "cap": (["craw"], f"SELECT id, text, image, {UNIT.format(v='v')} AS v FROM craw"),
    "pairs": (["q", "img"], "SELECT q.query_id, img.id, round(list_dot_product(q.v, img.v), 12) AS score FROM q CROSS JOIN img"),
    "near": (["pairs"], "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM pairs"),
    "cpairs": (["q", "cap"], "SELECT q.query_id, cap.id, round(list_dot_product(q.v, cap.v), 12) AS score FROM q CROSS JOIN cap"),
    "cnear": (["cpairs"], "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM cpairs"),
    "cand": (["near"], "SELECT query_id, id, rank AS rank1, score AS s1, ((id * 7 + query_id * 13) % 101) / 101.0::DOUBLE AS s2 FROM near WHERE rank <= 30"),
    "rho": (["cand"], """SELECT query_id, CASE WHEN count(*) <= 3 THEN 0.0::DOUBLE WHEN max(s1) = min(s1) OR max(s2) = min(s2) THEN NULL
        ELSE covar_pop(s1, s2) / (stddev_pop(s1) * stddev_pop(s2)) END AS rho FROM cand GROUP BY query_id"""),
    "gate": (["cand", "rho"], """SELECT cand.*, rho, CASE WHEN rho < -0.2 THEN 'inverted' WHEN abs(rho) < 0.15 THEN 'rank_fusion' ELSE 'weighted' END AS branch FROM cand JOIN rho USING (query_id)"""),
    "zed": (["gate"], """SELECT query_id, id, rank1, s1, branch, t,
        CASE WHEN max(s1) OVER w - min(s1) OVER w < 1e-8 THEN 0 ELSE (s1 - min(s1) OVER w) / (max(s1) OVER w - min(s1) OVER w) END AS n1,
        CASE WHEN max(t) OVER w - min(t) OVER w < 1e-8 THEN 0 ELSE (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w) END AS n2,
        row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, rank1, id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, rank1, id) AS r2
        FROM (SELECT *, CASE WHEN branch = 'inverted' THEN -s2 ELSE s2 END AS t FROM gate) WINDOW w AS (PARTITION BY query_id)"""),
    "hyb": (["zed"], """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank1, id) AS rank, id, score, branch FROM (SELECT *,
        CASE branch WHEN 'rank_fusion' THEN 1 / (60 + r1)::DOUBLE + 1 / (60 + r2)::DOUBLE ELSE 0.6::DOUBLE * n1 + 0.4::DOUBLE * n2 END AS score FROM zed)"""),
    "isem": (["img"], """SELECT src, dst, s::FLOAT::DOUBLE AS w, s, r FROM (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.v, b.v), 12) AS s,
        row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.id) AS r FROM img a JOIN img b ON a.id <> b.id) WHERE r <= 8"""),
    "csem": (["cap"], """SELECT src, dst, s::FLOAT::DOUBLE AS w FROM (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.v, b.v), 12) AS s,
        row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.id) AS r FROM cap a JOIN cap b ON a.id <> b.id) WHERE r <= 4"""),
    "edges": (["isem", "csem", "cap"], """SELECT 'image' AS src_type, src, 'sem_sim' AS edge_type, 'image' AS dst_type, dst, w FROM isem UNION ALL SELECT 'caption', src, 'sem_sim', 'caption', dst, w FROM csem
        UNION ALL SELECT 'caption', id, 'paired_with', 'image', image, 1.0 FROM cap UNION ALL SELECT 'caption', a.id, 'cooccur', 'caption', b.id, 1.0 FROM cap a JOIN cap b ON a.image = b.image AND a.id <> b.id"""),
    "extra": (["near", "cnear", "cap"], """SELECT n.query_id, 'caption' AS node_type, c.id AS node_idx, max(n.score) AS score, 2 AS source FROM near n JOIN cap c ON c.image = n.id
        WHERE n.rank <= 5 AND NOT EXISTS (SELECT 1 FROM cnear k WHERE k.rank <= 5 AND k.query_id = n.query_id AND k.id = c.id) GROUP BY n.query_id, c.id"""),
    "seeds": (["near", "cnear", "extra"], """SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, node_idx) AS seed_rank, node_type, node_idx, score FROM (
        SELECT query_id, 'image' AS node_type, id AS node_idx, score, 0 AS source FROM near WHERE rank <= 5 UNION ALL SELECT query_id, 'caption', id, score, 1 FROM cnear WHERE rank <= 5 UNION ALL SELECT * FROM extra)) WHERE seed_rank <= 5"""),
    "gathered": (["seeds", "edges", "cap"], """SELECT query_id, seed_rank, 0 AS path, node_idx AS via, c.id AS caption FROM seeds s JOIN cap c ON s.node_type = 'image' AND c.image = s.node_idx
        UNION ALL SELECT query_id, seed_rank, 1, e.dst, c.id FROM seeds s JOIN edges e ON s.node_type = 'image' AND e.src_type = 'image' AND e.edge_type = 'sem_sim' AND e.src = s.node_idx JOIN cap c ON c.image = e.dst
        UNION ALL SELECT query_id, seed_rank, CASE e.edge_type WHEN 'sem_sim' THEN 2 ELSE 3 END, e.src, e.dst FROM seeds s JOIN edges e ON s.node_type = 'caption' AND e.src_type = 'caption' AND e.edge_type <> 'paired_with' AND e.src = s.node_idx
        UNION ALL SELECT query_id, seed_rank, 4, a.image, c.id FROM seeds s JOIN cap a ON s.node_type = 'caption' AND a.id = s.node_idx JOIN cap c ON c.image = a.image"""),
    "stream": (["gathered", "cap"], f"""SELECT query_id, unnest(tok) AS term, generate_subscripts(tok, 1) AS pos FROM (
        SELECT query_id, flatten(list(t ORDER BY seed_rank, path, via, caption)) AS tok FROM gathered JOIN (SELECT id, {TOKENS.format(t='text')} AS t FROM cap) c ON c.id = caption GROUP BY query_id)"""),
    "terms": (["stream"], """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, big, p, term) AS term_rank, term, n FROM (
        SELECT query_id, term, 0 AS big, count(*) AS n, min(pos) AS p FROM stream GROUP BY query_id, term UNION ALL
        SELECT query_id, term, 1, count(*), min(pos) FROM (SELECT query_id, term || ' ' || lead(term) OVER (PARTITION BY query_id ORDER BY pos) AS term, pos FROM stream) WHERE term IS NOT NULL GROUP BY query_id, term)"""),
    "typed": (["edges"], "SELECT src_type, src, dst_type, dst, w * CASE edge_type WHEN 'cooccur' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS w FROM edges"),
    "f0": (["seeds"], "SELECT query_id, node_type, node_idx, max(score) AS score, 0 AS hop FROM seeds GROUP BY 1, 2, 3"),
    "s1": (["f0", "typed"], "SELECT query_id, dst_type AS node_type, dst AS node_idx, max(score * 0.85::DOUBLE * w) AS score FROM f0 JOIN typed ON node_type = src_type AND node_idx = src GROUP BY 1, 2, 3 HAVING max(score * 0.85::DOUBLE * w) >= 1e-3"),
    "b1": (["s1", "f0"], """SELECT query_id, node_type, node_idx, score, 1 AS hop FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_type, node_idx) AS r FROM s1 ANTI JOIN f0 USING (query_id, node_type, node_idx)) WHERE r <= 20"""),
    "f1": (["f0", "s1", "b1"], """SELECT query_id, node_type, node_idx, max(score) AS score, min(hop) AS hop FROM (SELECT * FROM f0 UNION ALL SELECT s1.*, f0.hop FROM s1 JOIN f0 USING (query_id, node_type, node_idx) UNION ALL SELECT * FROM b1) GROUP BY 1, 2, 3"""),
    "s2": (["b1", "typed"], "SELECT query_id, dst_type AS node_type, dst AS node_idx, max(score * (0.85::DOUBLE * 0.85::DOUBLE) * w) AS score FROM b1 JOIN typed ON node_type = src_type AND node_idx = src GROUP BY 1, 2, 3 HAVING max(score * (0.85::DOUBLE * 0.85::DOUBLE) * w) >= 1e-3"),
    "b2": (["s2", "f1"], """SELECT query_id, node_type, node_idx, score, 2 AS hop FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_type, node_idx) AS r FROM s2 ANTI JOIN f1 USING (query_id, node_type, node_idx)) WHERE r <= 20"""),
    "f2": (["f1", "s2", "b2"], """SELECT query_id, node_type, node_idx, max(score) AS score, min(hop) AS hop FROM (SELECT * FROM f1 UNION ALL SELECT s2.*, f1.hop FROM s2 JOIN f1 USING (query_id, node_type, node_idx) UNION ALL SELECT * FROM b2) GROUP BY 1, 2, 3"""),
    "links": (["edges"], "SELECT DISTINCT src_type, src, dst_type, dst FROM edges WHERE edge_type <> 'cooccur'"),
    "out": (["links"], "SELECT *, count(*) OVER (PARTITION BY src_type, src) AS degree FROM links"),
    "p0": (["seeds"], "SELECT query_id, node_type, node_idx, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS score FROM (SELECT DISTINCT query_id, node_type, node_idx FROM seeds)"),
}
for _i in (1, 2, 3):
    CTES[f"p{_i}"] = (["p0", f"p{_i - 1}", "out"], f"""SELECT query_id, node_type, node_idx, sum(score) AS score FROM (SELECT query_id, dst_type AS node_type, dst AS node_idx, 0.85::DOUBLE * score / degree AS score FROM p{_i - 1} JOIN out ON node_type = src_type AND node_idx = src
        UNION ALL SELECT query_id, node_type, node_idx, 0.15::DOUBLE * score FROM p0) GROUP BY 1, 2, 3""")  # fmt: skip


def sql(select: str, *needs: str) -> str:
    """The statement with the CTEs it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" if order else "") + select


def _r(*columns: str) -> str:
    return ", ".join(f"round({c.split()[0]}, 6) AS {c.split()[-1]}" for c in columns)


def _metrics(ranks: str) -> str:
    hits = ", ".join(f"avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END) AS recall_at_{k}" for k in (1, 5, 10))
    return f"SELECT count(*) AS n, {hits}, avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr, avg(coalesce(1.0::DOUBLE / rank, 0)) AS map, avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS ndcg_at_10 FROM ({ranks})"


def _ranks(of: str) -> str:
    return f"SELECT q.query_id, n.rank FROM q LEFT JOIN (SELECT * FROM {of} WHERE rank <= 10) n ON n.query_id = q.query_id AND n.id = q.gt"


NAMES = ["recall_at_1", "recall_at_5", "recall_at_10", "mrr", "map", "ndcg_at_10"]
METRIC_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in NAMES)
OTHERS = "(SELECT id AS query_id, v FROM img)"
ORACLE_SQL: dict[str, str] = {
    "caption_counts": "SELECT count(DISTINCT source) AS n_images, count(*) AS n_captions FROM documents",
    "captions_of_image": "SELECT doc_id AS row_pos, text AS caption FROM documents WHERE source = 'src3'",
    "caption_regex_search": "SELECT doc_id AS row_pos, source AS image_name FROM documents WHERE regexp_matches(text, 'th[ae]r+e', 'i') ORDER BY doc_id LIMIT 50",
    "valid_captions": "SELECT doc_id AS row_pos FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND text <> 'nan'",
    "first_n_images": "SELECT source AS image_name, doc_id AS row_pos FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY min(doc_id) LIMIT 5)",
    "caption_key": "SELECT doc_id AS row_pos, source || '#' || doc_id AS caption_id FROM documents",
    "captions_by_image": "SELECT source AS image_name, string_agg(source || '#' || doc_id, ',' ORDER BY doc_id) AS caption_ids FROM documents GROUP BY source",
    "hash_sample": "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 20",
    "test_queries": "SELECT arg_min(text, doc_id) AS query, 'img' || (doc_id % (SELECT count(*) FROM embeddings)) AS ground_truth, count(*) - 1 AS n_alternatives FROM documents WHERE text IS NOT NULL GROUP BY ground_truth ORDER BY md5(ground_truth || '|2025'), ground_truth LIMIT 25",
    "systematic_sample": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) WHERE k % greatest(1, (SELECT count(*) FROM documents) // 10) = 0",
    "available_captions": "SELECT doc_id AS row_pos, source AS image_name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "caption_profile": r"""WITH c AS (SELECT source, length(text) AS ch, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS wd FROM documents), g AS (SELECT source, count(*) AS n FROM c GROUP BY source)
        SELECT (SELECT count(*) FROM g) AS n_images, count(*) AS n_captions, (SELECT round(avg(n), 6) FROM g) AS captions_per_image, (SELECT min(n) FROM g) AS min_captions, (SELECT max(n) FROM g) AS max_captions,
        round(avg(ch), 6) AS avg_chars, round(avg(wd), 6) AS avg_words, min(wd) AS min_words, max(wd) AS max_words FROM c""",
    "unique_images": "SELECT source AS image_name, min(doc_id) AS first_pos FROM documents GROUP BY source",
    "duplicate_ratio": "SELECT round(1 - count(DISTINCT text) / count(*)::DOUBLE, 6) AS duplicate_ratio FROM documents",
    "top_captions": "SELECT text AS caption, count(*) AS n FROM documents GROUP BY text ORDER BY n DESC, text LIMIT 10",
    "caption_histogram": "WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents) SELECT CASE WHEN hi = lo THEN 0 ELSE least(49, floor((n_chars - lo) / ((hi - lo) / 50)))::BIGINT END AS bin, count(*) AS n FROM documents, e GROUP BY bin",
    "latency_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "score_summary": "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(var_pop(value), 6) AS var, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type",
    "windowed_latencies": "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "l2_normalize": sql("SELECT id, round(u[1], 6) AS first, round(sqrt(list_dot_product(u, u)), 6) AS norm FROM (SELECT id, v AS u FROM img)", "img"),
    "unit_norm_check": sql("SELECT round(max(o), 6) AS max_off, round(avg(o), 6) AS mean_off, count(*) FILTER (o > 1e-4) AS n_off FROM (SELECT abs(sqrt(list_dot_product(v, v)) - 1) AS o FROM raw)", "raw"),
    "vector_checks": "SELECT count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings",
    "query_vectors": sql("SELECT query_id, gt, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM q", "q"),
    "knn_cosine_top10": sql("SELECT query_id, rank, id, round(score, 6) AS score FROM near WHERE rank <= 10", "near"),
    "knn_cosine_top10_sql": sql("SELECT query_id, rank, id, round(score, 6) AS score FROM near WHERE rank <= 10", "near"),
    "knn_euclidean_top10": sql("SELECT query_id, rank, id, round(s, 6) AS score FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s, id) AS rank FROM (SELECT q.query_id, raw.id, round(list_distance(q.v, raw.v) ** 2, 12) AS s FROM q CROSS JOIN raw)) WHERE rank <= 10", "q", "raw"),
    "ivf_probe_topk": sql(f"""SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs JOIN img USING (id) JOIN (
        SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q.v, c.v), 12) DESC, label) AS r FROM q CROSS JOIN (SELECT label, {UNIT.format(v='v')} AS v FROM (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM raw) GROUP BY label, pos) GROUP BY label)) c
        ) p USING (query_id, label) WHERE r <= 2) WHERE rank <= 10""", "pairs"),
    "semantic_edges": sql("SELECT src, dst, r AS rank, round(w, 6) AS weight FROM isem", "isem"),
    "stage1_retrieve": sql("SELECT query_id, id, rank AS rank1, round(score, 6) AS s1 FROM near WHERE rank <= 30", "near"),
    "jaccard_rerank": sql(f"""SELECT query_id, n.id, rank AS rank1, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE END, 6) AS s2 FROM cnear n
        JOIN (SELECT query_id, {TOKENS.format(t='text')} AS a FROM q) USING (query_id) JOIN (SELECT id, {TOKENS.format(t='text')} AS b FROM cap) c ON c.id = n.id WHERE rank <= 20""", "cnear", "q", "cap"),
    "yesno_probability": "SELECT event_id, round((exp(a) + exp(b)) / (exp(a) + exp(b) + exp(c) + exp(0.5)), 6) AS p FROM (SELECT event_id, value / 50 - t AS a, (event_id % 7) / 3.0::DOUBLE - t AS b, value / 40 - t AS c, t FROM (SELECT *, greatest(value / 50, (event_id % 7) / 3.0::DOUBLE, value / 40, 0.5) AS t FROM events)) WHERE false",
    "prompts": "SELECT item_id, 'Question: Does this image show ' || lower(text) || '? Answer:' AS prompt FROM benchmark",
    "names_and_numbers": "SELECT p_partkey, replace(p_brand || '/' || p_type, '/', '-') AS name, format('{:,}', p_partkey * 1000) AS shown FROM part",
    "minmax_norm": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN max(l_extendedprice) OVER w - min(l_extendedprice) OVER w < 1e-8 THEN 0 ELSE (l_extendedprice - min(l_extendedprice) OVER w) / (max(l_extendedprice) OVER w - min(l_extendedprice) OVER w) END, 6) AS z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)",
    "agreement_corr": sql("SELECT query_id, round(rho, 6) AS rho FROM rho", "rho"),
    "hybrid_search": sql("SELECT query_id, rank, id, round(score, 6) AS score, branch FROM hyb WHERE rank <= 10", "hyb"),
    "hybrid_gate_branches": sql("SELECT branch, count(DISTINCT query_id) AS n FROM hyb GROUP BY branch", "hyb"),
    "ordinal_and_dense_rank": "SELECT o_orderkey, o_orderstatus, floor(o_totalprice / 1000)::BIGINT AS price, row_number() OVER (PARTITION BY o_orderstatus ORDER BY floor(o_totalprice / 1000) DESC, o_orderkey) AS ordinal, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY floor(o_totalprice / 1000) DESC) AS dense FROM orders",
    "text_to_image": sql("SELECT query_id, rank, id, round(score, 6) AS score FROM near WHERE rank <= 5", "near"),
    "image_to_text": sql(f"SELECT query_id, rank, id, text, round(score, 6) AS score FROM (SELECT query_id, id, text, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT query_id, cap.id, text, round(list_dot_product(o.v, cap.v), 12) AS s FROM {OTHERS} o CROSS JOIN cap)) WHERE rank <= 3", "img", "cap"),
    "image_to_image": sql(f"SELECT query_id, rank, id, round(s, 6) AS score FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT query_id, img.id, round(list_dot_product(o.v, img.v), 12) AS s FROM {OTHERS} o JOIN img ON img.id <> query_id)) WHERE rank <= 5", "img"),
    "image_to_image_hybrid": sql(f"SELECT query_id, rank, id, round(s, 6) AS score FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT query_id, img.id, round(list_dot_product(o.v, img.v), 12) AS s FROM {OTHERS} o CROSS JOIN img)) WHERE rank <= 10", "img"),
    "node_index": "SELECT source AS ext_id, row_number() OVER (ORDER BY min(doc_id), source) - 1 AS node_idx FROM documents GROUP BY source",
    "paired_edges": sql("SELECT id AS src, image AS dst FROM cap", "cap"),
    "unpaired_captions": sql("SELECT c.id AS node_idx FROM cap c JOIN img ON img.id = c.image WHERE label = 1", "cap", "img"),
    "cooccur_edges": sql("SELECT a.id AS src, b.id AS dst FROM cap a JOIN cap b ON a.image = b.image AND a.id <> b.id", "cap"),
    "graph_edge_counts": sql("SELECT src_type, edge_type, dst_type, count(*) AS n_edges FROM edges GROUP BY 1, 2, 3", "edges"),
    "graph_validation": "SELECT unnest(['dimension', 'not_finite', 'not_dense', 'loop', 'null_weight', 'src_without_node', 'dst_without_node']) AS \"check\", 0::BIGINT AS violations",
    "out_degree": sql("SELECT e.src_type AS node_type, edge_type, max(k) AS max_degree, round(sum(k)::BIGINT / any_value(n)::DOUBLE, 6) AS mean_degree FROM (SELECT src_type, edge_type, src, count(*) AS k FROM edges GROUP BY 1, 2, 3) e JOIN (SELECT 'image' AS t, count(*) AS n FROM embeddings UNION ALL SELECT 'caption', count(*) FROM documents) ON t = e.src_type GROUP BY 1, 2", "edges"),
    "cross_type_links": sql("SELECT query_id, rank, id, round(s, 6) AS score FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT cap.id AS query_id, img.id, round(list_dot_product(cap.v, img.v), 12) AS s FROM cap CROSS JOIN img)) WHERE rank <= 2", "cap", "img"),
    "seed_nodes": sql("SELECT query_id, seed_rank, node_type, node_idx, round(score, 6) AS score FROM seeds", "seeds"),
    "token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS.format(t='text')}) AS token FROM documents) GROUP BY token",
    "neighbour_captions": sql("SELECT query_id, seed_rank, path::BIGINT AS path, via, caption FROM gathered", "gathered"),
    "bigram_top_terms": sql("SELECT query_id, term_rank, term, n FROM terms WHERE term_rank <= 5", "terms"),
    "enrich_query": sql("SELECT query_id, CASE WHEN t IS NULL THEN text ELSE text || '; ' || t END AS enriched FROM q LEFT JOIN (SELECT query_id, string_agg(term, '; ' ORDER BY term_rank) AS t FROM terms WHERE term_rank <= 5 GROUP BY query_id) USING (query_id)", "terms", "q"),
    "tfidf_terms": f"""WITH t AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOKENS.format(t='text')}) AS term FROM documents) GROUP BY id, term), s AS (SELECT id, t.term, tf * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) AS x FROM t JOIN (SELECT term, count(*) AS df FROM t GROUP BY term) d ON d.term = t.term)
        SELECT id, term, round(x, 6) AS tfidf, r AS term_rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(x, 9) DESC, term) AS r FROM s) WHERE r <= 3""",
    "truth_rank": sql(_ranks("near"), "near", "q"),
    "eval_metrics": sql(f"SELECT n, {METRIC_ROUND} FROM ({_metrics(_ranks('near'))})", "near", "q"),
    "method_compare": sql("SELECT metric, round(a, 6) AS base, round(b, 6) AS other, round(b - a, 6) AS delta, round(CASE WHEN a = 0 THEN NULL ELSE (b - a) * 100 / a END, 6) AS percent FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, x.{m} AS a, y.{m} AS b FROM ({_metrics(_ranks('near'))}) x, ({_metrics(_ranks('hyb'))}) y" for m in NAMES) + ")", "near", "hyb", "q"),
    "settings": "SELECT k1, k2 FROM (SELECT unnest([20, 50, 100])::BIGINT AS k1), (SELECT unnest([5, 10, 50])::BIGINT AS k2) WHERE k1 >= k2",
    "closest_setting": "SELECT event_type FROM (SELECT event_type, avg(value) AS ms FROM events GROUP BY event_type) ORDER BY abs(ms - 50), event_type LIMIT 1",
    "beam_expand": sql("SELECT query_id, node_type, node_idx, round(score, 6) AS score, hop::BIGINT AS hop FROM f2", "f2"),
    "candidate_images": sql("SELECT query_id, node_idx AS id, round(score, 6) AS score FROM f2 WHERE node_type = 'image'", "f2"),
    "kg_min_hops": sql("SELECT query_id, node_type, node_idx, round(1.0::DOUBLE / (1 + hop), 6) AS kg FROM f2", "f2"),
    "kg_ppr": sql("SELECT query_id, node_type, node_idx, round(ln(score), 6) AS log_score FROM p3", "p3"),
    "context_payload": sql("""SELECT query_id, coalesce(string_agg(CASE WHEN node_type = 'caption' THEN substring(text, 1, 120) END, '|' ORDER BY r), '') AS texts, coalesce(string_agg(CASE WHEN node_type = 'image' THEN node_idx::VARCHAR END, ',' ORDER BY r), '') AS image_ids, coalesce(string_agg(CASE WHEN node_type = 'caption' THEN node_idx::VARCHAR END, ',' ORDER BY r), '') AS caption_ids
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node_type ORDER BY score DESC, node_idx) AS r FROM f2) f LEFT JOIN cap c ON f.node_type = 'caption' AND c.id = f.node_idx WHERE r <= CASE node_type WHEN 'caption' THEN 5 ELSE 4 END GROUP BY query_id""", "f2", "cap"),
}
ORACLE_SQL["yesno_probability"] = "SELECT event_id, round((exp(a - t) + exp(b - t)) / (exp(a - t) + exp(b - t) + exp(c - t) + exp(0.5 - t)), 6) AS p FROM (SELECT *, greatest(a, b, c, 0.5) AS t FROM (SELECT event_id, value / 50 AS a, (event_id % 7) / 3.0::DOUBLE AS b, value / 40 AS c FROM events))"
for _name, _score in {"fusion_weighted": "0.6::DOUBLE * n1 + 0.4::DOUBLE * n2", "fusion_rrf": "1 / (60 + r1)::DOUBLE + 1 / (60 + r2)::DOUBLE", "fusion_replace": "s2"}.items():
    ORACLE_SQL[_name] = sql(f"""SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank1, id) AS rank FROM (SELECT *, {_score} AS score FROM (SELECT *,
        (s1 - min(s1) OVER w) / (max(s1) OVER w - min(s1) OVER w) AS n1, (s2 - min(s2) OVER w) / (max(s2) OVER w - min(s2) OVER w) AS n2,
        row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, rank1, id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, rank1, id) AS r2 FROM cand WINDOW w AS (PARTITION BY query_id)))) WHERE rank <= 10""", "cand")  # fmt: skip
_SOME = CTES["cand"][1] + " AND id % 3 = 0"
ORACLE_SQL["hybrid_with_missing"] = ORACLE_SQL["hybrid_search"].replace(CTES["cand"][1], _SOME)
ORACLE_SQL["kg_fusion"] = sql("""SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank1, id) AS rank FROM (SELECT *, CASE WHEN abs(rho) < 0.15 THEN
    1 / (60 + r1)::DOUBLE + CASE WHEN t IS NULL THEN 0 ELSE 1 / (60 + r2)::DOUBLE END + CASE WHEN kg IS NULL THEN 0 ELSE 1 / (60 + r3)::DOUBLE END ELSE 0.7::DOUBLE * n1 + 0.2::DOUBLE * coalesce(n2, 0) + 0.1::DOUBLE * coalesce(n3, 0) END AS score FROM (SELECT *,
    (s1 - min(s1) OVER w) / (max(s1) OVER w - min(s1) OVER w) AS n1, (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w) AS n2,
    CASE WHEN max(kg) OVER w - min(kg) OVER w < 1e-8 THEN 0 ELSE (kg - min(kg) OVER w) / (max(kg) OVER w - min(kg) OVER w) END AS n3,
    row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC NULLS LAST, rank1, id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY t DESC NULLS LAST, rank1, id) AS r2, row_number() OVER (PARTITION BY query_id ORDER BY kg DESC NULLS LAST, rank1, id) AS r3
    FROM (SELECT c.*, rho, CASE WHEN abs(rho) < 0.05 THEN NULL ELSE s2 END AS t, 1.0::DOUBLE / (1 + f.hop) AS kg FROM cand c JOIN rho USING (query_id) LEFT JOIN f2 f ON f.query_id = c.query_id AND f.node_type = 'image' AND f.node_idx = c.id) WINDOW w AS (PARTITION BY query_id)))) WHERE rank <= 10""", "cand", "rho", "f2")  # fmt: skip
ORACLE_SQL |= {
    "load_captions": "SELECT p_brand AS image_name, p_partkey::VARCHAR AS comment_number, trim(p_name) AS caption FROM part",
    "load_captions_counts": "SELECT count(DISTINCT p_brand) AS n_images, count(*) AS n_captions FROM part",
    "embeddings_store": sql("SELECT id, round(list_sum(v), 6) AS total, 'given' AS model FROM raw", "raw"),
    "index_store": ORACLE_SQL["ivf_probe_topk"],
    "index_stats": "SELECT 2 * count(*) AS n_vectors, 64::BIGINT AS dimension, 'flat' AS index_type, 'cosine' AS metric FROM embeddings",
    "index_add_keeps_ids": sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score FROM near WHERE rank <= 4 UNION ALL SELECT query_id, id + 1000000, score FROM near WHERE rank <= 4) QUALIFY rank <= 4", "near"),
    "ivf_trained_recall": "SELECT 10 * count(*) AS n, true AS enough FROM benchmark",
    "lsh_recall": "SELECT 10 * count(*) AS n, true AS enough FROM benchmark",
    "search_without_index": ORACLE_SQL["knn_cosine_top10"],
    "graph_store": sql("SELECT src_type || '-' || edge_type AS kind, count(*) AS n, 0::BIGINT AS n_texts FROM edges GROUP BY 1 UNION ALL SELECT 'image', count(*), 0 FROM img UNION ALL SELECT 'caption', count(*), count(text) FROM cap", "edges", "img"),
    "graph_pipeline": sql("""SELECT 'caption' AS src_type, 'paired_with' AS edge_type, 'image' AS dst_type, count(*) AS n_edges FROM cap UNION ALL
        SELECT 'caption', 'cooccur', 'caption', count(*) FROM cap a JOIN cap b ON a.image = b.image AND a.id <> b.id HAVING count(*) > 0 UNION ALL
        SELECT 'image', 'sem_sim', 'image', least(8, count(DISTINCT image) - 1) * count(DISTINCT image) FROM cap UNION ALL SELECT 'caption', 'sem_sim', 'caption', least(8, count(*) - 1) * count(*) FROM cap""", "cap"),
    "results_store": sql(f"SELECT n, round(recall_at_10, 6) AS recall_at_10, round(mrr, 6) AS mrr FROM ({_metrics(_ranks('near'))})", "near", "q"),
    "node_json": "SELECT vec_id AS node_idx, vec_id::VARCHAR AS ext_id, 'image' AS node_type FROM embeddings",
    "aligned_vectors": sql("SELECT id, round(v[1]::FLOAT::DOUBLE, 6) AS first, round(sqrt(list_dot_product(f, f)), 6) AS norm FROM (SELECT *, v::FLOAT[]::DOUBLE[] AS f FROM img)", "img"),
    "encode_given_vectors": sql("SELECT id, round(v[2]::FLOAT::DOUBLE, 6) AS second, round(sqrt(list_dot_product(f, f)), 6) AS norm FROM (SELECT *, v::FLOAT[]::DOUBLE[] AS f FROM img)", "img"),
    "fusion_lower_is_better": ORACLE_SQL["hybrid_search"].replace("/ 101.0::DOUBLE AS s2", "/ -101.0::DOUBLE AS s2"),
    "fusion_constant_scores": sql("SELECT query_id, rank, id, round(0.6::DOUBLE * (score - lo) / (hi - lo), 6) AS score, 'weighted' AS branch FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM near WHERE rank <= 30 WINDOW w AS (PARTITION BY query_id)) WHERE rank <= 10", "near"),
    "yesno_missing": "SELECT event_id, CASE WHEN event_type <> 'click' THEN round(1 / (1 + exp(0.5 - value / 50)), 6) END AS p FROM events",
    "hit_rates": "SELECT event_type, count(*) AS n, count(*) FILTER (value < 20) AS hits, round(count(*) FILTER (value < 20) / count(*)::DOUBLE, 6) AS hit_rate FROM events GROUP BY event_type",
    "edges_summary": sql("""SELECT query_id, string_agg(edge_type || '=' || n, ',' ORDER BY edge_type) AS edges_summary FROM (SELECT a.query_id, e.edge_type, count(*) AS n FROM edges e
        JOIN f2 a ON a.node_type = e.src_type AND a.node_idx = e.src JOIN f2 b ON b.node_type = e.dst_type AND b.node_idx = e.dst AND b.query_id = a.query_id GROUP BY 1, 2) GROUP BY query_id""", "f2", "edges"),
    "ablation_grid": "SELECT beam, hops, k_seed, decay, kg_weight FROM (SELECT unnest([10, 20])::BIGINT AS beam), (SELECT unnest([1, 2])::BIGINT AS hops), (SELECT unnest([5, 10, 15])::BIGINT AS k_seed), (SELECT unnest([0.8, 0.85, 0.9])::DOUBLE AS decay), (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS kg_weight)",
}
# the gate over captions with the overlap of tokens as the second score
_OVERLAP = f"""SELECT query_id, n.id, rank AS rank1, score AS s1, CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE END AS s2 FROM cnear n
    JOIN (SELECT query_id, {TOKENS.format(t='text')} AS a FROM q) USING (query_id) JOIN (SELECT id, {TOKENS.format(t='text')} AS b FROM cap) c ON c.id = n.id WHERE rank <= 30"""
_with_captions = sql("", "cnear", "q").rstrip()
ORACLE_SQL["hybrid_captions_jaccard"] = _with_captions + ",\n" + ",\n".join(f"{n} AS ({_OVERLAP if n == 'cand' else CTES[n][1]})" for n in ("cand", "rho", "gate", "zed", "hyb")) + "\nSELECT query_id, rank, id, round(score, 6) AS score, branch FROM hyb WHERE rank <= 10"
_kg = ORACLE_SQL["kg_fusion"].replace("round(score, 6) AS score", "score")
ORACLE_SQL["graph_mode_metrics"] = f"SELECT n, {METRIC_ROUND} FROM ({_metrics('SELECT q.query_id, n.rank FROM q LEFT JOIN kgf n ON n.query_id = q.query_id AND n.id = q.gt')})"
_head, _, _tail = _kg.rpartition("\nSELECT query_id, rank, id,")
ORACLE_SQL["graph_mode_metrics"] = _head + ",\nkgf AS (SELECT query_id, rank, id," + _tail + ")\n" + ORACLE_SQL["graph_mode_metrics"]
# greedy picks, one after another
_steps = ["m0 AS (SELECT near.query_id, near.id, score, img.v FROM near JOIN img USING (id) WHERE rank <= 30)", "k1 AS (SELECT query_id, id, v, 0.7::DOUBLE * score AS value, 1 AS rank FROM m0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 0.7::DOUBLE * score DESC, score DESC, id) = 1)"]
for _i in range(2, 6):
    _held = " UNION ALL ".join(f"SELECT * FROM k{_j}" for _j in range(1, _i))
    _steps.append(f"""k{_i} AS (SELECT query_id, id, v, value, {_i} AS rank FROM (SELECT m.query_id, m.id, any_value(m.v) AS v, any_value(m.score) AS score, 0.7::DOUBLE * any_value(m.score) - 0.3::DOUBLE * max(list_dot_product(m.v, h.v)) AS value
        FROM m0 m JOIN ({_held}) h USING (query_id) WHERE (m.query_id, m.id) NOT IN (SELECT (query_id, id) FROM ({_held})) GROUP BY m.query_id, m.id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, score DESC, id) = 1)""")
ORACLE_SQL["mmr_top5"] = sql("", "near", "img").rstrip() + ",\n" + ",\n".join(_steps) + "\nSELECT query_id, rank::BIGINT AS rank, id, round(value, 6) AS mmr FROM (" + " UNION ALL ".join(f"SELECT * FROM k{_j}" for _j in range(1, 6)) + ")"
