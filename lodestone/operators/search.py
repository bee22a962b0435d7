"""Two-stage search: encode, nearest neighbours, rerank, fuse. A single query is a table of one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokens
from ..functions.vectors import aligned
from ..session import ship
from .fusion import FusionConfig, fuse
from ..sources.scratch import among, keep
from .knn import knn_join

#: (query_id, id, ...) pairs to the same rows with a column s2; null where a pair can't be scored.
Scorer = Callable[[DataFrame], DataFrame]


class Encoder(Protocol):
    """What turns texts or image bytes into vectors. One is made on each worker."""

    dim: int

    def encode(self, items: list) -> list[list[float]]: ...


class PairModel(Protocol):
    """What scores pairs of a text and an image (bytes), between 0 and 1. One is made on each worker."""

    higher_is_better: bool

    def score(self, texts: list, images: list) -> list[float]: ...


#: Texts and images that a model takes at once.
TEXT_BATCH, IMAGE_BATCH, LEAST_BATCH = 64, 32, 1


def model_info(model: Encoder | PairModel) -> dict:
    """Name, dimension and orientation of a model, as far as it has them."""
    return {"model_type": type(model).__name__} | {k: getattr(model, k) for k in ("dim", "higher_is_better") if hasattr(model, k)}


def in_batches(run: Callable[[list], list], items: list, size: int, least: int = LEAST_BATCH) -> list:
    """The model's answers for all items. Where memory doesn't suffice for a batch its size is halved, down to ``least``."""
    out: list = []
    while len(out) < len(items):
        try:
            out += run(items[len(out) : len(out) + size])
        except MemoryError:
            if size <= least:
                raise
            size = max(least, size // 2)
    return out


class HashEncoder:
    """A stand-in without a model: signed counts of hashed tokens."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, items: list) -> list[list[float]]:
        import zlib

        out = []
        for x in items:
            v = [0.0] * self.dim
            for t in (x if isinstance(x, str) else x.hex() if x else "").lower().split():
                h = zlib.crc32(t.encode())
                v[h % self.dim] += 1.0 if h >> 16 & 1 else -1.0
            out.append(v)
        return out


def encode(df: DataFrame, column: str, make: Callable[[], Encoder], batch: int = TEXT_BATCH) -> DataFrame:
    """Adds a column embedding of unit vectors (a zero vector stays zero) of texts or image bytes."""
    import numpy as np

    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            got = in_batches(model.encode, list(s), batch)
            yield pd.Series([np.asarray(v, np.float64) / max(float(np.linalg.norm(v)), 1e-12) for v in got], dtype=object)

    return df.withColumn("embedding", run(F.col(column)))


def encode_query(df: DataFrame, mode: str, dim: int, make: Callable[[], Encoder] | None = None, column: str = "query") -> DataFrame:
    """Adds the unit vector (column embedding) of a text, an image's bytes or a given vector. Raises ValueError for another mode or no encoder, and when run
    for a vector of another dimension or with a value that isn't finite."""
    if mode not in ("text", "image", "vector"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "vector":
        return aligned(df.withColumn("embedding", F.col(column)), dim)
    if make is None:
        raise ValueError(f"mode {mode} needs an encoder")
    return aligned(encode(df, column, make, TEXT_BATCH if mode == "text" else IMAGE_BATCH), dim)


PAIR_TYPES = ("text", "image")


def pair_scorer(queries: DataFrame, corpus: DataFrame, make: Callable[[], PairModel], query_type: str = "text", candidate_type: str = "image", batch: int = 8) -> Scorer:
    """A scorer by a model of text and image pairs; queries (query_id, content), corpus (id, content). An image asking for texts is the swapped pair. A pair that the
    model fails on gets null, no constant. Raises NotImplementedError for pairs of one kind, ValueError for an unknown kind."""
    if query_type not in PAIR_TYPES or candidate_type not in PAIR_TYPES:
        raise ValueError(f"unknown pair {query_type} / {candidate_type}")
    if query_type == candidate_type:
        raise NotImplementedError(f"no model for {query_type} and {candidate_type}")

    def score(pairs: DataFrame) -> DataFrame:
        ship(pairs.sparkSession)

        @F.pandas_udf("double")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = make()
            for a, b in parts:
                texts, images = (a, b) if query_type == "text" else (b, a)
                yield pd.Series(in_batches(lambda some: _scores(model, some), list(zip(texts, images, strict=True)), batch), dtype="float64")

        q, c = queries.select("query_id", F.col("content").alias("_q")), corpus.select("id", F.col("content").alias("_c"))
        return pairs.join(q, "query_id", "left").join(c, "id", "left").withColumn("s2", run("_q", "_c")).drop("_q", "_c")

    return score


def _scores(model: PairModel, pairs: list[tuple]) -> list[float | None]:
    """Scores of pairs; null where one has no content or the model fails. Memory errors are the caller's."""
    try:
        whole = all(x is not None and y is not None for x, y in pairs)
        got = model.score(*map(list, zip(*pairs, strict=True))) if whole else None
        if got is not None and len(got) == len(pairs):
            return [float(x) for x in got]
    except MemoryError:
        raise
    except Exception:
        pass
    if len(pairs) > 1:  # find the pairs that fail
        return [x for p in pairs for x in _scores(model, [p])]
    return [None] * len(pairs)


def jaccard_scorer(queries: DataFrame, corpus: DataFrame) -> Scorer:
    """Token overlap of the query's text and the candidate's; queries (query_id, text), corpus (id, text). The pairs are written to the shared folder: only the
    texts in them are cut into tokens, and a few of them go to where the texts are."""

    def score(pairs: DataFrame) -> DataFrame:
        pairs = keep(pairs, "pairs")
        q = queries.select("query_id", tokens(F.col("text")).alias("_q"))
        c = among(corpus, pairs, "id").select("id", tokens(F.col("text")).alias("_c"))
        return pairs.join(q, "query_id", "left").join(c, "id", "left").withColumn("s2", jaccard(F.col("_q"), F.col("_c"))).drop("_q", "_c")

    return score


def stage1(queries: DataFrame, corpus: DataFrame, k1: int) -> DataFrame:
    """(query_id, id, rank1, s1)."""
    return knn_join(queries, corpus, k1).select("query_id", "id", F.col("rank").alias("rank1"), F.col("score").alias("s1"))


def hybrid_search(queries: DataFrame, corpus: DataFrame, scorer: Scorer, k1: int = 50, k2: int = 10, config: FusionConfig = FusionConfig(), available: DataFrame | None = None) -> DataFrame:
    """The best k2 of the k1 nearest rows after reranking. Candidates that aren't in ``available`` (id) are left out of stage 2; a query that has none there keeps its stage-1 order."""
    near = keep(stage1(queries, corpus, k1), "near")
    pairs = near if available is None else near.join(available.select("id"), "id", "left_semi")
    scored = scorer(pairs.select("query_id", "id")).select("query_id", "id", "s2")
    return fuse(near.join(scored, ["query_id", "id"], "left"), k2, config)


def text_to_image(queries: DataFrame, images: DataFrame, k: int = 10) -> DataFrame:
    return knn_join(queries, images, k)


def image_to_text(queries: DataFrame, captions: DataFrame, k: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """With the captions' texts, joined by caption id; ``texts`` (id, text) if captions have none."""
    return knn_join(queries, captions, k).join((captions if texts is None else texts).select("id", "text"), "id", "left").select("query_id", "rank", "id", "text", "score")


def image_to_image(queries: DataFrame, images: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
    return knn_join(queries, images, k, exclude_self=exclude_self)


def image_to_image_hybrid(queries: DataFrame, images: DataFrame, k1: int = 50, k2: int = 10) -> DataFrame:
    """Images have no reranker: the first k2 of stage 1."""
    return image_to_image(queries, images, k1).where(F.col("rank") <= k2)


def batch_search(queries: DataFrame, corpus: DataFrame, search_type: str, k: int = 10) -> DataFrame:
    kinds = {"text_to_image": text_to_image, "image_to_text": image_to_text, "image_to_image": image_to_image}
    if search_type not in kinds:
        raise ValueError(f"unknown search type {search_type}")
    return kinds[search_type](queries, corpus, k)


def mmr(candidates: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over (query_id, id, score, embedding): k picks by trade * score - (1 - trade) * nearest pick. A query's candidates are few (k1)."""
    import numpy as np

    ship(candidates.sparkSession)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        x = np.array(rows.embedding.tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near, left, out = np.zeros(len(rows)), list(range(len(rows))), []
        while left and len(out) < k:
            value = [trade * rows.score[i] - (1 - trade) * (near[i] if out else 0) for i in left]
            best = left[int(np.argmax(value))]
            out.append((rows.query_id[best], len(out) + 1, rows.id[best], max(value)))
            left.remove(best)
            near = np.maximum(near, x @ x[best]) if len(out) > 1 else x @ x[best]
        return pd.DataFrame(out, columns=["query_id", "rank", "id", "mmr"])

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, rank int, id long, mmr double")
