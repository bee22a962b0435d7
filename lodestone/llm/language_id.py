"""Language identification by hierarchical discrimination.

One-versus-one linear support vector machines pick the language family first, then the language within that family.
Features are hashed byte 1- to 3-grams of the whole text: square roots of counts, of unit length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .bpe import release
from .samples import fold
from .shared import table

#: Language families by ISO 639-1 code. Any other language is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
}
DIM = 4096


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def _letters() -> np.ndarray:
    """Lower case for A-Z; all that is no letter in ASCII becomes a space."""
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        out[b] = ord(chr(b).lower()) if chr(b).isalpha() else 32
    return out


LOWER = _letters()


def features(text: str, chunk: int = 1 << 20) -> np.ndarray:
    """Of a whole text, ``chunk`` bytes at a time."""
    b = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))] if len(b) else b
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(b), chunk):
        u = b[at : at + chunk + 2].astype(np.uint32)  # a gram belongs to the chunk it starts in
        n = min(chunk, len(b) - at)
        grams = [u[:n], (u[:-1] * 256 + u[1:] + 65536)[:n], (u[:-2] * 65536 + u[1:-1] * 256 + u[2:] + (1 << 25))[:n]]
        counts += np.bincount((np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    x = np.sqrt(counts)
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 50.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear machine with squared hinge loss, by accelerated gradient steps; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    each = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step, t = np.float32(1 / (1 + 2 * c * 2)), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v)).astype(np.float32)
        g = v - 2 * np.float32(c) * (x.T @ (each * slack * y.astype(np.float32)))
        new = v - step * g
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, v, t = new, new + np.float32((t - 1) / t2) * (new - w), t2
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """weights: a column per machine. votes: for each machine its two sides, families first."""

    families: dict[str, list[str]]
    weights: np.ndarray
    intercepts: np.ndarray
    machines: list[tuple[str, str, str]]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text):
            return "und", 0.0
        margin = dict(zip(self.machines, (features(text) @ self.weights + self.intercepts).tolist(), strict=True))
        kin, p = self._pick("", list(self.families), margin)
        lang, q = self._pick(kin, self.families[kin], margin)
        return lang, p * q

    @staticmethod
    def _pick(level: str, sides: list[str], margin: dict) -> tuple[str, float]:
        """The side that wins most machines, ties by the sum of margins, and how sure its closest win is."""
        won = {s: [0, 0.0, 1.0] for s in sides}
        for a, b in combinations(sides, 2):
            m = margin[(level, a, b)]
            for s, v in ((a, m), (b, -m)):
                p = 1 / (1 + np.exp(-np.clip(3 * v, -30, 30)))
                won[s] = [won[s][0] + (v > 0), won[s][1] + v, min(won[s][2], float(p))]
        best = max(sides, key=lambda s: (won[s][0], won[s][1]))
        return best, won[best][2]


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """From rows of features and their languages."""
    y = np.array(langs)
    kin: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        kin.setdefault(family(lang), []).append(lang)
    machines, ws, bs = [], [], []
    levels = [("", {f: members for f, members in kin.items()}), *((f, {m: [m] for m in members}) for f, members in kin.items())]
    for level, sides in levels:
        for a, b in combinations(sides, 2):
            pos, neg = np.isin(y, sides[a]), np.isin(y, sides[b])
            rows = pos | neg
            w, i = train_svm(x[rows], np.where(pos[rows], 1.0, -1.0))
            machines.append((level, a, b)), ws.append(w), bs.append(i)
    return Model(kin, np.array(ws, np.float32).reshape(-1, DIM).T, np.array(bs), machines)


def train(docs: DataFrame, folds: int = 5, held: int = 0, per_lang: int = 1000, most: int = 20_000) -> Model | None:
    """Learn every language from text and lang of rows outside the held-out fold, of texts with a letter. None if there is no such row.

    The sample is bounded: at most ``per_lang`` rows for each language, those of the least hashes of id and text, and fewer (50 at least) where there are so
    many languages that these would be over ``most`` in all. Texts of any length count, as wholes; their features are worked out on the executors. Rows with a null
    id are in no fold and aren't learned from; rows that repeat an id count each by itself; an empty table gives None.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id").cast("long"), folds) != held))
    sizes = rows.groupBy("lang").count().collect()  # a row per language
    each = max(50, min(per_lang, most // max(len(sizes), 1)))
    steps, below = 1 << 30, F.lit(0)
    for r in sizes:
        below = F.when(F.col("lang") == r[0], int(min(1.0, (1.2 * each + 200) / r[1]) * steps)).otherwise(below)
    near = rows.withColumn("h", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(steps))).where(F.col("h") < below).select("lang", "h", "text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t) if has_letter(t) else None for t in batch.column(2).to_pylist()]
            keep = pa.array([x is not None for x in got], pa.bool_())
            at = [np.flatnonzero(x) for x in got if x is not None]
            values = [x[i] for x, i in zip((x for x in got if x is not None), at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([i.astype(np.int16) for i in at], pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))], ["lang", "h", "at", "value"])

    order = Window.partitionBy("lang").orderBy("h", "at", "value")
    ranked = near.mapInArrow(weigh, "lang string, h long, at array<smallint>, value array<float>").withColumn("k", F.row_number().over(order))
    got = ranked.where(F.col("k") <= each).drop("k").toArrow()  # at most ``each`` rows a language, of some kilobytes
    if not len(got):
        return None
    langs = got.column("lang").to_pylist()
    x = np.zeros((len(got), DIM), np.float32)
    for i, (at, value) in enumerate(zip(got.column("at"), got.column("value"), strict=True)):
        x[i, at.values.to_numpy()] = value.values.to_numpy()
    first = np.lexsort((got.column("h").to_numpy(), np.array(langs)))
    return fit(x[first], [langs[i] for i in first])


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(t) and has_letter(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred and score. A text that is null or has no letter gets ``und`` and 0; so do all texts without a model. Null and
    repeated ids don't matter."""
    ship(docs.sparkSession)
    own = docs.select(*keep, *([] if "text" in keep else ["text"]))
    at = own.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            got = [model.predict(t) if model else ("und", 0.0) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])
    return own.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
