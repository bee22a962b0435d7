"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Trees are complete to a fixed depth and lie in flat arrays (feature, threshold, leaf value), which numpy walks for all
rows and trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .samples import fold, sample_ids
from .shared import table

GROUPS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" ",
    "break": b"\n\r",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "pipe": b"|",
    "symbol": b"#$%&*@^~+=<>\\/_`",
    "bracket": b"()[]{}\"'",
    "high": bytes(range(128, 256)),
}


def _group_matrix() -> np.ndarray:
    out = np.zeros((256, len(GROUPS)))
    for k, members in enumerate(GROUPS.values()):
        out[list(members), k] = 1
    return out


GROUP_OF = _group_matrix()
NAMES = [*GROUPS, "bytes", "words", "word_size", "word_spread", "distinct", "top_word", "short_words", "long_words", "capital", "lines", "line_size", "repeated_lines", "short_lines", "repeated_pairs", "entropy"]


def statistics(text: str | None) -> list[float]:
    """The features of a whole text; all of an empty one are zero."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist[hist > 0] / len(raw)
    groups = (hist @ GROUP_OF / len(raw)).tolist()
    words = raw.split()
    n = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    initial = sum(1 for w in words if 65 <= w[0] <= 90)
    return [
        *groups, float(np.log1p(len(raw))), float(np.log1p(len(words))), float(sizes.mean()), float(sizes.std()), len(counts) / n,
        max(counts.values(), default=0) / n, float((sizes <= 3).mean()), float((sizes > 12).mean()), initial / n,
        float(np.log1p(len(lines))), len(raw) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), sum(len(x) < 40 for x in lines) / max(len(lines), 1),
        1 - pairs / max(len(words) - 1, 1), float(-(share * np.log2(share)).sum()),
    ]


@dataclass
class Trees:
    """feature and threshold: a row per tree, a column per inner node, breadth first; a row goes right if its value is above the threshold. leaf: a column per leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64).reshape(-1, len(NAMES))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        trees = np.arange(len(self.leaf))[None, :]
        at = np.zeros((len(x), len(self.leaf)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        raw = np.full(len(x), self.base) + (self.leaf[trees, at - (2**depth - 1)].sum(1) if depth else 0)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boost on the log loss. A feature's values are cut into at most ``bins`` bins by quantile; splits come from gradient histograms."""
    x, y = np.asarray(x, np.float64).reshape(-1, len(NAMES)), np.asarray(y, np.float64)
    n, d = x.shape
    p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    if not n or y.min() == y.max():
        return Trees(base, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin k: values up to cut k
    raw = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = prob - y, prob * (1 - prob)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, k = 2**level - 1, 2**level
            best = np.zeros(k)
            pick = [(0, np.inf, -1)] * k
            for j in range(d):
                key = (node - first) * bins + binned[:, j]
                g = np.bincount(key, grad, k * bins).reshape(k, bins)
                h = np.bincount(key, hess, k * bins).reshape(k, bins)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gs, hs = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least) | (hs - hl < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                for m in range(k):
                    if gain[m, top[m]] > best[m] + 1e-9:
                        best[m], pick[m] = gain[m, top[m]], (j, cuts[j][top[m]], top[m])
            right = np.zeros(n, bool)
            for m, (j, cut, b) in enumerate(pick):
                feature[first + m], threshold[first + m] = j, cut
                if b >= 0:
                    right |= (node == first + m) & (binned[:, j] > b)
            node = 2 * node + 1 + right
        at = node - (2**depth - 1)
        leaf = -rate * np.bincount(at, grad, 2**depth) / (np.bincount(at, hess, 2**depth) + ridge)
        raw += leaf[at]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    ship(docs.sparkSession)
    own = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([statistics(t) for t in batch.column(len(keep)).to_pylist()], pa.list_(pa.float64()))], [*keep, "stats"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])
    return own.mapInArrow(run, f"{kinds}, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, most: int = 10_000) -> Trees:
    """Learn ``label`` from rows outside the held-out fold, at most ``most`` of each class, the first by the id's hash.

    Of labels that differ for one id the lower counts, of texts that share an id that with the least statistics; null ids and null labels teach nothing. Without
    rows, or with one class only, the model gives the same score to all.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"))
    picked = sample_ids(known.where(fold(F.col("doc_id"), folds) != held), "y", most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # 2 * most ids
    one = with_statistics(rows, ["doc_id", "y"]).groupBy("doc_id", "y").agg(F.min("stats").alias("stats"))  # an id may be repeated
    got = sorted(tuple(r) for r in one.collect())  # 2 * most rows
    return fit(np.array([r[2] for r in got]), np.array([r[1] for r in got]))


def score(docs: DataFrame, model: Trees, keep: list[str], least: float = 0.7) -> DataFrame:
    """The columns ``keep`` with score and predicted (1 if the score is at least ``least``). A null text is scored as an empty one; null and repeated ids don't matter."""
    ship(docs.sparkSession)
    own = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.array([statistics(t) for t in batch.column(len(keep)).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= least).astype(np.int32))], [*keep, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])
    return own.mapInArrow(run, f"{kinds}, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
