"""The search engine's control plane: settings, result cache, statistics and tuning."""

from __future__ import annotations

import time
import warnings
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fusion import FusionConfig
from ..operators.profile import hit_rate
from ..operators.search import Encoder, Scorer, hybrid_search


@dataclass(frozen=True)
class HybridConfig:
    k1: int = 50
    k2: int = 10
    batch_size: int = 8
    use_cache: bool = True
    max_cache_size: int = 1000
    fusion: FusionConfig = FusionConfig()

    def __post_init__(self) -> None:
        if self.k2 < 1 or self.k1 < self.k2 or self.batch_size < 1:
            raise ValueError("k1 >= k2 >= 1 and batch_size >= 1 must hold")


class HybridEngine:
    """Two-stage search over a corpus (id, embedding), with a bounded cache of collected results for single queries.

    ``make_scorer`` makes a scorer for a batch size, in place of ``scorer``, which has its own.
    """

    def __init__(self, corpus: DataFrame, scorer: Scorer | None = None, config: HybridConfig = HybridConfig(), make_scorer: Callable[[int], Scorer] | None = None):
        if (scorer is None) == (make_scorer is None):
            raise ValueError("either a scorer or make_scorer")
        self.corpus, self.config = corpus, config
        self.make_scorer = make_scorer or (lambda batch: scorer)
        self._cache: OrderedDict[tuple, list] = OrderedDict()
        self.reset_statistics()

    def update_config(self, **changes) -> HybridConfig:
        """Unknown names are ignored with a warning; settings that don't hold raise and change nothing."""
        known = {f.name for f in fields(HybridConfig)}
        for name in changes.keys() - known:
            warnings.warn(f"unknown setting {name}", stacklevel=2)
        self.config = replace(self.config, **{k: v for k, v in changes.items() if k in known})
        return self.config

    def reset_config(self) -> None:
        self.config = HybridConfig()

    def search(self, queries: DataFrame, k1: int | None = None, k2: int | None = None) -> DataFrame:
        """queries (query_id, embedding), any number."""
        return hybrid_search(queries, self.corpus, self.make_scorer(self.config.batch_size), k1 or self.config.k1, k2 or self.config.k2, self.config.fusion)

    def search_one(self, query: list[float], k1: int | None = None, k2: int | None = None) -> list[tuple[int, float]]:
        k1, k2 = k1 or self.config.k1, k2 or self.config.k2
        key = (tuple(query), k1, k2, self.config.fusion, self.config.batch_size)
        if self.config.use_cache and key in self._cache:
            self.hits += 1
            self._cache.move_to_end(key)
            return self._cache[key]
        began = time.perf_counter()
        one = self.corpus.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<double>")
        got = [(r.id, r.score) for r in self.search(one, k1, k2).orderBy("rank").collect()]
        self.misses += 1
        took = (time.perf_counter() - began) * 1000
        self.latencies.append(took)
        self.last = {"encode_ms": 0.0, "search_ms": took, "total_ms": took, "qps": 1000 / took if took else 0.0}
        if self.config.use_cache:
            self._cache[key] = got
            while len(self._cache) > self.config.max_cache_size:
                self._cache.popitem(last=False)
        return got

    def search_text(self, text: str, model: Encoder, k1: int | None = None, k2: int | None = None) -> list[tuple[int, float]]:
        """As ``search_one`` for a text that ``model`` encodes; ``last`` then parts its time."""
        began = time.perf_counter()
        vector = model.encode([text])[0]
        encoded = (time.perf_counter() - began) * 1000
        got = self.search_one(vector, k1, k2)
        took = (time.perf_counter() - began) * 1000
        self.last = {"encode_ms": encoded, "search_ms": took - encoded, "total_ms": took, "qps": 1000 / took if took else 0.0}
        return got

    def clear_cache(self) -> None:
        self._cache.clear()

    def cache_size(self) -> int:
        return len(self._cache)

    def cache_keys(self) -> list[tuple]:
        return list(self._cache)

    def reset_statistics(self) -> None:
        self.hits = self.misses = 0
        self.latencies: list[float] = []
        self.last: dict[str, float] = {}

    def statistics(self) -> dict:
        """Counts, the share of look-ups that hit, and mean, median and high percentiles of latency where there was a search."""
        out: dict = {"total": self.hits + self.misses, "hits": self.hits, "hit_rate": hit_rate(self.hits, self.misses)}
        if self.latencies:
            import numpy as np

            out |= {"mean_ms": float(np.mean(self.latencies)), "median_ms": float(np.median(self.latencies)), "p95_ms": float(np.percentile(self.latencies, 95)), "p99_ms": float(np.percentile(self.latencies, 99)), "qps": 1000 / float(np.mean(self.latencies))}
        return out

    def profile(self, queries: DataFrame, k1s: list[int], k2s: list[int], batch_sizes: list[int]) -> list[dict]:
        """Mean latency per query for each setting with k1 >= k2, fastest first; the engine's own settings stay."""
        n, out, own = max(queries.count(), 1), [], self.config
        for k1, k2, b in product(k1s, k2s, batch_sizes):
            if k1 >= k2:
                self.config = replace(own, batch_size=b)
                began = time.perf_counter()
                try:
                    self.search(queries, k1, k2).write.format("noop").mode("overwrite").save()
                finally:
                    self.config = own
                out.append({"k1": k1, "k2": k2, "batch_size": b, "ms": (time.perf_counter() - began) * 1000 / n})
        return sorted(out, key=lambda r: r["ms"])

    def optimize(self, profiled: list[dict], target_ms: float = 500) -> HybridConfig:
        best = min(profiled, key=lambda r: abs(r["ms"] - target_ms))
        return self.update_config(**{k: best[k] for k in ("k1", "k2", "batch_size")})


def settings_grid(k1s: DataFrame, k2s: DataFrame) -> DataFrame:
    """All pairs of a few settings with k1 >= k2."""
    return k1s.join(k2s, F.col("k1") >= F.col("k2"))
