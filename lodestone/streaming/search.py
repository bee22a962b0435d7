"""A stream of queries against a static corpus, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import knn_join


def stream_search(queries: DataFrame, corpus: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of queries (query_id, embedding) is joined to the corpus and handed to ``sink``."""
    return queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(knn_join(df, corpus, k), n)).start()


def windowed_latency(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Count and mean of value per event type and tumbling window of ts; also on a table."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
