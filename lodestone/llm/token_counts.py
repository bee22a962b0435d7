"""Token counts behind a cache of digests.

A text's digest (SHA-256 of the text with each run of ASCII white space made one space, which the tokenizer does itself
and which can't make or break a special token) and the tokenizer's digest (SHA-256 of its file) are joined to stored
counts. Only distinct texts without a stored count are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .bpe import Encoder, default_path
from .shared import new_dir, table

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The stored counts; none if there is no such folder yet. Any other trouble raises."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    return spark.createDataFrame([], CACHE_SCHEMA)


def _digest(text, folded: bool):
    return F.unhex(F.sha2(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ") if folded else text, 256))


def count_misses(docs: DataFrame, cache_dir: str, tokenizer: str, text_col: str = "text") -> None:
    """Encode every distinct text that the cache lacks and append its count."""
    ship(docs.sparkSession)
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    folded = not Encoder.at(tokenizer).spaced
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", _digest(F.col("text"), folded))
    stored = read_cache(spark, cache_dir).where(F.col("tokenizer") == version)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.at(tokenizer)
        for batch in batches:
            sizes = [np.zeros(0, np.int64), *(np.diff(off) for _, _, off in enc.chunks(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes))], ["digest", "n_tokens"])

    misses = texts.join(stored.select("digest"), "digest", "left_anti").dropDuplicates(["digest"]).select("digest", "text")
    counts = misses.mapInArrow(count, "digest binary, n_tokens long")
    counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_dir)


def token_counts(docs: DataFrame, cache_dir: str, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_bytes (UTF-8), n_tokens, over_limit. A null text counts as empty; rows of one id stay apart."""
    count_misses(docs, cache_dir, tokenizer, text_col)
    folded = not Encoder.at(tokenizer).spaced
    stored = read_cache(docs.sparkSession, cache_dir).where(F.col("tokenizer") == tokenizer_digest(tokenizer))
    stored = stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))  # two runs at once may have stored a text twice
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), _digest(text, folded).alias("digest"))
    return rows.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), new_dir(spark, "counts"), default_path("word_bpe_49k.json"))
