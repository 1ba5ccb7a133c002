"""Token counts through a digest cache: only distinct texts that no earlier run has counted are encoded.

Key of the cache: SHA-256 of the text (null as empty, otherwise unchanged, since counts depend on every byte) and of
the tokenizer file. A copy of a text, in this run or an earlier one, costs a join instead of an encoding; digests of very
many rows are joined by a broadcast of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwave.llm.base import join_groups, shared_dir, table, texts, written
from cohortwave.llm.tokens import JSON, RANKS, encoder, tokenizer_path, tokenizer_version

TOKEN_LIMIT = 512
CACHE = "digest string, version string, n_tokens long"


def cached_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a folder that isn't there yet is an empty cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.schema(CACHE).parquet(cache_path) if there else spark.createDataFrame([], CACHE)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache_path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. Appends what it encodes to the cache.

    Null and empty texts have no tokens; repeated rows get a row each; long texts are encoded whole; an empty
    table gives an empty result; other columns are not read. Appending twice (a rerun) is harmless: equal keys
    hold equal counts.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path(JSON))
    ranks_path = ranks_path or tokenizer_path(RANKS)
    rows = texts(docs, id_col, text_col).withColumn("digest", F.sha2("text", 256))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = encoder(ranks_path).counts(batch.column("text"))
            yield pa.record_batch([batch.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n)], names=["digest", "version", "n_tokens"])

    # the duplicates go before the shuffle as well as after it, so a large group of copies sends one text per task
    misses = rows.select("digest", "text").dropDuplicates(["digest"]).join(cached_counts(spark, cache_path, version), "digest", "left_anti")
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    narrow = written(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    counted = cached_counts(spark, cache_path, version).join(narrow.groupBy("digest").agg(F.count("*").alias("n")), "digest")
    return join_groups(narrow, counted, ["digest"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache of its own, so that each run encodes every distinct text."""
    return token_counts(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}")
