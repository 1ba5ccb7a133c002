"""Exact duplicates by a heavy-hitter split.

Frequent digests are found by Misra-Gries summaries (one pass, bounded counters, merged FAN_IN at a time); their exact
winners are verified and broadcast, so that the copies of a very large group never meet in one task. All other
digests use an ordinary shuffle of narrow rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwave.llm.base import checkpointed, table, texts

#: Counters of a summary. A digest held by more than rows / (COUNTERS + 1) rows is found for certain.
COUNTERS = 256
#: Summaries that one task merges, and that the driver gets at most, whatever the input.
FAN_IN = 32


def merged_counts(counts: pd.Series, counters: int) -> pd.Series:
    """Misra-Gries reduction: subtract the (counters + 1)-th largest count, keep what stays positive."""
    counts = counts.groupby(level=0).sum().sort_values(ascending=False)
    if len(counts) > counters:
        counts = counts - counts.iloc[counters]
        counts = counts[counts > 0]
    return counts


def frequent_candidates(digests: DataFrame, counters: int = COUNTERS) -> list[str]:
    """Digests that may be frequent; none above rows / (counters + 1) is missing."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.Series(dtype="int64")
        for batch in batches:
            kept = merged_counts(pd.concat([kept, batch["digest"].value_counts()]), counters)
        yield pd.DataFrame({"part": np.full(len(kept), TaskContext.get().partitionId(), "int64"), "digest": kept.index.astype(str), "n": kept.to_numpy("int64")})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        kept = merged_counts(part.set_index("digest")["n"], counters)
        return pd.DataFrame({"part": np.full(len(kept), part["part"].iloc[0]), "digest": kept.index.astype(str), "n": kept.to_numpy("int64")})

    schema = "part long, digest string, n long"
    parts = checkpointed(digests.select("digest").mapInPandas(summarise, schema))
    while (parts.agg(F.max("part")).first()[0] or 0) >= FAN_IN:
        parts = checkpointed(parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(merge, schema))
    rows = parts.collect()  # at most FAN_IN x counters
    if not rows:
        return []
    return list(merged_counts(pd.Series([r.n for r in rows], index=[r.digest for r in rows]), counters).index)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id (largest id of its group), group_size, kept, text_sha256.

    Null texts count as empty and form one group with empty texts; repeated rows of one id are all kept or all
    dropped together; a row without an id counts in its group's size, and its `kept` is null; an empty table gives an
    empty result; no other column of ``docs`` is read.
    """
    spark = docs.sparkSession
    ids = checkpointed(texts(docs, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("digest")))
    candidates = frequent_candidates(ids, counters)
    schema = "digest string, keep_id long, group_size long"
    heavy = spark.createDataFrame([], schema)
    if candidates:
        asked = F.broadcast(spark.createDataFrame([(c,) for c in candidates], "digest string"))
        # at most `counters` rows: the size of what is broadcast is bounded by the parameter
        won = ids.join(asked, "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1").collect()
        heavy = spark.createDataFrame([tuple(r) for r in won], schema)
    split = ids.join(F.broadcast(heavy), "digest", "left")
    rest = split.where("group_size is null").select("doc_id", "digest")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = split.where("group_size is not null").select("doc_id", "keep_id", "group_size", "digest").unionByName(rest.join(groups, "digest").select("doc_id", "keep_id", "group_size", "digest"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns.

    A text that only rows without an id hold keeps one of them; where another row with that text has an id, none.
    """
    found = exact_duplicates(docs)
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    alone = found.where("doc_id is null and keep_id is null").select("text_sha256")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    nameless = docs.where(docs["doc_id"].isNull()).select(F.sha2(F.coalesce(docs["text"], F.lit("")), 256).alias("digest"), row)
    nameless = nameless.join(alone, nameless["digest"] == alone["text_sha256"], "left_semi").groupBy("digest").agg(F.first("row").alias("row")).select("row.*")
    return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").unionByName(nameless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
