"""Hierarchical multi-length packing of token sequences.

Documents are cut into full windows and a rest; rests are routed to the tier (256, 512, 1024) that holds them. The
packing plan works on the histogram of rest lengths (at most 1024 numbers, whatever the corpus): each long window is
filled with rests of shorter tiers, then each shorter tier is packed into its own windows where these come out
exactly full, otherwise into long ones. Pieces find their place by their rank among pieces of their length, counted
per hash bucket, so no task sees all pieces of a common length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwave.llm.base import table, texts, written
from cohortwave.llm.tokens import RANKS, encoder, tokenizer_path

WINDOW = 1024
TIERS = (256, 512, 1024)
END_ID = 0
#: Windows of a training step, in long-window equivalents.
STEP_WINDOWS = 64
#: Pieces per hash bucket that one task ranks, about.
BUCKET_ROWS = 20_000
#: Buckets whose counts are summed in one task.
SHELF = 1_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step long"


def pieces(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document's ids (closed by id 0) into full windows and a rest."""
    ranks_path = ranks_path or tokenizer_path(RANKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, at in encoder(ranks_path).rows(batch.column("text")):
                closed = np.insert(ids, at[1:], END_ID).astype("<u4", copy=False)
                at = at + np.arange(hi - lo + 1)
                total = np.diff(at)
                per_doc = -(-total // window)
                row = np.repeat(np.arange(hi - lo), per_doc)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * window
                length = np.minimum(window, total[row] - start)
                raw, first = memoryview(closed).cast("B"), 4 * (at[row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                yield pa.record_batch([batch.column("doc_id").take(pa.array(lo + row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(cut, PIECE)


def fill(counts: np.ndarray, first: int, window: int) -> tuple[dict[int, int], int]:
    """The lengths beside `first` that fill a window, longest fitting first, and what is left open."""
    use, gap = {first: 1}, window - first
    while gap > 0:
        left = counts[1 : gap + 1].copy()
        for length, n in use.items():
            if length <= gap:
                left[length - 1] -= n
        fits = np.flatnonzero(left > 0)
        if not len(fits):
            break
        length = int(fits[-1]) + 1
        take = min(gap // length, int(left[length - 1]))
        use[length] = use.get(length, 0) + take
        gap -= take * length
    return use, gap


def packing_plan(histogram: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, dict[int, int]]]:
    """(window, how many such windows, {length: pieces in each}). Every piece of the histogram is placed."""
    window = tiers[-1]
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    while (there := np.flatnonzero(counts)).size:
        first = int(there[-1])
        own = next(t for t in tiers if first <= t)
        use, gap = fill(counts, first, own)
        if gap and own != window:  # a shorter window only where it is exactly full
            own = window
            use, gap = fill(counts, first, own)
        many = min(int(counts[length]) // n for length, n in use.items())
        for length, n in use.items():
            counts[length] -= many * n
        plan.append((own, many, use))
    return plan


def placements(plan: list[tuple[int, int, dict[int, int]]], step_windows: int = STEP_WINDOWS) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length, arrays by run of ranks: first rank, first sequence, copies per window, offset, window, rank in tier; and the number of steps."""
    runs: dict[int, list[tuple[int, ...]]] = {}
    ranks: dict[int, int] = {}
    in_tier: dict[int, int] = {}
    sequence = tokens = 0
    for window, many, use in plan:
        offset = 0
        for length, n in sorted(use.items(), reverse=True):
            runs.setdefault(length, []).append((ranks.get(length, 0), sequence, n, offset, window, in_tier.get(window, 0)))
            ranks[length] = ranks.get(length, 0) + many * n
            offset += n * length
        sequence += many
        in_tier[window] = in_tier.get(window, 0) + many
        tokens += many * window
    steps = max(1, -(-tokens // (step_windows * max((w for w, _, _ in plan), default=WINDOW))))
    return {length: tuple(np.asarray(c, np.int64) for c in zip(*r, strict=True)) for length, r in runs.items()}, steps


def bucket_bases(counts: DataFrame, shelf: int = SHELF) -> DataFrame:
    """(length, bucket, base): rows of the length in all buckets before. counts: length, bucket, n.

    Sums go over shelves of so many buckets first, then over the buckets of a shelf, so no task reads every bucket of a length.
    """
    shelved = counts.withColumn("shelf", F.floor(F.col("bucket") / shelf))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    shelves = shelved.groupBy("length", "shelf").agg(F.sum("n").alias("n")).select("length", "shelf", F.coalesce(F.sum("n").over(earlier("length").orderBy("shelf")), F.lit(0)).alias("shelf_base"))
    inside = shelved.withColumn("inside", F.coalesce(F.sum("n").over(earlier("length", "shelf").orderBy("bucket")), F.lit(0)))
    return inside.join(shelves, ["length", "shelf"]).select("length", "bucket", (F.col("shelf_base") + F.col("inside")).alias("base"))


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step.

    A null or empty text is a single piece of one id. Repeated rows of one id are separate documents. `window` is
    the sequence's context size; `step` deals the windows of every tier evenly over training steps. The order of
    pieces depends on ids alone, not on the number of partitions read.
    """
    window = tiers[-1]
    cut = written(pieces(docs, window, ranks_path, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    where, steps = placements(packing_plan(histogram, tiers))
    buckets = max(8, sum(histogram.values()) // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.select("*", bucket).withColumn("at", own)
    bases = bucket_bases(cut.groupBy("length", bucket).agg(F.count("*").alias("n")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for length, part in batch.groupby("length", sort=False):
                first, sequence, copies, offset, tier, in_tier = where[length]
                rank = part["rank"].to_numpy("int64")
                run = np.searchsorted(first, rank, side="right") - 1
                inside = rank - first[run]
                nth = inside // copies[run]
                done.append(part.drop(columns="rank").assign(sequence_id=sequence[run] + nth, offset=offset[run] + inside % copies[run] * length, window=tier[run].astype("int32"), step=(in_tier[run] + nth) % steps))
            if done:
                yield pd.concat(done)

    return ranked.join(bases, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("at")).alias("rank")).mapInPandas(place, PLACED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
