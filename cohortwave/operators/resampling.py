"""Resampling whose shuffle doesn't grow with rows times replicates, and surrogate nulls as restartable jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwave.operators.models import blockwise_iaaft, floating_forward_selection, spread_by, whole_groups
from cohortwave.operators.order import positions
from cohortwave.sources.tables import pending_units

#: Rows whose draws are made at once; the tree above them splits the replicates' draws.
BLOCK_ROWS = 4096
#: Cells (replicates x rows) of counts that a task holds.
CELLS = 1 << 21


def block_draws(block: int, blocks: int, rows: int, replicates: int, seed: int, block_rows: int) -> np.ndarray:
    """How many of each replicate's `rows` draws fall into a block, from a tree of binomial splits.

    A split's seed is its place in the tree, so every task finds the same numbers for the nodes that it shares with others.
    """
    draws, lo, hi = np.full(replicates, rows, np.int64), 0, blocks
    while hi - lo > 1:
        middle = (lo + hi) // 2
        inside = min(rows, hi * block_rows) - lo * block_rows
        left = np.random.default_rng([seed, lo, hi]).binomial(draws, (middle - lo) * block_rows / inside)
        lo, hi, draws = (lo, middle, left) if block < middle else (middle, hi, draws - left)
    return draws


def row_counts(draws: np.ndarray, rows: int, rng: np.random.Generator) -> np.ndarray:
    """(replicates, rows): each replicate's draws dealt evenly at random over the rows of a block."""
    place = np.repeat(np.arange(len(draws)), draws) * rows + rng.integers(0, rows, int(draws.sum()))
    return np.bincount(place, minlength=len(draws) * rows).reshape(len(draws), rows)


def bootstrap_sums(df: DataFrame, order: list[str], sums: dict[str, Column], n: int, seed: int) -> DataFrame:
    """(replicate, sums): each column summed over as many rows as there are, drawn with replacement, for n replicates.

    The multinomial counts of a replicate are split down a tree of blocks of rows and then within each block; what is
    shuffled is each row once and n sums a task. Rows with a NULL in a column take no part.
    """
    values = df.select(*order, *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(sums.values())]).dropna(subset=[f"_v{i}" for i in range(len(sums))])
    placed = positions(values, order, "_at").withColumn("_block", F.floor((F.col("_at") - 1) / BLOCK_ROWS).cast("long"))
    rows = placed.count()
    blocks, names, block_rows = -(-rows // BLOCK_ROWS), [f"_v{i}" for i in range(len(sums))], BLOCK_ROWS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part, starts in whole_groups(batches, ["_block"], block_rows):
            for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
                block, x = int(part["_block"].iloc[a]), part[names].iloc[a:b].to_numpy(float)
                draws, rng = block_draws(block, blocks, rows, n, seed, block_rows), np.random.default_rng([seed, block, block, 1])
                total = np.zeros((n, len(names))) if total is None else total
                step = max(1, CELLS // len(x))
                for lo in range(0, n, step):
                    total[lo : lo + step] += row_counts(draws[lo : lo + step], len(x), rng) @ x
        if total is not None:
            yield pd.DataFrame(total, columns=names).assign(replicate=np.arange(n))[["replicate", *names]]

    partial = spread_by(placed.select("_block", "_at", *names), "_block").sortWithinPartitions("_block", "_at").mapInPandas(run, "replicate long, " + ", ".join(f"{c} double" for c in names))
    return partial.groupBy("replicate").agg(*[F.sum(c).alias(name) for c, name in zip(names, sums, strict=True)])


def score_sums(y: str, pred: str, m0: str) -> dict[str, Column]:
    """What Q2 and the skill of the mean absolute error are made of."""
    p, m = F.col(y) - F.col(pred), F.col(y) - F.col(m0)
    return {"sse": p * p, "sse0": m * m, "sae": F.abs(p), "sae0": F.abs(m)}


def scores_of(sums: DataFrame) -> DataFrame:
    """(replicate, q2, mae_skill)."""
    ratio = lambda a, b: 1 - F.col(a) / F.greatest(F.col(b), F.lit(1e-300))
    return sums.select("replicate", ratio("sse", "sse0").alias("q2"), ratio("sae", "sae0").alias("mae_skill"))


# surrogate null

RESULT = "participant string, replicate int, n_folds long, mean_r double, mean_rmse double"


def finished(spark: SparkSession, path: str) -> DataFrame:
    """Results stored so far; a folder that isn't there yet holds none. A unit stored twice counts once."""
    try:
        found = spark.read.schema(RESULT).parquet(path)
    except AnalysisException:
        found = spark.createDataFrame([], RESULT)
    return found.where("n_folds is not null").dropDuplicates(["participant", "replicate"])


def surrogate_units(series: DataFrame, key: str, order: str, columns: list[str], y: str, most: int, replicates: list[int], seed: int) -> DataFrame:
    """Results of the given replicates for all participants of series: replicate -1 is the series itself, others have y replaced
    by a surrogate of each block, and go through the same selection and block validation."""
    rows = series.select(F.col(key).cast("string").alias("participant"), "block", order, *columns, F.col(y).cast("double").alias("y")).dropna()
    parts = [rows.withColumn("replicate", F.lit(-1))] if -1 in replicates else []
    for r in (r for r in replicates if r >= 0):  # a replicate has a seed of its own, so it is the same whenever it is run
        made = blockwise_iaaft(rows, ["participant", "block"], order, "y", 1, seed * 1_000_003 + r).drop("replicate")
        parts.append(rows.drop("y").join(made.withColumnRenamed("surrogate", "y"), ["participant", "block", order]).withColumn("replicate", F.lit(r)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    named = both.withColumn("unit", F.concat_ws(":", "replicate", "participant"))
    found = floating_forward_selection(named, "unit", columns, "y", most)
    s = found.groupBy("key").agg(F.count("*").alias("n_folds"), F.avg("r").alias("mean_r"), F.avg("rmse").alias("mean_rmse"))
    cut = F.instr("key", ":")
    return s.select(F.substr("key", cut + 1).alias("participant"), F.substr("key", F.lit(1), cut - 1).cast("int").alias("replicate"), "n_folds", "mean_r", "mean_rmse")


def surrogate_null(series: DataFrame, key: str, order: str, columns: list[str], y: str, most: int, k: int, seed: int, path: str, at_once: int = 4) -> DataFrame:
    """(participant, replicate, ...) of the series and k surrogates; units already stored under path aren't run again.

    A run takes at_once replicates, appends their units and goes on; after an interruption the same call finds what is
    missing, including units without a full result.
    """
    spark = series.sparkSession
    people = series.select(F.col(key).cast("string").alias("participant")).distinct()
    for lo in range(-1, k, at_once):
        group = list(range(lo, min(k, lo + at_once)))
        plan = people.select("participant", F.explode(F.array(*map(F.lit, group))).alias("replicate"))
        pending = pending_units(plan, finished(spark, path), ["participant", "replicate"], ["n_folds"])
        open_ = sorted(r["replicate"] for r in pending.select("replicate").distinct().collect())
        if not open_:
            continue
        own = series.join(pending.select(F.col("participant").alias("_p")).distinct(), F.col(key).cast("string") == F.col("_p"), "left_semi")
        units = surrogate_units(own, key, order, columns, y, most, open_, seed)
        # participants too short for a fold get a unit too, so that they are not asked for again
        full = pending.select("participant", "replicate").join(units, ["participant", "replicate"], "left").withColumn("n_folds", F.coalesce("n_folds", F.lit(0).cast("long")))
        full.select("participant", "replicate", "n_folds", "mean_r", "mean_rmse").write.mode("append").parquet(path)
    return finished(spark, path).where((F.col("replicate") < k))


def surrogate_summary(units: DataFrame) -> DataFrame:
    """Per participant and for the cohort (participant NULL: the mean over participants): observed mean R, the null's mean and SD, p = (1 + number at least as large) / (1 + K).

    A replicate whose selection predicts a constant has no R; it counts among K, and not as large.
    """
    units = units.where("n_folds > 0")
    cohort = units.groupBy("replicate").agg(F.avg("mean_r").alias("mean_r")).select(F.lit(None).cast("string").alias("participant"), "replicate", "mean_r")
    both = units.select("participant", "replicate", "mean_r").unionByName(cohort)
    seen = both.where("replicate = -1 and mean_r is not null").select(F.col("participant").alias("_p"), F.col("mean_r").alias("observed"))
    j = both.where("replicate >= 0").join(seen, F.col("participant").eqNullSafe(F.col("_p")))
    return j.groupBy("participant", "observed").agg(F.count("*").alias("k"), F.avg("mean_r").alias("null_mean"), F.stddev_samp("mean_r").alias("null_sd"), ((1 + F.count_if(F.col("mean_r") >= F.col("observed"))) / (1 + F.count("*"))).alias("p"))
