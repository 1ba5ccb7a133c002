"""Folds, scaling, ridge models, nested validation, resampling and verdicts.

Linear models are fitted from sums of cross products, which Spark adds up; a training part is the total minus what is
left out. Nested validation meets its pairs of left-out rows in cells of bounded size. Bootstraps join rows by position
to drawn positions. No table is brought to the driver, and none has a bound on its rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwave.functions.scalar import safe_corr
from cohortwave.operators.order import average_ranks, largest_group, stored
from cohortwave.operators.shape import canonical_positions

#: Rows of either side of a cell of nested validation.
CELL_ROWS = 400
#: Pairs of left-out rows whose small systems are solved at once.
PAIRS_AT_ONCE = 20_000
#: Rows of a block that one surrogate is made of, at most (32 MB a series, twelve days at four rows a second); a longer block is cut in such stretches.
STRETCH = 1 << 22
#: Members of a fold that are one list (some 40 MB); more are put in order by a window over all rows.
FOLD_MEMBERS = 1 << 22
#: Rows of folds that a task makes, and tasks at most; a task makes one fold at least.
FOLD_ROWS, MOST_PARTS = 1 << 20, 20_000
#: Rows of a table of subjects or folds that are broadcast.
BROADCAST_ROWS = 1 << 20
#: Values of a group that are one list from which its row draws; larger groups are joined to their draws.
DRAW_ROWS = 1 << 16
#: Draws whose digests a task holds at once (8 MB).
DRAWS_AT_ONCE = 1 << 18
#: Rows of whole groups that a task works on at once; a larger group comes alone.
ROWS_AT_ONCE = 1 << 16


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to a stated number of partitions: few bytes with much work in them would otherwise be merged into one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = ROWS_AT_ONCE) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, starts) of whole groups out of batches in which the rows of a group are neighbours."""

    def starts(part: pd.DataFrame) -> np.ndarray:
        group = part.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        return np.flatnonzero(np.append(True, group[1:] != group[:-1]))

    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        if len(b):
            held.append(b)
            size += len(b)
        if size >= rows:
            part = pd.concat(held, ignore_index=True)
            at = starts(part)
            if len(at) > 1:
                yield part.iloc[: at[-1]], at[:-1]
            held = [part.iloc[at[-1] :].reset_index(drop=True)]
            size = len(held[0])
            rows = max(rows, 2 * size)  # a group larger than that is not put together anew for every batch
    if held:
        part = pd.concat(held, ignore_index=True)
        yield part, starts(part)


# folds and scaling


def loso_folds(subjects: DataFrame, subject: str, seed: int, fraction: float) -> DataFrame:
    """(fold_id, subject, role): one test subject per fold, a hash-ordered fraction of the rest for validation.

    n folds of n members are n * n rows by definition; join them to subject-level tables only. What is shuffled and stored is a
    bit a row: a fold is one row with a bit for each member, which becomes its n rows where they are read, in tasks of FOLD_ROWS or one fold.
    """
    s = stored(subjects.select(subject).distinct(), "subjects")
    n, named = s.agg(F.count("*"), F.count(subject)).first()
    if n > FOLD_MEMBERS or named < n:
        return loso_folds_by_window(s, subject, seed, fraction)
    take = math.ceil(Decimal(max(0, n - 1)) * Decimal(str(fraction)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = None, []
        for b in batches:
            words = []
            for head, own, members in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if seen is None or not members.values.equals(seen):
                    seen, texts = members.values, [m.encode() for m in members.values.to_pylist()]
                words.append(validation_bits(head.encode(), texts, own - 1, take))
            ends = np.cumsum([0, *map(len, words)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(words), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["fold_id", "_words"])

    members = s.agg(F.sort_array(F.collect_list(subject)).alias("_members"))
    texts = members.select("_members", F.transform("_members", lambda m: m.cast("string")).alias("_texts"))
    folds = spread_by(s, subject).crossJoin(F.broadcast(texts)).select(F.col(subject).alias("fold_id"), F.concat_ws(":", F.lit(seed), F.col(subject), F.lit("")).alias("_head"), F.array_position("_members", F.col(subject)).cast("int").alias("_own"), "_texts")
    bits = stored(folds.mapInArrow(run, f"fold_id {dict(s.dtypes)[subject]}, _words array<bigint>"), "folds")
    parts = max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-n * n // FOLD_ROWS)))
    rows = bits.repartition(parts, "fold_id").crossJoin(F.broadcast(members)).select("fold_id", "_words", F.posexplode("_members").alias("_i", subject))
    bit = F.getbit(F.get("_words", F.shiftright("_i", 6)), F.col("_i").bitwiseAND(F.lit(63)))
    return rows.select("fold_id", subject, F.when(F.col("fold_id") == F.col(subject), "test").when(bit == 1, "validation").otherwise("train").alias("role"))


def validation_bits(head: bytes, members: list[bytes], own: int, take: int) -> np.ndarray:
    """64-bit words, a bit for each member: whether it is among the `take` of least SHA-256 of head + member, without the fold's own."""
    sha, chosen = hashlib.sha256, np.zeros(-(-len(members) // 64) * 64, np.uint8)
    if take:
        h = np.frombuffer(b"".join([sha(head + m).digest()[:8] for m in members]), ">u8").astype(np.uint64)
        h[own] = np.iinfo(np.uint64).max
        least = h <= np.partition(h, take - 1)[take - 1]
        if least.sum() > take or least[own]:  # equal in the first 8 bytes
            order = sorted((sha(head + m).digest(), i) for i, m in enumerate(members) if i != own)
            least = np.isin(np.arange(len(members)), [i for _, i in order[:take]])
        chosen[: len(members)] = least
    return np.packbits(chosen, bitorder="little").view("<i8")


def loso_folds_by_window(s: DataFrame, subject: str, seed: int, fraction: float) -> DataFrame:
    """loso_folds() of more subjects than a list may hold, by a shuffle of all rows."""
    folds = s.select(F.col(subject).alias("fold_id"))
    member = folds.join(s).withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col("fold_id"), F.col(subject)), 256)).withColumn("_test", F.col("fold_id") == F.col(subject))
    w = Window.partitionBy("fold_id")
    r = member.withColumn("_rank", F.row_number().over(w.orderBy("_test", "_h", subject))).withColumn("_n", F.count("*").over(w))
    return r.select("fold_id", subject, F.when(F.col("_test"), "test").when(F.col("_rank") <= F.ceil(share_of(F.col("_n") - 1, fraction)), "validation").otherwise("train").alias("role"))


def share_of(n: Column, ratio: float) -> Column:
    """n times a ratio as it is written: in decimals, 90000 * 0.7 is 63000 and not a little less."""
    return n.cast("decimal(18,0)") * F.lit(Decimal(str(ratio)))


def subject_ratio_split(subjects: DataFrame, subject: str, seed: int, train: float, validation: float) -> DataFrame:
    """Roles by position in a hash order: floor(n * ratio) to train, then validation, the rest to test."""
    s = subjects.select(subject).distinct().withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(subject)), 256))
    n = s.agg(F.count("*").alias("n"))
    r = canonical_positions(s, ["h", subject]).join(F.broadcast(n))
    cut = F.floor(share_of(F.col("n"), train))
    return r.select(subject, F.when(F.col("position") <= cut, "train").when(F.col("position") <= cut + F.floor(share_of(F.col("n"), validation)), "validation").otherwise("test").alias("role"))


def fold_partition_check(folds: DataFrame, subject: str) -> DataFrame:
    """Violations: members with several roles in a fold, folds without exactly one test subject, subjects not tested exactly once, folds that lack subjects."""
    test = F.count_if(F.col("role") == "test")
    # folds of loso_folds() are dealt by fold_id, and a task holds few of them: neither grouping shuffles rows
    per = folds.groupBy("fold_id", subject).agg((F.min("role") != F.max("role")).alias("_several"), test.alias("_tests"))
    fold = per.groupBy("fold_id").agg(F.count_if("_several").alias("_several"), F.sum("_tests").alias("_tests"), F.count(subject).alias("_members"))
    # in few tasks, for each hands on every subject once
    seen = folds.select(subject).coalesce(folds.sparkSession.sparkContext.defaultParallelism).distinct()
    n = seen.agg(F.count("*").alias("_all"), F.count(subject).alias("_n"))
    once = folds.where(F.col("role") == "test").groupBy(subject).agg(F.count("*").alias("_tested")).agg(F.count_if(F.col("_tested") == 1).alias("_once"))
    whole = fold.crossJoin(F.broadcast(n))
    sums = whole.agg(F.coalesce(F.sum("_several"), F.lit(0)).alias("several_roles"), F.count_if(F.col("_tests") != 1).alias("bad_folds"), F.count_if(F.col("_members") != F.col("_n")).alias("incomplete_folds"))
    return sums.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(once)).select("several_roles", "bad_folds", "incomplete_folds", (F.col("_all") - F.col("_once")).alias("bad_subjects"))


def fold_invariants(folds: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Per participant: valid blocks, tested blocks, blocks tested that don't exist, and whether the two agree."""
    b = blocks.select(*keys, "block").distinct().withColumn("_b", F.lit(1))
    f = folds.select(*keys, "block").distinct().withColumn("_f", F.lit(1))
    r = b.join(f, [*keys, "block"], "full").groupBy(*keys).agg(F.count("_b").alias("n_blocks"), F.count("_f").alias("n_tested"), F.count_if(F.col("_b").isNull()).alias("strangers"))
    return r.withColumn("complete", (F.col("n_blocks") == F.col("n_tested")) & (F.col("strangers") == 0))


def standardise_by_fold(features: DataFrame, folds: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """Features of every fold's members, scaled by its training members' mean and population SD (zero SD counts as 1)."""
    features = stored(features.select(subject, *columns), "features")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    j = folds.join(small(features), subject)
    train = F.col("role") == "train"
    s = j.groupBy("fold_id").agg(*[F.avg(F.when(train, F.col(c))).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(F.when(train, F.col(c))).alias(f"_s_{c}") for c in columns])
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(f"_s_{c}", F.lit(0.0)), F.lit(1.0))
    return j.join(small(stored(s, "scales")), "fold_id").select("fold_id", subject, "role", *[z(c).alias(c) for c in columns])


# ridge


def ridge_fit(df: DataFrame, keys: list[str], columns: list[str], y: str, alpha: float) -> DataFrame:
    """Centred ridge with a free intercept: one pass of cross-product sums per group, then a p x p solve each."""
    rows = df.dropna(subset=[*columns, y])
    sums = [F.count("*").alias("n"), F.sum(y).alias("sy")]
    sums += [F.sum(c).alias(f"s_{i}") for i, c in enumerate(columns)] + [F.sum(F.col(c) * F.col(y)).alias(f"y_{i}") for i, c in enumerate(columns)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"x_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    p = len(columns)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy(float)
            s = np.stack([b[f"s_{i}"] for i in range(p)], 1)
            cross = np.empty((len(b), p, p))
            for i in range(p):
                for j in range(i, p):
                    cross[:, i, j] = cross[:, j, i] = b[f"x_{i}_{j}"]
            cross = cross - s[:, :, None] * s[:, None, :] / n[:, None, None] + alpha * np.eye(p)
            right = np.stack([b[f"y_{i}"] for i in range(p)], 1) - s * (b["sy"].to_numpy(float) / n)[:, None]
            beta = np.linalg.solve(cross, right[:, :, None])[:, :, 0] if len(b) else np.zeros((0, p))
            out = b[keys].assign(n=b["n"], intercept=b["sy"] / n - (s * beta).sum(1) / n)
            for i, c in enumerate(columns):
                out[f"b_{c}"] = beta[:, i]
            yield out

    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", n long, intercept double, " + ", ".join(f"b_{c} double" for c in columns)
    return rows.groupBy(*keys).agg(*sums).mapInPandas(solve, schema)


def score_linear(df: DataFrame, model: DataFrame, keys: list[str], columns: list[str], name: str = "score") -> DataFrame:
    """Frozen scoring: intercept plus dot product, by a join on the model's keys."""
    j = df.join(model, keys)
    value = F.col("intercept")
    for c in columns:
        value = value + F.col(f"b_{c}") * F.col(c)
    return j.withColumn(name, value)


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cross products of (1, x, y) of each row, as n matrices."""
    d = np.column_stack([np.ones(len(y)), x, y])
    return d[:, :, None] * d[:, None, :]


def ridge_from_moments(m: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sums of cross products of many training sets: coefficients on standardised columns by alpha, means, SDs, mean of y."""
    p = m.shape[1] - 2
    n = m[:, 0, 0]
    mean, ybar = m[:, 0, 1:-1] / n[:, None], m[:, 0, -1] / n
    gram = m[:, 1:-1, 1:-1] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    right = m[:, 1:-1, -1] - n[:, None] * mean * ybar[:, None]
    var = np.maximum(np.diagonal(gram, axis1=1, axis2=2) / n[:, None], 0)
    sd = np.where(var <= 1e-20, 1.0, np.sqrt(var))
    gram = gram / (sd[:, :, None] * sd[:, None, :])
    beta = np.linalg.solve(gram[:, None] + alphas[:, None, None] * np.eye(p), np.broadcast_to((right / sd)[:, None, :, None], (len(m), len(alphas), p, 1)))[..., 0]
    return beta, mean, sd, ybar


def inner_errors(total: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray, same: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Squared errors of rows (x, y), each predicted without itself, summed for every alpha and each outer row that is left out.

    total: sums over all rows; left: cross products of the outer rows; same: (outer, inner) pairs that are one row.
    """
    own = moments(x, y)
    out = np.zeros((len(left), len(alphas)))
    step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
    for lo in range(0, len(left), step):
        part = total[None, None] - left[lo : lo + step, None] - own[None]
        beta, mean, sd, ybar = ridge_from_moments(part.reshape(-1, *total.shape), alphas)
        k = len(part)
        z = (np.tile(x, (k, 1)) - mean) / sd
        error = (np.tile(y, k) - ybar)[:, None] - (beta * z[:, None, :]).sum(-1)
        error = np.where(same[lo : lo + step].reshape(-1, 1), 0.0, error)
        out[lo : lo + step] = (error**2).reshape(k, len(y), -1).sum(1)
    return out


def nested_loso(features: DataFrame, subject: str, columns: list[str], y: str, alphas: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, subject, y, pred, m0, alpha): outer leave-one-out, inner choice of alpha, scaling inside each fold.

    Training sums are the total minus the rows left out. Every pair of an outer and an inner row is one small solve;
    pairs meet in cells of CELL_ROWS rows a side, whose errors are added up by outer row, so any number of subjects
    is exact. Groups of fewer than three subjects give no rows.
    """
    grid = np.sort(np.asarray(alphas, float))
    p, one = len(columns), [F.lit(0).alias("_all")] if not keys else []
    by = [*keys] if keys else ["_all"]
    kinds = {**dict(features.dtypes), "_all": "int"}
    clean = features.select(*keys, *one, F.col(subject).alias("subject"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)], F.col(y).cast("double").alias("y")).dropna()
    if keys and largest_group(clean, by) <= CELL_ROWS:  # many small groups: one cell each, without joins
        return nested_small(clean, by, p, grid, kinds, kinds[subject])
    # columns are centred and scaled by all rows first, which changes no prediction and keeps the sums well conditioned
    scale = clean.groupBy(*by).agg(F.count("*").alias("_n"), *[f(f"_x{i}").alias(f"_{m}{i}") for i in range(p) for m, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [((F.col(f"_x{i}") - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0)).alias(f"_x{i}") for i in range(p)]
    rows = clean.join(scale.where("_n > 2"), by).select(*by, "subject", "y", "_n", *z)
    d = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(p)], F.col("y")]
    sums = rows.groupBy(*by).agg(F.array(*[F.sum(a * b) for a in d for b in d]).alias("_total"))
    cells = F.ceil(F.col("_n") / CELL_ROWS).cast("int")
    rows = rows.join(sums, by).withColumns({"_cells": cells, "_cell": F.pmod(F.xxhash64("subject"), cells).cast("int"), "_h": F.xxhash64("subject")})
    every = F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))
    outer = rows.withColumn("_inner", every).withColumnRenamed("_cell", "_outer")
    names = [f"_x{i}" for i in range(p)]
    # columns of names of their own: both sides come from one table
    inner = rows.select(*[F.col(c).alias(f"_i{c}") for c in [*by, "subject", "y", *names]], F.col("_cell").alias("_i_inner"), every.alias("_i_outer"))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*by, "subject", "_sse"])
        xa, ya, total = a[names].to_numpy(float), a["y"].to_numpy(float), np.asarray(a["_total"].iloc[0]).reshape(p + 2, p + 2)
        same = a["subject"].to_numpy()[:, None] == b["_isubject"].to_numpy()[None, :]
        sse = inner_errors(total, moments(xa, ya), b[[f"_i{c}" for c in names]].to_numpy(float), b["_iy"].to_numpy(float), same, grid)
        return a[[*by, "subject"]].assign(_sse=list(sse))

    key_schema = ", ".join(f"{k} {kinds[k]}" for k in by)
    kind = kinds[subject]
    outer_keys, inner_keys = [*by, "_outer", "_inner"], [*[f"_i{k}" for k in by], "_i_outer", "_i_inner"]
    errors = spread_by(outer, *outer_keys).groupBy(*outer_keys).cogroup(spread_by(inner, *inner_keys).groupBy(*inner_keys)).applyInPandas(cell, f"{key_schema}, subject {kind}, _sse array<double>")
    summed = errors.groupBy(*by, "subject").agg(F.array(*[F.sum(F.get("_sse", i)) for i in range(len(grid))]).alias("_sse"))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*by, "subject", "y"]].assign(pred=np.nan, m0=np.nan, alpha=np.nan)
            if len(b):
                x, t = b[names].to_numpy(float), b["y"].to_numpy(float)
                total = np.stack([np.asarray(v).reshape(p + 2, p + 2) for v in b["_total"]])
                choice = np.argmin(np.round(np.stack(b["_sse"].to_list()) / (b["_n"].to_numpy(float) - 1)[:, None], 12), axis=1)
                beta, mean, sd, ybar = ridge_from_moments(total - moments(x, t), grid)
                own = beta[np.arange(len(b)), choice]
                out = out.assign(pred=((x - mean) / sd * own).sum(1) + ybar, m0=ybar, alpha=grid[choice])
            yield out

    found = rows.join(summed, [*by, "subject"]).select(*by, "subject", "y", "_n", "_total", "_sse", *names)
    return found.mapInPandas(predict, f"{key_schema}, subject {kind}, y double, pred double, m0 double, alpha double").select(*keys, "subject", "y", "pred", "m0", "alpha")


def nested_small(clean: DataFrame, by: list[str], p: int, grid: np.ndarray, kinds: dict[str, str], kind: str) -> DataFrame:
    """nested_loso() of groups that are one cell each; a task takes them one after another."""
    names = [f"_x{i}" for i in range(p)]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[names].to_numpy(float), group["y"].to_numpy(float)
        sd = x.std(0)
        x = (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)
        own = moments(x, y)
        total, same = own.sum(0), np.eye(len(y), dtype=bool)
        sse = inner_errors(total, own, x, y, same, grid)
        choice = np.argmin(np.round(sse / (len(y) - 1), 12), axis=1)
        beta, mean, sd, ybar = ridge_from_moments(total - own, grid)
        pred = ((x - mean) / sd * beta[np.arange(len(y)), choice]).sum(1) + ybar
        return group[[*by, "subject", "y"]].assign(pred=pred, m0=ybar, alpha=grid[choice])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, starts in whole_groups(batches, by, 4 * CELL_ROWS):
            ends = np.append(starts[1:], len(part))
            found = [one(part.iloc[a:b]) for a, b in zip(starts, ends, strict=True) if b - a > 2]
            if found:
                yield pd.concat(found)

    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + f", subject {kind}, y double, pred double, m0 double, alpha double"
    return spread_by(clean, *by).sortWithinPartitions(*by, "subject").mapInPandas(run, schema)


def model_ladder(features: DataFrame, subject: str, specs: dict[str, tuple[list[str], str]], alphas: list[float]) -> DataFrame:
    """Held-out predictions of several feature blocks and targets."""
    out = None
    for name, (columns, y) in specs.items():
        one = nested_loso(features, subject, columns, y, alphas).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def q2_of(y: str, pred: str, m0: str) -> Column:
    """1 - squared error of the predictions over that of the training means."""
    return 1 - F.sum((F.col(y) - F.col(pred)) ** 2) / F.greatest(F.sum((F.col(y) - F.col(m0)) ** 2), F.lit(1e-300))


def seed_of(*parts: object) -> int:
    """The seed of a group: the first 8 hex digits of SHA-256."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def permutation_null(features: DataFrame, subject: str, columns: list[str], y: str, alphas: list[float], n: int, seed: int) -> DataFrame:
    """Q2 of the whole nested validation with y permuted over subjects, one row per replicate; replicate -1 is unpermuted.

    In a replicate, the subject at place i in order of SHA-256 of seed:replicate:subject gets the y of the subject at place i in order of id.
    """
    rows = stored(features.select(subject, *columns, F.col(y).alias("y")).dropna(), "permuted")
    placed = canonical_positions(rows, [subject])
    dealt = rows.select(subject, *columns, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col("replicate"), F.col(subject)), 256)
    dealt = dealt.withColumn("position", F.row_number().over(Window.partitionBy("replicate").orderBy(order, subject)).cast("long"))
    permuted = dealt.join(placed.select("position", "y"), "position").select("replicate", subject, *columns, "y")
    both = permuted.unionByName(rows.select(F.lit(-1).alias("replicate"), subject, *columns, "y"))
    return nested_loso(both, subject, columns, "y", alphas, ("replicate",)).groupBy("replicate").agg(q2_of("y", "pred", "m0").alias("q2"))


def null_summary(null: DataFrame) -> DataFrame:
    """Observed Q2, p = (1 + number at least as large) / (1 + B), and the null's mean, SD and quantiles."""
    seen = null.where("replicate = -1").select(F.col("q2").alias("observed"))
    rest = null.where("replicate >= 0")
    return rest.join(F.broadcast(seen)).groupBy("observed").agg(F.count("*").alias("b"), ((1 + F.count_if(F.col("q2") >= F.col("observed"))) / (1 + F.count("*"))).alias("p"), F.avg("q2").alias("null_mean"), F.stddev_samp("q2").alias("null_sd"), F.percentile("q2", F.lit(0.95)).alias("null_p95"))


# resampling


def drawn(seed: int, replicate: Column, k: Column, n: Column) -> Column:
    """The k-th position (0 to n - 1) of a replicate, from SHA-256 of seed:replicate:k, so that SQL can draw the same."""
    head = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), replicate, k), 256), 1, 8)
    return F.conv(head, 16, 10).cast("long") % n


def resampled(df: DataFrame, order: str, columns: list[str], n: int, seed: int) -> DataFrame:
    """(replicate, columns): n replicates of as many rows as df has, drawn with replacement by position in `order`."""
    placed = canonical_positions(df.select(order, *columns).dropna(), [order]).select(*columns, (F.col("position") - 1).alias("_i"))
    rows = df.select(order, *columns).dropna().count()
    ids = df.sparkSession.range(0, n * rows)
    replicate, k = F.floor(F.col("id") / max(1, rows)), F.col("id") % max(1, rows)
    places = ids.select(replicate.alias("replicate"), drawn(seed, replicate, k, F.lit(rows)).alias("_i"))
    return places.join(placed, "_i").select("replicate", *columns)


def bootstrap_statistic(df: DataFrame, order: str, columns: list[str], statistic: Column, n: int, seed: int) -> DataFrame:
    """(replicate, value): an aggregate over rows drawn with replacement."""
    return resampled(df, order, columns, n, seed).groupBy("replicate").agg(statistic.alias("value"))


def bootstrap_rank_correlation(df: DataFrame, order: str, a: str, b: str, n: int, seed: int) -> DataFrame:
    """(replicate, value): rank correlation of rows drawn with replacement; ties share their mean rank."""
    rows = resampled(df, order, [a, b], n, seed)
    for c in (a, b):
        least = F.rank().over(Window.partitionBy("replicate").orderBy(c))
        rows = rows.withColumn(f"_r_{c}", least + (F.count("*").over(Window.partitionBy("replicate", c)) - 1) / 2)
    return rows.groupBy("replicate").agg(F.corr(f"_r_{a}", f"_r_{b}").alias("value")).select("replicate", F.nanvl("value", F.lit(None)).alias("value"))


def interval(boot: DataFrame, level: float = 0.95) -> DataFrame:
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return boot.agg(F.count("value").alias("b"), F.avg("value").alias("mean"), F.percentile("value", F.lit(lo)).alias("lower"), F.percentile("value", F.lit(hi)).alias("upper"))


def paired_bootstrap_ci(deltas: DataFrame, subject: str, delta: str, n: int, seed: int) -> DataFrame:
    """Interval of the mean delta; reliable where it leaves zero out."""
    ci = interval(bootstrap_statistic(deltas, subject, [delta], F.avg(delta), n, seed))
    return ci.withColumn("reliable", F.when(F.col("upper") < 0, "lower").when(F.col("lower") > 0, "higher").otherwise("none"))


def score_intervals(pred: DataFrame, order: str, y: str, p: str, m0: str, n: int, seed: int) -> DataFrame:
    """(score, b, mean, lower, upper) of Q2, the skill of the mean absolute error, and the rank correlation, over rows drawn with replacement."""
    error, base = F.abs(F.col(y) - F.col(p)), F.abs(F.col(y) - F.col(m0))
    skill = 1 - F.sum(error) / F.greatest(F.sum(base), F.lit(1e-300))
    boots = {
        "q2": bootstrap_statistic(pred, order, [y, p, m0], q2_of(y, p, m0), n, seed),
        "mae_skill": bootstrap_statistic(pred, order, [y, p, m0], skill, n, seed),
        "rho": bootstrap_rank_correlation(pred, order, y, p, n, seed),
    }
    return reduce(DataFrame.unionByName, [interval(b).select(F.lit(k).alias("score"), "b", "mean", "lower", "upper") for k, b in boots.items()])


#: Targets of a subject's two sessions: the statistic of a session's rows and of drawn values by replicate, and whether the log ratio is of perturbation to baseline.
TARGETS = {"rt": (lambda c: F.median(c), lambda x: np.median(x, axis=1), True), "speed": (lambda c: F.avg(F.lit(1.0) / F.col(c)), lambda x: np.mean(1 / x, axis=1), False)}


def drawn_places(prefix: bytes, replicates: range, draws: int, size: int) -> np.ndarray:
    """(replicates, draws): places from 0 to size - 1, from SHA-256 of prefix:replicate:k for k from 0 to draws - 1."""
    heads, ks, sha = [b"%b:%d:" % (prefix, r) for r in replicates], [b"%d" % k for k in range(draws)], hashlib.sha256
    digests = b"".join([sha(head + k).digest() for head in heads for k in ks])
    return (np.frombuffer(digests, ">u4")[::8].astype(np.int64) % size).reshape(len(heads), draws)


def of_draws(values: np.ndarray, prefix: str, draws: int, n: int, statistic: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A statistic of each of n replicates of `draws` drawn values, DRAWS_AT_ONCE of them or a replicate at once."""
    step = max(1, DRAWS_AT_ONCE // draws)
    return np.concatenate([statistic(values[drawn_places(prefix.encode(), range(lo, min(n, lo + step)), draws, len(values))]) for lo in range(0, n, step)])


def for_each_row(df: DataFrame, key: str, f: Callable[..., tuple], names: list[str]) -> DataFrame:
    """(key, names): what f says of the other columns of each row, lists as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = lambda c: [x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) else x.as_py() for x in c]
            out = [f(*row) for row in zip(*map(cells, b.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[i] for o in out], pa.float64()) for i in range(len(names))]], [key, *names])

    return df.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"{c} double" for c in names))


def trial_bootstrap(trials: DataFrame, subject: str, base: str, pert: str, n: int, seed: int, target: str = "rt") -> DataFrame:
    """SE and interval of a target per subject, trials resampled within sessions: the log ratio of medians (rt) or of mean speeds (speed, baseline to perturbation).

    A draw is a place among the session's trials in order of time, from SHA-256 of seed:subject:session:replicate:k. A subject's
    sessions are two lists from which its row draws, so draws are not shuffled; sessions of more than DRAW_ROWS trials are joined to their draws.
    """
    statistic, of_list, upward = TARGETS[target]
    rows = trials.select(F.col(subject).alias("subject"), "session", "rt").where("rt > 0").where(F.col("session").isin(base, pert))
    sizes = rows.groupBy("subject", "session").agg(F.count("*").alias("_n"), statistic("rt").alias("value"))
    of = lambda session, what: F.max(F.when(F.col("session") == session, F.col(what)))
    ratio = F.ln(of(pert, "value") / of(base, "value")) if upward else F.ln(of(base, "value") / of(pert, "value"))
    both = sizes.groupBy("subject").agg(of(base, "_n").alias("n_base"), of(pert, "_n").alias("n_pert"), ratio.alias("y")).where("n_base > 1 and n_pert > 1")
    large = F.greatest("n_base", "n_pert") > DRAW_ROWS
    some_large = not both.where(large).isEmpty()

    few = rows.join(both.where(~large).select("subject"), "subject", "left_semi") if some_large else rows
    at = lambda session: F.sort_array(F.collect_list(F.when(F.col("session") == session, F.col("rt").cast("double"))))
    lists = spread_by(few, "subject").groupBy("subject").agg(at(base).alias("_base"), at(pert).alias("_pert")).where("size(_base) > 1 and size(_pert) > 1")
    prefix = lambda session: F.concat_ws(":", F.lit(seed), "subject", F.lit(session))

    def one(b: np.ndarray, p: np.ndarray, at_base: str, at_pert: str) -> tuple:
        b, p = of_draws(b, at_base, len(b), n, of_list), of_draws(p, at_pert, len(p), n, of_list)
        v = np.log(p / b) if upward else np.log(b / p)
        return (float(v.std(ddof=1)), *map(float, np.quantile(v, [0.025, 0.975])))

    spread = for_each_row(lists.select("subject", "_base", "_pert", prefix(base).alias("_at0"), prefix(pert).alias("_at1")), "subject", one, ["se", "lower", "upper"])
    if some_large:
        by = ["subject", "session"]
        many = rows.join(both.where(large).select("subject"), "subject", "left_semi")
        placed = many.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("rt")) - 1)
        k = sizes.join(both.where(large).select("subject"), "subject", "left_semi").select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
        values = drawn_rows(k, by, F.concat_ws(":", F.lit(seed), *by), "_n", "_n", placed).groupBy(*by, "replicate").agg(statistic("rt").alias("value"))
        ratios = values.groupBy("subject", "replicate").agg(ratio.alias("v"))
        spread = spread.unionByName(ratios.groupBy("subject").agg(F.stddev_samp("v").alias("se"), F.percentile("v", F.lit(0.025)).alias("lower"), F.percentile("v", F.lit(0.975)).alias("upper")))
    return both.join(spread, "subject")


def drawn_rows(asked: DataFrame, by: list[str], prefix: Column, draws: str, places: str, values: DataFrame) -> DataFrame:
    """Rows of values at the drawn places (_i) of each asked replicate: a join, for lists too long to be one."""
    k = spread_by(asked, *by, "replicate").select("*", prefix.alias("_prefix")).select("*", F.explode(F.sequence(F.lit(0), F.col(draws).cast("int") - 1)).alias("_k"))
    head = F.substring(F.sha2(F.concat_ws(":", "_prefix", "replicate", "_k"), 256), 1, 8)
    chosen = k.withColumn("_i", (F.conv(head, 16, 10).cast("long") % F.col(places)).cast("int")).drop("_prefix", "_k")
    return chosen.join(values, [*by, "_i"])


def cohort_reliability(boot: DataFrame) -> DataFrame:
    """What trial_bootstrap() says of a cohort: subjects, mean SE, SD of the targets, their ratio, share of intervals without zero."""
    apart = (F.col("lower") > 0) | (F.col("upper") < 0)
    s = boot.agg(F.count("*").alias("n"), F.avg("se").alias("mean_se"), F.stddev_samp("y").alias("sd_y"), F.avg(apart.cast("int")).alias("share_apart"))
    return s.select("n", "mean_se", "sd_y", F.try_divide(F.col("mean_se"), F.col("sd_y")).alias("se_over_sd"), "share_apart")


def block_lengths(events: DataFrame, key: str, t: str, quantum: float) -> DataFrame:
    """(key, block): twice the median interval between a recording's events, in quanta, rounded up; 1 at least."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    gaps = events.where(F.col(t).isNotNull()).select(F.col(key).alias("key"), gap.alias("gap"))
    return gaps.groupBy("key").agg(F.greatest(F.coalesce(F.ceil(2 * F.median("gap") / quantum), F.lit(1)), F.lit(1)).cast("int").alias("block"))


def long_recordings(sizes: DataFrame, placed: DataFrame, n: int, seed: int) -> DataFrame:
    """moving_block_bootstrap()'s intervals of recordings that are joined to their draws."""
    values = placed.where(F.col("_i") <= F.col("n") - F.col("block")).select("key", "_i", F.lit(0).alias("kind"), F.col("_sum").alias("v")).unionByName(placed.select("key", "_i", F.lit(1).alias("kind"), F.col("x").alias("v")))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.ceil(F.col("n") / F.col("block")).cast("int").alias("draws"), (F.col("n") - F.col("block") + 1).alias("places")), F.struct(F.lit(1).alias("kind"), F.col("n").alias("draws"), F.col("n").alias("places"))))
    asked = sizes.select("key", "block", kinds.alias("g")).select("key", "block", "g.*").select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    means = drawn_rows(asked, ["key", "kind"], F.concat_ws(":", F.lit(seed), "kind", "key"), "draws", "places", values).groupBy("key", "kind", "replicate").agg((F.sum("v") / F.max("draws") / F.max(F.when(F.col("kind") == 0, F.col("block")).otherwise(1))).alias("m"))
    ends = means.groupBy("key", "kind").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    of = lambda kind, what: F.max(F.when(F.col("kind") == kind, F.col(what)))
    return ends.groupBy("key").agg(of(0, "lo").alias("lower"), of(0, "hi").alias("upper"), of(1, "lo").alias("iid_lower"), of(1, "hi").alias("iid_upper"))


def moving_block_bootstrap(df: DataFrame, key: str, order: str, x: str, block: int | DataFrame, n: int, seed: int) -> DataFrame:
    """Interval of a recording's mean under blocks of rows and under single rows, and the ratio of their widths.

    block: the rows of a block, or a table (key, block) such as block_lengths() gives; recordings without one have none.

    A draw is a place in the recording, from SHA-256 of seed:kind:key:replicate:k, kind 0 for blocks and 1 for rows. A recording
    is a list from which its row draws, so draws are not shuffled; one of more than DRAW_ROWS rows is joined to its draws.
    """
    rows = spread_by(df.select(F.col(key).alias("key"), order, F.col(x).alias("x")).dropna(), "key")
    sizes = rows.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.avg("x").alias("mean"))
    sizes = sizes.withColumn("_asked", F.lit(block)) if isinstance(block, int) else sizes.join(block.select("key", F.col("block").alias("_asked")), "key")
    sizes = sizes.select("key", "n", "mean", F.least("_asked", "n").alias("block"))
    w = Window.partitionBy("key").orderBy(order)
    placed = rows.join(sizes.select("key", "n", "block"), "key").withColumn("_i", F.row_number().over(w) - 1)
    if isinstance(block, int):
        placed = placed.withColumn("_sum", F.sum("x").over(w.rowsBetween(0, block - 1)))
    else:  # blocks of a recording's own length: a difference of running sums
        run = placed.withColumn("_run", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        last = run.select("key", (F.col("_i") - F.col("block") + 1).alias("_i"), F.col("_run").alias("_to"))
        placed = run.join(last, ["key", "_i"], "left").withColumn("_sum", F.col("_to") - F.col("_run") + F.col("x"))
    cells = F.array_sort(F.collect_list(F.struct("_i", F.col("x").cast("double").alias("x"), F.col("_sum").cast("double").alias("_sum"))))
    lists = placed.where(F.col("n") <= DRAW_ROWS).groupBy("key", "n", "block").agg(cells.alias("_c"))
    prefix = lambda kind: F.concat_ws(":", F.lit(seed), F.lit(kind), "key")

    def one(x: np.ndarray, sums: np.ndarray, block: int, at_blocks: str, at_rows: str) -> tuple:
        total = lambda v: v.sum(axis=1)
        draws = -(-len(x) // block)
        blocks = of_draws(sums[: len(x) - block + 1], at_blocks, draws, n, total) / draws / block
        return (*map(float, np.quantile(blocks, [0.025, 0.975])), *map(float, np.quantile(of_draws(x, at_rows, len(x), n, total) / len(x), [0.025, 0.975])))

    lists = lists.select("key", F.transform("_c", lambda c: c["x"]).alias("_x"), F.transform("_c", lambda c: c["_sum"]).alias("_s"), "block", prefix(0).alias("_at0"), prefix(1).alias("_at1"))
    wide = for_each_row(lists, "key", one, ["lower", "upper", "iid_lower", "iid_upper"])
    if not sizes.where(F.col("n") > DRAW_ROWS).isEmpty():
        wide = wide.unionByName(long_recordings(sizes.where(F.col("n") > DRAW_ROWS), placed.where(F.col("n") > DRAW_ROWS), n, seed))
    ratio = F.when(F.col("iid_upper") > F.col("iid_lower"), (F.col("upper") - F.col("lower")) / (F.col("iid_upper") - F.col("iid_lower")))
    return sizes.join(wide, "key").select("key", F.col("n").cast("long").alias("n"), "block", "mean", "lower", "upper", "iid_lower", "iid_upper", ratio.alias("width_ratio"))


def iaaft_rows(v: np.ndarray, out: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Series with the values of the rows of v and nearly their spectra, from permutations of these rows."""
    amplitude, ordered = np.abs(np.fft.rfft(v)), np.sort(v)
    out, left = out.copy(), np.arange(len(v))
    for _ in range(rounds):
        shaped = np.fft.irfft(amplitude[left] * np.exp(1j * np.angle(np.fft.rfft(out[left]))), v.shape[1])
        ranks = np.argsort(np.argsort(shaped, kind="stable"), kind="stable")
        fresh = np.take_along_axis(ordered[left], ranks, 1)
        moved = (fresh != out[left]).any(axis=1)
        out[left] = fresh
        left = left[moved]
        if not len(left):
            break
    return out


def iaaft(v: np.ndarray, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """A series with the values of v and nearly its spectrum."""
    return iaaft_rows(v[None], rng.permutation(v)[None], rounds)[0]


def blockwise_iaaft(series: DataFrame, keys: list[str], order: str, x: str, k: int, seed: int, stretch: int = STRETCH) -> DataFrame:
    """k surrogates of every block (keys end with the block), each block on its own, in stretches of at most `stretch` rows.

    A task takes its blocks in order and makes the surrogates of all blocks of one length at once.
    """
    fields = dict(series.dtypes)
    by = [*keys, "_stretch"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    cut = series.select(*keys, order, x).dropna().withColumn("_stretch", F.floor(place / stretch).cast("int"))

    def surrogates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, starts in whole_groups(batches, by):
            values, sizes = part[x].to_numpy(float), np.diff(np.append(starts, len(part)))
            names = part[by].iloc[starts].to_numpy().tolist()
            made = np.empty((k, len(part)))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                at = starts[own][:, None] + np.arange(size)
                v = values[at]
                rngs = [np.random.default_rng(seed_of(seed, int(names[i][-1]), *names[i][:-1])) for i in own]
                first = np.stack([[rng.permutation(row) for _ in range(k)] for rng, row in zip(rngs, v, strict=True)])
                found = iaaft_rows(np.repeat(v, k, axis=0), first.reshape(-1, size)).reshape(len(own), k, size)
                for i in range(k):
                    made[i, at] = found[:, i]
            for i in range(k):
                yield part[keys].assign(replicate=i, **{order: part[order], "surrogate": made[i]})

    schema = ", ".join(f"{c} {fields[c]}" for c in keys) + f", replicate int, {order} {fields[order]}, surrogate double"
    return spread_by(cut, *by).sortWithinPartitions(*by, order).mapInPandas(surrogates, schema)


def block_sums(series: DataFrame, key: str, columns: list[str], y: str) -> DataFrame:
    """Sums of cross products of (1, columns, y) for each (key, block): a small square matrix each, whatever the rows."""
    d = [F.lit(1.0), *[F.col(c).cast("double") for c in [*columns, y]]]
    rows = series.select(key, "block", *columns, y).dropna()
    return rows.groupBy(key, "block").agg(F.array(*[F.sum(a * b) for a in d for b in d]).alias("_sums"))


def fold_scores(beta: np.ndarray, test: np.ndarray) -> tuple[float | None, float]:
    """Correlation and RMSE of predictions beta (intercept first) on rows known by their sums of cross products."""
    n, ysum, yy = test[0, 0], test[0, -1], test[-1, -1]
    inner = test[:-1, :-1]
    psum, pp, py = beta @ inner[:, 0], beta @ inner @ beta, beta @ test[:-1, -1]
    vy, vp = yy - ysum**2 / n, pp - psum**2 / n
    r = float((py - psum * ysum / n) / np.sqrt(vy * vp)) if vy > 1e-12 * yy and vp > 1e-12 * pp else None
    return r, float(np.sqrt(max(yy - 2 * py + pp, 0) / n))


def per_block_fold(series: DataFrame, key: str, fit: Callable[[np.ndarray, np.ndarray, int], tuple], columns: list[str], y: str, extra: str) -> DataFrame:
    """fit(sums of every block, total, left-out block) for each (participant, block). Only block sums are grouped, never rows."""
    kind = dict(series.dtypes)[key]
    p = len(columns) + 2
    names = ["key", "fold", "n_train", "n_test", *[c.split()[0] for c in extra.split(", ")]]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        grams = np.stack([np.asarray(v).reshape(p, p) for v in part["_sums"]])
        total, rows = grams.sum(0), []
        for i, block in enumerate(part["block"].tolist()):
            n_test = int(grams[i, 0, 0])
            n_train = int(total[0, 0]) - n_test
            if n_train > 3:
                rows.append((part[key].iloc[0], block, n_train, n_test, *fit(grams, total, i)))
        return pd.DataFrame(rows, columns=names)

    return spread_by(block_sums(series, key, columns, y), key).groupBy(key).applyInPandas(one, f"key {kind}, fold long, n_train long, n_test long, {extra}")


def block_cv_pca_ols(series: DataFrame, key: str, columns: list[str], y: str, least: float = 0.01) -> DataFrame:
    """Leave one block out: principal components of the training part with at least 1 % of its variance, then OLS.

    Components come from the training correlation matrix, total minus block; their scores are uncorrelated, so OLS on
    them is one division each.
    """

    def fit(grams: np.ndarray, total: np.ndarray, i: int) -> tuple:
        m = total - grams[i]
        n, mean, ybar = m[0, 0], m[0, 1:-1] / m[0, 0], m[0, -1] / m[0, 0]
        cov = m[1:-1, 1:-1] - n * np.outer(mean, mean)
        var = np.maximum(np.diagonal(cov) / n, 0)
        sd = np.where(var <= 1e-20 * np.maximum(mean**2, 1), 1.0, np.sqrt(var))
        values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        keep = values / max(values.sum(), 1e-300) >= least
        right = (m[1:-1, -1] - n * mean * ybar) / sd
        slope = vectors[:, keep] @ (vectors[:, keep].T @ right / values[keep]) / sd
        return int(keep.sum()), *fold_scores(np.append(ybar - slope @ mean, slope), grams[i])

    return per_block_fold(series, key, fit, columns, y, "components int, r double, rmse double")


def floating_forward_selection(series: DataFrame, key: str, columns: list[str], y: str, most: int) -> DataFrame:
    """Column subset per outer fold by inner leave-one-block-out RMSE, dropping columns again where that helps.

    A candidate subset costs a small solve for each inner fold: the outer training sums minus the inner block's.
    """

    def fit(blocks: np.ndarray, whole: np.ndarray, i: int) -> tuple:
        grams, total, last = np.delete(blocks, i, axis=0), whole - blocks[i], whole.shape[0] - 1
        train = total - grams if len(grams) > 1 else grams

        def errors(subsets: list[tuple[int, ...]]) -> list[float]:
            """Of subsets of one size, all solved at once."""
            at = np.array([[0, *[c + 1 for c in subset]] for subset in subsets])
            square = (at[:, None, :, None], at[:, None, None, :])
            fold = np.arange(len(grams))[None, :, None, None]
            inverse = np.linalg.pinv(train[fold, *square] + 1e-9 * np.eye(at.shape[1]), rcond=at.shape[1] * np.finfo(float).eps, hermitian=True)
            across = (np.arange(len(grams))[None, :, None], at[:, None, :], last)
            beta = (inverse @ train[across][..., None])[..., 0]
            sse = grams[None, :, last, last] - 2 * (beta * grams[across]).sum(-1) + np.einsum("ski,skij,skj->sk", beta, grams[fold, *square], beta)
            return np.sqrt(np.maximum(sse.sum(1), 0) / grams[:, 0, 0].sum()).tolist()

        def least(subsets: list[tuple[int, ...]]) -> tuple[float, tuple[int, ...]]:
            return min(zip(errors(subsets), subsets, strict=True))

        chosen: tuple[int, ...] = ()
        best = {0: least([()])}
        while len(chosen) < min(most, last - 1):
            e, chosen = least([(*chosen, c) for c in range(last - 1) if c not in chosen])
            best[len(chosen)] = min(best.get(len(chosen), (e, chosen)), (e, chosen))
            while len(chosen) > 2:
                e, less = least([tuple(c for c in chosen if c != out) for out in chosen])
                if e >= best[len(less)][0] - 1e-12:
                    break
                best[len(less)], chosen = (e, less), less
        subset = min(best.values(), key=lambda b: (round(b[0], 12), len(b[1])))[1]
        at = [0, *[c + 1 for c in subset]]
        beta = np.zeros(last)
        beta[at] = np.linalg.lstsq(total[np.ix_(at, at)], total[at, last], rcond=None)[0]
        return [columns[c] for c in sorted(subset)], *fold_scores(beta, blocks[i])

    return per_block_fold(series, key, fit, columns, y, "selected array<string>, r double, rmse double")


def finite_sample_dispersion(df: DataFrame, row: str, x: str, sizes: list[int], seed: int) -> DataFrame:
    """Bias and spread of the SD of k values, over groups that a hash order deals from the rows, next to sigma / sqrt(2 (k - 1))."""
    rows = df.select(row, F.col(x).alias("x")).dropna().withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(row)), 256))
    placed = canonical_positions(rows, ["_h", row])
    sigma = rows.agg(F.stddev_samp("x").alias("sigma"), F.count("*").alias("rows"))
    groups = placed.select("x", (F.col("position") - 1).alias("i"), F.explode(F.array(*map(F.lit, sizes))).alias("k")).groupBy("k", F.floor(F.col("i") / F.col("k")).alias("g"))
    spread = groups.agg(F.stddev_samp("x").alias("sd"), F.count("*").alias("n")).where("n = k").groupBy("k").agg(F.count("*").alias("n"), F.avg("sd").alias("sd"), F.stddev_samp("sd").alias("spread"))
    return spread.join(F.broadcast(sigma)).select("k", "n", (F.col("sd") - F.col("sigma")).alias("bias"), "spread", (F.col("sigma") / F.sqrt(2.0 * (F.col("k") - 1))).alias("analytic"))


def grouped_grid_search(df: DataFrame, keys: list[str], role: str, columns: list[str], y: str, alphas: list[float]) -> DataFrame:
    """alpha per group by mean squared error on validation rows (ties: the smaller), with that error.

    One pass adds up the cross products of training and of validation rows; columns are centred and scaled first, so that
    the sums are well conditioned. One eigendecomposition of a group's training matrix serves the whole grid, and
    validation errors come from the validation sums.
    """
    p, grid = len(columns), np.sort(np.asarray(alphas, float))
    rows = df.dropna(subset=[*columns, y]).where(F.col(role).isin("train", "validation"))
    kinds = dict(df.dtypes)
    names = [*columns, y]
    # shifted by a value of the table, not by the mean: that would be a pass of its own
    shift = rows.select(*names).limit(1).agg(*[F.coalesce(F.first(F.col(c).cast("double")), F.lit(0.0)).alias(f"_c{i}") for i, c in enumerate(names)])
    d = [F.lit(1.0), *[F.col(c).cast("double") - F.col(f"_c{i}") for i, c in enumerate(names)]]
    of = lambda name: F.array(*[F.coalesce(F.sum(F.when(F.col(role) == name, a * b)), F.lit(0.0)) for a in d for b in d])
    sums = rows.join(F.broadcast(shift)).groupBy(*keys).agg(of("train").alias("_train"), of("validation").alias("_held"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            train, held = (np.stack(b[c].to_list()).reshape(-1, p + 2, p + 2) for c in ("_train", "_held"))
            ok = (train[:, 0, 0] > 0) & (held[:, 0, 0] > 0)
            b, train, held = b[ok], train[ok], held[ok]
            n, m = train[:, 0, 0], held[:, 0, 0]
            mean, ybar = train[:, 0, 1:-1] / n[:, None], train[:, 0, -1] / n
            gram = train[:, 1:-1, 1:-1] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
            right = train[:, 1:-1, -1] - n[:, None] * mean * ybar[:, None]
            values, vectors = np.linalg.eigh(gram)
            turned = np.einsum("gji,gj->gi", vectors, right)
            beta = np.einsum("gij,gaj->gai", vectors, turned[:, None] / (np.maximum(values, 0)[:, None] + grid[None, :, None]))
            # held sums about the training means
            at = held[:, 0, 1:-1] - m[:, None] * mean
            xx = held[:, 1:-1, 1:-1] - held[:, 0, 1:-1, None] * mean[:, None] - mean[:, :, None] * held[:, 0, None, 1:-1] + m[:, None, None] * mean[:, :, None] * mean[:, None]
            xy = held[:, 1:-1, -1] - mean * held[:, 0, -1, None] - at * ybar[:, None]
            yy = held[:, -1, -1] - 2 * ybar * held[:, 0, -1] + m * ybar**2
            sse = yy[:, None] - 2 * np.einsum("gai,gi->ga", beta, xy) + np.einsum("gai,gij,gaj->ga", beta, xx, beta)
            mse = np.round(np.maximum(sse, 0) / m[:, None], 9)
            yield b[keys].assign(alpha=grid[mse.argmin(axis=1)], mse=mse.min(axis=1))

    return sums.mapInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", alpha double, mse double")


# projection, shift and verdicts


def project_to_grid(values: DataFrame, weights: DataFrame, keys: list[str], channel: str, value: str) -> DataFrame:
    """weights (cell, channel, w): weighted sum of channel values in each cell."""
    return values.join(F.broadcast(weights) if weights.count() <= 100_000 else weights, channel).groupBy(*keys, "cell").agg(F.sum(F.col("w") * F.col(value)).alias("value"))


def normalization_shift(target: DataFrame, source: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """Batch means and SDs against source statistics, per channel in source SDs, averaged over channels."""
    j = target.join(source.select(channel, F.col("mean").alias("sm"), F.col("sd").alias("ss")), channel)
    return j.groupBy(*keys).agg(F.avg(F.abs(F.col("mean") - F.col("sm")) / F.nullif("ss", F.lit(0.0))).alias("mean_shift"), F.avg(F.abs(F.ln(F.nullif("sd", F.lit(0.0))) - F.ln(F.nullif("ss", F.lit(0.0))))).alias("log_sd_shift"))


def shift_against_change(shift: DataFrame, change: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """How a statistics shift (x) goes with a change of accuracy (y) over units: units with both, r, rank correlation, slope of y on x."""
    j = shift.select(*keys, F.col(x).cast("double").alias("x")).join(change.select(*keys, F.col(y).cast("double").alias("y")), keys).where("x is not null and y is not null")
    ranked = average_ranks(average_ranks(j, [], "x", "rx"), [], "y", "ry")
    s = ranked.agg(F.count("*").alias("n"), safe_corr("x", "y").alias("r"), safe_corr("rx", "ry").alias("rho"), F.regr_slope("y", "x").alias("slope"))
    return s.select("n", *[F.when(F.col("n") >= 3, F.col(c)).alias(c) for c in ("r", "rho", "slope")])


def collapse_verdict(stats: DataFrame, degraded: Column, concentrated: Column, harmed_share: Column, limit: float) -> DataFrame:
    """Flags and the first case that holds: collapse, degraded, concentrated only, none; heterogeneous overrides none."""
    both = degraded & concentrated
    case = F.when(both, "collapse").when(degraded, "degraded").when(concentrated, "concentrated").when(harmed_share >= limit, "heterogeneous").otherwise("none")
    return stats.select("*", degraded.alias("is_degraded"), concentrated.alias("is_concentrated"), both.alias("is_collapsed"), case.alias("verdict"))


def eligibility_verdict(checks: DataFrame, keys: list[str], ok: str) -> DataFrame:
    """AND of a family's criteria, with those that fail."""
    return checks.groupBy(*keys).agg(F.count("*").alias("n_criteria"), F.bool_and(ok).alias("eligible"), F.concat_ws(";", F.array_sort(F.collect_list(F.when(~F.col(ok), F.col("criterion"))))).alias("failing"))
