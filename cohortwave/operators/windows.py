"""Windows over ordered series: cutting, dynamics, batches, runs, gaps, blocks and smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def disjoint_windows(series: DataFrame, keys: list[str], order: str, k: int, burn: int = 0) -> DataFrame:
    """window_index of k consecutive rows each from the start (after burn rows); an incomplete tail is dropped."""
    w = Window.partitionBy(*keys)
    r = series.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1 - burn).withColumn("_n", F.count("*").over(w) - burn)
    return r.where((F.col("_i") >= 0) & (F.col("_i") < F.floor(F.col("_n") / k) * k)).withColumn("window_index", F.floor(F.col("_i") / k)).drop("_i", "_n")


def protocol_windows(series: DataFrame, keys: list[str], order: str, protocols: list[tuple[str, int, int]]) -> DataFrame:
    """Windows of every (label, burn, k) protocol in one pass: the small protocol list is exploded onto narrow rows."""
    w = Window.partitionBy(*keys)
    r = series.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    grid = F.array(*[F.struct(F.lit(name).alias("label"), F.lit(burn).alias("_burn"), F.lit(k).alias("_k")) for name, burn, k in protocols])
    x = r.select("*", F.inline(grid)).withColumn("_i", F.col("_r") - F.col("_burn"))
    return x.where((F.col("_i") >= 0) & (F.col("_i") < F.floor((F.col("_n") - F.col("_burn")) / F.col("_k")) * F.col("_k"))).withColumn("window_index", F.floor(F.col("_i") / F.col("_k"))).drop("_r", "_n", "_i", "_burn", "_k")


def prefix_vs_full(windows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value of the first window, of the whole session and of the rest (means over windows)."""
    first = F.col("window_index") == 0
    s = windows.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.avg(F.when(first, F.col(value))).alias("prefix"), F.avg(value).alias("whole"), F.avg(F.when(~first, F.col(value))).alias("complement"))
    return s.withColumn("prefix_minus_full", F.col("prefix") - F.col("whole"))


def position_values(windows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value of the first, middle ((n - 1) // 2) and last window; with two windows the middle is the first."""
    w = Window.partitionBy(*keys)
    r = windows.withColumn("_i", F.row_number().over(w.orderBy("window_index")) - 1).withColumn("_n", F.count("*").over(w)).where("_n >= 2")
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col(value)))
    return r.groupBy(*keys).agg(F.max("_n").alias("n_windows"), at(F.lit(0)).alias("early"), at(F.floor((F.col("_n") - 1) / 2)).alias("middle"), at(F.col("_n") - 1).alias("late")).withColumn("late_minus_early", F.col("late") - F.col("early"))


def dynamic_features(series: DataFrame, keys: list[str], order: str, s: str = "s") -> DataFrame:
    """Level m, dispersion j, volatility v, drift d with its error and t, drift share and residual dispersion.

    Time is centred and scaled to the window: tau = (i - (N + 1) / 2) / N. Drift needs three rows.
    """
    w = Window.partitionBy(*keys)
    r = series.select(*keys, F.col(s).alias("s"), (F.col(s) - F.lag(s).over(w.orderBy(order))).alias("ds"), F.row_number().over(w.orderBy(order)).alias("i"), F.count("*").over(w).alias("N"))
    r = r.withColumn("tau", (F.col("i") - (F.col("N") + 1) / 2) / F.col("N"))
    a = r.groupBy(*keys).agg(F.count("s").alias("n"), F.avg("s").alias("m"), F.stddev_samp("s").alias("j"), F.sqrt(F.sum(F.col("ds") * F.col("ds")) / F.nullif(2 * (F.count("s") - 1), F.lit(0))).alias("v"),
                             F.regr_sxx("s", "tau").alias("sxx"), F.regr_sxy("s", "tau").alias("sxy"), F.regr_syy("s", "tau").alias("syy"))
    ok = (F.col("n") >= 3) & (F.col("sxx") > 0)
    slope = F.when(ok, F.col("sxy") / F.nullif("sxx", F.lit(0.0)))
    sse = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(sse / F.nullif(F.col("n") - 2, F.lit(0)) / F.nullif("sxx", F.lit(0.0)))
    return a.select(*keys, "n", "m", "j", "v", slope.alias("d"), F.when(ok, se).alias("d_se"), F.when(ok, F.try_divide(slope, se)).alias("d_t"), F.when(ok, F.try_divide(slope * F.col("sxy"), F.col("syy"))).alias("drift_share"), F.when(ok, F.sqrt(sse / F.nullif(F.col("n") - 2, F.lit(0)))).alias("j_res"))


def duplicate_ids(rows: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(row_id)).alias("n_repeats"))


def ordered_batches(segments: DataFrame, subject: list[str], visit: str, order: str, size: int) -> DataFrame:
    """Batches cut inside a visit, visits in rank order: stream_position, batch_index, offset and true batch size."""
    own = Window.partitionBy(*subject, visit)
    r = segments.withColumn("_i", F.row_number().over(own.orderBy(order)) - 1).withColumn("_n", F.count("*").over(own))
    r = r.withColumn("_b", F.floor(F.col("_i") / size))
    stream = Window.partitionBy(*subject)
    r = r.withColumn("stream_position", F.row_number().over(stream.orderBy(visit, order)) - 1).withColumn("batch_index", F.dense_rank().over(stream.orderBy(visit, "_b")) - 1)
    last = F.col("_b") == F.floor((F.col("_n") - 1) / size)
    return r.withColumns({"offset": F.col("_i") % size, "batch_n": F.when(last, F.col("_n") - F.col("_b") * size).otherwise(F.lit(size)), "is_final_of_visit": last}).drop("_i", "_n", "_b")


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of equal values: first and last position, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = rows.withColumn("_new", (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return islands(rows, keys, order, value).groupBy(*keys).agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"))


def row_ranges(rows: DataFrame, position: str, subject: str) -> DataFrame:
    """Contiguous position ranges of each subject, without a sort of the whole table: by position minus own rank."""
    r = rows.withColumn("_g", F.col(position) - F.row_number().over(Window.partitionBy(subject).orderBy(position)))
    return r.groupBy(subject, "_g").agg(F.min(position).alias("start_row"), F.max(position).alias("end_row"), F.count("*").alias("row_count")).drop("_g")


def missing_epochs(rows: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """Interior gaps between the smallest and largest epoch: how many are missing and in how many gaps."""
    w = Window.partitionBy(*keys).orderBy(epoch)
    gap = F.lead(epoch).over(w) - F.col(epoch) - 1
    r = rows.select(*keys, epoch).distinct().withColumn("_gap", gap)
    return r.groupBy(*keys).agg(F.count("*").alias("n_epochs"), F.coalesce(F.sum(F.when(F.col("_gap") > 0, F.col("_gap"))), F.lit(0)).alias("n_missing"), F.count_if(F.col("_gap") > 0).alias("n_gaps"), F.max("_gap").alias("largest_gap"))


def missing_list(rows: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """Each epoch between a group's smallest and largest that it lacks. Repeated epochs have no gap between them, so one shuffle and sort do."""
    w = Window.partitionBy(*keys).orderBy(epoch)
    r = rows.select(*keys, epoch).withColumn("_next", F.lead(epoch).over(w)).where(F.col("_next") - F.col(epoch) > 1)
    return r.select(*keys, F.explode(F.sequence(F.col(epoch) + 1, F.col("_next") - 1)).alias("missing"))


def assign_blocks(markers: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """block number from 0; a spacing of more than gap opens a new block."""
    w = Window.partitionBy(*keys).orderBy(t)
    return markers.withColumn("_new", (F.col(t) - F.lag(t).over(w) > gap).cast("int")).withColumn("block", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_new")


def blocks_from_gaps(markers: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    b = assign_blocks(markers, keys, t, gap).groupBy(*keys, "block").agg(F.min(t).alias("start_s"), F.max(t).alias("stop_s"), F.count("*").alias("n_markers"))
    return b.withColumn("duration_s", F.col("stop_s") - F.col("start_s"))


def marker_aligned_windows(markers: DataFrame, keys: list[str], t: str, min_s: float) -> DataFrame:
    """Greedy contiguous windows of at least min_s whose edges are markers; a shorter tail has complete = false.

    A window's end decides where the next one may start, so the markers of a block are walked in order. They stream by
    in batches; what is kept between batches is the open window alone, however long the block.
    """
    fields = {f.name: f.dataType.simpleString() for f in markers.schema.fields}
    names = [*keys, "window_index", "start_s", "stop_s", "complete"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, last, index = None, 0.0, 0.0, 0

        def tail() -> list[tuple]:
            return [(*key, index, start, last, False)] if key is not None and last > start else []

        for batch in batches:
            out: list[tuple] = []
            times = batch[t].to_numpy(float)
            fresh = np.ones(len(batch), bool)
            fresh[1:] = False
            for k in keys:
                v = batch[k].to_numpy()
                fresh[1:] |= v[1:] != v[:-1]
            edges = np.append(np.flatnonzero(fresh), len(batch))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own = tuple(batch[k].iloc[lo] for k in keys)
                if own != key:
                    out += tail()
                    key, start, index = own, times[lo], 0
                at = lo
                # the first marker that is far enough: a search finds it, but for rounding of the sum
                while (at := lo + int(np.searchsorted(times[lo:hi], start + min_s - 1e-6 * max(1.0, abs(min_s))))) < hi:
                    while at < hi and times[at] - start < min_s:
                        at += 1
                    if at == hi:
                        break
                    out.append((*key, index, start, times[at], True))
                    start, index = times[at], index + 1
                last = times[hi - 1]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(tail(), columns=names)

    rows = markers.select(*keys, t).where(F.col(t).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, t)
    return rows.mapInPandas(walk, ", ".join(f"{k} {fields[k]}" for k in keys) + ", window_index long, start_s double, stop_s double, complete boolean")


def block_local_mean(series: DataFrame, keys: list[str], order: str, x: str, half: int, block: str = "block") -> DataFrame:
    """Centred mean over 2 half + 1 rows clamped to the block; rows outside any block (NULL) have none."""
    w = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(-half, half)
    return series.withColumn("smooth", F.when(F.col(block).isNotNull(), F.avg(x).over(w)))


def running_balanced_accuracy(pred: DataFrame, keys: list[str], order: str, y: str = "y", p: str = "p") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    one, yes = F.col(y) == 1, F.col(p) >= 0.5
    n = lambda c: F.sum(c.cast("int")).over(w)
    return pred.withColumn("running", (F.try_divide(n(one & yes), n(one)) + F.try_divide(n(~one & ~yes), n(~one))) / 2)


def sliding_windows(epochs: DataFrame, length: int, step: int, steps: int, samples: str = "samples") -> DataFrame:
    """Slices of an epoch's samples at multiples of step; the last ones are clamped to the end."""
    start = F.least(F.col("step") * step, F.size(samples) - length).cast("int")
    return epochs.where(F.size(samples) >= length).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).withColumn("start", start).withColumn("slice", F.slice(samples, F.col("start") + 1, length))


def last_marker(signal: DataFrame, keys: list[str], t: str, is_marker: str) -> DataFrame:
    """Time of the latest marker at or before each row, and the position since then."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return signal.withColumn("marker_t", F.last(F.when(F.col(is_marker), F.col(t)), ignorenulls=True).over(w)).withColumn("since", F.col(t) - F.col("marker_t"))


def tile_local_slope(signal: DataFrame, keys: list[str], t: str, x: str, is_marker: str, within: float) -> DataFrame:
    """Slope of x over the first part of each tile between markers; tiles of fewer than three rows have none."""
    s = last_marker(signal, keys, t, is_marker).where(F.col("marker_t").isNotNull() & (F.col("since") < within))
    g = s.groupBy(*keys, "marker_t").agg(F.count("*").alias("n"), F.regr_slope(x, "since").alias("slope"))
    g = g.withColumn("slope", F.when(F.col("n") >= 3, F.col("slope")))
    return g.groupBy(*keys).agg(F.count("*").alias("tiles"), F.avg("slope").alias("mean_slope"), F.avg((F.col("slope") > 0).cast("int")).alias("share_positive"))


def stream_order_check(stream: DataFrame, keys: list[str], epoch: str, visit: str) -> DataFrame:
    """Counts of violations per stream (columns stream_position, batch_index, batch_n); all zero for a sound one."""
    w = Window.partitionBy(*keys).orderBy("stream_position")
    r = stream.select("*", (F.lag(epoch).over(w) >= F.col(epoch)).alias("_desc"), (F.lag(visit).over(w) == F.col(visit)).alias("_same"), (F.lag("batch_index").over(w) > F.col("batch_index")).alias("_back"))
    b = stream.groupBy(*keys, "batch_index").agg(F.count_distinct(visit).alias("v"), F.count("*").alias("c"), F.max("batch_n").alias("bn")).groupBy(*keys).agg(F.count_if(F.col("v") > 1).alias("mixed_batches"), F.count_if(F.col("c") != F.col("bn")).alias("wrong_sizes"))
    a = r.groupBy(*keys).agg(
        F.count_if(F.col("_desc") & F.col("_same")).alias("not_ascending"), (F.count("*") - F.count_distinct(visit, epoch)).alias("repeats"), F.count_if("_back").alias("batch_backwards"),
        ((F.min("stream_position") != 0) | (F.max("stream_position") != F.count("*") - 1) | (F.count_distinct("stream_position") != F.count("*"))).cast("int").alias("bad_positions"),
    )
    return a.join(b, keys)

