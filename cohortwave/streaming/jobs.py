"""Structured Streaming jobs: windowed features, blocks, response matching, monitoring and order checks.

Each takes a streaming (or batch) DataFrame with a timestamp column ``ts`` and returns one; drain() runs a stream over
what is there and ends, and replay() does so for input that arrives in parts, with a restart between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortwave.sources.tables import scratch


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder, or a single file, as a stream; schema from the files, ts as an instant."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        stream = reader.parquet(path)
    else:  # a file source watches folders
        stream = reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, label: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, at: str | None = None) -> DataFrame:
    """Run over the available input and return what was written; the checkpoint makes a restart exactly-once.

    A second call with the same folder `at` goes on where the first one ended, with its state and watermark.
    """
    spark = stream.sparkSession
    at = at or scratch(spark, f"stream-{label}")
    out = f"{at}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if each or mode != "append":
        save = each or (lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out))
        query = writer.outputMode(mode).foreachBatch(save).start()
    else:
        query = writer.outputMode(mode).format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def replay(rows: DataFrame, part: Column, parts: int, job: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What job writes in append mode when rows arrive in parts 0 to parts - 1, the stream being restarted from its checkpoint for each."""
    spark = rows.sparkSession
    at = scratch(spark, f"stream-{label}")
    out = None
    for i in range(parts):
        rows.where(part == i).write.mode("append").parquet(f"{at}/in")
        out = drain(job(spark.readStream.schema(rows.schema).parquet(f"{at}/in")), label, at=at)
    return out


def tumbling_features(stream: DataFrame, width: str, delay: str, keys: list[str], value: str) -> DataFrame:
    """Level and dispersion per closed window."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("j"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "m", "j")


def sliding_features(stream: DataFrame, width: str, step: str, delay: str, keys: list[str], value: str) -> DataFrame:
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "m")


def blocks(stream: DataFrame, gap: str, delay: str, keys: list[str]) -> DataFrame:
    """Session windows: a gap longer than `gap` closes a block."""
    w = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n_markers"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return w.select(*keys, "first_ts", "last_ts", "n_markers")


def match_response(perturbations: DataFrame, responses: DataFrame, key: str, bound: str, delay: str) -> DataFrame:
    """All responses within the bound of each perturbation; both sides keep state only as long as it can match."""
    p = perturbations.select(F.col(key).alias("pk"), F.col("event_id").alias("p_id"), F.col("ts").alias("p_ts")).withWatermark("p_ts", delay)
    r = responses.select(F.col(key).alias("rk"), F.col("event_id").alias("r_id"), F.col("ts").alias("r_ts")).withWatermark("r_ts", delay)
    return p.join(r, F.expr(f"pk = rk AND r_ts > p_ts AND r_ts <= p_ts + interval {bound}"), "inner").select(F.col("pk").alias(key), "p_id", "r_id", "p_ts", "r_ts")


def first_response(perturbations: DataFrame, responses: DataFrame, key: str, bound: str, delay: str) -> DataFrame:
    """One row per perturbation once it can have no further response: its first response within the bound, how many
    there were, and censored where there was none.

    A left outer join keeps each side only as long as it can match; the watermark releases rows without a match. A second
    aggregation holds one row per perturbation until the watermark, moved back by the bound, has passed it.
    """
    p = perturbations.select(F.col(key).alias("pk"), F.col("event_id").alias("p_id"), F.col("ts").alias("p_ts")).withWatermark("p_ts", delay)
    r = responses.select(F.col(key).alias("rk"), F.col("event_id").alias("r_id"), F.col("ts").alias("r_ts")).withWatermark("r_ts", delay)
    j = p.join(r, F.expr(f"pk = rk AND r_ts > p_ts AND r_ts <= p_ts + interval {bound}"), "left_outer")
    g = j.groupBy("pk", "p_id", "p_ts").agg(F.min(F.when(F.col("r_id").isNotNull(), F.struct("r_ts", "r_id"))).alias("f"), F.count("r_id").alias("n_responses"))
    return g.select(F.col("pk").alias(key), "p_id", "p_ts", F.col("f.r_id").alias("r_id"), F.col("f.r_ts").alias("r_ts"), "n_responses", F.col("f").isNull().alias("censored"))


def visit_monitor(stream: DataFrame, keys: list[str], order: str, p: str, size: int, gap_ms: int, delay: str, least: float = 1e-12, buckets: int = 512) -> DataFrame:
    """A row for every batch of `size` predictions of a visit (keys, such as arm, subject, visit), in order of arrival. least: see entropies().

    A visit ends when the watermark is gap_ms past its last row; then its short last batch leaves. Rows behind the watermark are
    taken as well: as in order_check() a row travels as a tick that moves the watermark and as data that is never late. A row of an
    ended visit goes on with its short batch, which then leaves anew: longer, or with last = false if it is open again. settled() keeps
    what holds in the end. So that late rows find their place, a visit's counters are kept for good: less than a batch each.

    Visits share the state of one of `buckets` hash buckets (fixed for the life of a checkpoint), as a call a visit takes far longer than its work.
    """
    kinds = dict(stream.dtypes)

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        visits: dict[tuple, list] = {}  # index, held, end, whether the short batch is out
        if state.exists:
            *known, index, end, out, n, flat = state.get
            at = 0
            for key, i, e, o, m in zip(zip(*known, strict=True), index, end, out, n, strict=True):
                visits[key] = [i, list(flat[at : at + m]), e, o]
                at += m
        left: list[tuple] = []  # key, index, values, last
        recalled = set()
        if not state.hasTimedOut:
            rows = pd.concat(parts)
            rows = rows[rows["_tick"].isna()].sort_values(order)
            for key, value, ms in zip(zip(*[rows[k].tolist() for k in keys], strict=True), rows[p].tolist(), (rows["_us"] // 1000).tolist(), strict=True):
                visit = visits.setdefault(key, [0, [], 0, False])
                visit[1].append(value)
                visit[2] = max(visit[2], ms)
                if visit[3]:
                    visit[3] = False
                    recalled.add(key)
                if len(visit[1]) == size:
                    left.append((key, visit[0], visit[1], False))
                    visit[0], visit[1] = visit[0] + 1, []
                    recalled.discard(key)
        timer = None
        for key, visit in visits.items():
            if visit[1] and not visit[3]:
                if visit[2] + gap_ms <= now:
                    left.append((key, visit[0], list(visit[1]), True))
                    visit[3] = True
                else:
                    timer = min(timer or visit[2] + gap_ms, visit[2] + gap_ms)
                    if key in recalled:
                        left.append((key, visit[0], list(visit[1]), False))
        if visits:
            index, held, end, out = zip(*visits.values(), strict=True)
            state.update((*map(list, zip(*visits, strict=True)), list(index), list(end), list(out), list(map(len, held)), [x for h in held for x in h]))
            if timer:
                state.setTimeoutTimestamp(timer)
        if left:
            n = np.array([len(x[2]) for x in left])
            scores = np.empty((3, len(left)))
            for m in np.unique(n):
                scores[:, n == m] = entropies([x[2] for x in left if len(x[2]) == m], least)
            columns = [*zip(*[x[0] for x in left], strict=True), [x[1] for x in left], n, [x[3] for x in left], *scores]
            yield pd.DataFrame(dict(zip(names, columns, strict=True)))

    names = [*keys, "batch_index", "n", "last", "q1", "h_cond", "h_marg"]
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", batch_index long, n long, last boolean, q1 double, h_cond double, h_marg double"
    held = ", ".join(f"{k} array<{kinds[k]}>" for k in keys) + ", index array<long>, end array<long>, released array<boolean>, n array<long>, held array<double>"
    ticks = F.explode(F.array(F.col("ts").cast("timestamp"), F.lit(None).cast("timestamp")))
    both = stream.select(*keys, order, p, F.unix_micros("ts").alias("_us"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), ticks.alias("_tick"))
    return both.withWatermark("_tick", delay).groupBy("_bucket").applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def settled(batches: DataFrame, keys: list[str], size: int) -> DataFrame:
    """What holds in the end of visit_monitor()'s rows: each batch's last form, without short ones that are open again."""
    by = [*keys, "batch_index"]
    rest = [c for c in batches.columns if c not in by]
    latest = batches.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("n", "last")).alias("_r"))
    return latest.select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest]).where(F.col("last") | (F.col("n") == size))


def order_check(stream: DataFrame, keys: list[str], epoch: str, arrival: list[str], delay: str, idle_ms: int) -> DataFrame:
    """Every row with its status under the rule that epochs ascend strictly within keys, in order of arrival.

    accepted; repeated (the last accepted epoch again); out_of_order (below it); late (behind the watermark, whatever the
    epoch). previous is the epoch that the row had to exceed. split() keeps two tables.

    The operator would drop late rows unseen, so a row travels twice: as a tick that carries the time and moves the
    watermark, and as data without one, which is never late. State is one number a key. It goes when the watermark is
    idle_ms past the key's last row; from then on the watermark alone tells late rows.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(parts)
        rows = rows[rows["_tick"].isna()].sort_values(arrival).reset_index(drop=True)
        if not len(rows):
            return
        watermark = state.getCurrentWatermarkMs()
        known, end = state.get if state.exists else (None, 0)
        x, us = rows[epoch].to_numpy(), rows["_us"].to_numpy()
        late, lowest = us < watermark * 1000, np.iinfo(np.int64).min
        seen = np.maximum.accumulate(np.concatenate([[lowest if known is None else known], np.where(late, lowest, x)]))
        before = seen[:-1]
        status = np.select([late, x > before, x == before], ["late", "accepted", "repeated"], "out_of_order")
        if seen[-1] > lowest:
            end = max(end, int(us.max()) // 1000)
            state.update((int(seen[-1]), end))
            state.setTimeoutTimestamp(max(end + idle_ms, watermark + 1))
        previous = pd.Series(before, dtype="Int64").mask(before == lowest)
        yield rows.assign(previous=previous, status=status)[names]

    names = [*keys, epoch, *arrival, "_us", "previous", "status"]
    ticks = F.explode(F.array(F.col("ts").cast("timestamp"), F.lit(None).cast("timestamp")))
    both = stream.select(*keys, F.col(epoch).cast("long").alias(epoch), *arrival, F.unix_micros("ts").alias("_us"), ticks.alias("_tick"))
    kinds = dict(both.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, epoch, *arrival, "_us"]) + ", previous long, status string"
    checked = both.withWatermark("_tick", delay).groupBy(*keys).applyInPandasWithState(step, schema, "last long, end long", "append", GroupStateTimeout.EventTimeTimeout)
    return checked.select(*keys, epoch, *arrival, F.timestamp_micros("_us").alias("ts"), "previous", "status")


def split(stream: DataFrame, label: str, ok: Column, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Drain a stream into two tables: rows for which ok holds, and the side table of the others.

    A trigger's rows are a folder of their own that a rerun of it overwrites, so both tables are exactly-once.
    """
    spark = stream.sparkSession
    at = at or scratch(spark, f"stream-{label}")

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, where in (("main", F.coalesce(ok, F.lit(False))), ("side", ~F.coalesce(ok, F.lit(False)))):
            batch.where(where).write.mode("overwrite").parquet(f"{at}/{name}/trigger={number}")
        batch.unpersist()

    query = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return tuple(spark.read.schema(stream.schema).parquet(f"{at}/{name}") for name in ("main", "side"))


def replay_split(rows: DataFrame, part: Column, parts: int, job: Callable[[DataFrame], DataFrame], label: str, ok: Column) -> tuple[DataFrame, DataFrame]:
    """replay() into two tables."""
    spark = rows.sparkSession
    at = scratch(spark, f"stream-{label}")
    out = ()
    for i in range(parts):
        rows.where(part == i).write.mode("append").parquet(f"{at}/in")
        out = split(job(spark.readStream.schema(rows.schema).parquet(f"{at}/in")), label, ok, at)
    return out


def entropies(values: list, least: float) -> tuple:
    """(mean, conditional entropy, marginal entropy) of a batch's predictions, or of each of several batches of one length, held `least` away from 0 and 1.

    With least = 0 they are taken as they are: 0 has no logarithm, so an entropy that needs it is NaN, as in SQL.
    """
    batch = np.clip(np.asarray(values, float), least, 1 - least)
    q = batch.mean(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = lambda x: -(x * np.log(x) + (1 - x) * np.log(1 - x))
        return q, h(batch).mean(axis=-1), h(q)


def batch_monitor(stream: DataFrame, key: str, order: str, p: str, size: int, least: float = 1e-12) -> DataFrame:
    """A row for every full batch of `size` predictions of a key, in order of arrival; state holds less than a batch. least: see entropies()."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, held = state.get if state.exists else (0, [])
        rows = pd.concat(parts).sort_values(order)
        values = [*held, *rows[p].tolist()]
        out = []
        while len(values) >= size:
            out.append((k[0], index, size, *entropies(values[:size], least)))
            values, index = values[size:], index + 1
        state.update((index, values))
        yield pd.DataFrame(out, columns=[key, "batch_index", "n", "q1", "h_cond", "h_marg"])

    schema = f"{key} {kind}, batch_index long, n long, q1 double, h_cond double, h_marg double"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "index long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def running_accuracy(stream: DataFrame, key: str, y: str, p: str) -> DataFrame:
    """Cumulative balanced accuracy of each key after every trigger; the state is four counters."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tp, fn, tn, fp = state.get if state.exists else (0, 0, 0, 0)
        for part in parts:
            one, yes = part[y].to_numpy() == 1, part[p].to_numpy() >= 0.5
            tp, fn, tn, fp = tp + int((one & yes).sum()), fn + int((one & ~yes).sum()), tn + int((~one & ~yes).sum()), fp + int((~one & yes).sum())
        state.update((tp, fn, tn, fp))
        accuracy = (tp / (tp + fn) + tn / (tn + fp)) / 2 if tp + fn and tn + fp else None
        yield pd.DataFrame([(k[0], tp + fn + tn + fp, accuracy)], columns=[key, "n", "balanced_accuracy"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, balanced_accuracy double", "tp long, fn long, tn long, fp long", "update", GroupStateTimeout.NoTimeout)


def dedup(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First row of every key; state is dropped once the watermark has passed it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
