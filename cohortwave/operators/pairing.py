"""Joins: pairing, cohorts, reconciliation, interval and as-of joins, set comparisons of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwave.functions.scalar import delta_log


def pair_sessions(features: DataFrame, keys: list[str], base: str, pert: str, level: str = "m", dispersion: str = "j") -> DataFrame:
    """Level difference and log dispersion ratio of two sessions, by one conditional aggregation."""
    pick = lambda c, s: F.max(F.when(F.col("session") == s, F.col(c)))
    w = features.groupBy(*keys).agg(pick(level, base).alias("m0"), pick(level, pert).alias("m1"), pick(dispersion, base).alias("j0"), pick(dispersion, pert).alias("j1"))
    return w.where("m0 is not null and m1 is not null").select(*keys, (F.col("m1") - F.col("m0")).alias("delta_m"), delta_log(F.col("j0"), F.col("j1")).alias("delta_log_j"))


def pair_windows(windows: DataFrame, keys: list[str], base: str, pert: str, value: str) -> DataFrame:
    """Windows of two sessions by index, up to the shorter one."""
    side = lambda s, n: windows.where(F.col("session") == s).select(*keys, "window_index", F.col(value).alias(n))
    return side(base, "a").join(side(pert, "b"), [*keys, "window_index"])


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """Name of the first rule that holds; NULL if none does."""
    out = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def build_manifest(headers: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """headers with ``reason`` (first failing rule) and ``admitted``."""
    return headers.withColumn("reason", first_reason(rules)).withColumn("admitted", F.col("reason").isNull())


def build_cohort(manifest: DataFrame, targets: DataFrame, participants: DataFrame, key: str, base: str, pert: str, floor: int = 0) -> DataFrame:
    """Every participant with the first reason against it; strength is the weaker of its two sessions."""
    pick = lambda c, s: F.max(F.when(F.col("session") == s, F.col(c)))
    m = manifest.where("admitted").groupBy(key).agg(F.count_if(F.col("session") == base).alias("n0"), F.count_if(F.col("session") == pert).alias("n1"), F.least(pick("strength", base), pick("strength", pert)).alias("strength"))
    j = participants.select(key).join(m, key, "left").join(targets.select(key, F.lit(True).alias("has_target")), key, "left")
    missing = lambda c: F.coalesce(c, F.lit(0)) == 0
    reason = first_reason([(missing(F.col("n0")) & missing(F.col("n1")), "no_recording"), (missing(F.col("n0")), "no_baseline"), (missing(F.col("n1")), "no_perturbation"), (F.col("has_target").isNull(), "no_target"), (F.col("strength") < floor, "weak_evidence")])
    return j.select(key, "strength", F.coalesce(reason, F.lit("")).alias("reason"), reason.isNull().alias("included"))


def reconcile(official: DataFrame, raw: DataFrame, key: str, columns: list[str], tolerance: float) -> DataFrame:
    """Official against recomputed values: differences and all reasons, joined by semicolons."""
    a = official.select(key, *[F.col(c).alias(f"o_{c}") for c in columns], F.lit(True).alias("_o"))
    b = raw.select(key, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    j = a.join(b, key, "full")
    diffs = {f"d_{c}": F.col(f"r_{c}") - F.col(f"o_{c}") for c in columns}
    reasons = F.concat_ws(";", F.when(F.col("_o").isNull(), "raw_only"), F.when(F.col("_r").isNull(), "official_only"), *[F.when(F.abs(d) > tolerance, f"differs_{n[2:]}") for n, d in diffs.items()])
    return j.select(key, *[d.alias(n) for n, d in diffs.items()], reasons.alias("reasons"))


def missing_upstream(everything: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return everything.join(used, key, "left_anti")


def join_key_audit(a: DataFrame, b: DataFrame, naive: str, true: str, attribute: str) -> DataFrame:
    """How many pairs each key gives, how many naive pairs are wrong, and how well an attribute agrees."""
    ra, rb = a.select(F.col(naive).alias("na"), F.col(true).alias("ta"), F.col(attribute).alias("xa")), b.select(F.col(naive).alias("nb"), F.col(true).alias("tb"), F.col(attribute).alias("xb"))
    audit = lambda j, name: j.agg(F.count("*").alias("pairs"), F.count_if(~F.col("ta").eqNullSafe(F.col("tb"))).alias("wrong"), F.count_if(F.col("xa") == F.col("xb")).alias("agree")).withColumn("key", F.lit(name))
    both = audit(ra.join(rb, F.col("na") == F.col("nb")), "naive").unionByName(audit(ra.join(rb, F.col("ta") == F.col("tb")), "true"))
    return both.select("key", "pairs", "wrong", "agree")


def arm_disagreement(pred: DataFrame, arm_a: str, arm_b: str, keys: list[str], segment: str, p: str = "p") -> DataFrame:
    """Share of windows on which two arms decide differently; NULL unless both hold the same windows."""
    side = lambda a, n: pred.where(F.col("arm") == a).select(*keys, segment, (F.col(p) >= 0.5).alias(n))
    j = side(arm_a, "la").join(side(arm_b, "lb"), [*keys, segment], "full")
    s = j.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(F.col("la").isNotNull() & F.col("lb").isNotNull()).alias("same_windows"), F.avg((F.col("la") != F.col("lb")).cast("int")).alias("share"))
    return s.withColumn("share", F.when(F.col("same_windows"), F.col("share")))


def match_response(perturbations: DataFrame, responses: DataFrame, keys: list[str], bound: float) -> DataFrame:
    """First response in (t, t + bound] of each perturbation and how many there are; censored if none.

    An interval join by time buckets as wide as the bound: each response goes into its own bucket and the next
    perturbation bucket before it, so both sides meet on equal keys and no nested loop is needed.
    """
    a = perturbations.select(*keys, "event_id", F.col("t").alias("pt"), F.floor(F.col("t") / bound).alias("bucket"))
    b = responses.select(*keys, F.col("t").alias("rt"), F.explode(F.array(F.floor(F.col("t") / bound), F.floor(F.col("t") / bound) - 1)).alias("bucket"))
    hit = a.join(b, [*keys, "bucket"]).where((F.col("rt") > F.col("pt")) & (F.col("rt") <= F.col("pt") + bound)).groupBy(*keys, "event_id").agg(F.min("rt").alias("rt"), F.count("*").alias("n_responses"))
    j = a.drop("bucket").join(hit, [*keys, "event_id"], "left")
    return j.select(*keys, "event_id", F.col("pt").alias("t"), (F.col("rt") - F.col("pt")).alias("latency"), F.coalesce("n_responses", F.lit(0)).alias("n_responses"), F.col("rt").isNull().alias("censored"))


def asof_value(events: DataFrame, signal: DataFrame, keys: list[str], t: str, x: str) -> DataFrame:
    """Latest signal value at or before each event: one union and one ordered window, no range join."""
    both = signal.select(*keys, t, F.col(x).alias("_x"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("event_id")).unionByName(events.select(*keys, t, F.lit(None).cast("double").alias("_x"), F.lit(1).alias("_side"), "event_id"))
    w = Window.partitionBy(*keys).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(x, F.last("_x", ignorenulls=True).over(w)).where("_side = 1").select(*keys, "event_id", t, x)


def in_blocks(samples: DataFrame, blocks: DataFrame, keys: list[str], t: str) -> DataFrame:
    """block of each sample, NULL outside; blocks (keys, block, start_s, stop_s) don't overlap.

    As-of on the block starts, then a check of the end: linear in both sides.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    fields = dict(samples.dtypes)
    marks = blocks.select(*keys, F.col("start_s").alias(t), F.col("block").alias("_b"), F.col("stop_s").alias("_stop"), F.lit(0).alias("_side"), *[nothing(fields[c]).alias(c) for c in samples.columns if c not in (*keys, t)])
    rows = samples.select(*keys, t, nothing("long").alias("_b"), nothing("double").alias("_stop"), F.lit(1).alias("_side"), *[c for c in samples.columns if c not in (*keys, t)])
    w = Window.partitionBy(*keys).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    j = marks.unionByName(rows).withColumn("_b", F.last("_b", ignorenulls=True).over(w)).withColumn("_stop", F.last("_stop", ignorenulls=True).over(w)).where("_side = 1")
    return j.select(*samples.columns, F.when(F.col(t) <= F.col("_stop"), F.col("_b")).alias("block"))


def driving_mask(samples: DataFrame, blocks: DataFrame, span: DataFrame, keys: list[str], t: str) -> DataFrame:
    """driving: inside a block and the valid span; gap: valid but in no block; the rest is invalid."""
    j = in_blocks(samples, blocks, keys, t).join(span, keys, "left")
    valid = F.coalesce(F.col(t).between(F.col("valid_lo"), F.col("valid_hi")), F.lit(False))
    return j.withColumn("state", F.when(~valid, "invalid").when(F.col("block").isNotNull(), "driving").otherwise("gap"))


def resample_linear(knots: DataFrame, grid: DataFrame, keys: list[str], t: str, x: str) -> DataFrame:
    """Linear interpolation of knots at the grid's times; ends are held constant."""
    both = knots.select(*keys, t, F.col(x).alias("_x"), F.lit(0).alias("_side")).unionByName(grid.select(*keys, t, F.lit(None).cast("double").alias("_x"), F.lit(1).alias("_side")))
    w = Window.partitionBy(*keys).orderBy(t, "_side")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("_side") == 0, F.struct(F.col(t).alias("t"), F.col("_x").alias("x")))
    j = both.withColumn("_lo", F.last(known, ignorenulls=True).over(back)).withColumn("_hi", F.first(known, ignorenulls=True).over(ahead)).where("_side = 1")
    step = F.try_divide(F.col(t) - F.col("_lo.t"), F.col("_hi.t") - F.col("_lo.t"))
    return j.select(*keys, t, F.coalesce(F.col("_lo.x") + (F.col("_hi.x") - F.col("_lo.x")) * step, F.col("_lo.x"), F.col("_hi.x")).alias(x))


def window_pairs(windows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All pairs i < j of windows inside one recording: what agreement statistics are defined on.

    The result is quadratic in a recording's windows by definition; equal keys spread recordings over tasks.
    """
    a = windows.select(*keys, F.col("window_index").alias("i"), F.col(value).alias("a"))
    b = windows.select(*keys, F.col("window_index").alias("j"), F.col(value).alias("b"))
    return a.join(b, keys).where("i < j")


def baseline_scenario(windows: DataFrame, key: str, base: str, current: str, value: str) -> DataFrame:
    """First current window against the median of at least two baseline windows and against the first of them."""
    b = windows.where(F.col("session") == base).groupBy(key).agg(F.count("*").alias("n_base"), F.median(value).alias("base_median"), F.min_by(value, "window_index").alias("base_first"))
    c = windows.where(F.col("session") == current).groupBy(key).agg(F.min_by(value, "window_index").alias("now"))
    j = b.where("n_base >= 2").join(c, key)
    return j.select(key, "n_base", (F.col("now") - F.col("base_median")).alias("to_median"), (F.col("now") - F.col("base_first")).alias("to_first"))


def table_diff(expected: DataFrame, actual: DataFrame, key: str, columns: list[str], labels: list[str], tolerance: float) -> DataFrame:
    """One row: key coverage both ways, largest difference and worst key per column, label flips, verdict."""
    e = expected.select(F.col(key).alias("ke"), *[F.col(c).alias(f"e_{c}") for c in [*columns, *labels]])
    a = actual.select(F.col(key).alias("ka"), *[F.col(c).alias(f"a_{c}") for c in [*columns, *labels]])
    j = e.join(a, F.col("ke") == F.col("ka"), "full")
    diff = {c: F.abs(F.col(f"e_{c}") - F.col(f"a_{c}")) for c in columns}
    flips = [F.count_if(F.col(f"e_{c}") != F.col(f"a_{c}")).alias(f"flips_{c}") for c in labels]
    r = j.agg(F.count_if(F.col("ka").isNull()).alias("missing"), F.count_if(F.col("ke").isNull()).alias("extra"), *[F.max(d).alias(f"max_{c}") for c, d in diff.items()], *[F.max_by("ke", d).alias(f"worst_{c}") for c, d in diff.items()], *flips)
    ok = (F.col("missing") == 0) & (F.col("extra") == 0)
    for c in columns:
        ok = ok & (F.coalesce(F.col(f"max_{c}"), F.lit(0.0)) <= tolerance)
    for c in labels:
        ok = ok & (F.col(f"flips_{c}") == 0)
    return r.withColumn("same", ok)


def with_first_window(windows: DataFrame, label: str, targets: DataFrame, key: str) -> DataFrame:
    return windows.where((F.col("label") == label) & (F.col("window_index") == 0)).join(targets, key)


def censoring_audit(matched: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Censored share, its last quarter minus its first, and the share of perturbations with several responses."""
    q = matched.withColumn("_q", F.ntile(4).over(Window.partitionBy(*keys).orderBy(order)))
    c = F.col("censored").cast("int")
    return q.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(c).alias("censored_share"), (F.avg(F.when(F.col("_q") == 4, c)) - F.avg(F.when(F.col("_q") == 1, c))).alias("late_minus_early"), F.avg((F.col("n_responses") > 1).cast("int")).alias("multi_share"))


def same_sample_sets(pred: DataFrame, arms: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Per group, whether all arms share the same rows: number of distinct signatures over arms.

    A signature sums 64-bit hashes of rows, so no list of rows is gathered.
    """
    s = pred.groupBy(*keys, arms).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sig"))
    return s.groupBy(*keys).agg(F.count("*").alias("n_arms"), F.count_distinct("n", "sig").alias("n_signatures"), F.min("n").alias("n_rows"))


def mask_audit(masked: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Rows, fractions and ranges of a series inside and outside driving."""
    drive, gap = F.col("state") == "driving", F.col("state") == "gap"
    a = masked.groupBy(*keys).agg(F.count_if(drive).alias("n_driving"), F.count_if(gap).alias("n_gap"), F.count_if(F.col("state") == "invalid").alias("n_invalid"), F.avg(F.when(drive, F.col(x))).alias("mean_driving"), F.avg(F.when(gap, F.col(x))).alias("mean_gap"),
                                  F.max(F.when(drive, F.abs(x))).alias("max_driving"), F.max(F.when(gap, F.abs(x))).alias("max_gap"))
    return a.withColumn("gap_fraction", F.try_divide(F.col("n_gap"), F.col("n_gap") + F.col("n_driving"))).withColumn("scale_ratio", F.try_divide(F.col("max_gap"), F.col("max_driving")))


def event_locked_mean(signal: DataFrame, events: DataFrame, keys: list[str], t: str, x: str, edges: list[float]) -> DataFrame:
    """Mean of the signal in bins of time after each event, by bucketed interval join."""
    width = edges[-1]
    e = events.select(*keys, "event_id", F.col(t).alias("et"), F.floor(F.col(t) / width).alias("bucket"))
    s = signal.select(*keys, F.col(t).alias("st"), F.col(x).alias("sx"), F.explode(F.array(F.floor(F.col(t) / width), F.floor(F.col(t) / width) - 1)).alias("bucket"))
    lag = F.col("st") - F.col("et")
    j = e.join(s, [*keys, "bucket"]).where((lag > 0) & (lag <= width))
    bin_ = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        bin_ = F.when(lag <= edges[i], i).otherwise(bin_)
    return j.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("sx").alias("mean"))


def rate_per_block(events: DataFrame, blocks: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Events per minute in each block, and the ratio of the largest to the smallest rate of a recording."""
    n = in_blocks(events, blocks, keys, t).where("block is not null").groupBy(*keys, "block").agg(F.count("*").alias("n_events"))
    j = blocks.join(n, [*keys, "block"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    r = j.withColumn("rate", F.try_divide(F.col("n_events") * 60.0, F.col("stop_s") - F.col("start_s")))
    w = Window.partitionBy(*keys)
    return r.select(*keys, "block", "n_events", "rate", F.try_divide(F.max("rate").over(w), F.nullif(F.min("rate").over(w), F.lit(0.0))).alias("max_over_min"))
