"""Cleaning, quality checks and classification of rows. DataFrame in, DataFrame out; grouping columns are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwave.functions.scalar import finite, is_missing, parse_numeric
from cohortwave.operators.geometry import nearest_on_sphere
from cohortwave.operators.order import with_quantiles


def numeric_audit(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    v, missing = parse_numeric(F.col(text)), is_missing(F.col(text))
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(missing).alias("n_missing"), F.count_if(~missing & v.isNull()).alias("n_invalid"), F.count(v).alias("n_numeric"))


def filter_rt_window(trials: DataFrame, lo: float, hi: float, rt: str = "rt") -> DataFrame:
    """Out-of-range reaction times become NULL (never clamped) in ``rt_valid``."""
    return trials.withColumn("rt_valid", F.when(F.col(rt).between(lo, hi), F.col(rt)))


def rt_audit(trials: DataFrame, keys: list[str], lo: float, hi: float, rt: str = "rt") -> DataFrame:
    t = filter_rt_window(trials, lo, hi, rt)
    return t.groupBy(*keys).agg(F.count("*").alias("n_trials"), F.count_if(F.col(rt).isNull()).alias("n_missing"), F.count_if(F.col(rt) < lo).alias("n_fast"), F.count_if(F.col(rt) > hi).alias("n_slow"), F.count("rt_valid").alias("n_valid"))


def classify_tokens(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """First rule whose pattern occurs gives the class."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def extract_fields(df: DataFrame, text: str, fields: dict[str, str], *keep: str) -> DataFrame:
    """One column for each named pattern (first group); NULL where it doesn't occur."""
    return df.select(*keep, *[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias(n) for n, p in fields.items()])


def epoch_qc(epochs: DataFrame, keys: list[str], max_abs: float, max_ptp: float, min_std: float, samples: str = "samples") -> DataFrame:
    """Per epoch over its channels: worst amplitude, peak to peak and flatness, and the reasons against it.

    An epoch with a nonfinite sample has that reason alone.
    """
    x = F.transform(samples, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    clean = F.when(~bad, x)
    rows = epochs.select(*keys, bad.alias("bad"), clean.alias("x")).select(
        *keys, "bad", F.greatest(F.array_max("x"), -F.array_min("x")).alias("abs"), (F.array_max("x") - F.array_min("x")).alias("ptp"),
        F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / F.size("x") - F.pow(F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x"), F.lit(2))).alias("sd"),
    )
    worst = rows.groupBy(*keys).agg(F.bool_or("bad").alias("bad"), F.max("abs").alias("max_abs"), F.max("ptp").alias("max_ptp"), F.min("sd").alias("min_std"))
    reasons = F.when(F.col("bad"), "nonfinite").otherwise(F.concat_ws(";", F.when(F.col("max_abs") > max_abs, "amplitude"), F.when(F.col("max_ptp") > max_ptp, "peak_to_peak"), F.when(F.col("min_std") < min_std, "flat")))
    return worst.select(*keys, "max_abs", "max_ptp", "min_std", reasons.alias("reasons"), (reasons == "").alias("qc_pass"))


def flag_boundary_crossing(epochs: DataFrame, boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """epochs (keys, lo, hi), boundaries (keys, at): whether a boundary lies in (lo, hi]."""
    hit = epochs.join(boundaries, keys).where("at > lo and at <= hi").select(*keys, "lo", "hi").distinct().withColumn("crossed", F.lit(True))
    return epochs.join(hit, [*keys, "lo", "hi"], "left").withColumn("crossed", F.coalesce("crossed", F.lit(False)))


def cut_segments(epochs: DataFrame, n: int, stem: Column, keep: list[str], epoch: str = "epoch", samples: str = "samples") -> DataFrame:
    """Slices of n samples that don't overlap; an incomplete tail is dropped."""
    last = F.floor(F.size(samples) / n) - 1
    cut = epochs.where(F.size(samples) >= n).select("*", stem.alias("stem"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    start = (F.col("i") * n).cast("int")
    return cut.select(*keep, epoch, start.alias("start_sample"), (start + n).alias("stop_sample"), F.format_string("%s_e%04d_s%06d", "stem", F.col(epoch), start).alias("segment_id"), F.slice(samples, start + 1, n).alias("samples"))


def reorder_channels(df: DataFrame, keys: list[str], order: list[str], name: str = "channel", value: str = "value") -> DataFrame:
    """Values as an array in canonical channel order; NULL where a channel is absent, with the number of duplicates."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col(name).cast("string"), value)))).alias("m"), (F.count("*") - F.count_distinct(name)).alias("n_duplicates")).select(
        *keys, F.array(*[F.try_element_at("m", F.lit(c)) for c in order]).alias("values"), "n_duplicates"
    )


def assign_region(df: DataFrame, regions: DataFrame, on: str = "channel") -> DataFrame:
    """regions: (channel, region), one row per channel name of a montage."""
    return df.join(F.broadcast(regions) if regions.count() <= 10_000 else regions, on)


def validate_partition(channels: DataFrame, regions: DataFrame, on: str = "channel") -> DataFrame:
    """(problem, channel) for duplicate, unmapped and missing channels; empty when regions partition the channels."""
    twice = regions.groupBy(on).count().where("count > 1").select(F.lit("duplicate").alias("problem"), on)
    unmapped = channels.select(on).distinct().join(regions, on, "left_anti").select(F.lit("unmapped").alias("problem"), on)
    missing = regions.select(on).distinct().join(channels, on, "left_anti").select(F.lit("missing").alias("problem"), on)
    return twice.unionByName(unmapped).unionByName(missing)


def visit_rank(df: DataFrame, orders: DataFrame, key: str = "subject") -> DataFrame:
    """visit 0 or 1 of each session by the subject's recorded order ``first->second``, never by clock time."""
    parts = F.split("session_order", "->")
    rank = F.when(F.col("session") == F.get(parts, F.lit(0)), 0).when(F.col("session") == F.get(parts, F.lit(1)), 1)
    return df.join(orders, key, "left").withColumn("visit", rank)


def cap_per_group(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def trim_constant_ends(signal: DataFrame, key: str, sample: str, columns: list[str]) -> DataFrame:
    """Rows of the valid span: from the last leading constant run to the first trailing one, over all columns."""
    w = Window.partitionBy(key).orderBy(sample)
    changed = signal.select(key, sample, *[(F.col(c) != F.lag(c).over(w)).alias(f"c_{c}") for c in columns])
    ends = changed.groupBy(key).agg(*[F.min(F.when(F.col(f"c_{c}"), F.col(sample))).alias(f"lo_{c}") for c in columns], *[F.max(F.when(F.col(f"c_{c}"), F.col(sample))).alias(f"hi_{c}") for c in columns])
    lo = F.greatest(*[F.col(f"lo_{c}") for c in columns]) if len(columns) > 1 else F.col(f"lo_{columns[0]}")
    hi = F.least(*[F.col(f"hi_{c}") for c in columns]) if len(columns) > 1 else F.col(f"hi_{columns[0]}")
    span = ends.select(key, lo.alias("_lo"), hi.alias("_hi"))
    return signal.join(span, key).where(F.col(sample).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def far_outliers(df: DataFrame, keys: list[str], value: str, k: float = 3.0) -> DataFrame:
    """Rows outside [q1 - k IQR, q3 + k IQR] of their group, exact linear quantiles."""
    q = with_quantiles(df, keys, value, [0.25, 0.75]).select(*keys, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    return df.join(q, keys).where((F.col(value) < F.col("q1") - k * (F.col("q3") - F.col("q1"))) | (F.col(value) > F.col("q3") + k * (F.col("q3") - F.col("q1"))))


def sensitivity_filters(df: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """All candidate inclusion rules in one pass: subjects kept and removed under each."""
    flags = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("keep")) for n, c in rules.items()])
    return df.select(subject, F.inline(flags)).groupBy("rule").agg(F.count_if("keep").alias("n_kept"), F.count_if(~F.col("keep")).alias("n_removed"), F.min(F.when(~F.col("keep"), F.col(subject))).alias("first_removed"))


def nearest_channel(montage: DataFrame, template: DataFrame) -> DataFrame:
    """(name, x, y, z) rows, scaled to the unit sphere: the closest template name and its distance."""
    return nearest_on_sphere(montage, template)


def drop_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})
