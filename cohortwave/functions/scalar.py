"""Scalar expressions: log ratios, entropies, hash draws, keys, list columns. All are Spark columns; NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("", "n/a", "na", "nan", "none")


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def parse_numeric(c: Column) -> Column:
    """Trimmed text to a finite double; missing tokens and anything else are NULL."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(~text.isin(*MISSING), finite(text.try_cast("double")))


def is_missing(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*MISSING), F.lit(True))


def slowing_index(theta: Column, alpha: Column, beta: Column, eps: float = 1e-12) -> Column:
    """Log ratio of slow to fast power, an isometric coordinate: gains cancel."""
    return F.lit(math.sqrt(2 / 3)) * (F.ln(theta + eps) - 0.5 * (F.ln(alpha + eps) + F.ln(beta + eps)))


def delta_log(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """ln b - ln a; the floor enters only where a value isn't positive."""
    low = (a <= 0) | (b <= 0)
    return F.when(low, F.ln(F.greatest(b, F.lit(0.0)) + eps) - F.ln(F.greatest(a, F.lit(0.0)) + eps)).otherwise(F.ln(b) - F.ln(a))


def binary_entropy(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def differential_entropy(variance: Column) -> Column:
    return 0.5 * F.ln(F.lit(2 * math.pi * math.e) * F.greatest(variance, F.lit(1e-12)))


def log10_floor(x: Column, floor: float) -> Column:
    return F.log10(F.greatest(x, F.lit(floor)))


def hash_seed(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 of the pipe-joined parts, modulo 2**31 - 1."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(2**31 - 1)).cast("long")


def hash_draw(key: Column, n: Column | int) -> Column:
    """A draw from 0 to n - 1 out of the first 8 hex digits of SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % (n if isinstance(n, Column) else F.lit(n))


def segment_key(stem: Column, epoch: Column, start: Column) -> Column:
    return F.format_string("%s_e%04d_s%06d", stem, epoch, start)


def split_list(c: Column, separator: str = ";") -> Column:
    return F.filter(F.transform(F.split(c, "[" + separator + "]"), F.trim), lambda x: x != "")


def band_trapezoid(freqs: Column, psd: Column, lo: float, hi: float) -> Column:
    """Trapezoid area of psd over freqs from lo to hi, both ends included."""
    pairs = F.filter(F.arrays_zip(freqs.alias("f"), psd.alias("p")), lambda x: (x["f"] >= lo) & (x["f"] <= hi))
    steps = F.transform(F.sequence(F.lit(1), F.size(pairs) - 1), lambda i: (F.get(pairs, i)["f"] - F.get(pairs, i - 1)["f"]) * (F.get(pairs, i)["p"] + F.get(pairs, i - 1)["p"]) / 2)
    return F.when(F.size(pairs) > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def label_map(session: Column, labels: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in labels.items():
        out = F.when(session == k, F.lit(v)).otherwise(out)
    return out


def clock_minutes(text: Column) -> Column:
    """H:MM:SS to minutes; NULL where the text isn't a clock time."""
    part = lambda i: F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2}):([0-9]{2})$", i).try_cast("double")
    return part(1) * 60 + part(2) + part(3) / 60


def clock_delta(a: Column, b: Column) -> Column:
    """b - a in minutes on the clock circle, in (-720, 720]."""
    d = clock_minutes(b) - clock_minutes(a)
    return F.when(d > 720, d - 1440).when(d <= -720, d + 1440).otherwise(d)


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; NULL where a side is constant."""
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_samp(F.when(F.col(x).isNotNull(), F.col(y))), F.lit(0.0))
