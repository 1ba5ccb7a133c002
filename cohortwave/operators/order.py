"""Total order, ranks and quantiles over groups of any size.

Rows are dealt by range once and stored with their part and their place in it; what needs the order reads the stored
table, so that every reader sees the same parts. Running sums are taken within parts and carried from part to part.
Exact quantiles come from rounds of histograms, each of which narrows a quantile's range to one bin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwave.sources.tables import scratch

#: Rows (or distinct values) of one group that a plain window or percentile() takes in one task; larger groups are cut.
GROUP_ROWS = 1 << 20
#: Bins of a round of refinement.
BINS = 1024
#: Groups times quantiles that are broadcast at once (a few MB).
TARGETS = 50_000
#: monotonically_increasing_id() is part << 33 + place.
PLACE_BITS = 33


def stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_order(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df with _part and _place (from 0): parts are ranges of the order, rows are in order of their place within one."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    mask = F.lit((1 << PLACE_BITS) - 1)
    return stored(dealt, "order").select("*", F.shiftright("_id", PLACE_BITS).alias("_part"), F.col("_id").bitwiseAND(mask).alias("_place")).drop("_id")


def positions(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """df with the position of each row (1 to n) in the order. Rows that the order leaves equal have neighbouring positions."""
    dealt = stored_order(df, order)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    # a row for each part of a shuffle, so one small task and a small broadcast
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return dealt.join(F.broadcast(before), "_part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + F.col("_place") + 1).alias(name))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def matched(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b, where all columns are equal, nulls to nulls.

    b's columns get names of their own, as b is often made from a and a reference to either would then be ambiguous.
    """
    other = b.select(*[F.col(f"`{c}`").alias(f"_of_{i}") for i, c in enumerate(columns)], *[F.col(f"`{c}`") for c in b.columns if c not in columns])
    on = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(columns)], F.lit(True))
    return a.join(other, on, how).drop(*[f"_of_{i}" for i in range(len(columns))])


def sums_before(df: DataFrame, keys: list[str], x: str, weights: list[str], most: int | None = None) -> DataFrame:
    """df with _before_<weight>: each weight summed over the rows of the group with smaller x (x is distinct within a group).

    With a group of more than `most` rows, the sums are taken within stored parts and carried from part to part.
    """
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = lambda w, c: F.coalesce(F.sum(c).over(past(w)), F.lit(0))
    if largest_group(df, keys) <= (GROUP_ROWS if most is None else most):
        return df.withColumns({f"_before_{c}": over(Window.partitionBy(*keys).orderBy(x), c) for c in weights})
    dealt = stored_order(df, [*keys, x])
    inside = dealt.withColumns({f"_in_{c}": over(Window.partitionBy(*keys, "_part").orderBy("_place"), c) for c in weights})
    parts = dealt.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in weights])
    carried = parts.select(*keys, "_part", *[over(Window.partitionBy(*keys).orderBy("_part"), c).alias(f"_carry_{c}") for c in weights])
    joined = matched(inside, carried, [*keys, "_part"])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_in_{c}") + F.col(f"_carry_{c}")).alias(f"_before_{c}") for c in weights])


def average_ranks(df: DataFrame, keys: list[str], x: str, name: str, most: int | None = None) -> DataFrame:
    """df with ranks from 1 within groups, ties averaged; NULL values have no rank.

    Rows are counted by distinct value, and only distinct values are put in order where a group is large.
    """
    if largest_group(df, keys) <= (GROUP_ROWS if most is None else most):
        part, tie = Window.partitionBy(*keys, F.col(x).isNull()), Window.partitionBy(*keys, F.col(x))
        return df.withColumn(name, F.when(F.col(x).isNotNull(), F.rank().over(part.orderBy(x)) + (F.count("*").over(tie) - 1) / 2.0))
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    ranks = sums_before(counts, keys, x, ["_n"], most).select(*keys, x, (F.col("_before__n") + (F.col("_n") + 1) / 2.0).alias(name))
    return matched(df, ranks, [*keys, x], "left")


def with_quantiles(df: DataFrame, keys: list[str], x: str, at: list[float], aggs: tuple[Column, ...] | list[Column] = (), most: int | None = None) -> DataFrame:
    """(keys, aggs, q): aggregates of each group with the exact linear quantiles of x, NULL without values.

    No task holds more than `most` values of one group: the quantiles of larger ones are found in rounds.
    """
    most = GROUP_ROWS if most is None else most
    rows = df.select(*keys, F.col(x).cast("double").alias("_x")).where("_x is not null")
    if largest_group(rows, keys) <= most:
        return df.groupBy(*keys).agg(*aggs, F.percentile(F.col(x).cast("double"), F.array(*map(F.lit, at))).alias("q"))
    rows = stored(rows, "values")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), (F.lit(p) * (F.col("_n") - 1)).alias("_at")) for i, p in enumerate(at)]))
    wanted = sizes.select("*", place.alias("_p")).select("*", "_p._i", "_p._at")
    ranks = stored(wanted.select(*keys, "_lo", "_hi", "_i", "_at", "_n", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_k")), "ranks")
    found = selected(rows, ranks.select(*keys, "_k", "_lo", "_hi", "_n").distinct(), keys, most)
    j = matched(ranks.select(*keys, "_i", "_at", "_k"), found, [*keys, "_k"])
    low, high = F.min(F.struct("_k", "_value"))["_value"], F.max(F.struct("_k", "_value"))["_value"]
    share = F.max("_at") - F.floor(F.max("_at"))
    each = j.groupBy(*keys, "_i").agg(((1 - share) * low + share * high).alias("_v"))
    values = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("q"))
    groups = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    return matched(groups, values, keys, "left")


def selected(rows: DataFrame, targets: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, _k, _value): the value of rank _k (from 0) of each group, by histograms of the range that holds it.

    A range's least and largest value fall in different bins, so each round narrows every range; a range of one value or
    of at most `most` rows is done, and then its rows are put in order.
    """
    open_ = stored(targets.select(*keys, "_k", F.lit(0).cast("long").alias("_below"), "_lo", "_hi", F.col("_n").alias("_rows")), "ranges")
    done = None
    while True:
        ready = (F.col("_rows") <= most) | (F.col("_lo") == F.col("_hi"))
        finished = open_.where(ready)
        done = finished if done is None else done.unionByName(finished)
        waiting = open_.where(~ready)
        if waiting.isEmpty():
            break
        inside = held(rows, waiting, keys)
        bin_ = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS), F.lit(BINS - 1))
        bins = inside.groupBy(*keys, "_k", "_below", bin_.alias("_bin")).agg(F.count("*").alias("_rows"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        w = Window.partitionBy(*keys, "_k").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        bins = bins.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_rows").over(w), F.lit(0)))
        open_ = stored(bins.where((F.col("_below") <= F.col("_k")) & (F.col("_k") < F.col("_below") + F.col("_rows"))).select(*keys, "_k", "_below", "_lo", "_hi", "_rows"), "ranges")
    single = F.col("_lo") == F.col("_hi")
    some = held(rows, done.where(~single), keys)
    order = F.row_number().over(Window.partitionBy(*keys, "_k").orderBy("_x")) - 1
    exact = some.withColumn("_r", order + F.col("_below")).where("_r = _k").select(*keys, "_k", F.col("_x").alias("_value"))
    return done.where(single).select(*keys, "_k", F.col("_lo").alias("_value")).unionByName(exact)


def held(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with every range of their group that holds them."""
    few = ranges.count() <= TARGETS
    r = ranges.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_k", "_below", "_lo", "_hi")
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)], F.col("_x").between(F.col("_lo"), F.col("_hi")))
    return rows.join(F.broadcast(r) if few else r, match).select(*keys, "_x", "_k", "_below", "_lo", "_hi")
