"""Sorts, top-k, set comparisons and reshapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwave.operators.order import positions


def worst_row(df: DataFrame, keys: list[str], row: str, diff: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(row, diff).alias(row), F.max(diff).alias(diff))


def best_by(df: DataFrame, keys: list[str], score: str, choice: str) -> DataFrame:
    """Smallest score of each group; ties go to the smaller choice."""
    return df.groupBy(*keys).agg(F.min(F.struct(F.col(score).alias("score"), F.col(choice).alias("choice"))).alias("b")).select(*keys, "b.score", "b.choice")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def canonical_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Position of each row in a total order, without a single-task sort; the ordered rows are stored once."""
    return positions(df, order)


def subject_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key of either side once, with the side that holds it."""
    marked = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    both = marked.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.select(key, F.when(F.col("a") + F.col("b") == 2, "both").when(F.col("a") == 1, "only_a").otherwise("only_b").alias("side"))


def union_conditions(tables: dict[int, DataFrame]) -> DataFrame:
    """Stack the tables of several conditions under their labels; columns that one lacks are NULL."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [t.withColumn("label", F.lit(k)) for k, t in tables.items()])


def to_wide(df: DataFrame, keys: list[str], name: str, value: Column, values: list[str], prefix: str = "") -> DataFrame:
    """One column per listed name; the list is explicit, so no extra job looks for it."""
    wide = df.groupBy(*keys).pivot(name, values).agg(value)
    return wide.select(*keys, *[F.col(v).alias(prefix + v) for v in values])


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "observable", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)
