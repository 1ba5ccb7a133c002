"""Total order, ranks and quantiles of large groups: stored parts, running sums over several of them, refinement."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import aggregates, order, shape


@pytest.fixture
def setting(spark):
    """Change session settings for one test."""
    old = {}

    def put(**values):
        for key, value in values.items():
            name = key.replace("__", ".")
            old.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in old.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("rows, wide, adaptive", [(300_000, False, "true"), (300_000, True, "true"), (300_000, False, "false"), (2_000_000, False, "true"), (2_000_000, False, "false"), (20_000, True, "true")])
def test_positions_are_one_to_n(spark, setting, rows, wide, adaptive):
    setting(spark__sql__adaptive__enabled=adaptive, spark__sql__shuffle__partitions="200")
    df = spark.range(rows).select((F.xxhash64("id") % 1_000_003).alias("h"), "id")
    if wide:
        df = df.withColumn("text", F.repeat(F.sha2(F.col("id").cast("string"), 256), 6))
    got = shape.canonical_positions(df, ["h", "id"])
    assert got.columns == [*df.columns, "position"]
    # 1..n without a gap or repeat, and in the asked order
    facts = got.agg(F.count("*"), F.count_distinct("position"), F.min("position"), F.max("position"), F.count_distinct("id")).first()
    assert tuple(facts) == (rows, rows, 1, rows, rows)
    want = df.select("h", "id").toPandas().sort_values(["h", "id"])["id"].to_numpy()
    seen = got.select("id", "position").toPandas().sort_values("position")["id"].to_numpy()
    assert np.array_equal(want, seen)


def test_positions_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(3, None), (1, "a"), (None, "b"), (1, None)], "x int, y string")
    got = sorted(tuple(r) for r in order.positions(df, ["x", "y"], "n").select("n", "x", "y").collect())
    assert got == [(1, None, "b"), (2, 1, None), (3, 1, "a"), (4, 3, None)]
    assert order.positions(df.limit(0), ["x"]).count() == 0


def groups(spark, seed=1, rows=6000):
    """Groups of very different size, one of them null; many ties, some NULL values."""
    rng = np.random.default_rng(seed)
    g = rng.choice(["a", "b", "c", None], rows, p=[0.8, 0.1, 0.05, 0.05])
    x = np.where(rng.random(rows) < 0.5, rng.integers(0, 40, rows), rng.standard_cauchy(rows) * 1e3)
    data = [(k, None if i % 17 == 0 else float(v), i, int(rng.random() < 0.4)) for i, (k, v) in enumerate(zip(g.tolist(), x.tolist(), strict=True))]
    return spark.createDataFrame(data, "g string, x double, id int, y int"), pd.DataFrame(data, columns=["g", "x", "id", "y"])


@pytest.mark.parametrize("most", [10, 10_000])
def test_average_ranks(spark, most):
    df, pdf = groups(spark)
    got = order.average_ranks(df, ["g"], "x", "r", most).toPandas().sort_values("id")
    want = pdf.groupby("g", dropna=False)["x"].rank()
    assert np.array_equal(got["r"].to_numpy(float), want.to_numpy(float), equal_nan=True)
    assert got.columns.tolist() == ["g", "x", "id", "y", "r"]


@pytest.mark.parametrize("most", [5, 300])
def test_quantiles_by_refinement(spark, most):
    df, pdf = groups(spark, 2)
    at = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: (r.n, r.q) for r in order.with_quantiles(df, ["g"], "x", at, [F.count("x").alias("n")], most).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        n, q = got[None if not isinstance(g, str) else g]
        v = part["x"].dropna()
        assert n == len(v)
        np.testing.assert_allclose(q, np.percentile(v, [100 * p for p in at]), rtol=1e-12)
    assert len(got) == 4


def test_quantiles_of_odd_groups(spark):
    rows = [("one", 4.0), ("same", 2.0), ("same", 2.0), ("same", 2.0), ("none", None), *[("far", v) for v in (1e-300, 2e-300, 1.0, 1e300, -1e300, 3.0)]]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q for r in order.with_quantiles(df, ["g"], "x", [0.5, 1.0], most=1).collect()}
    assert got["one"] == [4.0, 4.0] and got["same"] == [2.0, 2.0] and got["none"] is None
    assert got["far"] == [np.median([1e-300, 2e-300, 1.0, 1e300, -1e300, 3.0]), 1e300]
    whole = order.with_quantiles(df.where("g = 'far'"), [], "x", [0.5], most=2).collect()
    assert [r.q for r in whole] == [[0.5]]


def test_pooled_auc_and_rank_correlation_over_several_parts(spark, setting, monkeypatch):
    """One group larger than a task may hold gives what the plain window gives."""
    df, _ = groups(spark, 3)
    df = df.withColumn("p", (F.col("id") * 7919 % 1009) / 1009)
    plain = [aggregates.classification_metrics(df, ["g"], "y", "p"), aggregates.binned_auc(df.where("x is not null"), [], "y", "x"), aggregates.spearman(df, ["g"], "x", "p"), aggregates.percentile_summary(df, ["g"], "x"), aggregates.bland_altman(df, ["g"], "x", "p")]
    want = [sorted(map(str, d.collect())) for d in plain]
    monkeypatch.setattr(order, "GROUP_ROWS", 20)
    setting(spark__sql__adaptive__coalescePartitions__enabled="false")
    cut = [aggregates.classification_metrics(df, ["g"], "y", "p"), aggregates.binned_auc(df.where("x is not null"), [], "y", "x"), aggregates.spearman(df, ["g"], "x", "p"), aggregates.percentile_summary(df, ["g"], "x"), aggregates.bland_altman(df, ["g"], "x", "p")]
    for a, b in zip(want, cut, strict=True):
        rows = sorted(map(str, b.collect()))
        assert len(a) == len(rows)
        for x, y in zip(a, rows, strict=True):
            assert x == y or np.allclose([float(v) for v in numbers(x)], [float(v) for v in numbers(y)], rtol=1e-9)


def numbers(text):
    import re

    return re.findall(r"-?\d+\.?\d*(?:e[-+]?\d+)?", text)
