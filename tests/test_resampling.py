from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import models, resampling


def test_counts_are_multinomial():
    """Counts of a row over 4,000 replicates are binomial, add up to n, and blocks share them as the tree says."""
    n, replicates, rows = 50, 4000, 8
    blocks = -(-n // rows)
    draws = np.stack([resampling.block_draws(b, blocks, n, replicates, 3, rows) for b in range(blocks)])
    assert (draws.sum(0) == n).all()
    counts = np.concatenate([resampling.row_counts(draws[b], min(rows, n - b * rows), np.random.default_rng([3, b])) for b in range(blocks)], axis=1)
    assert counts.shape == (replicates, n) and (counts.sum(1) == n).all()
    pmf = np.array([math.comb(n, k) * (1 / n) ** k * (1 - 1 / n) ** (n - k) for k in range(5)])
    pmf = np.append(pmf, 1 - pmf.sum())
    seen = np.array([(counts == k).sum() for k in range(5)] + [(counts > 4).sum()]) / counts.size
    chi2 = (counts.size * (seen - pmf) ** 2 / pmf).sum()
    assert chi2 < 20.5  # 99.9 % of 5 degrees of freedom
    for i, j in ((0, 1), (0, 49), (7, 8)):  # neighbours and rows of other blocks alike: covariance -1/n
        assert np.cov(counts[:, i], counts[:, j])[0, 1] == pytest.approx(-1 / n, abs=0.06)


def test_sums_do_not_depend_on_the_partitioning_and_have_the_right_spread(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(1)
    values = rng.normal(size=1000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(5000, None)], "i long, x double")
    found = []
    for parts in (1, 7):
        got = resampling.bootstrap_sums(df.repartition(parts), ["i"], {"n": F.when(F.col("x").isNotNull(), 1.0), "s": F.col("x")}, 2000, 5).toPandas().sort_values("replicate")
        assert got.replicate.tolist() == list(range(2000)) and (got.n == 1000).all()
        found.append(got.s.to_numpy())
    assert np.allclose(found[0], found[1])
    means = found[0] / 1000
    assert means.mean() == pytest.approx(values.mean(), abs=4 * values.std() / np.sqrt(1000) / np.sqrt(2000))
    assert means.std() == pytest.approx(values.std() / np.sqrt(1000), rel=0.07)
    assert resampling.bootstrap_sums(df.limit(0), ["i"], {"s": F.col("x")}, 10, 1).count() == 0


def test_scores_of_sums_are_the_scores_of_drawn_rows(spark, monkeypatch):
    """Replicates agree with plain resampling of the same table in mean and spread."""
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(a + rng.normal()), 0.0) for i, a in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "i long, y double, p double, m double")
    tree = resampling.scores_of(resampling.bootstrap_sums(df, ["i"], resampling.score_sums("y", "p", "m"), 400, 1)).toPandas()
    plain = models.bootstrap_statistic(df, "i", ["y", "p", "m"], models.q2_of("y", "p", "m"), 400, 1).toPandas()
    assert tree.q2.mean() == pytest.approx(plain.value.mean(), abs=0.04) and tree.q2.std() == pytest.approx(plain.value.std(), rel=0.25)


def series(spark):
    rng = np.random.default_rng(4)
    rows = []
    for p in range(4):
        for b in range(3 if p else 1):  # participant 0 has a single block: no fold
            a = rng.normal(size=(25, 2))
            rows += [(p, b, b * 100 + t, float(a[t, 0]), float(a[t, 1]), float(2 * a[t, 0] + 0.1 * rng.normal())) for t in range(25)]
    return spark.createDataFrame(rows, "p long, block long, t long, x1 double, x2 double, y double")


def test_surrogate_null_goes_on_after_an_interruption(spark, tmp_path):
    args = ("p", "t", ["x1", "x2"], "y", 2)
    key = lambda r: (r.participant, r.replicate)
    whole = {key(r): (r.n_folds, r.mean_r, r.mean_rmse) for r in resampling.surrogate_null(series(spark), *args, 5, 9, str(tmp_path / "a"), 3).collect()}
    assert len(whole) == 4 * 6 and all(whole["0", r][0] == 0 for r in range(-1, 5))
    # a run that stored some units, one of them without a result
    part = spark.read.parquet(str(tmp_path / "a")).where("replicate < 1 or participant = '2'")
    part.withColumn("n_folds", F.when(F.col("participant") != "3", F.col("n_folds"))).write.parquet(str(tmp_path / "b"))
    calls = []
    exact = resampling.surrogate_units
    resampling.surrogate_units = lambda df, *a: calls.append((sorted(r.p for r in df.select("p").distinct().collect()), a[5])) or exact(df, *a)
    try:
        again = {key(r): (r.n_folds, r.mean_r, r.mean_rmse) for r in resampling.surrogate_null(series(spark), *args, 5, 9, str(tmp_path / "b"), 3).collect()}
        resampling.surrogate_null(series(spark), *args, 5, 9, str(tmp_path / "b"), 3)
    finally:
        resampling.surrogate_units = exact
    assert calls == [([0, 1, 3], [-1, 0, 1]), ([0, 1, 3], [2, 3, 4])]
    assert again.keys() == whole.keys()
    for k, v in whole.items():
        assert again[k][0] == v[0] and all(a == b or a == pytest.approx(b) for a, b in zip(again[k][1:], v[1:], strict=True))
    # the observed series is predicted, its surrogates are not
    s = {r.participant: r for r in resampling.surrogate_summary(spark.createDataFrame([(p, r, *v) for (p, r), v in whole.items()], resampling.RESULT)).collect()}
    assert s[None].observed > 0.9 and s[None].p == pytest.approx(1 / 6) and s["1"].k == 5 and "0" not in s


def test_surrogate_units_against_loops(spark):
    """A replicate's surrogate of each block, by the same seeds in plain numpy, through plain least squares on the best subset."""
    rows = series(spark).toPandas()
    got = {r.participant: r for r in resampling.surrogate_units(series(spark), "p", "t", ["x1", "x2"], "y", 2, [3], 9).collect()}
    made = models.blockwise_iaaft(series(spark).selectExpr("cast(p as string) participant", "block", "t", "y"), ["participant", "block"], "t", "y", 1, 9 * 1_000_003 + 3).toPandas()
    own = rows.assign(participant=rows.p.astype(str)).merge(made, on=["participant", "block", "t"])
    selected = models.floating_forward_selection(spark.createDataFrame(own[["participant", "block", "x1", "x2"]].assign(y=own.surrogate)), "participant", ["x1", "x2"], "y", 2).toPandas()
    for p in ("1", "2", "3"):
        errors = []
        for f in selected[selected.key == p].itertuples():
            o = own[own.participant == p]
            train, test = o[o.block != f.fold], o[o.block == f.fold]
            design = lambda d, cols=list(f.selected): np.column_stack([np.ones(len(d)), *[d[c] for c in cols]])
            beta = np.linalg.lstsq(design(train), train.surrogate, rcond=None)[0]
            errors.append(np.sqrt(np.mean((test.surrogate - design(test) @ beta) ** 2)))
        assert got[p].n_folds == 3 and got[p].mean_rmse == pytest.approx(np.mean(errors), rel=1e-6)


def test_shift_against_change_and_block_lengths(spark):
    x = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0), (4, None)], "k int, x double")
    y = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 0.0), (5, 9.0)], "k int, y double")
    r = models.shift_against_change(x, y, ["k"], "x", "y").first()
    assert (r.n, r.rho) == (3, pytest.approx(-1)) and r.r == pytest.approx(np.corrcoef([1, 2, 4], [3, 1, 0])[0, 1])
    assert models.shift_against_change(x.where("k < 3"), y, ["k"], "x", "y").first().rho is None
    ev = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 21.0), ("b", 5.0)], "k string, t double")
    assert {r["key"]: r.block for r in models.block_lengths(ev, "k", "t", 5.0).collect()} == {"a": 5, "b": 1}
