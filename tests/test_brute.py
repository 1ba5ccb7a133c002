"""Registered queries that have no SQL, against plain loops over the rows that they read."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest

from cohortwave.operators import models
from cohortwave.plans import model_queries, registry, stat_queries
from cohortwave.plans.base import read

from .conftest import DATA

GRID = sorted(model_queries.ALPHAS)


def fit(x, y, alpha):
    """Ridge on standardised columns: a function from rows to predictions."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1.0, sd)
    z = (x - mean) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda v: (v - mean) / sd @ beta + y.mean()


def nested(x, y, grid=GRID):
    """(pred, m0, alpha) of every row by two nested leave-one-out loops."""
    out = []
    for i in range(len(y)):
        rest = np.arange(len(y)) != i
        xr, yr = x[rest], y[rest]
        error = [np.mean([(yr[j] - fit(np.delete(xr, j, 0), np.delete(yr, j), a)(xr[j])) ** 2 for j in range(len(yr))]) for a in grid]
        alpha = grid[int(np.argmin(np.round(error, 12)))]
        out.append((fit(xr, yr, alpha)(x[i]), yr.mean(), alpha))
    return out


def close(a, b):
    return (a is None and b is None) or pd.isna(a) and pd.isna(b) or a == pytest.approx(b, rel=1e-5, abs=1e-7)


def nations(spark):
    return model_queries.nation_features(spark, DATA).toPandas().sort_values("subject").dropna()


def m9(spark):
    f = nations(spark)
    want = dict(zip(f.subject, zip(f.y, nested(f[["a", "b", "c"]].to_numpy(float), f.y.to_numpy(float)), strict=True), strict=True))
    got = registry.QUERIES["m9_nested_loso"](spark, DATA).collect()
    assert len(got) == len(want)
    for r in got:
        y, own = want[r.subject]
        assert all(map(close, (r.y, r.pred, r.m0, r.alpha), (y, *own)))


def m10(spark):
    f = nations(spark)
    specs = {"features": (["a", "b", "c"], "y"), "confound_only": (["c"], "y"), "other_target": (["a", "b"], "z")}
    want = {(name, s): own for name, (columns, y) in specs.items() for s, own in zip(f.subject, nested(f[columns].to_numpy(float), f[y].to_numpy(float)), strict=True)}
    got = registry.QUERIES["m10_model_ladder"](spark, DATA).collect()
    assert len(got) == len(want) and all(map(close, (v for r in got for v in (r.pred, r.m0, r.alpha)), (v for r in got for v in want[r.model, r.subject])))


def m11(spark):
    """Two of the query's replicates and the observed value by loops; the summary by pandas."""
    f = nations(spark)
    x, y = f[["a", "b", "c"]].to_numpy(float), f.y.to_numpy(float)
    null = {r.replicate: r.q2 for r in models.permutation_null(model_queries.nation_features(spark, DATA), "subject", ["a", "b", "c"], "y", model_queries.ALPHAS, 200, 1).collect()}
    import hashlib

    for replicate in (-1, 0, 7):
        own = y
        if replicate >= 0:
            order = sorted(range(len(f)), key=lambda i: hashlib.sha256(f"1:{replicate}:{f.subject.iloc[i]}".encode()).hexdigest())
            own = np.empty(len(y))
            own[order] = y
        found = np.asarray([(p, m) for p, m, _ in nested(x, own)])
        assert null[replicate] == pytest.approx(1 - ((own - found[:, 0]) ** 2).sum() / ((own - found[:, 1]) ** 2).sum(), rel=1e-5)
    rest = np.asarray([v for k, v in null.items() if k >= 0])
    r = registry.QUERIES["m11_permutation_null"](spark, DATA).first()
    assert (r.b, r.p) == (200, pytest.approx((1 + (rest >= null[-1]).sum()) / 201))
    assert np.allclose([r.observed, r.null_mean, r.null_sd, r.null_p95], [null[-1], rest.mean(), rest.std(ddof=1), np.quantile(rest, 0.95)])


def m17(spark):
    """Every block's surrogates hold its values in another order, twice, and nearly its spectrum where it is long."""
    rows = model_queries.blocked(spark, DATA).toPandas().dropna(subset=["s"])
    got = registry.QUERIES["m17_blockwise_iaaft"](spark, DATA).toPandas()
    assert len(got) == 2 * len(rows)
    made = {k: g.sort_values("event_id") for k, g in got.groupby(["user_id", "block", "replicate"])}
    alike = []
    for (user, block), part in rows.groupby(["user_id", "block"]):
        part = part.sort_values("event_id")
        for i in range(2):
            own = made[user, block, i]
            assert own.event_id.tolist() == part.event_id.tolist() and np.array_equal(np.sort(own.surrogate), np.sort(part.s))
            if len(part) > 12:
                a, b = (np.abs(np.fft.rfft(v - v.mean()))[1:] for v in (part.s.to_numpy(), own.surrogate.to_numpy()))
                alike.append(np.corrcoef(a, b)[0, 1])
    assert np.mean(alike) > 0.9


def per_fold(spark, name, one):
    rows = model_queries.fold_table(spark, DATA).toPandas().dropna()
    want = {}
    for user, part in rows.groupby("user_id"):
        for block in part.block.unique():
            test = (part.block == block).to_numpy()
            if (~test).sum() > 3:
                x, y = part[["x1", "x2", "x3", "x4"]].to_numpy(float), part.y.to_numpy(float)
                want[user, block] = ((~test).sum(), test.sum(), *one(x[~test], y[~test], part.block.to_numpy()[~test], x[test], y[test]))
    got = {(r[0], r.fold): tuple(r)[2:] for r in registry.QUERIES[name](spark, DATA).collect()}
    assert got.keys() == want.keys()
    return got, want


def scores(y, pred):
    flat = y.std() < 1e-9 or pred.std() < 1e-6 or len(y) < 2
    return (None if flat else float(np.corrcoef(y, pred)[0, 1])), float(np.sqrt(np.mean((y - pred) ** 2)))


def m18(spark):
    def one(x, y, _, xt, yt):
        mean, sd = x.mean(0), x.std(0)
        sd = np.where(sd < 1e-12, 1.0, sd)
        _, s, v = np.linalg.svd((x - mean) / sd, full_matrices=False)
        keep = s**2 / (s**2).sum() >= 0.01
        design = lambda u: np.column_stack([np.ones(len(u)), (u - mean) / sd @ v[keep].T])
        beta = np.linalg.lstsq(design(x), y, rcond=None)[0]
        return int(keep.sum()), *scores(yt, design(xt) @ beta)

    got, want = per_fold(spark, "m18_block_cv_pca_ols", one)
    for k, (n_train, n_test, components, r, rmse) in got.items():
        assert (n_train, n_test, components) == want[k][:3] and rmse == pytest.approx(want[k][4], rel=1e-4)
        assert n_test < 3 or r is None or want[k][3] is None or r == pytest.approx(want[k][3], abs=1e-3)


def m19(spark):
    """The inner error of the chosen subset is no worse than any of one column, and its scores are those of OLS on it."""

    def inner(x, y, blocks, subset):
        design = lambda u: np.column_stack([np.ones(len(u)), u[:, subset]])
        sse = 0.0
        for b in np.unique(blocks):
            train = blocks != b if len(np.unique(blocks)) > 1 else blocks == b
            beta = np.linalg.lstsq(design(x[train]), y[train], rcond=None)[0]
            sse += ((y[blocks == b] - design(x[blocks == b]) @ beta) ** 2).sum()
        return np.sqrt(sse / len(y))

    def one(x, y, blocks, xt, yt):
        return x, y, blocks, xt, yt

    got, want = per_fold(spark, "m19_floating_forward_selection", one)
    for k, (n_train, n_test, selected, r, rmse) in itertools.islice(got.items(), 60):
        x, y, blocks, xt, yt = want[k][2:]
        subset = [int(c[1]) - 1 for c in selected]
        assert (n_train, n_test) == want[k][:2] and len(subset) <= 3
        others = [[], *([c] for c in range(4))]
        assert inner(x, y, blocks, subset) <= min(inner(x, y, blocks, o) for o in others) * (1 + 1e-3) + 1e-6
        design = lambda u: np.column_stack([np.ones(len(u)), u[:, subset]])  # noqa: B023, E731
        beta = np.linalg.lstsq(design(x), y, rcond=None)[0]
        assert rmse == pytest.approx(scores(yt, design(xt) @ beta)[1], rel=1e-3, abs=1e-5)


def tail(density, x, far=2_000.0):
    grid = np.concatenate([np.linspace(x, x + 50, 200_001), np.linspace(x + 50, far, 400_001)[1:]])
    return np.trapezoid(density(grid), grid)


def gamma_ratio(a, b):
    from math import exp, lgamma

    return exp(lgamma(a) - lgamma(b))


def a29(spark):
    rows = stat_queries.pairs(spark, DATA).toPandas()
    got = {r.user_id: r for r in registry.QUERIES["a29_t_test"](spark, DATA).collect()}
    for user, part in list(rows.groupby("user_id"))[:15]:
        d = (part.a - part.b).dropna()
        n = len(d)
        if n < 3:
            continue
        t = d.mean() / (d.std() / np.sqrt(n))
        density = lambda v, k=n - 1: gamma_ratio((k + 1) / 2, k / 2) / np.sqrt(k * np.pi) * (1 + v * v / k) ** (-(k + 1) / 2)
        assert got[user].n == n and got[user].t == pytest.approx(t) and got[user].p == pytest.approx(2 * tail(density, abs(t)), abs=2e-4)


def a30(spark):
    rows = stat_queries.pairs(spark, DATA).toPandas()
    got = {r.user_id: r for r in registry.QUERIES["a30_wilcoxon_p_value"](spark, DATA).collect()}
    for user, part in rows.groupby("user_id"):
        x = (part.a - part.b) / 5
        d = np.sign(x) * np.floor(np.abs(x) + 0.5)
        d = d[d != 0].dropna()
        if not len(d):
            continue
        rank, n = d.abs().rank(), len(d)
        ties = d.abs().value_counts()
        z = (rank[d > 0].sum() - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
        density = lambda v: np.exp(-v * v / 2) / np.sqrt(2 * np.pi)
        assert (got[user].n, got[user].w_plus) == (n, rank[d > 0].sum()) and got[user].z == pytest.approx(z)
        assert got[user].p == pytest.approx(min(1.0, 2 * tail(density, abs(z), 60.0)), abs=1e-6)


def a10(spark):
    """The interval's ends turn the F ratio into the quantiles of F at 2.5 %, by integration of its density."""
    li = read(spark, DATA, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_quantity").toPandas()
    li["l_quantity"] = li["l_quantity"].astype(float)
    got = {r.g: r for r in registry.QUERIES["a10_icc_interval"](spark, DATA).collect()}

    def f_tail(x, d1, d2):
        c = gamma_ratio((d1 + d2) / 2, d1 / 2) / np.exp(__import__("math").lgamma(d2 / 2)) * (d1 / d2) ** (d1 / 2)
        return tail(lambda v: c * v ** (d1 / 2 - 1) * (1 + d1 * v / d2) ** (-(d1 + d2) / 2), x)

    for g, part in li.groupby("l_returnflag"):
        wide = part.groupby(["l_suppkey", "l_linenumber"]).l_quantity.mean().unstack()
        wide = wide[wide.notna().sum(axis=1) == wide.notna().sum(axis=1).max()]
        if g not in got or wide.isna().any().any() or len(wide) < 2:
            continue
        n, k = wide.shape
        v = wide.to_numpy()
        msr = k * v.mean(1).var(ddof=1)
        msc = n * v.mean(0).var(ddof=1)
        mse = ((v - v.mean(1, keepdims=True) - v.mean(0) + v.mean()) ** 2).sum() / ((n - 1) * (k - 1))
        icc = (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)
        r = got[g]
        assert (r.n, r.k) == (n, k) and r.icc == pytest.approx(icc) and r.lower < icc < r.upper
        assert r.p == pytest.approx(f_tail(msr / mse, n - 1, (n - 1) * (k - 1)), abs=1e-4)
        a, b = k * icc / (n * (1 - icc)), 1 + k * icc * (n - 1) / (n * (1 - icc))
        df = (a * msc + b * mse) ** 2 / ((a * msc) ** 2 / (k - 1) + (b * mse) ** 2 / ((n - 1) * (k - 1)))
        rest = k * msc + (k * n - k - n) * mse
        low = n * msr * (1 - r.lower) / (n * mse + r.lower * rest)
        high = (n * mse + r.upper * rest) / (n * msr * (1 - r.upper))
        assert f_tail(low, n - 1, df) == pytest.approx(0.025, abs=5e-4) and f_tail(high, df, n - 1) == pytest.approx(0.025, abs=5e-4)


def m12_tree(spark):
    """Mean and spread of the query's replicates against numpy's own resampling of the same lines."""
    li = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_extendedprice", "l_quantity").toPandas()
    y = li.l_extendedprice.to_numpy(float)
    error, base = y - li.l_quantity.to_numpy(float) * 1500, y - 38000.0
    rng = np.random.default_rng(0)
    at = rng.integers(0, len(y), (400, len(y)))
    want = {"q2": 1 - (error[at] ** 2).sum(1) / (base[at] ** 2).sum(1), "mae_skill": 1 - np.abs(error[at]).sum(1) / np.abs(base[at]).sum(1)}
    for r in registry.QUERIES["m12_tree_bootstrap"](spark, DATA).collect():
        own, sd = want[r.score], want[r.score].std()
        assert r.b == 200 and r["mean"] == pytest.approx(own.mean(), abs=0.4 * sd)
        assert r.lower == pytest.approx(np.quantile(own, 0.025), abs=0.9 * sd) and r.upper == pytest.approx(np.quantile(own, 0.975), abs=0.9 * sd)


def m19_null(spark):
    """The observed R of every participant is the mean over the folds of the selection itself; p is one of the four values that three surrogates allow."""
    folds = registry.QUERIES["m19_floating_forward_selection"](spark, DATA).toPandas()
    want = folds.assign(r=folds.r.astype(float)).groupby("key").r.mean()
    got = {r.participant: r for r in registry.QUERIES["m19_surrogate_null"](spark, DATA).collect()}
    assert {k for k in got if k is not None} == {str(k) for k, v in want.items() if v == v} and None in got
    for k, r in got.items():
        assert r.k == 3 and min(abs(4 * r.p - i) for i in (1, 2, 3, 4)) < 1e-9
        if k is not None:
            assert r.observed == pytest.approx(want[int(k)], abs=1e-6)
    assert got[None].observed == pytest.approx(want.mean(), abs=1e-6)


BRUTE = {"m12_tree_bootstrap": m12_tree, "m19_surrogate_null": m19_null, "m9_nested_loso": m9, "m10_model_ladder": m10, "m11_permutation_null": m11, "m17_blockwise_iaaft": m17, "m18_block_cv_pca_ols": m18, "m19_floating_forward_selection": m19, "a29_t_test": a29, "a30_wilcoxon_p_value": a30, "a10_icc_interval": a10}


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_query(spark, name):
    BRUTE[name](spark)


def test_every_query_has_sql_or_a_brute_force_version():
    assert registry.QUERIES.keys() == registry.ORACLES.keys() | BRUTE.keys()


def test_nested_validation_over_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((31, 2)), rng.standard_normal(31)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(31)], "s int, a double, b double, y double")
    want = nested(x, y, [0.1, 10.0])
    monkeypatch.setattr(models, "CELL_ROWS", 6)
    got = {r.subject: r for r in models.nested_loso(df.repartition(3), "s", ["a", "b"], "y", [10.0, 0.1]).collect()}
    assert len(got) == 31 and all(map(close, (v for i in got for v in (got[i].pred, got[i].m0, got[i].alpha)), (v for i in got for v in want[i])))
    assert models.nested_loso(df.limit(2), "s", ["a", "b"], "y", [1.0]).count() == 0
