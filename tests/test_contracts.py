"""Mathematical contracts on synthetic signals, closed forms, leakage boundaries and negative controls."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwave.functions import scalar, spectral, tails
from cohortwave.operators import aggregates as agg
from cohortwave.operators import clean, models, pairing, windows
from cohortwave.sources import tables

FS, N = 500.0, 2000


def tones(gain=1.0, theta=1.0, n=8, seed=0, wobble=0.0):
    rng = np.random.default_rng(seed)
    t = np.arange(N) / FS
    out = []
    for _ in range(n):
        a = theta * (1 + wobble * rng.standard_normal())
        out.append(gain * sum(w * np.sin(2 * np.pi * f * t + rng.uniform(0, 6.28)) for f, w in ((6, a), (10, 1.0), (20, 0.7))))
    return np.asarray(out)


def index_of(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "epoch int, samples array<float>")
    p = spectral.band_powers(df, FS, {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)})
    s = p.select("epoch", scalar.slowing_index(F.col("theta"), F.col("alpha"), F.col("beta")).alias("s"))
    return agg.level_and_dispersion(s, [], "s").first()


def test_gain_cancels_and_slow_power_raises_the_level(spark):
    a, b, c = (index_of(spark, x) for x in (tones(), tones(gain=7.0), tones(theta=2.0)))
    assert a.m == pytest.approx(b.m, abs=1e-4) and a.j == pytest.approx(b.j, abs=1e-4)
    assert c.m > a.m + 0.5
    assert index_of(spark, tones(wobble=0.3)).j > 5 * a.j


def test_welch_against_a_plain_loop():
    x = np.random.default_rng(1).standard_normal(64)
    _, density = spectral.welch(x[None], 64.0, 32, 16)
    want = np.zeros(17)
    for s in (0, 16, 32):
        v = x[s : s + 32] - x[s : s + 32].mean()
        w = [0.5 - 0.5 * np.cos(2 * np.pi * i / 32) for i in range(32)]
        for k in range(17):
            c = sum(v[i] * w[i] * np.exp(-2j * np.pi * k * i / 32) for i in range(32))
            want[k] += abs(c) ** 2 / (64 * sum(u * u for u in w)) * (1 if k in (0, 16) else 2) / 3
    assert np.allclose(density[0], want)


def test_band_entropy_of_a_sine_is_that_of_its_variance(spark):
    t = np.arange(256) / 256
    df = spark.createDataFrame([(0, [float(v) for v in 3 * np.sin(2 * np.pi * 10 * t)]), (1, None), (2, [])], "epoch int, samples array<float>")
    got = {r.epoch: r.alpha for r in spectral.band_entropy(df, 256.0, {"alpha": (8.0, 14.0)}).collect()}
    assert got[0] == pytest.approx(0.5 * np.log(2 * np.pi * np.e * 4.5 * 256 / 255), abs=1e-5) and got[1] is None and got[2] is None


def test_dynamics_of_ramp_and_noise(spark):
    rng = np.random.default_rng(2)
    rows = [("ramp", i, 0.5 * i) for i in range(20)] + [("iid", i, float(v)) for i, v in enumerate(rng.standard_normal(4000))] + [("two", 0, 1.0), ("two", 1, 2.0)]
    r = {x.k: x for x in windows.dynamic_features(spark.createDataFrame(rows, "k string, i int, s double"), ["k"], "i").collect()}
    assert r["ramp"].j_res == pytest.approx(0, abs=1e-6) and r["ramp"].d == pytest.approx(10) and r["ramp"].v == pytest.approx(0.5 / np.sqrt(2))
    assert r["iid"].v == pytest.approx(r["iid"].j, rel=0.05) and r["two"].d is None


def test_windows_are_disjoint_and_drop_the_tail(spark):
    df = spark.createDataFrame([(1, i) for i in range(23)], "k int, i int")
    got = sorted((r.window_index, r.i) for r in windows.disjoint_windows(df, ["k"], "i", 5, burn=2).collect())
    assert [i for _, i in got] == list(range(2, 22)) and [w for w, _ in got] == [n // 5 for n in range(20)]


def test_ridge_against_normal_equations_and_collinear_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 3))
    x[:, 2] = x[:, 0]
    y = 3 * x[:, 0] + rng.standard_normal(60)
    df = spark.createDataFrame([(0, *map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "g int, a double, b double, c double, y double")
    m = models.ridge_fit(df, ["g"], ["a", "b", "c"], "y", 0.5).first()
    z = x - x.mean(0)
    beta = np.linalg.solve(z.T @ z + 0.5 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose([m.b_a, m.b_b, m.b_c], beta, atol=1e-8) and m.intercept == pytest.approx(y.mean() - x.mean(0) @ beta)


def plain_inner(x, y, alphas):
    out = []
    for a in alphas:
        e = []
        for j in range(len(y)):
            k = np.arange(len(y)) != j
            beta, m, s, b = models.ridge_from_moments(models.moments(x[k], y[k]).sum(0)[None], np.asarray([a]))
            e.append((y[j] - b[0] - ((x[j] - m[0]) / s[0]) @ beta[0, 0]) ** 2)
        out.append(np.mean(e))
    return out


def test_nested_validation_noise_signal_and_leakage(spark):
    rng = np.random.default_rng(4)
    x, noise = rng.standard_normal((29, 3)), rng.standard_normal(29)
    grid = np.asarray([0.1, 1.0, 10.0, 100.0])
    total, none = models.moments(x, noise).sum(0), np.zeros((1, 5, 5))
    assert np.allclose(models.inner_errors(total, none, x, noise, np.zeros((1, 29), bool), grid)[0] / 29, plain_inner(x, noise, grid))
    df = spark.createDataFrame([(i, *map(float, x[i]), float(noise[i]), float(3 * x[i, 0] + 0.3 * noise[i])) for i in range(29)], "s int, a double, b double, c double, n double, y double")
    q = {}
    for target in ("n", "y"):
        r = models.nested_loso(df, "s", ["a", "b", "c"], target, [0.1, 1.0, 10.0, 100.0]).toPandas()
        assert len(r) == 29
        for row in r.itertuples():
            assert row.m0 == pytest.approx((r.y.sum() - row.y) / 28)
        q[target] = 1 - ((r.y - r.pred) ** 2).sum() / ((r.y - r.m0) ** 2).sum()
    assert q["n"] <= 0.1 and q["y"] > 0.5
    moved = df.withColumn("y", F.when(F.col("s") == 3, 1e6).otherwise(F.col("y")))
    a, b = (models.nested_loso(t, "s", ["a", "b", "c"], "y", [1.0]).where("s = 3" if False else "subject = 3").first().pred for t in (df, moved))
    assert a == pytest.approx(b)


def test_permutation_p_and_interval(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(v), float(v + 0.2 * e)) for i, (v, e) in enumerate(rng.standard_normal((20, 2)))], "s int, a double, y double")
    null = models.permutation_null(df, "s", ["a"], "y", [1.0], 40, 7)
    r = models.null_summary(null).first()
    assert r.b == 40 and r.p == pytest.approx(1 / 41) and r.observed > 0.5
    again = {x.replicate: x.q2 for x in models.permutation_null(df.repartition(3), "s", ["a"], "y", [1.0], 40, 7).collect()}
    assert all(again[x.replicate] == pytest.approx(x.q2) for x in null.collect())
    ci = models.paired_bootstrap_ci(df, "s", "y", 200, 1).first()
    assert ci.lower <= df.agg(F.avg("y")).first()[0] <= ci.upper


def test_surrogates_keep_values_and_nearly_the_spectrum(spark):
    v = np.cumsum(np.random.default_rng(6).standard_normal(200))
    s = models.iaaft(v, np.random.default_rng(1))
    assert np.array_equal(np.sort(s), np.sort(v)) and not np.array_equal(s, v)
    a, b = np.abs(np.fft.rfft(v)), np.abs(np.fft.rfft(s))
    assert np.corrcoef(a, b)[0, 1] > 0.98


def test_selection_finds_the_columns_that_matter(spark):
    rng = np.random.default_rng(7)
    rows = []
    for b in range(5):
        for _ in range(40):
            x = rng.standard_normal(4)
            rows.append((1, b, *map(float, x), float(2 * x[1] - x[3] + 0.1 * rng.standard_normal())))
    df = spark.createDataFrame(rows, "p int, block long, a double, b double, c double, d double, y double")
    got = models.floating_forward_selection(df, "p", ["a", "b", "c", "d"], "y", 2).collect()
    assert len(got) == 5 and all(r.selected == ["b", "d"] and r.r > 0.95 for r in got)
    assert all(r.r > 0.95 for r in models.block_cv_pca_ols(df, "p", ["a", "b", "c", "d"], "y").collect())


def test_finite_samples_match_the_analytic_spread(spark):
    for r in models.finite_sample_dispersion(spark.range(60_000).selectExpr('id', '2 * randn(3) as x'), 'id', 'x', [8, 60], 1).collect():
        assert r.spread == pytest.approx(r.analytic, rel=0.1) and r.bias < 0.01


# negative controls: every checker must bite


def stream(spark):
    rows = [("u", 0, e) for e in range(10)] + [("u", 1, e) for e in range(20, 27)]
    return windows.ordered_batches(spark.createDataFrame(rows, "s string, visit int, epoch int"), ["s"], "visit", "epoch", 4)


def test_stream_order_check_bites(spark):
    good = stream(spark)
    check = lambda df: windows.stream_order_check(df, ["s"], "epoch", "visit").first().asDict()
    zero = {"s": "u", "not_ascending": 0, "repeats": 0, "batch_backwards": 0, "bad_positions": 0, "mixed_batches": 0, "wrong_sizes": 0}
    assert check(good) == zero
    assert check(good.withColumn("epoch", -F.col("epoch")))["not_ascending"] > 0
    assert check(good.where("stream_position <> 3"))["bad_positions"] == 1
    assert check(good.withColumn("batch_index", F.lit(0)))["mixed_batches"] == 1
    assert check(good.unionByName(good.limit(1)))["repeats"] == 1
    assert check(good.withColumn("batch_n", F.lit(4)))["wrong_sizes"] > 0


def test_fold_checks_bite(spark):
    s = spark.createDataFrame([(i,) for i in range(7)], "subject int")
    folds = models.loso_folds(s, "subject", 1, 0.3)
    check = lambda f: tuple(models.fold_partition_check(f, "subject").first())
    assert check(folds) == (0, 0, 0, 0)
    assert folds.where("role = 'validation'").count() == 7 * 2
    leaked = folds.unionByName(folds.where("fold_id = 2 and role = 'test'").withColumn("role", F.lit("train")))
    assert check(leaked)[0] == 1
    assert check(folds.where("not (fold_id = 1 and role = 'test')"))[1] == 1
    blocks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "k string, block int")
    tested = spark.createDataFrame([("a", 0), ("b", 0), ("b", 5)], "k string, block int")
    assert {r.k: (r.complete, r.strangers) for r in models.fold_invariants(tested, blocks, ["k"]).collect()} == {"a": (False, 0), "b": (False, 1)}


def test_sample_sets_and_table_diff_bite(spark):
    pred = spark.createDataFrame([(a, 1, i) for a in "xy" for i in range(5)], "arm string, s int, seg int")
    sig = lambda p: pairing.same_sample_sets(p, "arm", ["s"], ["seg"]).first().n_signatures
    assert sig(pred) == 1 and sig(pred.where("not (arm = 'x' and seg = 2)")) == 2
    t = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k int, v double, l string")
    same = lambda e, a: pairing.table_diff(e, a, "k", ["v"], ["l"], 1e-9).first()
    assert same(t, t).same and not same(t, t.where("k = 1")).same
    d = same(t, t.withColumn("v", F.col("v") + F.when(F.col("k") == 2, 0.5).otherwise(0.0)))
    assert (d.worst_v, d.max_v, d.same) == (2, 0.5, False)


def test_masks_blocks_and_censoring(spark):
    s = spark.createDataFrame([("r", float(t)) for t in range(0, 400, 10)], "k string, t double")
    b = windows.blocks_from_gaps(spark.createDataFrame([("r", float(t)) for t in (20, 60, 100, 250, 300)], "k string, t double"), ["k"], "t", 90.0)
    assert sorted((r.start_s, r.stop_s) for r in b.collect()) == [(20, 100), (250, 300)]
    span = spark.createDataFrame([("r", 10.0, 290.0)], "k string, valid_lo double, valid_hi double")
    m = pairing.driving_mask(s, b, span, ["k"], "t")
    got = {r.state: r["count"] for r in m.groupBy("state").count().collect()}
    assert got == {"driving": 9 + 5, "gap": 15, "invalid": 11}
    smooth = windows.block_local_mean(m.withColumn("x", F.col("t")), ["k"], "t", "x", 2).where("block is null and smooth is not null")
    assert smooth.count() == 0
    p = spark.createDataFrame([("r", 1, 0.0), ("r", 2, 30.0), ("r", 3, 55.0)], "k string, event_id long, t double")
    q = spark.createDataFrame([("r", 30.0), ("r", 39.5), ("r", 40.0), ("r", 66.0)], "k string, t double")
    r = {x.event_id: (x.latency, x.n_responses, x.censored) for x in pairing.match_response(p, q, ["k"], 10.0).collect()}
    assert r == {1: (None, 0, True), 2: (9.5, 2, False), 3: (None, 0, True)}


def test_quality_checks(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [0.0, 1.0, -1.0]), (2, [0.0, nan, 1.0]), (3, [5.0, 5.0, 5.0]), (4, [0.0, 50.0, -60.0])], "e int, samples array<float>")
    got = {r.e: (r.reasons, r.qc_pass) for r in clean.epoch_qc(df, ["e"], 40.0, 100.0, 0.1).collect()}
    assert got == {1: ("", True), 2: ("nonfinite", False), 3: ("flat", False), 4: ("amplitude;peak_to_peak", False)}
    t = spark.createDataFrame([(" 3.5 ",), ("NaN",), ("inf",), ("x",), ("",), (None,)], "v string").select(scalar.parse_numeric(F.col("v")).alias("v"), scalar.is_missing(F.col("v")).alias("m")).collect()
    assert [r.v for r in t] == [3.5, None, None, None, None, None] and [r.m for r in t] == [False, True, False, False, True, True]
    assert agg.spearman(spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 4.0)], "g int, a double, b double"), ["g"]).first().rho is None


def test_waveform_blobs(spark):
    cube = np.arange(2 * 3 * 4, dtype="<f4").reshape(2, 3, 4)
    df = spark.createDataFrame([("a", bytearray(cube.tobytes())), ("b", bytearray(b"123")), ("c", None)], "path string, content binary")
    got = tables.decode_waveforms(df, ["path"], 4, 3).collect()
    ok = {(r.epoch, r.channel): list(r.samples) for r in got if r.error is None}
    assert ok == {(e, c): cube[e, :, c].tolist() for e in range(2) for c in range(4)}
    assert {r.path: r.error for r in got if r.error} == {"b": "3 bytes", "c": "0 bytes"}


def test_tails_against_numeric_integration(spark):
    import math

    def t_density(x, df):
        return np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / np.sqrt(df * np.pi) * (1 + x * x / df) ** (-(df + 1) / 2)

    grid = np.linspace(-2.1, 2.1, 400_001)
    for df in (3, 10, 80):
        assert float(tails.t_two_sided(np.asarray([2.1]), np.asarray([df]))[0]) == pytest.approx(1 - np.trapezoid(t_density(grid, df), grid), abs=1e-8)
    for d1, d2 in ((1, 7), (4, 9), (30, 50), (200, 3)):
        x = tails.f_quantile(np.asarray([0.975]), d1, d2)
        assert float(tails.f_upper(x, d1, d2)[0]) == pytest.approx(0.025, abs=1e-10)
    assert float(tails.f_upper(np.asarray([2.1**2]), 1, 10)[0]) == pytest.approx(float(tails.t_two_sided(np.asarray([2.1]), 10)[0]))
    assert float(tails.normal_two_sided(np.asarray([1.959963984540054]))[0]) == pytest.approx(0.05)
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (0.0, 3.0)], "t double, df double")
    p = [r.p for r in df.select(tails.t_p_value(F.col("t"), F.col("df")).alias("p")).collect()]
    assert p[0] == pytest.approx(0.391002, abs=1e-6) and p[1] is None and p[2] == pytest.approx(1)


def test_icc_interval_brackets_and_matches_a_plain_anova(spark):
    rng = np.random.default_rng(8)
    target, rater = rng.standard_normal(40) * 2, np.asarray([0.0, 0.3, -0.2])
    x = target[:, None] + rater + rng.standard_normal((40, 3))
    df = spark.createDataFrame([("g", t, r, float(x[t, r])) for t in range(40) for r in range(3)], "g string, t int, r int, v double")
    got = agg.icc_interval(df, ["g"], "t", "r", "v").first()
    msr = 3 * x.mean(1).var(ddof=1)
    msc = 40 * x.mean(0).var(ddof=1)
    mse = ((x - x.mean(1, keepdims=True) - x.mean(0) + x.mean()) ** 2).sum() / 78
    assert got.icc == pytest.approx((msr - mse) / (msr + 2 * mse + 3 * (msc - mse) / 40))
    assert 0.5 < got.lower < got.icc < got.upper < 1 and got.p < 1e-6
