"""What larger tables brought up: groups beyond a task's rows, ratios that are not whole, zeros, late rows, draws of large groups."""

from __future__ import annotations

from datetime import timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import aggregates, models, order, pairing, windows
from cohortwave.plans import registry, source_queries
from cohortwave.streaming import jobs

from .conftest import DATA
from .test_queries import rows
from .test_streams import ZERO


def want(name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return rows(con.execute(registry.ORACLES[name]).df())


def test_ranks_of_pairs_of_one_table(spark, monkeypatch):
    """Pairs of a table with itself in a group larger than a task may hold: ranks have the same values, and no reference is ambiguous."""
    rng = np.random.default_rng(1)
    table = spark.createDataFrame([("p", u, w, float(rng.integers(0, 30))) for u in range(6) for w in range(12)], "label string, user int, window_index int, m double")
    pairs = pairing.window_pairs(table, ["label", "user"], "m")
    plain = aggregates.spearman(pairs, ["label"]).first()
    monkeypatch.setattr(order, "GROUP_ROWS", 50)
    cut = aggregates.spearman(pairs, ["label"]).first()
    assert cut.n == plain.n and cut.rho == pytest.approx(plain.rho)


def test_protocol_audit_over_large_groups(spark, monkeypatch):
    monkeypatch.setattr(order, "GROUP_ROWS", 500)
    assert rows(registry.QUERIES["a41_protocol_grid_audit"](spark, DATA).toPandas()) == want("a41_protocol_grid_audit")


def test_average_rank_of_large_groups(spark, monkeypatch):
    """Few distinct values in a group of very many rows."""
    monkeypatch.setattr(order, "GROUP_ROWS", 100)
    assert rows(registry.QUERIES["w16_average_rank"](spark, DATA).toPandas()) == want("w16_average_rank")


def test_a_latency_of_zero_has_infinite_speed(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 4.0), ("b", None), ("c", None)], "u string, l double")
    got = {r.u: (r.n_answered, r.mean_speed) for r in aggregates.response_targets(df, ["u"], "l", 10.0).collect()}
    sql = duckdb.execute("SELECT u, count(l), avg(1 / l) FROM (VALUES ('a', 0.0::DOUBLE), ('a', 2.0), ('b', 4.0), ('b', NULL), ('c', NULL)) t(u, l) GROUP BY u").fetchall()
    assert got == {u: (n, v) for u, n, v in sql} and got["a"] == (2, float("inf"))


def test_shares_are_those_of_the_written_ratio(spark):
    """90 * 0.7 is 62.99999999999999 in doubles."""
    for n, train, validation in ((90, 0.7, 0.15), (20, 0.7, 0.15), (100, 0.29, 0.57)):
        split = models.subject_ratio_split(spark.range(n).withColumnRenamed("id", "s"), "s", 7, train, validation)
        got = {r.role: r["count"] for r in split.groupBy("role").count().collect()}
        first, second = (n * round(r * 100) // 100 for r in (train, validation))
        assert (got["train"], got["validation"], got["test"]) == (first, second, n - first - second)


def shuffled(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "Exchange " in line and ("_k" in line or "replicate" in line)]


def explained(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("target", ["rt", "speed"])
def test_trials_are_drawn_without_a_shuffle_of_draws(spark, monkeypatch, target):
    """Lists and, for sessions longer than a list may be, joins give the same draws."""
    rng = np.random.default_rng(5)
    data = [(u, s, float(v)) for u in range(5) for s in ("b", "p", "other") for v in rng.gamma(4.0, 100.0, 2 + 9 * u)] + [(9, "b", 1.0), (9, "p", 2.0), (None, "b", 1.0), (8, "p", -1.0)]
    df = spark.createDataFrame(data, "u long, session string, rt double")
    run = lambda: models.trial_bootstrap(df, "u", "b", "p", 40, 3, target)
    lists = {r.subject: r for r in run().collect()}
    assert sorted(lists) == [0, 1, 2, 3, 4] and not shuffled(explained(run()))
    for limit in (0, 15):
        monkeypatch.setattr(models, "DRAW_ROWS", limit)
        joined = {r.subject: r for r in run().collect()}
        assert sorted(joined) == sorted(lists)
        for u, r in joined.items():
            assert tuple(r)[1:] == pytest.approx(tuple(lists[u])[1:], rel=1e-9)


@pytest.mark.parametrize("own", [False, True])
def test_blocks_are_drawn_without_a_shuffle_of_draws(spark, monkeypatch, own):
    rng = np.random.default_rng(6)
    data = [(k, i, float(v)) for k in ("a", "b", "c") for i, v in enumerate(rng.normal(size=3 + 10 * (ord(k) - 97)))] + [("d", 0, None), ("a", 99, None)]
    df = spark.createDataFrame(data, "k string, i long, x double")
    lengths = spark.createDataFrame([("a", 2), ("b", 3), ("c", 90)], "key string, block int") if own else 4
    run = lambda: models.moving_block_bootstrap(df, "k", "i", "x", lengths, 30, 2)
    lists = {r["key"]: tuple(r)[1:] for r in run().collect()}
    assert sorted(lists) == ["a", "b", "c"] and not shuffled(explained(run()))
    for limit in (0, 5):
        monkeypatch.setattr(models, "DRAW_ROWS", limit)
        joined = {r["key"]: tuple(r)[1:] for r in run().collect()}
        assert joined.keys() == lists.keys()
        for k, v in joined.items():
            assert v == pytest.approx(lists[k], rel=1e-9)


def test_a_prediction_of_zero_has_no_logarithm(spark):
    """Held away from 0 by default; taken as it is, as in SQL, where asked."""
    kept, bare = jobs.entropies([0.0, 0.5], 1e-12), jobs.entropies([0.0, 0.5], 0.0)
    assert kept[1] == pytest.approx(np.log(2) / 2) and np.isnan(bare[1]) and bare[2] == pytest.approx(kept[2])
    rows = spark.createDataFrame([(None, None, None), (0.25, None, 0.5), (0.25, 0.1, 0.5)], "q1 double, h_cond double, h_marg double")
    got = [tuple(r) for r in source_queries.not_a_number(rows, "h_cond", "h_marg").collect()]
    assert got[0] == (None, None, None) and np.isnan(got[1][1]) and got[1][2] == 0.5 and got[2] == (0.25, 0.1, 0.5)


def test_folds_by_bits_are_those_of_the_window(spark):
    """Members by list and by window alike, whatever the type; the checks see faults; no row of a fold is shuffled."""
    for kind, n, fraction in (("long", 70, 0.2), ("string", 9, 0.29), ("long", 1, 0.2), ("long", 40, 0.0)):
        s = spark.range(n).select((F.col("id") * 7).cast(kind).alias("s"))
        folds = models.loso_folds(s.union(s), "s", 3, fraction)
        got, by_window = ({tuple(r) for r in f.collect()} for f in (folds, models.loso_folds_by_window(s, "s", 3, fraction)))
        assert len(got) == n * n and got == by_window
        assert tuple(models.fold_partition_check(folds, "s").first()) == (0, 0, 0, 0)
    plan = explained(models.loso_folds(spark.range(70).withColumnRenamed("id", "s"), "s", 3, 0.2))
    assert "_words" in next(x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "fold_id" in x) or plan.count("Exchange hashpartitioning") == 1
    assert models.loso_folds(spark.range(0).withColumnRenamed("id", "s"), "s", 3, 0.2).count() == 0


def test_members_whose_digests_begin_alike(monkeypatch):
    """A cut through equal first bytes is decided by the rest of the digests."""
    import hashlib

    class Digest:
        def __init__(self, text):
            self.text = text

        def digest(self):
            return b"\0" * 8 + hashlib.sha256(self.text).digest()

    members = [b"%d" % i for i in range(50)]
    want = sorted((hashlib.sha256(b"h:" + m).digest(), i) for i, m in enumerate(members) if i != 4)[:11]
    monkeypatch.setattr(models, "hashlib", type("H", (), {"sha256": Digest}))
    bits = np.unpackbits(models.validation_bits(b"h:", members, 4, 11).view(np.uint8), bitorder="little")
    assert sorted(np.flatnonzero(bits)) == sorted(i for _, i in want)


def test_fold_check_shuffles_no_row_and_scales_agree(spark):
    s = spark.range(30).withColumnRenamed("id", "s")
    folds = models.loso_folds(s, "s", 3, 0.2)
    features = s.select("s", (F.col("s") * F.col("s")).cast("double").alias("x"), F.lit(2.0).alias("same"))
    got = {(r.fold_id, r.s): (r.x, r.same) for r in models.standardise_by_fold(features, folds, "s", ["x", "same"]).collect()}
    for f in (0, 17):
        roles = {r.s: r.role for r in folds.where(F.col("fold_id") == f).collect()}
        x = np.array([u * u for u, role in roles.items() if role == "train"], float)
        for u in roles:
            assert got[f, u] == (pytest.approx((u * u - x.mean()) / x.std()), 0.0)
    plan = explained(models.fold_partition_check(folds, "s"))
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(fold_id" in x and "s#" in x.split("ENSURE")[0] and "ENSURE" in x]


def test_missing_epochs_take_one_shuffle(spark):
    df = spark.createDataFrame([("a", e) for e in (3, 3, 7, 4, 7, 9)] + [("b", 5), ("b", 5), (None, 1), (None, 3)], "k string, e long")
    found = windows.missing_list(df, ["k"], "e")
    assert explained(found).count("Exchange hashpartitioning") == 1
    assert sorted(found.collect(), key=str) == sorted([("a", 5), ("a", 6), ("a", 8), (None, 2)], key=str)


def test_late_rows_of_a_visit_extend_its_batches(spark):
    """(part, visit, id, minute): rows behind the watermark come to their place, and a released short batch is taken back or replaced."""
    events = [(0, 1, 1, 0), (0, 1, 2, 1), (0, 1, 3, 2), (0, 1, 4, 3), (0, 2, 5, 4), (0, 4, 6, 5), (1, 3, 7, 100), (2, 1, 8, 2), (2, 2, 9, 5), (2, 2, 10, 6), (2, 4, 11, 95), (2, 5, 12, 1), (3, 1, 13, 0), (3, 3, 14, 101)]
    df = spark.createDataFrame([(p, v, i, i / 100, ZERO + timedelta(minutes=m)) for p, v, i, m in events], "part int, visit long, event_id long, p double, ts timestamp")
    job = lambda s: jobs.visit_monitor(s, ["visit"], "event_id", "p", 3, 30 * 60_000, "1 minute", buckets=2)
    out = jobs.settled(jobs.replay(df, F.col("part"), 4, job, "t-late"), ["visit"], 3)
    got = sorted((r.visit, r.batch_index, r.n, r["last"], round(r.q1, 6)) for r in out.collect())
    # visit 3 is open, and visit 4 again since its row of minute 95
    assert got == [(1, 0, 3, False, 0.02), (1, 1, 3, False, round((4 + 8 + 13) / 300, 6)), (2, 0, 3, False, 0.08), (5, 0, 1, True, 0.12)]
