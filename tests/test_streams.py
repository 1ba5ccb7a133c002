"""Streams over several triggers with restarts in between: first responses, visits, order checks."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from cohortwave.streaming import jobs

ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return ZERO + timedelta(minutes=minutes)


def minutes(ts):
    return F.unix_seconds(ts) / 60 - ZERO.timestamp() / 60


def test_first_response_and_censored_perturbations(spark):
    """(part, user, kind, id, minute): the response of a perturbation may come in a later trigger; the last ones are still open at the end."""
    events = [(0, "u", "p", 1, 0), (0, "u", "r", 2, 3), (0, "u", "r", 3, 4), (0, "v", "p", 4, 5), (0, "u", "p", 5, 8), (1, "u", "r", 6, 12), (1, "v", "r", 7, 30), (1, "v", "p", 8, 31), (2, "w", "p", 9, 60), (2, "w", "r", 10, 60), (2, "w", "r", 11, 90), (2, "w", "p", 12, 89)]
    df = spark.createDataFrame([(p, u, k, i, at(m)) for p, u, k, i, m in events], "part int, user string, kind string, event_id int, ts timestamp")
    job = lambda s: jobs.first_response(s.where("kind = 'p'"), s.where("kind = 'r'"), "user", "10 minutes", "1 minute")
    out = jobs.replay(df, F.col("part"), 3, job, "t-first")
    got = {r.p_id: (r.r_id, r.n_responses, r.censored) for r in out.collect()}
    assert got == {1: (2, 2, False), 4: (None, 0, True), 5: (6, 1, False), 8: (None, 0, True), 9: (None, 0, True)}


def test_visits_release_their_short_last_batch(spark):
    rows = [(0, "a", 1, i, i) for i in range(5)] + [(1, "a", 1, 5, 6)] + [(1, "a", 2, 10 + i, 7 + i) for i in range(2)] + [(2, "b", 1, 20, 200), (3, "b", 1, 21, 201)]
    df = spark.createDataFrame([(p, arm, v, i, at(m), 0.25) for p, arm, v, i, m in rows], "part int, arm string, visit int, event_id int, ts timestamp, p double")
    job = lambda s: jobs.visit_monitor(s, ["arm", "visit"], "event_id", "p", 4, 30 * 60_000, "1 minute")
    out = jobs.replay(df, F.col("part"), 4, job, "t-visit").collect()
    got = sorted((r.arm, r.visit, r.batch_index, r.n, r["last"], r.q1) for r in out)
    # arm b's visit hasn't ended: the watermark is not 30 minutes past it
    assert got == [("a", 1, 0, 4, False, 0.25), ("a", 1, 1, 2, True, 0.25), ("a", 2, 0, 2, True, 0.25)]


def test_order_check_keeps_late_and_repeated_rows_and_frees_state(spark):
    """Arrival order within and across triggers; a row behind the watermark is late whatever its epoch; after a long idle time a key starts anew."""
    rows = [(0, "k", 1, 1, 10), (0, "k", 2, 3, 11), (0, "k", 3, 2, 12), (1, "k", 4, 3, 13), (1, "k", 5, 4, 14), (1, "z", 6, 1, 100), (2, "k", 7, 9, 20), (2, "k", 8, 5, 101), (3, "z", 9, 2, 400), (4, "k", 10, 1, 401), (4, "z", 11, 2, 402)]
    df = spark.createDataFrame([(p, k, a, e, at(m)) for p, k, a, e, m in rows], "part int, k string, arrival int, epoch int, ts timestamp")
    job = lambda s: jobs.order_check(s.select("k", "arrival", "epoch", "ts"), ["k"], "epoch", ["arrival"], "30 minutes", 60 * 60_000)
    main, side = jobs.replay_split(df.drop("part").withColumn("part", F.col("arrival")), part_of(), 5, job, "t-order", F.col("status") == "accepted")
    good = sorted((r.k, r.arrival, r.previous) for r in main.collect())
    bad = sorted((r.k, r.arrival, r.status) for r in side.collect())
    assert bad == [("k", 3, "out_of_order"), ("k", 4, "repeated"), ("k", 7, "late"), ("z", 11, "repeated")]
    # key k was freed when the watermark passed its last row by more than an hour, so its epoch 1 is a first one
    assert good == [("k", 1, None), ("k", 2, 1), ("k", 5, 3), ("k", 8, 4), ("k", 10, None), ("z", 6, None), ("z", 9, 1)]
    assert {r.arrival: r.m for r in main.select("arrival", minutes("ts").alias("m")).collect()}[8] == 101


def part_of():
    """The trigger of each arrival number of the test above."""
    a = F.col("arrival")
    return F.when(a <= 3, 0).when(a <= 6, 1).when(a <= 8, 2).when(a <= 9, 3).otherwise(4)
