"""Windows and joins on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwave.operators import aggregates as agg
from cohortwave.operators import pairing as pair
from cohortwave.operators import windows as win
from cohortwave.plans import base
from cohortwave.plans.base import EVENTS, PREDICTIONS, SERIES, TRIALS, read, register
from cohortwave.plans.stat_queries import region_series

#: The value series of a user in event order, as s.
USER = "us AS (SELECT user_id, event_id, event_type, value AS s, t, k FROM ev)"


def user_series(spark, d):
    return base.events(spark, d).select("user_id", "event_id", "event_type", F.col("value").alias("s"), "t", "k")


WINDOWS = f"{EVENTS}, {USER}, wi AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM us), win AS (SELECT *, i // 8 AS window_index FROM wi WHERE i < (n // 8) * 8)"


def user_windows(spark, d, k=8):
    return win.disjoint_windows(user_series(spark, d), ["user_id"], "event_id", k)


@register("w1_disjoint_windows", "SELECT user_id, window_index, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, avg(s) AS m FROM win GROUP BY 1, 2", WINDOWS, rnd="m")
def w1(spark, d):
    return user_windows(spark, d).groupBy("user_id", "window_index").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.avg("s").alias("m"))


PROTOCOLS = [("b0_k4", 0, 4), ("b0_k8", 0, 8), ("b5_k8", 5, 8), ("b10_k15", 10, 15)]
PROTOCOL_SQL = "pr(label, burn, k) AS (VALUES ('b0_k4', 0, 4), ('b0_k8', 0, 8), ('b5_k8', 5, 8), ('b10_k15', 10, 15)), px AS (SELECT us.*, label, burn, pr.k AS kk, row_number() OVER (PARTITION BY user_id, label ORDER BY event_id) - 1 - burn AS i, count(*) OVER (PARTITION BY user_id, label) - burn AS n FROM us, pr), pw AS (SELECT user_id, label, i // kk AS window_index, s, event_id FROM px WHERE i >= 0 AND i < (n // kk) * kk)"


def protocol_means(spark, d):
    w = win.protocol_windows(user_series(spark, d), ["user_id"], "event_id", PROTOCOLS)
    return w.groupBy("user_id", "label", "window_index").agg(F.count("*").alias("n"), F.avg("s").alias("m"), F.stddev_samp("s").alias("j"))


@register("w2_windows_after_burnin", "SELECT user_id, label, window_index, count(*) AS n, avg(s) AS m, stddev_samp(s) AS j FROM pw GROUP BY 1, 2, 3", EVENTS, USER, PROTOCOL_SQL, rnd="m j")
def w2(spark, d):
    return protocol_means(spark, d)


WMEANS = "wm AS (SELECT user_id, window_index, avg(s) AS m, stddev_samp(s) AS j FROM win GROUP BY 1, 2)"


def window_means(spark, d):
    return user_windows(spark, d).groupBy("user_id", "window_index").agg(F.avg("s").alias("m"), F.stddev_samp("s").alias("j"))


@register("w3_prefix_vs_full", "SELECT user_id, count(*) AS n_windows, avg(m) FILTER (window_index = 0) AS prefix, avg(m) AS whole, avg(m) FILTER (window_index > 0) AS complement, avg(m) FILTER (window_index = 0) - avg(m) AS prefix_minus_full FROM wm GROUP BY 1", WINDOWS, WMEANS, rnd="prefix complement prefix_minus_full whole", digits=11)
def w3(spark, d):
    return win.prefix_vs_full(window_means(spark, d), ["user_id"], "m")


@register(
    "w4_position_effect",
    """, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY window_index) - 1 AS q, count(*) OVER (PARTITION BY user_id) AS c FROM wm)
    SELECT user_id, max(c) AS n_windows, max(m) FILTER (q = 0) AS early, max(m) FILTER (q = (c - 1) // 2) AS middle, max(m) FILTER (q = c - 1) AS late, max(m) FILTER (q = c - 1) - max(m) FILTER (q = 0) AS late_minus_early
    FROM x WHERE c >= 2 GROUP BY 1""",
    WINDOWS,
    WMEANS,
    rnd="early middle late late_minus_early",
)
def w4(spark, d):
    return win.position_values(window_means(spark, d), ["user_id"], "m")


DYNAMICS = """dx AS (SELECT user_id, window_index, s, s - lag(s) OVER w AS ds, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id, window_index) AS c
    FROM win WINDOW w AS (PARTITION BY user_id, window_index ORDER BY event_id)),
dt AS (SELECT *, (r - (c + 1) / 2) / c AS tau FROM dx),
    da AS (SELECT user_id, window_index, count(s) AS n, avg(s) AS m, stddev_samp(s) AS j, sqrt(sum(ds * ds) / nullif(2 * (count(s) - 1), 0)) AS v, regr_sxx(s, tau) AS sxx, regr_sxy(s, tau) AS sxy, regr_syy(s, tau) AS syy
    FROM dt GROUP BY 1, 2)"""


@register("w5_local_volatility", "SELECT user_id, window_index, v FROM da", WINDOWS, DYNAMICS, rnd="v")
def w5(spark, d):
    return win.dynamic_features(user_windows(spark, d), ["user_id", "window_index"], "event_id").select("user_id", "window_index", "v")


@register(
    "w6_w7_dynamic_features",
    """SELECT user_id, window_index, n, m, j, v, sxy / sxx AS d, sqrt(greatest(syy - sxy / sxx * sxy, 0) / (n - 2) / sxx) AS d_se, (sxy / sxx) / nullif(sqrt(greatest(syy - sxy / sxx * sxy, 0) / (n - 2) / sxx), 0) AS d_t,
    sxy / sxx * sxy / nullif(syy, 0) AS drift_share, sqrt(greatest(syy - sxy / sxx * sxy, 0) / (n - 2)) AS j_res FROM da""",
    WINDOWS,
    DYNAMICS,
    rnd="m j v d d_se d_t drift_share j_res",
)
def w7(spark, d):
    return win.dynamic_features(user_windows(spark, d), ["user_id", "window_index"], "event_id")


@register("w7_region_dynamics", """, x AS (SELECT subject, session, region, s, s - lag(s) OVER w AS ds FROM series
    WINDOW w AS (PARTITION BY subject, session, region ORDER BY epoch))
SELECT subject, session, region, count(s) AS n, avg(s) AS m, stddev_samp(s) AS j, sqrt(sum(ds * ds) / nullif(2 * (count(s) - 1), 0)) AS v FROM x
    GROUP BY 1, 2, 3""", SERIES, rnd="m j v")
def w7b(spark, d):
    return win.dynamic_features(region_series(spark, d), ["subject", "session", "region"], "epoch").select("subject", "session", "region", "n", "m", "j", "v")


@register("w8_duplicate_ids", "SELECT l_orderkey, count(*) AS n, count(*) - count(DISTINCT l_linenumber) AS n_repeats FROM lineitem GROUP BY 1")
def w8(spark, d):
    return win.duplicate_ids(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


#: Segments of a user's stream: visit 0 (views), 1 (clicks), 2 (the rest), epochs by event id.
SEGMENTS = "seg AS (SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS visit, event_id AS epoch, event_type, k FROM ev)"
STREAM = """s0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, visit ORDER BY epoch) - 1 AS i, count(*) OVER (PARTITION BY user_id, visit) AS n FROM seg),
    s1 AS (SELECT *, i // 8 AS b FROM s0),
stream AS (SELECT user_id, visit, epoch, event_type, k, row_number() OVER (PARTITION BY user_id
    ORDER BY visit, epoch) - 1 AS stream_position, dense_rank() OVER (PARTITION BY user_id ORDER BY visit, b) - 1 AS batch_index, i % 8 AS "offset",
CASE WHEN b = (n - 1) // 8 THEN n - b * 8 ELSE 8 END AS batch_n, b = (n - 1) // 8 AS is_final_of_visit FROM s1)"""


def segments(spark, d):
    visit = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return base.events(spark, d).select("user_id", visit.alias("visit"), F.col("event_id").alias("epoch"), "event_type", "k")


def stream(spark, d):
    return win.ordered_batches(segments(spark, d), ["user_id"], "visit", "epoch", 8)


@register("w9_ordered_batches", "SELECT * FROM stream", EVENTS, SEGMENTS, STREAM)
def w9(spark, d):
    return stream(spark, d)


RUNS = "rn AS (SELECT user_id, event_id, event_type, CAST(lag(event_type) OVER w IS DISTINCT FROM event_type AS INTEGER) AS nw FROM us WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), ru AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM rn), rl AS (SELECT user_id, run, count(*) AS len FROM ru GROUP BY 1, 2)"


@register("w10_runs", "SELECT user_id, count(*) AS n_runs, max(len) AS longest FROM rl GROUP BY 1", EVENTS, USER, RUNS)
def w10(spark, d):
    return win.runs(user_series(spark, d), ["user_id"], "event_id", "event_type")


@register(
    "w11_missing_epochs",
    """WITH e AS (SELECT DISTINCT o_custkey, o_orderkey // 50 AS e FROM orders),
    g AS (SELECT o_custkey, lead(e) OVER (PARTITION BY o_custkey ORDER BY e) - e - 1 AS gap FROM e)
    SELECT o_custkey, count(*) AS n_epochs, CAST(coalesce(sum(gap) FILTER (gap > 0), 0) AS BIGINT) AS n_missing, count(*) FILTER (gap > 0) AS n_gaps, max(gap) AS largest_gap
    FROM g GROUP BY 1""",
)
def w11(spark, d):
    return win.missing_epochs(read(spark, d, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 50).alias("e")), ["o_custkey"], "e")


@register("w11_missing_list", "WITH e AS (SELECT DISTINCT l_suppkey, l_orderkey // 40 AS e FROM lineitem), r AS (SELECT l_suppkey, min(e) AS a, max(e) AS b FROM e GROUP BY 1), f AS (SELECT l_suppkey, unnest(range(a, b)) AS missing FROM r) SELECT l_suppkey, missing FROM f ANTI JOIN e ON f.l_suppkey = e.l_suppkey AND missing = e.e")
def w11b(spark, d):
    return win.missing_list(read(spark, d, "lineitem").select("l_suppkey", F.floor(F.col("l_orderkey") / 40).alias("e")), ["l_suppkey"], "e")


GAP = 12 * 3600.0
BLOCKS = f"bk AS (SELECT *, CAST(coalesce(sum(nw) OVER (PARTITION BY user_id ORDER BY t), 0) AS BIGINT) AS block FROM (SELECT *, CAST(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {GAP} AS INTEGER) AS nw FROM us)), blocks AS (SELECT user_id, block, min(t) AS start_s, max(t) AS stop_s, count(*) AS n_markers, max(t) - min(t) AS duration_s FROM bk GROUP BY 1, 2)"


def user_blocks(spark, d):
    return win.blocks_from_gaps(user_series(spark, d), ["user_id"], "t", GAP)


@register("w12_blocks_from_gaps", "SELECT * FROM blocks", EVENTS, USER, BLOCKS, rnd="start_s stop_s duration_s")
def w12(spark, d):
    return user_blocks(spark, d)


@register(
    "w13_marker_aligned_windows",
    """RECURSIVE ev AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id
    ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    walk AS (SELECT user_id, t, i, t AS start, false AS cut, 0.0::DOUBLE AS a, n FROM ev WHERE i = 1 UNION ALL
             SELECT ev.user_id, ev.t, ev.i, CASE WHEN ev.t - w.start >= 86400 THEN ev.t ELSE w.start END, ev.t - w.start >= 86400, w.start, ev.n
             FROM walk w JOIN ev ON ev.user_id = w.user_id AND ev.i = w.i + 1),
    done AS (SELECT user_id, a AS start_s, t AS stop_s, true AS complete FROM walk WHERE cut
    UNION ALL SELECT user_id, start, t, false FROM walk WHERE i = n AND t > start)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_s) - 1 AS window_index, start_s, stop_s, complete
    FROM done""".replace("RECURSIVE", "WITH RECURSIVE", 1),
    rnd="start_s stop_s",
)
def w13(spark, d):
    return win.marker_aligned_windows(base.events(spark, d), ["user_id"], "t", 86400.0)


@register("w14_block_local_mean", "SELECT user_id, event_id, block, avg(s) OVER (PARTITION BY user_id, block ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM bk", EVENTS, USER, BLOCKS, rnd="smooth")
def w14(spark, d):
    b = win.assign_blocks(user_series(spark, d), ["user_id"], "t", GAP)
    return win.block_local_mean(b, ["user_id"], "event_id", "s", 2).select("user_id", "event_id", "block", "smooth")


@register(
    "w15_running_balanced_accuracy",
    """, c AS (SELECT arm, subject, segment_id, sum(CAST(y = 1 AND p >= 0.5 AS INTEGER)) OVER w AS tp, sum(CAST(y = 1 AS INTEGER)) OVER w AS pos, sum(CAST(y = 0 AND p < 0.5 AS INTEGER)) OVER w AS tn, sum(CAST(y = 0 AS INTEGER)) OVER w AS neg
    FROM pred WINDOW w AS (PARTITION BY arm, subject
    ORDER BY segment_id)) SELECT arm, subject, segment_id, (tp / nullif(pos, 0) + tn / nullif(neg, 0)) / 2 AS running FROM c""",
    PREDICTIONS,
    rnd="running",
)
def w15(spark, d):
    return win.running_balanced_accuracy(base.predictions(spark, d), ["arm", "subject"], "segment_id").select("arm", "subject", "segment_id", "running")


@register("w16_average_rank", "SELECT event_id, CAST(rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS DOUBLE) AS rank FROM ev", EVENTS)
def w16(spark, d):
    return agg.average_rank(base.events(spark, d), ["event_type"], "k").select("event_id", F.col("rank").cast("double").alias("rank"))


@register(
    "w17_sliding_windows_in_epoch",
    "SELECT vec_id, CAST(step AS INTEGER) AS step, CAST(least(step * 4, 48) AS INTEGER) AS start, list_sum(CAST(embedding[least(step * 4, 48) + 1:least(step * 4, 48) + 16] AS DOUBLE[])) AS total FROM (SELECT *, unnest(range(0, 16)) AS step FROM embeddings)",
    rnd="total",
)
def w17(spark, d):
    s = win.sliding_windows(read(spark, d, "embeddings"), 16, 4, 16, "embedding")
    return s.select("vec_id", "step", "start", F.aggregate("slice", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total"))


TILES = "tl AS (SELECT user_id, t, s, max(CASE WHEN event_type = 'signup' THEN t END) OVER (PARTITION BY user_id ORDER BY t) AS mt FROM us)"


@register(
    "w18_tile_local_slope",
    """, g AS (SELECT user_id, mt, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(t - mt) > 0 THEN regr_slope(s, t - mt) END AS slope FROM tl
    WHERE mt IS NOT NULL AND t - mt < 90000 GROUP BY 1, 2)
    SELECT user_id, count(*) AS tiles, round(avg(slope) * 1000, 5) AS mean_slope, avg(CAST(slope > 0 AS INTEGER)) AS share_positive FROM g GROUP BY 1""",
    EVENTS,
    USER,
    TILES,
    rnd="share_positive",
)
def w18(spark, d):
    s = user_series(spark, d).withColumn("is_marker", F.col("event_type") == "signup")
    return win.tile_local_slope(s, ["user_id"], "t", "s", "is_marker", 90000.0).withColumn("mean_slope", F.round(F.col("mean_slope") * 1000, 5))


@register(
    "w19_stream_order_check",
    """, b AS (SELECT user_id, count(*) FILTER (v > 1) AS mixed_batches, count(*) FILTER (c <> bn) AS wrong_sizes
    FROM (SELECT user_id, batch_index, count(DISTINCT visit) AS v, count(*) AS c, max(batch_n) AS bn FROM stream GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT *, lag(epoch) OVER w >= epoch AND lag(visit) OVER w = visit AS d, lag(batch_index) OVER w > batch_index AS back FROM stream
    WINDOW w AS (PARTITION BY user_id ORDER BY stream_position)),
    a AS (SELECT user_id, count(*) FILTER (d) AS not_ascending, count(*) - count(DISTINCT (visit, epoch)) AS repeats, count(*) FILTER (back) AS batch_backwards, CAST(min(stream_position) <> 0 OR max(stream_position) <> count(*) - 1 OR count(DISTINCT stream_position) <> count(*) AS INTEGER) AS bad_positions
    FROM l GROUP BY 1)
    SELECT * FROM a JOIN b USING (user_id)""",
    EVENTS,
    SEGMENTS,
    STREAM,
)
def w19(spark, d):
    return win.stream_order_check(stream(spark, d), ["user_id"], "epoch", "visit")


@register("w20_row_ranges", "WITH g AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) SELECT event_type, min(event_id) AS start_row, max(event_id) AS end_row, count(*) AS row_count FROM g GROUP BY event_type, g.g")
def w20(spark, d):
    return win.row_ranges(read(spark, d, "events"), "event_id", "event_type")


# joins


@register(
    "j1_pair_sessions",
    """, f AS (SELECT subject, region, session, avg(s) AS m, stddev_samp(s) AS j FROM series GROUP BY 1, 2, 3),
    w AS (SELECT subject, region, max(m) FILTER (session = 'baseline') AS m0, max(m) FILTER (session = 'perturbation') AS m1, max(j) FILTER (session = 'baseline') AS j0, max(j) FILTER (session = 'perturbation') AS j1
    FROM f GROUP BY 1, 2)
    SELECT subject, region, m1 - m0 AS delta_m, ln(j1) - ln(j0) AS delta_log_j FROM w WHERE m0 IS NOT NULL AND m1 IS NOT NULL""",
    SERIES,
    rnd="delta_m delta_log_j",
)
def j1(spark, d):
    return pair.pair_sessions(agg.level_and_dispersion(region_series(spark, d), ["subject", "session", "region"]), ["subject", "region"], "baseline", "perturbation")


TWO = "tw AS (SELECT subject, session, (row_number() OVER (PARTITION BY subject, session ORDER BY trial_id) - 1) // 4 AS window_index, rt, count(*) OVER (PARTITION BY subject, session) AS c FROM trials), tm AS (SELECT subject, session, window_index, avg(rt) AS m FROM tw WHERE window_index < c // 4 GROUP BY 1, 2, 3)"


def trial_windows(spark, d):
    return win.disjoint_windows(base.trials(spark, d), ["subject", "session"], "trial_id", 4).groupBy("subject", "session", "window_index").agg(F.avg("rt").alias("m"))


@register("j2_pair_windows", "SELECT subject, window_index, a.m AS a, b.m AS b FROM tm a JOIN tm b USING (subject, window_index) WHERE a.session = 'baseline' AND b.session = 'perturbation'", TRIALS, TWO, rnd="a b")
def j2(spark, d):
    return pair.pair_windows(trial_windows(spark, d), ["subject"], "baseline", "perturbation", "m")


MANIFEST = "man AS (SELECT user_id AS subject, event_type AS session, count(*) AS n, max(k) AS strength FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1, 2), adm AS (SELECT *, CASE WHEN n < 8 THEN 'too_short' WHEN strength < 90 THEN 'weak' END AS reason FROM man)"


def manifest(spark, d):
    m = base.events(spark, d).where(F.col("event_type").isin("view", "click")).groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("session")).agg(F.count("*").alias("n"), F.max("k").alias("strength"))
    return pair.build_manifest(m, [(F.col("n") < 8, "too_short"), (F.col("strength") < 90, "weak")])


@register("s9_build_manifest", "SELECT *, reason IS NULL AS admitted FROM adm", EVENTS, MANIFEST)
def s9(spark, d):
    return manifest(spark, d)


@register(
    "j3_build_cohort",
    """, ses AS (SELECT subject, count(*) FILTER (session = 'view') AS n0, count(*) FILTER (session = 'click') AS n1, least(max(strength) FILTER (session = 'view'), max(strength) FILTER (session = 'click')) AS strength
    FROM adm WHERE reason IS NULL GROUP BY 1),
    p AS (SELECT DISTINCT user_id AS subject FROM ev), tg AS (SELECT DISTINCT user_id AS subject FROM ev WHERE event_type = 'purchase' AND value > 60),
    j AS (SELECT p.subject, ses.strength, CASE WHEN coalesce(n0, 0) = 0 AND coalesce(n1, 0) = 0 THEN 'no_recording' WHEN coalesce(n0, 0) = 0 THEN 'no_baseline' WHEN coalesce(n1, 0) = 0 THEN 'no_perturbation' WHEN tg.subject IS NULL THEN 'no_target' WHEN strength < 95 THEN 'weak_evidence' END AS reason
    FROM p LEFT JOIN ses USING (subject) LEFT JOIN tg USING (subject)) SELECT subject, strength, coalesce(reason, '') AS reason, reason IS NULL AS included FROM j""",
    EVENTS,
    MANIFEST,
)
def j3(spark, d):
    ev = base.events(spark, d)
    targets = ev.where("event_type = 'purchase' and value > 60").select(F.col("user_id").alias("subject")).distinct()
    return pair.build_cohort(manifest(spark, d), targets, ev.select(F.col("user_id").alias("subject")).distinct(), "subject", "view", "click", 95)


@register(
    "j4_reconcile",
    """WITH o AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
    r AS (SELECT l_orderkey AS k, sum(l_quantity) + max(l_tax) * 20 AS q FROM lineitem WHERE l_discount < 0.1 GROUP BY 1)
    SELECT coalesce(o.k, r.k) AS k, round(r.q - o.q, 6) AS d_q, concat_ws(';', CASE WHEN o.k IS NULL THEN 'raw_only' END, CASE WHEN r.k IS NULL THEN 'official_only' END, CASE WHEN abs(r.q - o.q) > 0.5 THEN 'differs_q' END) AS reasons
    FROM o FULL JOIN r ON o.k = r.k""",
)
def j4(spark, d):
    li = read(spark, d, "lineitem")
    o = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("q"))
    r = li.where("l_discount < 0.1").groupBy(F.col("l_orderkey").alias("k")).agg((F.sum("l_quantity") + F.max("l_tax") * 20).alias("q"))
    return pair.reconcile(o, r, "k", ["q"], 0.5).withColumn("d_q", F.round("d_q", 6))


@register("j5_subjects_missing_upstream", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def j5(spark, d):
    used = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return pair.missing_upstream(read(spark, d, "customer").select("c_custkey", "c_name"), used, "c_custkey")


@register(
    "j6_join_key_audit",
    """WITH a AS (SELECT c_custkey // 2 AS naive, c_custkey AS true_, c_nationkey AS x FROM customer),
    b AS (SELECT o_custkey // 3 AS naive, o_custkey AS true_, CAST(o_custkey % 25 AS INTEGER) AS x FROM orders)
    SELECT 'naive' AS key, count(*) AS pairs, count(*) FILTER (a.true_ <> b.true_) AS wrong, count(*) FILTER (a.x = b.x) AS agree FROM a JOIN b ON a.naive = b.naive
    UNION ALL SELECT 'true', count(*), count(*) FILTER (a.true_ <> b.true_), count(*) FILTER (a.x = b.x) FROM a JOIN b ON a.true_ = b.true_""",
)
def j6(spark, d):
    c = F.col
    a = read(spark, d, "customer").select(F.floor(c("c_custkey") / 2).alias("naive"), c("c_custkey").alias("id"), c("c_nationkey").alias("x"))
    b = read(spark, d, "orders").select(F.floor(c("o_custkey") / 3).alias("naive"), c("o_custkey").alias("id"), (c("o_custkey") % 25).cast("int").alias("x"))
    return pair.join_key_audit(a, b, "naive", "id", "x")


@register("j7_arm_disagreement", "SELECT subject, seed, count(*) AS n, true AS same_windows, avg(CAST((a.p >= 0.5) <> (b.p >= 0.5) AS INTEGER)) AS share FROM pred a JOIN pred b USING (subject, seed, segment_id) WHERE a.arm = 'a' AND b.arm = 'b' GROUP BY 1, 2", PREDICTIONS, rnd="share")
def j7(spark, d):
    return pair.arm_disagreement(base.predictions(spark, d), "a", "b", ["subject", "seed"], "segment_id")


BOUND = 36 * 3600.0
MATCHED = f"""pe AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'error'), rs AS (SELECT user_id, t FROM ev WHERE event_type = 'purchase'),
mt AS (SELECT pe.user_id, pe.event_id, pe.t, min(rs.t) - pe.t AS latency, count(rs.t) AS n_responses, min(rs.t) IS NULL AS censored
    FROM pe LEFT JOIN rs ON pe.user_id = rs.user_id AND rs.t > pe.t AND rs.t <= pe.t + {BOUND} GROUP BY 1, 2, 3)"""


def matched(spark, d):
    ev = base.events(spark, d)
    return pair.match_response(ev.where("event_type = 'error'").select("user_id", "event_id", "t"), ev.where("event_type = 'purchase'").select("user_id", "t"), ["user_id"], BOUND)


@register("j8_match_response", "SELECT * FROM mt", EVENTS, MATCHED, rnd="t latency")
def j8(spark, d):
    return matched(spark, d)


@register("j9_signal_at_event", "SELECT e.user_id, e.event_id, s.value FROM (SELECT * FROM ev WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') s ON e.user_id = s.user_id AND s.t <= e.t", EVENTS)
def j9(spark, d):
    ev = base.events(spark, d)
    return pair.asof_value(ev.where("event_type = 'error'").select("user_id", "event_id", "t"), ev.where("event_type = 'view'").select("user_id", "t", "value"), ["user_id"], "t", "value").select("user_id", "event_id", "value")


SIGNUP_BLOCKS = BLOCKS.replace("FROM us)", "FROM us WHERE event_type = 'signup')")


def signup_blocks(spark, d):
    return win.blocks_from_gaps(user_series(spark, d).where("event_type = 'signup'"), ["user_id"], "t", 48 * 3600.0)


SB = SIGNUP_BLOCKS.replace(str(GAP), "172800.0")


@register("j10_samples_in_blocks", "SELECT us.user_id, us.event_id, blocks.block FROM us LEFT JOIN blocks ON us.user_id = blocks.user_id AND us.t BETWEEN start_s AND stop_s", EVENTS, USER, SB)
def j10(spark, d):
    return pair.in_blocks(user_series(spark, d), signup_blocks(spark, d), ["user_id"], "t").select("user_id", "event_id", "block")


SPAN = "span AS (SELECT user_id, min(t) FILTER (k < 80) AS valid_lo, max(t) FILTER (k < 80) AS valid_hi FROM us GROUP BY 1), mask AS (SELECT us.user_id, us.event_id, us.s, CASE WHEN NOT coalesce(us.t BETWEEN valid_lo AND valid_hi, false) THEN 'invalid' WHEN block IS NOT NULL THEN 'driving' ELSE 'gap' END AS state FROM us LEFT JOIN blocks ON us.user_id = blocks.user_id AND us.t BETWEEN start_s AND stop_s LEFT JOIN span ON us.user_id = span.user_id)"


def masked(spark, d):
    us = user_series(spark, d)
    span = us.groupBy("user_id").agg(F.min(F.when(F.col("k") < 80, F.col("t"))).alias("valid_lo"), F.max(F.when(F.col("k") < 80, F.col("t"))).alias("valid_hi"))
    return pair.driving_mask(us, signup_blocks(spark, d), span, ["user_id"], "t")


@register("p14_driving_mask", "SELECT user_id, state, count(*) AS n FROM mask GROUP BY 1, 2", EVENTS, USER, SB, SPAN)
def p14(spark, d):
    return masked(spark, d).groupBy("user_id", "state").agg(F.count("*").alias("n"))


@register(
    "a45_mask_audit",
    """SELECT user_id, count(*) FILTER (state = 'driving') AS n_driving, count(*) FILTER (state = 'gap') AS n_gap, count(*) FILTER (state = 'invalid') AS n_invalid, avg(s) FILTER (state = 'driving') AS mean_driving, avg(s) FILTER (state = 'gap') AS mean_gap,
    max(abs(s)) FILTER (state = 'driving') AS max_driving, max(abs(s)) FILTER (state = 'gap') AS max_gap, count(*) FILTER (state = 'gap') / nullif(count(*) FILTER (state <> 'invalid'), 0) AS gap_fraction, max(abs(s)) FILTER (state = 'gap') / max(abs(s)) FILTER (state = 'driving') AS scale_ratio
    FROM mask GROUP BY 1""",
    EVENTS,
    USER,
    SB,
    SPAN,
    rnd="mean_driving mean_gap gap_fraction scale_ratio",
    digits=9,
)
def a45(spark, d):
    return pair.mask_audit(masked(spark, d), ["user_id"], "s")


@register(
    "j11_resample_linear",
    """, kn AS (SELECT user_id, t, s FROM us WHERE event_type = 'view'), gr AS (SELECT user_id, t, event_id FROM us WHERE event_type = 'click'),
    lo AS (SELECT gr.user_id, gr.event_id, gr.t, kn.t AS lt, kn.s AS lx FROM gr ASOF LEFT JOIN kn ON gr.user_id = kn.user_id AND gr.t >= kn.t),
    hi AS (SELECT lo.*, kn.t AS ht, kn.s AS hx FROM lo ASOF LEFT JOIN kn ON lo.user_id = kn.user_id AND lo.t <= kn.t)
    SELECT user_id, t, coalesce(lx + (hx - lx) * (t - lt) / nullif(ht - lt, 0), lx, hx) AS s FROM hi""",
    EVENTS,
    USER,
    rnd="t s",
)
def j11(spark, d):
    us = user_series(spark, d)
    return pair.resample_linear(us.where("event_type = 'view'").select("user_id", "t", "s"), us.where("event_type = 'click'").select("user_id", "t"), ["user_id"], "t", "s")


@register("j12_window_pairs", "SELECT a.user_id, a.window_index AS i, b.window_index AS j, a.m AS a, b.m AS b FROM wm a JOIN wm b ON a.user_id = b.user_id AND a.window_index < b.window_index", WINDOWS, WMEANS, rnd="a b")
def j12(spark, d):
    return pair.window_pairs(window_means(spark, d), ["user_id"], "m")


@register(
    "j13_baseline_scenario",
    """, b AS (SELECT subject, count(*) AS n_base, median(m) AS bm, arg_min(m, window_index) AS bf FROM tm WHERE session = 'baseline' GROUP BY 1),
    c AS (SELECT subject, arg_min(m, window_index) AS now FROM tm WHERE session = 'perturbation' GROUP BY 1)
    SELECT subject, n_base, now - bm AS to_median, now - bf AS to_first FROM b JOIN c USING (subject) WHERE n_base >= 2""",
    TRIALS,
    TWO,
    rnd="to_median to_first",
)
def j13(spark, d):
    return pair.baseline_scenario(trial_windows(spark, d), "subject", "baseline", "perturbation", "m")


@register(
    "j14_table_diff",
    """WITH e AS (SELECT s_suppkey AS k, s_acctbal AS v, s_nationkey % 2 AS g FROM supplier),
    a AS (SELECT s_suppkey AS k, s_acctbal + CASE WHEN s_suppkey = 7 THEN 0.5 ELSE 0 END AS v, CASE WHEN s_suppkey % 40 = 3 THEN 1 - s_nationkey % 2 ELSE s_nationkey % 2 END AS g
    FROM supplier WHERE s_suppkey <> 11),
    j AS (SELECT e.k AS ke, a.k AS ka, abs(e.v - a.v) AS dv, e.g <> a.g AS f
    FROM e FULL JOIN a ON e.k = a.k) SELECT count(*) FILTER (ka IS NULL) AS missing, count(*) FILTER (ke IS NULL) AS extra, max(dv) AS max_v, arg_max(ke, dv) AS worst_v, count(*) FILTER (f) AS flips_g, false AS same
    FROM j""",
    rnd="max_v",
)
def j14(spark, d):
    c = F.col
    s = read(spark, d, "supplier").select(c("s_suppkey").alias("k"), c("s_acctbal").alias("v"), (c("s_nationkey") % 2).alias("g"))
    other = s.where("k <> 11").select("k", (c("v") + F.when(c("k") == 7, 0.5).otherwise(0.0)).alias("v"), F.when(c("k") % 40 == 3, 1 - c("g")).otherwise(c("g")).alias("g"))
    return pair.table_diff(s, other, "k", ["v"], ["g"], 1e-9)


@register("j15_with_first_window", "SELECT user_id, label, window_index, avg(s) AS m, max(c_acctbal) AS target FROM pw JOIN customer ON user_id = c_custkey WHERE label = 'b5_k8' AND window_index = 0 GROUP BY 1, 2, 3", EVENTS, USER, PROTOCOL_SQL, rnd="m")
def j15(spark, d):
    targets = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("target"))
    return pair.with_first_window(protocol_means(spark, d).drop("n", "j"), "b5_k8", targets, "user_id")


@register(
    "j16_censoring_audit",
    """, q AS (SELECT *, CAST(censored AS INTEGER) AS c, ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM mt)
    SELECT user_id, count(*) AS n, avg(c) AS censored_share, avg(c) FILTER (q = 4) - avg(c) FILTER (q = 1) AS late_minus_early, avg(CAST(n_responses > 1 AS INTEGER)) AS multi_share
    FROM q GROUP BY 1""",
    EVENTS,
    MATCHED,
    rnd="censored_share late_minus_early multi_share",
)
def j16(spark, d):
    return pair.censoring_audit(matched(spark, d), ["user_id"], "event_id")


@register("t2_same_sample_sets", "SELECT subject, seed, 2 AS n_arms, 1 AS n_signatures, count(*) // 2 AS n_rows FROM pred GROUP BY 1, 2", PREDICTIONS)
def t2(spark, d):
    return pair.same_sample_sets(base.predictions(spark, d), "arm", ["subject", "seed"], ["segment_id", "session", "y"]).withColumns({"n_arms": F.col("n_arms").cast("int"), "n_signatures": F.col("n_signatures").cast("int")})


@register(
    "a39_a40_stream_inventory",
    """, b AS (SELECT user_id, batch_index, count(*) AS c FROM stream
    GROUP BY 1, 2) SELECT user_id, count(*) AS n_windows, count(*) FILTER (visit = 0) AS n_first, count(*) FILTER (k >= 50) AS n_positive, avg(CAST(k >= 50 AS INTEGER)) AS share_positive, max(batch_index) + 1 AS n_batches, min(batch_n) AS smallest_batch,
    (SELECT count(*) FROM b WHERE b.user_id = stream.user_id AND c = 1) AS n_single FROM stream GROUP BY user_id""",
    EVENTS,
    SEGMENTS,
    STREAM,
    rnd="share_positive",
)
def a40(spark, d):
    s = stream(spark, d)
    single = s.groupBy("user_id", "batch_index").agg(F.count("*").alias("c")).groupBy("user_id").agg(F.count_if(F.col("c") == 1).alias("n_single"))
    hit = F.col("k") >= 50
    a = s.groupBy("user_id").agg(F.count("*").alias("n_windows"), F.count_if(F.col("visit") == 0).alias("n_first"), F.count_if(hit).alias("n_positive"), F.avg(hit.cast("int")).alias("share_positive"), (F.max("batch_index") + 1).alias("n_batches"), F.min("batch_n").alias("smallest_batch"))
    return a.join(single, "user_id")


@register(
    "a41_protocol_grid_audit",
    """, m AS (SELECT user_id, label, window_index, avg(s) AS m FROM pw GROUP BY 1, 2, 3),
    a AS (SELECT label, user_id, count(*) AS n FROM m GROUP BY 1, 2),
    e AS (SELECT label, count(*) FILTER (n >= 2) AS eligible, count(*) AS sessions FROM a GROUP BY 1),
    q AS (SELECT x.label, x.user_id, x.m AS a, y.m AS b FROM m x JOIN m y ON x.user_id = y.user_id AND x.label = y.label AND x.window_index < y.window_index),
    p AS (SELECT label, median(abs(a - b)) AS median_abs FROM q GROUP BY 1),
    rk AS (SELECT label, rank() OVER (PARTITION BY label
    ORDER BY a) + (count(*) OVER (PARTITION BY label, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY label
    ORDER BY b) + (count(*) OVER (PARTITION BY label, b) - 1) / 2.0 AS rb FROM q),
    rh AS (SELECT label, corr(ra, rb) AS rho FROM rk GROUP BY 1),
    i AS (SELECT quantile_cont(f, 0.75) - quantile_cont(f, 0.25) AS iqr FROM (SELECT user_id, avg(s) AS f FROM us GROUP BY 1)),
    po AS (SELECT label, user_id, arg_max(m, window_index) - arg_min(m, window_index) AS d FROM m GROUP BY 1, 2 HAVING count(*) >= 2),
    dz AS (SELECT label, abs(avg(d) / stddev_samp(d)) AS abs_dz FROM po GROUP BY 1),
    g AS (SELECT user_id, avg(s) AS f FROM us GROUP BY 1), gm AS (SELECT avg(f) AS gm FROM g),
    sg AS (SELECT m.label, avg(CAST(sign(m.m - gm) = sign(f - gm) AS INTEGER)) AS sign_agreement FROM m JOIN g USING (user_id), gm WHERE window_index = 0 GROUP BY 1)
    SELECT label, sessions, eligible, median_abs / iqr AS nmae, rho, abs_dz, sign_agreement
    FROM e JOIN p USING (label) JOIN rh USING (label) JOIN dz USING (label) JOIN sg USING (label), i""",
    EVENTS,
    USER,
    PROTOCOL_SQL,
    rnd="nmae rho abs_dz sign_agreement",
)
def a41(spark, d):
    """Per protocol: eligibility, disagreement and rank correlation of window pairs, position effect, sign against the whole session."""
    m = protocol_means(spark, d)
    n = m.groupBy("label", "user_id").agg(F.count("*").alias("n")).groupBy("label").agg(F.count("*").alias("sessions"), F.count_if(F.col("n") >= 2).alias("eligible"))
    pairs = pair.window_pairs(m, ["label", "user_id"], "m")
    diff, rho = agg.absolute_disagreement(pairs, ["label"]).select("label", "median_abs"), agg.spearman(pairs, ["label"]).select("label", "rho")
    position = win.position_values(m, ["label", "user_id"], "m").groupBy("label").agg(F.abs(F.avg("late_minus_early") / F.stddev_samp("late_minus_early")).alias("abs_dz"))
    full = user_series(spark, d).groupBy("user_id").agg(F.avg("s").alias("f"))
    whole = full.agg((F.percentile("f", F.lit(0.75)) - F.percentile("f", F.lit(0.25))).alias("iqr"), F.avg("f").alias("gm"))
    first = m.where("window_index = 0").join(full, "user_id").join(F.broadcast(whole)).select("label", (F.col("m") - F.col("gm")).alias("a"), (F.col("f") - F.col("gm")).alias("b"))
    sign = agg.sign_stability(first, ["label"]).select("label", F.col("agreement").alias("sign_agreement"))
    j = n.join(diff, "label").join(rho, "label").join(position, "label").join(sign, "label").join(F.broadcast(whole))
    return j.select("label", "sessions", "eligible", (F.col("median_abs") / F.col("iqr")).alias("nmae"), "rho", "abs_dz", "sign_agreement")


@register(
    "a43_event_locked_mean",
    """, e AS (SELECT user_id, event_id, t FROM us WHERE event_type = 'error'),
    j AS (SELECT e.user_id, us.t - e.t AS lag, us.s FROM e JOIN us ON e.user_id = us.user_id AND us.t > e.t AND us.t <= e.t + 72000)
    SELECT user_id, CASE WHEN lag <= 18000 THEN 0 ELSE 1 END AS bin, count(*) AS n, avg(s) AS mean FROM j GROUP BY 1, 2""",
    EVENTS,
    USER,
    rnd="mean",
    digits=9,
)
def a43(spark, d):
    us = user_series(spark, d)
    return pair.event_locked_mean(us, us.where("event_type = 'error'"), ["user_id"], "t", "s", [18000.0, 72000.0])


@register(
    "a44_rate_per_block",
    """, n AS (SELECT blocks.user_id, blocks.block, count(us.t) AS n_events, count(us.t) * 60.0 / nullif(max(stop_s) - max(start_s), 0) AS rate
    FROM blocks LEFT JOIN us ON us.user_id = blocks.user_id AND us.t BETWEEN start_s AND stop_s AND us.event_type = 'error' GROUP BY 1, 2)
    SELECT user_id, block, n_events, rate, max(rate) OVER (PARTITION BY user_id) / nullif(min(rate) OVER (PARTITION BY user_id), 0) AS max_over_min FROM n""",
    EVENTS,
    USER,
    SB,
    rnd="rate max_over_min",
)
def a44(spark, d):
    us = user_series(spark, d)
    return pair.rate_per_block(us.where("event_type = 'error'"), signup_blocks(spark, d), ["user_id"], "t")

