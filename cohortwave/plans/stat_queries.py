"""Aggregations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwave.operators import aggregates as agg
from cohortwave.plans import base
from cohortwave.plans.base import BANDS, EVENTS, PREDICTIONS, SERIES, TRIALS, read, register

SESSIONS = f"{TRIALS}, ok AS (SELECT * FROM trials WHERE rt BETWEEN 5 AND 200), sess AS (SELECT subject, session, count(rt) AS n, median(rt) AS median_rt, avg(rt) AS mean_rt, avg(1 / rt) AS mean_speed, stddev_samp(rt) AS sd_rt FROM ok GROUP BY 1, 2)"


def sessions(spark, d):
    return agg.session_targets(base.trials(spark, d).where("rt between 5 and 200"), ["subject", "session"])


@register("a1_session_targets", "SELECT * FROM sess", SESSIONS, rnd="median_rt mean_rt mean_speed sd_rt")
def a1(spark, d):
    return sessions(spark, d)


PAIRED = f"""{SESSIONS}, wide AS (SELECT subject, max(median_rt) FILTER (session = 'baseline') AS m0, max(median_rt) FILTER (session = 'perturbation') AS m1, max(mean_speed) FILTER (session = 'baseline') AS v0,
max(mean_speed) FILTER (session = 'perturbation') AS v1 FROM sess GROUP BY 1),
    paired AS (SELECT subject, m1 - m0 AS delta_median, ln(m1) - ln(m0) AS y_rt, ln(v0) - ln(v1) AS y_speed, m0 IS NOT NULL AND m1 IS NOT NULL AS computed,
CASE WHEN m0 IS NULL THEN 'no_baseline' WHEN m1 IS NULL THEN 'no_perturbation' ELSE '' END AS reason FROM wide)"""


@register("a2_paired_targets", "SELECT * FROM paired", PAIRED, rnd="delta_median y_rt y_speed")
def a2(spark, d):
    return agg.paired_targets(sessions(spark, d), "subject", "baseline", "perturbation")


def region_series(spark, d):
    return agg.region_series(base.channels(spark, d), ["subject", "session", "region", "epoch"])


@register("a4_level_and_dispersion", "SELECT subject, session, region, count(s) AS n, avg(s) AS m, stddev_samp(s) AS j FROM series GROUP BY 1, 2, 3", SERIES, rnd="m j")
def a4(spark, d):
    return agg.level_and_dispersion(region_series(spark, d), ["subject", "session", "region"])


RELATIVE = "per AS (SELECT subject, session, channel, avg(theta / tot) AS tm, stddev_samp(theta / tot) AS ts, avg(alpha / tot) AS am, stddev_samp(alpha / tot) AS asd, avg(beta / tot) AS bm, stddev_samp(beta / tot) AS bs FROM (SELECT *, theta + alpha + beta AS tot FROM bands) GROUP BY 1, 2, 3)"


@register(
    "a5_relative_power_features",
    "SELECT subject, session, channel % 3 AS region, avg(tm) AS theta_mean, avg(ts) AS theta_sd, avg(am) AS alpha_mean, avg(asd) AS alpha_sd, avg(bm) AS beta_mean, avg(bs) AS beta_sd FROM per GROUP BY 1, 2, 3",
    BANDS,
    RELATIVE,
    rnd="theta_mean theta_sd alpha_mean alpha_sd beta_mean beta_sd",
)
def a5(spark, d):
    b = base.bands(spark, d).withColumn("region", F.col("channel") % 3)
    return agg.relative_power_features(b, ["subject", "session", "channel", "region"], ["subject", "session", "region"], ["theta", "alpha", "beta"])


@register(
    "a6_floor_audit",
    "SELECT session, count(*) AS n, "
    + ", ".join(f"count(*) FILTER ({b} <= 0.03) AS {b}_floor, min({b}) AS {b}_min, max({b}) AS {b}_max, avg({b}) AS {b}_mean" for b in ("alpha", "beta"))
    + ", max(abs(alpha / (alpha + beta) + beta / (alpha + beta) - 1)) AS identity_error FROM bands GROUP BY 1",
    BANDS,
    rnd="alpha_min alpha_max alpha_mean beta_min beta_max beta_mean identity_error",
)
def a6(spark, d):
    return agg.floor_audit(base.bands(spark, d), ["session"], ["alpha", "beta"], 0.03)


@register(
    "a7_percentile_summary",
    """SELECT user_id, event_type, n, CASE WHEN n >= 2 THEN a END AS low, CASE WHEN n >= 2 THEN p1 END AS p25, CASE WHEN n >= 2 THEN p2 END AS median, CASE WHEN n >= 2 THEN p3 END AS p75, CASE WHEN n >= 2 THEN b END AS high,
    CASE WHEN n >= 2 THEN p3 - p1 END AS iqr
    FROM (SELECT user_id, event_type, count(value) AS n, min(value) AS a, max(value) AS b, quantile_cont(value, 0.25) AS p1, quantile_cont(value, 0.5) AS p2, quantile_cont(value, 0.75) AS p3
    FROM events GROUP BY 1, 2)""",
    rnd="low p25 median p75 high iqr",
)
def a7(spark, d):
    return agg.percentile_summary(read(spark, d, "events"), ["user_id", "event_type"], "value")


#: Pairs of neighbouring values of a user, in event order.
PAIRS = "pairs AS (SELECT * FROM (SELECT user_id, event_type, event_id, value AS a, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL)"


def pairs(spark, d):
    from pyspark.sql import Window

    ev = read(spark, d, "events")
    return ev.select("user_id", "event_type", "event_id", F.col("value").alias("a"), F.lead("value").over(Window.partitionBy("user_id").orderBy("event_id")).alias("b")).where("b is not null")


@register("a8_absolute_disagreement", "SELECT event_type, count(*) AS n, median(abs(a - b)) AS median_abs, avg(abs(a - b)) AS mean_abs, quantile_cont(abs(a - b), 0.9) AS p90_abs FROM pairs GROUP BY 1", PAIRS, rnd="median_abs mean_abs p90_abs")
def a8(spark, d):
    return agg.absolute_disagreement(pairs(spark, d), ["event_type"])


@register(
    "a8_normalized_disagreement",
    """, x AS (SELECT event_type, count(*) AS n, median(abs(a - b)) AS median_abs, avg(abs(a - b)) AS mean_abs, quantile_cont(abs(a - b), 0.9) AS p90_abs
    FROM pairs GROUP BY 1),
    r AS (SELECT event_type, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events
    GROUP BY 1) SELECT *, median_abs / CASE WHEN iqr > 0 THEN iqr END AS nmae FROM x LEFT JOIN r USING (event_type)""",
    PAIRS,
    rnd="median_abs mean_abs p90_abs iqr nmae",
)
def a8b(spark, d):
    return agg.normalized_disagreement(pairs(spark, d), agg.percentile_summary(read(spark, d, "events"), ["event_type"], "value"), ["event_type"])


@register(
    "a9_bland_altman",
    """, x AS (SELECT user_id, a - b AS d, (a + b) / 2 AS m
    FROM pairs) SELECT user_id, count(d) AS n, avg(d) AS bias, stddev_samp(d) AS sd, median(d) AS median_diff, quantile_cont(d, 0.025) AS p2_5, quantile_cont(d, 0.975) AS p97_5,
    regr_slope(d, m) AS slope, corr(d, m) AS r, avg(d) - 1.96 * stddev_samp(d) AS lower, avg(d) + 1.96 * stddev_samp(d) AS upper FROM x GROUP BY 1""",
    PAIRS,
    rnd="bias sd median_diff p2_5 p97_5 slope r lower upper",
)
def a9(spark, d):
    return agg.bland_altman(pairs(spark, d), ["user_id"])


RATINGS = "ratings AS (SELECT l_suppkey AS target, l_linenumber AS rater, l_returnflag AS g, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"


@register(
    "a10_icc_2_1",
    """, c AS (SELECT *, count(*) OVER (PARTITION BY g, target) AS k1 FROM ratings),
    f AS (SELECT * FROM (SELECT *, max(k1) OVER (PARTITION BY g) AS km FROM c) WHERE k1 = km),
    r AS (SELECT g, var_pop(tm) * count(*) * max(k) AS ssr, count(*) AS n, max(k) AS k FROM (SELECT g, target, avg(v) AS tm, count(*) AS k FROM f
    GROUP BY 1, 2) GROUP BY 1),
    q AS (SELECT g, var_pop(rm) * count(*) * max(n) AS ssc FROM (SELECT g, rater, avg(v) AS rm, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT g, var_pop(v) * count(*) AS sst FROM f GROUP BY 1),
    m AS (SELECT g, n, k, ssr / (n - 1) AS msr, ssc / (k - 1) AS msc, (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS mse
    FROM r JOIN q USING (g) JOIN t USING (g) WHERE n > 1 AND k > 1)
    SELECT g, n, k, (msr - mse) / nullif(msr + (k - 1) * mse + k * (msc - mse) / n, 0) AS icc, msr / nullif(mse, 0) AS f FROM m""",
    RATINGS,
    rnd="icc f",
)
def a10(spark, d):
    r = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("rater"), F.col("l_returnflag").alias("g")).agg(F.avg("l_quantity").alias("v"))
    return agg.icc_2_1(r, ["g"], "target", "rater", "v")


@register(
    "a11_variance_components",
    """WITH g AS (SELECT event_type, user_id, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM events GROUP BY 1, 2),
    s AS (SELECT event_type, count(*) AS groups, CAST(sum(n) AS BIGINT) AS total, sum(ss) AS ssw, sum(n * m * m) AS s2, sum(n * m) AS s1, sum(n * n) AS nn
    FROM g GROUP BY 1),
    v AS (SELECT event_type, groups, total, ssw / (total - groups) AS within, greatest(((s2 - s1 * s1 / total) / (groups - 1) - ssw / (total - groups)) / ((total - nn / total) / (groups - 1)), 0) AS between_
    FROM s)
    SELECT event_type, groups, total, within, round(between_, 4) AS between, between_ / (between_ + within) AS share FROM v""",
    rnd="within share",
)
def a11(spark, d):
    return agg.variance_components(read(spark, d, "events"), ["event_type"], "user_id", "value").withColumn("between", F.round("between", 4))


@register("a12_sign_stability", "SELECT event_type, count(*) FILTER (a <> 0 AND b <> 0) AS n, count(*) FILTER (a = 0 OR b = 0) AS n_zero, count(*) FILTER (a <> 0 AND b <> 0 AND sign(a) = sign(b)) AS n_same, count(*) FILTER (a <> 0 AND b <> 0 AND sign(a) = sign(b)) / count(*) FILTER (a <> 0 AND b <> 0) AS agreement FROM (SELECT event_type, round(a - 35, 0) AS a, round(b - 35, 0) AS b FROM pairs) GROUP BY 1", PAIRS, rnd="agreement")
def a12(spark, d):
    return agg.sign_stability(pairs(spark, d).select("event_type", F.round(F.col("a") - 35, 0).alias("a"), F.round(F.col("b") - 35, 0).alias("b")), ["event_type"])


RANKED = "rk AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY a) + (count(*) OVER (PARTITION BY user_id, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY user_id ORDER BY b) + (count(*) OVER (PARTITION BY user_id, b) - 1) / 2.0 AS rb FROM (SELECT user_id, round(a / 10) AS a, round(b / 10) AS b FROM pairs))"


@register("a13_spearman", "SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0) END AS rho FROM rk GROUP BY 1", PAIRS, RANKED, rnd="rho")
def a13(spark, d):
    return agg.spearman(pairs(spark, d).select("user_id", F.round(F.col("a") / 10).alias("a"), F.round(F.col("b") / 10).alias("b")), ["user_id"])


METRICS = f"""{PREDICTIONS}, pr AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY arm, seed, subject, p) - 1) / 2.0 AS rk FROM pred
    WINDOW w AS (PARTITION BY arm, seed, subject ORDER BY p)),
mc AS (SELECT arm, seed, subject, count(*) AS n, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn, sum(rk) FILTER (y = 1) AS rs
    FROM pr GROUP BY 1, 2, 3),
metrics AS (SELECT arm, seed, subject, n, tp, fp, fn, tn, (tp + tn) / n AS accuracy, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
(rs - (tp + fn) * (tp + fn + 1) / 2.0) / nullif((tp + fn) * (tn + fp), 0) AS auc FROM mc)"""


def metrics(spark, d):
    return agg.classification_metrics(base.predictions(spark, d), ["arm", "seed", "subject"])


@register("a14_classification_metrics", "SELECT * FROM metrics", METRICS, rnd="accuracy balanced_accuracy f1 auc")
def a14(spark, d):
    return metrics(spark, d)


@register(
    "a14_binned_auc",
    """, h AS (SELECT l_linestatus AS arm, l_discount * 10 AS p, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag <> 'R') AS neg
    FROM lineitem GROUP BY 1, 2),
    c AS (SELECT arm, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY arm
    ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS a FROM h) SELECT arm, sum(a) / (sum(pos) * sum(neg)) AS auc FROM c
    GROUP BY 1""",
    EVENTS,
    rnd="auc",
)
def a14b(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_linestatus").alias("arm"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"))
    return agg.binned_auc(li, ["arm"])


@register("a15_subject_macro", "SELECT arm, seed, count(balanced_accuracy) AS n_subjects, avg(balanced_accuracy) AS macro FROM metrics GROUP BY 1, 2", METRICS, rnd="macro")
def a15(spark, d):
    return agg.subject_macro(base.predictions(spark, d), ["arm", "seed"], "subject")


BATCHES = f"""{PREDICTIONS}, pos AS (SELECT *, (row_number() OVER (PARTITION BY arm, subject ORDER BY segment_id) - 1) // 8 AS batch FROM pred),
q AS (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS c FROM pos),
b0 AS (SELECT arm, subject, batch, count(*) AS n, avg(p) AS q1, avg(-(c * ln(c) + (1 - c) * ln(1 - c))) AS h_cond, avg(greatest(p, 1 - p)) AS mean_max_conf, avg(CAST(p >= 0.5 AS INTEGER)) AS pred_positive, avg(y) AS true_positive_share,
avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS accuracy, avg(CAST(p >= 0.5 AS INTEGER)) FILTER (y = 1) AS s1, avg(CAST(p < 0.5 AS INTEGER)) FILTER (y = 0) AS s0
    FROM q GROUP BY 1, 2, 3),
b1 AS (SELECT *, least(greatest(q1, 1e-12), 1 - 1e-12) AS qc FROM b0),
batches AS (SELECT arm, subject, batch, n, q1, h_cond, mean_max_conf, pred_positive, true_positive_share, accuracy, -(qc * ln(qc) + (1 - qc) * ln(1 - qc)) AS h_marg, greatest(pred_positive, 1 - pred_positive) AS dominant, (s1 + s0) / 2 AS balanced_accuracy
    FROM b1)"""


def batches(spark, d):
    from pyspark.sql import Window

    p = base.predictions(spark, d)
    w = Window.partitionBy("arm", "subject").orderBy("segment_id")
    return agg.batch_stats(p.withColumn("batch", F.floor((F.row_number().over(w) - 1) / 8)), ["arm", "subject", "batch"])


@register("a16_batch_stats", "SELECT * FROM batches", BATCHES, rnd="q1 h_cond mean_max_conf pred_positive true_positive_share accuracy h_marg dominant balanced_accuracy")
def a16(spark, d):
    return batches(spark, d)


QUARTILES = "qn AS (SELECT arm, subject, q1, row_number() OVER (PARTITION BY arm, subject ORDER BY batch) - 1 AS i, count(*) OVER (PARTITION BY arm, subject) AS n FROM batches), qs AS (SELECT arm, subject, max(n) AS n_batches, avg(q1) FILTER (i < floor(n / 4)) AS a, avg(q1) FILTER (i >= ceil(3 * n / 4)) AS b FROM qn GROUP BY 1, 2)"


@register("a17_quartile_summary", "SELECT arm, subject, n_batches, CASE WHEN n_batches >= 4 THEN a END AS first, CASE WHEN n_batches >= 4 THEN b END AS last, CASE WHEN n_batches >= 4 THEN b - a END AS delta FROM qs", BATCHES, QUARTILES, rnd="first last delta")
def a17(spark, d):
    return agg.quartile_summary(batches(spark, d), ["arm", "subject"], "batch", "q1")


@register(
    "a18_hierarchical_summary",
    """, s AS (SELECT arm, avg(m) AS grand_mean, stddev_samp(m) AS sd_subjects, count(*) AS n_subjects FROM (SELECT arm, subject, avg(accuracy) AS m
    FROM metrics GROUP BY 1, 2) GROUP BY 1),
    e AS (SELECT arm, stddev_samp(m) AS sd_seeds, count(*) AS n_seeds FROM (SELECT arm, seed, avg(accuracy) AS m FROM metrics GROUP BY 1, 2) GROUP BY 1),
    c AS (SELECT arm, count(*) AS cells FROM (SELECT DISTINCT arm, seed, subject FROM metrics) GROUP BY 1)
    SELECT arm, grand_mean, sd_subjects, n_subjects, sd_seeds, n_seeds, cells = n_subjects * n_seeds AS complete FROM s JOIN e USING (arm) JOIN c USING (arm)""",
    METRICS,
    rnd="grand_mean sd_subjects sd_seeds",
)
def a18(spark, d):
    return agg.hierarchical_summary(metrics(spark, d), "arm", "seed", "subject", "accuracy")


DELTAS = "deltas AS (SELECT subject, avg(accuracy) FILTER (arm = 'a') AS source, avg(accuracy) FILTER (arm = 'b') - avg(accuracy) FILTER (arm = 'a') AS delta_b FROM metrics GROUP BY 1)"


def deltas(spark, d):
    return agg.arm_deltas(metrics(spark, d), "subject", "arm", "accuracy", "a", ["b"])


@register("a19_arm_vs_source_deltas", "SELECT * FROM deltas", METRICS, DELTAS, rnd="source delta_b")
def a19(spark, d):
    return deltas(spark, d)


@register(
    "a20_delta_summary",
    """, x AS (SELECT subject % 5 AS cohort, round(delta_b, 9) AS d
    FROM deltas) SELECT cohort, count(d) AS n, avg(d) AS mean, median(d) AS median, stddev_samp(d) AS sd, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS iqr,
    count(*) FILTER (d > 0) AS improved, count(*) FILTER (d < 0) AS harmed, count(*) FILTER (d = 0) AS tied FROM x GROUP BY 1""",
    METRICS,
    DELTAS,
    rnd="mean median sd q1 q3 iqr",
)
def a20(spark, d):
    return agg.delta_summary(deltas(spark, d).select((F.col("subject") % 5).alias("cohort"), F.round("delta_b", 9).alias("d")), ["cohort"], "d")


@register("a21_count_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a21(spark, d):
    return agg.count_rollup(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("a22_distinct_audit", "SELECT lang, count(*) AS n_rows, count(DISTINCT sha256(text)) AS n_distinct, count(*) = count(DISTINCT sha256(text)) AS all_distinct FROM documents GROUP BY 1")
def a22(spark, d):
    return agg.distinct_audit(read(spark, d, "documents").select("lang", F.sha2("text", 256).alias("digest")), ["lang"], "digest")


@register(
    "a23_fit_channel_scaler",
    """WITH m AS (SELECT label, CAST(sum(len(embedding)) AS BIGINT) AS n, sum(list_sum(CAST(embedding AS DOUBLE[]))) AS s, sum(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS ss
    FROM embeddings GROUP BY 1),
    r AS (SELECT label, CAST(sum(n) OVER () - n AS BIGINT) AS n, sum(s) OVER () - s AS s, sum(ss) OVER () - ss AS ss
    FROM m) SELECT label, n, s / n AS mean, sqrt(greatest(ss / n - (s / n) * (s / n), 1e-12)) AS sd FROM r""",
    rnd="mean sd",
)
def a23(spark, d):
    return agg.fit_channel_scaler(read(spark, d, "embeddings"), "label", [], "embedding")


@register("a24_padding_mask", "SELECT l_suppkey, l_linenumber, bool_and(l_tax = 0) AS padding, count(*) AS n FROM lineitem WHERE l_quantity < 3 GROUP BY 1, 2")
def a24(spark, d):
    return agg.padding_mask(read(spark, d, "lineitem").where("l_quantity < 3"), ["l_suppkey", "l_linenumber"], "l_tax")


@register(
    "a25_window_inventory",
    """WITH w AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY 1, 2), p AS (SELECT DISTINCT user_id, event_type FROM events)
    SELECT user_id, event_type, coalesce(n, 0) AS n_windows, coalesce(n, 0) >= 2 AS eligible FROM p LEFT JOIN w USING (user_id, event_type)""",
)
def a25(spark, d):
    ev = read(spark, d, "events")
    return agg.window_inventory(ev.where("value > 100"), ev.select("user_id", "event_type").distinct(), ["user_id", "event_type"])


@register(
    "a26_shape_stats",
    """WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), c AS (SELECT event_type, value - m AS x FROM events JOIN m USING (event_type)),
    a AS (SELECT event_type, count(*) AS n, avg(x ** 3) / avg(x ** 2) ** 1.5 AS skew, avg(x ** 4) / avg(x ** 2) ** 2 - 3 AS kurtosis FROM c GROUP BY 1),
    w AS (SELECT event_type, sqrt(avg(v)) AS within_sd FROM (SELECT event_type, user_id, var_samp(value) AS v FROM events GROUP BY 1, 2)
    GROUP BY 1) SELECT * FROM a JOIN w USING (event_type)""",
    rnd="skew kurtosis within_sd",
)
def a26(spark, d):
    return agg.shape_stats(read(spark, d, "events"), ["event_type"], "user_id", "value")


@register(
    "a27_approximate_reliability",
    """, t AS (SELECT session, mean_rt AS y, sd_rt / sqrt(n) AS se
    FROM sess) SELECT session, count(y) AS n, CASE WHEN count(y) >= 3 THEN greatest(1 - avg(se * se) / nullif(var_samp(y), 0), 0) END AS reliability
    FROM t GROUP BY 1""",
    SESSIONS,
    rnd="reliability",
)
def a27(spark, d):
    t = sessions(spark, d).select("session", F.col("mean_rt").alias("y"), (F.col("sd_rt") / F.sqrt("n")).alias("se"))
    return agg.approximate_reliability(t, ["session"], "y", "se")


@register(
    "a28_split_half_reliability",
    """, h AS (SELECT subject, session, rt, row_number() OVER (PARTITION BY subject, session ORDER BY trial_id) % 2 AS half FROM ok),
    m AS (SELECT subject, half, ln(median(rt) FILTER (session = 'perturbation')) - ln(median(rt) FILTER (session = 'baseline')) AS y FROM h GROUP BY 1, 2),
    w AS (SELECT subject, max(y) FILTER (half = 1) AS a, max(y) FILTER (half = 0) AS b FROM m GROUP BY 1),
    r AS (SELECT count(*) AS n, corr(a, b) AS pearson, count(*) FILTER (sign(a) = sign(b)) / count(*) AS sign_agreement FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT n, pearson, 2 * pearson / (1 + pearson) AS spearman_brown, sign_agreement FROM r""",
    SESSIONS,
    rnd="pearson spearman_brown sign_agreement",
)
def a28(spark, d):
    from cohortwave.functions.scalar import safe_corr

    h = agg.split_halves(base.trials(spark, d).where("rt between 5 and 200"), ["subject", "session"], ["trial_id"])
    s = agg.session_targets(h, ["subject", "half", "session"])
    y = s.groupBy("subject").agg(*[(F.ln(F.max(F.when((F.col("half") == i) & (F.col("session") == "perturbation"), F.col("median_rt")))) - F.ln(F.max(F.when((F.col("half") == i) & (F.col("session") == "baseline"), F.col("median_rt"))))).alias(n) for i, n in ((1, "a"), (0, "b"))])
    r = y.where("a is not null and b is not null").agg(F.count("*").alias("n"), safe_corr("a", "b").alias("pearson"), F.avg((F.signum("a") == F.signum("b")).cast("int")).alias("sign_agreement"))
    return r.select("n", "pearson", agg.spearman_brown(F.col("pearson")).alias("spearman_brown"), "sign_agreement")


@register(
    "a29_one_sample_effect",
    "SELECT event_type, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t, avg(x) / stddev_samp(x) AS dz, avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*)) AS lower, avg(x) + 1.96 * stddev_samp(x) / sqrt(count(*)) AS upper FROM (SELECT event_type, a - b AS x FROM pairs) GROUP BY 1",
    PAIRS,
    rnd="mean sd t dz lower upper",
)
def a29(spark, d):
    return agg.one_sample_effect(pairs(spark, d).select("event_type", (F.col("a") - F.col("b")).alias("x")), ["event_type"], "x")


@register(
    "a30_wilcoxon_signed_rank",
    """, x AS (SELECT user_id, round((a - b) / 5) AS d FROM pairs),
    r AS (SELECT user_id, d, abs(d) AS ad, rank() OVER (PARTITION BY user_id
    ORDER BY abs(d)) + (count(*) OVER (PARTITION BY user_id, abs(d)) - 1) / 2.0 AS rk FROM x WHERE d <> 0),
    t AS (SELECT user_id, sum(c * c * c - c) AS ties FROM (SELECT user_id, ad, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT user_id, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus FROM r GROUP BY 1)
    SELECT user_id, n, CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus, (w_plus - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 0) AS z
    FROM s JOIN t USING (user_id)""",
    PAIRS,
    rnd="z",
)
def a30(spark, d):
    return agg.wilcoxon_signed_rank(pairs(spark, d).select("user_id", F.round((F.col("a") - F.col("b")) / 5).alias("d")), ["user_id"], "d")


@register(
    "a31_lane_metrics",
    """WITH s AS (SELECT user_id, event_id, value - 50 AS x FROM events),
    o AS (SELECT *, abs(x) > 40 AS out, lag(abs(x) > 40) OVER (PARTITION BY user_id ORDER BY event_id) AS po FROM s)
    SELECT user_id, count(x) AS n, avg(abs(x)) AS mean_abs, median(abs(x)) AS median_abs, quantile_cont(abs(x), 0.9) AS p90_abs, stddev_samp(x) AS sdlp, sqrt(avg(x * x)) AS rms, avg(CAST(out AS INTEGER)) AS share_out, count(*) FILTER (out AND NOT coalesce(po, false)) AS excursions
    FROM o GROUP BY 1""",
    rnd="mean_abs median_abs p90_abs sdlp rms share_out",
)
def a31(spark, d):
    return agg.lane_metrics(read(spark, d, "events").select("user_id", "event_id", (F.col("value") - 50).alias("x")), ["user_id"], "event_id", "x", 40.0)


LATENCIES = "lat AS (SELECT user_id, event_type, event_id % 2 AS side, CASE WHEN k >= 15 THEN value / 20 END AS l FROM ev)"


def latencies(spark, d):
    return base.events(spark, d).select("user_id", "event_type", (F.col("event_id") % 2).alias("side"), F.when(F.col("k") >= 15, F.col("value") / 20).alias("l"))


@register(
    "a32_response_targets",
    "SELECT user_id, count(*) AS n, count(l) AS n_answered, avg(1 / l) AS mean_speed, median(l) AS median_latency, median(coalesce(least(l, 10), 10)) AS median_censored, avg(coalesce(least(l, 10), 10)) AS mean_censored FROM lat GROUP BY 1",
    EVENTS,
    LATENCIES,
    rnd="mean_speed median_latency median_censored mean_censored",
)
def a32(spark, d):
    return agg.response_targets(latencies(spark, d), ["user_id"], "l", 10.0)


@register(
    "a33_ols_time_on_task",
    """, c AS (SELECT event_type, user_id, (t - avg(t) OVER w) / 3600 AS x, value - avg(value) OVER w AS z FROM ev WINDOW w AS (PARTITION BY event_type, user_id)),
    s AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS subjects, sum(x * x) AS sxx, sum(x * z) AS sxz, sum(z * z) AS szz FROM c GROUP BY 1)
    SELECT event_type, n, subjects, sxz / sxx AS slope, 1 - (szz - sxz * sxz / sxx) / szz AS r2_within, (sxz * sxz / sxx) / ((szz - sxz * sxz / sxx) / (n - subjects - 1)) AS f
    FROM s""",
    EVENTS,
    rnd="slope r2_within f",
    digits=5,
)
def a33(spark, d):
    ev = base.events(spark, d).withColumn("h", (F.col("t") - 1704067200.0) / 3600)
    return agg.ols_time_on_task(ev, ["event_type"], "user_id", "h", "value")


@register(
    "a34_selection_stability",
    """WITH s AS (SELECT user_id, event_id % 6 AS fold, list_distinct(list(event_type)) AS items FROM events GROUP BY 1, 2),
    j AS (SELECT a.user_id, len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items))) AS j
    FROM s a JOIN s b ON a.user_id = b.user_id AND a.fold < b.fold),
    n AS (SELECT user_id, count(DISTINCT list_sort(items)) AS n_subsets FROM s
    GROUP BY 1) SELECT user_id, count(*) AS pairs, avg(j) AS mean, min(j) AS low, median(j) AS median, max(n_subsets) AS n_subsets
    FROM j JOIN n USING (user_id) GROUP BY 1""",
    rnd="mean low median",
)
def a34(spark, d):
    s = read(spark, d, "events").groupBy("user_id", (F.col("event_id") % 6).alias("fold")).agg(F.collect_set("event_type").alias("items"))
    return agg.selection_stability(s, ["user_id"], "fold", "items")


SCORED = "sc AS (SELECT event_type, value AS y, 20 + k * 0.5 AS p, avg(value) OVER (PARTITION BY event_type) AS m0 FROM ev)"


@register(
    "a35_regression_scores",
    "SELECT event_type, count(*) AS n, corr(y, p) AS r, sqrt(avg((y - p) ** 2)) AS rmse, sqrt(avg((y - p) ** 2)) / stddev_samp(y) AS rmse_over_sd, 1 - sum((y - p) ** 2) / sum((y - m0) ** 2) AS q2, avg(abs(y - p)) AS mae, 1 - avg(abs(y - p)) / avg(abs(y - m0)) AS mae_skill FROM sc GROUP BY 1",
    EVENTS,
    SCORED,
    rnd="r rmse rmse_over_sd q2 mae mae_skill",
)
def a35(spark, d):
    ev = base.events(spark, d)
    m0 = ev.groupBy("event_type").agg(F.avg("value").alias("m0"))
    return agg.regression_scores(ev.join(m0, "event_type").select("event_type", F.col("value").alias("y"), (20 + F.col("k") * 0.5).alias("p"), "m0"), ["event_type"], "y", "p", "m0")


@register(
    "a36_qc_report",
    """SELECT name, failures, warnings, CASE WHEN failures > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (
    SELECT 'positive' AS name, count(*) FILTER (value <= 0) AS failures, count(*) FILTER (value < 1) AS warnings FROM events
    UNION ALL SELECT 'range', count(*) FILTER (value > 300), count(*) FILTER (value > 200) FROM events
    UNION ALL SELECT 'named', count(*) FILTER (event_type IS NULL), 0 FROM events)""",
)
def a36(spark, d):
    v = F.col("value")
    return agg.qc_report(read(spark, d, "events"), {"positive": (F.count_if(v <= 0), F.count_if(v < 1)), "range": (F.count_if(v > 300), F.count_if(v > 200)), "named": (F.count_if(F.col("event_type").isNull()), F.lit(0))})


@register(
    "a37_number_check",
    """WITH e AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1),
    c AS (SELECT event_type, avg(value) + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS v FROM events WHERE event_type <> 'click' GROUP BY 1
    UNION ALL SELECT 'nothing', 1.0)
    SELECT c.event_type, c.v AS claimed, e.v AS found, coalesce(round(c.v, 2) = round(e.v, 2), false) AS ok FROM c LEFT JOIN e USING (event_type)""",
    rnd="claimed found",
)
def a37(spark, d):
    e = read(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("value"))
    c = e.where("event_type <> 'click'").withColumn("value", F.col("value") + F.when(F.col("event_type") == "view", 1.0).otherwise(0.0)).unionByName(spark.createDataFrame([("nothing", 1.0)], "event_type string, value double"))
    return agg.number_check(c, e, "event_type", 2)


@register(
    "a38_time_lag_autocorr",
    "SELECT user_id, count(c) AS n, sum(c * p) / sum(c * c) AS acf FROM (SELECT user_id, c, lag(c) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS c FROM events)) GROUP BY 1",
    rnd="acf",
)
def a38(spark, d):
    return agg.lag_autocorrelation(read(spark, d, "events"), ["user_id"], "event_id", "value")


@register(
    "a42_response_profile",
    """SELECT event_type, count(*) AS n, median(l) AS median, quantile_cont(l, 0.75) - quantile_cont(l, 0.25) AS iqr, stddev_samp(l) / avg(l) AS cv, quantile_cont(l, 0.95) AS p95, avg(CAST(l > 5 AS INTEGER)) AS share_slow, avg(CAST(l IS NULL AS INTEGER)) AS share_missed,
    median(l) FILTER (side = 0) - median(l) FILTER (side = 1) AS left_minus_right FROM lat GROUP BY 1""",
    EVENTS,
    LATENCIES,
    rnd="median iqr cv p95 share_slow share_missed left_minus_right",
)
def a42(spark, d):
    return agg.response_profile(latencies(spark, d), ["event_type"], "l", "side", 5.0)


# tail probabilities: no SQL; tests hold the tails against numeric integration


@register("a10_icc_interval")
def a10b(spark, d):
    r = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("rater"), F.col("l_returnflag").alias("g")).agg(F.avg("l_quantity").alias("v"))
    return agg.icc_interval(r, ["g"], "target", "rater", "v")


@register("a29_t_test")
def a29b(spark, d):
    return agg.with_t_test(agg.one_sample_effect(pairs(spark, d).select("user_id", (F.col("a") - F.col("b")).alias("x")), ["user_id"], "x"))


@register("a30_wilcoxon_p_value")
def a30b(spark, d):
    return agg.with_normal_test(agg.wilcoxon_signed_rank(pairs(spark, d).select("user_id", F.round((F.col("a") - F.col("b")) / 5).alias("d")), ["user_id"], "d"))
