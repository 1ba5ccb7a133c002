"""Spectra, folds, models, resampling and verdicts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwave.functions import spectral
from cohortwave.operators import aggregates as agg
from cohortwave.operators import geometry, models, resampling
from cohortwave.operators import windows as win
from cohortwave.plans import base
from cohortwave.plans.base import EVENTS, read, register
from cohortwave.plans.series_queries import BLOCKS, GAP, USER, user_series
from cohortwave.plans.stat_queries import DELTAS, METRICS, deltas
from cohortwave.sources.tables import scratch

POWER_BANDS = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "total": (1.0, 30.0)}
#: One-sided Welch density of one segment of 64 samples at 64 Hz: bins of 1 Hz.
PSD = """x AS (SELECT vec_id, label, unnest(range(0, 64)) AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    c AS (SELECT vec_id, label, n, (v - avg(v) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS v FROM x),
psd AS (SELECT vec_id, label, f, (sum(v * cos(2 * pi() * f * n / 64)) ** 2 + sum(v * sin(2 * pi() * f * n / 64)) ** 2) / (64 * 24.0) * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END AS p
    FROM c, (SELECT unnest(range(0, 33)) AS f) GROUP BY 1, 2, 3),
tr AS (SELECT vec_id, label, f, p, lag(p) OVER (PARTITION BY vec_id ORDER BY f) AS q FROM psd)"""
AREAS = ", ".join(f"sum((p + q) / 2) FILTER (f > {int(lo)} AND f <= {int(hi)}) AS {n}" for n, (lo, hi) in POWER_BANDS.items())


def powers(spark, d):
    return spectral.band_powers(base.epochs(spark, d), 64.0, POWER_BANDS)


@register("m1_band_powers", f"SELECT vec_id AS epoch, label AS subject, CASE WHEN vec_id % 2 = 0 THEN 'baseline' ELSE 'perturbation' END AS session, {AREAS} FROM tr GROUP BY ALL", PSD, rnd="theta alpha beta total", digits=8)
def m1(spark, d):
    return powers(spark, d)


@register(
    "m1_flagship_region_table",
    f""", pw AS (SELECT vec_id AS epoch, label AS subject, CASE WHEN vec_id % 2 = 0 THEN 'baseline' ELSE 'perturbation' END AS session, {AREAS} FROM tr GROUP BY ALL),
    s AS (SELECT subject, session, epoch, sqrt(2.0 / 3) * (ln(theta + 1e-12) - 0.5 * (ln(alpha + 1e-12) + ln(beta + 1e-12))) AS s FROM pw),
    w AS (SELECT *, row_number() OVER (PARTITION BY subject, session ORDER BY epoch) - 1 AS i, count(*) OVER (PARTITION BY subject, session) AS n FROM s),
    m AS (SELECT subject, session, i // 4 AS window_index, avg(s) AS m, stddev_samp(s) AS j FROM w WHERE i < (n // 4) * 4 GROUP BY 1, 2, 3)
    SELECT subject, window_index, max(m) FILTER (session = 'baseline') AS m_baseline, max(m) FILTER (session = 'perturbation') AS m_perturbation, max(j) FILTER (session = 'baseline') AS j_baseline, max(j) FILTER (session = 'perturbation') AS j_perturbation
    FROM m GROUP BY 1, 2""",
    PSD,
    rnd="m_baseline m_perturbation j_baseline j_perturbation",
)
def flagship(spark, d):
    """Spectra, slowing index, windows, level and dispersion, sessions side by side."""
    from cohortwave.functions.scalar import slowing_index

    s = powers(spark, d).select("subject", "session", "epoch", slowing_index(F.col("theta"), F.col("alpha"), F.col("beta")).alias("s"))
    w = agg.level_and_dispersion(win.disjoint_windows(s, ["subject", "session"], "epoch", 4), ["subject", "session", "window_index"])
    wide = w.groupBy("subject", "window_index").pivot("session", ["baseline", "perturbation"]).agg(F.max("m").alias("m"), F.max("j").alias("j"))
    return wide.select("subject", "window_index", F.col("baseline_m").alias("m_baseline"), F.col("perturbation_m").alias("m_perturbation"), F.col("baseline_j").alias("j_baseline"), F.col("perturbation_j").alias("j_perturbation"))


@register(
    "m2_welch_features",
    """WITH x AS (SELECT vec_id, s, unnest(range(0, 32)) AS n, CAST(unnest(embedding[s * 16 + 1:s * 16 + 32]) AS DOUBLE) AS v
    FROM embeddings, (SELECT unnest(range(0, 3)) AS s)),
    c AS (SELECT vec_id, s, n, (v - avg(v) OVER (PARTITION BY vec_id, s)) * (0.5 - 0.5 * cos(2 * pi() * n / 32)) AS v FROM x),
    p AS (SELECT vec_id, s, f, (sum(v * cos(2 * pi() * f * n / 32)) ** 2 + sum(v * sin(2 * pi() * f * n / 32)) ** 2) / (64 * 12.0) * CASE WHEN f IN (0, 16) THEN 1 ELSE 2 END AS p
    FROM c, (SELECT unnest(range(0, 17)) AS f) GROUP BY 1, 2, 3),
    a AS (SELECT vec_id, f, avg(p) AS p FROM p GROUP BY 1, 2), t AS (SELECT vec_id, f * 2 AS f, p, lag(p) OVER (PARTITION BY vec_id ORDER BY f) AS q FROM a)
    SELECT vec_id AS epoch, log10(greatest(sum(p + q) FILTER (f > 4 AND f <= 8), 1e-20)) AS theta, log10(greatest(sum(p + q) FILTER (f > 8 AND f <= 12), 1e-20)) AS alpha, log10(greatest(sum(p + q) FILTER (f > 14 AND f <= 30), 1e-20)) AS beta
    FROM t GROUP BY 1""",
    rnd="theta alpha beta",
)
def m2(spark, d):
    return spectral.welch_features(base.epochs(spark, d).select("epoch", "samples"), 64.0, 32, 16, {"theta": (4.0, 8.0), "alpha": (8.0, 12.0), "beta": (14.0, 30.0)})


@register(
    "m3_band_entropy",
    """WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    p AS (SELECT vec_id, f, sum(v * cos(2 * pi() * f * n / 64)) ** 2 + sum(v * sin(2 * pi() * f * n / 64)) ** 2 AS p
    FROM x, (SELECT unnest(range(1, 33)) AS f) GROUP BY 1, 2)
    SELECT vec_id AS epoch, 0.5 * ln(2 * pi() * exp(1) * greatest(sum(2 * p) FILTER (f BETWEEN 8 AND 14) / (64 * 63), 1e-12)) AS alpha, 0.5 * ln(2 * pi() * exp(1) * greatest(sum(2 * p) FILTER (f BETWEEN 14 AND 31) / (64 * 63), 1e-12)) AS beta
    FROM p GROUP BY 1""",
    rnd="alpha beta",
)
def m3(spark, d):
    return spectral.band_entropy(base.epochs(spark, d).select("epoch", "samples"), 64.0, {"alpha": (8.0, 14.0), "beta": (14.0, 31.0)})


@register(
    "m4_project_to_grid",
    """WITH raw AS (SELECT g AS cell, c AS channel, 1 / (0.5 + ((c % 8) - (g % 4) * 2) ** 2 + ((c // 8) - (g // 4) * 2) ** 2) AS w
    FROM (SELECT unnest(range(0, 16)) AS g), (SELECT unnest(range(0, 64)) AS c)),
    wt AS (SELECT cell, channel, w / sum(w) OVER (PARTITION BY cell) AS w FROM raw),
    x AS (SELECT vec_id, unnest(range(0, 64)) AS channel, CAST(unnest(embedding) AS DOUBLE) AS v
    FROM embeddings) SELECT vec_id, cell, sum(w * v) AS value FROM x JOIN wt USING (channel) GROUP BY 1, 2""",
    rnd="value",
)
def m4(spark, d):
    x = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("channel", "v")).withColumn("v", F.col("v").cast("double"))
    c, g = F.col("channel"), F.col("cell")
    grid = spark.range(64).select(F.col("id").alias("channel"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("cell"))
    raw = grid.select("cell", "channel", (1 / (0.5 + (c % 8 - g % 4 * 2) ** 2 + (F.floor(c / 8) - F.floor(g / 4) * 2) ** 2)).alias("w"))
    total = raw.groupBy("cell").agg(F.sum("w").alias("t"))
    weights = raw.join(total, "cell").select("cell", "channel", (F.col("w") / F.col("t")).alias("w"))
    return models.project_to_grid(x, weights, ["vec_id"], "channel", "v")


#: A montage of 64 channels, none four on a circle: three points make a triangle where no other lies in their circle.
HULL = """po AS (SELECT c AS channel, c % 8 + 0.2 * sin(c * 1.7) AS x, c // 8 + 0.2 * cos(c * 2.3) AS y FROM (SELECT unnest(range(0, 64)) AS c)),
    tri AS (SELECT a.channel AS ca, b.channel AS cb, c.channel AS cc, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS area
    FROM po a JOIN po b ON a.channel < b.channel JOIN po c ON b.channel < c.channel WHERE greatest(abs(a.x - b.x), abs(a.x - c.x), abs(b.x - c.x), abs(a.y - b.y), abs(a.y - c.y), abs(b.y - c.y)) < 9),
    de AS (SELECT * FROM tri WHERE NOT EXISTS (SELECT 1 FROM po WHERE channel NOT IN (ca, cb, cc) AND sign(area) * (
    ((ax - x) ** 2 + (ay - y) ** 2) * ((bx - x) * (cy - y) - (cx - x) * (by_ - y)) - ((bx - x) ** 2 + (by_ - y) ** 2) * ((ax - x) * (cy - y) - (cx - x) * (ay - y))
    + ((cx - x) ** 2 + (cy - y) ** 2) * ((ax - x) * (by_ - y) - (bx - x) * (ay - y))) > 0)),
    box AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM po),
    ce AS (SELECT i AS cell, lx + (i % 14) / 13.0 * (hx - lx) AS x, ly + (i // 14) / 13.0 * (hy - ly) AS y FROM box, (SELECT unnest(range(0, 196)) AS i)),
    ba AS (SELECT cell, ca, cb, cc, ((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) / area AS wb, ((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) / area AS wc FROM ce, de),
    hit AS (SELECT cell, arg_min({'ca': ca, 'cb': cb, 'cc': cc, 'wb': wb, 'wc': wc}, ca * 4096 + cb * 64 + cc) AS h FROM ba WHERE least(wb, wc, 1 - wb - wc) >= -1e-12 GROUP BY 1)"""


@register(
    "m4_project_inside_hull",
    """, e AS (SELECT vec_id, embedding AS v FROM embeddings)
    SELECT vec_id, cell, CASE WHEN h IS NULL THEN 0 ELSE (1 - h.wb - h.wc) * v[h.ca + 1] + h.wb * v[h.cb + 1] + h.wc * v[h.cc + 1] END AS value FROM e, ce LEFT JOIN hit USING (cell)""",
    HULL,
    rnd="value",
    digits=5,
)
def m4_hull(spark, d):
    c = F.col("channel")
    x = read(spark, d, "embeddings").select(F.lit(0).alias("montage"), "vec_id", F.posexplode("embedding").alias("channel", "v")).withColumn("v", F.col("v").cast("double"))
    positions = x.select("montage", "channel").distinct().select("montage", "channel", (c % 8 + 0.2 * F.sin(c * 1.7)).alias("x"), (F.floor(c / 8) + 0.2 * F.cos(c * 2.3)).alias("y"))
    return geometry.project_inside_hull(x, geometry.hull_weights(positions, ["montage"], "channel", 14), ["montage"], ["vec_id"], "channel", "v").drop("montage")


FOLDS = """sub AS (SELECT s_suppkey AS subject FROM supplier),
    mem AS (SELECT a.subject AS fold_id, b.subject, sha256(concat_ws(':', 7, a.subject, b.subject)) AS h, a.subject = b.subject AS test FROM sub a, sub b),
fr AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY test, h, subject) AS r, count(*) OVER (PARTITION BY fold_id) AS n FROM mem),
    folds AS (SELECT fold_id, subject, CASE WHEN test THEN 'test' WHEN r <= ceil((n - 1) * 0.2) THEN 'validation' ELSE 'train' END AS role FROM fr)"""


def folds(spark, d):
    return models.loso_folds(read(spark, d, "supplier").select(F.col("s_suppkey").alias("subject")), "subject", 7, 0.2)


@register("m5_loso_folds", "SELECT * FROM folds", FOLDS)
def m5(spark, d):
    return folds(spark, d)


@register("t3_fold_partition_check", "SELECT CAST(0 AS BIGINT) AS several_roles, CAST(0 AS BIGINT) AS bad_folds, CAST(0 AS BIGINT) AS incomplete_folds, count(*) - count(DISTINCT s_suppkey) AS bad_subjects FROM supplier")
def t3(spark, d):
    return models.fold_partition_check(folds(spark, d), "subject")


@register("m6_subject_ratio_split", "SELECT subject, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS role FROM (SELECT c_custkey AS subject, row_number() OVER (ORDER BY sha256(concat_ws(':', 7, c_custkey)), c_custkey) AS r, count(*) OVER () AS n FROM customer)")
def m6(spark, d):
    return models.subject_ratio_split(read(spark, d, "customer").select(F.col("c_custkey").alias("subject")), "subject", 7, 0.7, 0.15)


@register(
    "m7_standardise_by_fold",
    """, ft AS (SELECT l_suppkey AS subject, avg(l_quantity) AS q, avg(l_extendedprice) AS e FROM lineitem GROUP BY 1),
    j AS (SELECT * FROM folds JOIN ft USING (subject)),
    s AS (SELECT fold_id, avg(q) FILTER (role = 'train') AS mq, stddev_pop(q) FILTER (role = 'train') AS sq, avg(e) FILTER (role = 'train') AS me, stddev_pop(e) FILTER (role = 'train') AS se
    FROM j GROUP BY 1)
    SELECT fold_id, subject, role, (q - mq) / coalesce(nullif(sq, 0), 1) AS q, (e - me) / coalesce(nullif(se, 0), 1) AS e FROM j JOIN s USING (fold_id)""",
    FOLDS,
    rnd="q e",
)
def m7(spark, d):
    ft = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject")).agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"))
    return models.standardise_by_fold(ft, folds(spark, d), "subject", ["q", "e"])


RIDGE = """rs AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_tax) AS my, covar_pop(l_quantity, l_quantity) * count(*) + 2 AS aa, covar_pop(l_discount, l_discount) * count(*) + 2 AS bb, covar_pop(l_quantity, l_discount) * count(*) AS ab,
covar_pop(l_quantity, l_tax) * count(*) AS ay, covar_pop(l_discount, l_tax) * count(*) AS by_ FROM lineitem GROUP BY 1),
    rb AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM rs)"""


@register("m8_ridge_fit", "SELECT l_suppkey, n, my - b1 * ma - b2 * mb AS intercept, b1 AS b_l_quantity, b2 AS b_l_discount FROM rb", RIDGE, rnd="intercept b_l_quantity b_l_discount", digits=7)
def m8(spark, d):
    return models.ridge_fit(read(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_discount"], "l_tax", 2.0)


@register("m24_score_linear", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, my - b1 * ma - b2 * mb + b1 * l_quantity + b2 * l_discount AS score FROM lineitem JOIN rb USING (l_suppkey)", RIDGE, rnd="score")
def m24(spark, d):
    li = read(spark, d, "lineitem")
    model = models.ridge_fit(li, ["l_suppkey"], ["l_quantity", "l_discount"], "l_tax", 2.0).drop("n")
    return models.score_linear(li, model, ["l_suppkey"], ["l_quantity", "l_discount"]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "score")


def nation_features(spark, d):
    """A subject-level table: nations, with features from their customers' orders."""
    c = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return c.groupBy(F.col("c_nationkey").alias("subject")).agg(F.avg("c_acctbal").alias("a"), F.avg("o_totalprice").alias("b"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("c"), (F.avg("c_acctbal") * 2 + F.stddev_samp("o_totalprice") / 100).alias("y"), F.max("o_totalprice").alias("z"))


ALPHAS = [0.1, 1.0, 10.0, 100.0, 1000.0]
NATION = "nf AS (SELECT c_nationkey AS subject, avg(c_acctbal) AS a, avg(o_totalprice) AS b, avg(CAST(o_orderstatus = 'F' AS INTEGER)) AS c, avg(c_acctbal) * 2 + stddev_samp(o_totalprice) / 100 AS y, max(o_totalprice) AS z FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)"


@register("m9_nested_loso")
def m9(spark, d):
    return models.nested_loso(nation_features(spark, d), "subject", ["a", "b", "c"], "y", ALPHAS)


@register("m10_model_ladder")
def m10(spark, d):
    return models.model_ladder(nation_features(spark, d), "subject", {"features": (["a", "b", "c"], "y"), "confound_only": (["c"], "y"), "other_target": (["a", "b"], "z")}, ALPHAS)


@register("m11_permutation_null")
def m11(spark, d):
    return models.null_summary(models.permutation_null(nation_features(spark, d), "subject", ["a", "b", "c"], "y", ALPHAS, 200, 1))


#: Subject rows drawn with replacement, the same draws as in Spark.
BOOT = "pos AS (SELECT *, row_number() OVER (ORDER BY subject) - 1 AS i, count(*) OVER () AS n FROM {table}), dr AS (SELECT rep, k, ('0x' || substr(sha256(concat_ws(':', 3, rep, k)), 1, 8))::BIGINT % n AS i FROM (SELECT unnest(range(0, 300)) AS rep), (SELECT i AS k, n FROM pos)), bt AS (SELECT rep, pos.* FROM dr JOIN pos USING (i))"


@register("m12_bootstrap_scores", ", v AS (SELECT rep, 1 - sum((y - 2 * a) ** 2) / sum((y - z / 100) ** 2) AS q FROM bt GROUP BY 1) SELECT count(*) AS b, avg(q) AS mean, quantile_cont(q, 0.025) AS lower, quantile_cont(q, 0.975) AS upper FROM v", NATION, BOOT.format(table="nf"), rnd="mean lower upper")
def m12(spark, d):
    f = nation_features(spark, d).select("subject", "y", (F.col("a") * 2).alias("pred"), (F.col("z") / 100).alias("m0"))
    return models.interval(models.bootstrap_statistic(f, "subject", ["y", "pred", "m0"], models.q2_of("y", "pred", "m0"), 300, 3))


@register(
    "m12_score_intervals",
    """, pp AS (SELECT rep, y, 2 * a AS p, z / 100 AS m FROM bt),
    rk AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY y) + (count(*) OVER (PARTITION BY rep, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY rep ORDER BY p) + (count(*) OVER (PARTITION BY rep, p) - 1) / 2.0 AS rp FROM pp),
    v AS (SELECT 'q2' AS score, rep, 1 - sum((y - p) ** 2) / sum((y - m) ** 2) AS q FROM pp GROUP BY 2 UNION ALL SELECT 'mae_skill', rep, 1 - sum(abs(y - p)) / sum(abs(y - m)) FROM pp GROUP BY 2
    UNION ALL SELECT 'rho', rep, corr(ry, rp) FROM rk GROUP BY 2)
    SELECT score, count(*) AS b, avg(q) AS mean, quantile_cont(q, 0.025) AS lower, quantile_cont(q, 0.975) AS upper FROM v GROUP BY 1""",
    NATION,
    BOOT.format(table="nf"),
    rnd="mean lower upper",
)
def m12_scores(spark, d):
    f = nation_features(spark, d).select("subject", "y", (F.col("a") * 2).alias("pred"), (F.col("z") / 100).alias("m0"))
    return models.score_intervals(f, "subject", "y", "pred", "m0", 300, 3)


@register("m12_tree_bootstrap")
def m12_tree(spark, d):
    """Q2 and skill of a prediction of line prices over all order lines, without a shuffle of rows times replicates."""
    li = read(spark, d, "lineitem")
    f = li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("pred"), F.lit(38000.0).alias("m0"))
    boot = resampling.scores_of(resampling.bootstrap_sums(f, ["l_orderkey", "l_linenumber"], resampling.score_sums("y", "pred", "m0"), 200, 3))
    one = lambda c: models.interval(boot.select("replicate", F.col(c).alias("value"))).select(F.lit(c).alias("score"), "b", "mean", "lower", "upper")
    return one("q2").unionByName(one("mae_skill"))


@register(
    "m13_paired_bootstrap_ci",
    """, v AS (SELECT rep, avg(delta_b) AS q FROM bt GROUP BY 1),
    c AS (SELECT count(*) AS b, avg(q) AS mean, quantile_cont(q, 0.025) AS lower, quantile_cont(q, 0.975) AS upper FROM v)
    SELECT *, CASE WHEN upper < 0 THEN 'lower' WHEN lower > 0 THEN 'higher' ELSE 'none' END AS reliable FROM c""",
    METRICS,
    DELTAS,
    BOOT.format(table="deltas"),
    rnd="mean lower upper",
)
def m13(spark, d):
    return models.paired_bootstrap_ci(deltas(spark, d), "subject", "delta_b", 300, 3)


#: Trials resampled within sessions, the same draws as in Spark; stat is a session's statistic, ratio the target of its two values.
TRIAL_BOOT = """tp AS (SELECT *, row_number() OVER (PARTITION BY subject, session ORDER BY rt) - 1 AS i FROM trials WHERE rt > 0),
    sz AS (SELECT subject, session, count(*) AS n, {stat} AS m FROM tp GROUP BY ALL),
    two AS (SELECT subject, max(n) FILTER (session = 'baseline') AS n_base, max(n) FILTER (session = 'perturbation') AS n_pert, {ratio} AS y
    FROM sz GROUP BY 1 HAVING n_base > 1 AND n_pert > 1),
    dr AS (SELECT subject, session, rep, ('0x' || substr(sha256(concat_ws(':', 5, subject, session, rep, k)), 1, 8))::BIGINT % n AS i
    FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, unnest(range(0, 500)) AS rep FROM sz JOIN (SELECT subject FROM two) USING (subject)))),
    md AS (SELECT subject, session, rep, {stat} AS m FROM dr JOIN tp USING (subject, session, i) GROUP BY ALL),
    ra AS (SELECT subject, rep, {ratio} AS v FROM md GROUP BY ALL),
    boot AS (SELECT subject, n_base, n_pert, y, stddev_samp(v) AS se, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper
    FROM two JOIN ra USING (subject) GROUP BY ALL)"""
UP = "ln(max(m) FILTER (session = 'perturbation') / max(m) FILTER (session = 'baseline'))"
DOWN = "ln(max(m) FILTER (session = 'baseline') / max(m) FILTER (session = 'perturbation'))"


@register("m14_trial_bootstrap", "SELECT * FROM boot", base.TRIALS, TRIAL_BOOT.format(stat="median(rt)", ratio=UP), rnd="y se lower upper")
def m14(spark, d):
    return models.trial_bootstrap(base.trials(spark, d), "subject", "baseline", "perturbation", 500, 5)


@register("m14_speed_bootstrap", "SELECT * FROM boot", base.TRIALS, TRIAL_BOOT.format(stat="avg(1 / rt)", ratio=DOWN), rnd="y se lower upper")
def m14_speed(spark, d):
    return models.trial_bootstrap(base.trials(spark, d), "subject", "baseline", "perturbation", 500, 5, "speed")


@register(
    "m14_cohort_summary",
    "SELECT count(*) AS n, avg(se) AS mean_se, stddev_samp(y) AS sd_y, avg(se) / stddev_samp(y) AS se_over_sd, avg(CAST(lower > 0 OR upper < 0 AS INTEGER)) AS share_apart FROM boot",
    base.TRIALS,
    TRIAL_BOOT.format(stat="avg(1 / rt)", ratio=DOWN),
    rnd="mean_se sd_y se_over_sd share_apart",
)
def m14_cohort(spark, d):
    return models.cohort_reliability(m14_speed(spark, d))


@register(
    "m15_correlation_bootstrap",
    """, r AS (SELECT rep, rank() OVER (PARTITION BY rep
    ORDER BY a) + (count(*) OVER (PARTITION BY rep, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY rep
    ORDER BY z) + (count(*) OVER (PARTITION BY rep, z) - 1) / 2.0 AS rz FROM bt),
    v AS (SELECT rep, corr(ra, rz) AS q FROM r
    GROUP BY 1) SELECT count(*) AS b, avg(q) AS mean, quantile_cont(q, 0.025) AS lower, quantile_cont(q, 0.975) AS upper FROM v""",
    NATION,
    BOOT.format(table="nf"),
    rnd="mean lower upper",
)
def m15(spark, d):
    return models.interval(models.bootstrap_rank_correlation(nation_features(spark, d), "subject", "a", "z", 300, 3))


@register(
    "m16_moving_block_bootstrap",
    """WITH r AS (SELECT user_id AS key, event_id, value AS x FROM events WHERE value IS NOT NULL),
    sz AS (SELECT key, count(*) AS n, avg(x) AS mean, least(6, count(*)) AS block FROM r GROUP BY 1),
    pl AS (SELECT key, n, block, x, row_number() OVER w - 1 AS i, sum(x) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s
    FROM r JOIN sz USING (key) WINDOW w AS (PARTITION BY key ORDER BY event_id)),
    va AS (SELECT key, 0 AS kind, i, s AS v FROM pl WHERE i <= n - block UNION ALL SELECT key, 1, i, x FROM pl),
    ask AS (SELECT key, block, 0 AS kind, CAST(ceil(n / block) AS BIGINT) AS draws, n - block + 1 AS places FROM sz UNION ALL SELECT key, 1, 1, n, n FROM sz),
    dr AS (SELECT key, kind, block, draws, rep, ('0x' || substr(sha256(concat_ws(':', 9, kind, key, rep, k)), 1, 8))::BIGINT % places AS i
    FROM (SELECT *, unnest(range(0, draws)) AS k FROM (SELECT *, unnest(range(0, 300)) AS rep FROM ask))),
    me AS (SELECT key, kind, rep, sum(v) / max(draws) / max(block) AS m FROM dr JOIN va USING (key, kind, i) GROUP BY ALL),
    en AS (SELECT key, kind, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM me GROUP BY ALL),
    wi AS (SELECT key, max(lo) FILTER (kind = 0) AS lower, max(hi) FILTER (kind = 0) AS upper, max(lo) FILTER (kind = 1) AS iid_lower, max(hi) FILTER (kind = 1) AS iid_upper
    FROM en GROUP BY 1)
    SELECT key, n, CAST(block AS INTEGER) AS block, mean, lower, upper, iid_lower, iid_upper, CASE WHEN iid_upper > iid_lower THEN (upper - lower) / (iid_upper - iid_lower) END AS width_ratio
    FROM sz JOIN wi USING (key)""",
    rnd="mean lower upper iid_lower iid_upper width_ratio",
)
def m16(spark, d):
    return models.moving_block_bootstrap(read(spark, d, "events"), "user_id", "event_id", "value", 6, 300, 9)


@register(
    "m16_block_rule_bootstrap",
    """WITH r AS (SELECT user_id AS key, event_id, value AS x FROM events WHERE value IS NOT NULL),
    gp AS (SELECT user_id AS key, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events),
    bl AS (SELECT key, greatest(coalesce(ceil(2 * median(g) / 14400), 1), 1) AS b FROM gp GROUP BY 1),
    sz AS (SELECT key, count(*) AS n, avg(x) AS mean, least(any_value(b), count(*))::BIGINT AS block FROM r JOIN bl USING (key) GROUP BY 1),
    pi AS (SELECT key, n, block, x, row_number() OVER (PARTITION BY key ORDER BY event_id) - 1 AS i FROM r JOIN sz USING (key)),
    pl AS (SELECT key, n, block, x, i, (SELECT sum(q.x) FROM pi q WHERE q.key = pi.key AND q.i BETWEEN pi.i AND pi.i + pi.block - 1) AS s FROM pi),
    va AS (SELECT key, 0 AS kind, i, s AS v FROM pl WHERE i <= n - block UNION ALL SELECT key, 1, i, x FROM pl),
    ask AS (SELECT key, block, 0 AS kind, CAST(ceil(n / block) AS BIGINT) AS draws, n - block + 1 AS places FROM sz UNION ALL SELECT key, 1, 1, n, n FROM sz),
    dr AS (SELECT key, kind, block, draws, rep, ('0x' || substr(sha256(concat_ws(':', 9, kind, key, rep, k)), 1, 8))::BIGINT % places AS i
    FROM (SELECT *, unnest(range(0, draws)) AS k FROM (SELECT *, unnest(range(0, 300)) AS rep FROM ask))),
    me AS (SELECT key, kind, rep, sum(v) / max(draws) / max(block) AS m FROM dr JOIN va USING (key, kind, i) GROUP BY ALL),
    en AS (SELECT key, kind, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM me GROUP BY ALL),
    wi AS (SELECT key, max(lo) FILTER (kind = 0) AS lower, max(hi) FILTER (kind = 0) AS upper, max(lo) FILTER (kind = 1) AS iid_lower, max(hi) FILTER (kind = 1) AS iid_upper
    FROM en GROUP BY 1)
    SELECT key, n, CAST(block AS INTEGER) AS block, mean, lower, upper, iid_lower, iid_upper, CASE WHEN iid_upper > iid_lower THEN (upper - lower) / (iid_upper - iid_lower) END AS width_ratio
    FROM sz JOIN wi USING (key)""",
    rnd="mean lower upper iid_lower iid_upper width_ratio",
)
def m16_rule(spark, d):
    """Blocks of twice a user's median interval between events, in quanta of four hours."""
    ev = read(spark, d, "events")
    lengths = models.block_lengths(ev.select("user_id", base.seconds(F.col("ts")).alias("t")), "user_id", "t", 14400)
    return models.moving_block_bootstrap(ev, "user_id", "event_id", "value", lengths, 300, 9)


def blocked(spark, d):
    s = win.assign_blocks(user_series(spark, d), ["user_id"], "t", GAP)
    return s.withColumn("block", F.col("block") % 6)


@register("m17_blockwise_iaaft")
def m17(spark, d):
    return models.blockwise_iaaft(blocked(spark, d), ["user_id", "block"], "event_id", "s", 2, 4)


def fold_columns():
    k = F.col("k").cast("double")
    return k.alias("x1"), (k * k / 100).alias("x2"), F.sin(k).alias("x3"), (F.col("t") / 86400 - 19723).alias("x4")


def fold_table(spark, d):
    """A user's series with four columns to predict the value from."""
    return blocked(spark, d).select("user_id", "block", *fold_columns(), F.col("s").alias("y"))


@register("m18_block_cv_pca_ols")
def m18(spark, d):
    return models.block_cv_pca_ols(fold_table(spark, d), "user_id", ["x1", "x2", "x3", "x4"], "y")


@register("m19_floating_forward_selection")
def m19(spark, d):
    return models.floating_forward_selection(fold_table(spark, d), "user_id", ["x1", "x2", "x3", "x4"], "y", 3)


@register("m19_surrogate_null")
def m19_null(spark, d):
    """Column selection on the series and on three sets of surrogates, by participant and for the cohort; units are stored and resumed."""
    series = blocked(spark, d).select("user_id", "block", "event_id", *fold_columns(), F.col("s").alias("y"))
    units = resampling.surrogate_null(series, "user_id", "event_id", ["x1", "x2", "x3", "x4"], "y", 3, 3, 4, scratch(spark, "surrogate-null"), 2)
    return resampling.surrogate_summary(units)


@register(
    "m20_finite_sample_dispersion",
    """WITH p AS (SELECT value AS x, row_number() OVER (ORDER BY sha256(concat_ws(':', 2, event_id)), event_id) - 1 AS i FROM events WHERE value IS NOT NULL),
    s AS (SELECT stddev_samp(x) AS sigma FROM p),
    g AS (SELECT k, i // k AS g, stddev_samp(x) AS sd, count(*) AS n FROM p, (SELECT unnest([4, 8, 15, 30, 60]) AS k) GROUP BY 1, 2)
    SELECT k, count(*) AS n, avg(sd) - max(sigma) AS bias, stddev_samp(sd) AS spread, max(sigma) / sqrt(2.0 * (k - 1)) AS analytic FROM g, s WHERE n = k GROUP BY k""",
    rnd="bias spread analytic",
)
def m20(spark, d):
    """Groups of event values, dealt by a hash order."""
    return models.finite_sample_dispersion(read(spark, d, "events"), "event_id", "value", [4, 8, 15, 30, 60], 2)


@register(
    "m21_collapse_verdict",
    """, x AS (SELECT subject % 5 AS cohort, avg(delta_b) AS mean, avg(CAST(delta_b < 0 AS INTEGER)) AS harmed, max(source) AS top FROM deltas GROUP BY 1)
    SELECT cohort, mean, harmed, mean < -0.005 AS is_degraded, top > 0.75 AS is_concentrated, mean < -0.005 AND top > 0.75 AS is_collapsed,
    CASE WHEN mean < -0.005 AND top > 0.75 THEN 'collapse' WHEN mean < -0.005 THEN 'degraded' WHEN top > 0.75 THEN 'concentrated' WHEN harmed >= 0.4 THEN 'heterogeneous' ELSE 'none' END AS verdict
    FROM x""",
    METRICS,
    DELTAS,
    rnd="mean harmed",
)
def m21(spark, d):
    x = deltas(spark, d).groupBy((F.col("subject") % 5).alias("cohort")).agg(F.avg("delta_b").alias("mean"), F.avg((F.col("delta_b") < 0).cast("int")).alias("harmed"), F.max("source").alias("top"))
    return models.collapse_verdict(x, F.col("mean") < -0.005, F.col("top") > 0.75, F.col("harmed"), 0.4).drop("top")


@register(
    "m22_eligibility_verdict",
    """WITH u AS (SELECT event_type AS family, 'enough' AS criterion, count(*) > 1990 AS ok FROM events GROUP BY 1
    UNION ALL SELECT event_type, 'level', avg(value) < 50 FROM events GROUP BY 1
    UNION ALL SELECT event_type, 'spread', stddev_samp(value) > 49 FROM events GROUP BY 1)
    SELECT family, count(*) AS n_criteria, bool_and(ok) AS eligible, coalesce(string_agg(criterion, ';'
    ORDER BY criterion) FILTER (NOT ok), '') AS failing FROM u GROUP BY 1""",
)
def m22(spark, d):
    s = read(spark, d, "events").groupBy(F.col("event_type").alias("family")).agg((F.count("*") > 1990).alias("enough"), (F.avg("value") < 50).alias("level"), (F.stddev_samp("value") > 49).alias("spread"))
    return models.eligibility_verdict(s.unpivot(["family"], ["enough", "level", "spread"], "criterion", "ok"), ["family"], "ok")


@register(
    "m23_normalization_shift",
    """WITH src AS (SELECT l_linenumber AS c, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    tg AS (SELECT l_suppkey, l_linenumber AS c, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
    SELECT l_suppkey, avg(abs(tg.m - src.m) / nullif(src.s, 0)) AS mean_shift, avg(abs(ln(nullif(tg.s, 0)) - ln(nullif(src.s, 0)))) AS log_sd_shift
    FROM tg JOIN src USING (c) GROUP BY 1""",
    rnd="mean_shift log_sd_shift",
)
def m23(spark, d):
    li = read(spark, d, "lineitem").withColumn("c", F.col("l_linenumber"))
    stats = lambda df, *k: df.groupBy(*k, "c").agg(F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("sd"))
    return models.normalization_shift(stats(li.where("l_linestatus = 'O'"), "l_suppkey"), stats(li.where("l_linestatus = 'F'")), ["l_suppkey"], "c")


@register(
    "m23_shift_against_change",
    """WITH src AS (SELECT l_linenumber AS c, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    tg AS (SELECT l_suppkey, l_linenumber AS c, avg(l_extendedprice) AS m FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
    sh AS (SELECT l_suppkey, avg(abs(tg.m - src.m) / nullif(src.s, 0)) AS x FROM tg JOIN src USING (c) GROUP BY 1),
    ch AS (SELECT l_suppkey, avg(l_discount) FILTER (l_linestatus = 'O') - avg(l_discount) FILTER (l_linestatus = 'F') AS y FROM lineitem GROUP BY 1),
    j AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM sh JOIN ch USING (l_suppkey) WHERE x IS NOT NULL AND y IS NOT NULL)
    SELECT count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS rho, regr_slope(y, x) AS slope FROM j""",
    rnd="r rho slope",
)
def m23_change(spark, d):
    """The shift of a supplier's prices against the change of its discounts."""
    of = lambda status: F.avg(F.when(F.col("l_linestatus") == status, F.col("l_discount")))
    change = read(spark, d, "lineitem").groupBy("l_suppkey").agg((of("O") - of("F")).alias("change"))
    return models.shift_against_change(m23(spark, d), change, ["l_suppkey"], "mean_shift", "change")


@register(
    "m25_grouped_grid_search",
    "WITH "
    + ", ".join(
        f"s{i} AS (SELECT l_returnflag AS g, avg(l_quantity) AS mx, avg(l_tax) AS my, covar_pop(l_quantity, l_tax) * count(*) / (var_pop(l_quantity) * count(*) + {a}) AS b FROM lineitem WHERE l_orderkey % 4 > 0 GROUP BY 1), e{i} AS (SELECT g, {a} AS alpha, round(avg((l_tax - my - b * (l_quantity - mx)) ** 2), 9) AS mse FROM lineitem JOIN s{i} ON g = l_returnflag WHERE l_orderkey % 4 = 0 GROUP BY 1)"
        for i, a in enumerate((1.0, 1e6, 1e9))
    )
    + ", u AS (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) SELECT g, CAST((min(struct_pack(m := mse, a := alpha))).a AS DOUBLE) AS alpha, min(mse) AS mse FROM u GROUP BY 1",
)
def m25(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.when(F.col("l_orderkey") % 4 == 0, "validation").otherwise("train").alias("role"), "l_quantity", "l_tax")
    return models.grouped_grid_search(li, ["g"], "role", ["l_quantity"], "l_tax", [1.0, 1e6, 1e9])


@register(
    "a39_fold_invariants",
    "SELECT user_id, count(DISTINCT block) AS n_blocks, count(DISTINCT block) FILTER (c > 1) AS n_tested, CAST(0 AS BIGINT) AS strangers, count(DISTINCT block) = count(DISTINCT block) FILTER (c > 1) AS complete FROM (SELECT user_id, block, count(*) OVER (PARTITION BY user_id, block) AS c FROM bk) GROUP BY 1",
    EVENTS,
    USER,
    BLOCKS,
)
def a39(spark, d):
    b = win.assign_blocks(user_series(spark, d), ["user_id"], "t", GAP)
    tested = b.groupBy("user_id", "block").agg(F.count("*").alias("c")).where("c > 1")
    return models.fold_invariants(tested, b, ["user_id"])



