"""Cleaning, scalar functions, sorts, sets and reshapes on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwave.functions import scalar
from cohortwave.operators import clean, geometry, shape
from cohortwave.plans import base
from cohortwave.plans.base import BANDS, CHANNELS, EVENTS, TRIALS, r6, read, register

RAW = "raw AS (SELECT event_type, user_id, CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'signup' THEN concat('x', CAST(value AS VARCHAR)) WHEN event_id % 7 = 0 THEN ' NaN ' ELSE concat(' ', CAST(value AS VARCHAR)) END AS txt FROM events)"


def raw_text(spark, d):
    c = F.col
    text = F.when(c("event_type") == "error", "n/a").when(c("event_type") == "signup", F.concat(F.lit("x"), c("value").cast("string"))).when(c("event_id") % 7 == 0, " NaN ").otherwise(F.concat(F.lit(" "), c("value").cast("string")))
    return read(spark, d, "events").select("event_type", "user_id", text.alias("txt"))


@register(
    "p1_parse_numeric",
    """, s AS (SELECT event_type, lower(trim(txt)) IN ('', 'n/a', 'na', 'nan', 'none') AS missing, try_cast(trim(txt) AS DOUBLE) AS v FROM raw)
    SELECT event_type, count(*) AS n_rows, count(*) FILTER (missing) AS n_missing, count(*) FILTER (NOT missing AND coalesce(NOT isfinite(v), true)) AS n_invalid,
           count(*) FILTER (NOT missing AND isfinite(v)) AS n_numeric FROM s GROUP BY 1""",
    RAW,
)
def p1(spark, d):
    return clean.numeric_audit(raw_text(spark, d), ["event_type"], "txt")


@register(
    "p2_filter_rt_window",
    """SELECT subject, session, count(*) AS n_trials, count(*) FILTER (rt IS NULL) AS n_missing, count(*) FILTER (rt < 5) AS n_fast, count(*) FILTER (rt > 200) AS n_slow,
    count(*) FILTER (rt BETWEEN 5 AND 200) AS n_valid FROM trials GROUP BY 1, 2""",
    TRIALS,
)
def p2(spark, d):
    return clean.rt_audit(base.trials(spark, d), ["subject", "session"], 5, 200)


RULES = [("MACHINERY|BUILDING", "closed"), ("FURN", "explicit_open"), ("HOLD", "implicit_open")]


@register(
    "p3_classify_tokens",
    """SELECT CASE WHEN regexp_matches(c_mktsegment, 'MACHINERY|BUILDING') THEN 'closed' WHEN c_mktsegment LIKE '%FURN%' THEN 'explicit_open' WHEN c_mktsegment LIKE '%HOLD%' THEN 'implicit_open'
    ELSE 'no_evidence' END AS verdict, count(*) AS n FROM customer GROUP BY 1""",
)
def p3(spark, d):
    return read(spark, d, "customer").select(clean.classify_tokens(F.col("c_mktsegment"), RULES, "no_evidence").alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


FIELDS = {"lang": 'lang="([a-z]+)"', "advert": "<!-- ad ([0-9]+) -->", "title": "<title>([^<]*)</title>", "canonical": 'rel="canonical" href="([^"]*)"'}


@register(
    "p4_extract_history_fields",
    """SELECT page_id, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(html, '<!-- ad ([0-9]+) -->', 1), '') AS advert,
    nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, 'rel="canonical" href="([^"]*)"', 1), '') AS canonical
    FROM pages""",
)
def p4(spark, d):
    return clean.extract_fields(read(spark, d, "pages"), "html", FIELDS, "page_id")


@register(
    "p5_epoch_qc",
    """q AS (SELECT label, vec_id, list_max(x) AS mx, list_min(x) AS mn, sqrt(list_avg(list_transform(x, lambda v: v * v)) - list_avg(x) ** 2) AS sd
        FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)),
    w AS (SELECT label, vec_id // 4 AS epoch, max(greatest(mx, -mn)) AS a, max(mx - mn) AS p, min(sd) AS s FROM q GROUP BY 1, 2),
    v AS (SELECT *, concat_ws(';', CASE WHEN a > 0.35 THEN 'amplitude' END, CASE WHEN p > 0.6 THEN 'peak_to_peak' END, CASE WHEN s < 0.12 THEN 'flat' END) AS reasons
    FROM w)
    SELECT label, epoch, round(a, 6) AS max_abs, round(p, 6) AS max_ptp, round(s, 6) AS min_std, reasons, reasons = '' AS qc_pass
    FROM v""".replace("q AS", "WITH q AS", 1),
)
def p5(spark, d):
    e = read(spark, d, "embeddings").select("label", F.floor(F.col("vec_id") / 4).alias("epoch"), F.col("embedding").alias("samples"))
    return clean.epoch_qc(e, ["label", "epoch"], 0.35, 0.6, 0.12).select("label", "epoch", r6("max_abs").alias("max_abs"), r6("max_ptp").alias("max_ptp"), r6("min_std").alias("min_std"), "reasons", "qc_pass")


@register(
    "p6_flag_boundary_crossing",
    """, spans AS (SELECT user_id, CAST(floor(t / 43200) * 43200 AS DOUBLE) AS lo, CAST(floor(t / 43200) * 43200 + 43200 AS DOUBLE) AS hi FROM ev GROUP BY ALL),
    marks AS (SELECT user_id, t AS m FROM ev WHERE event_type = 'error')
    SELECT user_id, lo, hi, EXISTS (SELECT 1 FROM marks WHERE marks.user_id = spans.user_id AND m > lo AND m <= hi) AS crossed FROM spans""",
    EVENTS,
)
def p6(spark, d):
    ev = base.events(spark, d)
    lo = (F.floor(F.col("t") / 43200) * 43200).cast("double")
    return clean.flag_boundary_crossing(ev.select("user_id", lo.alias("lo"), (lo + 43200).alias("hi")).distinct(), ev.where("event_type = 'error'").select("user_id", F.col("t").alias("at")), ["user_id"])


@register(
    "p7_cut_segments",
    """SELECT vec_id, CAST(20 * i AS INTEGER) AS start_sample, CAST(20 * i + 20 AS INTEGER) AS stop_sample, printf('v%d_e%04d_s%06d', label, vec_id, 20 * i) AS segment_id,
    round(list_sum(CAST(embedding[20 * i + 1:20 * i + 20] AS DOUBLE[])), 6) AS total FROM (SELECT *, unnest(range(0, len(embedding) // 20)) AS i FROM embeddings)""",
)
def p7(spark, d):
    cut = clean.cut_segments(read(spark, d, "embeddings"), 20, F.concat(F.lit("v"), F.col("label")), [], "vec_id", "embedding")
    return cut.select("vec_id", "start_sample", "stop_sample", "segment_id", r6(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double"))).alias("total"))


@register(
    "p8_reorder_channels",
    """SELECT subject, epoch, max(round(alpha, 6)) FILTER (channel = 3) AS c3, max(round(alpha, 6)) FILTER (channel = 1) AS c1, max(round(alpha, 6)) FILTER (channel = 7) AS c7, count(*) - count(DISTINCT channel) AS n_duplicates
    FROM (SELECT subject, epoch, channel, sum(alpha) AS alpha FROM bands GROUP BY ALL) GROUP BY 1, 2""",
    BANDS,
)
def p8(spark, d):
    b = base.bands(spark, d).groupBy("subject", "epoch", "channel").agg(F.sum("alpha").alias("value"))
    v = clean.reorder_channels(b, ["subject", "epoch"], ["3", "1", "7"])
    return v.select("subject", "epoch", *[r6(F.get("values", F.lit(i))).alias(f"c{n}") for i, n in enumerate((3, 1, 7))], "n_duplicates")


@register("p9_assign_region", "SELECT n_name AS nation, r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def p9(spark, d):
    regions = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("channel"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return clean.assign_region(read(spark, d, "customer").select(F.col("c_nationkey").alias("channel")), regions).groupBy("nation", "region").agg(F.count("*").alias("n"))


@register(
    "p9_validate_partition",
    """SELECT 'unmapped' AS problem, l_suppkey AS channel FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000) GROUP BY ALL
    UNION ALL SELECT 'missing', s_suppkey FROM supplier WHERE s_acctbal > 1000 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)
    UNION ALL SELECT 'duplicate', s_suppkey FROM supplier WHERE s_acctbal > 1000 GROUP BY 2 HAVING count(*) > 1""",
)
def p9b(spark, d):
    regions = read(spark, d, "supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").alias("channel"), F.col("s_nationkey").alias("region"))
    return clean.validate_partition(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("channel")), regions)


@register(
    "p10_visit_rank",
    """SELECT o_custkey AS subject, o_orderstatus AS session, CASE WHEN o_orderstatus = split_part(so, '->', 1) THEN 0 WHEN o_orderstatus = split_part(so, '->', 2) THEN 1 END AS visit, count(*) AS n
    FROM orders JOIN (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'O->F' ELSE 'F->O' END AS so FROM customer) ON o_custkey = c_custkey GROUP BY ALL""",
)
def p10(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("session"))
    meta = read(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.when(F.col("c_nationkey") % 2 == 0, "O->F").otherwise("F->O").alias("session_order"))
    return clean.visit_rank(orders, meta).groupBy("subject", "session", "visit").agg(F.count("*").alias("n"))


CLOCKS = "clk AS (SELECT event_id, strftime(ts, '%H:%M:%S') AS a, CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE strftime(ts + to_microseconds(CAST(value * 600000000 AS BIGINT)), '%H:%M:%S') END AS b FROM events)"


@register(
    "p11_clock_delta",
    """, m AS (SELECT event_id, a, b, epoch(try_cast(b AS TIME) - CAST('00:00:00' AS TIME)) / 60 AS mb, epoch(CAST(a AS TIME) - CAST('00:00:00' AS TIME)) / 60 AS ma
    FROM clk)
    SELECT event_id, a, b, round(CASE WHEN mb - ma > 720 THEN mb - ma - 1440 WHEN mb - ma <= -720 THEN mb - ma + 1440 ELSE mb - ma END, 6) AS delta
    FROM m""".replace("epoch(try_cast(b AS TIME) - CAST('00:00:00' AS TIME))", "(CAST(try_cast(substr(b, 1, 2) AS INTEGER) * 3600 + try_cast(substr(b, 4, 2) AS INTEGER) * 60 + try_cast(substr(b, 7, 2) AS INTEGER) AS DOUBLE))").replace("epoch(CAST(a AS TIME) - CAST('00:00:00' AS TIME))", "(CAST(CAST(substr(a, 1, 2) AS INTEGER) * 3600 + CAST(substr(a, 4, 2) AS INTEGER) * 60 + CAST(substr(a, 7, 2) AS INTEGER) AS DOUBLE))"),
    CLOCKS,
)
def p11(spark, d):
    later = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 600000000).cast("long"))
    clk = read(spark, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("a"), F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.date_format(later, "HH:mm:ss")).alias("b"))
    return clk.withColumn("delta", r6(scalar.clock_delta(F.col("a"), F.col("b"))))


@register("p12_cap_per_group", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def p12(spark, d):
    return clean.cap_per_group(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], 3).select("user_id", "event_type", "event_id")


@register(
    "p13_trim_constant_ends",
    """, s AS (SELECT user_id, event_id, t, CAST(value < 100 AS INTEGER) AS x, CAST(k < 90 AS INTEGER) AS y FROM ev),
    c AS (SELECT *, x <> lag(x) OVER w AS cx, y <> lag(y) OVER w AS cy FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    b AS (SELECT user_id, greatest(min(event_id) FILTER (cx), min(event_id) FILTER (cy)) AS lo, least(max(event_id) FILTER (cx), max(event_id) FILTER (cy)) AS hi
    FROM c GROUP BY 1)
    SELECT user_id, count(*) AS n, min(event_id) AS first_sample, max(event_id) AS last_sample FROM s JOIN b USING (user_id)
    WHERE event_id BETWEEN lo AND hi GROUP BY 1""",
    EVENTS,
)
def p13(spark, d):
    s = base.events(spark, d).select("user_id", "event_id", (F.col("value") < 100).cast("int").alias("x"), (F.col("k") < 90).cast("int").alias("y"))
    return clean.trim_constant_ends(s, "user_id", "event_id", ["x", "y"]).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_sample"), F.max("event_id").alias("last_sample"))


@register(
    "p15_far_outliers",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT event_type, event_id, user_id, value FROM events JOIN q USING (event_type) WHERE value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)""",
)
def p15(spark, d):
    return clean.far_outliers(read(spark, d, "events"), ["event_type"], "value").select("event_type", "event_id", "user_id", "value")


@register(
    "p16_sensitivity_filters",
    """, c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1),
    r AS (SELECT 'both' AS rule, user_id, v > 0 AND c > 0 AS keep FROM c UNION ALL SELECT 'ten_each', user_id, v >= 10 AND c >= 10 FROM c
    UNION ALL SELECT 'more_clicks', user_id, c > v FROM c)
    SELECT rule, count(*) FILTER (keep) AS n_kept, count(*) FILTER (NOT keep) AS n_removed, min(user_id) FILTER (NOT keep) AS first_removed FROM r GROUP BY 1""",
    EVENTS,
)
def p16(spark, d):
    c = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("event_type") == "click").alias("c"))
    return clean.sensitivity_filters(c, "user_id", {"both": (F.col("v") > 0) & (F.col("c") > 0), "ten_each": (F.col("v") >= 10) & (F.col("c") >= 10), "more_clicks": F.col("c") > F.col("v")})


@register(
    "p17_drop_nonfinite",
    """WITH x AS (SELECT l_suppkey, l_extendedprice / nullif(l_discount, 0) AS v
    FROM lineitem) SELECT l_suppkey, count(*) AS n, count(v) AS n_finite, round(avg(v), 4) AS mean FROM x GROUP BY 1""",
)
def p17(spark, d):
    x = read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") / F.nullif("l_discount", F.lit(0.0))).alias("v"))
    return clean.drop_nonfinite(x, ["v"]).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count("v").alias("n_finite"), F.round(F.avg("v"), 4).alias("mean"))


MONTAGE = "m AS (SELECT s_name AS name, 1 + s_suppkey % 7 AS x, s_nationkey - 12.5 AS y, s_acctbal / 1000 AS z FROM supplier), tp AS (SELECT n_name AS name, 1 + n_nationkey % 5 AS x, n_nationkey - 11.5 AS y, n_regionkey + 0.5 AS z FROM nation)"


@register(
    "p18_nearest_channel",
    """, d AS (SELECT m.name, tp.name AS nearest, sqrt((m.x / sqrt(m.x ** 2 + m.y ** 2 + m.z ** 2) - tp.x / sqrt(tp.x ** 2 + tp.y ** 2 + tp.z ** 2)) ** 2 + (m.y / sqrt(m.x ** 2 + m.y ** 2 + m.z ** 2) - tp.y / sqrt(tp.x ** 2 + tp.y ** 2 + tp.z ** 2)) ** 2
     + (m.z / sqrt(m.x ** 2 + m.y ** 2 + m.z ** 2) - tp.z / sqrt(tp.x ** 2 + tp.y ** 2 + tp.z ** 2)) ** 2) AS dist FROM m, tp)
    SELECT name, arg_min(nearest, dist) AS nearest, round(min(dist), 6) AS distance FROM d GROUP BY 1""",
    MONTAGE,
)
def p18(spark, d):
    return named_positions(spark, d).withColumn("distance", r6("distance"))


def named_positions(spark, d):
    c = F.col
    m = read(spark, d, "supplier").select(c("s_name").alias("name"), (1 + c("s_suppkey") % 7).alias("x"), (c("s_nationkey") - 12.5).alias("y"), (c("s_acctbal") / 1000).alias("z"))
    t = read(spark, d, "nation").select(c("n_name").alias("name"), (1 + c("n_nationkey") % 5).alias("x"), (c("n_nationkey") - 11.5).alias("y"), (c("n_regionkey") + 0.5).alias("z"))
    return clean.nearest_channel(m, t)


@register(
    "p18_one_to_one_check",
    """, u AS (SELECT m.name, tp.name AS nearest, sqrt((m.x / sqrt(m.x ** 2 + m.y ** 2 + m.z ** 2) - tp.x / sqrt(tp.x ** 2 + tp.y ** 2 + tp.z ** 2)) ** 2
     + (m.y / sqrt(m.x ** 2 + m.y ** 2 + m.z ** 2) - tp.y / sqrt(tp.x ** 2 + tp.y ** 2 + tp.z ** 2)) ** 2 + (m.z / sqrt(m.x ** 2 + m.y ** 2 + m.z ** 2) - tp.z / sqrt(tp.x ** 2 + tp.y ** 2 + tp.z ** 2)) ** 2) AS dist FROM m, tp),
    b AS (SELECT name, arg_min(nearest, dist) AS nearest, min(dist) AS distance FROM u GROUP BY 1),
    k AS (SELECT nearest, count(*) AS n, max(distance) AS far FROM b GROUP BY 1)
    SELECT sum(n)::BIGINT AS n_positions, count(*) AS n_names, count(*) FILTER (n > 1) AS n_shared, max(n) AS most, max(far) AS worst, count(*) FILTER (n > 1) = 0 AS one_to_one FROM k""",
    MONTAGE,
    rnd="worst",
)
def p18_check(spark, d):
    return geometry.match_audit(named_positions(spark, d))


# scalar functions


@register("f1_slowing_index", "SELECT subject, session, epoch, channel, round(sqrt(2.0 / 3) * (ln(theta + 1e-12) - 0.5 * (ln(alpha + 1e-12) + ln(beta + 1e-12))), 6) AS s FROM bands", BANDS)
def f1(spark, d):
    return base.bands(spark, d).select("subject", "session", "epoch", "channel", r6(scalar.slowing_index(F.col("theta"), F.col("alpha"), F.col("beta"))).alias("s"))


@register("f2_delta_log", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(CASE WHEN l_discount <= 0 OR l_tax <= 0 THEN ln(greatest(l_tax, 0) + 1e-12) - ln(greatest(l_discount, 0) + 1e-12) ELSE ln(l_tax) - ln(l_discount) END, 6) AS dl FROM lineitem")
def f2(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", r6(scalar.delta_log(F.col("l_discount"), F.col("l_tax"))).alias("dl"))


@register("f3_binary_entropy", "SELECT event_id, round(-(q * ln(q) + (1 - q) * ln(1 - q)), 6) AS h FROM (SELECT event_id, least(greatest((k - 10) / 80.0, 1e-12), 1 - 1e-12) AS q FROM ev)", EVENTS)
def f3(spark, d):
    return base.events(spark, d).select("event_id", r6(scalar.binary_entropy((F.col("k") - 10) / 80.0)).alias("h"))


@register("f4_differential_entropy", "SELECT user_id, event_type, round(0.5 * ln(2 * pi() * exp(1) * greatest(coalesce(var_samp(value), 0), 1e-12)), 6) AS de FROM events GROUP BY 1, 2")
def f4(spark, d):
    v = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    return v.select("user_id", "event_type", r6(scalar.differential_entropy(F.col("v"))).alias("de"))


@register("f5_log10_floor", "SELECT c_custkey, round(log10(greatest(c_acctbal, 0.5)), 6) AS l FROM customer")
def f5(spark, d):
    return read(spark, d, "customer").select("c_custkey", r6(scalar.log10_floor(F.col("c_acctbal"), 0.5)).alias("l"))


@register("f6_hash_seed", "SELECT event_id, CAST(('0x' || substr(sha256(concat_ws('|', event_id, event_type, user_id)), 1, 16))::UBIGINT % 2147483647 AS BIGINT) AS seed, ('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 97 AS draw FROM events")
def f6(spark, d):
    return read(spark, d, "events").select("event_id", scalar.hash_seed(F.col("event_id"), F.col("event_type"), F.col("user_id")).alias("seed"), scalar.hash_draw(F.col("event_id"), 97).alias("draw"))


@register("f7_segment_key", "SELECT o_orderkey, printf('%s_e%04d_s%06d', o_orderpriority, o_custkey, o_orderkey) AS k, split_part(o_orderpriority, '-', 1) AS stem FROM orders")
def f7(spark, d):
    return read(spark, d, "orders").select("o_orderkey", scalar.segment_key(F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderkey")).alias("k"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("stem"))


@register(
    "f8_band_mask_trapz",
    """WITH p AS (SELECT vec_id, unnest(range(0, 64)) AS f, embedding FROM embeddings),
    v AS (SELECT vec_id, f, CAST(embedding[f + 1] AS DOUBLE) ** 2 AS y FROM p WHERE f BETWEEN 8 AND 13),
    s AS (SELECT vec_id, (y + lag(y) OVER (PARTITION BY vec_id ORDER BY f)) / 2 AS a FROM v) SELECT vec_id, round(sum(a), 6) AS power FROM s GROUP BY 1""",
)
def f8(spark, d):
    freqs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
    psd = F.transform("embedding", lambda v: v.cast("double") * v.cast("double"))
    return read(spark, d, "embeddings").select("vec_id", freqs.alias("f"), psd.alias("p")).select("vec_id", r6(scalar.band_trapezoid(F.col("f"), F.col("p"), 8, 13)).alias("power"))


@register("f9_parse_list", "SELECT page_id, len(list_filter(string_split(url, '/'), lambda x: trim(x) <> '')) AS n, list_filter(string_split(url, '/'), lambda x: trim(x) <> '')[2] AS second, CAST(length(url) AS INTEGER) AS size FROM pages")
def f9(spark, d):
    parts = scalar.split_list(F.col("url"), "/")
    return read(spark, d, "pages").select("page_id", F.size(parts).cast("long").alias("n"), F.get(parts, F.lit(1)).alias("second"), F.length("url").alias("size"))


@register("f9_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def f9b(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("f10_label_map", "SELECT event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 END AS label, count(*) AS n FROM events GROUP BY 1, 2")
def f10(spark, d):
    return read(spark, d, "events").select("event_type", scalar.label_map(F.col("event_type"), {"view": 0, "click": 1}).alias("label")).groupBy("event_type", "label").agg(F.count("*").alias("n"))


# sorts, sets, reshapes


@register("k1_worst_row", "SELECT l_suppkey, arg_max(l_orderkey * 10 + l_linenumber, abs(l_extendedprice - 1000 * l_quantity)) AS row_key, round(max(abs(l_extendedprice - 1000 * l_quantity)), 6) AS diff FROM lineitem GROUP BY 1")
def k1(spark, d):
    x = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key"), F.abs(F.col("l_extendedprice") - 1000 * F.col("l_quantity")).alias("diff"))
    return shape.worst_row(x, ["l_suppkey"], "row_key", "diff").withColumn("diff", r6("diff"))


@register("k2_best_by", "SELECT p_brand, (min(struct_pack(a := p_retailprice, b := p_size))).a AS score, (min(struct_pack(a := p_retailprice, b := p_size))).b AS choice FROM part GROUP BY 1")
def k2(spark, d):
    return shape.best_by(read(spark, d, "part"), ["p_brand"], "p_retailprice", "p_size")


@register("k3_top_values", "SELECT url_host AS value, count(*) AS n FROM (SELECT split_part(url, '/', 3) AS url_host FROM pages) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def k3(spark, d):
    return shape.top_values(read(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")), "host", 10)


@register("k4_canonical_sort", "SELECT user_id, event_type, event_id, row_number() OVER (ORDER BY user_id, event_type, event_id) AS position FROM events")
def k4(spark, d):
    return shape.canonical_positions(read(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type", "event_id"])


@register(
    "t1_subject_sets",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 150),
    b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 150)
    SELECT coalesce(a.user_id, b.user_id) AS subject, CASE WHEN a.user_id IS NULL THEN 'only_b' WHEN b.user_id IS NULL THEN 'only_a' ELSE 'both' END AS side
    FROM a FULL JOIN b ON a.user_id = b.user_id""",
)
def t1(spark, d):
    ev = read(spark, d, "events").where("value > 150").select(F.col("user_id").alias("subject"), "event_type")
    return shape.subject_sets(ev.where("event_type = 'view'").select("subject"), ev.where("event_type = 'click'").select("subject"), "subject")


@register(
    "t4_union_condition_tables",
    "SELECT label, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT 0 AS label, l_quantity AS v FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 1, l_discount FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1",
)
def t4(spark, d):
    li = read(spark, d, "lineitem")
    both = shape.union_conditions({0: li.where("l_linestatus = 'F'").select(F.col("l_quantity").alias("v")), 1: li.where("l_linestatus = 'O'").select(F.col("l_discount").alias("v"), F.lit(1).alias("extra"))})
    return both.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@register("r1_to_wide", "SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 4) AS M_{t}" for t in ("click", "error", "view")) + " FROM events GROUP BY 1")
def r1(spark, d):
    w = shape.to_wide(read(spark, d, "events"), ["user_id"], "event_type", F.sum("value"), ["click", "error", "view"], "M_")
    return w.select("user_id", *[F.round(c, 4).alias(c) for c in w.columns[1:]])


@register("r2_to_long", "SELECT subject, session, epoch, observable, round(sum(value), 4) AS value FROM (UNPIVOT bands ON theta, alpha, beta INTO NAME observable VALUE value) GROUP BY ALL", BANDS)
def r2(spark, d):
    return shape.to_long(base.bands(spark, d), ["subject", "session", "epoch"], ["theta", "alpha", "beta"]).groupBy("subject", "session", "epoch", "observable").agg(F.round(F.sum("value"), 4).alias("value"))


@register("a3_region_series", "SELECT subject, session, epoch, region, round(s, 6) AS s FROM series", base.SERIES)
def a3(spark, d):
    from cohortwave.operators import aggregates

    return aggregates.region_series(base.channels(spark, d), ["subject", "session", "epoch", "region"], "value").select("subject", "session", "epoch", "region", r6("s").alias("s"))


del CHANNELS
