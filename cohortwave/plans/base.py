"""Registry of queries with their SQL, and the roles that the driver's tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, *ctes: str, rnd: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Register a query; ctes are put before its SQL. Columns named in rnd are rounded on both sides."""
    columns = rnd.split()

    def put(f: Query) -> Query:
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.round(c, digits) for c in columns})) if columns else f
        if sql:
            body = f"WITH {', '.join(ctes)} {sql.strip()}" if ctes else sql.strip()
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM ({body})" if columns else body
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


#: The same roles in SQL.
EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"
TRIALS = "trials AS (SELECT user_id AS subject, CASE event_type WHEN 'view' THEN 'baseline' ELSE 'perturbation' END AS session, event_id AS trial_id, value AS rt FROM events WHERE event_type IN ('view', 'click'))"
BANDS = "bands AS (SELECT l_suppkey AS subject, CASE l_linestatus WHEN 'F' THEN 'baseline' ELSE 'perturbation' END AS session, l_orderkey AS epoch, l_linenumber AS channel, l_extendedprice AS theta, l_quantity AS alpha, l_tax + 0.01 AS beta FROM lineitem)"
CHANNELS = """flat AS (SELECT label AS subject, CASE WHEN vec_id % 2 = 0 THEN 'baseline' ELSE 'perturbation' END AS session, vec_id AS epoch, unnest(range(0, 64)) AS channel, embedding
    FROM embeddings),
channels AS (SELECT subject, session, epoch, channel, CASE WHEN channel < 16 THEN 'F' WHEN channel < 44 THEN 'CT' ELSE 'PO' END AS region, CAST(embedding[channel + 1] AS DOUBLE) AS value
    FROM flat)"""
SERIES = f"{CHANNELS}, series AS (SELECT subject, session, region, epoch, median(value) AS s FROM channels GROUP BY ALL)"
PREDICTIONS = f"""{EVENTS}, pred AS (SELECT 'a' AS arm, event_id % 3 AS seed, user_id AS subject, event_id AS segment_id, event_type AS session, t, CAST(k >= 50 AS INTEGER) AS y, value / (value + 50.0) AS p
    FROM ev
UNION ALL SELECT 'b', event_id % 3, user_id, event_id, event_type, t, CAST(k >= 50 AS INTEGER), 1 - k / 100.0 FROM ev)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", "event_type", "value", seconds(F.col("ts")).alias("t"), F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))


def trials(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    return ev.select(F.col("user_id").alias("subject"), F.when(F.col("event_type") == "view", "baseline").otherwise("perturbation").alias("session"), F.col("event_id").alias("trial_id"), F.col("value").alias("rt"))


def bands(spark: SparkSession, d: str) -> DataFrame:
    session = F.when(F.col("l_linestatus") == "F", "baseline").otherwise("perturbation")
    return read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("subject"), session.alias("session"), F.col("l_orderkey").alias("epoch"), F.col("l_linenumber").alias("channel"),
        F.col("l_extendedprice").alias("theta"), F.col("l_quantity").alias("alpha"), (F.col("l_tax") + 0.01).alias("beta"),
    )


def epochs(spark: SparkSession, d: str) -> DataFrame:
    session = F.when(F.col("vec_id") % 2 == 0, "baseline").otherwise("perturbation")
    return read(spark, d, "embeddings").select(F.col("label").alias("subject"), session.alias("session"), F.col("vec_id").alias("epoch"), F.col("embedding").alias("samples"))


def region_of(channel: Column) -> Column:
    return F.when(channel < 16, "F").when(channel < 44, "CT").otherwise("PO")


def channels(spark: SparkSession, d: str) -> DataFrame:
    long = epochs(spark, d).select("subject", "session", "epoch", F.posexplode("samples").alias("channel", "value"))
    return long.select("subject", "session", "epoch", "channel", region_of(F.col("channel")).alias("region"), F.col("value").cast("double").alias("value"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    arms = F.array(F.struct(F.lit("a").alias("arm"), (F.col("value") / (F.col("value") + 50.0)).alias("p")), F.struct(F.lit("b").alias("arm"), (1 - F.col("k") / 100.0).alias("p")))
    return events(spark, d).select((F.col("event_id") % 3).alias("seed"), F.col("user_id").alias("subject"), F.col("event_id").alias("segment_id"), F.col("event_type").alias("session"), "t", (F.col("k") >= 50).cast("int").alias("y"), F.explode(arms).alias("x")).select(
        "x.arm", "seed", "subject", "segment_id", "session", "t", "y", "x.p"
    )
