"""Views of the driver tables in the shapes that the operators take, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as W

DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def req(spark: SparkSession, d: str) -> DataFrame:
    """Requests: one per event; k, the number in props, makes statuses."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("span"),
        F.col("user_id").alias("stream"),
        F.col("event_type").alias("service"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("end_s"),
        F.datediff(F.col("ts"), F.lit("2024-01-01")).alias("window"),
        F.col("value").alias("duration"),
        k.alias("k"),
        F.when(k < 5, None).when(k >= 95, 503).when(k >= 90, 404).otherwise(200).alias("status"),
        (1 + F.col("event_id") % 16).cast("int").alias("active"),
    )


REQ = """req AS (
  SELECT event_id AS span, user_id AS stream, event_type AS service, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS end_s,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS "window", value AS duration, k,
    CASE WHEN k < 5 THEN NULL WHEN k >= 95 THEN 503 WHEN k >= 90 THEN 404 ELSE 200 END AS status, CAST(1 + event_id % 16 AS INT) AS active
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events))"""


def win(spark: SparkSession, d: str) -> DataFrame:
    """Service-days of requests."""
    return W.request_windows(req(spark, d), 86400.0)


WIN = (
    REQ
    + """, win AS (
  SELECT service, "window", quantile_cont(duration, 0.95) AS p95, avg(coalesce(CAST(status >= 400 AS INT), 0)) AS error_fraction,
    count(*) / 86400.0::DOUBLE AS rps, max(active) AS max_active, count(*) AS requests
  FROM req GROUP BY service, "window")"""
)


def busy(spark: SparkSession, d: str) -> DataFrame:
    """win with a dense warning flag: p95 over the median of the first five days."""
    w = win(spark, d)
    base = w.where("window < 5").groupBy("service").agg(F.percentile("p95", F.lit(0.5)).alias("base"))
    return w.join(base, "service").withColumn("warning", F.col("p95") > F.col("base")).withColumn("until", F.col("window") + 1)


BUSY = (
    WIN
    + """, base AS (SELECT service, quantile_cont(p95, 0.5) AS base FROM win WHERE "window" < 5 GROUP BY service),
busy AS (SELECT win.*, base, p95 > base AS warning, "window" + 1 AS until FROM win JOIN base USING (service))"""
)


def child(spark: SparkSession, d: str) -> DataFrame:
    """Line items as spans by service and month."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("trace"),
        F.col("l_linenumber").alias("span"),
        F.concat("l_returnflag", "l_linestatus").alias("service"),
        F.date_trunc("month", "l_shipdate").cast("date").cast("string").alias("month"),
        F.col("l_quantity").alias("duration"),
        F.when(F.col("l_tax") == 0, None).when(F.col("l_discount") >= 0.09, 500).otherwise(200).alias("status"),
    )


CHILD = """child AS (
  SELECT l_orderkey AS trace, l_linenumber AS span, l_returnflag || l_linestatus AS service, CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS month,
    l_quantity AS duration, CASE WHEN l_tax = 0 THEN NULL WHEN l_discount >= 0.09 THEN 500 ELSE 200 END AS status
  FROM lineitem)"""


def msg(spark: SparkSession, d: str) -> DataFrame:
    """Documents as log rows."""
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("service"), F.floor(F.col("doc_id") / 100).alias("window"), F.col("text").alias("message"))


MSG = """msg AS (SELECT doc_id, source AS service, doc_id // 100 AS "window", text AS message FROM documents)"""


def sess(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lifecycle measurements of a customer's session."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("instance"), F.col("o_orderpriority").alias("operation"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("line"))


SESS = "sess AS (SELECT o_custkey AS instance, o_orderpriority AS operation, o_totalprice AS value, o_orderkey AS line FROM orders)"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def tok(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("session"), "ts", "event_id", F.col("event_type").alias("token"))


def lab(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a score to evaluate."""
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id").select("doc_id", F.col("toxic").alias("truth"), F.col("n_chars").cast("double").alias("score"), F.col("lang").alias("system"), F.col("source").alias("service"))


LAB = "lab AS (SELECT doc_id, toxic AS truth, CAST(n_chars AS DOUBLE) AS score, lang AS system, source AS service FROM labels JOIN documents USING (doc_id))"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


SCHEDULE = [("click", 8, 12), ("error", 15, 18), ("view", 20, 26)]


def schedule(spark: SparkSession) -> DataFrame:
    """Fault intervals [onset, recovery) in days, for evaluation only."""
    return spark.createDataFrame(SCHEDULE, "service string, onset int, recovery int")


SCHED = "sched AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {a}, {b})" for s, a, b in SCHEDULE) + ") t(service, onset, recovery))"
