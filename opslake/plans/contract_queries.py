"""Queries of the event contracts. The driver tables are cast into the producers' shapes with every rule broken by some
rows, so that each rule's count is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import OPERATIONS
from ..operators import contracts as K
from ..sources import files
from . import bindings as B
from .registry import query

REQUEST_SCHEMA, FEATURE_SCHEMA, PARAMETER_SCHEMA = "request-v1", "features-v2", "lifecycle-v1"


def violations_sql(source: str, name: str, rules: dict[str, str]) -> str:
    tests = ", ".join(f"CASE WHEN NOT coalesce({sql}, false) THEN '{rule}' END" for rule, sql in rules.items())
    return f"WITH {source}, v AS (SELECT unnest(list_filter([{tests}], lambda x: x IS NOT NULL)) AS rule FROM {name}) SELECT rule, count(*) AS n FROM v GROUP BY rule"


def _one_of(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Requests: k, a number from 0 to 99 in each event, says which rule a row breaks.
_RAW = (
    B.REQ
    + f""", raw AS (SELECT k,
  CASE WHEN k = 1 THEN 'request-v0' ELSE '{REQUEST_SCHEMA}' END AS schema,
  CASE service WHEN 'click' THEN 'frontend' WHEN 'view' THEN 'checkout' WHEN 'purchase' THEN 'inventory' ELSE service END AS service,
  md5(CAST(stream AS VARCHAR)) AS trace_id, CASE WHEN k = 2 THEN upper(md5(CAST(span AS VARCHAR))) ELSE md5(CAST(span AS VARCHAR)) END AS span_id,
  CASE WHEN k = 4 THEN 'root' WHEN span % 3 <> 0 THEN md5(CAST(span - 1 AS VARCHAR)) END AS parent_span_id,
  CASE WHEN k = 6 THEN -1.0 WHEN k = 7 THEN end_s + 1 ELSE end_s - duration / 1000 END AS "start", CASE WHEN k = 5 THEN 0.0 ELSE end_s END AS "end",
  CASE WHEN k = 3 THEN 700000.0 WHEN k = 8 THEN duration + 10 ELSE duration END AS duration_ms,
  CASE WHEN k = 9 THEN 600 WHEN k < 5 THEN NULL ELSE status END AS status, CASE WHEN k = 10 THEN 0 ELSE active END AS active_requests,
  CASE WHEN k = 11 THEN repeat('x', 2001) WHEN k = 12 THEN NULL ELSE 'done' END AS message,
  CASE WHEN k = 13 THEN 'gateway' WHEN span % 5 = 0 THEN 'checkout' END AS dependency, CASE WHEN k = 14 THEN 700 WHEN span % 5 = 0 THEN status END AS dependency_status
  FROM req)"""
)
P01 = {
    "schema": f"schema = '{REQUEST_SCHEMA}'",
    "service": f"service IN {_one_of(K.REQUEST_SERVICES)}",
    "trace_id": f"regexp_matches(trace_id, '{K.HEX_ID}')",
    "span_id": f"regexp_matches(span_id, '{K.HEX_ID}')",
    "parent_span_id": f"parent_span_id IS NULL OR regexp_matches(parent_span_id, '{K.HEX_ID}')",
    "start": '"start" > 0',
    "end": '"end" > 0',
    "duration_ms": "duration_ms BETWEEN 0 AND 600000",
    "order": '"end" >= "start"',
    "clock": 'abs(("end" - "start") * 1000 - duration_ms) <= 5',
    "status": "status BETWEEN 100 AND 599",
    "active_requests": "active_requests BETWEEN 1 AND 10000",
    "message": "length(message) <= 2000",
    "dependency": f"dependency IS NULL OR dependency IN {_one_of(K.REQUEST_DEPENDENCIES)}",
    "dependency_status": "dependency_status IS NULL OR dependency_status BETWEEN 0 AND 599",
    "fields": "k <> 15",
}


def raw_requests(spark, d) -> DataFrame:
    """Requests as JSON lines (column ``value``)."""
    c = F.col
    k, span = c("k"), c("span")
    r = B.req(spark, d)
    md5 = lambda x: F.md5(x.cast("string").cast("binary"))
    none = F.lit(None)
    fields = {
        "schema": F.when(k == 1, "request-v0").otherwise(REQUEST_SCHEMA),
        "service": F.coalesce(*[F.when(c("service") == a, b) for a, b in (("click", "frontend"), ("view", "checkout"), ("purchase", "inventory"))], c("service")),
        "trace_id": md5(c("stream")),
        "span_id": F.when(k == 2, F.upper(md5(span))).otherwise(md5(span)),
        "parent_span_id": F.when(k == 4, "root").when(span % 3 != 0, md5(span - 1)),
        "start": F.when(k == 6, -1.0).when(k == 7, c("end_s") + 1).otherwise(c("end_s") - c("duration") / 1000),
        "end": F.when(k == 5, 0.0).otherwise(c("end_s")),
        "duration_ms": F.when(k == 3, 700000.0).when(k == 8, c("duration") + 10).otherwise(c("duration")),
        "status": F.when(k == 9, 600).when(k < 5, none).otherwise(c("status")),
        "active_requests": F.when(k == 10, 0).otherwise(c("active")),
        "message": F.when(k == 11, "x" * 2001).when(k == 12, none).otherwise("done"),
        "dependency": F.when(k == 13, "gateway").when(span % 5 == 0, "checkout"),
        "dependency_status": F.when(k == 14, 700).when(span % 5 == 0, c("status")),
        "root_cause": F.when(k == 15, "frontend"),
    }
    return r.select(F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])).alias("value"))


def checked_requests(lines: DataFrame) -> DataFrame:
    """Lines with ``event`` (null where a line is no JSON) and ``violations`` of the request contract."""
    allowed = ["schema", *files.REQUEST.fieldNames()]
    schema = f"schema string, {files.REQUEST.simpleString().removeprefix('struct<').removesuffix('>').replace(':', ' ')}"
    parsed = lines.select("value", F.explode(F.array(F.from_json("value", schema))).alias("event"))  # parsed once, not once a rule
    return K.check(parsed, K.request_rules(REQUEST_SCHEMA, allowed))


@query("p01_request_contract", violations_sql(_RAW, "raw", P01))
def request_contract(spark, d):
    return K.violation_counts(checked_requests(raw_requests(spark, d)))


_VALID = " AND ".join(f"coalesce({sql}, false)" for sql in P01.values())


@query("p01_quarantine", f"WITH {_RAW} SELECT count(*) AS lines, count(*) FILTER ({_VALID}) AS valid, count(*) FILTER (NOT ({_VALID})) AS quarantined FROM raw")
def request_quarantine(spark, d):
    valid, broken = K.split(checked_requests(raw_requests(spark, d)))
    both = valid.select(F.lit(1).alias("ok")).unionByName(broken.select(F.lit(0).alias("ok")))
    return both.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("ok") == 1).alias("valid"), F.count_if(F.col("ok") == 0).alias("quarantined"))


# Logs: windows of a service's events in stretches of 20 minutes, those of an odd number cut to 50 seconds.
_LOGS = (
    B.REQ
    + """, logs AS (SELECT span, k, end_s, service AS source, CAST(floor(end_s / 1200) AS BIGINT) AS stretch,
  CASE service WHEN 'click' THEN 'gateway' WHEN 'view' THEN 'worker' WHEN 'purchase' THEN 'database' WHEN 'signup' THEN 'reservation' ELSE service END AS service,
  CASE WHEN k = 1 THEN 'TRACE' WHEN status >= 500 THEN 'ERROR' WHEN status >= 400 THEN 'WARN' ELSE 'INFO' END AS level,
  CASE WHEN k = 2 THEN '' WHEN k = 3 THEN repeat('x', 2001) ELSE 'done' END AS message,
  CASE WHEN k = 4 THEN -1.0 WHEN k = 5 THEN 3600001.0 ELSE duration END AS latency_ms FROM req)"""
)
P02 = {
    "timestamp": "k NOT IN (6, 7)",
    "service": f"service IN {_one_of(K.LOG_SERVICES)}",
    "level": f"level IN {_one_of(K.LEVELS)}",
    "message": "length(message) BETWEEN 1 AND 2000",
    "latency_ms": "latency_ms BETWEEN 0 AND 3600000",
}


def log_events(spark, d) -> DataFrame:
    c = F.col
    k = c("k")
    at = F.timestamp_micros((c("end_s") * 1e6).cast("long"))
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return B.req(spark, d).select(
        "span",
        c("service").alias("source"),
        F.floor(c("end_s") / 1200).alias("stretch"),
        F.when(k == 6, stamp).when(k == 7, "2024-02-30T00:00:00Z").otherwise(F.concat(stamp, F.lit("Z"))).alias("timestamp"),
        F.coalesce(*[F.when(c("service") == a, b) for a, b in (("click", "gateway"), ("view", "worker"), ("purchase", "database"), ("signup", "reservation"))], c("service")).alias("service"),
        F.when(k == 1, "TRACE").when(c("status") >= 500, "ERROR").when(c("status") >= 400, "WARN").otherwise("INFO").alias("level"),
        F.when(k == 2, "").when(k == 3, "x" * 2001).otherwise("done").alias("message"),
        F.when(k == 4, -1.0).when(k == 5, 3600001.0).otherwise(c("duration")).alias("latency_ms"),
    )


@query("p02_log_event_contract", violations_sql(_LOGS, "logs", P02))
def log_event_contract(spark, d):
    return K.violation_counts(K.check(log_events(spark, d), K.log_rules()))


_LOG_OK = " AND ".join(f"coalesce({sql}, false)" for sql in P02.values())


@query(
    "p02_log_window_contract",
    f"""WITH {_LOGS}, w AS (SELECT source, stretch, count(*) AS events, bool_and({_LOG_OK}) AS ok, max(end_s) FILTER (k <> 7 AND k <> 6) - min(end_s) FILTER (k <> 7 AND k <> 6) AS span FROM logs WHERE k NOT IN (6, 7) GROUP BY ALL)
SELECT source, count(*) AS windows, count(*) FILTER (NOT ok) AS bad_events, count(*) FILTER (span > 60) AS too_long, count(*) FILTER (ok AND span <= 60 AND events <= 5000) AS valid FROM w GROUP BY source""",
)
def log_window_contract(spark, d):
    events = K.check(log_events(spark, d).where("timestamp LIKE '%.%Z'"), K.log_rules())
    windows = K.log_windows(events, ["source", "stretch"])
    has = lambda rule: F.count_if(F.array_contains("violations", rule))
    return windows.groupBy("source").agg(F.count(F.lit(1)).alias("windows"), has("event").alias("bad_events"), has("window_span").alias("too_long"), F.count_if(F.size("violations") == 0).alias("valid"))


# Feature windows: one message a day with the services' 18 features; the day says which rule it breaks.
_FEATURES = (
    B.WIN
    + """, feat AS (SELECT "window" AS w, CASE WHEN "window" % 13 = 1 THEN 'pay load' ELSE service END AS service, p95, error_fraction, requests FROM win
  UNION ALL SELECT "window", service, p95, error_fraction, requests FROM win WHERE "window" % 13 = 2 AND service = 'view'),
msgs AS (SELECT w, count(*) AS n, count(DISTINCT service) AS names, bool_and(regexp_matches(service, '^[A-Za-z0-9_.-]+$')) AS named FROM feat GROUP BY w)"""
)
P03 = {
    "stream": "w % 13 <> 3",
    "profile": "w % 13 <> 4",
    "end": "w % 13 <> 5",
    "feature_schema": "w % 13 <> 6",
    "services": "n BETWEEN 1 AND 128",
    "service": "named",
    "unique": "n = names",
    "features": "w % 13 NOT IN (7, 8)",
    "flags": "w % 13 <> 9",
    "shares": "w % 13 NOT IN (8, 10)",
}


def feature_windows(spark, d) -> DataFrame:
    w = B.win(spark, d)
    day = F.col("window") % 13
    named = w.withColumn("service", F.when(day == 1, "pay load").otherwise(F.col("service")))
    rows = named.unionByName(w.where((day == 2) & (F.col("service") == "view")))
    zero = F.lit(0.0)
    features = [F.col("p95"), F.col("error_fraction"), *[zero] * 8, F.when(day == 9, 2.0).otherwise(1.0), F.when(day == 7, -1.0).otherwise(0.0), *[zero] * 3, F.lit(1.0), F.when(day == 10, 1.5).otherwise(0.5), zero]
    array = F.array(*features)
    service = F.struct("service", F.when(day == 8, F.slice(array, 1, 17)).otherwise(array).alias("features"))
    messages = rows.groupBy("window").agg(F.collect_list(service).alias("services"))
    return messages.select(
        F.when(day == 3, "a b").otherwise("live-1").alias("stream"),
        F.when(day == 4, "xx").otherwise("ob").alias("profile"),
        ((F.col("window") + 1) * 60 + F.when(day == 5, 1).otherwise(0)).alias("end"),
        F.when(day == 6, "features-v1").otherwise(FEATURE_SCHEMA).alias("feature_schema"),
        "services",
    )


@query("p03_feature_window_contract", violations_sql(_FEATURES, "msgs", P03))
def feature_window_contract(spark, d):
    return K.violation_counts(K.check(feature_windows(spark, d), K.feature_rules(FEATURE_SCHEMA)))


# Lifecycle parameters: orders; the last two digits of the key say which rule a row breaks.
_OPS = list(zip(B.PRIORITIES, OPERATIONS))
_PARAMS = f"""params AS (SELECT o_orderkey AS key, CAST(floor(o_orderkey / 500) AS BIGINT) AS batch, o_orderkey % 100 AS e,
  CASE o_orderpriority {' '.join(f"WHEN '{p}' THEN '{o}'" for p, o in _OPS)} ELSE 'resize instance' END AS operation, o_totalprice AS value FROM orders)"""
P04 = {
    "instance": "e <> 1",
    "operation": f"operation IN {_one_of(OPERATIONS)}",
    "duration_seconds": "e NOT IN (2, 3) AND value BETWEEN 0 AND 600000",
    "line_number": "e <> 4 AND key >= 1",
    "observed_timestamp": "e NOT IN (5, 6, 7)",
}


def parameter_events(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    e = key % 100
    h = F.md5(F.col("o_custkey").cast("string").cast("binary"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS")
    operation: Column = F.coalesce(*[F.when(F.col("o_orderpriority") == p, o) for p, o in _OPS], F.lit("resize instance"))
    return B.table(spark, d, "orders").select(
        F.floor(key / 500).alias("batch"),
        F.when(e == 1, F.upper(uuid)).otherwise(F.concat(F.lit("a"), F.substring(uuid, 2, 35))).alias("instance"),
        operation.alias("operation"),
        F.when(e == 2, -1.0).when(e == 3, float("nan")).otherwise(F.col("o_totalprice")).alias("duration_seconds"),
        F.when(e == 4, 0).otherwise(key).alias("line_number"),
        F.when(e == 5, "2024-02-30 00:00:00.000").when(e == 6, F.substring(stamp, 1, 19)).when(e == 7, F.concat(stamp, F.lit("Z"))).otherwise(stamp).alias("observed_timestamp"),
    )


@query("p04_parameter_contract", violations_sql(_PARAMS, "params", P04))
def parameter_contract(spark, d):
    return K.violation_counts(K.check(parameter_events(spark, d), K.parameter_rules()))


_PARAM_OK = " AND ".join(f"coalesce({sql}, false)" for sql in P04.values())


@query(
    "p04_batch_contract",
    f"""WITH {_PARAMS}, b AS (SELECT batch, count(*) AS events, bool_and({_PARAM_OK}) AS ok FROM params GROUP BY batch)
SELECT batch, events, list_sort(list_filter([CASE WHEN NOT ok THEN 'event' END, CASE WHEN events > 128 THEN 'batch_size' END, CASE WHEN batch % 5 = 4 THEN 'profile' END], lambda x: x IS NOT NULL)) AS violations FROM b""",
)
def batch_contract(spark, d):
    events = K.check(parameter_events(spark, d), K.parameter_rules()).withColumn("profile", F.when(F.col("batch") % 5 == 4, "v2").otherwise("v4"))
    batches = K.batches(events, ["batch", "profile"], [("profile", F.col("profile").isin(*K.CALIBRATIONS))])
    return batches.select("batch", "events", F.array_sort("violations").alias("violations"))
