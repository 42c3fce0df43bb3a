"""Contracts of telemetry events: named rules per row, and the rows that break none.

A rule is a name and a condition; an unknown (null) outcome counts as broken. Rules of a whole batch or window (its size,
its span, its unique members) are conditions over aggregates, so they are checked after one grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..functions.text import OPERATIONS

# Enumerations, ranges and patterns that existing producers keep to.
REQUEST_SERVICES = ("frontend", "checkout", "inventory")
REQUEST_DEPENDENCIES = ("checkout", "inventory")
LOG_SERVICES = ("gateway", "reservation", "worker", "database")
LEVELS = ("INFO", "WARN", "ERROR")
PROFILES = ("ob", "ss", "tt")
CALIBRATIONS = ("v3", "v4")
HEX_ID = "^[0-9a-f]{32}$"
UUID = "^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
NAME = "^[A-Za-z0-9_.-]+$"
ZONED = r"(Z|[+-]\d{2}:?\d{2})$"
STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,9}$"
MAX_MESSAGE = 2000
MAX_DURATION_MS = 600_000
MAX_LATENCY_MS = 3_600_000
MAX_DURATION_S = 600_000
CLOCK_MS = 5
WINDOW_EVENTS = 5000
WINDOW_SECONDS = 60
MAX_FEATURE = 1e12
FEATURES = 18
FLAGS = (10, 15)
SHARES = (16, 17)
MAX_SERVICES = 128
MAX_BATCH = 128

Rules = list[tuple[str, Column]]


def optional(value: Column, ok: Column) -> Column:
    return value.isNull() | ok


def request_rules(schema: str, allowed: list[str], event: str = "event", raw: str = "value") -> Rules:
    """Rules of a request event in struct column ``event``, parsed from the JSON text ``raw``, which has no fields but those
    allowed. Completion may not precede the start, and the duration agrees with both clocks within 5 ms."""
    c = lambda name: F.col(f"{event}.{name}")
    start, end, duration = finite(c("start")), finite(c("end")), finite(c("duration_ms"))
    return [
        ("schema", c("schema") == schema),
        ("service", c("service").isin(*REQUEST_SERVICES)),
        ("trace_id", c("trace_id").rlike(HEX_ID)),
        ("span_id", c("span_id").rlike(HEX_ID)),
        ("parent_span_id", optional(c("parent_span_id"), c("parent_span_id").rlike(HEX_ID))),
        ("start", start > 0),
        ("end", end > 0),
        ("duration_ms", duration.between(0, MAX_DURATION_MS)),
        ("order", end >= start),
        ("clock", F.abs((end - start) * 1000 - duration) <= CLOCK_MS),
        ("status", c("status").between(100, 599)),
        ("active_requests", c("active_requests").between(1, 10_000)),
        ("message", F.length(c("message")) <= MAX_MESSAGE),
        ("dependency", optional(c("dependency"), c("dependency").isin(*REQUEST_DEPENDENCIES))),
        ("dependency_status", optional(c("dependency_status"), c("dependency_status").between(0, 599))),
        ("fields", F.size(F.array_except(F.json_object_keys(F.col(raw)), F.array(*map(F.lit, allowed)))) == 0),
    ]


def log_rules() -> Rules:
    """Rules of a log event with ``timestamp`` text that names its time zone."""
    c = F.col
    return [
        ("timestamp", c("timestamp").rlike(ZONED) & F.try_to_timestamp("timestamp").isNotNull()),
        ("service", c("service").isin(*LOG_SERVICES)),
        ("level", c("level").isin(*LEVELS)),
        ("message", F.length("message").between(1, MAX_MESSAGE)),
        ("latency_ms", finite(c("latency_ms")).between(0, MAX_LATENCY_MS)),
    ]


def log_windows(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, events, violations: rules of a window (1 to 5000 events, at most 60 s between the first and the last) and
    ``event`` where any of its events breaks a rule. events has violations, as from :func:`check`."""
    at = F.try_to_timestamp("timestamp")
    windows = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.bool_and(F.size("violations") == 0).alias("_ok"), ((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6).alias("_span"))
    return check(windows, [("event", F.col("_ok")), ("window_events", F.col("events").between(1, WINDOW_EVENTS)), ("window_span", F.coalesce("_span", F.lit(0.0)) <= WINDOW_SECONDS)]).drop("_ok", "_span")


def feature_rules(schema: str) -> Rules:
    """Rules of a feature window: stream, profile, end, feature_schema and services (array of service and 18 features)."""
    c = F.col
    value = lambda s, i: F.get(s["features"], F.lit(i))
    every = lambda test: F.forall("services", lambda s: F.coalesce(test(s), F.lit(False)))
    names = F.transform("services", lambda s: s["service"])
    return [
        ("stream", c("stream").rlike(NAME) & (F.length("stream") <= 80)),
        ("profile", c("profile").isin(*PROFILES)),
        ("end", (c("end") > 0) & (c("end") % 60 == 0)),
        ("feature_schema", c("feature_schema") == schema),
        ("services", F.size("services").between(1, MAX_SERVICES)),
        ("service", every(lambda s: s["service"].rlike(NAME) & (F.length(s["service"]) <= 128))),
        ("unique", F.size(F.array_distinct(names)) == F.size(names)),
        ("features", every(lambda s: (F.size(s["features"]) == FEATURES) & F.forall(s["features"], lambda x: finite(x).isNotNull() & x.between(0, MAX_FEATURE)))),
        ("flags", every(lambda s: value(s, FLAGS[0]).isin(0, 1) & value(s, FLAGS[1]).isin(0, 1))),
        ("shares", every(lambda s: (value(s, SHARES[0]) <= 1) & (value(s, SHARES[1]) <= 1))),
    ]


def parameter_rules() -> Rules:
    """Rules of a lifecycle parameter event; the timestamp must also be a date that exists."""
    c = F.col
    return [
        ("instance", c("instance").rlike(UUID)),
        ("operation", c("operation").isin(*OPERATIONS)),
        ("duration_seconds", finite(c("duration_seconds")).between(0, MAX_DURATION_S)),
        ("line_number", c("line_number") >= 1),
        ("observed_timestamp", c("observed_timestamp").rlike(STAMP) & F.try_to_timestamp("observed_timestamp").isNotNull()),
    ]


def batches(events: DataFrame, keys: list[str], rules: Rules, most: int = MAX_BATCH) -> DataFrame:
    """keys, events, violations: rules of a batch, its size, and ``event`` where any of its events breaks a rule."""
    sizes = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.bool_and(F.size("violations") == 0).alias("_ok"))
    return check(sizes, [("event", F.col("_ok")), ("batch_size", F.col("events").between(1, most)), *rules]).drop("_ok")


def check(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``violations``, the names of the rules that a row breaks."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that keep to the contract, and the quarantined ones with their violations."""
    broken = F.size("violations") > 0
    return checked.where(~broken).drop("violations"), checked.where(broken)


def violation_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
