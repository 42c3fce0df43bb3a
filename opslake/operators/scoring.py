"""Operational scoring, evidence and rule-based diagnosis of service windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def operational_reasons(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``reasons`` (no requests, latency, errors over the service's limits) and ``alert``. limits is one row a service."""
    joined = df.join(limits, "service")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("requests") == 0, F.lit("no requests")),
            F.when(F.col("p95") > F.col("latency_limit"), F.lit("latency")),
            F.when(F.col("error_fraction") > F.col("error_limit"), F.lit("errors")),
        )
    )
    return joined.withColumn("reasons", reasons).withColumn("alert", F.size("reasons") > 0)


def top_evidence(events: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The k most telling events of each window: failures first, then the slowest, ties by span."""
    error = F.coalesce(F.col("status") >= 400, F.lit(False))
    ranked = events.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(error.desc(), F.col("duration").desc(), "span")))
    kept = ranked.where(F.col("_r") <= k)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "span", "status", "duration", "dependency", "dependency_status"))), lambda x: x.dropFields("_r")).alias("evidence"))


def priorities(df: DataFrame, window: str = "window") -> DataFrame:
    """Adds ``priority``: 3 for a failure of the service's own, 2 without requests, 1 for any reason, else 0; an alert whose
    evidence names no dependency that alerts itself is raised to 3. df has reasons, alert, requests and evidence."""
    own = F.exists("evidence", lambda e: (e["status"] >= 400) & e["dependency"].isNull())
    base = F.when(F.coalesce(own, F.lit(False)), 3).when(F.col("requests") == 0, 2).when(F.col("alert"), 1).otherwise(0)
    alerting = F.collect_set(F.when(F.col("alert"), F.col("service"))).over(Window.partitionBy(window))
    named = F.filter(F.transform("evidence", lambda e: e["dependency"]), lambda d: d.isNotNull())
    root = F.col("alert") & ~F.arrays_overlap(F.coalesce(named, F.array().cast("array<string>")), F.col("_alerting"))
    out = df.withColumn("_alerting", alerting).withColumn("priority", F.when(root, F.greatest(base, F.lit(3))).otherwise(base))
    return out.drop("_alerting")


def ranked_candidates(df: DataFrame, window: str = "window") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(window).orderBy(F.col("priority").desc(), F.col("p95").desc(), "service")))


def dependency_edges(df: DataFrame, window: str = "window") -> DataFrame:
    """source, target, status, span of evidence whose downstream call failed, and whether the target has a row that alerts."""
    calls = df.select(window, F.col("service").alias("source"), F.explode("evidence").alias("e")).where(F.col("e.dependency_status").isNotNull() & (F.col("e.dependency_status") != 200))
    edges = calls.select(window, "source", F.col("e.dependency").alias("target"), F.col("e.dependency_status").alias("status"), F.col("e.span").alias("span"))
    targets = df.where("alert").select(window, F.col("service").alias("target"), F.lit(True).alias("affected"))
    return edges.join(targets, [window, "target"], "left").withColumn("affected", F.coalesce("affected", F.lit(False)))


def rule_diagnosis(flags: dict[str, Column], rules: list[tuple[str, str]]) -> Column:
    """The first rule whose flag holds names the cause; none otherwise."""
    return F.coalesce(*[F.when(flags[f], F.lit(cause)) for f, cause in rules], F.lit("none"))


def reject_reason(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first condition that holds, null if none does."""
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in rules])


def contract(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``violations``, the names of the rules that a row breaks; an unknown (null) outcome counts as broken."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])))


def window_status(services: DataFrame, scores: DataFrame, threshold: DataFrame, expected: list[str], rules: list[tuple[str, Column, str]], novel_share: float = 0.1, window: str = "window") -> DataFrame:
    """window, status, ml_anomaly, novel, missing (expected services without events, by name) and suspect of every window of
    ``scores`` (window, score). services has one row a window and service with events, errors, p95 and unknown (the share of
    its lines without a known template); threshold is one row.

    With a missing service telemetry is insufficient and nothing is diagnosed; else a score over the threshold or a service
    with too many unknown lines is an anomaly, and the first rule (service, condition on its row, suspect) that holds names
    the suspect."""
    there = services.where(F.col("events") > 0)
    facts = [F.coalesce(F.bool_or((F.col("service") == s) & F.coalesce(c, F.lit(False))), F.lit(False)).alias(f"_rule{i}") for i, (s, c, _) in enumerate(rules)]
    per = there.groupBy(window).agg(F.collect_set("service").alias("_there"), F.bool_or(F.col("unknown") > novel_share).alias("novel"), *facts)
    joined = scores.join(per, window, "left").join(F.broadcast(threshold))
    missing = F.array_except(F.array(*[F.lit(s) for s in sorted(expected)]), F.coalesce("_there", F.array().cast("array<string>")))
    out = joined.select("*", missing.alias("missing"), F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)).alias("ml_anomaly")).withColumn("novel", F.coalesce("novel", F.lit(False)))
    status = F.when(F.size("missing") > 0, "insufficient_telemetry").when(F.col("ml_anomaly") | F.col("novel"), "anomaly").otherwise("normal")
    suspect = F.coalesce(*[F.when(F.col(f"_rule{i}"), F.lit(name)) for i, (_, _, name) in enumerate(rules)], F.lit(None).cast("string"))
    return out.withColumn("status", status).select(window, "status", "ml_anomaly", "novel", "missing", F.when(F.col("status") == "anomaly", suspect).alias("suspect"))
