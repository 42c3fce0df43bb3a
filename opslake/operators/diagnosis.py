"""What a diagnosis may cite, and whether one can be accepted: contexts of predictions and validation of diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the diagnosis format.
STATUSES = ["clear", "review", "abstain"]
RUNBOOKS = ["latency", "local_error", "dependency", "coverage", "none"]
DIAGNOSIS = "status string, suspected_service string, evidence_ids array<string>, runbook_id string, summary string"

SLOW_MS = 100
EVIDENCE_EACH = 2


def contexts(candidates: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """One row a prediction (keys): ``citations``, of which each has id, service and dependency; ``runbooks`` that the
    observations support; ``services`` that may be named; ``alert``; ``absent``, whether no candidate has any request.

    candidates: keys, place (their order), service, requests, alert. events: keys, service, span, status, duration,
    dependency. A candidate's first two events (failed ones, then the slowest) are E1.., numbered over the candidates in
    order; its measured window is M1.. . A prediction's candidates are as many as there are services."""
    order = [F.coalesce(F.col("status") >= 400, F.lit(False)).desc(), F.col("duration").desc(), "span"]
    top = events.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "service").orderBy(*order))).where(F.col("_i") <= EVIDENCE_EACH)  # limited in each task first
    shown = top.groupBy(*keys, "service").agg(F.array_sort(F.collect_list(F.struct("_i", "span", "status", "duration", "dependency"))).alias("_shown"))
    rows = candidates.join(shown, [*keys, "service"], "left")
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "service", "requests", "alert", F.coalesce("_shown", F.array().cast(shown.schema["_shown"].dataType)).alias("shown")))).alias("c"))
    seen = F.flatten(F.transform("c", lambda c: F.transform(c["shown"], lambda e: F.struct(c["service"].alias("service"), e["status"].alias("status"), e["duration"].alias("duration"), e["dependency"].alias("dependency")))))
    failed = lambda e: F.coalesce(e["status"] >= 400, F.lit(False))
    cited = lambda letter, of, dependency: F.transform(of, lambda e, i: F.struct(F.concat(F.lit(letter), (i + 1).cast("string")).alias("id"), e["service"].alias("service"), dependency(e).alias("dependency")))
    supported = [
        ("coverage", F.exists("c", lambda c: c["requests"] == 0)),
        ("dependency", F.exists("seen", lambda e: failed(e) & e["dependency"].isNotNull())),
        ("latency", F.exists("seen", lambda e: e["duration"] > SLOW_MS)),
        ("local_error", F.exists("seen", lambda e: failed(e) & e["dependency"].isNull())),
        ("none", F.lit(True)),
    ]
    return per.withColumn("seen", seen).select(
        *keys,
        F.concat(cited("E", F.col("seen"), lambda e: e["dependency"]), cited("M", F.col("c"), lambda e: F.lit(None).cast("string"))).alias("citations"),
        F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in supported])).alias("runbooks"),
        F.array_union(F.transform("c", lambda c: c["service"]), F.array_compact(F.transform("seen", lambda e: e["dependency"]))).alias("services"),
        F.exists("c", lambda c: c["alert"]).alias("alert"),
        F.forall("c", lambda c: c["requests"] == 0).alias("absent"),
    )


def validated(diagnoses: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnoses (keys, ``answer``: JSON) with ``accepted``, ``status`` (abstain where rejected) and ``reason``, the first
    that holds: malformed, review without citation, clear naming a fault, duplicate citation, unknown citation, unknown
    service, runbook not available, unrelated citation, clear against an alert, review without an alert, review of
    absent sources."""
    d, ids = F.col("d"), F.col("d.evidence_ids")
    review, clear, named = d["status"] == "review", d["status"] == "clear", d["suspected_service"]
    bad: Column = d.isNull() | ~F.coalesce(d["status"].isin(STATUSES), F.lit(False)) | ids.isNull() | F.exists(ids, lambda i: i.isNull()) | (F.size(ids) > 6)
    bad |= ~F.coalesce(d["runbook_id"].isin(RUNBOOKS), F.lit(False)) | ~F.coalesce(F.length(d["summary"]).between(1, 600), F.lit(False)) | (F.length(named) > 128)
    cited = F.filter("citations", lambda c: F.array_contains(ids, c["id"]))
    related = F.exists(cited, lambda c: (c["service"] == named) | F.coalesce(c["dependency"] == named, F.lit(False)))
    rules = [
        (bad, "malformed"),
        (review & (F.size(ids) == 0), "review without citation"),
        (clear & (named.isNotNull() | (d["runbook_id"] != "none")), "clear naming a fault"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "duplicate citation"),
        (F.size(F.array_except(ids, F.transform("citations", lambda c: c["id"]))) > 0, "unknown citation"),
        (named.isNotNull() & ~F.array_contains("services", named), "unknown service"),
        (~F.array_contains("runbooks", d["runbook_id"]), "runbook not available"),
        (named.isNotNull() & (F.size(ids) > 0) & ~related, "unrelated citation"),
        (clear & F.col("alert"), "clear against an alert"),
        (review & ~F.col("alert"), "review without an alert"),
        (review & F.col("absent"), "review of absent sources"),
    ]
    joined = diagnoses.withColumn("d", F.from_json("answer", DIAGNOSIS)).join(known, keys)
    reason = F.coalesce(*[F.when(c, F.lit(name)) for c, name in rules])
    out = joined.withColumn("reason", reason)
    return out.select(*keys, F.col("reason").isNull().alias("accepted"), F.when(F.col("reason").isNull(), d["status"]).otherwise("abstain").alias("status"), "reason")
