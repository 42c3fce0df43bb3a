"""Evaluation against labels: binary metrics, curves, incidents, intervals, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .ranking import GROUP_ROWS, quantiles, running_sums, value_buckets, with_quantiles
from .sequence import tail_ranks


def binary_metrics(df: DataFrame, truth: Column, alert: Column, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """tp, fp, fn, tn, precision, recall, f1 (0 where undefined) per key; a null alert never counts as one."""
    hit = F.coalesce(alert, F.lit(False))
    out = df.groupBy(*keys).agg(F.count_if(truth & hit).alias("tp"), F.count_if(~truth & hit).alias("fp"), F.count_if(truth & ~hit).alias("fn"), F.count_if(~truth & ~hit).alias("tn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def thresholds(df: DataFrame, score: str, truth: str) -> DataFrame:
    """score, tp, fp at or above each distinct score, p and n in all. Distinct scores are summed in ranges of scores."""
    distinct = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    sums = running_sums(distinct, [], value_buckets(distinct, "score"), [F.col("score").desc()], {"tp": "pos", "fp": "neg"}, descending=True)
    return sums.withColumnsRenamed({"tp_all": "p", "fp_all": "n"})


def average_precision(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Step-wise: the sum of precision times the rise of recall over distinct thresholds, ties merged."""
    return thresholds(df, score, truth).agg(F.sum(F.col("tp") / (F.col("tp") + F.col("fp")) * F.col("pos") / F.col("p")).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the curve by ranks, ties counted half."""
    return thresholds(df, score, truth).agg(F.sum((F.col("tp") - F.col("pos") / 2) * F.col("neg") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def curves(df: DataFrame, score: str, truth: str) -> DataFrame:
    t = thresholds(df, score, truth)
    return t.select("score", (F.col("tp") / F.col("p")).alias("recall"), (F.col("fp") / F.col("n")).alias("fall_out"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def cohort(windows: DataFrame, schedule: DataFrame, start: str = "window", end: str = "until") -> DataFrame:
    """healthy, fault or boundary of each window against its service's fault interval (a small table)."""
    joined = windows.join(F.broadcast(schedule), "service", "left")
    kind = F.when(F.col("onset").isNull() | (F.col(end) <= F.col("onset")) | (F.col(start) >= F.col("recovery")), "healthy").when((F.col(start) >= F.col("onset")) & (F.col(end) <= F.col("recovery")), "fault").otherwise("boundary")
    return joined.withColumn("cohort", kind)


def false_alert_rate(df: DataFrame, alert: str, width_seconds: float) -> DataFrame:
    healthy = df.where("cohort = 'healthy'")
    return healthy.agg(F.count(F.lit(1)).alias("healthy_windows"), F.count_if(F.col(alert)).alias("false_alerts")).withColumn("per_hour", ratio(F.col("false_alerts"), F.col("healthy_windows") * (width_seconds / 3600)))


def trial(df: DataFrame, alert: str, width_seconds: float) -> DataFrame:
    """Per service with a fault: recall of fault windows, detected, delay of the first alert, false alerts an hour."""
    fault, healthy, hit = F.col("cohort") == "fault", F.col("cohort") == "healthy", F.col(alert)
    out = df.where("onset IS NOT NULL").groupBy("service", "onset").agg(
        ratio(F.count_if(fault & hit), F.count_if(fault)).alias("recall"),
        F.max((fault & hit).cast("int")).alias("detected"),
        (F.min(F.when(fault & hit, F.col("until"))) - F.first("onset")).alias("delay"),
        ratio(F.count_if(healthy & hit), F.count_if(healthy) * (width_seconds / 3600)).alias("false_per_hour"),
    )
    return out.drop("onset")


def incident_outcome(opened: DataFrame, schedule: DataFrame, observed: int) -> DataFrame:
    """Per service: openings inside the fault, false openings, and the healthy exposure."""
    joined = schedule.join(opened, "service", "left")
    inside = F.col("opened_at").between(F.col("onset"), F.col("recovery"))
    return joined.groupBy("service").agg(F.count_if(inside).alias("for_fault"), F.count_if(F.col("opened_at").isNotNull() & ~inside).alias("false_openings"), (F.lit(observed) - F.first(F.col("recovery") - F.col("onset"))).cast("int").alias("exposure"))


def distribution(df: DataFrame, keys: list[str], value: str, threshold: float, group_rows: int = GROUP_ROWS) -> DataFrame:
    """keys, p50, p95 (exact; no task holds a large group's values), largest, over (values above the threshold)."""
    out = with_quantiles(df, keys, [F.max(value).alias("largest"), F.count_if(F.col(value) > threshold).alias("over")], value, {"p50": 0.5, "p95": 0.95}, group_rows)
    return out.select(*keys, "p50", "p95", "largest", "over")


def replay_equality(stored: DataFrame, replayed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows compared, rows that differ or are on one side only, and the largest difference."""
    a, b = stored.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l")), replayed.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    both = a.join(b, keys, "full_outer")
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"), F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("max_difference"))


def duplicates(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys that occur more than once: the same payload is a duplicate, different payloads are a conflict."""
    hashed = F.sha2(F.to_json(F.struct(*payload)), 256)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(hashed).alias("payloads")).where("n > 1").select(*keys, "n", F.when(F.col("payloads") > 1, "conflict").otherwise("duplicate").alias("kind"))


def shift_bounds(df: DataFrame, values: list[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """One row with the bounds of each value over healthy rows."""
    out = None
    for v in values:
        bounds = quantiles(df, v, [low, high]).toDF(f"{v}_low", f"{v}_high")
        out = bounds if out is None else out.join(F.broadcast(bounds))
    return out


def shift_score(df: DataFrame, bounds: DataFrame, values: list[str]) -> DataFrame:
    """Share of the values that lie outside their bounds (missing values are not counted)."""
    out = df.join(F.broadcast(bounds))
    outside = sum((((F.col(v) < F.col(f"{v}_low")) | (F.col(v) > F.col(f"{v}_high"))).cast("int") for v in values), F.lit(0))
    return out.withColumn("shift", outside / F.lit(len(values))).drop(*bounds.columns)


def higher_quantile(values: Column, q: float) -> Column:
    """The quantile of an array that is the next value at or above the exact place."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.ceil(F.lit(q) * (F.size(values) - 1)).cast("int") + 1)


def diagnosis_quality(df: DataFrame, keys: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rates of diagnoses per key, from rows with start, end, onset, recovery (null without a fault), target, valid, accepted,
    verdict, suspect, latency_ms, input_tokens and output_tokens. Windows that overlap the fault's begin or end count
    neither as healthy nor as faulty; a rate over no window is null."""
    c = F.col
    healthy = c("onset").isNull() | (c("end") <= c("onset")) | (c("start") >= c("recovery"))
    faulty = F.coalesce((c("start") >= c("onset")) & (c("end") <= c("recovery")), F.lit(False))
    share = lambda what, of=F.lit(True): F.avg(F.when(of, F.coalesce(what, F.lit(False)).cast("double")))
    review = c("verdict") == "review"
    rates = [
        F.count(F.lit(1)).alias("windows"),
        share(c("valid")).alias("valid"),
        share(c("accepted")).alias("accepted"),
        share(c("verdict") == "abstain").alias("abstained"),
        share(review, healthy).alias("healthy_review"),
        share(review, faulty).alias("fault_review"),
        share(review & (c("suspect") == c("target")), faulty).alias("right_suspect"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    ]
    return with_quantiles(df, keys, rates, "latency_ms", {"latency_p95": 0.95}, group_rows)


def snapshot_summary(snapshots: DataFrame, services: list[str]) -> DataFrame:
    """:func:`instance_summary` of snapshots with one row each and ``pods``, an array of service, uid, restarts."""
    rows = snapshots.withColumn("_snapshot", F.monotonically_increasing_id()).select("_snapshot", F.explode_outer("pods").alias("p"))
    return instance_summary(rows.select("_snapshot", "p.service", "p.uid", "p.restarts"), "_snapshot", services)


def instance_summary(pods: DataFrame, snapshot: str, services: list[str]) -> DataFrame:
    """service, instances, missing, restarts per expected service, from a row a snapshot and instance (service, uid, restarts;
    a snapshot without any has a row with nulls): different instances seen, snapshots without one, and most restarts of
    one. Snapshots and instances are counted in two steps, so no task holds those of a service or a snapshot."""
    total = pods.select(snapshot).distinct().agg(F.count(F.lit(1)).alias("_all"))
    there = pods.select("service", snapshot).distinct().groupBy("service").agg(F.count(F.lit(1)).alias("_present"))
    seen = pods.groupBy("service", "uid").agg(F.max("restarts").alias("restarts")).groupBy("service").agg(F.count("uid").alias("instances"), F.max("restarts").alias("restarts"))
    expected = pods.sparkSession.createDataFrame([(s,) for s in services], "service string")
    joined = expected.join(there, "service", "left").join(seen, "service", "left").join(F.broadcast(total))
    return joined.select("service", F.coalesce("instances", F.lit(0)).cast("long").alias("instances"), (F.col("_all") - F.coalesce("_present", F.lit(0))).alias("missing"), F.coalesce("restarts", F.lit(0)).alias("restarts"))


def coverage_summary(guard: DataFrame, run: str, window: str = "window") -> DataFrame:
    """Per run, and over all with a null run: windows with a coverage issue, services that had one, insufficient windows. guard
    has one row a run, window and service with insufficient and issue."""
    windows = guard.groupBy(run, window).agg(F.bool_or("issue").alias("_w"), F.bool_or("insufficient").alias("_i"))
    counts = windows.rollup(run).agg(F.count_if("_w").alias("warning_windows"), F.count_if("_i").alias("insufficient_windows"))
    services = guard.where("issue").rollup(run).agg(F.count_distinct("service").alias("warned_services"))
    joined = counts.join(services.withColumnRenamed(run, "_run"), F.col(run).eqNullSafe(F.col("_run")), "left")
    return joined.select(run, "warning_windows", "insufficient_windows", F.coalesce("warned_services", F.lit(0)).cast("long").alias("warned_services"))


def first_alert_outcome(df: DataFrame, schedule: DataFrame, strength: Column, tops: tuple[int, ...] = (1, 3)) -> DataFrame:
    """cases, recall, top1, top3, median_delay, from rows (service, window, until, warning) and a schedule (service, onset,
    recovery), one row a case: the first warning inside the fault, the faulty service's place by ``strength`` among all
    services of that window, and the time from onset to the window's end. Cases without a warning count in every share."""
    places = Window.partitionBy("window").orderBy(strength.desc(), "service")  # a window has a row a service
    ranked = df.withColumn("place", F.row_number().over(places))
    case = schedule.withColumn("_case", F.struct(*schedule.columns))
    hit = ranked.join(F.broadcast(case), "service").where(F.col("warning") & (F.col("window") >= F.col("onset")) & (F.col("window") < F.col("recovery")))
    first = hit.groupBy("_case").agg(F.min(F.struct("until", "place")).alias("first"))
    outcome = case.select("_case", "onset").join(first, "_case", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    within = [share(F.col("first.place") <= k).alias(f"top{k}") for k in tops]
    return outcome.agg(F.count(F.lit(1)).alias("cases"), share(F.col("first").isNotNull()).alias("recall"), *within, F.percentile(F.col("first.until") - F.col("onset"), F.lit(0.5)).alias("median_delay"))  # a row a case


def tail_decision(reference: DataFrame, queries: DataFrame, key: str, values: list[str], alpha: float) -> DataFrame:
    """key, least, abstained, warning: the least of the upper-tail ranks of a row's values, each among the reference rows that
    have the value: (1 + how many are as large) / (1 + how many there are). A row decides only with all values, and
    warns at alpha shared among them."""
    long = lambda df, *ids: df.select(*ids, F.explode(F.array(*[F.struct(F.lit(v).alias("operation"), F.col(v).alias("value")) for v in values])).alias("_e")).select(*ids, "_e.*").where("value IS NOT NULL")
    ranks = tail_ranks(long(reference), long(queries, key), "operation", "value")
    per = ranks.groupBy(key).agg(F.min("p").alias("least"), F.count(F.lit(1)).alias("_n"))
    out = queries.select(key).join(per, key, "left")
    whole = F.coalesce(F.col("_n") == len(values), F.lit(False))
    return out.select(key, "least", (~whole).alias("abstained"), (whole & (F.col("least") <= alpha / len(values))).alias("warning"))


def guardrail(healthy: DataFrame, df: DataFrame, score: str, q: float) -> DataFrame:
    """df with ``cutoff``, the next score at or above the place of the quantile among the healthy rows, and ``flagged``."""
    counts = healthy.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    sums = running_sums(counts, [], value_buckets(counts, "_v"), [F.col("_v")], {"_upto": "_n"})
    cutoff = sums.agg(F.min(F.when(F.col("_upto") > F.ceil(F.lit(q) * (F.col("_upto_all") - 1)), F.col("_v"))).alias("cutoff"))
    return df.join(F.broadcast(cutoff)).withColumn("flagged", F.col(score) > F.col("cutoff"))


def trial_match(df: DataFrame, schedule: DataFrame, strength: Column) -> DataFrame:
    """service, delay, named, matched of each case of a schedule: the first warning of any service inside the fault (of one
    window's the strongest, then by name), and whether it is the faulty service's."""
    case = schedule.withColumnsRenamed({"service": "_target"})
    hits = df.withColumn("_strength", strength).join(F.broadcast(case), F.col("warning") & (F.col("window") >= F.col("onset")) & (F.col("window") < F.col("recovery")))  # a schedule is few rows
    first = hits.groupBy("_target", "onset", "recovery").agg(F.min(F.struct("until", (-F.col("_strength")).alias("_s"), "service")).alias("f"))
    out = case.join(F.broadcast(first), ["_target", "onset", "recovery"], "left")
    return out.select(F.col("_target").alias("service"), (F.col("f.until") - F.col("onset")).alias("delay"), F.col("f.service").alias("named"), F.coalesce(F.col("f.service") == F.col("_target"), F.lit(False)).alias("matched"))


def source_coverage(cells: DataFrame, sources: dict[str, DataFrame], keys: list[str], window: list[str]) -> DataFrame:
    """level, service, rows and a count for each source: one row of level ``window`` with the windows in which any service has
    the source, and one of level ``service`` for each service with its windows and its observations of the source. Keys
    are the window's and service; the sources' rows are counted by key before they meet."""
    marked = cells.select(*keys).distinct().select("*", *[F.lit(0).cast("long").alias(n) for n in sources])
    for name, frame in sources.items():
        counted = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        marked = marked.unionByName(counted.select(*keys, *[(F.col("_n") if n == name else F.lit(0).cast("long")).alias(n) for n in sources]))
    per = marked.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sources])
    windows = per.groupBy(*window).agg(*[F.max(F.col(n) > 0).alias(n) for n in sources])
    whole = windows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(n).alias(n) for n in sources])
    services = per.groupBy("service").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(n).alias(n) for n in sources])
    columns = ["level", "service", "rows", *sources]
    return whole.select(F.lit("window").alias("level"), F.lit(None).cast("string").alias("service"), "rows", *sources).select(columns).unionByName(services.withColumn("level", F.lit("service")).select(columns))


def replay(scored: DataFrame, threshold: DataFrame, window: list[str], features: list[str], candidates: int = 5, changes: int = 3) -> DataFrame:
    """window, score (the largest), threshold, alert and the first ``candidates`` services by score (of equal ones by name) with
    their ``changes`` most changed features, of equal ones the first. scored has service, score and ``<feature>_change``;
    threshold is one row. A row without a score is no candidate."""
    place = F.row_number().over(Window.partitionBy(*window).orderBy(F.round("score", 9).desc(), "service"))  # a window has a row a service
    first = scored.where("score IS NOT NULL").withColumn("_r", place).where(F.col("_r") <= candidates)
    pairs = F.array(*[F.struct((-F.coalesce(F.round(f"{f}_change", 9), F.lit(0.0))).alias("k"), F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f"{f}_change").alias("value")) for i, f in enumerate(features)])
    top = F.transform(F.slice(F.array_sort(pairs), 1, changes), lambda x: x.dropFields("k", "i"))
    each = F.struct("_r", "service", "score", top.alias("changes"))
    per = first.groupBy(*window).agg(F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(each)), lambda x: x.dropFields("_r")).alias("candidates"))
    return per.join(F.broadcast(threshold)).select(*window, "score", "threshold", (F.col("score") > F.col("threshold")).alias("alert"), "candidates")
