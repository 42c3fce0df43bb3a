"""Order-dependent operators: streaks, gaps, incidents, rankings, running state, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hash_places, running_sums, value_buckets

ALL_BEFORE = (Window.unboundedPreceding, Window.currentRow)


def streaks(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Adds ``streak``: how many rows in a row the flag has held, 0 where it does not. Rows must be dense in ``order``."""
    by = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_island", F.sum((~F.col(flag)).cast("long")).over(by.rowsBetween(*ALL_BEFORE)))
    inside = Window.partitionBy(*keys, "_island").orderBy(order).rowsBetween(*ALL_BEFORE)
    return marked.withColumn("streak", F.sum(F.col(flag).cast("long")).over(inside)).drop("_island")


def persistent(df: DataFrame, keys: list[str], order: str, flag: str, least: int = 2) -> DataFrame:
    return streaks(df, keys, order, flag).withColumn("alert", F.col("streak") >= least)


def longest_gap(df: DataFrame, keys: list[str], order: str, present: str) -> DataFrame:
    """The longest run of rows without presence."""
    gaps = streaks(df.withColumn("_absent", ~F.col(present)), keys, order, "_absent")
    return gaps.groupBy(*keys).agg(F.max("streak").alias("longest_gap"))


def coverage_guard(df: DataFrame, expected: DataFrame, time: str = "window", required: float = 0.8) -> DataFrame:
    """df: one row per expected service and window with ``seen``. A window with less than ``required`` of the services is
    insufficient and resets every gap; else a service's gap counts its absent windows; at its threshold an issue opens."""
    cover = df.groupBy(time).agg(F.avg(F.col("seen").cast("double")).alias("coverage"))
    with_cover = df.join(cover, time).withColumn("insufficient", F.col("coverage") < required)
    gaps = streaks(with_cover.withColumn("_gap", ~F.col("seen") & ~F.col("insufficient")), ["service"], time, "_gap").drop("_gap")
    return gaps.join(expected, "service").withColumnRenamed("streak", "gap").withColumn("issue", (F.col("gap") >= F.col("threshold")) & (F.col("gap") > 0))


def incident_transitions(df: DataFrame, keys: list[str], start: str, end: str, warning: str) -> DataFrame:
    """Openings (second warning in a row) and closings (second clear in a row), without repeats of the same kind. One row
    per transition with the time it was decided (the window's end)."""
    both = streaks(streaks(df, keys, start, warning).withColumnRenamed("streak", "_warn").withColumn("_ok", ~F.col(warning)), keys, start, "_ok")
    marks = both.where((F.col("_warn") == 2) | (F.col("streak") == 2)).withColumn("kind", F.when(F.col("_warn") == 2, "open").otherwise("close"))
    before = F.lag("kind").over(Window.partitionBy(*keys).orderBy(start))
    kept = marks.withColumn("_last", F.coalesce(before, F.lit("close"))).where("kind <> _last")
    return kept.select(*keys, F.col(start).alias("start"), F.col(end).alias("at"), "kind")


def episodes(transitions: DataFrame, keys: list[str]) -> DataFrame:
    """opened_at, closed_at (null while open) of each incident."""
    by = Window.partitionBy(*keys).orderBy("at")
    return transitions.withColumn("closed_at", F.lead("at").over(by)).where("kind = 'open'").select(*keys, F.col("at").alias("opened_at"), "closed_at")


def first_alerts(df: DataFrame, keys: list[str], end: str, alert: str) -> DataFrame:
    return df.where(alert).groupBy(*keys).agg(F.min(end).alias("first_alert"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def running_max(df: DataFrame, keys: list[str], order: str, operation: str, value: str, operations: list[str]) -> DataFrame:
    """After each row, the largest value of each operation so far in its key, null before its first."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(*ALL_BEFORE)
    return df.select(*keys, order, *[F.max(F.when(F.col(operation) == o, F.col(value))).over(so_far).alias(f"max_{i}") for i, o in enumerate(operations)])


def stitch_lines(df: DataFrame, keys: list[str], order: str, text: str, is_start: Column) -> DataFrame:
    """Joins unstamped lines to the stamped line before them; those before the first are event 0."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(*ALL_BEFORE)
    numbered = df.withColumn("event", F.sum(is_start.cast("long")).over(by))
    grouped = numbered.groupBy(*keys, "event").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_l"))
    return grouped.select(*keys, "event", F.size("_l").alias("lines"), F.array_join(F.transform("_l", lambda x: x["t"]), "\n").alias("message"))


def transition_counts(tokens: DataFrame, session: str, order: list[str], token: str) -> DataFrame:
    """left, right, n: bigram counts with a begin (-1) and an end (-2) token in each session."""
    by = Window.partitionBy(session).orderBy(*order)
    pairs = tokens.select(session, F.coalesce(F.lag(token).over(by), F.lit("-1")).alias("left"), F.col(token).alias("right"), F.lead(token).over(by).alias("_next"))
    ends = pairs.where("_next IS NULL").select(F.col("right").alias("left"), F.lit("-2").alias("right"))
    return pairs.select("left", "right").unionByName(ends).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def transition_score(tokens: DataFrame, model: DataFrame, session: str, order: list[str], token: str, vocabulary: int, smoothing: float = 0.1) -> DataFrame:
    """Mean negative log-likelihood of each session's transitions under smoothed counts."""
    by = Window.partitionBy(session).orderBy(*order)
    pairs = tokens.select(session, F.coalesce(F.lag(token).over(by), F.lit("-1")).alias("left"), F.col(token).alias("right"), F.lead(token).over(by).alias("_next"))
    both = pairs.select(session, "left", "right").unionByName(pairs.where("_next IS NULL").select(session, F.col("right").alias("left"), F.lit("-2").alias("right")))
    totals = model.groupBy("left").agg(F.sum("n").alias("total"))
    scored = both.join(model, ["left", "right"], "left").join(totals, "left", "left")
    p = (F.coalesce("n", F.lit(0)) + smoothing) / (F.coalesce("total", F.lit(0)) + smoothing * vocabulary)
    return scored.groupBy(session).agg(F.avg(-F.log(p)).alias("score"), F.count(F.lit(1)).alias("transitions"))


def sequence_status(df: DataFrame, keys: list[str], order: str, arrival: str, step: int) -> DataFrame:
    """ok, duplicate, late or gap for each message, against the largest ``order`` that came before it."""
    by = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(order).over(by)
    kind = F.when(last.isNull() | (F.col(order) == last + step), "ok").when(F.col(order) == last, "duplicate").when(F.col(order) < last, "late").otherwise("gap")
    return df.select(*keys, order, arrival, kind.alias("status"))


def tail_ranks(reference: DataFrame, query: DataFrame, operation: str, value: str) -> DataFrame:
    """query rows with p = (1 + references at or above the value) / (1 + references) in their operation. Counts by distinct
    value first, so the ordered window sees each value once and not each row."""
    counts = reference.groupBy(operation, value).agg(F.count(F.lit(1)).alias("_r")).unionByName(query.select(operation, value).distinct().withColumn("_r", F.lit(0).cast("long")))
    distinct = counts.groupBy(operation, value).agg(F.sum("_r").alias("_r"))
    sums = running_sums(distinct, [operation], value_buckets(distinct, value), [F.col(value).desc()], {"above": "_r"}, descending=True)
    table = sums.select(operation, value, ((1 + F.col("above")) / (1 + F.col("above_all"))).alias("p"))
    return query.join(table, [operation, value], "left")


def hash_split(df: DataFrame, group: str, key: Column, cuts: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """train, validation or test by the order of sha256(key) within the group."""
    ranked = hash_places(df.withColumn("_h", F.sha2(key, 256)), [group], "_h")
    at = lambda c: F.floor(F.col("rows") * F.lit(c))
    i = F.col("place")
    return ranked.withColumn("split", F.when(i < at(cuts[0]), "train").when(i < at(cuts[1]), "validation").otherwise("test")).drop("_h", "place", "rows")


def parity_split(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("split", (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 2).cast("int"))


def chronological_split(df: DataFrame, time: str, share: float = 0.7) -> DataFrame:
    bounds = df.agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    cut = F.col("_a") + share * (F.col("_b") - F.col("_a"))
    return df.join(F.broadcast(bounds)).withColumn("split", F.when(F.col(time) <= cut, "train").otherwise("validation")).drop("_a", "_b")


def spaced_sample(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k evenly spaced rows of each key, first and last included."""
    by = Window.partitionBy(*keys)
    n, i = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(*order)) - 1
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / (k - 1)))
    return df.withColumn("_n", n).withColumn("_i", i.cast("long")).where(F.array_contains(at, F.col("_i"))).drop("_n", "_i")
