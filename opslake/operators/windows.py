"""Per-service windows: aggregates, dense spines, joins of modalities, causal normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clipped_change, finite, ratio, robust_scale, unusual_status
from ..functions.text import has_error_word
from .ranking import GROUP_ROWS, key_join, quantile_columns, with_quantiles

WARMUP = 5


def complete_bounds(df: DataFrame, time: str, width: int, keys: list[str]) -> DataFrame:
    """keys, first, last: bounds of the windows that the data cover whole."""
    return df.groupBy(*keys).agg((F.ceil(F.min(time) / width) * width).cast("long").alias("first"), (F.floor(F.max(time) / width) * width).cast("long").alias("last"))


def metric_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over finite values; a window with none is null."""
    return df.groupBy(*keys).agg(F.avg(finite(F.col(value))).alias("mean"), F.count(finite(F.col(value))).alias("observations"))


def unpivot_metrics(df: DataFrame, ids: list[str], kinds: list[str]) -> DataFrame:
    """Wide ``<service>_<kind>`` columns to rows (ids, service, kind, value); other kinds are left out."""
    columns = [c for c in df.columns if c not in ids and c.rpartition("_")[2] in kinds]
    long = df.unpivot(ids, columns, "name", "value")
    return long.select(*ids, F.regexp_extract("name", "^(.*)_([^_]*)$", 1).alias("service"), F.regexp_extract("name", "^(.*)_([^_]*)$", 2).alias("kind"), "value")


def log_counts(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """Lines, lines with an error word, log volume and error rate."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.count_if(has_error_word(F.col(message))).alias("errors"))
    return out.withColumn("log_volume", F.log1p("lines")).withColumn("error_rate", ratio(F.col("errors"), F.col("lines")))


def span_sums(df: DataFrame, keys: list[str], duration: str, status: str) -> DataFrame:
    """Partial sums of spans; merging them is :func:`merge_span_sums`, which the two-phase aggregate also does."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spans"),
        F.sum(duration).alias("duration"),
        F.max(duration).alias("longest"),
        F.count_if(unusual_status(F.col(status))).alias("unusual"),
        F.count(status).alias("known"),
    )


def merge_span_sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("spans", "duration")], F.max("longest").alias("longest"), *[F.sum(c).alias(c) for c in ("unusual", "known")])


def span_ratios(sums: DataFrame) -> DataFrame:
    return sums.select(
        *[c for c in sums.columns if c not in ("spans", "duration", "longest", "unusual", "known")],
        F.log1p("spans").alias("span_volume"),
        ratio(F.col("duration"), F.col("spans")).alias("mean_duration"),
        F.coalesce(F.col("longest"), F.lit(0.0)).alias("longest"),
        ratio(F.col("unusual"), F.col("known")).alias("unusual_rate"),
        ratio(F.col("known"), F.col("spans")).alias("known_rate"),
        (F.col("spans") > 0).cast("int").alias("present"),
    )


def request_aggregates(width: float) -> list[Column]:
    """p95 duration (linear), error fraction, requests per second, most active requests, count."""
    return [
        F.percentile("duration", F.lit(0.95)).alias("p95"),
        F.avg(F.coalesce((F.col("status") >= 400).cast("double"), F.lit(0.0))).alias("error_fraction"),
        (F.count(F.lit(1)) / F.lit(width)).alias("rps"),
        F.max("active").alias("max_active"),
        F.count(F.lit(1)).alias("requests"),
    ]


def request_windows(requests: DataFrame, width: float, keys: list[str] = ["service", "window"], group_rows: int | None = None) -> DataFrame:  # noqa: B006
    """The aggregates of each window. With ``group_rows`` no task holds more values of a window than that."""
    p95, *rest = request_aggregates(width)
    if group_rows:
        return with_quantiles(requests, keys, rest, "duration", {"p95": 0.95}, group_rows)
    return requests.groupBy(*keys).agg(p95, *rest)


def spine(keys: DataFrame, first: int, last: int, name: str = "window") -> DataFrame:
    """Every key with every window of [first, last]: no join, an array is exploded."""
    return keys.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(last))))


def dense(frame: DataFrame, grid: DataFrame, keys: list[str], zeros: list[str]) -> DataFrame:
    """The grid with the frame's values, zero where the frame has no row."""
    return grid.join(frame, keys, "left").select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zeros else F.col(c) for c in frame.columns if c not in keys])


def modality_union(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per key of any modality, with a 0/1 flag per modality, in one aggregate instead of outer joins."""
    marked = None
    for name, frame in frames.items():
        part = frame.select(*keys, F.lit(name).alias("_m"))
        marked = part if marked is None else marked.unionByName(part)
    return marked.groupBy(*keys).agg(*[F.max((F.col("_m") == m).cast("int")).alias(f"{m}_present") for m in frames])


def causal_change(frame: DataFrame, keys: list[str], window: str, values: list[str], warmup: int = WARMUP) -> DataFrame:
    """Per key and value the clipped change against the median and scale of its first ``warmup`` windows. A value that
    is missing in the whole warm-up is 0 everywhere and counts as missing."""
    base = frame.where(F.col(window) < warmup).groupBy(*keys).agg(*[F.percentile(v, F.lit(0.5)).alias(f"{v}_center") for v in values], *[F.stddev_pop(v).alias(f"{v}_spread") for v in values])
    out = frame.join(base, keys, "left")
    changes = [clipped_change(F.col(v), F.col(f"{v}_center"), robust_scale(F.col(f"{v}_center"), F.col(f"{v}_spread"))).alias(f"{v}_change") for v in values]
    missing = sum((F.col(f"{v}_center").isNull().cast("int") for v in values), F.lit(0))
    return out.select(*keys, window, *changes, missing.alias("columns_missing"))


def healthy_reference(frame: DataFrame, keys: list[str], values: list[str], group_rows: int | None = None) -> DataFrame:
    """Median, scale and number of finite values per key: the small table that later windows are compared with. With
    ``group_rows`` no task holds more values of a key than that (also in the two functions below)."""
    x = {v: finite(F.col(v).cast("double")) for v in values}
    centers = quantile_columns(frame, keys, {f"{v}_center": (x[v], 0.5) for v in values}, group_rows)
    sums = frame.groupBy(*keys).agg(*[a for v in values for a in (F.stddev_pop(x[v]).alias(f"_{v}_spread"), F.count(x[v]).alias(f"{v}_n"))])
    joined = key_join(sums, centers, keys)
    return joined.select(*keys, *[a for v in values for a in (f"{v}_center", robust_scale(F.col(f"{v}_center"), F.col(f"_{v}_spread")).alias(f"{v}_scale"), f"{v}_n")])


def mad_reference(frame: DataFrame, keys: list[str], values: list[str], floors: list[float], group_rows: int | None = None) -> DataFrame:
    """Median and floored median absolute deviation per key, in two passes over the frame. Without keys they are those of the
    whole frame, in one row; its medians are plain numbers in the second pass, as a join without a key may be a product."""
    medians = quantile_columns(frame, keys, {f"{v}_center": (F.col(v), 0.5) for v in values}, group_rows)
    if not keys:
        row = medians.first()
        center = {v: F.lit(row[f"{v}_center"]).cast("double") for v in values}
        spread = quantile_columns(frame, [], {f"{v}_scale": (F.abs(F.col(v) - center[v]), 0.5) for v in values}, group_rows)
        return spread.select(*[c.alias(f"{v}_center") for v, c in center.items()], *[F.greatest(f"{v}_scale", F.lit(f)).alias(f"{v}_scale") for v, f in zip(values, floors)])
    near = frame.join(medians, keys)
    spread = quantile_columns(near, keys, {f"{v}_scale": (F.abs(F.col(v) - F.col(f"{v}_center")), 0.5) for v in values}, group_rows)
    return medians.join(spread.select(*keys, *[F.greatest(f"{v}_scale", F.lit(f)).alias(f"{v}_scale") for v, f in zip(values, floors)]), keys)


def envelopes(frame: DataFrame, latency_factor: float = 2.0, latency_floor: float = 50.0, error_margin: float = 0.05, group_rows: int | None = None) -> DataFrame:
    """Operating limits per service from healthy windows."""
    high = quantile_columns(frame, ["service"], {"_p95": (F.col("p95"), 0.99), "_errors": (F.col("error_fraction"), 0.99)}, group_rows)
    return high.select("service", F.greatest(F.col("_p95") * latency_factor, F.lit(latency_floor)).alias("latency_limit"), F.greatest(F.col("_errors") + error_margin, F.lit(error_margin)).alias("error_limit"))


def counter_rates(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Rates of a counter between neighbouring times. The first row of a series has none; a decrease is a reset (null) and
    the new previous value; of equal times the first value stays."""
    series = Window.partitionBy(*keys).orderBy(time)
    distinct = df.groupBy(*keys, time).agg(F.min_by(value, value).alias(value))
    before_v, before_t = F.lag(value).over(series), F.lag(time).over(series)
    rated = distinct.select(*keys, time, F.col(value), before_v.alias("_v"), before_t.alias("_t"))
    rate = F.when(F.col(value) >= F.col("_v"), (F.col(value) - F.col("_v")) / (F.col(time) - F.col("_t")))
    return rated.where("_t IS NOT NULL").select(*keys, time, rate.alias("rate"), (F.col(value) < F.col("_v")).alias("reset"))


def history(frame: DataFrame, keys: list[str], window: str, values: list[str], length: int = 5) -> DataFrame:
    """The values of the last ``length`` windows of a dense frame, oldest first, zeros before the first."""
    over = Window.partitionBy(*keys).orderBy(window)
    return frame.select(*keys, window, *[F.array(*[F.coalesce(F.lag(v, k).over(over), F.lit(0.0)) for k in range(length - 1, -1, -1)]).alias(f"{v}_history") for v in values])


def context_features(frame: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each row's log1p values with the mean and maximum over the rows of its window (keys)."""
    together = Window.partitionBy(*keys)
    own = [F.log1p(F.greatest(F.col(v), F.lit(0.0))).alias(f"{v}_log") for v in values]
    around = [f(F.log1p(F.greatest(F.col(v), F.lit(0.0)))).over(together).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("max", F.max))]
    return frame.select(*[c for c in frame.columns if c not in values], *own, *around)
