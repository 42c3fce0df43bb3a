"""The 18 features of a service-window from metrics, logs and spans, and short histories of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clipped_change, finite, missing_share, ratio, robust_scale
from .windows import span_sums

#: Raw dimensions r0 to r13: eight metrics, log volume and error share, span volume, mean and longest duration, unusual share.
METRICS, RAW = 8, 14
#: Places of the 18 features that say whether a source is there, and of the share of missing metrics.
LOGS_AT, TRACES_AT, MISSING_AT, FEATURES = 10, 15, 17, 18


def raw_dimensions(grid: DataFrame, metrics: DataFrame, logs: DataFrame, spans: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """keys, r0 to r13 and known (share of spans with a status) of every row of the grid; what a source does not say is null.

    metrics has keys, kind and value (means of finite values; at most eight kinds, in their order), logs keys and error
    (boolean), spans keys, duration and status. Each source is aggregated by the keys before it meets the grid."""
    means = metrics.groupBy(*keys).agg(*[F.avg(F.when(F.col("kind") == k, finite(F.col("value").cast("double")))).alias(f"r{i}") for i, k in enumerate(kinds[:METRICS])])
    lines = logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lines"), F.count_if("error").alias("_errors"))
    joined = grid.select(*keys).join(means, keys, "left").join(lines, keys, "left").join(span_sums(spans, keys, "duration", "status"), keys, "left")
    there = {f"r{i}": F.col(f"r{i}") for i in range(len(kinds[:METRICS]))}
    there |= {"r8": F.log1p("_lines"), "r9": F.col("_errors") / F.col("_lines")}
    there |= {"r10": F.log1p("spans"), "r11": F.col("duration") / F.col("spans"), "r12": F.col("longest").cast("double"), "r13": F.col("unusual") / F.nullif(F.col("known"), F.lit(0))}
    none = F.lit(None).cast("double")
    known = ratio(F.col("known"), F.coalesce("spans", F.lit(0)))
    return joined.select(*keys, *[there.get(f"r{i}", none).alias(f"r{i}") for i in range(RAW)], known.alias("known"))


def reference_dimensions(healthy: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c0 to c13, s0 to s13: medians and floored spreads of raw dimensions; null where no row has the dimension."""
    out = []
    for i in range(RAW):
        center = F.percentile(f"r{i}", F.lit(0.5))
        out += [center.alias(f"c{i}"), F.when(center.isNotNull(), robust_scale(center, F.stddev_pop(f"r{i}"))).alias(f"s{i}")]
    return healthy.groupBy(*keys).agg(*out)


def scaled_features(raw: DataFrame, reference: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """keys, features: changes of the eight metrics, of the logs and whether there are any, of the spans, whether there are
    any and their share with a status, and the share of missing metrics. A source counts as there only if it is in the
    window and the reference of ``by`` knows all its dimensions (of spans the first three); a metric that is missing on
    either side has no change. Keys without a reference have no source at all."""
    joined = raw.join(reference, by, "left")
    has = lambda dims: sum((F.col(f"c{i}").isNull().cast("int") for i in dims), F.lit(0)) == 0
    logs, spans = F.col("r8").isNotNull() & has((8, 9)), F.col("r10").isNotNull() & has((10, 11, 12))
    change = lambda i: clipped_change(F.col(f"r{i}"), F.col(f"c{i}"), F.col(f"s{i}"))
    only = lambda there, c: F.when(there, c).otherwise(F.lit(0.0))
    missing = missing_share([F.col(f"r{i}") + F.col(f"c{i}") for i in range(METRICS)])
    columns = [
        *[change(i) for i in range(METRICS)],
        *[only(logs, change(i)) for i in (8, 9)],
        logs.cast("double"),
        *[only(spans, change(i)) for i in (10, 11, 12, 13)],
        spans.cast("double"),
        only(spans, F.col("known")),
        missing,
    ]
    return joined.select(*keys, F.array(*columns).alias("features"))


def observed(features: Column) -> Column:
    """Whether any source is there."""
    return (features[MISSING_AT] < 1) | (features[LOGS_AT] > 0) | (features[TRACES_AT] > 0)


def histories(df: DataFrame, keys: list[str], window: str, length: int = 5) -> DataFrame:
    """df with ``history``: the features of the last ``length`` windows of a dense frame one after another, oldest first,
    zeros before the first."""
    over = Window.partitionBy(*keys).orderBy(window)
    zeros = F.array_repeat(F.lit(0.0), FEATURES)
    return df.withColumn("history", F.flatten(F.array(*[F.coalesce(F.lag("features", k).over(over), zeros) for k in range(length - 1, -1, -1)])))
