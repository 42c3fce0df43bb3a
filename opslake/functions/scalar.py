"""Scalar rules of telemetry: missing values, robust change, statuses, ratios, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite: Spark's aggregates would take NaN as the largest value."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clipped_change(x: Column, center: Column, scale: Column, limit: float = 100.0) -> Column:
    """Distance to the center in scales, within [0, limit]; missing is 0."""
    return F.coalesce(F.least(F.greatest(F.abs(x - center) / scale, F.lit(0.0)), F.lit(limit)), F.lit(0.0))


def robust_scale(center: Column, spread: Column) -> Column:
    return F.greatest(spread, F.abs(center) * 0.05, F.lit(1e-6))


def unusual_status(status: Column) -> Column:
    """A known status that is neither 0 nor from 200 to 399; unknown is never unusual."""
    return status.isNotNull() & (status != 0) & ((status < 200) | (status >= 400))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def max_residual(values: list[Column], centers: list[Column], scales: list[Column]) -> Column:
    """Largest absolute distance in scales over the values that are there; null if none is."""
    return F.greatest(*[F.abs(v - c) / s for v, c, s in zip(values, centers, scales)])


def rfc3339(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normal_duration_us(duration: Column, unit: Column) -> Column:
    return F.when(unit == "ms", duration * 1000.0).otherwise(duration)


def normal_status(text: Column, failed: Column) -> tuple[Column, Column]:
    """Status code and where it comes from: the code that the text names, else 500 or 0 for a flag that says whether the
    call failed, else unknown. An empty text names none."""
    code = F.nullif(F.trim(text), F.lit("")).try_cast("int")
    from_flag = F.when(failed, 500).when(~failed, 0)
    source = F.when(code.isNotNull(), "status code").when(failed.isNotNull(), "error flag").otherwise("unavailable")
    return F.coalesce(code, from_flag), source


def missing_share(values: list[Column]) -> Column:
    """The share of the values that are null."""
    return sum((v.isNull().cast("int") for v in values), F.lit(0)) / F.lit(len(values))


def observable(flags: list[tuple[Column, list[int]]]) -> Column:
    """Indices of the dimensions whose source flag holds."""
    return F.array_sort(F.flatten(F.array(*[F.when(f, F.array(*[F.lit(i) for i in dims])).otherwise(F.array().cast("array<int>")) for f, dims in flags])))
