"""Sums and places in an order, for keys of any size: no key's rows need to fit into one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value_buckets(df: DataFrame, value: str) -> Column:
    """Number of the bucket that a value lies in, in the order of values: as many buckets of about equal size as there are
    shuffle partitions. The bounds are plain numbers, so a task that runs again sees the same ones. Null is bucket 0."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(value, F.lit([i / n for i in range(1, n)]) if n > 1 else F.lit([0.5]), 10_000)).first()[0] or []
    below = F.lit(0)
    if bounds:
        below = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(value)))
    return F.when(F.col(value).isNull(), 0).otherwise(1 + below)


def running_sums(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds for each ``name: column`` of sums the sum of the column over the rows of the key up to this one, and its sum over
    the whole key as ``<name>_all``. ``bucket`` numbers ranges of the order (``descending`` if the order runs from the
    last bucket to the first); rows are summed inside their bucket and take over the sums of the buckets before."""
    marked = df.withColumn("_bucket", bucket)
    totals = marked.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    step = F.col("_bucket").desc() if descending else F.col("_bucket")
    earlier = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    before = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in sums], *[F.sum(f"_{n}").over(whole).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.select("*", *[F.sum(c).over(inside).alias(f"_{n}_inside") for n, c in sums.items()])
    on = F.col("_bucket") == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = summed.join(before, on)
    return joined.select(*df.columns, *[(F.col(f"_{n}_before") + F.col(f"_{n}_inside")).alias(n) for n in sums], *[f"{n}_all" for n in sums])


def hash_places(df: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Adds ``place`` (from 0) and ``rows`` of each row in its key, in the order of ``digest``, a hexadecimal hash whose first
    three digits are the buckets."""
    bucket = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    out = running_sums(df.withColumn("_one", F.lit(1).cast("long")), keys, bucket, [F.col(digest)], {"_at": "_one"})
    return out.withColumn("place", F.col("_at") - 1).withColumnRenamed("_at_all", "rows").drop("_at", "_one")


def quantiles(df: DataFrame, value: str, shares: list[float], n: str | None = None) -> DataFrame:
    """One row with the exact quantiles q0, q1, ... of a column over the whole table, interpolated between neighbours; nulls
    are left out. Equal values are counted first and summed in ranges, so no task holds the column. ``n``: the column with
    the number of rows that a row stands for."""
    return grouped_quantiles(df, [], value, shares, n)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], n: str | None = None) -> DataFrame:
    """:func:`quantiles` of each key. The ranges are those of the whole column, so the rows of a key that has many are dealt
    over many ranges; each adds up its own, and a key's places are found from one row a key and range. A key without any
    value has no row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.sum(n or F.lit(1)).alias("_n"))
    sums = running_sums(counts, keys, value_buckets(counts, "_v"), [F.col("_v")], {"_upto": "_n"})
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    out = []
    for i, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("_upto_all") - 1)
        out += [at(F.floor(place)).alias(f"_low{i}"), at(F.ceil(place)).alias(f"_high{i}"), F.max(place - F.floor(place)).alias(f"_part{i}")]
    row = sums.groupBy(*keys).agg(*out) if keys else sums.agg(*out)
    return row.select(*keys, *[(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")).alias(f"q{i}") for i in range(len(shares))])


#: Rows of a group whose values a task may hold.
GROUP_ROWS = 1 << 20


def with_quantiles(df: DataFrame, keys: list[str], aggregates: list[Column], value: str, shares: dict[str, float], group_rows: int = GROUP_ROWS) -> DataFrame:
    """The aggregates of each key and exact quantiles of a column by name, null for a key without any value. If every group is
    small, quantiles are one more aggregate; else they come from :func:`grouped_quantiles`. The result is the same."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= group_rows:
        return df.groupBy(*keys).agg(*aggregates, *[F.percentile(value, F.lit(q)).alias(name) for name, q in shares.items()])
    found = grouped_quantiles(df, keys, value, list(shares.values())).select(*keys, *[F.col(f"q{i}").alias(name) for i, name in enumerate(shares)])
    groups = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    return key_join(groups, found, keys)


def quantile_columns(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], group_rows: int | None = GROUP_ROWS) -> DataFrame:
    """keys and the exact quantile (column, share) of each name, null for a key without any value of it; without keys, one row
    for the whole table. With ``group_rows`` no task holds more values of a key: where a key has more rows, the columns'
    values become rows with their name and all are found by :func:`grouped_quantiles` at once. Without it, every key is taken
    to be small."""
    if group_rows is None or (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) <= group_rows:
        return df.groupBy(*keys).agg(*[F.percentile(c, F.lit(q)).alias(name) for name, (c, q) in wanted.items()])
    shares = sorted({q for _, q in wanted.values()})
    each = F.array(*[F.struct(F.lit(name).alias("_name"), c.cast("double").alias("_value")) for name, (c, _) in wanted.items()])
    long = df.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e.*")
    found = grouped_quantiles(long, [*keys, "_name"], "_value", shares)
    picked = [F.max(F.when(F.col("_name") == name, F.col(f"q{shares.index(q)}"))).alias(name) for name, (_, q) in wanted.items()]
    out = found.groupBy(*keys).agg(*picked)
    return key_join(df.select(*keys).distinct(), out, keys) if keys else out


def key_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(right.withColumnsRenamed({k: f"_k_{k}" for k in keys}), on, "left").drop(*[f"_k_{k}" for k in keys])


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, how: str = "inner", hot_parts: int | None = None) -> DataFrame:
    """Rows of points with those intervals of their key that hold them, start <= at < end. Time is cut into buckets of
    ``width``: an interval has a row for each bucket that it touches and a point is in one, so it is an equality join and
    overlapping or long intervals need no other care. Buckets that hold over a quarter of a partition's share of the points
    are cut into parts (all of the shuffle partitions, or ``hot_parts``), for which their intervals are repeated.
    ``how``: inner, or left for points without an interval too. Intervals must not have a column of points but the keys."""
    left, right = _bucketed(points, intervals, keys, at, start, end, width, hot_parts)
    on = (F.col("_bucket") == F.col("_r_bucket")) & (F.col("_part") == F.col("_r_part")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(right, on, how).drop("_bucket", "_part", "_r_bucket", "_r_part", *[f"_r_{k}" for k in keys])


def _bucketed(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, hot_parts: int | None) -> tuple[DataFrame, DataFrame]:
    """Points with ``_bucket`` and ``_part``, and a row of each interval for each bucket and part that it meets, whose keys,
    bucket and part are named ``_r_...``."""
    parts = hot_parts or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    dealt = points.withColumn("_bucket", bucket(at))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    limit = counts.agg((F.sum("_n") / (4 * parts)).alias("_limit"))
    hot = counts.join(F.broadcast(limit)).where("_n > _limit").select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_bucket").alias("_h_bucket"))  # at most four a partition
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(start), F.ceil(F.col(end) / F.lit(float(width))).cast("long") - 1)))

    def marked(df: DataFrame) -> DataFrame:
        on = F.col("_bucket") == F.col("_h_bucket")
        for k in keys:
            on = on & (F.col(k) == F.col(f"_h_{k}"))
        return df.join(F.broadcast(hot), on, "left")

    gone = ["_h_bucket", *[f"_h_{k}" for k in keys]]
    left = marked(dealt).withColumn("_part", F.when(F.col("_h_bucket").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(0)).drop(*gone)
    copies = F.when(F.col("_h_bucket").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    right = marked(spread).withColumn("_part", F.explode(copies)).drop(*gone)
    return left, right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_bucket").alias("_r_bucket"), F.col("_part").alias("_r_part"), *[c for c in intervals.columns if c not in keys])


def interval_counts(points: DataFrame, intervals: DataFrame, keys: list[str], ids: list[str], at: str, start: str, end: str, width: float, value: str, hot_parts: int | None = None) -> DataFrame:
    """ids, keys, n and least of each interval that holds a point of its key, start <= at < end: how many it holds (of a
    non-null ``value``) and their least value, a long.

    No row stands for a point and an interval: pairs grow with the product of both. In a bucket (see :func:`interval_join`)
    points are sorted once, an interval's are those between two places, and their least value is that of two runs of a
    power of two; what an interval has in its buckets is added up."""
    where = ["_bucket", "_part", *keys]
    left, right = _bucketed(points, intervals, keys, at, start, end, width, hot_parts)
    left = left.where(F.col(value).isNotNull()).select(*where, F.col(at).cast("double").alias("_at"), F.col(value).cast("long").alias("_v"))
    right = right.select(*[F.col(f"_r{c}" if c.startswith("_") else f"_r_{c}").alias(c) for c in where], *ids, F.col(start).cast("double").alias("_start"), F.col(end).cast("double").alias("_end"))
    schema = T.StructType([*[right.schema[c] for c in [*ids, *keys]], T.StructField("n", T.LongType()), T.StructField("least", T.LongType())])

    def held(these: pa.Table, asked: pa.Table) -> pa.Table:
        time, values = these["_at"].to_numpy(), these["_v"].to_numpy()
        order = np.argsort(time)
        time, values = time[order], values[order]
        first, last = np.searchsorted(time, asked["_start"].to_numpy()), np.searchsorted(time, asked["_end"].to_numpy())
        n = last - first
        some = np.flatnonzero(n > 0)
        first, last, n = first[some], last[some], n[some]
        least = np.empty(len(some), np.int64)
        level = np.frexp(n)[1] - 1
        runs = values  # the least of 2^k values from each place
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                half = 1 << (k - 1)
                runs = np.minimum(runs[:-half], runs[half:])
            now = level == k
            least[now] = np.minimum(runs[first[now]], runs[last[now] - (1 << k)])
        return asked.take(pa.array(some)).select([*ids, *keys]).append_column("n", pa.array(n.astype(np.int64))).append_column("least", pa.array(least))

    found = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(held, schema)
    return found.groupBy(*ids, *keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """Inner join on a key that may be hot on the left. Keys with over a quarter of a partition's share of the left rows (at
    most four a shuffle partition) are cut into as many parts as there are partitions, by a hash of ``spread``, and the
    right side's rows of these keys are repeated for each part."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg((F.sum("_n") / (4 * parts)).alias("_limit"))
    hot = counts.join(F.broadcast(total)).where("_n > _limit").select(F.col(key).alias("_hot"))
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    a = marked.withColumn("_part", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(copies)).drop("_hot")
    return a.join(b, [key, "_part"]).drop("_part")
