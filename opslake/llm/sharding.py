"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 65,536 places; a row's id hashes to a place and belongs to the next
point clockwise. A shard's load is bounded by its share of all rows, so a full shard passes its overflow clockwise to
the next point whose shard has room, and so on. With the shares of :func:`capacities` every shard is filled exactly,
so counts differ by one row at most, and only overflow leaves its ring place.

The ring works on counts: rows are ranked within their arc by a hash of their content, the overflow rounds move runs
of ranks (at most one round a shard), and a last join gives each row its shard and slot. So the result follows from
the rows alone, however the table is dealt over partitions. DataFrame functions only.

Cases: null text has 0 bytes; null ids and ids that many rows share hash to one place whose overflow moves on, and
salts keep such rows apart in the shuffle; rows equal in id, size and text checksum are counted before the shuffle and
dealt out in blocks after it; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import expanded, join_runs, ranked_kinds, remove_tables, written

SHARDS = 40
VNODES = 64
PLACES = 1 << 16
OVERHEAD = 16


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """point (order on the ring, from 0), place, shard of every virtual node."""
    points = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("v"))
    points = points.withColumn("place", F.pmod(F.xxhash64(F.lit("vnode"), "shard", "v"), F.lit(PLACES)).cast("int"))
    order = Window.orderBy("place", "shard", "v")
    return points.select((F.row_number().over(order) - 1).alias("point"), "place", "shard")


def arcs(points: DataFrame) -> DataFrame:
    """place, arc: the first point at or after each place, clockwise. A table of 65,536 rows whatever the input."""
    spark = points.sparkSession
    places = spark.range(PLACES).select(F.col("id").cast("int").alias("place"), F.lit(None).cast("int").alias("point"))
    back = Window.orderBy(F.col("place").desc(), F.col("point").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = places.unionByName(points.groupBy("place").agg(F.min("point").alias("point")))
    first = both.withColumn("arc", F.last("point", ignorenulls=True).over(back))
    at = Window.partitionBy("place")
    return first.withColumn("arc", F.coalesce(F.max("point").over(at), "arc", F.lit(0))).where("point is null").select("place", F.col("arc").cast("int").alias("arc"))


def capacities(shards: int, n: int) -> str:
    """SQL for a shard's bound: the rows divided evenly, the first shards take the remainder."""
    return f"{n // shards} + CASE WHEN shard < {n % shards} THEN 1 ELSE 0 END"


def place_arcs(counts: DataFrame, points: DataFrame, shards: int, n: int) -> DataFrame:
    """arc, first, last, shard, slot0: which shard takes which ranks of each arc. counts: arc, n. A written table."""
    points = written(points.coalesce(1))
    bound = points.select("shard").distinct().selectExpr("shard", f"{capacities(shards, n)} AS bound")
    moving = counts.select("arc", F.col("arc").alias("point"), F.lit(0).cast("long").alias("rank0"), F.col("n").cast("long").alias("n"))
    state = written(moving.join(points.drop("place"), "point").select(F.lit(False).alias("placed"), "arc", "point", "rank0", "n", "shard", F.lit(0).cast("long").alias("slot0")).coalesce(1))
    made, done = [state], []
    twice = points.select("point", "shard", "point").toDF("point", "shard", "turn").unionByName(points.select((F.col("point")).alias("point"), "shard", (F.col("point") + shards * points_per(points, shards)).alias("turn")))
    used = points.select("shard").distinct().select("shard", F.lit(0).cast("long").alias("used"))
    while True:
        inside = Window.partitionBy("shard").orderBy("point", "arc", "rank0").rowsBetween(Window.unboundedPreceding, -1)
        arrivals = state.where("not placed").join(used, "shard").join(bound, "shard")
        arrivals = arrivals.withColumn("at", F.col("used") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        arrivals = arrivals.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n"), F.col("bound") - F.col("at"))))
        full = used.join(bound, "shard").join(state.where("not placed").groupBy("shard").agg(F.sum("n").alias("came")), "shard", "left")
        full = full.select("shard", F.least(F.col("used") + F.coalesce("came", F.lit(0)), F.col("bound")).alias("used"), (F.col("used") + F.coalesce("came", F.lit(0)) >= F.col("bound")).alias("full"))
        # the next point with room, clockwise: over two turns of the ring, backwards
        back = Window.orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, -1)
        with_room = twice.join(full, "shard").withColumn("next", F.last(F.when(~F.col("full"), F.struct(F.col("point").alias("to"), F.col("shard").alias("to_shard"))), ignorenulls=True).over(back))
        onward = with_room.where("turn = point").select("point", "next")
        over = arrivals.where("n > taken").join(onward, "point").select(F.lit(False).alias("placed"), "arc", F.col("next.to").alias("point"), (F.col("rank0") + F.col("taken")).alias("rank0"), (F.col("n") - F.col("taken")).alias("n"), F.col("next.to_shard").alias("shard"), F.lit(0).cast("long").alias("slot0"))
        took = arrivals.where("taken > 0").select(F.lit(True).alias("placed"), "arc", "point", "rank0", F.col("taken").alias("n"), "shard", F.col("at").alias("slot0"))
        state = written(over.unionByName(took).coalesce(1))
        used = written(full.select("shard", "used").coalesce(1))
        made += [state, used]
        done.append(state.where("placed"))
        if state.where("not placed").isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    runs = written(out.select("arc", F.col("rank0").alias("first"), (F.col("rank0") + F.col("n") - 1).alias("last"), "shard", "slot0").coalesce(1))
    remove_tables(points, *made)
    return runs


def points_per(points: DataFrame, shards: int) -> int:
    return points.count() // shards


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows': counts at most one apart), shard, slot (gapless from 0 in the shard) and
    grown_shard (null: it belongs to another law) per row of docs."""
    points = ring(spark, shards, vnodes)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # rows that are equal in all three are one kind with its number, so that ranks follow from the rows alone
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.withColumn("place", F.pmod(F.xxhash64(F.lit("row"), "doc_id"), F.lit(PLACES)).cast("int")).withColumn("mixed", F.xxhash64("doc_id", "size", "text_crc32"))
    kinds = written(kinds.join(F.broadcast(arcs(points)), "place").drop("place"))
    n = kinds.agg(F.sum("n")).first()[0] or 0
    counts = kinds.groupBy("arc").agg(F.sum("n").alias("n"))
    runs = place_arcs(counts, points, shards, n)
    ordered = ranked_kinds(kinds, "arc", ["mixed", "doc_id", "size", "text_crc32"], "n", max(8, min(1 << 14, n >> 20)))
    placed = join_runs(expanded(ordered, "n", ["mixed"]).drop("rank0"), "arc", runs, "first", "last")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
