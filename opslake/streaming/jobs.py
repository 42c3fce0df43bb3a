"""Structured Streaming operators. Each runs to the end of what has landed (availableNow) and can be restarted from its
checkpoint; results equal the batch operators' on the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from .commits import Commits


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session makes one where it is not named; a cluster must name it,
    as executors would each write to a folder of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def watch(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    """The folder's files as a stream: what has landed since the last trigger is one batch."""
    return spark.readStream.schema(schema).parquet(folder)


def fed(df: DataFrame, parts: list[Column], query: Callable[[DataFrame], DataFrame], mode: str = "append", folder: str | None = None, runner: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Lands a table part by part, each written by as many tasks as it has partitions, and after each part starts the query
    anew from its checkpoint and runs it to the end of what has landed. Returns the output of all parts."""
    spark = df.sparkSession
    landed, folder, out = new_folder(spark, "landed"), folder or new_folder(spark, "stream"), None
    for part in parts:
        df.where(part).write.mode("append").parquet(landed)
        out = (runner or run)(query(watch(spark, df.schema, landed)), mode=mode, folder=folder)
    return out


def run(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream to its end and returns its output. Each batch is written under its number, so a batch that is replayed
    after a failure replaces what it had written: state and output agree. With the folder of an earlier run it goes on from
    that run's checkpoint, and returns the output of both."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark, "stream")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def run_until_refused(df: DataFrame, parts: list[Column], query: Callable[[DataFrame], DataFrame], message: str) -> tuple[DataFrame, bool]:
    """Output of a stream up to the part that fails with the message, and whether one did. Any other failure is raised."""
    spark = df.sparkSession
    landed, folder, refused = new_folder(spark, "landed"), new_folder(spark, "stream"), False
    for part in parts:
        df.where(part).write.mode("append").parquet(landed)
        stream = query(watch(spark, df.schema, landed))
        try:
            run(stream, folder=folder)
        except StreamingQueryException as e:
            if message not in str(e):
                raise
            refused = True
            break
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch=*").select(*stream.columns), refused


def ledger(stream: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame], schema: str, folder: str, after_write: Callable[[int], None] | None = None) -> DataFrame:
    """Runs a stream whose state and predictions are one table: ``step(batch, state, number)`` makes rows of the schema, of
    which those with ``part = 'state'`` are the state for the next batch and the others the output.

    A batch is one commit (see :class:`.commits.Commits`): its rows are there whole or not at all, and a reader sees
    nothing of a batch that died. A batch that fails after the write and is replayed starts from the commit before it and
    replaces its own. State is a distributed table, of any size; once the next batch is committed, its files are deleted.
    ``after_write`` is called before the stream's checkpoint knows of the batch. Returns the output of all batches with
    their number."""
    spark = stream.sparkSession
    empty = spark.createDataFrame([], schema)
    commits = Commits(spark, f"{folder}/ledger")

    def sink(batch: DataFrame, number: int) -> None:
        before = commits.read("state", empty.schema, first=number - 1, last=number - 1) if number else empty
        rows = commits.staged(step(batch, before, number).select(*empty.columns))
        commits.commit(number, state=rows.where("part = 'state'"), out=rows.where("part <> 'state'").withColumn("batch", F.lit(number)))
        commits.drop("state", number - 2)
        commits.unstage(rows)
        if after_write:
            after_write(number)

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return commits.read("out", T.StructType([*empty.schema.fields, T.StructField("batch", T.IntegerType())]))


def fed_ledger(df: DataFrame, parts: list[Column], query: Callable[[DataFrame], DataFrame], step: Callable, schema: str) -> DataFrame:
    """:func:`fed` with a ledger: a stop and a start from the checkpoint between parts."""
    return fed(df, parts, query, runner=lambda stream, mode, folder: ledger(stream, step, schema, folder))


def windowed_ingest(width: int, keys: list[str], at: str) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """A step of :func:`ledger` that closes one window a batch, [number * width, (number + 1) * width): rows before it are
    ``late``, rows in it ``current``, and rows after it wait as state. No row is lost without a count."""

    def step(batch: DataFrame, state: DataFrame, number: int) -> DataFrame:
        rows = batch.select(*keys, at).unionByName(state.select(*keys, at))
        part = F.when(F.col(at) < number * width, "late").when(F.col(at) < (number + 1) * width, "current").otherwise("state")
        return rows.withColumn("part", part)

    return step


def grace_ingest(width: float, grace: float, keys: list[str], at: str, captured: str) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """A step of :func:`ledger` that decides a window when the clock (the latest capture so far) is ``grace`` past its end, by
    the rows that were captured until then; rows captured later are ``late``."""

    def step(batch: DataFrame, state: DataFrame, number: int) -> DataFrame:
        columns = [*keys, at, captured, "clock"]
        rows = batch.withColumn("clock", F.lit(None).cast("double")).select(*columns).unionByName(state.select(*columns))
        clock = rows.agg(F.greatest(F.max(captured), F.max("clock")).alias("_now"))  # one row
        decision = (F.floor(F.col(at) / width) + 1) * width + grace
        part = F.when(F.col(captured) > decision, "late").when(decision <= F.col("_now"), "current").otherwise("state")
        return rows.join(F.broadcast(clock)).withColumn("part", part).withColumn("clock", F.col("_now")).drop("_now")

    return step


def resume(stored: DataFrame, source: DataFrame, source_key: str, ids: list[str], at: str, overlap: float) -> DataFrame:
    """Rows of a source to ingest after a stop: those at or after the source's latest stored time less the overlap (all of a
    source that nothing is stored of), without those stored, each id once."""
    latest = stored.groupBy(F.col(source_key).alias("_k")).agg(F.max(at).alias("_latest"))
    again = source.join(latest, F.col(source_key) == F.col("_k"), "left").where(F.col("_latest").isNull() | (F.col(at) >= F.col("_latest") - overlap)).drop("_k", "_latest")
    return again.dropDuplicates(ids).join(stored.select(*ids), ids, "left_anti")


def tumbling(stream: DataFrame, time: str, width: str, delay: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Windows by completion time, decided once the watermark has passed them; later rows are dropped."""
    timed = stream.withWatermark(time, delay)
    return timed.groupBy(F.window(time, width).alias("w"), *keys).agg(*aggregates).select(*keys, F.unix_timestamp("w.start").alias("start"), *[c for c in aggregates_names(aggregates)])


def aggregates_names(aggregates: list[Column]) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2].strip("`") for a in aggregates]


def deduplicated(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """First arrival of each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


#: Groups of keys whose state is read and written together: a call costs the same for one key or for some.
KEY_GROUPS = 1 << 11


def stateful(stream: DataFrame, keys: list[str], order: list[str], output: str, state: str, step: Callable[[dict, tuple, tuple | None], tuple[list[tuple], tuple]], groups: int = KEY_GROUPS) -> DataFrame:
    """A keyed state machine: rows of a key go through ``step(row, key, state) -> (output rows, state)`` in order within
    each batch; the state survives restarts in the checkpoint.

    Keys are dealt over ``groups`` groups by their hash (those with a null into one of their own), and a group's call takes
    the rows of its keys and holds their states as arrays, so the number of calls a batch is bounded while keys may grow.
    With fewer keys than groups nearly every key has a call of its own."""
    names = [c.strip().split()[0] for c in output.split(",")]
    fields = [*[T.StructField(f"key_{i}", stream.schema[k].dataType) for i, k in enumerate(keys)], *T.StructType.fromDDL(state).fields]
    held = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields])

    def advance(_: tuple, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).drop(columns="_group").sort_values(order, kind="stable")
        now = {tuple(x[: len(keys)]): tuple(x[len(keys) :]) for x in zip(*group.get)} if group.exists else {}
        out: list[tuple] = []
        for row in rows.to_dict("records"):
            key = tuple(None if row[k] != row[k] else row[k] for k in keys)
            made, now[key] = step(row, key, now.get(key))
            out += made
        group.update(tuple(map(list, zip(*[(*k, *s) for k, s in now.items()]))))
        yield pd.DataFrame(out, columns=names)

    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    dealt = stream.withColumn("_group", F.when(missing, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*keys), F.lit(groups))))
    return dealt.groupBy("_group").applyInPandasWithState(advance, output, held, "append", GroupStateTimeout.NoTimeout)


def incident_step(row: dict, key: tuple, state: tuple | None) -> tuple[list[tuple], tuple]:
    """Opens on the second warning in a row and closes on the second clear in a row."""
    active, warnings, clears = state or (False, 0, 0)
    warnings, clears = (warnings + 1, 0) if row["warning"] else (0, clears + 1)
    kind = "open" if warnings >= 2 and not active else "close" if clears >= 2 and active else None
    out = [(*key, int(row["window"]), int(row["until"]), kind)] if kind else []
    return out, (active if kind is None else kind == "open", warnings, clears)


def running_max_step(operations: list[str]) -> Callable:
    """After each line the largest value of each operation so far; lines that do not rise are rejected."""

    def step(row: dict, key: tuple, state: tuple | None) -> tuple[list[tuple], tuple]:
        last, values = (state[0], list(state[1])) if state else (-1, [None] * len(operations))
        if row["line"] <= last:
            return [], (last, values)
        i = operations.index(row["operation"])
        values[i] = row["value"] if values[i] is None else max(values[i], row["value"])
        return [(*key, int(row["line"]), *values)], (int(row["line"]), values)

    return step


def contiguous_step(step_size: int, kept: int) -> Callable:
    """Accepts a message only if it follows the last accepted one; answers with how many of the last ones are kept."""

    def step(row: dict, key: tuple, state: tuple | None) -> tuple[list[tuple], tuple]:
        last, history = state or (None, 0)
        end = int(row["end"])
        ok = last is None or end == last + step_size
        if ok:
            last, history = end, min(kept, history + 1)
        return [(*key, end, int(row["arrival"]), "accepted" if ok else "rejected", history)], (last, history)

    return step


def coverage_step(threshold: int) -> Callable:
    """Gaps of a service's windows; an insufficient window resets them."""

    def step(row: dict, key: tuple, state: tuple | None) -> tuple[list[tuple], tuple]:
        gap = 0 if row["seen"] or row["insufficient"] else (state[0] if state else 0) + 1
        return [(*key, int(row["window"]), gap, gap >= threshold)], (gap,)

    return step


def guarded(stream: DataFrame, identity: str, expected: str) -> DataFrame:
    """Rows of a stream that were scored by the expected model; others fail the query, which keeps its checkpoint clean."""
    return stream.withColumn(identity, F.when(F.col(identity) == expected, F.col(identity)).otherwise(F.raise_error(F.lit("the stream's model has changed"))))
