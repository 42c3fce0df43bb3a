"""Ingest that refuses conflicts: a store of digests, captures that are taken whole or not at all, a mark for each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .commits import Commits

EVENTS = "service string, span long, digest string, source string, transport double"
MARKS = "source string, mark double"
OUTCOMES = "capture int, source string, refused boolean, inserted long, mark double"
QUARANTINE = "capture int, source string, service string, span long, digest string, stored string"
COMPACT_EVERY = 16


class ConflictIngest:
    """Takes captures (a trigger's rows of one source) of events (source, service, span, payload, transport).

    An event is known by (service, span). The same payload again is a repeat and is not stored twice. Another payload than
    the stored one, or than the first of the trigger (by source, then digest), is a conflict: the capture that brought it
    is refused whole, its conflicting events come out in ``quarantine``, and the source's high-water mark (the latest
    transport time taken) stays. Events, marks, outcomes and quarantine of a trigger are one commit, so a trigger that dies
    and is replayed neither stores nor refuses twice. Events are stored once, by the trigger that brought them; old
    parts are merged every ``compact_every`` triggers."""

    def __init__(self, folder: str, stream: DataFrame, compact_every: int = COMPACT_EVERY):
        self.spark = stream.sparkSession
        self.stream, self.folder, self.compact_every = stream, folder, compact_every
        self.commits = Commits(self.spark, f"{folder}/ingest")

    def run(self) -> ConflictIngest:
        query = self.stream.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def _take(self, batch: DataFrame, number: int) -> None:
        sent = batch.groupBy("source", "service", "span", F.sha2(F.col("payload"), 256).alias("digest")).agg(F.max("transport").alias("transport"))
        stored = self.commits.read("events", EVENTS, last=number - 1).select("service", "span", F.col("digest").alias("stored"))
        first = F.min(F.struct("source", "digest")).over(Window.partitionBy("service", "span"))
        judged = sent.withColumn("_first", first).join(stored, ["service", "span"], "left").withColumn("_conflict", F.coalesce(F.col("digest") != F.col("stored"), F.lit(False)) | (F.col("digest") != F.col("_first.digest")))
        rows = self.commits.staged(judged.select("source", "service", "span", "digest", "transport", "stored", "_conflict", (F.col("_first.source") == F.col("source")).alias("_is_first")))
        captures = rows.groupBy("source").agg(F.bool_or("_conflict").alias("refused"), F.max("transport").alias("_latest"))
        new = rows.join(captures.where("NOT refused").select("source"), "source", "left_semi").where("stored IS NULL AND _is_first")
        old = self.commits.read("marks", MARKS, first=number - 1, last=number - 1)
        taken = captures.where("NOT refused").select("source", F.col("_latest").alias("mark"))
        marks = self.commits.staged(old.unionByName(taken).groupBy("source").agg(F.max("mark").alias("mark")))
        inserted = new.groupBy("source").agg(F.count(F.lit(1)).alias("inserted"))
        outcomes = captures.join(inserted, "source", "left").join(marks, "source", "left").select(F.lit(number).alias("capture"), "source", "refused", F.coalesce("inserted", F.lit(0).cast("long")).alias("inserted"), "mark")
        quarantine = rows.where("_conflict").select(F.lit(number).alias("capture"), "source", "service", "span", "digest", "stored")
        self.commits.commit(number, events=new.select("service", "span", "digest", "source", "transport"), marks=marks, outcomes=outcomes, quarantine=quarantine)
        self.commits.drop("marks", number - 2)
        self.commits.unstage(rows)
        self.commits.unstage(marks)
        if number and number % self.compact_every == 0:
            self.commits.compact("events", EVENTS, number - 1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def events(self) -> DataFrame:
        return self.commits.read("events", EVENTS)

    def outcomes(self) -> DataFrame:
        return self.commits.read("outcomes", OUTCOMES)

    def quarantine(self) -> DataFrame:
        return self.commits.read("quarantine", QUARANTINE)

    def marks(self) -> DataFrame:
        last = self.commits.last()
        return self.commits.read("marks", MARKS, first=last or 0)
