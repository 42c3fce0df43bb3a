"""Queries that run as streams over the driver tables, landed as files, and equal batch results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import sequence as Q
from ..sources import files
from ..operators import forest, windows
from ..streaming import ingest, jobs, processors
from . import bindings as B
from . import window_queries as WQ
from .registry import query

R = "round({}, 6)".format


def timed_requests(spark, d):
    return B.req(spark, d).withColumn("at", F.timestamp_micros((F.col("end_s") * 1e6).cast("long")))


def _thirds():
    return [F.col("window") < 10, (F.col("window") >= 10) & (F.col("window") < 20), F.col("window") >= 20]


# A window of a day is decided when the latest event is an hour past its end: the last day stays open.
@query(
    "t02_tumbling_window",
    f"""WITH {B.REQ} SELECT service, CAST(1704067200 + "window" * 86400 AS BIGINT) AS start, count(*) AS requests, max(active) AS max_active, {R('max(duration)')} AS longest FROM req
WHERE 1704067200 + ("window" + 1) * 86400 <= (SELECT max(end_s) FROM req) - 3600 GROUP BY service, "window" """,
)
def tumbling_window(spark, d):
    aggregates = [F.count(F.lit(1)).alias("requests"), F.max("active").alias("max_active"), F.max("duration").alias("longest")]
    return jobs.fed(timed_requests(spark, d), _thirds(), lambda stream: jobs.tumbling(stream, "at", "1 day", "1 hour", ["service"], aggregates))


@query("t03_late_accounting", f"WITH {B.REQ}, m AS (SELECT service, end_s, max(end_s) OVER (PARTITION BY service ORDER BY (k, span) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM req) SELECT service, count(*) AS n, count(*) FILTER (end_s < last - 86400) AS late FROM m GROUP BY service")
def late_accounting(spark, d):
    r = B.req(spark, d).select("service", "end_s", "k", "span")
    parts = [F.col("k") < 40, (F.col("k") >= 40) & (F.col("k") < 80), F.col("k") >= 80]

    def step(row, key, state):
        last, n, late = state or (None, 0, 0)
        is_late = last is not None and row["end_s"] < last - 86400
        now = (row["end_s"] if last is None else max(last, row["end_s"]), n + 1, late + int(is_late))
        return [(*key, now[1], now[2])], now

    counted = jobs.fed(r, parts, lambda stream: jobs.stateful(stream, ["service"], ["k", "span"], "service string, n long, late long", "last double, n long, late long", step))
    return counted.groupBy("service").agg(F.max("n").alias("n"), F.max("late").alias("late"))


@query("t05_dedup_ingest", f"WITH {B.REQ} SELECT span, service FROM req")
def dedup_ingest(spark, d):
    r = B.req(spark, d).select("span", "service", "window", F.timestamp_micros((F.col("end_s") * 1e6).cast("long")).alias("at"))
    again = r.where("span % 4 = 0")
    return jobs.fed(r.unionByName(again), _thirds(), lambda stream: jobs.deduplicated(stream, "at", "2 days", ["span"]).select("span", "service"))


def _flags(spark, d):
    return B.busy(spark, d).select("service", "window", "until", "warning")


@query("t07_incident_stream", f"WITH {WQ._TRANSITIONS} SELECT * FROM transitions")
def incident_stream(spark, d):
    return jobs.fed(_flags(spark, d), _thirds(), lambda stream: jobs.stateful(stream, ["service"], ["window"], "service string, start int, at int, kind string", "active boolean, warnings int, clears int", jobs.incident_step))


@query("t08_contiguous_messages")
def contiguous_messages(spark, d):
    r = B.req(spark, d).select("service", (F.col("window") * 60).alias("end"), F.col("span").alias("arrival"))
    parts = [F.pmod(F.col("arrival"), F.lit(3)) == i for i in range(3)]
    return jobs.fed(r, parts, lambda stream: jobs.stateful(stream, ["service"], ["arrival"], "service string, end long, arrival long, status string, history int", "last long, history int", jobs.contiguous_step(60, 5)))


@query("t09_parameter_stream", f"WITH {B.SESS} SELECT instance, line, {WQ._MAXES} FROM sess WINDOW o AS (PARTITION BY instance ORDER BY line ROWS UNBOUNDED PRECEDING)")
def parameter_stream(spark, d):
    s = B.sess(spark, d)
    top = s.agg(F.max("line")).first()[0] or 0
    parts = [F.col("line") <= top // 2, F.col("line") > top // 2]
    columns = ", ".join(f"max_{i} double" for i in range(5))
    return jobs.fed(s, parts, lambda stream: jobs.stateful(stream, ["instance"], ["line"], f"instance long, line long, {columns}", "last long, maxima array<double>", jobs.running_max_step(B.PRIORITIES)))


@query(
    "t10_coverage_stream",
    f"""WITH {WQ._SEEN}, c AS (SELECT *, avg(CAST(seen AS INT)) OVER (PARTITION BY "window") AS coverage FROM seen),
f AS (SELECT *, coverage < 0.5 AS insufficient FROM c), g AS (SELECT *, sum(CAST(seen OR insufficient AS INT)) OVER (PARTITION BY service ORDER BY "window") AS j FROM f),
h AS (SELECT *, sum(CAST(NOT seen AND NOT insufficient AS INT)) OVER (PARTITION BY service, j ORDER BY "window") AS gap FROM g)
SELECT service, "window", CAST(gap AS INT) AS gap, gap >= 2 AS issue FROM h""",
)
def coverage_stream(spark, d):
    guard = WQ.coverage_guard(spark, d).select("service", "window", "seen", "insufficient")
    return jobs.fed(guard, _thirds(), lambda stream: jobs.stateful(stream, ["service"], ["window"], "service long, window int, gap int, issue boolean", "gap int", jobs.coverage_step(2)))


@query("t11_replay_equality", f"WITH {WQ._TRANSITIONS} SELECT count(*) AS compared, CAST(sum(\"at\") AS BIGINT) AS total, CAST(0 AS BIGINT) AS mismatches, CAST(0 AS DOUBLE) AS max_difference FROM transitions")
def stream_replay_equality(spark, d):
    batch = Q.incident_transitions(_flags(spark, d), ["service"], "window", "until", "warning")
    stream = incident_stream(spark, d)
    return E.replay_equality(batch, stream, ["service", "start", "kind"], "at").join(stream.agg(F.sum("at").alias("total")))


@query("t12_identity_guard", f"WITH {B.REQ} SELECT service, count(*) AS n, true AS refused FROM req WHERE \"window\" < 20 GROUP BY service")
def identity_guard(spark, d):
    """The last third comes from another model: the stream stops before it and keeps what it had."""
    marked = B.req(spark, d).select("service", "window").withColumn("model", F.when(F.col("window") < 20, "m1").otherwise("m2"))
    kept, refused = jobs.run_until_refused(marked, _thirds(), lambda stream: jobs.guarded(stream, "model", "m1"), "model has changed")
    return kept.groupBy("service").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


# Arrival day: the day of the event, or six days earlier or later. Batches arrive by thirds and each closes one third.
_ARRIVALS = """a AS (SELECT service, span, "window", least(2, "window" // 10) AS w, greatest(0, least(2, floor(("window" + [0, 6, -6][k % 3 + 1]) / 10))) AS b FROM req)"""


@query(
    "t01_incremental_ingest",
    f"""WITH {B.REQ}, {_ARRIVALS}, p AS (SELECT service, greatest(w, b) AS batch, CASE WHEN w < b THEN 'late' ELSE 'current' END AS part FROM a)
SELECT CAST(batch AS INT) AS batch, service, part, count(*) AS n, CAST(3 AS BIGINT) AS torn FROM p GROUP BY ALL""",
)
def incremental_ingest(spark, d):
    """Files of JSON lines, each with a torn last line, that bring events early and late; a stop and a restart between."""
    r = B.req(spark, d)
    arrival = F.col("window") + F.element_at(F.array(F.lit(0), F.lit(6), F.lit(-6)), F.pmod("k", F.lit(3)).cast("int") + 1)
    third = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(arrival / 10).cast("int")))
    lines = r.select(third.alias("third"), F.to_json(F.struct("service", F.least(F.lit(29), F.col("window")).alias("day"), F.col("span").alias("id"))).alias("value"))
    folder, run = jobs.new_folder(spark, "lines"), jobs.new_folder(spark, "stream")
    torn = spark.range(1).select(F.lit('{"service": "cli').alias("value"))
    out = None
    for i in range(3):  # each round starts the query anew from its checkpoint
        lines.where(F.col("third") == i).select("value").unionByName(torn).write.mode("append").text(folder)
        stream = spark.readStream.schema("value string").text(folder)
        events = stream.select(F.from_json("value", "service string, day int, id long, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("e")).select("e.*").where("bad IS NULL")
        out = jobs.ledger(events, jobs.windowed_ingest(10, ["service", "id"], "day"), "service string, id long, day int, part string", run)
    read = spark.read.text(folder)
    bad = read.where(F.from_json("value", "service string, bad string", {"columnNameOfCorruptRecord": "bad"})["bad"].isNotNull()).agg(F.count(F.lit(1)).alias("torn"))
    return out.groupBy("batch", "service", "part").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(bad))


_CAPTURED = "c AS (SELECT service, span, end_s, end_s + 600 * (k % 10) AS captured FROM req)"


@query(
    "t04_arrival_grace",
    f"""WITH {B.REQ}, {_CAPTURED}, w AS (SELECT *, (floor(end_s / 86400) + 1) * 86400 + 1800 AS decision, max(captured) OVER () AS now FROM c)
SELECT service, CAST(floor(end_s / 86400) AS BIGINT) AS day, count(*) FILTER (captured <= decision) AS counted, count(*) FILTER (captured > decision) AS late FROM w WHERE decision <= now GROUP BY ALL""",
)
def arrival_grace(spark, d):
    """Days are decided half an hour after they end, by what was captured until then."""
    c = B.req(spark, d).select("service", "span", "end_s", (F.col("end_s") + 600 * (F.col("k") % 10)).alias("captured"))
    bounds = c.agg(F.min("captured").alias("a"), F.max("captured").alias("b")).first()
    a, b = bounds["a"] or 0.0, bounds["b"] or 0.0
    cuts = [a + (b - a) * i / 3 for i in (1, 2)]
    x = F.col("captured")
    parts = [x <= cuts[0], (x > cuts[0]) & (x <= cuts[1]), x > cuts[1]]
    schema = "service string, span long, end_s double, captured double, clock double, part string"
    out = jobs.fed_ledger(c, parts, lambda stream: stream, jobs.grace_ingest(86400, 1800, ["service", "span"], "end_s", "captured"), schema)
    day = F.floor(F.col("end_s") / 86400).alias("day")
    counted = out.groupBy("service", day).agg(F.count_if(F.col("part") == "current").alias("counted"), F.count_if(F.col("part") == "late").alias("late"))
    return counted.where(((F.col("day") + 1) * 86400 + 1800) <= b)


@query(
    "t06_resume_overlap",
    f"""WITH {B.REQ}, s AS (SELECT * FROM req WHERE "window" < 20 AND k >= 10), m AS (SELECT service, max(end_s) AS latest FROM s GROUP BY service)
SELECT service, count(*) AS inserted, count(*) FILTER (end_s < latest) AS recovered FROM req JOIN m USING (service) WHERE end_s >= latest - 86400 AND span NOT IN (SELECT span FROM s) GROUP BY service""",
)
def resume_overlap(spark, d):
    """A stop after day 20 that lost a tenth of the rows; the source is read again from a day before the latest row."""
    r = B.req(spark, d).select("service", "span", "end_s", "window", "k")
    stored = jobs.fed(r.where("window < 20 AND k >= 10"), [F.col("window") < 10, F.col("window") >= 10], lambda stream: stream)
    again = jobs.resume(stored, r.unionByName(r.where("k % 4 = 0")), "service", ["span"], "end_s", 86400.0)
    latest = stored.groupBy("service").agg(F.max("end_s").alias("latest"))
    return again.join(latest, "service").groupBy("service").agg(F.count(F.lit(1)).alias("inserted"), F.count_if(F.col("end_s") < F.col("latest")).alias("recovered"))


def longest_so_far(batch, state, number):
    """State: the longest duration and the rows of each service so far; output: the same as the prediction of the batch."""
    rows = batch.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.max("duration").alias("longest")).unionByName(state.select("service", "n", "longest"))
    now = rows.groupBy("service").agg(F.sum("n").alias("n"), F.max("longest").alias("longest"))
    return now.withColumn("part", F.explode(F.array(F.lit("state"), F.lit("prediction"))))


@query(
    "s14_state_sink",
    f"""WITH {B.REQ}, t AS (SELECT least(2, "window" // 10) AS third, * FROM req), b AS (SELECT unnest([0, 1, 2]) AS batch)
SELECT CAST(batch AS INT) AS batch, service, CAST(count(*) AS BIGINT) AS n, {R('max(duration)')} AS longest FROM t JOIN b ON third <= batch GROUP BY ALL""",
)
def state_sink(spark, d):
    """State and predictions of a batch in one write; the query is stopped and started again after each third."""
    r = B.req(spark, d).select("service", "window", "duration")
    return jobs.fed_ledger(r, _thirds(), lambda stream: stream, longest_so_far, "service string, n long, longest double, part string").drop("part")


@query("s05_jsonl_scan", f"WITH {B.REQ} SELECT service, count(*) AS n, CAST(sum(status) AS BIGINT) AS statuses FROM req GROUP BY service")
def jsonl_scan(spark, d):
    folder = jobs.new_folder(spark, "json")
    good = B.req(spark, d).select(F.to_json(F.struct("service", "status")).alias("value"))
    good.unionByName(spark.range(1).select(F.lit('{"service": "cli').alias("value"))).write.text(folder)
    return files.read_jsonl(spark, folder, files.REQUEST).groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.sum("status").alias("statuses"))


@query("s06_numbered_lines", "SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line, CAST(event_id AS VARCHAR) AS value FROM events")
def numbered_lines(spark, d):
    folder = jobs.new_folder(spark, "lines")
    events = B.table(spark, d, "events").select("event_type", "event_id")
    events.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", F.col("event_id").cast("string").alias("value")).write.partitionBy("event_type").text(folder)
    return files.numbered_lines(spark, folder).select(F.regexp_extract("file", "event_type=([^/]+)", 1).alias("file"), "line", "value")


@query("s07_stamped_lines", f"WITH {B.REQ} SELECT service, count(*) AS n, CAST(sum(status) AS BIGINT) AS statuses FROM req GROUP BY service")
def stamped_lines(spark, d):
    r = B.req(spark, d).select(F.concat_ws(" ", F.date_format(F.timestamp_seconds("end_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.to_json(F.struct("service", "status"))).alias("value"))
    parsed = files.stamped_json(r, files.REQUEST).where("transport IS NOT NULL")
    return parsed.groupBy("event.service").agg(F.count(F.lit(1)).alias("n"), F.sum("event.status").alias("statuses"))


@query("s08_case_sink", "SELECT o_orderpriority AS \"case\", o_orderkey AS id, round(o_totalprice, 6) AS value FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def case_sink(spark, d):
    """One folder a case, of which a reader of two cases opens two."""
    folder = jobs.new_folder(spark, "cases")
    files.write_cases(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("case")), folder)
    return spark.read.parquet(folder).where(F.col("case").isin("1-URGENT", "5-LOW")).select("case", "id", "value")


@query("s10_ordered_export", f"WITH {B.REQ} SELECT service, row_number() OVER (PARTITION BY service ORDER BY end_s, span) AS line, span FROM req")
def ordered_export(spark, d):
    """The exported files, read in the order of their names, hold each service's rows in order."""
    folder = jobs.new_folder(spark, "export")
    files.write_ordered_json(B.req(spark, d).select("service", "end_s", "span"), folder, "service", ["end_s", "span"])
    lines = files.numbered_lines(spark, folder).select(F.regexp_extract("file", "service=([^/]+)", 1).alias("service"), "file", "line", F.get_json_object("value", "$.span").cast("long").alias("span"))
    before = lines.groupBy("service", "file").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("service", "file", F.coalesce(F.sum("n").over(Window.partitionBy("service").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lines.join(before, ["service", "file"]).select("service", (F.col("before") + F.col("line")).alias("line"), "span")


@query("s04_nested_traces", "SELECT o_orderkey AS trace, count(*) AS spans, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_traces(spark, d):
    folder = jobs.new_folder(spark, "traces")
    traces = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    traces.groupBy(F.col("l_orderkey").alias("traceID")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("spans")).select(F.array(F.struct("traceID", "spans")).alias("data")).write.json(folder)
    spans = files.flatten_traces(spark.read.json(folder))
    return spans.groupBy(F.col("traceID").alias("trace")).agg(F.count(F.lit(1)).alias("spans"), F.sum("l_quantity").alias("quantity"))


# scoring, ingest and coverage inside the stream ---------------------------------------------------------------------

_ORIGIN_MS = 1_704_067_200_000  # 2024-01-01, the first window
_CLOCK = "~clock"


def _closed(spark, requests):
    """Requests with a mark of time three days after the last window, which closes all windows before it. It has a service of
    its own: a null one would be filtered out, for a later join, before the watermark sees it."""
    mark = spark.range(1).select(F.lit(_CLOCK).alias("service"), F.timestamp_millis(F.lit(_ORIGIN_MS + (B.DAYS + 3) * processors.DAY_MS)).alias("at"), F.lit(B.DAYS + 3).alias("window"))
    return requests.unionByName(mark, allowMissingColumns=True)


@query("t07_online_incidents", f"WITH {WQ._TRANSITIONS} SELECT * FROM transitions")
def online_incidents(spark, d):
    """Raw requests in, transitions out: windows, the frozen model of the first five days and hysteresis in one stream."""
    requests = _closed(spark, timed_requests(spark, d).select("service", "at", "window", "duration", "status", "active"))
    model = B.win(spark, d).where("window < 5").groupBy("service").agg(F.percentile("p95", F.lit(0.5)).alias("base"))
    aggregates = windows.request_aggregates(86400.0)
    built = lambda stream: processors.online_incidents(stream, "at", "1 hour", "1 day", aggregates, model, F.col("p95") > F.col("base"), processors.Incidents(processors.DAY_MS, _ORIGIN_MS))
    return jobs.fed(requests, _thirds(), built, runner=processors.run)


@query("t10_coverage_guard_stream", f"""WITH {WQ._SEEN}, c AS (SELECT *, avg(CAST(seen AS INT)) OVER (PARTITION BY "window") AS coverage FROM seen),
f AS (SELECT *, coverage < 0.9 AS insufficient FROM c), g AS (SELECT *, sum(CAST(seen OR insufficient AS INT)) OVER (PARTITION BY service ORDER BY "window") AS j FROM f),
h AS (SELECT *, sum(CAST(NOT seen AND NOT insufficient AS INT)) OVER (PARTITION BY service, j ORDER BY "window") AS gap FROM g)
SELECT CAST(service AS VARCHAR) AS service, "window", seen, {R('coverage')} AS coverage, insufficient, CAST(gap AS BIGINT) AS gap, gap >= 2 AS issue FROM h""")
def coverage_guard_stream(spark, d):
    """Raw events in, the guard's rows out: presence, coverage over all services and gaps are all made in the stream."""
    requests = _closed(spark, timed_requests(spark, d).select(F.col("stream").cast("string").alias("service"), "at", "window"))
    expected = requests.where(F.col("service") != _CLOCK).select("service").distinct()
    guard = processors.CoverageGuard(2, 0.9, processors.DAY_MS, _ORIGIN_MS)
    built = lambda stream: processors.coverage_stream(lambda: stream, "at", "1 hour", "1 day", expected, guard)
    return jobs.fed(requests, _thirds(), built, runner=processors.run).where(F.col("window").between(0, B.DAYS - 1) & (F.col("service") != _CLOCK))


_SENT = f"""{B.REQ}, base AS (SELECT stream AS source, service, span, least(2, "window" // 10) AS capture, CAST(k AS VARCHAR) AS payload, end_s FROM req),
sent AS (SELECT * FROM base UNION ALL SELECT * REPLACE (capture + 1 AS capture) FROM base WHERE span % 4 = 0 AND capture < 2
  UNION ALL SELECT * REPLACE (capture + 1 AS capture, payload || '?' AS payload) FROM base WHERE span % 997 = 0 AND capture < 2)"""


def _steps():
    out = ["e_0 AS (SELECT source, span, payload, 0 AS capture FROM sent WHERE false)"]
    for i in range(3):
        out.append(f"s_{i} AS (SELECT source, span, payload, max(end_s) AS latest FROM sent WHERE capture = {i} GROUP BY ALL)")
        out.append(f"bad_{i} AS (SELECT source FROM s_{i} GROUP BY source, span HAVING count(*) > 1 UNION SELECT s.source FROM s_{i} s JOIN e_{i} e ON e.span = s.span AND e.payload <> s.payload)")
        out.append(f"e_{i + 1} AS (SELECT * FROM e_{i} UNION ALL SELECT source, span, payload, {i} FROM s_{i} WHERE source NOT IN (SELECT source FROM bad_{i}) AND span NOT IN (SELECT span FROM e_{i}))")
        out.append(f"m_{i} AS (SELECT source, {i} AS capture, source IN (SELECT source FROM bad_{i}) AS refused, max(latest) AS latest FROM s_{i} GROUP BY source)")
    return ", ".join(out)


@query(
    "t05_conflict_ingest",
    f"""WITH {_SENT}, {_steps()}, m AS (SELECT * FROM m_0 UNION ALL SELECT * FROM m_1 UNION ALL SELECT * FROM m_2),
n AS (SELECT source, capture, count(*) AS inserted FROM e_3 GROUP BY source, capture)
SELECT CAST(capture AS INT) AS capture, CAST(source AS VARCHAR) AS source, refused, CAST(coalesce(inserted, 0) AS BIGINT) AS inserted,
  {R('max(latest) FILTER (NOT refused) OVER (PARTITION BY source ORDER BY capture)')} AS mark FROM m LEFT JOIN n USING (source, capture)""",
)
def conflict_ingest(spark, d):
    """Captures by source: repeats are dropped, a changed payload refuses its capture and leaves the source's mark."""
    base = B.req(spark, d).select(F.col("stream").cast("string").alias("source"), "service", "span", F.least(F.lit(2), F.floor(F.col("window") / 10)).cast("int").alias("capture"), F.col("k").cast("string").alias("payload"), F.col("end_s").alias("transport"))
    later = base.where("capture < 2").withColumn("capture", F.col("capture") + 1)
    sent = base.unionByName(later.where("span % 4 = 0")).unionByName(later.where("span % 997 = 0").withColumn("payload", F.concat("payload", F.lit("?"))))
    landed, folder = jobs.new_folder(spark, "landed"), jobs.new_folder(spark, "stream")
    for i in range(3):  # each round starts the query anew from its checkpoint
        sent.where(F.col("capture") == i).write.mode("append").parquet(landed)
        taken = ingest.ConflictIngest(folder, jobs.watch(spark, sent.schema, landed)).run()
    return taken.outcomes()


# Windows of three days: a user who is silent for one leaves a gap. Some messages come twice, some with another profile.
_STATS = ["count(*)", "count(*) FILTER (status >= 400)", "avg(duration)", "max(duration)", "min(duration)", "sum(duration)", "max(active)", "avg(active)", "min(active)"]
_MESSAGES = f"""{B.REQ}, cells AS (SELECT CAST(stream AS VARCHAR) AS stream, "window" // 3 AS w, service, {", ".join(f"CAST({x} AS DOUBLE) AS f{i}" for i, x in enumerate(_STATS))},
  CAST(count(status) AS DOUBLE) AS f10, CAST(count(*) FILTER (k >= 50) AS DOUBLE) AS f15, CAST(count(*) FILTER (status IS NULL) AS DOUBLE) / count(*) AS f17 FROM req GROUP BY ALL),
sent AS (SELECT stream, w, 1000 * w AS arrival FROM (SELECT DISTINCT stream, w FROM cells) UNION ALL SELECT stream, w, 1000 * w + 1500 FROM (SELECT DISTINCT stream, w FROM cells) WHERE (w + CAST(stream AS INT)) % 7 = 3),
m AS (SELECT stream, w, 60 * (w + 1) AS "end", arrival, CASE WHEN CAST(stream AS INT) % 11 = 5 AND w >= 7 THEN 'logs' ELSE 'all' END AS profile, row_number() OVER (PARTITION BY stream ORDER BY arrival) AS i FROM sent)"""
_ACCEPT = f"""{_MESSAGES}, run AS (
  SELECT stream, i, w, "end", arrival, profile AS kept, "end" AS last, CAST(NULL AS VARCHAR) AS reason FROM m WHERE i = 1
  UNION ALL
  SELECT m.stream, m.i, m.w, m."end", m.arrival, kept, CASE WHEN m.profile = kept AND m."end" = last + 60 THEN m."end" ELSE last END,
    CASE WHEN m.profile <> kept THEN 'profile' WHEN m."end" <= last THEN 'not later' WHEN m."end" <> last + 60 THEN 'gap' END
  FROM run JOIN m ON m.stream = run.stream AND m.i = run.i + 1)"""
_FEATURES = ["f0", "f1", "f2", "f3", "f4", "f5", "f6", "f7", "f8", "ln(1 + f0)", "f10", "ln(1 + f5)", "f1 / f0", "f3 - f4", "f6 - f8", "f15", "f15 / f0", "f17"]


def feature_messages(spark, d):
    """stream, end, arrival, profile, services: 18 features of each service in windows of three days."""
    count_where = lambda c: F.count_if(c).cast("double")
    status, duration, active = F.col("status"), F.col("duration"), F.col("active").cast("double")
    stats = [F.count(F.lit(1)).cast("double"), count_where(status >= 400), F.avg(duration), F.max(duration), F.min(duration), F.sum(duration), F.max(active), F.avg(active), F.min(active)]
    r = B.req(spark, d).withColumns({"stream": F.col("stream").cast("string"), "w": F.floor(F.col("window") / 3)})
    cells = r.groupBy("stream", "w", "service").agg(*[x.alias(f"f{i}") for i, x in enumerate(stats)], F.count(status).cast("double").alias("f10"), count_where(F.col("k") >= 50).alias("f15"), (count_where(status.isNull()) / F.count(F.lit(1))).alias("f17"))
    vector = F.array(*[F.expr(x) for x in _FEATURES])
    whole = cells.groupBy("stream", "w").agg(F.collect_list(F.struct("service", vector.alias("features"))).alias("services"))  # a row's services are bounded by the fleet
    once = whole.withColumn("arrival", 1000 * F.col("w"))
    again = whole.where((F.col("w") + F.col("stream").cast("int")) % 7 == 3).withColumn("arrival", 1000 * F.col("w") + 1500)
    profile = F.when((F.col("stream").cast("int") % 11 == 5) & (F.col("w") >= 7), "logs").otherwise("all")
    return once.unionByName(again).select("stream", (60 * (F.col("w") + 1)).alias("end"), "arrival", profile.alias("profile"), "services")


def _available(current):
    """A service counts if anything was measured: not all missing, or logs, or traces."""
    return (current[:, 17] < 1) | (current[:, 10] > 0) | (current[:, 15] > 0)


def _mean_of_history(raw):
    return raw.mean(axis=(1, 2))


def _message_thirds():
    return [F.col("arrival") < 3000, (F.col("arrival") >= 3000) & (F.col("arrival") < 7000), F.col("arrival") >= 7000]


@query(
    "t08_feature_stream",
    f"""WITH RECURSIVE {_ACCEPT}, ok AS (SELECT stream, w FROM run WHERE reason IS NULL),
held AS (SELECT c.stream, c.w, service, ({" + ".join(_FEATURES)}) AS total, NOT (f17 >= 1 AND f10 <= 0 AND f15 <= 0) AS valid FROM cells c JOIN ok USING (stream, w)),
scored AS (SELECT a.stream, a.w, a.service, (SELECT sum(h.total) FROM held h WHERE h.stream = a.stream AND h.service = a.service AND h.w BETWEEN a.w - 4 AND a.w) / 90 AS score FROM held a WHERE valid),
best AS (SELECT stream, w, max(score) AS score, list(service ORDER BY score DESC, service) AS names FROM scored GROUP BY stream, w),
seen AS (SELECT a.stream, a.w, count(*) AS n FROM ok a JOIN ok b ON a.stream = b.stream AND b.w BETWEEN a.w - 4 AND a.w GROUP BY ALL)
SELECT run.stream, run."end", run.arrival, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN names IS NULL THEN 'abstained' ELSE 'scored' END AS status, reason,
  CASE WHEN reason IS NULL THEN CAST(n AS INT) ELSE 0 END AS windows, CASE WHEN reason IS NULL THEN {R('score')} END AS score,
  reason IS NULL AND coalesce(score > 9.0, false) AS alert, CASE WHEN reason IS NULL THEN coalesce(names, []) ELSE [] END AS candidates
FROM run LEFT JOIN best USING (stream, w) LEFT JOIN seen USING (stream, w)""",
)
def feature_stream(spark, d):
    """Messages with repeats, gaps and changes of profile; scores over the last five accepted windows."""
    processor = processors.FeatureScorer(_mean_of_history, _available, {"all": 9.0, "logs": 9.0}, 18)
    return jobs.fed(feature_messages(spark, d), _message_thirds(), lambda stream: processors.score_features(stream, processor), runner=processors.run_on_rows)


def feature_histories(messages):
    """stream, end, service, x: the 90 features of five windows that the stream scores, for each available service of the messages
    it accepts: of each stream, in order of arrival, those without a gap after the first. Zeros stand for windows before."""
    arrived = Window.partitionBy("stream").orderBy("arrival")
    once = messages.withColumn("_n", F.row_number().over(Window.partitionBy("stream", "end").orderBy("arrival"))).where("_n = 1")
    placed = once.withColumns({"_n": F.row_number().over(arrived), "_end": F.first("end").over(arrived), "_profile": F.first("profile").over(arrived)})
    accepted = placed.where("end = _end + 60 * (_n - 1) AND profile = _profile").select("stream", "end", F.explode("services").alias("s"))
    last = Window.partitionBy("stream", "s.service").orderBy("end").rangeBetween(-240, 0)  # at most five rows
    held = accepted.withColumn("_held", F.map_from_entries(F.collect_list(F.struct("end", "s.features")).over(last)))
    ends = F.sequence(F.col("end") - 240, F.col("end"), F.lit(60))
    x = F.flatten(F.transform(ends, lambda e: F.coalesce(F.element_at("_held", e), F.array_repeat(F.lit(0.0), 18))))
    f = F.col("s.features")
    return held.where((f[17] < 1) | (f[10] > 0) | (f[15] > 0)).select("stream", "end", F.col("s.service").alias("service"), x.alias("x"))


def history_forest(spark, d):
    """A forest over histories of the first five windows, of which the last has whole ones; None without any."""
    rows = feature_histories(feature_messages(spark, d).where("arrival < 5000"))
    nodes = forest.grow(rows, F.concat_ws("/", "stream", "end", "service"), F.col("x"), trees=25, psi=64).toPandas()  # 25 trees of at most 128 nodes
    return forest.Forest(nodes) if len(nodes) else None


@query("t08_forest_stream")
def forest_stream(spark, d):
    """The same stream, scored by an isolation forest over the 90 features of five windows that was fitted on the histories of
    the first five; its nodes are bounded by trees and sample, and go to the tasks with the processor."""
    fitted = history_forest(spark, d)
    processor = processors.FeatureScorer(lambda raw: fitted.score(raw.reshape(len(raw), -1)), _available, {"all": 0.6, "logs": 0.6}, 18)
    return jobs.fed(feature_messages(spark, d), _message_thirds(), lambda stream: processors.score_features(stream, processor), runner=processors.run_on_rows)
