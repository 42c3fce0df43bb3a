"""Contracts, ingestion, ledgers and restarts, against plain Python and against fixtures of the producers."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from landing import land, roll, watch
from opslake.operators import contracts as K
from opslake.plans import contract_queries
from opslake.sources import files
from opslake.streaming import jobs

EVENT = {
    "schema": "request-v1",
    "service": "checkout",
    "trace_id": "a" * 32,
    "span_id": "0" * 32,
    "parent_span_id": None,
    "start": 10.0,
    "end": 10.01,
    "duration_ms": 10.0,
    "status": 200,
    "active_requests": 1,
    "message": "ok",
    "dependency": None,
    "dependency_status": None,
}


def request_violations(spark, *events):
    lines = spark.createDataFrame([(e if isinstance(e, str) else json.dumps(e),) for e in events], "value string")
    return [r.violations for r in contract_queries.checked_requests(lines).collect()]


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, []),
        ({"root_cause": "disk"}, ["fields"]),
        ({"duration_ms": 900.0}, ["clock"]),
        ({"duration_ms": math.nan}, ["duration_ms", "clock", "fields"]),
        ({"end": 9.0}, ["order", "clock"]),
        ({"trace_id": "A" * 32}, ["trace_id"]),
        ({"span_id": "0" * 31}, ["span_id"]),
        ({"parent_span_id": "x"}, ["parent_span_id"]),
        ({"status": 99}, ["status"]),
        ({"status": None}, ["status"]),
        ({"message": "x" * 2001}, ["message"]),
        ({"dependency": "frontend", "dependency_status": 600}, ["dependency", "dependency_status"]),
        ({"active_requests": 0, "service": "cart"}, ["service", "active_requests"]),
    ],
)
def test_request_contract(spark, change, broken):
    assert request_violations(spark, EVENT | change) == [broken]


def test_a_line_that_is_no_json_breaks_every_rule_of_presence(spark):
    assert "service" in request_violations(spark, '{"service": "che')[0]


def test_quarantine_keeps_every_row(spark):
    lines = spark.createDataFrame([(json.dumps(EVENT | {"status": s}),) for s in (200, 99, 700)], "value string")
    valid, broken = K.split(contract_queries.checked_requests(lines))
    assert valid.count() == 1 and broken.count() == 2 and "violations" in broken.columns


def test_log_contract(spark):
    good = ("2024-05-06T07:08:09Z", "gateway", "INFO", "m", 5.0)
    rows = [good, ("2024-05-06T07:08:09", *good[1:]), ("2024-02-30T07:08:09Z", *good[1:]), (good[0], "cart", "DEBUG", "", float("inf")), ("2024-05-06T09:08:39+02:00", *good[1:]), ("2024-05-06T07:09:10Z", *good[1:])]
    frame = spark.createDataFrame(rows, "timestamp string, service string, level string, message string, latency_ms double")
    checked = K.check(frame, K.log_rules())
    assert [r.violations for r in checked.collect()] == [[], ["timestamp"], ["timestamp"], ["service", "level", "message", "latency_ms"], [], []]
    windows = lambda f: K.log_windows(f, ["service"]).collect()[0].violations
    assert windows(checked.limit(1)) == [] and windows(checked.where("size(violations) = 0")) == ["window_span"] and windows(checked.where("service = 'gateway' AND timestamp NOT LIKE '%:10Z'")) == ["event"]


def feature_message(**change):
    features = [1.0] * 18
    for i, v in change.pop("at", {}).items():
        features[i] = v
    services = change.pop("services", [("a", features), ("b", [0.0] * 18)])
    return (change.get("stream", "s-1"), change.get("profile", "ob"), change.get("end", 120), change.get("feature_schema", "f1"), services)


@pytest.mark.parametrize(
    ("message", "broken"),
    [
        (feature_message(), []),
        (feature_message(end=121), ["end"]),
        (feature_message(stream="a b", profile="x", feature_schema="f0"), ["stream", "profile", "feature_schema"]),
        (feature_message(at={10: 2.0}), ["flags"]),
        (feature_message(at={16: 1.5}), ["shares"]),
        (feature_message(at={0: -1.0}), ["features"]),
        (feature_message(at={0: math.inf}), ["features"]),
        (feature_message(services=[("a", [0.0] * 18), ("a", [0.0] * 18)]), ["unique"]),
        (feature_message(services=[("a b", [0.0] * 18)]), ["service"]),
        (feature_message(services=[]), ["services"]),
        (feature_message(services=[(f"s{i}", [0.0] * 18) for i in range(129)]), ["services"]),
    ],
)
def test_feature_contract(spark, message, broken):
    frame = spark.createDataFrame([message], "stream string, profile string, end long, feature_schema string, services array<struct<service: string, features: array<double>>>")
    assert K.check(frame, K.feature_rules("f1")).first().violations == broken


def test_parameter_contract_and_batches(spark):
    good = ("b", "0123abcd-0123-0123-0123-0123456789ab", "build instance", 31.27, 1, "2024-05-06 07:08:09.5")
    bad = [(*good[:1], "0123ABCD-0123-0123-0123-0123456789ab", *good[2:]), (*good[:2], "resize", *good[3:]), (*good[:3], -1.0, *good[4:]), (*good[:4], 0, good[5]), (*good[:5], "2024-05-06 07:08:09"), (*good[:5], "2024-13-06 07:08:09.5")]
    frame = spark.createDataFrame([good, *bad], "batch string, instance string, operation string, duration_seconds double, line_number int, observed_timestamp string")
    checked = K.check(frame, K.parameter_rules())
    assert [r.violations for r in checked.collect()] == [[], ["instance"], ["operation"], ["duration_seconds"], ["line_number"], ["observed_timestamp"], ["observed_timestamp"]]
    assert K.batches(checked, ["batch"], [], most=6).first().violations == ["event", "batch_size"]
    assert K.batches(checked.limit(1), ["batch"], []).first().violations == []


# ingestion ---------------------------------------------------------------------------------------------------------


def ingest_by_hand(parts, width):
    pending, out = [], []
    for n, part in enumerate(parts):
        rows, pending = pending + part, []
        for key, at in rows:
            if at >= (n + 1) * width:
                pending.append((key, at))
            else:
                out.append((n, key, at, "late" if at < n * width else "current"))
    return sorted(out)


def test_windows_close_one_a_batch_and_nothing_is_lost(spark):
    rng = random.Random(1)
    parts = [[(f"k{rng.randrange(3)}", rng.randrange(40)) for _ in range(30)] for _ in range(4)]
    frame = spark.createDataFrame([(i, k, a) for i, p in enumerate(parts) for k, a in p], "part_no int, key string, at int")
    stream = land(frame, [F.col("part_no") == i for i in range(4)]).drop("part_no")
    out = jobs.ledger(stream, jobs.windowed_ingest(10, ["key"], "at"), "key string, at int, part string", jobs.new_folder(spark, "stream"))
    assert sorted((r.batch, r.key, r.at, r.part) for r in out.collect()) == ingest_by_hand(parts, 10)


def test_the_native_window_fixture(spark):
    """Rows that end at 5, 11 and 15 against the window from 10 to 12: late, current, pending."""
    step = jobs.windowed_ingest(2, [], "at")
    batch = spark.createDataFrame([(5.0,), (11.0,), (15.0,)], "at double")
    assert [r.part for r in step(batch, batch.limit(0), 5).orderBy("at").collect()] == ["late", "current", "state"]


class Killed(Exception):
    pass


def test_a_batch_that_died_after_its_write_is_replayed_once(spark):
    """State and output of the batch were written but not committed; the restart must not count the batch twice."""
    rows = [(i // 10, f"s{i % 3}", i) for i in range(40)]
    frame = spark.createDataFrame(rows, "third int, service string, v int")
    folder, landed = jobs.new_folder(spark, "stream"), jobs.new_folder(spark, "landed")
    for i in range(4):
        roll(frame.where(F.col("third") == i).drop("third"), landed)
    schema = "service string, n long, part string"

    def counts(batch, state, number):
        now = batch.groupBy("service").agg(F.count(F.lit(1)).alias("n")).unionByName(state.select("service", "n")).groupBy("service").agg(F.sum("n").alias("n"))
        return now.withColumn("part", F.explode(F.array(F.lit("state"), F.lit("sum"))))

    def die(number):
        if number == 2:
            raise Killed

    read = lambda: watch(spark, frame.drop("third").schema, landed)
    with pytest.raises(Exception, match="Killed"):
        jobs.ledger(read(), counts, schema, folder, after_write=die)
    out = jobs.ledger(read(), counts, schema, folder)
    true = [(b, f"s{s}", sum(1 for t, _, i in rows if t <= b and i % 3 == s)) for b in range(4) for s in range(3)]
    assert sorted((r.batch, r.service, r.n) for r in out.collect()) == true


def test_a_batch_that_died_before_its_write_leaves_nothing(spark):
    frame = spark.createDataFrame([(1,), (2,)], "v int")
    folder, landed = jobs.new_folder(spark, "stream"), jobs.new_folder(spark, "landed")
    roll(frame, landed)
    fail = [True]

    def step(batch, state, number):
        if fail[0]:
            raise Killed
        return batch.withColumn("part", F.lit("out"))

    with pytest.raises(Exception, match="Killed"):
        jobs.ledger(watch(spark, frame.schema, landed), step, "v int, part string", folder)
    fail[0] = False
    assert jobs.ledger(watch(spark, frame.schema, landed), step, "v int, part string", folder).count() == 2


def test_grace_counts_what_was_captured_in_time(spark):
    rows = [("a", 1, 1.0, 1.5), ("a", 2, 9.0, 12.9), ("a", 3, 9.5, 13.5), ("a", 4, 14.0, 14.5), ("a", 5, 24.0, 30.0)]
    frame = spark.createDataFrame(rows, "service string, span long, at double, captured double")
    stream = land(frame, [F.col("span") <= 2, F.col("span") == 3, F.col("span") >= 4])
    out = jobs.ledger(stream, jobs.grace_ingest(10, 3, ["service", "span"], "at", "captured"), "service string, span long, at double, captured double, clock double, part string", jobs.new_folder(spark, "stream"))
    assert sorted((r.span, r.part) for r in out.collect()) == [(1, "current"), (2, "current"), (3, "late"), (4, "current")]


def test_resume_reads_the_overlap_again_and_adds_each_row_once(spark):
    stored = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0)], "service string, span long, at double")
    source = spark.createDataFrame([("a", 1, 10.0), ("a", 7, 17.9), ("a", 3, 18.5), ("a", 2, 20.0), ("a", 4, 21.0), ("a", 4, 21.0), ("b", 9, 1.0)], "service string, span long, at double")
    assert sorted(r.span for r in jobs.resume(stored, source, "service", ["span"], "at", 2.0).collect()) == [3, 4, 9]


def test_a_refused_batch_keeps_what_came_before(spark):
    frame = spark.createDataFrame([(i, "m1" if i < 4 else "m2") for i in range(6)], "i int, model string")
    kept, refused = jobs.run_until_refused(frame, [F.col("i") < 4, F.col("i") >= 4], lambda stream: jobs.guarded(stream, "model", "m1"), "model has changed")
    assert refused and sorted(r.i for r in kept.collect()) == [0, 1, 2, 3]
    kept, refused = jobs.run_until_refused(frame, [F.lit(True)], lambda stream: stream, "model has changed")
    assert not refused and kept.count() == 6


def test_a_stream_goes_on_from_its_checkpoint(spark):
    frame = spark.createDataFrame([(i,) for i in range(6)], "i int")
    landed, folder = jobs.new_folder(spark, "landed"), jobs.new_folder(spark, "stream")
    roll(frame.where("i < 3"), landed)
    assert jobs.run(watch(spark, frame.schema, landed), folder=folder).count() == 3
    roll(frame.where("i >= 3"), landed)
    assert sorted(r.i for r in jobs.run(watch(spark, frame.schema, landed), folder=folder).collect()) == list(range(6))


def test_messages_of_a_stream_are_judged_like_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), 60 * rng.randrange(8), i) for i in range(200)]
    frame = spark.createDataFrame(rows, "s string, end int, arrival int")
    out = jobs.run(jobs.stateful(land(frame, [F.col("arrival") < 90, F.col("arrival") >= 90]), ["s"], ["arrival"], "s string, end long, arrival long, status string, history int", "last long, history int", jobs.contiguous_step(60, 5)))
    state, true = {}, []
    for s, end, arrival in rows:
        last, kept = state.get(s, (None, 0))
        ok = last is None or end == last + 60
        state[s] = (end, min(5, kept + 1)) if ok else (last, kept)
        true.append((arrival, s, "accepted" if ok else "rejected", state[s][1]))
    assert sorted((r.arrival, r.s, r.status, r.history) for r in out.collect()) == true


def test_exported_files_follow_each_other_in_order(spark, tmp_path):
    rng = random.Random(3)
    frame = spark.createDataFrame([(rng.choice("aab"), rng.random(), i) for i in range(500)], "k string, t double, i int")
    files.write_ordered_json(frame, str(tmp_path / "out"), "k", ["t", "i"])
    for k in "ab":
        found = sorted((tmp_path / "out" / f"k={k}").glob("*.json"))
        got = [json.loads(line)["t"] for f in found for line in f.read_text().splitlines()]
        assert got == sorted(r.t for r in frame.where(F.col("k") == k).collect()) and got


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "l.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = files.numbered_lines(spark, str(tmp_path / "l.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.line, r.value) for r in got} == {(i + 1, f"line {i}") for i in range(5000)}
