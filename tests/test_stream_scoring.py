"""Processors, commits and conflict ingest against plain Python, with restarts, expiry and refusals."""

import random
from collections import defaultdict

import pytest
from landing import land
from pyspark.sql import functions as F

from opslake.streaming import ingest, jobs, processors
from opslake.streaming.commits import Commits

DAY = processors.DAY_MS
MESSAGE = "stream string, end long, arrival long, profile string, services array<struct<service: string, features: array<double>>>"


def feature_scorer(**how):
    """The functions are made here, so that they travel to the workers with the processor."""
    return processors.FeatureScorer(lambda raw: raw[:, :, :2].sum(axis=(1, 2)), lambda current: current[:, 2] < 1, {"a": 6, "b": 1}, 3, **how)


def scored_by_hand(rows, step=60, kept=5):
    """The rules of the scorer, message by message."""
    state, out = {}, []
    for s, end, arrival, profile, services in sorted(rows, key=lambda r: r[2]):
        place, history = state.get(s, (None, []))
        reason = "profile" if place and profile != place[0] else "not later" if place and end <= place[1] else "gap" if place and end != place[1] + step else None
        if reason:
            out.append((arrival, s, "rejected", reason, 0, None, False, []))
            continue
        current = dict(services)
        history = [h for h in history if h[0] > end - kept * step] + [(end, current)]
        state[s] = ((profile, end), history)
        values = {n: sum(sum(c[n][:2]) for _, c in history if n in c) for n, f in current.items() if f[2] < 1}
        names = sorted(values, key=lambda n: (-values[n], n))[:5]
        best = values[names[0]] if names else None
        out.append((arrival, s, "scored" if names else "abstained", None, len(history), best, bool(names) and best > {"a": 6, "b": 1}[profile], names))
    return sorted(out, key=str)


def messages(n=300):
    rng = random.Random(4)
    rows, ends = [], defaultdict(lambda: 60)
    for i in range(n):
        s = rng.choice("pqr")
        end = ends[s] + rng.choice([0, 60, 60, 60, 60, 60, 60, 60, 120]) if rng.random() < 0.9 else ends[s]
        ends[s] = max(ends[s], end) if rng.random() < 0.97 else ends[s]
        services = [(n, [float(rng.randrange(3)), float(rng.randrange(2)), float(rng.random() < 0.4)]) for n in "uvwxyz" if rng.random() < 0.6]
        rows.append((s + str(i // 60), end, i, "b" if rng.random() < 0.05 else "a", services))
    return rows


def test_feature_scores_equal_a_loop_over_restarts(spark):
    rows = messages()
    frame = spark.createDataFrame(rows, MESSAGE)
    processor = feature_scorer()
    parts = [F.col("arrival") < 70, F.col("arrival").between(70, 180), F.col("arrival") > 180]
    out = jobs.fed(frame, parts, lambda s: processors.score_features(s, processor), runner=processors.run_on_rows)
    got = sorted(((r.arrival, r.stream, r.status, r.reason, r.windows, r.score, r.alert, r.candidates) for r in out.collect()), key=str)
    true = scored_by_hand(rows)
    assert got == true
    assert {r[2] for r in true} == {"scored", "abstained", "rejected"} and {r[3] for r in true} == {None, "profile", "not later", "gap"}


def test_expired_state_starts_anew(spark):
    frame = spark.createDataFrame([("s", 60, 0, "a", [("u", [1.0, 1.0, 0.0])]), ("s", 600, 1, "b", [("u", [1.0, 1.0, 0.0])])], MESSAGE)
    statuses = {}
    for ttl in (1, None):
        processor = feature_scorer(ttl_ms=ttl)
        out = jobs.fed(frame, [F.col("arrival") == 0, F.col("arrival") == 1], lambda s, p=processor: processors.score_features(s, p), runner=processors.run_on_rows)
        statuses[ttl] = [(r.status, r.windows) for r in out.orderBy("arrival").collect()]
    assert statuses == {1: [("scored", 1), ("scored", 1)], None: [("scored", 1), ("rejected", 0)]}


def test_silent_services_are_closed_by_a_timer(spark):
    """a warns on days 0 to 2 and is never heard again; b goes on; the mark of time is on day 20."""
    rows = [("a", float(w), 1) for w in range(3)] + [("b", float(w), int(w in (4, 5))) for w in range(12)] + [("clock", 20.0, 0)]
    frame = spark.createDataFrame(rows, "service string, day double, hot int").withColumn("at", F.timestamp_millis((F.col("day") * DAY + 1000).cast("long")))
    model = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "service string, base double")
    built = lambda s: processors.online_incidents(s, "at", "1 hour", "1 day", [F.max("hot").alias("hot")], model, F.col("hot") > F.col("base"), processors.Incidents(DAY, silence=4))
    out = jobs.fed(frame, [F.col("day") < 6, F.col("day") >= 6], built, runner=processors.run)
    assert sorted(map(tuple, out.collect())) == [("a", 1, 2, "open"), ("a", 2, 7, "silent"), ("b", 5, 6, "open"), ("b", 7, 8, "close")]


def test_coverage_of_days_without_any_event(spark):
    """Days 3 and 4 have no event at all: no row says so, the timers do."""
    present = {0: "abc", 1: "ab", 2: "a", 5: "ab", 6: "abc", 7: "ab", 8: "ab"}
    rows = [(s, float(w)) for w, names in present.items() for s in names] + [("clock", 15.0)]
    frame = spark.createDataFrame(rows, "service string, day double").withColumn("at", F.timestamp_millis((F.col("day") * DAY + 5000).cast("long")))
    expected = spark.createDataFrame([(s,) for s in "abc"], "service string")
    guard = processors.CoverageGuard(2, 0.5, DAY)
    built = lambda s: processors.coverage_stream(lambda: s, "at", "1 hour", "1 day", expected, guard)
    out = jobs.fed(frame, [F.col("day") < 6, F.col("day") >= 6], built, runner=processors.run).where("service <> 'clock' AND window < 9")
    true, gaps = [], dict.fromkeys("abc", 0)
    for w in range(9):
        names = present.get(w, "")
        for s in "abc":
            low = len(names) / 3 < 0.5
            gaps[s] = 0 if s in names or low else gaps[s] + 1
            true.append((s, w, s in names, round(len(names) / 3, 6), low, gaps[s], gaps[s] >= 2))
    got = sorted((r.service, r.window, r.seen, round(r.coverage, 6), r.insufficient, r.gap, r.issue) for r in out.collect())
    assert got == sorted(true) and any(r[6] for r in true)


CAPTURE = "step int, source string, service string, span long, payload string, transport double"


def test_conflicts_refuse_their_capture_whole(spark):
    rows = [
        (0, "x", "s", 1, "p", 1.0), (0, "x", "s", 2, "p", 2.0), (0, "y", "s", 3, "p", 9.0),
        (1, "x", "s", 1, "p", 1.0), (1, "x", "s", 4, "p", 5.0),  # a repeat, and a new one
        (1, "y", "s", 3, "changed", 11.0), (1, "y", "s", 5, "p", 12.0),  # a conflict: neither is taken, the mark stays
        (1, "z", "s", 6, "p", 3.0), (1, "z", "s", 6, "q", 3.5),  # two payloads in one capture
        (2, "y", "s", 5, "p", 12.0), (2, "y", "t", 3, "changed", 10.0),  # another service's span 3 is another event
        (2, "a", "s", 7, "p", 1.0), (2, "b", "s", 7, "q", 1.0), (2, "b", "s", 8, "p", 1.0),  # the second source of a trigger conflicts
    ]
    frame = spark.createDataFrame(rows, CAPTURE)
    landed, folder = jobs.new_folder(spark, "landed"), jobs.new_folder(spark, "stream")
    for i in range(3):
        frame.where(F.col("step") == i).write.mode("append").parquet(landed)
        taken = ingest.ConflictIngest(folder, jobs.watch(spark, frame.schema, landed), compact_every=2).run()
    assert sorted((r.service, r.span) for r in taken.events().collect()) == [("s", 1), ("s", 2), ("s", 3), ("s", 4), ("s", 5), ("s", 7), ("t", 3)]
    assert sorted(tuple(r) for r in taken.outcomes().collect()) == [(0, "x", False, 2, 2.0), (0, "y", False, 1, 9.0), (1, "x", False, 1, 5.0), (1, "y", True, 0, 9.0), (1, "z", True, 0, None), (2, "a", False, 1, 1.0), (2, "b", True, 0, None), (2, "y", False, 2, 12.0)]
    assert sorted((r.capture, r.source, r.span) for r in taken.quarantine().collect()) == [(1, "y", 3), (1, "z", 6), (2, "b", 7)]
    assert {r.source: r.mark for r in taken.marks().collect()} == {"x": 5.0, "y": 12.0, "a": 1.0}


def test_a_killed_ingest_is_replayed_once(spark, monkeypatch):
    frame = spark.createDataFrame([(0, "x", "s", i, "p", float(i)) for i in range(20)], CAPTURE)
    landed, folder = jobs.new_folder(spark, "landed"), jobs.new_folder(spark, "stream")
    frame.write.parquet(landed)
    real = Commits.drop
    monkeypatch.setattr(Commits, "drop", lambda *a: (_ for _ in ()).throw(RuntimeError("killed after the commit")))
    with pytest.raises(Exception, match="killed"):
        ingest.ConflictIngest(folder, jobs.watch(spark, frame.schema, landed)).run()
    monkeypatch.setattr(Commits, "drop", real)
    taken = ingest.ConflictIngest(folder, jobs.watch(spark, frame.schema, landed)).run()
    assert taken.events().count() == 20 and [(r.inserted, r.refused) for r in taken.outcomes().collect()] == [(20, False)]
    assert taken.commits.vacuum() > 0 and taken.events().count() == 20


def test_a_commit_is_seen_whole_or_not_at_all(spark, monkeypatch):
    commits = Commits(spark, jobs.new_folder(spark, "commits"))
    frame = spark.createDataFrame([(i,) for i in range(10)], "i int")
    commits.commit(0, a=frame, b=frame)
    put = Commits._put
    monkeypatch.setattr(Commits, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed between write and commit")))
    with pytest.raises(RuntimeError):
        commits.commit(1, a=frame, b=frame)
    monkeypatch.setattr(Commits, "_put", put)
    assert commits.last() == 0 and commits.read("a", frame.schema).count() == commits.read("b", frame.schema).count() == 10
    commits.commit(1, a=frame)
    commits.commit(1, a=frame.where("i < 4"), b=frame)  # again: replaces
    assert (commits.read("a", frame.schema).count(), commits.read("b", frame.schema).count(), commits.read("a", frame.schema, first=1).count()) == (14, 20, 4)
    assert commits.read("none", frame.schema).count() == 0


def test_merged_parts_read_the_same(spark):
    commits = Commits(spark, jobs.new_folder(spark, "commits"))
    for n in range(5):
        commits.commit(n, a=spark.createDataFrame([(n, i) for i in range(3)], "n int, i int"), b=spark.createDataFrame([(n,)], "n int"))
    schema = commits.read("b", spark.createDataFrame([(0,)], "n int").schema).schema
    pairs = spark.createDataFrame([(0, 0)], "n int, i int").schema
    before = sorted(map(tuple, commits.read("a", pairs).collect()))
    old = commits.read("a", pairs)  # a reader from before the merge
    commits.compact("a", pairs, 3, 1)
    assert sorted(map(tuple, commits.read("a", pairs).collect())) == before == sorted(map(tuple, old.collect()))
    assert len([n for t in commits._visible(commits.entries()).values() for n in t.get("a", [])]) == 2
    commits.compact("a", pairs, 4, 1)  # a merge of a merge
    assert commits.vacuum() == 6 and sorted(map(tuple, commits.read("a", pairs).collect())) == before
    assert sorted(r.n for r in commits.read("b", schema).collect()) == [0, 1, 2, 3, 4]
    commits.drop("b", 3)
    assert [r.n for r in commits.read("b", schema).collect()] == [4]
