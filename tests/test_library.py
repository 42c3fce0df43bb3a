"""Operators against literal outputs and against plain Python state machines."""

import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from landing import land
from opslake.functions import scalar, text
from opslake.operators import evaluate, forest, novelty, scoring, sequence, windows
from opslake.sources import files
from opslake.streaming import jobs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "message, template",
    [
        ("[10:00] Took 12.5 s for a12 1-2", "took <num> s for a1<num> <num><num>"),
        ("  id 0123456789abcdef0 failed  ", "id <id> failed"),
        ("A\n\tB -3", "a b <num>"),
        ("\t [x] y\n", "y"),
        ("[a][b] c", "[b] c"),
        ("v2 +5.25e3 x-7 8-9", "v2 <num>e3 x-<num> <num><num>"),
        ("deadbeef0123 DEADBEEF01234567 beef", "<id> <id> beef"),
    ],
)
def test_log_template(spark, message, template):
    assert one(spark, text.log_template(F.col("m")), m=message) == template


def test_template_is_cut(spark):
    assert len(one(spark, text.log_template(F.col("m")), m="x" * 3000)) == 2000


@pytest.mark.parametrize("name, service", [("UserMentionService_", "user-mention-service"), ("NginxThrift", "nginx-thrift"), ("Media", "media")])
def test_kebab_service(spark, name, service):
    assert one(spark, text.kebab_service(F.col("n")), n=name) == service


def test_bracket_epoch(spark):
    expected = datetime(2025, 11, 3, 22, 3, 7, 84255, timezone.utc).timestamp()
    assert one(spark, text.bracket_epoch(F.col("l")), l="[2025-Nov-03 22:03:07.084255] <info>: x") == pytest.approx(expected)
    assert one(spark, text.bracket_epoch(F.col("l")), l="no stamp") is None


def test_lifecycle_line(spark):
    line = "n.log 2017-05-16 00:00:04.500 25746 WARNING nova.compute [req-38101a0b] [instance: b9000564-fe1a-409b-b8cc-1e88b294cd1d] Took 31.27 seconds to build instance."
    row = spark.createDataFrame([(line,), ("torn",)], "l string")
    got = row.select(*[c.alias(n) for n, c in text.lifecycle_fields(F.col("l")).items()]).collect()
    assert got[0].level == "WARNING" and got[0].instance == "b9000564-fe1a-409b-b8cc-1e88b294cd1d" and got[1].level is None
    spent = row.select(*[c.alias(n) for n, c in text.duration_fields(F.col("l")).items()]).collect()
    assert (spent[0].operation, spent[0].duration_seconds) == ("build instance", 31.27) and spent[1].operation is None


def test_severity_line(spark):
    line = "- 1117838570 2005.06.03 R02-M1 2005-06-03-15 R02-M1 RAS KERNEL INFO cache parity error corrected 0x1f"
    row = spark.createDataFrame([(line,), ("few fields",)], "l string").select(*[c.alias(n) for n, c in text.severity_line(F.col("l")).items()]).collect()
    assert (row[0].label, row[0].node, row[0].severity) == (0, "R02-M1", "INFO") and row[0].message.startswith("cache") and row[1].message is None


def test_run_stamp(spark):
    assert str(one(spark, text.run_stamp(F.col("n")), n="case_20250102T030405_metrics_x")) == "2025-01-02 03:04:05"


@pytest.mark.parametrize("x, finite", [(float("nan"), None), (float("inf"), None), (2.0, 2.0)])
def test_finite(spark, x, finite):
    assert one(spark, scalar.finite(F.col("x")), x=x) == finite


def test_missing_status_is_never_unusual(spark):
    rows = spark.createDataFrame([(None,), (0,), (200,), (399,), (400,), (100,)], "s int").select(scalar.unusual_status(F.col("s")).alias("u")).collect()
    assert [r.u for r in rows] == [False, False, False, False, True, True]


def test_counter_rates(spark):
    rows = [(1, 10, 100.0), (1, 20, 130.0), (1, 20, 140.0), (1, 30, 5.0), (1, 40, 15.0)]
    got = windows.counter_rates(spark.createDataFrame(rows, "s int, t int, v double"), ["s"], "t", "v").orderBy("t").collect()
    assert [(r.t, r.rate, r.reset) for r in got] == [(20, 3.0, False), (30, None, True), (40, 1.0, False)]


def test_causal_change_uses_only_the_warm_up(spark):
    rows = [("a", i, float(x), None) for i, x in enumerate([1, 2, 3, 4, 5, 50, 3])]
    got = {r.w: r for r in windows.causal_change(spark.createDataFrame(rows, "s string, w int, x double, y double"), ["s"], "w", ["x", "y"]).collect()}
    spread = np.std([1, 2, 3, 4, 5])
    assert got[5].x_change == pytest.approx(47 / spread) and got[6].x_change == 0 and got[5].y_change == 0 and got[5].columns_missing == 1


def random_flags(seed):
    rng = random.Random(seed)
    return [(s, w, w + 1, rng.random() < 0.5) for s in "abc" for w in range(40)]


def incidents(rows):
    out = []
    for s in sorted({r[0] for r in rows}):
        active, warn, clear = False, 0, 0
        for _, start, end, w in sorted(r for r in rows if r[0] == s):
            warn, clear = (warn + 1, 0) if w else (0, clear + 1)
            if warn >= 2 and not active or clear >= 2 and active:
                active = not active
                out.append((s, start, end, "open" if active else "close"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_incidents_equal_the_state_machine(spark, seed):
    rows = random_flags(seed)
    frame = spark.createDataFrame(rows, "service string, window int, until int, warning boolean")
    got = sequence.incident_transitions(frame, ["service"], "window", "until", "warning").collect()
    assert sorted(map(tuple, got)) == incidents(rows)


def test_incident_fixture(spark):
    flags = [False, True, True, True, False, False]
    rows = [("x", 10 + 3 * i, 13 + 3 * i, f) for i, f in enumerate(flags)]
    frame = spark.createDataFrame(rows, "s string, a int, b int, f boolean")
    got = sequence.episodes(sequence.incident_transitions(frame, ["s"], "a", "b", "f"), ["s"]).first()
    assert (got.opened_at, got.closed_at) == (19, 28)


@pytest.mark.parametrize("seed", range(2))
def test_coverage_guard_equals_the_state_machine(spark, seed):
    rng = random.Random(seed)
    rows = [(s, w, rng.random() < 0.6) for s in "abcde" for w in range(30)]
    expected = spark.createDataFrame([(s, 2) for s in "abcde"], "service string, threshold int")
    got = {(r.service, r.window): (r.gap, r.issue) for r in sequence.coverage_guard(spark.createDataFrame(rows, "service string, window int, seen boolean"), expected, required=0.5).collect()}
    gap = dict.fromkeys("abcde", 0)
    for w in range(30):
        seen = {s: x for s, v, x in rows if v == w}
        enough = sum(seen.values()) / 5 >= 0.5
        for s in "abcde":
            gap[s] = gap[s] + 1 if enough and not seen[s] else 0
            assert got[s, w] == (gap[s], gap[s] >= 2)


def test_tail_ranks(spark):
    reference = spark.createDataFrame([("op", float(v)) for v in range(100)], "o string, v double")
    query = spark.createDataFrame([("op", 1000.0), ("op", 99.0), ("op", -1.0)], "o string, v double")
    got = {r.v: r.p for r in sequence.tail_ranks(reference, query, "o", "v").collect()}
    assert got == {1000.0: 1 / 101, 99.0: 2 / 101, -1.0: 1.0}


def test_stitching(spark):
    lines = [(0, "lost"), (1, "[a] x"), (2, "more"), (3, "[b] y")]
    frame = spark.createDataFrame([(1, *x) for x in lines], "f int, n int, t string")
    got = {r.event: r.message for r in sequence.stitch_lines(frame, ["f"], "n", "t", F.col("t").startswith("[")).collect()}
    assert got == {0: "lost", 1: "[a] x\nmore", 2: "[b] y"}


def test_sequence_status(spark):
    frame = spark.createDataFrame([("a", e, i) for i, e in enumerate([120, 120, 60, 240, 180, 300])], "s string, e int, i int")
    assert [r.status for r in sequence.sequence_status(frame, ["s"], "e", "i", 60).orderBy("i").collect()] == ["ok", "duplicate", "late", "gap", "late", "ok"]


def test_average_precision_and_auc_merge_ties(spark):
    frame = spark.createDataFrame([(3.0, 1), (2.0, 1), (2.0, 0), (1.0, 0)], "s double, y int")
    assert evaluate.average_precision(frame, "s", "y").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert evaluate.roc_auc(frame, "s", "y").first()[0] == pytest.approx(0.875)


def test_undefined_metrics_are_zero(spark):
    frame = spark.createDataFrame([(0, None), (0, False)], "y int, a boolean")
    row = evaluate.binary_metrics(frame, F.col("y") == 1, F.col("a")).first()
    assert (row.tn, row.precision, row.recall, row.f1) == (2, 0, 0, 0)


def test_higher_quantile(spark):
    row = spark.range(1).select(evaluate.higher_quantile(F.array(*[F.lit(float(x)) for x in (5, 1, 3, 2)]), 0.5).alias("x")).first()
    assert row.x == np.quantile([5, 1, 3, 2], 0.5, method="higher")


def test_conflicts_and_duplicates(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c")], "k int, p string")
    assert {(r.k, r.kind) for r in evaluate.duplicates(frame, ["k"], ["p"]).collect()} == {(1, "duplicate"), (2, "conflict")}


def test_contract_counts_unknown_as_broken(spark):
    frame = spark.createDataFrame([(1,), (None,), (99,)], "x int")
    got = scoring.contract(frame, [("small", F.col("x") < 10)]).collect()
    assert [r.violations for r in got] == [[], ["small"], ["small"]]


def test_envelopes_have_a_factor_a_floor_and_a_margin(spark):
    frame = spark.createDataFrame([("slow", 100.0, 0.5), ("quick", 3.0, 0.0)], "service string, p95 double, error_fraction double")
    got = {r.service: (r.latency_limit, r.error_limit) for r in windows.envelopes(frame).collect()}
    assert got == {"slow": (200.0, 0.55), "quick": (50.0, 0.05)}


def test_forest_finds_the_outlier_and_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(400)] + [(999, 9.0, 9.0, 9.0)]
    frame = spark.createDataFrame(rows, "id int, a double, b double, c double")
    nodes = forest.grow(frame, F.col("id"), ["a", "b", "c"], trees=50, psi=64)
    assert nodes.where("node = 0").agg(F.min("size"), F.max("size")).first() == (64, 64)
    first = forest.score(frame, nodes, ["a", "b", "c"]).orderBy(F.col("score").desc()).first()
    again = forest.grow(frame.repartition(7), F.col("id"), ["a", "b", "c"], trees=50, psi=64)
    assert first.id == 999 and nodes.exceptAll(again).isEmpty()


def test_lexical_novelty(spark):
    known = spark.createDataFrame([(1, "disk read error on node"), (2, "user logged in")], "p int, t string")
    texts = spark.createDataFrame([(1, "Disk read error on node"), (2, "zzz qqq"), (3, "user logged out")], "k int, t string")
    got = {r.k: r.novelty for r in novelty.lexical_novelty(texts, "k", "t", known, "p", "t").collect()}
    assert got[1] == pytest.approx(0) and got[2] == 1 and 0 < got[3] < 1


def test_vector_novelty_in_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 8).tolist(), int(i >= 30)) for i in range(50)]
    frame = spark.createDataFrame(rows, "i int, v array<double>, q int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    for block in (4096, 7):
        for r in novelty.vector_novelty(frame, "i", "v", F.col("q") == 0, block).collect():
            assert r.novelty == pytest.approx(1 - max(unit[r.i] @ unit[j] for j in range(30)))


def test_templates_are_frozen_in_matching(spark):
    lines = spark.createDataFrame([("open file a1 now",), ("open file b2 now",), ("close it",)], "l string")
    found = novelty.mine_templates(lines, "l")
    assert {(r.template, r.n) for r in found.collect()} == {("open file <*> now", 2), ("close it", 1)}
    new = spark.createDataFrame([("open file zz now",), ("something else",)], "l string")
    assert [r.known for r in novelty.match_templates(new, "l", found).orderBy("l").collect()] == [True, False]


def test_stream_equals_batch(spark):
    rows = random_flags(7)
    frame = spark.createDataFrame(rows, "service string, window int, until int, warning boolean")
    stream = land(frame, [F.col("window") < 13, F.col("window").between(13, 26), F.col("window") > 26])
    out = jobs.run(jobs.stateful(stream, ["service"], ["window"], "service string, start int, at int, kind string", "active boolean, warnings int, clears int", jobs.incident_step))
    assert sorted(map(tuple, out.collect())) == incidents(rows)


def test_contiguous_messages(spark):
    frame = spark.createDataFrame([("a", e, i) for i, e in enumerate([120, 120, 60, 240, 180])], "s string, end int, arrival int")
    out = jobs.run(jobs.stateful(land(frame, [F.lit(True)]), ["s"], ["arrival"], "s string, end long, arrival long, status string, history int", "last long, history int", jobs.contiguous_step(60, 5)))
    assert [(r.status, r.history) for r in out.orderBy("arrival").collect()] == [("accepted", 1), ("rejected", 1), ("rejected", 1), ("rejected", 1), ("accepted", 2)]


def test_a_changed_model_stops_the_stream(spark):
    frame = spark.createDataFrame([(1, "m2")], "i int, model string")
    with pytest.raises(Exception, match="model has changed"):
        jobs.run(jobs.guarded(land(frame, [F.lit(True)]), "model", "m1"))


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfname,value\nx,1.5\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv"), "name string, value double").collect() == [("x", 1.5)]
    (tmp_path / "e.jsonl").write_text('{"service":"a","status":200}\n{"service":"b"')
    assert [r.service for r in files.read_jsonl(spark, str(tmp_path / "e.jsonl"), files.REQUEST).collect()] == ["a"]
    (tmp_path / "l.txt").write_text("one\ntwo\nthree\n")
    assert [(r.line, r.value) for r in files.numbered_lines(spark, str(tmp_path / "l.txt")).orderBy("line").collect()] == [(1, "one"), (2, "two"), (3, "three")]
    for case in ("c1", "c2"):
        spark.createDataFrame([(1.0,)], "v double").write.parquet(str(tmp_path / "cases" / case / "metrics.parquet"))
    assert sorted(r.case for r in files.read_cases(spark, str(tmp_path / "cases"), "metrics").collect()) == ["c1", "c2"]


def test_entry_and_registered_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
