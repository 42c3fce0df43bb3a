"""Hot groups, intervals, sparse blocks, decisions and diagnoses against plain Python."""

import json
import math
import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslake.operators import diagnosis, evaluate, novelty, ranking, scoring, selection, windows


def quantile(values, q):
    return float(np.quantile(np.array(values, float), q))


@pytest.mark.parametrize("group_rows", [10, 1 << 20])
def test_quantiles_of_hot_and_small_groups(spark, group_rows):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.random(), 0.5, None])) for _ in range(3000)] + [(k, float(rng.randrange(5))) for k in "abc" for _ in range(rng.randrange(1, 9))] + [("one", 7.0), ("none", None), (None, 3.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    by = defaultdict(list)
    for k, v in rows:
        by[k] += [v] if v is not None else []
    out = ranking.with_quantiles(frame, ["k"], [F.count(F.lit(1)).alias("n")], "v", {"a": 0.5, "z": 0.95}, group_rows)
    got = {r.k: (r.n, r.a, r.z) for r in out.collect()}
    assert {k: n for k, (n, _, _) in got.items()} == Counter(k for k, _ in rows)
    for k, values in by.items():
        want = [quantile(values, q) for q in (0.5, 0.95)] if values else [None, None]
        assert got[k][1:] == pytest.approx(want) if values else list(got[k][1:]) == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_of_overlapping_intervals_and_a_hot_bucket(spark, how):
    rng = random.Random(2)
    points = [(i, "hot" if i % 3 else rng.choice("abc"), rng.uniform(0, 30) if i % 4 else 15.25) for i in range(900)] + [(9001, None, 3.0), (9002, "a", None)]
    intervals = [(j, rng.choice(["hot", "a", "b", "zz"]), (s := rng.uniform(-5, 30)), s + rng.choice([0.0, 0.1, 2.5, 40.0])) for j in range(60)] + [(100, "hot", 15.25, 15.25), (101, "hot", 10.0, 15.25), (102, "hot", 15.25, 20.0), (103, None, 0.0, 9.0)]
    out = ranking.interval_join(spark.createDataFrame(points, "i int, k string, t double"), spark.createDataFrame(intervals, "j int, k string, a double, b double"), ["k"], "t", "a", "b", 2.0, how)
    true = [(i, j) for i, k, t in points for j, l, a, b in intervals if k is not None and t is not None and k == l and a <= t < b]
    if how == "left":
        met = {i for i, _ in true}
        true += [(i, None) for i, *_ in points if i not in met]
    assert sorted(((r.i, r.j) for r in out.collect()), key=str) == sorted(true, key=str)
    assert sorted(out.columns) == ["a", "b", "i", "j", "k", "t"]


@pytest.mark.parametrize("blocks", [(1, 1), (4, 3)])
def test_nearest_in_blocks(spark, blocks, monkeypatch):
    rng = random.Random(3)
    vector = lambda n: {f"t{rng.randrange(60)}": rng.random() for _ in range(n)}
    queries = {q: vector(rng.randrange(1, 9)) | {"all": 0.3} for q in range(80)} | {500: {"unknown": 1.0}}
    known = {p: vector(rng.randrange(1, 9)) | {"all": 0.2} for p in range(50)}
    rows = lambda d: [(k, t, w) for k, v in d.items() for t, w in v.items()]
    monkeypatch.setattr(novelty, "PRODUCTS", 500)
    out = novelty.nearest(spark.createDataFrame(rows(queries), "q int, term string, w double"), spark.createDataFrame(rows(known), "p int, term string, w double"), "q", "p", *blocks)
    true = {q: 1 - max(sum(w * v.get(t, 0) for t, w in x.items()) for v in known.values()) for q, x in queries.items() if q != 500}
    got = {r.q: r.novelty for r in out.collect()}
    assert got == pytest.approx(true)
    assert "PythonMapInArrow" in (plan := out._jdf.queryExecution().toString()) or "MapInArrow" in plan


def test_tail_decisions_need_all_values(spark):
    rng = random.Random(4)
    row = lambda i: (i, *[rng.choice([None, float(rng.randrange(40))]) if rng.random() < 0.2 else float(rng.randrange(40)) for _ in range(4)])
    healthy, asked = [row(i) for i in range(300)], [row(i) for i in range(60)] + [(99, 99.0, 1.0, 1.0, 1.0), (98, 99.0, None, 99.0, 99.0), (97, None, None, None, None)]
    schema = "i int, a double, b double, c double, d double"
    got = {r.i: (r.least, r.abstained, r.warning) for r in evaluate.tail_decision(spark.createDataFrame(healthy, schema), spark.createDataFrame(asked, schema), "i", list("abcd"), 0.05).collect()}
    for i, *values in asked:
        ps = [(1 + sum(h[j + 1] is not None and h[j + 1] >= v for h in healthy)) / (1 + sum(h[j + 1] is not None for h in healthy)) for j, v in enumerate(values) if v is not None]
        least, abstained, warning = got[i]
        assert (least is None) == (not ps) and (not ps or math.isclose(least, min(ps)))
        assert abstained == (len(ps) < 4) and warning == (len(ps) == 4 and min(ps) <= 0.0125)
    assert got[99][2] and not got[98][2]


def test_guardrail_takes_the_next_score(spark):
    rng = random.Random(5)
    for n in (1, 2, 37, 400):
        healthy = [rng.randrange(20) / 20 for _ in range(n)]
        out = evaluate.guardrail(spark.createDataFrame([(h,) for h in healthy], "s double"), spark.createDataFrame([(0.3,), (1.5,), (None,)], "s double"), "s", 0.9).collect()
        want = sorted(healthy)[math.ceil(0.9 * (n - 1))]
        assert {r.cutoff for r in out} == {want} and {r.s: r.flagged for r in out} == {0.3: 0.3 > want, 1.5: True, None: None}


def test_first_alerts_of_cases(spark):
    """a: found at once, first of three; b: found late, and not the strongest; c: never found."""
    rows = [("a", 5, 6, True, 9.0), ("b", 5, 6, False, 2.0), ("c", 5, 6, False, 1.0), ("a", 7, 8, True, 9.0), ("b", 7, 8, True, 3.0), ("c", 7, 8, True, 5.0), ("c", 20, 21, False, 1.0), ("c", 2, 3, True, 1.0)]
    frame = spark.createDataFrame(rows, "service string, window int, until int, warning boolean, p double")
    schedule = spark.createDataFrame([("a", 5, 9), ("b", 6, 9), ("c", 19, 22)], "service string, onset int, recovery int")
    r = evaluate.first_alert_outcome(frame, schedule, F.col("p")).first()
    assert (r.cases, round(r.recall, 6), round(r.top1, 6), round(r.top3, 6), r.median_delay) == (3, 0.666667, 0.333333, 0.666667, 1.5)
    got = sorted(tuple(x) for x in evaluate.trial_match(frame, schedule, F.col("p")).collect())
    assert got == [("a", 1, "a", True), ("b", 2, "a", False), ("c", None, None, False)]


def test_replicas_never_hide_everything(spark):
    rows = [(f"s{i}", i, int(i % 5 == 0)) for i in range(200)]
    out = selection.dropout_replicas(selection.class_weights(spark.createDataFrame(rows, "service string, window int, truth int"), "truth"), ["service", "window"], ["metrics", "logs", "traces"], 2).collect()
    assert len(out) == 600 and not any(r.no_metrics and r.no_logs and r.no_traces for r in out)
    assert not any(r.no_metrics or r.no_logs or r.no_traces for r in out if r.replica == 0) and all(any(r[f"no_{m}"] for r in out) for m in ("metrics", "logs", "traces"))
    by = defaultdict(float)
    for r in out:
        by[r.truth] += r.weight
    assert by[0] == pytest.approx(by[1]) and {r.weight for r in out} == {200 / (2 * 160), 200 / (2 * 40)}


CANDIDATE = "p int, place int, service string, requests long, alert boolean"
EVENT = "p int, service string, span long, status int, duration double, dependency string"


def test_contexts_and_rejections(spark):
    candidates = [(p, i + 1, s, n, a) for p, cells in {1: [("x", 3, True), ("y", 1, False), ("z", 0, False)], 2: [("x", 1, False), ("y", 1, False), ("z", 1, False)], 3: [("x", 0, True), ("y", 0, False), ("z", 0, False)]}.items() for i, (s, n, a) in enumerate(cells)]
    events = [(1, "x", 1, 200, 500.0, None), (1, "x", 2, 503, 5.0, "z"), (1, "x", 3, 404, 1.0, None), (1, "y", 4, 200, 20.0, None), (2, "x", 5, 200, 1.0, None), (2, "y", 6, None, 100.0, None), (2, "z", 7, 399, 2.0, "w")]
    known = diagnosis.contexts(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(events, EVENT), ["p"])
    got = {r.p: ([tuple(c) for c in r.citations], r.runbooks, set(r.services), r.alert, r.absent) for r in known.collect()}
    measured = [("M1", "x", None), ("M2", "y", None), ("M3", "z", None)]
    assert got[1] == ([("E1", "x", "z"), ("E2", "x", None), ("E3", "y", None), *measured], ["coverage", "dependency", "local_error", "none"], {"x", "y", "z"}, True, False)
    assert got[2] == ([("E1", "x", None), ("E2", "y", None), ("E3", "z", "w"), *measured], ["none"], {"x", "y", "z", "w"}, False, False)
    assert got[3] == (measured, ["coverage", "none"], {"x", "y", "z"}, True, True)
    answer = lambda status, service, ids, book, summary="s": json.dumps({"status": status, "suspected_service": service, "evidence_ids": ids, "runbook_id": book, "summary": summary})
    cases = [
        (1, "not json", "malformed"), (1, answer("maybe", None, [], "none"), "malformed"), (1, answer("review", None, ["E1"], "none", ""), "malformed"), (1, answer("review", None, [f"E{i}" for i in range(7)], "none"), "malformed"), (1, answer("review", None, ["E1"], "reboot"), "malformed"), (1, None, "malformed"),
        (1, answer("review", "x", [], "none"), "review without citation"), (1, answer("clear", "x", [], "none"), "clear naming a fault"), (1, answer("clear", None, [], "coverage"), "clear naming a fault"),
        (1, answer("review", None, ["E1", "E1"], "none"), "duplicate citation"), (1, answer("review", None, ["E1", "E4"], "none"), "unknown citation"), (1, answer("review", "w", ["E1"], "none"), "unknown service"),
        (1, answer("review", "x", ["E1"], "latency"), "runbook not available"), (1, answer("review", "y", ["E1", "M3"], "none"), "unrelated citation"), (1, answer("clear", None, [], "none"), "clear against an alert"),
        (2, answer("review", "w", ["E3"], "none"), "review without an alert"), (3, answer("review", "x", ["M1"], "coverage"), "review of absent sources"),
        (1, answer("review", "z", ["E1"], "dependency"), None), (2, answer("clear", None, [], "none"), None), (3, answer("abstain", None, [], "none"), None),
    ]
    for p, text, reason in cases:
        r = diagnosis.validated(spark.createDataFrame([(p, text)], "p int, answer string"), known, ["p"]).first()
        assert (r.reason, r.accepted) == (reason, reason is None), text
        assert r.status == ("abstain" if reason else json.loads(text)["status"])


def tree_by_hand(lines, depth, children):
    cut = [line.split() for line in lines]
    word = lambda w, i: w[i] if i < len(w) and not any(c.isdigit() for c in w[i]) else "<*>"
    paths, kept = [str(len(w)) for w in cut], []
    for i in range(depth):
        counts = defaultdict(Counter)
        for p, w in zip(paths, cut):
            if word(w, i) != "<*>":
                counts[p][word(w, i)] += 1
        kept.append({p: set(sorted(c, key=lambda x: (-c[x], x))[:children]) for p, c in counts.items()})
        paths = [f"{p} {word(w, i) if word(w, i) in kept[i].get(p, ()) else '<*>'}" for p, w in zip(paths, cut)]
    leaves = defaultdict(list)
    for p, w in zip(paths, cut):
        leaves[p].append(w)
    found = {p: ([x[0] if len(set(x)) == 1 and not any(c.isdigit() for c in x[0]) else "<*>" for x in zip(*ws)], len(ws)) for p, ws in leaves.items() if ws[0]}

    def known(line):
        w = line.split()
        p = str(len(w))
        for i in range(depth):
            p += " " + (word(w, i) if word(w, i) in kept[i].get(p, ()) else "<*>")
        return p in found and all(t in ("<*>", x) for t, x in zip(found[p][0], w))

    return found, known


@pytest.mark.parametrize(("depth", "children"), [(3, 2), (1, 16), (4, 3)])
def test_template_trees_equal_counting_by_hand(spark, depth, children):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice([rng.choice("abcdefgh"), rng.choice("ab"), f"n{rng.randrange(99)}"]) for _ in range(rng.randrange(0, 6)))
    old, new = [line() for _ in range(400)] + ["a b c"] * 300, [line() for _ in range(200)] + ["a b zz", ""]
    frame = spark.createDataFrame([(x,) for x in old], "line string")
    found, known = tree_by_hand(old, depth, children)
    for parts in (1, 7):  # the tree does not depend on how lines are dealt
        tree = novelty.TemplateTree(frame.repartition(parts), "line", depth, children)
        assert {r.path: (r.words, r.n) for r in tree.templates.collect()} == found
    got = [(r.line, r.known) for r in tree.match(spark.createDataFrame([(x,) for x in new], "line string"), "line").collect()]
    assert sorted(got) == sorted((x, known(x)) for x in new) and {k for _, k in got} == {True, False}
    share = novelty.unknown_share(spark.createDataFrame([("a", True)] * 9 + [("a", False)] + [("b", False)], "k string, known boolean"), ["k"])
    assert {r.k: (r.lines, round(r.unknown, 6), r.drifted) for r in share.collect()} == {"a": (10, 0.1, False), "b": (1, 1.0, True)}


@pytest.mark.parametrize("group_rows", [None, 1, 10_000])
def test_references_of_hot_and_small_groups_are_the_same(spark, group_rows):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b"]), rng.choice([None, float("nan"), *map(float, range(9))]), rng.choice([0.5, 2.5, 7.0])) for _ in range(300)] + [("c", None, 1.0)]
    frame = spark.createDataFrame(rows, "service string, p95 double, error_fraction double").repartition(4)
    got = {r.service: r for r in windows.healthy_reference(frame, ["service"], ["p95", "error_fraction"], group_rows).collect()}
    for s in "ab":
        x = [r[1] for r in rows if r[0] == s and r[1] is not None and r[1] == r[1]]
        assert got[s].p95_center == pytest.approx(statistics.median(x)) and got[s].p95_n == len(x)
        assert got[s].p95_scale == pytest.approx(max(statistics.pstdev(x), abs(statistics.median(x)) * 0.05, 1e-6))
    assert got["c"].p95_center is None and got["c"].p95_n == 0 and got["c"].error_fraction_center == 1.0
    clean = frame.where("NOT isnan(p95)")
    mad = {r.service: r for r in windows.mad_reference(clean, ["service"], ["p95", "error_fraction"], [0.1, 3.0], group_rows).collect()}
    limits = {r.service: r for r in windows.envelopes(clean, group_rows=group_rows).collect()}
    for s in "ab":
        x = [r[1] for r in rows if r[0] == s and r[1] is not None and r[1] == r[1]]
        assert mad[s].p95_scale == pytest.approx(max(statistics.median(abs(v - statistics.median(x)) for v in x), 0.1)) and mad[s].error_fraction_scale == 3.0
        assert limits[s].latency_limit == max(50.0, 2 * float(np.quantile(x, 0.99)))
    spread = {r.service: r for r in evaluate.distribution(clean, ["service"], "p95", 4.0, group_rows or 1 << 20).collect()}
    assert all(spread[s].p95 == pytest.approx(np.quantile([r[1] for r in rows if r[0] == s and r[1] is not None and r[1] == r[1]], 0.95)) for s in "ab")


def test_window_status_needs_every_service(spark):
    rows = [(1, "a", 5, 0, 10.0, 0.0), (1, "b", 5, 2, 10.0, 0.0), (2, "a", 5, 0, 200.0, 0.2), (2, "b", 5, 0, 10.0, 0.0), (3, "a", 5, 9, 10.0, 0.9), (4, "a", 1, 0, 1.0, 0.1), (4, "b", 1, 0, 1.0, None), (6, "a", 1, 0, 1.0, 0.5), (6, "b", 1, 0, 1.0, 0.0)]
    services = spark.createDataFrame(rows, "window int, service string, events int, errors int, p95 double, unknown double")
    scores = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.9), (4, 0.5), (5, None), (6, None)], "window int, score double")
    limit = spark.createDataFrame([(0.5,)], "threshold double")
    rules = [("b", F.col("errors") > 0, "b"), ("a", F.col("errors") > 0, "a"), ("a", F.col("p95") > 150, "a")]
    got = {r.window: tuple(r)[1:] for r in scoring.window_status(services, scores, limit, ["b", "a"], rules).collect()}
    assert got == {
        1: ("anomaly", True, False, [], "b"),
        2: ("anomaly", False, True, [], "a"),
        3: ("insufficient_telemetry", True, True, ["b"], None),
        4: ("normal", False, False, [], None),
        5: ("insufficient_telemetry", False, False, ["a", "b"], None),
        6: ("anomaly", False, True, [], None),
    }
