"""Calibrated drift, its evidence and summaries, template shares, replay, forest reports and coverage, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslake.operators import evaluate, forest, novelty


def test_templates_are_scored_once_and_mapped_back(spark, tmp_path):
    known = spark.createDataFrame([("request served",), ("request served",), ("request failed",), (None,)], "t string")
    rows = [(1, "request served"), (2, "panic lock poisoned"), (3, "request failed"), (4, None), (5, "request served"), (6, "")]
    events = spark.createDataFrame(rows, "id int, t string")
    for folder in (None, str(tmp_path / "templates")):
        got = {r.id: r.novelty for r in novelty.template_novelty(events, "t", known, folder).collect()}
        assert len(got) == 6 and got[2] == got[4] == got[6] == 1.0
        assert got[1] == pytest.approx(0.0, abs=1e-9) and got[3] == pytest.approx(0.0, abs=1e-9) and got[5] == pytest.approx(0.0, abs=1e-9)
    assert {r.novelty for r in novelty.template_novelty(events, "t", known.limit(0)).collect()} == {1.0}
    assert novelty.template_novelty(events.limit(0), "t", known).count() == 0


@pytest.mark.parametrize("values, expected", [([0.0, 0.5, 1.0], 0.995), ([0.01, 0.02], 0.05), ([], 0.05)])
def test_threshold_is_the_quantile_and_at_least_the_floor(spark, values, expected):
    healthy = spark.createDataFrame([(v,) for v in values], "novelty double")
    assert novelty.novelty_threshold(healthy).first().threshold == pytest.approx(np.quantile(values, 0.995) if expected > 0.05 else expected)


def random_events(seed, n=900):
    rng = random.Random(seed)
    hot = {("a", 2), ("a", 3), ("a", 4), ("b", 1), ("b", 3), ("c", 5), ("c", 6)}
    out = []
    for i in range(n):
        s, w = rng.choice("abc"), rng.randrange(7)
        novel = rng.random() < (0.5 if (s, w) in hot else 0.02)
        out.append((s, w, rng.randrange(50), f"message {i % 40} " + "x" * (rng.random() < 0.1) * 700, rng.choice([0.6, 0.7, 0.8]) if novel else 0.0))
    return out


def findings_by_hand(events, threshold, windows, least, share, k):
    cells = defaultdict(list)
    for e in events:
        cells[e[0], e[1]].append(e)
    out = {}
    for s in sorted({e[0] for e in events}):
        run = 0
        for w in range(windows[0], windows[1] + 1):
            rows = cells.get((s, w), [])
            novel = [e for e in rows if e[4] > threshold]
            run = run + 1 if len(rows) >= least and len(novel) > share * len(rows) else 0
            if run >= 2:
                top = sorted(novel, key=lambda e: (-e[4], e[2], e[3]))[:k]
                out[s, w] = (len(rows), len(novel), [(e[4], e[2], e[3][:600], hashlib.sha256(f"{s}:{e[2]}:{e[3]}".encode()).hexdigest()[:20]) for e in top])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_drift_evidence_equals_a_loop(spark, seed):
    events = random_events(seed)
    frame = spark.createDataFrame(events, "service string, window long, time long, message string, novelty double").repartition(5)
    limit = spark.createDataFrame([(0.05,)], "threshold double")
    found = novelty.drift_evidence(frame, limit, (0, 7), 20, 0.1, 3)
    got = {(r.service, r.window): (r.events, r.novel, [(e.novelty, e.time, e.message, e.id) for e in r.evidence]) for r in found.collect()}
    expected = findings_by_hand(events, 0.05, (0, 7), 20, 0.1, 3)
    assert got == expected and len(got) >= 2
    assert novelty.drift_evidence(frame.limit(0), limit, (0, 7)).count() == 0


def test_content_summary_counts_every_case(spark):
    events = spark.createDataFrame([(1, "a", "t"), (1, "a", "t"), (1, "b", "u"), (2, "a", None)], "c int, service string, t string")
    left_out = spark.createDataFrame([(1,), (3,), (3,)], "c int")
    found = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "c int, service string")
    got = {r.c: (r.warnings, r.events, r.excluded, r.templates, r.services) for r in novelty.content_summary(events, left_out, found, "t", ["c"]).collect()}
    assert got == {1: (3, 3, 1, 2, ["a", "b"]), 2: (0, 1, 0, 0, []), 3: (0, 0, 2, 0, [])}


def test_template_shares_have_a_place_for_every_template(spark):
    train = spark.createDataFrame([("get page",), ("get page",), ("put page 7",), ("drop table now",)], "line string")
    tree = novelty.TemplateTree(train, "line")
    rows = [("a", "get page"), ("a", "put page 9"), ("a", "something never seen"), ("a", "get page"), ("b", "unknown"), ("c", None)]
    shares = novelty.template_shares(tree.match(spark.createDataFrame(rows, "service string, line string"), "line", "path"), tree, ["service"])
    got = {r.service: r for r in shares.collect()}
    paths = sorted(r.path for r in tree.templates.collect())
    of = {r.path: " ".join(r.words) for r in tree.templates.collect()}
    named = dict(zip((of[p] for p in paths), got["a"].shares))
    assert named == {"get page": 0.5, "put page <*>": 0.25, "drop table now": 0.0} and got["a"].unknown == 0.25
    assert got["b"].shares == [0.0] * 3 and got["b"].unknown == 1.0 and got["c"].lines == 1


def test_replay_ranks_candidates_and_their_changes(spark):
    rng = random.Random(4)
    rows = [(w, f"s{i}", rng.choice([0.1, 0.5, 0.5, None]), rng.choice([0.0, 1.0, 2.0]), rng.choice([1.0, 3.0]), rng.choice([None, 2.0])) for w in range(6) for i in range(8)]
    frame = spark.createDataFrame(rows, "window int, service string, score double, a_change double, b_change double, c_change double")
    limit = spark.createDataFrame([(0.4,)], "threshold double")
    got = {r.window: r for r in evaluate.replay(frame, limit, ["window"], ["a", "b", "c"], 5, 2).collect()}
    for w in range(6):
        seen = sorted((r for r in rows if r[0] == w and r[2] is not None), key=lambda r: (-r[2], r[1]))[:5]
        if not seen:
            assert w not in got
            continue
        assert [c.service for c in got[w].candidates] == [r[1] for r in seen]
        for c, r in zip(got[w].candidates, seen):
            order = sorted(zip("abc", r[3:]), key=lambda x: -(x[1] or 0.0))[:2]
            assert [(x.feature, x.value) for x in c.changes] == order
        assert got[w].score == seen[0][2] and got[w].alert == (seen[0][2] > 0.4)


def test_forest_report_covers_every_feature(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], *map(float, rng.normal(i % 2, 1, 2)), 7.0) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, g string, x double, y double, z double")
    columns = ["x", "y", "z"]
    nodes = forest.grow(frame, F.col("id"), columns, F.col("g"), trees=10, psi=16).cache()
    scored = forest.score(frame, nodes, columns, F.col("g")).cache()
    got = {(r.group, r.feature): r for r in forest.report(nodes, frame, scored, columns, F.col("g")).collect()}
    splits = Counter((n.group, columns[n.feature]) for n in nodes.collect() if n.feature >= 0)
    scores = defaultdict(list)
    for r in scored.collect():
        scores[r.g].append(r.score)
    assert len(got) == 6
    for g in "ab":
        for i, c in enumerate(columns):
            values, r = [row[2 + i] for row in rows if row[1] == g], got[g, c]
            assert (r.splits, r.least, r.most) == (splits[g, c], min(values), max(values))
            assert r.threshold == pytest.approx(np.quantile(scores[g], 0.995))
    assert got["a", "z"].splits == 0


def test_source_coverage(spark):
    cells = spark.createDataFrame([(w, s) for w in range(4) for s in "ab"] * 2, "window int, service string")
    sources = {"metrics": cells.where("window < 2 AND service = 'a'"), "logs": cells.where("window = 3"), "traces": cells.limit(0)}
    got = {(r.level, r.service): (r.rows, r.metrics, r.logs, r.traces) for r in evaluate.source_coverage(cells, sources, ["window", "service"], ["window"]).collect()}
    assert got == {("window", None): (4, 2, 1, 0), ("service", "a"): (4, 4, 2, 0), ("service", "b"): (4, 0, 2, 0)}


def test_instances_without_snapshots_and_without_pods(spark):
    pods = spark.createDataFrame([(0, "a", "u", 1), (0, "a", "u", 4), (1, None, None, None), (2, "a", "v", 0)], "t int, service string, uid string, restarts int")
    got = {r.service: (r.instances, r.missing, r.restarts) for r in evaluate.instance_summary(pods, "t", ["a", "b"]).collect()}
    assert got == {"a": (2, 1, 4), "b": (0, 3, 0)}
    assert evaluate.instance_summary(pods.limit(0), "t", ["a"]).first().missing == 0
