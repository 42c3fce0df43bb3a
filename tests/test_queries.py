"""Registered queries without SQL, against plain Python on the tables they read."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from opslake.operators import evaluate
from opslake.plans import bindings as B
from opslake.plans import model_queries as M

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    queries = entry.queries()
    return lambda name: queries[name](spark, SF).collect()


def depth(nodes, x):
    node, steps = nodes[0], 0
    while node.feature >= 0:
        node, steps = nodes[node.left if x[node.feature] < node.split else node.right], steps + 1
    n = node.size
    return steps + (0 if n < 2 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)


def by_hand(trees, x):
    n = max(t[0].size for t in trees.values())
    return 2 ** (-sum(depth(t, x) for t in trees.values()) / len(trees) / (2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n))


def grown(rows):
    trees = defaultdict(lambda: defaultdict(dict))
    for n in rows:
        trees[n.group][n.tree][n.node] = n
    return trees


def test_forest_queries_walk_their_own_trees(spark, run):
    changed = {(r.service, r.window): [r[c] if r[c] is not None else 0.0 for c in M.CHANGES] for r in M.changed(spark, SF).collect()}
    trees = grown(M.isolation_forest_fit(spark, SF).collect())["all"]
    assert len(trees) == 200 and {t[0].size for t in trees.values()} <= {64, sum(w < 15 for _, w in changed)}
    got = {(r.service, r.window): r.score for r in run("m02_isolation_forest_score")}
    assert got.keys() == changed.keys()
    for k, score in got.items():
        assert score == pytest.approx(by_hand(trees, changed[k]), abs=1e-5)
    splits = {r.feature: r.splits for r in run("m29_forest_introspection")}
    assert sum(splits.values()) == sum(n.feature >= 0 for t in trees.values() for n in t.values())


def test_dropped_modality_scores_like_zeros(spark, run):
    from opslake.operators import forest

    c = M.changed(spark, SF)
    trees = grown(forest.grow(c.where("window < 15"), M.key(), M.CHANGES, trees=100, psi=64).collect())["all"]
    rows = {(r.service, r.window): [r[x] if r[x] is not None else 0.0 for x in M.CHANGES] for r in c.collect()}
    at = M.CHANGES.index("error_fraction_change")
    for r in run("p14_modality_drop"):
        x = rows[r.service, r.window]
        assert r.score == pytest.approx(by_hand(trees, x), abs=1e-5)
        assert r.without_errors == pytest.approx(by_hand(trees, [0.0 if i == at else v for i, v in enumerate(x)]), abs=1e-5)


def test_forests_by_service_and_of_sessions_and_texts(run):
    by_service = run("m03_service_forests")
    assert {r.window for r in by_service} <= set(range(15, 30)) and len({r.service for r in by_service}) == 5
    for name in ("m03_service_forests", "m04_session_forest", "m05_text_forest"):
        scores = [r.score for r in run(name)]
        assert scores and all(0 < s < 1 for s in scores)


def test_replay_ranks_and_alerts_follow_from_the_scores(run):
    scored = defaultdict(list)
    for r in run("m02_isolation_forest_score"):
        scored[r.window].append((-r.score, r.service))
    for r in run("m26_historical_replay"):
        assert r.candidates == [s for _, s in sorted(scored[r.window])[:5]]
        assert r.score == pytest.approx(-min(scored[r.window])[0]) and r.alert == (r.score > r.threshold)


def test_template_queries_keep_every_line(spark, run):
    pages = B.table(spark, SF, "pages")
    assert sum(r.n for r in run("m10_template_mining")) == pages.count()
    known = {r.page_id: r.known for r in run("m10_unseen_templates")}
    assert set(known) == {r.page_id for r in pages.where("page_id % 3 = 0").collect()}


def test_supervised_queries(spark, run):
    detected = {(r.service, r.window): r for r in run("m13_supervised_detector")}
    truth = {(r.service, r.window): r.truth for r in M.training(spark, SF).collect()}
    assert {k: r.truth for k, r in detected.items()} == truth and all(0 <= r.score <= 1 for r in detected.values())
    fitted = [r for r in detected.values() if r.window % 2 == 0]
    mean = lambda t: sum(r.score for r in fitted if r.truth == t) / sum(r.truth == t for r in fitted)
    assert mean(1.0) > mean(0.0) + 0.3
    ranked = defaultdict(list)
    for r in run("m14_service_ranker"):
        ranked[r.window].append((r["rank"], -r.score))
    assert all(sorted(v) == sorted(v, key=lambda x: x[1]) and [k for k, _ in sorted(v)] == [1, 2, 3][: len(v)] for v in ranked.values())
    assert {(r.service, r.window) for r in run("m15_temporal_detector")} == set(truth)


def test_fusion_replay_and_report_queries(spark, run):
    days = {r.window: r for r in run("m15_temporal_fusion")}
    assert sorted(days) == list(range(B.DAYS))
    seen = defaultdict(set)
    for r in M.external_features(spark, SF).collect():
        if r.features[17] < 1 or r.features[10] > 0 or r.features[15] > 0:
            seen[r.window].add(r.service)
    for w, r in days.items():
        assert r.abstained == (r.score is None) == (not seen[w]) and (r.abstained or 0 <= r.score <= 1)
        assert set(filter(None, r.top.split(","))) <= seen[w] and "signup" not in r.top
    scores = defaultdict(list)
    for r in run("m02_isolation_forest_score"):
        scores[r.window].append(r.score)
    healthy = [x for w, v in scores.items() if w < 15 for x in v]
    for r in run("m26_replay_changes"):
        assert r.score == pytest.approx(max(scores[r.window]), abs=1e-5) and r.threshold == pytest.approx(np.quantile(healthy, 0.995), abs=1e-5)
        assert len(r.candidates.split(",")) == min(5, len(scores[r.window])) and all(c.count("+") == 2 for c in r.candidates.split(","))
    rows = M.changed(spark, SF).where("window < 15").collect()
    report = run("m29_forest_report")
    assert {(r.group, r.feature) for r in report} == {(x.service, c) for x in rows for c in M.CHANGES}
    for r in report:
        values = [x[r.feature] for x in rows if x.service == r.group]
        assert (r.least, r.most) == (pytest.approx(min(values), abs=1e-5), pytest.approx(max(values), abs=1e-5))


def test_selection_scores_its_candidates_like_the_curves_do(spark, run):
    rows = run("m16_model_selection")
    best = [r for r in rows if r.best]
    assert len(best) == 1 and best[0].objective == max(r.objective for r in rows)
    train = M.training(spark, SF)
    name, scored = next(M.candidates(train.where("window % 2 = 0"), train.where("window % 2 = 1"), M.SELECTION_FEATURES))
    assert name == rows[0].name
    assert rows[0].pr_auc == pytest.approx(evaluate.average_precision(scored, "score", "truth").first()[0], abs=1e-5)


def test_messages_are_judged_whole(spark, run):
    parts = defaultdict(list)
    for r in B.req(spark, SF).select("service", (F.col("window") * 60).alias("end"), "span").collect():
        parts[r.span % 3].append((r.service, r.end, r.span))
    state, true = {}, []
    for part in range(3):
        for service, end, span in sorted(parts[part], key=lambda x: x[2]):
            last, kept = state.get(service, (None, 0))
            ok = last is None or end == last + 60
            state[service] = (end, min(5, kept + 1)) if ok else (last, kept)
            true.append((service, end, span, "accepted" if ok else "rejected", state[service][1]))
    assert sorted((r.service, r.end, r.arrival, r.status, r.history) for r in run("t08_contiguous_messages")) == sorted(true)


def test_template_of_every_page(spark, run):
    got = {r.page_id: r.template for r in run("f01_log_template")}
    assert len(got) == B.table(spark, SF, "pages").count() and not any(any(c.isupper() for c in t) or "  " in t for t in got.values())


def test_the_forest_stream_scores_like_a_loop(run, spark):
    """Accepted messages, histories of five windows with zeros before, and the forest's score of each available service."""
    from opslake.plans import stream_queries as S

    messages = sorted(S.feature_messages(spark, SF).collect(), key=lambda r: r.arrival)
    fitted, state, true = S.history_forest(spark, SF), {}, {}
    for m in messages:
        profile, last, history = state.get(m.stream, (None, None, {}))
        if last is not None and (m.profile != profile or m.end != last + 60):
            true[m.stream, m.arrival] = ("rejected", None, [])
            continue
        history = {e: v for e, v in history.items() if e > m.end - 300} | {m.end: {s.service: s.features for s in m.services}}
        state[m.stream] = (m.profile, m.end, history)
        scores = {}
        for s in m.services:
            if s.features[17] < 1 or s.features[10] > 0 or s.features[15] > 0:
                raw = [x for e in range(m.end - 240, m.end + 1, 60) for x in history.get(e, {}).get(s.service, [0.0] * 18)]
                scores[s.service] = float(fitted.score(np.array([raw]))[0])
        names = sorted(scores, key=lambda n: (-scores[n], n))[:5]
        true[m.stream, m.arrival] = ("scored" if names else "abstained", max(scores.values(), default=None), names)
    got = {(r.stream, r.arrival): (r.status, r.score, r.candidates) for r in run("t08_forest_stream")}
    assert got.keys() == true.keys() and {s for s, *_ in got.values()} >= {"scored", "rejected"}
    for k, (status, score, names) in true.items():
        assert got[k][0] == status and got[k][2] == names and (score is None or abs(got[k][1] - score) < 1e-5)


def test_the_forest_stream_is_fitted_on_the_histories_it_scores(spark):
    """All five windows split, and the histories are those of a loop over accepted messages; one stream has a gap."""
    from opslake.plans import stream_queries as S

    messages = S.feature_messages(spark, SF).where("arrival < 5000 AND NOT (stream = '3' AND end = 180)")
    state, true = {}, {}
    for m in sorted(messages.collect(), key=lambda r: r.arrival):
        profile, last, history = state.get(m.stream, (None, None, {}))
        if last is not None and (m.profile != profile or m.end != last + 60):
            continue
        history = {e: v for e, v in history.items() if e > m.end - 300} | {m.end: {s.service: s.features for s in m.services}}
        state[m.stream] = (m.profile, m.end, history)
        for s in m.services:
            if s.features[17] < 1 or s.features[10] > 0 or s.features[15] > 0:
                true[m.stream, m.end, s.service] = [x for e in range(m.end - 240, m.end + 1, 60) for x in history.get(e, {}).get(s.service, [0.0] * 18)]
    rows = S.feature_histories(messages).collect()
    got = {(r.stream, r.end, r.service): r.x for r in rows}
    assert len(got) == len(rows) and got.keys() == true.keys() and {e for s, e, _ in got if s == "3"} == {60, 120}
    assert all(got[k] == pytest.approx(x) for k, x in true.items())
    fitted = S.history_forest(spark, SF)
    split = np.setdiff1d(np.arange(len(fitted.feature)), np.flatnonzero(fitted.next[::2] == np.arange(len(fitted.feature))))
    assert {f // 18 for f in fitted.feature[split]} == {0, 1, 2, 3, 4}
    old = np.array(list(got.values()))
    for window in range(5):
        new = old.copy()
        new[:, 18 * window : 18 * window + 18] = 0.0
        assert (fitted.score(new) != fitted.score(old)).any()
