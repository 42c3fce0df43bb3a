"""Forests, novelty, selection, sums over ranges and summaries, against plain Python."""

import bisect
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslake.functions import scalar
from opslake.operators import evaluate, forest, novelty, ranking, selection, sequence


def path_length(nodes, x):
    node, depth = nodes[0], 0
    while node.feature >= 0:
        node, depth = nodes[node.left if x[node.feature] < node.split else node.right], depth + 1
    n = node.size
    return depth + (0 if n < 2 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)


def scores_by_hand(nodes, rows):
    trees = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n
    psi = max(t[0].size for t in trees.values())
    expected = 2 * (math.log(psi - 1) + 0.5772156649015329) - 2 * (psi - 1) / psi
    return [2 ** (-sum(path_length(t, x) for t in trees.values()) / len(trees) / expected) for x in rows]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], *map(float, rng.normal(i % 2, 1, 2))) for i in range(120)]
    return rows, spark.createDataFrame(rows, "id int, g string, x double, y double")


def test_forest_scores_equal_a_walk_through_its_nodes(spark, points):
    rows, frame = points
    nodes = forest.grow(frame, F.col("id"), ["x", "y"], trees=30, psi=32)
    got = {r.id: r.score for r in forest.score(frame, nodes, ["x", "y"]).collect()}
    true = dict(zip([r[0] for r in rows], scores_by_hand(nodes.collect(), [r[2:] for r in rows])))
    assert got == pytest.approx(true)


def test_values_that_barely_differ_still_split():
    x = np.array([[1.0], [np.nextafter(1.0, 2)], [1.0]])
    for tree in range(30):
        nodes = forest.grow_tree(x, tree)
        assert sum(n[5] for n in nodes if n[1] < 0) == 3 and all(n[5] for n in nodes)


def test_forests_by_group_stay_tables_and_share_large_groups(spark, points, monkeypatch):
    monkeypatch.setattr(forest, "ROWS_A_TASK", 7)
    rows, frame = points
    extra = frame.unionByName(spark.createDataFrame([(900, "c", 0.0, 0.0), (901, None, 0.0, 0.0)], frame.schema)).withColumn("tags", F.array(F.lit("t")))
    nodes = forest.grow(frame, F.col("id"), ["x", "y"], F.col("g"), trees=20, psi=32)
    found = forest.score(extra, nodes, ["x", "y"], F.col("g"))
    assert found.columns == [*extra.columns, "score"]
    got = {r.id: r.score for r in found.collect()}
    assert got.pop(900) is None and got.pop(901) is None and len(got) == 120
    for g in "ab":
        mine = [r for r in rows if r[1] == g]
        true = scores_by_hand(nodes.where(F.col("group") == g).collect(), [r[2:] for r in mine])
        assert [got[r[0]] for r in mine] == pytest.approx(true)


def test_sparse_vectors_are_like_dense_ones(spark, points):
    rows, frame = points
    sparse = frame.withColumn("v", F.array(F.struct(F.lit(1).alias("i"), F.col("y").alias("v")), F.struct(F.lit(0).alias("i"), F.col("x").alias("v"))))
    a = forest.grow(frame, F.col("id"), ["x", "y"], trees=10, psi=16)
    b = forest.grow(sparse, F.col("id"), F.col("v"), trees=10, psi=16, size=2)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    one, two = ({r.id: r.score for r in s.collect()} for s in (forest.score(frame, a, ["x", "y"]), forest.score(sparse, b, F.col("v"), size=2)))
    assert one == pytest.approx(two)


def test_text_weights_as_sparse_vectors(spark):
    frame = spark.createDataFrame([(1, "disk error disk"), (2, "user login")], "k int, t string")
    counts = novelty.terms(frame, ["k"], "t")
    idf = novelty.tfidf_fit(counts, "k")
    order = sorted(r.term for r in idf.collect())
    for r in novelty.sparse_vectors(counts, idf, "k").collect():
        assert sum(e.v**2 for e in r.x) == pytest.approx(1) and [order[e.i] for e in r.x] == sorted(order[e.i] for e in r.x)


def test_vector_novelty_with_repeats_and_without_references(spark):
    frame = spark.createDataFrame([(i, [1.0, 0.0], 1) for i in range(50)] + [(99, [0.0, 2.0], 0), (98, [3.0, 0.0], 0)], "i int, v array<double>, r int")
    assert {r.i: round(r.novelty, 9) for r in novelty.vector_novelty(frame, "i", "v", F.col("r") == 1, 7).collect()} == {99: 1.0, 98: 0.0}
    assert {r.novelty for r in novelty.vector_novelty(frame, "i", "v", F.lit(False)).collect()} == {2.0}


# sums over ranges --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[random.Random(1).random() for _ in range(400)], [1.0, 1.0, 2.0], [], [5.0] * 30])
def test_thresholds_equal_a_sorted_list(spark, values):
    rng = random.Random(2)
    rows = [(v, rng.randrange(2)) for v in values]
    got = {r.score: (r.tp, r.fp, r.p, r.n) for r in evaluate.thresholds(spark.createDataFrame(rows, "s double, t int"), "s", "t").collect()}
    p = sum(t for _, t in rows)
    assert got == {v: (sum(t for s, t in rows if s >= v), sum(1 - t for s, t in rows if s >= v), p, len(rows) - p) for v in values}


def test_running_sums_with_null_keys_and_values(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), rng.choice([None, 1.0, 2.0, 3.0]), i) for i in range(60)]
    frame = spark.createDataFrame(rows, "k string, v double, i int")
    got = ranking.running_sums(frame, ["k"], ranking.value_buckets(frame, "v"), [F.col("v").asc_nulls_first(), F.col("i")], {"so_far": "i"})
    order = sorted(rows, key=lambda r: (r[0] or "", -1 if r[1] is None else r[1], r[2]))
    sums, true = {}, {}
    for k, _, i in order:
        sums[k] = sums.get(k, 0) + i
        true[i] = sums[k]
    assert {r.i: r.so_far for r in got.collect()} == true and {r.k: r.so_far_all for r in got.collect()} == sums


def test_tail_ranks_equal_counts(spark):
    rng = random.Random(5)
    ref = [(rng.choice("ab"), float(rng.randrange(20))) for _ in range(200)]
    ask = [(i, rng.choice("abc"), float(rng.randrange(25))) for i in range(80)]
    got = sequence.tail_ranks(spark.createDataFrame(ref, "o string, v double"), spark.createDataFrame(ask, "i int, o string, v double"), "o", "v").collect()
    for r in got:
        mine = sorted(v for o, v in ref if o == r.o)
        assert r.p == pytest.approx((1 + len(mine) - bisect.bisect_left(mine, r.v)) / (1 + len(mine)))


def test_hash_split_takes_whole_shares(spark):
    rows = [(i, i % 3) for i in range(300)]
    got = {r.i: r.split for r in sequence.hash_split(spark.createDataFrame(rows, "i int, g int"), "g", F.col("i").cast("string")).collect()}
    for g in range(3):
        order = sorted((i for i, h in rows if h == g), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
        assert [got[i] for i in order] == ["train"] * 60 + ["validation"] * 20 + ["test"] * 20


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [random.Random(9).gauss(0, 1) for _ in range(333)] + [None] * 5, [2.0] * 50])
def test_quantiles_are_exact(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranking.quantiles(frame, "v", [0.0, 0.001, 0.5, 0.999, 1.0]).first()
    assert list(got) == pytest.approx(np.quantile([v for v in values if v is not None], [0.0, 0.001, 0.5, 0.999, 1.0]).tolist())


def test_quantiles_of_nothing_are_null(spark):
    assert list(ranking.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]).first()) == [None]


def test_hot_terms_join_like_others(spark):
    rng = random.Random(7)
    left = [(i, "hot" if i % 2 else rng.choice("abcdefgh")) for i in range(400)]
    right = [(j, t) for j, t in enumerate(["hot", "hot", "a", "b", "zz"])]
    got = ranking.salted_join(spark.createDataFrame(left, "i int, term string"), spark.createDataFrame(right, "j int, term string"), "term", F.col("i"))
    assert sorted(map(tuple, got.select("i", "j", "term").collect())) == sorted((i, j, t) for i, t in left for j, u in right if t == u)


def test_large_routes_are_mined_in_parts(spark, monkeypatch):
    lines = spark.createDataFrame([(f"open file f{i} now",) for i in range(60)] + [("close it",)] * 3, "l string")
    whole = {tuple(r) for r in novelty.mine_templates(lines, "l").collect()}
    monkeypatch.setattr(novelty, "ROUTE_LINES", 10)
    assert {tuple(r) for r in novelty.mine_templates(lines, "l").collect()} == whole == {("4 open file", "open file <*> now", 60), ("2 close it", "close it", 3)}


# selection and summaries -------------------------------------------------------------------------------------------


def test_selection_keeps_the_first_best_and_stops_when_stale(spark):
    asked = []

    def candidates():
        for name, order in (("bad", [0, 1, 2, 3]), ("good", [3, 2, 1, 0]), *((f"same{i}", [3, 2, 1, 0]) for i in range(6))):
            asked.append(name)
            yield name, spark.createDataFrame([(w, s, float(order[s]), float(s == 0 and w < 2)) for w in range(3) for s in range(4)], "w int, s int, score double, truth double")

    got = selection.select_model(candidates(), "w", "s").orderBy("step").collect()
    assert [r.name for r in got if r.best] == ["good"] and len(got) == 6 == len(asked)
    assert got[1].top1 == 1.0 and got[0].top1 == 0.0 and got[1].objective == pytest.approx((got[1].pr_auc + 1) / 2)


def test_diagnosis_rates_leave_out_what_straddles(spark):
    rows = [("t", 0, 1, 2, 4, True, True, "review", "x", 1.0), ("t", 1, 3, 2, 4, True, False, "review", "t", 2.0), ("t", 2, 4, 2, 4, None, True, "review", "t", 3.0), ("t", 3, 4, 2, 4, False, True, "clear", None, 4.0), ("u", 0, 9, None, None, True, True, "abstain", None, 5.0)]
    frame = spark.createDataFrame([(r[0], *r[1:5], r[0], *r[5:], 10, 1) for r in rows], "service string, start int, end int, onset int, recovery int, target string, valid boolean, accepted boolean, verdict string, suspect string, latency_ms double, input_tokens int, output_tokens int")
    got = {r.service: r for r in evaluate.diagnosis_quality(frame, ["service"]).collect()}
    t, u = got["t"], got["u"]
    assert (t.windows, t.valid, t.accepted, t.healthy_review, t.fault_review, t.right_suspect) == (4, 0.5, 0.75, 1.0, 0.5, 0.5)
    assert (u.abstained, u.healthy_review, u.fault_review, u.input_tokens) == (1.0, 0.0, None, 10)


def test_snapshots_count_absence(spark):
    frame = spark.createDataFrame([(0, [("a", "u1", 0), ("a", "u2", 3)]), (1, [("a", "u1", 1)]), (2, [])], "t int, pods array<struct<service: string, uid: string, restarts: int>>")
    got = {r.service: (r.instances, r.missing, r.restarts) for r in evaluate.snapshot_summary(frame, ["a", "b"]).collect()}
    assert got == {"a": (2, 1, 3), "b": (0, 3, 0)}


def test_statuses_are_normalised(spark):
    frame = spark.createDataFrame([("200", None), ("", True), (None, False), ("x", None), (" 404 ", True)], "s string, f boolean")
    code, source = scalar.normal_status(F.col("s"), F.col("f"))
    assert [tuple(r) for r in frame.select(code, source).collect()] == [(200, "status code"), (500, "error flag"), (0, "error flag"), (None, "unavailable"), (404, "status code")]
