"""Features of three sources and the model on their histories, against plain Python and finite differences."""

import math
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opslake.operators import features, temporal

SERVICES = pa.list_(pa.struct([("service", pa.string()), ("history", pa.list_(pa.float64())), ("seen", pa.bool_()), ("faulty", pa.bool_())]))


def item(rng, names, faulty=None, missing=0.0, logs=1.0, traces=1.0, seen=True):
    out = []
    for n in names:
        x = rng.uniform(0, 5, (5, 18))
        x[:, 17], x[:, 10], x[:, 15] = missing, logs, traces
        out.append({"service": n, "history": x.ravel().tolist(), "seen": seen, "faulty": n == faulty})
    return out


def batch(items, truth=None, weight=None):
    n = len(items)
    return pa.record_batch([pa.array(items, SERVICES), pa.array(truth or [0.0] * n), pa.array(weight or [1.0] * n)], ["services", "truth", "weight"])


def outputs(model, items, **options):
    f = model.forward(temporal.Batch(batch(items), **options))
    return f["detect"], f["rank"], f["count"]


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    items = [item(rng, "abc", "b"), item(rng, "de", logs=0.0), [], item(rng, "fgh", "h", missing=1.0), item(rng, "i", missing=1.0, logs=0.0, traces=0.0)]
    b = temporal.Batch(batch(items, [1.0, 0.0, 0.0, 1.0, 1.0], [1.0, 2.0, 1.0, 3.0, 1.0]))
    model = temporal.Fusion(4)
    _, gradient = model.loss(b)
    for i in rng.choice(model.size, 120, replace=False):
        step = np.zeros(model.size)
        step[i] = 1e-6
        up, down = (temporal.Fusion(4, model.values + s).loss(b, gradient=False)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_order_and_unseen_services_change_nothing():
    rng = np.random.default_rng(2)
    model, a = temporal.Fusion(8), item(rng, "abc")
    detect, rank, _ = outputs(model, [a])
    turned, turned_rank, _ = outputs(model, [[a[2], a[0], a[1]]])
    assert turned == pytest.approx(detect) and turned_rank == pytest.approx(rank[[2, 0, 1]])
    more, more_rank, count = outputs(model, [a + item(rng, "xy", seen=False)])
    assert more == pytest.approx(detect) and more_rank == pytest.approx(rank) and count.tolist() == [3]


def test_a_dropped_source_does_not_matter():
    rng = np.random.default_rng(3)
    model, a = temporal.Fusion(8), item(rng, "ab")
    other = [dict(s, history=np.array(s["history"]).reshape(5, 18).copy()) for s in a]
    for s in other:
        s["history"][:, 11:17] = 90.0
        s["history"] = s["history"].ravel().tolist()
    assert outputs(model, [a], drop="traces")[0] == pytest.approx(outputs(model, [other], drop="traces")[0])
    assert outputs(model, [a])[0] != pytest.approx(outputs(model, [other])[0])


def test_chance_never_hides_every_source():
    rng = np.random.default_rng(4)
    items = [item(rng, "abcdefgh", missing=float(i % 2), traces=float(i % 3 > 0)) for i in range(60)]
    plain, hidden = temporal.Batch(batch(items)), temporal.Batch(batch(items), hide=5)
    assert (hidden.there.any(1) == plain.there.any(1)).all() and (hidden.there <= plain.there).all()
    assert (hidden.there[:, 0] == plain.there[:, 0]).all() and (hidden.there != plain.there).any()


def table(spark, rows):
    kind = "services array<struct<service string, history array<double>, seen boolean, faulty boolean>>"
    return spark.createDataFrame(rows, f"window long, {kind}, truth double")


def faulty_days(rng, n):
    out = []
    for w in range(n):
        names = list("abcd")
        bad = names[w % 4] if w % 3 == 0 else None
        services = item(rng, names, bad)
        for s in services:
            x = np.array(s["history"]).reshape(5, 18)
            x[:, :8] = rng.uniform(0, 1, (5, 8)) + (30.0 if s["faulty"] else 0.0)
            s["history"] = x.ravel().tolist()
        out.append((w, services, float(bad is not None)))
    return out


def test_training_finds_faults_and_their_services(spark, tmp_path):
    rows = faulty_days(np.random.default_rng(5), 90)
    data = table(spark, rows).repartition(3)
    model = temporal.fit(data, F.col("window") % 5 == 0, F.col("window"), epochs=25, batches=2, hidden=6, rate=0.05, patience=25, folder=str(tmp_path / "items"))
    got = {r.window: r for r in temporal.predict(data, model, ["window"]).collect()}
    assert len(got) == 90
    for w, _, truth in rows:
        assert (got[w].score > 0.5) == (truth == 1)
        assert truth == 0 or got[w].ranking[0] == "abcd"[w % 4]


def test_gradient_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    data = table(spark, [(w, s, t) for w, s, t in faulty_days(rng, 12)]).withColumns({"weight": F.lit(1.0), "held_out": F.col("window") >= 9}).select("services", "truth", "weight", "held_out")
    model = temporal.Fusion(4)
    a, b = (temporal.gradient_sums(data.repartition(n), model, 0, share=0.0) for n in (1, 5))
    assert a[0] == pytest.approx(b[0]) and np.abs(a[0]).max() > 0 and a[1] == pytest.approx(b[1])
    assert a[2] == b[2] == 9 and a[4] == b[4] == 3 and a[3] == pytest.approx(b[3])


def test_no_source_no_score_and_empty_tables(spark):
    rng = np.random.default_rng(7)
    rows = [(1, item(rng, "ab", missing=1.0, logs=0.0, traces=0.0), 0.0), (2, [], 0.0), (3, item(rng, "ab"), 0.0)]
    model = temporal.Fusion(4)
    got = {r.window: r for r in temporal.predict(table(spark, rows), model, ["window"]).collect()}
    assert got[1].score is None and got[1].ranking == [] and got[2].score is None and got[2].ranking == []
    assert 0 < got[3].score < 1 and sorted(got[3].ranking) == ["a", "b"]
    empty = table(spark, [])
    assert temporal.predict(empty, model, ["window"]).count() == 0
    assert np.isfinite(temporal.fit(empty, F.lit(False), F.col("window"), epochs=1).values).all()


def test_features_by_hand(spark):
    grid = spark.createDataFrame([(s, w) for s in "ab" for w in range(4)], "service string, window int")
    metric = [("a", 0, "cpu", 1.0), ("a", 0, "cpu", 3.0), ("a", 1, "cpu", 4.0), ("a", 2, "cpu", float("nan")), ("a", 3, "cpu", 50.0), ("a", 3, "mem", 9.0), ("b", 0, "cpu", 1.0)]
    log = [("a", 0, True), ("a", 0, False), ("a", 1, False), ("a", 3, True), ("b", 1, True)]
    span = [("a", 0, 10.0, 200), ("a", 0, 30.0, 500), ("a", 1, 20.0, None), ("a", 3, 400.0, None), ("a", 3, 400.0, 404), ("b", 1, 1.0, 200)]
    frames = [spark.createDataFrame(r, f"service string, window int, {c}") for r, c in ((metric, "kind string, value double"), (log, "error boolean"), (span, "duration double, status int"))]
    raw = features.raw_dimensions(grid, *frames, ["service", "window"], ["cpu", "mem"])
    reference = features.reference_dimensions(raw.where("service = 'a' AND window < 2"), ["service"])
    scaled = features.scaled_features(raw, reference, ["service", "window"], ["service"])
    got = {(r.service, r.window): r.features for r in scaled.collect()}

    def change(x, seen):
        c = statistics.median(seen)
        return min(100.0, abs(x - c) / max(statistics.pstdev(seen), abs(c) * 0.05, 1e-6))

    logs, shares = [math.log1p(2), math.log1p(1)], [0.5, 0.0]
    expected = [change(50, [2, 4]), *[0.0] * 7, change(math.log1p(1), logs), change(1.0, shares), 1.0]
    expected += [change(math.log1p(2), logs), change(400, [20, 20]), change(400, [30, 20]), change(1.0, [0.5]), 1.0, 0.5, 7 / 8]
    assert got[("a", 3)] == pytest.approx(expected)
    assert got[("a", 2)] == pytest.approx([0.0] * 17 + [1.0])
    assert all(got[("b", w)] == pytest.approx([0.0] * 17 + [1.0]) for w in range(4))  # nothing is known of b
    seen = {(r.service, r.window): r.o for r in scaled.select("service", "window", features.observed(F.col("features")).alias("o")).collect()}
    assert [seen[("a", w)] for w in range(4)] == [True, True, False, True] and not seen[("b", 1)]
    h = {(r.service, r.window): r.history for r in features.histories(scaled, ["service"], "window", 5).collect()}
    assert h[("a", 1)] == pytest.approx([0.0] * 54 + got[("a", 0)] + got[("a", 1)])
