"""Steps whose cost must follow the rows and not pairs, keys or dense copies of them."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from landing import land
from pyspark.sql import functions as F

import __spark_entry__ as entry
from opslake.operators import forest, novelty, ranking, windows
from opslake.plans import model_queries as models
from opslake.plans import registry
from opslake.streaming import jobs, processors

SF = "/root/testdata/sf0.01"


def test_interval_counts_equal_all_pairs(spark):
    rng = random.Random(5)
    points = [(rng.choice("ab"), i, rng.choice([rng.uniform(0, 40), 10.0, 20.0])) for i in range(300)]
    intervals = [(rng.choice("abc"), i, s := float(rng.randrange(40)), s + rng.choice([0, -1, 1, 3, 17])) for i in range(120)]
    true = {}
    for k, f, s, e in intervals:
        if inside := [v for key, v, t in points if key == k and s <= t < e]:
            true[f, k] = (len(inside), min(inside))
    args = spark.createDataFrame(points, "k string, v long, t double"), spark.createDataFrame(intervals, "k string, f long, s double, e double")
    for parts in (1, 3):
        out = ranking.interval_counts(*args, ["k"], ["f"], "t", "s", "e", 10.0, "v", hot_parts=parts)
        assert {(r.f, r.k): (r.n, r.least) for r in out.collect()} == true


def test_groups_of_keys_do_not_change_a_state_machine(spark):
    """Calls are as many as groups; each key still has its own state over batches, a null key too."""
    rows = [(None if i % 11 == 0 else i % 11, i, i % 7) for i in range(220)]
    frame = spark.createDataFrame(rows, "s long, i long, v long")

    def step(row, key, state):
        total = (state[0] if state else 0) + row["v"]
        return [(*key, int(row["i"]), total)], (total,)

    sums, true = {}, []
    for s, i, v in rows:
        sums[s] = sums.get(s, 0) + v
        true.append((s, i, sums[s]))
    for groups in (1, 3, 1000):
        out = jobs.run(jobs.stateful(land(frame, [F.col("i") < 90, F.col("i") >= 90]), ["s"], ["i"], "s long, i long, total long", "total long", step, groups=groups))
        assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[1]) == true


def test_queries_are_spread_where_prototypes_are_one_block(spark):
    asked = spark.range(16).select(F.col("id").cast("int").alias("_q"))
    known = spark.createDataFrame([(0, "p")], "_p int, _ps string")
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        pairs = novelty.block_pairs(asked, known, "_q", "_p", 16, 1)
        assert sorted(r._q for r in pairs.collect()) == list(range(16))
        assert pairs.withColumn("_at", F.spark_partition_id()).select("_at").distinct().count() > 1
    finally:
        for name in plain:
            spark.conf.unset(name)


def test_vectors_are_dense_a_part_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((300, 40)) < 0.2, rng.random((300, 40)), 0.0)
    nodes = pd.concat([pd.DataFrame(forest.grow_tree(x[rng.permutation(300)[:64]], t), columns=["node", "feature", "split", "left", "right", "size"]).assign(tree=t) for t in range(9)])
    grown, widest = forest.Forest(nodes), []
    monkeypatch.setattr(forest, "CELLS_AT_ONCE", 40 * 50)
    made = forest.column_matrix
    monkeypatch.setattr(forest, "column_matrix", lambda v, size: widest.append(len(v)) or made(v, size))
    sparse = pa.array([[{"i": int(i), "v": row[i]} for i in np.flatnonzero(row)] for row in x], pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float64())])))
    assert np.array_equal(grown.score_column(sparse.slice(20), 40), grown.score(x[20:])) and max(widest) == 50
    trees = {t: n.set_index("node") for t, n in nodes.groupby("tree")}
    for row, score in zip(x[:20], grown.score(x[:20])):
        paths = []
        for n in trees.values():
            at, depth = 0, 0
            while n.feature[at] >= 0:
                at, depth = n.left[at] if row[n.feature[at]] < n.split[at] else n.right[at], depth + 1
            paths.append(depth + float(forest.average_depth(n["size"][at])))
        assert abs(score - 2.0 ** (-np.mean(paths) / grown.expected)) < 1e-12


def test_groups_of_services_do_not_change_coverage(spark):
    """One group holds all services, whose windows end at different times, and one timer."""
    day = processors.DAY_MS
    rows = [(s, float(w)) for s in "abc" for w in range(7) if (ord(s) + w) % 3 and w not in (3, 4)] + [("clock", 15.0)]
    frame = spark.createDataFrame(rows, "service string, day double").withColumn("at", F.timestamp_millis((F.col("day") * day + 5000).cast("long")))
    expected, guard = spark.createDataFrame([(s,) for s in "abc"], "service string"), processors.CoverageGuard(2, 0.5, day)
    built = lambda s: processors.coverage_stream(lambda: s, "at", "1 hour", "1 day", expected, guard, groups=1)
    out = jobs.fed(frame, [F.lit(True)], built, runner=processors.run).where("service <> 'clock' AND window < 7")
    got = {(r.service, r.window): r.seen for r in out.collect()}
    assert got == {(s, w): (s, float(w)) in rows for s in "abc" for w in range(7)}


def test_coverage_meets_many_services_without_a_product(spark):
    """Services that are too many to broadcast: a product would run a partition's state anew for each of their partitions."""
    day, plans = processors.DAY_MS, []
    rows = [(s, float(w)) for s in "abcdefgh" for w in range(5) if (ord(s) + w) % 3] + [("clock", 15.0)]
    frame = spark.createDataFrame(rows, "service string, day double").withColumn("at", F.timestamp_millis((F.col("day") * day + 5000).cast("long")))
    expected, guard = spark.createDataFrame([(s,) for s in "abcdefgh"], "service string"), processors.CoverageGuard(2, 0.5, day)

    def run(stream, mode, folder):
        out = processors.coverage_stream(lambda: stream, "at", "1 hour", "1 day", expected, guard)
        with processors.settings(spark, **{processors.STORE: processors.ROCKSDB}):
            query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        plans.append(query._jsq.explainInternal(False))
        return spark.read.parquet(f"{folder}/out")

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jobs.fed(frame, [F.col("day") < 3, F.col("day") >= 3], lambda s: s, runner=run).where("service <> 'clock' AND window < 5").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.service, r.window): r.seen for r in out} == {(s, w): (s, float(w)) in rows for s in "abcdefgh" for w in range(5)} and len(out) == 40
    assert all("TransformWithState" in p and "CartesianProduct" not in p for p in plans)


@pytest.mark.parametrize("name", ["m04_session_forest", "m20_residual_and_tail"])
def test_no_task_holds_the_values_of_all_sessions(spark, monkeypatch, name):
    """Medians of the whole table come from ranges where it is large, with the same result."""
    query, ranged, made = entry.queries()[name], [], ranking.grouped_quantiles
    small = query(spark, SF).collect()
    monkeypatch.setattr(windows, "GROUP_ROWS", 10)
    monkeypatch.setattr(ranking, "grouped_quantiles", lambda *a: ranged.append(1) or made(*a))
    large = query(spark, SF).collect()
    assert len(ranged) == 2 and len(small) > 1000 and sorted(large, key=str) == sorted(small, key=str)


def test_the_whole_table_meets_its_medians_and_size_without_a_product(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, rng.uniform(0, 9)]), rng.uniform(0, 5)) for i in range(400)]
    frame = spark.createDataFrame(rows, "i long, a double, b double").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for group_rows in (None, 10):
            out = windows.mad_reference(frame, [], ["a", "b"], [0.01, 2.0], group_rows)
            got = out.first()
            for c, values, floor in (("a", [r[1] for r in rows if r[1] is not None], 0.01), ("b", [r[2] for r in rows], 2.0)):
                middle = np.median(values)
                assert got[f"{c}_center"] == pytest.approx(middle) and got[f"{c}_scale"] == pytest.approx(max(floor, np.median(np.abs(values - middle))))
            assert out.count() == 1
        drawn = forest.sample_rows(frame, F.col("i"), None, ["a", "b"], 3, 16)
        for df in (out, drawn):
            assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
        assert drawn.select("group").distinct().collect() == [("all",)] and {r["count"] >= 16 for r in drawn.groupBy("tree").count().collect()} == {True}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def lines_read(spark, monkeypatch):
    """How often the queries of message drift read each log line, as a function of a query's name."""
    read, made = spark.sparkContext.accumulator(0), models.log_lines

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(models, "log_lines", lambda spark, d: (df := made(spark, d)).mapInArrow(counted, df.schema))
    rows = made(spark, SF).count()

    def times(name):
        before = read.value
        assert registry.QUERIES[name](spark, SF).collect()
        return (read.value - before) / rows

    return times


def test_drift_reads_lines_for_counts_and_for_evidence(lines_read):
    assert lines_read("m09_calibrated_drift") == 2


def test_content_summary_reads_lines_once(lines_read):
    assert lines_read("a30_content_summary") == 1


@pytest.mark.parametrize("seed", [3, 4])
def test_evidence_from_counts_of_templates_equals_that_from_events(spark, tmp_path, seed):
    rng = random.Random(seed)
    of = {"plain": 0.0, "rare": 0.7, "new": 0.9, None: 1.0}
    rows = []
    for i in range(900):
        t = rng.choices(list(of), [1, 1, 1, 1] if rng.random() < 0.3 else [60, 1, 1, 1])[0]
        rows.append((rng.choice(["a", "b", "c", None]), rng.randrange(7), rng.randrange(50), f"message {i % 40}", t))
    events = spark.createDataFrame(rows, "service string, window int, time long, message string, template string")
    known = spark.createDataFrame(list(of.items()), "_t string, novelty double")
    limit = spark.createDataFrame([(0.05,)], "threshold double")
    scored = lambda df: df.join(known, F.col("template").eqNullSafe(F.col("_t"))).drop("_t")
    counts = scored(novelty.template_counts(events, ["service", "window"], "template", str(tmp_path / "counts")))
    got = novelty.template_evidence(events, "template", counts, limit, (0, 7), str(tmp_path / "findings"))
    expected = novelty.drift_evidence(scored(events), limit, (0, 7))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() >= 2
    quantile = novelty.novelty_threshold(counts, n="n").first().threshold
    assert quantile == pytest.approx(np.quantile([of[r[4]] for r in rows], 0.995))
    none = novelty.template_evidence(events.limit(0), "template", counts.limit(0), limit, (0, 7), str(tmp_path / "none"))
    assert none.count() == 0
