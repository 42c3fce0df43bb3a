"""Isolation forests as table jobs: a node table is grown in Spark and scores rows by vectorised descent.

Features are a list of numeric columns, or one array column (``array<double>``, or with ``size`` dimensions a sparse
``array<struct<i, v>>``).
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import with_quantiles

NODES = "group string, tree int, node int, feature int, split double, left int, right int, size int"
TREES_A_TASK = 25
ROWS_A_TASK = 200_000
PATHS_AT_ONCE = 1 << 20
CELLS_AT_ONCE = 1 << 21


def average_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def vector(features: list[str] | Column) -> Column:
    if isinstance(features, Column):
        return features
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def matrix(values, size: int | None) -> np.ndarray:
    """Rows of dense or, with a size, sparse vectors as one dense matrix."""
    if size is None:
        return np.array([list(v) for v in values], float).reshape(len(values), -1)
    out = np.zeros((len(values), size))
    for row, v in zip(out, values):
        for e in v:
            row[e["i"]] = e["v"]
    return out


def column_matrix(values: pa.ListArray, size: int | None) -> np.ndarray:
    """:func:`matrix` of an Arrow column, without an object for a value."""
    flat = values.flatten()
    if size is None:
        return flat.to_numpy(zero_copy_only=False).reshape(len(values), -1)
    out = np.zeros((len(values), size))
    row = np.repeat(np.arange(len(values)), pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
    out[row, pc.struct_field(flat, "i").to_numpy(zero_copy_only=False)] = pc.struct_field(flat, "v").to_numpy(zero_copy_only=False)
    return out


def sample_rows(df: DataFrame, key: Column, group: Column | None, features: list[str] | Column, trees: int, psi: int) -> DataFrame:
    """group, tree, x: psi rows for each tree without replacement, those with the smallest hash of (row, tree). A row is
    only repeated for the trees in whose reach its hash is, so the work is trees * psi and not trees * rows. Without a group
    all rows are of ``all``, whose size is one row for every task: a join on a constant may be a product."""
    rows = df.select((F.lit("all") if group is None else group.cast("string")).alias("group"), key.alias("_key"), vector(features).alias("x"))
    count = F.count(F.lit(1)).alias("_n")
    sized = rows.join(F.broadcast(rows.agg(count))) if group is None else rows.join(rows.groupBy(F.col("group").alias("_g")).agg(count), F.col("group").eqNullSafe(F.col("_g")))
    reach = F.least(F.lit(1.0), (F.lit(1.3 * psi) + 40) / F.col("_n")) * 1_000_000
    place = lambda t: F.pmod(F.xxhash64("_key", t), F.lit(1_000_000))
    drawn = sized.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(place(F.col("tree")) < reach)
    return drawn.select("group", "tree", "x", F.xxhash64("_key", "tree").alias("_h"))


def grow_tree(x: np.ndarray, tree: int) -> list[list]:
    """Nodes of one tree, each after its parent: random splits of the features that vary, down to the usual depth."""
    rng = np.random.default_rng(tree)
    limit = max(1, math.ceil(math.log2(max(2, len(x)))))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_right else 3] = number
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(open_):
            nodes.append([number, -1, 0.0, -1, -1, len(rows)])
            continue
        f = int(rng.choice(open_))
        at = max(float(rng.uniform(low[f], high[f])), float(np.nextafter(low[f], high[f])))  # neither side is empty
        nodes.append([number, f, at, -1, -1, len(rows)])
        goes = x[rows, f] < at
        todo += [(rows[~goes], depth + 1, number, True), (rows[goes], depth + 1, number, False)]
    return nodes


def grow(df: DataFrame, key: Column, features: list[str] | Column, group: Column | None = None, trees: int = 200, psi: int = 256, size: int | None = None) -> DataFrame:
    """The node table of a forest per group. Leaves have feature -1; node 0 is the root. A task grows some trees of a group
    from their psi rows each."""

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, rows in pdf.sort_values(["tree", "_h"]).groupby("tree"):
            nodes = grow_tree(matrix(rows["x"].head(psi).tolist(), size), int(tree))
            out.append(pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "size"]).assign(group=pdf["group"].iloc[0], tree=int(tree)))
        return pd.concat(out)[["group", "tree", "node", "feature", "split", "left", "right", "size"]]

    sampled = sample_rows(df, key, group, features, trees, psi)
    return sampled.groupBy("group", F.floor(F.col("tree") / TREES_A_TASK)).applyInPandas(some, NODES)


class Forest:
    """A group's trees as flat arrays. Leaves point at themselves, so all paths take equally many steps."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        first = nodes.groupby("tree")["node"].transform("size").to_numpy()
        tree = nodes["tree"].to_numpy()
        self.roots = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        base = np.repeat(self.roots, first[self.roots])
        leaf = nodes["feature"].to_numpy() < 0
        here = np.arange(len(nodes))
        self.feature = np.where(leaf, 0, nodes["feature"].to_numpy())
        self.split = nodes["split"].to_numpy()
        left = np.where(leaf, here, base + nodes["left"].to_numpy())
        right = np.where(leaf, here, base + nodes["right"].to_numpy())
        self.next = np.column_stack([right, left]).ravel()
        size = nodes["size"].to_numpy()
        depth, level, self.steps = np.zeros(len(nodes)), self.roots, 0
        while len(level := level[~leaf[level]]):
            self.steps += 1
            level = np.concatenate([left[level], right[level]])
            depth[level] = self.steps
        self.path = depth + average_depth(size)
        self.expected = max(float(average_depth(size[self.roots].max())), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path) per row: near 1 is anomalous."""
        out = np.empty(len(x))
        at_once = max(1, PATHS_AT_ONCE // len(self.roots))
        for i in range(0, len(x), at_once):
            part = np.ascontiguousarray(x[i : i + at_once])
            flat, begin = part.ravel(), np.arange(len(part)) * part.shape[1]
            paths = np.empty((len(part), len(self.roots)))
            for t, root in enumerate(self.roots):  # a tree's nodes stay in the cache
                node = np.full(len(part), root)
                for _ in range(self.steps):
                    node = self.next[2 * node + (flat[begin + self.feature[node]] < self.split[node])]
                paths[:, t] = self.path[node]
            out[i : i + at_once] = 2.0 ** (-paths.mean(axis=1) / self.expected)
        return out

    def score_column(self, values: pa.ListArray, size: int | None) -> np.ndarray:
        """Scores of an Arrow column of vectors; at most ``CELLS_AT_ONCE`` values are dense at once."""
        at_once = max(1, CELLS_AT_ONCE // (size or 64))
        parts = [self.score(column_matrix(values.slice(i, at_once), size)) for i in range(0, len(values), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0)


def score(df: DataFrame, nodes: DataFrame, features: list[str] | Column, group: Column | None = None, name: str = "score", size: int | None = None) -> DataFrame:
    """df with the forest's score of each row; rows of a group without a forest get none.

    One forest, whose nodes are bounded by trees * 2 psi, is broadcast. Forests by group stay tables: a group's rows meet
    its nodes in tasks of at most about ``ROWS_A_TASK`` rows, so neither the number of groups nor a large group matters."""
    if group is None:
        return _score_by_one(df, nodes, vector(features), name, size)
    rows = df.withColumn("_group", F.coalesce(group.cast("string"), F.lit(""))).withColumn("_x", vector(features))
    tasks = rows.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / ROWS_A_TASK).cast("int").alias("_tasks"))
    dealt = rows.join(tasks, "_group").withColumn("_task", F.pmod(F.monotonically_increasing_id(), F.col("_tasks")).cast("int")).drop("_tasks")
    copies = nodes.withColumnRenamed("group", "_group").join(tasks, "_group").withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1))).drop("_tasks")
    columns = df.columns

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        values = np.zeros(left.num_rows) if not right.num_rows else np.concatenate([np.zeros(0), *map(partial(Forest(right.to_pandas()).score_column, size=size), left["_x"].chunks)])
        none = np.full(left.num_rows, not right.num_rows)
        return left.select(columns).append_column(name, pa.array(values, pa.float64(), mask=none))

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return dealt.groupBy("_group", "_task").cogroup(copies.groupBy("_group", "_task")).applyInArrow(scored, schema)


def _score_by_one(df: DataFrame, nodes: DataFrame, x: Column, name: str, size: int | None) -> DataFrame:
    table = nodes.toPandas()
    shared = df.sparkSession.sparkContext.broadcast(Forest(table) if len(table) else None)

    columns = [c for c in df.columns if c != name]
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField(name, T.DoubleType())])

    def scored(batches):
        forest = shared.value
        for batch in batches:
            values = pa.nulls(batch.num_rows, pa.float64()) if forest is None else pa.array(forest.score_column(batch.column("_x"), size))
            yield pa.record_batch([*[batch.column(c) for c in columns], values], schema.names)

    return df.select(*columns, x.alias("_x")).mapInArrow(scored, schema)


def introspect(nodes: DataFrame) -> DataFrame:
    """How often each feature splits, per group."""
    return nodes.where("feature >= 0").groupBy("group", "feature").agg(F.count(F.lit(1)).alias("splits"), F.min("split").alias("least"), F.max("split").alias("most"))


def report(nodes: DataFrame, training: DataFrame, scored: DataFrame, features: list[str], group: Column, share: float = 0.995) -> DataFrame:
    """group, feature, splits (of the group's trees), least and most (values of its training rows, null if it has none), threshold
    (the quantile of the group's scores), for every group and feature. The features are columns."""
    long = training.select(group.cast("string").alias("group"), F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])).alias("_e"))
    ranges = long.groupBy("group", F.col("_e.feature").alias("feature")).agg(F.min("_e.v").alias("least"), F.max("_e.v").alias("most"))
    splits = nodes.where("feature >= 0").groupBy("group", "feature").agg(F.count(F.lit(1)).alias("splits"))
    limits = with_quantiles(scored.select(group.cast("string").alias("group"), "score"), ["group"], [], "score", {"threshold": share})
    out = ranges.join(splits, ["group", "feature"], "left").join(limits, "group", "left")
    return out.select("group", F.element_at(F.array(*[F.lit(c) for c in features]), F.col("feature") + 1).alias("feature"), F.coalesce("splits", F.lit(0)).alias("splits"), "least", "most", "threshold")
