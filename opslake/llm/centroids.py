"""Clustering around centroids (Lloyd's rounds) with heap-ordered bounds, exact in integers.

A vector's gap is its distance to the second nearest centroid less that to its own. When centroids move, the gap of a
vector of cluster c shrinks by at most the drift of c plus the largest drift of another centroid. So each cluster adds
up its drift, and a vector put into the cluster's heap gets the key ``gap + drift so far``: it needs no look until the
cluster's drift reaches that key, whatever happens in between. A round pops the vectors whose key the drift has reached,
compares only these with all centroids, exactly, and puts them into the heap of their new cluster.

The heap of a cluster is a set of runs, Parquet tables in the order (cluster, key). The drift never falls, so what
earlier rounds popped is a prefix of each run, and what a round pops is the next range of it: a filter on ``cluster``
and ``due`` that reaches the scan and skips row groups and pages, so other vectors are not read. Popped vectors make
one new run. When runs hold twice as many rows as there are vectors, the round also moves the live rows into its new
run, and the old ones are deleted. Sums of a cluster change only by the vectors that leave or join it.

Keys are doubles; a vector is popped already when its gap is within ``SLACK`` of closing, far more than rounding can
amount to, so the result is that of comparing all vectors in every round.

Cases: vectors of another length, or with a null, infinite or NaN component, or with a component of 65,536 or more (the
squared distance would leave 64 bits) are not kept; a null vec_id counts as the empty text among the seeds; repeated rows
are vectors of their own; fewer kept vectors than clusters make as many clusters as vectors; none, or an empty table, an
empty result. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove_tables, written

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
LARGEST = 1 << 26
SLACK = 1e-6
RUN = "vec_id long, vec array<int>, before int, cluster int, due double"


def integer_vectors(table: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, vec (integers) of the rows whose embedding can be kept."""
    x = F.col("embedding")
    scaled = F.transform(x, lambda v: v.cast("double") * F.lit(float(scale)))
    fits = F.forall(scaled, lambda v: v.isNotNull() & (v >= -LARGEST) & (v < LARGEST))  # NaN is larger than any number
    return table.where((F.size(x) == dims) & fits).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda v: F.floor(v).cast("int")).alias("vec"))


def seeds(vectors: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id`` [k, dims]."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["vec"] for r in vectors.select(key.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()], np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances [vectors, centroids], exact in 64 bits."""
    return np.stack([np.square(x - c).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and the gap to the second nearest."""
    d = distances(x, centroids)
    own = d.argmin(axis=1)
    at = np.arange(len(x))
    best = np.sqrt(d[at, own].astype(float))
    if len(centroids) == 1:
        return own, np.full(len(x), np.inf)
    d[at, own] = np.iinfo(np.int64).max
    return own, np.sqrt(d.min(axis=1).astype(float)) - best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


@dataclass
class Run:
    """A part of all heaps: rows in the order (cluster, due), of which each cluster's with ``due <= low`` are popped."""

    table: DataFrame
    rows: int
    low: np.ndarray

    def between(self, high: np.ndarray | None) -> DataFrame:
        """The rows that are live, or of these the ones that drift has reached."""
        wanted: Column = F.lit(False)
        for c, low in enumerate(self.low):
            mine = F.col("cluster") == c
            if np.isfinite(low):
                mine &= F.col("due") > float(low)
            wanted |= mine if high is None else mine & (F.col("due") <= float(high[c]))
        return self.table.where(wanted)


class Heaps:
    """The vectors by cluster, popped as the centroids drift."""

    def __init__(self, vectors: DataFrame, centroids: np.ndarray):
        self.centroids = centroids
        self.drift = np.zeros(len(centroids))
        self.sums = np.zeros(centroids.shape, object)  # exact whatever the number of vectors
        self.counts = np.zeros(len(centroids), object)
        self.rescanned: list[int] = []
        first = vectors.select("vec_id", "vec", F.lit(-1).alias("before"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("due"))
        self.runs: list[Run] = []
        self._push(first)

    def _push(self, rows: DataFrame) -> None:
        """Compares with all centroids the rows whose key the drift has reached, and makes one run of all."""
        centroids, drift = self.centroids, self.drift.copy()

        def placed(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch)
                cluster = batch.column("cluster").to_numpy(zero_copy_only=False).copy()
                due = batch.column("due").to_numpy(zero_copy_only=False).copy()
                before = cluster.copy()
                reached = np.flatnonzero((cluster < 0) | (due <= drift[cluster] + SLACK))
                own, gap = nearest(x[reached], centroids)
                cluster[reached] = own
                due[reached] = gap + drift[own]
                yield pa.record_batch([batch.column("vec_id"), batch.column("vec"), pa.array(before, pa.int32()), pa.array(cluster, pa.int32()), pa.array(due, pa.float64())], ["vec_id", "vec", "before", "cluster", "due"])

        table = written(rows.mapInArrow(placed, RUN).sortWithinPartitions("cluster", "due"))
        n = table.count()
        self.runs.append(Run(table, n, np.full(len(centroids), -np.inf)))
        self._account(table.where("before <> cluster"))

    def _account(self, moved: DataFrame) -> None:
        """Takes the vectors that changed clusters out of the old sums and into the new ones."""
        k, dims = self.centroids.shape

        def summed(batches):
            n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
            for batch in batches:
                x = _matrix(batch)
                for column, sign in (("before", -1), ("cluster", 1)):
                    of = batch.column(column).to_numpy(zero_copy_only=False)
                    for c in range(k):
                        mine = of == c
                        n[c] += sign * int(mine.sum())
                        total[c] += sign * x[mine].sum(axis=0)
            some = np.flatnonzero((n != 0) | total.any(axis=1))
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        parts = moved.mapInArrow(summed, "cluster int, n long, total array<long>")
        flat = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "total")).alias("i", "v"))
        for r in flat.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # clusters x dimensions
            if r["i"]:
                self.sums[r["cluster"], r["i"] - 1] += int(r["v"])
            else:
                self.counts[r["cluster"]] += int(r["v"])

    def move(self) -> bool:
        """Moves each non-empty centroid to the floored mean of its vectors. False if none has moved."""
        new = self.centroids.copy()
        for c in np.flatnonzero(self.counts > 0):
            new[c] = [s // self.counts[c] for s in self.sums[c]]
        step = np.sqrt(np.square(new - self.centroids).sum(axis=1).astype(float))
        if not step.any():
            return False
        others = np.array([np.delete(step, c).max(initial=0.0) for c in range(len(step))])
        self.centroids, self.drift = new, self.drift + step + others
        return True

    def reassign(self) -> None:
        """Pops what the drift has reached, and pushes it where it belongs now."""
        high = self.drift + SLACK
        total = int(sum(self.counts))
        full = sum(r.rows for r in self.runs) > 2 * total
        old = list(self.runs)
        popped = None
        for run in old:
            part = run.between(None if full else high)
            popped = part if popped is None else popped.unionByName(part)
        self._push(popped)
        if full:
            self.runs = self.runs[len(old) :]
            remove_tables(*[r.table for r in old])
        for run in self.runs[:-1]:
            run.low = high
        self.rescanned.append(self.runs[-1].rows)

    def members(self) -> DataFrame:
        """vec_id, cluster, distance (squared, to its centroid) of each vector, once."""
        centroids = self.centroids
        live = None
        for run in self.runs:
            part = run.between(None)
            live = part if live is None else live.unionByName(part)

        def measured(batches):
            for batch in batches:
                cluster = batch.column("cluster")
                d = np.square(_matrix(batch) - centroids[cluster.to_numpy(zero_copy_only=False)]).sum(axis=1) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.record_batch([batch.column("vec_id"), cluster, pa.array(d)], ["vec_id", "cluster", "distance"])

        return live.mapInArrow(measured, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """vec_id, cluster, distance of the kept vectors; the final centroids; the vectors compared with all centroids in each
    round after the first (compacting rounds count all rows they move)."""
    vectors = integer_vectors(table, dims, scale)
    start = seeds(vectors, k, seed)
    if not len(start):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), start, []
    heaps = Heaps(vectors, start)
    for _ in range(rounds):
        if not heaps.move():  # nothing would change any more
            break
        heaps.reassign()
    members = written(heaps.members())
    remove_tables(*[r.table for r in heaps.runs])
    return members, heaps.centroids, heaps.rescanned


def clustered(spark: SparkSession, table: DataFrame) -> DataFrame:
    """The vectors with cluster, squared distance, inertia of the cluster and of all, and the centroid's SHA-256."""
    members, centroids, _ = cluster(table)
    hashes = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    sizes = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per_cluster = sizes.join(F.broadcast(spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")), "cluster")
    total = members.agg(F.sum("distance").alias("inertia"))
    per_cluster = per_cluster.crossJoin(F.broadcast(total))
    return members.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    """The same in SQL: every round compares all vectors with all centroids."""
    assigned = "SELECT r, v, arg_min(cluster, d * {k} + cluster) AS cluster, CAST(min(d) AS BIGINT) AS distance FROM (SELECT r, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i}) GROUP BY r, v"
    moved = """SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {dims} + 1)) AS i) GROUP BY cluster, i) GROUP BY cluster
  ) n USING (cluster)"""
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({assigned.format(i=i, k=k)})")
        steps.append(f"c{i + 1} AS MATERIALIZED ({moved.format(i=i, dims=dims)})")
    steps.append(f"a{rounds} AS MATERIALIZED ({assigned.format(i=rounds, k=k)})")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {k})
), {", ".join(steps)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (cluster)"""
