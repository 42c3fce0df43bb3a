"""A detector and ranker on short histories of three sources, trained by mini-batches as Spark jobs.

Each source has a recurrent encoder; a service's state is the mean of its sources' states, weighted by gates over those that
are there. A window's detection comes from the mean and the largest of its services' states, a service's rank from its state
and the mean. Services have no identity and no place: their order, and services that are not there, change nothing. A window
without any source has no score.

An item is one window: keys, ``services`` (array of service, history, seen, faulty), truth, weight. All services of a batch of
items are rows of one matrix, with the item that each belongs to, so nothing is padded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import FEATURES, LOGS_AT, MISSING_AT, TRACES_AT

HISTORY = 5
SOURCES = {"metrics": [*range(8), MISSING_AT], "logs": [8, 9, LOGS_AT], "traces": [11, 12, 13, 14, TRACES_AT, 16]}
HIDDEN_SHARE = 0.15
ROWS_AT_ONCE = 1 << 14


def items(df: DataFrame, keys: list[str], truth: Column, faulty: Column, seen: Column) -> DataFrame:
    """keys, services, truth of rows (keys, service, history): one row a window, with as many services as the inventory has."""
    part = F.struct("service", "history", seen.alias("seen"), faulty.alias("faulty"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("services"), F.max(truth.cast("double")).alias("truth"))


class Fusion:
    """Weights as one flat vector with named views, and the sums of loss and gradient over a batch."""

    def __init__(self, hidden: int = 16, values: np.ndarray | None = None, seed: int = 7):
        self.hidden, h = hidden, hidden
        shapes = {}
        for name, columns in SOURCES.items():
            shapes |= {f"{name}_in": (len(columns), 3 * h), f"{name}_state": (h, 3 * h), f"{name}_bias": (1, 3 * h), f"{name}_gate": (h, 1)}
        for head in ("rank", "detect"):
            shapes |= {f"{head}_first": (2 * h, h), f"{head}_shift": (1, h), f"{head}_last": (h, 1), f"{head}_level": (1, 1)}
        self.shapes, self.size = shapes, sum(a * b for a, b in shapes.values())
        self.values = np.zeros(self.size) if values is None else np.asarray(values, float)
        self.w = self.views(self.values)
        if values is None:
            rng = np.random.default_rng(seed)
            for name, (a, b) in shapes.items():
                if not name.endswith(("bias", "shift", "level")):
                    self.w[name][:] = rng.normal(0, 1 / math.sqrt(a), (a, b))

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, (a, b) in self.shapes.items():
            out[name] = flat[at : at + a * b].reshape(a, b)
            at += a * b
        return out

    def encode(self, name: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """The state after the last step, and what each step needs to go back."""
        h, steps = np.zeros((len(x), self.hidden)), []
        n, u = self.hidden, self.w[f"{name}_state"]
        for t in range(x.shape[1]):
            a = x[:, t] @ self.w[f"{name}_in"] + self.w[f"{name}_bias"]
            zr = _sigmoid(a[:, : 2 * n] + h @ u[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n :] + (r * h) @ u[:, 2 * n :])
            steps.append((h, z, r, c))
            h = z * h + (1 - z) * c
        return h, steps

    def back(self, name: str, x: np.ndarray, steps: list, dh: np.ndarray, g: dict) -> None:
        n, u, du = self.hidden, self.w[f"{name}_state"], g[f"{name}_state"]
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, c = steps[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            drh = dc @ u[:, 2 * n :].T
            dr = drh * h * r * (1 - r)
            da = np.hstack([dz, dr, dc])
            g[f"{name}_in"] += x[:, t].T @ da
            g[f"{name}_bias"] += da.sum(0)
            du[:, : 2 * n] += h.T @ da[:, : 2 * n]
            du[:, 2 * n :] += (r * h).T @ dc
            dh = dh * z + drh * r + da[:, : 2 * n] @ u[:, : 2 * n].T

    def head(self, name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = np.tanh(x @ self.w[f"{name}_first"] + self.w[f"{name}_shift"])
        return (middle @ self.w[f"{name}_last"] + self.w[f"{name}_level"])[:, 0], middle

    def head_back(self, name: str, x: np.ndarray, middle: np.ndarray, d: np.ndarray, g: dict) -> np.ndarray:
        g[f"{name}_last"] += middle.T @ d[:, None]
        g[f"{name}_level"] += d.sum()
        inner = d[:, None] * self.w[f"{name}_last"].T * (1 - middle * middle)
        g[f"{name}_first"] += x.T @ inner
        g[f"{name}_shift"] += inner.sum(0)
        return inner @ self.w[f"{name}_first"].T

    def forward(self, batch: Batch) -> dict:
        """Detections and ranks (logits), which services and items count, and the steps between."""
        f, of, n = {}, batch.of, batch.items
        f["x"] = {s: batch.x[:, :, columns] for s, columns in SOURCES.items()}
        coded = {s: self.encode(s, f["x"][s]) for s in SOURCES}
        f["states"], f["steps"] = np.stack([coded[s][0] for s in SOURCES], 1), [coded[s][1] for s in SOURCES]
        gates = np.stack([coded[s][0] @ self.w[f"{s}_gate"] for s in SOURCES], 1)[:, :, 0]
        there = batch.there
        gates = np.where(there, gates, -np.inf)
        e = np.exp(gates - gates.max(1, initial=-1e30, keepdims=True))
        f["share"] = e / np.maximum(e.sum(1, keepdims=True), 1e-300)
        f["fused"] = (f["states"] * f["share"][:, :, None]).sum(1)
        f["valid"] = batch.seen & there.any(1)
        rows = np.flatnonzero(f["valid"])
        f["rows"], f["of"], v = rows, of[rows], f["fused"][rows]
        f["count"] = np.bincount(f["of"], minlength=n)
        f["mean"] = np.zeros((n, self.hidden))
        np.add.at(f["mean"], f["of"], v)
        f["mean"] /= np.maximum(f["count"], 1)[:, None]
        f["most"] = np.full((n, self.hidden), -np.inf)
        np.maximum.at(f["most"], f["of"], v)
        f["most"][f["count"] == 0] = 0.0
        f["rank_in"] = np.hstack([v, f["mean"][f["of"]]])
        f["rank"], f["rank_middle"] = self.head("rank", f["rank_in"])
        f["detect_in"] = np.hstack([f["mean"], f["most"]])
        f["detect"], f["detect_middle"] = self.head("detect", f["detect_in"])
        return f

    def loss(self, batch: Batch, gradient: bool = True) -> tuple[float, np.ndarray | None]:
        """The sum over the items that have a source: weighted cross-entropy of detection, and half the cross-entropy of the
        faulty services among all where one is there."""
        f = self.forward(batch)
        live = f["count"] > 0
        d = f["detect"]
        total = (batch.weight * (np.logaddexp(0, d) - batch.truth * d))[live].sum()
        of, faulty = f["of"], batch.faulty[f["rows"]]
        hits = np.bincount(of, faulty, minlength=batch.items)
        top = np.full(batch.items, -np.inf)
        np.maximum.at(top, of, f["rank"])
        e = np.exp(f["rank"] - top[of])
        sums = np.bincount(of, e, minlength=batch.items)
        asked = (hits > 0)[of]
        share = faulty / np.maximum(hits, 1)[of]
        total += 0.5 * (share * (np.log(sums[of]) + top[of] - f["rank"]))[asked].sum()
        if not gradient:
            return float(total), None
        flat = np.zeros(self.size)
        g = self.views(flat)
        dd = np.where(live, batch.weight * (_sigmoid(d) - batch.truth), 0.0)
        dr = np.where(asked, 0.5 * (e / sums[of] - share), 0.0)
        d_detect = self.head_back("detect", f["detect_in"], f["detect_middle"], dd, g)
        d_rank = self.head_back("rank", f["rank_in"], f["rank_middle"], dr, g)
        h = self.hidden
        d_mean = d_detect[:, :h].copy()
        np.add.at(d_mean, of, d_rank[:, h:])
        v = f["fused"][f["rows"]]
        d_v = d_rank[:, :h] + d_mean[of] / f["count"][of][:, None]
        largest = v == f["most"][of]
        ties = np.zeros((batch.items, h))
        np.add.at(ties, of, largest)
        d_v += np.where(largest, d_detect[:, h:][of] / np.maximum(ties, 1)[of], 0.0)
        d_fused = np.zeros_like(f["fused"])
        d_fused[f["rows"]] = d_v
        inner = (f["states"] * d_fused[:, None, :]).sum(2)
        d_gate = f["share"] * (inner - (f["share"] * inner).sum(1, keepdims=True))
        for i, s in enumerate(SOURCES):
            g[f"{s}_gate"] += f["states"][:, i].T @ d_gate[:, i : i + 1]
            dh = d_fused * f["share"][:, i : i + 1] + d_gate[:, i : i + 1] * self.w[f"{s}_gate"].T
            self.back(s, f["x"][s], f["steps"][i], dh, g)
        return float(total), flat


class Batch:
    """Some items as matrices: x (services, steps, features), of (a service's item), there (sources), seen, faulty, truth,
    weight. Values enter as log(1 + x); ``drop`` hides a source, ``hide`` (a number) hides a ``share`` of logs and traces
    by chance, though never all the sources that a service has."""

    def __init__(self, batch: pa.RecordBatch, drop: str | None = None, hide: int | None = None, share: float = HIDDEN_SHARE):
        lists = batch.column("services")
        services = lists.flatten()
        self.items = len(lists)
        self.of = np.repeat(np.arange(self.items), np.diff(lists.offsets.to_numpy()))
        self.names = services.field("service")
        raw = services.field("history").flatten().to_numpy(zero_copy_only=False).reshape(-1, HISTORY, FEATURES)
        self.x = np.log1p(np.maximum(raw, 0.0))
        self.there = np.stack([raw[:, -1, MISSING_AT] < 1, raw[:, :, LOGS_AT].max(1, initial=0) > 0, raw[:, :, TRACES_AT].max(1, initial=0) > 0], 1)
        if drop:
            self.there[:, list(SOURCES).index(drop)] = False
        if hide is not None:
            kept = np.random.default_rng(hide).random(self.there.shape) >= share
            kept[:, 0] = True
            kept |= ~(self.there & kept).any(1, keepdims=True)
            self.there &= kept
        of = lambda name: services.field(name).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        self.seen, self.faulty = of("seen"), of("faulty").astype(float)
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(float) if name in batch.schema.names else np.ones(self.items)
        self.truth, self.weight = number("truth"), number("weight")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sliced(batches):
    """Batches cut so that about ``ROWS_AT_ONCE`` services are matrices at once."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, ROWS_AT_ONCE * batch.num_rows // max(1, len(batch.column("services").flatten())))
            for i in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(i, step).columns], schema=batch.schema)


SUMS = "gradient array<double>, loss double, n long, held double, held_n long"


def gradient_sums(data: DataFrame, model: Fusion, step: int, share: float = HIDDEN_SHARE) -> tuple[np.ndarray, float, int, float, int]:
    """Gradient, loss and number of the training items, loss and number of the held-out ones. Each task sums its own, and
    about the root of the tasks' sums are summed in tasks before the rest come to the driver."""
    values, hidden = model.values, model.hidden

    def each(batches):
        net, total, loss, n, held, held_n = Fusion(hidden, values), np.zeros(len(values)), 0.0, 0, 0.0, 0
        for number, batch in enumerate(_sliced(batches)):
            out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for part, held_out in ((batch.filter(pa.array(~out)), False), (batch.filter(pa.array(out)), True)):
                if part.num_rows and held_out:
                    held, held_n = held + net.loss(Batch(part), gradient=False)[0], held_n + part.num_rows
                elif part.num_rows:
                    one, g = net.loss(Batch(part, hide=step * 1_000_003 + number, share=share))
                    total, loss, n = total + g, loss + one, n + part.num_rows
        yield pa.RecordBatch.from_pylist([{"gradient": total, "loss": loss, "n": n, "held": held, "held_n": held_n}], schema=sums)

    sums = pa.schema([("gradient", pa.list_(pa.float64())), ("loss", pa.float64()), ("n", pa.int64()), ("held", pa.float64()), ("held_n", pa.int64())])
    groups = math.ceil(math.sqrt(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(g) for g in table["gradient"].to_pylist()], axis=0)
        return pa.Table.from_pylist([{"gradient": total, **{c: sum(table[c].to_pylist()) for c in ("loss", "n", "held", "held_n")}}], schema=sums)

    rows = data.mapInArrow(each, SUMS).groupBy(F.pmod(F.spark_partition_id(), F.lit(groups))).applyInArrow(added, SUMS).collect()  # at most ``groups``
    gradient = np.sum([np.asarray(r.gradient) for r in rows], axis=0) if rows else np.zeros(len(values))
    return gradient, *[sum(r[c] for r in rows) for c in ("loss", "n", "held", "held_n")]


def fit(data: DataFrame, held_out: Column, key: Column, epochs: int = 12, batches: int = 1, hidden: int = 16, rate: float = 0.02, patience: int = 4, folder: str | None = None) -> Fusion:
    """The weights with the least held-out loss (without held-out items: the last); training ends after ``patience`` epochs
    that bring none. Items are dealt to ``batches`` mini-batches by a hash of their key; with a ``folder`` they are written
    there by batch, so that a step reads its own only. A step is one job: gradients are summed over its items and the
    weights, the same few thousand numbers whatever the data, take one step of Adam with clipped gradients. Positive items
    weigh as many times more as they are rarer."""
    rows = data.withColumns({"held_out": held_out, "_batch": F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")})
    counts = rows.where(~F.col("held_out")).agg(F.count_if(F.col("truth") == 0).alias("a"), F.count_if(F.col("truth") == 1).alias("b")).first()
    rows = rows.withColumn("weight", F.when(F.col("truth") == 1, counts.a / max(1, counts.b)).otherwise(1.0)).select("services", "truth", "weight", "held_out", "_batch")
    if folder:
        rows.write.mode("overwrite").partitionBy("_batch").parquet(folder)
        rows = data.sparkSession.read.parquet(folder)
    model = Fusion(hidden)
    m, v, best, least, stale, step = np.zeros(model.size), np.zeros(model.size), model.values.copy(), math.inf, 0, 0
    for _ in range(epochs):
        held, held_n = 0.0, 0
        for batch in range(batches):
            before = model.values.copy()
            gradient, _, n, lost, lost_n = gradient_sums(rows.where(F.col("_batch") == batch).drop("_batch"), model, step)
            held, held_n, step = held + lost, held_n + lost_n, step + 1
            if not n:
                continue
            gradient /= n
            gradient *= min(1.0, 1.0 / max(1e-12, float(np.linalg.norm(gradient))))
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            model = Fusion(hidden, model.values - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        if held_n:  # the losses that an epoch's steps report are those of the weights before the last of them
            if held / held_n < least:
                best, least, stale = before, held / held_n, 0
            else:
                stale += 1
                if stale >= patience:
                    break
        else:
            best = model.values
    return Fusion(hidden, best)


def predict(data: DataFrame, model: Fusion, keys: list[str], drop: str | None = None) -> DataFrame:
    """keys, score, ranking of every item: null and empty where no service has a source (``drop`` takes one away). Equal
    ranks are in the order of names."""
    values, hidden = model.values, model.hidden
    schema = T.StructType([*[data.schema[k] for k in keys], T.StructField("score", T.DoubleType()), T.StructField("ranking", T.ArrayType(T.StringType()))])

    def each(batches):
        net = Fusion(hidden, values)
        for batch in _sliced(batches):
            b = Batch(batch, drop)
            f = net.forward(b)
            rows = f["rows"]
            names = np.array(b.names.to_pylist(), dtype=object)[rows] if len(rows) else np.array([], dtype=object)
            order = sorted(range(len(rows)), key=lambda i: (f["of"][i], -round(float(f["rank"][i]), 9), names[i]))
            bounds = np.append(0, np.cumsum(f["count"]))
            ranked = [[names[i] for i in order[bounds[k] : bounds[k + 1]]] for k in range(b.items)]
            scores = pa.array(_sigmoid(f["detect"]), mask=f["count"] == 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], scores, pa.array(ranked, pa.list_(pa.string()))], [*keys, "score", "ranking"])

    return data.select(*keys, "services").mapInArrow(each, schema)
