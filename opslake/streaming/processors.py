"""Keyed processors with typed state, timers and chained stateful operators.

State is in RocksDB and the checkpoint; :func:`run` starts a stream with that store. All outputs equal those of batch
operators over the same rows, wherever the stream is stopped and started again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import jobs

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def settings(spark: SparkSession, **values: str):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """:func:`.jobs.run` with state in RocksDB. Batches without rows let event-time timers fire at the end of what has landed."""
    with settings(stream.sparkSession, **{STORE: ROCKSDB}):
        return jobs.run(stream, mode, folder)


def run_on_rows(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """:func:`run` for state that expires by processing time, which would ask for batches without rows for ever."""
    with settings(stream.sparkSession, **{STORE: ROCKSDB, IDLE_BATCHES: "false"}):
        return jobs.run(stream, mode, folder)


#: Groups of keys whose state is read and written together: a call costs much the same for one key or for some.
KEY_GROUPS = 1 << 11


# feature windows ---------------------------------------------------------------------------------------------------

SCORED = "stream string, end long, arrival long, status string, reason string, windows int, score double, alert boolean, candidates array<string>"


_KINDS = {"end": "int64", "arrival": "int64", "windows": "int32", "score": "float64", "alert": "bool"}


class FeatureScorer(StatefulProcessor):
    """Scores messages (one stream's feature vectors by service for the window that ends at ``end``), in arrival order.

    A message is accepted if it is the stream's first, or has its profile and ends one step after the last accepted one;
    others come out as ``rejected`` with a reason (profile, not later, gap) and leave the state as it was. State is the
    last accepted place and the feature vectors of the last ``kept`` windows, and expires ``ttl_ms`` after its last
    change. Streams are dealt over groups by :func:`score_features`; a group's states are read, and all its messages scored,
    in one call. ``scorer`` takes histories [services, kept, features], with zeros before a service's first window, and
    returns a score each. Services without any available signal are no candidates; without candidates the answer is
    ``abstained``. The score is the best candidate's; an alert is a score over the profile's threshold.
    """

    def __init__(self, scorer: Callable[[np.ndarray], np.ndarray], available: Callable[[np.ndarray], np.ndarray], thresholds: dict[str, float], features: int, step: int = 60, kept: int = 5, top: int = 5, ttl_ms: int | None = 7 * DAY_MS):
        self.scorer, self.available, self.thresholds, self.features = scorer, available, thresholds, features
        self.step, self.kept, self.top, self.ttl = step, kept, top, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = "streams array<string>, profiles array<string>, lasts array<long>, windows array<int>, changed array<long>, ends array<array<long>>, services array<array<string>>, features array<array<double>>"
        self.state = handle.getValueState("streams", held, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        columns = ["stream", "end", "arrival", "profile", "names", "flat"]
        messages = sorted((m for frame in rows for m in zip(*[frame[c] for c in columns])), key=lambda m: m[2])
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        streams = self._load(now)
        out, asked, changed = [], [], False
        for stream, end, arrival, profile, services, flat in messages:
            end = int(end)
            place, history = streams.get(stream, (None, []))
            reason = None
            if place and profile != place[0]:
                reason = "profile"
            elif place and end <= place[1]:
                reason = "not later"
            elif place and end != place[1] + self.step:
                reason = "gap"
            if reason:
                out.append([stream, end, int(arrival), "rejected", reason, 0, None, False, []])
                continue
            place, changed = (profile, end, min(self.kept, place[2] + 1) if place else 1, now), True  # accepted windows have no gaps
            current = dict(zip(services, np.asarray(flat, float).reshape(-1, self.features)))
            history = [h for h in history if h[0] > end - self.kept * self.step] + [(end, s, f) for s, f in current.items()]
            streams[stream] = (place, history)
            names = sorted(current)
            number = {s: i for i, s in enumerate(names)}
            raw = np.zeros((len(names), self.kept, self.features))
            for e, s, f in history:
                if s in number:
                    raw[number[s], self.kept - 1 - (end - e) // self.step] = f
            valid = self.available(raw[:, -1])
            asked.append((len(out), profile, [n for n, v in zip(names, valid) if v], raw[valid]))
            out.append([stream, end, int(arrival), "abstained", None, place[2], None, False, []])
        for (at, profile, names, _), scores in zip(asked, self._scores([raw for *_, raw in asked])):
            if names:
                order = sorted(range(len(names)), key=lambda i: (-scores[i], names[i]))[: self.top]
                best = float(scores[order[0]])
                out[at][3], out[at][6], out[at][7], out[at][8] = "scored", best, best > self.thresholds[profile], [names[i] for i in order]
        if changed:
            self._save(streams)
        columns = dict(zip([c.split()[0] for c in SCORED.split(", ")], zip(*out)))
        yield pd.DataFrame({c: np.array(v, _KINDS[c]) if c in _KINDS else list(v) for c, v in columns.items()})

    def _load(self, now: int) -> dict[str, tuple]:
        """Of each stream of the group its place (profile, end, windows, time of the last change) and history, in one call that
        reads all; streams whose time is over are left out."""
        held = self.state.get()
        streams = {}
        for stream, profile, end, windows, changed, ends, services, features in zip(*held) if held else ():
            if not self.ttl or now < changed + self.ttl:
                streams[stream] = (profile, end, windows, changed), list(zip(ends, services, np.array(features, float).reshape(-1, self.features)))
        return streams

    def _save(self, streams: dict[str, tuple]) -> None:
        held = [(s, *place, [e for e, *_ in h], [n for _, n, _ in h], np.concatenate([f for *_, f in h]).tolist() if h else []) for s, (place, h) in streams.items()]
        self.state.update(tuple(map(list, zip(*held))))

    def _scores(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """All histories of the group's messages in one call."""
        if not parts or not sum(map(len, parts)):
            return [np.zeros(0)] * len(parts)
        return np.split(self.scorer(np.concatenate(parts)), np.cumsum([len(p) for p in parts])[:-1])

    def close(self) -> None:
        pass


def score_features(messages: DataFrame, processor: FeatureScorer, groups: int = KEY_GROUPS) -> DataFrame:
    """messages: stream string, end, arrival, profile, services array<struct<service, features>>."""
    flat = F.flatten(F.transform("services", lambda s: s["features"]))
    plain = messages.select("stream", "end", "arrival", "profile", F.transform("services", lambda s: s["service"]).alias("names"), flat.alias("flat"))
    return plain.withColumn("_group", F.pmod(F.xxhash64("stream"), F.lit(groups))).groupBy("_group").transformWithStateInPandas(processor, SCORED, "append", "ProcessingTime" if processor.ttl else "None")


# incidents ---------------------------------------------------------------------------------------------------------

TRANSITIONS = "service string, start int, at int, kind string"


class Incidents(StatefulProcessor):
    """Opens an incident on the second warning in a row and closes it on the second clear in a row. A service that sends no
    window for ``silence`` windows of event time is forgotten by a timer, and an open incident is closed as ``silent``."""

    def __init__(self, width_ms: int, origin_ms: int = 0, silence: int = 7):
        self.width, self.origin, self.silence = width_ms, origin_ms, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("incident", "active boolean, warnings int, clears int, last int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        windows = pd.concat(list(rows), ignore_index=True).sort_values("window")
        active, warnings, clears, last = tuple(self.state.get()) if self.state.exists() else (False, 0, 0, 0)
        out = []
        for last, warning in zip(windows["window"].astype(int), windows["warning"].astype(bool)):
            warnings, clears = (warnings + 1, 0) if warning else (0, clears + 1)
            kind = "open" if warnings >= 2 and not active else "close" if clears >= 2 and active else None
            if kind:
                active = kind == "open"
                out.append((key[0], last, last + 1, kind))
        self.state.update((active, warnings, clears, int(last)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self.origin + (int(last) + 1 + self.silence) * self.width)
        yield pd.DataFrame(out, columns=["service", "start", "at", "kind"]).astype({"start": "int32", "at": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        active, _, _, last = tuple(self.state.get()) if self.state.exists() else (False, 0, 0, 0)
        self.state.clear()
        out = [(key[0], last, last + 1 + self.silence, "silent")] if active else []
        yield pd.DataFrame(out, columns=["service", "start", "at", "kind"]).astype({"start": "int32", "at": "int32"})

    def close(self) -> None:
        pass


def online_incidents(requests: DataFrame, time: str, delay: str, width: str, aggregates: list[Column], model: DataFrame, warning: Column, processor: Incidents) -> DataFrame:
    """Raw requests in, incident transitions out: windows by event time, aggregated once the watermark has passed them, meet
    the model's row of their service, and go through the incident processor, all in one stream."""
    windows = requests.withWatermark(time, delay).groupBy(F.window(time, width).alias("_w"), "service").agg(*aggregates)
    number = F.floor((F.unix_millis("_w.start") - F.lit(processor.origin)) / F.lit(processor.width)).cast("int")
    scored = windows.withColumns({"_at": F.window_time("_w"), "window": number}).join(model, "service").select("service", "_at", "window", warning.alias("warning"))
    return scored.groupBy("service").transformWithStateInPandas(processor, TRANSITIONS, "append", "EventTime")


# coverage ----------------------------------------------------------------------------------------------------------

COVERAGE = "service string, window int, seen boolean, coverage double, insufficient boolean, gap long, issue boolean"


class CoverageGuard(StatefulProcessor):
    """For each window and expected service: whether the service was seen, the window's coverage, and the service's gap.

    Rows are the service's presence in a window (``coverage`` null) and the coverage of each window that had any event.
    A presence waits in state for its window's coverage. A window in which no service sent anything has no row at all: a
    timer finds that it is over and answers for it with coverage 0. Gaps count absent windows and start anew after a
    presence or an insufficient window. Services are dealt over groups by :func:`coverage_stream`; a group's states are
    read and written in one call and it has one timer."""

    def __init__(self, threshold: int, required: float, width_ms: int, origin_ms: int = 0, slack_windows: int = 1):
        self.threshold, self.required = threshold, required
        self.width, self.origin, self.slack = width_ms, origin_ms, slack_windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = "services array<string>, nexts array<int>, gaps array<long>, waiting array<array<int>>, timer long"
        self.state = handle.getValueState("services", held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        covered = []
        for frame in rows:
            for service, w, coverage in zip(frame["service"].tolist(), frame["window"].tolist(), frame["coverage"].tolist()):
                self.places.setdefault(service, [0, 0, set()])
                if coverage is None or coverage != coverage:
                    self.places[service][2].add(int(w))
                else:
                    covered.append((int(w), service, float(coverage)))
        out: list[tuple] = []
        for w, service, coverage in sorted(covered, key=lambda c: c[0]):
            self._advance(service, w, out)
            self._answer(service, w, coverage, out)
        self._save()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        fired, self.timer, now = self.timer, None, timerValues.getCurrentWatermarkInMs()
        out: list[tuple] = []
        for service, place in self.places.items():
            if self._over(place) <= fired or self._over(place) < now:
                self._advance(service, place[0] + 1, out)
        self._save()
        yield self._frame(out)

    def _load(self) -> None:
        """Next window, gap and waiting presences of each service of the group, in one call; :meth:`_save` writes them in one."""
        held = self.state.get()
        *places, self.timer = held if held else ([], [], [], [], None)
        self.places = {s: [n, g, set(w)] for s, n, g, w in zip(*places)}

    def _over(self, place: list) -> int:
        """When the window after the last answered one is over, and the slack with it."""
        return self.origin + (place[0] + 1 + self.slack) * self.width

    def _advance(self, service, upto: int, out: list[tuple]) -> None:
        """Windows before ``upto`` that no coverage has come for: nobody sent anything."""
        while self.places[service][0] < upto:
            self._answer(service, self.places[service][0], 0.0, out)

    def _answer(self, service, window: int, coverage: float, out: list[tuple]) -> None:
        place = self.places[service]
        seen = window in place[2]
        place[2].discard(window)
        insufficient = coverage < self.required
        gap = 0 if seen or insufficient else place[1] + 1
        place[:2] = window + 1, gap
        out.append((service, window, seen, coverage, insufficient, gap, gap >= self.threshold))

    def _save(self) -> None:
        """The state, and one timer: for the service whose window is over first."""
        timer = min(map(self._over, self.places.values()))
        if timer != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.handle.registerTimer(timer)
        held = zip(*[(s, n, g, sorted(w)) for s, (n, g, w) in self.places.items()])
        self.state.update((*map(list, held), timer))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        kinds = {"service": object, "window": "int32", "seen": "bool", "coverage": "float64", "insufficient": "bool", "gap": "int64", "issue": "bool"}
        return pd.DataFrame({c: np.array(v, kind) for (c, kind), v in zip(kinds.items(), list(zip(*out)) or [()] * len(kinds))})

    def close(self) -> None:
        pass


def coverage_stream(events: Callable[[], DataFrame], time: str, delay: str, width: str, expected: DataFrame, processor: CoverageGuard, groups: int = KEY_GROUPS) -> DataFrame:
    """Raw events (service, time) in, the coverage guard's rows out.

    ``events`` opens the stream; it is opened twice, for the services' presences and for the windows' coverage, which is
    their number over that of the expected services. Each window's coverage goes to every expected service: that is the
    dense grid which the guard answers with, no more. No window's services are gathered in one row. Coverage meets the
    services by their group: a join without a key would be a product once they are too many to broadcast, and that runs a
    partition's windows, and so their state, anew for each partition of services, which the state store refuses."""
    number = lambda w: F.floor((F.unix_millis(F.col(w)["start"]) - F.lit(processor.origin)) / F.lit(processor.width)).cast("int")
    seen = lambda: events().withWatermark(time, delay).groupBy(F.window(time, width).alias("_w"), "service").agg(F.count(F.lit(1)).alias("_n"))
    present = seen().withColumns({"_at": F.window_time("_w"), "window": number("_w")}).select("service", "_at", "window", F.lit(None).cast("double").alias("coverage"))
    total = expected.agg(F.count(F.lit(1)).alias("_total"))
    counted = seen().withColumn("_t", F.window_time("_w")).groupBy(F.window("_t", width).alias("_v")).agg(F.count(F.lit(1)).alias("_present"))
    counted = counted.withColumns({"_at": F.window_time("_v"), "window": number("_v")})
    group = F.pmod(F.xxhash64("service"), F.lit(groups))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    cover = counted.join(F.broadcast(total)).withColumn("_group", every).join(expected.select("service", group.alias("_group")), "_group").select("service", "_at", "window", (F.col("_present") / F.col("_total")).alias("coverage"))
    rows = present.unionByName(cover)
    return rows.withColumn("_group", group).groupBy("_group").transformWithStateInPandas(processor, COVERAGE, "append", "EventTime")
