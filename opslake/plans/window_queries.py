"""Queries of window aggregates, joins of modalities, normalisation, sequences and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import unusual_status
from ..operators import evaluate as E
from ..operators import scoring as C
from ..operators import selection as S
from ..operators import sequence as Q
from ..operators import windows as W
from ..operators.ranking import interval_counts, with_quantiles
from . import bindings as B
from .registry import query

R = "round({}, 6)".format
NUM = ["p95", "error_fraction", "rps"]


@query("a01_metric_mean", f"WITH {B.REQ} SELECT service, \"window\", {R('avg(duration)')} AS mean, count(duration) AS observations FROM req GROUP BY ALL")
def metric_mean(spark, d):
    return W.metric_means(B.req(spark, d), ["service", "window"], "duration")


@query(
    "a02_log_volume_errors",
    f"""WITH {B.MSG}, c AS (SELECT service, count(*) AS lines, count(*) FILTER (regexp_matches(message, '\\b(error|exception|fatal|panic|timeout|timed\\s+out|refused|failed|failure)\\b', 'i')) AS errors FROM msg GROUP BY service)
SELECT service, lines, errors, {R('ln(1 + lines)')} AS log_volume, {R('errors / lines')} AS error_rate FROM c""",
)
def log_volume(spark, d):
    return W.log_counts(B.msg(spark, d), ["service"], "message")


_SPANS = f"""{B.CHILD}, s AS (SELECT service, month, count(*) AS spans, sum(duration) AS duration, max(duration) AS longest,
  count(*) FILTER (status IS NOT NULL AND status <> 0 AND (status < 200 OR status >= 400)) AS unusual, count(status) AS known FROM child GROUP BY service, month)"""


@query("a03_span_aggregate", f"WITH {_SPANS} SELECT * FROM s")
def span_aggregate(spark, d):
    return W.span_sums(B.child(spark, d), ["service", "month"], "duration", "status")


@query("a04_partial_merge", f"WITH {_SPANS} SELECT service, CAST(sum(spans) AS BIGINT) AS spans, sum(duration) AS duration, max(longest) AS longest, CAST(sum(unusual) AS BIGINT) AS unusual, CAST(sum(known) AS BIGINT) AS known FROM s GROUP BY service")
def partial_merge(spark, d):
    return W.merge_span_sums(span_aggregate(spark, d), ["service"])


@query(
    "a05_span_ratios",
    f"""WITH {_SPANS} SELECT service, month, {R('ln(1 + spans)')} AS span_volume, {R('duration / spans')} AS mean_duration, longest,
  CASE WHEN known > 0 THEN {R('unusual / known')} ELSE 0.0 END AS unusual_rate, {R('known / spans')} AS known_rate, 1 AS present FROM s""",
)
def span_ratios(spark, d):
    return W.span_ratios(span_aggregate(spark, d))


@query("a06_request_window", f"WITH {B.WIN} SELECT service, \"window\", {R('p95')} AS p95, {R('error_fraction')} AS error_fraction, {R('rps')} AS rps, max_active, requests FROM win")
def request_window(spark, d):
    return W.request_windows(B.req(spark, d), 86400.0, group_rows=W.GROUP_ROWS)


_GRID = 'grid AS (SELECT service, w AS "window" FROM (SELECT DISTINCT event_type AS service FROM events), (SELECT unnest(range(0, 35)) AS w))'


def grid(spark, d):
    return W.spine(B.req(spark, d).select("service").distinct(), 0, 34)


@query(
    "a07_zero_fill",
    f"""WITH {B.WIN}, {_GRID} SELECT service, "window", {R('coalesce(p95, 0)')} AS p95, {R('coalesce(error_fraction, 0)')} AS error_fraction, {R('coalesce(rps, 0)')} AS rps,
  coalesce(max_active, 0) AS max_active, coalesce(requests, 0) AS requests FROM grid LEFT JOIN win USING (service, "window")""",
)
def zero_fill(spark, d):
    return W.dense(B.win(spark, d), grid(spark, d), ["service", "window"], [*NUM, "max_active", "requests"])


@query(
    "a08_healthy_reference",
    f"""WITH {B.WIN} SELECT service, {R('quantile_cont(p95, 0.5)')} AS p95_center, {R('greatest(stddev_pop(p95), abs(quantile_cont(p95, 0.5)) * 0.05, 1e-6)')} AS p95_scale, count(p95) AS p95_n,
  {R('quantile_cont(error_fraction, 0.5)')} AS error_fraction_center, {R('greatest(stddev_pop(error_fraction), abs(quantile_cont(error_fraction, 0.5)) * 0.05, 1e-6)')} AS error_fraction_scale, count(error_fraction) AS error_fraction_n
FROM win WHERE "window" < 15 GROUP BY service""",
)
def healthy_reference(spark, d):
    return W.healthy_reference(B.win(spark, d).where("window < 15"), ["service"], ["p95", "error_fraction"], W.GROUP_ROWS)


@query(
    "a09_mad_reference",
    f"""WITH {B.WIN}, h AS (SELECT * FROM win WHERE "window" < 15), m AS (SELECT service, quantile_cont(p95, 0.5) AS a, quantile_cont(error_fraction, 0.5) AS b FROM h GROUP BY service)
SELECT service, {R('any_value(a)')} AS p95_center, {R('any_value(b)')} AS error_fraction_center, {R('greatest(quantile_cont(abs(p95 - a), 0.5), 1.0)')} AS p95_scale,
  {R('greatest(quantile_cont(abs(error_fraction - b), 0.5), 0.01)')} AS error_fraction_scale FROM h JOIN m USING (service) GROUP BY service""",
)
def mad_reference(spark, d):
    return W.mad_reference(B.win(spark, d).where("window < 15"), ["service"], ["p95", "error_fraction"], [1.0, 0.01], W.GROUP_ROWS)


@query("a10_quantile_threshold", f"WITH {B.WIN} SELECT service, {R('quantile_cont(p95, 0.995)')} AS threshold FROM win WHERE \"window\" < 15 GROUP BY service")
def quantile_threshold(spark, d):
    return with_quantiles(B.win(spark, d).where("window < 15"), ["service"], [], "p95", {"threshold": 0.995})


_LIMITS = """limits AS (SELECT service, greatest(quantile_cont(p95, 0.99), 0) AS latency_limit, greatest(quantile_cont(error_fraction, 0.99), 0) AS error_limit FROM win WHERE "window" < 15 GROUP BY service)"""


def limits(spark, d):
    return W.envelopes(B.win(spark, d).where("window < 15"), 1.0, 0.0, 0.0)


@query("a11_operating_envelopes", f"WITH {B.WIN}, {_LIMITS} SELECT service, {R('latency_limit')} AS latency_limit, {R('error_limit')} AS error_limit FROM limits")
def operating_envelopes(spark, d):
    return limits(spark, d)


@query(
    "a11_default_envelopes",
    f"""WITH {B.WIN} SELECT service, {R('greatest(quantile_cont(p95, 0.99) * 2, 50)')} AS latency_limit, {R('greatest(quantile_cont(error_fraction, 0.99) + 0.05, 0.05)')} AS error_limit FROM win WHERE "window" < 15 GROUP BY service""",
)
def default_envelopes(spark, d):
    """Factor, floor and margin as they are set for users."""
    return W.envelopes(B.win(spark, d).where("window < 15"), group_rows=W.GROUP_ROWS)


@query("a12_window_score", f"WITH {B.WIN} SELECT \"window\", {R('max(p95)')} AS score, arg_max(service, {{'p': p95, 's': service}}) AS service FROM win GROUP BY \"window\"")
def window_score(spark, d):
    return B.win(spark, d).groupBy("window").agg(F.max("p95").alias("score"), F.max_by("service", F.struct("p95", "service")).alias("service"))


@query("a13_service_prior", "SELECT o_orderpriority AS system, o_orderstatus AS service, count(*) AS n, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus) AS INT) AS rank FROM orders GROUP BY 1, 2")
def service_prior(spark, d):
    counts = B.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("system"), F.col("o_orderstatus").alias("service")).agg(F.count(F.lit(1)).alias("n"))
    return Q.top_k(counts, ["system"], [F.col("n").desc(), F.col("service")], 1000)


@query(
    "a14_session_aggregate",
    f"""WITH {B.SESS} SELECT instance, {R('ln(1 + count(*))')} AS volume, {R("avg(CAST(operation = '1-URGENT' AS INT))")} AS error_fraction,
  {R('count(DISTINCT operation) / count(*)')} AS distinct_fraction, {R('quantile_cont(value, 0.95)')} AS q95, {R('avg(value)')} AS mean FROM sess GROUP BY instance""",
)
def session_aggregate(spark, d):
    s = B.sess(spark, d)
    aggregates = [
        F.log1p(F.count(F.lit(1))).alias("volume"),
        F.avg((F.col("operation") == "1-URGENT").cast("double")).alias("error_fraction"),
        (F.count_distinct("operation") / F.count(F.lit(1))).alias("distinct_fraction"),
        F.avg("value").alias("mean"),
    ]
    return with_quantiles(s, ["instance"], aggregates, "value", {"q95": 0.95})


_PIVOT = ", ".join(f"max(value) FILTER (operation = '{p}') AS op{i}" for i, p in enumerate(B.PRIORITIES))


def session_pivot(spark, d):
    s = B.sess(spark, d).groupBy("instance").pivot("operation", B.PRIORITIES).agg(F.max("value"))
    return s.toDF("instance", *[f"op{i}" for i in range(len(B.PRIORITIES))])


@query("a15_max_duration_pivot", f"WITH {B.SESS} SELECT instance, {_PIVOT} FROM sess GROUP BY instance")
def max_duration_pivot(spark, d):
    return session_pivot(spark, d)


@query(
    "a16_parse_audit",
    f"""WITH {B.SESS}, s AS (SELECT instance, count(*) AS n, count(DISTINCT operation) AS kinds FROM sess GROUP BY instance)
SELECT CAST(sum(n) AS BIGINT) AS lines, count(*) AS sessions, count(*) FILTER (kinds = 5) AS complete FROM s""",
)
def parse_audit(spark, d):
    s = B.sess(spark, d).groupBy("instance").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("operation").alias("kinds"))
    return s.agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("kinds") == 5).alias("complete"))


@query(
    "a17_modality_coverage",
    f"""WITH {B.REQ}, f AS (SELECT "window", bool_or(status IS NOT NULL) AS status, bool_or(duration > 400) AS slow, bool_or(k = 0) AS quiet FROM req GROUP BY "window")
SELECT count(*) AS windows, count(*) FILTER (status) AS with_status, count(*) FILTER (slow) AS with_slow, count(*) FILTER (quiet) AS with_quiet FROM f""",
)
def modality_coverage(spark, d):
    f = B.req(spark, d).groupBy("window").agg(F.bool_or(F.col("status").isNotNull()).alias("status"), F.bool_or(F.col("duration") > 400).alias("slow"), F.bool_or(F.col("k") == 0).alias("quiet"))
    return f.agg(F.count(F.lit(1)).alias("windows"), F.count_if("status").alias("with_status"), F.count_if("slow").alias("with_slow"), F.count_if("quiet").alias("with_quiet"))


# A user is a service that is seen only on the days of its events.
_SEEN = f"""{B.REQ}, users AS (SELECT DISTINCT stream AS service FROM req), days AS (SELECT unnest(range(0, 30)) AS "window"),
seen AS (SELECT users.service, days."window", r.n IS NOT NULL AS seen FROM users CROSS JOIN days LEFT JOIN (SELECT stream, "window", count(*) AS n FROM req GROUP BY ALL) r ON r.stream = users.service AND r."window" = days."window"),
islands AS (SELECT *, sum(CAST(seen AS INT)) OVER (PARTITION BY service ORDER BY "window") AS i FROM seen),
gaps AS (SELECT service, i, count(*) FILTER (NOT seen) AS gap FROM islands GROUP BY service, i)"""


def seen(spark, d):
    r = B.req(spark, d).groupBy(F.col("stream").alias("service"), "window").agg(F.lit(True).alias("seen"))
    days = W.spine(r.select("service").distinct(), 0, B.DAYS - 1)
    return days.join(r, ["service", "window"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


@query(
    "a18_expected_inventory",
    f"""WITH {_SEEN}, p AS (SELECT service, avg(CAST(seen AS INT)) AS presence FROM seen GROUP BY service)
SELECT service, {R('presence')} AS presence, CAST(max(gap) + 2 AS BIGINT) AS threshold FROM p JOIN gaps USING (service) WHERE presence >= 0.8 GROUP BY service, presence""",
)
def expected_inventory(spark, d):
    s = seen(spark, d)
    presence = s.groupBy("service").agg(F.avg(F.col("seen").cast("double")).alias("presence")).where("presence >= 0.8")
    return presence.join(Q.longest_gap(s, ["service"], "window", "seen"), "service").select("service", "presence", (F.col("longest_gap") + 2).alias("threshold"))


@query("w05_longest_gap", f"WITH {_SEEN} SELECT service, CAST(max(gap) AS BIGINT) AS longest_gap FROM gaps GROUP BY service")
def longest_gap(spark, d):
    return Q.longest_gap(seen(spark, d), ["service"], "window", "seen")


@query(
    "w06_coverage_guard",
    f"""WITH {_SEEN}, c AS (SELECT *, avg(CAST(seen AS INT)) OVER (PARTITION BY "window") AS coverage FROM seen),
f AS (SELECT *, coverage < 0.5 AS insufficient FROM c), g AS (SELECT *, sum(CAST(seen OR insufficient AS INT)) OVER (PARTITION BY service ORDER BY "window") AS j FROM f),
h AS (SELECT *, sum(CAST(NOT seen AND NOT insufficient AS INT)) OVER (PARTITION BY service, j ORDER BY "window") AS gap FROM g)
SELECT service, "window", seen, {R('coverage')} AS coverage, insufficient, CAST(gap AS BIGINT) AS gap, 2 AS threshold, gap >= 2 AS issue FROM h""",
)
def coverage_guard(spark, d):
    s = seen(spark, d)
    expected = s.select("service").distinct().withColumn("threshold", F.lit(2))
    return Q.coverage_guard(s, expected, required=0.5)


_CHANGE = """w AS (SELECT service, quantile_cont(p95, 0.5) AS c, stddev_pop(p95) AS s, quantile_cont(error_fraction, 0.5) AS ec, stddev_pop(error_fraction) AS es FROM win WHERE "window" < 5 GROUP BY service)"""


@query(
    "w01_causal_change",
    f"""WITH {B.WIN}, {_CHANGE} SELECT service, "window", {R('least(abs(p95 - c) / greatest(s, abs(c) * 0.05, 1e-6), 100)')} AS p95_change,
  {R('least(abs(error_fraction - ec) / greatest(es, abs(ec) * 0.05, 1e-6), 100)')} AS error_fraction_change, 0 AS columns_missing FROM win JOIN w USING (service)""",
)
def causal_change(spark, d):
    return W.causal_change(B.win(spark, d), ["service"], "window", ["p95", "error_fraction"])


@query(
    "w02_counter_rate",
    f"""WITH counter AS (SELECT o_custkey AS series, epoch(o_orderdate) AS t, min(o_totalprice) AS v FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(v) OVER w AS v0, lag(t) OVER w AS t0 FROM counter WINDOW w AS (PARTITION BY series ORDER BY t))
SELECT series, CAST(t AS BIGINT) AS t, {R('CASE WHEN v >= v0 THEN (v - v0) / (t - t0) END')} AS rate, v < v0 AS reset FROM l WHERE t0 IS NOT NULL""",
)
def counter_rate(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_custkey").alias("series"), F.unix_timestamp("o_orderdate").alias("t"), F.col("o_totalprice").alias("v"))
    return W.counter_rates(o, ["series"], "t", "v")


@query("w03_history", f"""WITH {B.WIN} SELECT service, "window", list_transform([coalesce(lag(p95, 4) OVER o, 0), coalesce(lag(p95, 3) OVER o, 0), coalesce(lag(p95, 2) OVER o, 0), coalesce(lag(p95) OVER o, 0), p95], lambda x: {R('x')}) AS p95_history FROM win WINDOW o AS (PARTITION BY service ORDER BY "window")""")
def history(spark, d):
    return W.history(B.win(spark, d), ["service"], "window", ["p95"]).withColumn("p95_history", F.transform("p95_history", lambda x: F.round(x, 6)))


_STREAK = f"""{B.BUSY}, i1 AS (SELECT *, sum(CAST(NOT warning AS INT)) OVER (PARTITION BY service ORDER BY "window") AS a, sum(CAST(warning AS INT)) OVER (PARTITION BY service ORDER BY "window") AS b FROM busy),
st AS (SELECT *, sum(CAST(warning AS INT)) OVER (PARTITION BY service, a ORDER BY "window") AS streak, sum(CAST(NOT warning AS INT)) OVER (PARTITION BY service, b ORDER BY "window") AS clear FROM i1)"""


@query("w04_persistence", f'WITH {_STREAK} SELECT service, "window", CAST(streak AS BIGINT) AS streak, streak >= 2 AS alert FROM st')
def persistence(spark, d):
    return Q.persistent(B.busy(spark, d), ["service"], "window", "warning").select("service", "window", "streak", "alert")


_TRANSITIONS = f"""{_STREAK}, marks AS (SELECT service, "window" AS start, until AS "at", CASE WHEN streak = 2 THEN 'open' ELSE 'close' END AS kind FROM st WHERE streak = 2 OR clear = 2),
lagged AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY service ORDER BY start), 'close') AS last FROM marks), transitions AS (SELECT service, start, "at", kind FROM lagged WHERE kind <> last)"""


@query("w07_incident_hysteresis", f"WITH {_TRANSITIONS} SELECT * FROM transitions")
def incident_hysteresis(spark, d):
    return Q.incident_transitions(B.busy(spark, d), ["service"], "window", "until", "warning")


_EPISODES = f'''{_TRANSITIONS}, episodes AS (SELECT service, "at" AS opened_at, closed_at FROM (SELECT *, lead("at") OVER (PARTITION BY service ORDER BY "at") AS closed_at FROM transitions) WHERE kind = 'open')'''


@query("w08_episodes", f"WITH {_EPISODES} SELECT * FROM episodes")
def incident_episodes(spark, d):
    return Q.episodes(incident_hysteresis(spark, d), ["service"])


@query("w09_first_alert", f'WITH {B.BUSY} SELECT service, min(until) AS first_alert FROM busy WHERE warning AND "window" >= 5 GROUP BY service')
def first_alert(spark, d):
    return Q.first_alerts(B.busy(spark, d).where("window >= 5"), ["service"], "until", "warning")


@query("w10_top_services", f'WITH {B.WIN} SELECT "window", service, {R("p95")} AS p95, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "window" ORDER BY p95 DESC, service) AS INT) AS rank FROM win) WHERE rank <= 3')
def top_services(spark, d):
    return Q.top_k(B.win(spark, d), ["window"], [F.col("p95").desc(), F.col("service")], 3).select("window", "service", "p95", "rank")


@query(
    "w11_top_evidence",
    f"""WITH {B.REQ} SELECT service, "window", span, status, {R('duration')} AS duration, place FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY service, "window" ORDER BY coalesce(status >= 400, false) DESC, duration DESC, span) AS INT) AS place FROM req) WHERE place <= 3""",
)
def top_evidence(spark, d):
    e = C.top_evidence(with_dependency(B.req(spark, d)), ["service", "window"])
    return e.select("service", "window", F.posexplode("evidence").alias("place", "e")).select("service", "window", "e.span", "e.status", "e.duration", (F.col("place") + 1).alias("place"))


def with_dependency(requests):
    """Some requests call the service ``view``; the call's status is the request's."""
    calls = F.col("k") % 3 == 0
    return requests.withColumn("dependency", F.when(calls, F.lit("view"))).withColumn("dependency_status", F.when(calls, F.col("status")))


_MAXES = ", ".join(f"max(value) FILTER (operation = '{p}') OVER o AS max_{i}" for i, p in enumerate(B.PRIORITIES))


@query("w12_prefix_running_max", f"WITH {B.SESS} SELECT instance, line, {_MAXES} FROM sess WINDOW o AS (PARTITION BY instance ORDER BY line ROWS UNBOUNDED PRECEDING)")
def prefix_running_max(spark, d):
    return Q.running_max(B.sess(spark, d), ["instance"], "line", "operation", "value", B.PRIORITIES)


@query(
    "w13_multiline_stitching",
    """WITH n AS (SELECT *, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS event FROM conversations)
SELECT conv_id, CAST(event AS BIGINT) AS event, CAST(count(*) AS INT) AS lines, string_agg(text, chr(10) ORDER BY turn) AS message FROM n GROUP BY conv_id, event""",
)
def multiline_stitching(spark, d):
    return Q.stitch_lines(B.lines(spark, d), ["conv_id"], "turn", "text", F.col("role") == "user")


_PAIRS = """tok AS (SELECT user_id AS session, event_type AS token, ts, event_id FROM events), p AS (
  SELECT session, coalesce(lag(token) OVER o, '-1') AS "left", token AS "right", lead(token) OVER o AS nxt FROM tok WINDOW o AS (PARTITION BY session ORDER BY ts, event_id)),
pairs AS (SELECT session, "left", "right" FROM p UNION ALL SELECT session, "right", '-2' FROM p WHERE nxt IS NULL), model AS (SELECT "left", "right", count(*) AS n FROM pairs GROUP BY ALL)"""


@query("w14_transition_model", f"WITH {_PAIRS} SELECT * FROM model")
def transition_model(spark, d):
    return Q.transition_counts(B.tok(spark, d), "session", ["ts", "event_id"], "token")


@query(
    "w15_transition_score",
    f"""WITH {_PAIRS}, totals AS (SELECT "left", sum(n) AS total FROM model GROUP BY ALL)
SELECT session, {R('avg(-ln((n + 0.1) / (total + 0.1 * 8)))')} AS score, count(*) AS transitions FROM pairs JOIN model USING ("left", "right") JOIN totals USING ("left") GROUP BY session""",
)
def transition_score(spark, d):
    t = B.tok(spark, d)
    return Q.transition_score(t, Q.transition_counts(t, "session", ["ts", "event_id"], "token"), "session", ["ts", "event_id"], "token", 8)


@query(
    "w16_sequence_integrity",
    f"""WITH {B.REQ}, m AS (SELECT stream, span, "window", max("window") OVER (PARTITION BY stream ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM req)
SELECT stream, "window", span, CASE WHEN last IS NULL OR "window" = last + 1 THEN 'ok' WHEN "window" = last THEN 'duplicate' WHEN "window" < last THEN 'late' ELSE 'gap' END AS status FROM m""",
)
def sequence_integrity(spark, d):
    return Q.sequence_status(B.req(spark, d), ["stream"], "window", "span", 1)


@query("w17_chronological_split", f"WITH {B.REQ} SELECT span, CASE WHEN end_s <= min(end_s) OVER () + 0.7 * (max(end_s) OVER () - min(end_s) OVER ()) THEN 'train' ELSE 'validation' END AS split FROM req")
def chronological_split(spark, d):
    return Q.chronological_split(B.req(spark, d), "end_s").select("span", "split")


@query(
    "w18_hash_split",
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('v1:' || o_orderkey)) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def hash_split(spark, d):
    return Q.hash_split(B.table(spark, d, "orders"), "o_orderpriority", F.concat(F.lit("v1:"), F.col("o_orderkey").cast("string"))).select("o_orderkey", "split")


@query("w19_hash_parity_split", "SELECT doc_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 AS INT) AS split FROM documents")
def parity_split(spark, d):
    return Q.parity_split(B.table(spark, d, "documents"), F.col("doc_id").cast("string")).select("doc_id", "split")


@query(
    "w20_group_disjoint_split",
    """WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256(source)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM documents JOIN g USING (source)""",
)
def group_disjoint_split(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", "source")
    groups = Q.hash_split(docs.select("source").distinct().withColumn("_all", F.lit(1)), "_all", F.col("source")).drop("_all")
    return docs.join(groups, "source").select("doc_id", "split")


@query(
    "w21_tail_rank",
    f"""WITH {B.SESS}, ref AS (SELECT * FROM sess WHERE line % 2 = 0), qry AS (SELECT DISTINCT operation, value FROM sess WHERE line % 2 = 1),
n AS (SELECT operation, count(*) AS n FROM ref GROUP BY 1), c AS (SELECT operation, value, count(*) AS m FROM ref GROUP BY ALL),
u AS (SELECT operation, value, m FROM c UNION ALL SELECT operation, value, 0 FROM qry), v AS (SELECT operation, value, sum(m) AS m FROM u GROUP BY ALL),
p AS (SELECT operation, value, (1 + sum(m) OVER (PARTITION BY operation ORDER BY value DESC)) / (1 + n) AS p FROM v JOIN n USING (operation))
SELECT line, operation, value, {R('p')} AS p FROM sess JOIN p USING (operation, value) WHERE line % 2 = 1""",
)
def tail_rank(spark, d):
    s = B.sess(spark, d)
    return Q.tail_ranks(s.where("line % 2 = 0"), s.where("line % 2 = 1").drop("instance"), "operation", "value").select("line", "operation", "value", "p")


@query(
    "w22_spaced_sample",
    f"""WITH {B.REQ}, r AS (SELECT stream, span, row_number() OVER (PARTITION BY stream ORDER BY span) - 1 AS i, count(*) OVER (PARTITION BY stream) AS n FROM req)
SELECT stream, span FROM r WHERE i IN (0, floor((n - 1) / 4.0), floor(2 * (n - 1) / 4.0), floor(3 * (n - 1) / 4.0), n - 1)""",
)
def spaced_sample(spark, d):
    return Q.spaced_sample(B.req(spark, d).select("stream", "span"), ["stream"], ["span"], 5)


@query("w23_latest_history", f"WITH {B.REQ} SELECT stream, span, rank FROM (SELECT stream, span, CAST(row_number() OVER (PARTITION BY stream ORDER BY end_s DESC, span DESC) AS INT) AS rank FROM req) WHERE rank <= 100")
def latest_history(spark, d):
    return Q.top_k(B.req(spark, d), ["stream"], [F.col("end_s").desc(), F.col("span").desc()], 100).select("stream", "span", "rank")


@query(
    "m12_context_features",
    f"""WITH {B.WIN} SELECT service, "window", requests, max_active, {R('ln(1 + p95)')} AS p95_log, {R('ln(1 + error_fraction)')} AS error_fraction_log, {R('ln(1 + rps)')} AS rps_log,
  {R('avg(ln(1 + p95)) OVER w')} AS p95_mean, {R('max(ln(1 + p95)) OVER w')} AS p95_max, {R('avg(ln(1 + error_fraction)) OVER w')} AS error_fraction_mean, {R('max(ln(1 + error_fraction)) OVER w')} AS error_fraction_max,
  {R('avg(ln(1 + rps)) OVER w')} AS rps_mean, {R('max(ln(1 + rps)) OVER w')} AS rps_max FROM win WINDOW w AS (PARTITION BY "window")""",
)
def context_features(spark, d):
    return W.context_features(B.win(spark, d), ["window"], NUM)


_REASONS = f"""{B.WIN}, {_LIMITS}, scored AS (SELECT win.*, p95 > latency_limit AS slow, error_fraction > error_limit AS failing FROM win JOIN limits USING (service) WHERE "window" >= 15)"""


@query(
    "m17_operational_score",
    f"""WITH {_REASONS} SELECT service, "window", {R('p95')} AS p95, {R('error_fraction')} AS error_fraction, requests,
  array_to_string(list_concat(CASE WHEN slow THEN ['latency'] ELSE [] END, CASE WHEN failing THEN ['errors'] ELSE [] END), ',') AS reasons, slow OR failing AS alert FROM scored""",
)
def operational_score(spark, d):
    scored = C.operational_reasons(B.win(spark, d).where("window >= 15"), limits(spark, d))
    return scored.select("service", "window", "p95", "error_fraction", "requests", F.array_join("reasons", ",").alias("reasons"), "alert")


_EVIDENCE = """ev AS (SELECT service, "window", span, status, duration, CASE WHEN k % 3 = 0 THEN 'view' END AS dependency, CASE WHEN k % 3 = 0 THEN status END AS dependency_status FROM (
  SELECT *, row_number() OVER (PARTITION BY service, "window" ORDER BY coalesce(status >= 400, false) DESC, duration DESC, span) AS i FROM req) WHERE i <= 3)"""


def with_priority(spark, d):
    scored = C.operational_reasons(B.win(spark, d).where("window >= 15"), limits(spark, d))
    evidence = C.top_evidence(with_dependency(B.req(spark, d).where("window >= 15")), ["service", "window"])
    return C.priorities(scored.join(evidence, ["service", "window"], "left"))


_RANKED = f"""{_REASONS}, {_EVIDENCE}, a AS (SELECT "window", list(service) FILTER (slow OR failing) AS alerting FROM scored GROUP BY ALL),
e AS (SELECT service, "window", bool_or(coalesce(status >= 400, false) AND dependency IS NULL) AS own, list(dependency) FILTER (dependency IS NOT NULL) AS deps FROM ev GROUP BY ALL),
b AS (SELECT s.service, s."window", p95, slow OR failing AS alert, CASE WHEN own THEN 3 WHEN slow OR failing THEN 1 ELSE 0 END AS base, slow OR failing AND NOT coalesce(list_has_any(deps, alerting), false) AS r0,
  (slow OR failing) AND NOT coalesce(list_has_any(deps, alerting), false) AS root FROM scored s JOIN a USING ("window") LEFT JOIN e ON e.service = s.service AND e."window" = s."window"),
prioritised AS (SELECT service, "window", p95, CASE WHEN root THEN greatest(base, 3) ELSE base END AS priority FROM b)"""


@query("m17_priority_ranking", f"WITH {_RANKED} SELECT service, \"window\", priority, CAST(row_number() OVER (PARTITION BY \"window\" ORDER BY priority DESC, p95 DESC, service) AS INT) AS rank FROM prioritised")
def priority_ranking(spark, d):
    return C.ranked_candidates(with_priority(spark, d)).select("service", "window", "priority", "rank")


@query(
    "j20_dependency_edges",
    f"""WITH {_REASONS}, {_EVIDENCE} SELECT e."window", e.service AS source, dependency AS target, dependency_status AS status, span, coalesce(s.slow OR s.failing, false) AS affected
FROM ev e JOIN scored z ON z.service = e.service AND z."window" = e."window" LEFT JOIN scored s ON s."window" = e."window" AND s.service = e.dependency AND (s.slow OR s.failing) WHERE dependency_status <> 200""",
)
def dependency_edges(spark, d):
    return C.dependency_edges(with_priority(spark, d)).select("window", "source", "target", "status", "span", "affected")


_COHORT = f"""{B.BUSY}, {B.SCHED}, co AS (SELECT busy.*, onset, recovery, CASE WHEN onset IS NULL OR until <= onset OR "window" >= recovery THEN 'healthy' WHEN "window" >= onset AND until <= recovery THEN 'fault' ELSE 'boundary' END AS cohort FROM busy LEFT JOIN sched USING (service))"""


def cohorts(spark, d):
    return E.cohort(B.busy(spark, d), B.schedule(spark))


@query("j12_interval_cohorts", f'WITH {_COHORT} SELECT service, "window", cohort FROM co')
def interval_cohorts(spark, d):
    return cohorts(spark, d).select("service", "window", "cohort")


@query("a22_false_alert_rate", f"WITH {_COHORT} SELECT count(*) AS healthy_windows, count(*) FILTER (warning) AS false_alerts, {R('count(*) FILTER (warning) / (count(*) * 24.0)')} AS per_hour FROM co WHERE cohort = 'healthy'")
def false_alert_rate(spark, d):
    return E.false_alert_rate(cohorts(spark, d), "warning", 86400)


@query(
    "m24_trial_evaluation",
    f"""WITH {_COHORT} SELECT service, {R("count(*) FILTER (cohort = 'fault' AND warning) / count(*) FILTER (cohort = 'fault')")} AS recall,
  max(CAST(cohort = 'fault' AND warning AS INT)) AS detected, min(until) FILTER (cohort = 'fault' AND warning) - any_value(onset) AS delay,
  {R("count(*) FILTER (cohort = 'healthy' AND warning) / (count(*) FILTER (cohort = 'healthy') * 24.0)")} AS false_per_hour FROM co WHERE onset IS NOT NULL GROUP BY service""",
)
def trial_evaluation(spark, d):
    return E.trial(cohorts(spark, d), "warning", 86400)


@query(
    "m25_incident_evaluation",
    f"""WITH {_EPISODES}, {B.SCHED} SELECT service, count(*) FILTER (opened_at BETWEEN onset AND recovery) AS for_fault,
  count(*) FILTER (opened_at IS NOT NULL AND NOT opened_at BETWEEN onset AND recovery) AS false_openings, CAST(30 - any_value(recovery - onset) AS INT) AS exposure FROM sched LEFT JOIN episodes USING (service) GROUP BY service""",
)
def incident_evaluation(spark, d):
    return E.incident_outcome(incident_episodes(spark, d), B.schedule(spark), B.DAYS)


@query(
    "a29_fault_impact",
    f"""WITH {B.REQ}, {B.SCHED}, f AS (SELECT req.*, "window" >= onset AND "window" < recovery AS hit FROM req JOIN sched USING (service))
SELECT service, count(*) FILTER (hit AND status >= 400) AS impacted, min(span) FILTER (hit AND status >= 400) AS first_impact, {R('quantile_cont(duration, 0.5) FILTER (hit)')} AS median_duration,
  {R('quantile_cont(duration, 0.5) FILTER (NOT hit)')} AS normal_median, {R('avg(coalesce(CAST(status >= 400 AS INT), 0)) FILTER (hit)')} AS error_fraction, {R('avg(coalesce(CAST(status >= 400 AS INT), 0)) FILTER (NOT hit)')} AS normal_error_fraction FROM f GROUP BY service""",
)
def fault_impact(spark, d):
    """Each faulty service's requests during its fault against its normal ones."""
    r = B.req(spark, d).join(F.broadcast(B.schedule(spark)), "service").withColumn("hit", (F.col("window") >= F.col("onset")) & (F.col("window") < F.col("recovery")))
    bad = F.coalesce(F.col("status") >= 400, F.lit(False))
    per = with_quantiles(r, ["service", "hit"], [F.count_if(bad).alias("n"), F.min(F.when(bad, F.col("span"))).alias("first"), F.avg(bad.cast("double")).alias("share")], "duration", {"median": 0.5})
    of = lambda c, hit: F.max(F.when(F.col("hit") == hit, F.col(c)))
    return per.groupBy("service").agg(F.coalesce(of("n", True), F.lit(0)).alias("impacted"), of("first", True).alias("first_impact"), of("median", True).alias("median_duration"), of("median", False).alias("normal_median"), of("share", True).alias("error_fraction"), of("share", False).alias("normal_error_fraction"))


@query("a33_service_timeline", f"""WITH {B.WIN} SELECT "window", {', '.join(f"{R(f'max(p95) FILTER (service = {chr(39)}{s}{chr(39)})')} AS {s}" for s in ('click', 'error', 'purchase', 'signup', 'view'))} FROM win GROUP BY "window" """)
def service_timeline(spark, d):
    return B.win(spark, d).groupBy("window").pivot("service", ["click", "error", "purchase", "signup", "view"]).agg(F.first("p95"))


@query("a34_traffic_summary", f"WITH {B.REQ} SELECT CAST(coalesce(status, 0) AS INT) AS status, count(*) AS n, {R('count(*) / (30 * 86400.0)')} AS per_second FROM req GROUP BY 1")
def traffic_summary(spark, d):
    return B.req(spark, d).groupBy(F.coalesce("status", F.lit(0)).alias("status")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / (30 * 86400.0)).alias("per_second"))


@query(
    "a31_feature_evidence",
    f"""WITH {B.WIN}, {_CHANGE}, ch AS (SELECT service, "window", least(abs(p95 - c) / greatest(s, abs(c) * 0.05, 1e-6), 100) AS a, least(abs(error_fraction - ec) / greatest(es, abs(ec) * 0.05, 1e-6), 100) AS b FROM win JOIN w USING (service))
SELECT service, "window", CASE WHEN a >= b THEN 'p95' ELSE 'error_fraction' END AS feature, {R('greatest(a, b)')} AS change FROM ch""",
)
def feature_evidence(spark, d):
    c = causal_change(spark, d)
    pairs = F.array(*[F.struct((-F.col(f"{v}_change")).alias("k"), F.lit(i).alias("i"), F.lit(v).alias("feature")) for i, v in enumerate(("p95", "error_fraction"))])
    return c.withColumn("top", F.array_sort(pairs)[0]).select("service", "window", F.col("top.feature").alias("feature"), (-F.col("top.k")).alias("change"))


@query("a26_distribution_summary", f"WITH {B.WIN} SELECT service, {R('quantile_cont(p95, 0.5)')} AS p50, {R('quantile_cont(p95, 0.95)')} AS p95, {R('max(p95)')} AS largest, count(*) FILTER (p95 > 150) AS over FROM win GROUP BY service")
def distribution_summary(spark, d):
    return E.distribution(B.win(spark, d).select("service", F.col("p95").alias("v")), ["service"], "v", 150)


@query(
    "m19_input_shift",
    f"""WITH {B.WIN}, b AS (SELECT quantile_cont(p95, 0.001) AS a, quantile_cont(p95, 0.999) AS z, quantile_cont(error_fraction, 0.001) AS ea, quantile_cont(error_fraction, 0.999) AS ez FROM win WHERE "window" < 15)
SELECT service, "window", {R('(CAST(p95 < a OR p95 > z AS INT) + CAST(error_fraction < ea OR error_fraction > ez AS INT)) / 2')} AS shift FROM win, b WHERE "window" >= 15""",
)
def input_shift(spark, d):
    w = B.win(spark, d)
    values = ["p95", "error_fraction"]
    return E.shift_score(w.where("window >= 15"), E.shift_bounds(w.where("window < 15"), values), values).select("service", "window", "shift")


@query(
    "m18_rule_status",
    f"""WITH {B.WIN}, f AS (SELECT "window", count(DISTINCT service) AS services, max(p95) FILTER (service = 'purchase') AS p, max(error_fraction) FILTER (service = 'error') AS e, max(error_fraction) FILTER (service = 'view') AS v FROM win GROUP BY ALL)
SELECT "window", CASE WHEN services < 5 THEN 'insufficient' WHEN e > 0.12 OR v > 0.12 OR p > 170 THEN 'anomaly' ELSE 'normal' END AS status,
  CASE WHEN e > 0.12 THEN 'error' WHEN v > 0.12 THEN 'view' WHEN p > 170 THEN 'purchase' ELSE 'none' END AS cause FROM f""",
)
def rule_status(spark, d):
    of = lambda s, v: F.max(F.when(F.col("service") == s, F.col(v)))
    f = B.win(spark, d).groupBy("window").agg(F.count_distinct("service").alias("services"), of("purchase", "p95").alias("p"), of("error", "error_fraction").alias("e"), of("view", "error_fraction").alias("v"))
    flags = {"error": F.col("e") > 0.12, "view": F.col("v") > 0.12, "slow": F.col("p") > 170}
    cause = C.rule_diagnosis(flags, [("error", "error"), ("view", "view"), ("slow", "purchase")])
    status = F.when(F.col("services") < 5, "insufficient").when(cause != "none", "anomaly").otherwise("normal")
    return f.select("window", status.alias("status"), cause.alias("cause"))


@query("f15_unusual_status", f"WITH {B.REQ} SELECT span, coalesce(status <> 0 AND (status < 200 OR status >= 400), false) AS unusual FROM req")
def unusual(spark, d):
    return B.req(spark, d).select("span", unusual_status(F.col("status")).alias("unusual"))


_DIAGNOSES = f"""{B.REQ}, {B.SCHED}, dx AS (SELECT service, CASE WHEN k % 2 = 0 THEN 'logs' ELSE 'hybrid' END AS mode, "window" AS "start", "window" + 1 AS "end", onset, recovery, k % 10 <> 1 AS valid, k % 7 <> 2 AS accepted,
  CASE WHEN k % 5 = 0 THEN 'abstain' WHEN k % 3 = 0 THEN 'review' ELSE 'clear' END AS verdict, CASE WHEN k % 4 = 0 THEN 'view' ELSE service END AS suspect, duration AS latency_ms, 100 + k AS input_tokens, k AS output_tokens
  FROM req LEFT JOIN sched USING (service))"""
_HEALTHY, _FAULTY = '(onset IS NULL OR "end" <= onset OR "start" >= recovery)', '("start" >= onset AND "end" <= recovery)'


@query(
    "a27_diagnosis_quality",
    f"""WITH {_DIAGNOSES} SELECT service, mode, count(*) AS windows, {R("avg(CAST(valid AS INT))")} AS valid, {R("avg(CAST(accepted AS INT))")} AS accepted, {R("avg(CAST(verdict = 'abstain' AS INT))")} AS abstained,
  {R(f"avg(CAST(verdict = 'review' AS INT)) FILTER ({_HEALTHY})")} AS healthy_review, {R(f"avg(CAST(verdict = 'review' AS INT)) FILTER ({_FAULTY})")} AS fault_review,
  {R(f"avg(CAST(verdict = 'review' AND suspect = service AS INT)) FILTER ({_FAULTY})")} AS right_suspect, {R("quantile_cont(latency_ms, 0.95)")} AS latency_p95,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM dx GROUP BY service, mode""",
)
def diagnosis_quality(spark, d):
    k = F.col("k")
    r = B.req(spark, d).join(F.broadcast(B.schedule(spark)), "service", "left")
    dx = r.select(
        "service",
        F.when(k % 2 == 0, "logs").otherwise("hybrid").alias("mode"),
        F.col("window").alias("start"),
        (F.col("window") + 1).alias("end"),
        "onset",
        "recovery",
        F.col("service").alias("target"),
        (k % 10 != 1).alias("valid"),
        (k % 7 != 2).alias("accepted"),
        F.when(k % 5 == 0, "abstain").when(k % 3 == 0, "review").otherwise("clear").alias("verdict"),
        F.when(k % 4 == 0, "view").otherwise(F.col("service")).alias("suspect"),
        F.col("duration").alias("latency_ms"),
        (100 + k).alias("input_tokens"),
        k.alias("output_tokens"),
    )
    return E.diagnosis_quality(dx, ["service", "mode"])


@query(
    "a28_snapshot_summary",
    f"""WITH {B.REQ}, pods AS (SELECT CAST(floor(end_s / 3600) AS BIGINT) AS snapshot, service, stream AS uid, k % 6 AS restarts FROM req), t AS (SELECT count(DISTINCT snapshot) AS n FROM pods),
e AS (SELECT unnest(['click', 'error', 'view', 'cart']) AS service)
SELECT service, count(DISTINCT uid) AS instances, any_value(n) - count(DISTINCT snapshot) AS missing, coalesce(max(restarts), 0) AS restarts FROM e LEFT JOIN pods USING (service), t GROUP BY service""",
)
def snapshot_summary(spark, d):
    """Hours as snapshots of the streams that were active; one expected service never is."""
    pods = B.req(spark, d).select(F.floor(F.col("end_s") / 3600).alias("snapshot"), "service", F.col("stream").alias("uid"), (F.col("k") % 6).alias("restarts"))
    return E.instance_summary(pods, "snapshot", ["click", "error", "view", "cart"])


@query(
    "a32_coverage_summary",
    f"""WITH {_SEEN}, c AS (SELECT *, avg(CAST(seen AS INT)) OVER (PARTITION BY "window") AS coverage FROM seen),
f AS (SELECT *, coverage < 0.87 AS insufficient FROM c), g AS (SELECT *, sum(CAST(seen OR insufficient AS INT)) OVER (PARTITION BY service ORDER BY "window") AS j FROM f),
h AS (SELECT service, "window", insufficient, sum(CAST(NOT seen AND NOT insufficient AS INT)) OVER (PARTITION BY service, j ORDER BY "window") >= 2 AS issue, "window" // 10 AS run FROM g),
w AS (SELECT run, "window", bool_or(issue) AS w, bool_or(insufficient) AS i FROM h GROUP BY ALL),
a AS (SELECT run, count(*) FILTER (w) AS warning_windows, count(*) FILTER (i) AS insufficient_windows FROM w GROUP BY ROLLUP (run)), s AS (SELECT run, count(DISTINCT service) AS warned_services FROM h WHERE issue GROUP BY ROLLUP (run))
SELECT a.run, warning_windows, insufficient_windows, coalesce(warned_services, 0) AS warned_services FROM a LEFT JOIN s ON a.run IS NOT DISTINCT FROM s.run""",
)
def coverage_summary(spark, d):
    s = seen(spark, d)
    guard = Q.coverage_guard(s, s.select("service").distinct().withColumn("threshold", F.lit(2)), required=0.87)
    return E.coverage_summary(guard.withColumn("run", F.floor(F.col("window") / 10)), "run")


# Faults of any number, overlapping and of any length, from a table: the orders of each month open one for a service.
_FAULTS = """faults AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][1 + o_custkey % 5] AS service, o_orderkey AS fault, 1704067200 + (o_orderkey * 7919) % 2592000 AS onset, 1704067200 + (o_orderkey * 7919) % 2592000 + 60 * (1 + o_custkey % 97) AS recovery FROM orders)"""


@query("j12_interval_join", f"WITH {B.REQ}, {_FAULTS} SELECT fault, service, count(span) AS requests, min(span) AS first FROM faults JOIN req USING (service) WHERE end_s >= onset AND end_s < recovery GROUP BY ALL")
def interval_join_query(spark, d):
    """Requests inside many overlapping intervals of their service."""
    key = F.element_at(F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")]), 1 + F.col("o_custkey").cast("int") % 5)
    onset = 1704067200 + (F.col("o_orderkey") * 7919) % 2592000
    faults = B.table(spark, d, "orders").select(key.alias("service"), F.col("o_orderkey").alias("fault"), onset.alias("onset"), (onset + 60 * (1 + F.col("o_custkey") % 97)).alias("recovery"))
    met = interval_counts(B.req(spark, d).select("service", "span", "end_s"), faults, ["service"], ["fault"], "end_s", "onset", "recovery", 3600.0, "span")
    return met.select("fault", "service", F.col("n").alias("requests"), F.col("least").alias("first"))


@query(
    "m19_shift_guardrail",
    f"""WITH {B.WIN}, b AS (SELECT quantile_cont(p95, 0.05) AS a, quantile_cont(p95, 0.95) AS z, quantile_cont(error_fraction, 0.05) AS ea, quantile_cont(error_fraction, 0.95) AS ez FROM win WHERE "window" < 15),
s AS (SELECT service, "window", (CAST(p95 < a OR p95 > z AS INT) + CAST(error_fraction < ea OR error_fraction > ez AS INT)) / 2 AS shift FROM win, b), m AS (SELECT "window", max(shift) AS shift FROM s GROUP BY 1),
c AS (SELECT quantile_disc(shift, 0.9) AS cutoff, (SELECT list(shift ORDER BY shift)[CAST(ceil(0.9 * (count(*) - 1)) AS INT) + 1] FROM m WHERE "window" < 15) AS higher FROM m WHERE "window" < 15)
SELECT "window", {R('shift')} AS shift, {R('higher')} AS cutoff, shift > higher AS flagged FROM m, c WHERE "window" >= 15""",
)
def shift_guardrail(spark, d):
    """A window's largest share of features outside their range, against the higher quantile of healthy windows' largest."""
    w, values = B.win(spark, d), ["p95", "error_fraction"]
    bounds = E.shift_bounds(w.where("window < 15"), values, 0.05, 0.95)
    most = E.shift_score(w, bounds, values).groupBy("window").agg(F.max("shift").alias("shift"))
    return E.guardrail(most.where("window < 15"), most.where("window >= 15"), "shift", 0.9)


_FOUR = ["p95", "error_fraction", "max_active", "requests"]
_REFERENCE = "ref AS (SELECT service, " + ", ".join(f"quantile_cont({v}, 0.5) AS c{i}, stddev_pop({v}) AS s{i}" for i, v in enumerate(_FOUR)) + ' FROM win WHERE "window" < 5 GROUP BY service)'
_CHANGES = ", ".join(f"{{'feature': '{v}', 'i': {i}, 'change': least(abs({v} - c{i}) / greatest(s{i}, abs(c{i}) * 0.05, 1e-6), 100)}}" for i, v in enumerate(_FOUR))


@query(
    "a31_top_changes",
    f"""WITH {B.WIN}, {_REFERENCE}, x AS (SELECT service, "window", unnest([{_CHANGES}]) AS f FROM win JOIN ref USING (service)),
r AS (SELECT service, "window", f, row_number() OVER (PARTITION BY service, "window" ORDER BY round(f.change, 9) DESC, f.i) AS place FROM x)
SELECT service, "window", CAST(place AS INT) AS place, f.feature AS feature, {R('f.change')} AS change FROM r WHERE place <= 3""",
)
def top_changes(spark, d):
    """The three most changed features of each candidate, of equal ones the first."""
    c = W.causal_change(B.win(spark, d), ["service"], "window", _FOUR)
    pairs = F.array(*[F.struct((-F.round(f"{v}_change", 9)).alias("k"), F.lit(i).alias("i"), F.lit(v).alias("feature"), F.col(f"{v}_change").alias("change")) for i, v in enumerate(_FOUR)])
    top = c.select("service", "window", F.posexplode(F.slice(F.array_sort(pairs), 1, 3)).alias("place", "f"))
    return top.select("service", "window", (F.col("place") + 1).alias("place"), "f.feature", "f.change")


@query(
    "m24_trial_match",
    f"""WITH {B.BUSY}, {B.SCHED}, hits AS (SELECT s.service AS target, onset, until, b.service, p95 / base AS strength FROM sched s JOIN busy b ON b.warning AND b."window" >= onset AND b."window" < recovery),
f AS (SELECT target, onset, until AS first_at, service AS named FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY until, strength DESC, service) AS i FROM hits) WHERE i = 1)
SELECT s.service, first_at - f.onset AS delay, named, coalesce(named = s.service, false) AS matched FROM sched s LEFT JOIN f ON f.target = s.service""",
)
def trial_match(spark, d):
    """Each trial's first alert of any service, the strongest of that window, and whether it names the faulty service."""
    return E.trial_match(B.busy(spark, d), B.schedule(spark), F.col("p95") / F.col("base"))


@query(
    "m30_replicated_masks",
    f"""WITH {_COHORT}, t AS (SELECT service, "window", CAST(cohort = 'fault' AS INT) AS truth FROM co WHERE cohort IN ('fault', 'healthy')), n AS (SELECT truth, count(*) AS n, sum(count(*)) OVER () AS total FROM t GROUP BY truth),
r AS (SELECT t.*, replica, CASE WHEN replica = 0 THEN 0 ELSE CAST('0x' || substr(sha256(service || ':' || "window" || ':' || replica), 1, 6) AS BIGINT) % 7 END AS m FROM t, (SELECT unnest([0, 1, 2]) AS replica))
SELECT service, "window", CAST(replica AS INT) AS replica, truth, (m & 1) > 0 AS no_metrics, (m & 2) > 0 AS no_logs, (m & 4) > 0 AS no_traces, {R('total / (2.0 * n)')} AS weight FROM r JOIN n USING (truth)""",
)
def replicated_masks(spark, d):
    """Training rows as they are and twice with hidden modalities, never all three, weighted so that classes count alike."""
    rows = cohorts(spark, d).where("cohort IN ('fault', 'healthy')").select("service", "window", (F.col("cohort") == "fault").cast("int").alias("truth"))
    return S.dropout_replicas(S.class_weights(rows, "truth"), ["service", "window"], ["metrics", "logs", "traces"], 2)


# Each user is a system of its own with the five services and a window a day, so many service-windows are idle.
_SYSTEMS = f"""{B.REQ}, cells AS (SELECT stream, "window", service, quantile_cont(duration, 0.95) AS p95, avg(coalesce(CAST(status >= 400 AS INT), 0)) AS error_fraction, count(*) AS requests FROM req GROUP BY ALL),
names AS (SELECT DISTINCT service FROM req), lim AS (SELECT service, quantile_cont(p95, 0.5) AS center, quantile_cont(p95, 0.9) AS latency_limit, quantile_cont(error_fraction, 0.9) AS error_limit FROM cells WHERE "window" < 15 GROUP BY service),
lims AS (SELECT lim.*, greatest(quantile_cont(abs(p95 - center), 0.5), 1.0) AS scale FROM cells JOIN lim USING (service) WHERE "window" < 15 GROUP BY ALL),
dense AS (SELECT s.stream * 30 + w."window" AS cell, s.stream, w."window", n.service, p95, error_fraction, coalesce(requests, 0) AS requests FROM (SELECT DISTINCT stream FROM req) s CROSS JOIN (SELECT unnest(range(15, 30)) AS "window") w CROSS JOIN names n LEFT JOIN cells c ON c.stream = s.stream AND c."window" = w."window" AND c.service = n.service),
scored AS (SELECT dense.*, requests = 0 AS idle, coalesce(p95 > latency_limit, false) AS slow, coalesce(error_fraction > error_limit, false) AS failing, CASE WHEN requests > 0 THEN abs(p95 - center) / scale END AS score FROM dense JOIN lims USING (service)),
ev AS (SELECT stream, "window", service, status, CASE WHEN k % 3 = 0 THEN 'view' END AS dependency FROM (SELECT *, row_number() OVER (PARTITION BY stream, "window", service ORDER BY coalesce(status >= 400, false) DESC, duration DESC, span) AS i FROM req) WHERE i <= 3),
e AS (SELECT stream, "window", service, bool_or(coalesce(status >= 400, false) AND dependency IS NULL) AS own, list(DISTINCT dependency) FILTER (dependency IS NOT NULL) AS deps FROM ev GROUP BY ALL),
al AS (SELECT cell, list(service) AS alerting FROM scored WHERE idle OR slow OR failing GROUP BY cell),
base AS (SELECT s.*, idle OR slow OR failing AS alert, CASE WHEN own THEN 3 WHEN idle THEN 2 WHEN slow OR failing THEN 1 ELSE 0 END AS b, coalesce(list_has_any(deps, alerting), false) AS upstream FROM scored s LEFT JOIN al USING (cell) LEFT JOIN e ON e.stream = s.stream AND e."window" = s."window" AND e.service = s.service),
ranked AS (SELECT *, CASE WHEN alert AND NOT upstream THEN greatest(b, 3) ELSE b END AS priority FROM base)"""


def dense_priorities(spark, d):
    """Every service of every system and day with its limits' reasons, a score where it has requests, and its priority."""
    r = B.req(spark, d)
    at = F.col("stream") * 30 + F.col("window")
    keys = ["stream", "window", "service"]
    cells = W.request_windows(r, 86400.0, keys).select(*keys, "p95", "error_fraction", "requests")
    healthy = cells.where("window < 15")
    limits = healthy.groupBy("service").agg(F.percentile("p95", F.lit(0.9)).alias("latency_limit"), F.percentile("error_fraction", F.lit(0.9)).alias("error_limit"))
    limits = limits.join(W.mad_reference(healthy, ["service"], ["p95"], [1.0]), "service")  # a row a service
    grid = W.spine(r.select("stream").distinct().join(F.broadcast(r.select("service").distinct())), 15, B.DAYS - 1)
    scored = C.operational_reasons(W.dense(cells, grid, keys, ["requests"]), limits).withColumn("score", F.when(F.col("requests") > 0, F.abs(F.col("p95") - F.col("p95_center")) / F.col("p95_scale")))
    evidence = C.top_evidence(with_dependency(r.where("window >= 15")), keys)
    return C.priorities(scored.join(evidence, keys, "left").withColumn("at", at), "at")


@query(
    "m17_dense_ranking",
    f"""WITH {_SYSTEMS} SELECT stream, "window", service, requests, array_to_string(list_filter([CASE WHEN idle THEN 'no requests' END, CASE WHEN slow THEN 'latency' END, CASE WHEN failing THEN 'errors' END], lambda x: x IS NOT NULL), ',') AS reasons,
  {R('score')} AS score, priority, CAST(row_number() OVER (PARTITION BY cell ORDER BY priority DESC, p95 DESC NULLS LAST, service) AS INT) AS rank FROM ranked""",
)
def dense_ranking(spark, d):
    """Failures of a service's own come first with idle services, which nothing seen blames on others; then those over a
    limit that call such a one, and the rest."""
    ranked = C.ranked_candidates(dense_priorities(spark, d), "at")
    return ranked.select("stream", "window", "service", "requests", F.array_join("reasons", ",").alias("reasons"), "score", "priority", "rank")


# Metrics from every eleventh request, logs from failures, spans from those that know their status.
_MODALITIES = f"""{B.REQ}, o AS (SELECT stream, "window", service, count(*) FILTER (k % 11 = 0) AS metrics, count(*) FILTER (status >= 400) AS logs, count(status) AS traces FROM req GROUP BY ALL),
w AS (SELECT stream, "window", bool_or(metrics > 0) AS m, bool_or(logs > 0) AS l, bool_or(traces > 0) AS t FROM o GROUP BY ALL)"""


@query(
    "a17_modality_windows",
    f"""WITH {_MODALITIES} SELECT 'window' AS level, CAST(NULL AS VARCHAR) AS service, count(*) AS rows, count(*) FILTER (m) AS metrics, count(*) FILTER (l) AS logs, count(*) FILTER (t) AS traces FROM w
UNION ALL SELECT 'service', service, count(*), CAST(sum(metrics) AS BIGINT), CAST(sum(logs) AS BIGINT), CAST(sum(traces) AS BIGINT) FROM o GROUP BY service""",
)
def modality_windows(spark, d):
    """In how many windows each source is seen at any service, and how many observations each service has of it."""
    r, keys = B.req(spark, d), ["stream", "window", "service"]
    sources = {"metrics": r.where("k % 11 = 0"), "logs": r.where("status >= 400"), "traces": r.where("status IS NOT NULL")}
    return E.source_coverage(r.select(*keys), sources, keys, ["stream", "window"])
