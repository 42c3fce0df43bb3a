"""Queries of sources, contracts, joins, audits and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import scoring as C
from ..operators import sequence as Q
from ..operators import windows as W
from ..sources import files
from ..streaming.jobs import new_folder
from . import bindings as B
from .registry import query

R = "round({}, 6)".format


@query("s11_index_audit", "SELECT o_orderstatus AS kind, count(*) AS listed, count(*) FILTER (o_orderkey % 997 <> 0) AS counted FROM orders GROUP BY 1 HAVING count(*) <> count(*) FILTER (o_orderkey % 997 <> 0)")
def index_audit(spark, d):
    o = B.table(spark, d, "orders").withColumnRenamed("o_orderstatus", "kind")
    count = lambda x: x.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return files.index_audit(count(o), count(o.where("o_orderkey % 997 <> 0")), ["kind"])


@query("s12_suite_totals", f"WITH {B.MSG} SELECT service, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars, count(*) FILTER (message IS NULL) AS missing FROM msg GROUP BY service")
def suite_totals(spark, d):
    return B.msg(spark, d).groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).cast("long").alias("chars"), F.count_if(F.col("message").isNull()).alias("missing"))


@query(
    "s15_metric_audit",
    f"WITH {B.REQ} SELECT service, count(*) AS n, count(DISTINCT stream) AS names, count(*) FILTER (isnan(duration) OR isinf(duration)) AS nonfinite, {R('min(end_s)')} AS first, {R('max(end_s)')} AS last, count(DISTINCT end_s) AS times FROM req GROUP BY service",
)
def metric_audit(spark, d):
    return B.req(spark, d).groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("stream").alias("names"), F.count_if(S.finite(F.col("duration")).isNull()).alias("nonfinite"), F.min("end_s").alias("first"), F.max("end_s").alias("last"), F.count_distinct("end_s").alias("times"))


_FORMS = "CASE WHEN regexp_matches(text, '^[0-9+]') THEN 'numeric' WHEN regexp_matches(text, '\\|') THEN 'table' WHEN regexp_matches(text, '^[A-Z]{2}') THEN 'upper' ELSE 'prose' END"


@query("s16_log_form_audit", f"SELECT source, {_FORMS} AS form, count(*) AS n FROM documents GROUP BY ALL")
def log_form_audit(spark, d):
    t = F.col("text")
    form = F.when(t.rlike("^[0-9+]"), "numeric").when(t.rlike(r"\|"), "table").when(t.rlike("^[A-Z]{2}"), "upper").otherwise("prose")
    return B.table(spark, d, "documents").groupBy("source", form.alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query("s17_trace_audit", f"WITH {B.CHILD} SELECT service, count(*) AS spans, count(*) FILTER (month < '1997-01-01' OR month >= '2001-01-01') AS outside, count(*) FILTER (status >= 400) AS errors, count(status) AS known, min(month) AS first, max(month) AS last FROM child GROUP BY service")
def trace_audit(spark, d):
    outside = (F.col("month") < "1997-01-01") | (F.col("month") >= "2001-01-01")
    return B.child(spark, d).groupBy("service").agg(F.count(F.lit(1)).alias("spans"), F.count_if(outside).alias("outside"), F.count_if(F.col("status") >= 400).alias("errors"), F.count("status").alias("known"), F.min("month").alias("first"), F.max("month").alias("last"))


@query(
    "s18_grid_integrity",
    f"""WITH {B.WIN}, g AS (SELECT service, "window", "window" - lag("window") OVER (PARTITION BY service ORDER BY "window") AS step FROM win)
SELECT service, count(*) AS windows, count(*) FILTER (step <> 1) AS broken, count(*) = 30 AS complete FROM g GROUP BY service""",
)
def grid_integrity(spark, d):
    step = F.col("window") - F.lag("window").over(Window.partitionBy("service").orderBy("window"))
    return B.win(spark, d).withColumn("step", step).groupBy("service").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("step") != 1).alias("broken"), (F.count(F.lit(1)) == 30).alias("complete"))


@query("p05_metric_whitelist", f"WITH {B.REQ} SELECT count(*) AS rows, count(*) FILTER (service IN ('click', 'view', 'purchase')) AS kept, count(*) FILTER (service NOT IN ('click', 'view', 'purchase')) AS excluded FROM req")
def metric_whitelist(spark, d):
    kept = F.col("service").isin("click", "view", "purchase")
    return B.req(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("excluded"))


@query("p06_marker_filter", f"WITH {B.MSG} SELECT service, count(*) AS kept FROM msg WHERE NOT regexp_matches(message, '\\bchaos(?:blade|mesh|_|\\b)|fault[_ -]injection', 'i') GROUP BY service")
def marker_filter(spark, d):
    return B.msg(spark, d).where(~T.is_instrumentation(F.col("message"))).groupBy("service").agg(F.count(F.lit(1)).alias("kept"))


@query("p07_in_window_filter", f"WITH {B.REQ} SELECT service, count(*) FILTER (\"window\" BETWEEN 0 AND 24) AS inside, count(*) FILTER (NOT \"window\" BETWEEN 0 AND 24) AS outside FROM req GROUP BY service")
def in_window_filter(spark, d):
    inside = F.col("window").between(0, 24)
    return B.req(spark, d).groupBy("service").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@query("p08_complete_bounds", f"WITH {B.REQ} SELECT service, CAST(ceil(min(end_s) / 3600) * 3600 AS BIGINT) AS first, CAST(floor(max(end_s) / 3600) * 3600 AS BIGINT) AS last FROM req GROUP BY service")
def complete_bounds(spark, d):
    return W.complete_bounds(B.req(spark, d), "end_s", 3600, ["service"])


@query(
    "p09_eligibility",
    f"""WITH {B.REQ}, c AS (SELECT stream, count(*) FILTER (status IS NULL OR status < 400) AS normal, count(*) FILTER (status >= 400) AS faulty FROM req GROUP BY stream)
SELECT stream, CASE WHEN normal < 50 THEN 'few normal' WHEN faulty < 5 THEN 'few faulty' ELSE 'eligible' END AS reason FROM c""",
)
def eligibility(spark, d):
    bad = F.coalesce(F.col("status") >= 400, F.lit(False))
    c = B.req(spark, d).groupBy("stream").agg(F.count_if(~bad).alias("normal"), F.count_if(bad).alias("faulty"))
    return c.select("stream", F.coalesce(C.reject_reason([(F.col("normal") < 50, "few normal"), (F.col("faulty") < 5, "few faulty")]), F.lit("eligible")).alias("reason"))


@query(
    "p10_straddling_exclusion",
    f"""WITH {B.BUSY}, {B.SCHED} SELECT service, "window" FROM busy LEFT JOIN sched USING (service) WHERE onset IS NULL OR NOT ("window" - 1 < onset AND onset < until)""",
)
def straddling_exclusion(spark, d):
    j = B.busy(spark, d).join(F.broadcast(B.schedule(spark)), "service", "left")
    return j.where("onset IS NULL OR NOT (window - 1 < onset AND onset < until)").select("service", "window")


@query("p11_availability_mask", f"WITH {B.REQ}, a AS (SELECT service, \"window\", count(status) > 0 AS known, max(duration) > 300 AS slow FROM req GROUP BY ALL) SELECT service, count(*) FILTER (known OR slow) AS available FROM a GROUP BY service")
def availability_mask(spark, d):
    a = B.req(spark, d).groupBy("service", "window").agg((F.count("status") > 0).alias("known"), (F.max("duration") > 300).alias("slow"))
    return a.groupBy("service").agg(F.count_if(F.col("known") | F.col("slow")).alias("available"))


@query(
    "p12_unpivot_metrics",
    """WITH u AS (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity AS a_cpu, l_extendedprice AS a_mem, l_discount AS b_c_cpu, l_tax AS b_error FROM lineitem) ON a_cpu, a_mem, b_c_cpu, b_error INTO NAME name VALUE value)
SELECT regexp_extract(name, '^(.*)_([^_]*)$', 1) AS service, regexp_extract(name, '^(.*)_([^_]*)$', 2) AS kind, count(*) AS n, round(sum(value), 4) AS total FROM u WHERE name <> 'b_error' GROUP BY ALL""",
)
def unpivot_metrics(spark, d):
    wide = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a_cpu"), F.col("l_extendedprice").alias("a_mem"), F.col("l_discount").alias("b_c_cpu"), F.col("l_tax").alias("b_error"))
    long = W.unpivot_metrics(wide, ["l_orderkey", "l_linenumber"], ["cpu", "mem"])
    return long.groupBy("service", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("p13_prefault_selection", f"WITH {B.BUSY}, {B.SCHED} SELECT service, count(*) AS n FROM busy JOIN sched USING (service) WHERE until <= onset GROUP BY service")
def prefault_selection(spark, d):
    return B.busy(spark, d).join(F.broadcast(B.schedule(spark)), "service").where("until <= onset").groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query("p15_startup_exclusion", f"WITH {B.REQ}, s AS (SELECT stream, ceil((min(end_s) + 300) / 60) * 60 AS start FROM req GROUP BY stream) SELECT stream, count(*) AS kept FROM req JOIN s USING (stream) WHERE end_s >= start GROUP BY stream")
def startup_exclusion(spark, d):
    start = F.ceil((F.min("end_s").over(Window.partitionBy("stream")) + 300) / 60) * 60
    return B.req(spark, d).withColumn("start", start).where("end_s >= start").groupBy("stream").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "p16_evidence_rows",
    f"""WITH {B.REQ}, e AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY span) AS i, count(*) OVER (PARTITION BY service) AS total FROM req WHERE status >= 400 OR duration > 150)
SELECT service, span, total FROM e WHERE i <= 30""",
)
def evidence_rows(spark, d):
    rows = B.req(spark, d).where((F.col("status") >= 400) | (F.col("duration") > 150))
    # the limit is taken in each task before rows move, and totals are partial counts: a hot service sends 30 rows a task
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("service").orderBy("span"))).where("i <= 30").select("service", "span")
    return first.join(rows.groupBy("service").agg(F.count(F.lit(1)).alias("total")), "service")


@query(
    "p17_threshold_fallback",
    f"""WITH {B.WIN}, t AS (SELECT service, quantile_cont(p95, 0.995) AS t FROM win WHERE "window" < 15 AND service < 's' GROUP BY service)
SELECT service, {R('coalesce(t, (SELECT max(t) FROM t))')} AS threshold FROM (SELECT DISTINCT service FROM win) LEFT JOIN t USING (service)""",
)
def threshold_fallback(spark, d):
    w = B.win(spark, d)
    t = w.where("window < 15 AND service < 's'").groupBy("service").agg(F.percentile("p95", F.lit(0.995)).alias("t"))
    most = t.agg(F.max("t").alias("most"))
    return w.select("service").distinct().join(t, "service", "left").join(F.broadcast(most)).select("service", F.coalesce("t", "most").alias("threshold"))


@query("j01_labels_join", f"WITH {B.LAB} SELECT doc_id, truth, score, system FROM lab")
def labels_join(spark, d):
    return B.lab(spark, d).select("doc_id", "truth", "score", "system")


@query(
    "j02_modality_union",
    """WITH a AS (SELECT DISTINCT l_suppkey AS service FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT s_suppkey AS service FROM supplier), c AS (SELECT DISTINCT ps AS service FROM (SELECT o_custkey AS ps FROM orders))
SELECT service, max(CAST(m = 1 AS INT)) AS metrics_present, max(CAST(m = 2 AS INT)) AS logs_present, max(CAST(m = 3 AS INT)) AS traces_present
FROM (SELECT service, 1 AS m FROM a UNION ALL SELECT service, 2 FROM b UNION ALL SELECT service, 3 FROM c) GROUP BY service""",
)
def modality_union(spark, d):
    a = B.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("service")).distinct()
    b = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("service")).distinct()
    c = B.table(spark, d, "orders").select(F.col("o_custkey").alias("service")).distinct()
    return W.modality_union({"metrics": a, "logs": b, "traces": c}, ["service"])


@query(
    "j03_dense_spine",
    f"""WITH {B.REQ}, u AS (SELECT DISTINCT stream FROM req), d AS (SELECT unnest(range(0, 30)) AS "window"), n AS (SELECT stream, "window", count(*) AS n FROM req GROUP BY ALL)
SELECT u.stream, d."window", coalesce(n, 0) AS n FROM u CROSS JOIN d LEFT JOIN n ON n.stream = u.stream AND n."window" = d."window" """,
)
def dense_spine(spark, d):
    r = B.req(spark, d)
    n = r.groupBy("stream", "window").agg(F.count(F.lit(1)).alias("n"))
    return W.dense(n, W.spine(r.select("stream").distinct(), 0, 29), ["stream", "window"], ["n"])


@query(
    "j04_append_spans",
    f"""WITH {B.WIN}, f AS (SELECT service, "window", count(*) AS failures FROM req WHERE status = 503 GROUP BY ALL) SELECT service, "window", requests, coalesce(failures, 0) AS failures FROM win LEFT JOIN f USING (service, "window")""",
)
def append_spans(spark, d):
    f = B.req(spark, d).where("status = 503").groupBy("service", "window").agg(F.count(F.lit(1)).alias("failures"))
    return B.win(spark, d).join(f, ["service", "window"], "left").select("service", "window", "requests", F.coalesce("failures", F.lit(0)).alias("failures"))


@query(
    "j05_alias_resolution",
    """WITH t AS (SELECT DISTINCT 'src' || CAST(doc_id % 30 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN 'service' ELSE '' END AS name FROM documents), s AS (SELECT DISTINCT source AS name FROM documents)
SELECT name, CASE WHEN name LIKE '%service' AND regexp_replace(name, 'service$', '') IN (SELECT name FROM s) AND name NOT IN (SELECT name FROM s) THEN regexp_replace(name, 'service$', '') ELSE name END AS resolved FROM t""",
)
def alias_resolution(spark, d):
    docs = B.table(spark, d, "documents")
    names = docs.select(F.concat(F.lit("src"), (F.col("doc_id") % 30).cast("string"), F.when(F.col("doc_id") % 2 == 0, "service").otherwise("")).alias("name")).distinct()
    known = docs.select(F.col("source").alias("known")).distinct()
    short = names.withColumn("short", F.regexp_replace("name", "service$", ""))
    target = short.join(known, short["short"] == known["known"], "left").withColumnRenamed("known", "target")
    own = known.withColumnRenamed("known", "own")
    both = target.join(own, target["name"] == own["own"], "left")
    return both.select("name", F.when(F.col("name").endswith("service") & F.col("target").isNotNull() & F.col("own").isNull(), F.col("short")).otherwise(F.col("name")).alias("resolved"))


@query("j06_unmatched_services", "SELECT DISTINCT o_custkey AS service FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def unmatched_services(spark, d):
    c = B.table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("service"))
    return B.table(spark, d, "orders").select(F.col("o_custkey").alias("service")).distinct().join(c, "service", "left_anti")


@query(
    "j07_reference_lookup",
    f"""WITH {B.WIN}, r AS (SELECT service, quantile_cont(p95, 0.5) AS center FROM win WHERE "window" < 15 AND service <> 'view' GROUP BY service)
SELECT service, "window", {R('CASE WHEN center IS NULL THEN 0 ELSE p95 - center END')} AS excess, center IS NOT NULL AS available FROM win LEFT JOIN r USING (service) WHERE "window" >= 15""",
)
def reference_lookup(spark, d):
    w = B.win(spark, d)
    r = w.where("window < 15 AND service <> 'view'").groupBy("service").agg(F.percentile("p95", F.lit(0.5)).alias("center"))
    j = w.where("window >= 15").join(r, "service", "left")
    return j.select("service", "window", F.coalesce(F.col("p95") - F.col("center"), F.lit(0.0)).alias("excess"), F.col("center").isNotNull().alias("available"))


@query("j08_span_epoch_join", "SELECT l_orderkey, l_linenumber, CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def span_epoch_join(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.unix_timestamp("o_orderdate").alias("epoch"))
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query("j09_clock_offsets", "SELECT CAST(date_diff('day', o_orderdate, l_shipdate) // 30 AS BIGINT) AS offset, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1")
def clock_offsets(spark, d):
    j = B.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(B.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate >= o_orderdate")
    return j.groupBy(F.floor(F.datediff("l_shipdate", "o_orderdate") / 30).alias("offset")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j10_parent_links",
    f"""WITH {B.REQ}, p AS (SELECT a.service, b.span IS NOT NULL AS found, coalesce(b.stream = a.stream, false) AS same FROM (SELECT *, span // 2 AS parent FROM req WHERE span > 1) a LEFT JOIN (SELECT span, stream FROM req WHERE span % 10 <> 0) b ON b.span = a.parent)
SELECT service, count(*) AS spans, count(*) FILTER (NOT found) AS missing, count(*) FILTER (found AND NOT same) AS crossed FROM p GROUP BY service""",
)
def parent_links(spark, d):
    r = B.req(spark, d)
    parents = r.where("span % 10 <> 0").select(F.col("span").alias("parent"), F.col("stream").alias("parent_stream"))
    j = r.where("span > 1").withColumn("parent", F.floor(F.col("span") / 2)).join(parents, "parent", "left")
    found = F.col("parent_stream").isNotNull()
    return j.groupBy("service").agg(F.count(F.lit(1)).alias("spans"), F.count_if(~found).alias("missing"), F.count_if(found & (F.col("parent_stream") != F.col("stream"))).alias("crossed"))


@query(
    "j11_trace_completeness",
    f"WITH {B.CHILD}, t AS (SELECT trace, list_sort(list_distinct(list(service))) AS seen FROM child GROUP BY trace) SELECT trace, list_sort(list_filter(['AF', 'NO', 'RF'], lambda x: NOT list_contains(seen, x))) AS missing FROM t",
)
def trace_completeness(spark, d):
    expected = F.array(*[F.lit(x) for x in ("AF", "NO", "RF")])
    return B.child(spark, d).groupBy("trace").agg(F.collect_set("service").alias("seen")).select("trace", F.array_sort(F.array_except(expected, "seen")).alias("missing"))


@query("j13_bitemporal_read", f"WITH {B.REQ} SELECT service, count(*) AS n FROM req WHERE \"window\" BETWEEN 5 AND 9 AND end_s + k * 3600 <= 1704067200 + 10 * 86400 GROUP BY service")
def bitemporal_read(spark, d):
    return B.req(spark, d).where("window BETWEEN 5 AND 9 AND end_s + k * 3600 <= 1704067200 + 10 * 86400").groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query("j14_late_events", f"WITH {B.REQ} SELECT service, \"window\", count(*) FILTER (end_s + k * 3600 > 1704067200 + (\"window\" + 2) * 86400) AS late FROM req GROUP BY ALL")
def late_events(spark, d):
    return B.req(spark, d).groupBy("service", "window").agg(F.count_if(F.expr("end_s + k * 3600 > 1704067200 + (window + 2) * 86400")).alias("late"))


_TWICE = "x AS (SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey + CAST(o_orderkey % 2 AS BIGINT) FROM orders WHERE o_orderkey % 5 = 0)"


@query("j15_duplicate_conflicts", f"WITH {_TWICE} SELECT o_orderkey, count(*) AS n, CASE WHEN count(DISTINCT o_custkey) > 1 THEN 'conflict' ELSE 'duplicate' END AS kind FROM x GROUP BY 1 HAVING count(*) > 1")
def duplicate_conflicts(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    again = o.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("o_custkey"))
    return E.duplicates(o.unionByName(again), ["o_orderkey"], ["o_custkey"])


@query("j16_identity_leaks", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def identity_leaks(spark, d):
    o = B.table(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").select("o_custkey").distinct().join(o.where("o_orderkey % 2 = 1").select("o_custkey"), "o_custkey", "left_semi")


@query("j18_replay_equality", "WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders), b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 100 = 0 THEN 0.5 ELSE 0 END AS v FROM orders WHERE o_orderkey % 50 <> 1) SELECT count(*) AS compared, count(*) FILTER (a.v IS DISTINCT FROM b.v) AS mismatches, round(max(abs(a.v - b.v)), 6) AS max_difference FROM a FULL JOIN b USING (o_orderkey)")
def replay_equality(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    again = o.where("o_orderkey % 50 <> 1").withColumn("v", F.col("v") + F.when(F.col("o_orderkey") % 100 == 0, 0.5).otherwise(0.0))
    return E.replay_equality(o, again, ["o_orderkey"], "v")


@query(
    "j19_citation_resolution",
    f"""WITH {B.REQ}, c AS (SELECT stream, unnest([span, span, span + 1, span * 2]) AS cited FROM req), r AS (SELECT c.stream, cited, req.stream AS owner FROM c LEFT JOIN req ON req.span = cited)
SELECT stream, count(*) AS cited, count(*) - count(DISTINCT cited) AS duplicates, count(*) FILTER (owner IS NULL) AS unknown, count(*) FILTER (owner <> stream) AS unrelated FROM r GROUP BY stream""",
)
def citation_resolution(spark, d):
    r = B.req(spark, d)
    cited = r.select("stream", F.explode(F.array(F.col("span"), F.col("span"), F.col("span") + 1, F.col("span") * 2)).alias("cited"))
    times = cited.groupBy("stream", "cited").agg(F.count(F.lit(1)).alias("n"))  # one row a citation, however often it is made
    j = times.join(r.select(F.col("span").alias("cited"), F.col("stream").alias("owner")), "cited", "left")
    made = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return j.groupBy("stream").agg(F.sum("n").alias("cited"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"), made(F.col("owner").isNull()).alias("unknown"), made(F.col("owner") != F.col("stream")).alias("unrelated"))


@query("j21_label_identity", "SELECT count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (d.doc_id IS NULL) AS unknown FROM documents d FULL JOIN labels l USING (doc_id)")
def label_identity(spark, d):
    a = B.table(spark, d, "documents").select("doc_id", F.lit(1).alias("a"))
    j = a.join(B.table(spark, d, "labels").select("doc_id", F.lit(1).alias("b")), "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("b").isNull()).alias("unlabelled"), F.count_if(F.col("a").isNull()).alias("unknown"))


@query("j22_positive_containment", "SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src3')")
def positive_containment(spark, d):
    return B.table(spark, d, "labels").where("toxic = 1").select("doc_id").join(B.table(spark, d, "documents").where("source <> 'src3'").select("doc_id"), "doc_id", "left_anti")


@query(
    "j23_unique_prefix_match",
    """WITH s AS (SELECT DISTINCT source FROM documents), r AS (SELECT DISTINCT source || '_run' || CAST(doc_id % 2 AS VARCHAR) AS run FROM documents WHERE source <> 'src7')
SELECT source, count(run) AS matches, CASE WHEN count(run) = 1 THEN 'ok' ELSE 'error' END AS status FROM s LEFT JOIN r ON split_part(run, '_', 1) = source GROUP BY source""",
)
def unique_prefix_match(spark, d):
    docs = B.table(spark, d, "documents")
    runs = docs.where("source <> 'src7'").select(F.concat("source", F.lit("_run"), (F.col("doc_id") % 2).cast("string")).alias("run")).distinct().withColumn("source", F.substring_index("run", "_", 1))
    j = docs.select("source").distinct().join(runs, "source", "left").groupBy("source").agg(F.count("run").alias("matches"))
    return j.withColumn("status", F.when(F.col("matches") == 1, "ok").otherwise("error"))


_METRICS = f"count(*) FILTER (truth = 1 AND score > 3000) AS tp, count(*) FILTER (truth = 0 AND score > 3000) AS fp, count(*) FILTER (truth = 1 AND score <= 3000) AS fn, count(*) FILTER (truth = 0 AND score <= 3000) AS tn"
_RATES = f"CASE WHEN tp + fp > 0 THEN {R('tp / (tp + fp)')} ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN {R('tp / (tp + fn)')} ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN {R('2 * tp / (2 * tp + fp + fn)')} ELSE 0 END AS f1"


@query("a19_binary_metrics", f"WITH {B.LAB}, m AS (SELECT {_METRICS} FROM lab) SELECT *, {_RATES} FROM m")
def binary_metrics(spark, d):
    return E.binary_metrics(B.lab(spark, d), F.col("truth") == 1, F.col("score") > 3000)


@query("a23_grouped_report", f"WITH {B.LAB}, m AS (SELECT coalesce(system, 'all') AS system, {_METRICS} FROM lab GROUP BY GROUPING SETS ((), (system))) SELECT *, {_RATES} FROM m")
def grouped_report(spark, d):
    lab = B.lab(spark, d)
    each = lab.withColumn("system", F.explode(F.array(F.lit("all"), F.col("system"))))
    return E.binary_metrics(each, F.col("truth") == 1, F.col("score") > 3000, ["system"])


_STEPS = f"{B.LAB}, s AS (SELECT score, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth <> 1) AS neg FROM lab GROUP BY score), t AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)"


@query("a20_average_precision", f"WITH {_STEPS} SELECT {R('sum(tp / (tp + fp) * pos / p)')} AS average_precision FROM t")
def average_precision(spark, d):
    return E.average_precision(B.lab(spark, d), "score", "truth")


@query("a21_roc_auc", f"WITH {_STEPS} SELECT {R('sum((tp - pos / 2) * neg / (p * n))')} AS roc_auc FROM t")
def roc_auc(spark, d):
    return E.roc_auc(B.lab(spark, d), "score", "truth")


@query("a21_curves", f"WITH {_STEPS} SELECT score, {R('tp / p')} AS recall, {R('fp / n')} AS fall_out, {R('tp / (tp + fp)')} AS precision FROM t")
def roc_curves(spark, d):
    return E.curves(B.lab(spark, d), "score", "truth")


@query("a25_run_summary", f"WITH {B.LAB}, r AS (SELECT service, count(*) AS windows, count(*) FILTER (score > 5000) AS alerts FROM lab GROUP BY service) SELECT count(*) AS runs, CAST(sum(windows) AS BIGINT) AS windows, CAST(sum(alerts) AS BIGINT) AS alerts, count(*) FILTER (alerts > 5) AS alerted_runs FROM r")
def run_summary(spark, d):
    r = B.lab(spark, d).groupBy("service").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("score") > 5000).alias("alerts"))
    return r.agg(F.count(F.lit(1)).alias("runs"), F.sum("windows").alias("windows"), F.sum("alerts").alias("alerts"), F.count_if(F.col("alerts") > 5).alias("alerted_runs"))


@query("a35_calibration_summary", f"WITH {B.LAB} SELECT count(*) FILTER (score > 4000) AS alerts, min(score) AS least, max(score) AS most FROM lab WHERE truth = 0")
def calibration_summary(spark, d):
    return B.lab(spark, d).where("truth = 0").agg(F.count_if(F.col("score") > 4000).alias("alerts"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("o01_ordered_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def ordered_page(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query(
    "o03_tail_slice",
    'SELECT o_custkey, o_orderkey, "offset" FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS "offset", count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE \"offset\" >= n - 3',
)
def tail_slice(spark, d):
    by = Window.partitionBy("o_custkey")
    o = B.table(spark, d, "orders").withColumn("offset", (F.row_number().over(by.orderBy("o_orderkey")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(by))
    return o.where("offset >= n - 3").select("o_custkey", "o_orderkey", "offset")


@query("o04_inventory_union", "SELECT s_suppkey AS id FROM supplier UNION SELECT n_nationkey FROM nation UNION SELECT l_suppkey FROM lineitem")
def inventory_union(spark, d):
    ids = [B.table(spark, d, t).select(F.col(c).cast("long").alias("id")) for t, c in (("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("lineitem", "l_suppkey"))]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


@query("o05_identity_intersect", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def identity_intersect(spark, d):
    o = B.table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("o06_identity_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def identity_except(spark, d):
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(B.table(spark, d, "orders").select("o_custkey"))


_LINE = "'nova.log 2017-05-16 00:00:0' || (event_id % 10) || '.123 2931 ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' nova.compute [req-ab-' || event_id || '] [instance: ' || printf('%08d', user_id) || '-0000-0000-0000-000000000000] ' || CASE WHEN event_type = 'view' THEN 'Took ' || value || ' seconds to build instance.' ELSE 'status ' || event_id END"


def lifecycle_lines(spark, d):
    return B.table(spark, d, "events").select(
        "event_id",
        F.concat(
            F.lit("nova.log 2017-05-16 00:00:0"), (F.col("event_id") % 10).cast("string"), F.lit(".123 2931 "), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"),
            F.lit(" nova.compute [req-ab-"), F.col("event_id").cast("string"), F.lit("] [instance: "), F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lit("-0000-0000-0000-000000000000] "),
            F.when(F.col("event_type") == "view", F.concat(F.lit("Took "), F.col("value").cast("string"), F.lit(" seconds to build instance."))).otherwise(F.concat(F.lit("status "), F.col("event_id").cast("string"))),
        ).alias("line"),
    )


@query("f05_lifecycle_parse", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'nova.compute' AS logger, lpad(CAST(user_id AS VARCHAR), 8, '0') || '-0000-0000-0000-000000000000' AS instance, '2017-05-16 00:00:0' || (event_id % 10) || '.123' AS observed FROM events")
def lifecycle_parse(spark, d):
    lines = lifecycle_lines(spark, d)
    fields = T.lifecycle_fields(F.col("line"))
    return lines.select("event_id", *[fields[c].alias(c) for c in ("level", "logger", "instance", "observed")])


@query("f06_duration_measurement", "SELECT event_id, 'build instance' AS operation, round(value, 6) AS duration_seconds FROM events WHERE event_type = 'view'")
def duration_measurement(spark, d):
    lines = lifecycle_lines(spark, d)
    fields = T.duration_fields(F.col("line"))
    return lines.select("event_id", fields["operation"].alias("operation"), fields["duration_seconds"].alias("duration_seconds")).where("operation IS NOT NULL")


@query("f02_mask_numbers", r"SELECT url, regexp_replace(url, '\b\d+(?:\.\d+)?\b', '<NUM>', 'g') AS masked FROM pages")
def mask_numbers(spark, d):
    return B.table(spark, d, "pages").select("url", T.mask_numbers(F.col("url")).alias("masked"))


@query("f03_severity_text", r"SELECT event_id, upper(event_type) || ' ' || regexp_replace(props, '\b\d+(?:\.\d+)?\b', 'NUM', 'g') AS text FROM events")
def severity_text(spark, d):
    return B.table(spark, d, "events").select("event_id", T.severity_text(F.upper("event_type"), F.col("props")).alias("text"))


@query("f11_error_word", r"SELECT conv_id, turn, regexp_matches(text, '\b(error|exception|fatal|panic|timeout|timed\s+out|refused|failed|failure)\b', 'i') AS error FROM conversations")
def error_word(spark, d):
    return B.table(spark, d, "conversations").select("conv_id", "turn", T.has_error_word(F.col("text")).alias("error"))


@query("f13_max_residual", f"WITH {B.SESS}, p AS (SELECT instance, max(value) FILTER (operation = '1-URGENT') AS a, max(value) FILTER (operation = '5-LOW') AS b FROM sess GROUP BY instance) SELECT instance, {R('greatest(abs(a - 250000) / 1000, abs(b - 200000) / 2000)')} AS residual FROM p")
def max_residual(spark, d):
    s = B.sess(spark, d).groupBy("instance").agg(F.max(F.when(F.col("operation") == "1-URGENT", F.col("value"))).alias("a"), F.max(F.when(F.col("operation") == "5-LOW", F.col("value"))).alias("b"))
    return s.select("instance", S.max_residual([F.col("a"), F.col("b")], [F.lit(250000.0), F.lit(200000.0)], [F.lit(1000.0), F.lit(2000.0)]).alias("residual"))


@query("f16_evidence_id", "SELECT event_id, substr(sha256(event_type || ':' || event_id || ':' || props), 1, 20) AS evidence FROM events")
def evidence_id(spark, d):
    return B.table(spark, d, "events").select("event_id", T.evidence_id(F.col("event_type"), F.col("event_id").cast("string"), F.col("props")).alias("evidence"))


@query("f17_rfc3339", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders")
def rfc3339(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", S.rfc3339(F.unix_timestamp("o_orderdate")).alias("stamp"))


@query(
    "m20_residual_and_tail",
    f"""WITH {B.SESS}, p AS (SELECT instance, max(value) FILTER (operation = '1-URGENT') AS a, max(value) FILTER (operation = '2-HIGH') AS b FROM sess GROUP BY instance),
c AS (SELECT quantile_cont(a, 0.5) AS ca, quantile_cont(b, 0.5) AS cb FROM p), s AS (SELECT greatest(quantile_cont(abs(a - ca), 0.5), 0.01) AS sa, greatest(quantile_cont(abs(b - cb), 0.5), 0.01) AS sb FROM p, c)
SELECT instance, {R('greatest(abs(a - ca) / sa, abs(b - cb) / sb)')} AS residual, coalesce(greatest(abs(a - ca) / sa, abs(b - cb) / sb) > 2.5, false) AS warning, a IS NULL AND b IS NULL AS abstained FROM p, c, s""",
)
def residual_and_tail(spark, d):
    s = B.sess(spark, d).groupBy("instance").agg(*[F.max(F.when(F.col("operation") == p, F.col("value"))).alias(c) for c, p in (("a", "1-URGENT"), ("b", "2-HIGH"))])
    table = new_folder(spark, "sessions")
    s.write.parquet(table)
    s = spark.read.parquet(table)
    ref = W.mad_reference(s, [], ["a", "b"], [0.01, 0.01], W.GROUP_ROWS)
    j = s.join(F.broadcast(ref))
    residual = S.max_residual([F.col("a"), F.col("b")], [F.col("a_center"), F.col("b_center")], [F.col("a_scale"), F.col("b_scale")])
    return j.select("instance", residual.alias("residual"), F.coalesce(residual > 2.5, F.lit(False)).alias("warning"), (F.col("a").isNull() & F.col("b").isNull()).alias("abstained"))


@query(
    "a24_incident_recall",
    f"""WITH {B.LAB}, c AS (SELECT service, max(CAST(truth = 1 AND score > 3000 AS INT)) AS detected, min(doc_id) FILTER (truth = 1 AND score > 3000) AS first FROM lab GROUP BY service)
SELECT count(*) AS cases, {R('avg(detected)')} AS recall, {R('quantile_cont(first, 0.5)')} AS median_delay FROM c""",
)
def incident_recall(spark, d):
    hit = (F.col("truth") == 1) & (F.col("score") > 3000)
    c = B.lab(spark, d).groupBy("service").agg(F.max(hit.cast("int")).alias("detected"), F.min(F.when(hit, F.col("doc_id"))).alias("first"))
    return c.agg(F.count(F.lit(1)).alias("cases"), F.avg("detected").alias("recall"), F.percentile("first", F.lit(0.5)).alias("median_delay"))


@query("a30_finding_summary", f"WITH {B.MSG} SELECT service, count(*) AS events, count(DISTINCT md5(message)) AS templates, count(*) FILTER (length(message) > 2000) AS long FROM msg GROUP BY service")
def finding_summary(spark, d):
    return B.msg(spark, d).groupBy("service").agg(F.count(F.lit(1)).alias("events"), F.count_distinct(F.md5("message")).alias("templates"), F.count_if(F.length("message") > 2000).alias("long"))


@query(
    "m27_model_comparison",
    f"""WITH {B.LAB}, m AS (SELECT 'long' AS model, {_METRICS} FROM lab UNION ALL SELECT 'short', count(*) FILTER (truth = 1 AND score < 500), count(*) FILTER (truth = 0 AND score < 500), count(*) FILTER (truth = 1 AND score >= 500), count(*) FILTER (truth = 0 AND score >= 500) FROM lab)
SELECT *, {_RATES} FROM m""",
)
def model_comparison(spark, d):
    lab, truth = B.lab(spark, d), F.col("truth") == 1
    a = E.binary_metrics(lab, truth, F.col("score") > 3000).select(F.lit("long").alias("model"), "*")
    return a.unionByName(E.binary_metrics(lab, truth, F.col("score") < 500).select(F.lit("short").alias("model"), "*"))


@query("m28_score_diagnostics", f"WITH {B.LAB} SELECT system, truth, {R('quantile_cont(score, 0.5)')} AS p50, {R('quantile_cont(score, 0.95)')} AS p95, max(score) AS largest, count(*) FILTER (score > 3000) AS over FROM lab GROUP BY system, truth")
def score_diagnostics(spark, d):
    return E.distribution(B.lab(spark, d), ["system", "truth"], "score", 3000)




_FIRST = f"""{B.BUSY}, {B.SCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY p95 / base DESC, service) AS place FROM busy),
f AS (SELECT s.service, onset, min(until) AS first_at FROM sched s LEFT JOIN busy b ON b.service = s.service AND b.warning AND b."window" >= onset AND b."window" < recovery GROUP BY ALL)"""


@query(
    "a24_first_alert_ranking",
    f"""WITH {_FIRST} SELECT count(*) AS cases, {R('count(first_at) / count(*)')} AS recall, {R('count(*) FILTER (place <= 1) / count(*)')} AS top1, {R('count(*) FILTER (place <= 3) / count(*)')} AS top3,
  {R('quantile_cont(first_at - onset, 0.5)')} AS median_delay FROM f LEFT JOIN r ON r.service = f.service AND r.until = f.first_at""",
)
def first_alert_ranking(spark, d):
    """Cases by their first alert inside the fault: found at all, the place of the faulty service then, and the delay."""
    return E.first_alert_outcome(B.busy(spark, d), B.schedule(spark), F.col("p95") / F.col("base"))


@query(
    "m20_tail_decision",
    f"""WITH {B.SESS}, s AS (SELECT instance, {", ".join(f"max(value) FILTER (operation = '{p}') AS v{i}" for i, p in enumerate(B.PRIORITIES[:4]))} FROM sess GROUP BY instance),
t AS (SELECT instance, {", ".join(f"CASE WHEN v{i} IS NOT NULL THEN (1 + (SELECT count(*) FROM s h WHERE h.instance % 2 = 0 AND h.v{i} >= s.v{i})) / (1.0 + (SELECT count(v{i}) FROM s h WHERE h.instance % 2 = 0)) END AS p{i}" for i in range(4))} FROM s WHERE instance % 2 = 1)
SELECT instance, {R('least(p0, p1, p2, p3)')} AS least, p0 IS NULL OR p1 IS NULL OR p2 IS NULL OR p3 IS NULL AS abstained,
  coalesce(p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL AND least(p0, p1, p2, p3) <= 0.05 / 4, false) AS warning FROM t""",
)
def tail_decision(spark, d):
    """Sessions against the upper tails of the calibration sessions (even instances), measurement by measurement: a warning
    needs all four and a rank at or under alpha, shared among the four; with one missing there is no decision."""
    s = B.sess(spark, d).groupBy("instance").agg(*[F.max(F.when(F.col("operation") == p, F.col("value"))).alias(f"v{i}") for i, p in enumerate(B.PRIORITIES[:4])])
    return E.tail_decision(s.where("instance % 2 = 0"), s.where("instance % 2 = 1"), "instance", [f"v{i}" for i in range(4)], 0.05)
