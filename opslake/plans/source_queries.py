"""Queries of scans, sinks and scalar functions: tables written in the producers' formats and read back, and lines and names
built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..functions import text as X
from ..operators import scoring as C
from ..sources import files
from ..streaming import jobs
from . import bindings as B
from . import window_queries as WQ
from .registry import query

R = "round({}, 6)".format


@query("s01_case_index", f"WITH {B.MSG} SELECT service AS \"case\", count(*) AS n_logs, count(DISTINCT \"window\") AS n_windows, bool_or(message IS NOT NULL) AS has_logs FROM msg GROUP BY service HAVING count(*) > 45")
def case_index(spark, d):
    """An index of runs, written wide and read with only the columns and runs that are asked for."""
    folder = jobs.new_folder(spark, "index")
    m = B.msg(spark, d).groupBy(F.col("service").alias("case")).agg(F.count(F.lit(1)).alias("n_logs"), F.count_distinct("window").alias("n_windows"), F.bool_or(F.col("message").isNotNull()).alias("has_logs"), F.max("message").alias("longest"))
    m.write.parquet(folder)
    return spark.read.parquet(folder).where("n_logs > 45").select("case", "n_logs", "n_windows", "has_logs")


@query(
    "s02_case_telemetry",
    f"""WITH {B.REQ} SELECT service AS "case", count(*) AS n, {R('avg(duration)')} AS mean, CAST(count(*) FILTER (service <> 'view') AS BIGINT) AS active FROM req GROUP BY service""",
)
def case_telemetry(spark, d):
    """One folder a case; one case lacks a modality's file and another lacks a column."""
    folder = jobs.new_folder(spark, "cases")
    r = B.req(spark, d).select("service", "span", "duration", "active")
    for i, service in enumerate(["click", "error", "purchase", "signup", "view"]):
        case = r.where(F.col("service") == service).drop("service")
        (case.drop("active") if service == "view" else case).write.parquet(f"{folder}/{service}/metrics.parquet")
        if i:
            case.select("span").write.parquet(f"{folder}/{service}/logs.parquet")
    found = files.read_cases(spark, folder, "metrics")
    return found.groupBy("case").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean"), F.count("active").alias("active"))


@query("s03_csv_scan", f"SELECT c_custkey AS id, c_name AS name, {R('c_acctbal')} AS balance FROM customer")
def csv_scan(spark, d):
    """Files that begin with a byte-order mark and hold quoted text."""
    folder = jobs.new_folder(spark, "csv")
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    c.withColumnRenamed("id", "﻿id").write.option("quoteAll", "true").csv(folder, header=True)
    return files.read_csv(spark, folder, "id long, name string, balance double")


TYPED = T.StructType([T.StructField("span_id", T.StringType()), T.StructField("duration_us", T.DoubleType()), T.StructField("status_code", T.IntegerType()), T.StructField("timestamp", T.LongType())])


@query("s09_typed_sink", f"WITH {B.REQ} SELECT CAST(span AS VARCHAR) AS span_id, {R('duration')} AS duration_us, status AS status_code, CAST(NULL AS BIGINT) AS \"timestamp\" FROM req")
def typed_sink(spark, d):
    """The sink's columns are exactly its schema's: others go, and missing ones are null."""
    folder = jobs.new_folder(spark, "typed")
    r = B.req(spark, d).select(F.col("span").alias("span_id"), F.col("duration").alias("duration_us"), F.col("status").cast("string").alias("status_code"), "stream")
    files.write_typed(r, folder, TYPED)
    return spark.read.parquet(folder)


@query("s13_cross_split_duplicates", """WITH h AS (SELECT doc_id % 3 AS split, sha256('{"lang":"' || lang || '","text":"' || sha256(text) || '"}') AS h FROM documents) SELECT h, count(*) AS n, count(DISTINCT split) AS splits FROM h GROUP BY h HAVING count(DISTINCT split) > 1""")
def cross_split_duplicates(spark, d):
    """Records that are equal as canonical JSON, the whole text by its digest, and lie in several splits."""
    rows = B.table(spark, d, "documents").select((F.col("doc_id") % 3).alias("split"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text"), "lang")
    h = rows.select("split", files.content_hash(["text", "lang"]).alias("h"))
    return h.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits")).where("splits > 1")


@query("o02_candidate_order", f"WITH {WQ._RANKED} SELECT \"window\", list(service ORDER BY priority DESC, p95 DESC, service) AS candidates FROM prioritised GROUP BY \"window\"")
def candidate_order(spark, d):
    ranked = C.ranked_candidates(WQ.with_priority(spark, d))
    return ranked.groupBy("window").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "service"))), lambda x: x["service"]).alias("candidates"))


@query(
    "f04_severity_lines",
    f"""WITH {B.REQ} SELECT span, CASE WHEN k % 10 <> 3 THEN CAST(k % 10 = 1 AS INT) END AS label, CASE WHEN k % 10 <> 3 THEN 'R' || k END AS node, CASE WHEN k % 10 <> 3 THEN CASE WHEN k % 2 = 0 THEN 'INFO' ELSE 'FATAL' END END AS severity,
  CASE WHEN k % 10 <> 3 THEN 'data  TLB error ' || span END AS message FROM req""",
)
def severity_lines(spark, d):
    """Ten fields between blanks, of which the last keeps its own; lines with fewer fields give nothing."""
    k = F.col("k")
    line = F.concat_ws(" ", F.when(k % 10 == 1, "KERNDTLB").otherwise("-"), F.lit("1117838570  2005.06.03"), F.concat(F.lit("R"), k.cast("string")), F.lit("2005-06-03-15.42.50 R02 RAS KERNEL"), F.when(k % 2 == 0, "INFO").otherwise("FATAL"), F.concat(F.lit("data  TLB error "), F.col("span").cast("string")))
    fields = X.severity_line(F.when(k % 10 == 3, "- 1117838570 2005.06.03 R02").otherwise(line))
    return B.req(spark, d).select("span", *[c.alias(n) for n, c in fields.items()])


_CAMEL = "upper(left(event_type, 1)) || substr(event_type, 2)"


@query("f07_kebab_service", f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nginx-thrift' WHEN event_id % 2 = 0 THEN event_type || '-mention-service' ELSE event_type || '-' || event_type END AS name FROM events")
def kebab_service(spark, d):
    e = F.col("event_id")
    camel = F.initcap("event_type")
    name = F.when(e % 7 == 0, "NginxThrift").when(e % 2 == 0, F.concat(camel, F.lit("MentionService_"))).otherwise(F.concat(camel, camel))
    return B.table(spark, d, "events").select("event_id", X.kebab_service(name).alias("name"))


@query("f08_bracket_time", f"WITH {B.REQ} SELECT span, CASE WHEN k % 5 <> 0 THEN {R('floor(end_s * 1000) / 1000')} END AS epoch FROM req")
def bracket_time(spark, d):
    at = F.timestamp_micros((F.floor(F.col("end_s") * 1000) * 1000).cast("long"))
    stamp = F.date_format(at, "yyyy-MMM-dd HH:mm:ss.SSSSSS")
    line = F.when(F.col("k") % 5 == 0, F.concat(stamp, F.lit(" <info>: no brackets"))).otherwise(F.concat(F.lit("["), stamp, F.lit("] <info>: started [2024-Jan-01 00:00:00.000000]")))
    return B.req(spark, d).select("span", X.bracket_epoch(line).alias("epoch"))


@query(
    "f09_run_names",
    "SELECT o_orderkey, CAST(floor(epoch(CAST(o_orderdate AS TIMESTAMP))) AS BIGINT) AS stamp, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'order' || o_custkey END AS run FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0",
)
def run_names(spark, d):
    key = F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.when(key % 3 == 0, F.concat(F.lit("order_metrics_"), stamp)).otherwise(F.concat(F.lit("order"), F.col("o_custkey").cast("string"), F.lit("_metrics_"), stamp, F.when(key % 2 == 0, "_").otherwise("T"), F.date_format("o_orderdate", "HHmmss"), F.lit(".json")))
    return B.table(spark, d, "orders").select(key, F.unix_timestamp(X.run_stamp(name)).alias("stamp"), X.run_key(name).alias("run"))


@query(
    "f10_span_normalisers",
    f"""WITH {B.REQ} SELECT span, {R('CASE WHEN k % 2 = 0 THEN duration * 1000 ELSE duration END')} AS duration_us, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN CASE WHEN k % 8 = 1 THEN 500 ELSE 0 END ELSE status END AS status_code,
  CASE WHEN k % 4 = 0 THEN 'unavailable' WHEN k % 4 = 1 THEN 'error flag' WHEN status IS NULL THEN 'unavailable' ELSE 'status code' END AS status_source FROM req""",
)
def span_normalisers(spark, d):
    k = F.col("k")
    text = F.when(k % 4 == 0, "").when(k % 4 >= 2, F.col("status").cast("string"))
    flag = F.when(k % 4 == 1, k % 8 == 1)
    code, source = S.normal_status(text, flag)
    return B.req(spark, d).select("span", S.normal_duration_us(F.col("duration"), F.when(k % 2 == 0, "ms").otherwise("us")).alias("duration_us"), code.alias("status_code"), source.alias("status_source"))


@query("f12_clipped_change", f"WITH {B.REQ} SELECT span, CASE WHEN k % 11 = 0 THEN 0.0 WHEN k % 11 = 1 THEN 100.0 ELSE {R('least(abs(duration - 50) / 0.9, 100)')} END AS change FROM req")
def clipped_change(spark, d):
    k = F.col("k")
    x = F.when(k % 11 == 0, None).when(k % 11 == 1, float("inf")).otherwise(F.col("duration"))
    return B.req(spark, d).select("span", S.clipped_change(x, F.lit(50.0), F.lit(0.9)).alias("change"))


@query(
    "f14_ratios",
    f"""WITH {B.REQ} SELECT span, {R('ln(1 + duration)')} AS volume, CASE WHEN k % 10 = 0 THEN 0.0 ELSE {R('duration / (k % 10)')} END AS ratio, (CAST(status IS NULL AS INT) + CAST(k % 3 = 0 AS INT)) / 2 AS missing FROM req""",
)
def ratios(spark, d):
    k = F.col("k")
    return B.req(spark, d).select("span", F.log1p("duration").alias("volume"), S.ratio(F.col("duration"), k % 10).alias("ratio"), S.missing_share([F.col("status"), F.when(k % 3 != 0, k)]).alias("missing"))


@query("f18_observable", f"WITH {B.REQ} SELECT span, list_sort(list_concat(list_concat([0, 1, 17], CASE WHEN k % 2 = 0 THEN [8, 9] ELSE [] END), CASE WHEN k % 3 = 0 THEN [11, 12, 13] ELSE [] END)) AS dims FROM req")
def observable(spark, d):
    k = F.col("k")
    dims = S.observable([(F.lit(True), [0, 1, 17]), (k % 2 == 0, [8, 9]), (k % 3 == 0, [11, 12, 13])])
    return B.req(spark, d).select("span", F.array_sort(dims).alias("dims"))
