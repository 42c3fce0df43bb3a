"""Scans and sinks of telemetry files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST = T.StructType(
    [
        T.StructField("service", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("active_requests", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("dependency", T.StringType()),
        T.StructField("dependency_status", T.IntegerType()),
    ]
)


def read_cases(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """``<folder>/<case>/<name>.parquet`` of every case that has it, with a ``case`` column from the path."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    df = reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/*/{name}.parquet")
    return df.withColumn("case", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{name}\.parquet", 1))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a byte-order mark at its begin is not part of the first name, as the schema gives the names."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON event a line; lines that do not parse (a torn last line) are left out."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return parsed.where("_corrupt_record IS NULL").drop("_corrupt_record")


def flatten_traces(df: DataFrame) -> DataFrame:
    """Rows of ``traces`` (array of struct with spans) or ``data`` (array of struct with traceID and spans) as spans."""
    outer = "traces" if "traces" in df.columns else "data"
    traces = df.select(F.explode(outer).alias("t"))
    return traces.select("t.*").select("*", F.explode("spans").alias("s")).drop("spans").select("*", "s.*").drop("s")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value. Numbers follow the order in each file also where a file is split between tasks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order"), "value")
    counts = rows.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("file", "_block", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_order"))
    return rows.withColumn("_place", place).join(before, ["file", "_block"]).select("file", (F.col("_before") + F.col("_place")).alias("line"), "value")


def stamped_json(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """``<RFC3339> <json>`` lines: transport time and the event's fields; null fields where a part does not parse."""
    parts = F.split(value, " ", 2)
    return lines.withColumn("transport", F.try_to_timestamp(parts[0])).withColumn("event", F.from_json(F.get(parts, 1), schema))


def write_cases(df: DataFrame, path: str) -> None:
    df.write.partitionBy("case").option("compression", "zstd").mode("overwrite").parquet(path)


def write_typed(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Writes exactly the schema's columns in its types; a column that df lacks is null."""
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(path)


def write_ordered_json(df: DataFrame, path: str, key: str, order: list[str]) -> None:
    """One folder a key with its rows in order: within each file, and from file to file by name. Ranges of rows are dealt to
    tasks, so a large key is several files."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).write.partitionBy(key).mode("overwrite").json(path)


def content_hash(columns: list[str]) -> Column:
    """sha256 of the row as canonical JSON: fields by name, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def index_audit(index: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose counted rows differ from the index or are missing on one side. Both have ``n``."""
    a, b = index.select(*keys, F.col("n").alias("listed")), found.select(*keys, F.col("n").alias("counted"))
    return a.join(b, keys, "full_outer").where(~F.col("listed").eqNullSafe(F.col("counted")))
