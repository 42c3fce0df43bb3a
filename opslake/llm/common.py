"""Helpers that the operators share: tables cut from their lineage, and text held in flat numpy buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task holds in numpy arrays at once (a longer single text is a piece of its own).
PIECE_BYTES = 2 << 20
MASK64 = (1 << 64) - 1
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A folder of one machine cannot stand in for
    it: what an executor writes there no other would see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):  # one machine, one process: any folder is shared
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: the lineage ends here and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, {f.rsplit("/", 1)[0] for f in table.inputFiles()})


def tables_made() -> int:
    """How many tables :func:`written` has made in this process: a mark for :func:`release`."""
    return len(_tables)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes the tables made since a mark, but for those of keep. For when all that reads them has been written."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for table in keep for f in table.inputFiles()}
    _delete(spark, {p for p in _tables[since:] if p.rsplit("/", 1)[1] not in kept})


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))


def thinned(rows: DataFrame, key: Column, n: int, groups: list | None = None) -> DataFrame:
    """Of each value of ``_group`` (or of those in groups, a short list) the rows with the smallest key hashes, about n and
    rarely fewer: a hash threshold by the group's count, so no partition hands over more than its share."""
    counts = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    if groups is not None:
        counts = counts.where(F.col("_group").isin(groups))
    share = F.least(F.lit(1.0), F.lit(n + 8 * n**0.5 + 40) / F.col("_rows"))
    place = F.pmod(key, F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.join(F.broadcast(counts.select(F.col("_group").alias("_g"), share.alias("_share"))), F.col("_group") == F.col("_g")).where(place < F.col("_share")).select(*rows.columns)


def sample_texts(rows: DataFrame, max_rows: int, max_bytes: int) -> list[tuple]:
    """(_id, _text, _group) of rows that are already few: in the order of a hash, at most max_rows of each group and
    max_bytes of text in all. Only ids, hashes and sizes are collected before the choice; equal rows count once."""
    spark = rows.sparkSession
    keyed = rows.withColumn("_content", F.xxhash64("_id", "_text"))
    sizes = written(keyed.groupBy("_id", "_group", "_content").agg(F.max(F.octet_length("_text")).cast("long").alias("_size")))  # one pass over the texts
    groups = [r["_group"] for r in sizes.select("_group").distinct().collect()]
    found = thinned(sizes, F.col("_content"), max_rows, groups).collect()  # bounded also where one id has many texts
    remove_tables(sizes)
    kept, taken, size = [], {}, 0
    for r in sorted(found, key=lambda r: (r["_content"], str(r["_group"]))):
        if taken.get(r["_group"], 0) < max_rows and size + r["_size"] <= max_bytes:
            taken[r["_group"]] = taken.get(r["_group"], 0) + 1
            size += r["_size"]
            kept.append((r["_content"], r["_group"]))
    if not kept:
        return []
    chosen = spark.createDataFrame(kept, f"_content long, _group {dict(sizes.dtypes)['_group']}")
    texts = keyed.join(F.broadcast(chosen), ["_content", "_group"]).groupBy("_content", "_group").agg(F.first("_id").alias("_id"), F.first("_text").alias("_text")).toArrow()
    order = sorted(range(texts.num_rows), key=lambda i: (texts["_content"][i].as_py(), str(texts["_group"][i])))
    return [(texts["_id"][i].as_py(), texts["_text"][i].as_py(), texts["_group"][i].as_py()) for i in order]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES, rows: int = 30_000) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of each take at most ``limit`` bytes and rows, or are one row. ``column`` has the
    texts, or their sizes."""
    for batch in batches:
        sizes = batch.column(column)
        sizes = pc.fill_null(sizes if pa.types.is_integer(sizes.type) else pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            ends = np.cumsum(sizes[start : start + rows])
            n = max(1, int(np.searchsorted(ends, limit, "right")))
            yield batch.slice(start, n)
            start += n


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, as byte ranges of one buffer (null text: none).

    data: the texts' UTF-8 bytes, each text followed by a line break; doc_start: where each text begins
    (one entry more than texts); start, end: byte range of each word; doc: its text; first: index of each
    text's first word (one entry more than texts).
    """

    def __init__(self, texts: pa.Array, lower_ascii: bool = False):
        joined = "\n".join([t or "" for t in texts.to_pylist()]) + "\n" if len(texts) else ""
        self.raw = joined.encode("utf-8", "surrogatepass")
        data = np.frombuffer(self.raw, np.uint8)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        if lower_ascii:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)
            self.raw = data.tobytes()
        self.data = data
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        before = np.concatenate([[True], blank[:-1]]) if len(data) else blank
        self.start = np.flatnonzero(~blank & before)
        self.end = np.flatnonzero(blank & ~before)
        self.first = np.searchsorted(self.start, self.doc_start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def _powers(base: int, n: int, store: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006  a cache in the worker
    if len(store.get(base, ())) < n:
        size = max(n, PIECE_BYTES + 1)
        p = np.full(size, np.uint64(base & MASK64))
        p[0] = 1
        store[base] = np.cumprod(p)
    return store[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits (the finaliser of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each range, by differences of one prefix sum of a polynomial mod 2^64."""
    base |= 1
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _powers(base, len(values)), out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * _powers(pow(base, -1, 1 << 64), len(values) + 1)[start])


def word_hashes(words: Words, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    return range_hashes(words.data.astype(np.uint64) + np.uint64(1), words.start, words.end, base)


RANK_BLOCK = 4096


def ranked(rows: DataFrame, key: str, order: list[str], rows_per_salt: int = 1 << 20) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each value of ``key``. A key with a third of all rows is cut into salts: the
    rank is the row's place in its salt plus the counts of the salts before it. ``rows`` must be a written table."""
    n = rows.count()
    salts = max(8, min(1 << 14, n // rows_per_salt))
    return ranked_kinds(rows.withColumn("_one", F.lit(1).cast("long")), key, order, "_one", salts).withColumnRenamed("rank0", "rank").drop("_one")


def ranked_kinds(kinds: DataFrame, key: str, order: list[str], n: str, salts: int) -> DataFrame:
    """Adds ``rank0`` to rows that each stand for ``n`` equal ones: the sum of n of the rows before it with the same key. The
    ranks follow from the columns in ``order`` alone, however the rows are dealt."""
    salted = kinds.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = salted.groupBy(key, "_salt").agg(F.sum(n).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col(key).alias("_key"), F.col("_salt").alias("_s"), F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = salted.withColumn("_place", F.coalesce(F.sum(n).over(inside), F.lit(0).cast("long")))
    out = out.join(before, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_s")))
    return out.withColumn("rank0", F.col("_place") + F.col("_before")).drop("_salt", "_place", "_key", "_s", "_before")


def join_runs(rows: DataFrame, key: str, runs: DataFrame, first: str, last: str) -> DataFrame:
    """Joins each row (key, rank) with the run of its key that holds the rank (first <= rank <= last). Runs are spread
    over blocks of ranks, so it is an equality join and no key is hot."""
    spread = runs.withColumn("_block", F.explode(F.sequence(F.floor(F.col(first) / RANK_BLOCK).cast("long"), F.floor(F.col(last) / RANK_BLOCK).cast("long"))))
    spread = spread.withColumnRenamed(key, "_key")
    left = rows.withColumn("_row_block", F.floor(F.col("rank") / RANK_BLOCK).cast("long"))
    on = (F.col(key) == F.col("_key")) & (F.col("_row_block") == F.col("_block")) & F.col("rank").between(F.col(first), F.col(last))
    return left.join(spread, on).drop("_key", "_block", "_row_block")


def expanded(kinds: DataFrame, n: str, spread: list[str]) -> DataFrame:
    """One row for each that a kind stands for, with its ``rank`` from the kind's ``rank0``. Kinds of many rows are first cut
    into blocks that are dealt over all tasks."""
    block = F.lit(RANK_BLOCK)
    few = kinds.where(F.col(n) <= block).withColumn("rank", F.explode(F.sequence(F.col("rank0"), F.col("rank0") + F.col(n) - 1)))
    cut = kinds.where(F.col(n) > block).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, block.cast("long"))))
    cut = cut.repartition(shuffle_partitions(kinds.sparkSession), *spread, "_from")
    many = cut.withColumn("rank", F.explode(F.sequence(F.col("rank0") + F.col("_from"), F.col("rank0") + F.least(F.col("_from") + block, F.col(n)) - 1))).drop("_from")
    return few.unionByName(many)


def join_keyed(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Left join of rows with a table that has one row a key and counts in ``n`` how many rows have it. Keys that hold over a
    quarter of a partition's share of the rows are broadcast, at most four for each shuffle partition; rows of other
    keys, whose groups are smaller than that, are shuffled. ``table`` must be a written table or cheap."""
    parts = shuffle_partitions(rows.sparkSession)
    total = table.agg(F.sum(n)).first()[0] or 0
    values = [c for c in table.columns if c not in (key, n)]
    hot = table.where(F.col(n) > total / (4 * parts)).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    cold = table.where(F.col(n) <= total / (4 * parts)).select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    stays = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    # rows that need no shuffle join get keys of their own, which no row of the table has
    marked = marked.withColumn("_salt", F.when(stays, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 14)).cast("int")).otherwise(0)).withColumn("_shuffled", F.when(~stays, F.col(key)))
    joined = marked.join(cold, (F.col("_shuffled") == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values])
