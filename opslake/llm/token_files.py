"""Texts as token ids in Parquet files that can be read in part.

Documents are range-partitioned by id and sorted, every text is encoded and gets its end mark, and Spark writes a row a
document: ``doc_id``, ``part`` (its file), ``place`` (ids before it in the file), ``n_tokens``, ``ids`` (a list column)
and ``meta`` (a struct of the metadata columns asked for). Ids are dictionary-encoded, as a file uses a bounded
vocabulary many times (``encoding="delta"`` packs differences instead); ``doc_id`` and ``place``, which rise, are
delta-packed. Row groups have ``group_bytes``, pages ``page_bytes``, and Parquet's column indexes give the smallest and
largest value of each page, so :func:`documents_between`, :func:`tokens_between` and :func:`metadata` read the columns and
pages that they ask for. A manifest has one row a file: the ids before it, so a document's ``start`` is a sum of two
numbers and no file is written twice.

The text is cut before each blank that a visible character follows and around single line breaks, where the tokenizer
always cuts; distinct pieces of a batch are encoded once, by the tokenizer, and kept in the worker's table of bounded
size.

Cases: a null or empty text is its end mark alone; special tokens' strings in a text are ordinary text; rows with one id
(or none: they come first) lie next to each other, in the order of their texts, and are dealt over several files if they are
many; an empty table gives no file with rows and an empty result; metadata columns that are not there are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, shared_folder, shuffle_partitions
from .packing import WordTable, _gather, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 256
#: First bytes of characters that may be blanks outside ASCII.
BLANK_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


class PieceTable(WordTable):
    """The ids of pieces of text, each with the blank before it: a blank and plain letters, then ASCII marks, are two parts;
    any other piece is one and is encoded whole."""

    LETTERS = WordTable.LETTERS + "".join(sorted({c.upper() for c in WordTable.LETTERS if len(c.upper()) == 1}))

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.letters.add(" ")
        self.spelling[32] = "Ġ"

    def _parts(self, words: pa.Array) -> list[pa.Array]:
        stem = pc.utf8_rtrim(words, self.MARKS)
        plain = pc.match_substring_regex(stem, f"^ ?[{self.LETTERS}]+$")
        marks = pc.utf8_ltrim(words, self.LETTERS + " ")
        return [pc.if_else(plain, stem, words), pc.if_else(plain, marks, "")]

    def _spelt(self, part: str) -> str | None:
        if part and part != " " and self.letters.issuperset(part) and " " not in part[1:]:
            return part.translate(self.spelling)
        return None


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before blanks that a visible character follows and around single line breaks between visible
    characters, and the number of pieces of each text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    if not len(texts) or offsets[-1] == offsets[0]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets.astype(np.int64) - offsets[0]
    visible = (data > 32) & (data != 127)
    for lead in BLANK_LEADS:
        visible &= data != lead
    new = np.zeros(len(data), bool)
    new[:-1] = (data[:-1] == 32) & visible[1:]
    single = 1 + np.flatnonzero((data[1:-1] == 10) & visible[:-2] & (data[:-2] < 127) & visible[2:])
    new[single] = new[single + 1] = True
    new[ends[:-1][np.diff(ends) > 0]] = True
    starts = np.flatnonzero(new)
    bounds = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))), np.diff(np.searchsorted(starts, ends))


def encode(texts: pa.Array, table: PieceTable, end_id: int = END_ID) -> pa.ListArray:
    """Each text's ids and the end mark."""
    split, pieces_of = cut(texts)
    words = split.dictionary_encode()
    which = words.indices.to_numpy()
    begin, n, flat = table.encode(words.dictionary)
    begin, n = begin[which].ravel(), n[which].ravel()
    ids = _gather(flat, begin, n) if len(n) else np.zeros(0, np.uint32)
    ends = np.append(0, np.cumsum(n))[2 * np.cumsum(pieces_of)].astype(np.int64)
    ids = np.insert(ids, ends, end_id).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends + np.arange(1, len(ends) + 1)).astype(np.int32)), pa.array(ids))


def write(spark: SparkSession, docs: DataFrame, folder: str | None = None, metadata: Sequence[str] = ("lang", "source"), tokenizer: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> str:
    """Writes the documents' ids; returns the folder, with ``data`` and ``manifest``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding must be 'dictionary' or 'delta'")
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    path = tokenizer or tokenizer_path(TOKENIZER)
    meta = [c for c in metadata if c in docs.columns]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(1).alias("_"), *[F.col(c) for c in meta]).alias("meta"))
    # equal ids may be many: the text's hash and the row's place split them
    order = ["doc_id", "_h", "_n"]
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()}).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), rows.schema["meta"]])

    def encoded(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        table = PieceTable.of_worker(path)
        for batch in pieces(batches, limit=1 << 20):
            ids = encode(batch.column("text"), table, end_id)
            offsets = ids.offsets.to_numpy().astype(np.int64)
            n = np.diff(offsets)
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(place + offsets[:-1]), pa.array(n), ids, batch.column("meta")], schema.names)
            place += int(offsets[-1])

    out = rows.select("doc_id", "text", "meta").mapInArrow(encoded, schema)
    out = out.withColumn("meta", F.struct(*[F.col("meta")[c].alias(c) for c in meta])) if meta else out.drop("meta")
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#place": "false",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "compression": "zstd",
    }
    out.write.options(**options).parquet(f"{folder}/data")
    files = spark.read.parquet(f"{folder}/data").groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    files.select("part", F.coalesce(before, F.lit(0)).alias("base"), "tokens", "docs").coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and meta (if any) of each document, without reading ids."""
    data = spark.read.parquet(f"{folder}/data")
    return _placed(spark, folder, data).select("doc_id", "start", "n_tokens", *[c for c in data.columns if c == "meta"])


def documents_between(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """doc_id, start, ids of the documents with first <= doc_id <= last: the pages that may hold them are read."""
    return _placed(spark, folder, spark.read.parquet(f"{folder}/data").where(F.col("doc_id").between(first, last))).select("doc_id", "start", "ids")


def tokens_between(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """doc_id, start, ids: the ids at the places start to stop - 1 of all files as one sequence, by document."""
    files = spark.read.parquet(f"{folder}/manifest").where((F.col("base") < stop) & (F.col("base") + F.col("tokens") > start)).orderBy("part").collect()  # a row a file
    if not files:
        return documents_between(spark, folder, 0, -1)
    data = spark.read.parquet(f"{folder}/data").where(F.col("part").between(files[0]["part"], files[-1]["part"]))
    last = files[-1]
    inside = ~((F.col("part") == last["part"]) & (F.col("place") >= stop - last["base"])) & ~((F.col("part") == files[0]["part"]) & (F.col("place") + F.col("n_tokens") <= start - files[0]["base"]))
    found = _placed(spark, folder, data.where(inside))
    low, high = F.greatest(F.lit(start), F.col("start")), F.least(F.lit(stop), F.col("start") + F.col("n_tokens"))
    return found.where(low < high).select("doc_id", low.alias("start"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("ids"))


def _placed(spark: SparkSession, folder: str, data: DataFrame) -> DataFrame:
    base = spark.read.parquet(f"{folder}/manifest").select(F.col("part").alias("_part"), "base")
    return data.join(F.broadcast(base), F.col("part") == F.col("_part")).withColumn("start", F.col("base") + F.col("place"))  # a row a file


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids, all from the files."""
    rows = _placed(spark, folder, spark.read.parquet(f"{folder}/data")).select("doc_id", "start", "ids")

    def summed(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy().astype(np.int64)
            flat = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digest(spark, write(spark, docs))
