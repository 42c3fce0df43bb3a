"""Dictionary-compressed WARC archives.

Pages are written as WARC/1.1 records, each compressed by itself with a Zstandard dictionary that was built from a
bounded sample of the archived records (at most ``rows`` whole pages and ``sample_bytes`` of html; under 20 records there
is none). The dictionary is the content of a skippable frame (magic 0x184D2A5D) at the
start of every archive, so an archive can be read without anything else and any record can be read by its offset.
Equal payloads of ``least_bytes`` or more are stored once: the page with the largest id is the response, the others
are revisit records that refer to it.

Each task writes archives of about ``archive_bytes`` of payload into a folder that all machines share. Names hold a
random part and a table lists the archives of tasks that succeeded, so files of lost tasks are never read.

Cases: a null html or url is empty, blanks and letters outside ASCII in a url are percent-encoded; pages with a null id are written without an id and, as an id is needed to refer
to, are always responses; pages that repeat an id and payload share a verdict; an empty table gives no archive and an
empty result. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_keyed, pieces, sample_texts, shared_folder, thinned, written

MAGIC = 0x184D2A5D
LEAST_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
SAMPLE_ROWS = 300
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
URL_SIGNS = "%:/?#[]@!$&'()*+,;=~"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, whose block is an HTTP head and the payload, or, where refers_to is set, a revisit record, whose
    block is the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {quote(url or '', safe=URL_SIGNS)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    lines.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """The record's fields, the payload's size by its HTTP head, and the payload (empty for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0]), payload


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def frames(raw: bytes):
    """The records of one archive, in order."""
    import zstandard

    magic, size = struct.unpack_from("<II", raw)
    if magic != MAGIC:
        raise ValueError("the archive does not begin with its dictionary")
    data = zstandard.ZstdCompressionDict(raw[8 : 8 + size]) if size else None
    decompressor = zstandard.ZstdDecompressor(dict_data=data)
    at, view = 8 + size, memoryview(raw)
    while at < len(raw):
        reader, out = decompressor.decompressobj(), []
        while not reader.eof:
            if at >= len(raw):
                raise ValueError("the archive ends inside a record")
            part = view[at : at + 8192]
            out.append(reader.decompress(part))
            at += len(part) - len(reader.unused_data)
        yield b"".join(out)


def build_dictionary(pages: DataFrame, rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or none where there are too few records to train on."""
    import zstandard

    known = pages.select(F.col("page_id").cast("long").alias("_id"), F.col("url").cast("string").alias("_url"), F.col("html").alias("_text"), F.lit(0).alias("_group")).where(F.length("html") > 0)
    sample = sample_texts(thinned(known.drop("_url"), F.xxhash64("_id", "_text"), rows), rows, sample_bytes)
    records = [record(page_id, None, p := html.encode("utf-8", "surrogatepass"), len(p), hashlib.sha1(p).hexdigest(), None) for page_id, html, _ in sample]
    try:
        return zstandard.train_dictionary(size, records, level=LEVEL).as_bytes() if len(records) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def decide(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The pages with refers_to: the largest page id of an equal payload, null for responses. Payloads of many pages are
    joined by broadcast, so no task gets all pages of one payload."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.octet_length(raw).alias("size"), F.sha1(raw).alias("digest"))
    rows = rows.withColumn("same", F.when((F.col("size") >= least_bytes) & F.col("page_id").isNotNull(), F.col("digest")))
    held = rows.where("same IS NOT NULL").groupBy("same").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    joined = join_keyed(rows, written(held.where("n > 1")), "same", "n")
    return joined.withColumn("refers_to", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper"))).drop("same", "keeper")


def write_archives(spark: SparkSession, pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes the archives, their records dated ``date`` (now); a table of (path, records, payload_bytes) of those that count."""
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    dictionary = spark.sparkContext.broadcast(build_dictionary(pages))
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archived(batches):
        import zstandard
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        raw = dictionary.value
        data = zstandard.ZstdCompressionDict(raw) if raw else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
        out, path, records, size = None, "", 0, 0
        for batch in pieces(batches, "html"):
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    path, records, size = f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(path, compression=None)
                    out.write(leading_frame(raw))
                payload = html.encode("utf-8", "surrogatepass")
                out.write(compressor.compress(record(page_id, url, payload, len(payload), digest, refers_to, date)))
                records, size = records + 1, size + len(payload)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.record_batch([pa.array([path.rsplit("/", 1)[1]]), pa.array([records]), pa.array([size])], ["name", "records", "payload_bytes"])
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([path.rsplit("/", 1)[1]]), pa.array([records]), pa.array([size])], ["name", "records", "payload_bytes"])

    listed = written(decide(pages).mapInArrow(archived, "name string, records long, payload_bytes long"))
    return listed.select(F.concat(F.lit(folder + "/"), F.col("name")).alias("path"), "name", "records", "payload_bytes")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits) of every record in
    the listed archives. Digests of responses are taken anew from what was read."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    first = archives.select("path").first()
    if first is None:
        return spark.createDataFrame([], schema)
    stored = spark.read.format("binaryFile").load(first["path"].rsplit("/", 1)[0]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    stored = stored.join(archives.select("name"), "name", "left_semi")

    def parsed(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows: list[list] = [[], [], [], [], [], [], []]
                for raw in frames(content.as_py()):
                    fields, size, payload = parse(raw)
                    response = fields["WARC-Type"] == "response"
                    page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                    digest = hashlib.sha1(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    values = (page and int(page), fields["WARC-Target-URI"], len(payload) if response else size, digest, fields["WARC-Type"], to and int(to), payload.decode("utf-8", "surrogatepass") if response else None)
                    for column, value in zip(rows, values):
                        column.append(value)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], [c.split()[0] for c in schema.split(", ")])

    return stored.mapInArrow(parsed, schema)
