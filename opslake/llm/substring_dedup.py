"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words of one text; words of windows whose word sequence starts in two or more
places are removed. The cover is a set of residues modulo a period such that for any two positions some shift below
the period makes both cover positions. So two equal windows hold an equal anchor (window - period + 1 words) that
starts at a cover position in both. Step 1 hashes anchors at cover positions only (5 in 21) and keeps those that occur
twice. Step 2 extends: only window starts that lie within a period before a repeated anchor are hashed as whole
windows (80 bits), and windows that occur twice are confirmed. Step 3 removes the covered words. Windows count as equal
if their 80-bit hashes are: among n windows next to repeated anchors a false match has a chance of about n * n / 2^81.

Hashes are dealt over partitions and compared there with sorted arrays, so a passage in a third of the texts costs
memory for its partition's rows only (24 bytes a hash), and partitions are as many as the text needs.

Cases: null text has no words; texts shorter than a window keep all words; repeated rows are places of their own, so
both are removed whole; an empty table gives an empty result; of the input only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, mix, pieces, range_hashes, shuffle_partitions, word_hashes

WINDOW = 35
PERIOD = 21
PART_BYTES = 64 << 20
COVER = (3, 6, 7, 12, 14)  # differences of these give every residue modulo 21
BASES = (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5)


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """Period and residues whose anchors fit into the window; a window under 35 words takes a smaller perfect cover."""
    for period, residues in ((PERIOD, COVER), (13, (0, 1, 3, 9)), (7, (1, 2, 4)), (3, (0, 1))):
        if window - period + 1 >= max(1, min(8, window - 2)):
            return period, residues
    return 1, (0,)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds _k and _c, two hashes (64 and 32 bits) of the row's content: equal rows share their verdict. Candidates go by _k
    alone, where a false match costs only work; verdicts go by both."""
    content = F.col("doc_id").cast("long"), F.col("text")
    return docs.withColumns({"_k": F.xxhash64(*content), "_c": F.hash(*content)})


def _joined(docs: DataFrame, per_key: DataFrame, how: str, on: list[str]) -> DataFrame:
    """docs joined with a table on keys. Texts travel compressed (column _z) with their size (_size)."""

    def packed(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=9)
        for batch in pieces(batches):
            z = [None if t is None else compressor.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            yield pa.RecordBatch.from_pydict(columns | {"_z": pa.array(z, pa.binary()), "_size": pc.binary_length(batch.column("text")).cast(pa.int64())})

    keyed = _keyed(docs)
    schema = T.StructType([f for f in keyed.schema if f.name != "text"] + [T.StructField("_z", T.BinaryType()), T.StructField("_size", T.LongType())])
    return keyed.mapInArrow(packed, schema).join(per_key, on, how)


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    import zstandard

    decompressor = zstandard.ZstdDecompressor()
    return [b"" if z is None else decompressor.decompress(z) for z in batch.column("_z").to_pylist()]


DEALT = "part int, h array<long>, doc array<short>, a array<int>, b array<short>, keys array<long>"
SURE = DEALT + ", checks array<int>"


def _dealt(parts: int, deal: np.ndarray, h: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, keys: np.ndarray, checks: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each partition with what a piece of texts has for it, as arrays: four times smaller than a row for each
    hash. doc counts the texts of the row, whose keys come along. Texts must be in order."""
    part = (deal % np.uint64(parts)).astype(np.int32)
    by = np.argsort(part, kind="stable")
    part, h, doc, a, b = part[by], h[by], doc[by], a[by], b[by]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    new = np.append(True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])) if len(part) else np.zeros(0, bool)
    local = np.cumsum(new) - 1
    offsets = pa.array(np.append(first, len(part)).astype(np.int32))
    key_first = local[first] if len(part) else np.zeros(0, np.int64)
    local = local - np.repeat(key_first, np.diff(np.append(first, len(part))))
    a = a.astype(np.int32)
    a[1:] -= np.where(new[1:], 0, a[:-1])  # steps within a text pack better than places
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (h.view(np.int64), local.astype(np.int16), a, b.astype(np.int16))]
    keyed = [pa.ListArray.from_arrays(pa.array(np.append(key_first, new.sum()).astype(np.int32)), pa.array(v[doc[new]])) for v in (keys, checks) if v is not None]
    return pa.record_batch([pa.array(part[first]), *lists, *keyed], ["part", "h", "doc", "a", "b", "keys", "checks"][: 5 + len(keyed)])


def _gathered(batches) -> tuple[np.ndarray, ...] | None:
    """h, a, b and the keys of each hash that was dealt to a partition."""
    out = []
    for batch in batches:
        flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "part"]
        sizes = np.diff(batch.column("h").offsets.to_numpy(zero_copy_only=False))
        offsets = batch.column("keys").offsets.to_numpy(zero_copy_only=False)
        h, doc, a, b, *keys = flat
        text = doc.astype(np.int64) + np.repeat(offsets[:-1] - offsets[0], sizes)
        new = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
        total = np.cumsum(a, dtype=np.int64)
        a = total - np.repeat(total[new] - a[new], np.diff(np.append(new, len(a))))
        out.append((h, a.astype(np.int32), b, *(k[text] for k in keys)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else None


def partitions_for(docs: DataFrame) -> int:
    """Partitions that hashes are dealt over: so many that each has the hashes of ``PART_BYTES`` of text, as a task sorts its
    partition in memory."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // PART_BYTES))


def anchors(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """Every anchor at a cover position, dealt by its hash. a: its place in the text; b: what its piece knows of it."""
    period, residues = cover_of(window)
    length = window - period + 1

    def found(batches):
        for batch in pieces(batches):
            words = Words(batch.column("text"))
            n = np.diff(words.first)
            place = np.arange(len(words.start)) - words.first[words.doc]
            at = np.flatnonzero(np.isin(place % period, residues) & (place + length <= n[words.doc]) & (n[words.doc] >= window))
            h = range_hashes(word_hashes(words), at, at + length, BASES[0])
            known = _known([h])
            keys = batch.column("_k").to_numpy(zero_copy_only=False)
            deal = np.where(known == 2, mix(keys[words.doc[at]].view(np.uint64) ^ place[at].astype(np.uint64)), h)
            yield _dealt(parts, deal, h, words.doc[at], place[at], known, keys)

    return _keyed(docs).select("_k", "text").mapInArrow(found, DEALT).repartitionById(parts, F.col("part"))


def _known(keys: list[np.ndarray]) -> np.ndarray:
    """What one piece of texts already tells: 0 for hashes that occur once in it; of each that occurs more often 1 for
    the first row, which goes to the comparison for all, and 2 for the rest, which are dealt anywhere. So a passage in
    a third of all texts sends one row a piece to its hash's partition."""
    known = np.zeros(len(keys[0]), np.int8)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    same = np.ones(max(0, len(order) - 1), bool)
    for c in keys:
        same &= c[order][1:] == c[order][:-1]
    known[order[:-1][same]] = 1
    known[order[1:][same]] = 2
    return known


def _repeated(keys: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Which rows have keys that occur in another row, here or in the row's own piece."""
    twin = known > 0
    here = np.flatnonzero(known < 2)
    keys = [c[here] for c in keys]
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    same = np.ones(max(0, len(order) - 1), bool)
    for c in keys:
        same &= c[order][1:] == c[order][:-1]
    twin[here[order[1:][same]]] = True
    twin[here[order[:-1][same]]] = True
    return twin


def repeated_anchors(dealt: DataFrame) -> DataFrame:
    """_k, pos of anchors that occur twice or more."""

    def kept(batches):
        if table := _gathered(batches):
            h, place, known, k = table
            r = _repeated([h], known)
            yield pa.record_batch([pa.array(k[r]), pa.array(place[r])], ["_k", "pos"])

    return dealt.mapInArrow(kept, "_k long, pos int")


def windows(candidates: DataFrame, window: int, parts: int) -> DataFrame:
    """The window at each candidate start, dealt by its hash. a: its start and what its piece knows of it; b: 16 more
    bits of hash."""
    period = cover_of(window)[0]

    def hashed(batches):
        for batch in pieces(batches, "_size"):
            words = Words(pa.array([t.decode("utf-8", "surrogatepass") for t in _unpacked(batch)], pa.string()))
            near = batch.column("places")
            flat = near.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(near.offsets.to_numpy(zero_copy_only=False)))
            n = len(words.start)
            inside = words.first[owner] + flat < words.first[owner + 1]  # else the place is that of another row with the same _k
            owner, flat = owner[inside], flat[inside]
            anchor = words.first[owner] + flat
            # starts from a period before each anchor up to it, inside the text
            low = np.maximum(anchor - period + 1, words.first[owner])
            open_ = np.bincount(low, minlength=n + 1) - np.bincount(anchor + 1, minlength=n + 1)[: n + 1]
            at = np.flatnonzero(np.cumsum(open_)[:n] > 0)
            at = at[at + window <= words.first[words.doc[at] + 1]]
            w = word_hashes(words)
            h = range_hashes(w, at, at + window, BASES[1])
            g = (range_hashes(mix(w), at, at + window, BASES[2]) >> np.uint64(48)).astype(np.uint16).view(np.int16)
            start = at - words.first[words.doc[at]]
            known = _known([h, g])
            keys = batch.column("_k").to_numpy(zero_copy_only=False)
            deal = np.where(known == 2, mix(keys[words.doc[at]].view(np.uint64) ^ start.astype(np.uint64)), h)
            yield _dealt(parts, deal, h, words.doc[at], start * 4 + known, g, keys, batch.column("_c").to_numpy(zero_copy_only=False))

    return candidates.select("_k", "_c", "_z", "_size", "places").mapInArrow(hashed, SURE).repartitionById(parts, F.col("part"))


def repeated_starts(dealt: DataFrame) -> DataFrame:
    """_k, _c, start of windows that occur twice or more."""

    def kept(batches):
        if table := _gathered(batches):
            h, a, g, k, c = table
            r = _repeated([h, g], a & 3)
            yield pa.record_batch([pa.array(k[r]), pa.array(c[r]), pa.array(a[r] >> 2)], ["_k", "_c", "start"])

    return dealt.mapInArrow(kept, "_k long, _c int, start int")


def covered_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """_k, _c, starts: the starts of repeated windows per distinct row (keys as in :func:`_keyed`)."""
    parts = partitions_for(docs)
    places = repeated_anchors(anchors(docs, window, parts)).groupBy("_k").agg(F.collect_set("pos").alias("places"))
    candidates = _joined(docs.select("doc_id", "text"), places, "inner", ["_k"])
    return repeated_starts(windows(candidates, window, parts)).groupBy("_k", "_c").agg(F.collect_set("start").alias("starts"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) per row of docs."""
    rows = _joined(docs.select("doc_id", "text"), covered_words(docs, window), "left", ["_k", "_c"])

    def cut(batches):
        for batch in pieces(batches, "_size"):
            total, removed, kept = [], [], []
            for text, starts in zip(_unpacked(batch), batch.column("starts")):
                words = text.split()
                total.append(len(words))
                if starts.is_valid:
                    stays = uncovered(len(words), starts.values.to_numpy(zero_copy_only=False), window)
                    words = [w for w, s in zip(words, stays) if s]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def digest(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words' SHA-256 (taken in the JVM)."""
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))



def strip_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, with the repeated words taken out of ``text``: texts without any stay as they are,
    others become the words left, joined by one space; rows of which nothing is left go. ``n_chars`` follows."""
    starts = covered_words(docs, window).withColumnRenamed("starts", "_starts")
    names = docs.columns

    def cut(batches):
        for batch in pieces(batches, "_size"):
            texts, stay = [], []
            for raw, null, found in zip(_unpacked(batch), batch.column("_z").is_null().to_pylist(), batch.column("_starts")):
                if found.is_valid:
                    words = raw.split()
                    kept = [w for w, s in zip(words, uncovered(len(words), found.values.to_numpy(zero_copy_only=False), window)) if s]
                    raw = b" ".join(kept)
                    stay.append(bool(kept))
                else:
                    stay.append(True)
                texts.append(None if null else raw.decode("utf-8", "surrogatepass"))
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.record_batch(columns, names).filter(pa.array(stay, pa.bool_()))

    out = _joined(docs, starts, "left", ["_k", "_c"]).mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def uncovered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in no window that begins at one of the starts (a start whose window would end past the text is
    none of this text's)."""
    starts = starts[starts + window <= n]
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.subtract.at(cover, starts + window, 1)
    return np.cumsum(cover)[:-1] == 0
