"""Ranked lexical search by the Best Position Algorithm over impact lists.

A pass over the documents keeps each text's length and its frequencies of the terms that occur in items (a term's hash
finds it, its bytes confirm it). From these come the statistics of all documents, and lists: a part of the documents,
as many as have ``POSTINGS`` frequencies, is a segment with one list a term, in the order of falling impact. In a
segment an item's lists are read from the top, in steps that double. A document met in one list is looked up in the
item's other lists (direct access), which also shows at which positions it stands there. Each list keeps its best
position, up to which every position has been seen, under either kind of access; no document that has not been seen
can score more than the sum of the impacts that follow the best positions. The item is done in the segment once that
sum is strictly below the k-th best score so far, so equal scores are all met and ties go to the smaller doc_id. The
k best are carried from segment to segment of a task, and the tasks' bests meet in a window of k rows a task and item.

Scores are integers (see :func:`weight` and :func:`impact`). Items are searched in blocks of ``BLOCK_CHARS`` characters,
each with a pass of its own, so the terms that a task holds are bounded.

Cases: a null text has no terms, and a document without terms is not counted; an item without terms, or whose terms no
document holds, has no rows; items and documents that repeat are items and documents of their own (equal scores with
equal ids in any order); null ids come after all others; empty tables give an empty result. Only ``doc_id``, ``item_id``
and ``text`` are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, range_hashes, written

TOP = 10
BLOCK_CHARS = 1 << 20
POSTINGS = 1 << 21
FIRST_STEP = 32
BASE = 0x5851F42D4C957F2D
_breaks = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _breaks[_low : _high + 1] = True


class Terms:
    """The terms of a batch of texts, as byte ranges of the lower-cased data; doc: each term's text."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        offsets -= offsets[0]
        term = ~_breaks[self.data]
        first = np.zeros(len(data) + 1, bool)  # a term never goes on into the next text
        first[offsets] = True
        self.start = np.flatnonzero(term & (np.append(True, ~term[:-1]) | first[:-1])) if len(data) else np.zeros(0, np.int64)
        self.end = np.flatnonzero(term & (np.append(~term[1:], True) | first[1:])) + 1 if len(data) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.n = n

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data.astype(np.uint64) + np.uint64(1), self.start, self.end, BASE)

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


class Vocabulary:
    """Terms in the order of their hashes; a term's number is its place."""

    def __init__(self, terms: list[bytes]):
        t = Terms(pa.array([x.decode("utf-8", "surrogatepass") for x in terms], pa.string()))
        h = t.hashes()
        order = np.argsort(h)
        self.hash = h[order]
        self.terms = [terms[i] for i in order]
        self.number = {x: i for i, x in enumerate(self.terms)}
        self.bytes = np.frombuffer(b"".join(self.terms), np.uint8)
        self.size = np.array([len(x) for x in self.terms], np.int64)
        self.at = np.cumsum(self.size) - self.size
        if len(h) and (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms of the items have one hash; choose another BASE")

    def find(self, words: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms of the vocabulary, and their numbers. The bytes decide, not the hash alone."""
        if not len(self.hash) or not len(words.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        word = np.flatnonzero((self.hash[at] == h) & (words.end - words.start == self.size[at]))
        number = at[word]
        if not len(word):
            return word, number
        n = self.size[number]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = words.data[np.repeat(words.start[word], n) + inside] == self.bytes[np.repeat(self.at[number], n) + inside]
        right = np.logical_and.reduceat(same, np.cumsum(n) - n)
        return word[right], number[right]


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What one occurrence of a term in an item adds to a document's score, before the term's weight."""
    m = 100 - 75 + (75 * n * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers) and tf of each text with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        known = shared.value
        for batch in pieces(batches):
            words = Terms(batch.column("text"))
            n = np.bincount(words.doc, minlength=words.n)
            word, number = known.find(words)
            key, tf = np.unique(words.doc[word] * max(1, len(known.hash)) + number, return_counts=True)
            doc = key // max(1, len(known.hash))
            offsets = pa.array(np.searchsorted(doc, np.arange(words.n + 1)).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, pa.array((key % max(1, len(known.hash))).astype(np.int32)))
            rows = pa.record_batch([batch.column("doc_id"), pa.array(n), terms, pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], ["doc_id", "n", "terms", "tf"])
            yield rows.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(counted, "doc_id long, n long, terms array<int>, tf array<int>")


class Segment:
    """Impact lists of some documents. Documents are numbered in the order of their ids, null ids last."""

    def __init__(self, doc_id: np.ndarray, null: np.ndarray, doc: np.ndarray, term: np.ndarray, g: np.ndarray):
        order = np.lexsort((doc_id, null))
        self.id, self.null = doc_id[order], null[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        doc = self.place[doc]
        by = np.lexsort((doc, -g, term))
        self.doc, self.g, term = doc[by], g[by], term[by]
        self.numbers, first = np.unique(term, return_index=True)
        self.first = dict(zip(self.numbers.tolist(), zip(first.tolist(), np.append(first[1:], len(term)).tolist())))
        self.finders: dict[int, tuple] = {}
        self.accesses = 0

    def positions(self, term: int, docs: np.ndarray) -> np.ndarray:
        """Direct access: where documents stand in the term's list, or -1."""
        a, b = self.first[term]
        if term not in self.finders:
            if 16 * (b - a) > len(self.id):
                table = np.full(len(self.id), -1, np.int32)
                table[self.doc[a:b]] = np.arange(b - a)
                self.finders[term] = (table, None)
            else:
                by = np.argsort(self.doc[a:b])
                self.finders[term] = (self.doc[a:b][by], by)
        found, by = self.finders[term]
        if by is None:
            return found[docs]
        at = np.minimum(np.searchsorted(found, docs), len(found) - 1)
        return np.where(found[at] == docs, by[at], -1)

    def search(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that may be among the k best, and their scores. query: terms with the factor of their impact;
        floor: the k-th best score known from elsewhere (0: none). Whoever scores floor or more and is among the k best
        here is returned, by falling score and rising id."""
        lists = [(t, w, *self.first[t]) for t, w in query if w > 0 and t in self.first]
        score = np.zeros(len(self.id), np.int64)
        seen = np.zeros(len(self.id), bool)
        met = [np.zeros(b - a, bool) for _, _, a, b in lists]
        best = [0] * len(lists)  # how many positions from the top have all been seen
        low, high, kth = 0, FIRST_STEP, max(1, floor)
        found: list[np.ndarray] = []
        while lists:
            for _, _, a, b in lists:
                docs = self.doc[a + low : min(b, a + high)]
                docs = docs[~seen[docs]]
                if not len(docs):
                    continue
                seen[docs] = True
                found.append(docs)
                for i, (t, w, first, _) in enumerate(lists):
                    at = self.positions(t, docs)
                    there = np.flatnonzero(at >= 0)
                    at = at[there]
                    score[docs[there]] += w * self.g[first + at]
                    met[i][at] = True
                    self.accesses += len(there)
            limit = 0
            for i, (_, w, a, b) in enumerate(lists):
                if best[i] < b - a:
                    rest = met[i][best[i] :]
                    step = int(rest.argmin())
                    best[i] = b - a if rest[step] else best[i] + step
                if best[i] < b - a:
                    limit += w * int(self.g[a + best[i]])
            here = np.concatenate(found)
            if len(here) >= k:
                kth = max(kth, int(np.partition(score[here], -k)[-k]))
            if limit < kth:  # strictly: an unseen document could otherwise tie with a smaller id
                break
            low, high = high, 2 * high
            if all(low >= b - a for *_, a, b in lists):
                break
        here = np.concatenate(found) if found else np.zeros(0, np.int64)
        here = here[score[here] >= kth]
        here = here[np.lexsort((here, -score[here]))][:k]
        return here, score[here]


def search_block(spark: SparkSession, docs: DataFrame, items: list[tuple], k: int, postings: int) -> DataFrame:
    """q (an item's place in items), doc_id, score: candidates that hold the k best of each item."""
    words = Terms(pa.array([t for _, t in items], pa.string()))
    texts = words.texts()
    vocabulary = Vocabulary(sorted(set(texts)))
    queries = [Counter() for _ in items]
    for d, t in zip(words.doc.tolist(), texts):
        queries[d][vocabulary.number[t]] += 1
    rows = written(frequencies(docs, vocabulary))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    documents, total = size["n"], size["l"] or 0
    df = {r["t"]: r["df"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term of the block
    weighted = [[(t, n * weight(documents, df[t])) for t, n in sorted(q.items()) if t in df] for q in queries]
    shared = spark.sparkContext.broadcast(weighted)

    def searched(batches):
        asked = shared.value
        tops: list[list[tuple]] = [[] for _ in asked]  # (-score, id is null, id)

        def through(parts):
            n, doc_id, sizes, term, tf = (np.concatenate(c) for c in zip(*[p[:5] for p in parts]))
            null = np.concatenate([p[5] for p in parts])
            doc = np.repeat(np.arange(len(n)), sizes)
            segment = Segment(doc_id, null, doc, term, impact(tf, n[doc], documents, total))
            for q, query in enumerate(asked):
                top = tops[q]
                here, score = segment.search(query, k, -top[k - 1][0] if len(top) >= k else 0)
                if len(here):
                    top += zip((-score).tolist(), segment.null[here].tolist(), segment.id[here].tolist())
                    top.sort()
                    del top[k:]

        parts, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            terms, tf = batch.column("terms"), batch.column("tf")
            parts.append((batch.column("n").to_numpy(), pc.fill_null(ids, 0).to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False)))
            size += len(parts[-1][3])
            if size >= postings:
                through(parts)
                parts, size = [], 0
        if parts:
            through(parts)
        found = [(q, None if null else i, -s) for q, top in enumerate(tops) for s, null, i in top]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["q", "doc_id", "score"])

    return rows.mapInArrow(searched, "q int, doc_id long, score long")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = TOP, block_chars: int = BLOCK_CHARS, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // block_chars))
    out = None
    for block in range(blocks):
        part = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]  # block_chars characters or so
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(part)], "q int, item_id long")
        found = search_block(spark, docs, part, k, postings)
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
