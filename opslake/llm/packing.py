"""Best-fit packing of token sequences by bulk-synchronous sweeps.

Documents of one length are alike, so documents and gaps (the free ends of sequences) are kept as runs: a length with
its number of documents, a gap with its number of sequences. Spark counts the lengths; the sweeps work on runs, whose
number is bounded by the capacity and the rounds and not by the data; Spark then ranks the documents of each length
and joins each with its run. Lengths are taken in ranges from the largest down. Each round

1. takes the largest documents of the range, at most as many as there are gaps, both sorted by size;
2. finds each document's successor, the number of gaps that are too small for it, in one sweep;
3. resolves conflicts by rank: documents with one successor take it and the gaps after it in order, which is a running
   maximum of (successor - rank); what runs past the last gap waits;
4. cuts runs where they overlap, records who lies where, and shrinks the gaps.

Rounds repeat until nothing in the range fits; new sequences are opened only then.

Cases: a null or empty text is one token (its end mark); repeated rows and null ids are packed like any other; an
empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_runs, pieces, ranked, written

CAPACITY = 4096
END_ID = 1
RATIO = 0.97
KNOWN_PARTS = 600_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable:
    """The ids of word parts in one flat array of bounded size, into which only new parts are encoded.

    The tokenizer splits letters from marks, so a word of plain letters and ASCII marks after them has two parts;
    every other word is one part and is encoded whole, as it stands."""

    MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
    LETTERS = "".join(c for c in map(chr, [*range(97, 123), *range(ord("ß"), ord("ÿ"))]) if c.isalpha())

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = set(self.LETTERS)
        self.spelling = {ord(c): spell(c)[0][0] for c in self.LETTERS}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(KNOWN_PARTS + 1, np.int64)  # where each part's ids end; they begin where the part before ends

    @classmethod
    def of_worker(cls, path: str) -> "WordTable":
        """The table of this Python worker, which Spark uses again for later tasks."""
        store = vars(sys.modules.setdefault("_opslake_worker", types.ModuleType("_opslake_worker"))).setdefault("tables", {})
        if (cls.__name__, path) not in store:
            store[cls.__name__, path] = cls(path)
        return store[cls.__name__, path]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word's two parts begin, how many they are (both [words, 2]), and the array they are in.
        Words differ from each other."""
        parts = pa.concat_arrays(self._parts(words)).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > KNOWN_PARTS:
            self._clear()
        if len(distinct) > KNOWN_PARTS:  # one very long text: a table of its own
            self.ends = np.zeros(len(distinct) + 1, np.int64)
        known = self.known
        if new := [w for w in distinct if w not in known]:
            self._learn(new)
        at = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        start = np.where(at > 0, self.ends[at - 1], 0)
        n = self.ends[at] - start
        which = parts.indices.to_numpy().reshape(2, -1).T
        return start[which], n[which], self.ids

    def _parts(self, words: pa.Array) -> list[pa.Array]:
        stem = pc.utf8_rtrim(words, self.MARKS)
        plain = pc.match_substring_regex(stem, f"^[{self.LETTERS}{self.LETTERS.upper().replace('SS', '')}]+$")
        marks = pc.utf8_ltrim(pc.utf8_lower(words), self.LETTERS)
        return [pc.if_else(plain, pc.utf8_lower(stem), words), pc.if_else(plain, marks, "")]

    def _spelt(self, part: str) -> str | None:
        """A part of plain letters in the tokenizer's letters for bytes, ready to be merged; None for any other."""
        if part.isascii() and part.isalpha() and part.islower():
            return part
        return part.translate(self.spelling) if part and self.letters.issuperset(part) else None

    def _learn(self, parts: list[str]) -> None:
        """Plain letters are merged as they are; others take the whole tokenizer."""
        merge, spelt = self.tokenizer.model.tokenize, self._spelt
        found: list[list[int]] = [[]] * len(parts)
        other = []
        for i, w in enumerate(parts):
            if (s := spelt(w)) is not None:
                found[i] = [t.id for t in merge(s)]
            else:
                other.append(i)
        for k in range(0, len(other), 1000):
            some = other[k : k + 1000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([parts[i] for i in some], add_special_tokens=False)):
                found[i] = e.ids
        first = len(self.known)
        n = np.fromiter(map(len, found), np.int64, len(found))
        begin = int(self.ends[first - 1]) if first else 0
        end = begin + int(n.sum())
        if end > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(end, np.uint32))
        self.ids[begin:end] = np.fromiter(chain.from_iterable(found), np.uint32, end - begin)
        self.ends[first : first + len(parts)] = begin + np.cumsum(n)
        self.known.update(zip(parts, range(first, first + len(parts))))


def _gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges flat[start : start + n], one after the other."""
    return flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def encode_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text's ids and end mark, cut only where longer than capacity.

    The tokenizer never joins characters across a blank, so the ids of blank-separated words come from a table. Arrow
    splits the texts and numbers their distinct words; Python sees each distinct word of a batch once."""
    path = path or tokenizer_path()

    def encoded(batches):
        table = WordTable.of_worker(path)
        for batch in pieces(batches, limit=1 << 20):
            split = pc.ascii_split_whitespace(pc.fill_null(batch.column("text").cast(pa.string()), ""))
            words = split.flatten().dictionary_encode()
            which = words.indices.to_numpy()
            begin, n, flat = table.encode(words.dictionary)
            begin, n = begin[which].ravel(), n[which].ravel()
            ids = _gather(flat, begin, n)
            words_before = split.offsets.to_numpy().astype(np.int64)
            ends = np.append(0, np.cumsum(n))[2 * (words_before[1:] - words_before[0])]
            ids = np.insert(ids, ends, END_ID).astype("<u4")
            ends = ends + np.arange(1, len(ends) + 1)
            total = np.diff(ends, prepend=0)
            cuts = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(total[row] - start, capacity)
            begin = (ends - total)[row] + start
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[a:b]) for a, b in zip((4 * begin).tolist(), (4 * (begin + length)).tolist())]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(encoded, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(length: np.ndarray, n: np.ndarray, gap: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """One matching of documents with gaps; both are runs sorted by size. Returns for each piece of a matched run its
    document run, place in that run, gap run, place in that run, and number."""
    gaps_before = np.cumsum(count) - count
    total = int(count.sum())
    rank = np.cumsum(n) - n
    # successor of each length: how many gaps are too small for it
    smaller = np.append(gaps_before, total)[np.searchsorted(gap, length)]
    # conflicts: a run starts at its successor, or where the runs before it have pushed it to
    begin = rank + np.maximum.accumulate(smaller - rank)
    end = np.minimum(begin + n, total)
    cuts = np.unique(np.concatenate([begin[begin < total], end, gaps_before, [total]]))
    at, size = cuts[:-1], np.diff(cuts)
    doc = np.maximum(np.searchsorted(begin, at, "right") - 1, 0)
    held = (at >= begin[doc]) & (at < end[doc])
    at, size, doc = at[held], size[held], doc[held]
    run = np.searchsorted(gaps_before, at, "right") - 1
    return doc, at - begin[doc], run, at - gaps_before[run], size


def match_runs(length: np.ndarray, n: np.ndarray, capacity: int = CAPACITY, ratio: float = RATIO) -> np.ndarray:
    """Places every document of a length table. Rows: length, first rank in its length, number, first sequence, offset;
    consecutive ranks lie in consecutive sequences at the same offset.

    Lengths are taken in ranges from the largest down, each down to ``ratio`` of its largest. In a range, rounds go on
    until nothing in it fits; what is left then gets as many new sequences as its tokens need."""
    order = np.argsort(length)
    length, n = length[order].astype(np.int64), n[order].astype(np.int64)
    done = np.zeros(len(length), np.int64)  # documents of each length placed so far
    gap, first, count = (np.zeros(0, np.int64) for _ in range(3))
    bins, out = 0, []
    high = len(length)
    while high:
        low = int(np.searchsorted(length, int(length[high - 1] * ratio), "right"))
        low = min(low, high - 1)
        while True:
            left = n[low:high] - done[low:high]
            if not left.any():
                break
            fits = np.flatnonzero((left > 0) & (length[low:high] <= (gap[-1] if len(gap) else 0))) + low
            if not len(fits):
                more = -(-int((left * length[low:high]).sum()) // capacity)
                gap, first, count = (np.append(x, v) for x, v in ((gap, capacity), (first, bins), (count, more)))
                bins += more
                continue
            usable = int(np.searchsorted(gap, length[fits[0]]))
            room = int(count[usable:].sum())
            asked = n[fits] - done[fits]
            over = np.maximum(np.cumsum(asked[::-1])[::-1] - room, 0)  # the largest documents first, one a gap
            take = np.maximum(asked - over, 0)
            fits, take = fits[take > 0], take[take > 0]
            doc, place, run, inside, size = sweep(length[fits], take, gap[usable:], count[usable:])
            doc, run = fits[doc], run + usable
            start = first[run] + inside
            # ranks in a length are given out in the order of placing
            by = np.lexsort((place, doc))
            doc, run, start, size, inside = doc[by], run[by], start[by], size[by], inside[by]
            rank = np.cumsum(size) - size
            head = np.searchsorted(doc, doc)
            rank = rank - rank[head] + done[doc]
            out.append(np.column_stack([length[doc], rank, size, start, capacity - gap[run]]))
            np.add.at(done, doc, size)
            # gaps that took a document shrink; the rest of their runs stays
            points = np.lexsort((inside, run))
            r, i, z, d = run[points], inside[points], size[points], doc[points]
            new = [(gap[r] - length[d], first[r] + i, z)]
            last = np.flatnonzero(np.append(r[1:] != r[:-1], True))
            new.append((gap[r[last]], first[r[last]] + i[last] + z[last], count[r[last]] - i[last] - z[last]))
            before = np.where(np.append(True, r[1:] != r[:-1]), 0, np.append(0, (i + z)[:-1]))
            new.append((gap[r], first[r] + before, i - before))
            touched = np.ones(len(gap), bool)
            touched[r] = False
            new.append((gap[touched], first[touched], count[touched]))
            gap, first, count = (np.concatenate(c) for c in zip(*new))
            real = (count > 0) & (gap > 0)
            by = np.lexsort((first[real], gap[real]))
            gap, first, count = gap[real][by], first[real][by], count[real][by]
            if len(gap):
                joins = np.append(False, (gap[1:] == gap[:-1]) & (first[1:] == first[:-1] + count[:-1]))
                count = np.add.reduceat(count, np.flatnonzero(~joins))
                gap, first = gap[~joins], first[~joins]
        high = low
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def place_runs(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """length, rank0, rank1, bin0, offset: runs that place every document of a table (length, n), which has at most
    ``capacity`` rows."""

    def matched(batches):
        tables = [(b.column("length").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if tables:
            rows = match_runs(*(np.concatenate(c) for c in zip(*tables)), capacity)
            yield pa.record_batch([pa.array(c) for c in (rows[:, 0], rows[:, 1], rows[:, 1] + rows[:, 2] - 1, rows[:, 3], rows[:, 4])], ["length", "rank0", "rank1", "bin0", "offset"])

    return lengths.coalesce(1).mapInArrow(matched, "length long, rank0 long, rank1 long, bin0 long, offset long")


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece of a document."""
    cut = written(encode_pieces(docs, path, capacity))
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    joined = join_runs(ranked(cut, "length", ["doc_id", "piece", "start", "ids_crc32"]), "length", written(place_runs(lengths, capacity)), "rank0", "rank1")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin0") + F.col("rank") - F.col("rank0")).alias("sequence_id"), "offset")
