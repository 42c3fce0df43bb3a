"""Benchmark decontamination by the q-gram lemma.

Benchmark items (lower-cased, white space folded) are cut into overlapping patterns of ``pattern`` characters. A text
region that matches a pattern of n characters within k edits shares at least n - q + 1 - k * q character q-grams with
it, all on diagonals (text position minus pattern offset) within k of each other. So hits are counted in diagonal
bands that overlap by k; bands that reach the bound are retained and verified by a banded alignment, which gives the
true edit distance. Nothing within the edit budget is missed.

The benchmark is taken in blocks of at most ``block_chars`` characters, each broadcast by itself; every text is
searched whole against every block.

Items shorter than q characters have no q-gram and no room for an edit: they are found exactly, as whole words.
:func:`clean` does not drop a text for them, as a few letters are no passage.

Cases: null texts and items are empty, and an empty item matches nothing; for patterns too short for the full budget it
is lowered until the bound is 1; repeated rows are reported each; ``doc_id``, ``text`` and ``item_id``,
``text`` are all that is read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

Q = 10
PATTERN = 100
ERROR = 0.08
BAND = 32
BLOCK_CHARS = 1 << 20
FILTER_BITS = 22
BANDS_AT_ONCE = 4096


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the Q characters from each position on, by doubling. A collision only adds a hit."""
    if len(c) < Q:
        return np.zeros(0, np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1)
    two += c[1:]
    four = two[:-2] * np.uint32(0x85EBCA6B)
    four += two[2:]
    eight = four[:-4] * np.uint32(0xC2B2AE35)
    eight += four[4:]
    ten = eight[:-2] * np.uint32(0x27D4EB2F)
    ten += two[8:]
    ten ^= ten >> np.uint32(15)
    ten *= np.uint32(0x165667B1)
    return ten


class Patterns:
    """The patterns of a block of items and a table of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], pattern: int = PATTERN, error: float = ERROR):
        self.item, self.offset, self.text = [], [], []
        self.short: dict[str, list[int]] = {}
        for item, raw in items:
            text = fold(raw)
            if len(text) < Q:
                if text:
                    self.short.setdefault(text, []).append(item)
                continue
            starts = [0] if len(text) <= pattern * 3 // 2 else [*range(0, len(text) - pattern, pattern // 2), len(text) - pattern]
            for s in starts:
                part = text if len(starts) == 1 else text[s : s + pattern]
                self.item.append(item)
                self.offset.append(s)
                self.text.append(codes(part))
        # a look-ahead, so that items that overlap in a text are all found
        longest_first = sorted(self.short, key=lambda t: (-len(t), t))
        self.short_words = [re.compile(r"(?<!\w)(?=(" + "|".join(re.escape(t) for t in longest_first if len(t) == n) + r")(?!\w))") for n in sorted({len(t) for t in self.short})]
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.budget = np.minimum((error * self.size).astype(np.int64), np.maximum((self.size - Q) // Q, 0))
        self.bound = self.size - Q + 1 - self.budget * Q
        grams = [gram_hashes(t) for t in self.text]
        h = np.concatenate([*grams, np.zeros(0, np.uint32)])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hash >> np.uint32(32 - FILTER_BITS)] = True

    def candidates(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, band) of retained regions in one buffer of characters; band b holds diagonals from b * BAND on."""
        h = gram_hashes(c)
        at = np.flatnonzero(self.filter[h >> np.uint32(32 - FILTER_BITS)])
        where = np.searchsorted(self.hash, h[at])
        where[where == len(self.hash)] = 0
        true = self.hash[where] == h[at] if len(self.hash) else np.zeros(len(at), bool)
        at, where = at[true], where[true]
        # the hits of a region lie in a window of a pattern's length and budget; hits in no window with enough go
        if len(at):
            reach = int((self.size + self.budget).max())
            more = np.searchsorted(at, at + reach)
            enough = np.flatnonzero(more - np.arange(len(at)) >= int(self.bound.min()))
            kept = np.cumsum(np.bincount(enough, minlength=len(at) + 1) - np.bincount(more[enough], minlength=len(at) + 1))[:-1] > 0
            at, where = at[kept], where[kept]
        keys = []
        times = self.first[where + 1] - self.first[where]
        ends = np.cumsum(times)
        begin = 0
        while begin < len(at):  # at most some two million hits are held at once
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 2_000_000, "right")))
            t = times[begin:stop]
            entry = np.repeat(self.first[where[begin:stop]], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            p = self.owner[entry]
            d = np.repeat(at[begin:stop], t) - self.place[entry] + BAND * 64
            band = d // BAND
            both = d % BAND < self.budget[p]
            key = np.concatenate([p * (1 << 40) + band, p[both] * (1 << 40) + band[both] - 1])
            keys.append(np.unique(key, return_counts=True))
            begin = stop
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, back = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
        hits = np.bincount(back, np.concatenate([n for _, n in keys]))
        p = key >> 40
        kept = hits >= self.bound[p]
        return p[kept], (key[kept] & ((1 << 40) - 1)) - 64

    def align(self, c: np.ndarray, low: int, high: int, pattern: int, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of the whole pattern against each band, and the position where such an alignment ends. Characters
        outside [low, high), the text that the region belongs to, match nothing."""
        word, k = self.text[pattern], int(self.budget[pattern])
        if len(bands) > BANDS_AT_ONCE:  # a long repetitive text: bounded memory
            parts = [self.align(c, low, high, pattern, bands[i : i + BANDS_AT_ONCE]) for i in range(0, len(bands), BANDS_AT_ONCE)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        start = bands * BAND - k
        width = BAND + 3 * k + 1
        column = np.arange(width)
        cost = np.zeros((len(bands), width), np.int32)
        for i, letter in enumerate(word):
            at = start[:, None] + column + i
            inside = (at >= low) & (at < high)
            differs = ~inside | (c[np.where(inside, at, 0)] != letter)
            nxt = cost + differs
            nxt[:, :-1] = np.minimum(nxt[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(nxt - column, axis=1) + column
        best = cost.argmin(axis=1)
        return cost[np.arange(len(bands)), best], start + best + len(word)


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, pattern: int = PATTERN, error: float = ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_patterns (matched patterns of the item), edits (least), start, end (characters of the folded
    text): one row per text and item that it holds, in part or whole, within the edit budget."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // block_chars))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, item_id long, n_patterns int, edits int, start long, end long"
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Patterns([(r["item_id"], r["text"]) for r in part], pattern, error))

        def searched(batches, shared=shared):
            table = shared.value
            for batch in pieces(batches, limit=1 << 19):
                found: list[list] = [[], [], [], [], [], []]
                texts = [fold(t) for t in batch.column("text").to_pylist()]
                ids = batch.column("doc_id").to_pylist()
                c = codes("\n".join(texts) + "\n")
                first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
                p, band = table.candidates(c)
                # diagonals can begin before the text; the middle of the region tells which text it is in
                middle = np.clip(band * BAND + BAND // 2 + table.size[p] // 2, 0, len(c) - 1)
                doc = np.searchsorted(first, middle, "right") - 1
                best: dict[tuple[int, int], list] = {}
                order = np.lexsort((p, doc))
                runs = np.flatnonzero(np.concatenate([[True], np.diff(doc[order]) != 0]) | np.concatenate([[True], np.diff(p[order]) != 0])) if len(p) else []
                for a, b in zip(runs, [*runs[1:], len(p)]):
                    d, q = int(doc[order[a]]), int(p[order[a]])
                    edits, end = table.align(c, int(first[d]), int(first[d + 1]) - 1, q, band[order[a:b]])
                    at = int(edits.argmin())
                    if edits[at] > table.budget[q]:
                        continue
                    e, stop = int(edits[at]), int(end[at] - first[d])
                    row = best.setdefault((d, table.item[q]), [0, e, stop, stop])
                    row[0] += 1
                    row[1] = min(row[1], e)
                    row[2] = min(row[2], stop - len(table.text[q]))
                    row[3] = max(row[3], stop)
                for words in table.short_words:
                    for d, t in enumerate(texts):
                        for m in words.finditer(t):
                            for item in table.short[m[1]]:
                                row = best.setdefault((d, item), [0, 0, m.start(), m.end(1)])
                                row[0], row[3] = 1, max(row[3], m.end(1))
                for (d, item), row in best.items():
                    for column, value in zip(found, [ids[d], item, row[0], row[1], max(0, row[2]), row[3]]):
                        column.append(value)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "n_patterns", "edits", "start", "end"])

        found = rows.mapInArrow(searched, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark passage of Q or more characters (a row without an id goes if any such row
    holds one)."""
    folded = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    hit = matches(spark, docs, benchmark.where(F.length(folded) >= Q)).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_anti")
