"""Toxicity by a misspelling-tolerant lexicon and the context of each hit.

Terms are learned from every labelled row outside the held-out fold: words whose labelled mentions are nearly all in
marked texts. The terms form a trie; Levenshtein automata of the terms (none below four letters, one edit from four,
two from eight; a swap of neighbours counts as one) are intersected with it and determinised into one transition
table. All words of a piece of text run through that table together, one letter per step, so a word that can be no
misspelling dies after a few steps. A hit gets a score from its context window: hits inside quotation marks and hits
next to words that the labelled texts show around harmless mentions count for less. A logistic curve over the hit
counts and window scores, fitted on a bounded sample of labelled rows, gives the score.

A hit is quoted if within the context window the nearest quotation mark before it opens and the nearest one of the same
kind after it closes. A mark opens where no letter or digit is before it and closes where none is after it, so an
apostrophe inside a word is no mark.

Bounds (parameters): the lexicon holds at most ``max_terms`` terms, of 2 to 64 characters, the surest first; the curve
and the contexts are fitted on at most ``max_per_class`` texts of each label and ``max_bytes`` of text.

Cases: a null or empty text has no hits and gets the score of such texts; without labelled rows every score is 0.0,
with one class only it is that class's share; repeated rows are scored alike; columns other than ``doc_id`` and
``text`` (of labels ``doc_id`` and ``toxic``) are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, crc_of_id, pieces, remove_tables, word_hashes, written
from .quality_classifier import labelled_sample, logistic_fit

MAX_PER_CLASS = 4000
MAX_BYTES = 16 << 20
MAX_TERMS = 2000
#: Labels that are broadcast at most (16 bytes each).
BROADCAST_LABELS = 1 << 21
WINDOW = 4
CONTEXT_SLOTS = 1 << 12
#: Kinds of quotation marks, each read as its plain form.
DOUBLE, SINGLE = "«»„“”‟＂", "‘’‚‛‹›`´"
OTHER_MARKS = "…–—‐‑‒•·¡¿"


def mentions(docs: DataFrame, labels: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """w, n, k: how many different contexts (the word before) each word of the labelled rows has, and how many of these in
    marked texts, so that copies of one passage count once; a context that occurs under both labels counts under both.
    Every labelled row outside the held-out fold is counted, and contexts are told apart by 63 bits of hash, so that counts
    are right at any size. A word's contexts are dealt over all partitions before they are added up.

    Up to ``broadcast_labels`` labels are broadcast; more meet the texts by shuffling both."""
    fold = labels.where(F.col("toxic").isNotNull() & (crc_of_id(F.col("doc_id")) % 5 != 0)).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y")).distinct()
    words = F.split(F.lower(F.regexp_replace("_text", r"[^\p{L}\p{N}\s]+", " ")), r"\s+")
    few = fold.limit(broadcast_labels + 1).count() <= broadcast_labels
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(fold) if few else fold.hint("shuffle_hash"), "_id").select("_y", words.alias("w"))
    marked = (F.col("_y") == 1).cast("long")
    context = F.transform("w", lambda x, i: F.xxhash64(F.coalesce(F.get("w", i - 1), F.lit(""))).bitwiseAND(F.lit(-2)).bitwiseOR(marked))
    each = rows.select(F.explode(F.arrays_zip(F.col("w"), context.alias("c"))).alias("x")).select(F.col("x")["w"].alias("w"), F.col("x")["c"].alias("c"))
    different = each.where((F.length("w") >= 2) & (F.length("w") <= 64)).distinct()
    return different.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c").bitwiseAND(F.lit(1))).alias("k"))


def learn_terms(docs: DataFrame, labels: DataFrame, min_contexts: int = 4, least: float = 0.5, max_terms: int = MAX_TERMS) -> list[str]:
    """Words whose share of contexts in marked texts has a lower confidence bound of ``least`` or more. A stem (written
    ``abc*``) of three to eight letters with four or more forms is judged by the mentions of all its forms. The surest
    come first, at most max_terms (a bound on the compiled table)."""
    seen = written(mentions(docs, labels))
    stems = seen.select("n", "k", F.explode(F.transform(F.sequence(F.lit(3), F.least(F.lit(8), F.greatest(F.lit(3), F.length("w")))), lambda m: F.concat(F.substr("w", F.lit(1), m), F.lit("*")))).alias("w"))
    stems = stems.groupBy("w").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("forms")).where("forms >= 4").drop("forms")
    total = seen.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    if not total["n"] or not total["k"]:
        return []
    base = total["k"] / total["n"]
    n, rate, z = F.col("n"), F.col("k") / F.col("n"), 3.0
    z2 = z * z
    low = (rate + z2 / (2 * n) - z * F.sqrt(rate * (1 - rate) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    found = seen.unionByName(stems).withColumn("low", low).where((n >= min_contexts) & (low > F.when(F.col("w").endswith("*"), 0.65).otherwise(max(least, base))))
    ranked = [r["w"] for r in found.orderBy(F.col("low").desc(), F.length("w").desc(), "w").limit(max_terms).collect()]
    remove_tables(seen)
    # of a word and its stems that mean the same mentions, the surest stays
    kept: list[str] = []
    for w in ranked:
        if not any(w.startswith(v[:-1]) if v.endswith("*") else w.endswith("*") and v.startswith(w[:-1]) for v in kept) and not (w.endswith("*") and any(v.endswith("*") and v[:-1].startswith(w[:-1]) for v in kept)):
            kept.append(w)
    return kept


def compile_automaton(terms: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Intersects the terms' Levenshtein automata with their trie. Returns letter classes (0: any other letter), the
    transition table [state, class] (state 0 is dead, 1 the start) and per state the fewest edits to a term, or -1."""
    letters = {c: i + 1 for i, c in enumerate(sorted({c for t in terms for c in t} - {"*"}))}
    children: list[dict[str, int]] = [{}]
    ends: dict[int, str] = {}
    for term in terms:
        node = 0
        for c in term.removesuffix("*"):
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = min(ends.get(node, term), term)
    budget = [0] * len(children)  # the most edits that any term below a node allows
    for node in reversed(range(len(children))):
        budget[node] = max([_edits(ends[node])] if node in ends else [0])
        for child in children[node].values():
            budget[node] = max(budget[node], budget[child])

    # A position is (node, edits, letter owed by a swap or ""); deletions of term letters are followed at once.
    def closed(items: set) -> frozenset:
        best: dict[tuple, int] = {}
        todo = list(items)
        while todo:
            node, e, owed = todo.pop()
            if node >= 0 and e > budget[node] or best.get((node, owed), 99) <= e:
                continue
            best[node, owed] = e
            if not owed and node < 0:
                continue
            if not owed and ends.get(node, "").endswith("*") and e <= _edits(ends[node]):
                todo.append((-1, e, ""))  # past a stem any letters may follow
            if not owed:
                todo += [(child, e + 1, "") for child in children[node].values()]
        return frozenset((n, e, o) for (n, o), e in best.items())

    def step(state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e, owed in state:
            if owed:
                if c == owed:
                    out.add((node, e, ""))
                continue
            if node < 0:
                out.add((node, e, ""))
                continue
            out.add((node, e + 1, ""))
            for d, child in children[node].items():
                out.add((child, e + (c != d), ""))
                if c in children[child]:
                    out.add((children[child][c], e + 1, d))
        return closed(out)

    start = closed({(0, 0, "")})
    number, order, rows = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters) + 1)]
    for state in order:
        row = []
        for c in ["", *letters]:
            after = step(state, c)
            if after not in number:
                number[after] = len(number)
                order.append(after)
            row.append(number[after])
        rows.append(row)
    accepts = np.full(len(number), -1, np.int8)
    for state, i in number.items():
        costs = [e for n, e, o in state if n < 0 or not o and n in ends and e <= _edits(ends[n])]
        if costs:
            accepts[i] = min(costs)
    return letters, np.array(rows, np.int32), accepts


def plain_marks(text: str) -> str:
    """Typographic quotation marks and dashes as plain ones, so that they belong to no word."""
    if not text.isascii():
        for kind, plain in ((DOUBLE, '"'), (SINGLE, "'"), (OTHER_MARKS, "-")):
            for mark in kind:
                text = text.replace(mark, plain)
    return text


def is_quoted(before: str, after: str) -> bool:
    """Whether a quotation opens in ``before``, is still open at its end, and closes in ``after``."""
    for mark in "\"'":
        here = before + "x" + after  # x stands for the hit
        opens = [i for i, c in enumerate(here) if c == mark and not here[i - 1 : i].isalnum() and not here[i + 1 : i + 2].isspace()]
        closes = [i for i, c in enumerate(here) if c == mark and not here[i + 1 : i + 2].isalnum() and i and not here[i - 1].isspace()]
        at = len(before)
        last = max((i for i in opens if i < at), default=-1)
        if last >= 0 and not any(last < i < at for i in closes) and (end := min((i for i in closes if i > at), default=-1)) > 0 and not any(at < i < end for i in opens):
            return True
    return False


def _edits(term: str) -> int:
    """Edits that a misspelling of the term may have. Stems meet many words, so short ones allow none."""
    if term.endswith("*"):
        return int(len(term) > 8)
    return 2 if len(term) >= 8 else 1 if len(term) >= 4 else 0


class ToxicityModel:
    def __init__(self, terms: list[str]):
        self.terms = terms
        self.letters, self.table, self.accepts = compile_automaton(terms) if terms else ({}, np.zeros((1, 1), np.int32), np.array([-1], np.int8))
        self.longest = max(map(len, terms), default=0) + 2
        self.stems = any(t.endswith("*") for t in terms)
        self.context = np.zeros(CONTEXT_SLOTS)
        self.weights: np.ndarray | None = None
        self.constant = 0.0

    def hits(self, texts: pa.Array):
        """Per hit: its text, edits, whether it is quoted, and the slots of the words around it (-1: none)."""
        folded = pa.array([plain_marks((t or "").lower()) for t in texts.to_pylist()], pa.string())
        words = Words(folded)
        n = len(words.start)
        if not n or not self.terms:
            return words, np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros((0, 2 * WINDOW), np.int64)
        cls = np.zeros(256, np.int32)  # 0: a letter outside the terms; -1: not part of a word
        cls[:128] = -1
        cls[97:123] = 0
        cls[48:58] = 0
        for symbol in b"@$":  # stand-ins for letters
            cls[symbol] = 0
        tail = np.zeros(256, bool)
        tail[0x80:0xC0] = True  # continuation bytes belong to the letter before them
        multi = {}
        for c, k in self.letters.items():
            raw = c.encode()
            if len(raw) == 1:
                cls[raw[0]] = k
            else:
                multi[raw] = k
        code = cls[words.data]
        for raw, k in multi.items():
            at = np.flatnonzero(words.data[: len(words.data) - len(raw) + 1] == raw[0])
            for j in range(1, len(raw)):
                at = at[words.data[at + j] == raw[j]]
            code[at] = k
        # strip marks around each word: first and last byte that is a letter or digit; a stand-in counts only between such
        core = cls >= 0
        core[[*b"@$"]] = False
        part = core[words.data]
        steps = np.concatenate([[0], np.cumsum(part)])
        inner = np.flatnonzero(part)
        has = steps[words.end] > steps[words.start]
        w = np.flatnonzero(has)
        first = inner[steps[words.start[w]]]
        last = inner[steps[words.end[w]] - 1] + 1
        characters = np.concatenate([[0], np.cumsum(~tail[words.data])])
        ok = (characters[last] - characters[first] <= self.longest) | self.stems
        w, first, last = w[ok], first[ok], last[ok]
        state = np.ones(len(w), np.int32)
        at = first.copy()
        live = np.arange(len(w))
        found = np.full(len(w), -1, np.int8)
        while len(live):
            b = at[live]
            skip = tail[words.data[b]]
            now = np.where(skip, state[live], self.table[state[live], np.maximum(code[b], 0)])
            state[live] = now
            at[live] += 1
            done = at[live] >= last[live]
            found[live[done]] = self.accepts[now[done]]
            live = live[(now > 0) & ~done]
        hit = np.flatnonzero(found >= 0)
        index, first, last = w[hit], first[hit], last[hit]
        quoted = np.zeros(len(hit), bool)
        slots = np.full((len(hit), 2 * WINDOW), -1, np.int64)
        near = (word_hashes(words) % np.uint64(CONTEXT_SLOTS)).astype(np.int64) 
        for j, off in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
            at = index + off
            same = (at >= 0) & (at < n)
            same[same] = words.doc[at[same]] == words.doc[index[same]]
            slots[same, j] = near[at[same]]
        for i, k in enumerate(index):  # few: only hits come here
            a, z = words.start[max(words.first[words.doc[k]], k - WINDOW)], words.end[min(words.first[words.doc[k] + 1] - 1, k + WINDOW)]
            before = words.raw[a : first[i]].decode("utf-8", "ignore")
            after = words.raw[last[i] : z].decode("utf-8", "ignore")
            quoted[i] = is_quoted(before, after)
        return words, index, found[hit], quoted, slots

    def features(self, texts: pa.Array) -> np.ndarray:
        words, index, edits, quoted, slots = self.hits(texts)
        n = len(texts)
        doc = words.doc[index] if len(index) else np.zeros(0, np.int64)
        around = np.where(slots >= 0, self.context[np.maximum(slots, 0)], 0).sum(axis=1) if len(index) else np.zeros(0)
        count = lambda mask: np.bincount(doc[mask], minlength=n)[:n]
        best = np.full(n, -6.0)
        np.maximum.at(best, doc, np.clip(around - 3.0 * quoted, -6, 6))
        plain, fuzzy = count(~quoted), count((edits > 0) & ~quoted)
        # a misspelt hit counts like an exact one as far as labels do not tell otherwise (third and fourth)
        return np.column_stack([np.minimum(plain, 3), plain > 0, np.minimum(fuzzy, 3), (fuzzy > 0) & (fuzzy == plain), np.minimum(count(quoted), 3), best])

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        x = np.column_stack([self.features(texts), np.ones(len(texts))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    model = ToxicityModel(learn_terms(docs, labels))
    counts = {r["toxic"]: r["n"] for r in labels.where(crc_of_id(F.col("doc_id")) % 5 != 0).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r["toxic"] is not None}
    if not counts:
        return model
    share = counts.get(1, 0) / sum(counts.values())
    model.constant = share
    sample = labelled_sample(docs, labels, "toxic", max_per_class, max_bytes)
    if not model.terms or not 0 < share < 1 or len({y for *_, y in sample}) < 2:
        return model
    y = np.array([label for *_, label in sample], float)
    parts, at, slot_counts = [], [], np.full((2, CONTEXT_SLOTS), 0.5)
    texts = [t for _, t, _ in sample]
    for i in range(0, len(texts), 500):
        part = pa.array(texts[i : i + 500], pa.string())
        words, index, _, _, slots = model.hits(part)
        label = y[i + words.doc[index]].astype(int)
        # half of the texts teach the contexts, the other half the curve: else contexts known by heart would count too much
        label[(i + words.doc[index]) % 2 == 1] = -1
        for side in (0, 1):
            around = slots[label == side]
            slot_counts[side] += np.bincount(around[around >= 0], minlength=CONTEXT_SLOTS)
        parts.append(part)
        at.append(i)
    # windows of harmless mentions against windows of abuse; rare words are shrunk to no weight
    rates = slot_counts / slot_counts.sum(axis=1, keepdims=True)
    seen = slot_counts.sum(axis=0) - 1
    model.context = np.log(rates[1] / rates[0]) * seen / (seen + 10)
    x = np.concatenate([model.features(p) for p in parts])[1::2]
    y = y[1::2]
    weights = logistic_fit(x, y)
    drawn = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weights[-1] += math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    model.weights = weights
    return model


def detect(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) for every row of docs."""
    shared = spark.sparkContext.broadcast(fit(docs, labels))

    def scored(batches):
        m = shared.value
        for batch in pieces(batches):
            s = m.score(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), F.col("text").alias("text"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
