"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has hashed features: the whole word (lexicon), its prefixes and suffixes of one to three bytes, and its
byte 2-grams and 3-grams. Weights per language and a learned transition matrix give every word a posterior language by
forward-backward, so that code-switched texts are labelled word by word; a text's language is the one with the
largest mean posterior, which is also its score.

Fitting takes a bounded sample of labelled rows (parameters): ``max_per_lang`` texts of each language with the smallest
hash of their row and ``max_bytes`` of text, which are whole texts of any length; ids whose crc32 mod 4 is 2 are held
out. At most ``max_langs`` languages, those with most rows, have a place in the model, whose size grows with them.
Training sequences of 64 words join spans of two texts, so that transitions between languages occur. Every text is
predicted whole and exactly: a piece of texts is cut into blocks of 32 words; the messages between blocks come first, by
products of the blocks' transitions with up to ``PRODUCT_LANGS`` languages and word by word with more; then forward and
backward run inside all blocks at once. Pieces shrink as languages grow (``PIECE_CELLS``), and a text longer than a piece
is read in parts, forward for the messages between parts and backward for the posteriors, so memory is bounded by
neither.

Cases: a null text or one without letters is ``und`` with score 0.0; with one known language every other text gets it;
without any labelled row every text is ``und``; repeated rows are predicted alike; of the input only ``doc_id``,
``text`` and, for fitting, ``lang`` are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, crc_of_id, pieces, range_hashes, sample_texts, thinned

MAX_PER_LANG = 250
MAX_LANGS = 200
MAX_BYTES = 4 << 20
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
SPAN = 64
BLOCK = 32
#: With more languages than this, a block's transition product costs more than going word by word.
PRODUCT_LANGS = 16
#: Bytes of text times languages that a piece may have.
PIECE_CELLS = 32 << 20
BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


def folded(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))


def word_features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, slot) pairs per feature kind; a word shorter than an affix or n-gram has none of that length."""
    data = words.data.astype(np.uint64)
    start, end, index = words.start, words.end, np.arange(len(words.start))
    slot = lambda h, kind: (((h ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
    out = [(index, slot(range_hashes(words.data.astype(np.uint64) + np.uint64(1), start, end, BASES[0]), 1))]
    code = data.copy()
    size = end - start
    inside = np.zeros(len(data) + 1, np.int32)
    inside[start] += 1
    inside[end] -= 1
    inside = np.cumsum(inside)[:-1].astype(bool)
    owner = np.repeat(index, size)
    at = np.flatnonzero(inside)
    left = np.repeat(end, size) - at
    for n in (1, 2, 3):
        if n > 1:
            code[: len(data) - n + 1] = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :]
            whole = left >= n
            out.append((owner[whole], slot(code[at[whole]], 10 + n)))
        long = size >= n
        out.append((index[long], slot(code[start[long]], 20 + n)))
        out.append((index[long], slot(code[end[long] - n], 30 + n)))
    return out


def emissions(words: Words, weights: np.ndarray) -> np.ndarray:
    """Log scores [words, labels]: the sums of the weights of each word's features."""
    columns = np.ascontiguousarray(weights.T, np.float32)  # no copy of a model's weights
    out = np.zeros((len(columns), len(words.start)), np.float32)
    for owner, slots in word_features(words):
        if not len(owner):
            continue
        runs = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for row, column in zip(out, columns):
            row[owner[runs]] += np.add.reduceat(column.take(slots), runs) if len(runs) < len(owner) else column.take(slots)
    return np.ascontiguousarray(out.T)


def _steps(emit: np.ndarray) -> np.ndarray:
    emit = emit - emit.max(axis=1, keepdims=True)
    np.clip(emit, -30, 0, out=emit)
    return np.exp(emit, out=emit).astype(np.float32, copy=False)


def _edges_by_product(step: np.ndarray, a: np.ndarray, first: np.ndarray, real: np.ndarray, where: np.ndarray, block_first: np.ndarray, into: np.ndarray, out_of: np.ndarray) -> None:
    """Fills in the forward message before and the backward message after each block, from each block's product of
    (transition, emission) steps: from the label before it to its last label."""
    nb, k = into.shape
    blocks = np.diff(block_first)
    product = np.broadcast_to(np.eye(k, dtype=np.float32), (nb, k, k)).copy()
    several = np.flatnonzero(np.repeat(blocks, blocks) > 1)  # a text of one block needs no product
    part = product[several]
    for t in range(BLOCK):
        nxt = (part.reshape(-1, k) @ a).reshape(-1, k, k) * step[where[several, t]][:, None, :]
        nxt /= nxt.reshape(-1, k * k).sum(axis=1)[:, None, None]
        part = np.where(real[several, t, None, None], nxt, part)
    product[several] = part
    for b in range(1, int(blocks.max(initial=0))):
        live = block_first[:-1][blocks > b] + b
        v = np.einsum("ij,ijl->il", into[live - 1], product[live - 1])
        into[live] = v / v.sum(axis=1, keepdims=True)
        back = block_first[1:][blocks > b] - 1 - b
        v = np.einsum("ijl,il->ij", product[back + 1], out_of[back + 1])
        out_of[back] = v / v.sum(axis=1, keepdims=True)


def _edges_by_vector(step: np.ndarray, a: np.ndarray, first: np.ndarray, block_first: np.ndarray, into: np.ndarray, out_of: np.ndarray) -> None:
    """The same word by word, for all texts of several blocks at once; no k x k table is made."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > BLOCK]
    if not len(order):
        return
    size, start, block = sizes[order], first[order], block_first[order]
    longer = np.searchsorted(-size, -np.arange(size[0] + 1), "left").tolist()  # how many texts have more than t words
    v = into[block].copy()
    for t in range((int(size[0]) - 1) // BLOCK * BLOCK):
        m = longer[t]
        nxt = (v[:m] @ a) * step[start[:m] + t]
        v[:m] = nxt / nxt.sum(axis=1, keepdims=True)
        if (t + 1) % BLOCK == 0:
            m = longer[t + 1]
            into[block[:m] + (t + 1) // BLOCK] = v[:m]
    v = out_of[block + (size - 1) // BLOCK].copy()
    for t in range(int(size[0]) - 1, BLOCK - 1, -1):
        m = longer[t]
        nxt = (v[:m] * step[start[:m] + t]) @ a.T
        v[:m] = nxt / nxt.sum(axis=1, keepdims=True)
        if t % BLOCK == 0:
            out_of[block[:m] + t // BLOCK - 1] = v[:m]


def posteriors(emit: np.ndarray, first: np.ndarray, move: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each label at each word. emit [words, labels] are log scores, first the index of each text's first
    word (one more than texts), move the log transition scores; before and after: the messages at the ends of the texts,
    if these are parts of longer ones. Exact; scaled at each step."""
    n, k = emit.shape
    if not n:
        return emit
    step = _steps(emit)
    a = np.exp(move - move.max()).astype(np.float32)
    sizes = np.diff(first)
    blocks = -(-sizes // BLOCK)
    block_first = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(block_first[-1])
    text = np.repeat(np.arange(len(sizes)), blocks)
    at = (np.arange(nb) - block_first[text])[:, None] * BLOCK + np.arange(BLOCK)[None]
    real = at < sizes[text][:, None]
    where = np.where(real, at + first[text][:, None], 0)
    into, out_of = np.full((nb, k), 1 / k, np.float32), np.full((nb, k), 1 / k, np.float32)  # forward before, backward after each block
    some = blocks > 0
    if before is not None:
        into[block_first[:-1][some]] = before
    if after is not None:
        out_of[block_first[1:][some] - 1] = after
    if k <= PRODUCT_LANGS:
        _edges_by_product(step, a, first, real, where, block_first, into, out_of)
    else:
        _edges_by_vector(step, a, first, block_first, into, out_of)
    gamma = np.zeros((n, k), np.float32)
    v = into
    for t in range(BLOCK):
        nxt = (v @ a) * step[where[:, t]]
        nxt /= nxt.sum(axis=1, keepdims=True)
        v = np.where(real[:, t, None], nxt, v)
        gamma[where[real[:, t], t]] = v[real[:, t]]
    v = out_of
    for t in range(BLOCK - 1, -1, -1):
        gamma[where[real[:, t], t]] *= v[real[:, t]]
        nxt = (v * step[where[:, t]]) @ a.T
        nxt /= nxt.sum(axis=1, keepdims=True)
        v = np.where(real[:, t, None], nxt, v)
    gamma /= gamma.sum(axis=1, keepdims=True)
    return gamma


def message(emit: np.ndarray, move: np.ndarray, v: np.ndarray, backward: bool = False) -> np.ndarray:
    """The forward message after the words of a part, or the backward message before them, from the one at its other end."""
    step, a = _steps(emit), np.exp(move - move.max()).astype(np.float32)
    for s in step[::-1] if backward else step:
        v = a @ (v * s) if backward else (v @ a) * s
        v = v / v.sum()
    return v.astype(np.float32)


class CrfModel:
    def __init__(self, labels: list[str], weights: np.ndarray, move: np.ndarray):
        self.labels, self.weights, self.move = labels, np.asfortranarray(weights, np.float32), move

    @property
    def piece_bytes(self) -> int:
        return max(1 << 12, min(1 << 20, PIECE_CELLS // max(1, len(self.labels))))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.labels)
        letters = pc.match_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), r"\p{L}").to_numpy(zero_copy_only=False)
        if not k or not n:
            return ["und"] * n, np.zeros(n)
        if n == 1 and k > 1 and (pc.binary_length(texts)[0].as_py() or 0) > self.piece_bytes:
            mean = self._mean_of_long(folded(texts)[0].as_py())[None]
        else:
            words = Words(folded(texts))
            gamma = posteriors(emissions(words, self.weights), words.first, self.move)
            mean = np.stack([np.bincount(words.doc, gamma[:, j], minlength=n) for j in range(k)], axis=1) / np.maximum(1, np.diff(words.first))[:, None]
        best = mean.argmax(axis=1)
        return [self.labels[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, np.clip(mean[np.arange(n), best], 0, 1), 0.0)

    def _mean_of_long(self, text: str) -> np.ndarray:
        """The mean posterior of one text, in parts of whole words."""
        k, size = len(self.labels), self.piece_bytes // 2
        cuts = [0]
        for m in re.finditer(r"[\x20\x09-\x0D]+", text):
            if m.end() - cuts[-1] >= size:
                cuts.append(m.end())
        parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
        emit_of = lambda part: (words := Words(pa.array([part], pa.string())), emissions(words, self.weights))
        before = [np.full(k, 1 / k, np.float32)]
        for part in parts[:-1]:
            before.append(message(emit_of(part)[1], self.move, before[-1]))
        after, total, n = np.full(k, 1 / k, np.float32), np.zeros(k), 0
        for part, v in zip(reversed(parts), reversed(before)):
            words, emit = emit_of(part)
            total += posteriors(emit, words.first, self.move, v, after).sum(axis=0, dtype=float)
            n += len(words.start)
            after = message(emit, self.move, after, backward=True)
        return total / max(1, n)

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, posterior) of each word of one text."""
        words = Words(folded(pa.array([text], pa.string())))
        gamma = posteriors(emissions(words, self.weights), words.first, self.move)
        return [(words.raw[s:e].decode(), self.labels[g.argmax()], float(g.max())) for s, e, g in zip(words.start, words.end, gamma)]


def gradient(emit: np.ndarray, label: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the conditional log-likelihood of labels [sequences, words]: by each word's log score [sequences, words, k] and by
    the transitions [k, k]. Expected transitions are one matrix product; no word has a k x k table."""
    k, span = emit.shape[2], emit.shape[1]
    e, a = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(move - move.max())
    f, b = np.zeros_like(e), np.ones_like(e)
    f[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, span):
        f[:, t] = (f[:, t - 1] @ a) * e[:, t]
        f[:, t] /= f[:, t].sum(axis=1, keepdims=True)
    for t in range(span - 2, -1, -1):
        b[:, t] = (b[:, t + 1] * e[:, t + 1]) @ a.T
        b[:, t] /= b[:, t].sum(axis=1, keepdims=True)
    gamma = f * b
    gamma /= gamma.sum(axis=2, keepdims=True)
    left, right = f[:, :-1].reshape(-1, k), (e * b)[:, 1:].reshape(-1, k)
    expected = a * ((left / ((left @ a) * right).sum(axis=1, keepdims=True)).T @ right)
    observed = np.zeros((k, k))
    np.add.at(observed, (label[:, :-1].ravel(), label[:, 1:].ravel()), 1)
    own = -gamma
    np.put_along_axis(own, label[:, :, None], np.take_along_axis(own, label[:, :, None], 2) + 1, 2)
    return own, observed - expected


def fit(docs: DataFrame, max_per_lang: int = MAX_PER_LANG, max_langs: int = MAX_LANGS, max_bytes: int = MAX_BYTES, epochs: int = 4, seed: int = 7) -> CrfModel:
    """Stochastic gradient steps (per-weight step sizes) on the conditional log-likelihood of 64-word sequences."""
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.col("lang").cast("string").alias("_group")).where(F.col("_group").isNotNull() & F.col("_text").isNotNull() & (crc_of_id(F.col("_id")) % 4 != 2))
    labels = sorted(r["_group"] for r in known.groupBy("_group").count().orderBy(F.col("count").desc(), "_group").limit(max_langs).collect())
    if not labels:
        return CrfModel([], np.zeros((SLOTS, 0)), np.zeros((0, 0)))
    sample = sample_texts(thinned(known, F.xxhash64("_id", "_text"), max_per_lang, labels), max_per_lang, max_bytes)
    sample = sorted(sample, key=lambda r: r[2])  # one language after the other; the hash order stays within
    texts, y = [t for _, t, _ in sample], [labels.index(lang) for *_, lang in sample]
    k = len(labels)
    words = Words(folded(pa.array(texts, pa.string())))
    n = len(words.start)
    weights, move = np.zeros((SLOTS, k)), np.zeros((k, k))
    half = min(SPAN // 2, n // 2)
    if not half or k == 1:
        return CrfModel(labels, weights, move)
    span = 2 * half
    pairs = word_features(words)
    owner = np.concatenate([o for o, _ in pairs])
    slots = np.concatenate([s for _, s in pairs])
    order = np.argsort(owner, kind="stable")
    owner, slots = owner[order], slots[order]
    from_word = np.searchsorted(owner, np.arange(n + 1))
    truth = np.array(y)[words.doc]
    rng = np.random.default_rng(seed)
    g_w, g_m = np.full((SLOTS, k), 1e-2), np.full((k, k), 1e-2)
    for _ in range(epochs):
        starts = rng.permutation(np.arange(0, n - half + 1, half))
        starts = starts[: len(starts) // 2 * 2].reshape(-1, 2)
        for i in range(0, len(starts), 64):
            seq = (starts[i : i + 64, :, None] + np.arange(half)).reshape(-1, span)
            flat = seq.ravel()
            sizes = from_word[flat + 1] - from_word[flat]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            feature = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(from_word[flat], sizes)
            row, slot = np.repeat(np.arange(len(flat)), sizes), slots[feature]
            emit = np.stack([np.bincount(row, weights[slot, j], minlength=len(flat)) for j in range(k)], axis=1).reshape(-1, span, k)
            by_word, by_move = gradient(emit, truth[seq], move)
            error = by_word.reshape(-1, k)
            gm = by_move / len(seq) - 1e-3 * move
            g_m += gm * gm
            move += 0.2 * gm / np.sqrt(g_m)
            used, at = np.unique(slot, return_inverse=True)  # no other weight changes
            gw = np.stack([np.bincount(at, error[row, j], minlength=len(used)) for j in range(k)], axis=1) / len(seq)
            g_w[used] += gw * gw
            weights[used] += 0.1 * gw / np.sqrt(g_w[used])
    return CrfModel(labels, weights, move)


def identify(spark: SparkSession, docs: DataFrame, model: CrfModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    shared = spark.sparkContext.broadcast(model or fit(docs))

    def predicted(batches):
        m = shared.value
        for batch in pieces(batches, limit=m.piece_bytes):
            lang, score = m.predict(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")
