"""Quality classifier by compression.

Zstandard dictionaries are built from good and from bad labelled texts. A text is compressed whole with either; the
difference of the two compressed sizes, over the text's size and over the smaller compressed size, says which class it
resembles. A logistic curve turns it into a score; it is fitted on the labelled texts in ``FOLDS`` parts, each compressed
with dictionaries of the other parts, so that no text is measured by a dictionary that holds it. The curve also takes how far the text compresses and the logarithm of its size, by which the difference is calibrated for short
and for repetitive texts.

Only a bounded sample of labelled rows is used for fitting (parameters): at most ``max_per_class`` texts of each label,
those with the smallest hash of their id, and ``max_bytes`` of text; of these at most ``dictionary_bytes`` bytes are a
class's dictionary, which takes texts over a sixteenth of that last, so that no single text fills it. Every text of
the table is scored whole.

Cases: a null or empty text has difference 0 and gets the score of an empty text; without labels of both classes
every score is the share of label 1, or 0.5 without any label; repeated rows are scored alike; other columns of
the input are kept out of the way (only ``doc_id`` and ``text`` are read).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, pieces, sample_texts, thinned

MAX_PER_CLASS = 1500
MAX_BYTES = 64 << 20
DICTIONARY_BYTES = 1 << 20
FOLDS = 4
LEVEL = 6


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, max_per_class: int, max_bytes: int = MAX_BYTES) -> list[tuple[int, str, int]]:
    """(id, text, label) of at most max_per_class rows of each label, those with the smallest hash of their id, and of
    these at most max_bytes of text. Rows whose crc32(doc_id) mod 5 is 0 are held out. The narrow label table is thinned
    first, so of the texts only the sample's leave their place."""
    ids = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(target).cast("long").alias("_group")).where(F.col("_group").isin(0, 1) & (crc_of_id(F.col("_id")) % 5 != 0)).distinct()
    few = thinned(ids, F.xxhash64("_id"), max_per_class).collect()
    if not few:
        return []
    few = ids.sparkSession.createDataFrame(few, "_id long, _group long")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    return sample_texts(texts.join(F.broadcast(few), "_id"), max_per_class, max_bytes)


def logistic_fit(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 2.0) -> np.ndarray:
    """Damped Newton steps for a logistic curve on standardised inputs; weights are for x as given, the last is the
    intercept. ridge pulls the weights, not the intercept, to zero."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    scale[scale <= 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    pull = np.append(np.full(x.shape[1], ridge), 1e-6)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0.5, -1, 1) * (z @ w)).sum() + (pull * w**2).sum() / 2)

    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * w)
        rate, now = 1.0, loss(w)
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    out = w.copy()
    out[:-1] = w[:-1] / scale
    out[-1] = w[-1] - (out[:-1] * mean).sum()
    return out


def _features(text: str, good, bad) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0, 0.0, 0.0, 0.0
    g, b = len(good.compress(raw)), len(bad.compress(raw))
    return (b - g) / len(raw), (b - g) / min(b, g), math.log(min(b, g) / len(raw)), math.log(len(raw))


class CompressionModel:
    """Two dictionaries and the weights of the calibrating curve: plain values, sent to the tasks once."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float] | None, constant: float):
        self.good, self.bad, self.weights, self.constant = good, bad, weights, constant

    def compressors(self):
        import zstandard

        made = []
        for raw in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False))
        return made

    def score(self, texts: list[str | None], compressors) -> list[float]:
        if self.weights is None:
            return [self.constant] * len(texts)
        x = np.array([_features(t or "", *compressors) for t in texts]).reshape(len(texts), 4)
        z = np.column_stack([x, np.ones(len(x))]) @ np.array(self.weights)
        return list(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def dictionary(texts: list[str], size: int) -> bytes:
    """Whole texts until the dictionary is full; those over a sixteenth of it last, so that no single one fills it."""
    raw = bytearray()
    for text in sorted(texts, key=lambda t: len(t) > size // 16):
        raw += text.encode("utf-8", "surrogatepass") + b"\n"
        if len(raw) >= size:
            break
    return bytes(raw[:size])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_per_class: int = MAX_PER_CLASS, dictionary_bytes: int = DICTIONARY_BYTES) -> CompressionModel:
    """The curve is calibrated on the sample in parts, each compressed with dictionaries of the other parts; the model's own
    dictionaries are built from all of it. Calibration weighs the classes as they are in the labels."""
    sample = labelled_sample(docs, labels, target, max_per_class)
    if not sample:
        return CompressionModel(b"", b"", None, 0.5)
    counts = {r["_label"]: r["n"] for r in labels.where(crc_of_id(F.col("doc_id")) % 5 != 0).groupBy(F.col(target).alias("_label")).agg(F.count(F.lit(1)).alias("n")).collect() if r["_label"] is not None}
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    texts = {label: [t for _, t, y in sample if y == label and t] for label in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return CompressionModel(b"", b"", None, share)
    folds = min(FOLDS, *map(len, texts.values()))
    x, y = [], []
    for fold in range(folds):
        compressors = CompressionModel(*(dictionary([t for i, t in enumerate(texts[label]) if i % folds != fold], dictionary_bytes) for label in (1, 0)), None, share).compressors()
        for label in (0, 1):
            for text in texts[label][fold::folds]:
                x.append(_features(text, *compressors))
                y.append(float(label))
    x, y = np.array(x), np.array(y)
    weights = logistic_fit(x, y)
    model = CompressionModel(*(dictionary(texts[label], dictionary_bytes) for label in (1, 0)), None, share)
    drawn = min(max(y.mean(), 1e-6), 1 - 1e-6)
    if 0 < share < 1:  # the sample takes both classes alike; the curve is moved to the classes' true shares
        weights[-1] += math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    model.weights = weights.tolist()
    return model


def score(spark: SparkSession, docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id, held_out, score for every row of docs."""
    shared = spark.sparkContext.broadcast(model)

    def scored(batches):
        import zstandard  # noqa: F401

        m = shared.value
        compressors = m.compressors() if m.weights is not None else ()
        for batch in pieces(batches):
            s = m.score(batch.column("text").to_pylist(), compressors)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold)."""
    return score(spark, docs, fit(docs, labels, target)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    shared = spark.sparkContext.broadcast(fit(docs, labels, target))

    def kept(batches):
        m = shared.value
        compressors = m.compressors() if m.weights is not None else ()
        for batch in pieces(batches):
            s = np.array(m.score(batch.column("text").to_pylist(), compressors))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(kept, docs.schema)
