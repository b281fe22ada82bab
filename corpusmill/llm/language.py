"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's letters are lower-cased, everything else becomes a single blank, and its n-grams of
one to three characters are hashed. A feature is the n-gram's share of the text times its
inverse document frequency, counted over all training documents. Weights are learned by
follow-the-regularised-leader with an elastic net, so most are exactly zero, on a bounded
sample of labelled rows (``TRAIN_ROWS``); a part of the sample that takes no part in training
sets the temperature.

Defined results: a null text, or one without letters, gives ``und`` with score 0, as does any
text when there is nothing to learn from; texts are read whole; equal texts get equal
answers; other columns are kept as they are by :func:`predict`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_batches

BUCKETS = 1 << 16
ORDERS = 3
# Expected number of labelled rows the weights are learned from; the document frequencies use all.
TRAIN_ROWS = 6000
EPOCHS = 3
SCALE = 20.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.02
# Characters of one text whose features are held at once.
BLOCK = 1 << 18
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case letters with single blanks around words; empty if there is no letter."""
    clean = _NOT_LETTERS.sub(" ", text.lower()) if text else ""
    if not clean.isascii():
        # Numbers that are no digits, such as fractions and circled numbers, count as word characters.
        numbers = {c for c in set(clean) if unicodedata.category(c) in ("No", "Nl")}
        if numbers:
            clean = re.sub(" +", " ", clean.translate({ord(c): " " for c in numbers}))
    clean = clean.strip()
    return f" {clean} " if clean else ""


def ngram_buckets(clean: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of every order, in blocks, each n-gram once per occurrence."""
    codes = np.frombuffer(clean.encode("utf-32-le"), np.uint32).astype(np.uint64)
    for start in range(0, len(codes), BLOCK):
        block = codes[start : start + BLOCK + ORDERS - 1]
        first = min(BLOCK, len(codes) - start)
        key = np.zeros(len(block), np.uint64)
        for order in range(ORDERS):
            size = min(first, len(block) - order)
            if size <= 0:
                break
            key = key[:size] * np.uint64(0x100000001B3) + block[order : order + size] + np.uint64(order + 1)
            mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield (mixed >> np.uint64(48)).astype(np.int64)


def features(clean: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(BUCKETS, np.int64)
    for buckets in ngram_buckets(clean):
        counts += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used] / counts.sum() * idf[used] * SCALE


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x classes, with the inverse document frequency multiplied in
    bias: np.ndarray
    temperature: float

    def probabilities(self, clean: str) -> np.ndarray:
        total, n = np.zeros(len(self.classes)), 0
        for buckets in ngram_buckets(clean):
            total += self.weights.take(buckets, axis=0).sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return softmax((total / n + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


class Leader:
    """Follow-the-regularised-leader with per-coordinate rates and elastic-net penalties."""

    def __init__(self, classes: int):
        self.z = np.zeros((BUCKETS + 1, classes))
        self.n = np.zeros((BUCKETS + 1, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        kept = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -kept / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, BUCKETS), np.append(x, 1.0)
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1.0
        gradient = x[:, None] * error[None, :]
        rate = (np.sqrt(self.n[at] + gradient**2) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += gradient - rate * w
        self.n[at] += gradient**2


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the least log loss, by golden-section search on its logarithm."""
    def loss(t: float) -> float:
        scaled = logits / np.exp(t)
        top = scaled.max(axis=1)
        return float(np.mean(top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[np.arange(len(labels)), labels]))

    low, high, ratio = -4.0, 4.0, (np.sqrt(5.0) - 1.0) / 2.0
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2.0))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows of ``texts (text)``; and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if clean := letters(text):
                    seen = np.zeros(BUCKETS, bool)
                    for buckets in ngram_buckets(clean):
                        seen[buckets] = True
                    total += seen
                    n += 1
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array([*used, -1], pa.int64()), pa.array([*total[used], n], pa.int64())], names=["bucket", "n"])

    counts = texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r.bucket: r.n for r in counts.collect()}  # at most one row per bucket
    frequency = np.zeros(BUCKETS, np.int64)
    for bucket, n in found.items():
        if bucket >= 0:
            frequency[bucket] = n
    return frequency, found.get(-1, 0)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from ``labelled (doc_id, text, lang)``; rows without text or label teach nothing."""
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    frequency, n = document_frequencies(rows.select("text"))
    idf = np.log((1.0 + n) / (1.0 + frequency)) + 1.0
    chance = min(1.0, train_rows / max(1, rows.count()))
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def start():
        def extract(batch):
            found = [features(c, idf) if (c := letters(t)) else (np.empty(0, np.int64), np.empty(0)) for t in batch.column(0).to_pylist()]
            return [at for at, _ in found], [x for _, x in found], batch.column(1), batch.column(2)

        return extract

    sample = rows.where(draw < chance).select("text", "lang", F.xxhash64("text", "doc_id").alias("key"))
    sample = map_batches(sample, "at array<int>, x array<double>, lang string, key bigint", start)
    # The sample is bounded, so one task can learn from it; only the weights come to the driver.
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The features stay in the batches' buffers.
        rows = []
        for batch in batches:
            borders = batch.column(0).offsets.to_numpy()
            at, x = batch.column(0).values.to_numpy(), batch.column(1).values.to_numpy()
            labels, keys = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows += [(keys[i], labels[i], at[a:b], x[a:b]) for i, (a, b) in enumerate(zip(borders, borders[1:])) if a < b]
        rows.sort(key=lambda r: r[0])
        names = sorted({r[1] for r in rows})
        if not names:
            return
        data = [(at, x, names.index(lang)) for _, lang, at, x in rows]
        held = data[::5] if len(data) >= 50 else data
        leader = Leader(len(names))
        for _ in range(EPOCHS):
            for i, (at, x, label) in enumerate(data):
                if i % 5 or len(data) < 50:
                    leader.learn(at, x, label)
        weights = leader.weights(slice(None))
        logits = np.array([x @ weights[at] + weights[BUCKETS] for at, x, _ in held])
        temperature = calibrated(logits, np.array([label for _, _, label in held]))
        used = np.flatnonzero(np.any(weights[:BUCKETS] != 0.0, axis=1))
        keys = [*used, BUCKETS, BUCKETS + 1]
        values = [*weights[used], weights[BUCKETS], np.full(len(names), temperature)]
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([list(v) for v in values]), pa.array([names] * len(keys))],
                              names=["at", "w", "names"])

    learned = sample.repartition(1).mapInArrow(learn, "at bigint, w array<double>, names array<string>").collect()
    if not learned:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    names = tuple(learned[0].names)
    weights, rest = np.zeros((BUCKETS, len(names))), {}
    for row in learned:
        if row.at < BUCKETS:
            weights[row.at] = row.w
        else:
            rest[row.at] = np.array(row.w)
    weights = (weights * idf[:, None] * SCALE).astype(np.float32)
    return Model(names, weights, rest[BUCKETS], float(rest[BUCKETS + 1][0]))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability."""
    def answer(text: str | None) -> tuple[str, float]:
        clean = letters(text)
        if not clean or not model.classes:
            return UNKNOWN, 0.0
        chances = model.probabilities(clean)
        best = int(chances.argmax())
        return model.classes[best], float(chances[best])

    @F.pandas_udf("lang string, score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([answer(t) for t in texts], columns=["lang", "score"])

    found = docs.withColumn("_found", identify(F.col(text_col).cast("string")))
    return found.withColumns({lang: F.col("_found.lang"), score: F.col("_found.score")}).drop("_found")
