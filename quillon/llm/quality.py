"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are word n-grams (words and their shapes) hashed into 2**DIM_BITS slots; a document is the set of its
slots with equal weight, scaled to unit length, and its score is the logistic of a sparse dot product.
Training takes a bounded, documented sample of labelled documents to one task, each once, as the numbers of its slots;
the task goes over them for some epochs, each in an order of its own, with per-coordinate FTRL-proximal updates; L1
keeps the slots of incidental words at exactly zero. The model is the weight vector alone, whose size is fixed.

Defined results: null and empty texts have only the bias, learned as the logit of the sample's share of label 1;
without usable labels every score is 0.5; repeated rows are scored each; long texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import values
from quillon.llm.labelled import training_sample

#: Labelled documents to learn from, at most.
SAMPLE = 12_000
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.3
DIM_BITS, EPOCHS = 20, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.01

_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> str:
    """Kind of a token: letter case, digits, or the signs themselves."""
    if not (word[0].isalnum() or word[0] == "_"):
        return word
    kind = "9" if word.isdigit() else "m" if any(c.isdigit() for c in word) else "X" if word.isupper() and len(word) > 1 else "Xx" if word[0].isupper() else "x"
    return kind + ("l" if len(word) > 14 else "")


class Features:
    """Slots of a text; remembers the hashes of words."""

    def __init__(self, most: int = 300_000) -> None:
        self.known: dict[str, tuple[int, int]] = {}
        self.most = most

    def _hashes(self, word: str) -> tuple[int, int]:
        if len(self.known) >= self.most:
            self.known.clear()
        got = self.known[word] = zlib.crc32(word.lower().encode("utf-8", "replace")), zlib.crc32(b"#" + _shape(word).encode("utf-8", "replace"))
        return got

    def slots(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        if not tokens:
            return np.empty(0, np.int64)
        known = self.known
        pairs = np.array([known.get(t) or self._hashes(t) for t in tokens], np.uint64)
        word, shape = pairs[:, 0], pairs[:, 1]
        # Whether a word repeats the one before is a token of its own.
        again = np.r_[np.uint64(0), (word[1:] == word[:-1]).astype(np.uint64)]
        shape = shape + again * np.uint64(1 << 33)
        grams = [word, shape * _MIX + np.uint64(1)]
        if len(tokens) > 1:
            grams += [(word[:-1] * _MIX) ^ (word[1:] + np.uint64(2)), ((shape[:-1] * _MIX) ^ shape[1:]) * _MIX + np.uint64(3)]
        if len(tokens) > 2:
            grams.append((((shape[:-2] * _MIX) ^ shape[1:-1]) * _MIX ^ shape[2:]) * _MIX + np.uint64(4))
        mixed = np.concatenate(grams) * _MIX
        return np.unique((mixed >> np.uint64(64 - DIM_BITS)).astype(np.int64))


class Ftrl:
    """FTRL-proximal for logistic loss over sparse unit-length examples, with an unregularised bias."""

    def __init__(self, dim: int = 1 << DIM_BITS, bias: float = 0.0) -> None:
        self.z, self.n, self.bias, self.bias_n = np.zeros(dim), np.zeros(dim), bias, 1.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, slots: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        x = 1.0 / math.sqrt(len(slots)) if len(slots) else 0.0
        error = sigmoid(self.bias + float(w.sum()) * x) - label
        g = error * x
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / ALPHA
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g
        self.bias_n += error * error
        self.bias -= 0.05 * error / math.sqrt(self.bias_n)


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


@dataclass
class Classifier:
    bias: float
    weights: np.ndarray

    def score(self, slots: np.ndarray) -> float:
        return sigmoid(self.bias + (float(self.weights[slots].sum()) / math.sqrt(len(slots)) if len(slots) else 0.0))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = SAMPLE) -> Classifier:
    """Fit on at most `most` labelled documents outside the held-out fold; the driver gets the weights alone."""
    sample = training_sample(docs, labels, label_col, MODULUS, HELD_OUT, most)
    mean = sample.agg(F.avg("label")).first()[0]
    if mean is None:
        return Classifier(0.0, np.zeros(1 << DIM_BITS, np.float32))
    share = min(max(mean, 0.01), 0.99)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            slots = [features.slots(t).astype("<u4").tobytes() for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.binary()), batch.column(2)], ["id", "slots", "label"])

    examples = sample.select(F.col("id").cast("long"), "text", "label").mapInArrow(hashed, "id long, slots binary, label int")
    ordered = examples.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label", "slots").select("slots", "label")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Ftrl(bias=math.log(share / (1 - share))), []
        for batch in batches:
            held += [(np.frombuffer(slots, "<u4"), label) for slots, label in zip(values(batch.column(0)), values(batch.column(1)))]
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(held)).tolist():
                slots, label = held[i]
                model.update(slots.astype(np.int64), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.weights(slice(None)).astype("<f4").tobytes()], pa.binary())], ["bias", "weights"])

    got = ordered.mapInArrow(train, "bias double, weights binary").first()
    return Classifier(got.bias, np.frombuffer(bytes(got.weights), "<f4").copy())


def score_texts(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (the chance of label 1), a row for each input row. The weights are broadcast: 4 MB, fixed."""
    shipped = docs.sparkSession.sparkContext.broadcast((classifier.bias, classifier.weights.tobytes()))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = shipped.value
        model, features = Classifier(bias, np.frombuffer(weights, np.float32)), Features()
        for batch in batches:
            scores = [model.score(features.slots(t)) for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return source.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
