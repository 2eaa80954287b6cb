"""Text quality by a factorisation machine.

Inputs are hashed words (each word's core and the signs around it), statistics of
structure, and the row's own length field as metadata. The pairwise term
sum_{i<j} <v_i, v_j> x_i x_j is scored in linear time as half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). The model is fitted with Adam on the
logistic loss over a bounded sample of labelled rows and sent to the tasks, which score
whole texts in chunks.

Defined results: a null text is empty; a text without words is scored from its
statistics; a null length field counts as the text's own length; repeated rows get the
same score; without labelled rows of both classes every score is the share of label 1
(0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlog.llm.common import released, slices, with_text
from fathomlog.llm.training import fitted, sample_of
from fathomlog.llm.word_bpe import split_words

BUCKETS, RANK = 4096, 8
#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 2000
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STATISTICS = 12

# Kinds of bytes: 1 lower case, 2 upper case, 3 digit, 4 sign, 5 white space, 6 beyond ASCII, 7 line end, 0 other.
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_KIND[[*b"0123456789"]] = 3
_KIND[[*_SIGNS.encode()]] = 4
_KIND[[*b" \t\r\f\v"]] = 5
_KIND[128:] = 6
_KIND[10] = 7


def features(texts: pa.Array, lengths: pa.Array) -> np.ndarray:
    """Row per text: word frequencies by bucket (unit length), then ``STATISTICS`` raw statistics."""
    n = len(texts)
    offsets, positions, words = split_words(texts)
    core, around = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for i, word in enumerate(words.to_pylist()):
        low = word.lower()
        inner = low.strip(_SIGNS)
        core[i] = zlib.crc32(inner.encode()) % BUCKETS
        around[i] = -1 if len(inner) == len(word) else zlib.crc32(b"\0" + low.replace(inner, "", 1).encode()) % BUCKETS
    counts = np.diff(offsets)
    row = np.repeat(np.arange(n), counts)
    signed = around[positions]
    cells = np.concatenate((row * BUCKETS + core[positions], (row * BUCKETS + signed)[signed >= 0]))
    x = np.bincount(cells, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    distinct = (x > 0).sum(axis=1)
    x = np.log1p(x)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-6)

    raw = [t.encode() for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, raw), np.int64, n)
    kinds = np.zeros((n, 8))
    signs = np.zeros(n)  # signs that follow a sign
    for i, text in enumerate(raw):
        if text:
            kind = _KIND[np.frombuffer(text, np.uint8)]
            kinds[i] = np.bincount(kind, minlength=8)
            signs[i] = np.count_nonzero((kind[1:] == 4) & (kind[:-1] == 4))
    lines = [t.splitlines() for t in texts.to_pylist()]
    held = np.fromiter((len(v) for v in lines), np.float64, n)
    same = np.fromiter((len(v) - len(set(v)) for v in lines), np.float64, n)
    size = np.maximum(sizes, 1)
    stated = np.where(np.isnan(got := lengths.to_numpy(zero_copy_only=False).astype(np.float64)), [len(t) for t in texts.to_pylist()], got)
    stats = np.column_stack(
        (
            kinds[:, 1:5] / size[:, None],
            kinds[:, 6] / size,
            signs / np.maximum(counts, 1),
            np.log1p(counts),
            sizes / np.maximum(counts, 1) / 10,
            distinct / np.maximum(counts, 1),
            np.log1p(sizes / np.maximum(held, 1)),
            same / np.maximum(held, 1),
            np.log1p(np.maximum(stated, 0)),
        )
    )
    return np.hstack((x, np.clip(stats, 0, 20).astype(np.float32)))


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def prepared(self, x: np.ndarray) -> np.ndarray:
        stats = np.clip((x[:, BUCKETS:] - self.mean) / self.scale, -4, 4) * np.float32(0.25)
        return np.hstack((x[:, :BUCKETS], stats)).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.prepared(x)
        sums = z @ self.factors
        logit = self.bias + z @ self.weights + 0.5 * ((sums * sums).sum(axis=1) - (z * z) @ (self.factors * self.factors).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, epochs: int = 8, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> FactorisationMachine:
    """Adam on the logistic loss, classes weighted alike."""
    share = float(y.mean()) if len(y) else 0.5
    mean, scale = (x[:, BUCKETS:].mean(axis=0), x[:, BUCKETS:].std(axis=0) + 1e-3) if len(y) else (np.zeros(STATISTICS), np.ones(STATISTICS))
    d = BUCKETS + STATISTICS
    if share in (0.0, 1.0) or not len(y):
        odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
        return FactorisationMachine(float(odds), np.zeros(d, np.float32), np.zeros((d, RANK), np.float32), mean, scale)
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(0.0, np.zeros(d, np.float32), rng.normal(0, 0.02, (d, RANK)).astype(np.float32), mean.astype(np.float32), scale.astype(np.float32))
    z = model.prepared(x)
    values = [np.zeros(1, np.float32), model.weights, model.factors]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    importance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        size = min(64, max(8, len(y) // 16))
        for at in range(0, len(y), size):
            some = order[at : at + size]
            b, target = z[some], y[some]
            bias, w, v = values
            sums = b @ v
            squares = b * b
            logit = bias[0] + b @ w + 0.5 * ((sums * sums).sum(axis=1) - squares @ (v * v).sum(axis=1))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) * importance[some] / len(some)
            error = error.astype(np.float32)
            grads = [error.sum(keepdims=True), b.T @ error + decay * w, b.T @ (error[:, None] * sums) - v * (squares.T @ error)[:, None] + decay * v]
            step += 1
            for k in range(3):
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                values[k] = (values[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return FactorisationMachine(float(values[0][0]), values[1], values[2], model.mean, model.scale)


def train(documents: DataFrame, labels: DataFrame, allowed: Column, *, label: str = "quality", length_col: str = "n_chars", per_class: int = PER_CLASS) -> FactorisationMachine:
    """A model of ``label`` from at most ``2 * per_class`` rows that ``allowed`` (a column over ``labels``) admits."""
    sample = sample_of(documents, labels, label, allowed, per_class=per_class, columns=("text", length_col))

    def learn(rows: list[tuple]) -> FactorisationMachine:
        texts, lengths = pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())
        parts = [features(texts[at : at + 500], lengths[at : at + 500]) for at in range(0, len(rows), 500)]
        x = np.vstack(parts) if parts else np.zeros((0, BUCKETS + STATISTICS), np.float32)
        return fit(x, np.array([r[0] for r in rows], np.float32))

    return fitted(sample, learn)


def score(documents: DataFrame, model: FactorisationMachine, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """(id, score) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed size
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = shared.value.score(features(part.column("text"), part.column("length")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores)], ["id", "score"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(length_col).cast("double").alias("length"))
    return with_text(rows, "text").mapInArrow(released(run), f"id {kind}, score double").withColumnRenamed("id", id_col)
