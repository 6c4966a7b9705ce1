"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank is good or bad; its features are its own, the
previous line's and the next line's. The document's raw quality is the mean of
its lines' marginal chance to be good, weighted by their length; a logistic
curve turns it into the chance of label 1.

Fitting: all lines first take their document's label; after a first fit, the
lines of bad documents that look good become good (but the worst line of each
stays bad), and the field is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from . import textkernel as K
from .session import bounded_sample, ready

#: Labelled documents of each label that a fit uses at most (on average; see bounded_sample).
FIT_DOCS = 1500

_CLASSES = 10
_CLASS = np.full(256, 9, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#$%&*@~^`+="]] = 5
_CLASS[[ord(c) for c in "|<>{}[]\\/_"]] = 6
_CLASS[ord("!")] = 7
_CLASS[0x80:0xC0] = 8  # the later bytes of a character
FEATURES = 20


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, lines per row) of all lines that are not blank."""
    rows = len(offsets) - 1
    cuts = np.unique(np.concatenate((np.flatnonzero(raw == 10), offsets[1:] - 1, [-1])))
    starts, ends = cuts[:-1] + 1, cuts[1:] + 1  # an end takes the line feed in
    row = np.searchsorted(offsets, starts, "right") - 1
    first, last, _ = K.words(raw, offsets)
    line = np.searchsorted(starts, first, "right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    used = np.flatnonzero(n_words)
    renumber = np.zeros(len(starts), np.int64)
    renumber[used] = np.arange(len(used))
    size = (ends - starts)[used]
    cls = np.bincount(np.repeat(np.arange(len(starts)), ends - starts) * _CLASSES + _CLASS[raw], minlength=len(starts) * _CLASSES).reshape(-1, _CLASSES)[used].astype(np.float64)
    line, n = renumber[line], n_words[used].astype(np.float64)
    h = K.span_hash(raw, first, last)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    length = (last - first).astype(np.float64)
    head, tail = raw[first], raw[last - 1]
    per_line = lambda x: np.bincount(line, x, len(used))
    at = np.searchsorted(line, np.arange(len(used)))  # first word of each line
    end = np.append(at[1:], len(line)) - 1
    lh = K.mix(np.add.reduceat(K.mix(h + (np.arange(len(h)) - at[line]).astype(np.uint64)), at)) if len(used) else np.zeros(0, np.uint64)
    same = np.zeros(len(used), bool)
    same[1:] = (lh[1:] == lh[:-1]) & (row[used][1:] == row[used][:-1])
    letters = np.maximum(1, cls[:, 0] + cls[:, 1] + cls[:, 9])
    solid = np.maximum(1, size - cls[:, 3])
    z = np.empty((len(used), FEATURES), np.float64)
    z[:, 0] = 1
    z[:, 1] = np.log1p(size)
    z[:, 2] = np.log1p(n)
    z[:, 3] = cls[:, 1] / letters
    z[:, 4] = cls[:, 2] / solid
    z[:, 5] = cls[:, 4] / solid
    z[:, 6] = cls[:, 5] / solid
    z[:, 7] = cls[:, 6] / solid
    z[:, 8] = cls[:, 7] / solid
    z[:, 9] = cls[:, 9] / solid
    z[:, 10] = per_line(again) / n
    z[:, 11] = np.log1p(per_line(length) / n)
    z[:, 12] = per_line((length == 1) & (_CLASS[head] >= 4)) / n  # lone marks
    z[:, 13] = per_line(_CLASS[head] == 1) / n
    z[:, 14] = per_line((_CLASS[tail] >= 5) & (_CLASS[tail] <= 7)) / n  # words that end in a mark
    z[:, 15] = np.isin(tail[end], np.frombuffer(b".!?:", np.uint8)) if len(used) else 0
    z[:, 16] = same
    z[:, 17] = per_line(length > 25) / n
    z[:, 18] = (cls[:, 5] + cls[:, 6] + cls[:, 7] > 0.08 * solid).astype(np.float64)
    z[:, 19] = z[:, 10] > 0.3
    return z, size, np.bincount(row[used], minlength=rows)


@dataclass
class Model:
    chain: crf.Chain
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    bias: float

    def raw_quality(self, z: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        marginals = self.chain.forward_backward(_beside((z - self.mean) / self.scale, lines, self.chain.weights), lines)[0]
        row = np.repeat(np.arange(len(lines)), lines)
        return np.bincount(row, marginals[:, 1] * size, len(lines)) / np.maximum(1, np.bincount(row, size, len(lines)))

    def scores(self, z: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """0 where a document has no line."""
        if not len(z):
            return np.zeros(len(lines))
        return np.where(lines > 0, 1 / (1 + np.exp(-(self.slope * self.raw_quality(z, size, lines) + self.bias))), 0.0)


def _beside(z: np.ndarray, lines: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores from own, previous and next features; a missing neighbour adds nothing."""
    own, before, after = (z @ weights[k * FEATURES : (k + 1) * FEATURES] for k in range(3))
    starts = (np.cumsum(lines) - lines)[lines > 0]
    ends = (np.cumsum(lines) - 1)[lines > 0]
    up, down = np.zeros_like(own), np.zeros_like(own)
    up[1:], down[:-1] = before[:-1], after[1:]
    up[starts], down[ends] = 0, 0
    return own + up + down


def _wide(z: np.ndarray, lines: np.ndarray) -> np.ndarray:
    up, down = np.zeros_like(z), np.zeros_like(z)
    up[1:], down[:-1] = z[:-1], z[1:]
    up[(np.cumsum(lines) - lines)[lines > 0]] = 0
    down[(np.cumsum(lines) - 1)[lines > 0]] = 0
    return np.hstack((z, up, down))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = K.buffer_of(batch.column(1))
        for i, j in K.slices(offs):
            z, size, lines = line_features(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            at = np.concatenate(([0], np.cumsum(lines)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], K.binary_column(z.astype(np.float32), at * FEATURES), K.binary_column(size.astype(np.int64), at)], ["label", "z", "size"])


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = FIT_DOCS) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, label 0 or 1)``; rows without text or label teach nothing.

    At most about 2 * ``per_label`` documents' line features reach the driver.
    Without documents of both labels every text scores 0.5.
    """
    ready(docs.sparkSession)
    sample = bounded_sample(labels.filter("label IN (0, 1) AND doc_id IS NOT NULL"), "label", per_label).select("doc_id", "label")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("length(text) > 0").join(F.broadcast(sample), "doc_id")
    got = sorted(tuple(r) for r in rows.select("label", "text").mapInArrow(_featured, "label int, z binary, size binary").collect())
    got = [(y, np.frombuffer(z, np.float32).reshape(-1, FEATURES).astype(np.float64), np.frombuffer(s, np.int64)) for y, z, s in got if s]
    if len({y for y, _, _ in got}) < 2:
        return Model(crf.Chain(np.zeros((3 * FEATURES, 2)), np.zeros(2), np.zeros((2, 2))), np.zeros(FEATURES), np.ones(FEATURES), 0.0, 0.0)
    label = np.array([y for y, _, _ in got])
    z, size, lines = np.vstack([z for _, z, _ in got]), np.concatenate([s for _, _, s in got]), np.array([len(s) for _, _, s in got])
    mean, scale = z.mean(0), z.std(0) + 1e-6
    mean[0], scale[0] = 0, 1
    wide = _wide((z - mean) / scale, lines)
    doc = np.repeat(np.arange(len(lines)), lines)
    states = label[doc].copy()
    chain = crf.fit(wide, lines, states, 2)
    good = chain.forward_backward(wide @ chain.weights, lines)[0][:, 1]
    worst = np.lexsort((good, doc))[np.cumsum(lines) - lines]
    states[(label[doc] == 0) & (good > 0.5)] = 1
    states[worst[label == 0]] = 0
    model = Model(crf.fit(wide, lines, states, 2), mean, scale, 1.0, 0.0)
    x = np.column_stack((model.raw_quality(z, size, lines), np.ones(len(lines))))
    w = np.zeros(2)
    for _ in range(50):  # Newton steps of a lightly penalised logistic curve
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2)
        w = w + np.linalg.solve(h, x.T @ (label - p) - 0.02 * w)
    model.slope, model.bias = float(w[0]), float(w[1])
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = K.buffer_of(batch.column(batch.num_columns - 1))
        for i, j in K.slices(offs):
            z, size, lines = line_features(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-1], pa.array(model.scores(z, size, lines), pa.float64())], [*batch.schema.names[:-1], "score"])


def score_quality(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with score (0 to 1). A null or blank text scores 0. Other columns are ignored."""
    ready(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _scored(it, model), f"{fields}, score double")
