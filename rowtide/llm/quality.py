"""A quality score learned from preferences: Bradley-Terry on features of whole texts.

A preference is a pair of labelled documents of which one has label 1 and the other label 0. The score's weights
minimise the logistic loss of the pairs' feature differences. Scores are then cut at a quantile, that of the share of
label 0 among the learned rows, and moved so that the cut lies at 0.7 of a logistic curve.

Learned from at most ``SAMPLE`` labelled rows (those with the smallest hashes of their ids) and ``PAIRS`` pairs; every
document is scored over its whole text. Null and empty texts have the features of an empty text; a very long text is read
by one task. Without any pair to learn from every score is 0.5. Repeated rows have a score each; of rows with one doc_id
the least text is learned from, and label 1 if the labels differ. Equal texts have equal scores, and a score just at the
cut is predicted 1. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import common

SAMPLE, PAIRS, CUT = 20_000, 60_000, 0.7
#: Classes of bytes; 0 is the rest.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\v\f", ".", ",;:", "!", "?", "|", "#", "$", "%", "&", "*", "\"'`", "()[]{}", "<>=/\\", "-_+~^@"]
_CLASS = np.zeros(256, np.int64)
for _k, _of in enumerate(CLASSES):
    _CLASS[list(_of.encode())] = _k + 1
_CLASS[128:] = len(CLASSES) + 1
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _by_row(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of different spans of each row."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    key = common.span_names(data, starts, ends)[0] ^ common.mixed(row.astype(np.uint64) + np.uint64(1))
    _, at = np.unique(key, return_index=True)
    return np.bincount(row[at], minlength=rows).astype(float)


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text; all are computed over whole texts, a batch at a time."""
    data, offsets = common.text_buffer(column)
    rows, kinds = len(offsets) - 1, len(CLASSES) + 2
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    count = np.bincount(row * kinds + _CLASS[data], minlength=rows * kinds).reshape(rows, kinds)
    ws, we, wf = common.word_spans(data, offsets, _WORD)
    ls, le, lf = common.word_spans(data, offsets, _LINE)
    words, lines = np.diff(wf).astype(float), np.diff(lf).astype(float)
    one = lambda x: np.maximum(x, 1.0)
    last = np.append(data, 0)[np.maximum(we - 1, 0)] if len(we) else np.zeros(0, np.uint8)
    kind, lower = _CLASS[last], np.append(data, 0)[ws] if len(ws) else np.zeros(0, np.uint8)
    length = we - ws
    shares = [np.sqrt(count[:, k] / one(size)) for k in range(kinds)]
    per_word = [np.log1p(count[:, k]) - np.log1p(words) for k in (2, 7, 9, 11)]
    word = [
        _by_row(wf, length) / one(words),
        _by_row(wf, length**2.0) / one(words),
        _by_row(wf, length > 15) / one(words),
        _by_row(wf, length <= 3) / one(words),
        _by_row(wf, length == 1) / one(words),
        _by_row(wf, (kind > 6)) / one(words),
        _by_row(wf, (kind >= 9) & (kind <= 16)) / one(words),
        _by_row(wf, (lower >= 65) & (lower <= 90)) / one(words),
        _distinct(data, ws, we, wf) / one(words),
        _distinct(data, ls, le, lf) / one(lines),
        np.log1p(words),
        np.log1p(lines),
        words / one(lines),
    ]
    return np.stack([*shares, *per_word, *word], axis=1)


class Scorer:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float):
        self.mean, self.scale, self.weights, self.cut = mean, scale, weights, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + np.log(CUT / (1 - CUT)), -40, 40)))


def learn(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3) -> Scorer:
    """Bradley-Terry by Newton steps on the pairs' differences."""
    n = x.shape[1] if x.ndim == 2 else 0
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Scorer(np.zeros(n), np.ones(n), np.zeros(n), 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.clip((x - mean) / scale, -8, 8)
    drawn = np.random.default_rng(0)
    times = min(pairs, 4 * len(good) * len(bad))
    d = z[drawn.choice(good, times)] - z[drawn.choice(bad, times)]
    w = np.zeros(n)
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d.T * (p * (1 - p))) @ d / times + ridge * np.eye(n), d.T @ p / times - ridge * w)
        w += step * min(1, 4 / max(np.abs(step).max(), 1e-9))
    raw = z @ w
    below, above = np.sort(raw)[max(0, len(bad) - 1)], np.sort(raw)[min(len(raw) - 1, len(bad))]
    return Scorer(mean, scale, w, float((below + above) / 2))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled documents outside the held-out ones."""
    some = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, and so is its broadcast
    both = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id")
    both = both.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one row an id, however often it occurs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(features(batch.column("text")).astype("<f8").tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = both.mapInArrow(run, "doc_id long, quality int, x array<double>").toArrow()
    label = got.column("quality").to_numpy()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(label), -1) if len(label) else np.zeros((0, 0))
    order = np.lexsort((*(x.T if x.size else []), got.column("doc_id").to_numpy()))
    return x[order], label[order]


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """All columns of ``docs`` and ``quality_score`` of the whole text, which replaces a column of that name."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    docs = docs.drop("quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            yield batch.append_column("quality_score", pa.array(held.value.score(features(batch.column("text"))), pa.float64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, quality_score double")


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and predicted of every document (doc_id, text)."""
    some = docs.select(F.col("doc_id").cast("long"), "text")
    return scored(some, learn(*labelled(docs, labels, sample))).select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", common.held_out().alias("held_out"), "score", "predicted")
