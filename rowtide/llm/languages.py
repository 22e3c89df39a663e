"""Language identification in two steps: the family first, then the languages of that family against each other.

Features are the shares of hashed byte n-grams (one to three bytes, A-Z lower-cased) of the whole text. A multinomial
logistic regression separates the families; within a family each pair of languages has a linear support vector machine
(squared hinge), and the language with most pairs won is predicted, the sum of margins breaking ties.

Learned from at most ``SAMPLE`` documents a language, those with the smallest hashes of their ids. Texts that are null or
have no letter are ``und`` with score 0, as are all if there is nothing to learn from. Languages that no family lists
are a family each. Repeated rows are judged each; of rows with one doc_id the least text and language are learned from. A
very long text is read by one task; ties between languages go to the first by name. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.llm import common

SAMPLE, BINS = 1200, 2048
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ca", "ro"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
}
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def features(column: pa.Array, bins: int = BINS) -> np.ndarray:
    """A row for each text: square roots of the shares of its n-grams, hashed to ``bins`` places; its length is 1."""
    data, offsets = common.text_buffer(column)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    code, total = _LOWER[data], np.zeros((rows, bins), np.float32)
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * np.uint64(257) + _LOWER[data[n - 1 :]]
        inside = row[: len(code)] == row[n - 1 :]
        place = (((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)).astype(np.int64) % bins
        total += np.bincount(row[: len(code)][inside] * bins + place[inside], minlength=rows * bins).reshape(rows, bins).astype(np.float32)
    return np.sqrt(total / np.maximum(total.sum(1, keepdims=True), 1))


def has_letter(column: pa.Array) -> np.ndarray:
    return np.array([bool(x) and any(map(str.isalpha, x)) for x in column.to_pylist()], bool)


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights (the last is the bias) that minimise squared hinge loss, by accelerated gradient steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = ahead = np.zeros(x.shape[1], x.dtype)
    each = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)  # both sides weigh the same
    rate = 1 / (2 * 2.1 + ridge)
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ridge * ahead - 2 * x.T @ (each * y * gap))
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def logistic(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-5, rounds: int = 200) -> np.ndarray:
    """Weights of a multinomial logistic regression (the last row is the bias), by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = ahead = np.zeros((x.shape[1], classes), x.dtype)
    want = np.eye(classes, dtype=x.dtype)[y]
    each = (1 / np.maximum(np.bincount(y, minlength=classes), 1) / classes).astype(x.dtype)[y][:, None]
    for k in range(rounds):
        new = ahead - 0.9 * (x.T @ (each * (softmax(x @ ahead) - want)) + ridge * ahead)
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


class Identifier:
    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, list[str]] = FAMILIES):
        of = {lang: family for family, some in families.items() for lang in some}
        known = sorted(set(langs))
        self.families = sorted({of.get(x, x) for x in known})
        self.langs = {f: [x for x in known if of.get(x, x) == f] for f in self.families}
        lang = np.array(langs)
        family = np.array([self.families.index(of.get(x, x)) for x in langs], int)
        self.first = logistic(x, family, len(self.families)) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.langs[f], 2):
                some = (lang == a) | (lang == b)
                self.pairs[a, b] = svm(x[some], np.where(lang[some] == a, 1, -1).astype(x.dtype))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        share = softmax(x1 @ self.first) if self.first is not None else np.ones((len(x), 1))
        best = share.argmax(1)
        lang, score = np.full(len(x), "und", object), share.max(1).astype(float)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            names = self.langs[f]
            won, margin = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for i, j in combinations(range(len(names)), 2):
                m = x1[rows] @ self.pairs[names[i], names[j]]
                won[:, i] += m >= 0
                won[:, j] += m < 0
                margin[:, i] += m
                margin[:, j] -= m
            total = won + 0.5 * np.tanh(margin / max(len(names) - 1, 1))
            lang[rows] = np.array(names, object)[total.argmax(1)]
            if len(names) > 1:
                score[rows] *= 1 / (1 + np.exp(-2 * np.sort(margin, axis=1)[:, -1] / (len(names) - 1)))
        return lang, score


def labelled(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, list[str]]:
    """Features and languages of at most ``sample`` documents a language outside the held-out ones."""
    known = docs.select(F.col("doc_id").cast("long"), "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out())
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))  # languages: a few hundred at most
    place = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("at")
    few = known.join(F.broadcast(counts), "lang").select("doc_id", "lang", "n", place).filter(F.col("at") * F.col("n") < 2 * sample + 100)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))).filter(F.col("k") <= sample).select("doc_id", F.col("lang").alias("learn"))
    few = few.groupBy("doc_id").agg(F.min("learn").alias("learn"))
    both = docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null").join(F.broadcast(few), "doc_id")
    both = both.groupBy("doc_id", "learn").agg(F.min("text").alias("text"))  # one row an id: at most ``sample`` rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, 1 << 20):
            x = [r.tobytes() for r in features(batch.column("text")).astype("<f2")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("learn"), pa.array(x, pa.binary())], ["doc_id", "learn", "x"])

    got = both.mapInArrow(run, "doc_id long, learn string, x binary").toArrow().sort_by([("learn", "ascending"), ("doc_id", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f2").reshape(got.num_rows, BINS).astype(np.float32)
    return x, got.column("learn").to_pylist()


def identify(docs: DataFrame, sample: int = SAMPLE, families: dict[str, list[str]] = FAMILIES) -> DataFrame:
    """doc_id, lang_pred and score of every document (doc_id, text); ``lang`` is read for learning only."""
    x, langs = labelled(docs, sample)
    held = docs.sparkSession.sparkContext.broadcast(Identifier(x, langs, families) if langs else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in common.small_batches(batches, 1 << 20):
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if model is not None:
                lang, score = model.predict(features(batch.column("text")))
                no = ~has_letter(batch.column("text"))
                lang[no], score[no] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents")).select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")
