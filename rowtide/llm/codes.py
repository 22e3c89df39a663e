"""Compression of vectors to codes: a codebook for each part of a vector, searched as a VA-file, in exact integers.

A vector is cut into equal parts, and each part is replaced by the index of the nearest entry of its position's codebook.
The entries of a codebook are approximated by cells: each coordinate is quantised to a few bits, and a cell knows the
smallest and the largest coordinate in it. A lookup table for each query and coordinate holds the least and the greatest
squared difference from every cell; added up, they bound an entry's distance from below and above. Entries whose lower
bound is over the least upper bound can't be nearest; only the others are refined with integer distances, ties to the
lower index. Bounds are sums of whole numbers, exact in either arithmetic used.

Each training round is one pass in which a task sends a row for each entry at most; only codebooks (``parts`` times
``entries`` rows) and their sums come to the driver. ``df`` is read rounds + 2 times, so it should be a written table; the
codes are written to the shared folder. Sums by label are joined back without sending a frequent label to one task.

Rows whose vector is null, has another number of components, or a null or non-finite one aren't returned. Fewer usable
vectors than entries give codebooks of as many entries as vectors. Of rows with one id, the smaller vector comes first as an entry;
rows without id come last. Repeated rows count as often as they occur; null labels count as one label. Other columns are
ignored, whatever their names. An empty table gives no rows. A component too large for exact 64-bit distances is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import common, vectors

PARTS, ENTRIES, ROUNDS, DIMS, SCALE = 16, 64, 2, 64, 256
#: Bits of a coordinate's cell, and vectors searched together.
BITS, TOGETHER = 3, 4096
_HEX = np.array([f"{k:02x}".encode() for k in range(256)])


class Cells:
    """The approximation of one codebook (entries by coordinates)."""

    def __init__(self, entries: np.ndarray):
        count, width = entries.shape
        cells = 1 << BITS
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0)
        cell = rank * cells // count  # as many entries in each
        self.entries = entries
        self.low, self.high = np.zeros((width, cells), np.int64), np.zeros((width, cells), np.int64)
        self.member = np.zeros((width * cells, count), np.int64)  # cells by entries
        for d in range(width):
            for c in np.unique(cell[:, d]):
                inside = cell[:, d] == c
                self.low[d, c], self.high[d, c] = entries[inside, d].min(), entries[inside, d].max()
                self.member[d * cells + c] = inside
        self.large = int(np.abs(entries).max(initial=0))
        self.member_real = self.member.astype(float)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each query to each entry."""
        below, above = self.low[None] - x[:, :, None], x[:, :, None] - self.high[None]
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(np.abs(below), np.abs(above))
        tables = [(t * t).reshape(len(x), -1) for t in (least, most)]
        # sums below 2^53 are exact as doubles, whose product is faster
        exact = x.shape[1] * 4 * max(self.large, int(np.abs(x).max(initial=0))) ** 2 < 1 << 53
        return tuple(t.astype(float) @ self.member_real if exact else t @ self.member for t in tables)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        apart = x[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        starts = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == best[row])  # by row, then entry
        return entry[hits[np.unique(row[hits], return_index=True)[1]]], best


def encode(x: np.ndarray, books: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vectors by parts) and the squared distances summed over the parts."""
    codes, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    cut = x.reshape(len(x), len(books), x.shape[1] // len(books))
    for at in range(0, len(x), TOGETHER):
        to = min(at + TOGETHER, len(x))
        for p, book in enumerate(books):
            codes[at:to, p], distance = book.nearest(cut[at:to, p])
            error[at:to] += distance
    return codes, error


def totals(df: DataFrame, column: str, codebooks: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each entry has, and the sums of their components; codebooks: parts by entries by coordinates."""
    parts, entries, width = codebooks.shape

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Cells(b) for b in codebooks]
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = vectors.integers(batch.column(0), parts * width, scale)[1]
            codes, _ = encode(x, books)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], x[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), *[pa.array(sums[part, entry, d]) for d in range(width)]], ["part", "entry", "n", *[f"s{d}" for d in range(width)]])

    found = df.select(column).mapInArrow(fold, "part int, entry int, n long" + "".join(f", s{d} long" for d in range(width)))
    n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for part, entry, count, *s in found.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(f"s{d}") for d in range(width)]).collect():
        n[part, entry], sums[part, entry] = count, s
    return n, sums


def fit(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, key: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """The codebooks (parts by entries by coordinates) after ``rounds`` rounds from the vectors with the smallest ids."""
    first = vectors.first_vectors(df, column, [F.col(key).asc_nulls_last()], entries, dims, scale)
    codebooks = first.reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        n, sums = totals(df, column, codebooks, scale)
        codebooks = np.where(n[:, :, None] > 0, sums // np.maximum(n, 1)[:, :, None], codebooks)
    return codebooks


def coded(df: DataFrame, codebooks: np.ndarray, scale: int = SCALE, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of every usable vector."""
    parts, entries, width = codebooks.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Cells(b) for b in codebooks]
        for batch in batches:
            rows, x = vectors.integers(batch.column(2), parts * width, scale)
            codes, error = encode(x, books)
            text = _HEX[codes].view(f"S{2 * parts}").ravel() if len(x) else np.zeros(0, "S1")
            kept = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(text.astype(str), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    found = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), column)
    schema = f"vec_id long, label {found.schema['label'].dataType.simpleString()}, code string, error long"
    return found.mapInArrow(assign, schema) if entries else df.sparkSession.createDataFrame([], schema)


def decoded(codes: DataFrame, codebooks: np.ndarray, code: str = "code") -> DataFrame:
    """Adds ``vector``, the integers that each code stands for; a null code gives null."""
    books = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in codebooks])
    at = F.transform(F.sequence(F.lit(0), F.lit(len(codebooks) - 1)), lambda p: books[p][F.conv(F.substring(F.col(code), 2 * p + 1, F.lit(2)), 16, 10).cast("int")])
    return codes.withColumn("vector", F.when(F.col(code).isNotNull(), F.flatten(at)))


def compressed(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Codes of all usable vectors with their error, the error summed over their label, and the digest of the codebooks."""
    codebooks = fit(df, parts, entries, rounds, dims, scale)
    digest = sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    key = [F.col("label").isNull().alias("__none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("__label")]
    rows = common.staged(coded(df, codebooks, scale).select("*", *key).drop("label"))
    sums = rows.groupBy("__none", "__label").agg(F.sum("error").alias("label_error"))
    found = common.joined_evenly(rows, sums, ["__none", "__label"])
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(common.table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    width = DIMS // PARTS
    near = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
        FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"""q AS (SELECT n, part, w[{width} * part + 1 : {width} * part + {width}] AS v FROM kept, range({PARTS}) AS t(part))""",
        f"""first AS (SELECT n, row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES})""",
        """c0 AS (SELECT part, entry, v AS c FROM first JOIN q USING (n))""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT n, part, min({{'distance': CAST({near} AS BIGINT), 'entry': entry}}) AS own FROM q JOIN c{k} USING (part) GROUP BY n, part)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT part, own.entry AS entry, dim, sum(x) AS s, count(*) AS m FROM a{k} JOIN
            (SELECT n, part, unnest(v) AS x, unnest(range({width})) AS dim FROM q) USING (n, part) GROUP BY ALL)""")
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(any_value(m), any_value(c)) AS c FROM c{k} LEFT JOIN
            (SELECT part, entry, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY dim) AS m FROM s{k} GROUP BY part, entry) USING (part, entry) GROUP BY part, entry)""")
    return f"""WITH {", ".join(steps)}, coded AS (SELECT n, string_agg(printf('%02x', own.entry), '' ORDER BY part) AS code, CAST(sum(own.distance) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY n),
    book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (n), book"""


OP13_SQL = _sql()
