"""Helpers that several operators share: tables, stage tables in the shared folder, distributed ranks, buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where no one has set it, a temporary one in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_rank(df: DataFrame, by: list[str], salt: Column, order: list[Column], rank: str, salts: int | Column = 256) -> DataFrame:
    """Add ``rank`` (long, gapless from 0 within each value of ``by``) without gathering a value's rows in one task.

    Rows are ranked within (by, salt) and moved up by the number of rows of smaller salts. ``by`` must take a bounded
    number of values (lengths, shards): the table of offsets, a row for each value and salt, is then broadcast. ``salts``
    may be a column that follows from ``by``. ``salt`` must depend on the row's own values only, so that a retried task gives the same ranks. ``by`` has no nulls.
    """
    df = df.withColumn("__salt", F.pmod(salt, F.lit(salts) if isinstance(salts, int) else salts).cast("int"))
    before = Window.partitionBy(*by).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*by, "__salt").agg(F.count("*").alias("__n")).withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*by, "__salt").orderBy(*order)
    return df.withColumn("__at", F.row_number().over(within) - 1).join(F.broadcast(offsets), [*by, "__salt"]).withColumn(rank, (F.col("__from") + F.col("__at")).cast("long")).drop("__salt", "__at", "__from")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings or bytes, back to back, and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with ``is_word[byte]`` in each row, and the n + 1 first words of rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    starts = inside[1:] & ~inside[:-1]  # a word starts at byte i
    ends = inside[:-1] & ~inside[1:]  # a word ends before byte i
    cut = offsets[1:-1]  # rows that touch: a run is cut where the next row starts
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut + 1]]
    starts[cut] = True
    ends[cut] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return s, e, np.searchsorted(s, offsets)


def small_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 2 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``max_bytes`` of text (a single larger row is a batch of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.names.index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def id_salt(*columns: str) -> Column:
    return F.xxhash64(*columns)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers whose high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes up to which a span is hashed along with all others; longer ones one by one.
_SHORT = 256
_PART = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number (zeros behind the end)."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", held, 0, (1,))


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the bytes of each span, the same in every process.

    Spans are read eight bytes at a time and mixed after each step; those over ``_SHORT`` bytes have 128 bits of BLAKE2.
    """
    size = ends - starts
    a, b = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), mixed(size.astype(np.uint64) + np.uint64(0x5EED))
    eights, at = _eights(data), np.flatnonzero(size <= _SHORT)
    for k in range(0, _SHORT, 8):
        at = at[size[at] > k] if k else at[size[at] > 0]
        if not len(at):
            break
        x = eights[starts[at] + k] & _PART[np.minimum(size[at] - k, 8)]
        a[at] = mixed(a[at] ^ x)
        y = (b[at] + x) * np.uint64(0xD6E8FEB86659FD93)
        y = (y ^ (y >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F) + x
        b[at] = y ^ (y >> np.uint64(29))
    for i in np.flatnonzero(size > _SHORT):
        a[i], b[i] = np.frombuffer(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), "<u8")
    return a, mixed(b)


def equal_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``data`` and ``other`` that begin at these places and have these sizes are the same bytes."""
    same, at = np.ones(len(size), bool), np.arange(len(size))
    left, right, k = _eights(data), _eights(other), 0
    while len(at := at[size[at] > k]):
        part = _PART[np.minimum(size[at] - k, 8)]
        ok = (left[starts[at] + k] & part) == (right[others[at] + k] & part)
        same[at[~ok]] = False
        at, k = at[ok], k + 8
    return same


def joined_evenly(rows: DataFrame, found: DataFrame, key: list[str], how: str = "inner", hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``found``, which has one row a key, without sending the rows of a frequent key to one task.

    A key is frequent if more than one in ``hot`` of all rows has it, so there are fewer than ``hot`` such keys, whatever
    the size: their rows of ``found`` are broadcast, and all others are joined by key. ``rows`` is read three times and so
    should be a written table; keys have no nulls.
    """
    spark = rows.sparkSession
    many = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    many = many.filter(F.col("__n") > rows.count() // hot).select(*key)
    many = spark.createDataFrame(many.collect(), many.schema)
    marked = rows.join(F.broadcast(many.withColumn("__hot", F.lit(True))), key, "left")
    few = found.join(F.broadcast(many), key, "left_semi")
    a = marked.filter("__hot").drop("__hot").join(F.broadcast(few), key, how)
    return a.unionByName(marked.filter("__hot is null").drop("__hot").join(found, key, how))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as an empty text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 4 == 2
