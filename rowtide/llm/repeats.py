"""Substring dedup by recompression: long repeats are found, and told from others, by symbols that equal word sequences
get everywhere.

A text's words are named by 128-bit hashes. Each round first names maximal runs of one symbol, then pairs: every symbol
lies left or right by a bit of its name, and a left one directly before a right one becomes one symbol. A name is a hash
of the names it stands for, so all tasks give the same one without asking each other. A symbol also knows on which words
its forming depended; where two documents share those words, both have it.

Every window of ``WINDOW`` words is spelled by the largest symbols that depend on its own words only, from left to
right, with single words where there is none. Equal windows have the same spelling and different ones another, so the
spelling's hash (96 bits) stands for the window. The greatest symbol of the spelling (highest round, then largest name) is
elected, with the words it depends on: equal windows elect equal symbols, so a window can only repeat where its symbol
does. Spark compares both in two
rounds, on a table of documents dealt into shards:

1. each shard sends the symbols it elects, once each, with the smallest and largest doc_id, and is told which occur in
   more than one document;
2. each shard sends the spellings of the windows behind those symbols in the same way, and is told the smallest doc_id of
   each window that also occurs elsewhere;
3. each shard drops the words of windows that start in a document with a smaller doc_id.

A group of copies costs a row for each shard, not for each copy. Numbers travel packed, those of a shard for one task
together, so there are never more rows than numbers. A shard has ``SHARD_BYTES`` of text; one very long text is a shard of
its own, read in one task.

Null and empty texts have no words; texts of fewer words than a window lose nothing. A null doc_id counts as larger than
all others. Rows with equal doc_id never remove each other's words, whatever their texts; ties between windows don't
matter, as only the smallest doc_id counts. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import common

WINDOW, ROUNDS, SHARD_BYTES, BATCH = 13, 2, 16 << 20, 256 << 10
_NO_ID = (1 << 63) - 1
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


#: Weights of the places in a spelling, for both halves of its hash.
_PLACE = np.random.default_rng(0x5EED).integers(1, 1 << 63, (2, 64), np.uint64) * np.uint64(2) + np.uint64(1)
#: Further than any window reaches, for a symbol's own words and for what it depends on.
_NONE, _FAR = 127, 1 << 28


def _shifted(x: np.ndarray, by: int, start: np.ndarray, edge: int) -> np.ndarray:
    """The value of the symbol before (``by`` 1) or after (-1); ``edge`` where the document has none."""
    out = np.empty_like(x)
    if by > 0:
        out[1:] = x[:-1]
        out[start] = edge
    else:
        out[:-1] = x[1:]
        out[:-1][start[1:]] = edge
        out[-1:] = edge
    return out


class Round:
    """The symbols that a round leaves, by their first word: two halves of the name, words, and words it depends on.

    ``whole`` names the symbol together with all words that it depends on.
    """

    def __init__(self, words: int):
        self.a, self.b, self.whole = np.zeros(words, np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        self.size = np.zeros(words, np.int8)
        self.back, self.ahead = np.full(words, _NONE, np.int8), np.full(words, _NONE, np.int8)


class Text:
    """The words of a batch of documents: names, and the windows that lie within a document."""

    def __init__(self, column: pa.Array, width: int):
        if not 0 < width <= _PLACE.shape[1]:
            raise ValueError(f"a window has 1 to {_PLACE.shape[1]} words")
        self.data, offsets = common.text_buffer(column)
        self.starts, self.ends, self.first = common.word_spans(self.data, offsets, _WORD)
        self.a, self.b = common.span_names(self.data, self.starts, self.ends)
        rows, n = len(offsets) - 1, len(self.a)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        to = np.repeat(self.first[1:], np.diff(self.first))
        self.windows = np.flatnonzero(np.arange(n) + width <= to)
        self.width = width

    def rounds(self, rounds: int = ROUNDS) -> Iterator[Round]:
        """Run and pair the symbols again and again; what a round forms within a window's width is yielded."""
        a, b, n = self.a, self.b, len(self.a)
        at = since = np.arange(n, dtype=np.int32)  # a symbol's first word, and what it depends on
        until = at + 1
        up, down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (int(_A), pow(int(_A), -1, 1 << 64)))
        sums = np.append(np.uint64(0), np.cumsum(a * up[:n]))  # of the words' names, for any words in a row
        start = np.zeros(n, bool)  # a document's first symbol
        start[self.first[:-1][self.first[:-1] < n]] = True
        for turn in range(rounds if n else 0):
            # a run ends at the symbols beside it, and depends at a document's edge on what isn't there
            low, high = np.minimum(_shifted(since, 1, start, -_FAR), _shifted(since, -1, start, _FAR)), np.maximum(_shifted(until, 1, start, -_FAR), _shifted(until, -1, start, _FAR))
            since, until = np.minimum(since, low), np.maximum(until, high)
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & ~start[1:]
            made = np.zeros(len(a), bool)
            if same.any():  # runs: within one, everything depends on all of it
                i = np.flatnonzero(np.append(True, ~same))
                size = np.diff(np.append(i, len(a))).astype(np.uint64)
                since, until = np.minimum.reduceat(since, i), np.maximum.reduceat(until, i)
                a, b, at, start, made = a[i], b[i], at[i], start[i], size > 1
                a[made], b[made] = common.mixed(a[made] + size[made] * _A), common.mixed(b[made] + size[made] * _B)
            # pairs: a left symbol and the right one after it
            right = (common.mixed(a + np.uint64((turn + 1) * int(_B) % (1 << 64))) >> np.uint64(63)).astype(bool)
            pair = ~right[:-1] & right[1:] & ~start[1:]
            joined, gone = np.append(pair, False), np.append(False, pair)
            # a right symbol that stays saw what came before it, a left one and a pair what comes after
            behind = right & ~gone
            low = np.where(behind, _shifted(since, 1, start, -_FAR), _shifted(since, -1, start, _FAR))
            high = np.where(behind, _shifted(until, 1, start, -_FAR), _shifted(until, -1, start, _FAR))
            since, until = np.minimum(since, low), np.maximum(until, high)
            i = np.flatnonzero(pair)
            first, second = common.mixed(a[i] * _A + a[i + 1] * _B + np.uint64(turn)), common.mixed(b[i] * _B + common.mixed(b[i + 1] + np.uint64(turn)))
            a, b = a.copy(), b.copy()
            a[i], b[i] = first, second
            made, stay = (made | joined)[~gone], ~gone
            a, b, at, start, since, until = a[stay], b[stay], at[stay], start[stay], since[stay], until[stay]
            i = np.flatnonzero(made & (until - since <= self.width))
            found, p = Round(n + self.width), at[i]
            found.a[p], found.b[p], found.size[p] = a[i], b[i], np.append(at[1:], n)[i] - p
            found.back[p], found.ahead[p] = p - since[i], until[i] - p
            found.whole[p] = common.mixed((sums[until[i]] - sums[since[i]]) * down[since[i]] + (until[i] - p).astype(np.uint64))
            yield found

    def spelled(self, rounds: int = ROUNDS, elect: bool = True, spell: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window the elected symbol, and 64 and 32 bits of its spelling (zeros for what isn't asked for)."""
        n, width = len(self.a), self.width
        levels = list(self.rounds(rounds))
        a, b = (np.concatenate([x, np.zeros(width, np.uint64)]) for x in (self.a, self.b))
        here, best = np.zeros(n, np.int8), np.zeros(n, np.uint64)  # how far each window is spelled
        first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for d in range(width):
            now, q = here == d, slice(d, n + d)
            x, y, size, symbol = a[q], b[q], np.ones(n, np.int8), np.zeros(n, np.uint64)
            for k, level in enumerate(levels):
                fits = (level.back[q] <= d) & (level.ahead[q] <= width - d)
                size = np.where(fits, level.size[q], size)
                if spell:
                    x, y = np.where(fits, level.a[q], x), np.where(fits, level.b[q], y)
                if elect:
                    symbol = np.where(fits, (level.whole[q] >> np.uint64(8)) | np.uint64(k + 1 << 56), symbol)
            if elect:
                np.maximum(best, symbol * now, out=best)
            if spell:
                first += x * now * _PLACE[0, d]
                second += y * now * _PLACE[1, d]
            here += size * now
        at = self.windows
        best, first, second = best[at], common.mixed(first[at]), (common.mixed(second[at]) >> np.uint64(32)).astype(np.uint32)
        if elect:  # windows without any symbol stand for themselves
            alone = np.flatnonzero(best == 0)
            words = np.zeros(len(alone), np.uint64)
            for d in range(width):
                words += self.a[at[alone] + d] * _PLACE[0, d]
            best[alone] = common.mixed(words) >> np.uint64(8)
        return best, first, second


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, first bytes first; most high bytes are zero."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return pa.Codec("zstd", 1).compress(raw, asbytes=True) if len(raw) else b""


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.Codec("zstd").decompress(data, n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(-1)


def _least(keys: list[np.ndarray], low: np.ndarray, high: np.ndarray):
    """Distinct keys (one or two arrays) with the least ``low`` and the greatest ``high`` of each."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, low, high
    new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    return [k[new] for k in keys], np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new)


SENT = "part int, shard int, n int, key binary, more binary, low binary, over binary"
TOLD = "shard int, n int, key binary, more binary, low binary"


def _send(shard: int, keys: list[np.ndarray], low: np.ndarray, high: np.ndarray, parts: int) -> pa.RecordBatch:
    """The keys of a shard, packed for the tasks that compare them."""
    part = (keys[0] >> np.uint64(32)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cut)):
        i = order[cut[k] : cut[k + 1]]
        rows.append((int(k), shard, len(i), _pack(keys[0][i]), _pack(keys[1][i]) if len(keys) > 1 else b"", _pack(low[i]), _pack(high[i] - low[i])))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "shard", "n", "key", "more", "low", "over"])


def compared(sent: DataFrame, parts: int) -> DataFrame:
    """Tell each shard which of its keys also occur in another document, and the smallest doc_id of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for batch in batches for x in batch.to_pylist()]
        if not rows:
            return
        by: dict[int, list] = {}
        for x in rows:
            by.setdefault(x["part"], []).append(x)
        for some in by.values():
            sizes = [x["n"] for x in some]
            keys = [np.concatenate([_unpack(x["key"], x["n"], "<u8") for x in some])]
            if some[0]["more"]:
                keys.append(np.concatenate([_unpack(x["more"], x["n"], "<u4") for x in some]))
            low = np.concatenate([_unpack(x["low"], x["n"], "<i8") for x in some])
            high = low + np.concatenate([_unpack(x["over"], x["n"], "<i8") for x in some])
            shard = np.repeat([x["shard"] for x in some], sizes)
            order = np.lexsort(keys[::-1])
            new = np.concatenate([[True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])])
            at = np.flatnonzero(new)
            first, last = np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)
            which = np.cumsum(new) - 1
            told = order[(first < last)[which]]
            least = first[which[(first < last)[which]]]
            by_shard = np.argsort(shard[told], kind="stable")
            told, least = told[by_shard], least[by_shard]
            cut = np.append(np.flatnonzero(np.concatenate([[True], shard[told][1:] != shard[told][:-1]])), len(told)) if len(told) else np.zeros(1, int)
            out = [(int(shard[told[s]]), int(e - s), _pack(keys[0][told[s:e]]), _pack(keys[1][told[s:e]]) if len(keys) > 1 else b"", _pack(least[s:e])) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 2 + [pa.binary()] * 3, strict=True)], ["shard", "n", "key", "more", "low"])

    return sent.repartition(parts, "part").mapInArrow(run, TOLD)


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return common.small_batches(table.select(["doc_id", "text"]).to_batches(), BATCH)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.names.index("doc_id")).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _replies(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = table.to_pylist()
    none = [np.zeros(0, t) for t in ("<u8", "<u4", "<i8")]
    if not rows:
        return tuple(none)
    key = np.concatenate([_unpack(x["key"], x["n"], "<u8") for x in rows])
    more = np.concatenate([_unpack(x["more"], x["n"], "<u4") for x in rows]) if rows[0]["more"] else np.zeros(len(key), "<u4")
    low = np.concatenate([_unpack(x["low"], x["n"], "<i8") for x in rows])
    order = np.lexsort((more, key))
    return key[order], more[order], low[order]


def sharded(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """Documents (doc_id, text, shard) as a table bucketed by shard, so that later joins on it move no text.

    The table's files stay in the shared folder with those of all stages; its name is dropped from the catalog.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    enough = min(common.parts(spark), -(-int(total) // (shard_bytes // 16 or 1)))  # small tables still use all tasks
    shards = max(1, enough, -(-int(total) // shard_bytes))
    limit = "spark.sql.sources.bucketing.maxBuckets"
    if shards > int(spark.conf.get(limit)):
        spark.conf.set(limit, shards)
    name = f"repeats_{uuid.uuid4().hex}"
    shard = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(shards)).cast("int").alias("shard")
    writer = docs.withColumn("shard", shard).repartition(shards, "shard").write.format("parquet").option("compression", "zstd")
    writer.bucketBy(shards, "shard").option("path", f"{common.shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table, shards


def dedup(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space, as bytes) of each document."""
    spark = docs.sparkSession
    table, shards = sharded(docs, shard_bytes)
    parts = max(common.parts(spark), shards)

    def send_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in common.small_batches(batches, BATCH):
            text, ids = Text(batch.column("text"), width), _ids(batch)
            name, row = text.spelled(rounds, spell=False)[0], text.row[text.windows]
            if not len(name):
                continue
            new = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])]))
            name, row = name[new], row[new]
            shard = batch.column("shard").to_numpy()[row]
            for k in np.unique(shard):
                i = shard == k
                held.setdefault(int(k), []).append(_least([name[i]], ids[row[i]], ids[row[i]]))
        for k, some in held.items():
            keys, low, high = _least([np.concatenate([x[0][0] for x in some])], np.concatenate([x[1] for x in some]), np.concatenate([x[2] for x in some]))
            yield _send(k, keys, low, high, parts)

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        known, _, _ = _replies(right)
        found, shard = [], left.column("shard")[0].as_py() if left.num_rows else 0
        for batch in _batches(left):
            text, ids = Text(batch.column("text"), width), _ids(batch)
            name, a, b = text.spelled(rounds)
            at = np.minimum(np.searchsorted(known, name), max(len(known) - 1, 0))
            some = np.flatnonzero(known[at] == name) if len(known) and len(name) else np.zeros(0, int)
            own = ids[text.row[text.windows[some]]]
            found.append(_least([a[some], b[some]], own, own))
        keys, low, high = _least([np.concatenate([x[0][k] for x in found]) for k in (0, 1)], np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])) if found else ([np.zeros(0, "<u8"), np.zeros(0, "<u4")], np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.Table.from_batches([_send(shard, keys, low, high, parts)])

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        key, more, low = _replies(right)
        doc, words, gone, kept = [], [], [], []
        for batch in _batches(left):
            text, ids = Text(batch.column("text"), width), _ids(batch)
            n = len(text.a)
            bad = np.zeros(n + 1, np.int64)
            if len(key) and len(text.windows):
                _, a, b = text.spelled(rounds, elect=False)
                at = np.searchsorted(key, a)
                hit = np.flatnonzero(key[np.minimum(at, len(key) - 1)] == a)
                while len(hit):  # keys that agree in the first 64 bits only are a step apart
                    i = at[hit]
                    right_one = more[i] == b[hit]
                    w = text.windows[hit[right_one]]
                    w = w[low[i[right_one]] < ids[text.row[w]]]
                    bad[w] += 1
                    np.subtract.at(bad, w + width, 1)
                    hit = hit[~right_one]
                    at[hit] += 1
                    hit = hit[(at[hit] < len(key))]
                    hit = hit[key[at[hit]] == a[hit]]
            stay = np.cumsum(bad)[:n] == 0
            size = np.where(stay, text.ends - text.starts + 1, 0)
            to = np.cumsum(size)
            flat = np.full(int(size.sum()), 0x20, np.uint8)
            s, length = text.starts[stay], (text.ends - text.starts)[stay]
            put = np.repeat((to - size)[stay] - np.concatenate([[0], np.cumsum(length)[:-1]]) if len(s) else s, length) + np.arange(int(length.sum()))
            take = np.repeat(s - np.concatenate([[0], np.cumsum(length)[:-1]]) if len(s) else s, length) + np.arange(int(length.sum()))
            flat[put] = text.data[take]
            raw, edge = flat.tobytes(), np.concatenate([[0], to])[text.first]
            total = np.concatenate([[0], np.cumsum(~stay)])
            doc += batch.column("doc_id").to_pylist()
            words += np.diff(text.first).tolist()
            gone += (total[text.first[1:]] - total[text.first[:-1]]).tolist()
            kept += [raw[x : max(x, y - 1)] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.table([pa.array(doc, pa.int64()), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    shared = common.staged(compared(table.mapInArrow(send_symbols, SENT), parts))
    by_shard = table.groupBy("shard")
    sent = by_shard.cogroup(shared.repartition(shards, "shard").groupBy("shard")).applyInArrow(send_windows, SENT)
    repeated = common.staged(compared(sent, parts))
    both = by_shard.cogroup(repeated.repartition(shards, "shard").groupBy("shard"))
    return both.applyInArrow(drop, "doc_id long, n_words long, n_removed long, kept binary")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The query in DuckDB's SQL: the smallest doc_id of each window, then a sliding maximum over the words.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT doc_id, i, w[i : i + 12] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT x, min(doc_id) AS first FROM x GROUP BY x),
bad AS (SELECT doc_id, i FROM x JOIN f USING (x) WHERE first < doc_id),
g AS (SELECT p.doc_id, p.i, word, max(CASE WHEN bad.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN bad ON p.doc_id = bad.doc_id AND p.i = bad.i),
r AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""
