"""Benchmark decontamination with an FM-index for each training shard.

A shard is a batch of documents inside a Spark task. Its words become numbers; a word that no benchmark item has can't be
part of a match, so only runs of benchmark words that are long enough for a window are indexed (nothing else could
match). The index is the Burrows-Wheeler transform of those runs with a wavelet matrix for ranks and every
``EVERY``-th suffix position kept. All windows of all items are searched backwards at once, their occurrences are located
by walking to a kept position, and overlapping occurrences merge into removal spans.

A window is ``WINDOW`` consecutive words of an item; an item with fewer words, but some, is one window. Words are looked up
by a hash and then compared byte by byte. The benchmark is broadcast in blocks of at most about ``BLOCK_BYTES`` of text, one
pass over the documents for each; a block is built, sent and given up before the next one. How it is cut into blocks
doesn't change the result.

Null and empty texts have no words. Items with equal ids count once; an item without an id marks words but isn't listed.
Repeated documents are judged each, and so are rows with one doc_id and different texts; no ties arise, as items are listed in
the order of their ids as text. A very long text is a shard of its own, in one task. Other columns are ignored. Without
items nothing is hit; an empty table of documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.llm import common

WINDOW, EVERY, BLOCK_BYTES = 10, 8, 16 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Ranks:
    """A wavelet matrix: how often a symbol occurs before a place, for many symbols and places at once."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.levels = []
        for bit in range(max(1, int(kinds - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(place), place
        for bit, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            s, e = before[start], before[end]
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start


class Index:
    """The FM-index of runs of symbols (1 and up), each followed by a 0."""

    def __init__(self, text: np.ndarray, kinds: int, every: int = EVERY):
        n = len(text)
        gaps = text == 0
        # each 0 is a symbol of its own, so a suffix is told from all others within its run
        rank = np.where(gaps, np.cumsum(gaps) - 1, text + gaps.sum() - 1).astype(np.int64)
        step = 1
        while True:
            ahead = np.full(n, -1, np.int64)
            ahead[:-step] = rank[step:] if step < n else ahead[:-step]
            key = rank * (n + kinds + 2) + ahead + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            rank = new
            if rank.max(initial=0) == n - 1 or step >= n:
                break
            step *= 2
        places = order
        self.last = text[places - 1]  # the symbol before each suffix; before the first comes the last, a 0
        self.ranks = Ranks(self.last, kinds)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        kept = (places % every == 0) | (self.last == 0)  # no walk passes the start of a run
        self.kept, self.number, self.places = kept, np.cumsum(kept) - 1, places[kept]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each window (a row of symbols, 0 behind its length)."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.last), np.int64)
        live = np.arange(len(windows))
        for back in range(1, windows.shape[1] + 1):
            now = live[lengths[live] >= back]
            if not len(now):
                break
            symbol = windows[now, lengths[now] - back]
            lo[now] = self.first[symbol] + self.ranks.rank(symbol, lo[now])
            hi[now] = self.first[symbol] + self.ranks.rank(symbol, hi[now])
            live = live[hi[live] > lo[live]]
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        steps = np.zeros(len(row), np.int64)
        walking = np.flatnonzero(~self.kept[row])
        row = row.copy()
        while len(walking):
            symbol = self.last[row[walking]]
            row[walking] = self.first[symbol] + self.ranks.rank(symbol, row[walking])
            steps[walking] += 1
            walking = walking[~self.kept[row[walking]]]
        return self.places[self.number[row]] + steps


class Items:
    """The windows of a block of items, as numbers of words, and the items that have each."""

    def __init__(self, ids: list[str | None], texts: pa.Array, width: int = WINDOW):
        data, offsets = common.text_buffer(texts)
        data = _LOWER[data]
        starts, ends, first = common.word_spans(data, offsets, _WORD)
        flat, to = data[_WORD[data]], np.concatenate([[0], np.cumsum(ends - starts)])
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to), pa.py_buffer(flat)]).dictionary_encode()
        self.data, to = common.text_buffer(spans.dictionary)
        hashes = common.span_names(self.data, to[:-1], to[1:])[0]
        order = np.argsort(hashes)
        self.hashes, self.starts, self.sizes = hashes[order], to[:-1][order], np.diff(to)[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(1, len(order) + 1)
        number = place[spans.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        rows, of = [], []
        names = sorted({x for x in ids if x is not None})
        place = {x: k for k, x in enumerate(names)}
        for i, name in enumerate(ids):
            words = number[first[i] : first[i + 1]]
            if len(words):
                got = np.lib.stride_tricks.sliding_window_view(words, width) if len(words) >= width else np.pad(words, (0, width - len(words)))[None]
                rows.append(got)
                of.append(np.full(len(got), place.get(name, -1)))
        self.names = names
        every = np.concatenate(rows) if rows else np.zeros((0, width), np.int32)
        self.windows, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.zeros(0, np.int64))
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(of) if of else np.zeros(0, np.int64)], axis=1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        self.lengths = (self.windows > 0).sum(1)
        self.items, self.at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.shortest = int(self.lengths.min(initial=width))

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, from 1 on; 0 for words that no item has."""
        found = np.zeros(len(starts), np.int64)
        if not len(self.hashes):
            return found
        hashes, size = common.span_names(data, starts, ends)[0], ends - starts
        at = np.searchsorted(self.hashes, hashes)
        live = np.arange(len(starts))
        while len(live := live[self.hashes[np.minimum(at[live], len(self.hashes) - 1)] == hashes[live]]):
            i = at[live]
            same = self.sizes[i] == size[live]
            same[same] = common.equal_spans(data, starts[live[same]], self.data, self.starts[i[same]], size[live[same]])
            found[live[same]] = i[same] + 1
            live = live[~same]  # a word of the same hash but other bytes may follow
            at[live] += 1
            live = live[at[live] < len(self.hashes)]
        return found


def matches(items: Items, data: np.ndarray, offsets: np.ndarray):
    """For a shard: starts, ends, first word of each document, which words are hit, and (document, item) pairs."""
    data = _LOWER[data]
    starts, ends, first = common.word_spans(data, offsets, _WORD)
    hit, none = np.zeros(len(starts), bool), np.zeros((0, 2), np.int64)
    number = items.numbers(data, starts, ends)
    known = number > 0
    if not known.any():
        return starts, ends, first, hit, none
    new = np.zeros(len(starts) + 1, bool)  # where a run can't go on from the word before
    new[first] = True
    new[1:] |= ~known
    new[:-1] |= ~known
    edge = np.flatnonzero(new)
    if edge[0] != 0:
        edge = np.append(0, edge)
    size = np.diff(edge)
    runs = np.flatnonzero(known[edge[:-1]] & (size >= items.shortest))
    size = size[runs]
    if not len(runs):
        return starts, ends, first, hit, none
    word = np.repeat(edge[runs] - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange(int((size + 1).sum()))
    gap = np.zeros(len(word), bool)
    gap[np.cumsum(size + 1) - 1] = True
    text = np.where(gap, 0, number[np.minimum(word, len(number) - 1)])
    present, text = np.unique(text, return_inverse=True)  # only the symbols of this shard
    text = text.reshape(-1)
    here = np.full(len(items.hashes) + 1, -1, np.int64)
    here[present] = np.arange(len(present))
    usable = np.arange(len(items.windows))
    for k in range(items.windows.shape[1]):  # windows of which all words occur
        usable = usable[here[items.windows[usable, k]] >= 0]
    if not len(usable):
        return starts, ends, first, hit, none
    index = Index(text, len(present))
    lengths = items.lengths[usable]
    lo, hi = index.search(here[items.windows[usable]], lengths)
    found = np.flatnonzero((hi > lo))
    times = (hi - lo)[found]
    if not len(found):
        return starts, ends, first, hit, none
    row = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
    place, window = index.locate(row), np.repeat(found, times)
    change = np.bincount(place, minlength=len(text) + 1) - np.bincount(place + lengths[window], minlength=len(text) + 1)
    covered = np.cumsum(change)[: len(text)] > 0
    hit[word[covered & ~gap]] = True
    doc = np.searchsorted(first, word[place], "right") - 1
    pair = np.unique(np.stack([doc, usable[window]], axis=1), axis=0)
    count = items.at[pair[:, 1] + 1] - items.at[pair[:, 1]]
    where = np.repeat(items.at[pair[:, 1]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    return starts, ends, first, hit, np.unique(np.stack([np.repeat(pair[:, 0], count), items.items[where]], axis=1), axis=0)


def _spans(starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Bytes from the first to the last of consecutive hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(starts[np.flatnonzero(edge == 1)].tolist(), ends[np.flatnonzero(edge == -1) - 1].tolist(), strict=True))


class Blocks:
    """The benchmark in blocks of bounded size, each read by itself when it is asked for."""

    def __init__(self, benchmark: DataFrame, width: int, block_bytes: int):
        size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.n, self.width = max(1, -(-int(size) // block_bytes)), width
        self.some = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")

    def sent(self, k: int):
        """Block ``k`` as a broadcast value."""
        some = self.some.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == k) if self.n > 1 else self.some
        got = some.toArrow()
        return self.some.sparkSession.sparkContext.broadcast(Items(got.column("item_id").to_pylist(), got.column("text").combine_chunks(), self.width))


def find(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) and spans of UTF-8 bytes to remove, for each document (doc_id, text)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    fields = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start long, end long>>"
    blocks = Blocks(benchmark, width, block_bytes)
    out = docs.select(F.col("doc_id").cast("long"), "text")
    for k in range(blocks.n):
        held = blocks.sent(k)
        more = k + 1 < blocks.n  # the next pass needs the text

        def run(batches: Iterator[pa.RecordBatch], held=held, later=k > 0, more=more) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in common.small_batches(batches):
                data, offsets = common.text_buffer(batch.column("text"))
                starts, ends, first, hit, pairs = matches(items, data, offsets)
                rows = batch.num_rows
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[first[1:]] - total[first[:-1]]
                listed = np.searchsorted(pairs[:, 0], np.arange(rows + 1))
                before = batch.column("spans").to_pylist() if later else [[]] * rows
                names = batch.column("items").to_pylist() if later else [[]] * rows
                spans: list = [[]] * rows
                for i in np.flatnonzero((n_hit > 0) | np.array([bool(x) for x in before], bool)):
                    a, b = first[i], first[i + 1]
                    s, e, h = starts[a:b] - offsets[i], ends[a:b] - offsets[i], hit[a:b].copy()
                    for x in before[i]:
                        h |= (s >= x["start"]) & (e <= x["end"])
                    n_hit[i] = h.sum()
                    spans[i] = [{"start": x, "end": y} for x, y in _spans(s, e, h)]
                    names[i] = sorted({*names[i], *(items.names[x] for x in pairs[listed[i] : listed[i + 1], 1])})
                made = [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(span)), batch.column("text")]
                yield pa.RecordBatch.from_arrays(made[: 5 + more], ["doc_id", "n_words", "n_hit", "items", "spans", "text"][: 5 + more])

        out = out.mapInArrow(run, fields + ", text string" * more)
        if more:
            out = common.staged(out)
            held.destroy()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same rows and columns without the removal spans; ``n_chars`` counts what is left. A null text stays null.

    Every pass searches the whole text: all but the last only add their spans, and the last cuts those of all passes.
    """
    names, schema = docs.columns, docs.schema
    spans = "__spans"
    while spans in names:
        spans += "_"
    blocks = Blocks(benchmark, width, block_bytes)
    out = docs
    for k in range(blocks.n):
        held = blocks.sent(k)

        def run(batches: Iterator[pa.RecordBatch], held=held, later=k > 0, more=k + 1 < blocks.n) -> Iterator[pa.RecordBatch]:
            for batch in common.small_batches(batches):
                at = names.index("text")
                texts = batch.column(at)
                data, offsets = common.text_buffer(texts)
                starts, ends, first, hit, _ = matches(held.value, data, offsets)
                before = batch.column(len(names)).to_pylist() if later else [[]] * batch.num_rows
                if later:
                    batch = batch.select(names)
                total = np.concatenate([[0], np.cumsum(hit)])
                touched = np.flatnonzero((total[first[1:]] > total[first[:-1]]) | np.array([bool(x) for x in before], bool))
                merged: list = [[]] * batch.num_rows
                for i in touched:
                    a, b = first[i], first[i + 1]
                    s, e, h = starts[a:b] - offsets[i], ends[a:b] - offsets[i], hit[a:b].copy()
                    for x, y in zip(before[i][::2], before[i][1::2], strict=True):
                        h[np.searchsorted(s, x) : np.searchsorted(e, y, "right")] = True
                    merged[i] = _spans(s, e, h)
                if more:
                    flat = pa.array([[x for pair in some for x in pair] for some in merged], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*names, spans])
                    continue
                if len(touched):
                    left = texts.to_pylist()
                    for i in touched:
                        own, to, kept = left[i].encode(), 0, []
                        for s, e in merged[i]:
                            kept.append(own[to:s])
                            to = e
                        left[i] = (b"".join(kept) + own[to:]).decode()
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(left, batch.schema.field(at).type))
                    if "n_chars" in names:
                        n = names.index("n_chars")
                        counted = pa.array([x if left[i] is None else len(left[i]) for i, x in enumerate(batch.column(n).to_pylist())], batch.schema.field(n).type)
                        batch = batch.set_column(n, batch.schema.field(n), counted)
                yield batch

        more = k + 1 < blocks.n
        out = out.mapInArrow(run, T.StructType([*schema.fields, T.StructField(spans, T.ArrayType(T.LongType()))]) if more else schema)
        if more:
            out = common.staged(out)
            held.destroy()
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The query in DuckDB's SQL: windows of each length are compared as lists of words.
OP9_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, w[i : i + 9] AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
k AS (SELECT DISTINCT len(x) AS n FROM bw),
dw AS (SELECT doc_id, i, n, w[i : i + n - 1] AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (x)),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
