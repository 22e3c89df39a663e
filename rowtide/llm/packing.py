"""Best-fit packing of documents into fixed-length token sequences by bin completion.

The lengths of all pieces form a histogram of at most ``capacity`` entries, however many documents there are, so the
search runs once on that histogram (a few thousand steps) and Spark does the rest: tokenizing, counting, ranking pieces
within their length, and placing each piece by its rank.

Bin completion takes the largest remaining piece, enumerates undominated fillings of what is left of its sequence, and
branches over them, least waste first; one step fills as many equal sequences as the counts allow, and later fewer. A
branch is pruned when its waste so far or a lower bound leaves no room for fewer sequences than the incumbent has.
Best-fit decreasing gives the first incumbent, and one more for what each step leaves.

The search ends when the incumbent meets the lower bound or nothing is left to try, and so with the fewest sequences
there can be; it is stopped after ``SEARCH_STEPS`` steps (``complete`` says more), as the number of branches has no useful bound. The more
documents there are, the sooner best-fit meets the bound.

Null and empty texts give one piece of length 1 (the end id alone). Repeated rows are packed as often as they occur, and
so are rows with one doc_id and different texts; pieces of equal length are placed in the order of a hash of their ids.
A very long text is cut into pieces by one task. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import common

CAPACITY = 2048
END_ID = 0
#: Steps of the search, fillings looked at for each on average, and words whose ids a task keeps.
SEARCH_STEPS, LOOKED, KEPT_WORDS = 2000, 20, 600_000

_LATIN = [chr(c) for c in range(0x180) if c != 0x130 and not 0x1C <= c <= 0x1F]
_L = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_N = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
#: Texts of these characters only are cut into the vocabulary's own pre-tokens here; the tokenizer then sees each
#: distinct pre-token once. Its normalizer leaves them as they are but for the case.
_OTHER = re.compile(f"[^{re.escape(''.join(_LATIN))}]|<\\|")
_PIECE = re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^\\s{_L}{_N}]+")
#: The same for texts of ASCII, in lower case, which most are.
_ASCII_OTHER = re.compile("[\x1c-\x1f]|<\\|")
_ASCII_PIECE = re.compile("[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\sa-z0-9]+")


class Encoder:
    """ids of whole texts as the little-endian bytes of unsigned 32-bit numbers, with a bounded memory of pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encode new pre-tokens, a thousand to a text; each ends with the only id of its ids that ends a word."""
        if len(self.known) + len(words) > KEPT_WORDS:
            self.known.clear()
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.ids(" ".join(some)), np.uint32)
            to = np.flatnonzero(self.ends[ids]) + 1
            if len(to) == len(some):
                data, at_byte = ids.tobytes(), 0
                for word, end in zip(some, (to * 4).tolist(), strict=True):
                    self.known[word] = data[at_byte:end]
                    at_byte = end
            else:
                for word in some:
                    self.known[word] = self.direct(word)

    def ids(self, text: str) -> list[int]:
        # the fast form of the same leaves out where tokens are in the text
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def direct(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()

    @staticmethod
    def words(text: str) -> list[str] | None:
        """The pre-tokens of a text; none if it has characters that only the tokenizer knows to handle."""
        if text.isascii():
            return None if _ASCII_OTHER.search(text) else _ASCII_PIECE.findall(text.lower())
        return None if _OTHER.search(text) else _PIECE.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(x) for x in texts]
        new = set().union(*[x for x in cut if x]) - self.known.keys()
        if new:
            if len(self.known) + len(new) > KEPT_WORDS:
                new = set().union(*[x for x in cut if x])
            self.learn(list(new))
        known = self.known
        return [self.direct(text) if words is None else b"".join(map(known.__getitem__, words)) for text, words in zip(texts, cut, strict=True)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each document (doc_id, text): consecutive runs of ``capacity`` ids, the last possibly shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(tokenizer), array("I", [end_id]).tobytes()
        step = 4 * capacity
        for batch in common.small_batches(batches, 1 << 20):
            doc, piece, start, length, crc, raw = [], [], [], [], [], []
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
            made = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(made + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths of a sequence, how many such sequences)."""
    room: dict[int, dict[tuple[int, ...], int]] = {}  # by what is left
    open_ = 0  # which keys ``room`` has, as bits
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            fits = open_ >> length
            if not fits:
                each = capacity // length
                full, rest = divmod(n, each)
                for k, m in ((each, full), (rest, 1)):
                    if k and m:
                        kind = room.setdefault(capacity - k * length, {})
                        key = (length,) * k
                        kind[key] = kind.get(key, 0) + m
                        open_ |= 1 << capacity - k * length
                break
            left = length + (fits & -fits).bit_length() - 1
            key, m = room[left].popitem()
            each = min(left // length, n)
            used = min(m, n // each)
            if m > used:
                room[left][key] = m - used
            if not room[left]:
                del room[left]
                open_ ^= 1 << left
            kind = room.setdefault(left - each * length, {})
            open_ |= 1 << left - each * length
            new = key + (length,) * each
            kind[new] = kind.get(new, 0) + used
            n -= used * each
    return [x for kind in room.values() for x in kind.items()]


def least(counts: np.ndarray, capacity: int) -> int:
    """No packing needs fewer sequences: the best of the bounds that count large pieces by themselves."""
    lengths = np.arange(capacity + 1)
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    half = capacity // 2
    k = np.arange(half + 1)  # pieces over capacity - k stand alone; those over a half don't share; the rest fills up
    edge = capacity - k + 1
    alone, large = number[-1] - number[edge], number[edge] - number[half + 1]
    spare = large * capacity - (total[edge] - total[half + 1])
    small = total[half + 1] - total[k]
    return max(-(-int(total[-1]) // capacity), int((alone + large + np.maximum(0, -(-(small - spare) // capacity))).max()))


def _dominates(large: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether first-fit deals the pieces of ``small`` into those of ``large``: then ``large`` is at least as good."""
    room = list(large)
    for x in small:
        for i, r in enumerate(room):
            if r >= x:
                room[i] -= x
                break
        else:
            return False
    return True


def fillings(counts: np.ndarray, room: int, waste: int, after: tuple[int, tuple[int, ...]] | None = None, spent: list[int] | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, lengths, largest first) of every undominated way to fill ``room`` that wastes at most ``waste``.

    They come lazily, least waste first, and of equal waste those with larger pieces first. Each is maximal: nothing that
    is left fits in its waste. ``after``: only those behind this one in that order. ``spent``: counts those looked at.
    """
    lengths = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1]]
    # sums within reach with the lengths from each on, as bits; a shorter length may go in several times
    reach, whole = [1], (1 << room + 1) - 1
    for x in reversed(lengths):
        bits, n, step = reach[-1], min(int(counts[x]), room // x), 1
        while n:  # 1, 2, 4, ... copies at a time
            bits |= bits << x * min(step, n)
            n -= min(step, n)
            step *= 2
        reach.append(bits & whole)
    reach.reverse()
    smallest = lengths[-1] if lengths else room + 1
    kept: list[tuple[int, ...]] = []

    def ways(k: int, left: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
            return
        while k < len(lengths) and reach[k] >> left & 1:
            x = lengths[k]
            for n in range(min(int(counts[x]), left // x), 0, -1):
                if reach[k + 1] >> left - n * x & 1:
                    for rest in ways(k + 1, left - n * x):
                        yield (x,) * n + rest
            k += 1

    for lost in range(after[0] if after else 0, min(waste, room) + 1):
        if not reach[0] >> room - lost & 1:
            continue
        for kind in ways(0, room - lost):
            if spent is not None:
                spent[0] += 1
                if spent[0] > spent[1]:
                    return
            if lost >= smallest and any(int(counts[x]) > kind.count(x) for x in lengths if x <= lost):
                continue  # something more would fit
            if any(_dominates(one, kind) for one in kept):
                continue
            kept.append(kind)
            if after is None or lost > after[0] or (lost == after[0] and kind < after[1]):
                yield lost, kind
            if len(kind) < 2 and not lost:
                return  # one piece that fits exactly is at least as good as all others


class Step:
    """A sequence's kind that the search has chosen, and what else there is to try at its place."""

    def __init__(self, largest: int, ways: Iterator[tuple[int, tuple[int, ...]]]):
        self.largest, self.ways = largest, ways
        self.way: tuple[int, tuple[int, ...]] = (0, ())
        self.times = 0


def complete(counts: np.ndarray, capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Branch and bound over fillings; the result is the last incumbent: (lengths of a sequence, how many such).

    A step takes the largest piece left and an undominated filling of the rest of its sequence, as often as the counts
    allow, and branches first over fewer times (another filling then follows for the same largest piece) and then over
    the next filling. What is left after a step is also packed by best-fit, which gives incumbents early. A branch ends
    where the sequences so far and a lower bound for the rest don't beat the incumbent. If the search ends by itself the
    result is the least possible; it is stopped after ``steps`` steps or ``LOOKED`` times as many fillings looked at, with
    the best incumbent until then.
    """
    counts = counts.astype(np.int64).copy()
    total = int((counts * np.arange(capacity + 1)).sum())
    incumbent, bound = best_fit(counts, capacity), least(counts, capacity)
    most = sum(m for _, m in incumbent)
    path: list[Step] = []
    waste = used = 0
    spent = [0, LOOKED * steps]

    def put(step: Step, times: int) -> None:
        nonlocal waste, used
        for x in (step.largest, *step.way[1]):
            counts[x] -= times
        step.times += times
        waste += times * step.way[0]
        used += times

    def fits(step: Step) -> int:
        need: dict[int, int] = {}
        for x in (step.largest, *step.way[1]):
            need[x] = need.get(x, 0) + 1
        return min(int(counts[x]) // n for x, n in need.items())

    def opened(after: tuple[int, tuple[int, ...]] | None) -> Step:
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        here = counts.copy()
        counts[largest] += 1
        return Step(largest, fillings(here, capacity - largest, (most - 1) * capacity - total - waste, after, spent))

    for _ in range(steps):
        if most <= bound or spent[0] > spent[1]:
            break
        if path and path[-1].times:
            last = path[-1]
            left = int(counts.sum())
            if left:
                rest = best_fit(counts, capacity)
                n = sum(m for _, m in rest)
            else:
                rest, n = [], 0
            if used + n < most:
                most = used + n
                incumbent = [((x.largest, *x.way[1]), x.times) for x in path] + rest
            if left and used + least(counts, capacity) < most and waste <= (most - 1) * capacity - total:
                # the same largest piece again: only with fillings behind this one, so no order of fillings comes twice
                path.append(opened(last.way if counts[last.largest] else None))
        elif not path:
            path.append(opened(None))
        while path:  # the next choice: fewer times, then the next filling, then a step back
            last = path[-1]
            if last.times > 1:
                put(last, -1)
                break
            put(last, -last.times)
            way = next(last.ways, None)
            if way is not None:
                last.way = way
                put(last, fits(last))
                break
            path.pop()
        else:
            break
    return incumbent


def place(rows: DataFrame, capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` and a number of their own, ``__row``, which is dropped.

    ``rows`` is read several times and so should be a written table. A piece that fills a sequence is one by itself and
    isn't moved; its sequence_id is below 0.
    """
    spark = rows.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    counts[capacity] = 0
    taken = np.zeros(capacity + 1, np.int64)
    table, sequence = [], 0
    for kind, times in complete(counts, capacity, steps):
        offset = 0
        for x in kind:
            table.append((x, taken[x], sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    table.sort()
    lengths, ranks, sequences, offsets = (np.array(x, np.int64) for x in zip(*table, strict=True)) if table else (np.zeros(0, np.int64),) * 4
    # Each step of the search uses up one length but for fewer than a sequence holds, so the table's size follows the
    # number of distinct lengths, which is at most the capacity, and not the number of rows.
    held = spark.sparkContext.broadcast((lengths << 48 | ranks, ranks, sequences, offsets))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, to, at = held.value
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            i = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, "right") - 1
            batch = batch.drop_columns(["__rank"])
            yield batch.append_column("sequence_id", pa.array(to[i] + rank - first[i])).append_column("offset", pa.array(at[i]))

    # frequent lengths are ranked in parts, each of a bounded share of all rows: at most capacity + enough parts in all
    enough = max(64, 4 * common.parts(spark))
    salts = [(k, 1 + int(n) * enough // int(counts.sum())) for k, n in enumerate(counts.tolist()) if n]
    salted = rows.join(F.broadcast(spark.createDataFrame(salts, "length long, __salts long")), "length")
    kept = [c for c in rows.columns if c != "__row"]
    ranked = common.salted_rank(salted, ["length"], common.id_salt("doc_id", "piece", "__row"), [F.col("doc_id"), F.col("piece")], "__rank", F.col("__salts"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    packed = ranked.select(*kept, "__rank").mapInArrow(put, f"{fields}, sequence_id long, offset long")
    full = rows.filter(F.col("length") == capacity).select(*kept, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, steps: int = SEARCH_STEPS, with_ids: bool = False) -> DataFrame:
    """Pack documents (doc_id, text): one row per piece with its sequence and its place there."""
    found = pieces(docs, tokenizer, capacity, end_id, with_ids).withColumn("__row", F.monotonically_increasing_id())
    return place(common.staged(found), capacity, steps)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path())
