"""Secret scans: fixed patterns, and strings that a token vocabulary spells out almost letter by letter.

Ordinary words and identifiers take few tokens for their length under a byte-pair vocabulary; random strings take one
for every one or two characters. Every run of 20 or more key characters is tokenized, without what the patterns' spans
and known digests (UUID, hexadecimal digest of a usual length) cover of it. What is left is judged as a whole and in
every window of 20 characters: under ``RATIO`` characters per token it is a ``random`` span, up to the next separators on
both sides, unless it is an identifier (words that the vocabulary knows and numbers, joined by separators). The spans of
the patterns always stay.

A null or empty text has no spans. Each row is judged by itself, so repeated rows, rows with one doc_id, ties and other
columns don't matter; spans that start together are listed in the order of ``KINDS``. Runs are tokenized whole, and the
time for a very long text grows with its length. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import common

RATIO, LEAST = 2.0, 20
#: The order of kinds where spans start together.
KINDS = ["assign", "access", "hex", "random"]
#: Patterns, the group that is the secret's value (0: the match), and its least length.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: A sign without which a text has no match of the pattern.
SIGNS = {"assign": re.compile("[:=]"), "access": re.compile("AKIA"), "hex": re.compile("[0-9a-f]{16}")}
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|(?:sha(?:1|256|384|512)-)?(?:[0-9a-fA-F]{128}|[0-9a-fA-F]{96}|[0-9a-fA-F]{64}|[0-9a-fA-F]{56}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})"
    r"|sha(?:256|384|512)-[A-Za-z0-9+/]{43,86}={0,2}"
    r")(?![A-Za-z0-9])"
)
#: What names are made of; each character belongs to one part.
PART = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+")
PIECE = re.compile("[A-Za-z0-9]+")


class Scanner:
    def __init__(self, vocabulary: str, ratio: float):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.ratio = ratio

    def sizes(self, run: str) -> list[int]:
        """Characters of each token."""
        size = self.size
        return [size[t] for t in self.encode(run)]

    def identifier(self, run: str) -> bool:
        """Words and numbers; with letters, those of words that have ``ratio`` characters a token make up the half at least."""
        parts = PART.findall(run)
        if any(len(x) > 8 for x in parts if x[0].isdigit()):
            return False
        words = [x for x in parts if x[0].isalpha()]
        if not words:
            return True
        letters = sum(len(x) for x in words if len(x) > 2 and len(x) >= self.ratio * len(self.sizes(x)))
        single = sum(len(x) == 1 and x not in "vV" for x in words)
        return not single and 2 * letters >= len(run)

    def random(self, run: str) -> list[tuple[int, int]]:
        """The parts of a run that are random, in order."""
        sizes = self.sizes(run)
        ends = list(accumulate(sizes))
        found: list[tuple[int, int]] = []
        if len(run) < self.ratio * len(sizes):
            found.append((0, len(run)))
        else:
            j, at, borders = 0, 0, None
            for i, size in enumerate(sizes):  # the shortest window from each token
                while j < len(sizes) and ends[j] - at < LEAST:
                    j += 1
                if j == len(sizes):
                    break
                if ends[j] - at < self.ratio * (j + 1 - i):
                    if borders is None:
                        borders = [0, *(x for m in PIECE.finditer(run) for x in m.span()), len(run)]
                    s, e = borders[bisect_right(borders, at) - 1], borders[bisect_left(borders, ends[j])]
                    if found and s <= found[-1][1]:
                        found[-1] = (found[-1][0], max(e, found[-1][1]))
                    else:
                        found.append((s, e))
                at += size
        return [(s, e) for s, e in found if not self.identifier(run[s:e])]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, kind's place, end) of all spans, in order."""
        found = []
        for k, kind in enumerate(KINDS[:3]):
            if SIGNS[kind].search(text):
                pattern, group, least = PATTERNS[kind]
                found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        base = sorted(found)
        covered: list[list[int]] = []  # what the patterns' spans cover, without overlaps
        for s, _, e in base:
            if covered and s <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], e)
            else:
                covered.append([s, e])
        k = 0
        for m in RUN.finditer(text):
            at, last = m.span()
            while k < len(covered) and covered[k][1] <= at:
                k += 1
            taken = [(at + x.start(), at + x.end()) for x in KNOWN.finditer(m.group())]
            for i in range(k, len(covered)):
                if covered[i][0] >= last:
                    break
                taken.append(tuple(covered[i]))
            for s, e in [*sorted(taken), (last, last)]:
                if s - at >= LEAST:
                    found += [(at + x, 3, at + y) for x, y in self.random(text[at:s])]
                at = max(at, e)
        return sorted(found)


def scan(docs: DataFrame, vocabulary: str, ratio: float = RATIO) -> DataFrame:
    """One row per document (doc_id, text): its id and ``found``, an array of (kind, start, end) in order of start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(vocabulary, ratio)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in common.small_batches(batches):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.spans(x or "")] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(kind))], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, found array<struct<kind string, start long, end long>>")


def redact(docs: DataFrame, vocabulary: str, ratio: float = RATIO, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with each run of overlapping spans replaced by ``mark`` and ``n_chars`` counted anew.

    A null text stays null. All other columns stay as they are.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(vocabulary, ratio)
        for batch in common.small_batches(batches):
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                if text and (spans := scanner.spans(text)):
                    out, to = [], 0
                    for s, _, e in spans:
                        if s >= to:
                            out += [text[to:s], mark]
                        to = max(to, e)
                    texts[i] = "".join(out) + text[to:]
            put = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                put["n_chars"] = pa.array([None if x is None else len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([put.get(n, batch.column(k)).cast(batch.schema.field(k).type) for k, n in enumerate(names)], names)

    return docs.mapInArrow(run, docs.schema)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"), vocabulary_path())

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("found", lambda x: x["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(of(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
