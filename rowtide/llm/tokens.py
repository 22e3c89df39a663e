"""Token counts of every prefix of a text, for a byte-fallback BPE vocabulary in a sentencepiece model, by dynamic programming.

A prefix's encoding is the encoding of a shorter prefix and one last token. A run of tokens is what the tokenizer gives if
each two neighbours are what it gives for these two alone, and each token for itself, so exactly one token that the prefix
ends with fits behind the encoding of what stands before it. An automaton names those tokens, the longest first; whether two
tokens may stand side by side is asked once and remembered. So one walk over a text finds the token count of all its
prefixes, each exactly what the tokenizer gives for that prefix alone. (They aren't monotone: a word's next letter can
complete a longer token.)

The counts are stored as differences, a signed byte for each code point, and answer questions without encoding again:
``tokens_at`` (tokens of the first n code points), ``fitting`` (the longest prefix within a budget) and ``truncated``
(its text). No token has a space behind another character, or letters and punctuation (``alphabets``), so a walk begins anew at
each word, and workers remember the differences of words of up to ``SHORT`` characters (of ``KEPT`` of them, and as many
that were in use before those); others are walked each time they occur.

A null text is empty and has no tokens. A very long text is walked by one task, in time that follows its length. Repeated
rows are counted each; rows with one id are no concern. Characters that the vocabulary lacks count as their bytes, and the
names of special tokens are ordinary text. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import common

LIMIT = 4096
KEPT, PAIRS, SHORT = 400_000, 1_000_000, 32
MARK = "▁"  # what the tokenizer turns a space into; here both are a space
PREFIXES = "doc_id long, n_chars long, n_bytes long, n_tokens long, steps binary"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def alphabets(tokens: list[str], most: int = 6) -> list[set[str]]:
    """Sets of characters such that no token has characters of two of them (but spaces); the smaller sets are taken as one."""
    of: dict[str, set[str]] = {}
    for a, b in sorted({token[k : k + 2] for token in tokens for k in range(len(token) - 1)}):
        if a != " " and b != " ":
            both = of.setdefault(a, {a}) | of.setdefault(b, {b})
            of |= dict.fromkeys(both, both)
        else:
            of.setdefault(b, {b})
    of.pop(" ", None)
    found = sorted({id(chars): chars for chars in of.values()}.values(), key=lambda chars: (-len(chars), min(chars)))
    return found[:most] + [set().union(*found[most:])] * (len(found) > most)


class Prefixes:
    """Differences of the token counts of successive prefixes of texts."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        # fixed values: texts that show what a model does to spaces, case and compatibility characters
        if model.normalize(" ﬁ  A ") != MARK * 2 + "ﬁ" + MARK * 2 + "A" + MARK or model.encode("\n", out_type=str) != [MARK, "<0x0A>"]:
            raise ValueError("only models with byte fallback that mark each space and change nothing else are supported")
        ids = [i for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i).replace(MARK, " "): model.get_score(i) for i in ids}
        if any(" " in piece.lstrip(" ") for piece in self.score):
            raise ValueError("only models whose tokens begin with the mark of a space, or have none, are supported")
        longer = [piece for piece in self.score if len(piece) > 1]
        #: Tokens by number: the text, and how it comes about. One that the tokenizer doesn't give for its own text occurs nowhere.
        self.text, self.made = [], []
        for piece in self.score:
            made = self.merges(piece)
            if len(made) == len(piece):
                self.text.append(piece)
                self.made.append(made)
        self.ending = ahocorasick.Automaton()
        for k, piece in enumerate(self.text):
            self.ending.add_word(piece, (len(piece), k))
        self.ending.make_automaton()
        inside = {char for piece in longer for char in piece}
        if not inside <= self.score.keys() or "\n" in inside:
            raise ValueError("only models that know each character of their tokens, and have no line ends in them, are supported")
        self.words = re.compile("|".join([f" *[{re.escape(''.join(sorted(chars)))}]+" for chars in alphabets(longer)] + [" +", "."]), re.DOTALL).findall
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merges(self, text: str) -> list[tuple[float, str, str]]:
        """How a short text is joined: of all neighbours that make up a token those with the best score are, the left ones first.

        For each step (the first: none taken) the score of the next, and what the text begins and ends with.
        """
        parts, score, made = list(text), self.score, []
        while len(parts) > 1:
            best, at = max((score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            made.append((best, parts[0], parts[-1]))
            if best == -np.inf:
                return made
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return [*made, (-np.inf, parts[0], parts[0])]

    def fit(self, left: int, right: int) -> bool:
        """Whether the tokenizer leaves two tokens side by side: both come about as they do alone, unless it joins across first."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b, score = iter(self.made[left]), iter(self.made[right]), self.score
        (own, _, end), (other, begin, _) = next(a), next(b)
        while (across := score.get(end + begin, -np.inf)) <= own or across < other:
            if own == other == -np.inf:
                break
            if own >= other:
                own, _, end = next(a)
            else:
                other, begin, _ = next(b)
        fits = self.pairs[left * len(self.text) + right] = across == -np.inf
        return fits

    def walked(self, words: list[str]) -> dict[str, bytes]:
        """For each word what each character adds to the token count; one walk goes over all of them, parted by line ends."""
        joined = "\n".join(words)
        count, last = [0] * (len(joined) + 1), [-1] * (len(joined) + 1)  # of each prefix: its tokens, and the last one (-1: none, or bytes)
        pairs, fit, n, at = self.pairs.get, self.fit, len(self.text), 0
        for end, (size, token) in self.ending.iter(joined):  # of tokens with one end the longest comes first
            if end < at:  # another one has fitted
                continue
            while at < end:  # no token ends here: the character counts as its bytes
                count[at + 1] = count[at] + len(joined[at].encode())
                at += 1
            start = end + 1 - size
            left = last[start]
            if size > 1 and left >= 0:
                fits = pairs(left * n + token)
                if not (fit(left, token) if fits is None else fits):
                    continue
            at = end + 1
            count[at] = count[start] + 1
            last[at] = token
        for k in range(at, len(joined)):
            count[k + 1] = count[k] + len(joined[k].encode())
        steps, found, at = np.diff(np.array(count)).astype(np.int8).tobytes(), {}, 0
        for word in words:
            found[word] = steps[at : at + len(word)]
            at += len(word) + 1
        return found

    def steps(self, texts: list[str]) -> list[np.ndarray]:
        """What each code point of each text adds to the token count, as signed bytes."""
        cut = [self.words(" " + text.replace(MARK, " ")) if text else [] for text in texts]
        known, before = self.known, self.before
        made = [list(map(known.get, words)) for words in cut]
        new = {word for words, found in zip(cut, made, strict=True) if None in found for word, x in zip(words, found, strict=True) if x is None}
        again = new.intersection(before)
        for word in again:
            known[word] = before[word]
        walked = self.walked(list(new - again))
        known.update(walked)
        found = []
        for words, steps in zip(cut, made, strict=True):
            steps = np.frombuffer(b"".join([known[word] for word in words] if None in steps else steps), np.int8)
            found.append(np.concatenate([steps[:1] + steps[1:2], steps[2:]]))  # the space in front comes with the first code point
        for word in walked:
            if len(word) > SHORT:
                del known[word]
        if len(known) > KEPT:
            self.known, self.before = {}, known
        return found


def prefixes(docs: DataFrame, model: str, with_text: bool = False) -> DataFrame:
    """(doc_id, n_chars, n_bytes, n_tokens, steps) of each document (doc_id, text); sums of ``steps`` are the counts of prefixes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Prefixes(model)
        for batch in common.small_batches(batches, 1 << 20):
            sizes = np.diff(common.text_buffer(batch.column(1))[1])
            steps = counter.steps([text or "" for text in batch.column(1).to_pylist()])
            columns = [batch.column(0), pa.array([len(x) for x in steps], pa.int64()), pa.array(sizes, pa.int64()), pa.array([int(x.sum(dtype=np.int64)) for x in steps], pa.int64()), pa.array([x.tobytes() for x in steps], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(1)] * with_text, ["doc_id", "n_chars", "n_bytes", "n_tokens", "steps"] + ["text"] * with_text)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, PREFIXES + ", text string" * with_text)


def _answered(stored: DataFrame, name: str, asked: str, answer) -> DataFrame:
    """Adds the column ``name``: the answer from each row's prefix counts (from 0 code points on) and the number in ``asked``."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(batch.schema.names.index("steps")).to_pylist(), batch.column(batch.schema.names.index(asked)).to_pylist(), strict=True)
            made = [None if steps is None or n is None else int(answer(np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)]), n)) for steps, n in pairs]
            yield batch.append_column(name, pa.array(made, pa.int64()))

    return stored.drop(name).mapInArrow(answers, stored.drop(name).schema.add(name, "long"))


def tokens_at(stored: DataFrame, n_chars: str) -> DataFrame:
    """Adds ``tokens_at``: the tokens of the text's first ``n_chars`` (a column) code points; null if it is, all if it has fewer."""
    return _answered(stored, "tokens_at", n_chars, lambda counts, n: counts[min(max(n, 0), len(counts) - 1)])


def fitting(stored: DataFrame, budget: int) -> DataFrame:
    """Adds ``fit_chars``: the code points of the longest prefix of at most ``budget`` tokens; none for a budget below 0."""
    asked = stored.withColumn("__budget", F.lit(budget).cast("long"))
    found = _answered(asked, "fit_chars", "__budget", lambda counts, n: np.flatnonzero(counts <= n)[-1] if n >= 0 else 0)
    return found.drop("__budget")


def truncated(docs: DataFrame, model: str, budget: int) -> DataFrame:
    """(doc_id, text, n_tokens): texts cut to their longest prefix of at most ``budget`` tokens, and their tokens before that."""
    found = fitting(prefixes(docs, model, with_text=True), budget)
    return found.select("doc_id", F.expr("left(text, cast(fit_chars as int))").alias("text"), "n_tokens")


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = prefixes(common.table(spark, sf_dir, "documents"), model_path())
    counted = stored.withColumn("over_limit", F.col("n_tokens") > LIMIT)
    return fitting(counted, LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars", "fit_chars")
