"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs. DataFrame functions only.

Every paragraph (line) has a wide vector; a text's fingerprint is the sum of its paragraphs' vectors, lane by lane,
modulo a power of two. Order doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts. 16 lanes modulo 2^32 are expanded from the paragraph's SHA-512: two texts have them equal only
if they have the same paragraphs. 65 lanes modulo 2^24 describe its content: how many pieces it has (each five words in
a row of a paragraph, from every word on; a shorter paragraph is one), and in how many of these pieces each bit of a 64-bit hash is set. These lanes are sums as well, and the squared difference
of two such sums estimates how many pieces two texts don't share, so they give a likeness from 0 to 1.

A null text is an empty one. An empty text has one empty paragraph. Rows with equal doc_id count as neighbours in an
order fixed by their texts; rows without doc_id come last. A very long text is a row like any other, held
with its hashes by one task. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.llm import common

#: Words of a piece, hashes of a digest (two lanes each), bits of a piece's hash.
WORDS, HASHES, BITS = 5, 8, 64
#: Pieces that are counted in signed bytes.
RUN = 127
STRONG, WEAK = 1 << 32, 1 << 24


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the array ``name``: 16 strong lanes, the number of pieces, then 64 bit counts."""
    df = df.withColumn("__paragraphs", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    digests = F.transform("__paragraphs", lambda p: F.sha2(p.cast("binary"), 512))
    words = F.transform("__paragraphs", lambda p: F.transform(F.split(p, " ", -1), lambda w: F.xxhash64(w)))
    # get() gives null behind the last word, which the hash passes over
    pieces = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))))
    df = df.withColumns({"__digests": digests, "__pieces": pieces}).drop("__paragraphs")

    def total(array: str, term) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + term(x))

    # sums of two lanes each: bits 0-31 and 32-62; no text has 2^31 paragraphs or pieces, so no lane runs over
    low = F.lit(STRONG - 1)
    lanes = []
    for k in range(HASHES):
        lanes += [total("__digests", lambda x, k=k: F.xxhash64(x, F.lit(k)).bitwiseAND(low)), total("__digests", lambda x, k=k: F.shiftrightunsigned(F.xxhash64(x, F.lit(k)), 32))]
    # eight bits of a hash are counted at once in the bytes of a number, for RUN pieces; then the runs' bytes are added up
    df = df.withColumn("__runs", F.transform(F.sequence(F.lit(0), F.floor((F.size("__pieces") - 1) / RUN).cast("int")), lambda i: F.slice("__pieces", i * RUN + 1, RUN)))

    def in_bytes(k: int) -> Column:
        return F.transform("__runs", lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(0x0101010101010101))))

    df = df.withColumns({f"__bits{k}": in_bytes(k) for k in range(8)})
    twice = [total(f"__bits{k % 8}", lambda x, k=k: F.shiftrightunsigned(x, k - k % 8).bitwiseAND(F.lit(0xFF << 32 | 0xFF))) for k in range(BITS // 2)]
    df = df.withColumn("__sums", F.array(*lanes, *twice)).withColumn("__n", F.size("__pieces").cast("long")).drop("__digests", "__pieces", "__runs", *[f"__bits{k}" for k in range(8)])
    strong = F.transform(F.slice("__sums", 1, 2 * HASHES), lambda x: x.bitwiseAND(F.lit(STRONG - 1)))
    halves = F.slice("__sums", 2 * HASHES + 1, BITS // 2)
    weak = F.concat(F.array("__n"), F.transform(halves, lambda x: x.bitwiseAND(F.lit(STRONG - 1))), F.transform(halves, lambda x: F.shiftrightunsigned(x, 32)))
    return df.withColumn(name, F.concat(strong, F.transform(weak, lambda x: x.bitwiseAND(F.lit(WEAK - 1))))).drop("__sums", "__n")


def combine(a: str | Column, b: str | Column, sign: int = 1) -> Column:
    """The fingerprint of both texts' paragraphs together, or (``sign`` -1) of those of ``a`` without those of ``b``."""
    added = F.zip_with(a, b, lambda x, y: x + y * sign)
    return F.transform(added, lambda x, i: F.when(i < 2 * HASHES, F.pmod(x, F.lit(STRONG))).otherwise(F.pmod(x, F.lit(WEAK))))


def to_hex(fingerprint: str) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x, i: F.lpad(F.hex(x), F.when(i < 2 * HASHES, 8).otherwise(6), F.lit("0"))), ""))


def likeness(a: str, b: str) -> Column:
    """From 0 (no piece of five words shared) to 1 (all shared, or equal fingerprints), from the fingerprints alone."""

    def signed(x: Column) -> Column:
        return F.when(x >= WEAK // 2, x - WEAK).otherwise(x)

    def norm(lanes: Column) -> Column:  # the sum over bits of (2 x (pieces with the bit) - pieces) squared
        of, n = F.slice(lanes, 2, BITS), F.element_at(lanes, 1)
        squares = F.aggregate(of, F.lit(0.0), lambda s, x: s + x * x)
        plain = F.aggregate(of, F.lit(0.0), lambda s, x: s + x)
        return F.lit(4.0) * squares - F.lit(4.0) * n * plain + F.lit(float(BITS)) * n * n

    left, right = (F.transform(F.slice(x, 2 * HASHES + 1, BITS + 1), lambda x: x.cast("double")) for x in (a, b))
    apart = F.zip_with(F.slice(a, 2 * HASHES + 1, BITS + 1), F.slice(b, 2 * HASHES + 1, BITS + 1), lambda x, y: signed(F.pmod(x - y, F.lit(WEAK))).cast("double"))
    whole = norm(left) + norm(right)
    found = F.when(whole > 0, F.lit(1.0) - norm(apart) / whole).otherwise(F.lit(0.0))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0)))


def with_next(docs: DataFrame, take: list[str]) -> DataFrame:
    """Add next_<column> of the following row by descending doc_id; after the last comes the first.

    Ranges of doc_id are dealt out, about ``parts`` of them, and an id that fills a range by itself (such as null) is dealt
    into 256 more, by a hash of its rows' texts, which also orders rows of equal doc_id. The first row of each range also goes, as a guest, to the end of the range before, so that each range finds its neighbours by itself.
    The driver sees a bound a range; the table of first rows, one a range, is lined up by one task and broadcast.
    """
    n = common.parts(docs.sparkSession)
    docs = docs.withColumn("__key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    cuts = docs.agg(F.percentile_approx("__key", [i / n for i in range(1, n)] or [0.5], 10000)).first()[0]
    if cuts is None:
        return docs.drop("__key").withColumns({f"next_{c}": F.col(c) for c in take})
    often = {x for x in cuts if cuts.count(x) > 1}
    docs = docs.withColumn("__tie", F.xxhash64("text") if often else F.lit(0).cast("long"))
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(x).cast("long") for x in cuts])
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    # the number of bounds at most the key, by halving
    at = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & (F.get(bounds, p + s - 1) <= F.col("__key")), p + s).otherwise(p))
    docs = docs.withColumn("__range", at.cast("long") * 257 + 256)
    if often:  # the first byte of the tie, in its order
        docs = docs.withColumn("__range", F.when(F.col("__key").isin(sorted(often)), F.col("__range") - 1 - (F.shiftright("__tie", 56) + 128)).otherwise(F.col("__range")))
    # a row for each range: its first row, and the range that has the row before
    line = Window.orderBy("__guest_of")
    heads = docs.groupBy(F.col("__range").alias("__guest_of")).agg(F.max(F.struct("__key", F.bitwise_not("__tie").alias("__back"))).alias("__head"))
    following = F.coalesce(F.lead("__guest_of").over(line), F.first("__guest_of").over(line))
    heads = heads.select(F.col("__head.__key").alias("__key"), F.bitwise_not(F.col("__head.__back")).alias("__tie"), following.alias("__guest_of"))
    docs = docs.join(F.broadcast(heads), ["__key", "__tie"], "left")
    own = F.struct(F.col("__range").alias("r"), F.lit(False).alias("guest"))
    docs = docs.withColumn("__at", F.explode(F.when(F.col("__guest_of").isNotNull(), F.array(own, F.struct(F.col("__guest_of").alias("r"), F.lit(True).alias("guest")))).otherwise(F.array(own))))
    docs = docs.withColumns({"__range": F.col("__at.r"), "__guest": F.col("__at.guest")}).drop("__at", "__guest_of")
    order = Window.partitionBy("__range").orderBy("__guest", F.desc("__key"), F.xxhash64("text"))
    docs = docs.withColumns({f"next_{c}": F.lead(c).over(order) for c in take})
    return docs.filter(~F.col("__guest")).drop("__key", "__tie", "__range", "__guest")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(with_fingerprint(docs, "text", "fp"), ["text", "fp"])
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("__k", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("__k")).cast("int")), F.substring("next_text", F.lit(1), F.col("__k")))
    both = both.withColumn("edited", edited).drop("text", "next_text", "__k")
    both = with_fingerprint(both, "edited", "edited_fp")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        to_hex("fp").alias("fingerprint"),
        to_hex("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
