"""Near-duplicates by 64-bit SimHash, joined through popcounts of fingerprint segments.

A fingerprint is cut into 32 segments of two bits; its embedding is the vector of their bit counts. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so every link lies within that
distance in the embedding. The 32 coordinates are dealt into groups: a distance of at most ``most`` leaves at least
groups - most of them without any difference, so the cells of a grid are the choices of that many groups with their
counts, and each link meets in at least one cell. More fingerprints are dealt into more groups, which changes the work
and never the links. Within a cell the distance itself is checked. A cell gives a
forest that spans its links, never all of its pairs; cells with many fingerprints are dealt into blocks, and each pair
of blocks is a task's work of its own.

With ``bands`` (the pipeline's wide fingerprints, whose links span far more bits than a grid can be complete for) the
cells come from the shingles instead: in each band, texts meet that agree in ``ROWS`` minimum hashes of their multisets
of shingles. Two texts that share a part s of their shingles miss each other with the chance (1 - s^ROWS)^bands, however
many texts there are.

Equal fingerprints count once, so exact copies cost nothing. Connected components come from Spark rounds over the
forest's links, with a written table between rounds.

Null and empty texts have no words: fingerprint zero, linked like any other. Rows with the same doc_id keep a row each,
whatever their texts; a bit that is set in just half the shingles is 0. A very long text is read by one task. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import common

MOST, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of a cell that one task compares with each other, and the minimum hashes of a band.
BLOCK, ROWS = 4096, 4

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def columns(words: int) -> list[str]:
    return ["fp", *[f"fp{k + 1}" for k in range(1, words)]]


def fingerprint(shingles: np.ndarray) -> int:
    """The majority of each bit; a tie is 0."""
    if not len(shingles):
        return 0
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(shingles), bitorder="little").view("<u8")[0])


def sketch(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key for each band: the minimum hashes, one a factor, of the shingles and how often each came before."""
    shingles = np.sort(shingles)
    new = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
    before = np.arange(len(shingles)) - np.repeat(new, np.diff(np.append(new, len(shingles))))
    x = common.mixed(shingles + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = np.full(len(factors), (1 << 64) - 1, np.uint64)
    for at in range(0, len(x), 4096):
        low = np.minimum(low, (x[at : at + 4096, None] * factors).min(0))
    low = low.reshape(-1, ROWS)
    keys = np.arange(len(low), dtype=np.uint64)
    for k in range(ROWS):
        keys = common.mixed(keys + low[:, k])
    return keys


def fingerprints(docs: DataFrame, width: int = SHINGLE, words: int = 1, bands: int = 0) -> DataFrame:
    """doc_id and the fingerprint (signed longs of the same bits) of each document (doc_id, text); with ``bands`` their keys.

    Words after the first take their bits from a one-to-one mix of the shingles' hashes.
    """
    salts = np.random.default_rng(SEED).integers(1, 1 << 63, words, np.uint64)
    factors = np.random.default_rng(SEED + 1).integers(1, 1 << 63, bands * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh64_intdigest
        for batch in common.small_batches(batches):
            data, offsets = common.text_buffer(batch.column("text"))
            data = LOWER[data]
            starts, ends, first = common.word_spans(data, offsets, IS_WORD)
            # one space between words, rows back to back: each shingle is then a slice
            lengths = ends - starts
            at = np.cumsum(lengths + 1) - lengths - 1
            keep = IS_WORD[data]
            flat = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
            flat[np.repeat(at - starts, lengths) + np.flatnonzero(keep)] = data[keep]
            raw, to = flat.tobytes(), at + lengths
            made, keys = np.zeros((words, batch.num_rows), np.uint64), np.zeros((batch.num_rows, bands), np.uint64)
            for i in range(batch.num_rows):
                a, b = first[i], first[i + 1]
                if a < b:
                    n = max(1, b - a - width + 1)
                    pairs = zip(at[a : a + n].tolist(), to[min(a + width, b) - 1 : b].tolist(), strict=True)
                    shingles = np.array([h(raw[s:e], SEED) for s, e in pairs], np.uint64)
                    made[0, i] = fingerprint(shingles)
                    for k in range(1, words):
                        made[k, i] = fingerprint(common.mixed(shingles ^ salts[k]))
                    if bands:
                        keys[i] = sketch(shingles, factors)
            out, names = [batch.column("doc_id"), *[pa.array(x.view(np.int64)) for x in made]], ["doc_id", *columns(words)]
            if bands:
                every = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).reshape(-1)))
                out, names = [*out, every], [*names, "bands"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long" + "".join(f", {c} long" for c in columns(words)) + ", bands array<long>" * (bands > 0))


def enough_groups(points: int, most: int = MOST, per_cell: int = 1000) -> int:
    """The fewest groups with which random fingerprints meet about ``per_cell`` others in a cell, or fewer."""
    groups = most + 2
    while groups < 31 and points * 0.375 ** (32 * (groups - most) / groups) > per_cell:  # 3/8: two equal counts of two bits
        groups += 1
    return groups


def cells(points: DataFrame, most: int, groups: int) -> DataFrame:
    """(node, fp, salt, cell): for each fingerprint the choices of groups - most groups of its embedding."""
    each = [range(g, 32, groups) for g in range(groups)]  # coordinates of a group
    count = [sum((F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(3 << 2 * c)))).cast("long") * 3**k for k, c in enumerate(each[g])), F.lit(0).cast("long")) for g in range(groups)]
    points = points.select("node", "fp", F.xxhash64("fp").alias("salt"), *[x.alias(f"g{g}") for g, x in enumerate(count)])
    keys, choices = [], list(combinations(range(groups), groups - most))
    for at, chosen in enumerate(choices):
        key, scale = F.lit(at).cast("long"), len(choices)
        for g in chosen:
            key, scale = key + F.col(f"g{g}") * scale, scale * 3 ** len(each[g])
        keys.append(key)
    return points.select("node", "fp", "salt", F.explode(F.array(*keys)).alias("cell"))


def band_cells(marked: DataFrame, points: DataFrame, names: list[str]) -> DataFrame:
    """(node, fp..., salt, cell): for each fingerprint the bands of all texts that have it, where it meets another one.

    Only nodes and bands are compared at first; fingerprints then travel for the bands that are shared.
    """
    some = common.staged(marked.select(*names, "bands").distinct().join(points, names).select("node", *names, "bands"))
    keyed = common.staged(some.select("node", F.explode("bands").alias("cell")).distinct())
    shared = keyed.groupBy("cell").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("cell")
    met = common.joined_evenly(keyed, shared, ["cell"])
    return met.join(some.select("node", *names).distinct(), "node").select("node", *names, F.xxhash64("node").alias("salt"), "cell")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def apart(fps: list[np.ndarray], i, j) -> np.ndarray:
    """Bits that differ between the rows i and j of the words' columns."""
    return sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int16) for x in fps)


def linked(fps: list[np.ndarray], i, j, most: int, first: int) -> np.ndarray:
    """Whether the rows i and j differ by at most ``most`` bits, of the first word by at most ``first``."""
    near = np.bitwise_count(fps[0][i] ^ fps[0][j]) <= first
    if len(fps) > 1 and near.any():
        at = np.flatnonzero(near)
        near[at] = apart(fps, i[at], j if np.ndim(j) == 0 else j[at]) <= most
    return near


def spanning(fps: list[np.ndarray], left: np.ndarray, most: int, first: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """A forest over the links of a cell: from each point reached, the points not reached before that link to it.

    ``left``: the side of each point, where only pairs of different sides are asked for; else all the same.
    """
    sides = len(left) and left.min() != left.max()
    rest = np.arange(len(left))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = linked(fps, rest, i, most, min(first, most))
            if sides:
                near &= left[rest] != left[i]
            if near.any():
                hit = rest[near]
                yield i, hit
                queue += hit.tolist()
                rest = rest[~near]


def links(points: DataFrame, most: int = MOST, groups: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links between nodes of different fingerprints (node, fp) that give the same components as all links."""
    return links_within(cells(points, most, groups or enough_groups(points.count(), most)), ["fp"], most, block)


def links_within(dealt: DataFrame, names: list[str], cut: int, block: int = BLOCK, first: int = 64) -> DataFrame:
    """(a, b): links that give the same components as all links within the cells (node, fp..., salt, cell).

    Fingerprints link at ``cut`` or fewer differing bits of all words, if the first word differs by at most ``first``
    bits, which spares most pairs the comparison of the others.
    """
    spark = dealt.sparkSession
    large = dealt.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    large = common.staged(large)
    if large.isEmpty():
        rows = dealt.select("node", *names, "cell", F.lit(0).alias("part"), F.lit(0).alias("side"))
    else:
        own = F.pmod("salt", F.col("blocks")).cast("int")
        both = dealt.join(large, "cell", "left").withColumn("own", F.coalesce(own, F.lit(0)))
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("other")
        both = both.select("node", *names, "cell", "own", F.coalesce("blocks", F.lit(1)).alias("blocks"), other)
        # a pair of blocks is one part; a block's own pairs are the part of it with itself
        part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
        rows = both.select("node", *names, "cell", part.cast("int").alias("part"), "own").withColumnRenamed("own", "side")

    def found(cell, part, node, side, *fps):
        new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]))
        ends = np.append(new[1:], len(node))
        a, b = [], []
        small = np.repeat(ends, ends - new)  # where each row's run ends
        size = ends - new
        tiny = size <= 64
        for d in range(1, int(size[tiny].max(initial=1))):  # all runs that are short, pairs at each distance at once
            i = np.flatnonzero(np.repeat(tiny & (size > d), size) & (np.arange(len(node)) + d < small))
            i = i[linked(fps, i, i + d, cut, min(first, cut))]
            a.append(i)
            b.append(i + d)
        for s, e in zip(new[~tiny].tolist(), ends[~tiny].tolist(), strict=True):
            for i, hit in spanning([x[s:e] for x in fps], side[s:e], cut, first):
                a.append(np.full(len(hit), s + i))
                b.append(s + hit)
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        # each row that is linked goes to the smallest node it reaches within the cell: rows are in order of nodes, and
        # so all cells that hold a group give the same links
        least = np.arange(len(node))
        while len(a):
            low = np.minimum(least[a], least[b])
            if (low == least[a]).all() and (low == least[b]).all():
                break
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
            least = least[least]
        far = np.flatnonzero(least != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[least[far]]), pa.array(node[far])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            got = [batch.column(n).to_numpy() for n in ("cell", "part", "node", "side")] + [batch.column(n).to_numpy().view(np.uint64) for n in names]
            held = [np.concatenate(x) for x in zip(held, got, strict=True)] if held else got
            cell, part = held[0], held[1]
            if not len(cell):
                continue
            last = np.flatnonzero((cell != cell[-1]) | (part != part[-1]))  # the last run may go on in the next batch
            to = int(last[-1]) + 1 if len(last) else 0
            if to:
                yield found(*[x[:to] for x in held])
            held = [x[to:] for x in held]
        if held and len(held[0]):
            yield found(*held)

    rows = rows.repartition(common.parts(spark), "cell", "part").sortWithinPartitions("cell", "part", "node")
    return rows.select("cell", "part", "node", "side", *names).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link (a, b): component is the smallest node reachable.

    Alternates two steps until nothing changes, with a written table between: every node's larger neighbours are linked
    to its smallest neighbour, then its smaller ones are. Paths shorten by a factor each round.

    A node with very many links is no task of its own: ``joined_evenly`` broadcasts what the few such nodes are linked to.
    """
    edges = common.staged(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct())
    before = None
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
        large = common.staged(common.joined_evenly(edges, low, ["lo"]).select("hi", F.col("m").alias("lo")).distinct())
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        edges = common.joined_evenly(large, small, ["hi"]).select(F.explode(pairs).alias("x")).select("x.hi", "x.lo").filter("hi != lo").distinct()
        edges = common.staged(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct()).distinct()
        before = now


def near_duplicates(docs: DataFrame, most: int = MOST, width: int = SHINGLE, groups: int | None = None, words: int = 1, first: int = 64, bands: int = 0) -> DataFrame:
    """doc_id, fp..., component_id for each row of documents (doc_id, text); several words need ``bands``."""
    names = columns(words)
    marked = common.staged(fingerprints(docs, width, words, bands))
    points = common.staged(marked.groupBy(*names).agg(F.min("doc_id").alias("node")))
    known = points.filter("node is not null")
    joined = components(links_within(band_cells(marked, known, names), names, most, first=first) if bands else links(known, most, groups))
    named = common.staged(points.join(joined, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id")))
    return common.joined_evenly(marked.drop("bands"), named, names).select("doc_id", *names, "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, most: int = MOST, width: int = SHINGLE, words: int = 1, first: int = 64, bands: int = 0) -> DataFrame:
    """The rows and columns of ``docs`` without documents that have a smaller doc_id in their group.

    Rows with equal doc_id are one document; rows without a doc_id stay.
    """
    found = near_duplicates(docs, most, width, None, words, first, bands)
    rest = docs.filter("doc_id is not null").join(found.filter("doc_id > component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    return rest.select(*docs.columns).union(docs.filter("doc_id is null"))
