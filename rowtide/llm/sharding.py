"""Balanced label propagation: documents with equal texts are drawn into one shard, under quotas that keep shards even.

The links of a group of equal texts run through the text's hash, so a group costs a row for each shard it has members
in, not a row for each pair. In each round every group's members are joined with the shard where most of them are, which
asks for the others; the requests are summed to a matrix of shards by shards, which the driver turns into shares that the
receiving shards have room for. What a group has in a shard moves whole, by a hash against that share; what is more than
the shard asked has room for moves in proportion. A full shard keeps what it has, and the rest of a group that is larger
than a shard gathers elsewhere. Rounds end when nothing is asked for, or after ``ROUNDS``. Documents without links fill
the shards up at the end, with those of a shard that holds too many.

The law is ``rows``: counts differ by one at most. Null and empty texts are equal. Repeated rows are members each; rows
with one doc_id and different texts belong to their texts' groups. Ties between shards are broken by a hash. A very long
text only has its hashes taken. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.llm import common

#: Shards, rounds at most, and the share of its rows from which on a shard asks for no more.
SHARDS, ROUNDS, FULL = 8, 8, 0.97
GROUP = ["g1", "g2"]


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the group of each document: two independent hashes of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.md5(text.cast("binary")), F.lit(1)).alias("g2"))


def unit(*columns: str | Column) -> Column:
    """A number from 0 up to 1 from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def propagate(state: DataFrame, room: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """Move the members of groups (g1, g2, shard, n) for some rounds; ``room``: the rows each shard may hold."""
    k = len(room)
    for turn in range(rounds):
        load = np.zeros(k)
        for shard, n in state.groupBy("shard").agg(F.sum("n")).collect():
            load[shard] = n
        full = [int(s) for s in np.flatnonzero(load >= FULL * room)]
        open_ = ~F.col("shard").isin(full) if full else F.lit(True)
        votes = F.struct(F.when(open_, F.col("n")).otherwise(0), F.xxhash64(*GROUP, "shard"))
        leaders = state.groupBy(*GROUP).agg(F.max_by("shard", votes).alias("to"))
        asked = state.join(leaders, GROUP)  # at most a row for each shard and group
        asked = asked.withColumn("to", F.when(open_ & ~F.col("to").isin(full) if full else F.lit(True), F.col("to")).otherwise(F.col("shard")))
        flow = np.zeros((k, k))
        for a, b, n in asked.filter("shard != to").groupBy("shard", "to").agg(F.sum("n")).collect():
            flow[a, b] = n
        if not flow.sum():
            return state
        share = np.ones(k)
        for _ in range(50):  # what comes in may be as much as there is room for, with what goes out
            out = (flow * share[None, :]).sum(1)
            share = np.clip((room - load + out) / np.maximum(flow.sum(0), 1), 0, 1)
        of = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("to") + 1)
        part, free = of(share), of(np.maximum(room - load, 0))
        moved = F.when(F.col("shard") == F.col("to"), F.col("n")).when(F.col("n") > free, F.floor(F.col("n") * part)).when(unit(*GROUP, "shard", F.lit(turn)) < part, F.col("n")).otherwise(0).cast("long")
        asked = asked.withColumn("moved", moved)
        rows = F.array(F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")), F.struct("shard", (F.col("n") - F.col("moved")).alias("n")))
        state = common.staged(asked.select(*GROUP, F.explode(rows).alias("x")).select(*GROUP, "x.shard", "x.n").filter("n > 0").groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")))
    return state


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of each document (doc_id, text)."""
    docs = common.staged(marked(docs))
    total = docs.count()
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    start = F.pmod(F.xxhash64("doc_id", "g1"), F.lit(shards)).cast("int").alias("shard")
    state = docs.groupBy(*GROUP, start).agg(F.count("*").alias("n"))
    state = state.withColumn("all", F.sum("n").over(Window.partitionBy(*GROUP))).filter("all > 1").drop("all")
    state = propagate(common.staged(state), room, rounds)
    # a group's shards with the share of members up to each; the group's documents are dealt by a hash of their own
    up_to = Window.partitionBy(*GROUP).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*GROUP)
    groups = state.withColumn("up", F.sum("n").over(up_to) / F.sum("n").over(whole)).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("up", "shard"))).alias("places"))
    place = F.element_at(F.filter("places", lambda x: x["up"] > unit("doc_id", F.lit("place"))), 1)["shard"]
    dealt = common.staged(common.joined_evenly(docs, groups, GROUP, "left").select("doc_id", "size", "text_crc32", F.coalesce(place, F.lit(-1)).cast("int").alias("first")))
    held = {s: n for s, n in dealt.groupBy("first").count().collect()}
    kept = np.array([min(held.get(s, 0), room[s]) for s in range(shards)], np.int64)
    over = np.array([held.get(s, 0) - kept[s] for s in range(shards)], np.int64)
    ranked = common.salted_rank(dealt, ["first"], common.id_salt("doc_id"), [F.col("doc_id")], "rank", max(256, common.parts(docs.sparkSession)))

    def pick(values, of: Column) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in values]), of + 1)

    first = F.col("first")
    extra = held.get(-1, 0) + np.concatenate([[0], np.cumsum(over)[:-1]]) - kept  # a surplus row's rank among those that fill up
    spare = F.when(first < 0, F.col("rank")).when(F.col("rank") >= pick(kept, first), F.col("rank") + pick(extra, first))
    ranked = ranked.withColumn("spare", spare)
    ends = np.cumsum(room - kept)
    where = F.size(F.filter(F.array(*[F.lit(int(x)).cast("long") for x in ends]), lambda e: e <= F.col("spare")))
    ranked = ranked.withColumn("shard", F.when(F.col("spare").isNull(), first).otherwise(where).cast("int"))
    slot = F.when(F.col("spare").isNull(), F.col("rank")).otherwise(pick(kept - (ends - (room - kept)), F.col("shard")) + F.col("spare"))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))
