"""Transactions along a log: which id is pending, where it commits, and the set committed so far."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.functions import bytes as B
from rowtide.functions import gtid as G
from rowtide.functions import statements as S
from rowtide.operators.decode import carried
from rowtide.sources import folders


#: The kinds of events that may have a mark.
MARKING = [2, 16, 33, 34, 162]


def marks(events: DataFrame) -> DataFrame:
    """Add own_gtid of GTID events, ends, whether an event ends a transaction, and mark: what is pending after the event
    (an id, or nothing as ``""``), null for an event that leaves it as it is."""
    kind = F.col("type_code")
    own = F.when(kind == 33, B.mysql_gtid()).when(kind == 162, B.mariadb_gtid())
    ends = (kind == 16) | ((kind == 2) & S.is_boundary(B.query_text()))
    events = events.withColumns({"own_gtid": own, "ends": F.coalesce(ends, F.lit(False))})
    return events.withColumn("mark", F.when(F.col("own_gtid").isNotNull(), F.col("own_gtid")).when(F.col("ends") | (kind == 34), F.lit("")))


def with_gtid(events: DataFrame) -> DataFrame:
    """Add own_gtid of GTID events, gtid, the pending one at each event, and committed, the one that the event commits.

    A pending id commits at XID, at a boundary statement, or where the next GTID or an anonymous one begins.
    """
    events = carried(marks(events), F.col("mark"), "__before", "__after")
    none = F.lit("")
    pending = F.when(F.col("ends"), F.col("__before")).otherwise(F.col("__after"))
    out = events.withColumns({"gtid": F.nullif(pending, none), "committed": F.when(F.col("mark").isNotNull(), F.nullif(F.col("__before"), none))})
    return out.drop("__before", "__after", "ends", "mark")


def commits(marked: DataFrame) -> DataFrame:
    """(source_id, file, seq, gtid): each id once, at the event that commits it."""
    return marked.filter("committed is not null").select("source_id", "file", "seq", F.col("committed").alias("gtid"))


def singles(done: DataFrame) -> DataFrame:
    """(source_id, sid, start, end): a range for each MySQL id of ``commits``."""
    part = done.select("source_id", F.split("gtid", ":").alias("p")).select("source_id", F.col("p")[0].alias("sid"), F.col("p")[1].cast("long").alias("start"))
    return part.withColumn("end", F.col("start") + 1)


def committed_set(done: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(source_id, gtid_set): MySQL ids committed, with those of a baseline (source_id, gtid_set), in canonical text."""
    part = singles(done)
    if baseline is not None:
        part = part.union(G.ranges(baseline, "gtid_set", "source_id"))
    return G.set_text(G.merged(part, "source_id", "sid"), "source_id")


def ranges_of(body: bytes) -> list[tuple[str, int, int]]:
    """The ranges of a set in the form of the wire, as in a PREVIOUS_GTIDS body, all or none."""
    try:
        (n,), at, out = struct.unpack_from("<Q", body), 8, []
        for _ in range(n):
            sid, k = str(uuid.UUID(bytes=body[at : at + 16])), struct.unpack_from("<Q", body, at + 16)[0]
            at += 24
            for _ in range(k):
                start, end = struct.unpack_from("<QQ", body, at)
                if not 1 <= start < end < G.LIMIT:
                    return []
                out.append((sid, start, end))
                at += 16
        return out if at == len(body) else []
    except (struct.error, ValueError):
        return []


def list_of(body: bytes) -> list[tuple[str, int, int]]:
    """(domain, server, sequence) of a GTID_LIST body, all or none; the count is in the low 28 bits."""
    if len(body) < 4:
        return []
    n = int.from_bytes(body[:4], "little") & (1 << 28) - 1
    if n > 1_000_000 or len(body) < 4 + 16 * n:
        return []
    return [(str(d), s, q) for d, s, q in (struct.unpack_from("<IIQ", body, 4 + 16 * k) for k in range(n)) if q < 1 << 63]


def baselines(events: DataFrame) -> DataFrame:
    """(source_id, file, seq, kind, sid, a, b) of the sets that logs begin with.

    kind mysql: a range of ``sid`` from a up to b. kind mariadb: of domain ``sid``, server a and sequence b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, file, seq, code, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                kind, found = ("mysql", ranges_of(body)) if code == 35 else ("mariadb", list_of(body))
                rows += [(source, file, seq, kind, *x) for x in found]
            if rows:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["source_id", "file", "seq", "kind", "sid", "a", "b"])

    some = events.filter(F.col("type_code").isin(35, 163)).select("source_id", "file", "seq", "type_code", "body")
    return some.mapInArrow(run, "source_id string, file string, seq long, kind string, sid string, a long, b long")


def _told(marked: DataFrame, code: int, read: Callable[[bytes], list[tuple]], own: list[Column]) -> DataFrame:
    """(source_id, sid, a, b) of what events commit, which ``own`` tells, and of the sets that ``read`` finds in the events
    ``code``: in one pass, since each pass over a marked log lines it up anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.is_valid(batch.column("committed"))).select(["source_id", "sid", "a", "b"])
            held = batch.filter(pc.is_valid(batch.column("body")))
            rows = [(source, *x) for source, body in zip(held.column("source_id").to_pylist(), held.column("body").to_pylist(), strict=True) for x in read(body)]
            if rows:
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays([*made[:3], made[3].cast(pa.decimal128(20, 0))], ["source_id", "sid", "a", "b"])

    body = F.when(F.col("type_code") == code, F.col("body")).alias("body")
    some = marked.filter(F.col("committed").isNotNull() | (F.col("type_code") == code))
    some = some.select("source_id", *[c.alias(n) for n, c in zip(["sid", "a", "b"], own, strict=True)], "committed", body)
    return some.mapInArrow(run, "source_id string, sid string, a long, b decimal(20,0)")


def checkpoint(marked: DataFrame) -> DataFrame:
    """(source_id, gtid_set): what a log's own baselines and its committed transactions come to, MySQL form."""
    part = F.split("committed", ":")
    n = F.get(part, F.lit(1)).cast("long")
    told = _told(marked, 35, ranges_of, [F.get(part, F.lit(0)), n, (n + 1).cast("decimal(20,0)")])
    return G.set_text(G.merged(told.select("source_id", "sid", F.col("a").alias("start"), F.col("b").cast("long").alias("end")), "source_id", "sid"), "source_id")


def mariadb_checkpoint(marked: DataFrame) -> DataFrame:
    """(source_id, domain, server, seq): as ``checkpoint`` in MariaDB form, the highest sequence of each domain."""
    part = F.split("committed", "-")
    told = _told(marked, 163, list_of, [F.get(part, F.lit(0)), F.get(part, F.lit(1)).try_cast("long"), F.get(part, F.lit(2)).try_cast("decimal(20,0)")])
    return G.high_water(told.select("source_id", F.col("sid").cast("long").alias("domain"), F.col("a").alias("server"), F.col("b").alias("seq")), "source_id")


def resume_position(events: DataFrame) -> DataFrame:
    """(source_id, log_file, offset): where reading a log would go on, after the last of its events (with header).

    An aggregate with one row a source, so it holds for batches and, with that row as its state, for streams. The file is
    the one that the last ROTATE names (empty before the first); damaged events and next positions of 0 change nothing.
    """
    place, rotate = F.struct("file", "seq"), F.col("type_code") == 4
    at = F.when(F.col("crc_ok"), F.when(rotate, B.rotate_position().cast("long")).when(F.col("next_pos") > 0, F.col("next_pos")))
    told = events.select("source_id", F.when(rotate & F.col("crc_ok"), F.struct(place.alias("p"), B.rotate_file().alias("v"))).alias("f"), F.when(at.isNotNull(), F.struct(place.alias("p"), at.alias("v"))).alias("o"))
    last = told.groupBy("source_id").agg(F.max("f").alias("f"), F.max("o").alias("o"))
    return last.select("source_id", F.coalesce("f.v", F.lit("")).alias("log_file"), F.coalesce("o.v", F.lit(0)).alias("offset"))


def staged_set(done: DataFrame) -> DataFrame:
    """The merged ranges (source_id, sid, start, end) of a set (source_id, gtid_set), in the shared folder."""
    return folders.staged(G.merged(G.ranges(done, "gtid_set", "source_id"), "source_id", "sid"), "set")


def resume_after(marked: DataFrame, done: DataFrame) -> DataFrame:
    """The events of transactions that aren't in a set (source_id, gtid_set), and those outside of any transaction.

    Ranges of the set are merged first, so a transaction meets at most one of them. ``marked`` has gtid from ``with_gtid``,
    or from the reader of the files: then it may be a stream, which finds the merged set in the shared folder at each trigger.
    Streams that share a set are given what ``staged_set`` makes of it.
    """
    if "gtid_set" not in done.columns:
        held = done
    else:
        held = staged_set(done) if marked.isStreaming else G.merged(G.ranges(done, "gtid_set", "source_id"), "source_id", "sid")
    held = held.select(F.col("source_id").alias("__s"), F.col("sid").alias("__sid"), "start", "end")
    own = F.split("gtid", ":")
    rows = marked.withColumns({"__own": F.get(own, F.lit(0)), "__n": F.get(own, F.lit(1)).try_cast("long")})
    same = [F.col("source_id") == F.col("__s"), F.col("__own") == F.col("__sid"), F.col("__n") >= F.col("start"), F.col("__n") < F.col("end")]
    return rows.join(held, same, "left_anti").select(*marked.columns)
