"""Change logs written from plain tables: inputs for the queries, tests and benchmarks."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.functions import codec as C

RAW = "source_id string, file string, seq long, raw binary"
FDE = b"\x04\x00" + b"8.4.0".ljust(50, b"\0") + struct.pack("<I", 0) + b"\x13" + b"\0" * 5 + b"\x01"
BEGIN, COMMIT = (struct.pack("<IIBHH", 1, 0, 0, 0, 0) + b"\0" + word for word in (b"BEGIN", b"COMMIT"))
KINDS = {"INSERT": 30, "UPDATE": 31, "DELETE": 32}
#: Source rows whose events a task holds at once.
ROWS_AT_ONCE = 1000
SIDS = [uuid.UUID(int=1), uuid.UUID(int=2)]
EVENT_COLUMNS = [("event_id", C.LONGLONG, 0), ("ts", C.DATETIME2, 6), ("user_id", C.LONGLONG, 0), ("event_type", C.VARCHAR, 32), ("value", C.DOUBLE, 8), ("props", C.VARCHAR, 255)]


def raw_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["source_id", "file", "seq", "raw"])


def _structs(column: pa.StructArray) -> Iterator[tuple | None]:
    """The rows of a column of structs as tuples; nulls stay."""
    fields = zip(*[column.field(n).to_pylist() for n in range(column.type.num_fields)], strict=True)
    return (row if there else None for row, there in zip(fields, column.is_valid().to_pylist(), strict=True))


def spread(rows: DataFrame) -> DataFrame:
    """The rows in at least as many partitions as there are cores: a small table comes in one, and one task would write its log."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table_log(rows: DataFrame, database: str, table: str, columns: list[tuple[str, int, int]], unsigned: list[bool] | None = None, named: bool = True, per_event: int = 100, kind: int = 30, labels: dict[int, list[str]] | None = None, key: list[int] | None = None) -> DataFrame:
    """Each partition of ``rows`` as a file: a format description, a table map, and row events of some rows each.

    ``columns`` are (name, wire type, meta) in the order of the columns of ``rows``. kind 31 repeats each row as its own
    after-image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, seq = f"part.{TaskContext.get().partitionId():06d}", 2
        yield raw_batch([("log", name, 0, C.event(15, FDE)), ("log", name, 1, C.event(19, C.table_map(7, database, table, columns, unsigned, named, labels, key), next_pos=100))])
        write = C.image_writer(columns)
        for batch in batches:
            fixed = C.fixed_images(columns, batch.columns)
            values = [] if fixed is not None else list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            out = []
            for at in range(0, batch.num_rows, per_event):
                if fixed is not None:
                    rows = fixed[at : at + per_event]
                    images = [(np.concatenate([rows, rows], 1) if kind == 31 else rows).tobytes()]
                else:
                    images = [write(v) for v in values[at : at + per_event]]
                    if kind == 31:
                        images = [x + x for x in images]
                out.append(("log", name, seq, C.event(kind, C.rows_body(7, len(columns), images, kind == 31), next_pos=100 + seq)))
                seq += 1
            yield raw_batch(out)

    return spread(rows).mapInArrow(run, RAW)


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a history of rows by user: an ``error`` deletes the user's row, anything else inserts or updates it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    by = Window.partitionBy("user_id").orderBy("event_id")
    row = F.struct("event_id", "ts", "user_id", "event_type", "value", "props")
    before = F.lag(row).over(by)
    live = before.isNotNull() & (F.lag("event_type").over(by) != "error")
    error = F.col("event_type") == "error"
    op = F.when(~live & error, "NOOP").when(~live, "INSERT").when(error, "DELETE").otherwise("UPDATE")
    made = events.withColumns({"op": op, "before": F.when(live, before), "after": F.when(~error, row)}).filter("op <> 'NOOP'")
    return made.select(
        "event_id",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("seconds"),
        "op",
        "before",
        "after",
        F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("database"),
        F.when(F.col("user_id") % 2 == 0, "sessions").otherwise("items").alias("table"),
        (100 + F.col("user_id") % 6).alias("table_id"),
        F.concat(F.lit("binlog."), F.lpad((1 + F.floor(F.col("event_id") / 2500)).cast("string"), 6, "0")).alias("file"),
        (4 + (F.col("event_id") % 2500 + 1) * 1000).alias("next_pos"),
        (F.col("user_id") % 4).alias("domain"),
    )


def event_log(spark: SparkSession, sf_dir: str, maria: bool = False, damage: int = 0) -> DataFrame:
    """The history as raw events (source_id, file, seq, raw), a file for every 2500 source rows.

    Each file starts with a format description and ends with a ROTATE to the next. Each change is a transaction: GTID,
    BEGIN, the table map where the file hasn't had it yet, the row event, and XID or COMMIT. ``damage``: every row event
    whose source row's number leaves the greatest remainder when divided by it has a wrong byte.
    """
    made = event_changes(spark, sf_dir).repartition("file").sortWithinPartitions("file", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seq, seen, out = None, 0, set(), []
        write = C.image_writer(EVENT_COLUMNS)

        def put(raw: bytes) -> None:
            nonlocal seq
            out.append(("events", file, seq, raw))
            seq += 1

        def close() -> None:
            following = f"binlog.{int(file[7:]) + 1:06d}".encode()
            put(C.event(4, (4).to_bytes(8, "little") + following))

        for batch in batches:
            for at_once in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at_once, ROWS_AT_ONCE)
                named = [part.column(n).to_pylist() for n in ("event_id", "seconds", "next_pos", "table_id", "database", "table", "file", "op", "domain")]
                for k, ts, at, table_id, database, table, name, op, domain, before, after in zip(*named, _structs(part.column("before")), _structs(part.column("after")), strict=True):
                    if name != file:
                        if file is not None:
                            close()
                        file, seq, seen = name, 0, set()
                        put(C.event(15, FDE))
                    if maria:
                        put(C.event(162, struct.pack("<QIB", k + 1, domain, 0), ts, at))
                    else:
                        put(C.event(33, b"\0" + SIDS[k % 2].bytes + struct.pack("<Q", k // 2 + 1), ts, at))
                    put(C.event(2, BEGIN, ts, at))
                    if table_id not in seen:
                        seen.add(table_id)
                        put(C.event(19, C.table_map(table_id, database, table, EVENT_COLUMNS, named=k % 2 == 0), ts, at))
                    images = b"".join([write(v) for v in (before, after) if v is not None])
                    kind = KINDS[op]
                    raw = C.event(kind, C.rows_body(table_id, 6, [images], kind == 31), ts, at)
                    if damage and k % damage == damage - 1:
                        raw = raw[:-5] + bytes([raw[-5] ^ 0xFF]) + raw[-4:]
                    put(raw)
                    put(C.event(16, struct.pack("<Q", k), ts, at) if k % 3 else C.event(2, COMMIT, ts, at))
                yield raw_batch(out)
                out.clear()
        if file is not None:
            close()
            yield raw_batch(out)

    return made.mapInArrow(run, RAW)


def recorded(log: DataFrame, beats: int = 50) -> DataFrame:
    """(file, content): each file of an event log, whose tasks hold files in order, as a recorded connection.

    Heartbeats of all forms come after every so many events. The connections of files with even numbers end with an error.
    """
    from rowtide.sources import captures

    beat = [b"", b"\0", b"\0" + C.event(27, b"binlog")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parts, n = None, [], 0

        def closed() -> pa.RecordBatch:
            if int(file[7:]) % 2 == 0:
                parts.append(captures.packets(b"\xff" + struct.pack("<H", 1236) + b"#HY000" + b"purged " + file.encode(), n))
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([b"".join(parts)], pa.binary())], ["file", "content"])

        for batch in batches:
            for name, raw in zip(batch.column("file").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                if name != file:
                    if file is not None:
                        yield closed()
                    file, parts, n = name, [], 0
                parts.append(captures.packets(b"\0" + raw, n))
                n += 1
                if n % beats == 0:
                    parts.append(captures.packets(beat[n // beats % 3], n))
        if file is not None:
            yield closed()

    return log.mapInArrow(run, "file string, content binary")


def answer(names: list[str], rows: list[list[str | None]], without_end_marks: bool = False) -> bytes:
    """The packets of a server's answer to a text query."""
    from rowtide.sources import captures

    def field(x: str | None) -> bytes:
        return b"\xfb" if x is None else C.pack(len(x.encode())) + x.encode()

    mark, end = b"\xfe\0\0\2\0", b"\xfe\0\0\2\0\0\0" if without_end_marks else b"\xfe\0\0\2\0"
    sent = [C.pack(len(names)), *[b"".join(map(field, ["def", "s", "t", "t", n, n])) + b"\x0c" + b"\0" * 12 for n in names]]
    sent += [] if without_end_marks else [mark]
    sent += [*[b"".join(map(field, r)) for r in rows], end]
    return b"".join(captures.packets(x, 1 + k) for k, x in enumerate(sent))
