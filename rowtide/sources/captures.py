"""Recorded connections of servers: the bytes that came from a socket, as packets in files, read by Spark tasks.

A packet is three bytes of length, a number, and content; content of the greatest length goes on in the next packet.
``read_events`` takes the answers to a dump request, which are log events with a mark in front, and gives rows that
``decode.changes`` reads like those of log files. ``read_results`` takes answers to text queries, and ``columns`` makes of
answers to SHOW COLUMNS what ``decode.registry`` needs. ``read_requests`` takes what a client sent: its queries, and where it
asked a log to begin. A file is one side of a connection, read from its first answer or request on by one task.

Heartbeats (empty answers, and events of that kind) carry nothing and are no rows. An error, an end mark, any other mark
and a file that ends within a packet end the connection: its last row has an error code, with what the server said.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.functions import bytes as B
from rowtide.functions import codec
from rowtide.functions.errors import ConnectionEnded, ParseError, RequestRefused
from rowtide.operators import transactions
from rowtide.sources import framing

#: The greatest length of a packet's content, marks of an answer, the kind of heartbeat events, most columns.
FULL, OK, END, ERROR, HEARTBEAT, MAX_COLUMNS = 0xFFFFFF, 0x00, 0xFE, 0xFF, 27, 4096
EVENTS = framing.FRAMED + ", server_code int, message string"
RESULTS = "file string, result int, row int, names array<string>, values array<string>, error_code int, server_code int, message string"


def packets(content: bytes, number: int = 0) -> bytes:
    """An answer as packets, the first with this number."""
    out, at = [], 0
    while True:
        part = content[at : at + FULL]
        out.append(len(part).to_bytes(3, "little") + bytes([number % 256]) + part)
        at, number = at + FULL, number + 1
        if len(part) < FULL:
            return b"".join(out)


def contents(data: memoryview, limit: int) -> Iterator[bytes]:
    """The answers of a connection; ``ConnectionEnded`` after the last whole one if a part of one follows or it is too long."""
    at, parts, size = 0, [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 3], "little")
        size += n
        if at + 4 + n > len(data) or size > limit:
            raise ConnectionEnded("a packet is cut off or too long")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
        if n < FULL:
            yield b"".join(parts)
            parts, size = [], 0
    if parts:
        raise ConnectionEnded("a packet is cut off or too long")


def refused(content: bytes) -> tuple[int, str]:
    """Number and text of an error; a state of five characters may stand between them."""
    if len(content) < 3:
        return 0, "unknown error"
    return int.from_bytes(content[1:3], "little"), content[9 if content[3:4] == b"#" else 3 :].decode("utf-8", "replace")


def events_of(data: memoryview, limit: int) -> Iterator[tuple[bytes, int, int | None, str | None]]:
    """(event, error code, the server's code and message) of the answers to a dump request."""
    try:
        for content in contents(data, limit + 1):
            mark = content[0] if content else OK
            if mark == ERROR:
                yield b"", ConnectionEnded.code, *refused(content)
                return
            if mark != OK:
                yield b"", ConnectionEnded.code, None, "end of the stream" if mark == END else f"answer with mark {mark}"
                return
            if len(content) > 1 and not (len(content) > 5 and content[5] == HEARTBEAT):
                raw = content[1:]
                whole = len(raw) >= 19 and int.from_bytes(raw[9:13], "little") == len(raw)
                yield (raw, 0, None, None) if whole else (b"", ParseError.code, None, "event of another length than its packet")
    except ConnectionEnded as e:
        yield b"", e.code, None, str(e)


def events(files: DataFrame, limit: int = framing.DEFAULT_EVENT, source_id: str = "log") -> DataFrame:
    """As ``framing.read_files``, from a frame (file, content) of recorded answers to dump requests, with server_code and message."""
    limit = framing.size_limit(limit)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in EVENTS.split(", ")]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                held, size, follower = [], 0, framing.Follower()
                data = memoryview(content.as_buffer()) if content.is_valid else memoryview(b"")
                for seq, (raw, code, server_code, message) in enumerate(events_of(data, limit)):
                    held.append((source_id, name, seq, raw, code, *follower.see(seq, raw), server_code, message))
                    size += len(raw)
                    if size > 4 << 20 or len(held) >= framing.AT_ONCE:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    return files.select("file", "content").mapInArrow(run, EVENTS)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read_events(spark: SparkSession, path: str, limit: int = framing.DEFAULT_EVENT, source_id: str = "log") -> DataFrame:
    return events(_files(spark, path), limit, source_id)


def _fields(content: bytes, at: int = 0) -> list[bytes | None]:
    """The strings of a row, each behind its length; 251 stands for null."""
    out = []
    while at < len(content):
        if content[at] == 251:
            out.append(None)
            at += 1
            continue
        n, at = codec.packed(content, at)
        if at + n > len(content):
            raise ParseError("row of a result is cut off")
        out.append(content[at : at + n])
        at += n
    return out


def _text(x: bytes | None) -> str | None:
    return None if x is None else x.decode("utf-8", "replace")


def results_of(data: memoryview, without_end_marks: bool = False) -> Iterator[tuple]:
    """(result, row, names, values, error code, server_code, message) of the answers to text queries, one after the other.

    A result counts as a whole: one that fails is one row with its error. ``without_end_marks``: how the connection was set
    up, that no mark stands between columns and rows, and that rows end with a longer one.
    """
    answers = contents(data, framing.MOST_EVENT)

    def take() -> bytes:
        found = next(answers, None)
        if found is None:
            raise ConnectionEnded("the connection ends within a result")
        return found

    number = -1
    while True:
        made, number = [], number + 1
        try:
            first = next(answers, None)
            if first is None:
                return
            if not first:
                raise ConnectionEnded("empty answer")
            if first[0] == OK:
                continue
            if first[0] == ERROR:
                yield number, None, None, None, RequestRefused.code, *refused(first)
                continue
            n, _ = codec.packed(first, 0)
            if n > MAX_COLUMNS:
                raise ParseError("result of too many columns")
            names = [_text(_fields(take())[4]) for _ in range(n)]
            if not without_end_marks and not ((mark := take())[:1] == bytes([END]) and len(mark) < 9):
                raise ConnectionEnded("no mark between columns and rows")
            while True:
                content = take()
                if not content:
                    continue
                if content[0] == END and (len(content) >= 7 if without_end_marks else len(content) < 9):
                    break
                if content[0] == ERROR:
                    made = [(number, None, None, None, ConnectionEnded.code, *refused(content))]
                    break
                values = [_text(x) for x in _fields(content)]
                if len(values) != n:
                    raise ParseError("row of a result has another number of values")
                made.append((number, len(made), names, values, 0, None, None))
            yield from made
        except (ConnectionEnded, ParseError, IndexError) as e:
            yield number, None, None, None, getattr(e, "code", ParseError.code), None, str(e)
            return


def results(files: DataFrame, without_end_marks: bool = False) -> DataFrame:
    """The rows of recorded answers to text queries, from a frame (file, content); results and their rows count from 0."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in RESULTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows = [(name, *r) for r in results_of(memoryview(content.as_buffer()) if content.is_valid else memoryview(b""), without_end_marks)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 10_000], strict=True), kinds, strict=True)], names)

    return files.select("file", "content").mapInArrow(run, RESULTS)


def read_results(spark: SparkSession, path: str, without_end_marks: bool = False) -> DataFrame:
    return results(_files(spark, path), without_end_marks)


#: Commands, the flag of a request that goes by a set, and how a MariaDB client tells its set beforehand.
QUERY, DUMP, DUMP_GTID, THROUGH_SET = 0x03, 0x12, 0x1E, 0x04
STATE = re.compile(r"(?is)^\s*SET\s+@slave_connect_state\s*=\s*'([^']*)'")
SHOWN = r"(?is)^\s*SHOW\s+(?:FULL\s+)?COLUMNS\s+FROM\s+`((?:[^`]|``)*)`\.`((?:[^`]|``)*)`"
REQUESTS = "file string, request int, command string, statement string, server_id long, log_file string, position long, flags int, gtid_set string, error_code int"


def dump_request(server_id: Column, encoded: Column, log_file: Column | str = "", position: Column | int = 4, flags: Column | int = 0) -> Column:
    """The content of a request for a log's events after a set (``gtid.encoded``: hexadecimal text, empty for none), as bytes."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    name, sent = lit(log_file).cast("binary"), F.unhex(encoded)
    flag = F.when(F.length(sent) > 0, lit(flags).bitwiseOR(THROUGH_SET)).otherwise(lit(flags))
    return F.concat(F.lit(bytes([DUMP_GTID])), B.to_le(flag, 2), B.to_le(server_id, 4), B.to_le(F.length(name), 4), name, B.to_le(lit(position), 8), B.to_le(F.length(sent), 4), sent)


def request_of(content: bytes, state: str | None) -> tuple:
    """command, statement, server_id, log_file, position, flags, gtid_set and error code of a request; ``state`` is a set told before."""
    command = content[0] if content else None
    if command == QUERY:
        return "QUERY", content[1:].decode("utf-8", "replace"), None, None, None, None, None, 0
    try:
        if command == DUMP:
            position, flags, server = struct.unpack_from("<IHI", content, 1)
            return "DUMP", None, server, content[11:].decode("utf-8", "replace"), position, flags, state, 0
        if command == DUMP_GTID:
            flags, server, n = struct.unpack_from("<HII", content, 1)
            position, size = struct.unpack_from("<QI", content, 11 + n)
            body = content[23 + n :]
            if len(body) != size or position >= 1 << 63:
                raise ParseError("request of another length")
            found = transactions.ranges_of(body) if size else []
            if not found and size and body != bytes(8):
                raise ParseError("request with a damaged set")
            return "DUMP_GTID", None, server, content[11 : 11 + n].decode("utf-8", "replace"), position, flags, _set_text(found), 0
    except (struct.error, ParseError):
        return "DUMP" if command == DUMP else "DUMP_GTID", None, None, None, None, None, None, ParseError.code
    return "OTHER", None, None, None, None, None, None, 0


def _set_text(ranges: list[tuple[str, int, int]]) -> str:
    by: dict[str, list[str]] = {}
    for sid, start, end in ranges:
        by.setdefault(sid, []).append(str(start) if end == start + 1 else f"{start}-{end - 1}")
    return ",".join(":".join([sid, *parts]) for sid, parts in by.items())


def requests(files: DataFrame) -> DataFrame:
    """The requests of recorded clients, from a frame (file, content), counted from 0 in each file.

    A damaged request has an error code, and so has the end of a file that ends within one. The set of a MariaDB client
    is the one it told in a statement before.
    """
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32()]
    names = [x.split()[0] for x in REQUESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows, state = [], None
                try:
                    for sent in contents(memoryview(content.as_buffer()) if content.is_valid else memoryview(b""), framing.MOST_EVENT):
                        row = request_of(sent, state)
                        if row[0] == "QUERY" and (told := STATE.match(row[1])):
                            state = told.group(1)
                        rows.append((name, len(rows), *row))
                except ConnectionEnded as e:
                    rows.append((name, len(rows), *[None] * 7, e.code))
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 10_000], strict=True), kinds, strict=True)], names)

    return files.select("file", "content").mapInArrow(run, REQUESTS)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return requests(_files(spark, path))


def asked(found: DataFrame) -> DataFrame:
    """(file, result, database, table) of the requests for a table's columns, for ``columns``: the answers to queries come in
    the order of the queries, so a result's number is how many queries come before its own."""
    order = Window.partitionBy("file").orderBy("request")
    queries = found.filter("command = 'QUERY'").withColumn("result", F.row_number().over(order) - 1)
    name = lambda k: F.replace(F.regexp_extract("statement", SHOWN, k), F.lit("``"), F.lit("`"))
    return queries.filter(F.col("statement").rlike(SHOWN)).select("file", "result", name(1).alias("database"), name(2).alias("table"))


def columns(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(database, table, ordinal, name, type) from answers to SHOW COLUMNS; ``asked`` (file, result, database, table) tells
    which table each was about. Failed answers and rows of less than two values tell nothing."""
    rows = found.filter((F.col("error_code") == 0) & (F.size("values") >= 2)).join(asked, ["file", "result"])
    return rows.select("database", "table", F.col("row").alias("ordinal"), F.get("values", F.lit(0)).alias("name"), F.get("values", F.lit(1)).alias("type"))
