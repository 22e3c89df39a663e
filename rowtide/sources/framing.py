"""Change-log files as rows of raw events.

``read_files`` scans whole files in parallel, one task for each file, and yields an event at a time. The format
``rowlog`` does the same as a Spark data source, for batches and for streams over a growing folder.
"""

from __future__ import annotations

import bisect
import glob
import json
import operator
import os
import struct
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from rowtide.functions import bytes as B
from rowtide.functions import statements as S
from rowtide.functions.errors import ParseError

MAGIC = b"\xfebin"
# Fixed limits: the default, the most, and the least size of an event.
DEFAULT_EVENT, MOST_EVENT, LEAST_EVENT = 64 << 20, 1 << 30, 23
#: Bytes of a file that are read at once.
CHUNK = 8 << 20
#: Events that a task holds at once, however small.
AT_ONCE = 10_000
SCHEMA = "source_id string, file string, seq long, raw binary, error_code int"


def size_limit(asked: int) -> int:
    """0 asks for the most; anything else is kept between the least and the most."""
    return MOST_EVENT if asked == 0 else min(max(asked, LEAST_EVENT), MOST_EVENT)


class Framer:
    """Cuts a byte stream that arrives in any chunks into events; what is incomplete waits for the next chunk."""

    def __init__(self, limit: int = DEFAULT_EVENT):
        self.limit, self.rest, self.failed = size_limit(limit), b"", False

    def feed(self, chunk: bytes) -> Iterator[bytes]:
        if self.failed:
            raise ParseError("the stream has failed and needs a reset")
        data, at = self.rest + chunk, 0
        while len(data) - at >= 19:
            n = struct.unpack_from("<I", data, at + 9)[0]
            if not 19 <= n <= self.limit:
                self.failed = True
                raise ParseError(f"event of {n} bytes")
            if len(data) - at < n:
                break
            yield data[at : at + n]
            at += n
        self.rest = data[at:]

    def reset(self) -> None:
        self.rest, self.failed = b"", False


def events_of(chunks: Iterator[bytes], limit: int = DEFAULT_EVENT, closed: bool = True) -> Iterator[tuple[bytes, int]]:
    """(event, error code) of a file's content, in chunks of any sizes; a file may start with four magic bytes.

    A bad length ends the file with an error, and so does an event that is cut off, if the file is ``closed``.
    """
    framer, head = Framer(limit), b""
    try:
        for chunk in chunks:
            if head is not None:
                head += chunk
                if len(head) < 4:
                    continue
                chunk, head = head[4:] if head[:4] == MAGIC else head, None
            for raw in framer.feed(chunk):
                yield raw, 0
    except ParseError:
        yield b"", ParseError.code
        return
    if closed and (framer.rest or head):
        yield b"", ParseError.code


class Follower:
    """What a file's events have declared so far: checksums, the table maps by the tables' numbers, and the transaction's id.

    Transactions don't go on in the next file of a log, so a file's own events are enough to know their ids.
    """

    def __init__(self):
        self.declared: bool | None = None
        self.maps: dict[bytes, tuple[int, bytes]] = {}
        self.gtid: str | None = None

    def see(self, seq: int, raw: bytes) -> tuple[bool | None, int | None, bytes | None, str | None]:
        """declared, map_seq, map_body and gtid for an event."""
        kind = raw[4] if len(raw) >= 19 else 0
        found, gtid = (None, None), self.gtid
        if kind == 15:
            if len(raw) >= 81 and raw[-5] == 1:
                self.declared = True
            elif len(raw) >= 77 and raw[-1] == 0:
                self.declared = False
        elif kind == 4:  # tables are numbered anew in the next file
            self.maps.clear()
        elif kind == 19:
            self.maps[raw[19:25]] = seq, self._body(raw)
        elif kind in B.ROWS:
            found = self.maps.get(raw[19:25], found)
        elif kind in (33, 162):
            self.gtid = gtid = own_gtid(raw) or gtid
        elif kind in (16, 34) or kind == 2 and S.ends_transaction(self._body(raw)):
            self.gtid = None
            gtid = None if kind == 34 else gtid
        return self.declared, *found, gtid

    def _body(self, raw: bytes) -> bytes:
        return raw[19:] if self.declared is False else raw[19:-4]


def own_gtid(raw: bytes) -> str | None:
    """The id that an event of either flavour begins a transaction with; none if it is cut off or not positive."""
    if raw[4] == 33 and len(raw) >= 44:
        number = int.from_bytes(raw[36:44], "little")
        return f"{uuid.UUID(bytes=raw[20:36])}:{number}" if 1 <= number < 1 << 63 else None
    if raw[4] == 162 and len(raw) >= 32:
        sequence, domain = struct.unpack_from("<QI", raw, 19)
        return f"{domain}-{int.from_bytes(raw[5:9], 'little')}-{sequence}"
    return None


FRAMED = SCHEMA + ", declared boolean, map_seq long, map_body binary, gtid string"


def read_files(spark: SparkSession, path: str, limit: int = DEFAULT_EVENT, source_id: str = "log", files_per_trigger: int = 0, since: str | None = None, until: str | None = None, opened: bool = False, names: str | None = None) -> DataFrame:
    """(source_id, file, seq, raw, error_code) of all files under ``path``, numbered within each file, with ``declared``,
    map_seq, map_body and gtid (the transaction's id), which spare later steps looking for them.

    Files are read whole, by a task each, and so must be closed. With ``files_per_trigger`` it is a stream of so many
    files a trigger, from the first one on, that needs no state. ``since`` and ``until`` are names of files: those before
    and after aren't opened. ``names``, such as one of ``name_lanes``, is a pattern that names must match.

    Spark hands a task the whole content of a file, 2 GB at most. With ``opened`` it hands over paths only, and tasks read them
    a few MB at a time, whatever their size: from mounted folders and the stores that Arrow knows (S3, GCS, HDFS).
    """
    if files_per_trigger:
        kinds = "path string, modificationTime timestamp, length long, content binary"
        reader = spark.readStream.format("binaryFile").schema(kinds).option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = spark.read.format("binaryFile")
    files = (reader if names is None else reader.option("pathGlobFilter", names)).load(path)
    if since is not None:
        files = files.filter(F.col("_metadata.file_name") >= since)
    if until is not None:
        files = files.filter(F.col("_metadata.file_name") <= until)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path" if opened else "content")

    def chunks_of(held: pa.Scalar) -> Iterator[bytes]:
        if opened:
            yield from _opened(held.as_py())
            return
        data = memoryview(held.as_buffer())
        for at in range(0, len(data), CHUNK):
            yield bytes(data[at : at + CHUNK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, given in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size, follower = [], 0, Follower()
                for seq, (raw, code) in enumerate(events_of(chunks_of(given), limit)):
                    held.append((source_id, name, seq, raw, code, *follower.see(seq, raw)))
                    size += len(raw)
                    if size > 4 << 20 or len(held) >= AT_ONCE:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return files.mapInArrow(run, FRAMED)


def name_lanes(most: int = 10) -> list[str]:
    """Patterns for ``read_files`` that deal files out to at most ten lanes by the last digit of their names; every name matches one.

    Closed files don't depend on each other, so that streams of some each can run side by side, each with its checkpoint.
    """
    digits = ["0123456789"[k::most] for k in range(min(most, 10))]
    rest = "".join(digits[1:])
    return [f"*[^{rest}]" if rest else "*", *(f"*[{x}]" for x in digits[1:])]


def _opened(path: str) -> Iterator[bytes]:
    """A file's content, ``CHUNK`` bytes at a time."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        with open(f"/{rest.lstrip('/')}" if rest else path, "rb") as f:
            while chunk := f.read(CHUNK):
                yield chunk
        return
    from pyarrow import fs

    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    store, name = fs.FileSystem.from_uri(quote(f"{scheme}:{rest}", safe=":/@"))
    with store.open_input_stream(name) as f:
        while chunk := f.read(CHUNK):
            yield chunk


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.string()][: len(rows[0])]
    names = [x.split()[0] for x in FRAMED.split(", ")][: len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class FilePart(InputPartition):
    """Bytes of a file from ``start`` (an event's first) to ``end``; ``seq`` numbers the first event."""

    def __init__(self, path: str, seq: int = 0, start: int = 0, end: int | None = None):
        self.path, self.seq, self.start, self.end = path, seq, start, end


def _read(part: FilePart, source_id: str, limit: int, follow: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of a few MB; ``follow``: of a whole file, with what ``FRAMED`` has more."""

    def chunks() -> Iterator[bytes]:
        at = part.start
        with open(part.path, "rb") as f:
            f.seek(at)
            while chunk := f.read(CHUNK if part.end is None else min(CHUNK, part.end - at)):
                at += len(chunk)
                yield chunk

    held, size, follower, name = [], 0, Follower(), os.path.basename(part.path)
    for k, (raw, code) in enumerate(events_of(chunks(), limit, part.end is None)):
        held.append((source_id, name, part.seq + k, raw, code, *(follower.see(k, raw) if follow else ())))
        size += len(raw)
        if size > 4 << 20 or len(held) >= AT_ONCE:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _lengths(path: str, at: int, limit: int) -> Iterator[int]:
    """Where each complete event ends, from byte ``at`` on; only headers are read. A bad length ends the file's events."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        if at == 0 and f.read(4) == MAGIC:
            at = 4
        while at + 19 <= size:
            f.seek(at + 9)
            n = int.from_bytes(f.read(4), "little")
            if at + n > size and 19 <= n <= limit:
                return
            at = size if not 19 <= n <= limit else at + n
            yield at


class RowLogSource(DataSource):
    """``format("rowlog")``; options: path, sourceId, maxEventSize, maxEventsPerTrigger, maxBytesPerTrigger, checkpoint, follow,
    pushFilters, since, before.

    The path must be mounted on all machines; ``read_files`` reads any store that Spark reads. Files are read a few MB at a
    time, whatever their size. With ``follow`` (batches only) rows have what ``read_files`` adds, so that ``changes`` needs
    no exchange. With ``pushFilters``, for which ``spark.sql.python.filterPushdown.enabled`` must be set, files that filters on
    ``file`` rule out aren't opened. Of a folder, files are taken from the name ``since`` on, and only those ``before`` a name.
    """

    @classmethod
    def name(cls) -> str:
        return "rowlog"

    def schema(self) -> str:
        return FRAMED if _Options(self.options).follow else SCHEMA

    def reader(self, schema):
        return PushingReader(self.options) if self.options.get("pushFilters", "false").lower() == "true" else RowLogReader(self.options)

    def streamReader(self, schema):
        return RowLogStream(self.options)

    def writer(self, schema, overwrite):
        return RowLogWriter(self.options)


class _Options:
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://").replace("file:", "")
        self.source_id = options.get("sourceId", "log")
        self.limit = size_limit(int(options.get("maxEventSize", DEFAULT_EVENT)))
        self.checkpoint = options.get("checkpoint", "").removeprefix("file://").removeprefix("file:")
        self.follow = options.get("follow", "false").lower() == "true"
        self.most_events = int(options.get("maxEventsPerTrigger", 10_000))
        self.most_bytes = int(options.get("maxBytesPerTrigger", 256 << 20))
        self.since, self.before = options.get("since", ""), options.get("before", "")

    def files(self) -> list[str]:
        if not os.path.isdir(self.path):
            return [self.path]
        found = sorted(glob.glob(f"{self.path}/*"))
        upto = bisect.bisect_left(found, self.before, key=os.path.basename) if self.before else len(found)
        return found[bisect.bisect_left(found, self.since, key=os.path.basename) : upto]


class RowLogReader(DataSourceReader):
    def __init__(self, options):
        self.of = _Options(options)
        self.wanted: list[Filter] = []

    def partitions(self):
        named = [(os.path.basename(p), p) for p in self.of.files()]
        return [FilePart(p) for name, p in named if all(_HOLDS[type(f)](name, f.value) for f in self.wanted)]

    def read(self, partition):
        if partition is not None:  # Spark asks once where there are no files
            yield from _read(partition, self.of.source_id, self.of.limit, self.of.follow)


class PushingReader(RowLogReader):
    def pushFilters(self, filters):
        """Takes the comparisons of ``file`` with names; Spark evaluates the others."""
        for f in filters:
            if isinstance(f, tuple(_HOLDS)) and f.attribute == ("file",):
                self.wanted.append(f)
            else:
                yield f


_HOLDS = {EqualTo: operator.eq, In: lambda name, names: name in names, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class RowLogStream(DataSourceStreamReader):
    """Offsets are a file's name, and how many events and bytes of it are read; files follow each other by name.

    Every trigger takes a bounded number of events and bytes; a single event beyond the bound still goes through, alone.
    Spark doesn't tell a reader where its checkpoint stands, so the option ``checkpoint`` names the query's folder; without
    it the first trigger after a start takes all that is there.
    """

    def __init__(self, options):
        self.of = _Options(options)
        self.at: dict | None = None
        self.listed: tuple[int, list[str]] | None = None
        if self.of.checkpoint:
            logged = [int(n) for n in os.listdir(f"{self.of.checkpoint}/offsets") if n.isdigit()] if os.path.isdir(f"{self.of.checkpoint}/offsets") else []
            self.at = self.initialOffset()
            if logged:
                with open(f"{self.of.checkpoint}/offsets/{max(logged)}", encoding="utf-8") as f:
                    self.at = json.loads(f.read().splitlines()[-1])

    def files(self, since: str) -> list[str]:
        """The files from the name ``since`` on. A folder is listed anew when it has changed; one that changed within the last seconds
        is always listed, because it may change again at the same time of its clock."""
        if not os.path.isdir(self.of.path):
            return self.of.files()
        changed = os.stat(self.of.path).st_mtime_ns
        if self.listed is None or self.listed[0] != changed:
            quiet = time.time_ns() - changed > 5_000_000_000
            found = self.of.files()
            self.listed = (changed, found) if quiet else None
        else:
            found = self.listed[1]
        return found[bisect.bisect_left(found, since, key=os.path.basename) :]

    def initialOffset(self):
        return {"file": "", "event": 0, "byte": 0}

    def latestOffset(self):
        bounded = self.at is not None
        at = dict(self.at or self.initialOffset())
        events = size = 0
        for path in self.files(at["file"]):
            name = os.path.basename(path)
            if name < at["file"]:
                continue
            if name > at["file"]:
                at = {"file": name, "event": 0, "byte": 0}
            for to in _lengths(path, at["byte"], self.of.limit):
                n = to - at["byte"]
                if bounded and events and (events >= self.of.most_events or size + n > self.of.most_bytes):
                    self.at = at
                    return at
                events, size = events + 1, size + n
                at = {"file": name, "event": at["event"] + 1, "byte": to}
        self.at = at
        return at

    def partitions(self, start, end):
        parts = []
        for path in self.files(start["file"]):
            name = os.path.basename(path)
            if name > end["file"]:
                break
            if start["file"] <= name:
                first = start if name == start["file"] else {"event": 0, "byte": 0}
                to = end["byte"] if name == end["file"] else os.path.getsize(path)
                if to > first["byte"]:
                    parts.append(FilePart(path, first["event"], first["byte"], to))
        return parts

    def read(self, partition):
        yield from _read(partition, self.of.source_id, self.of.limit)

    def commit(self, end):
        pass


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class RowLogWriter(DataSourceWriter):
    """Rows (source_id, file, seq, raw) as log files with magic bytes; use ``write_files``, which orders the rows.

    Tasks write under names of their own; the files get theirs when all tasks are done.
    """

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://").replace("file:", "")

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        files, name, out = [], None, None
        for row in iterator:
            if row.file != name:
                if out:
                    out.close()
                name = row.file
                files.append((f"{self.path}/.{name}.{uuid.uuid4().hex}", f"{self.path}/{name}"))
                out = open(files[-1][0], "wb")  # noqa: SIM115
                out.write(MAGIC)
            out.write(bytes(row.raw))
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        for m in messages:
            for held, name in m.files if m else []:
                os.replace(held, name)

    def abort(self, messages):
        for m in messages:
            for held, _ in m.files if m else []:
                if os.path.exists(held):
                    os.remove(held)


def write_files(raw: DataFrame, path: str) -> None:
    """Each file of ``raw`` as a log file under ``path``, written by the task that has its rows."""
    raw.sparkSession.dataSource.register(RowLogSource)
    rows = raw.select("source_id", "file", "seq", "raw").repartition("file").sortWithinPartitions("file", "seq")
    rows.write.format("rowlog").mode("append").save(path)
