"""From raw events (source_id, file, seq, raw) to change rows.

Order: header fields and checksums as native columns, positions and table maps carried forward by windows, the table
filter, and only then the Python decoding of the row images that are left, so rows of blocked tables are never decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions import bytes as B
from rowtide.functions import codec, columnar
from rowtide.functions import statements as S
from rowtide.functions.errors import ChecksumError, DecodeError, LogError, ParseError

VALUE = "struct<ordinal int, name string, kind string, i bigint, d double, s string, b binary>"
ENVELOPE = f"source_id string, seq long, row_in_event int, op string, database string, `table` string, before array<{VALUE}>, after array<{VALUE}>, ts long, file string, offset long, error_code int"


def with_header(raw: DataFrame, checksum: str = "auto") -> DataFrame:
    """Add header fields, body and crc_ok. checksum: auto (from the format description, CRC32 until then), crc32, none.

    An artificial ROTATE (flag 0x20) has a checksum where it matches, even in a log that has none. Where the reader of the
    files has followed the format descriptions (``declared``), nothing is looked up here. Otherwise the events go to the
    tasks of their files before anything is added to them, so that all that is made from one log shares that exchange.
    """
    if checksum == "auto" and "declared" not in raw.columns:
        raw = raw.repartition("source_id", "file")
    events = raw.withColumns(B.header())
    if checksum == "auto":
        order = Window.partitionBy("source_id", "file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        said = F.last(F.when(F.col("type_code") == 15, B.declared_checksum()), ignorenulls=True).over(order)
        if "declared" in raw.columns:
            said = F.col("declared")
        events = events.withColumn("__crc", F.coalesce(said, F.lit(True)))
        artificial = (F.col("type_code") == 4) & (F.col("flags").bitwiseAND(0x20) != 0)
        events = events.withColumn("__crc", F.col("__crc") | (artificial & (F.length("raw") >= 23) & B.checksum_matches()))
    else:
        events = events.withColumn("__crc", F.lit(checksum == "crc32"))
    events = events.withColumn("crc_ok", F.when(F.col("__crc"), B.checksum_matches()).otherwise(True))
    return events.withColumn("body", B.body("raw", F.col("__crc"))).drop("__crc")


def carried(events: DataFrame, value: Column, before: str, after: str) -> DataFrame:
    """Add the last non-null ``value`` up to the event before, and up to the event itself, over all files of a source.

    Only a row for each file is ordered across files; events are ordered within their file, so files run in parallel.
    """
    order = Window.partitionBy("source_id", "file").orderBy("seq")
    across = Window.partitionBy("source_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("__v", value)
    ends = events.groupBy("source_id", "file").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("seq"))).alias("__end"))
    ends = ends.select("source_id", "file", F.last("__end", ignorenulls=True).over(across).alias("__in"))
    own = lambda to: F.last("__v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, to))
    # windows come before the join, which then finds the events in its order and sorts nothing
    lined = events.withColumns({"__own_before": own(-1), "__own_after": own(0)}).join(ends, ["source_id", "file"])
    return lined.withColumns({before: F.coalesce("__own_before", "__in"), after: F.coalesce("__own_after", "__in")}).drop("__v", "__in", "__own_before", "__own_after")


def with_position(events: DataFrame) -> DataFrame:
    """Add log_file and offset: where to resume. A ROTATE names the file from there on; a next position of 0 and a damaged
    event change nothing.
    """
    rotate = F.col("type_code") == 4
    at = F.when(F.col("crc_ok"), F.when(rotate, B.rotate_position()).when(F.col("next_pos") > 0, F.col("next_pos")))
    events = carried(carried(events, F.when(rotate, B.rotate_file()), "__b", "log_file").drop("__b"), at, "__b", "offset").drop("__b")
    return events.withColumns({"log_file": F.coalesce("log_file", F.lit("")), "offset": F.coalesce("offset", F.lit(0))})


def with_map_seq(events: DataFrame) -> DataFrame:
    """Add map_seq: the number of the latest table map of the same table in the same file, null before the first."""
    order = Window.partitionBy("source_id", "file", "table_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("map_seq", F.last(F.when(F.col("type_code") == 19, F.col("seq")), ignorenulls=True).over(order))


def map_names(body: str = "body") -> dict[str, Column]:
    """database and table of a TABLE_MAP's body, without parsing the rest."""
    n = B.le(body, 9, 1, "int")
    at = F.lit(11) + n  # of the table's length
    m = B.le(body, at, 1, "int")
    return {"database": B.text(F.substring(F.col(body), F.lit(10), n)), "table": B.text(F.substring(F.col(body), at + 1, m))}


def table_maps(events: DataFrame) -> DataFrame:
    """(source_id, file, map_seq, map_body, database, table) of every table map."""
    return events.filter("type_code = 19").select("source_id", "file", F.col("seq").alias("map_seq"), F.col("body").alias("map_body"), *[c.alias(n) for n, c in map_names().items()])


def passing(attached: DataFrame, allowed: Column | DataFrame | None) -> DataFrame:
    """Attached events of the tables that pass, and those without a name, which are errors.

    ``allowed`` is a predicate over database and table, or a frame (database, table) of the tables wanted, which is read
    anew by each run, and by each trigger of a stream; it is joined on the names, before any row is decoded.
    """
    if allowed is None:
        return attached
    if isinstance(allowed, DataFrame):
        wanted = allowed.select("database", "table").distinct().withColumn("__wanted", F.lit(True))
        found = attached.join(wanted, ["database", "table"], "left").filter(F.col("database").isNull() | F.col("__wanted"))
        return found.select(*attached.columns)
    return attached.filter(F.col("database").isNull() | allowed)


def attach(events: DataFrame, allowed: Column | DataFrame | None = None) -> DataFrame:
    """Row events with their table map as of that place; ``allowed`` as for ``passing``.

    A row event without a table map stays, with null names: that is an error unless it is dropped. What the reader of the
    files couldn't cut into events (``error_code``) stays as well. Where that reader has followed the table maps
    (``map_body``), nothing is moved or sorted.
    """
    broken = F.col("error_code") != 0 if "error_code" in events.columns else F.lit(False)
    wanted = F.col("type_code").isin(B.ROWS) | broken
    if "map_body" in events.columns:
        out = events.filter(wanted).withColumns(map_names("map_body"))
    else:
        order = Window.partitionBy("source_id", "file", "table_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        declared = F.last(F.when(F.col("type_code") == 19, F.struct("seq", "body")), ignorenulls=True).over(order)
        events = events.filter(wanted | (F.col("type_code") == 19)).withColumn("__map", declared)
        out = events.filter(wanted).withColumns({"map_seq": F.col("__map.seq"), "map_body": F.col("__map.body")}).drop("__map")
        out = out.withColumns(map_names("map_body"))
    return passing(out, allowed)


class Images:
    """A column of row images, gathered field by field."""

    def __init__(self):
        self.sizes: list[int | None] = []
        self.ordinal: list[int] = []
        self.name: list[str] = []
        self.kind: list[str] = []
        self.value: list = []

    def add(self, image: list[codec.Value] | None, names: list[str]) -> None:
        if image is None:
            self.sizes.append(None)
            return
        self.sizes.append(len(image))
        self.ordinal += range(len(image))
        self.name += names
        kinds, values = zip(*image, strict=True)
        self.kind += kinds
        self.value += values

    def cut(self, rows: int) -> None:
        """Take back all rows but the first so many."""
        n = sum(x for x in self.sizes[:rows] if x)
        del self.sizes[rows:], self.ordinal[n:], self.name[n:], self.kind[n:], self.value[n:]

    def arrow(self) -> pa.Array:
        pairs = list(zip(self.kind, self.value, strict=True))
        text, data = [], []
        for kind, x in pairs:
            s = b = None
            if kind == "STRING":
                try:
                    s = x.decode()
                except UnicodeDecodeError:
                    b = x
            elif kind == "BYTES":
                b = x
            text.append(s)
            data.append(b)
        fields = [
            pa.array(self.ordinal, pa.int32()),
            pa.array(self.name, pa.string()),
            pa.array(self.kind, pa.string()),
            pa.array([x if k == "INT" else None for k, x in pairs], pa.int64()),
            pa.array([x if k == "DOUBLE" else None for k, x in pairs], pa.float64()),
            pa.array(text, pa.string()),
            pa.array(data, pa.binary()),
        ]
        offsets, at = [], 0
        for n in self.sizes:
            offsets.append(None if n is None else at)
            at += n or 0
        values = pa.StructArray.from_arrays(fields, fields=list(_VALUE_ARROW.value_type))
        return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values, type=_VALUE_ARROW)


_VALUE_ARROW = pa.list_(pa.struct([("ordinal", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("i", pa.int64()), ("d", pa.float64()), ("s", pa.string()), ("b", pa.binary())]))
_ARROW = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), _VALUE_ARROW, _VALUE_ARROW, pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
_NAMES = ["source_id", "seq", "row_in_event", "op", "database", "table", "before", "after", "ts", "file", "offset", "error_code", "names_resolved"]


def _envelope(made: list[tuple], before: Images, after: Images, batch: pa.RecordBatch, keep: tuple[str, ...], events: list[int]) -> pa.RecordBatch:
    plain = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), _ARROW[:6] + _ARROW[8:], strict=True)]
    kept = _kept(batch, keep, pa.array(events, pa.int64()))
    return pa.RecordBatch.from_arrays([*plain[:6], before.arrow(), after.arrow(), *plain[6:], *kept], [*_NAMES, *keep])


def _images(read: columnar.Rows, side: int, table: codec.TableMap) -> pa.Array:
    """One side's images of what was read column by column, row by row."""
    rows, n = len(read.event), len(table.types)
    if read.images[side] is None or not rows:
        return pa.nulls(rows, _VALUE_ARROW)
    columns = [read.column(side, c) for c in range(n)]
    order = pa.array((np.arange(rows)[:, None] + rows * np.arange(n)).ravel())
    ordinal = np.tile(np.arange(n, dtype=np.int32), rows)
    fields = [pa.array(ordinal), pa.array(table.shown, pa.string()).take(pa.array(ordinal)), columnar.KINDS.take(pa.array(np.stack([c.kinds for c in columns], 1).ravel()))]
    for name in "idsb":
        kept = [c.field(name) for c in columns]
        none = all(x.null_count == rows for x in kept)
        fields.append(pa.nulls(rows * n, kept[0].type) if none else pa.concat_arrays(kept).take(order))
    values = pa.StructArray.from_arrays(fields, fields=list(_VALUE_ARROW.value_type))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n), values, type=_VALUE_ARROW)


def _kept(batch: pa.RecordBatch, keep: tuple[str, ...], events: pa.Array) -> list[pa.Array]:
    return [batch.column(batch.schema.names.index(f"keep_{name}")).take(events) for name in keep]


def _read_envelope(batch: pa.RecordBatch, keep: tuple[str, ...], kind: int, table: codec.TableMap, rows: np.ndarray, read: columnar.Rows) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows that their images have at most about ``VALUES`` values."""
    for part in read.parts(max(1, VALUES // len(table.types))):
        yield _envelope_of(batch, keep, kind, table, rows, part)


def _envelope_of(batch: pa.RecordBatch, keep: tuple[str, ...], kind: int, table: codec.TableMap, rows: np.ndarray, read: columnar.Rows) -> pa.RecordBatch:
    at, n = pa.array(rows[read.event]), len(read.event)
    of = lambda name: batch.column(batch.schema.names.index(name)).take(at)
    same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(n, np.int64)))
    head = [of("source_id"), of("seq"), pa.array(read.number), same(codec.OPS[kind]), same(table.database), same(table.table)]
    tail = [of("ts"), of("file"), of("offset").cast(pa.int64()), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, table.resolved))]
    return pa.RecordBatch.from_arrays([*head, _images(read, 0, table), _images(read, 1, table), *tail, *_kept(batch, keep, at)], [*_NAMES, *keep])


def _known(attached: DataFrame) -> Column:
    return F.col("known") if "known" in attached.columns else F.lit(None).cast("string").alias("known")


def registry(columns: DataFrame) -> DataFrame:
    """(database, table, names, unsigned) from a frame with a row for each column: database, table, ordinal, name, type.

    The type is as a server spells it (``int unsigned``), and such a frame is ``information_schema.columns`` read over
    JDBC, or ``captures.columns`` of recorded answers.
    """
    unsigned = F.coalesce(F.contains(F.lower("type"), F.lit("unsigned")), F.lit(False))
    told = columns.select("database", "table", F.struct("ordinal", F.coalesce("name", F.lit("")).alias("name"), unsigned.alias("unsigned")).alias("__c"))
    listed = told.groupBy("database", "table").agg(F.array_sort(F.collect_list("__c")).alias("__c"))
    return listed.select("database", "table", F.transform("__c", lambda c: c["name"]).alias("names"), F.transform("__c", lambda c: c["unsigned"]).alias("unsigned"))


def with_known(attached: DataFrame, tables: DataFrame) -> DataFrame:
    """Attached events with what a registry (database, table, names, and unsigned if it has it) knows of their table.

    ``decode_rows`` and ``decode_columns`` use it for events whose table map leaves out a name: then all names are the
    registry's, and the signs too if the table map leaves these out. Names stay unresolved where the registry lacks
    the table or has another number of columns. A table in the registry twice is an error of the registry: any one counts.
    """
    unsigned = F.col("unsigned") if "unsigned" in tables.columns else F.lit(None).cast("array<boolean>")
    told = tables.select("database", "table", F.to_json(F.struct("names", unsigned.alias("unsigned"))).alias("known")).dropDuplicates(["database", "table"])
    # the registry is as small as the schema: the log's events stay where they are
    return attached.join(F.broadcast(told), ["database", "table"], "left").withColumn("known", F.coalesce("known", F.lit("{}")))


#: Rows, and values of images, of a batch that goes back to Spark.
AT_ONCE, VALUES = 20_000, 200_000


def decode_rows(attached: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The change rows of attached row events: one for each row, or one with an error code for an event that fails.

    Events of one table are read side by side, column by column; those with an unusual layout one by one. The offset of a
    failed event is where it begins, so that resuming at the greatest offset doesn't pass it; it is null where the log
    doesn't say. After ``with_known``, rows say whether their columns' names are resolved. ``keep``: columns of the events
    that their rows have too, such as gtid.
    """
    keep = tuple(keep)

    def one_by_one(batch: pa.RecordBatch, reader: columnar.Reader) -> Iterator[pa.RecordBatch]:
        made, before, after, events = [], Images(), Images(), []
        plain = batch.columns[: len(batch.columns) - len(keep)]
        for at, (source, seq, kind, crc_ok, body, declared, database, name, ts, file, offset, begin, code, known) in enumerate(zip(*[c.to_pylist() for c in plain], strict=True)):
            op, start = codec.OPS.get(kind), len(made)
            try:
                if code:
                    raise LogError.of(code)
                if not crc_ok:
                    raise ChecksumError("checksum differs")
                if declared is None:
                    raise DecodeError("row event without a table map")
                table = reader.table(declared, known)
                for k, (old, new) in enumerate(codec.rows(kind, body, table)):
                    made.append((source, seq, k, op, table.database, table.table, ts, file, offset, 0, table.resolved))
                    before.add(old, table.shown)
                    after.add(new, table.shown)
            except LogError as e:  # all rows of an event, or none
                del made[start:]
                for images in (before, after):
                    images.cut(start)
                    images.add(None, [])
                made.append((source, seq, 0, op, database, name, ts, file, begin, e.code, None))
            events += [at] * (len(made) - start)
            if len(made) >= AT_ONCE:
                yield _envelope(made, before, after, batch, keep, events)
                made, before, after, events = [], Images(), Images(), []
        if made:
            yield _envelope(made, before, after, batch, keep, events)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = columnar.Reader()
        for whole in batches:
            for batch in columnar.pieces(whole, "body"):
                yield from reader.groups(batch, partial(_read_envelope, batch, keep))
                if reader.left.any():
                    yield from one_by_one(batch.filter(pa.array(reader.left)), reader)

    if "offset" not in attached.columns:
        attached = attached.withColumn("offset", F.col("next_pos"))
    begin = F.when(F.col("next_pos") >= F.col("event_length"), F.col("next_pos") - F.col("event_length"))
    code = F.col("error_code") if "error_code" in attached.columns else F.lit(0)
    wanted = ["source_id", "seq", "type_code", "crc_ok", "body", "map_body", "database", "table", "ts", "file", "offset"]
    more = [F.col(name).alias(f"keep_{name}") for name in keep]
    schema = ENVELOPE + ", names_resolved boolean" + "".join(f", `{name}` {attached.schema[name].dataType.simpleString()}" for name in keep)
    found = attached.select(*wanted, begin.alias("begin"), code.alias("code"), _known(attached), *more).mapInArrow(run, schema)
    return found if "known" in attached.columns else found.drop("names_resolved")


_STORED = {"v": (pa.list_(pa.float32()), "array<float>"), "i": (pa.int64(), "long"), "d": (pa.float64(), "double"), "s": (pa.string(), "string"), "b": (pa.binary(), "binary")}


def _stored(kind: str) -> str:
    return "v" if kind == "array<float>" else "b" if kind == "text" else "s" if kind == "decimal(20,0)" else _FIELD.get(kind, "s")


def decode_columns(attached: DataFrame, columns: dict[str, tuple[int, str]], image: str = "after") -> DataFrame:
    """Some columns of one image of attached row events, without the envelope: for views of a known table.

    ``columns`` maps names to (ordinal, Spark type). Only these leave Python; the others are read over. Rows come with
    source_id, file, seq, row_in_event, op and error_code, which is set, with null columns, for an event that fails.
    """
    names, side = list(columns), ("before", "after").index(image)
    wanted = [(k, _stored(kind)) for k, kind in columns.values()]
    head = ["source_id", "file", "seq", "row_in_event", "op", "error_code"]
    head_types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32()]

    def content(pair: codec.Value, stored: str):
        kind, x = pair
        if stored == "s":
            return x.decode("utf-8", "replace") if kind in ("STRING", "BYTES") else None if x is None else str(x)
        if stored == "b":
            return x if kind in ("STRING", "BYTES") else None
        if stored == "v":
            return np.frombuffer(x, "<f4").tolist() if kind == "BYTES" and len(x) % 4 == 0 else None
        return x if kind == ("INT" if stored == "i" else "DOUBLE") else None

    def stored_as(found: columnar.Column, stored: str) -> pa.Array:
        """As ``content``, of a whole column."""
        if stored in "id":
            return found.field(stored)
        text, data = found.field("s"), found.field("b")
        if stored == "v":
            return pa.array([None if x is None or len(x) % 4 else np.frombuffer(x, "<f4") for x in data.to_pylist()], _STORED["v"][0])
        if stored == "b":
            return pc.coalesce(text.cast(pa.binary()), data)
        if found.layout.kind == columnar.INT:
            return pc.coalesce(text, found.field("i").cast(pa.string()))
        if found.layout.kind == columnar.DOUBLE:
            return pa.array([None if x is None else str(x) for x in found.field("d").to_pylist()], pa.string())
        if data.null_count == len(data):
            return text
        return pc.coalesce(text, pa.array([None if x is None else x.decode("utf-8", "replace") for x in data.to_pylist()], pa.string()))

    def read_columns(batch: pa.RecordBatch, kind: int, table: codec.TableMap, rows: np.ndarray, whole: columnar.Rows) -> Iterator[pa.RecordBatch]:
        for part in whole.parts(max(1, VALUES // max(1, len(wanted)))):
            yield columns_of(batch, kind, table, rows, part)

    def columns_of(batch: pa.RecordBatch, kind: int, table: codec.TableMap, rows: np.ndarray, read: columnar.Rows) -> pa.RecordBatch:
        at, n = pa.array(rows[read.event]), len(read.event)
        of = lambda name: batch.column(batch.schema.names.index(name)).take(at)
        op = pa.array([codec.OPS[kind]], pa.string()).take(pa.array(np.zeros(n, np.int64)))
        made = [of("source_id"), of("file"), of("seq"), pa.array(read.number), op, pa.array(np.zeros(n, np.int32))]
        for ordinal, stored in wanted:
            there = read.images[side] is not None and ordinal < len(table.types) and n
            made.append(stored_as(read.column(side, ordinal), stored) if there else pa.nulls(n, _STORED[stored][0]))
        return pa.RecordBatch.from_arrays(made, head + names)

    def one_by_one(batch: pa.RecordBatch, reader: columnar.Reader) -> pa.RecordBatch:
        made, lists = [], [[] for _ in wanted]
        for source, file, seq, kind, crc_ok, body, declared, code, known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            try:
                if code:
                    raise LogError.of(code)
                if not crc_ok:
                    raise ChecksumError("checksum differs")
                if declared is None:
                    raise DecodeError("row event without a table map")
                images = [x[side] for x in codec.rows(kind, body, reader.table(declared, known))]
            except LogError as e:
                made.append((source, file, seq, 0, codec.OPS.get(kind), e.code))
                for out in lists:
                    out.append(None)
                continue
            made += [(source, file, seq, k, codec.OPS[kind], 0) for k in range(len(images))]
            for out, (ordinal, stored) in zip(lists, wanted, strict=True):
                out += [None if x is None or ordinal >= len(x) else content(x[ordinal], stored) for x in images]
        plain = [pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * len(head), head_types, strict=True)]
        return pa.RecordBatch.from_arrays([*plain, *[pa.array(x, _STORED[w][0]) for x, (_, w) in zip(lists, wanted, strict=True)]], head + names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, some = columnar.Reader(), {ordinal for ordinal, _ in wanted}
        keep = lambda table: (some, set()) if side == 0 else (set(), some)
        for whole in batches:
            for batch in columnar.pieces(whole, "body"):
                yield from reader.groups(batch, partial(read_columns, batch), keep)
                if reader.left.any():
                    yield one_by_one(batch.filter(pa.array(reader.left)), reader)

    fields = "source_id string, file string, seq long, row_in_event int, op string, error_code int"
    fields += "".join(f", `{n}` {_STORED[w][1]}" for n, (_, w) in zip(names, wanted, strict=True))
    code = F.col("error_code") if "error_code" in attached.columns else F.lit(0)
    found = attached.select("source_id", "file", "seq", "type_code", "crc_ok", "body", "map_body", code.alias("code"), _known(attached)).mapInArrow(run, fields)
    cast = lambda n, kind: B.text(n) if kind == "text" else F.col(n).try_cast(kind) if _stored(kind) == "s" and kind != "string" else F.col(n).cast(kind)
    return found.select(*head, *[cast(n, kind).alias(n) for n, (_, kind) in columns.items()])


def damaged(events: DataFrame) -> DataFrame:
    """Events with header that are no row events and are damaged, as error rows of the form of ``changes``: a wrong checksum,
    and table maps that don't parse, also those of tables that are filtered out.

    ``changes`` tells what is wrong with row events only, as the others don't change its rows. Both together, and
    ``failfast_prefix`` or ``strict`` on that, stop where a reader stops that takes no damage at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for source, seq, kind, crc_ok, body, ts, file, offset in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                code = 0 if crc_ok else ChecksumError.code
                if kind == 19 and crc_ok:
                    if len(parsed) > 4096:
                        parsed.clear()
                    if body[6:] not in parsed:
                        try:
                            codec.TableMap(body)
                            parsed[body[6:]] = 0
                        except LogError as e:
                            parsed[body[6:]] = e.code
                    code = parsed[body[6:]]
                if code:
                    rows.append((source, seq, 0, *[None] * 5, ts, file, offset, code, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW, strict=True)], _NAMES)

    whole = F.col("error_code") == 0 if "error_code" in events.columns else F.lit(True)
    begin = F.when(F.col("next_pos") >= F.col("event_length"), F.col("next_pos") - F.col("event_length"))
    some = events.filter(whole & ~F.col("type_code").isin(B.ROWS) & ((F.col("type_code") == 19) | ~F.col("crc_ok")))
    found = some.select("source_id", "seq", "type_code", "crc_ok", "body", "ts", "file", begin.alias("offset"))
    return found.mapInArrow(run, ENVELOPE + ", names_resolved boolean").drop("names_resolved")


DEFINITIONS = "source_id string, database string, `table` string, file string, seq long, n_maps long, n_columns int, ordinal int, name string, type string, meta int, unsigned boolean, nullable boolean, labels array<string>, key int, spark_type string, error_code int"


def definitions(events: DataFrame) -> DataFrame:
    """Each definition of a table that a log (with header) declares, a row for each column, with where it is declared first.

    ``n_maps``: how often it is; labels of enumerations and sets, and the place in the key (from 0), where the log tells
    them; ``spark_type``: as ``codec.spark_type``. A table map that doesn't parse is a row with an error code and no column.
    Logs repeat their table maps, so equal ones are brought together before any is parsed.
    """
    maps = table_maps(events.filter("crc_ok")).withColumn("definition", F.substring("map_body", 9, 1 << 30))
    some = maps.groupBy("source_id", "database", "table", "definition").agg(F.min(F.struct("file", "map_seq")).alias("at"), F.count("*").alias("n"))
    names = [x.split()[0].strip("`") for x in DEFINITIONS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, database, name, body, file, seq, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                head = (source, database, name, file, seq, n)
                try:
                    table = codec.TableMap(bytes(8) + body)
                except LogError as e:
                    rows.append((*head, *[None] * 10, e.code))
                    continue
                for i, (kind, meta, unsigned, labels) in enumerate(zip(table.types, table.meta, table.unsigned, table.labels, strict=True)):
                    real = meta >> 8 if kind == codec.STRING and meta >> 8 in (codec.ENUM, codec.SET) else kind
                    told = (table.names[i] or None, codec.TYPE_NAMES.get(real, "UNKNOWN"), meta, unsigned, table.nullable[i], labels)
                    rows.append((*head, len(table.types), i, *told, table.key.index(i) if i in table.key else None, codec.spark_type(kind, meta, unsigned, labels), 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return some.select("source_id", "database", "table", "definition", "at.file", "at.map_seq", "n").mapInArrow(run, DEFINITIONS)


def statements(events: DataFrame) -> DataFrame:
    """(source_id, file, seq, ts, database, statement, executed, is_ddl) of all events with header that carry a statement, in
    batches and streams: those that were executed, and those that row events note as their cause, which change no schema.

    A stream of those with is_ddl tells, for ``foreachBatch``, when to read a registry again. Damaged events have none.
    """
    kind, body = F.col("type_code"), F.col("body")
    noted = F.when(kind == 160, B.annotation()).otherwise(B.text(F.substring(body, F.lit(2), F.length(body))))  # behind a length that isn't used
    found = events.filter(kind.isin(2, 29, 160) & F.col("crc_ok"))
    told = found.select("source_id", "file", "seq", "ts", F.when(kind == 2, B.query_database()).alias("database"), F.when(kind == 2, B.query_text()).otherwise(noted).alias("statement"), (kind == 2).alias("executed"))
    return told.filter("statement is not null").withColumn("is_ddl", F.col("executed") & S.is_ddl("statement"))


def schema_changes(found: DataFrame) -> DataFrame:
    """(source_id, database, table, file, seq, added, dropped, retyped) of ``definitions``: at each new definition of a table
    the names of columns that the one before it hadn't, that it hasn't any more, and whose types differ.

    Definitions without names go by numbers. A table has as many rows here as definitions, however long the log.
    """
    column = F.struct(F.coalesce("name", F.col("ordinal").cast("string")).alias("name"), F.struct("type", "meta", "unsigned").alias("kind"))
    of = ["source_id", "database", "table"]
    whole = found.filter("error_code = 0").groupBy(*of, "file", "seq").agg(F.collect_list(column).alias("now"))
    before = F.lag("now").over(Window.partitionBy(*of).orderBy("file", "seq"))
    names = lambda c: F.transform(c, lambda x: x["name"])
    pairs = whole.withColumn("old", before).filter("old is not null")
    differ = F.filter("now", lambda x: F.exists("old", lambda y: (y["name"] == x["name"]) & (y["kind"] != x["kind"])))
    told = [F.array_sort(F.array_except(names("now"), names("old"))).alias("added"), F.array_sort(F.array_except(names("old"), names("now"))).alias("dropped"), F.array_sort(names(differ)).alias("retyped")]
    return pairs.select(*of, "file", "seq", *told).filter("size(added) + size(dropped) + size(retyped) > 0")


def _shown_as(name: str, kind: str, labels: list[str] | None) -> Column:
    """A column as ``definitions`` says, from what ``decode_columns`` reads for ``_read_as``."""
    c = F.col(name)
    if kind == "timestamp":
        return F.timestamp_seconds(c.try_cast("decimal(20,6)"))
    if kind == "interval":
        part = lambda k: F.regexp_extract(c, r"^(-?)([0-9]+):([0-9]+):([0-9.]+)$", k)
        size = F.make_dt_interval(F.lit(0), part(2).try_cast("int"), part(3).try_cast("int"), part(4).try_cast("decimal(18,6)"))
        return F.when(part(1) == "-", -size).otherwise(size)
    if kind == "string" and labels is not None:
        return F.when(c == 0, "").otherwise(F.get(F.array(*map(F.lit, labels)), c.cast("int") - 1))
    if kind == "array<string>":
        bit = lambda k: c.bitwiseAND(F.lit(1 << k if k < 63 else -1 << 63)) != 0
        return F.when(c.isNotNull(), F.array_compact(F.array(*[F.when(bit(k), F.lit(x)) for k, x in enumerate(labels)])))
    return c


def _read_as(kind: str, labels: list[str] | None) -> str:
    return "string" if kind in ("timestamp", "interval") else "bigint" if kind == "array<string>" or kind == "string" and labels is not None else kind


def view(raw: DataFrame, database: str, table: str, image: str = "after", checksum: str = "auto") -> DataFrame:
    """One table of a log as a plain table with the types that the log declares, and source_id, file, seq, row_in_event, op and error_code.

    Columns are those of the last definition (a column without a name has its number, as ``c0``); rows of earlier ones have
    nulls for what they lack, as columns go by their place. Enumerations are their labels, sets arrays of labels, times
    intervals; what a type can't hold (dates of zeros) is null. Only the definition comes to the driver. Events of the
    table that can't be decoded are rows with an error code.
    """
    events = with_header(raw, checksum)
    wanted = (F.col("database") == database) & (F.col("table") == table)
    told = definitions(events).filter(wanted & (F.col("error_code") == 0))
    last = told.agg(F.max(F.struct("file", "seq", "source_id")).alias("at")).first().at
    if last is None:
        raise ValueError(f"the log has no table {database}.{table}")
    columns = told.filter((F.col("file") == last.file) & (F.col("seq") == last.seq) & (F.col("source_id") == last.source_id)).orderBy("ordinal").collect()
    names = [c.name or f"c{c.ordinal}" for c in columns]
    found = decode_columns(attach(events, wanted), {f"__{c.ordinal}": (c.ordinal, _read_as(c.spark_type, c.labels)) for c in columns}, image)
    return found.select("source_id", "file", "seq", "row_in_event", "op", "error_code", *[_shown_as(f"__{c.ordinal}", c.spark_type, c.labels).alias(n) for c, n in zip(columns, names, strict=True)])


def strict(found: DataFrame) -> DataFrame:
    """The same rows; the first one with an error code ends the query, batch or stream, with an error that says where."""
    kinds = {ParseError.code: "ParseError", ChecksumError.code: "ChecksumError", DecodeError.code: "DecodeError"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("error_code")), F.lit("LogError"))
    told = F.concat(kind, F.lit(": code "), F.col("error_code").cast("string"), F.lit(" at event "), F.col("seq").cast("string"), F.lit(" of "), F.coalesce("file", F.lit("")))
    return found.withColumn("error_code", F.when(F.col("error_code") == 0, F.col("error_code")).otherwise(F.raise_error(told).cast("int")))


def changes(raw: DataFrame, allowed: Column | DataFrame | None = None, checksum: str = "auto", keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw events to change rows. The offset is the event header's next position. ``keep`` as for ``decode_rows``.

    From ``framing.read_files`` on, each file goes through one task and nothing is exchanged.
    """
    return decode_rows(attach(with_header(raw, checksum), allowed), keep)


def failfast_prefix(found: DataFrame) -> DataFrame:
    """The rows of each source before its first error."""
    first = found.groupBy("source_id").agg(F.min(F.when(F.col("error_code") != 0, F.col("seq"))).alias("__bad"))
    return found.join(first, "source_id").filter(F.col("__bad").isNull() | (F.col("seq") < F.col("__bad"))).drop("__bad")


def with_names(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Names from a registry (database, table, names) where its number of columns agrees; adds names_resolved."""
    names = registry.select("database", "table", F.col("names").alias("__names"))
    size = F.coalesce(F.size("after"), F.size("before"))
    out = found.join(names, ["database", "table"], "left").withColumn("names_resolved", F.coalesce(F.size("__names") == size, F.lit(False)))
    named = lambda c: F.when(F.col("names_resolved"), F.transform(c, lambda v: v.withField("name", F.get("__names", v["ordinal"])))).otherwise(F.col(c))
    return out.withColumns({"before": named("before"), "after": named("after")}).select(*found.columns, "names_resolved")


def with_schema_since(found: DataFrame, events: DataFrame) -> DataFrame:
    """Add schema_since: the place (file, seq) of the last statement before each row that changes a schema, null before
    the first. ``events`` are those of the same log, with header.

    Such statements are few: those of a file travel to its rows as one array of numbers, and a file knows the last one of
    the files before it.
    """
    ddl = (F.col("type_code") == 2) & S.is_ddl(B.query_text())
    files = events.groupBy("source_id", "file").agg(F.array_sort(F.collect_list(F.when(ddl, F.col("seq")))).alias("__ddl"))
    across = Window.partitionBy("source_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.size("__ddl") > 0, F.struct("file", F.try_element_at("__ddl", F.lit(-1)).alias("seq")))
    files = files.withColumn("__in", F.last(own, ignorenulls=True).over(across)).filter((F.size("__ddl") > 0) | F.col("__in").isNotNull())
    past = F.filter("__ddl", lambda at: at < F.col("seq"))
    here = F.when(F.size(past) > 0, F.struct("file", F.try_element_at(past, F.lit(-1)).alias("seq")))
    return found.join(files, ["source_id", "file"], "left").withColumn("schema_since", F.coalesce(here, F.col("__in"))).select(*found.columns, "schema_since")


def with_names_asof(found: DataFrame, registry: DataFrame) -> DataFrame:
    """As ``with_names``, from a registry with versions (database, table, file, seq, names): the last one at each row's place.

    Where ``found`` has schema_since, a version from before that statement is out of date and not used, whatever table the
    statement was about. The versions of a table travel as one array, so hot tables are no hot keys.
    """
    version = F.struct("file", "seq", "names")
    all_ = registry.groupBy("database", "table").agg(F.array_sort(F.collect_list(version)).alias("__all"))
    here = F.struct("file", "seq")
    since = F.col("schema_since")
    fresh = lambda v: since.isNull() | (F.struct(v["file"], v["seq"]) >= since) if "schema_since" in found.columns else F.lit(True)
    past = F.filter("__all", lambda v: (F.struct(v["file"], v["seq"]) <= here) & fresh(v))
    rows = found.join(all_, ["database", "table"], "left").withColumn("__names", F.try_element_at(F.transform(past, lambda v: v["names"]), F.lit(-1)))
    size = F.coalesce(F.size("after"), F.size("before"))
    rows = rows.withColumn("names_resolved", F.coalesce(F.size("__names") == size, F.lit(False)))
    named = lambda c: F.when(F.col("names_resolved"), F.transform(c, lambda v: v.withField("name", F.get("__names", v["ordinal"])))).otherwise(F.col(c))
    return rows.withColumns({"before": named("before"), "after": named("after")}).select(*found.columns, "names_resolved")


_FIELD = {"bigint": "i", "int": "i", "smallint": "i", "tinyint": "i", "boolean": "i", "double": "d", "float": "d", "binary": "b"}


def column(image: str, ordinal: int, kind: str = "string") -> Column:
    """A column of an image as a Spark type. Large unsigned numbers came as text and go through it."""
    v = F.get(image, F.lit(ordinal))
    if kind == "decimal(20,0)":
        return F.coalesce(v["i"].cast(kind), v["s"].try_cast(kind))
    if kind.startswith(("decimal", "date", "timestamp")):
        return v["s"].try_cast(kind)
    if kind == "text":  # TEXT columns travel as bytes
        return F.coalesce(v["s"], B.text(v["b"]))
    return v[_FIELD.get(kind, "s")].cast(kind)


def typed(found: DataFrame, columns: dict[str, str], image: str = "after", *keep: str) -> DataFrame:
    """A plain table from the images: ``columns`` maps names to Spark types, in the order of the wire."""
    return found.select(*keep, *[column(image, k, kind).alias(name) for k, (name, kind) in enumerate(columns.items())])
