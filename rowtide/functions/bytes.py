"""Numbers and fields of raw events as Spark columns; no Python runs per row.

``reverse()`` isn't used on binary columns: it works on characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event kinds by number.
KINDS = {2: "QUERY_EVENT", 3: "STOP_EVENT", 4: "ROTATE_EVENT", 15: "FORMAT_DESCRIPTION_EVENT", 16: "XID_EVENT", 19: "TABLE_MAP_EVENT", 23: "WRITE_ROWS_EVENT_V1", 24: "UPDATE_ROWS_EVENT_V1", 25: "DELETE_ROWS_EVENT_V1", 27: "HEARTBEAT_LOG_EVENT", 29: "ROWS_QUERY_EVENT", 30: "WRITE_ROWS_EVENT", 31: "UPDATE_ROWS_EVENT", 32: "DELETE_ROWS_EVENT", 33: "GTID_LOG_EVENT", 34: "ANONYMOUS_GTID_LOG_EVENT", 35: "PREVIOUS_GTIDS_LOG_EVENT", 160: "ANNOTATE_ROWS_EVENT", 162: "MARIADB_GTID_EVENT", 163: "MARIADB_GTID_LIST_EVENT"}
ROWS = [23, 24, 25, 30, 31, 32]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(data: str | Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD and ends no job."""
    return F.make_valid_utf8(_col(data).cast("string"))


def le(data: str | Column, at: int | Column, n: int, kind: str = "bigint") -> Column:
    """An unsigned little-endian number of n bytes; ``at`` counts from 1. Eight bytes need decimal(20,0)."""
    data = _col(data)
    if n == 8:
        parts = [F.substring(data, F.lit(at + k) if isinstance(at, int) else at + k, F.lit(1)) for k in reversed(range(n))]
        return F.conv(F.hex(F.concat(*parts)), 16, 10).cast("decimal(20,0)")
    whole = F.hex(F.substring(data, F.lit(at) if isinstance(at, int) else at, F.lit(n)))
    if n == 1:
        return F.conv(whole, 16, 10).cast(kind)
    # digits backwards are the bytes backwards, each with its halves exchanged: little code, which stays compiled
    number, low = F.conv(F.reverse(whole), 16, 10).cast("bigint"), F.lit(int("0F" * n, 16))
    swapped = F.shiftleft(number.bitwiseAND(low), 4).bitwiseOR(F.shiftright(number, 4).bitwiseAND(low))
    return swapped.cast(kind)


def be(data: str | Column, at: int | Column, n: int) -> Column:
    return F.conv(F.hex(F.substring(_col(data), F.lit(at) if isinstance(at, int) else at, F.lit(n))), 16, 10).cast("decimal(20,0)" if n == 8 else "bigint")


def to_le(number: str | Column, n: int) -> Column:
    """A number that isn't negative as n little-endian bytes; its higher bytes are left out."""
    digits = F.lpad(F.hex(_col(number).cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(n)]))


def header(raw: str = "raw") -> dict[str, Column]:
    """The fields of an event's header, and of row events and table maps the table's number."""
    kind = le(raw, 5, 1, "int")
    return {"ts": le(raw, 1, 4), "type_code": kind, "server_id": le(raw, 6, 4), "event_length": le(raw, 10, 4), "next_pos": le(raw, 14, 4), "flags": le(raw, 18, 2, "int"), "table_id": F.when(kind.isin(19, *ROWS), le(raw, 20, 6))}


def checksum_matches(raw: str = "raw") -> Column:
    """Whether the last four bytes are the CRC32 of the rest."""
    size = F.length(_col(raw))
    return F.crc32(F.substring(_col(raw), F.lit(1), size - 4)) == le(raw, size - 3, 4)


def body(raw: str = "raw", checksum: Column | bool = True) -> Column:
    size = F.length(_col(raw)) - 19
    tail = F.when(checksum, 4).otherwise(0) if isinstance(checksum, Column) else F.lit(4 if checksum else 0)
    return F.substring(_col(raw), F.lit(20), size - tail)


def declared_checksum(raw: str = "raw") -> Column:
    """Of a format description: true (CRC32), false (none) or null (it doesn't say)."""
    size = F.length(_col(raw))
    crc = (size >= 81) & (le(raw, size - 4, 1) == 1)
    none = (size >= 77) & (le(raw, size, 1) == 0)
    return F.when(crc, True).when(none, False)


def kind_name(code: str | Column = "type_code") -> Column:
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair if pair[0] != 2])
    return F.coalesce(F.element_at(names, _col(code)), F.lit("UNKNOWN"))


def is_rows(code: str | Column = "type_code") -> Column:
    return _col(code).isin(ROWS)


def rotate_file(data: str = "body") -> Column:
    """The file that a ROTATE event names."""
    name = F.expr(f"substring(`{data}`, 9)")
    return F.regexp_replace(text(name), "\\x00$", "")


def rotate_position(data: str = "body") -> Column:
    return le(data, 1, 8)


def query_text(data: str = "body") -> Column:
    """The statement of a QUERY event; null where the body is too short."""
    d = F.col(data)
    at = F.lit(13) + le(data, 12, 2, "int") + le(data, 9, 1, "int") + 1
    size = F.length(d)
    return F.when((size >= 13) & (at <= size), text(F.substring(d, at + 1, size - at)))


def query_database(data: str = "body") -> Column:
    """The default database of a QUERY event; empty if it has none, null where the body is too short."""
    d = F.col(data)
    at, n = F.lit(13) + le(data, 12, 2, "int"), le(data, 9, 1, "int")
    return F.when((F.length(d) >= 13) & (at + n < F.length(d)), text(F.substring(d, at + 1, n)))


def mysql_gtid(data: str = "body") -> Column:
    """``uuid:number`` of a GTID event; null if the number isn't positive."""
    h = F.lower(F.hex(F.substring(F.col(data), 2, 16)))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    number = le(data, 18, 8)
    return F.when((F.length(data) >= 25) & (number >= 1) & (number < F.lit(str(1 << 63)).cast("decimal(20,0)")), F.concat(uuid, F.lit(":"), number.cast("string")))


def mariadb_gtid(data: str = "body", server: str = "server_id") -> Column:
    """``domain-server-sequence`` of a MariaDB GTID event; the server comes from the header."""
    return F.when(F.length(data) >= 13, F.concat_ws("-", le(data, 9, 4).cast("string"), F.col(server).cast("string"), le(data, 1, 8).cast("string")))


def annotation(data: str = "body") -> Column:
    """The statement of an ANNOTATE_ROWS event."""
    return text(data)
