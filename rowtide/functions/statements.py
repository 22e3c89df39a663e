"""Statements, names and log lines as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive groups: with ordinary ones `-- ALTER TABLE t` would be read again as no comment.
_BLANK = r"[ \t\n\r\x0b\f]"
_TRIVIA = rf"(?is)^(?>{_BLANK}++|#[^\r\n]*+|--(?={_BLANK}|$)[^\r\n]*+|/\*(?!!|M!)(?>.*?\*/))*+"
_DDL = rf"{_TRIVIA}(?:/\*M?!\d*+{_BLANK}*+)?+(alter|rename|drop|create|truncate)(?![A-Za-z0-9_$])"
_FIRST = r"(?is)^(?>[ \t\n\r\x0b\f]++|#[^\n]*+|--[^\n]*+|/\*(?>.*?\*/))*+([A-Za-z]+)"
BOUNDARIES = ["COMMIT", "ROLLBACK", "ALTER", "RENAME", "DROP", "CREATE", "TRUNCATE"]


def is_ddl(statement: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(statement, _DDL, 1) != "", F.lit(False))


def first_keyword(statement: str | Column) -> Column:
    return F.upper(F.regexp_extract(statement, _FIRST, 1))


def is_boundary(statement: str | Column) -> Column:
    """Whether the statement ends a transaction."""
    return F.coalesce(first_keyword(statement).isin(BOUNDARIES), F.lit(False))


_first = re.compile(_FIRST).match


def ends_transaction(body: bytes) -> bool:
    """``is_boundary`` of a QUERY event's body, for readers of files."""
    if len(body) < 13 or (at := 14 + int.from_bytes(body[11:13], "little") + body[8]) > len(body):
        return False
    found = _first(body[at:].decode("utf-8", "replace"))
    return found is not None and found.group(1).upper() in BOUNDARIES


def quoted(name: str | Column) -> Column:
    """An identifier in backticks; null if it holds a NUL."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(~F.contains(name, F.lit("\0")), F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def flavor(version: str | Column) -> Column:
    v = F.col(version) if isinstance(version, str) else version
    return F.when(v.contains("MariaDB") | v.contains("mariadb"), "mariadb").otherwise("mysql")


def log_line(event: str, **fields: Column) -> Column:
    """``event=name key=value ...``; null values are left out."""
    return F.concat_ws(" ", F.lit(f"event={event}"), *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields.items()])


def op_label(op: str | Column = "op") -> Column:
    o = F.col(op) if isinstance(op, str) else op
    return F.when(o == "INSERT", "+").when(o == "UPDATE", "~").when(o == "DELETE", "-")
