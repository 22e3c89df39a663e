"""What can go wrong with a change log, by kind; ``CODES`` are the fixed numbers of the reports."""

from __future__ import annotations


class LogError(Exception):
    code = 1

    @classmethod
    def of(cls, code: int) -> LogError:
        """The error of a report that has only its number left."""
        found = cls(CODES.get(code, "ERROR"))
        found.code = code
        return found


class ParseError(LogError):
    """An event or table map whose layout is broken."""

    code = 100


class ChecksumError(LogError):
    code = 101


class DecodeError(LogError):
    """A rows event that can't be decoded."""

    code = 202


class RequestRefused(LogError):
    """A server answered a query with an error."""

    code = 402


class ConnectionEnded(LogError):
    """A server ended a connection, or its record ends."""

    code = 403


# Fixed values.
CODES = {0: "OK", 1: "ERROR", 100: "PARSE", 101: "CHECKSUM", 200: "DECODE", 201: "DECODE_COLUMN", 202: "DECODE_ROW", 301: "QUEUE_FULL", 400: "CONNECT", 401: "AUTH", 402: "VALIDATION", 403: "STREAM", 404: "DISCONNECTED"}
