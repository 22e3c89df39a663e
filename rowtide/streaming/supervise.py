"""Keeping a streaming query alive: it starts again from its checkpoint, a bounded number of times in a row."""

from __future__ import annotations

import random
import threading
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql.streaming import StreamingQuery

#: Seconds that a wait grows by with each failure in a row, and the longest wait.
STEP, LONGEST = 1.0, 10.0
#: What no new start can mend: wrong arguments and plans, and damaged logs.
FATAL = (ValueError, AnalysisException)
FATAL_NAMES = ("ParseError", "ChecksumError", "DecodeError", "ValueError", "AnalysisException")


def is_fatal(error: BaseException) -> bool:
    """Whether starting again can't help. A query's own error tells its cause as text only."""
    if isinstance(error, StreamingQueryException):
        return any(f"{name}:" in str(error) for name in FATAL_NAMES)
    return isinstance(error, FATAL)


def keep_running(start: Callable[[], StreamingQuery], most: int = 10, to_end: bool = False, stop: threading.Event | None = None, fatal: Callable[[BaseException], bool] = is_fatal) -> int:
    """Start a query, and again whenever it fails, until it ends (``to_end``: until it has read all there is) or ``stop`` is set.

    At most ``most`` starts in a row follow failures without any rows read in between; 0 means none. Waits grow by
    ``STEP`` up to ``LONGEST`` seconds, each shortened by up to half at random. The last error is raised once. Returns the
    number of failures that were survived. Nothing is lost or doubled, as far as the sink and the checkpoint see to that.
    """
    stop = stop or threading.Event()
    survived = in_row = 0
    while not stop.is_set():
        query = None
        try:
            query = start()
            if to_end:
                query.processAllAvailable()
                return survived
            while not query.awaitTermination(0.2):
                if stop.is_set():
                    return survived
            return survived
        except Exception as error:
            if query is not None and any(p.numInputRows > 0 for p in query.recentProgress):
                in_row = 0
            in_row += 1
            if fatal(error) or in_row > most:
                raise
            survived += 1
            stop.wait(min(in_row * STEP, LONGEST) * random.uniform(0.5, 1))
        finally:
            if query is not None:
                query.stop()
    return survived


def keep_all_running(starts: Sequence[Callable[[], StreamingQuery]], most: int = 10, to_end: bool = False, stop: threading.Event | None = None, fatal: Callable[[BaseException], bool] = is_fatal) -> int:
    """``keep_running`` of several queries side by side, each in a thread. An error of one that isn't survived ends those that
    don't run ``to_end``, lets none start again, and is raised. Returns the number of failures that were survived by all."""
    stop = stop or threading.Event()

    def run(start: Callable[[], StreamingQuery]) -> int:
        try:
            return keep_running(start, most, to_end, stop, fatal)
        except BaseException:
            stop.set()
            raise

    with ThreadPoolExecutor(max(1, len(starts))) as threads:
        return sum(threads.map(run, starts))
