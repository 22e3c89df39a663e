"""What streaming queries do, as log lines ``event=name key=value ...`` for Python's ``logging``."""

from __future__ import annotations

import logging
import threading
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener


def line(event: str, **fields: object) -> str:
    """As ``statements.log_line``: fields without a value are left out."""
    return " ".join([f"event={event}", *[f"{k}={v}" for k, v in fields.items() if v is not None]])


class LogLines(StreamingQueryListener):
    """For ``spark.streams.addListener``: starts, batches and ends are told at level INFO, failures at ERROR, idling and
    empty batches at DEBUG. Counters that a query observes, such as those of ``apply.observed``, are fields of its batches."""

    def __init__(self, logger: logging.Logger | None = None):
        self.logger = logger or logging.getLogger("rowtide.streaming")

    def onQueryStarted(self, event) -> None:
        self.logger.info(line("query_started", id=event.id, run=event.runId, name=event.name))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {f"{name}.{k}": v for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        level = logging.INFO if p.numInputRows else logging.DEBUG
        self.logger.log(level, line("batch", id=p.id, batch=p.batchId, rows=p.numInputRows, ms=p.durationMs.get("triggerExecution"), **seen))

    def onQueryIdle(self, event) -> None:
        self.logger.debug(line("query_idle", id=event.id))

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.logger.error(line("query_failed", id=event.id, error=event.exception.splitlines()[0]))
        else:
            self.logger.info(line("query_ended", id=event.id))


class Triggers(StreamingQueryListener):
    """Counts the triggers of each run that had rows; a query itself remembers its last hundred only.

    PySpark would copy all that an event says, value by value, which takes longer than a short trigger does: Spark then drops
    events. So this takes the events of the JVM, and the few values that it needs.
    """

    def __init__(self):
        self.counted: dict[str, int] = {}
        self.last: dict[str, int] = {}
        self.lost: set[str] = set()
        self.ended: set[str] = set()
        self.told = threading.Condition()

    @property
    def _jlistener(self):
        if not hasattr(self, "_held"):
            self._held = SparkContext._jvm.PythonStreamingQueryListenerWrapper(_Told(self))
        return self._held

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.saw(str(event.progress.runId), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.saw_end(str(event.runId))

    def saw(self, run: str, batch: int, rows: int) -> None:
        if batch > self.last.get(run, batch) + 1:
            self.lost.add(run)
        self.last[run] = batch
        self.counted[run] = self.counted.get(run, 0) + (rows > 0)

    def saw_end(self, run: str) -> None:
        with self.told:
            self.ended.add(run)
            self.told.notify_all()

    def of(self, run: str, timeout: float = 120) -> int:
        """The number of a run that has been stopped; its end is told after all of its triggers."""
        with self.told:
            if not self.told.wait_for(lambda: run in self.ended, timeout):
                raise TimeoutError(f"the end of run {run} wasn't told within {timeout} seconds")
        if run in self.lost:
            raise RuntimeError(f"Spark didn't tell of all triggers of run {run}")
        return self.counted.get(run, 0)


class _Told:
    """What the JVM calls, for ``Triggers``."""

    def __init__(self, to: Triggers):
        self.to = to

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress()
        self.to.saw(progress.runId().toString(), progress.batchId(), progress.numInputRows())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.to.saw_end(event.runId().toString())

    class Java:
        implements = ["org.apache.spark.sql.streaming.PythonStreamingQueryListener"]  # noqa: RUF012


_starting = threading.Lock()


def started(writer: DataStreamWriter, partitions: int | None = None) -> StreamingQuery:
    """The query, started with so many shuffle partitions, or as many as there are cores, and no more than are set.

    A stateful trigger writes files for every partition, whether it has rows or not. Once a query has a checkpoint, the
    number in there holds.
    """
    spark, name = writer._df.sparkSession, "spark.sql.shuffle.partitions"
    with _starting:
        before = spark.conf.get(name)
        spark.conf.set(name, min(int(before), partitions or spark.sparkContext.defaultParallelism))
        try:
            return writer.start()
        finally:
            spark.conf.set(name, before)


def run_to_end(writer: DataStreamWriter, partitions: int | None = None) -> int:
    """Start a query as ``started`` does, let it read all there is, and stop it; returns the number of triggers that had rows."""
    return run_all_to_end([writer], partitions)


def run_all_to_end(writers: Sequence[DataStreamWriter], partitions: int | None = None) -> int:
    """As ``run_to_end``, of queries that run side by side; returns the number of triggers of them all. The first error that is
    met stops all."""
    streams, triggers, queries = writers[0]._df.sparkSession.streams, Triggers(), []
    streams.addListener(triggers)
    try:
        try:
            for writer in writers:
                queries.append(started(writer, partitions))
            for query in queries:
                query.processAllAvailable()
        finally:
            for query in queries:
                query.stop()
        return sum(triggers.of(str(query.runId)) for query in queries)
    finally:
        streams.removeListener(triggers)
