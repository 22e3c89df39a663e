"""Transactions of a stream: which ids commit, and the set committed so far.

Only events of the kinds that begin or end transactions reach the state, without their bodies, and the state of a source is
the one id that is pending. A source is one log, so its markers are lined up in one task, as many as a trigger takes.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions import gtid as G
from rowtide.operators import decode
from rowtide.operators import transactions as T
from rowtide.sources import framing
from rowtide.streaming import progress


def track(key: tuple, batches: Iterator[pd.DataFrame], state, first: str = "") -> Iterator[pd.DataFrame]:
    """The ids that markers commit: each what the marker before left pending, and ``first`` what was pending before all. Events
    without a mark change nothing."""
    found = pd.concat(list(batches))
    found = found[found["mark"].notna()].sort_values(["file", "seq"])
    if found.empty:
        return
    pending = state.get[0] if state.exists else first
    found["gtid"] = found["mark"].shift(1, fill_value=pending)
    state.update((found["mark"].iloc[-1],))
    found["source_id"] = key[0]
    yield found.loc[found["gtid"] != "", ["source_id", "file", "seq", "gtid"]]


def commits(raw: DataFrame, checksum: str = "crc32", pending: str = "") -> DataFrame:
    """``transactions.commits`` of a stream of raw events: (source_id, file, seq, gtid), each id once, as it commits.

    Files must come in the order of their names, as ``changes.read`` takes them. ``checksum`` is crc32 or none, but from
    ``framing.read_files`` it is as the files declare. A transaction may go on in the next trigger or file. ``pending`` is the id
    that is pending where the stream begins, as ``pending_at`` tells for lanes of one source.
    """
    events = decode.with_header(raw, "auto" if "declared" in raw.columns else checksum)
    # a filter on the mark would be moved below it and work it out several times more; the tasks of the state do that
    told = T.marks(events.filter(F.col("type_code").isin(T.MARKING))).select("source_id", "file", "seq", "mark")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        yield from track(key, batches, state, pending)

    return told.groupBy("source_id").applyInPandasWithState(run, "source_id string, file string, seq long, gtid string", "pending string", "append", "NoTimeout")


def pending_at(spark: SparkSession, path: str, lanes: Sequence[dict[str, str]], checksum: str = "crc32", limit: int = framing.DEFAULT_EVENT) -> list[str]:
    """Of each of ``changes.lanes`` the id that is pending where it begins, "" for none.

    That is what the files before it leave, which must be closed: the last one is read, and those before while there is no mark.
    """
    files, found = framing._Options({"path": path}).files(), {}
    at = {k: bisect.bisect_left(files, lane["since"], key=os.path.basename) for k, lane in enumerate(lanes) if "since" in lane}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from framing._read(framing.FilePart(name), "log", limit)

    while at := {k: n - 1 for k, n in at.items() if n > 0 and k not in found}:
        asked = sorted({files[n] for n in at.values()})
        raw = spark.createDataFrame([(x,) for x in asked], "path string").repartition(len(asked)).mapInArrow(run, framing.SCHEMA)
        marked = T.marks(decode.with_header(raw, checksum).filter(F.col("type_code").isin(T.MARKING)))
        last = dict(marked.groupBy("file").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("seq")))).collect())
        found |= {k: last[name] for k, n in at.items() if last.get(name := os.path.basename(files[n])) is not None}
    return [found.get(k, "") for k in range(len(lanes))]


def committed(raw: DataFrame, checksum: str = "crc32", mariadb: bool = False, pending: str = "", begins: bool = True) -> DataFrame:
    """What a stream of raw events adds to the set of committed ids: its transactions, and the sets that its files ``begin`` with.

    MySQL: (source_id, sid, start, end), joined ranges. MariaDB: (source_id, domain, server, seq), the highest of each domain. A
    trigger's rows are made by the task that has its state, which sees each event once. They are whole when ``joined`` has put
    them together, or ``keep_set`` keeps them. ``pending``: as for ``commits``.
    """
    events, code = decode.with_header(raw, "auto" if "declared" in raw.columns else checksum), 163 if mariadb else 35
    starts = (F.col("type_code") == code) & F.col("crc_ok") if begins else F.lit(False)
    told = T.marks(events.filter(F.col("type_code").isin(T.MARKING) | starts)).select("source_id", "file", "seq", "mark", F.when(starts, F.col("body")).alias("begin"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(batches))
        ids = [x.split("-" if mariadb else ":") for done in track(key, iter([found]), state, pending) for x in done["gtid"]]
        sets = [x for body in found["begin"].dropna() for x in (T.list_of if mariadb else T.ranges_of)(bytes(body))]
        if mariadb:
            rows = _highest([(int(d), int(s), int(n)) for d, s, n in [*ids, *sets]])
        else:
            rows = _joined([*((sid, int(n), int(n) + 1) for sid, n in ids), *sets])
        if rows:
            yield pd.DataFrame([(key[0], *x) for x in rows], columns=["source_id", *(("domain", "server", "seq") if mariadb else ("sid", "start", "end"))])

    parts = "domain long, server long, seq decimal(20,0)" if mariadb else "sid string, start long, `end` long"
    return told.groupBy("source_id").applyInPandasWithState(run, f"source_id string, {parts}", "pending string", "append", "NoTimeout")


def _joined(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``gtid.islands`` of a trigger's ranges."""
    out: list[list] = []
    for sid, start, end in sorted(found):
        if out and out[-1][0] == sid and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([sid, start, end])
    return [tuple(x) for x in out]


def _highest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, Decimal]]:
    """``gtid.high_water`` of a trigger's ids."""
    top: dict[int, tuple[int, int]] = {}
    for domain, server, n in found:
        if domain not in top or n > top[domain][1]:
            top[domain] = server, n
    return [(domain, server, Decimal(n)) for domain, (server, n) in top.items()]


def joined(found: DataFrame) -> DataFrame:
    """The set that rows of ``committed`` come to, in the same form."""
    return G.high_water(found, "source_id") if "domain" in found.columns else G.merged(found, "source_id", "sid")


def keep_set(path: str, mariadb: bool = False) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on ``commits`` or ``committed``: what each batch adds to the set, as a folder under ``path``.

    A batch holds its MySQL ids as joined ranges, MariaDB ones as the highest of each domain, and reads nothing of the others, so
    its work doesn't grow with the set. One that runs again replaces its folder, so nothing counts twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch
        if "gtid" in batch.columns:
            new = G.mariadb_parts(batch, "gtid", "source_id") if mariadb else T.singles(batch)
        kept = G.high_water(new, "source_id") if mariadb else G.islands(new, ["source_id", "sid"])
        kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def kept_set(spark: SparkSession, path: str) -> DataFrame:
    """What ``keep_set`` holds by now: (source_id, sid, start, end), or (source_id, domain, server, seq)."""
    return joined(spark.read.parquet(path).drop("batch"))


def keep_last(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on an aggregate in mode ``update``, such as ``resume_position``: the rows that each batch changes, as
    a folder under ``path``. Lanes have a folder ``lane=k`` each in a common one; a key's rows must come from one lane."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def kept_last(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """What ``keep_last`` holds by now: of each key the row of its last batch."""
    found = spark.read.parquet(path)
    rest = F.struct(*[c for c in found.columns if c not in (*by, "lane", "batch")])
    return found.groupBy(*by).agg(F.max_by(rest, "batch").alias("__last")).select(*by, "__last.*")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mariadb: bool = False, partitions: int | None = None) -> int:
    """Keep the set of a stream of commits until there is no more, and stop; returns the number of triggers with rows.

    ``partitions``: as for ``progress.started``.
    """
    return progress.run_to_end(stream.writeStream.foreachBatch(keep_set(path, mariadb)).option("checkpointLocation", checkpoint).outputMode("append"), partitions)
