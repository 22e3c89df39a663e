"""Change rows from a stream of raw events.

The only state is, for each file of a source, the table maps seen so far: files are independent, because a log's table
numbers hold until it rotates. Header fields, filters and everything after the decoding are ordinary columns.
"""

from __future__ import annotations

import bisect
import itertools
import os
import pickle
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions import bytes as B
from rowtide.operators import decode
from rowtide.streaming import progress

_OUT = "source_id string, file string, seq long, type_code int, crc_ok boolean, error_code int, body binary, map_body binary, ts long, next_pos long, event_length long"


def attach_maps(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Give row events the latest table map of their table; a file's events arrive in order of ``seq``, and its state ends
    with it."""
    maps = pickle.loads(state.get[0]) if state.exists else {}
    events = pd.concat(list(batches)).sort_values("seq")
    kind = events["type_code"].fillna(0).astype(int).to_numpy()
    events["map_body"] = _as_of(events["table_id"], kind, events["body"], maps)
    if np.isin(kind, (3, 4)).any():
        if state.exists:
            state.remove()
    else:
        state.update((pickle.dumps(maps),))
    kept = events[np.isin(kind, B.ROWS) | (events["error_code"].to_numpy() != 0)].copy()
    kept["source_id"], kept["file"] = key
    yield kept[[x.split()[0] for x in _OUT.split(", ")]]


def _as_of(tables: pd.Series, kinds: np.ndarray, bodies: pd.Series, maps: dict) -> list[bytes | None]:
    """The map of each event's table at its place; ``maps`` is what was known before and becomes what is known after."""
    out = []
    for table, kind, body in zip(tables.tolist(), kinds.tolist(), bodies.tolist(), strict=True):
        if kind == 19:
            maps[table] = bytes(body)
        out.append(maps.get(table))
    return out


def changes(raw: DataFrame, allowed: Column | DataFrame | None = None, checksum: str = "crc32") -> DataFrame:
    """A stream of change rows from a stream of raw events.

    From ``framing.read_files`` (closed files), checksums are as their files declare and nothing is kept between triggers.
    From ``read`` (files that grow), ``checksum`` is crc32 or none for all events, and the state is a file's table maps.
    """
    if "map_body" in raw.columns:
        return decode.changes(raw, allowed)
    ends = F.col("type_code").isin(3, 4) & (F.col("flags").bitwiseAND(0x20) == 0)
    events = decode.with_header(raw, checksum).filter(F.col("type_code").isin(19, *B.ROWS) | ends | (F.col("error_code") != 0))
    events = events.select("source_id", "file", "seq", "type_code", "crc_ok", "error_code", "body", "table_id", "ts", "next_pos", "event_length")
    held = events.groupBy("source_id", "file").applyInPandasWithState(attach_maps, _OUT, "maps binary", "append", "NoTimeout")
    held = held.withColumns(decode.map_names("map_body"))
    return decode.decode_rows(decode.passing(held, allowed))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``format("rowlog")`` as a stream; registers the source."""
    from rowtide.sources.framing import RowLogSource

    spark.dataSource.register(RowLogSource)
    return spark.readStream.format("rowlog").options(**options).load(path)


def lanes(path: str, most: int) -> list[dict[str, str]]:
    """Options for ``read`` that deal a folder's files out to at most so many lanes: neighbours by name, of about as many bytes.

    Every name belongs to one lane, those of files to come to the last if names grow. Each lane is a stream with a checkpoint of
    its own and bounded triggers of its own. They run side by side, so that the triggers of a long log don't all wait for each
    other. A checkpoint belongs to its lane: these options must be kept with it.
    """
    from rowtide.sources.framing import _Options

    files = _Options({"path": path}).files()
    ends = list(itertools.accumulate(map(os.path.getsize, files)))
    starts = sorted({bisect.bisect_right(ends, ends[-1] * k // most) for k in range(1, most)} - {0, len(files)}) if ends else []
    names = ["", *(os.path.basename(files[k]) for k in starts), ""]
    return [{k: v for k, v in (("since", a), ("before", b)) if v} for a, b in itertools.pairwise(names)]


def run_lanes_to_end(streams: Sequence[DataFrame], out: str, checkpoints: Sequence[str], partitions: int | None = None) -> int:
    """As ``run_to_end``, of streams side by side, each to a folder of its own under ``out``, for ``written``."""
    writers = [x.writeStream.format("parquet").option("path", f"{out}/{k}").option("checkpointLocation", at).outputMode("append") for k, (x, at) in enumerate(zip(streams, checkpoints, strict=True))]
    return progress.run_all_to_end(writers, partitions)


def written(streams: Sequence[DataFrame], out: str) -> DataFrame:
    """What ``run_lanes_to_end`` has written, of each lane what its log of files says."""
    return reduce(DataFrame.unionByName, [x.sparkSession.read.schema(x.schema).parquet(f"{out}/{k}") for k, x in enumerate(streams)])


def run_to_end(stream: DataFrame, out: str, checkpoint: str, partitions: int | None = None) -> int:
    """Write what is there to Parquet, exactly once, and stop; a later call goes on from the checkpoint.

    Returns the number of triggers that had rows. ``partitions``: as for ``progress.started``.
    """
    return progress.run_to_end(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"), partitions)
