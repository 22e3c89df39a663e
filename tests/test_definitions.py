"""Tables as logs declare them, typed views, strict queries and what streams tell."""

import datetime
import logging
import struct
import time

import pytest
from pyspark.errors import StreamingQueryException

from rowtide.functions import codec as C
from rowtide.operators import apply as A
from rowtide.operators import decode as D
from rowtide.plans import changelog as L
from rowtide.sources import framing
from rowtide.streaming import progress, supervise

COLUMNS = [("id", C.LONGLONG, 0), ("e", C.STRING, C.ENUM << 8 | 1), ("s", C.STRING, C.SET << 8 | 8), ("v", C.VECTOR, 4), ("t", C.TIME2, 3), ("at", C.TIMESTAMP2, 0), ("d", C.DATE, 0), ("n", C.NEWDECIMAL, 50 << 8 | 4), ("b", C.BLOB, 2)]


def log(spark, raws, file="f", source="s"):
    return spark.createDataFrame([(source, file, k, bytearray(r)) for k, r in enumerate(raws)], L.RAW).coalesce(1)


def row(table, columns, values, kind=30):
    return C.event(kind, C.rows_body(table, len(columns), [C.image(columns, values)], kind == 31))


def test_labels_and_keys(spark):
    labels = {1: ["x", "é"], 2: [f"l{k}" for k in range(64)]}
    table = C.TableMap(C.table_map(1, "d", "t", COLUMNS, labels=labels, key=[2, 0]))
    assert table.labels[1] == ["x", "é"] and table.labels[2] == labels[2] and table.labels[0] is None and table.key == [2, 0]
    body = C.table_map(1, "d", "t", COLUMNS)
    for extra in (bytes([6]) + b"\x02\x05x", bytes([5]) + b"\x01\x09", bytes([8]) + b"\x01\x63", bytes([9]) + b"\x01\x01", bytes([8]) + b"\x01\xfc"):
        damaged = C.TableMap(body + extra)  # nothing depends on these
        assert damaged.labels == [None] * 9 and damaged.key == [] and damaged.names[0] == "id"
    assert C.TableMap(body + bytes([9]) + C.pack(4) + b"\x01\x0a\x00\x05").key == [1, 0]


def test_definitions(spark):
    first, second = C.table_map(1, "d", "t", COLUMNS, labels={1: ["x"], 2: ["y"]}, key=[0]), C.table_map(9, "d", "t", COLUMNS[:1], [True])
    raws = [C.event(19, first), C.event(19, C.table_map(5, "d", "t", COLUMNS, labels={1: ["x"], 2: ["y"]}, key=[0])), C.event(19, second), C.event(19, first), C.event(19, C.table_map(2, "d", "bad", COLUMNS)[:-12])]
    found = D.definitions(D.with_header(log(spark, raws))).orderBy("table", "seq", "ordinal").collect()
    assert [(r.table, r.seq, r.n_maps, r.ordinal, r.error_code) for r in found[:2]] == [("bad", 4, 1, None, 100), ("t", 0, 3, 0, 0)]
    assert [(r.name, r.type, r.spark_type, r.labels, r.key, r.n_columns) for r in found[1:4]] == [("id", "LONGLONG", "bigint", None, 0, 9), ("e", "ENUM", "string", ["x"], None, 9), ("s", "SET", "array<string>", ["y"], None, 9)]
    assert [(r.seq, r.unsigned, r.spark_type) for r in found[10:]] == [(2, True, "decimal(20,0)")]
    changed = D.schema_changes(D.definitions(D.with_header(log(spark, raws)))).collect()
    assert [(r.table, r.seq, r.added, r.dropped, r.retyped) for r in changed] == [("t", 2, [], sorted(n for n, *_ in COLUMNS[1:]), ["id"])]
    assert D.definitions(D.with_header(log(spark, raws).limit(0))).collect() == []


def test_view(spark):
    labels = {1: ["x", "é"], 2: [f"l{k}" for k in range(64)]}
    values = [7, 2, 1 | 1 << 63, struct.pack("<2f", 1.5, -2.0), -90_061_500_000, 1_700_000_000_000_000, datetime.date(2024, 2, 29), "-12.5000", b"\xff"]
    zero = [8, 0, 0, b"", 0, 0, None, None, None]
    odd = C.image(COLUMNS, [9, 9, None, b"abc", None, None, None, None, None])
    raws = [C.event(19, C.table_map(1, "d", "t", COLUMNS[:2])), row(1, COLUMNS[:2], [1, 1]), C.event(19, C.table_map(1, "d", "t", COLUMNS, labels=labels)), row(1, COLUMNS, values), row(1, COLUMNS, zero), C.event(30, C.rows_body(1, 9, [odd])), C.event(30, C.rows_body(1, 9, [odd])[:-1]), C.event(19, C.table_map(2, "d", "other", COLUMNS[:1])), row(2, COLUMNS[:1], [5]), row(1, COLUMNS, values, 32)]
    found = D.view(log(spark, raws), "d", "t")
    assert dict(found.dtypes) == {"source_id": "string", "file": "string", "seq": "bigint", "row_in_event": "int", "op": "string", "error_code": "int", "id": "bigint", "e": "string", "s": "array<string>", "v": "array<float>", "t": "interval day to second", "at": "timestamp", "d": "date", "n": "string", "b": "binary"}
    rows = {r.seq: r for r in found.collect()}
    assert sorted(rows) == [1, 3, 4, 5, 6, 9]
    assert (rows[1].id, rows[1].e, rows[1].s, rows[1].at) == (1, "x", None, None)
    r = rows[3]
    assert (r.id, r.e, r.s, r.v, r.t, r.d, r.n, bytes(r.b)) == (7, "é", ["l0", "l63"], [1.5, -2.0], -datetime.timedelta(hours=25, minutes=1, seconds=1, milliseconds=500), datetime.date(2024, 2, 29), "-12.5000", b"\xff")
    assert found.filter("seq = 3").selectExpr("unix_seconds(at) AS x").first().x == 1_700_000_000
    assert (rows[4].e, rows[4].s, rows[4].v, rows[4].t) == ("", [], [], datetime.timedelta(0))
    assert (rows[5].e, rows[5].s, rows[5].v) == (None, None, None)
    assert rows[6].error_code == 202 and rows[6].id is None and rows[9].op == "DELETE" and rows[9].id is None
    assert D.view(log(spark, raws), "d", "t", "before").filter("op = 'DELETE'").first().id == 7
    with pytest.raises(ValueError, match="no table"):
        D.view(log(spark, raws), "d", "none")


def test_spark_types():
    kinds = {(C.TINY, 0, True): "smallint", (C.INT24, 0, False): "int", (C.LONG, 0, True): "bigint", (C.NEWDECIMAL, 38 << 8 | 2, False): "decimal(38,2)", (C.NEWDECIMAL, 39 << 8 | 2, False): "string", (C.JSON, 4, False): "binary", (C.YEAR, 0, False): "int", (C.BIT, 8, False): "bigint", (C.VARCHAR, 9, False): "string", (C.TIMESTAMP, 0, False): "timestamp", (C.DATETIME, 0, False): "timestamp_ntz", (C.TIME, 0, False): "interval"}
    assert {k: C.spark_type(*k, None) for k in kinds} == kinds


def test_strict_queries(spark):
    raws = [C.event(19, C.table_map(1, "d", "t", COLUMNS[:1])), row(1, COLUMNS[:1], [1])]
    good = D.strict(D.changes(log(spark, raws)))
    assert [r.error_code for r in good.collect()] == [0]
    for bad, name in ((row(1, COLUMNS[:1], [1])[:-1] + b"?", "ChecksumError: code 101"), (row(3, COLUMNS[:1], [1]), "DecodeError: code 202 at event 2 of f")):
        with pytest.raises(Exception, match=name):
            D.strict(D.changes(log(spark, [*raws, bad]))).collect()


def test_damage_ends_a_strict_stream_at_once(spark, tmp_path, caplog):
    folder, marks = tmp_path / "log", str(tmp_path / "marks")
    folder.mkdir()
    raws = [C.event(19, C.table_map(1, "d", "t", COLUMNS[:1])), *[row(1, COLUMNS[:1], [k]) for k in range(20)]]
    (folder / "b.1").write_bytes(framing.MAGIC + b"".join(raws))
    listener = progress.LogLines()
    spark.streams.addListener(listener)
    started = []

    def start():
        started.append(1)
        events, _ = A.observed(D.with_header(framing.read_files(spark, str(folder), files_per_trigger=1)), "seen")
        found = D.strict(D.decode_rows(D.attach(events)))
        return found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", marks).start()

    try:
        with caplog.at_level(logging.DEBUG, "rowtide.streaming"):
            assert supervise.keep_running(start, to_end=True) == 0
            assert spark.read.parquet(str(tmp_path / "out")).count() == 20
            (folder / "b.2").write_bytes(framing.MAGIC + b"".join(raws[:5]) + raws[5][:-1] + b"?")
            with pytest.raises(StreamingQueryException, match="ChecksumError"):
                supervise.keep_running(start, to_end=True)
            for _ in range(50):
                if any("query_failed" in m for m in caplog.messages):
                    break
                time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert len(started) == 2
    told = [m for m in caplog.messages if m.startswith("event=batch") and "seen.events=21" in m]
    assert told and "seen.crc_errors=0" in told[0] and any(m.startswith("event=query_started") for m in caplog.messages) and any(m.startswith("event=query_failed") for m in caplog.messages)


def test_lines():
    assert progress.line("x", a=1, b=None, c="y") == "event=x a=1 c=y"


def test_damaged_events_of_any_kind(spark):
    good = C.table_map(1, "d", "t", COLUMNS[:1])
    raws = [C.event(19, good, next_pos=100), row(1, COLUMNS[:1], [1]), C.event(16, bytes(8), next_pos=500)[:-1] + b"?", C.event(19, good[:-9]), C.event(19, good[:-9]), C.event(2, b""), row(1, COLUMNS[:1], [1])[:-1] + b"?"]
    events = D.with_header(log(spark, raws))
    assert sorted((r.seq, r.error_code, r.offset, r.op) for r in D.damaged(events).collect()) == [(2, 101, 469, None), (3, 100, None, None), (4, 100, None, None)]
    both = D.decode_rows(D.attach(events)).unionByName(D.damaged(events))
    assert [(r.seq, r.error_code) for r in D.failfast_prefix(both).collect()] == [(1, 0)]
    assert D.damaged(events.limit(0)).collect() == []
