"""What must not grow with a log: triggers that are told, partitions of a trigger's state, times that a log is read."""

import datetime
import os
import re
import struct

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowtide.functions import bytes as B
from rowtide.functions import codec as C
from rowtide.operators import apply as A
from rowtide.operators import decode as D
from rowtide.operators import transactions
from rowtide.plans import catalog
from rowtide.plans import changelog as L
from rowtide.sources import captures, framing
from rowtide.streaming import changes as stream
from rowtide.streaming import progress, supervise
from rowtide.streaming import transactions as tracked

TABLES = "/root/testdata/sf0.01"
COLUMNS = [("id", C.LONG, 0)]
MAP = C.event(19, C.table_map(42, "testdb", "users", COLUMNS))


def _row(n):
    return C.event(30, C.rows_body(42, 1, [C.image(COLUMNS, [n])]))


def _gtid(n):
    return C.event(33, b"\0" + (1).to_bytes(16, "big") + struct.pack("<Q", n))


def _log(spark, events, file="f1", source="s"):
    return spark.createDataFrame([(source, file, k, bytearray(e)) for k, e in enumerate(events)], "source_id string, file string, seq long, raw binary")


def _plan(found):
    return found._jdf.queryExecution().executedPlan().toString()


def test_all_triggers_are_counted_not_only_those_that_a_query_remembers(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for k in range(5):
        (folder / f"b.{k}").write_bytes(framing.MAGIC + MAP + _row(k))
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name)
    spark.conf.set(name, 2)
    try:
        found = stream.changes(framing.read_files(spark, str(folder), files_per_trigger=1))
        assert stream.run_to_end(found.select("file", "op"), str(tmp_path / "out"), str(tmp_path / "marks")) == 5
    finally:
        spark.conf.set(name, before)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_streams_start_with_few_partitions_of_state(spark, tmp_path):
    folder, marks = tmp_path / "log", str(tmp_path / "marks")
    folder.mkdir()
    (folder / "b.1").write_bytes(framing.MAGIC + MAP + _row(1))
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    try:
        found = stream.changes(stream.read(spark, str(folder), checkpoint=marks)).select("op")
        query = progress.started(found.writeStream.format("noop").option("checkpointLocation", marks), 3)
        query.processAllAvailable()
        query.stop()
        assert query.recentProgress[0].stateOperators[0].numShufflePartitions == 3
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_a_stream_does_not_merge_its_set_anew_at_each_trigger(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "b.1").write_bytes(framing.MAGIC + MAP + b"".join([_gtid(1), _row(1), _gtid(2), _row(2), C.event(16, b"\0" * 8)]))
    done = spark.createDataFrame([("log", "00000000-0000-0000-0000-000000000001:1")], "source_id string, gtid_set string")
    rest = transactions.resume_after(D.attach(D.with_header(framing.read_files(spark, str(folder), files_per_trigger=1))), done)
    assert "Window" not in rest._jdf.queryExecution().analyzed().toString()
    stream.run_to_end(D.decode_rows(rest, ("gtid",)).select("gtid", D.column("after", 0, "bigint").alias("id")), str(tmp_path / "out"), str(tmp_path / "marks"))
    assert [(r.gtid[-1], r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("2", 2)]


def test_a_log_is_exchanged_once_and_not_joined_with_itself(spark):
    log = _log(spark, [MAP, _row(1), MAP, _row(2)]).unionByName(_log(spark, [_row(3)], "f2"))
    found = D.changes(log)
    plan = _plan(found)
    assert "Join" not in plan and len(re.findall(r"(?<!Broadcast)Exchange hash", plan)) == 1
    got = sorted((r.file, r.seq, r.error_code, r.after and r.after[0].i) for r in found.collect())
    assert got == [("f1", 1, 0, 1), ("f1", 3, 0, 2), ("f2", 0, 202, None)]


def test_what_is_carried_over_files_sorts_events_once(spark):
    log = _log(spark, [_gtid(1), MAP, _row(1)]).unionByName(_log(spark, [C.event(16, b"\0" * 8), _gtid(2), MAP, _row(2)], "f2"))
    marked = transactions.with_gtid(D.with_header(log))
    plan = _plan(marked.select("seq", "raw", "gtid", "committed"))
    assert len(re.findall(r"Sort \[source_id#\d+ ASC NULLS FIRST, file#\d+ ASC NULLS FIRST, seq", plan)) <= 2  # one a branch
    got = [(r.file, r.seq, r.gtid and r.gtid[-1], r.committed and r.committed[-1]) for r in marked.orderBy("file", "seq").collect()]
    assert got == [("f1", 0, "1", None), ("f1", 1, "1", None), ("f1", 2, "1", None), ("f2", 0, "1", "1"), ("f2", 1, "2", None), ("f2", 2, "2", None), ("f2", 3, "2", None)]
    raws = re.findall(r"Exchange hashpartitioning\(source_id#\d+, file#\d+[^\n]*REPARTITION", plan)
    assert len(raws) == 2  # of raw events alone, so that the second is the first's
    assert marked.filter(F.col("gtid").isNull()).count() == 0


class _Held:
    """Stands for a session or a frame, and keeps the function that tasks would run."""

    def __getattr__(self, name):
        return self if name == "read" else lambda *a: self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def test_tasks_hold_a_bounded_number_of_events(spark, monkeypatch):
    n, monkeyed = 2500, _Held()
    row = {"event_id": 1, "ts": datetime.datetime(2024, 1, 1), "user_id": 2, "event_type": "view", "value": 0.5, "props": None}
    kind = pa.struct([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    same = {"seconds": 1, "op": "INSERT", "database": "d", "table": "t", "table_id": 7, "file": "binlog.000001", "next_pos": 4, "domain": 0}
    columns = {"event_id": pa.array(range(n)), "before": pa.nulls(n, kind), "after": pa.array([row] * n, kind), **{k: pa.array([v] * n) for k, v in same.items()}}
    monkeypatch.setattr(L, "event_changes", lambda *a: monkeyed)
    L.event_log(spark, "")
    sizes = [b.num_rows for b in monkeyed.run(iter([pa.RecordBatch.from_pydict(columns)]))]
    assert max(sizes) < 5000 and sum(sizes) == 4 * n + 3

    event, files = C.event(16, b""), _Held()
    framing.read_files(files, "")
    sizes = [b.num_rows for b in files.run(iter([pa.RecordBatch.from_pydict({"file": ["f"], "content": [event * 25_000]})]))]
    assert sizes == [10_000, 10_000, 5_000]
    captures.events(files)
    sent = pa.array([captures.packets(b"\0" + event) * 25_000], pa.binary())
    assert [b.num_rows for b in files.run(iter([pa.RecordBatch.from_arrays([pa.array(["f"]), sent], ["file", "content"])]))] == [10_000, 10_000, 5_000]


def test_text_is_written_the_same_in_both_ways():
    columns = [("a", C.VARCHAR, 255), ("b", C.VAR_STRING, 256), ("c", C.VARCHAR, 65535)]
    for values in (["x", "y", "z"], ["\u00e4" * 100, b"\xff\0", ""], [None, "y", b"z" * 300]):
        assert C.image_writer(columns)(values) == C.image(columns, values)


def test_a_batch_that_is_merged_into_a_state_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k % 3, "INSERT", k) for k in range(30)], "id long, op string, seq long").mapInArrow(seen, "id long, op string, seq long")
    A.upsert(rows, str(tmp_path / "state"), ["id"], ["seq"])
    assert made.value == 30
    assert sorted((r.id, r.seq) for r in A.current_state(spark, str(tmp_path / "state")).collect()) == [(0, 27), (1, 28), (2, 29)]


def test_names_of_a_registry_move_no_events(spark):
    log = _log(spark, [C.event(19, C.table_map(42, "testdb", "users", COLUMNS, named=False)), _row(1)])
    told = spark.createDataFrame([("testdb", "users", 1, "key", "int")], "database string, `table` string, ordinal int, name string, type string")
    attached = D.attach(D.with_header(log))
    found = D.decode_rows(D.with_known(attached, D.registry(told)))
    assert "SortMergeJoin" not in _plan(found)
    assert [(r.after[0].name, r.after[0].i, r.names_resolved) for r in found.collect()] == [("key", 1, True)]


def test_a_checkpoint_lines_a_log_up_once(spark):
    start = C.event(35, struct.pack("<Q", 1) + (1).to_bytes(16, "big") + struct.pack("<QQQ", 1, 7, 9))
    log = _log(spark, [start, _gtid(1), C.event(16, b"\0" * 8), _gtid(2), C.event(16, b"\0" * 8), _gtid(5)])
    found = transactions.checkpoint(transactions.with_gtid(D.with_header(log)))
    assert _plan(found).count("Join") == 1
    assert [r.gtid_set for r in found.collect()] == ["00000000-0000-0000-0000-000000000001:1-2:7-8"]
    lists = C.event(163, struct.pack("<I", 2) + struct.pack("<IIQ", 9, 2, 77) + struct.pack("<IIQ", 0, 5, 1))
    log = _log(spark, [lists, C.event(162, struct.pack("<QIB", (1 << 64) - 1, 0, 0)), C.event(16, b"\0" * 8)])
    found = transactions.mariadb_checkpoint(transactions.with_gtid(D.with_header(log)))
    assert _plan(found).count("Join") == 1
    assert sorted((r.domain, r.server, int(r.seq)) for r in found.collect()) == [(0, 1, (1 << 64) - 1), (9, 2, 77)]


def test_little_endian_numbers_of_all_sizes_are_short_expressions(spark):
    data = bytes([0x01, 0xF2, 0x83, 0xE4, 0x75, 0xF6, 0xA7, 0xFF])
    some = spark.createDataFrame([(bytearray(data),), (bytearray(),), (None,)], "raw binary")
    for n in range(1, 9):
        got = [r[0] for r in some.select(B.le("raw", 1, n)).collect()]
        assert got == [int.from_bytes(data[:n], "little"), None, None]
    assert some.select(B.le("raw", 7, 4)).first()[0] == int.from_bytes(data[6:], "little")  # what is there of a short one
    assert str(B.le("raw", 1, 6)).count("substring") <= 2


def test_numbers_of_fixed_size_are_written_all_at_once():
    columns = [("a", C.TINY, 0), ("b", C.SHORT, 0), ("c", C.INT24, 0), ("d", C.LONG, 0), ("e", C.LONGLONG, 0), ("f", C.YEAR, 0), ("g", C.DOUBLE, 8), ("h", C.LONG, 0), ("i", C.TINY, 0)]
    rows = [(-128, 65535, -8388608, 4294967295, -1, 1901, 0.5, -7, 255), (127, -1, 16777215, -2147483648, 1 << 62, 0, -1e300, 7, 0)]
    made = [pa.array(c, pa.float64() if k == C.DOUBLE else pa.int64()) for c, (_, k, _) in zip(zip(*rows, strict=True), columns, strict=True)]
    assert [x.tobytes() for x in C.fixed_images(columns, made)] == [C.image_writer(columns)(list(r)) for r in rows]
    assert C.fixed_images(columns[:1], [pa.array([1, None])]) is None
    assert C.fixed_images([("f", C.YEAR, 0)], [pa.array([3000])]) is None
    assert C.fixed_images([("s", C.VARCHAR, 9)], [pa.array(["x"])]) is None


def test_a_stream_works_out_what_marks_an_event_once(spark, tmp_path):
    folder, marks = tmp_path / "log", str(tmp_path / "marks")
    folder.mkdir()
    begin = C.event(2, L.BEGIN)
    (folder / "b.1").write_bytes(framing.MAGIC + b"".join([begin, _gtid(1), begin, C.event(2, L.COMMIT), begin, begin, _gtid(2)]))
    (folder / "b.2").write_bytes(framing.MAGIC + begin + C.event(16, b"\0" * 8))
    found = tracked.commits(stream.read(spark, str(folder), maxEventsPerTrigger="1", checkpoint=marks))
    query = progress.started(found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", marks))
    query.processAllAvailable()
    query.stop()
    filters = [x for x in query._jsq.explainInternal(False).splitlines() if "Filter " in x]
    assert filters and not any("regexp_extract" in x for x in filters)
    assert sorted((r.file, r.seq, r.gtid[-1]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("b.1", 3, "1"), ("b.2", 1, "2")]


def test_a_batch_of_a_set_holds_only_what_it_adds(spark, tmp_path):
    held, keep = str(tmp_path / "set"), tracked.keep_set(str(tmp_path / "set"))
    batch = lambda *numbers: spark.createDataFrame([("s", f"u:{n}") for n in numbers], "source_id string, gtid string")
    for k, numbers in enumerate([(1, 2, 9), (3,), (8,), ()]):
        keep(batch(*numbers), k)
    keep(batch(8), 2)  # runs again
    assert [spark.read.parquet(f"{held}/batch={k}").count() for k in range(4)] == [2, 1, 1, 0]
    assert sorted((r.source_id, r.sid, r.start, r.end) for r in tracked.kept_set(spark, held).collect()) == [("s", "u", 1, 4), ("s", "u", 8, 10)]


def test_positions_are_kept_as_they_change(spark, tmp_path):
    folder, held, marks = tmp_path / "log", str(tmp_path / "places"), str(tmp_path / "marks")
    folder.mkdir()
    for k in range(3):
        (folder / f"b.{k}").write_bytes(framing.MAGIC + b"".join([C.event(16, b"\0" * 8, 0, 50 + n) for n in range(2)]))
    events = D.with_header(stream.read(spark, str(folder), maxEventsPerTrigger="2", checkpoint=marks), "crc32").withColumn("source_id", F.col("file"))
    places = transactions.resume_position(events)
    progress.run_to_end(places.writeStream.foreachBatch(tracked.keep_last(held)).option("checkpointLocation", marks).outputMode("update"))
    assert [r[1] for r in spark.read.parquet(held).groupBy("batch").count().orderBy("batch").collect()] == [1, 1, 1]
    assert sorted(map(tuple, tracked.kept_last(spark, held, "source_id").collect())) == [(f"b.{k}", "", 51) for k in range(3)]


def test_a_stream_lists_a_folder_once_until_it_changes(tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"b.{k}").write_bytes(framing.MAGIC + _gtid(1) + _gtid(2))
    os.utime(tmp_path, (1, 1))
    listings, listed = [], framing.glob.glob
    monkeypatch.setattr(framing.glob, "glob", lambda *a: listings.append(a) or listed(*a))
    marks = str(tmp_path / "none")
    reader = framing.RowLogStream({"path": str(tmp_path), "maxEventsPerTrigger": "3", "checkpoint": marks})
    ends = [reader.initialOffset()]
    while (end := reader.latestOffset()) != ends[-1]:
        ends.append(end)
    parts = [[(os.path.basename(p.path), p.seq) for p in reader.partitions(a, b)] for a, b in zip(ends, ends[1:], strict=False)]
    assert parts == [[("b.0", 0), ("b.1", 0)], [("b.1", 1), ("b.2", 0)], [("b.3", 0), ("b.4", 0)], [("b.4", 1), ("b.5", 0)]]
    assert len(listings) == 1
    (tmp_path / "b.6").write_bytes(framing.MAGIC + _gtid(3))
    assert reader.latestOffset()["file"] == "b.6" and len(listings) == 2
    (tmp_path / "b.7").write_bytes(framing.MAGIC + _gtid(3))  # at once after the other
    assert reader.latestOffset()["file"] == "b.7"


def test_a_stream_of_a_set_reads_its_events_once(spark, tmp_path):
    folder, marks = tmp_path / "log", str(tmp_path / "marks")
    folder.mkdir()
    start = C.event(35, struct.pack("<Q", 1) + (1).to_bytes(16, "big") + struct.pack("<QQQ", 1, 7, 9))
    (folder / "b.1").write_bytes(framing.MAGIC + b"".join([start, start[:-1] + b"\0", *[x for n in (1, 2, 9) for x in (_gtid(n), C.event(16, b"\0" * 8))]]))
    found = tracked.committed(stream.read(spark, str(folder), checkpoint=marks))
    query = progress.started(found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", marks))
    query.processAllAvailable()
    query.stop()
    assert len(re.findall(r"MicroBatchScan", query._jsq.explainInternal(False).split("== Physical")[-1])) == 1
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.sid[-1], r.start, r.end) for r in got.collect()) == [("1", 1, 3), ("1", 7, 10)]
    assert [(r.source_id, r.start, r.end) for r in tracked.joined(got.unionByName(got.withColumn("end", F.col("start") + 6))).collect()] == [("log", 1, 13)]


def test_a_stream_of_mariadb_ids_reads_the_lists_of_its_files(spark, tmp_path):
    folder, marks = tmp_path / "log", str(tmp_path / "marks")
    folder.mkdir()
    lists = C.event(163, struct.pack("<I", 2) + struct.pack("<IIQ", 9, 2, 77) + struct.pack("<IIQ", 0, 5, 1))
    ids = [C.event(162, struct.pack("<QIB", n, 0, 0)) for n in ((1 << 64) - 1, 3)]
    (folder / "b.1").write_bytes(framing.MAGIC + b"".join([lists, *ids, C.event(16, b"\0" * 8)]))
    stream.run_to_end(tracked.committed(stream.read(spark, str(folder), checkpoint=marks), mariadb=True), str(tmp_path / "out"), marks)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2
    assert sorted((r.domain, r.server, int(r.seq)) for r in tracked.joined(got).collect()) == [(0, 1, (1 << 64) - 1), (9, 2, 77)]


def test_lanes_hold_every_file_once_and_ids_that_go_on_in_the_next(spark, tmp_path):
    folder, begin = tmp_path / "log", C.event(2, L.BEGIN)
    folder.mkdir()
    assert stream.lanes(str(folder), 4) == [{}]
    for name, events in {"b.1": [_gtid(1), _gtid(2)], "b.2": [begin, begin], "b.3": [begin, C.event(16, b"\0" * 8)], "b.4": [begin, _gtid(4)]}.items():
        (folder / name).write_bytes(framing.MAGIC + b"".join(events))
    lanes = stream.lanes(str(folder), 40)
    assert lanes == [{"before": "b.2"}, {"since": "b.2", "before": "b.3"}, {"since": "b.3", "before": "b.4"}, {"since": "b.4"}]
    assert [len(stream.lanes(str(folder), n)) for n in (1, 2)] == [1, 2]
    assert [x[-1:] for x in tracked.pending_at(spark, str(folder), lanes)] == ["", "2", "2", ""]
    (folder / "b.10").write_bytes(framing.MAGIC + begin)  # later, but by its name before others
    (folder / "b.5").write_bytes(framing.MAGIC + C.event(16, b"\0" * 8))
    marks = [str(tmp_path / f"marks{k}") for k in range(4)]
    raw = [stream.read(spark, str(folder), maxEventsPerTrigger="1", checkpoint=m, **lane) for m, lane in zip(marks, lanes, strict=True)]
    found = [tracked.commits(x, pending=at) for x, at in zip(raw, tracked.pending_at(spark, str(folder), lanes), strict=True)]
    assert stream.run_lanes_to_end(found, str(tmp_path / "out"), marks, 1) == 10
    assert sorted((r.file, r.seq, r.gtid[-1]) for r in stream.written(found, str(tmp_path / "out")).collect()) == [("b.1", 1, "1"), ("b.3", 1, "2"), ("b.5", 0, "4")]


def test_triggers_that_spark_does_not_tell_of_are_an_error():
    triggers = progress.Triggers()
    for batch, rows in ((4, 1), (5, 0), (5, 2)):
        triggers.saw("a", batch, rows)
    for batch in (0, 2):
        triggers.saw("b", batch, 1)
    for run in "ab":
        triggers.saw_end(run)
    assert triggers.of("a") == 2
    with pytest.raises(RuntimeError):
        triggers.of("b")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", ["stream_baselines", "stream_changes", "stream_commits", "stream_committed_set", "stream_files", "stream_position", "stream_resume", "stream_statements", "stream_survives"])
def test_a_log_of_several_files_is_streamed_in_lanes(spark, monkeypatch, name):
    queries, start = [], progress.started
    monkeypatch.setattr(progress, "started", lambda *a: queries.append(start(*a)) or queries[-1])
    found = catalog.queries()[name](spark, TABLES)
    assert len({q.id for q in queries}) >= 4
    con, columns = duckdb.connect(), sorted(found.columns)
    con.sql(f"create view events as select * from '{TABLES}/events.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    as_text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert as_text(found.select(*columns).collect()) == as_text(want)


def test_lanes_by_name_hold_every_file_once(spark, tmp_path):
    names = ["b.1", "b.20", "b.13", "b.9", "b.x", "b.", "log^", "b]", "\u00e4"]
    for name in names:
        (tmp_path / name).write_bytes(framing.MAGIC + _gtid(1))
    for most in (1, 3, 10, 12):
        found = [[r.file for r in framing.read_files(spark, str(tmp_path), names=x).collect()] for x in framing.name_lanes(most)]
        assert len(found) == min(most, 10) and sorted(sum(found, [])) == sorted(names)


def test_queries_side_by_side_are_kept_running_until_one_cannot_be():
    class Query:
        recentProgress = ()  # noqa: RUF012

        def __init__(self, error=None):
            self.error = error

        def processAllAvailable(self):
            if self.error:
                raise self.error

        def awaitTermination(self, timeout):
            return False

        def stop(self):
            pass

    left = [[Query(OSError("x")), Query()], [Query()], [Query(OSError("y")), Query()]]
    assert supervise.keep_all_running([lambda x=x: x.pop(0) for x in left], to_end=True) == 2 and not any(left)
    with pytest.raises(ValueError, match="z"):
        supervise.keep_all_running([Query, lambda: (_ for _ in ()).throw(ValueError("z"))])


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_a_log_with_more_rows_is_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(framing, "write_files", lambda log, folder: made.append(log))
    catalog.written_files(spark, TABLES.replace("0.01", "0.001"), catalog._with_statements)
    assert _plan(made[0]).split("== Initial Plan ==")[0].count("MapInArrow") == 1
    assert made[0].filter("seq < 0").count() == 4
