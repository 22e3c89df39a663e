"""Recorded connections, what servers say about tables, and streams that start again."""

import struct
import threading

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rowtide.functions import codec as C
from rowtide.operators import decode as D
from rowtide.operators import transactions
from rowtide.plans import changelog as L
from rowtide.sources import captures, framing
from rowtide.streaming import supervise

LIMIT = 64 << 20
COLUMNS = [("k", C.LONG, 0), ("s", C.VARCHAR, 50)]


def answers(data, limit=LIMIT):
    return list(captures.events_of(memoryview(data), limit))


@pytest.mark.parametrize("size", [0, 1, captures.FULL - 1, captures.FULL, captures.FULL + 1, 2 * captures.FULL])
def test_packets_of_any_size(size):
    content = bytes(size)
    sent = captures.packets(content, 250)
    assert [len(x) for x in captures.contents(memoryview(sent * 2), 1 << 30)] == [size, size]
    assert len(sent) == size + 4 * (1 + size // captures.FULL)


def test_large_event_over_several_packets():
    raw = C.event(2, b"x" * (captures.FULL + 5))
    (found, code, _, _), *rest = answers(captures.packets(b"\0" + raw))
    assert found == raw and code == 0 and not rest


def test_heartbeats_are_no_rows():
    raw = C.event(16, b"\0" * 8)
    beats = [captures.packets(x) for x in (b"", b"\0", b"\0" + C.event(27, b"binlog.000001"))]
    assert [x[0] for x in answers(beats[0] + beats[1] + captures.packets(b"\0" + raw) + beats[2])] == [raw]


def test_how_connections_end():
    raw = C.event(16, b"\0" * 8)
    one = captures.packets(b"\0" + raw)
    ends = {
        b"": None,
        captures.packets(b"\xff\xd4\x04#HY000gone") + one: (403, 1236, "gone"),
        captures.packets(b"\xff\xd4\x04gone") + one: (403, 1236, "gone"),
        captures.packets(b"\xff") + one: (403, 0, "unknown error"),
        captures.packets(b"\xfe\0\0\0\0") + one: (403, None, "end of the stream"),
        captures.packets(b"\x07") + one: (403, None, "answer with mark 7"),
        one[:-1]: (403, None, "a packet is cut off or too long"),
        one[:2]: (403, None, "a packet is cut off or too long"),
        captures.packets(b"\0" + raw + b"x"): (100, None, "event of another length than its packet"),
    }
    for data, want in ends.items():
        found = answers(one + data)
        assert found[0] == (raw, 0, None, None)
        assert [x[1:] for x in found[1:]] == ([] if want is None else [want])
    assert answers(one, limit=len(raw) - 1)[0][1] == 403 and answers(one, limit=len(raw))[0][1] == 0


def test_tables_are_numbered_anew_after_a_rotate(spark):
    row = C.event(30, C.rows_body(1, 2, [C.image(COLUMNS, [5, "x"])]))
    sent = [C.event(15, L.FDE), C.event(19, C.table_map(1, "d", "t", COLUMNS)), row, C.event(4, (4).to_bytes(8, "little") + b"b.2"), row]
    files = spark.createDataFrame([("c", bytearray(b"".join(captures.packets(b"\0" + x) for x in sent))), ("none", None), ("empty", bytearray())], "file string, content binary")
    found = D.changes(captures.events(files)).select("file", "seq", "error_code").collect()
    assert sorted(map(tuple, found)) == [("c", 2, 0), ("c", 4, 202)]


def test_captures_from_a_folder(spark, tmp_path):
    sent = [C.event(19, C.table_map(1, "d", "t", COLUMNS)), C.event(30, C.rows_body(1, 2, [C.image(COLUMNS, [5, "x"])]))]
    (tmp_path / "a.cap").write_bytes(b"".join(captures.packets(b"\0" + x) for x in sent) + captures.packets(b"\xff\x01\0#HY000no"))
    found = D.changes(captures.read_events(spark, str(tmp_path), source_id="one")).orderBy("seq").collect()
    assert [(r.source_id, r.file, r.error_code, r.after[1].s if r.after else None) for r in found] == [("one", "a.cap", 0, "x"), ("one", "a.cap", 403, None)]


@pytest.mark.parametrize("short", [False, True])
def test_results(spark, short):
    ok, refused = captures.packets(b"\0\0\0\2\0\0\0"), captures.packets(b"\xff\x51\x04#42S02no such table")
    data = L.answer(["a", "b"], [["1", None], ["", "é" * 300]], short) + ok + refused + L.answer(["c"], [], short) + L.answer(["d"], [["x"]], short)
    found = captures.results(spark.createDataFrame([("f", bytearray(data)), ("n", None)], "file string, content binary"), short).collect()
    assert [(r.result, r.row, r.names, r["values"], r.error_code) for r in found] == [(0, 0, ["a", "b"], ["1", None], 0), (0, 1, ["a", "b"], ["", "é" * 300], 0), (2, None, None, None, 402), (4, 0, ["d"], ["x"], 0)]
    assert found[2].message == "no such table" and found[2].server_code == 0x451


def test_results_that_fail_count_as_none():
    whole = L.answer(["a", "b"], [["1", "2"], ["3", "4"]])
    tail = L.answer(["c"], [["x"]])
    read = lambda data: [(r[0], r[1], r[4]) for r in captures.results_of(memoryview(data))]
    assert read(whole[:-12]) == [(0, None, 403)]
    assert read(whole[:3]) == [(0, None, 403)]
    few = captures.packets(b"\1") + captures.packets(b"x") + tail
    assert read(few) == [(0, None, 100)]
    heads = whole[: whole.index(captures.packets(b"\1" + b"1\1" + b"2", 5))] if captures.packets(b"\1" + b"1\1" + b"2", 5) in whole else None
    assert heads is not None
    assert read(heads + captures.packets(b"\5x") + tail) == [(0, None, 100)]
    assert read(heads + captures.packets(b"\xff\1\0#HY000lost") + tail) == [(0, None, 403), (1, 0, 0)]
    assert read(b"") == []


def test_registry_fills_in_what_the_log_leaves_out(spark):
    columns = [("k", C.LONG, 0), ("n", C.SHORT, 0)]
    image = C.image(columns, [(1 << 32) - 1, 65535])
    maps = {1: C.table_map(1, "d", "bare", columns, named=False), 2: C.table_map(2, "d", "signed", columns, [False, False], named=False), 3: C.table_map(3, "d", "named", columns), 4: C.table_map(4, "d", "other", columns, named=False), 5: C.table_map(5, "d", "unknown", columns, named=False)}
    raws = [C.event(15, L.FDE), *[C.event(19, m) for m in maps.values()], *[C.event(30, C.rows_body(t, 2, [image])) for t in maps for _ in range(10)]]
    log = spark.createDataFrame([("s", "f", k, bytearray(r)) for k, r in enumerate(raws)], L.RAW).coalesce(1)
    told = [("d", t, n, name, kind) for t in ("bare", "signed", "named") for n, (name, kind) in enumerate([("a", "int unsigned"), ("b", "smallint(5) unsigned")])] + [("d", "other", 0, "a", "int")]
    known = D.registry(spark.createDataFrame(told, "database string, `table` string, ordinal int, name string, type string"))
    attached = D.with_known(D.attach(D.with_header(log)), known)
    want = {"bare": (True, "a", (1 << 32) - 1, 65535), "signed": (True, "a", -1, -1), "named": (True, "k", -1, -1), "other": (False, "0", -1, -1), "unknown": (False, "0", -1, -1)}
    found = D.decode_rows(attached).collect()
    assert len(found) == 50
    for r in found:
        assert (r.names_resolved, r.after[0].name, r.after[0].i, r.after[1].i) == want[r.table]
    few = D.decode_rows(attached.filter("seq % 10 = 0")).collect()  # read one by one
    assert {r.table: (r.names_resolved, r.after[0].name, r.after[0].i, r.after[1].i) for r in few} == want
    assert {r.k for r in D.decode_columns(attached.filter("`table` = 'bare'"), {"k": (0, "bigint")}).collect()} == {(1 << 32) - 1}
    assert "names_resolved" not in D.decode_rows(D.attach(D.with_header(log))).columns


def test_resume_position(spark):
    xid = lambda at: C.event(16, b"\0" * 8, next_pos=at)
    rotate = C.event(4, (120).to_bytes(8, "little") + b"b.7", next_pos=900)
    logs = {"a": [xid(100), rotate, xid(300), xid(0)], "b": [xid(100), xid(50)], "c": [xid(0)], "d": [xid(40), xid(60)[:-1] + b"?"]}
    raw = spark.createDataFrame([(s, "f", k, bytearray(r)) for s, raws in logs.items() for k, r in enumerate(raws)], L.RAW)
    found = transactions.resume_position(D.with_header(raw)).collect()
    assert {r.source_id: (r.log_file, r.offset) for r in found} == {"a": ("b.7", 300), "b": ("", 50), "c": ("", 0), "d": ("", 40)}
    assert transactions.resume_position(D.with_header(raw.limit(0))).collect() == []


class Query:
    """A streaming query as ``keep_running`` sees it."""

    def __init__(self, error=None, rows=0):
        self.error, self.recentProgress, self.stopped = error, [type("P", (), {"numInputRows": rows})()], False

    def processAllAvailable(self):
        if self.error:
            raise self.error

    def awaitTermination(self, seconds):
        if self.error:
            raise self.error
        return False

    def stop(self):
        self.stopped = True


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(supervise, "STEP", 0.001)


def test_a_stream_starts_again(quick):
    made = [Query(OSError("x")), Query(OSError("x")), Query()]
    left = iter(made)
    assert supervise.keep_running(lambda: next(left), most=2, to_end=True) == 2
    assert all(q.stopped for q in made)


def test_starts_in_a_row_are_bounded(quick):
    with pytest.raises(OSError, match="x"):
        supervise.keep_running(lambda: Query(OSError("x")), most=2, to_end=True)
    left = iter([Query(OSError("x"), rows=1) for _ in range(9)])
    with pytest.raises(OSError, match="last"):
        supervise.keep_running(lambda: next(left, None) or Query(OSError("last")), most=1, to_end=True)
    with pytest.raises(OSError):
        supervise.keep_running(lambda: Query(OSError("x")), most=0)


def test_what_no_start_can_mend_is_raised_at_once(quick):
    tries = []

    def start():
        tries.append(1)
        raise ValueError("wrong path")

    with pytest.raises(ValueError, match="wrong path"):
        supervise.keep_running(start)
    assert len(tries) == 1
    assert supervise.is_fatal(AnalysisException("x")) and not supervise.is_fatal(OSError("x"))


def test_stopping_ends_the_wait():
    stop, made = threading.Event(), []

    def start():
        made.append(Query())
        threading.Timer(0.05, stop.set).start()
        return made[-1]

    Query.awaitTermination, before = (lambda self, seconds: stop.wait(seconds) and False), Query.awaitTermination
    try:
        assert supervise.keep_running(start, stop=stop) == 0
    finally:
        Query.awaitTermination = before
    assert made[0].stopped and len(made) == 1
    assert supervise.keep_running(start, stop=stop) == 0 and len(made) == 1


def begun(n):
    return C.event(33, b"\0" + (1).to_bytes(16, "big") + struct.pack("<Q", n))


def said(statement):
    return C.event(2, struct.pack("<IIBHH", 1, 0, 1, 0, 2) + b"..d\0" + statement)


def test_readers_of_files_follow_transactions_as_windows_do(spark, tmp_path):
    row, maria = C.event(30, C.rows_body(1, 2, [C.image(COLUMNS, [5, "x"])])), C.event(162, struct.pack("<QIB", 7, 3, 0))
    head = [C.event(15, L.FDE), C.event(19, C.table_map(1, "d", "t", COLUMNS))]
    logs = {
        "b.1": [*head, row, begun(1), said(b"BEGIN"), row, C.event(16, b"\0" * 8), row, begun(2), said(b"/* a */ alter table t"), row],
        "b.2": [*head, begun(3), row, begun(4), row, C.event(34, b""), row, begun(0), row, maria, row, said(b"commit"), row, begun(5)[:-9], row],
    }
    for name, raws in logs.items():
        (tmp_path / name).write_bytes(framing.MAGIC + b"".join(raws))
    raw = framing.read_files(spark, str(tmp_path))
    followed = {(r.file, r.seq): r.gtid for r in raw.collect()}
    marked = transactions.with_gtid(D.with_header(raw.drop("gtid"))).select("file", "seq", "gtid").collect()
    assert followed == {(r.file, r.seq): r.gtid for r in marked}
    assert sum(g is not None for g in followed.values()) > 10
    rows = D.changes(raw, keep=("gtid",)).collect()
    assert all(r.gtid == followed[r.file, r.seq] for r in rows) and len(rows) == 11
    done = spark.createDataFrame([("log", "00000000-0000-0000-0000-000000000001:1-3")], "source_id string, gtid_set string")
    rest = D.decode_rows(transactions.resume_after(D.attach(D.with_header(raw)), done), ("gtid",)).collect()
    assert sorted((r.gtid or "") for r in rest) == sorted((r.gtid or "") for r in rows if r.gtid not in {f"00000000-0000-0000-0000-000000000001:{n}" for n in (1, 2, 3)})


@pytest.mark.parametrize("push", [False, True])
def test_the_source_reads_only_files_asked_for(spark, tmp_path, push):
    spark.dataSource.register(framing.RowLogSource)
    for k in range(4):
        (tmp_path / f"b.{k}").write_bytes(framing.MAGIC + b"".join([C.event(15, L.FDE), C.event(19, C.table_map(1, "d", "t", COLUMNS)), C.event(30, C.rows_body(1, 2, [C.image(COLUMNS, [k, "x"])]))]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", str(push).lower())
    try:
        raw = spark.read.format("rowlog").option("follow", "true").option("pushFilters", str(push)).load(str(tmp_path))
        for where, want in [("file > 'b.1' and file <= 'b.3' and seq >= 0", [2, 3]), ("file = 'b.2'", [2]), ("file in ('b.0', 'b.3')", [0, 3]), ("file < 'b.1' or file = 'b.3'", [0, 3]), ("file >= 'x'", [])]:
            found = D.changes(raw.filter(where))
            assert sorted(r.after[0].i for r in found.collect()) == want
            if push and " or " not in where and want:
                assert found.rdd.getNumPartitions() == len(want)
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_before_and_after_are_not_opened(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"b.{k}").write_bytes(framing.MAGIC + C.event(16, struct.pack("<Q", k)))
    read = lambda **names: sorted({r.file for r in framing.read_files(spark, str(tmp_path), **names).collect()})
    assert read(since="b.1") == ["b.1", "b.2", "b.3"] and read(until="b.1") == ["b.0", "b.1"] and read(since="b.2", until="b.2") == ["b.2"] and read(since="c") == []
    scan = framing.read_files(spark, str(tmp_path), since="b.3")
    scan.collect()
    assert scan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value() == 1


def test_requests(spark):
    from rowtide.functions import gtid as G
    from rowtide.plans import catalog

    dump = lambda body, size=None: b"\x1e" + struct.pack("<HII", 4, 9, 3) + b"b.7" + struct.pack("<QI", 120, len(body) if size is None else size) + body
    some = bytes.fromhex(catalog._encoded((catalog._S1, [(1, 4), (7, 8)]), (catalog._S2, [(5, 6)])))
    sent = {
        b"\x03SELECT 1": ("QUERY", "SELECT 1", None, None, None, None, 0),
        dump(b""): ("DUMP_GTID", None, 9, "b.7", 120, "", 0),
        dump(bytes(8)): ("DUMP_GTID", None, 9, "b.7", 120, "", 0),
        dump(some): ("DUMP_GTID", None, 9, "b.7", 120, f"{catalog._S1}:1-3:7,{catalog._S2}:5", 0),
        dump(some[:-1]): ("DUMP_GTID", None, None, None, None, None, 100),
        dump(some, 5): ("DUMP_GTID", None, None, None, None, None, 100),
        dump(b"")[:9]: ("DUMP_GTID", None, None, None, None, None, 100),
        b"\x03 set @slave_connect_state = '0-1-5'": ("QUERY", " set @slave_connect_state = '0-1-5'", None, None, None, None, 0),
        b"\x12" + struct.pack("<IHI", 4, 0, 7) + b"b.1": ("DUMP", None, 7, "b.1", 4, "0-1-5", 0),
        b"\x12abc": ("DUMP", None, None, None, None, None, 100),
        b"\x0e": ("OTHER", None, None, None, None, None, 0),
        b"": ("OTHER", None, None, None, None, None, 0),
    }
    data = b"".join(map(captures.packets, sent)) + b"\5\0"
    found = captures.requests(spark.createDataFrame([("f", bytearray(data)), ("n", None)], "file string, content binary")).orderBy("request").collect()
    assert [(r.command, r.statement, r.server_id, r.log_file, r.position, r.gtid_set, r.error_code) for r in found] == [*sent.values(), (None,) * 6 + (403,)]
    text = f"{catalog._S1}:1-3:7,{catalog._S2}:5"
    df = spark.createDataFrame([(9, text), (10, "")], "k long, g string")
    made = G.encoded_sets(df, "g", "k").withColumn("encoded", F.when(F.col("k") == 9, F.col("encoded")).otherwise("")).select("k", captures.dump_request(F.col("k"), F.col("encoded"), "b.7", 120).alias("x")).orderBy("k").collect()
    assert bytes(made[0].x) == dump(some) and bytes(made[1].x) == b"\x1e" + struct.pack("<HII", 0, 10, 3) + b"b.7" + struct.pack("<QI", 120, 0)


def test_files_opened_by_tasks(spark, tmp_path, monkeypatch):
    for k in range(3):
        raws = [C.event(15, L.FDE), C.event(19, C.table_map(1, "d", "t", COLUMNS)), *[C.event(30, C.rows_body(1, 2, [C.image(COLUMNS, [n, "x" * 50])])) for n in range(40)]]
        (tmp_path / f"b {k}%41.é").write_bytes(framing.MAGIC + b"".join(raws) + (b"cut" if k == 2 else b""))
    whole = framing.read_files(spark, str(tmp_path))
    some = framing.read_files(spark, str(tmp_path), opened=True)
    assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert "content" not in some._jdf.queryExecution().executedPlan().toString()
    assert D.changes(framing.read_files(spark, str(tmp_path), since="b 2", opened=True)).groupBy("error_code").count().collect() != []
    monkeypatch.setattr(framing, "CHUNK", 100)
    path = next(tmp_path.iterdir())
    assert b"".join(framing._opened(f"file:{path}")) == b"".join(framing._opened(f"file://{path}")) == b"".join(framing._opened(str(path))) == path.read_bytes()
