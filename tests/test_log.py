"""The operators on small logs written here; larger ones are held against SQL in test_queries."""

import struct

import pytest
from pyspark.sql import functions as F

from rowtide.functions import bytes as B
from rowtide.functions import codec as C
from rowtide.functions import gtid as G
from rowtide.functions import statements as S
from rowtide.functions.errors import ParseError
from rowtide.operators import apply as A
from rowtide.operators import decode as D
from rowtide.operators import filters, transactions
from rowtide.plans import catalog
from rowtide.sources import framing
from rowtide.streaming import changes as stream
from rowtide.streaming import transactions as tracked

COLUMNS = [("id", C.LONG, 0)]
MAP = "e80300001301000000320000006400000000002a000000000000000674657374646200057573657273000103000137f708d8"
WRITE = "e80300001e0100000028000000c800000000002a0000000000000002000101003930000087736de3"
UPDATE = "e80300001f010000002e0000002c01000000002a00000000000000020001010100010000000002000000e56b8988"
DELETE = "e80300002001000000280000009001000000002a000000000000000200010100070000004f316b49"
ROTATE = "0000000004010000002c000000000000000000040000000000000062696e6c6f672e303030303032cb8f26f5"


def raw(spark, events, file="f1", source="s"):
    rows = [(source, file, k, bytearray(bytes.fromhex(e) if isinstance(e, str) else e)) for k, e in enumerate(events)]
    return spark.createDataFrame(rows, "source_id string, file string, seq long, raw binary")


def test_fixture_events(spark):
    rows = D.changes(raw(spark, [MAP, WRITE, UPDATE, DELETE])).orderBy("seq").collect()
    assert [(r.op, r.before and r.before[0].i, r.after and r.after[0].i, r.offset, r.error_code) for r in rows] == [("INSERT", None, 12345, 200, 0), ("UPDATE", 1, 2, 300, 0), ("DELETE", 7, None, 400, 0)]
    assert (rows[0].database, rows[0].table, rows[0].after[0].name, rows[0].ts) == ("testdb", "users", "0", 1000)


def test_framing_does_not_depend_on_chunks():
    data = bytes.fromhex(MAP + WRITE + UPDATE + DELETE + ROTATE)
    framer, got = framing.Framer(), []
    for at in range(0, len(data), 7):
        got += framer.feed(data[at : at + 7])
    assert b"".join(got) == data and len(got) == 5
    whole = framing.MAGIC + data
    for size in (1, 3, 50, 1000):
        assert [x for x, _ in framing.events_of(whole[k : k + size] for k in range(0, len(whole), size))] == got
    assert [c for _, c in framing.events_of([whole[:-1]])] == [0, 0, 0, 0, 100] and len(list(framing.events_of([whole[:-1]], closed=False))) == 4


def test_framing_stops_at_a_bad_length():
    framer = framing.Framer(100)
    with pytest.raises(ParseError):
        list(framer.feed(struct.pack("<IBIIIH", 0, 2, 1, 101, 0, 0)))
    with pytest.raises(ParseError):
        list(framer.feed(b""))
    framer.reset()
    assert len(list(framer.feed(bytes.fromhex(MAP)))) == 1
    assert (framing.size_limit(0), framing.size_limit(1), framing.size_limit(5000)) == (1 << 30, 23, 5000)


def test_missing_map_damage_and_blocked_tables(spark):
    bad = bytearray(bytes.fromhex(WRITE))
    bad[-6] ^= 1
    log = raw(spark, [WRITE, MAP, bytes(bad), WRITE])
    assert [r.error_code for r in D.changes(log).orderBy("seq").collect()] == [202, 101, 0]
    assert D.failfast_prefix(D.changes(raw(spark, [MAP, WRITE, bytes(bad), WRITE]))).count() == 1
    blocked = D.changes(raw(spark, [MAP, bytes(bad)]), filters.allowed(exclude_tables=["users"]))
    assert blocked.count() == 0


def test_checksum_modes(spark):
    plain = C.event(30, C.rows_body(42, 1, [C.image(COLUMNS, [5])]), checksum=False)
    table = C.event(19, C.table_map(42, "d", "t", COLUMNS), checksum=False)
    assert D.changes(raw(spark, [table, plain]), checksum="none").first().after[0].i == 5
    fde = C.event(15, b"\4\0" + b"x" * 50 + b"\0" * 4 + b"\x13" + b"\0" * 5 + b"\0", checksum=False)
    assert D.changes(raw(spark, [fde, table, plain])).first().after[0].i == 5
    rotate = C.event(4, (4).to_bytes(8, "little") + b"b.2", flags=0x20)
    seen = D.with_header(raw(spark, [fde, rotate])).filter("type_code = 4").select(B.rotate_file().alias("f"), "crc_ok").first()
    assert (seen.f, seen.crc_ok) == ("b.2", True)


def test_null_and_absent_columns(spark):
    columns = [("a", C.LONG, 0), ("b", C.VARCHAR, 20), ("c", C.BLOB, 2)]
    body = (9).to_bytes(6, "little") + b"\1\0\2\0" + C.pack(3) + C.bits([True, False, True]) + C.bits([False, True]) + struct.pack("<i", 3)
    row = D.changes(raw(spark, [C.event(19, C.table_map(9, "d", "t", columns)), C.event(30, body)])).first()
    assert [(v.kind, v.i) for v in row.after] == [("INT", 3), ("NULL", None), ("NULL", None)]
    images = C.image(columns, [1, "", b""])
    row = D.changes(raw(spark, [C.event(19, C.table_map(9, "d", "t", columns)), C.event(30, C.rows_body(9, 3, [images]))])).first()
    assert (row.after[1].s, bytes(row.after[2].b)) == ("", b"")


def test_bytes_that_are_no_text_survive(spark):
    columns = [("a", C.VARCHAR, 20)]
    log = raw(spark, [C.event(19, C.table_map(9, "d", "t", columns)), C.event(30, C.rows_body(9, 1, [C.image(columns, [b"\xff\xfe"])]))])
    v = D.changes(log).first().after[0]
    assert (v.kind, v.s, bytes(v.b)) == ("STRING", None, b"\xff\xfe")


def test_gtid_fixtures(spark):
    s1, s2 = "00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-000000000002"
    bad = ["nocolon", "short:1", f"{s1}:0", f"{s1}:-1", f"{s1}:5-3", f"{s1}:", f"{s1}:9223372036854775807", f"{s1}:tag:1", s1.replace("1", "g") + ":1"]
    found = G.ranges(spark.createDataFrame([(x,) for x in bad], "g string"), "g", "g")
    assert {r.g for r in found.filter("sid is null").collect()} == set(bad)
    sets = spark.createDataFrame([(1, f"{s1}:1-3:7,{s2}:1-8,{s1}:4")], "id int, g string")
    merged = G.merged(G.ranges(sets, "g", "id"), "id", "sid")
    assert G.set_text(merged, "id").first().gtid_set == f"{s1}:1-4:7,{s2}:1-8"
    part = G.ranges(spark.createDataFrame([(1, f"{s1}:2-3:9")], "id int, g string"), "g", "id")
    assert [r.start for r in G.missing(merged, part, "id").collect()] == [9]
    maria = spark.createDataFrame([("0-1-100", True), ("0-1-2,1-1-3,", True), ("0-1", False), ("a-1-2", False), (f"{s1}:1", False)], "g string, want boolean")
    assert maria.filter(G.is_mariadb("g") != F.col("want")).count() == 0


def test_transaction_tracker(spark):
    sid = (1).to_bytes(16, "big")
    gtid = lambda n: C.event(33, b"\0" + sid + struct.pack("<Q", n))
    query = lambda q: C.event(2, struct.pack("<IIBHH", 1, 0, 0, 0, 0) + b"\0" + q)
    log = [gtid(42), query(b"BEGIN"), gtid(43), C.event(16, b"\0" * 8), gtid(44), query(b"ALTER TABLE t ADD c INT"), C.event(34, b""), gtid(45), C.event(34, b"")]
    done = transactions.commits(transactions.with_gtid(D.with_header(raw(spark, log)))).orderBy("seq").collect()
    assert [(r.seq, r.gtid.split(":")[1]) for r in done] == [(2, "42"), (3, "43"), (5, "44"), (8, "45")]


def test_transaction_goes_on_in_the_next_file(spark):
    gtid = C.event(33, b"\0" + (1).to_bytes(16, "big") + struct.pack("<Q", 7))
    log = raw(spark, [gtid], "f1").union(raw(spark, [C.event(16, b"\0" * 8)], "f2"))
    done = transactions.commits(transactions.with_gtid(D.with_header(log))).collect()
    assert [(r.file, r.gtid[-1]) for r in done] == [("f2", "7")]


def test_identifiers_and_lines(spark):
    df = spark.createDataFrame([("a`b",), ("x\0y",)], "n string")
    assert [r.q for r in df.select(S.quoted("n").alias("q")).collect()] == ["`a``b`", None]
    line = df.limit(1).select(S.log_line("start", host=F.lit("h"), port=F.lit(None), n=F.lit(3)).alias("x")).first().x
    assert line == "event=start host=h n=3"


def test_stream_resumes_and_loses_nothing(spark, tmp_path):
    folder, out, marks = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    event = lambda n: C.event(30, C.rows_body(42, 1, [C.image(COLUMNS, [n])]))
    head = bytes.fromhex(MAP)
    (folder / "b.1").write_bytes(framing.MAGIC + head + b"".join(map(event, range(10))))
    read = lambda: stream.changes(stream.read(spark, str(folder), maxEventsPerTrigger="4")).select(D.column("after", 0, "bigint").alias("id"))
    stream.run_to_end(read(), out, marks)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))
    (folder / "b.1").write_bytes(framing.MAGIC + head + b"".join(map(event, range(15))))  # the file grows, and another comes
    (folder / "b.2").write_bytes(framing.MAGIC + head + b"".join(map(event, range(20, 25))))
    stream.run_to_end(read(), out, marks)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(15), *range(20, 25)]


def test_upsert_batches(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, op string, seq long, v string")
    path = str(tmp_path / "state")
    A.upsert(rows((1, "INSERT", 1, "x"), (2, "INSERT", 2, "y"), (3, "INSERT", 2, "w")), path, ["id"], ["seq"])
    A.upsert(rows((1, "UPDATE", 3, "z"), (2, "DELETE", 5, None)), path, ["id"], ["seq"])
    A.upsert(rows((2, "UPDATE", 4, "late")), path, ["id"], ["seq"])  # a deleted key stays deleted
    assert sorted((r.id, r.v) for r in A.current_state(spark, path).collect()) == [(1, "z"), (3, "w")]


def test_counters_and_errors_of_statements(spark):
    bad = bytearray(bytes.fromhex(WRITE))
    bad[-6] ^= 1
    query = C.event(2, struct.pack("<IIBHH", 1, 0, 0, 0, 0) + b"\0INSERT INTO t VALUES ('caf\xe9')")
    events, seen = A.observed(D.with_header(raw(spark, [MAP, bytes(bad), query])))
    assert events.filter("type_code = 2").select(B.query_text().alias("q")).first().q == "INSERT INTO t VALUES ('caf\ufffd')"
    events.count()
    assert seen.get == {"events": 3, "bytes": len(bytes.fromhex(MAP)) + len(bad) + len(query), "crc_errors": 1}
    failed = D.changes(raw(spark, [MAP, WRITE, bytes(bad)])).orderBy("seq").collect()
    assert [(r.offset, r.error_code) for r in failed] == [(200, 0), (160, 101)]  # where the failed event begins


def test_id_sets_count_as_a_whole(spark):
    s1 = "00000000-0000-0000-0000-000000000001"
    sets = spark.createDataFrame([(1, f"{s1}:1-3,{s1}:tag:5"), (2, f"{s1}:0-4"), (3, f"{s1}:1-3"), (4, f"{s1}:5,x")], "id int, g string")
    merged = G.merged(G.ranges(sets, "g", "id"), "id", "sid")
    assert {r.id: r.gtid_set for r in G.set_text(merged, "id").collect()} == {1: None, 2: None, 3: f"{s1}:1-3", 4: None}
    far = spark.createDataFrame([(1, a, a + 3) for a in (0, (1 << 20) - 3, 1 << 20, (1 << 21) + 5, 3)], "id int, start long, end long")
    assert sorted((r.start, r.end) for r in G.merged(far, "id").collect()) == [(0, 6), ((1 << 20) - 3, (1 << 20) + 3), ((1 << 21) + 5, (1 << 21) + 8)]


def test_values_that_inflate_to_less_or_more():
    from rowtide.functions.errors import DecodeError

    good = C.deflated(b"some text")
    assert C.inflated(good, 100) == b"some text"
    for bad in (good + b"x", bytes([0x81, 0]) + C.zlib.compress(b""), bytes([0x81, 8]) + good[2:]):
        with pytest.raises(DecodeError):
            C.inflated(bad, 100)


def test_files_are_decoded_without_an_exchange(spark, tmp_path):
    (tmp_path / "b.1").write_bytes(framing.MAGIC + bytes.fromhex(MAP + WRITE + UPDATE))
    found = D.changes(framing.read_files(spark, str(tmp_path)))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.op for r in found.orderBy("seq").collect()] == ["INSERT", "UPDATE"]


def test_stream_takes_bounded_triggers_from_the_first_on(spark, tmp_path):
    folder, out, marks = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    event = lambda n: C.event(30, C.rows_body(42, 1, [C.image(COLUMNS, [n])]))
    (folder / "b.1").write_bytes(framing.MAGIC + bytes.fromhex(MAP) + b"".join(map(event, range(19))))
    read = lambda: stream.changes(stream.read(spark, str(folder), maxEventsPerTrigger="5", checkpoint=marks)).select(D.column("after", 0, "bigint").alias("id"))
    assert stream.run_to_end(read(), out, marks) == 4
    with open(folder / "b.1", "ab") as f:
        f.write(b"".join(map(event, range(19, 26))))
    assert stream.run_to_end(read(), out, marks) == 2
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(26))


def test_stream_tracks_transactions_over_triggers_files_and_restarts(spark, tmp_path):
    folder, held, marks = tmp_path / "log", str(tmp_path / "set"), str(tmp_path / "marks")
    folder.mkdir()
    gtid = lambda n: C.event(33, b"\0" + (1).to_bytes(16, "big") + struct.pack("<Q", n))
    end = C.event(16, b"\0" * 8)
    (folder / "b.1").write_bytes(framing.MAGIC + b"".join([gtid(1), end, gtid(2), gtid(3), C.event(34, b""), end, gtid(4)]))
    read = lambda: tracked.commits(stream.read(spark, str(folder), maxEventsPerTrigger="1", checkpoint=marks))
    kept = lambda: [(r.start, r.end) for r in tracked.kept_set(spark, held).orderBy("start").collect()]
    assert tracked.run_to_end(read(), held, marks) == 7
    assert kept() == [(1, 4)]
    (folder / "b.2").write_bytes(framing.MAGIC + end + gtid(9))
    tracked.run_to_end(read(), held, marks)
    assert kept() == [(1, 5)]


def test_stream_keeps_the_highest_id_of_each_domain(spark, tmp_path):
    folder, held, marks = tmp_path / "log", str(tmp_path / "set"), str(tmp_path / "marks")
    folder.mkdir()
    gtid = lambda d, n: C.event(162, struct.pack("<QIB", n, d, 0))
    (folder / "b.1").write_bytes(framing.MAGIC + b"".join([gtid(0, 5), gtid(1, 7), gtid(0, 6), gtid(1, 8)]))
    tracked.run_to_end(tracked.commits(stream.read(spark, str(folder), maxEventsPerTrigger="2", checkpoint=marks)), held, marks, mariadb=True)
    assert sorted((r.domain, int(r.seq)) for r in tracked.kept_set(spark, held).collect()) == [(0, 6), (1, 7)]


def test_names_are_out_of_date_after_a_statement_on_schemas(spark):
    query = lambda q: C.event(2, struct.pack("<IIBHH", 1, 0, 0, 0, 0) + b"\0" + q)
    write = C.event(30, C.rows_body(42, 1, [C.image(COLUMNS, [1])]))
    log = raw(spark, [MAP, write, query(b"INSERT INTO users VALUES (1)"), write, query(b"DROP VIEW v"), write, write]).union(raw(spark, [MAP, write], "f2"))
    known = spark.createDataFrame([("testdb", "users", "f1", 0, ["a"]), ("testdb", "users", "f1", 6, ["b"])], "database string, `table` string, file string, seq long, names array<string>")
    found = D.with_names_asof(D.with_schema_since(D.changes(log), D.with_header(log)), known).orderBy("file", "seq").collect()
    assert [(r.file, r.seq, r.names_resolved, r.after[0].name) for r in found] == [("f1", 1, True, "a"), ("f1", 3, True, "a"), ("f1", 5, False, "0"), ("f1", 6, True, "b"), ("f2", 1, True, "b")]


def test_tables_wanted_as_a_frame_leave_errors(spark):
    write = C.event(30, C.rows_body(42, 1, [C.image(COLUMNS, [1])]))
    log = raw(spark, [write, MAP, write])  # the first has no table map
    wanted = spark.createDataFrame([("testdb", "other")], "database string, `table` string")
    assert [(r.seq, r.error_code != 0) for r in D.changes(log, wanted).collect()] == [(0, True)]


def test_queries_have_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_baselines_are_all_or_nothing(spark):
    good = G.encoded(G.merged(G.ranges(spark.createDataFrame([(1, "00000000-0000-0000-0000-000000000001:1-3:7")], "id int, g string"), "g", "id"), "id", "sid"), "id").first().encoded
    log = [C.event(35, bytes.fromhex(good)), C.event(35, bytes.fromhex(good)[:-1]), C.event(163, struct.pack("<IIIQ", 1, 3, 1, 9)), C.event(163, struct.pack("<I", 1))]
    found = transactions.baselines(D.with_header(raw(spark, log))).orderBy("seq", "a").collect()
    assert [(r.seq, r.kind, r.a, r.b) for r in found] == [(0, "mysql", 1, 4), (0, "mysql", 7, 8), (2, "mariadb", 1, 9)]


def test_columns_without_the_envelope(spark):
    columns = [("id", C.LONG, 0), ("v", C.VARCHAR, 9), ("d", C.NEWDECIMAL, 5 << 8 | 2), ("t", C.BLOB, 2)]
    event = lambda kind, *images: C.event(kind, C.rows_body(9, 4, list(images), kind == 31))
    a, b = C.image(columns, [1, "x", "1.50", "text"]), C.image(columns, [2, None, "-2.25", None])
    broken = C.event(30, C.rows_body(9, 4, [a[:-1]]))
    log = raw(spark, [C.event(19, C.table_map(9, "d", "t", columns)), event(30, a, b), event(31, a + b), event(32, a), broken])
    wanted = {"t": (3, "text"), "d": (2, "decimal(5,2)"), "v": (1, "string")}
    found = D.decode_columns(D.attach(D.with_header(log)), wanted).orderBy("seq", "row_in_event").collect()
    assert [(r.op, r.error_code, r.t, r.d and str(r.d), r.v) for r in found] == [("INSERT", 0, "text", "1.50", "x"), ("INSERT", 0, None, "-2.25", None), ("UPDATE", 0, None, "-2.25", None), ("DELETE", 0, None, None, None), ("INSERT", 202, None, None, None)]
    assert D.decode_columns(D.attach(D.with_header(log)), {"id": (0, "int")}, "before").filter("id = 1").count() == 2


def test_no_events(spark):
    none = raw(spark, [MAP]).limit(0)
    marked = transactions.with_gtid(D.with_position(D.with_header(none)))
    assert D.changes(none).count() == transactions.commits(marked).count() == transactions.checkpoint(marked).count() == 0
