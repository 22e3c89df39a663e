"""Reading column by column gives what reading one by one gives, whatever the events hold."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from rowtide.functions import codec as C
from rowtide.functions import columnar
from rowtide.functions.errors import LogError
from rowtide.operators import decode as D
from rowtide.plans import changelog as L

COLUMNS = {
    "tiny": (C.TINY, 0), "small": (C.SHORT, 0), "medium": (C.INT24, 0), "whole": (C.LONG, 0), "big": (C.LONGLONG, 0), "year": (C.YEAR, 0), "real": (C.FLOAT, 4), "double": (C.DOUBLE, 8),
    "enum": (C.STRING, C.ENUM << 8 | 1), "set": (C.STRING, C.SET << 8 | 8), "bit": (C.BIT, 1 << 8 | 4), "bits": (C.BIT, 8 << 8), "short": (C.VARCHAR, 100), "long": (C.VARCHAR, 3000), "char": (C.STRING, 0xFE << 8 | 40),
    "blob": (C.BLOB, 2), "json": (C.JSON, 4), "packed": (C.VARCHAR_COMPRESSED, 200), "deflated": (C.BLOB_COMPRESSED, 3), "money": (C.NEWDECIMAL, 10 << 8 | 2), "wide": (C.NEWDECIMAL, 36 << 8 | 18), "point": (C.NEWDECIMAL, 4 << 8 | 4), "units": (C.NEWDECIMAL, 18 << 8),
    "day": (C.DATE, 0), "moment": (C.DATETIME2, 6), "moment0": (C.DATETIME2, 0), "stamp": (C.TIMESTAMP2, 3), "stamp0": (C.TIMESTAMP2, 0), "clock": (C.TIME2, 0), "clock5": (C.TIME2, 5), "seconds": (C.TIMESTAMP, 0),
}


def raw_value(rng, kind, meta):
    """Bytes as a server could send them, for values that aren't null."""
    size = {C.TINY: 1, C.SHORT: 2, C.INT24: 3, C.LONG: 4, C.LONGLONG: 8, C.YEAR: 1, C.DATE: 3, C.TIMESTAMP: 4}.get(kind)
    if kind in (C.DATETIME2, C.TIMESTAMP2, C.TIME2):
        size = {C.DATETIME2: 5, C.TIMESTAMP2: 4, C.TIME2: 3}[kind] + (meta + 1) // 2
    if kind == C.STRING and meta >> 8 in (C.ENUM, C.SET):
        size = meta & 0xFF
    if kind == C.BIT:
        size = (meta >> 8) + bool(meta & 0xFF)
    if size:
        return rng.choice([rng.randbytes(size), bytes(size), b"\xff" * size])
    if kind in (C.FLOAT, C.DOUBLE):
        return struct.pack("<f" if kind == C.FLOAT else "<d", rng.choice([0.0, -1.5, 1e30, rng.random()]))
    if kind == C.NEWDECIMAL:
        precision, scale = meta >> 8, meta & 0xFF
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randrange(precision - scale + 1)))
        tail = "".join(rng.choice("0123456789") for _ in range(scale))
        return C.decimal_bytes(rng.choice(["", "-"]) + (digits or "0") + ("." + tail if scale else ""), precision, scale)
    text = "".join(rng.choice("ab é日") for _ in range(rng.randrange(6))).encode() + (b"\xff" if rng.random() < 0.02 else b"")
    return C.written(kind, meta, text)


def images(rng, columns, n, nulls):
    out = []
    for _ in range(n):
        gone = [rng.random() < nulls for _ in columns]
        out.append(C.bits(gone) + b"".join(raw_value(rng, t, m) for (_, t, m), x in zip(columns, gone, strict=True) if not x))
    return out


def events(rng, columns, kind, n, nulls=0.2):
    update, bodies = kind == 31, []
    for k in range(n):
        count = rng.choice([0, 1, 1, 2, 5]) * (2 if update else 1)
        bodies.append(C.rows_body(7, len(columns), images(rng, columns, count, nulls), update))
        if k % 17 == 0:
            bodies[-1] = bodies[-1][: rng.randrange(len(bodies[-1]))]  # cut off
        if k % 23 == 0:
            at = rng.randrange(len(bodies[-1]) + 1)
            bodies[-1] = bodies[-1][:at] + rng.randbytes(3) + bodies[-1][at + 3 :]
    return bodies


def one_by_one(kind, bodies, table):
    found = []
    for e, body in enumerate(bodies):
        try:
            found += [(e, k, row) for k, row in enumerate(C.rows(kind, body, table))]
        except LogError:
            found.append((e, None, None))
    return found


def side_by_side(kind, bodies, table):
    data = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8)
    offsets = np.cumsum([0, *map(len, bodies)])
    got = columnar.read(kind, data, offsets[:-1], offsets[1:], table)
    assert got is not None
    whole = [None, None]
    for side in (0, 1):
        if got.images[side] is not None and len(got.event):
            columns = [got.column(side, c) for c in range(len(table.types))]
            fields = [{n: c.field(n).to_pylist() for n in "idsb"} for c in columns]
            for f in fields:
                f["s"] = [x if x is None else x.encode() for x in f["s"]]
            pick = lambda c, f, r: (columnar.KINDS[int(c.kinds[r])].as_py(), next((f[n][r] for n in "idsb" if f[n][r] is not None), None))
            whole[side] = [[pick(c, f, r) for c, f in zip(columns, fields, strict=True)] for r in range(len(got.event))]
    rows = [(int(e), int(k), tuple(None if w is None else w[r] for w in whole)) for r, (e, k) in enumerate(zip(got.event, got.number, strict=True))]
    return rows, set(got.left.tolist())


def shown(rows):
    return sorted(((e, k, repr(row)) for e, k, row in rows), key=str)


@pytest.mark.parametrize("name", [*COLUMNS, "all"])
@pytest.mark.parametrize("unsigned", [False, True])
def test_same_values(name, unsigned):
    rng = random.Random(f"{name}{unsigned}")
    columns = [(n, *c) for n, c in COLUMNS.items() if name in (n, "all")]
    table = C.TableMap(C.table_map(7, "d", "t", columns, [unsigned] * len(columns)))
    assert columnar.plan(table) is not None
    for kind in (30, 31, 32, 23):
        bodies = events(rng, columns, kind, 120)
        if kind == 23:
            bodies = [b[:8] + b[10:] for b in bodies]
        try:
            rows, left = side_by_side(kind, bodies, table)
        except LogError:  # a compressed value is damaged: all go one by one
            assert {"packed", "deflated"} & {n for n, *_ in columns}
            continue
        want = [x for x in one_by_one(kind, bodies, table) if x[0] not in left]
        assert shown(rows) == shown(want)
        assert len(left) < 60  # the rest is read here


def test_rare_types_and_few_events_are_left():
    old = C.TableMap(C.table_map(7, "d", "t", [("t", C.TIME, 0)]))
    assert columnar.plan(old) is None
    table = C.TableMap(C.table_map(7, "d", "t", [("k", C.LONG, 0)]))
    body = C.rows_body(7, 1, [C.image([("k", C.LONG, 0)], [5])])
    data = np.frombuffer(body * 3 + bytes(8), np.uint8)
    at = np.arange(3) * len(body)
    assert columnar.read(30, data, at, at + len(body), table) is None


def test_one_large_event_among_small_ones():
    columns = [("k", C.LONG, 0), ("s", C.VARCHAR, 50)]
    table = C.TableMap(C.table_map(7, "d", "t", columns))
    small = [C.rows_body(7, 2, [C.image(columns, [k, f"x{k}"])]) for k in range(30)]
    large = C.rows_body(7, 2, [C.image(columns, [k, "y"]) for k in range(500)])
    rows, left = side_by_side(30, [*small, large], table)
    assert left == {30} and len(rows) == 30


def test_batches_of_both_kinds(spark):
    """Tables mixed in one batch, with damaged events, absent columns and a type that is read one by one."""
    rng = random.Random(4)
    plain, rare = [("k", C.LONGLONG, 0), ("s", C.VARCHAR, 50), ("d", C.NEWDECIMAL, 10 << 8 | 2)], [("k", C.LONGLONG, 0), ("t", C.TIME, 0)]
    raws = [C.event(15, L.FDE), C.event(19, C.table_map(1, "a", "plain", plain)), C.event(19, C.table_map(2, "b", "rare", rare))]
    want = []
    for k in range(200):
        at = len(raws)
        if k % 3 == 0:
            raws.append(C.event(30, C.rows_body(2, 2, [b"\0" + struct.pack("<q", k) + (k + 10000).to_bytes(3, "little")])))
            want.append((at, 0, "rare", 0, k))
        elif k % 10 == 1:
            raws.append(C.event(30, C.rows_body(1, 3, [C.image(plain, [k, "x", "1.00"])])[:-1]))
            want.append((at, 0, "plain", 202, None))
        elif k % 10 == 2:
            present = (1).to_bytes(6, "little") + b"\1\0\2\0" + C.pack(3) + C.bits([True, False, True])
            raws.append(C.event(30, present + b"\0" + struct.pack("<q", k) + C.decimal_bytes("5.00", 10, 2)))
            want.append((at, 0, "plain", 0, k))
        else:
            n = rng.randrange(1, 4)
            raws.append(C.event(30, C.rows_body(1, 3, [C.image(plain, [k, None if j else "é", "-1.50"]) for j in range(n)])))
            want += [(at, j, "plain", 0, k) for j in range(n)]
    log = spark.createDataFrame([("s", "f", k, bytearray(r)) for k, r in enumerate(raws)], L.RAW).coalesce(1)
    found = D.changes(log).collect()
    assert sorted((r.seq, r.row_in_event, r.table, r.error_code, r.after[0].i if r.after else None) for r in found) == sorted(want)
    assert {v.s for r in found if r.table == "plain" and r.after for v in r.after if v.ordinal == 2} == {"-1.50", "5.00"}
    columns = D.decode_columns(D.attach(D.with_header(log)), {"k": (0, "bigint"), "s": (1, "string"), "more": (2, "decimal(10,2)"), "none": (9, "string")}).collect()
    assert sorted((r.seq, r.row_in_event, r.error_code, r.k, r.s) for r in columns) == sorted((r.seq, r.row_in_event, r.error_code, r.after[0].i if r.after else None, r.after[1].s if r.after else None) for r in found)
    assert all(r.none is None for r in columns)


def test_pieces_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in (10, 0, 900, 5, 5)], pa.binary())], ["body"])
    assert [p.num_rows for p in columnar.pieces(batch, "body", 100)] == [2, 1, 2]


def test_batches_stay_small(spark, monkeypatch):
    """Wide tables give batches of few rows, and a damaged compressed value leaves its event to be read alone."""
    monkeypatch.setattr(D, "VALUES", 10)
    columns = [("k", C.LONG, 0), *[(f"c{k}", C.TINY, 0) for k in range(6)], ("z", C.BLOB_COMPRESSED, 2)]
    raws = [C.event(15, L.FDE), C.event(19, C.table_map(1, "d", "t", columns))]
    images = [C.image(columns, [k, *range(6), b"x" * k if k % 3 else None]) for k in range(60)]
    bad = C.image(columns, [99, *range(6), b"yy"])
    raws += [C.event(30, C.rows_body(1, 8, images[k : k + 3])) for k in range(0, 60, 3)]
    raws.append(C.event(30, C.rows_body(1, 8, [bad[:-1] + b"?"])))
    log = spark.createDataFrame([("s", "f", k, bytearray(r)) for k, r in enumerate(raws)], L.RAW).coalesce(1)
    for whole, bad_code in ((log.filter("seq < 22"), None), (log, 202)):
        found = D.changes(whole).collect()
        assert sorted(r.after[0].i for r in found if r.error_code == 0) == list(range(60))
        assert {r.after[7].b and len(r.after[7].b) for r in found if r.error_code == 0} == {None, *[k for k in range(60) if k % 3]}
        assert [r.error_code for r in found if r.error_code] == ([] if bad_code is None else [bad_code])
