"""Texts of transaction-id sets and statements, in all the forms that may come."""

import pytest

from rowtide.functions import gtid as G
from rowtide.functions import statements as S

A, B = "00000000-0000-0000-0000-00000000000a", "abcdefab-cdef-abcd-efab-cdefabcdef00"


def column(spark, values, made):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, g string").select("k", made.alias("x"))
    return [r.x for r in df.orderBy("k").collect()]


def test_normalized(spark):
    forms = {
        f"{A}:7": f"{A}:1-7", f"{A}:0": "", f"{A}:1-7": f"{A}:1-7", f"{A}:1:3": f"{A}:1:3", f"{A}:tag:5": f"{A}:tag:5", "0-1-100": "0-1-100", "": "", "none": "none",
        f"{A}:7, {B}:9": f"{A}:1-7,{B}:1-9", f"{A}:0,{B}:9": f"{B}:1-9", f",{A}:7,,\t{B}:2-3 ,": f"{A}:1-7,{B}:2-3", f"{A}:0,{B}:0": "", f" {A}:7": f" {A}:1-7", "0-1-5,1-1-6": "0-1-5,1-1-6", None: None,
    }
    assert column(spark, list(forms), G.normalized("g")) == list(forms.values())


def test_tagged(spark):
    forms = {f"{A}:1-3": False, f"{A}:1,{B}:2": False, f"{A}:tag:1": True, f"{A}:1,{B}:t:2": True, "": False, "0-1-2": False}
    assert column(spark, list(forms), G.is_tagged("g")) == list(forms.values())


def test_mariadb(spark):
    forms = {"0-1-2": True, " 0-1-2 ,, 1-2-3,": True, "": False, ",": False, "0-1": False, "0-1-2-3": False, "0--2": False, "4294967295-0-18446744073709551615": True, "4294967296-0-1": False, "0-1-18446744073709551616": False, "00000000000000001-1-1": True, "0-1-2,x": False, f"{A}:1": False}
    assert column(spark, list(forms), G.is_mariadb("g")) == list(forms.values())


def test_mariadb_sets_count_as_a_whole(spark):
    sets = spark.createDataFrame([(1, "0-1-5,1-1-7"), (1, "0-2-9,,"), (2, "0-1-5,bad"), (3, ""), (4, None), (5, "0-1-5")], "id int, g string")
    found = sorted(map(tuple, G.mariadb_parts(sets, "g", "id").collect()), key=str)
    assert [(r[0], r[1], r[2], r[3] and int(r[3])) for r in found] == [(1, 0, 1, 5), (1, 0, 2, 9), (1, 1, 1, 7), (2, None, None, None), (5, 0, 1, 5)]
    assert sorted((r.id, r.domain, r.server, int(r.seq)) for r in G.high_water(G.mariadb_parts(sets, "g", "id"), "id").collect()) == [(1, 0, 2, 9), (1, 1, 1, 7), (5, 0, 1, 5)]


@pytest.mark.parametrize("text,want", [("1-3::5:", [(1, 4), (5, 6)]), (" 1-3 : 5 ", [(1, 4), (5, 6)]), ("1- 3", [(1, 4)]), ("+1-+3", [(1, 4)]), ("1 -3", None), (":", None), (": :", None), ("0-4", None), ("3-2", None), ("5-4", None), ("5-5", [(5, 6)]), ("-3", None), ("9223372036854775806", [((1 << 63) - 2, (1 << 63) - 1)]), ("9223372036854775807", None), ("99999999999999999999999", None), ("1-2-3", None)])
def test_ranges(spark, text, want):
    found = G.ranges(spark.createDataFrame([(f"{A}:{text},{B}:1",)], "g string"), "g").collect()
    assert sorted((r.sid, r.start, r.end) for r in found if r.sid) == ([] if want is None else [*[(A, a, b) for a, b in want], (B, 1, 2)])
    assert (want is None) == any(r.sid is None for r in found)


def test_encoded_sets(spark):
    le = lambda n: n.to_bytes(8, "little").hex()
    a, b = A.replace("-", ""), B.replace("-", "")
    forms = {"": le(0), " ,": le(0), f"{B}:1-3:7,{A}:2,{B}:3-6": le(2) + a + le(1) + le(2) + le(3) + b + le(1) + le(1) + le(8), f"{A.upper()}:5": le(1) + a + le(1) + le(5) + le(6), f"{A}:x": None, f"{A}:1,{B}": None, A: None}
    sets = spark.createDataFrame([(k, g) for k, g in enumerate(forms)], "k int, g string")
    assert [r.encoded for r in G.encoded_sets(sets, "g", "k").orderBy("k").collect()] == list(forms.values())


def test_first_words(spark):
    forms = {"commit": "COMMIT", " \n\t/* a */ -- b\n# c\rALTER\nDrop t": "DROP", "; commit": "", "/* open commit": "", "--commit\nROLLBACK": "ROLLBACK", "create_x": "CREATE", "": "", "1 commit": "", "/*!50100 ALTER TABLE t */ truncate t": "TRUNCATE"}
    assert column(spark, list(forms), S.first_keyword("g")) == list(forms.values())
    body = lambda text: bytes(8) + b"\3" + bytes(2) + b"\2\0" + b"..abc\0" + text.encode()
    for text, word in forms.items():
        assert S.ends_transaction(body(text)) == (word in S.BOUNDARIES)
    assert not S.ends_transaction(b"") and not S.ends_transaction(body("")[:-1])
