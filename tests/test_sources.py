"""Table files, modules and containers."""

import struct

import pytest

from granary.plans.files import make_container, make_module
from granary.sources import modules, tables

FIELDS = [tables.Field("NAME", "C", 8), tables.Field("QTY", "N", 5), tables.Field("OK", "L", 1), tables.Field("NOTE", "M", 4)]
ROWS = [(False, {"NAME": "bolt", "QTY": 12, "OK": True, "NOTE": b"x" * 100}), (True, {"NAME": "nut", "QTY": None, "OK": False, "NOTE": None})]


def test_records_and_memo():
    body, memo = tables.table_bytes(FIELDS, ROWS)
    got = list(tables.records(body, memo))
    assert [(n, d) for n, d, _ in got] == [(1, False), (2, True)]
    assert got[0][2] == {"NAME": b"bolt    ", "QTY": b"   12", "OK": b"T", "NOTE": b"x" * 100}
    assert got[1][2]["QTY"] == b"     " and got[1][2]["NOTE"] == b""


def test_memo_out_of_range():
    assert tables.memo_payload(b"\0" * 64, 9) == b""
    assert tables.memo_payload(None, 1) == b""


def test_faults():
    body, _ = tables.table_bytes(FIELDS, ROWS)
    assert tables.header_fault(body) is None
    assert tables.header_fault(body[:20])
    assert tables.header_fault(body[:10] + b"\0\0" + body[12:])  # records of no length
    assert tables.header_fault(body[:4] + struct.pack("<I", 999) + body[8:])
    assert tables.header_fault(body[:8] + struct.pack("<H", 60000) + body[10:])
    with pytest.raises(tables.MalformedTable):
        tables.read_header(b"<xml>" * 20)


def test_read_modes(spark, tmp_path):
    body, memo = tables.table_bytes(FIELDS, ROWS)
    (tmp_path / "good.dbf").write_bytes(body)
    (tmp_path / "good.FPT").write_bytes(memo)
    (tmp_path / "bad.dbf").write_bytes(b"no")
    rows = tables.read_tables(spark, str(tmp_path), mode="PERMISSIVE").collect()
    assert len(rows) == 3 and sum(r.fault is not None for r in rows) == 1
    assert next(r for r in rows if r["_recno"] == 1)["values"]["NOTE"] == b"x" * 100
    with pytest.raises(Exception, match="bad.dbf"):
        tables.read_tables(spark, str(tmp_path)).collect()


def test_protected_root(spark):
    with pytest.raises(ValueError, match="protected"):
        tables.write_table(spark.range(1), "/data/corpus/x.dbf", FIELDS, protected="/data/corpus")


def test_module_sections():
    m = make_module([["a = 1", "b = 2"], []], ["A", "B"])
    ((at, end, secs),) = modules.modules(m)
    assert (at, end, len(secs)) == (0, len(m), 2)
    assert [s.raw_text for s in secs[0].statements] == [b"a = 1", b"b = 2"]
    assert secs[1].symbols == ["A", "B"] and secs[0].symbols is None
    assert modules.classify(secs) == "parsed"
    assert modules.classify([secs[1]]) == "empty"
    assert modules.classify([]) == "rejected"


def test_a_module_ends_at_the_next():
    m = make_module([["x"]], ["X"])
    assert [(a, b) for a, b, _ in modules.modules(m + m)] == [(0, len(m)), (len(m), 2 * len(m))]


def test_bad_sections():
    m = make_module([["a = 1"]], ["A"])
    assert modules.read_section(m, 8, False)[0] is not None
    assert modules.read_section(m[:-12], 8, False)[0] is None
    assert modules.read_section(b"\xfc\x02\x00\x03\x00", 0, False)[1] == "declared length below 3"


def test_container_binding():
    blob = make_container([("xopen.bmp", b"BMx"), ("open.bmp", b"BMy"), ("a.txt", b"hello")])
    c = modules.read_container(blob)
    assert [(e[1], e[2]) for e in c.entries] == [("xopen.bmp", "exact"), ("open.bmp", "tail"), ("a.txt", "exact")]
    assert [blob[e[3] : e[4]] for e in c.entries] == [b"BMx", b"BMy", b"hello"]
    assert c.accepted and not c.overlaps
    assert modules.bind({0: "ab", 3: ""}, 3) == ("", "empty")
    assert modules.bind({0: "ab", 3: ""}, 2) == ("", "outside")


def test_container_faults():
    with pytest.raises(modules.ContainerError):
        modules.read_container(b"garbage" * 10)
    blob = make_container([("a", b"x")])
    with pytest.raises(modules.ContainerError, match="pool"):
        modules.read_container(blob[:9] + b"\xff\xff\xff\x00" + blob[13:])


def test_container_in_an_executable():
    inner = make_container([("a.txt", b"hello")])
    pe = bytearray(0x200)
    pe[:2] = b"MZ"
    struct.pack_into("<I", pe, 0x3C, 0x80)
    pe[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<H", pe, 0x86, 1)
    struct.pack_into("<H", pe, 0x94, 0)
    struct.pack_into("<II", pe, 0x98 + 16, 0x100, 0x100)
    c = modules.read_container(bytes(pe) + inner)
    assert c.base == 0x200 and c.entries[0][1] == "a.txt"
    assert (bytes(pe) + inner)[c.entries[0][3] : c.entries[0][4]] == b"hello"


def test_values_that_do_not_fit_are_refused():
    n, c = tables.Field("N", "N", 4), tables.Field("C", "C", 6)
    assert tables.encode_value(n, 1234) == b"1234" and tables.encode_value(c, "aŁ", 0xC8) == b"a\xa3    "
    for f, value, mark in ((n, 123456, 3), (c, "too long", 3), (c, "中", 3)):
        with pytest.raises(ValueError):
            tables.encode_value(f, value, mark)


def test_text_is_read_by_the_files_own_mark(spark, tmp_path):
    fields = [tables.Field("C", "C", 8)]
    for name, mark, text in (("a", 0x7A, "中文"), ("b", 3, "é€"), ("c", 1, "é")):
        (tmp_path / f"{name}.dbf").write_bytes(tables.table_bytes(fields, [(False, {"C": text})], mark)[0])
    got = tables.typed(tables.read_tables(spark, str(tmp_path)), fields)
    assert sorted(r.C for r in got.collect()) == sorted(["中文", "é€", "é"])


def test_edits_keep_other_bytes():
    body, memo = tables.table_bytes(FIELDS, ROWS)
    t = tables.TableImage(body, memo)
    t.set_field(2, "NOTE", b"new")
    t.set_field(1, "QTY", 7)
    n = t.append_clone(1, {"NAME": "copy"})
    rows = [r for *_, r in tables.records(*t.files())]
    assert n == 3 and rows[2]["NAME"] == b"copy    " and rows[2]["NOTE"] == b"x" * 100 and rows[1]["NOTE"] == b"new" and rows[0]["QTY"] == b"    7"
    assert t.pointer(3, "NOTE") != t.pointer(1, "NOTE")
    assert t.overwrite_memo(1, "NOTE", b"y" * 100) and not t.overwrite_memo(1, "NOTE", b"short")
    rows = [r for *_, r in tables.records(*t.files())]
    assert rows[0]["NOTE"] == b"y" * 100 and rows[2]["NOTE"] == b"x" * 100
    t.set_field(1, "NOTE", None)
    assert t.pointer(1, "NOTE") == 0 and bytes(t.files()[1][: len(memo)])[8:] == memo[8:].replace(b"x" * 100, b"y" * 100)
    first = tables.TableImage(tables.table_bytes([tables.Field("M", "M", 4)], [(False, {})])[0])
    first.set_field(1, "M", b"made")
    assert next(r for *_, r in tables.records(*first.files()))["M"] == b"made"
    with pytest.raises(IndexError):
        t.set_field(9, "QTY", 1)
