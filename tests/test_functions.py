"""The function library's decisions, one by one."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import FUNCTIONS, codepages

ROW = {"s": "One two\r\ntwo three", "e": "  ", "n": -7, "x": 1.005, "a": [3, 1, 2]}

CASES = [
    ("AT", lambda f, c: f("two", c.s, 2), 10),
    ("AT", lambda f, c: f("zzz", c.s, 2), 0),
    ("RAT", lambda f, c: f("two", c.s), 10),
    ("ATLINE", lambda f, c: f("three", c.s), 2),
    ("RATLINE", lambda f, c: f("two", c.s), 2),
    ("ATC", lambda f, c: f("ONE", c.s), 1),
    ("OCCURS", lambda f, c: f("two", c.s), 2),
    ("STRTRAN", lambda f, c: f(c.s, "two", "2", 2), "One two\r\n2 three"),
    ("STREXTRACT", lambda f, c: f(c.s, "One ", "\r"), "two"),
    ("STREXTRACT", lambda f, c: f(c.s, "nope", "\r"), ""),
    ("GETWORDCOUNT", lambda f, c: f(c.s), 4),
    ("GETWORDNUM", lambda f, c: f(c.s, 9), ""),
    ("MLINE", lambda f, c: f(c.s, 2), "two three"),
    ("PADC", lambda f, c: f(F.lit("ab"), 5, "*"), "*ab**"),
    ("PADL", lambda f, c: f(F.lit("abcdef"), 3), "abc"),
    ("LIKE", lambda f, c: f("O?e*", c.s), True),
    ("LIKE", lambda f, c: f("50%", F.lit("50x")), False),
    ("DIFFERENCE", lambda f, c: f(F.lit("Smith"), F.lit("Smythe")), 4),
    ("STR", lambda f, c: f(c.n, 2), "-7"),
    ("STR", lambda f, c: f(c.n * 100, 2), "**"),
    ("VAL", lambda f, c: f(F.lit(" 12.5abc")), 12.5),
    ("VAL", lambda f, c: f(F.lit("abc")), 0.0),
    ("CTOBIN", lambda f, c: f(FUNCTIONS["BINTOC"](F.lit(300))), 300),
    ("STRCONV", lambda f, c: f(f(F.lit("héj"), 13), 14), "héj"),
    ("TEXTMERGE", lambda f, c: f("n is <<n>>", n=c.n), "n is -7"),
    ("MOD", lambda f, c: f(c.n, 3), 2),
    ("MOD", lambda f, c: f(c.n, -3), -1),
    ("INT", lambda f, c: f(F.lit(-1.9)), -1),
    ("ROUND", lambda f, c: float(1.01) and f(c.x, 2).cast("double"), 1.01),
    ("BITSET", lambda f, c: f(F.lit(0), 3), 8),
    ("BITTEST", lambda f, c: f(F.lit(8), 3), True),
    ("BITCLEAR", lambda f, c: f(F.lit(15), 0), 14),
    ("GOMONTH", lambda f, c: f(F.lit("2024-01-31").cast("date"), 1).cast("string"), "2024-02-29"),
    ("DOW", lambda f, c: f(F.lit("2024-01-07").cast("date")), 1),
    ("DOW", lambda f, c: f(F.lit("2024-01-07").cast("date"), 2), 7),
    ("QUARTER", lambda f, c: f(F.lit("2024-03-07").cast("date"), 4), 4),
    ("CTOD", lambda f, c: f(F.lit("13/45/2024")).isNull(), True),
    ("EMPTY", lambda f, c: f(c.e, T.StringType()), True),
    ("EMPTY", lambda f, c: f(c.n, T.IntegerType()), False),
    ("EVL", lambda f, c: f(c.e, "x", T.StringType()), "x"),
    ("ICASE", lambda f, c: f(c.n > 0, "pos", c.n < 0, "neg"), "neg"),
    ("VARTYPE", lambda f, c: f(c.s), "C"),
    ("VARTYPE", lambda f, c: f(c.n), "N"),
    ("ADEL", lambda f, c: f(c.a, 1), [1, 2]),
    ("AINS", lambda f, c: f(c.a, 2, 9), [3, 9, 1, 2]),
    ("ASCAN", lambda f, c: f(c.a, 2), 3),
    ("ACOPY", lambda f, c: f(c.a, F.array(F.lit(7), F.lit(8), F.lit(9)), 1, 2, 2), [7, 3, 1]),
    ("JUSTSTEM", lambda f, c: f(F.lit("c:\\d\\a.b.txt")), "a.b"),
    ("JUSTPATH", lambda f, c: f(F.lit("c:\\d\\a.txt")), "c:\\d"),
    ("FORCEEXT", lambda f, c: f(F.lit("d.x/a"), "txt"), "d.x/a.txt"),
    ("ADDBS", lambda f, c: f(F.lit("c:\\d")), "c:\\d\\"),
    ("CPCONVERT", lambda f, c: f("cp437", "cp1252", F.lit("\x82".encode("latin-1").decode("cp1252"))), "é"),
]


@pytest.mark.parametrize(("name", "call", "want"), CASES, ids=[f"{n}-{i}" for i, (n, *_) in enumerate(CASES)])
def test_function(spark, name, call, want):
    df = spark.createDataFrame([ROW], "s string, e string, n int, x double, a array<int>")
    assert df.select(call(FUNCTIONS[name], df).alias("r")).first().r == want


def test_code_pages():
    assert codepages.decode(b"\xb0\xa1", 0x7A) == "啊"
    assert codepages.decode(b"\xff\xff", 0x7A) == "ÿÿ"
    assert [codepages.content_code_page(b) for b in (b"abc", b"\xb0\xa1", b"\xff")] == [1252, 936, 1252]
