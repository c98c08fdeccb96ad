"""Rules for messages, literals, clauses and names."""

import pytest
from pyspark.sql import functions as F

from granary.operators import members as mb
from granary.operators import messages as ms
from granary.operators import transfer as tr


@pytest.mark.parametrize(("text", "want"), [("2^6", 7), ("20*08", 6), ("(1+2)*3", 6), ("-5", 9), ("-5+1", 5), ("2*-3", 6), ("7", 9)])
def test_precedence(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(ms.precedence_of(F.col("s")).alias("p")).first().p == want


@pytest.mark.parametrize(("spec", "want"), [("2", (2, 2)), ("1-3", (1, 3)), ("M1-2", (1, 2)), ("?", None), ("", None), (None, None)])
def test_arity(spark, spec, want):
    a = spark.createDataFrame([(spec,)], "s string").select(ms.arity(F.col("s")).alias("a")).first().a
    assert (a and tuple(a)) == want


@pytest.mark.parametrize(("value", "want"), [(0, ("int8", 1)), (255, ("int8", 3)), (256, ("int16", 3)), (-1, ("int16", 2)), (-32768, ("int32", 6)), (40000, ("int32", 5))])
def test_integer_codes(spark, value, want):
    assert tuple(spark.createDataFrame([(value,)], "v int").select(ms.integer_code(F.col("v")).alias("c")).first().c) == want


def test_spelling_follows_source_order(spark):
    rows = [[(2, "null", "NULL", None), (1, "type", "INT", ["null"]), (3, "def", "DEFAULT 1", None), (4, "def", "DEFAULT 2", None)]]
    df = spark.createDataFrame([(r,) for r in rows], "c array<struct<ord:int,key:string,word:string,supersedes:array<string>>>")
    assert df.select(ms.spell(F.col("c")).alias("s")).first().s == "INT DEFAULT 1"


def test_names_and_startup(spark):
    df = spark.createDataFrame([(1, "dir\\Main.FXP", bytearray(b"\0\0\0\0x")), (2, "a/b.fxp", bytearray(b"\1\0\0\0x")), (3, "", bytearray(b""))], "`order` int, name string, payload binary").withColumn("kind", F.lit("compiled_without_module_magic"))
    assert mb.startup(df).first().startup == "dir\\Main.FXP"
    got = [r.m for r in mb.manifest(df.withColumn("file", F.lit("f"))).select(F.coalesce("landed", "miss").alias("m")).collect()]
    assert got == ["Main.prg", "b.prg", "empty name"]
    assert df.where("order = 1").select(mb.record_folder(F.lit(7), F.lit("a b")).alias("r")).first().r == "record_0007_a_b"


def test_generated_project(spark):
    have = spark.createDataFrame([("main.prg", "P", "MAIN")], "filename string, type string, key string")
    found = spark.createDataFrame([("MAIN.PRG", "P", "MAIN"), ("form.scx", "K", "FORM"), ("util.prg", "P", "UTIL")], have.schema)
    got = sorted((r.filename, r.main) for r in mb.generated_project(have, found, "main").collect())
    assert got == [("form.scx", False), ("main.prg", True)]


def test_list_tree(spark, tmp_path):
    for n in ("b.scx", "a.prg", "c.bin"):
        (tmp_path / n).write_bytes(b"x")
    got = mb.list_tree(spark, str(tmp_path), {"prg": "P", "scx": "K"}).collect()
    assert [(r.filename, r.type, r.key) for r in got] == [("a.prg", "P", "A"), ("b.scx", "K", "B")]


def test_copy_types(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    for kind in ("csv", "tab", "json", "parquet"):
        tr.copy_to(df, str(tmp_path / kind), kind)
        assert sorted(r.k for r in tr.read_from(spark, str(tmp_path / kind), kind, df.schema).collect()) == [1, 2]
    tr.copy_to(df, str(tmp_path / "sdf"), "sdf")
    assert sorted(len(r.value) for r in spark.read.text(str(tmp_path / "sdf")).collect()) == [32, 32]
    with pytest.raises(ValueError, match="xls"):
        tr.copy_to(df, str(tmp_path / "x"), "xls")
    assert tr.restore_variables(tr.save_variables({"abc": 1, "x": 2}, "a*"), {"y": 3}) == {"abc": 1, "y": 3}
