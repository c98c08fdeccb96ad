"""The operators' exact semantics on small fixtures."""

import pytest
from pyspark.sql import functions as F

from granary.operators import cache, dialect, ordering
from granary.operators import commands as cmd
from granary.operators import scorecard as sc
from granary.operators import sequence as sq
from granary.operators.workarea import STATE, WorkAreas


def test_axis_aggregate_counts_missing_and_repeats(spark):
    rows = spark.createDataFrame([(["a", "a", "b"], True, 1, 2), ([None, "", "?"], True, 1, 1), (["b"], None, None, 5)], "axis array<string>, yes boolean, num int, den int")
    got = {r.value: r for r in sc.axis_aggregate(rows, {"x": sc.axis_values(F.col("axis"), True)}, {"yes": F.col("yes")}, {"d": (F.col("num"), F.col("den"))}).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].records, got["a"].yes, got["b"].records, got["b"].yes) == (2, 2, 2, 1)  # a repeated value counts again
    assert (int(got["b"].d_num), int(got["b"].d_den)) == (1, 2)  # a null delta counts as (0, 0)
    assert {(r.missing, r.total) for r in got.values()} == {(1, 3)}


def test_rate_of_nothing_is_zero(spark):
    assert spark.range(1).select(sc.rate(F.lit(3), F.lit(0)).alias("r")).first().r == 0.0


@pytest.mark.parametrize(("value", "want"), [("ab12", "ab12"), ("ab", None), ("cd", "cd99"), ("", None), (None, None), ("ab1", None), ("ab123", "ab123")])
def test_exclusions_by_unique_prefix(spark, value, want):
    df = spark.createDataFrame([(value,)], "id string")
    assert sc.partition_excluded(df, "id", ["ab12", "ab123", "cd99"]).first().excluded_by == want


@pytest.mark.parametrize(
    ("canonical", "fail", "want"),
    [(True, "lift", "canonical_pass"), (False, "0 non-empty sections x", "no_code_sections"), (None, "lift: a", "lift_unsupported"), (False, "emit-compile", "compile_failed"), (False, "canonical: b", "canonical_mismatch"), (False, "3 non-empty sections", "method_directory"), (False, "unparsed", "unparsed"), (False, "record not found", "record_not_found"), (False, "x" * 50 + ": y", "other:" + "x" * 40), (False, None, "no_verdict")],
)
def test_outcomes(spark, canonical, fail, want):
    df = spark.createDataFrame([(canonical, fail)], "c boolean, f string")
    assert df.select(sc.outcome_bucket(F.col("c"), F.col("f")).alias("b")).first().b == want


def test_ranking_ties_and_order(spark):
    rows = spark.createDataFrame([(1, ["x", "y"], "r2"), (2, ["x"], "r1"), (3, ["y"], "r1"), (4, [], "r1")], "id int, b array<string>, repo string")
    got = [tuple(r) for r in sc.blocker_ranking(rows, "id", "b", "repo").collect()]
    assert got == [("x", 2, 1, 1, 2, "r1", 1), ("y", 2, 1, 1, 2, "r1", 1)]
    assert [tuple(r) for r in sc.blocker_pairs(rows, "b").collect()] == [("x", "y", 1)]


def test_sampling_is_repeatable():
    assert sc.deterministic_sample([3, 1, 2], 2) == sc.deterministic_sample([2, 3, 1], 2)
    assert sc.deterministic_sample([1], 5) == ["1"]


def test_drift_verdicts(spark):
    a, b = spark.range(10), spark.range(1, 11)
    assert sc.drift(a, a, "id", 4).first().verdict == "reproducible"
    assert sc.drift(a, b, "id", 4).first().verdict == "stale"


def sections(*frames):
    return [{"frames": list(f), "symbols": ["S"]} for f in frames]


KIND = "array<struct<frames:array<string>,symbols:array<string>>>"


@pytest.mark.parametrize(
    ("left", "right", "matched", "bijective"),
    [
        (sections("a", "b"), sections("a", "b"), True, True),
        (sections("a", "b"), sections("a", "x", "b"), True, False),
        (sections("a", "b"), sections("b", "a"), False, False),
        (sections("", "a"), sections("a", ""), True, True),
        (sections(""), sections("a"), False, False),
        (sections("a"), [{"frames": ["a"], "symbols": ["s"]}], True, True),  # symbols without regard to case
    ],
)
def test_ordered_match_and_bijection(spark, left, right, matched, bijective):
    df = spark.createDataFrame([(left, right)], f"l {KIND}, r {KIND}")
    r = df.select(sq.ordered_match(F.col("l"), F.col("r")).alias("m"), sq.bijection(F.col("l"), F.col("r")).alias("b")).first()
    assert (r.m, r.b) == (matched, bijective)


@pytest.mark.parametrize(("a", "b", "want"), [(b"abc", b"abc", []), (b"abcd", b"axxd", [(1, 3)]), (b"ab", b"axyz", [(1, 2), (2, 4)]), (b"", b"x", [(0, 1)])])
def test_changed_ranges_keep_the_tail_apart(spark, a, b, want):
    assert sq.byte_ranges(a, b) == want
    rows = [(0, i, chr(a[i]) if i < len(a) else None, chr(b[i]) if i < len(b) else None) for i in range(max(len(a), len(b)))]
    df = spark.createDataFrame(rows, "g int, p long, x string, y string")
    assert sorted((r.start, r.end) for r in sq.changed_ranges(df, "g", "p", "x", "y").collect()) == want


def test_first_difference(spark):
    df = spark.createDataFrame([(sections("ab"), sections("ax"))], f"l {KIND}, r {KIND}")
    assert df.select(sq.first_difference(F.col("l")[0], F.col("r")[0]).alias("d")).first().d == "frame 1"


def test_recno_is_dense_over_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.col("id").cast("string").alias("s"))
    got = {r.k: r["_recno"] for r in ordering.with_recno(df, "k").collect()}
    assert got == {k: k + 1 for k in range(1000)}
    by_text = [r["_recno"] for r in ordering.with_recno(df, "s").orderBy("s").collect()]
    assert by_text == list(range(1, 1001))


def test_total_on_groups_runs_only(spark):
    t = cmd.as_table(spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 5), (4, "a", 7)], "k int, g string, v int"), "k")
    assert [(r.g, int(r.v)) for r in cmd.total_on(t, "g", ["v"]).orderBy("_recno").collect()] == [("a", 3), ("b", 5), ("a", 7)]


def test_while_stops_at_null_and_skip_past_the_end(spark):
    t = cmd.as_table(spark.createDataFrame([(1, 1), (2, None), (3, 1)], "k int, v int"), "k")
    assert cmd.while_prefix(t, F.col("v") == 1).count() == 1
    assert cmd.skip(t, 2, 5).count() == 0
    assert cmd.skip(t, 2, -1).first().k == 1


def test_soft_delete_and_pack(spark):
    t = cmd.as_table(spark.range(5).withColumnRenamed("id", "k"), "k")
    t = cmd.recall(cmd.delete(t, F.col("k") < 3), F.col("k") == 1)
    assert [(r["_recno"], r.k) for r in cmd.pack(t).orderBy("_recno").collect()] == [(1, 1), (2, 3), (3, 4)]
    assert cmd.visible(t, False).count() == 5


def test_work_areas(spark):
    w = WorkAreas(spark)
    w.use(spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "b")], "k int, s string"), "t_area", "k")
    assert w.locate(F.col("s").startswith("ab")) and w.area.at == 1
    assert w.resume() and w.area.at == 2
    assert not w.resume()
    assert w.count(w.equal(F.col("s"), "ab")) == 1
    w.set("exact", False)
    assert w.count(w.equal(F.col("s"), "ab")) == 2
    assert w.go("bottom") and w.area.at == 3 and not w.skip()
    w.set("near", True)
    assert not w.seek("s", "aa") and w.area.at == 1
    with pytest.raises(KeyError):
        w.select("missing")
    w.close()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT TOP 3 a FROM t", "SELECT a FROM t LIMIT 3"),
        ("SELECT a FROM t WHERE x == 'ANY # \"' .AND. y # .T.", "SELECT a FROM t WHERE x = 'ANY # \"' AND y <> true"),
        ("SELECT a FROM t WHERE f(x) $ t.y", "SELECT a FROM t WHERE contains(t.y, f(x))"),
        ('SELECT "it" FROM t INTO CURSOR c READWRITE', "SELECT 'it' FROM t"),
        ("SELECT a FROM t WHERE b = ANY (SELECT c FROM u)", "SELECT a FROM t WHERE b IN (SELECT c FROM u)"),
    ],
)
def test_dialect(text, want):
    assert dialect.translate(text).sql == want


def test_quantifiers_over_nothing_and_null(spark):
    spark.createDataFrame([(1,), (5,)], "x int").createOrReplaceTempView("q_t")
    spark.createDataFrame([(2,), (None,)], "v int").createOrReplaceTempView("q_u")
    n = lambda s: dialect.select(spark, s).count()
    assert n("SELECT x FROM q_t WHERE x > ALL (SELECT v FROM q_u WHERE v > 100)") == 2
    assert n("SELECT x FROM q_t WHERE x > ANY (SELECT v FROM q_u WHERE v > 100)") == 0
    assert n("SELECT x FROM q_t WHERE x > ALL (SELECT v FROM q_u)") == 0
    assert n("SELECT x FROM q_t WHERE x > ANY (SELECT v FROM q_u)") == 1


def test_cache(spark):
    df = spark.createDataFrame([("a", "x = 1"), ("b", "x = 1"), ("c", "#include y")], "name string, source string")
    keyed = cache.with_key(df, "s", "i", "m", F.col("name"), F.col("source"))
    assert keyed.select("key").distinct().count() == 3
    key = keyed.where("name = 'a'").first().key
    stored = spark.createDataFrame([(key, "i", 2, bytearray(b"ok"), None), (key, "other", 2, bytearray(b"ok"), None), ("z", "i", 9, bytearray(b"cut"), None)], "key string, identity string, length int, payload binary, error string")
    assert cache.usable(stored, "i").count() == 1
    assert {r.name for r in cache.misses(keyed, stored, "i").collect()} == {"b", "c"}
    assert tuple(cache.receipt(keyed, stored, "i").first()) == (3, 1, 2)
    assert keyed.where(cache.cacheable(F.col("source"))).count() == 2


@pytest.mark.parametrize(
    ("content", "name", "want"),
    [(b"", "a.fxp", "empty"), (b"\xfe\xf2\xee1", "", "encrypted"), (b"\xfe\xf2\xff\x20", "", "standalone_module_magic"), (b"xx", "a.FXP", "compiled_without_module_magic"), (b"xx", "a.fpt", "memo_sidecar"), (b"BMx", "", "bmp"), (b"0abc", "", "dbf_header"), (b"hi\r\n", "", "text"), (b"\xfc\x01", "", "compiled_section_no_magic"), (b"\x01", "", "other")],
)
def test_payload_kinds(spark, content, name, want):
    df = spark.createDataFrame([(bytearray(content), name)], "c binary, n string")
    assert df.select(sq.payload_kind(F.col("c"), F.col("n")).alias("k")).first().k == want


def test_areas_tell_their_state(spark):
    w = WorkAreas(spark)
    w.use(spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "b")], "k int, s string"), "state_area", "k")
    says = lambda name, *args: STATE[name](w, *args)
    assert (says("RECNO"), says("RECCOUNT"), says("FCOUNT"), says("FIELD", 2), says("FIELD", 3), says("ALIAS"), says("USED", "x")) == (1, 3, 2, "S", "", "STATE_AREA", False)
    assert says("SEEK", "s", "b") and says("FOUND") and says("RECNO") == 3 and not says("EOF")
    assert not w.skip() and says("EOF") and says("RECNO") == 4
    assert w.go("top") and not says("EOF") and not w.skip(-1) and says("BOF") and says("RECNO") == 1
    assert says("LOOKUP", "s", 2, "k") == "abc" and says("RECNO") == 2
    assert says("LOOKUP", "s", 9, "k") == "" and says("EOF")
    assert says("INDEXSEEK", "k", 1) and says("RECNO") == 4
    w.index_on("byS", F.col("s"))
    assert (says("ORDER"), says("TAG", 1), says("TAGCOUNT"), says("SET", "deleted")) == ("BYS", "BYS", 1, False)


def test_ranking_counts_a_record_of_two_repositories_once(spark):
    df = spark.createDataFrame([(1, ["x"], ["r", "s"]), (2, ["x", "y"], ["s"]), (3, ["x"], None)], "id int, b array<string>, repo array<string>")
    got = [tuple(r) for r in sc.blocker_ranking(df, "id", "b", "repo").collect()]
    assert got == [("x", 3, 2, 1, 2, "s", 2), ("y", 1, 0, 1, 1, "s", 1)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT 2 ^ 3 AS x", [8.0]),
        ("SELECT 2 ^ 3 ^ 2 AS x", [64.0]),
        ("SELECT 2 ** (1 + 1) * 3 AS x", [12.0]),
        ("SELECT -2 ^ 2 AS x", [-4.0]),
        ("SELECT 2 ^ -1 AS x", [0.5]),
        ("SELECT 'a' + 'b' + \"c\" AS x", ["abc"]),
        ("SELECT 'a ' - 'b' AS x", ["ab "]),
        ("SELECT [it's] AS x", ["it's"]),
        ("SELECT 1 + 2 AS x", [3]),
        ("SELECT 5 - 2 AS x", [3]),
        ("SELECT array(1, 2)[1] AS x", [2]),
        ("SELECT TOP 1 1 AS x UNION ALL SELECT 2 UNION ALL SELECT 3 ORDER BY 1 DESC", [3, 2, 1]),
        ("SELECT TOP 50 PERCENT x FROM (VALUES (1), (2), (3)) t(x) ORDER BY x", [1, 2]),
        ("SELECT x FROM (VALUES (1), (2), (null)) t(x) WHERE x NOT IN (SELECT 2)", [1]),
        ("SELECT x FROM (VALUES (1), (2)) t(x) WHERE x NOT IN (SELECT y FROM (VALUES (2), (null)) u(y))", []),
        ("SELECT x FROM (VALUES (1), (null)) t(x) WHERE x NOT IN (SELECT y FROM (VALUES (1)) u(y) WHERE y > 1) ORDER BY x", [None, 1]),
    ],
)
def test_dialect(spark, text, want):
    from granary.operators.dialect import select

    assert [r.x for r in select(spark, text).collect()] == want


def test_not_in_broadcasts_nothing_that_grows(spark):
    from granary.operators.dialect import translate

    spark.range(100).createOrReplaceTempView("big_")
    plan = spark.sql(translate("SELECT id FROM big_ WHERE id NOT IN (SELECT id FROM big_ WHERE id > 3)").sql)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "isnull" not in plan.split("LeftAnti")[1].split("\n")[0]


def test_scorecard_reads_its_input_once(spark, sf_dir):
    from granary.plans.scorecards import axis_scorecard

    plan = axis_scorecard(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") == 1 or plan.count("lineitem") <= 2


def test_first_of_each_key_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "b"), (1, 5, "a"), (None, 2, "c"), (None, 1, "d"), (2, 3, "e")], "k int, o int, v string")
    assert {(r.k, r.v) for r in cmd.first_by(df, "k", "o").collect()} == {(1, "b"), (None, "d"), (2, "e")}


def test_rendering_says_what_it_leaves_out(spark):
    text = sc.render(spark.range(5), 3)
    assert text.count("\n") == 5 and "first 3 rows" in text
