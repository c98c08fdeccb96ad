"""Order at size: what is right over many buckets, and what a plan or a build costs."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from granary.operators import commands as cmd
from granary.operators import ordering


def jobs_of(spark, build):
    """How many jobs run while `build` makes its DataFrame."""
    group = f"build-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture
def wide(spark):
    """As many shuffle partitions as a cluster has."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_total_on_is_built_without_a_job(spark):
    t = spark.range(1, 100).select(F.col("id").alias("_recno"), (F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    assert jobs_of(spark, lambda: cmd.total_on(t, "g", ["v"])) == 0


@pytest.mark.parametrize("seed", range(3))
def test_runs_across_buckets(spark, monkeypatch, seed):
    monkeypatch.setattr(ordering, "SPAN_BITS", 2)
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]) if rng.random() < 0.3 else "a", rng.randrange(9)) for i in sorted(rng.sample(range(1, 400), 150))]
    want = [(r[0][0], k, sum(x[2] for x in r)) for k, r in ((k, list(g)) for k, g in groupby(rows, key=lambda x: x[1]))]
    got = cmd.total_on(spark.createDataFrame(rows, "_recno long, g string, v int").repartition(5), "g", ["v"])
    assert sorted((r["_recno"], r.g, int(r.v)) for r in got.collect()) == want
    assert dict(got.dtypes)["v"] == "decimal(28,4)"


def test_total_on_of_nothing(spark):
    t = spark.createDataFrame([], "_recno long, g string, v int")
    assert cmd.total_on(t, "g", ["v"]).count() == 0


def test_skip_is_built_without_a_job_and_counts_what_is_shown(spark):
    t = spark.range(1, 31).select(F.col("id").alias("_recno"), (F.col("id") % 3).alias("g"))
    shown = t.where("g = 0")
    assert jobs_of(spark, lambda: cmd.skip(shown, 3, 2)) == 0
    at = lambda n: [r["_recno"] for r in cmd.skip(shown, 6, n).collect()]
    assert [at(n) for n in (1, 8, 9, -1, -2, 0)] == [[9], [30], [], [3], [], [6]]
    assert cmd.skip(shown, 6, 1).columns == t.columns


def test_plans_hold_no_expression_for_each_bucket(wide):
    t = cmd.as_table(wide.range(5000).select((F.col("id") * 7 % 5000).alias("k"), F.lit("x").alias("s")), "k")
    changed = cmd.scan(t, {"s": F.lit("y")}, F.col("k") % 2 == 0, F.col("k") < 4000)
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(">=") <= 8 and plan.count("CASE WHEN") <= 8  # a few for each use of the table, not hundreds
    got = sorted((r["_recno"], r.k, r.s) for r in changed.collect())
    assert got == [(k + 1, k, "y" if k % 2 == 0 and k < 4000 else "x") for k in range(5000)]


@pytest.mark.parametrize("kind", ["int", "string", "double", "decimal(9,2)", "timestamp", "date"])
def test_places_of_keys_of_any_kind(wide, kind):
    n = F.col("id") * 37 % 300
    key = {"timestamp": F.timestamp_seconds(n * 5000), "date": F.date_add(F.lit("2024-01-01"), n.cast("int"))}.get(kind, n.cast(kind))
    df = wide.range(300).select(n.alias("n"), F.when(n > 0, key).alias("k"))
    got = ordering.with_recno(df, "k").select("_recno", "n", "k").collect()
    want = sorted(((r.n, r.k) for r in got), key=lambda r: (r[1] is not None, r[1]) if r[1] is not None else (False,))
    assert [n for n, _ in want] == [r.n for r in sorted(got, key=lambda r: r["_recno"])]
    assert sorted(r["_recno"] for r in got) == list(range(1, 301))


def test_runs_sums_and_neighbours_over_many_buckets(wide):
    df = wide.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.expr("cast(id div 7 as string)")).alias("v"))
    rows = {r.k: r for r in ordering.with_previous(df, "v", "k", "b").collect()}
    assert rows[0].b is None and all(rows[k].b == rows[k - 1].v for k in range(1, 500))
    sums = {r.k: r.s for r in ordering.running_sum(df, F.col("k"), "k", "s").collect()}
    assert sums == {k: k * (k + 1) // 2 for k in range(500)}
    runs = [r.n for r in ordering.groups_of_runs(df, "v", "k", "n").orderBy("k").collect()]
    want, n = [], 0
    for k in range(500):
        n += k == 0 and rows[k].v is not None or k > 0 and rows[k].v != rows[k - 1].v
        want.append(n)
    assert runs == want


def test_order_of_nothing(wide):
    assert ordering.with_recno(wide.createDataFrame([], "k int"), "k").count() == 0


def test_movements_search_once_and_share_a_shuffle(wide):
    t = cmd.as_table(wide.range(1000).withColumnRenamed("id", "k"), "k")
    steps = cmd.go(t, "bottom").unionByName(cmd.skip(t, 10, 5)).unionByName(cmd.skip(t, 10, -2))
    assert "isnotnull(aggregate" not in steps._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["_recno"] for r in steps.collect()) == [8, 15, 1000]
    plan = steps._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 1
