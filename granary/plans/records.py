"""Record commands over the supplied tables; a record's number is its place in key order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import commands as cmd
from granary.operators.ordering import RECNO
from granary.plans.base import Catalogue, load
from granary.session import shared_dir

C = Catalogue()


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmd.as_table(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderkey")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmd.as_table(load(spark, sf_dir, "customer"), "c_custkey")


O = "(SELECT row_number() OVER (ORDER BY o_orderkey) AS _recno, false AS _deleted, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)"
CU = "(SELECT row_number() OVER (ORDER BY c_custkey) AS _recno, false AS _deleted, * FROM customer)"


@C.add(f"SELECT * FROM {O} WHERE _recno >= 100 AND _recno < 150")
def scope_next(spark, sf_dir):
    return cmd.scope_next(orders(spark, sf_dir), 50, at=100)


@C.add(f"SELECT * FROM {O} WHERE _recno >= 900")
def scope_rest(spark, sf_dir):
    return cmd.scope_rest(orders(spark, sf_dir), 900)


@C.add(f"SELECT * FROM {O} WHERE _recno = 77")
def scope_record(spark, sf_dir):
    return cmd.scope_record(orders(spark, sf_dir), 77)


@C.add(f"SELECT * FROM {O} o WHERE _recno < (SELECT min(_recno) FROM {O} WHERE NOT o_totalprice < 200000)")
def while_prefix(spark, sf_dir):
    return cmd.while_prefix(orders(spark, sf_dir), F.col("o_totalprice") < 200000)


@C.add(f"SELECT * FROM {O} WHERE o_orderstatus = 'F'")
def set_filter(spark, sf_dir):
    from granary.operators.workarea import WorkAreas

    w = WorkAreas(spark)
    w.use(orders(spark, sf_dir), "orders_area")
    w.set_filter(F.col("o_orderstatus") == "F")
    return w.view()


@C.add(f"SELECT * FROM {O} WHERE o_custkey BETWEEN 10 AND 40")
def set_key(spark, sf_dir):
    return cmd.set_key(orders(spark, sf_dir), "o_custkey", 10, 40)


@C.add(f"SELECT _recno, o_orderkey FROM {O} WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (ORDER BY _recno) <= 2")
def locate_continue(spark, sf_dir):
    t, cond = orders(spark, sf_dir), F.col("o_orderstatus") == "F"
    first = cmd.locate(t, cond)
    at = first.select(RECNO).first()
    second = cmd.locate(t, cond, at[0] if at else 0)
    return first.unionByName(second).select(RECNO, "o_orderkey")


@C.add(f"SELECT * FROM {O} WHERE o_custkey = 7 ORDER BY _recno LIMIT 1")
def seek_exact(spark, sf_dir):
    return cmd.seek(orders(spark, sf_dir), "o_custkey", 7)


@C.add(f"SELECT * FROM {O} WHERE o_totalprice >= 123456.5 ORDER BY o_totalprice, _recno LIMIT 1")
def seek_near(spark, sf_dir):
    return cmd.seek(orders(spark, sf_dir), "o_totalprice", 123456.5, near=True)


@C.add(f"SELECT 'top' AS step, min(_recno) AS _recno FROM {O} UNION ALL SELECT 'bottom', max(_recno) FROM {O} UNION ALL SELECT 'skip', 15 UNION ALL SELECT 'back', 8")
def go_skip(spark, sf_dir):
    t = orders(spark, sf_dir)
    steps = {"top": cmd.go(t, "top"), "bottom": cmd.go(t, "bottom"), "skip": cmd.skip(t, 10, 5), "back": cmd.skip(t, 10, -2)}
    out = None
    for name, df in steps.items():
        row = df.select(F.lit(name).alias("step"), RECNO)
        out = row if out is None else out.unionByName(row)
    return out


@C.add(f"SELECT _recno, c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS c_mktsegment FROM {CU}")
def replace_for(spark, sf_dir):
    t = cmd.replace(customers(spark, sf_dir), {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("DEBTOR")}, F.col("c_acctbal") < 0)
    return t.select(RECNO, "c_custkey", "c_acctbal", "c_mktsegment")


@C.add("SELECT c_custkey, CASE WHEN n_regionkey = 2 THEN n_name ELSE c_name END AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def update_from(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return cmd.update_from(load(spark, sf_dir, "customer"), nation, "c_nationkey", {"c_name": F.col("n_name")}, F.col("n_regionkey") == 2).select("c_custkey", "c_name")


@C.add(f"SELECT row_number() OVER (ORDER BY _recno) AS _recno, c_custkey FROM {CU} WHERE NOT (c_acctbal < 0 AND NOT c_nationkey = 3)")
def delete_recall_pack(spark, sf_dir):
    t = cmd.delete(customers(spark, sf_dir), F.col("c_acctbal") < 0)
    t = cmd.recall(t, F.col("c_nationkey") == 3)
    return cmd.pack(t).select(RECNO, "c_custkey")


@C.add(f"SELECT c_mktsegment, count(*) AS n FROM {CU} WHERE NOT c_acctbal < 0 GROUP BY 1")
def set_deleted(spark, sf_dir):
    return cmd.visible(cmd.delete(customers(spark, sf_dir), F.col("c_acctbal") < 0)).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT count(*) AS n FROM customer WHERE false")
def zap(spark, sf_dir):
    return cmd.zap(customers(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN '' ELSE c_name END AS c_name, CASE WHEN c_nationkey = 4 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def blank_fields(spark, sf_dir):
    return cmd.blank(load(spark, sf_dir, "customer"), ["c_name", "c_acctbal"], F.col("c_nationkey") == 4).select("c_custkey", "c_name", "c_acctbal")


@C.add("SELECT p_partkey, p_name, p_size + 1 AS p_size FROM part")
def scatter_gather(spark, sf_dir):
    t = cmd.scatter(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), ["p_name", "p_size"])
    t = t.withColumn("_memvars", F.array(F.get("_memvars", F.lit(0)), (F.get("_memvars", F.lit(1)).cast("int") + 1).cast("string")))
    return cmd.gather(t, ["p_name", "p_size"]).select("p_partkey", "p_name", "p_size")


@C.add("SELECT * FROM (VALUES (1::INTEGER, 'p_partkey'), (2, 'p_name'), (3, 'p_brand'), (4, 'p_type'), (5, 'p_size'), (6, 'p_retailprice')) t(field_no, field_name)")
def copy_structure(spark, sf_dir):
    return cmd.structure(load(spark, sf_dir, "part")).select("field_no", "field_name")


@C.add("SELECT p_partkey, p_type FROM part")
def copy_fields_like(spark, sf_dir):
    return cmd.fields(load(spark, sf_dir, "part"), like="P_PART*,p_?ype,p_name", but="*name")


@C.add("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'ATLANTIS' UNION ALL SELECT 91, ''")
def insert_values(spark, sf_dir):
    t = cmd.insert_values(load(spark, sf_dir, "region"), [(90, "ATLANTIS")], ["r_regionkey", "r_name"])
    return cmd.insert_values(t, [(91,)], ["r_regionkey"])


@C.add("SELECT n_name, n_regionkey FROM nation UNION ALL SELECT s_name, NULL FROM supplier WHERE s_acctbal > 5000")
def append_from(spark, sf_dir):
    other = load(spark, sf_dir, "supplier").withColumnRenamed("s_name", "n_name")
    return cmd.append_from(load(spark, sf_dir, "nation").select("n_name", "n_regionkey"), other, F.col("s_acctbal") > 5000)


@C.add("SELECT avg(l_quantity) AS avg, count(*) AS cnt, max(l_quantity) AS max, min(l_quantity) AS min, cast(sum(cast(l_quantity AS decimal(18,4))) AS double) AS sum, stddev_pop(l_quantity) AS std, var_pop(l_quantity) AS var FROM lineitem WHERE l_returnflag = 'R'")
def calculate_all(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    out = cmd.calculate(rows, "l_quantity")
    return out.select(*[F.round(F.col(c).cast("decimal(28,10)"), 6).cast("double").alias(c) if c in ("avg", "std", "var") else c for c in out.columns])


C.sql["calculate_all"] = "SELECT cast(round(cast(avg AS decimal(28,10)), 6) AS double) AS avg, cnt, max, min, sum, cast(round(cast(std AS decimal(28,10)), 6) AS double) AS std, cast(round(cast(var AS decimal(28,10)), 6) AS double) AS var FROM (" + C.sql["calculate_all"] + ")"


@C.add(f"SELECT cast(round(cast(sum(o_totalprice / power(1.01, _recno)) AS decimal(28,10)), 2) AS double) AS npv FROM {O}")
def calculate_npv(spark, sf_dir):
    out = cmd.calculate(orders(spark, sf_dir), "o_totalprice", rate=0.01)
    return out.select(F.round(F.col("npv").cast("decimal(28,10)"), 2).cast("double").alias("npv"))


@C.add("SELECT cast(sum(cast(o_totalprice AS decimal(18,4))) AS double) AS total FROM orders WHERE o_orderstatus = 'P'")
def sum_for(spark, sf_dir):
    return cmd.sum_to(load(spark, sf_dir, "orders"), F.col("o_totalprice"), mask=F.col("o_orderstatus") == "P").select(F.col("v1").alias("total"))


@C.add("SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS n FROM orders")
def count_for(spark, sf_dir):
    return cmd.count_to(load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P").select(F.col("v1").alias("n"))


@C.add()
def average_for(spark, sf_dir):
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").agg(F.round(F.avg(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("mean"))


C.sql["average_for"] = "SELECT cast(round(cast(cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) / count(*) AS decimal(28,10)), 2) AS double) AS mean FROM orders WHERE o_orderstatus = 'P'"


@C.add(f"""
WITH t AS (SELECT *, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER (ORDER BY _recno) THEN 1 ELSE 0 END AS changed FROM {O}),
     g AS (SELECT *, sum(changed) OVER (ORDER BY _recno) AS run FROM t)
SELECT min(_recno) AS _recno, min(o_orderstatus) AS o_orderstatus, cast(sum(cast(o_totalprice AS decimal(18,4))) AS double) AS o_totalprice FROM g GROUP BY run""")
def total_on(spark, sf_dir):
    return cmd.total_on(orders(spark, sf_dir), "o_orderstatus", ["o_totalprice"]).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@C.add("SELECT p_partkey, p_brand, p_size FROM part")
def sort_fields(spark, sf_dir):
    return cmd.sort_to(load(spark, sf_dir, "part"), shared_dir(spark, "sorted"), F.col("p_brand"), F.desc("p_size"), F.col("p_partkey"), names=["p_partkey", "p_brand", "p_size"])


@C.add(f"SELECT _recno, o_custkey FROM {O} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY _recno) = 1")
def index_unique(spark, sf_dir):
    return cmd.index_on(orders(spark, sf_dir), F.col("o_custkey"), unique=True).select(RECNO, "o_custkey")


@C.add(f"SELECT _recno, o_totalprice FROM {O} WHERE o_totalprice > 250000")
def index_for(spark, sf_dir):
    return cmd.index_on(orders(spark, sf_dir), F.col("o_totalprice"), mask=F.col("o_totalprice") > 250000).select(RECNO, "o_totalprice")


@C.add("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey")
def relation_lookup(spark, sf_dir):
    child = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return cmd.set_relation(load(spark, sf_dir, "customer"), child, "c_custkey", "o_custkey", "o_orderkey").select("c_custkey", "o_orderkey")


@C.add("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def relation_one_to_many(spark, sf_dir):
    child = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return cmd.set_skip(load(spark, sf_dir, "customer"), child, "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@C.add("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 100 * n_regionkey")
def join_with(spark, sf_dir):
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    return cmd.join_with(s, n, (s.s_nationkey == n.n_nationkey) & (s.s_acctbal > 100 * n.n_regionkey), shared_dir(spark, "joined"), ["s_suppkey", "n_name"])


@C.add("SELECT c_custkey, coalesce(o_totalprice, 0) AS looked_up FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey")
def lookup_first(spark, sf_dir):
    found = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return cmd.lookup(load(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey"), found, "o_totalprice", "o_custkey", "o_orderkey")


@C.add(f"SELECT CASE WHEN _recno > 10 THEN _recno + 1 ELSE _recno END AS _recno, o_orderkey FROM {O} UNION ALL SELECT 11, 0")
def insert_blank(spark, sf_dir):
    return cmd.insert_record(orders(spark, sf_dir), 10).select(RECNO, "o_orderkey")


@C.add(f"SELECT _recno, o_orderkey FROM {O} UNION ALL SELECT count(*) + 1, 0 FROM orders")
def append_blank(spark, sf_dir):
    return cmd.append_blank(orders(spark, sf_dir)).select(RECNO, "o_orderkey")


@C.add(f"SELECT _recno, CASE WHEN o_orderstatus = 'F' AND _recno < coalesce((SELECT min(_recno) FROM {O} WHERE o_orderstatus = 'F' AND NOT o_totalprice < 400000), 1000000000) THEN 0 ELSE o_custkey END AS o_custkey FROM {O}")
def scan_while(spark, sf_dir):
    t = orders(spark, sf_dir)
    return cmd.scan(t, {"o_custkey": F.lit(0)}, F.col("o_orderstatus") == "F", F.col("o_totalprice") < 400000).select(RECNO, "o_custkey")
