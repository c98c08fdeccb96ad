"""The SELECT surface: joins, subqueries, quantifiers, grouping, order, unions."""

from __future__ import annotations

from granary.plans.base import Catalogue

C = Catalogue()
q = C.select

# one side is filtered first: no key is missing in the tables, so else outer joins couldn't be told from inner ones
EU = "SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 5"
URGENT = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"
q("join_inner", f"SELECT c.c_custkey, c.c_name, o.o_orderkey FROM ({EU}) c JOIN ({URGENT}) o ON c.c_custkey = o.o_custkey")
q("join_left", f"SELECT c.c_custkey, o.o_orderkey FROM ({EU}) c LEFT OUTER JOIN ({URGENT}) o ON c.c_custkey = o.o_custkey")
q("join_right", f"SELECT c.c_custkey, o.o_orderkey, o.o_custkey FROM ({EU}) c RIGHT OUTER JOIN ({URGENT}) o ON c.c_custkey = o.o_custkey")
q("join_full", f"SELECT c.c_custkey, o.o_orderkey, o.o_custkey FROM ({EU}) c FULL JOIN ({URGENT}) o ON c.c_custkey = o.o_custkey")
q("join_nested", "SELECT r.r_name, n.n_name, count(*) AS n_customers FROM region r JOIN (nation n JOIN customer c ON n.n_nationkey = c.c_nationkey) ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2")
q("join_comma", "SELECT n.n_name, s.s_name, s.s_acctbal FROM nation n, supplier s WHERE n.n_nationkey = s.s_nationkey AND s.s_acctbal > 0")
q("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
q("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
q("exists_subquery", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
q("not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '5-LOW')")
q("any_quantifier", "SELECT p_partkey, p_size FROM part WHERE p_retailprice > ANY (SELECT p_retailprice FROM part WHERE p_size = 50)")
q("all_quantifier", "SELECT p_partkey, p_size FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 50)")
q("all_quantifier_empty", "SELECT p_partkey FROM part WHERE p_retailprice < ALL (SELECT p_retailprice FROM part WHERE p_size < 0)")
q("some_quantifier_equal", "SELECT s_suppkey FROM supplier WHERE s_nationkey = SOME (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "SELECT s_suppkey FROM supplier WHERE s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
q("all_quantifier_unequal", "SELECT s_suppkey FROM supplier WHERE s_nationkey # ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "SELECT s_suppkey FROM supplier WHERE s_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
q("like_in_predicates", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' AND p_size IN (1, 5, 9) AND NOT p_brand == 'Brand#11'", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' AND p_size IN (1, 5, 9) AND NOT p_brand = 'Brand#11'")
q("contains_operator", "SELECT n_name FROM nation WHERE 'A' $ n_name .AND. .NOT. n_regionkey # 1", "SELECT n_name FROM nation WHERE contains(n_name, 'A') AND NOT n_regionkey <> 1")
q("arithmetic", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 2 + 1 AS twice, -l_linenumber AS neg, l_linenumber % 3 AS rest, l_linenumber ^ 2 AS squared, 2 ** l_linenumber ^ 2 AS raised, l_returnflag + '-' + l_linestatus AS joined FROM lineitem", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 2 + 1 AS twice, -l_linenumber AS neg, l_linenumber % 3 AS rest, power(l_linenumber, 2) AS squared, power(power(2, l_linenumber), 2) AS raised, l_returnflag || '-' || l_linestatus AS joined FROM lineitem")
q("group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100")
q("group_ordinal", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
q("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, cast(sum(DISTINCT l_linenumber) AS bigint) AS lines FROM lineitem GROUP BY l_returnflag")
q("count_star", "SELECT count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, cast(round(avg(cast(l_quantity AS decimal(18,2))), 6) AS double) AS avg_qty FROM lineitem", "SELECT count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, cast(round(cast(avg(l_quantity) AS decimal(28,10)), 6) AS double) AS avg_qty FROM lineitem")
q("agg_expression", "SELECT o_orderstatus, max(o_totalprice) - min(o_totalprice) AS span FROM orders GROUP BY o_orderstatus HAVING max(o_totalprice) > 2 * min(o_totalprice)")
q("top_n", "SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
q("top_in_union_arm", "SELECT TOP 3 1 AS k FROM orders UNION ALL SELECT n_nationkey FROM nation ORDER BY 1", "(SELECT 1 AS k FROM orders LIMIT 3) UNION ALL SELECT n_nationkey FROM nation")
q("top_percent", "SELECT TOP 10 PERCENT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= ceil(count(*) OVER () * 0.1)")
q("bracket_strings", "SELECT n_nationkey, [is ] + n_name AS said FROM nation WHERE NOT n_name = [BRAZIL]", "SELECT n_nationkey, 'is ' || n_name AS said FROM nation WHERE n_name <> 'BRAZIL'")
q("order_desc", "SELECT n_name, n_regionkey FROM nation ORDER BY 2 DESC, n_name")
q("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
q("union_all", "SELECT c_nationkey AS nationkey, c_acctbal AS bal FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
q("union_distinct", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
q("union_nested", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL (SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation)) u GROUP BY k HAVING count(*) > 1 ORDER BY k")
q("union_arms", "SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey HAVING count(*) > 2 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY s_nationkey ORDER BY 1, 2")
q("qualified_star", "SELECT r.*, -n.n_nationkey AS neg FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey")
q("into_cursor", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment INTO CURSOR segments READWRITE", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
