"""Subqueries and common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import both, frame, table

both("q1_derived_table", "SELECT k, n FROM (SELECT o_custkey AS k, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x WHERE n > 12) y")
both("q2_cte", "WITH a AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1), b AS (SELECT max(s) AS m FROM a) SELECT a.o_custkey, CAST(a.s AS DOUBLE) AS s FROM a, b WHERE a.s * 2 > b.m")
both("q3_recursive_union_all", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@frame("q3_recursive_union", """
WITH RECURSIVE reach(k) AS (SELECT CAST(1 AS BIGINT) UNION SELECT (k * 3 + i) % 97 FROM reach, (VALUES (1), (2)) AS v(i)) SELECT k FROM reach
""", sql=True)
def q3_recursive_union(spark, sf_dir):
    from ..operators.recursion import fixpoint

    start = spark.createDataFrame([(1,)], "k bigint")
    return fixpoint(start, lambda new: new.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("i"), "k").select(((F.col("k") * 3 + F.col("i")) % 97).alias("k")))


both("q4_scalar_subquery", "SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above, (SELECT max(n_name) FROM nation WHERE n_nationkey > 1000) AS none FROM orders")
both("q5_correlated_aggregate", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS n, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer")
both("q6_correlated_expression_key", "SELECT r_name, (SELECT count(*) FROM nation WHERE lower(substring(n_name, 1, 1)) = lower(substring(r_name, 1, 1))) AS n FROM region")
both("q7_correlated_non_equi", "SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey > r_regionkey) AS n FROM region")
both("q8_correlated_lookup", "SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region FROM nation")
both("q9_subquery_in_aggregate", "SELECT n_regionkey, sum(CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) THEN 1 ELSE 0 END) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= (SELECT min(r_regionkey) FROM region)")
both("q10_exists_in_select", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS rich, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'one' ELSE 'other' END AS place FROM customer")


@frame("q11_correlated_ordered_list", "SELECT r_name, (SELECT list(n_name ORDER BY n_name DESC) FROM nation WHERE n_regionkey = r_regionkey) AS names FROM region", sql=True)
def q11_correlated_ordered_list(spark, sf_dir):
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name"), False).alias("names"))
    region = table(spark, sf_dir, "region")
    return region.join(names, region.r_regionkey == names.n_regionkey, "left").select("r_name", "names")
