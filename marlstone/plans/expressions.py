"""Projection, filters, predicates and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import both, frame, table

both("p1_projection", "SELECT o.o_orderkey AS k, o.o_totalprice * 2 AS twice, o.o_orderstatus FROM orders o")
both("p2_exclude_replace", "SELECT n.* EXCLUDE (n_regionkey) REPLACE (upper(n_name) || '!' AS n_name), r.* EXCLUDE r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
both("p3_filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 500 AND (c_mktsegment = 'BUILDING' OR NOT c_nationkey = 3)")
both("p4_from_first", "FROM region SELECT r_regionkey, r_name")
both("p5_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
both("p6_comparison", "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_retailprice >= 1000.5 AS ge, p_partkey < '150' AS fitted, '20' <= p_size AS fitted_left, p_size > 10.5 AS fraction, CAST(p_retailprice AS DECIMAL(10,2)) > 1e3 AS beside FROM part")
both("p7_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 11 AND l_linenumber NOT BETWEEN 2 AND 7")
both("p8_in_list", "SELECT n_name, n_regionkey IN (0, 2) AS a, n_regionkey NOT IN (1, NULL) AS b FROM nation")
both("p9_is_distinct_from", "SELECT event_id, nullif(event_type, 'click') IS DISTINCT FROM 'view' AS a, nullif(user_id % 5, 0) IS NOT DISTINCT FROM NULL AS b FROM events")
both("p10_like", r"SELECT c_custkey, c_name LIKE '%01_' AS a, c_name ILIKE 'CUSTOMER%' AS b, c_name ^@ 'Cust' AS c, 'a_b' LIKE 'a!_b' ESCAPE '!' AS d FROM customer")
both("p11_null_logic", "SELECT event_id, x IS NULL AS a, x > 3 AND y AS b, x > 3 OR y AS c, NOT y AS d FROM (SELECT event_id, nullif(user_id % 7, 0) AS x, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS y FROM events)")
both("p12_row_comparison", "SELECT n_nationkey, (n_regionkey, n_name) > (2, 'F') AS after FROM nation")
both("p13_boolean_number", "SELECT p_partkey, (p_size > 20) = 1 AS a, 0 <> (p_brand = 'Brand#11') AS b, true = 1 AS c FROM part")
both("p14_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class, CASE p_brand WHEN 'Brand#11' THEN 1 END AS one FROM part")
both("p14_if", "SELECT p_partkey, if(p_size > 25, 'big', 'small') AS s FROM part")
both("p15_coalesce", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS a, ifnull(nullif(user_id, 3), -1) AS b, greatest(user_id, event_id, 50) AS c, least(user_id, event_id) AS d FROM events")
both("p16_cast", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS even, l_extendedprice::INT AS short, CAST(CAST(l_discount AS DECIMAL(10,2)) * 50 AS INT) AS half, CAST(CAST(l_quantity AS DECIMAL(10,2)) AS VARCHAR) AS text, CAST('1.5' AS INT) AS i, ' 1_000 '::BIGINT AS u, CAST('2024-02-29' AS DATE) = DATE '2024-02-29' AS d, (l_quantity > 10)::INT AS b FROM lineitem")
both("p16_try_cast", "SELECT p_partkey, TRY_CAST(substring(p_brand, 7) AS INT) AS n, TRY_CAST(p_name AS DOUBLE) AS none FROM part")
both("p17_try", "SELECT event_id, TRY(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k, TRY(CAST(event_type AS INT)) AS n, TRY(user_id // (event_id % 2)) AS q, TRY(json_extract_string(event_type, '$.a')) AS j, TRY(from_hex(event_type)) IS NULL AS h FROM events")
both("p18_wide_null_test", "SELECT p_partkey, TRY_CAST(p_partkey || repeat('9', 36) AS HUGEINT) IS NULL AS wide, TRY_CAST(p_brand AS HUGEINT) IS NULL AS no_number, TRY_CAST(substr(p_brand, 7) AS HUGEINT) IS NOT NULL AS number FROM part")
both("p19_move_constants", "SELECT event_id, 9223372036854775807 - event_id < 9223372036854775000 AS late FROM events WHERE event_id - 95 > 0 AND event_id + 5 <= 400000 AND 10 - event_id < 9")
both("p20_alias_reuse", "SELECT o_orderstatus AS status, count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY status ORDER BY -n, status")
both("p21_case_insensitive", 'SELECT N_NATIONKEY AS k, n_NAME AS name FROM NATION'.replace("NATION'", "nation'").replace("FROM NATION", "FROM nation"))
both("p22_default_names", "SELECT count(*), max(n_nationkey) + 1, lower(max(n_name)), n_regionkey, CASE WHEN n_regionkey > 2 THEN 'b' ELSE 's' END, n_regionkey::VARCHAR FROM nation GROUP BY n_regionkey")
both("p22_repeated_names", "WITH pairs AS (SELECT * FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey) SELECT n_nationkey, n_nationkey_1, n_name_1 FROM pairs")
both("p23_list_comprehension", "SELECT event_id, [x * 10 FOR x IN [event_id, user_id, event_id - user_id] IF x % 2 = 0] AS l FROM events")
both("p24_materialized_cte", "WITH t AS MATERIALIZED (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT a.n_regionkey, b.n FROM t a JOIN t b USING (n_regionkey)")


@frame("x2_text_function", "SELECT n_nationkey, nullif('<' || reverse(n_name) || '>', '<>') AS t FROM nation")
def x2_text_function(spark, sf_dir):
    from ..functions.text import text_function

    mark = text_function(lambda s: f"<{s[::-1]}>", 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", mark(F.col("n_name")).alias("t"))
