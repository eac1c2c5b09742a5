"""Sorts, limits and top-k."""

from __future__ import annotations

from .registry import both

both("o1_sort_nulls", "SELECT event_id, row_number() OVER (ORDER BY k ASC NULLS FIRST, event_id DESC) AS place FROM (SELECT event_id, nullif(user_id % 9, 4) AS k FROM events) ORDER BY place")
both("o1_default_nulls_last", "SELECT event_id, row_number() OVER (ORDER BY k DESC, event_id) AS place, row_number() OVER (ORDER BY k, event_id) AS up FROM (SELECT event_id, nullif(user_id % 9, 4) AS k FROM events) ORDER BY k DESC, event_id")
both("o2_order_by_all", "SELECT n_regionkey, nullif(n_name, 'CHINA') AS name FROM nation ORDER BY ALL LIMIT 17")
both("o5_fractional_limit", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 2.5")
both("o2_ordinals", "SELECT n_name, n_regionkey FROM nation ORDER BY 2 DESC, 1 LIMIT 8")
both("o4_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 120")
both("o6_top_k", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 100")
both("o7_outer_order", "SELECT * FROM (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey) WHERE c_custkey > 50 ORDER BY c_custkey LIMIT 20")
both("o8_page_over_left_joins", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 25 OFFSET 10")
both("o9_byte_order", "SELECT w FROM (VALUES ('a'), ('B'), ('é'), ('z'), ('Z'), ('aa')) AS t(w) ORDER BY w LIMIT 4")
