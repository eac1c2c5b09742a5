"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import latest_row, not_in, range_join, top_rows
from .registry import both, frame, table

both("j1_hash_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal < o_totalprice / 50")
both("j2_broadcast_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
both("j3_merge_join", "SELECT l_orderkey, l_linenumber, o_orderdate > TIMESTAMP '1998-01-01 00:00:00' AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
both("j4_theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
both("j5_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("j6_single_bound_join", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey >= r.r_regionkey")
_EPOCHS = "(SELECT c_custkey AS epoch, c_custkey * 7 AS first_id, c_custkey * 7 + 9 AS last_id FROM customer)"


def _epochs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("epoch"), (F.col("c_custkey") * 7).alias("first_id"), (F.col("c_custkey") * 7 + 9).alias("last_id"))


@frame("j7_range_join", f"SELECT e.event_id, p.epoch FROM events e JOIN {_EPOCHS} p ON e.event_id >= p.first_id AND e.event_id <= p.last_id", sql=True)
def j7_range_join(spark, sf_dir):
    return range_join(table(spark, sf_dir, "events").select("event_id"), _epochs(spark, sf_dir), "event_id", "first_id", "last_id").select("event_id", "epoch")


@frame("j8_outer_range_join", f"SELECT e.event_id, p.epoch FROM events e RIGHT JOIN {_EPOCHS} p ON e.event_id > p.first_id AND e.event_id <= p.last_id", sql=True)
def j8_outer_range_join(spark, sf_dir):
    return range_join(table(spark, sf_dir, "events").select("event_id"), _epochs(spark, sf_dir), "event_id", "first_id", "last_id", "right", low_strict=True).select("event_id", "epoch")


@frame("j8_left_range_join", f"SELECT e.event_id, p.epoch FROM events e LEFT JOIN {_EPOCHS} p ON e.event_id >= p.first_id AND e.event_id < p.last_id", sql=True)
def j8_left_range_join(spark, sf_dir):
    return range_join(table(spark, sf_dir, "events").select("event_id"), _epochs(spark, sf_dir), "event_id", "first_id", "last_id", "left", high_strict=True).select("event_id", "epoch")


both("j9_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '2001-06-01 00:00:00'")
both("j9_right_join", "SELECT c_custkey, n_name FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000")
both("j9_full_join", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM (SELECT * FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT * FROM customer WHERE c_acctbal < 5000) b ON a.c_custkey = b.c_custkey")
both("j10_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
both("j10_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01 00:00:00')")
both("j11_anti", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
both("j12_not_in", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
both("j12_not_in_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 1) FROM region WHERE r_regionkey < 3)")


@frame("j12_not_in_operator", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", sql=True)
def j12_not_in_operator(spark, sf_dir):
    return not_in(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders").where("o_totalprice > 300000"), "o_custkey")


both("j13_left_null_idiom", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
both("j14_using", "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)")
both("j15_expression_key", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON lower(substring(a.n_name, 1, 1)) = lower(substring(b.r_name, 1, 1))")
both("j16_self_join", "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.n = b.n AND a.k < b.k WHERE a.n > 15")


@frame("j17_lateral_top_k", "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t ON true", sql=True)
def j17_lateral_top_k(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return top_rows(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


both("j17_lateral_sql", "SELECT r_regionkey, t.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) t")
both("j18_lateral_binding", "SELECT n_nationkey, b.twice FROM nation, LATERAL (SELECT n_nationkey * 2 AS twice) b")


@frame("j19_latest_row", """
SELECT e.event_id, (SELECT p.event_id FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts ORDER BY p.ts DESC LIMIT 1) AS last_purchase
FROM events e WHERE e.event_type <> 'purchase'
""", sql=True)
def j19_latest_row(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("last_purchase"))
    return latest_row(events.where("event_type <> 'purchase'"), bought, ["user_id"], "ts", "bought", ["last_purchase"]).select("event_id", "last_purchase")


both("j21_null_equal_join", "SELECT a.event_id AS a, b.last AS b, b.n AS n FROM (SELECT event_id, nullif(user_id % 100, 3) AS k FROM events) a JOIN (SELECT nullif(user_id % 100, 3) AS k, max(event_id) AS last, count(*) AS n FROM events GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")
both("j22_build_on_smaller", "SELECT s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name")
