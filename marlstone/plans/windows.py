"""Window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.windows import last_value_so_far, partition_extreme, top_per_group
from .registry import both, frame, table

_W = "OVER (PARTITION BY user_id ORDER BY ts)"
both("w1_row_number", f"SELECT event_id, row_number() {_W} AS n FROM events")
both("w2_rank", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
both("w3_percent_rank", f"SELECT event_id, percent_rank() {_W} AS p, cume_dist() {_W} AS c FROM events")
both("w4_ntile", f"SELECT event_id, ntile(4) {_W} AS q FROM events")
both("w5_lag_lead", f"SELECT event_id, lag(event_type) {_W} AS a, lead(event_id, 2, -1) {_W} AS b FROM events")
both("w6_value_functions", f"SELECT event_id, first_value(event_type) {_W} AS f, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n, last_value(nullif(event_type, 'click') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events")


@frame("w7_last_value_so_far", "SELECT event_id, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM events", sql=True)
def w7_last_value_so_far(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", last_value_so_far(F.expr("nullif(event_type, 'view')"), [F.col("user_id")], [F.col("ts")]).alias("l"))


both("w8_aggregates_over", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, max(event_id) OVER (PARTITION BY event_type) AS m, min(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS lo FROM events")
both("w9_exact_window_sum", "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)::BIGINT AS s, sum(9223372036854775807) OVER (PARTITION BY user_id ORDER BY ts)::VARCHAR AS w, avg(event_id) OVER (PARTITION BY user_id) AS a FROM events")
both("w10_frames", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, count(*) OVER (PARTITION BY user_id % 5 ORDER BY event_id RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS b, max(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM events")
both("w11_named_window", "SELECT o_orderkey, count(*) OVER w AS n, max(o_orderkey) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("w12_filter_over", "SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts) AS clicks FROM events")
both("w13_rank_of_aggregate", "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_custkey")
both("w14_qualify", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")


@frame("w15_top_per_group", "SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) <= 3", sql=True)
def w15_top_per_group(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey"), F.asc("l_linenumber")]
    return top_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice")


@frame("w16_partition_extreme", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY o_totalprice = min(o_totalprice) OVER (PARTITION BY o_custkey)", sql=True)
def w16_partition_extreme(spark, sf_dir):
    return partition_extreme(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice")
