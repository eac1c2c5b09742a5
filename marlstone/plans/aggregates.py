"""Aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.aggregates import arg_max, arg_min, count_distinct_rows, exact_avg, exact_double_sum, exact_sum, guarded, ordered_list, ordered_text, signed_fold, sum_of_text
from .registry import both, frame, table

both("a1_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(l_shipdate) < TIMESTAMP '2002-01-01 00:00:00' AS m FROM lineitem GROUP BY 1, 2")
both("a2_global", "SELECT count(*) AS n, sum(l_linenumber) IS NULL AS none, max(l_orderkey) AS m FROM lineitem WHERE l_quantity > 1000")
both("a3_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
both("a4_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14 AND max(o_totalprice) > 100000")
both("a5_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("a5_rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)")
both("a5_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
both("a6_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, max(event_id) FILTER (WHERE event_type = 'view') AS last FROM events GROUP BY user_id")
both("a7_count", "SELECT event_type, count(*) AS n, count(nullif(user_id, 3)) AS k FROM events GROUP BY event_type")
both("a8_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
both("a9_distinct_beside_others", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY event_type")


@frame("a10_count_distinct_rows", "SELECT event_type, count(DISTINCT (user_id % 10, nullif(event_id % 4, 0))) AS n FROM events GROUP BY event_type", sql=True)
def a10_count_distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(count_distinct_rows((F.col("user_id") % 10).alias("a"), F.expr("nullif(event_id % 4, 0)").alias("b")).alias("n"))


@frame("a11_exact_sum", "SELECT l_suppkey, sum(CAST(l_orderkey AS HUGEINT) * 1000000000000)::DECIMAL(38,0) AS big, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DECIMAL(38,2) AS money FROM lineitem GROUP BY 1", sql=True)
def a11_exact_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(exact_sum(F.col("l_orderkey").cast("decimal(38,0)") * 1000000000000).alias("big"), exact_sum(F.col("l_extendedprice").cast("decimal(18,2)"), 2).cast("decimal(38,2)").alias("money"))


@frame("a12_exact_avg", "SELECT o_custkey, avg(o_orderkey) AS a FROM orders GROUP BY 1", sql=True)
def a12_exact_avg(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(exact_avg(F.col("o_orderkey")).alias("a"))


@frame("a13_exact_double_sum", "SELECT l_returnflag, round(fsum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1", sql=True)
def a13_exact_double_sum(spark, sf_dir):
    return exact_double_sum(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "total").select("l_returnflag", F.round("total", 2).alias("total"))


@frame("a14_sum_of_text", "SELECT p_brand, sum(TRY_CAST(substr(p_brand, 7) AS BIGINT))::DECIMAL(38,0) AS s FROM part GROUP BY 1", sql=True)
def a14_sum_of_text(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(sum_of_text(F.substring("p_brand", 7, 20)).alias("s"))


@frame("a15_guarded_cast", "SELECT max(TRY_CAST(substr(p_brand, 7) AS BIGINT)) AS m FROM part", sql=True)
def a15_guarded_cast(spark, sf_dir):
    text = F.substring("p_brand", 7, 20)
    return table(spark, sf_dir, "part").agg(F.max(guarded(text, text.try_cast("bigint"))).alias("m"))


both("a17_sum_distinct", "SELECT event_type, CAST(sum(DISTINCT user_id) AS BIGINT) AS s FROM events GROUP BY event_type")
both("a18_min_max", "SELECT c_nationkey, min(c_name) AS lo, max(c_mktsegment) AS hi, min(c_acctbal) AS bal, max(c_custkey > 700) AS late FROM customer GROUP BY c_nationkey")


@frame("a19_first_last", "SELECT user_id, first(nullif(event_type, 'click') ORDER BY ts) AS f, last(event_type ORDER BY ts) AS l FROM events GROUP BY user_id", sql=True)
def a19_first_last(spark, sf_dir):
    kind = F.struct(F.expr("nullif(event_type, 'click')").alias("v"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by(kind, "ts")["v"].alias("f"), F.max_by("event_type", "ts").alias("l"))


@frame("a20_arg_max", "SELECT user_id, arg_max(nullif(event_type, 'click'), ts) AS a, arg_min(event_id, ts) AS b FROM events GROUP BY user_id", sql=True)
def a20_arg_max(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(arg_max(F.expr("nullif(event_type, 'click')"), F.col("ts")).alias("a"), arg_min(F.col("event_id"), F.col("ts")).alias("b"))


@frame("a21_nth_value", "SELECT user_id, list(event_id ORDER BY ts)[3] AS third FROM events GROUP BY user_id", sql=True)
def a21_nth_value(spark, sf_dir):
    # Each task keeps three rows of a group before the shuffle.
    first = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))).where("n <= 3")
    return first.groupBy("user_id").agg(F.max(F.when(F.col("n") == 3, F.col("event_id"))).alias("third"))


both("a22_bool_and_or", "SELECT event_type, bool_and(user_id > 0) AS a, bool_or(user_id > 140) AS o FROM events GROUP BY event_type")
both("a23_bits", "SELECT event_type, bit_and(event_id) AS a, bit_or(event_id) AS o, bit_xor(event_id) AS x FROM events GROUP BY event_type")


@frame("a24_string_agg", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1", sql=True)
def a24_string_agg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC)").alias("names"))


@frame("a24_ordered_text", "SELECT user_id, string_agg(nullif(event_type, 'click'), '|' ORDER BY ts) AS path FROM events GROUP BY 1", sql=True)
def a24_ordered_text(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(ordered_text(F.expr("nullif(event_type, 'click')"), "|", F.col("ts")).alias("path"))


@frame("a25_ordered_list", "SELECT user_id, list(nullif(event_type, 'click') ORDER BY ts) AS kinds FROM events GROUP BY 1", sql=True)
def a25_ordered_list(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(ordered_list(F.expr("nullif(event_type, 'click')"), F.col("ts")).alias("kinds"))


both("a26_statistics", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp, round(corr(value, user_id), 6) AS c, round(covar_pop(value, user_id), 6) AS cp, round(median(value), 6) AS m, round(quantile_cont(value, 0.25), 6) AS q, round(regr_slope(value, user_id), 6) AS slope FROM events GROUP BY event_type")
both("a11_wide_sum", "SELECT sum(9223372036854775807 - event_id)::VARCHAR AS s, sum(user_id)::DECIMAL(38,0) AS u, sum(CASE WHEN user_id > 3 THEN 1 ELSE 0 END)::DECIMAL(38,0) AS n FROM events")
both("a25_lists", "SELECT event_type, len(list(user_id)) AS n, list(user_id ORDER BY ts DESC, event_id)[1] AS last, list_sort(list(DISTINCT user_id % 5)) AS kinds, list(event_id ORDER BY user_id % 3 DESC, event_id) FILTER (WHERE event_id % 50 = 0) AS some FROM events GROUP BY event_type")
both("a28_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")


@frame("a29_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey", sql=True)
def a29_distinct_on(spark, sf_dir):
    from ..operators.windows import top_per_group

    return top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@frame("a30_signed_fold", """
SELECT party, sum(amount)::DECIMAL(38,0) AS net FROM (
  SELECT l_suppkey AS party, CAST(l_quantity AS BIGINT) AS amount FROM lineitem
  UNION ALL SELECT l_partkey, -CAST(l_quantity AS BIGINT) FROM lineitem) GROUP BY party HAVING sum(amount) <> 0
""", sql=True)
def a30_signed_fold(spark, sf_dir):
    items, quantity = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("bigint")
    return signed_fold([(items, [F.col("l_suppkey")], [quantity]), (items, [F.col("l_partkey")], [-quantity])], ["party"], ["net"])


@frame("a30_composite_fold", """
SELECT side, kind, sum(n)::DECIMAL(38,0) AS n, sum(v)::DECIMAL(38,0) AS v FROM (
  SELECT 'in' AS side, lower(event_type) AS kind, 1 AS n, event_id AS v FROM events
  UNION ALL SELECT 'out', upper(event_type), -1, -user_id FROM events) GROUP BY ALL
""", sql=True)
def a30_composite_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return signed_fold([(e, [F.lit("in"), F.lower("event_type")], [F.lit(1), F.col("event_id")]), (e, [F.lit("out"), F.upper("event_type")], [F.lit(-1), -F.col("user_id")])], ["side", "kind"], ["n", "v"], drop_zero=False)
