"""Scans, literal relations, series and the union of sealed segments with live rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.facts import facts
from ..streaming.seam import MemoryTip, seam
from .registry import both, frame, table

both("s1_parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_quantity > 45")
both("s7_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
both("s8_empty_relation", "SELECT 1 AS one, 'a' AS letter")
both("s9_range", "SELECT range AS id FROM range(5, 50, 7)")
both("s10_generate_series", "SELECT generate_series AS v FROM generate_series(10, -5, -3)")
both("s11_unnest", "SELECT event_id, unnest([user_id, event_id]) AS v FROM events")


@frame("s4_facts_window", """
SELECT event_id, user_id, CAST(NULL AS VARCHAR) AS memo FROM events WHERE event_id > 100 AND event_id <= (SELECT max(event_id) - 200 FROM events)
UNION ALL SELECT event_id, user_id, 'live' AS memo FROM events WHERE event_id > (SELECT max(event_id) - 200 FROM events) AND event_id <= (SELECT max(event_id) - 150 FROM events)
""")
def s4_facts_window(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    last = events.agg(F.max("event_id")).first()[0]
    hot = events.where(F.col("event_id") > last - 200).withColumn("memo", F.lit("live"))
    return facts(events.where(F.col("event_id") <= last - 200), hot, {"event_id": "bigint", "user_id": "bigint", "memo": "string"}, "event_id", after=100, through=last - 150)


@frame("s5_register_rows", "SELECT e.event_type, count(*) AS n, max(l.label) AS label FROM events e JOIN (VALUES ('click', 'a click'), ('view', 'a view')) AS l(kind, label) ON e.event_type = l.kind GROUP BY 1")
def s5_register_rows(spark, sf_dir):
    from ..sources.facts import text_rows

    labels = text_rows(spark, [{"kind": "click", "label": "a click"}, {"kind": "view", "label": "a view"}])
    events = table(spark, sf_dir, "events")
    return events.join(F.broadcast(labels), events.event_type == labels.kind).groupBy("event_type").agg(F.count("*").alias("n"), F.max("label").alias("label"))


@frame("s14_seam", "SELECT event_id, user_id, event_type FROM events")
def s14_seam(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    tip = MemoryTip("event_id")
    last = events.agg(F.max("event_id")).first()[0]
    tip.append("events", [r.asDict() for r in events.where(F.col("event_id") > last - 200).collect()])
    tip.seal_through("events", last - 100)
    return seam(events.where(F.col("event_id") <= last - 50), tip, "events")


@frame("s6_empty_declared_table", "SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS name WHERE false")
def s6_empty_declared_table(spark, sf_dir):
    return spark.createDataFrame([], "id bigint, name string")


@frame("s17_parquet_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0")
def s17_parquet_round_trip(spark, sf_dir):
    from ..sources.tables import HostTables

    host = HostTables(spark)
    return host.load_parquet("poor", host.write_parquet(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey", "c_name", "c_acctbal")))


@frame("s3_wide_columns", """
SELECT p_partkey, p_name, TRY_CAST(substr(p_name, 1, 3) AS DECIMAL(38,0)) AS code_dec,
       TRY_CAST(substr(p_name, 1, 3) AS DECIMAL(38,0)) IS NULL AS code_overflow FROM part
""")
def s3_wide_columns(spark, sf_dir):
    from ..sources.facts import widened

    return widened(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.substring("p_name", 1, 3).alias("code")), ["code"]).drop("code")
