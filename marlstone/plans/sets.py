"""Set operations."""

from __future__ import annotations

from .registry import both, frame, table

_A = "SELECT user_id % 20 AS k, event_type AS t FROM events WHERE event_type <> 'click'"
_B = "SELECT user_id % 25 AS k, event_type AS t FROM events WHERE event_type <> 'view'"
both("u1_union_all", f"{_A} UNION ALL {_B}")
both("u2_union", f"{_A} UNION {_B}")


@frame("u3_union_by_name", "SELECT n_name, n_regionkey FROM nation UNION ALL BY NAME SELECT r_regionkey AS n_regionkey, r_name AS extra FROM region", sql=True)
def u3_union_by_name(spark, sf_dir):
    region = table(spark, sf_dir, "region").selectExpr("r_regionkey AS n_regionkey", "r_name AS extra")
    return table(spark, sf_dir, "nation").select("n_name", "n_regionkey").unionByName(region, allowMissingColumns=True)


both("u4_intersect", f"{_A} INTERSECT {_B}")
both("u4_intersect_all", f"{_A} INTERSECT ALL {_B}")
both("u5_except", f"{_A} EXCEPT {_B}")
both("u5_except_all", f"{_A} EXCEPT ALL {_B}")
both("u6_mixed_types", "SELECT CAST(n_nationkey AS DOUBLE) AS v FROM nation UNION ALL SELECT CAST(c_custkey AS DECIMAL(12,2)) FROM customer UNION ALL SELECT c_nationkey FROM customer")
both("u6_mixed_distinct", "SELECT CAST(l_linenumber AS DOUBLE) AS v FROM lineitem UNION SELECT CAST(l_suppkey AS DECIMAL(10,2)) FROM lineitem")
both("u6_wide", "SELECT l_suppkey AS v FROM lineitem EXCEPT SELECT CAST(l_suppkey AS HUGEINT) * 2 FROM lineitem")
both("u7_nested", f"(({_A}) EXCEPT ({_B})) UNION (SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation WHERE n_regionkey = 1) ORDER BY 1, 2")
