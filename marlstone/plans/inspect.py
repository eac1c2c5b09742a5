"""What a statement reaches: tables, base tables by scope, functions; its canonical form; its scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import PlanError
from .dialect import reached
from .parser import parse


def reach(spark: SparkSession, text: str) -> tuple[set[str], set[str]]:
    """Tables and functions that the statement names; common table expressions aren't tables where they are in scope."""
    return reached(parse(text))


def refs(text: str) -> dict[str, int]:
    """How often each table is named."""
    from collections import Counter

    from .parser import Table, walk

    known, query = reached(parse(text))[0], parse(text)
    return dict(Counter(n for t in walk(query) if isinstance(t, Table) and (n := ".".join(t.parts).lower()) in known))


def base_tables(spark: SparkSession, text: str) -> set[str]:
    return reach(spark, text)[0]


def canonical(df: DataFrame) -> str:
    """One text for all statements that differ in aliases of tables and spelling alone."""
    import re

    plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    return re.sub(r"file:\S+|RelationV2\S*", "", plan)


#: Physical operators that admission knows.
_KNOWN = set("""AdaptiveSparkPlan AggregateInPandas AppendColumns ArrowEvalPython BatchEvalPython BatchScan BroadcastExchange BroadcastHashJoin BroadcastNestedLoopJoin CartesianProduct CollectLimit CollectTail ColumnarToRow
    Coalesce EmptyRelation Expand FileSourceScan Filter FlatMapGroupsInPandas Generate GlobalLimit GlobalLimitAndOffset HashAggregate InMemoryTableScan InputAdapter LocalLimit LocalTableScan MapInArrow MapInPandas
    ObjectHashAggregate OneRowRelation PlanLater Project Range RDDScan ReusedExchange ReusedSubquery RowToColumnar Sample Scan ShuffleExchange ShuffledHashJoin Sort SortAggregate SortMergeJoin Subquery SubqueryBroadcast TakeOrderedAndProject
    Union UnionLoop WholeStageCodegen Window WindowGroupLimit WindowInPandas ArrowWindowPython PythonWindow CollectMetrics DataSourceScan RowDataSourceScan ExternalRDDScan ObjectScan SerializeFromObject DeserializeToObject MapElements MapPartitions""".split())


def _nodes(plan):
    yield plan
    for group in (plan.children(), plan.subqueries()):
        for i in range(group.size()):
            yield from _nodes(group.apply(i))


def _kind(node) -> str:
    return node.getClass().getSimpleName().removesuffix("Exec")


def parquet_scans(df: DataFrame) -> int:
    """Parquet scans of the physical plan, for admission; an operator that isn't known is refused."""
    found = 0
    for node in _nodes(df._jdf.queryExecution().sparkPlan()):
        kind = _kind(node)
        if kind not in _KNOWN:
            raise PlanError(f"operator {kind} isn't known")
        found += kind in ("FileSourceScan", "BatchScan") and "parquet" in node.toString().lower()
    return found


def plan_metrics(df: DataFrame) -> dict[str, int]:
    """What the plan of a frame that has run came to: rows out of scans, bytes spilled, the largest peak of memory, tasks' time."""
    found = {"scanned_rows": 0, "spilled_bytes": 0, "peak_memory": 0, "shuffled_bytes": 0}

    def visit(node) -> None:
        kind = _kind(node)
        if kind == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if kind.endswith("QueryStage"):
            return visit(node.plan())
        held = node.metrics()
        value = lambda name: held.apply(name).value() if held.contains(name) else 0
        if kind in ("FileSourceScan", "BatchScan"):
            found["scanned_rows"] += value("numOutputRows")
        found["spilled_bytes"] += value("spillSize")
        found["shuffled_bytes"] += value("dataSize") if kind == "ShuffleExchange" else 0
        found["peak_memory"] = max(found["peak_memory"], value("peakMemory"))
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return found
