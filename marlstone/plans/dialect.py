"""DuckDB's statements as Spark SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from .parser import Call, Query, Series, Table, parse, walk
from .writer import Writer


def spark_sql(text: str, spark: SparkSession | None = None, solve: Callable | None = None, functions: set[str] | frozenset = frozenset()) -> str:
    """The statement for Spark. With a session, in which its tables are known, types decide what they decide in DuckDB."""
    return Writer(spark, solve, functions).query(parse(text))


def reached(query: Query) -> tuple[set[str], set[str]]:
    """Tables and functions that a statement names; common table expressions aren't tables where they are in scope."""
    tables: set[str] = set()

    def visit(node, scope: frozenset) -> None:
        if isinstance(node, Query):
            for name, _, inner in node.ctes:
                visit(inner, scope | ({name.lower()} if node.recursive else set()))
                scope = scope | {name.lower()}
            for part in (node.body, node.order, node.limit, node.offset):
                visit(part, scope)
        elif isinstance(node, Table):
            name = ".".join(node.parts).lower()
            if name not in scope:
                tables.add(name.removeprefix("main."))
        elif isinstance(node, (list, tuple)):
            for x in node:
                visit(x, scope)
        elif isinstance(node, dict):
            visit(list(node.values()), scope)
        elif hasattr(node, "__dataclass_fields__"):
            for f in node.__dataclass_fields__:
                visit(getattr(node, f), scope)

    visit(query, frozenset())
    return tables, {n.name for n in walk(query) if isinstance(n, (Call, Series))}
