"""How queries are registered: a name, what runs in Spark, and the DuckDB SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from .inspect import reach

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement of the engine over the tables that it names."""
    engine = Engine(spark)
    for name in reach(spark, text)[0]:
        engine.register(name, table(spark, sf_dir, name))
    return engine.sql(text)


def both(name: str, text: str) -> None:
    """A statement that the engine and DuckDB must answer alike."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLES[name] = text


def frame(name: str, duck_text: str | None, sql: bool = False):
    """Registers a function of (spark, sf_dir) -> DataFrame; with sql, also what the engine answers to the text, as name_sql."""

    def add(f):
        QUERIES[name] = f
        if duck_text is not None:
            ORACLES[name] = duck_text
        if sql:
            both(f"{name}_sql", duck_text)
        return f

    return add
