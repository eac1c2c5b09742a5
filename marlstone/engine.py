"""The engine: a closed set of tables, and read-only SQL over them in DuckDB's dialect."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from .errors import Cancelled, EngineError, LimitExceeded, NoSegments, NotAllowed, PlanError, Timeout, restated
from .functions.duck import install
from .functions.text import register_text_function
from .plans.dialect import spark_sql
from .plans.inspect import reach
from .plans.writer import function_names
from .sources.facts import facts, text_rows, union_segments, widened
from .sources.tables import HostTables


@dataclass(frozen=True)
class Limits:
    """What one statement may take; None is without bound. The defaults keep an answer within the driver's memory."""

    max_rows: int | None = 1_000_000
    max_bytes: int | None = 256 << 20
    timeout_s: float | None = None

    @classmethod
    def serving(cls) -> Limits:
        """For statements of strangers."""
        return cls(max_rows=50_000, max_bytes=32 << 20, timeout_s=30.0)


@dataclass(frozen=True)
class Budget:
    """What a session may take, as settings for the one that builds it: memory of an executor, cores, and where tasks spill to."""

    memory: str = "8g"
    threads: int = 8
    spill: str | None = None

    def conf(self) -> dict[str, str]:
        made = {"spark.executor.memory": self.memory, "spark.executor.cores": str(self.threads), "spark.sql.shuffle.partitions": str(4 * self.threads)}
        return made | ({"spark.local.dir": self.spill} if self.spill else {})


class CancelToken:
    """Lets one thread give up the statement of another."""

    def __init__(self):
        self._event, self._stop = threading.Event(), []

    def cancel(self) -> None:
        self._event.set()
        for stop in list(self._stop):
            stop()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    @contextmanager
    def over(self, stop: Callable[[], None]):
        self._stop.append(stop)
        try:
            if self.cancelled:
                raise Cancelled("the statement was cancelled")
            yield
        finally:
            self._stop.remove(stop)


def size_of(value) -> int:
    """Bytes of a value, roughly."""
    if isinstance(value, (str, bytes, bytearray)):
        return len(value)
    if isinstance(value, (list, tuple)):
        return 8 + sum(map(size_of, value))
    if isinstance(value, dict):
        return 8 + sum(size_of(k) + size_of(v) for k, v in value.items())
    return 8


@dataclass(frozen=True)
class Metrics:
    """What an engine's answers came to; plan_metrics has what a plan took."""

    statements: int = 0
    rows: int = 0
    bytes: int = 0


class Gate:
    """At most so many statements at a time, first come first served."""

    def __init__(self, permits: int):
        self._lock, self._free, self._queue = threading.Condition(), permits, []

    @contextmanager
    def admitted(self):
        me = object()
        with self._lock:
            self._queue.append(me)
            self._lock.wait_for(lambda: self._free > 0 and self._queue[0] is me)
            self._queue.pop(0)
            self._free -= 1
            self._lock.notify_all()
        try:
            yield
        finally:
            with self._lock:
                self._free += 1
                self._lock.notify_all()


class Engine:
    def __init__(self, spark: SparkSession, permits: int = 8):
        self.spark, self.gate, self.host = spark, Gate(permits), HostTables(spark)
        self._tables: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}
        self._text_functions: set[str] = set()
        self._solved, self.metrics = 0, Metrics()
        install(spark)

    # Tables
    def register(self, name: str, df: DataFrame) -> None:
        if name.lower() in self._views:
            raise PlanError(f"{name} is a view")
        self._tables[name.lower()] = df

    def open_segments(self, folder: str) -> list[str]:
        """Tables of a folder of <table>-<hash>.parquet files, with wide columns as schema.json declares them."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files: dict[str, list[str]] = {}
        declared: dict = {}
        for status in fs.listStatus(root):
            path = status.getPath().toString()
            name = PurePosixPath(path).name
            if name.endswith(".parquet"):
                files.setdefault(name.removesuffix(".parquet").rpartition("-")[0] or name.removesuffix(".parquet"), []).append(path)
            elif name == "schema.json":
                declared = json.loads("\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect()))
        if not files and not declared:
            raise NoSegments(f"no segments in {folder}")
        for name, found in files.items():
            kinds = declared.get(name, {})
            self.register(name, widened(union_segments(self._segments(sorted(found))), [c for c, k in kinds.items() if k in ("word16", "word32")]))
        for name, kinds in declared.items():
            if name not in files:
                self.register(name, widened(self.spark.createDataFrame([], ", ".join(f"`{c}` {'string' if k.startswith('word') else k}" for c, k in kinds.items())), [c for c, k in kinds.items() if k in ("word16", "word32")]))
        return sorted(self._tables)

    def _segments(self, files: list[str]) -> list[DataFrame]:
        """One frame for all files of a schema: schemas come from the footers, whatever their number, and a plan has as many scans as there are schemas."""
        with ThreadPoolExecutor(16) as pool:
            schemas = list(pool.map(lambda f: self.spark.read.parquet(f).schema, files))
        alike: dict[str, tuple] = {}
        for f, schema in zip(files, schemas, strict=True):
            alike.setdefault(schema.json(), (schema, []))[1].append(f)
        return [self.spark.read.schema(schema).parquet(*own) for schema, own in alike.values()]

    def register_facts(self, name: str, cold: DataFrame | None, hot: DataFrame | None, declared: dict[str, str], block: str, after: int | None = None, through: int | None = None) -> None:
        self.register(name, facts(cold, hot, declared, block, after, through))

    def register_rows(self, name: str, rows: list[dict]) -> None:
        self.register(name, text_rows(self.spark, rows))

    def register_text_function(self, name: str, arity: int, f: Callable[..., str | None]) -> None:
        register_text_function(self.spark, name, arity, f)
        self._text_functions.add(name.lower())

    def register_scalar_function(self, name: str, f: Callable, result: str) -> None:
        """Makes f callable from SQL by that name, over values of any type; result: its type in Spark's words. Values cross in Arrow batches."""
        from pyspark.sql.functions import udf

        self.spark.udf.register(name, udf(f, result, useArrow=True))
        self._text_functions.add(name.lower())

    def function_names(self) -> list[str]:
        """All functions that a statement may call."""
        return sorted(set(function_names()) | self._text_functions)

    def visible_tables(self) -> list[str]:
        """All relations that a statement may name."""
        return sorted([*self.tables(), "information_schema.columns", "information_schema.tables"])

    def view(self, name: str, text: str) -> None:
        """A view over earlier tables and views; it may replace a view, never a table."""
        if name.lower() in self._tables:
            raise PlanError(f"{name} is a table")
        self._views[name.lower()] = self.sql(text)

    def tables(self) -> list[str]:
        return sorted([*self._tables, *self._views, *self.host.tables])

    def has_table(self, name: str) -> bool:
        return name.lower() in self.tables()

    def information_schema(self) -> tuple[DataFrame, DataFrame]:
        """The relations information_schema.tables and information_schema.columns."""
        known = {**{n: ("BASE TABLE", d) for n, d in {**self._tables, **self.host.tables}.items()}, **{n: ("VIEW", d) for n, d in self._views.items()}}
        from .sources.tables import duck_name

        tables = self.spark.createDataFrame([("main", "main", n, k) for n, (k, _) in sorted(known.items())], "table_catalog string, table_schema string, table_name string, table_type string")
        columns = self.spark.createDataFrame([("main", "main", n, f.name, i + 1, "YES" if f.nullable else "NO", duck_name(f.dataType)) for n, (_, d) in sorted(known.items()) for i, f in enumerate(d.schema)], "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
        return tables, columns

    # Statements
    def sql(self, text: str) -> DataFrame:
        """The answer as a frame; nothing runs yet, but for recursive queries that keep distinct rows. Only tables of this engine can be named."""
        explain = text.lstrip()[:7].lower() == "explain"
        body = text.lstrip()[7:] if explain else text
        try:
            wanted = reach(self.spark, body)[0]
            frames = {**self._tables, **self.host.tables, **self._views}
            if any(t.startswith("information_schema.") for t in wanted):
                frames["information_schema.tables"], frames["information_schema.columns"] = self.information_schema()
            for name in sorted(wanted):
                if name not in frames:
                    raise NotAllowed(f"no table {name}")
                frames[name].createOrReplaceTempView(f"`{name.replace('.', '_')}`")
            df = self.spark.sql(spark_sql(body, self.spark, self._solve, self._text_functions))
            return self.spark.createDataFrame([(df._jdf.queryExecution().toString(),)], "plan string") if explain else df
        except EngineError:
            raise
        except Exception as e:
            raise restated(e) from e

    def _solve(self, name: str, columns: list[str], start: str, head: str, step: str) -> str:
        """The view that holds a recursive query's distinct rows: its step is run over new rows until none is new."""
        from .operators.recursion import fixpoint

        first = self.spark.sql(start)
        if columns:
            first = first.toDF(*columns)
        self._solved += 1
        made = f"_solved_{id(self)}_{self._solved}"

        def once(new: DataFrame) -> DataFrame:
            new.createOrReplaceTempView(f"`{name}`")
            out = self.spark.sql(head + step).toDF(*first.columns)
            return out.select(*[out[c].cast(f.dataType).alias(f.name) for c, f in zip(out.columns, first.schema, strict=True)])

        fixpoint(first, once).createOrReplaceTempView(made)
        self.spark.catalog.dropTempView(name)
        return made

    def answer(self, text: str, limits: Limits = Limits(), token: CancelToken | None = None) -> list:
        """Rows, within the limits. Statements wait for their turn at the gate, and a token gives them up."""
        token = token or CancelToken()
        with self.gate.admitted():
            group, sc = f"marlstone-{uuid.uuid4().hex}", self.spark.sparkContext
            late, timer = threading.Event(), None
            stop = lambda: sc._jsc.sc().cancelJobGroupAndFutureJobs(group)
            with token.over(stop):
                df = self.sql(text)
                sc.setJobGroup(group, "statement", interruptOnCancel=True)
                if limits.timeout_s is not None:
                    timer = threading.Timer(limits.timeout_s, lambda: (late.set(), stop()))
                    timer.start()
                try:
                    rows, held = [], 0
                    df = df if limits.max_rows is None else df.limit(limits.max_rows + 1)
                    # Until here the cluster's spark.driver.maxResultSize bounds the bytes; a larger result aborts the job.
                    for row in df.collect():
                        rows.append(row)
                        held += size_of(tuple(row))
                        if limits.max_rows is not None and len(rows) > limits.max_rows:
                            raise LimitExceeded(f"more than {limits.max_rows} rows")
                        if limits.max_bytes is not None and held > limits.max_bytes:
                            raise LimitExceeded(f"more than {limits.max_bytes} bytes")
                except EngineError:
                    raise
                except Exception as e:
                    if late.is_set():
                        raise Timeout("timeout") from e
                    raise Cancelled("the statement was cancelled") if token.cancelled else restated(e) from e
                finally:
                    if timer:
                        timer.cancel()
                    sc.setLocalProperty("spark.jobGroup.id", None)
                self.metrics = Metrics(self.metrics.statements + 1, self.metrics.rows + len(rows), self.metrics.bytes + held)
                return rows
