"""Host tables: results kept under a name, with rollback, Parquet round trips, descriptions and encodings."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import LimitExceeded, NotAllowed, PlanError
from ..runtime import shared_dir

#: Spark's types as DuckDB names them.
NAMES = {"boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "binary": "BLOB", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "void": "NULL"}


def duck_name(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return "HUGEINT" if (kind.precision, kind.scale) == (38, 0) else f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return duck_name(kind.elementType) + "[]"
    if isinstance(kind, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {duck_name(f.dataType)}" for f in kind) + ")"
    if isinstance(kind, T.MapType):
        return f"MAP({duck_name(kind.keyType)}, {duck_name(kind.valueType)})"
    return NAMES.get(kind.simpleString(), kind.simpleString().upper())


class HostTables:
    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self._undo = spark, {}, None

    def create_table_as(self, name: str, df: DataFrame) -> DataFrame:
        if name.lower() in self.tables:
            raise PlanError(f"table {name} exists")
        # Written, so a lost executor loses nothing; a column of nulls alone has no type to write and becomes text.
        plain = df.select(*[df[f"`{f.name}`"].cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else df[f"`{f.name}`"] for f in df.schema])
        path = self.write_parquet(plain)
        self.tables[name.lower()] = made = self.spark.read.schema(plain.schema).parquet(path)
        return made

    def drop_relation(self, name: str) -> None:
        if name.lower() not in self.tables:
            raise NotAllowed(f"no host table {name}")
        del self.tables[name.lower()]

    def begin(self) -> None:
        if self._undo is not None:
            raise PlanError("a transaction is open")
        self._undo = dict(self.tables)

    def commit(self) -> None:
        self._open()
        self._undo = None

    def rollback(self) -> None:
        self.tables, self._undo = self._open(), None

    def _open(self) -> dict:
        if self._undo is None:
            raise PlanError("no transaction is open")
        return self._undo

    def write_parquet(self, df: DataFrame, path: str | None = None) -> str:
        if path is None:
            path = f"{shared_dir(self.spark)}/host-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def load_parquet(self, name: str, path: str) -> DataFrame:
        self.tables[name.lower()] = df = self.spark.read.parquet(path)
        return df


def describe(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, duck_name(f.dataType)) for f in df.schema]


def arrow_batches(df: DataFrame) -> Iterator:
    """The result as Arrow batches, partition by partition: no more than a partition is held."""
    import pyarrow as pa

    def sealed(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["stream"])

    for row in df.mapInArrow(sealed, "stream binary").toLocalIterator(prefetchPartitions=True):
        yield from pa.ipc.open_stream(row.stream)


def arrow_ipc(df: DataFrame, max_bytes: int = 256 << 20) -> bytes:
    """The result as an Arrow stream of so many bytes at most."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    sink, out = pa.BufferOutputStream(), None
    for batch in arrow_batches(df):
        if out is None:
            out = pa.ipc.new_stream(sink, batch.schema)
        out.write_batch(batch)
        if sink.tell() > max_bytes:
            raise LimitExceeded(f"more than {max_bytes} bytes")
    if out is None:
        out = pa.ipc.new_stream(sink, to_arrow_schema(df.schema))
    out.close()
    return sink.getvalue().to_pybytes()


def encoded(value):
    """A value as JSON has it: decimals and wide integers as text, times as ISO text, what isn't a number as null."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return value if abs(value) < 1 << 53 else str(value)
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    if isinstance(value, dict):
        return {str(k): encoded(v) for k, v in value.items()}
    return [encoded(v) for v in value]


def json_rows(df: DataFrame) -> Iterator[str]:
    """One JSON object a row, without holding the result."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield json.dumps({k: encoded(v) for k, v in row.asDict(recursive=True).items()}, ensure_ascii=False)


def for_each_batch(df: DataFrame, call: Callable, rows: int = 8192) -> int:
    """Hands the rows to call in batches, partition by partition; the number of rows."""
    held, n = [], 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        n += 1
        if len(held) == rows:
            call(held)
            held = []
    if held:
        call(held)
    return n
