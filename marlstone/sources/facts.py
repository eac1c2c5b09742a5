"""Fact tables: sealed segments and live rows by name, with declared columns and a window of blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError

_WIDER = {("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double")}


def merged_schema(frames: list[DataFrame]) -> dict[str, str]:
    """Columns of all frames by name, of the wider of two integer types; other differences are refused."""
    found: dict[str, str] = {}
    for df in frames:
        for name, kind in df.dtypes:
            old = found.get(name, kind)
            if old != kind and (old, kind) not in _WIDER and (kind, old) not in _WIDER:
                raise PlanError(f"column {name} is {old} in one segment and {kind} in another")
            found[name] = kind if (old, kind) in _WIDER else old
    return found


def union_segments(frames: list[DataFrame]) -> DataFrame:
    """All segments as one table; a segment without a column has nulls there."""
    kinds = merged_schema(frames)
    alike = [df.select(*[F.col(f"`{n}`").cast(k).alias(n) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]) for df in frames]
    return reduce(DataFrame.unionAll, alike)


def facts(cold: DataFrame | None, hot: DataFrame | None, declared: dict[str, str], block: str, after: int | None = None, through: int | None = None) -> DataFrame:
    """Sealed and live rows by name. Declared columns that neither side has are null. With a window, only blocks in (after, through]
    stay, and a row without a block is an error: it can't be placed in or out of the window."""
    sides = [df for df in (cold, hot) if df is not None]
    if not sides:
        raise PlanError("a fact table needs sealed or live rows")
    whole = union_segments(sides)
    for name, kind in declared.items():
        if name not in whole.columns:
            whole = whole.withColumn(name, F.lit(None).cast(kind))
    if after is None and through is None:
        return whole
    stamp = F.coalesce(F.col(block), F.raise_error(F.lit("a row without a block in a window of blocks")).cast("bigint"))
    if after is not None:
        whole = whole.where(stamp > after)
    return whole.where(stamp <= through) if through is not None else whole


def text_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small table of text from rows as dictionaries; what isn't text becomes text, a missing key null."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    data = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names) or "empty string")


def widened(df: DataFrame, columns: list[str]) -> DataFrame:
    """Beside each column of digits c: c_dec, its number where 38 digits hold it, and c_overflow, whether it has a value that c_dec lacks."""
    extra = {}
    for c in columns:
        number = F.col(c).try_cast("decimal(38,0)")
        extra |= {f"{c}_dec": number, f"{c}_overflow": F.col(c).isNotNull() & number.isNull()}
    return df.withColumns(extra)
