"""Window forms with cheaper plans than the window itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The k first rows of each group. Spark limits each task's rows to k a group before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def partition_extreme(df: DataFrame, keys: list[str], value: str, least: bool = True) -> DataFrame:
    """Rows whose value is the least (or greatest) of their group, null keys being a group: an aggregate joined back, so no group is sorted."""
    best = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.min if least else F.max)(value).alias("_best"))
    match = F.col(value) == F.col("_best")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(best, match).select(*df.columns)


def last_value_so_far(x: Column, keys: list[Column], order: list[Column]) -> Column:
    """The last x that isn't null up to this row."""
    return F.last(x, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
