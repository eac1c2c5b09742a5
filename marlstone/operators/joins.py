"""Joins that Spark has no operator for: by range, latest row, top rows per outer row, and NOT IN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(df: DataFrame, name: str) -> Column:
    """A column of numbers, dates or times as a double that keeps its order."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, how: str = "inner", low_strict: bool = False, high_strict: bool = False) -> DataFrame:
    """Rows of left with low <= at <= high of right; at and the bounds are numbers, dates or times.

    A range falls in one block as wide as the next power of two beyond its length, whatever the length, so ranges are never repeated; a point looks
    in its own block and the one before, for each width that ranges have (65 at most). The join is by equal block and shuffles.
    Null bounds match nothing. how: inner, left (of left) or right; right rows without a point have nulls, and so have left rows without a
    range, which are found by their value."""
    lo, hi = _number(right, low), _number(right, high)
    width = F.when(lo <= hi, F.ceil(F.log2(hi - lo + 1)).cast("int") + 1)
    ranges = right.withColumn("_w", width).withColumn("_n", F.floor(lo / F.pow(F.lit(2.0), "_w")))
    widths = right.select(F.collect_set(width)).scalar()
    own = F.floor(_number(left, at) / F.pow(F.lit(2.0), "_w"))
    points = left.withColumn("_w", F.explode(widths)).withColumn("_n", F.explode(F.array(own, own - 1)))
    above = F.col(at) > F.col(low) if low_strict else F.col(at) >= F.col(low)
    below = F.col(at) < F.col(high) if high_strict else F.col(at) <= F.col(high)
    l, r = points.alias("l"), ranges.alias("r")
    joined = l.join(r, (F.col("l._w") == F.col("r._w")) & (F.col("l._n") == F.col("r._n")) & above & below, "right" if how == "right" else "inner")
    joined = joined.select([F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns])
    if how != "left":
        return joined
    lonely = left.join(joined.select(F.col(at).alias("_at")).distinct(), F.col(at) == F.col("_at"), "left_anti")
    return joined.unionByName(lonely, allowMissingColumns=True)


def latest_row(left: DataFrame, right: DataFrame, on: list[str], at: str, by: str, values: list[str]) -> DataFrame:
    """left with values of the row of right, of the same keys, whose by is the latest at or before left's at; null if there is none.

    Both sides are laid end to end and sorted once by key and time, and the last row of right seen so far is carried on: one
    shuffle, no row is repeated, and no key's rows are multiplied. Of rows of right with equal keys and by the largest values win."""
    held = F.struct(F.col(by).alias("_by"), *[F.col(v).alias(v) for v in values])
    tops = right.where(F.col(by).isNotNull()).groupBy(*on, F.col(by).alias("_at")).agg(F.max(held).alias("_held")).withColumn("_side", F.lit(0))
    rows = left.withColumn("_at", F.col(at)).withColumn("_side", F.lit(1))
    both = tops.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy(*on).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.when(F.col("_at").isNotNull(), F.last("_held", ignorenulls=True).over(order)))
    return seen.where("_side = 1").select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def top_rows(left: DataFrame, right: DataFrame, on: list[str], order: list[Column], k: int, how: str = "left") -> DataFrame:
    """For each row of left the k first rows of right with equal keys: rows of right are ranked once a key, before the join."""
    ranked = right.withColumn("_rank", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
    return left.join(ranked, on, how)


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """WHERE column NOT IN (SELECT other ...): nothing if other has a null, no row whose column is null unless right is empty."""
    facts = right.agg(F.count("*").alias("_n"), F.count(F.when(F.col(other).isNull(), 1)).alias("_nulls"))
    kept = left.join(right.select(F.col(other).alias("_other")), F.col(column) == F.col("_other"), "left_anti")
    # One row, whatever the tables.
    return kept.join(F.broadcast(facts)).where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).drop("_n", "_nulls")
