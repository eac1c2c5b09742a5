"""Aggregates with exact results, orders and nulls as the engine defines them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def exact_sum(x: Column, scale: int = 0) -> Column:
    """Sum as DECIMAL(38, scale): integers don't wrap, and what has no room is an error."""
    return F.sum(x.cast(f"decimal(38,{scale})"))


def exact_avg(x: Column, scale: int = 0) -> Column:
    """The exact sum, turned to DOUBLE once, by the count."""
    return exact_sum(x, scale).cast("double") / F.count(x)


def sum_of_text(text: Column) -> Column:
    """Exact sum of digits in text. Text that isn't a whole number counts as null; one too wide for 38 digits is an error, never dropped."""
    shown = F.trim(text)
    fits = shown.try_cast(WIDE)
    digits = shown.rlike(r"^[+-]?[0-9]+$")
    value = F.when(digits & fits.isNull(), F.raise_error(F.lit("overflow: a number in text has more than 38 digits")).cast(WIDE)).when(digits, fits)
    return F.sum(value)


def guarded(source: Column, value: Column) -> Column:
    """value, or an error where a cast has dropped a source that isn't null."""
    return F.when(source.isNotNull() & value.isNull(), F.raise_error(F.lit("a value was dropped by TRY_CAST beneath an aggregate"))).otherwise(value)


def signed_fold(arms: list[tuple[DataFrame, list[Column], list[Column]]], keys: list[str], sums: list[str], drop_zero: bool = True) -> DataFrame:
    """SELECT keys, SUM(d) ... FROM (arm UNION ALL arm ...) GROUP BY keys [HAVING SUM <> 0].

    An arm is a table, its key expressions and its signed amounts. Amounts are summed exactly in 38 digits. Each task sums its rows
    by key before anything is shuffled."""
    rows = [df.select(*[k.alias(n) for k, n in zip(ks, keys, strict=True)], *[d.cast(WIDE).alias(n) for d, n in zip(ds, sums, strict=True)]) for df, ks, ds in arms]
    folded = reduce(DataFrame.unionAll, rows).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])
    return folded.where(" OR ".join(f"`{n}` <> 0" for n in sums)) if drop_zero else folded


def count_distinct_rows(*columns: Column) -> Column:
    """count(DISTINCT (a, b, ...)): rows with nulls count too."""
    return F.countDistinct(F.struct(*columns))


def ordered_list(x: Column, *order: Column) -> Column:
    """list(x ORDER BY order): nulls of x are kept, nulls of the order come last."""
    keyed = F.struct(*[c for i, o in enumerate(order) for c in (o.isNull().alias(f"n{i}"), o.alias(f"o{i}"))], x.alias("x"))
    return F.transform(F.sort_array(F.collect_list(keyed)), lambda s: s["x"])


def ordered_text(x: Column, separator: str, *order: Column) -> Column:
    """string_agg(x, separator ORDER BY order): nulls are passed over; null if nothing is left."""
    kept = F.filter(ordered_list(x, *order), lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, separator))


def arg_max(x: Column, y: Column) -> Column:
    """The x of the greatest y; rows where either is null are passed over."""
    return F.max_by(x, F.when(x.isNotNull(), y))


def arg_min(x: Column, y: Column) -> Column:
    return F.min_by(x, F.when(x.isNotNull(), y))


def exact_double_sum(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Sum of doubles, correctly rounded and the same in any order; null if there is no value, and as IEEE has it where values are infinite or no numbers.

    A double is a whole number of at most 55 bits times a power of two. The whole numbers are summed in 38 digits for each power, in
    generated code and before the shuffle, so a key has at most some 2,100 sums, and these are put together exactly and rounded once."""
    from pyspark.sql.types import DoubleType, StructType

    from ..functions.exact import WHOLE_BITS, together
    from ..runtime import ship

    ship(df.sparkSession)
    v = F.col("_v")
    plain = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    # One below the logarithm's floor, which may be one too high; halves of the shift, for a whole one may have no double.
    power = F.when(plain & (v != 0), F.floor(F.log2(F.abs(v))) - 1 - WHOLE_BITS).when(plain, 0).cast("int")
    shift = -F.col("_p")
    half = F.floor(shift / 2)
    whole = (v * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), shift - half)).cast("long").cast("decimal(38,0)")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_p", power)
    sums = rows.groupBy(*keys, "_p").agg(F.sum(F.when(F.col("_p").isNotNull(), whole)).alias("_s"), F.sum(F.when(F.col("_p").isNull(), v)).alias("_odd"))
    types = StructType([df.schema[k] for k in keys]).add(out, DoubleType())
    return sums.groupBy(*keys).applyInArrow(together(keys, out), types)
