"""Host functions over text: null in gives null out, an exception refuses the statement. Values cross in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def text_function(f: Callable[..., str | None], arity: int):
    """A Column function from a Python function of arity texts."""

    @pandas_udf("string")
    def call(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

    def apply(*columns):
        if len(columns) != arity:
            raise TypeError(f"the function takes {arity} texts")
        return call(*columns)

    apply.udf = call
    return apply


def register_text_function(spark: SparkSession, name: str, arity: int, f: Callable[..., str | None]) -> None:
    """Makes f callable from SQL by that name."""
    spark.udf.register(name, text_function(f, arity).udf)
