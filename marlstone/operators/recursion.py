"""Recursive queries that keep distinct rows (WITH RECURSIVE ... UNION), which Spark's own recursion lacks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import LimitExceeded
from ..runtime import shared_dir


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """start and all rows that step makes of new rows, each once, until none is new. Every round's new rows are written to the
    shared folder, so plans don't grow and a lost executor repeats one round at most."""
    spark = start.sparkSession
    folder = f"{shared_dir(spark)}/fixpoint-{uuid.uuid4().hex}"

    def kept(df: DataFrame, i: int) -> DataFrame:
        df.write.parquet(f"{folder}/{i}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{i}")

    seen = new = kept(start.distinct(), 0)
    for i in range(1, most + 1):
        new = kept(step(new).toDF(*start.columns).distinct().subtract(seen), i)
        if new.isEmpty():
            return seen
        seen = seen.unionAll(new)
    raise LimitExceeded(f"the recursion didn't end in {most} rounds")
