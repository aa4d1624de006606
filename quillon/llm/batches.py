"""Small helpers of the Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def values(column: pa.Array, at_once: int = 256) -> Iterator[Any]:
    """The column's values as Python objects, a few at a time so that a batch is never held twice."""
    for at in range(0, len(column), at_once):
        yield from column.slice(at, at_once).to_pylist()


def tasks(spark: SparkSession) -> int:
    """Partitions for work whose cost isn't in its bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where a column of df has them, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (n + "_" * k for k in range(len(taken) + 1)) if x.lower() not in taken) for n in names]
