"""Columns computed on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def with_arrow(df: DataFrame, made: dict[str, T.DataType], fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and the columns that fn makes of each batch; a column of the same name is replaced."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(k, v) for k, v in made.items()])

    def run(batches):
        for batch in batches:
            new = fn(batch)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [new[k] for k in made], names=[*kept, *made])

    return df.mapInArrow(run, schema)
