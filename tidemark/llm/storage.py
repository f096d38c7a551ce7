"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemark.sources.shared import drop, new_path, settle

__all__ = ["drop", "new_path", "settle", "settle_bucketed"]


def settle_bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """As settle, in n buckets of key: what is grouped or joined by key, and more, isn't shuffled again. df should come
    dealt out by key into n partitions. The table's name goes from the catalog at once, its files stay."""
    spark, table = df.sparkSession, f"tidemark_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).sortBy(key).option("path", new_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out
