"""Weighted rendezvous sharding, with DataFrame functions only.

A record goes to the shard with the largest score -weight / ln(u), where u in (0, 1) is a hash of the record's key and
the shard's number. A score depends on no other shard, so a shard that is added only takes records into itself, and one
that is taken away only gives up its own; shares are proportional to the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a shard in which slots are numbered side by side. Each is sorted by one task.
PARTS = 256


def _score(key: Column, shard: int, weight: float) -> Column:
    """Of 2**53 equal steps in (0, 1), the hash's upper 53 bits choose one."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(-float(weight)) / F.ln(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard, from 0; shards of weight 0 get nothing. All null keys go to one shard."""
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    best = [F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in live]
    return -(F.greatest(*best) if len(best) > 1 else best[0])["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """df with its shard, an int that only the key's value and the weights decide; rows of equal keys stay together."""
    return df.withColumn(out, shard_of(F.col(key), weights).cast("int"))


def number_slots(df: DataFrame, key: str, shard: str = "shard", out: str = "slot", parts: int = PARTS, ties: Sequence[str] = ()) -> DataFrame:
    """df with each row's place in its shard, from 0 without gaps.

    Rows are numbered inside parts of a shard, that hashes of key and ties choose, by key and ties; a part starts where
    those before it end. So no task holds a shard, and a hot key is split as far as the ties tell its rows apart.
    Rows that agree in all of these are numbered in any order. Rows without a shard get no slot and are left out. A
    column named as out is replaced, all others are kept, whatever their names.
    """
    by, longest = [F.col(key), *[F.col(c) for c in ties]], max(map(len, df.columns))
    part, size, s, p, start, place = (f"{'_' * longest}{c}" for c in ("part", "size", "s", "p", "start", "place"))  # no column has these names
    held = df.withColumn(part, F.pmod(F.xxhash64(F.lit("part"), *by), F.lit(parts)).cast("int"))
    sizes = held.groupBy(shard, part).agg(F.count("*").alias(size))  # at most shards x parts rows
    before = F.sum(size).over(Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(shard).alias(s), F.col(part).alias(p), F.coalesce(before, F.lit(0)).alias(start))
    within = F.row_number().over(Window.partitionBy(shard, part).orderBy(*by)) - 1
    numbered = held.withColumn(place, within).join(F.broadcast(starts), (F.col(shard) == F.col(s)) & (F.col(part) == F.col(p)))
    return numbered.withColumn(out, F.col(start) + F.col(place)).select(*[c for c in df.columns if c != out], out)


def op1_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """Documents in equal shards by doc_id alone (law `key`), and where one more shard would put them."""
    text = F.col("text").cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32")
    )
    docs = assign_shards(docs, "doc_id", [1.0] * shards)
    docs = number_slots(docs, "doc_id", ties=["text_crc32", "size"])
    docs = assign_shards(docs, "doc_id", [1.0] * (shards + 1), out="grown_shard")
    return docs.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
