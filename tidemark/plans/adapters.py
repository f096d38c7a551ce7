"""The library's inputs, derived from the driver's tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import TxnConfig
from tidemark.operators import clean, temporal
from tidemark.sources.io import LOG, RAW

CFG = TxnConfig(cutoff=datetime(2000, 11, 1), balance="balance")
EVENTS = replace(CFG, cutoff=datetime(2024, 1, 25), balance=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("o_custkey").alias("customer_id"), F.col("l_shipdate").alias("txn_ts"), F.when(flag == "A", " d ").when(flag == "R", "Debit").otherwise("C").alias("dc_raw"),
        F.when(flag.isin("A", "R"), -price).otherwise(price).alias("amount"), F.concat(flag, F.lit("-"), F.col("l_linestatus")).alias("channel"),
        F.col("p_type").alias("category"), (price * (1 - F.col("l_discount")) - 30000).alias("balance"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and enriched, dealt out by customer once: every feature group keeps this partitioning."""
    return temporal.add_temporal(clean.clean_transactions(txn_raw(spark, sf_dir), CFG), CFG).repartition("customer_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with times of day; debits are negative amounts, of which there are none."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id"), F.col("ts").alias("txn_ts"), F.col("value").alias("amount"), F.col("event_type").alias("channel"))
    return clean.clean_transactions(rows, EVENTS)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("customer_id"), F.col("ts").alias("snapshot_date"), "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("bal"),
        F.when(F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("long")).alias("k"),
    )


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("c_custkey").alias("customer_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "n_name", "c_name",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions in the three months from the cutoff, of customers that aren't kept for testing."""
    cutoff = F.lit(CFG.cutoff).cast("timestamp_ntz")
    ts = F.col("txn_ts")
    after = txn_raw(spark, sf_dir).where((ts >= cutoff) & (ts < F.lit(datetime(2001, 2, 1)).cast("timestamp_ntz"))).groupBy("customer_id").agg(F.count("*").alias("n"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id")).where("customer_id % 5 <> 0")
    return people.join(after, "customer_id", "left").select("customer_id", F.coalesce("n", F.lit(0)).alias("next_3m_txn_count"))


def test_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id")).where("customer_id % 5 = 0")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.round(F.sum("o_totalprice") / 10000 + 3.3e-8, 4)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(raw.alias(RAW)).withColumn(LOG, F.log1p(F.greatest(F.col(RAW), F.lit(0.0))))
