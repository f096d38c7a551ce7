"""Reading inputs and publishing results (A1-A10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import TxnConfig
from tidemark.operators.assemble import in_cohort

RAW, LOG = "predicted_next_3m_txn_count_raw", "predicted_next_3m_txn_count_log1p"
AGGREGATES = ("hist_", "roll", "lag", "mom_", "holiday_")
SEGMENTS = ("pca_", "seg_", "customer_seg")


def read_pruned(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """A1: the wanted columns that the file has; others are never read."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in wanted if c in df.columns])


def cohort_sample(txn: DataFrame, cfg: TxnConfig, percent: int = 30) -> DataFrame:
    """A2: all rows of a fixed share of customers. A sampling operator; nothing uses it unless called."""
    return txn.where(in_cohort(cfg, percent))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """With header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A9, A10"""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_inputs(spark: SparkSession, paths: dict[str, str], cfg: TxnConfig) -> dict[str, DataFrame]:
    """A1-A4: transactions, financials and demographics are Parquet; labels, test ids and the sample are CSV."""
    wanted = [cfg.customer, cfg.timestamp, cfg.amount, *cfg.direction, cfg.channel, cfg.category, *([cfg.balance] if cfg.balance else [])]
    out = {"transactions": read_pruned(spark, paths["transactions"], wanted)}
    out |= {k: spark.read.parquet(paths[k]) for k in ("financials", "demographics") if k in paths}
    csv = {"labels": f"{cfg.customer} string, {cfg.target} bigint", "test_ids": f"{cfg.customer} string", "sample": f"{cfg.customer} string"}
    return out | {k: read_csv(spark, paths[k], s) for k, s in csv.items() if k in paths}


def write_feature_store(df: DataFrame, path: str, by_split: bool = False) -> str:
    """A5"""
    w = df.write.mode("overwrite")
    (w.partitionBy("split") if by_split else w).parquet(path)
    return path


def view_columns(df: DataFrame, cfg: TxnConfig) -> dict[str, list[str]]:
    """Columns of each group's view: id, split and target, and the group's."""
    fixed = [c for c in (cfg.customer, "split", cfg.target) if c in df.columns]
    rest = [c for c in df.columns if c not in fixed]
    return {
        "v_aggregate_features": fixed + [c for c in rest if c.startswith(AGGREGATES)],
        "v_anomaly_features": fixed + [c for c in rest if "anomaly" in c],
        "v_segment_features": fixed + [c for c in rest if c.startswith(SEGMENTS)],
    }


def register_views(df: DataFrame, cfg: TxnConfig) -> None:
    """Features, v_train, v_test, the groups' views and an empty submission."""
    df.createOrReplaceTempView("features")
    for split in ("train", "test"):
        df.where(F.col("split") == split).createOrReplaceTempView(f"v_{split}")
    for name, columns in view_columns(df, cfg).items():
        df.select(*[F.col(f"`{c}`") for c in columns]).createOrReplaceTempView(name)
    df.where("split = 'test'").select(cfg.customer, F.lit(0.0).alias(cfg.target)).createOrReplaceTempView("v_submission_ready")


def publish_predictions(preds: DataFrame, path: str, cfg: TxnConfig) -> DataFrame:
    """Checked, written as Parquet and CSV, and shown by v_submission_ready."""
    missing = [c for c in (cfg.customer, RAW, LOG) if c not in preds.columns]
    if missing:
        raise ValueError(f"predictions lack {missing}")
    preds.write.mode("overwrite").parquet(f"{path}/predictions.parquet")
    write_csv(preds, f"{path}/predictions.csv")
    stored = preds.sparkSession.read.parquet(f"{path}/predictions.parquet")
    stored.select(cfg.customer, F.col(LOG).alias(cfg.target)).createOrReplaceTempView("v_submission_ready")
    return stored


def build_submission(preds: DataFrame, sample: DataFrame, cfg: TxnConfig) -> DataFrame:
    """log1p of the floored prediction for every id of the sample, 0 where there is none."""
    value = preds.select(cfg.customer, F.log1p(F.greatest(F.col(RAW), F.lit(0.0))).alias(cfg.target))
    return sample.select(cfg.customer).join(value, cfg.customer, "left").withColumn(cfg.target, F.coalesce(cfg.target, F.lit(0.0)))


def check_submission(submission: DataFrame, sample: DataFrame, cfg: TxnConfig) -> None:
    """Raises unless the submission has as many rows as the sample and no nulls."""
    n, nulls = submission.agg(F.count("*"), F.count_if(F.col(cfg.target).isNull() | F.col(cfg.customer).isNull())).first()
    if n != sample.count() or nulls:
        raise ValueError(f"submission has {n} rows, {nulls} of them with nulls")
