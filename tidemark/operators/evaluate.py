"""Errors and diagnostic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import TxnConfig


def errors(df: DataFrame, y: str, p: str, by: str | None = None) -> DataFrame:
    """N, rmsle (predictions floored at 0), rmse, mae; of all rows or by a column."""
    d = F.col(y) - F.col(p)
    log = F.log1p(y) - F.log1p(F.greatest(F.col(p), F.lit(0.0)))
    aggs = [F.count("*").alias("n"), F.sqrt(F.avg(log * log)).alias("rmsle"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae")]
    return (df.groupBy(by) if by else df.groupBy()).agg(*aggs)


def out_of_fold(df: DataFrame, y: str = "y", p: str = "p", active: str | None = None) -> DataFrame:
    """Q7: errors of each fold and of all validated rows (`fold` null), with the probability of activity as factor if given."""
    rows = df.where("fold > 0").withColumn("_p", F.col(p) * F.col(active) if active else F.col(p))
    return errors(rows, y, "_p", by="fold").unionByName(errors(rows, y, "_p").withColumn("fold", F.lit(None).cast("int")))


def cv_table(xgb: DataFrame, lgb: DataFrame) -> DataFrame:
    """R2: one row a fold, both kinds' rmsle and rmse."""
    parts = [errors(x, "y", "p", by="fold").select("fold", F.col("rmsle").alias(f"{k}_rmsle"), F.col("rmse").alias(f"{k}_rmse")) for k, x in (("xgb", xgb), ("lgb", lgb))]
    return parts[0].join(parts[1], "fold").select("fold", "xgb_rmsle", "lgb_rmsle", "xgb_rmse", "lgb_rmse")


def cv_summary(table: DataFrame) -> DataFrame:
    """R2: mean and sample deviation over folds."""
    names = [c for c in table.columns if c != "fold"]
    return table.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def importance_table(df: DataFrame, cfg: TxnConfig) -> DataFrame:
    """Feature, xgb_imp, lgb_imp and their weighted mean, largest first."""
    w = cfg.weights
    return df.withColumn("avg_imp", F.col("xgb_imp") * w["xgb"] + F.col("lgb_imp") * w["lgb"]).orderBy(F.desc("avg_imp"), "feature")


def top_features(importance: DataFrame, k: int = 15) -> DataFrame:
    """A top-k report."""
    return importance.orderBy(F.desc("avg_imp"), "feature").limit(k)


def segment_counts(df: DataFrame) -> DataFrame:
    """S7"""
    return df.groupBy("customer_segment").agg(F.count("*").alias("customers")).orderBy("customer_segment")


def residual_histogram(df: DataFrame, y: str = "y", p: str = "p", bins: int = 60) -> DataFrame:
    """(bin, n) of actual minus predicted, over [min, max]; the largest falls into the last bin."""
    d = F.col(y).cast("double") - F.col(p).cast("double")
    lo, hi = df.agg(F.min(d), F.max(d)).first()
    if lo is None:
        return df.select(F.lit(1).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    bin_ = F.least(F.floor((d - lo) / ((hi - lo) or 1.0) * bins).cast("int") + 1, F.lit(bins))
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def pair_density(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """How many rows have an actual and a predicted value in each cell of a grid, with the least and largest of both.

    Cells are fixed: 0 holds what is below 1, and each doubling is cut into four, so one aggregation finds the counts and
    the ranges, and densities of parts of the data add up. At most about 250 cells a side; rows with a null aren't counted.
    """

    def cell(x):
        whole = F.greatest(F.floor(x), F.lit(1)).cast("long")
        power = F.length(F.bin(whole)) - 1
        return F.when(x < 1, 0).otherwise(4 * power + F.floor((x / F.pow(F.lit(2.0), power) - 1) * 4) + 1).cast("int")

    rows = df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).where("y is not null and p is not null")
    ranges = [f(c).alias(f"{n}_{c}") for c in ("y", "p") for n, f in (("least", F.min), ("largest", F.max))]
    return rows.groupBy(cell(F.col("y")).alias("y_cell"), cell(F.col("p")).alias("p_cell")).agg(F.count("*").alias("n"), *ranges)
