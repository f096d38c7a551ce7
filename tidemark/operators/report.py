"""Risk reports on predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import TxnConfig
from tidemark.functions.quantiles import percentiles
from tidemark.operators.model import global_rank

RAW = "predicted_next_3m_txn_count_raw"
BANDS = ("Dormant", "At Risk", "Active")


def _band(x, low, high):
    return F.when(x <= low, BANDS[0]).when(x <= high, BANDS[1]).when(x > high, BANDS[2])


def risk_bands(preds: DataFrame, low: float = 50, high: float = 145) -> DataFrame:
    """Bands closed on the right."""
    return preds.withColumn("risk_flag", _band(F.col(RAW), F.lit(low), F.lit(high)))


def risk_terciles(preds: DataFrame, cfg: TxnConfig) -> DataFrame:
    """Bands at the 33rd and 66th percentiles; if those are equal, thirds by rank, ties by customer."""
    low, high = percentiles(preds, [F.col(RAW)], [0.33, 0.66])[0] or (None, None)
    if low is None or low < high:
        return risk_bands(preds, low, high)
    n = preds.count()
    ranked = global_rank(preds, RAW, cfg.customer, out="_rank")
    # thirds of the ranks 1..n as linear quantiles cut them
    return ranked.withColumn("risk_flag", _band(F.col("_rank") + 1, F.lit(1 + (n - 1) / 3), F.lit(1 + 2 * (n - 1) / 3))).drop("_rank")


def portfolio(banded: DataFrame) -> DataFrame:
    """S3: customers and their share by band."""
    total = banded.agg(F.count("*").alias("_n"))
    return banded.groupBy("risk_flag").agg(F.count("*").alias("customers")).join(F.broadcast(total)).select("risk_flag", "customers", (F.col("customers") / F.col("_n")).alias("share"))


def histogram(preds: DataFrame, bins: int = 40, exact: bool = True) -> DataFrame:
    """(bin, n, mean) of predictions clipped to [0, 95th percentile]; mean is that of all clipped ones."""
    top = (percentiles(preds, [F.col(RAW)], [0.95])[0] or [None])[0] if exact else preds.agg(F.percentile_approx(RAW, 0.95, 10_000)).first()[0]
    top = top or 0.0
    x = F.least(F.greatest(F.col(RAW), F.lit(0.0)), F.lit(top))
    clipped = preds.select(x.alias("x"))
    mean = clipped.agg(F.avg("x").alias("mean"))
    bin_ = F.least(F.floor(F.col("x") / (top or 1.0) * bins).cast("int") + 1, F.lit(bins))
    return clipped.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).join(F.broadcast(mean))


def lookup(preds: DataFrame, cfg: TxnConfig, text: str) -> DataFrame:
    """S5"""
    return preds.where(F.col(cfg.customer).cast("string") == text.strip())


def outreach(banded: DataFrame, bands: Sequence[str] = BANDS[:2]) -> DataFrame:
    """Customers in the bands, lowest prediction first."""
    return banded.where(F.col("risk_flag").isin(*bands)).orderBy(RAW)
