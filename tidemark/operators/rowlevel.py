"""Features of single transactions, one row per customer (F, G, H, I, K, L): wide conditional aggregates, no joins.

Each group of features is declared by itself; `features` computes all of them in one pass over the transactions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TxnConfig
from tidemark.functions import percentile, pieces, ratio, whole_days
from tidemark.functions.groups import Group, aggregate


def _cutoff(cfg: TxnConfig) -> Column:
    return F.lit(cfg.cutoff).cast("timestamp_ntz")


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def velocity_group(cfg: TxnConfig) -> Group:
    ts, a, aggs = F.col(cfg.timestamp).cast("timestamp_ntz"), F.col("amount_abs"), {}
    start = lambda d: F.timestamp_add("DAY", F.lit(-d), _cutoff(cfg))
    for d in cfg.velocity:
        on = (ts > start(d)) & (ts <= _cutoff(cfg))
        aggs |= {f"vel_{d}d_txn_count": F.count_if(on), f"vel_{d}d_total_amt": _zero(F.sum(F.when(on, a))), f"vel_{d}d_mean_amt": _zero(F.avg(F.when(on, a)))}
        aggs |= {f"vel_{d}d_{s}_count": F.count_if(on & (F.col("debit_credit") == s)) for s in ("debit", "credit")}
    pairs = [(a, b, by) for a, b, by in ((30, 90, 3.0), (7, 30, 4.3), (14, 60, 4.3)) if {a, b} <= set(cfg.velocity)]
    derived = {f"vel_ratio_{a}_{b}": ratio(f"vel_{a}d_txn_count", F.col(f"vel_{b}d_txn_count") / by) for a, b, by in pairs}
    return Group(aggs, derived, seen=(ts > start(max(cfg.velocity))) & (ts <= _cutoff(cfg)))


def velocity(txn: DataFrame, cfg: TxnConfig) -> DataFrame:
    """the last days before the cutoff, its own instant included; customers seen in some window."""
    g = velocity_group(cfg)
    return aggregate(txn.where(g.seen), cfg.customer, [g])


def decay_group(cfg: TxnConfig) -> Group:
    before = F.col(cfg.timestamp) <= _cutoff(cfg)
    days, aggs = F.when(before, whole_days(F.col(cfg.timestamp).cast("timestamp_ntz"), _cutoff(cfg))), {}
    debit = (F.col("debit_credit") == "debit").cast("double")
    for h in cfg.half_lives:
        w = F.exp(F.lit(-math.log(2) / h) * days)  # as SQL reckons it: a ratio of tiny weights shows every last bit
        aggs |= {f"decay{h}d_w_count": F.sum(w), f"decay{h}d_w_amt": _zero(F.sum(w * F.col("amount_abs"))), f"decay{h}d_w_debit": F.sum(w * debit), f"decay{h}d_w_credit": F.sum(w * (1 - debit))}
    more = {f"decay{h}d_dc_ratio": ratio(f"decay{h}d_w_debit", f"decay{h}d_w_credit") for h in cfg.half_lives}
    more |= {f"decay_trend_30_{h}": ratio("decay30d_w_count", f"decay{h}d_w_count") for h in (90, 180) if {30, h} <= set(cfg.half_lives)}
    return Group(aggs, more, seen=before)


def decay(txn: DataFrame, cfg: TxnConfig) -> DataFrame:
    """Sums weighted by one half per half-life, of rows up to the cutoff."""
    g = decay_group(cfg)
    return aggregate(txn.where(g.seen), cfg.customer, [g])


def debit_credit_group(cfg: TxnConfig, exact: bool = True) -> Group:
    aggs = {}
    for side in ("debit", "credit"):
        x, p = F.when(F.col("debit_credit") == side, F.col("amount_abs")), f"dc_{side}"
        stats = {"sum": F.sum(x), "mean": F.avg(x), "std": F.stddev_samp(x), "median": percentile(x, 0.5, exact), "min": F.min(x), "max": F.max(x), "q25": percentile(x, 0.25, exact), "q75": percentile(x, 0.75, exact)}
        aggs |= {f"{p}_count": F.count(x)} | {f"{p}_{k}": _zero(v) for k, v in stats.items()}
    d, c = F.col("dc_debit_count"), F.col("dc_credit_count")
    return Group(aggs, {
        "dc_debit_cv": ratio("dc_debit_std", "dc_debit_mean"), "dc_credit_cv": ratio("dc_credit_std", "dc_credit_mean"), "dc_freq_ratio": ratio(d, c),
        "dc_amount_ratio": ratio("dc_debit_sum", "dc_credit_sum"), "dc_net_flow": F.col("dc_credit_sum") - F.col("dc_debit_sum"), "dc_debit_dominance": ratio(d, d + c),
    })


def debit_credit(txn: DataFrame, cfg: TxnConfig, exact: bool = True) -> DataFrame:
    """H1, H2: distribution of debits and credits, 0 where a customer has none."""
    return aggregate(txn, cfg.customer, [debit_credit_group(cfg, exact)])


def balance_group(cfg: TxnConfig, exact: bool = True) -> Group:
    b = F.expr(f"try_cast(`{cfg.balance}` AS DOUBLE)")
    end = F.when(F.to_date(cfg.timestamp) == F.last_day(cfg.timestamp), b)
    stats = {
        "bal_mean": F.avg(b), "bal_std": F.stddev_samp(b), "bal_min": F.min(b), "bal_max": F.max(b), "bal_median": percentile(b, 0.5, exact),
        "bal_overdraft_freq": F.avg(F.when(b < 0, 1.0).otherwise(0.0)), "bal_eom_mean": F.avg(end), "bal_eom_std": F.stddev_samp(end), "bal_eom_min": F.min(end),
    }
    derived = {"bal_volatility": ratio("bal_std", F.abs("bal_mean")), "bal_range": F.col("bal_max") - F.col("bal_min")}
    return Group({k: _zero(v) for k, v in stats.items()}, derived)


def balance(txn: DataFrame, cfg: TxnConfig, exact: bool = True) -> DataFrame:
    """Trajectory of the balance column and of its values on month ends; without one, customers alone."""
    if not cfg.balance or cfg.balance not in txn.columns:
        return txn.select(cfg.customer).distinct()
    return aggregate(txn, cfg.customer, [balance_group(cfg, exact)])


def with_gap(txn: DataFrame, cfg: TxnConfig, ties: Sequence[str] = ()) -> DataFrame:
    """txn with `_gap`, whole days since the customer's transaction before; rows of one instant in the order of ties."""
    ts = F.col(cfg.timestamp).cast("timestamp_ntz")
    return txn.withColumn("_gap", whole_days(F.lead(ts).over(Window.partitionBy(cfg.customer).orderBy(F.desc(cfg.timestamp), *ties)), ts))


def recency_group(cfg: TxnConfig) -> Group:
    ts = F.col(cfg.timestamp).cast("timestamp_ntz")
    return Group({"days_since_last_txn": whole_days(F.max(ts), _cutoff(cfg)), "customer_tenure_days": whole_days(F.min(ts), _cutoff(cfg)), "avg_days_between_txn": F.avg("_gap")})


def recency(txn: DataFrame, cfg: TxnConfig, cuts: int | None = None) -> DataFrame:
    """K1, K2: whole days since the last and the first transaction, and mean whole days between transactions.

    A customer's rows are worked on in pieces of time (as many as `cuts`): gaps inside a piece are added up there, and those
    between pieces come from their first and last times."""
    ts = F.col(cfg.timestamp).cast("timestamp_ntz")
    rows = pieces.cut(txn.select(cfg.customer, cfg.timestamp), cfg.timestamp, cuts).withColumn("_ts", ts)
    gap = whole_days(F.lag("_ts").over(Window.partitionBy(cfg.customer, pieces.PIECE).orderBy("_ts")), "_ts")
    parts = rows.withColumn("_gap", gap).groupBy(cfg.customer, pieces.PIECE).agg(F.sum("_gap").alias("_inside"), F.count("*").alias("_n"), F.min("_ts").alias("_first"), F.max("_ts").alias("_last"))
    parts = pieces.carried(parts, cfg.customer, {"_before": F.last("_last")}, {})
    total = F.coalesce(F.sum("_inside"), F.lit(0)) + F.coalesce(F.sum(whole_days("_before", "_first")), F.lit(0))
    return parts.groupBy(cfg.customer).agg(
        whole_days(F.max("_last"), _cutoff(cfg)).alias("days_since_last_txn"), whole_days(F.min("_first"), _cutoff(cfg)).alias("customer_tenure_days"), (total / F.nullif(F.sum("_n") - 1, F.lit(0))).alias("avg_days_between_txn")
    )


def skew(x: Column) -> Column:
    """Bias-corrected skewness: null for fewer than three values, 0 without variance."""
    n = F.count(x).cast("double")
    corrected = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.when(F.min(x) == F.max(x), 0.0).otherwise(corrected))


def with_q90(txn: DataFrame, cfg: TxnConfig, exact: bool = True) -> DataFrame:
    """txn with `_q90`, the 90th percentile of the customer's amounts."""
    return txn.withColumn("_q90", percentile(F.col("amount_abs"), 0.9, exact).over(Window.partitionBy(cfg.customer)))


def amounts_group(cfg: TxnConfig, exact: bool = True) -> Group:
    a = F.col("amount_abs")
    return Group({
        "amt_total": _zero(F.sum(a)), "amt_mean": F.avg(a), "amt_median": percentile(a, 0.5, exact), "amt_std": F.stddev_samp(a), "amt_max": F.max(a), "amt_min": F.min(a), "amt_q25": percentile(a, 0.25, exact),
        "amt_q75": percentile(a, 0.75, exact), "amt_q90": F.first("_q90"), "amt_skew": skew(a), "amt_count": F.count(a), "amt_large_frac": F.avg(F.when(a > F.col("_q90"), 1.0).otherwise(0.0)),
    }, {"amt_iqr": F.col("amt_q75") - F.col("amt_q25"), "amt_cv": ratio("amt_std", "amt_mean")})


def amounts(txn: DataFrame, cfg: TxnConfig, exact: bool = True) -> DataFrame:
    """L1-L3: distribution of amounts, and the share of rows above the customer's own 90th percentile."""
    return aggregate(with_q90(txn.select(cfg.customer, "amount_abs"), cfg, exact), cfg.customer, [amounts_group(cfg, exact)])


def features(txn: DataFrame, cfg: TxnConfig, exact: bool = True) -> DataFrame:
    """All groups of this module in one aggregation, over transactions that are dealt out by customer."""
    groups = [velocity_group(cfg), decay_group(cfg), debit_credit_group(cfg, exact), recency_group(cfg), amounts_group(cfg, exact)]
    groups += [balance_group(cfg, exact)] if cfg.balance and cfg.balance in txn.columns else []
    rows = with_gap(txn, cfg, ["amount_abs", "debit_credit"])  # a fixed order, in which sums come out alike in every run
    return aggregate(with_q90(rows, cfg, exact), cfg.customer, groups)
