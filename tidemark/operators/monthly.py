"""Monthly table and what is derived from it (D1, D2, E1-E15). Everything groups by customer or customer and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TxnConfig
from tidemark.functions import over, percentile, ratio
from tidemark.functions.groups import Group, aggregate


def monthly_table(txn: DataFrame, cfg: TxnConfig, dense_months: bool = False) -> DataFrame:
    """One row per customer and month with a transaction; with dense_months also the months between, counted as zero."""
    c, a = cfg.customer, F.col("amount_abs")
    debit, credit = F.col("debit_credit") == "debit", F.col("debit_credit") != "debit"
    zero = F.lit(0.0)
    m = txn.groupBy(c, "ym").agg(
        F.count("*").alias("monthly_txn_count"), F.coalesce(F.sum(a), zero).alias("monthly_total_amt"), F.avg(a).alias("monthly_mean_amt"),
        F.max(a).alias("monthly_max_amt"), F.min(a).alias("monthly_min_amt"), F.stddev_samp(a).alias("monthly_std_amt"),
        F.count_if(debit).alias("monthly_debit_cnt"), F.count_if(credit).alias("monthly_credit_cnt"),
        F.sum("txn_is_weekend").alias("monthly_weekend_cnt"), F.sum("txn_is_sa_holiday").alias("monthly_holiday_cnt"),
        F.coalesce(F.sum(F.when(debit, a)), zero).alias("monthly_debit_sum"), F.coalesce(F.sum(F.when(credit, a)), zero).alias("monthly_credit_sum"),
        F.coalesce(F.avg(F.when(debit & (a > 0), a)), zero).alias("monthly_debit_mean"), F.coalesce(F.avg(F.when(credit & (a > 0), a)), zero).alias("monthly_credit_mean"),
    )
    if dense_months:
        spine = m.groupBy(c).agg(F.explode(F.sequence(F.min("ym"), F.max("ym"), F.expr("interval 1 month"))).alias("ym"))
        counted = [n for n, t in m.dtypes if t in ("bigint",)] + ["monthly_total_amt", "monthly_debit_sum", "monthly_credit_sum", "monthly_debit_mean", "monthly_credit_mean"]
        m = spine.join(m, [c, "ym"], "left").fillna(0, [n for n in counted if n != c])
    n = F.col("monthly_txn_count")
    return m.withColumns({
        "debit_credit_ratio": F.when(F.col("monthly_credit_cnt") > 0, F.col("monthly_debit_cnt") / F.nullif(F.col("monthly_credit_cnt"), F.lit(0))),
        "debit_credit_amount_ratio": F.when(F.col("monthly_credit_sum") > 0, over("monthly_debit_sum", "monthly_credit_sum")),
        "weekend_txn_frac": ratio("monthly_weekend_cnt", n), "holiday_txn_frac_monthly": ratio("monthly_holiday_cnt", n),
        "amt_cv": ratio("monthly_std_amt", "monthly_mean_amt"), "net_flow": F.col("monthly_credit_sum") - F.col("monthly_debit_sum"),
    })


def months_back(cfg: TxnConfig, n: int) -> Column:
    """First day of the month n months before the cutoff's."""
    return F.add_months(F.trunc(F.lit(cfg.cutoff).cast("timestamp_ntz"), "MM"), -n)


def history_group(cfg: TxnConfig) -> Group:
    n, amt = "monthly_txn_count", "monthly_total_amt"
    return Group({
        "hist_months_active": F.count("ym"), "hist_total_txn": F.sum(n), "hist_mean_monthly_txn": F.avg(n), "hist_std_monthly_txn": F.stddev_samp(n), "hist_median_monthly_txn": percentile(n, 0.5),
        "hist_max_monthly_txn": F.max(n), "hist_min_monthly_txn": F.min(n), "hist_q75_monthly_txn": percentile(n, 0.75), "hist_q25_monthly_txn": percentile(n, 0.25),
        "hist_total_amount": F.sum(amt), "hist_mean_amount": F.avg(amt), "hist_std_amount": F.stddev_samp(amt), "hist_max_amount": F.max(amt),
        "hist_mean_debit_ratio": F.avg("debit_credit_ratio"), "hist_std_debit_ratio": F.stddev_samp("debit_credit_ratio"),
        "hist_mean_weekend_frac": F.avg("weekend_txn_frac"), "hist_mean_holiday_frac": F.avg("holiday_txn_frac_monthly"), "hist_mean_amt_cv": F.avg("amt_cv"), "hist_zero_months": F.count_if(F.col(n) == 0),
        "hist_total_debit_sum": F.sum("monthly_debit_sum"), "hist_total_credit_sum": F.sum("monthly_credit_sum"), "hist_mean_debit_sum": F.avg("monthly_debit_sum"), "hist_mean_credit_sum": F.avg("monthly_credit_sum"),
        "hist_mean_net_flow": F.avg("net_flow"), "hist_std_net_flow": F.stddev_samp("net_flow"),
    }, {
        "hist_cv_txn": ratio("hist_std_monthly_txn", "hist_mean_monthly_txn"), "hist_iqr_txn": F.col("hist_q75_monthly_txn") - F.col("hist_q25_monthly_txn"),
        "hist_activity_rate": ratio(F.col("hist_months_active") - F.col("hist_zero_months"), "hist_months_active"),
        "hist_amount_per_txn": ratio("hist_total_amount", "hist_total_txn"), "hist_debit_credit_amount_ratio": ratio("hist_total_debit_sum", "hist_total_credit_sum"),
        "hist_txn_cv": ratio("hist_std_monthly_txn", "hist_mean_monthly_txn"),
    })


def history(m: DataFrame, cfg: TxnConfig) -> DataFrame:
    """Aggregates over all months, of which a customer has one row each."""
    return aggregate(m, cfg.customer, [history_group(cfg)])


#: name -> (column, aggregate) of a rolling window
ROLLED = {
    "txn_count": ("monthly_txn_count", F.sum), "mean_txn": ("monthly_txn_count", F.avg), "std_txn": ("monthly_txn_count", F.stddev_samp), "max_txn": ("monthly_txn_count", F.max),
    "total_amt": ("monthly_total_amt", F.sum), "mean_amt": ("monthly_total_amt", F.avg), "debit_ratio": ("debit_credit_ratio", F.avg), "weekend_frac": ("weekend_txn_frac", F.avg),
    "debit_sum": ("monthly_debit_sum", F.sum), "credit_sum": ("monthly_credit_sum", F.sum), "net_flow": ("net_flow", F.sum), "debit_cnt": ("monthly_debit_cnt", F.sum), "credit_cnt": ("monthly_credit_cnt", F.sum),
}
LAGGED = {"txn": "monthly_txn_count", "amt": "monthly_total_amt", "debit_ratio": "debit_credit_ratio", "mean_amt": "monthly_mean_amt", "debit_sum": "monthly_debit_sum", "credit_sum": "monthly_credit_sum", "net_flow": "net_flow"}


def windows_group(cfg: TxnConfig) -> Group:
    """Conditional aggregates for all rolling windows and lags: no join. A window of n months has n + 1."""
    now, aggs = months_back(cfg, 0), {}
    for n in cfg.rolling:
        inside = F.col("ym").between(months_back(cfg, n), now)
        aggs |= {f"roll{n}m_{name}": f(F.when(inside, F.col(c))) for name, (c, f) in ROLLED.items()}
    for k in cfg.lags:
        there = F.col("ym") == months_back(cfg, k - 1)
        aggs |= {f"lag{k}m_{name}": F.max(F.when(there, F.col(c))) for name, c in LAGGED.items()}
    more = {f"roll{n}m_dc_amt_ratio": ratio(f"roll{n}m_debit_sum", f"roll{n}m_credit_sum") for n in cfg.rolling}
    one, two, three = (F.col(f"lag{k}m_txn") for k in (1, 2, 3))
    more["mom_txn_growth"] = over(one - two, two)
    more["mom_amt_growth"] = over(F.col("lag1m_amt") - F.col("lag2m_amt"), "lag2m_amt")
    more["growth_3m_vs_6m"] = over("roll3m_txn_count", F.col("roll6m_txn_count") / 2)
    more["trend_1m_vs_3m"] = over("roll1m_txn_count", "roll3m_mean_txn")
    more["txn_acceleration"] = (one - two) - (two - three)
    return Group(aggs, more)


def windows(m: DataFrame, cfg: TxnConfig) -> DataFrame:
    """Rolling months, lags, growth, trends and acceleration."""
    return aggregate(m, cfg.customer, [windows_group(cfg)])


def seasons_group(cfg: TxnConfig) -> Group:
    n, month = F.col("monthly_txn_count"), F.month("ym")
    aggs = {"hist_mean_yearly_txn": F.sum(n) / F.size(F.collect_set(F.year("ym"))), "_mean": F.avg(n)}
    for k, name in ((11, "nov"), (12, "dec"), (1, "jan")):
        x = lambda c, k=k: F.when(month == k, F.col(c))
        aggs |= {f"hist_{name}_mean_txn": F.avg(x("monthly_txn_count")), f"hist_{name}_std_txn": F.stddev_samp(x("monthly_txn_count")), f"hist_{name}_max_txn": F.max(x("monthly_txn_count"))}
        aggs |= {f"hist_{name}_mean_amt": F.avg(x("monthly_total_amt")), f"hist_{name}_mean_debit": F.avg(x("monthly_debit_sum")), f"hist_{name}_mean_credit": F.avg(x("monthly_credit_sum"))}
    festive, q4 = month.isin(12, 1), month.isin(10, 11, 12)
    zero = lambda x: F.coalesce(x, F.lit(0))
    aggs |= {"festive_mean_txn": zero(F.avg(F.when(festive, n))), "festive_total_txn": zero(F.sum(F.when(festive, n))), "festive_mean_amt": zero(F.avg(F.when(festive, F.col("monthly_total_amt"))))}
    aggs |= {"hist_q4_mean_txn": zero(F.avg(F.when(q4, n))), "hist_q4_total_txn": zero(F.sum(F.when(q4, n)))}
    more = {"dec_spike_ratio": ratio("hist_dec_mean_txn", "_mean"), "dec_yearly_ratio": ratio(F.col("hist_dec_mean_txn") * 12, "hist_mean_yearly_txn"), "nov_dec_ratio": ratio("hist_dec_mean_txn", "hist_nov_mean_txn")}
    return Group(aggs, more, hidden=("_mean",))


def seasons(m: DataFrame, cfg: TxnConfig) -> DataFrame:
    """Yearly mean, November, December, January, festive and fourth-quarter features."""
    return aggregate(m, cfg.customer, [seasons_group(cfg)])


def with_runs(m: DataFrame, cfg: TxnConfig) -> DataFrame:
    """m with the length of each month's run of months with or without transactions, and its rank by count."""
    c, n = cfg.customer, F.col("monthly_txn_count")
    by = Window.partitionBy(c)
    ranked = m.withColumn("_on", n > 0).withColumns({
        "_island": F.row_number().over(by.orderBy("ym")) - F.row_number().over(Window.partitionBy(c, "_on").orderBy("ym")),
        "_rank": F.row_number().over(by.orderBy(n)), "_n": F.count("*").over(by), "_sum": F.sum(n).over(by),
    })
    return ranked.withColumn("_run", F.count("*").over(Window.partitionBy(c, "_on", "_island")))


def streaks_group(cfg: TxnConfig) -> Group:
    n = F.col("monthly_txn_count")
    gini = F.sum((2 * F.col("_rank") - F.col("_n") - 1) * n) / F.nullif(F.first("_n") * F.first("_sum"), F.lit(0))
    longest = lambda on: F.coalesce(F.max(F.when(on, F.col("_run"))), F.lit(0))
    return Group({"streak_longest_active": longest(F.col("_on")), "streak_longest_inactive": longest(~F.col("_on")), "consistency_gini": F.coalesce(gini, F.lit(0.0))})


def streaks(m: DataFrame, cfg: TxnConfig) -> DataFrame:
    """Longest runs of months with and without transactions, and the Gini coefficient of the counts."""
    return aggregate(with_runs(m.select(cfg.customer, "ym", "monthly_txn_count"), cfg), cfg.customer, [streaks_group(cfg)])


def customer_aggregates(m: DataFrame, cfg: TxnConfig) -> DataFrame:
    """All features of the monthly table in one aggregation, one row per customer."""
    return aggregate(with_runs(m, cfg), cfg.customer, [history_group(cfg), windows_group(cfg), seasons_group(cfg), streaks_group(cfg)])
