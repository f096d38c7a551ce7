"""Calendar columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import TxnConfig
from tidemark.functions import whole_days


def is_holiday(ts: Column, cfg: TxnConfig) -> Column:
    day = F.date_format(ts, "MM-dd")
    tests = [(day >= a) & (day <= b) if a <= b else (day >= a) | (day <= b) for a, b in cfg.holidays]
    return reduce(lambda x, y: x | y, tests, F.lit(False)).cast("int")


def add_temporal(txn: DataFrame, cfg: TxnConfig) -> DataFrame:
    """txn with 16 calendar columns; Monday is day 0, ym the first day of the month."""
    ts = F.col(cfg.timestamp)
    turn = lambda x, n: F.lit(2 * math.pi) * x / F.lit(float(n))
    return txn.withColumns({
        "txn_year": F.year(ts), "txn_month": F.month(ts), "txn_quarter": F.quarter(ts), "txn_dayofweek": F.weekday(ts), "txn_day": F.dayofmonth(ts),
        "txn_is_weekend": (F.weekday(ts) >= 5).cast("int"), "txn_is_month_start": (F.dayofmonth(ts) == 1).cast("int"),
        "txn_is_month_end": (F.to_date(ts) == F.last_day(ts)).cast("int"), "txn_is_sa_holiday": is_holiday(ts, cfg),
        "txn_month_sin": F.sin(turn(F.month(ts), 12)), "txn_month_cos": F.cos(turn(F.month(ts), 12)),
        "txn_quarter_sin": F.sin(turn(F.quarter(ts), 4)), "txn_quarter_cos": F.cos(turn(F.quarter(ts), 4)),
        "days_since_start": whole_days(F.lit(cfg.origin).cast("timestamp_ntz"), ts.cast("timestamp_ntz")), "ym": F.trunc(ts, "MM"),
        "days_to_month_end": F.dayofmonth(F.last_day(ts)) - F.dayofmonth(ts),
    })
