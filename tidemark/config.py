"""One configuration for all operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

# Month-day windows of public holidays, inclusive; a window may wrap the year's end.
HOLIDAYS = (
    ("12-01", "01-15"),
    ("03-21", "03-21"),
    ("04-27", "04-27"),
    ("05-01", "05-01"),
    ("06-16", "06-16"),
    ("08-09", "08-09"),
    ("09-24", "09-24"),
    ("12-16", "12-16"),
    ("12-25", "12-26"),
)

# Texts that mean a debit; everything else, and null, is a credit.
DEBIT_TOKENS = ("D", "DEBIT", "-1", "DR", "1", "TRUE", "YES")


@dataclass(frozen=True)
class TxnConfig:
    customer: str = "customer_id"
    timestamp: str = "txn_ts"
    amount: str = "amount"
    direction: tuple[str, ...] = ("dc_raw", "DebitCredit")  # the first that is present counts
    channel: str = "channel"
    category: str = "category"
    balance: str | None = None
    drop: tuple[str, ...] = ()
    cutoff: datetime = datetime(2015, 11, 1)
    origin: datetime = datetime(2012, 12, 1)
    holidays: tuple[tuple[str, str], ...] = HOLIDAYS
    rolling: tuple[int, ...] = (1, 3, 6, 12)  # months
    lags: tuple[int, ...] = (1, 2, 3, 6, 12)  # months
    velocity: tuple[int, ...] = (7, 14, 30, 60, 90)  # days
    half_lives: tuple[int, ...] = (30, 90, 180)  # days
    clusters: int = 5
    components: int = 10
    contamination: float = 0.05
    trees: int = 100
    seed: int = 42
    folds: int = 5
    least_train: float = 0.5
    weights: dict[str, float] = field(default_factory=lambda: {"xgb": 0.5, "lgb": 0.5})
    target: str = "next_3m_txn_count"
