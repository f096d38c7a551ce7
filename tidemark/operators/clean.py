"""Cleaning of transactions, snapshots and demographics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEBIT_TOKENS, TxnConfig
from tidemark.functions import pieces
from tidemark.functions.quantiles import percentiles
from tidemark.sources.shared import settle


def to_time(df: DataFrame, name: str) -> Column:
    """A timestamp column as it is; text is parsed, what can't be is null."""
    kind = dict(df.dtypes)[name]
    return F.col(name) if kind.startswith("timestamp") else F.try_to_timestamp(F.col(name).cast("string")).cast("timestamp_ntz")


def clean_transactions(txn: DataFrame, cfg: TxnConfig) -> DataFrame:
    """Rows with a readable time and a customer; amount_abs, and debit_credit from the direction column, else the sign."""
    direction = next((c for c in cfg.direction if c in txn.columns), None)
    amount = F.expr(f"try_cast(`{cfg.amount}` AS DOUBLE)") if cfg.amount in txn.columns else F.lit(None).cast("double")
    if direction:
        debit = F.upper(F.trim(F.col(direction).cast("string"))).isin(*DEBIT_TOKENS)
    else:
        debit = amount < 0
    side = F.when(debit, "debit").otherwise("credit")
    out = txn.withColumns({cfg.timestamp: to_time(txn, cfg.timestamp), "debit_credit": side, "amount_abs": F.abs(amount)})
    out = out.where(F.col(cfg.timestamp).isNotNull() & F.col(cfg.customer).isNotNull())
    gone = {cfg.amount, *cfg.direction, *cfg.drop} - {cfg.customer, cfg.timestamp, cfg.balance}
    return out.drop(*[c for c in gone if c in out.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row: one aggregate over all rows."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if counts[f"n{i}"]])


def fill_snapshots(snap: DataFrame, cfg: TxnConfig, date: str, columns: Sequence[str], tie: str | None = None, cuts: int | None = None) -> DataFrame:
    """Nulls take the customer's last value before, by date (and tie), else the first one after.

    A customer's rows are worked on in pieces of time (as many as `cuts`): values fill inside a piece, and the last and first
    ones of other pieces are carried over. Rows of equal date and tie are in any order."""
    if not columns:
        return snap
    rows = settle(pieces.cut(snap, date, cuts), "pieces")  # read once for the ends and once for the values
    order = [F.col(date)] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy(cfg.customer, pieces.PIECE).orderBy(*order)
    upto, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.struct(*order)
    ends = {f"_{n}{i}": f(F.col(c), F.when(F.col(c).isNotNull(), at)) for i, c in enumerate(columns) for n, f in (("last", F.max_by), ("first", F.min_by))}
    parts = rows.groupBy(cfg.customer, pieces.PIECE).agg(*[x.alias(n) for n, x in ends.items()])
    over = lambda n, f: {f"_{n}{i}": f(f"_{n}{i}", ignorenulls=True) for i in range(len(columns))}
    # the customer is null in both or equal, as it is in a window
    parts = pieces.carried(parts, cfg.customer, over("last", F.last), over("first", F.first)).withColumnsRenamed({cfg.customer: "_of", pieces.PIECE: "_at"})
    filled = rows.withColumns({f"_upto{i}": F.last(c, ignorenulls=True).over(upto) for i, c in enumerate(columns)} | {f"_on{i}": F.first(c, ignorenulls=True).over(on) for i, c in enumerate(columns)})
    joined = filled.join(parts, F.col(cfg.customer).eqNullSafe(F.col("_of")) & (F.col(pieces.PIECE) == F.col("_at")))
    made = {c: F.coalesce(*[F.col(f"_{n}{i}") for n in ("upto", "last", "on", "first")]) for i, c in enumerate(columns)}
    return joined.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in snap.columns])


def clean_snapshots(snap: DataFrame, cfg: TxnConfig, date: str, tie: str | None = None) -> DataFrame:
    """Date columns parsed, text in numeric columns nulled, then filled."""
    kinds = dict(snap.dtypes)
    dates = [c for c in snap.columns if "date" in c.lower()]
    snap = snap.withColumns({c: to_time(snap, c) for c in dates})
    values = [c for c in snap.columns if c not in (cfg.customer, date, tie, *dates) and kinds[c] != "string"]
    return fill_snapshots(snap, cfg, date, values, tie)


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's exact median; a column without values stays null."""
    if not columns:
        return df
    medians = [q and q[0] for q in percentiles(df, [F.col(f"`{c}`") for c in columns], [0.5])]
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m).cast("double")) for c, m in zip(columns, medians, strict=True)})


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """`{column}_enc`: rank in alphabetical order from 0, null as "Unknown". For few values: the code table is broadcast."""
    value = F.coalesce(F.col(column), F.lit("Unknown"))
    values = df.select(value.alias("_v")).distinct()
    codes = values.withColumn(f"{column}_enc", (F.dense_rank().over(Window.orderBy("_v")) - 1).cast("int"))
    return df.join(F.broadcast(codes), value == F.col("_v"), "left").drop("_v", column)


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    """`{column}_freq_enc`: share of the value among non-null rows, 0 for null."""
    total = df.agg(F.count(column)).first()[0]
    shares = df.where(F.col(column).isNotNull()).groupBy(column).agg((F.count("*") / F.lit(float(max(total, 1)))).alias(f"{column}_freq_enc"))
    return df.join(shares, column, "left").fillna(0.0, [f"{column}_freq_enc"]).drop(column)


def clean_demographics(demo: DataFrame, cfg: TxnConfig, max_levels: int = 30) -> DataFrame:
    """Numeric columns imputed; texts of at most max_levels values label-encoded, others frequency-encoded."""
    kinds = dict(demo.dtypes)
    numbers = [c for c in demo.columns if c != cfg.customer and kinds[c] != "string"]
    texts = [c for c in demo.columns if c != cfg.customer and kinds[c] == "string"]
    demo = impute_median(demo, numbers)
    levels = demo.agg(*[F.count_distinct(c).alias(c) for c in texts]).first() if texts else {}
    for c in texts:
        demo = label_encode(demo, c) if levels[c] <= max_levels else frequency_encode(demo, c)
    return demo
