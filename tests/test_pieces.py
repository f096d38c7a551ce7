"""Customers in pieces of time, of whom one has half of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.config import TxnConfig
from tidemark.functions import pieces, whole_days
from tidemark.operators import clean, rowlevel

CFG = TxnConfig()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    made = [(1 if i % 2 else rng.randint(2, 40), rng.randrange(3_000_000), i, rng.choice([None, None, i * 1.0]), rng.choice([None, i])) for i in range(4000)]
    made += [(2, 5, 5000 + i, None, i) for i in range(30)] + [(99, 7, 6000, None, None), (None, 8, 6001, None, 1), (None, 9, 6002, 2.0, None), (3, None, 6003, None, 4), (3, None, 6004, 1.0, None)]
    df = spark.createDataFrame(made, "customer_id long, minute long, event_id long, a double, b long")
    return df.withColumn("day", F.expr("timestamp_ntz'2014-01-01' + make_interval(0, 0, 0, 0, 0, minute, 0)")).cache()


@pytest.mark.parametrize("cuts", [1, 2, 16, 300])
def test_filling_equals_one_window(spark, rows, cuts):
    w = Window.partitionBy("customer_id").orderBy("day", "event_id")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)) for c in "ab"})
    got = clean.fill_snapshots(rows, CFG, "day", ["a", "b"], tie="event_id", cuts=cuts)
    assert got.columns == rows.columns
    key = lambda df: sorted((r.event_id, str(r.customer_id), r.a, r.b) for r in df.collect())
    assert key(got) == key(want)


@pytest.mark.parametrize("cuts", [1, 2, 16, 300])
def test_gaps_equal_one_window(spark, rows, cuts):
    txn = rows.where("day is not null and customer_id is not null").withColumnRenamed("day", "txn_ts")
    gaps = txn.withColumn("g", whole_days(F.lag("txn_ts").over(Window.partitionBy("customer_id").orderBy("txn_ts")), "txn_ts"))
    want = {r.customer_id: r.g for r in gaps.groupBy("customer_id").agg(F.avg("g").alias("g")).collect()}
    got = {r.customer_id: r.avg_days_between_txn for r in rowlevel.recency(txn, CFG, cuts=cuts).collect()}
    assert got.keys() == want.keys() and all(got[c] == (None if want[c] is None else pytest.approx(want[c])) for c in want)


def test_the_largest_piece_is_bounded(spark, rows):
    """Half of the rows are one customer's; with 16 cuts none of its pieces has more than about a sixteenth of them."""
    sizes = pieces.cut(rows, "day", 16).groupBy("customer_id", pieces.PIECE).count()
    assert sizes.agg(F.max("count")).first()[0] < 2000 / 16 * 1.3
