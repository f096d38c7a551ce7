"""Percentiles by narrowing, k-means with all restarts together, isolation trees grown in tasks, and fused groups."""

import math
import os
import random
from dataclasses import replace
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import TxnConfig
from tidemark.functions import quantiles
from tidemark.functions.groups import Group, aggregate
from tidemark.operators import categories, clean, matrix, rowlevel, temporal

CFG = TxnConfig(clusters=3, trees=20)


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_percentiles_equal_sql(spark, monkeypatch, few):
    """Ties, nulls, both signs, tiny and huge values, integers, empty columns; with and without reading ranges out."""
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(few)
    rows = [(rng.choice([None, 0.0, -0.0, 1.5, 1.5, 7.0]), rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300), rng.randint(-5, 5), None, rng.choice([math.inf, -math.inf, 5e-324, -5e-324, 1.0])) for _ in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, e double").repartition(5)
    shares = [0.0, 0.25, 0.33, 0.5, 0.66, 0.95, 1.0]
    want = df.agg(*[F.percentile(c, shares) for c in "abcd"]).first()
    got = quantiles.percentiles(df, [F.col(c) for c in "abcd"], shares)
    assert got[3] is None
    for g, w in zip(got[:3], want[:3], strict=True):
        assert g == pytest.approx(w, rel=1e-12)
    order = sorted(r[4] for r in rows)
    assert quantiles.percentiles(df, [F.col("e")], [0.0, 1.0])[0] == [order[0], order[-1]]
    assert quantiles.percentiles(df.limit(0), [F.col("a")], shares) == [None] and quantiles.percentiles(df, [], shares) == []


def test_impute_median_of_odd_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, 4.0, None), (3, 1.0, None)], "customer_id long, `a.b` double, none double")
    assert sorted(tuple(r) for r in clean.impute_median(df, ["a.b", "none"]).collect()) == [(1, 2.5, None), (2, 4.0, None), (3, 1.0, None)]


def test_kmeans_finds_separate_groups(spark):
    rng = random.Random(1)
    at = {0: (0.0, 0.0), 1: (10.0, 0.0), 2: (0.0, 30.0)}
    rows = [(i, at[i % 3][0] + rng.gauss(0, 0.5), at[i % 3][1] + rng.gauss(0, 0.5)) for i in range(300)]
    got = matrix.kmeans(spark.createDataFrame(rows, "customer_id long, x double, y double"), CFG, ["x", "y"]).collect()
    assert all(r.customer_segment == r.customer_id % 3 for r in got)
    for s in range(3):
        mine = np.array([(r.x, r.y) for r in got if r.customer_segment == s])
        far = np.linalg.norm(mine - mine.mean(axis=0), axis=1)
        assert sorted(far) == pytest.approx(sorted(r.customer_segment_dist for r in got if r.customer_segment == s))


def test_kmeans_of_few_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 1.0)], "customer_id long, x double")
    assert [r.customer_segment_dist for r in matrix.kmeans(df, CFG, ["x"]).collect()] == [0.0] * 3
    assert matrix.kmeans(df.limit(0), CFG, ["x"]).count() == 0


def plain_depth(tree, x):
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def test_isolation_trees_have_samples_of_their_own(spark):
    rows = spark.range(4000).select(F.xxhash64("id").alias("u"), F.array(F.col("id").cast("double"), F.rand(3)).alias("x"))
    found = matrix._samples(rows, 4000, 12, 64, 7).groupBy("tree").agg(F.count("*").alias("n"), F.collect_set("h").alias("h")).collect()
    assert len(found) == 12 and all(64 <= r.n <= 220 for r in found)
    assert len(set.union(*[set(r.h) for r in found])) > 6 * 64  # not one pool


def test_isolation_scores_equal_plain_reading(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), [[9.0, 9.0], [-8.0, 8.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "customer_id long, a double, b double")
    rows = df.select(F.xxhash64("customer_id").alias("u"), F.array("a", "b").alias("x"))
    forest = matrix.grow_forest(rows, len(x), CFG.trees, 256, CFG.seed)
    score = np.array([2 ** (-np.mean([plain_depth(t, r) for t in forest]) / matrix._average_path(256)) for r in x])
    edge = np.percentile(score, 95)
    got = {r.customer_id: r for r in matrix.isolation_forest(df, CFG).collect()}
    assert all(got[i].anomaly_iso_raw == pytest.approx(score[i] - edge, abs=1e-9) for i in range(len(x)))
    assert {i for i, r in got.items() if r.anomaly_iso_flag == -1} == set(np.flatnonzero(score > edge).tolist()) and {300, 301} <= set(np.argsort(-score)[:4].tolist())
    assert matrix.isolation_forest(df.limit(0), CFG).count() == 0 and matrix.isolation_forest(df.limit(1), CFG).first().anomaly_iso_flag == 1


def test_fused_groups_equal_single_ones(spark):
    """The same columns from one aggregation as from each group's own, also for customers whom a group doesn't have."""
    rng = random.Random(6)
    rows = [(i % 7, f"20{rng.choice(['13', '14', '15'])}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} 0{rng.randint(0, 9)}:00:00", rng.choice([None, rng.uniform(-50, 50)]), rng.choice("ab"), rng.choice(["x", "y", None])) for i in range(200)]
    rows += [(50, "2016-05-05 00:00:00", 3.0, "a", "x"), (51, "2013-01-01 00:00:00", None, "b", None)]
    df = spark.createDataFrame(rows, "customer_id long, txn_ts string, amount double, channel string, category string")
    txn = temporal.add_temporal(clean.clean_transactions(df, CFG), CFG).withColumn("balance", F.col("amount_abs") - 10)
    cfg = TxnConfig(balance="balance")
    whole = {r.customer_id: r for r in rowlevel.features(txn, cfg).collect()}
    for part in (rowlevel.velocity, rowlevel.decay, rowlevel.debit_credit, rowlevel.balance, rowlevel.recency, rowlevel.amounts):
        own = {r.customer_id: r for r in part(txn, cfg).collect()}
        for c, r in whole.items():
            for name in [n for n in part(txn, cfg).columns if n != "customer_id"]:
                want = own[c][name] if c in own else None
                assert r[name] == (pytest.approx(want, rel=1e-9, abs=1e-12) if want is not None else None), (part.__name__, c, name)
    assert {c for c, r in whole.items() if r.vel_90d_txn_count is None} >= {50, 51} and whole[50].decay30d_w_count is None
    cats = {r.customer_id: r for r in categories.category_features(txn, cfg).collect()}
    div = {r.customer_id: r for r in categories.diversity(txn, cfg).collect()}
    assert all((r.n_unique_channels, r.n_unique_categories) == (div[c].n_unique_channels, div[c].n_unique_categories) for c, r in cats.items()) and len(cats) == len(div)


def test_groups_hide_and_derive(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, -1.0)], "k long, x double")
    g = Group({"s": F.sum(F.when(F.col("x") > 0, F.col("x"))), "n": F.count_if(F.col("x") > 0)}, {"m": F.col("s") / F.col("n")}, seen=F.col("x") > 0, hidden=("s",))
    assert sorted(tuple(r) for r in aggregate(df, "k", [g]).collect()) == [(1, 2, 3.0), (2, None, None)]


def _baskets(spark, customers, values, rank, seed):
    """Long counts of customers who each like one of `rank` groups of values."""
    rng = np.random.default_rng(seed)
    likes = rng.integers(0, rank, values)
    rows = []
    for c in range(customers):
        mine = np.flatnonzero(likes == c % rank)
        for v in set(rng.choice(mine, min(len(mine), 20), replace=False).tolist()) | set(rng.integers(0, values, 3).tolist()):
            rows.append((c, f"v{v:05d}", int(rng.integers(1, 5))))
    return spark.createDataFrame(rows, "customer_id long, value string, n long").cache()


def _plain_matrix(long):
    rows = long.toPandas()
    names = sorted(rows.value.unique())
    x = np.zeros((rows.customer_id.max() + 1, len(names)))
    x[rows.customer_id, [names.index(v) for v in rows.value]] = rows.n
    tf = x / (x.sum(axis=1, keepdims=True) + 1e-9)
    return tf * np.log(len(x) / ((x > 0).sum(axis=0) + 1.0))


@pytest.mark.parametrize("whole", [256, 0])
def test_axes_equal_svd(spark, whole):
    """With all values in the block, and by repeated products with fewer columns."""
    long = _baskets(spark, 120, 90, 5, 3)
    x = _plain_matrix(long)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    got = categories.axes(long, CFG, categories.Vocabulary.of(long, CFG), 4, whole=whole, spare=20)
    assert got.shape == (x.shape[1], 4) and np.allclose(np.linalg.norm(got, axis=0), 1)
    assert np.linalg.norm(x @ got, axis=0) == pytest.approx(s[:4], rel=1e-6)
    assert np.abs((got * v[:4].T).sum(axis=0)) == pytest.approx(np.ones(4), abs=1e-4)


def test_axes_of_many_values(spark):
    long = _baskets(spark, 300, 20_000, 6, 8)
    words = categories.Vocabulary.of(long, CFG)
    got = categories.axes(long, CFG, words, 5)
    rows = {v: i for i, v in enumerate(words.values)}
    packed = long.toPandas()
    x = np.zeros((300, len(rows)))
    x[packed.customer_id, [rows[v] for v in packed.value]] = packed.n
    x = x / (x.sum(axis=1, keepdims=True) + 1e-9) * np.log(300 / (np.array(words.holders) + 1.0))
    best = np.linalg.svd(x, compute_uv=False)[:5]
    assert np.linalg.norm(x @ got, axis=0) == pytest.approx(best, rel=1e-3)
    assert categories.axes(long.limit(0), CFG, categories.Vocabulary.of(long.limit(0), CFG), 5).shape == (0, 0)


def test_few_copies_of_the_matrix_are_written(spark, monkeypatch):
    from tidemark.operators import assemble
    from tidemark.sources import shared

    wide, settled = [], shared.settle

    def counted(df, name):
        wide.append((name, len(df.columns)))
        return settled(df, name)

    rng = random.Random(1)
    rows = [(i % 30, CFG.cutoff - timedelta(days=rng.randint(0, 500)), rng.choice(["debit", "credit"]), rng.uniform(0, 50), rng.choice("ab"), rng.choice("xyz")) for i in range(300)]
    txn = spark.createDataFrame(rows, "customer_id long, txn_ts timestamp_ntz, debit_credit string, amount_abs double, channel string, category string")
    ids = spark.range(30).select(F.col("id").alias("customer_id"))
    labels = ids.where("customer_id < 20").withColumn(CFG.target, F.lit(1))
    for m in (assemble, matrix, quantiles):
        monkeypatch.setattr(m, "settle", counted)
    files = lambda: {x for d, _, names in os.walk(root) for x in (d,) if any(n.startswith("part-") for n in names)}
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = files()
    out = assemble.assemble(txn, None, None, labels, ids.where("customer_id >= 20"), replace(CFG, trees=5))
    assert out.count() == 30 and out.where("customer_segment is null or anomaly_iso_flag is null").count() == 0
    assert [n for n, columns in wide if columns > 100 or n in ("rows", "scaled", "values")] == ["features", "scored"]
    left = {os.path.basename(f) for f in files() - before}
    assert "scored" in left and not left & {"features", "transactions"}
