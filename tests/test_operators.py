"""Edge cases on a few rows."""

import math
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import TxnConfig
from tidemark.operators import assemble, categories, clean, evaluate, matrix, model, monthly, report, rowlevel, select, temporal
from tidemark.sources import io

CFG = TxnConfig()
T = CFG.cutoff


def txn(spark, rows):
    """rows of (customer, time, side, amount)."""
    df = spark.createDataFrame(rows, "customer_id long, txn_ts timestamp_ntz, debit_credit string, amount_abs double")
    return temporal.add_temporal(df, CFG)


def one(df):
    return df.first().asDict()


def test_direction_tokens_and_bad_values(spark):
    rows = [(1, "2015-01-01", v, "1") for v in (" d ", "DR", "1", "true", "C", "", None, "-1")] + [(1, "x", "D", "1"), (1, "2015-01-02", "D", "12a"), (None, "2015-01-01", "D", "1")]
    out = clean.clean_transactions(spark.createDataFrame(rows, "customer_id long, txn_ts string, dc_raw string, amount string"), CFG)
    got = [(r.debit_credit, r.amount_abs) for r in out.orderBy("txn_ts").collect()]
    assert sorted(d for d, _ in got[:8]) == ["credit"] * 3 + ["debit"] * 5
    assert len(got) == 9 and got[8] == ("debit", None)


def test_sign_decides_without_direction(spark):
    out = clean.clean_transactions(spark.createDataFrame([(1, T, -5.0), (2, T, 5.0), (3, T, None)], "customer_id long, txn_ts timestamp_ntz, amount double"), CFG)
    assert {r.customer_id: (r.debit_credit, r.amount_abs) for r in out.collect()} == {1: ("debit", 5.0), 2: ("credit", 5.0), 3: ("credit", None)}


def test_holidays_and_month_ends(spark):
    days = ["2014-11-30", "2014-12-01", "2014-12-31", "2015-01-15", "2015-01-16", "2015-03-21", "2014-12-26", "2000-02-28", "2000-02-29"]
    out = txn(spark, [(1, datetime.fromisoformat(d), "debit", 1.0) for d in days])
    got = {str(r.txn_ts.date()): (r.txn_is_sa_holiday, r.txn_is_month_end) for r in out.collect()}
    assert [got[d][0] for d in days[:7]] == [0, 1, 1, 1, 0, 1, 1]
    assert (got["2000-02-28"][1], got["2000-02-29"][1]) == (0, 1)


def test_days_are_rounded_down(spark):
    out = rowlevel.recency(txn(spark, [(1, T - timedelta(hours=6), "debit", 1.0), (2, T + timedelta(hours=18), "debit", 1.0)]), CFG)
    assert {r.customer_id: (r.days_since_last_txn, r.avg_days_between_txn) for r in out.collect()} == {1: (0, None), 2: (-1, None)}


def test_velocity_bounds(spark):
    out = one(rowlevel.velocity(txn(spark, [(1, T - timedelta(days=7), "debit", 1.0), (1, T, "credit", 2.0), (1, T + timedelta(seconds=1), "debit", 4.0)]), CFG))
    assert (out["vel_7d_txn_count"], out["vel_7d_total_amt"], out["vel_14d_txn_count"]) == (1, 2.0, 2)


def test_rolling_months_and_lags(spark):
    m = monthly.monthly_table(txn(spark, [(1, datetime(2015, k, 3), "debit", 1.0) for k in (9, 10, 11, 12)]), CFG)
    out = one(monthly.windows(m, CFG))
    assert (out["roll1m_txn_count"], out["lag1m_txn"], out["lag2m_txn"], out["lag12m_txn"]) == (2, 1, 1, None)


def test_one_sided_months(spark):
    m = monthly.monthly_table(txn(spark, [(1, T, "credit", 2.0), (2, T, "debit", 2.0)]), CFG)
    got = {r.customer_id: (r.debit_credit_ratio, r.monthly_debit_mean, r.debit_credit_amount_ratio) for r in m.collect()}
    assert got == {1: (0.0, 0.0, 0.0), 2: (None, 2.0, None)}


def test_streaks_compact_and_dense(spark):
    rows = txn(spark, [(1, datetime(2015, k, 3), "debit", 1.0) for k in (1, 2, 3, 6)])
    compact, dense = (one(monthly.streaks(monthly.monthly_table(rows, CFG, dense_months=d), CFG)) for d in (False, True))
    assert (compact["streak_longest_active"], compact["streak_longest_inactive"], compact["consistency_gini"]) == (4, 0, 0.0)
    assert (dense["streak_longest_active"], dense["streak_longest_inactive"]) == (3, 2)


def test_gini_of_one_and_three(spark):
    rows = txn(spark, [(1, datetime(2015, 1, 3), "debit", 1.0)] + [(1, datetime(2015, 2, k), "debit", 1.0) for k in (1, 2, 3)])
    assert one(monthly.streaks(monthly.monthly_table(rows, CFG), CFG))["consistency_gini"] == pytest.approx(0.25)


def test_skewness_of_few_and_equal_amounts(spark):
    out = rowlevel.amounts(txn(spark, [(1, T, "debit", 3.0)] * 3 + [(2, T, "debit", 1.0)]), CFG)
    assert {r.customer_id: (r.amt_skew, r.amt_std) for r in out.collect()} == {1: (0.0, 0.0), 2: (None, None)}


def test_fill_and_latest_snapshot(spark):
    rows = [(1, datetime(2015, 1, k), v, None) for k, v in enumerate([None, 1.0, None, 2.0, None], 1)]
    snap = spark.createDataFrame(rows, "customer_id long, snapshot_date timestamp_ntz, a double, b double")
    assert [(r.a, r.b) for r in clean.clean_snapshots(snap, CFG, "snapshot_date").orderBy("snapshot_date").collect()] == [(1.0, None)] * 2 + [(1.0, None)] + [(2.0, None)] * 2
    assert one(assemble.latest_snapshot(snap, CFG, "snapshot_date", ["a", "b"])) == {"customer_id": 1, "a": 2.0, "b": None}


def test_demographics(spark):
    demo = spark.createDataFrame([(1, 1.0, "b", None), (2, None, None, None), (3, 4.0, "a", None)], "customer_id long, x double, s string, y double")
    got = {r.customer_id: r.asDict() for r in clean.clean_demographics(demo, CFG).collect()}
    assert got[2]["x"] == 2.5 and got[2]["y"] is None and [got[i]["s_enc"] for i in (1, 2, 3)] == [2, 0, 1]
    shares = {r.customer_id: r.s_freq_enc for r in clean.clean_demographics(demo, CFG, max_levels=1).collect()}
    assert shares == {1: 0.5, 2: 0.0, 3: 0.5}


def test_labels_without_transactions_stay(spark):
    ids = assemble.label_union(spark.createDataFrame([(1, 3)], "customer_id long, next_3m_txn_count long"), spark.createDataFrame([(2,)], "customer_id long"), CFG)
    out = assemble.attach(ids, spark.createDataFrame([(9, 1.0)], "customer_id long, f double"), CFG)
    assert sorted((r.customer_id, r.split, r.f) for r in out.collect()) == [(1, "train", None), (2, "test", None)]


def test_robust_scale_of_sparse_column(spark):
    df = spark.createDataFrame([(i, float(i == 9)) for i in range(10)], "customer_id long, x double")
    assert {r.x for r in matrix.robust_scale(df, ["x"]).where("customer_id = 9").collect()} == {1.0}


def test_isolation_forest_flags_far_points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(195, 2)))] + [(1000 + i, 30.0 + i, -30.0) for i in range(5)]
    out = matrix.isolation_forest(spark.createDataFrame(rows, "customer_id long, x double, y double"), replace(CFG, trees=30))
    flags = {r.customer_id: r.anomaly_iso_flag for r in out.collect()}
    assert all(flags[1000 + i] == -1 for i in range(5)) and 5 <= sum(f == -1 for f in flags.values()) <= 12


def test_components_are_centred_and_ordered(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) * [5, 1, 0.2] + 10
    out = matrix.pca(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "customer_id long, a double, b double, c double"), ["a", "b", "c"])
    p = np.array([[r.pca_comp_1, r.pca_comp_2, r.pca_comp_3] for r in out.collect()])
    assert np.allclose(p.mean(axis=0), 0, atol=1e-9) and (np.diff(p.var(axis=0)) < 0).all()


def test_svd_reconstructs_the_gram_matrix(spark):
    rows = [(c, v, n) for c, v, n in ((1, "a", 3), (1, "b", 1), (2, "b", 2), (3, "c", 5), (4, "a", 1), (4, "c", 1))]
    long = spark.createDataFrame(rows, "customer_id long, value string, n long")
    w = {(r.customer_id, r.value): r.tfidf for r in categories.tfidf(long, CFG).collect()}
    m = np.array([[w.get((c, v), 0.0) for v in "abc"] for c in range(1, 5)])
    out = categories.svd(long, CFG, "e", 2).orderBy("customer_id").toPandas()[["e1", "e2"]].to_numpy()
    s = np.linalg.svd(m, compute_uv=False)
    assert np.allclose(np.linalg.norm(out, axis=0), s[:2]) and abs(out[:, 0] @ out[:, 1]) < 1e-9


def test_correlated_columns_are_dropped_in_order():
    m = np.array([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1]])
    assert select.drop_correlated(m, ["a", "b", "c"], {"a": 0.5, "b": 0.5, "c": 0}) == {"a"}
    assert select.drop_correlated(m, ["a", "b", "c"], {"a": 0.6, "b": 0.5, "c": 0}) == {"b"}


def test_rank_is_gapless_with_a_frequent_value(spark):
    rows = [(i, 5 if i % 3 else i % 7) for i in range(500)]
    out = model.global_rank(spark.createDataFrame(rows, "customer_id long, x long"), "x", "customer_id", parts=8).collect()
    assert [r.customer_id for r in sorted(out, key=lambda r: r["rank"])] == [i for i, x in sorted(rows, key=lambda t: (t[1], t[0]))]
    assert sorted(r["rank"] for r in out) == list(range(500))


def test_fold_sizes():
    assert model.fold_ends(10) == [5, 6, 7, 8, 9, 10]


def test_fold_sizes_are_exact_shares():
    for n in (720, 720_000, 1_234_567):
        assert model.fold_ends(n) == [n * k // 10 for k in range(5, 11)]


def _scored(spark, n):
    rows = spark.createDataFrame([(i, 1, 2, 3) for i in range(n)], "customer_id long, hist_months_active long, y long, p long")
    return model.assign_folds(rows, CFG)


def test_errors_of_folds_of_exact_shares(spark):
    got = evaluate.out_of_fold(_scored(spark, 720)).collect()
    assert {r.fold: r.n for r in got} == {1: 72, 2: 72, 3: 72, 4: 72, 5: 72, None: 360}


def test_written_diagnostics_have_exact_shares(spark, tmp_path):
    io.write_csv(evaluate.out_of_fold(_scored(spark, 720)), str(tmp_path / "d"))
    got = io.read_csv(spark, str(tmp_path / "d"), "fold int, n long, rmsle double, rmse double, mae double").collect()
    assert {r.fold: r.n for r in got} == {1: 72, 2: 72, 3: 72, 4: 72, 5: 72, None: 360}


def test_customers_without_transactions_keep_snapshot_and_demographics(spark):
    rows = [(i, T - timedelta(days=40 * j + 3 * i + 1), "debit" if (i + j) % 3 else "credit", 10.0 * i + j * j, "a" if j % 2 else "b", "c") for i in range(1, 7) for j in range(4)]
    t = spark.createDataFrame(rows, "customer_id long, txn_ts timestamp_ntz, debit_credit string, amount_abs double, channel string, category string")
    snap = spark.createDataFrame([(i, i / 2) for i in (1, 2, 8)], "customer_id long, bal double")
    demo = spark.createDataFrame([(i, i * 3) for i in range(1, 10)], "customer_id long, level int")
    labels = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4, 7)], f"customer_id long, {CFG.target} long")
    ids = spark.createDataFrame([(i,) for i in (5, 6, 8)], "customer_id long")
    for fitted in (False, True):
        out = assemble.assemble(t, snap, demo, labels, ids, replace(CFG, trees=5), fitted=fitted)
        got = {r.customer_id: r for r in out.collect()}
        assert {i: (r.bal, r.level, r.hist_total_txn) for i, r in got.items()} == {i: ({1: 0.5, 2: 1.0, 8: 4.0}.get(i), 3 * i, 4 if i < 7 else None) for i in range(1, 9)}
        assert {i for i, r in got.items() if fitted and r.customer_segment is not None} == (set(range(1, 7)) if fitted else set())
        assert out.columns.index("bal") < out.columns.index("level") and len(set(out.columns)) == len(out.columns)


def test_decay_has_the_last_bits_of_sql(spark):
    out = one(rowlevel.decay(txn(spark, [(1, T - timedelta(days=127), "debit", 1.0)]), CFG))
    assert out["decay30d_w_debit"] == math.exp(-math.log(2) / 30 * 127) and out["decay30d_dc_ratio"] == out["decay30d_w_debit"] / 1e-9


def test_risk_edges_and_ties(spark):
    preds = spark.createDataFrame([(i, x) for i, x in enumerate((50.0, 50.01, 145.0, 145.01))], f"customer_id long, {report.RAW} double")
    assert [r.risk_flag for r in report.risk_bands(preds).orderBy("customer_id").collect()] == ["Dormant", "At Risk", "At Risk", "Active"]
    tied = spark.createDataFrame([(i, 7.0) for i in range(9)], f"customer_id long, {report.RAW} double")
    assert [r.risk_flag for r in report.risk_terciles(tied, CFG).orderBy("customer_id").collect()] == ["Dormant"] * 3 + ["At Risk"] * 3 + ["Active"] * 3


def test_histogram_keeps_the_largest_in_the_last_bin(spark):
    preds = spark.createDataFrame([(i, float(i)) for i in range(100)], f"customer_id long, {report.RAW} double")
    out = {r["bin"]: r.n for r in report.histogram(preds).collect()}
    assert max(out) == 40 and sum(out.values()) == 100


def test_submission_and_views(spark, tmp_path):
    preds = spark.createDataFrame([(1, 3.0, 1.0), (2, -1.0, 0.0)], f"customer_id long, {io.RAW} double, {io.LOG} double")
    sample = spark.createDataFrame([(1,), (2,), (3,)], "customer_id long")
    out = io.build_submission(preds, sample, CFG)
    io.check_submission(out, sample, CFG)
    assert {r.customer_id: round(r.next_3m_txn_count, 4) for r in out.collect()} == {1: 1.3863, 2: 0.0, 3: 0.0}
    io.publish_predictions(preds, str(tmp_path), CFG)
    assert spark.table("v_submission_ready").count() == 2
    with pytest.raises(ValueError):
        io.publish_predictions(preds.drop(io.LOG), str(tmp_path), CFG)
    store = spark.createDataFrame([(1, "train", 2, 1.0, 0.5)], "customer_id long, split string, next_3m_txn_count long, hist_x double, anomaly_y double")
    io.write_feature_store(store, f"{tmp_path}/store", by_split=True)
    io.register_views(spark.read.parquet(f"{tmp_path}/store"), CFG)
    assert "hist_x" in spark.table("v_aggregate_features").columns and "hist_x" not in spark.table("v_anomaly_features").columns
    io.write_csv(preds, f"{tmp_path}/p.csv")
    assert io.read_csv(spark, f"{tmp_path}/p.csv", preds.schema).count() == 2


def test_errors(spark):
    df = spark.createDataFrame([(0.0, -1.0), (1.0, 1.0)], "y double, p double")
    out = one(evaluate.errors(df, "y", "p"))
    assert (out["n"], out["rmsle"], out["mae"]) == (2, 0.0, 0.5) and out["rmse"] == pytest.approx(0.5**0.5)


def test_empty_transactions(spark):
    rows = txn(spark, [])
    m = monthly.monthly_table(rows, CFG)
    for part in (monthly.history, monthly.windows, monthly.seasons, monthly.streaks):
        assert part(m, CFG).count() == 0
    for part in (rowlevel.velocity, rowlevel.decay, rowlevel.debit_credit, rowlevel.recency, rowlevel.amounts):
        assert part(rows, CFG).count() == 0


def test_two_stage_models_beat_a_constant(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 3, 200)
    rows = [(i, "train", int(rng.poisson(np.exp(v))) * int(rng.uniform() < 0.8), float(v), i % 6) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "customer_id long, split string, next_3m_txn_count long, x double, fold int")
    cfg = replace(CFG, folds=2)
    m = model.model_matrix(df.withColumn("fold", F.least("fold", F.lit(2))), ["x"], cfg)
    oof = model.train_counts(m, ["x"], cfg, "glm").out_of_fold
    constant = oof.withColumn("p", F.lit(float(np.mean([r[2] for r in rows]))))
    assert one(evaluate.errors(oof, "y", "p"))["rmsle"] < one(evaluate.errors(constant, "y", "p"))["rmsle"]
    assert 0 <= model.auc(model.train_activity(m, ["x"], cfg).out_of_fold) <= 1


def test_fold_models_predict_rows_they_never_saw(spark):
    cfg = replace(CFG, folds=2)
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, float(x), float(rng.poisson(np.exp(1.5 * (x > 0.5)))), 0) for i, x in enumerate(rng.random(300))]
    m = spark.createDataFrame(rows, "customer_id long, fold int, x double, y double, active int").withColumn("active", (F.col("y") > 0).cast("int"))
    fitted = {"xgb": model.train_counts(m, ["x"], cfg, "trees"), "lgb": model.train_counts(m, ["x"], cfg, "glm")}
    activity = model.train_activity(m, ["x"], cfg)
    new = spark.createDataFrame([(1000, 0.1), (1001, 0.9), (1002, None)], "customer_id long, x double").fillna(0.0)
    got = {r.customer_id: r for r in model.predict_ensemble(fitted, new, ["x"], cfg, activity).collect()}
    assert set(got) == {1000, 1001, 1002} and got[1001].prediction > 2 * got[1000].prediction
    for r in got.values():
        mean = lambda k, r=r: (r[f"{k}_1"] + r[f"{k}_2"]) / 2
        assert r.prediction == pytest.approx((0.5 * max(0, mean("xgb")) + 0.5 * max(0, mean("lgb"))) * mean("active"))
    assert 0 < len(fitted["xgb"].models[0].trees) <= 12
    shares = {r.feature: (r.xgb_imp, r.lgb_imp) for r in model.importances({k: v.models for k, v in fitted.items()}, ["x"], spark).collect()}
    assert shares == {"x": (1.0, 1.0)}


def test_poisson_trees_stop_early(spark):
    rows = [(float(i % 7), 3.0 + i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "x double, y double")
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    flat = df.withColumn("y", F.lit(3.5))
    assert len(model.fit_poisson_trees(df, flat, 1, rounds=12, patience=2).trees) < 12
    assert model.fit_poisson_trees(df.withColumn("y", F.lit(0.0)), flat, 1).trees == []


def test_bucketed_tables_need_no_shuffle(spark):
    from tidemark.sources.shared import settle_by

    df = settle_by(spark.range(1000).select((F.col("id") % 50).alias("customer_id"), "id"), "customer_id", "t")
    out = df.groupBy("customer_id").agg(F.sum("id").alias("s")).join(df.groupBy("customer_id").count(), "customer_id")
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString() and out.count() == 50


def test_names_of_values(spark):
    rows = [(1, "a.b"), (1, "a b"), (2, "a.b"), (2, "c")]
    long = categories.counts(spark.createDataFrame(rows, "customer_id long, category string"), CFG, "category")
    out = categories.vectors(long, CFG, "cat_frac_", "e", 1).orderBy("customer_id")
    assert set(out.columns) == {"customer_id", "e1", "cat_frac_a_b", "cat_frac_a_b_", "cat_frac_c"}
    assert [round(r.cat_frac_c, 6) for r in out.collect()] == [0.0, 0.5]
