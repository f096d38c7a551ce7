"""One query for each operator: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import assemble, categories, clean, evaluate, matrix, model, monthly, report, rowlevel, select, temporal
from tidemark.plans import adapters as data
from tidemark.plans.adapters import CFG, EVENTS
from tidemark.plans.oracles import ORACLES as _SQL
from tidemark.sources import io
from tidemark.sources.shared import new_path, settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ID = "customer_id"


def shown(df: DataFrame) -> DataFrame:
    """Comparable values: floats rounded, a little away from ties so that two engines round alike, quotients by 1e-9 to millions; whole numbers as bigint."""
    cast = {"double": lambda c: F.when(F.abs(c) >= 1e11, F.round(c / 1e6) * 1e6).otherwise(F.round(c + 3.3e-8, 5)), "int": lambda c: c.cast("long"), "date": lambda c: c.cast("string")}
    return df.select(*[cast.get(t, lambda c: c)(F.col(f"`{n}`")).alias(n) for n, t in df.dtypes])


def query(name: str):
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shown(f(spark, sf_dir))

        QUERIES[name] = run
        return f

    return add


def _months(s: SparkSession, d: str) -> DataFrame:
    return monthly.monthly_table(data.transactions(s, d), CFG)


def _past(s: SparkSession, d: str) -> DataFrame:
    """Customer history as of the cutoff."""
    txn = data.transactions(s, d).where(F.col("txn_ts") <= F.lit(CFG.cutoff).cast("timestamp_ntz"))
    return monthly.history(monthly.monthly_table(txn, CFG), CFG)


FEATURES = ["hist_months_active", "hist_total_txn", "hist_total_amount", "hist_std_monthly_txn"]


def _train(s: SparkSession, d: str) -> DataFrame:
    rows = assemble.attach(assemble.label_union(data.labels(s, d), data.test_ids(s, d), CFG), _past(s, d).select(ID, *FEATURES), CFG)
    return settle(rows.where("split = 'train'").fillna(0, FEATURES), "train")  # one row a customer, used by several jobs


def _folded(s: SparkSession, d: str) -> DataFrame:
    return model.assign_folds(_train(s, d), CFG)


def _test(s: SparkSession, d: str) -> DataFrame:
    return assemble.attach(data.test_ids(s, d), _past(s, d).select(ID, *FEATURES), CFG).withColumn(CFG.target, F.lit(None).cast("long"))


def _assembled(s: SparkSession, d: str, fitted: bool) -> DataFrame:
    """The full matrix, with snapshots and demographics."""
    demo = clean.clean_demographics(data.demographics(s, d), CFG)
    snap = clean.clean_snapshots(data.snapshots(s, d), CFG, "snapshot_date", tie="event_id")
    snap = assemble.latest_snapshot(snap, CFG, "snapshot_date", ["bal", "k"], tie="event_id")
    txn = clean.clean_transactions(data.txn_raw(s, d), CFG)
    return assemble.assemble(txn, snap, demo, data.labels(s, d), data.test_ids(s, d), CFG, as_of_filter=True, fitted=fitted)


def _oof(s: SparkSession, d: str) -> DataFrame:
    ts = F.col("txn_ts")
    recent = data.txn_raw(s, d).where((ts < F.lit(CFG.cutoff).cast("timestamp_ntz")) & (ts >= F.expr("timestamp_ntz'2000-08-01'"))).groupBy(ID).agg(F.count("*").alias("p"))
    return _folded(s, d).join(recent, ID, "left").select(ID, "fold", F.col(CFG.target).alias("y"), F.coalesce("p", F.lit(0)).alias("p"))


@query("read_pruned")
def _(s, d):
    return io.read_pruned(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_shipdate", "l_extendedprice", "l_returnflag", "no_such_column"])


@query("cohort_sample")
def _(s, d):
    return io.cohort_sample(clean.clean_transactions(data.txn_raw(s, d), CFG), CFG).groupBy(ID).agg(F.count("*").alias("n"), F.sum("amount_abs").alias("amount"))


@query("feature_views")
def _(s, d):
    rows = assemble.attach(assemble.label_union(data.labels(s, d), data.test_ids(s, d), CFG), _past(s, d), CFG)
    io.register_views(rows, CFG)
    return s.table("v_aggregate_features").groupBy("split").agg(F.count("*").alias("customers"), F.sum("hist_total_amount").alias("hist_total_amount"))


@query("submission")
def _(s, d):
    sample = data.test_ids(s, d).unionByName(data.table(s, d, "customer").where("c_custkey % 50 = 0").select((-F.col("c_custkey")).alias(ID)))
    return io.build_submission(data.predictions(s, d), sample, CFG)


@query("clean_txn")
def _(s, d):
    return clean.clean_transactions(data.txn_raw(s, d), CFG)


@query("snapshot_fill")
def _(s, d):
    return clean.clean_snapshots(data.snapshots(s, d), CFG, "snapshot_date", tie="event_id").select(ID, "event_id", "bal", "k")


@query("impute_median")
def _(s, d):
    return clean.impute_median(data.demographics(s, d), ["c_acctbal"]).select(ID, "c_acctbal")


@query("label_encode")
def _(s, d):
    return clean.label_encode(clean.label_encode(data.demographics(s, d), "c_mktsegment"), "n_name").select(ID, "c_mktsegment_enc", "n_name_enc")


@query("freq_encode")
def _(s, d):
    return clean.frequency_encode(clean.frequency_encode(data.demographics(s, d), "c_name"), "c_mktsegment").select(ID, "c_name_freq_enc", "c_mktsegment_freq_enc")


@query("calendar")
def _(s, d):
    names = ["txn_year", "txn_month", "txn_quarter", "txn_dayofweek", "txn_day", "txn_is_weekend", "txn_is_month_start", "txn_is_month_end", "days_since_start", "ym", "days_to_month_end"]
    return data.transactions(s, d).select("txn_ts", *names).distinct()


@query("holiday_flag")
def _(s, d):
    rows = temporal.add_temporal(clean.clean_transactions(data.txn_raw(s, d), CFG), CFG)
    return rows.groupBy(F.date_format("txn_ts", "MM-dd").alias("md")).agg(F.max("txn_is_sa_holiday").alias("is_holiday"), F.count("*").alias("n"))


@query("cyclical")
def _(s, d):
    return data.transactions(s, d).select("txn_ts", "txn_month_sin", "txn_month_cos", "txn_quarter_sin", "txn_quarter_cos").distinct()


@query("monthly")
def _(s, d):
    return _months(s, d)


@query("history")
def _(s, d):
    return monthly.history(_months(s, d), CFG)


@query("rolling")
def _(s, d):
    w = monthly.windows(_months(s, d), CFG)
    return w.select(ID, *[c for c in w.columns if c.startswith("roll")])


@query("lags")
def _(s, d):
    w = monthly.windows(_months(s, d), CFG)
    return w.select(ID, *[c for c in w.columns if c.startswith(("lag", "mom_"))], "txn_acceleration")


@query("trend")
def _(s, d):
    return monthly.windows(_months(s, d), CFG).select(ID, "growth_3m_vs_6m", "trend_1m_vs_3m")


@query("yearly_mean")
def _(s, d):
    return monthly.seasons(_months(s, d), CFG).select(ID, "hist_mean_yearly_txn")


@query("month_season")
def _(s, d):
    m = monthly.seasons(_months(s, d), CFG)
    return m.select(ID, *[c for c in m.columns if c.startswith(("hist_nov", "hist_dec", "hist_jan"))], "dec_spike_ratio", "dec_yearly_ratio", "nov_dec_ratio")


@query("festive_q4")
def _(s, d):
    return monthly.seasons(_months(s, d), CFG).select(ID, "festive_mean_txn", "festive_total_txn", "festive_mean_amt", "hist_q4_mean_txn", "hist_q4_total_txn")


@query("streaks")
def _(s, d):
    return monthly.streaks(_months(s, d), CFG).drop("consistency_gini")


@query("streaks_dense")
def _(s, d):
    return monthly.streaks(monthly.monthly_table(data.transactions(s, d), CFG, dense_months=True), CFG).drop("consistency_gini")


@query("gini")
def _(s, d):
    return monthly.streaks(_months(s, d), CFG).select(ID, "consistency_gini")


@query("velocity")
def _(s, d):
    return rowlevel.velocity(data.transactions(s, d), CFG)


@query("decay")
def _(s, d):
    return rowlevel.decay(data.transactions(s, d), CFG)


@query("decay_events")
def _(s, d):
    return rowlevel.decay(data.events(s, d), EVENTS)


@query("debit_credit")
def _(s, d):
    return rowlevel.debit_credit(data.transactions(s, d), CFG)


@query("balance")
def _(s, d):
    return rowlevel.balance(data.transactions(s, d), CFG)


@query("category_counts")
def _(s, d):
    return categories.counts(data.transactions(s, d), CFG, "category")


@query("category_frac")
def _(s, d):
    return categories.fractions(categories.counts(data.transactions(s, d), CFG, "category"), CFG).select(ID, "value", "tf")


@query("tfidf")
def _(s, d):
    return categories.tfidf(categories.counts(data.transactions(s, d), CFG, "category"), CFG).select(ID, "value", "tfidf")


@query("category_svd")
def _(s, d):
    return categories.svd(categories.counts(data.transactions(s, d), CFG, "category"), CFG, "type_emb_comp_")


@query("diversity")
def _(s, d):
    return categories.diversity(data.transactions(s, d), CFG)


for _name, _rows, _cfg in (("", data.transactions, CFG), ("_events", data.events, EVENTS)):
    query(f"recency{_name}")(lambda s, d, rows=_rows, cfg=_cfg: rowlevel.recency(rows(s, d), cfg).drop("avg_days_between_txn"))
    query(f"txn_gap{_name}")(lambda s, d, rows=_rows, cfg=_cfg: rowlevel.recency(rows(s, d), cfg).select(ID, "avg_days_between_txn"))


@query("amounts")
def _(s, d):
    return rowlevel.amounts(data.transactions(s, d), CFG).drop("amt_large_frac")


@query("large_frac")
def _(s, d):
    return rowlevel.amounts(data.transactions(s, d), CFG).select(ID, "amt_large_frac")


@query("zscore")
def _(s, d):
    names = ["hist_total_txn", "hist_mean_monthly_txn", "hist_std_monthly_txn", "hist_total_amount", "hist_std_amount"]
    return matrix.zscores(monthly.history(_months(s, d), CFG), CFG, names).select(ID, "anomaly_zscore_max", "anomaly_zscore_mean", "anomaly_zscore_flag")


@query("iforest")
def _(s, d):
    return matrix.isolation_forest(settle(monthly.history(_months(s, d), CFG), "history"), CFG).select(ID, "anomaly_iso_flag", "anomaly_iso_raw")


@query("robust_scale")
def _(s, d):
    names = ["hist_total_txn", "hist_total_amount", "hist_zero_months"]
    return matrix.robust_scale(monthly.history(_months(s, d), CFG), names).select(ID, *names)


def _components(s: SparkSession, d: str) -> DataFrame:
    h = settle(monthly.history(_months(s, d), CFG), "history")  # read by the jobs that fit scales and components
    names = matrix.numeric_columns(h, [ID])
    scaled = settle(matrix.robust_scale(h, names).select(ID, *names), "scaled")
    return matrix.pca(scaled, names, CFG.components).drop(*names)


@query("pca")
def _(s, d):
    return _components(s, d)


def _segments(s: SparkSession, d: str) -> DataFrame:
    p = _components(s, d)
    return matrix.kmeans(p, CFG, [c for c in p.columns if c != ID])


@query("kmeans")
def _(s, d):
    return _segments(s, d).select(ID, "customer_segment", "customer_segment_dist")


def _given_segments(s: SparkSession, d: str) -> DataFrame:
    return data.table(s, d, "customer").select(F.col("c_custkey").alias(ID), F.pmod("c_nationkey", F.lit(CFG.clusters)).cast("int").alias("customer_segment"))


@query("segment_dummies")
def _(s, d):
    return matrix.segment_dummies(_given_segments(s, d), CFG).select(ID, "customer_segment", *[F.col(f"seg_{i}").cast("int").alias(f"seg_{i}") for i in range(CFG.clusters)])


@query("segment_counts")
def _(s, d):
    return evaluate.segment_counts(_given_segments(s, d))


@query("latest_snapshot")
def _(s, d):
    return assemble.latest_snapshot(data.snapshots(s, d), CFG, "snapshot_date", ["bal", "k"], tie="event_id")


@query("assemble")
def _(s, d):
    return _assembled(s, d, fitted=True)


@query("assemble_groups")
def _(s, d):
    """The matrix without what is fitted."""
    rows = _assembled(s, d, fitted=False)
    return rows.drop(*[c for c in rows.columns if "_emb_comp_" in c or c.startswith(("cat_frac_", "ch_frac_"))])


@query("label_union")
def _(s, d):
    return assemble.attach(assemble.label_union(data.labels(s, d), data.test_ids(s, d), CFG), _past(s, d).select(ID, "hist_months_active", "hist_total_amount"), CFG)


@query("variance_filter")
def _(s, d):
    return select.variances(_train(s, d), FEATURES)


@query("rank_target_corr")
def _(s, d):
    return select.target_correlations(_train(s, d), FEATURES, CFG.target)


def _whole_train(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The matrix of labelled customers, as assemble_groups shows it, and its numeric columns."""
    rows = settle(QUERIES["assemble_groups"](s, d).where("split = 'train'"), "matrix")
    return rows, matrix.numeric_columns(rows, [ID, CFG.target])


@query("variance_whole")
def _(s, d):
    """P1 on every numeric column: logarithms, since variances differ by many orders."""
    rows, names = _whole_train(s, d)
    return select.variances(rows, names).select("feature", F.log10(1 + F.coalesce("variance", F.lit(0.0))).alias("log_variance"))


@query("target_corr_whole")
def _(s, d):
    """P3 on every numeric column."""
    rows, names = _whole_train(s, d)
    return select.target_correlations(rows, names, CFG.target)


@query("corr_pairs")
def _(s, d):
    m = select.correlation_matrix(_train(s, d), FEATURES)
    return s.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i < j], "a string, b string, corr double")


@query("select_features")
def _(s, d):
    """On all numeric columns of the matrix."""
    return select.select_features(settle(_assembled(s, d, fitted=False), "matrix"), CFG)[0]


@query("selected")
def _(s, d):
    _, names = select.select_features(_train(s, d).select(ID, "split", CFG.target, *FEATURES), CFG, max_features=3)
    return s.createDataFrame([(c,) for c in names], "feature string")  # at most max_features names


@query("folds")
def _(s, d):
    return _folded(s, d).select(ID, "rank", "fold")


@query("model_matrix")
def _(s, d):
    return model.model_matrix(_train(s, d), FEATURES[1:], CFG).drop("split")


@query("activity_model")
def _(s, d):
    fitted = model.train_activity(model.model_matrix(_folded(s, d), FEATURES, CFG), FEATURES, CFG)
    return fitted.out_of_fold.select(ID, "fold", "active", "p_active")


BOOSTED = {"rounds": 15, "patience": 3}


def _counted(s: SparkSession, d: str, activity: bool = False) -> dict[str, model.FoldModels]:
    return model.train_boosted(settle(model.model_matrix(_folded(s, d), FEATURES, CFG), "matrix"), FEATURES, CFG, BOOSTED, activity)


@query("count_models")
def _(s, d):
    return evaluate.cv_table(*[m.out_of_fold for m in _counted(s, d).values()])


@query("boosted_log_counts")
def _(s, d):
    rows = settle(model.model_matrix(_folded(s, d), FEATURES, CFG), "matrix")
    return evaluate.errors(model.train_counts(rows, FEATURES, CFG, "gbt").out_of_fold, "y", "p", by="fold")


@query("tuning")
def _(s, d):
    """All trials of a search over the settings of the level-wise learner."""
    rows = settle(model.model_matrix(_folded(s, d), FEATURES, CFG), "matrix")
    best, tried = model.tune(rows, FEATURES, CFG, "xgb", trials=8, rounds=2)
    data = [(t.number, len(t.scores), t.mean, t.given_up, t.settings == best, *[float(t.settings[k]) for k in sorted(t.settings)]) for t in tried]  # a row for each trial
    return s.createDataFrame(data, "trial int, folds int, rmsle double, given_up boolean, best boolean, " + ", ".join(f"{k} double" for k in sorted(best)))


@query("poisson_trees")
def _(s, d):
    """Out-of-fold errors of Spark's decision trees, boosted, and of the Poisson regression."""
    rows = settle(model.model_matrix(_folded(s, d), FEATURES, CFG), "matrix")
    return evaluate.cv_table(*[model.train_counts(rows, FEATURES, CFG, k).out_of_fold for k in ("trees", "glm")])


@query("activity_linear")
def _(s, d):
    fitted = model.train_activity(model.model_matrix(_folded(s, d), FEATURES, CFG), FEATURES, CFG, "linear")
    return fitted.out_of_fold.select(ID, "fold", "active", "p_active")


@query("predict_test")
def _(s, d):
    """A prediction for every test customer by the fold models of both kinds and of activity."""
    models = _counted(s, d, activity=True)
    activity = models.pop("active")
    return model.predict_ensemble(models, model.model_matrix(_test(s, d), FEATURES, CFG), FEATURES, CFG, activity)


@query("whole_job")
def _(s, d):
    """From transactions to a submission: assemble, select, folds, models, ensemble."""
    features, names = select.select_features(settle(_assembled(s, d, fitted=True), "matrix"), CFG)
    features = settle(features, "selected")
    by = "hist_months_active"
    train = features.where("split = 'train'").withColumn(by, F.coalesce(by, F.lit(0))) if by in names else features.where("split = 'train'").withColumn(by, F.lit(0))
    rows = settle(model.model_matrix(model.assign_folds(train, CFG), names, CFG), "folds")
    models = model.train_boosted(rows, names, CFG, BOOSTED, activity=True)
    activity = models.pop("active")
    found = model.predict_ensemble(models, model.model_matrix(features.where("split = 'test'"), names, CFG), names, CFG, activity)
    preds = found.select(ID, F.col("prediction").alias(io.RAW), F.log1p("prediction").alias(io.LOG))
    submission = io.build_submission(io.publish_predictions(preds, new_path(s, "published"), CFG), data.test_ids(s, d), CFG)
    io.check_submission(submission, data.test_ids(s, d), CFG)
    return submission


@query("ensemble")
def _(s, d):
    raw = F.col(io.RAW)
    folds = data.predictions(s, d).withColumns({"x1": raw, "x2": raw - 100, "l1": raw / 2, "active": raw / (raw + 100)})
    return model.blend(folds, {"xgb": ["x1", "x2"], "lgb": ["l1"]}, CFG, active=["active"]).select(ID, "prediction")


@query("oof_eval")
def _(s, d):
    return evaluate.out_of_fold(_oof(s, d))


@query("actual_predicted")
def _(s, d):
    return evaluate.pair_density(_oof(s, d).where("fold > 0"))


@query("residual_hist")
def _(s, d):
    return evaluate.residual_histogram(_oof(s, d))


@query("importances")
def _(s, d):
    models = _counted(s, d)
    return evaluate.importance_table(model.importances({k: m.models for k, m in models.items()}, FEATURES, s), CFG)


def _strengths(s: SparkSession, d: str) -> DataFrame:
    """Importances that SQL has too."""
    corr = select.target_correlations(_train(s, d), FEATURES, CFG.target)
    return corr.select("feature", F.col("corr").alias("xgb_imp"), (1 - F.col("corr")).alias("lgb_imp"))


@query("importance_table")
def _(s, d):
    return evaluate.importance_table(_strengths(s, d).withColumn("lgb_imp", F.col("lgb_imp") / 2), CFG)


@query("top_features")
def _(s, d):
    return evaluate.top_features(_strengths(s, d).select("feature", F.col("xgb_imp").alias("avg_imp")), 3)


def _two_predictors(s: SparkSession, d: str) -> DataFrame:
    rows = _oof(s, d).where("fold > 0")
    return evaluate.cv_table(rows, rows.withColumn("p", F.col("p") / 2))


@query("cv_table")
def _(s, d):
    return _two_predictors(s, d)


@query("cv_summary")
def _(s, d):
    return evaluate.cv_summary(_two_predictors(s, d))


@query("drop_empty")
def _(s, d):
    rows = data.demographics(s, d).withColumns({"nothing": F.lit(None).cast("double"), "no.text": F.lit(None).cast("string")})
    return clean.drop_empty_columns(rows)


@query("inputs")
def _(s, d):
    """Rows of every input: labels, ids and sample are written as CSV first."""
    paths = {"transactions": f"{d}/lineitem.parquet", "financials": f"{d}/events.parquet", "demographics": f"{d}/customer.parquet"}
    for name, rows in (("labels", data.labels(s, d)), ("test_ids", data.test_ids(s, d)), ("sample", data.test_ids(s, d))):
        paths[name] = new_path(s, name)
        io.write_csv(rows, paths[name])
    found = io.read_inputs(s, paths, CFG)
    total = lambda k, x: found[k].agg(F.lit(k).alias("input"), F.count("*").alias("n"), F.sum(x).cast("double").alias("total"))
    out = total("labels", CFG.target)
    for k, x in (("test_ids", F.col(ID).cast("long")), ("sample", F.col(ID).cast("long")), ("financials", "value"), ("demographics", "c_acctbal")):
        out = out.unionByName(total(k, x))
    return out


@query("feature_store")
def _(s, d):
    rows = assemble.attach(assemble.label_union(data.labels(s, d), data.test_ids(s, d), CFG), _past(s, d), CFG)
    stored = s.read.parquet(io.write_feature_store(rows, new_path(s, "features"), by_split=True))
    return stored.groupBy("split").agg(F.count("*").alias("customers"), F.sum("hist_total_amount").alias("hist_total_amount"))


@query("publish")
def _(s, d):
    io.publish_predictions(data.predictions(s, d), new_path(s, "published"), CFG)
    return s.table("v_submission_ready")


@query("diagnostics_csv")
def _(s, d):
    path = new_path(s, "diagnostics")
    io.write_csv(evaluate.out_of_fold(_oof(s, d)), path)
    return io.read_csv(s, path, "fold int, n long, rmsle double, rmse double, mae double")


@query("outreach_export")
def _(s, d):
    path = new_path(s, "outreach")
    io.write_csv(report.outreach(report.risk_bands(data.predictions(s, d))).select(ID, io.RAW, "risk_flag"), path)
    return io.read_csv(s, path, f"{ID} long, {io.RAW} double, risk_flag string")


@query("risk_bands")
def _(s, d):
    return report.risk_bands(data.predictions(s, d)).select(ID, io.RAW, "risk_flag")


@query("risk_terciles")
def _(s, d):
    return report.risk_terciles(data.predictions(s, d), CFG).select(ID, "risk_flag")


@query("portfolio")
def _(s, d):
    return report.portfolio(report.risk_bands(data.predictions(s, d)))


@query("pred_histogram")
def _(s, d):
    return report.histogram(data.predictions(s, d))


@query("lookup")
def _(s, d):
    return report.lookup(data.predictions(s, d), CFG, " 7 ").select(ID, io.RAW)


@query("outreach")
def _(s, d):
    return report.outreach(report.risk_bands(data.predictions(s, d))).select(ID, io.RAW, "risk_flag")


ORACLES = {k: v for k, v in _SQL.items() if k in QUERIES}
