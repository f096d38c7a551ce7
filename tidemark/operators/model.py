"""Expanding-window folds and two-stage models in Spark ML (Q1-Q6)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TxnConfig
from tidemark.operators import boost, tuning
from tidemark.operators.matrix import filled
from tidemark.sources.shared import settle


def _above(x, cuts: Sequence) -> Column:
    """How many of the cuts are below x."""
    n = F.lit(0)
    for c in cuts:
        n = n + (x > F.lit(c)).cast("int")
    return n


def global_rank(df: DataFrame, by: str, key: str, out: str = "rank", parts: int = 64) -> DataFrame:
    """Position of each row in the order by (by, key), from 0, without a window over all rows. `by` is numeric.

    Approximate quantiles cut the values of `by` into groups: one for each cut value itself, and one for what lies
    between two. A cut value may be everywhere, so its group is cut again by the key's quantiles. Rows are numbered
    inside a group; a group starts where all before it end.
    """
    share = [i / parts for i in range(1, parts)]
    numeric = dict(df.dtypes)[key] != "string"
    found = df.agg(F.percentile_approx(by, share, 10_000).alias("b"), (F.percentile_approx(key, share, 10_000) if numeric else F.lit(None)).alias("k")).first()
    cuts, keys = sorted(set(found["b"] or [])), sorted(set(found["k"] or []))
    on_cut = F.col(by).isin(cuts) if cuts else F.lit(False)
    group = 2 * _above(F.col(by), cuts) + on_cut.cast("int")
    held = df.withColumn("_group", group).withColumn("_part", F.when(on_cut, _above(F.col(key), keys)).otherwise(0))
    sizes = held.groupBy("_group", "_part").count()  # at most 2 x parts x parts rows
    before = F.sum("count").over(Window.orderBy("_group", "_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_group", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_group", "_part").orderBy(by, key)) - 1
    numbered = held.withColumn("_place", place).join(F.broadcast(starts), ["_group", "_part"])
    return numbered.withColumn(out, (F.col("_start") + F.col("_place")).cast("long")).select(*[c for c in df.columns if c != out], out)


def fold_ends(n: int, folds: int = 5, least: float = 0.5) -> list[int]:
    """Rows that each fold trains on, and n: fold k is validated on the rows up to the next end. Shares are exact, as SQL's
    decimals are: 0.7 of 720,000 rows as floats is a row less."""
    share = Fraction(str(least))
    return [int(n * (share + (1 - share) * k / folds)) for k in range(folds)] + [n]


def assign_folds(df: DataFrame, cfg: TxnConfig, by: str = "hist_months_active") -> DataFrame:
    """Q1: rank, and fold: 0 for rows that are only trained on, else the number from 1 of the fold that validates the row."""
    ranked = global_rank(df, by, cfg.customer)
    ends = fold_ends(df.count(), cfg.folds, cfg.least_train)
    fold = F.lit(0)
    for e in ends[:-1]:
        fold = fold + (F.col("rank") >= e).cast("int")
    return ranked.withColumn("fold", fold)


def model_matrix(df: DataFrame, columns: Sequence[str], cfg: TxnConfig) -> DataFrame:
    """Q2: nulls 0, y the count, active whether it is positive."""
    y = F.col(cfg.target).cast("double")
    keep = [c for c in (cfg.customer, "split", "rank", "fold") if c in df.columns]
    return df.select(*keep, *[filled(c).alias(c) for c in columns], y.alias("y"), (y > 0).cast("int").alias("active"))


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


@dataclass
class FoldModels:
    """Models of the folds 1.., how one predicts, and the predictions for the rows that each was validated on."""

    models: list = field(default_factory=list)
    predict: Callable[[object, DataFrame], Column | DataFrame] | None = None
    out_of_fold: DataFrame | None = None


def _fold_loop(rows: DataFrame, folds: int, train, predict, out: str, keep: Sequence[str]) -> FoldModels:
    """train(earlier rows, the fold's rows) gives a model; predict(model, rows, name) adds its prediction."""
    made = FoldModels(predict=predict)
    for k in range(1, folds + 1):
        valid = rows.where(F.col("fold") == k)
        made.models.append(train(rows.where(F.col("fold") < k), valid))
        part = predict(made.models[-1], valid, out).select(*keep, out)
        made.out_of_fold = part if made.out_of_fold is None else made.out_of_fold.unionByName(part)
    return made


def _boosted(matrix: DataFrame, columns: Sequence[str], cfg: TxnConfig, asked: dict[str, tuple[boost.Params, str, Sequence[str]]], y: str = "y") -> dict[str, FoldModels]:
    """Boosted trees of all kinds and folds, trained in the same passes; asked has a kind's params, and the name of the
    prediction and the columns beside it out of fold."""
    specs = [boost.Spec(k, params) for params, _, _ in asked.values() for k in range(1, cfg.folds + 1)]
    models, made = boost.fit(boost.bin_rows(matrix, columns, cfg.customer, y), specs), {}
    for i, (kind, (_, out, keep)) in enumerate(asked.items()):
        mine = models[i * cfg.folds : (i + 1) * cfg.folds]
        oof = boost.predict_by_fold(mine, matrix.where(F.col("fold") > 0), out).select(*keep, out)
        made[kind] = FoldModels(mine, lambda m, rows, name: m.predict(rows, name), oof)
    return made


def _activity(cfg: TxnConfig, params: boost.Params | None = None) -> tuple[boost.Params, str, Sequence[str]]:
    return params or boost.Params(loss="logistic", depth=4, seed=cfg.seed), "p_active", [cfg.customer, "fold", "y", "active"]


def _counting(cfg: TxnConfig, kind: str, params: dict | None) -> tuple[boost.Params, str, Sequence[str]]:
    return boost.Params(**{**GROWTH[kind], "seed": cfg.seed, **(params or {})}), "p", [cfg.customer, "fold", "y"]


def train_boosted(matrix: DataFrame, columns: Sequence[str], cfg: TxnConfig, params: dict | None = None, activity: bool = False) -> dict[str, FoldModels]:
    """Q3, Q4: both boosted learners of counts, and with activity (kind `active`) the one of activity, as train_counts and
    train_activity make them, but in the same passes over the rows: about as many as the slowest of them takes alone."""
    asked = {kind: _counting(cfg, kind, params) for kind in GROWTH}
    return _boosted(matrix, columns, cfg, asked | ({"active": _activity(cfg)} if activity else {}))  # active is y > 0


def train_activity(matrix: DataFrame, columns: Sequence[str], cfg: TxnConfig, kind: str = "trees", params: boost.Params | None = None) -> FoldModels:
    """Q3: probability of a positive count; positives weigh as much together as negatives, and predictions take that back.
    Kind `trees`: boosted trees with logistic loss, kind `linear`: logistic regression, whose predictions keep the weights.
    out_of_fold has p_active, auc by fold."""
    keep = [cfg.customer, "fold", "y", "active"]
    if kind == "trees":
        return _boosted(matrix, columns, cfg, {"active": _activity(cfg, params)}, "active")["active"]
    rows = settle(_vectors(matrix, columns), "vectors")

    def train(part: DataFrame, valid: DataFrame):
        n = part.agg(F.avg("active").alias("p")).first()["p"] or 0.0
        weight = (1 - n) / n if 0 < n < 1 else 1.0
        part = part.withColumn("w", F.when(F.col("active") == 1, weight).otherwise(1.0)).withColumnRenamed("active", "label")
        return LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=1e-3, maxIter=50).fit(part)

    def predict(m, part: DataFrame, out: str) -> DataFrame:
        return m.transform(part).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    return _fold_loop(rows, cfg.folds, train, predict, "p_active", keep)


@dataclass
class PoissonTrees:
    """Boosted regression trees with Poisson loss: the logarithm of the expected count is base + rate * the trees' sum."""

    base: float
    rate: float
    trees: list = field(default_factory=list)

    def add_log(self, rows: DataFrame, out: str) -> DataFrame:
        rows = rows.withColumn(out, F.lit(self.base))
        for t in self.trees:
            rows = t.transform(rows).withColumn(out, F.col(out) + self.rate * F.least(F.greatest(F.col("_tree"), F.lit(-4.0)), F.lit(4.0))).drop("_tree")
        return rows

    @property
    def importances(self):
        return sum(t.featureImportances.toArray() for t in self.trees) if self.trees else None


def _loss(rows: DataFrame, log: str) -> float:
    return rows.agg(F.avg(F.exp(log) - F.col("y") * F.col(log))).first()[0]


def fit_poisson_trees(train: DataFrame, valid: DataFrame, seed: int, rounds: int = 12, depth: int = 4, rate: float = 0.3, patience: int = 3) -> PoissonTrees:
    """Newton boosting: each tree is fitted to (y - mu) / mu with weight mu. It stops when the loss on valid hasn't fallen
    for `patience` rounds, and keeps the trees up to the best round."""
    mean = train.agg(F.avg("y")).first()[0]
    model = PoissonTrees(math.log(max(mean or 0.0, 1e-6)), rate)
    if not mean:
        return model
    learner = DecisionTreeRegressor(featuresCol="features", labelCol="_z", weightCol="_w", predictionCol="_tree", maxDepth=depth, seed=seed)
    best, least = 0, _loss(model.add_log(valid, "_f"), "_f")
    for k in range(1, rounds + 1):
        mu = F.exp("_f")
        rows = model.add_log(train, "_f").withColumns({"_z": (F.col("y") - mu) / mu, "_w": mu})
        model.trees.append(learner.fit(rows))
        loss = _loss(model.add_log(valid, "_f"), "_f")
        if loss is None or least is None or loss < least:
            best, least = k, loss
        elif k - best >= patience:
            break
    model.trees = model.trees[:best]
    return model


def auc(scored: DataFrame) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="p_active", labelCol="active").evaluate(scored.withColumn("active", F.col("active").cast("double")))


#: How the two learners of counts differ.
GROWTH = {"xgb": {"growth": "depth", "depth": 6, "least_weight": 3.0}, "lgb": {"growth": "leaf", "leaves": 31, "least_weight": 1e-3, "least_rows": 20}}


def train_counts(matrix: DataFrame, columns: Sequence[str], cfg: TxnConfig, kind: str, params: dict | None = None) -> FoldModels:
    """Q4: expected counts, floored at 0, with Poisson loss. Kinds `xgb` and `lgb`: boosted trees from histograms, grown level
    by level or the best leaf first, with row and column samples and regularised leaves; params are those of boost.Params.
    Kind `trees`: Spark's decision trees, boosted. All stop early by the fold they are validated on. Kind `glm`: regression with logarithmic link on scaled columns. Kind `gbt`: Spark's boosted trees on
    log1p of the count, which also stop early."""
    if kind in GROWTH:
        return _boosted(matrix, columns, cfg, {kind: _counting(cfg, kind, params)})[kind]
    rows = settle(_vectors(matrix, columns).withColumn("log_y", F.log1p("y")), "vectors")
    floored = lambda x, out, p: x.withColumn(out, F.greatest(p, F.lit(0.0))).drop("prediction")
    if kind == "glm":
        scaler = StandardScaler(inputCol="features", outputCol="scaled").fit(rows)
        learner = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="scaled", labelCol="y", **{"regParam": 0.1, "maxIter": 25} | (params or {}))
        train = lambda part, valid: learner.fit(scaler.transform(part))
        predict = lambda m, part, out: floored(m.transform(scaler.transform(part)), out, F.col("prediction")).drop("scaled")
    elif kind == "trees":
        train = lambda part, valid: fit_poisson_trees(part, valid, cfg.seed, **(params or {}))
        predict = lambda m, part, out: m.add_log(part, out).withColumn(out, F.exp(out))
    elif kind == "gbt":
        learner = GBTRegressor(featuresCol="features", labelCol="log_y", seed=cfg.seed, validationIndicatorCol="_valid", **{"maxIter": 10, "maxDepth": 4} | (params or {}))
        train = lambda part, valid: learner.fit(part.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True))))
        predict = lambda m, part, out: floored(m.transform(part), out, F.expm1("prediction"))
    else:
        raise ValueError(f"no model of kind {kind!r}")
    return _fold_loop(rows, cfg.folds, train, predict, "p", [cfg.customer, "fold", "y"])


#: Settings that are searched, as ranges of boost.Params.
SPACE = {
    "rate": tuning.Range(0.05, 0.4, log=True), "least_weight": tuning.Range(1.0, 15.0), "rows": tuning.Range(0.6, 1.0), "columns": tuning.Range(0.5, 1.0),
    "l1": tuning.Range(1e-4, 5.0, log=True), "l2": tuning.Range(0.5, 5.0, log=True),
}
GROWN = {"xgb": {"depth": tuning.Range(3, 8, whole=True)}, "lgb": {"leaves": tuning.Range(7, 63, whole=True), "least_rows": tuning.Range(5, 50, whole=True)}}


def tune(matrix: DataFrame, columns: Sequence[str], cfg: TxnConfig, kind: str, trials: int = 50, rounds: int = 30, together: int = 4) -> tuple[dict, list[tuning.Trial]]:
    """Q5: the settings of learner `kind` with the least mean over folds of RMSLE, and all trials. Trials are scored fold by
    fold and may be given up after each; several are trained in the same passes."""
    table = boost.bin_rows(matrix, columns, cfg.customer, "y")

    def score(settings: list[dict], fold: int) -> list[float]:
        specs = [boost.Spec(fold, boost.Params(**{**GROWTH[kind], "seed": cfg.seed, "rounds": rounds, **s})) for s in settings]
        return [math.inf if e is None else e for e in boost.log_errors(table, specs, boost.fit(table, specs))]

    return tuning.search(score, SPACE | GROWN[kind], trials, cfg.folds, cfg.seed, together)


def blend(df: DataFrame, models: dict[str, Sequence[str]], cfg: TxnConfig, active: Sequence[str] = ()) -> DataFrame:
    """Q6: `prediction`: the weighted blend of each kind's mean over its fold columns, floored at 0, times the mean
    probability of activity if columns of it are given."""
    mean = lambda names: sum((F.col(c) for c in names), F.lit(0.0)) / float(len(names))
    total = sum((F.lit(cfg.weights[k]) * F.greatest(mean(names), F.lit(0.0)) for k, names in models.items()), F.lit(0.0))
    return df.withColumn("prediction", total * mean(active) if active else total)


def predict_ensemble(models: dict[str, FoldModels], matrix: DataFrame, columns: Sequence[str], cfg: TxnConfig, activity: FoldModels | None = None) -> DataFrame:
    """Q6: for rows that no model saw (the test split): `{kind}_{fold}`, each fold model's prediction, `active_{fold}`, and
    their `prediction`, as blend makes it."""
    rows, names = _vectors(matrix, columns), {}
    for kind, fitted in [*models.items(), *([("active", activity)] if activity else [])]:
        names[kind] = [f"{kind}_{k}" for k in range(1, len(fitted.models) + 1)]
        for name, m in zip(names[kind], fitted.models, strict=True):
            rows = fitted.predict(m, rows, name)
    out = blend(rows, {k: n for k, n in names.items() if k != "active"}, cfg, active=names.get("active", ()))
    return out.select(cfg.customer, *[c for n in names.values() for c in n], "prediction")


def importances(models: dict[str, Sequence], columns: Sequence[str], spark) -> DataFrame:
    """Mean over a kind's fold models of their importances (of a regression: absolute coefficients, as shares)."""
    shares = {}
    for kind, fitted in models.items():
        rows = [_importance(m, len(columns)) for m in fitted]
        rows = [r / (r.sum() or 1.0) for r in rows]
        shares[kind] = sum(rows) / len(rows)
    kinds = list(shares)
    data = [(c, *[float(shares[k][i]) for k in kinds]) for i, c in enumerate(columns)]
    return spark.createDataFrame(data, "feature string, " + ", ".join(f"{k}_imp double" for k in kinds))


def _importance(m, n: int):
    if isinstance(m, PoissonTrees | boost.Boosted):
        return m.importances if m.trees else np.zeros(n)
    return m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray())
