"""Boosted trees from histograms, and the search over settings, against plain readings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import TxnConfig
from tidemark.operators import boost, evaluate, model, tuning

CFG = TxnConfig(folds=2)


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        a, b, c = rng.uniform(0, 4), rng.randrange(5), rng.gauss(0, 1)
        mean = math.exp(0.4 * a - (1.5 if b == 2 else 0.0) + 0.3 * (c > 0.5))
        y = float(np.random.default_rng(i).poisson(mean))
        rows.append((i, a, b, c, y, int(y > 0), i * 3 // 900))
    return spark.createDataFrame(rows, "customer_id long, a double, b int, c double, y double, active int, fold int").cache()


def slow_split(x, g, h, cuts, p):
    """Largest gain over all features and cuts."""
    score = lambda s, t: max(abs(s) - p.l1, 0.0) ** 2 / (t + p.l2)
    best = None
    for f, edges in enumerate(cuts):
        for b, e in enumerate(edges):
            left = x[:, f] <= e
            if left.all() or not left.any() or min(h[left].sum(), h[~left].sum()) < p.least_weight or min(left.sum(), (~left).sum()) < p.least_rows:
                continue
            gain = round(0.5 * (score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())), 9)
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = gain, f, b
    return best


def slow_tree(x, g, h, cuts, p):
    """Leaves {path: value} of a tree grown by the same rules, by comparing all splits of all leaves."""
    leaves = {(): np.ones(len(g), bool)}
    while True:
        options = {path: slow_split(x[m], g[m], h[m], cuts, p) for path, m in leaves.items() if p.growth == "leaf" or len(path) < p.depth}
        options = {k: v for k, v in options.items() if v}
        if not options or p.growth == "leaf" and len(leaves) >= p.leaves:
            break
        for path in list(options) if p.growth == "depth" else [max(options, key=lambda k: options[k][0])]:
            _, f, b = options[path]
            m, left = leaves.pop(path), x[:, f] <= cuts[f][b]
            leaves[(*path, (f, b, 0))], leaves[(*path, (f, b, 1))] = m & left, m & ~left
    return [(m, boost.leaf_value(g[m].sum(), h[m].sum(), p)) for m in leaves.values()]


@pytest.mark.parametrize("params", [boost.Params(depth=3), boost.Params(growth="leaf", leaves=9, least_weight=1e-3, least_rows=20), boost.Params(loss="logistic", depth=2, least_weight=1.0)])
def test_trees_equal_slow_growth(spark, matrix, params):
    p = boost.replace(params, rounds=3, rows=1.0, columns=1.0, patience=99)
    y = "active" if p.loss == "logistic" else "y"
    table = boost.bin_rows(matrix, ["a", "b", "c"], "customer_id", y)
    got = boost.fit(table, [boost.Spec(2, p)])[0]
    rows = matrix.where("fold < 2").toPandas()
    x, target = rows[["a", "b", "c"]].to_numpy(float), rows[y].to_numpy(float)
    margin, made = np.full(len(x), got.base), got.base
    assert got.base == pytest.approx(math.log(target.mean()) if p.loss == "poisson" else 0.0) and 1 <= len(got.trees) <= 3
    for t in got.trees:
        g, h = boost._gradients(margin, target, p, got.weight)
        for m, v in slow_tree(x, g, h, table.cuts, p):
            margin[m] += p.rate * v
        made = made + t.add(boost._binned(x, table.cuts))
        assert np.allclose(margin, made)
    held = matrix.where("fold = 2").toPandas()
    mine = got.margin(boost._binned(held[["a", "b", "c"]].to_numpy(float), table.cuts))
    assert min(got.losses) == pytest.approx(boost._losses(mine, held[y].to_numpy(float), p, got.weight) / len(held))
    sql = {r.customer_id: r.m for r in matrix.select("customer_id", F.expr(got.value_sql()).alias("m")).collect()}
    for r in got.predict(matrix, "p").collect():
        assert r.p == pytest.approx(float(got.mean(np.array([sql[r.customer_id]]))[0]))


def test_margins_that_are_settled_change_nothing(spark, matrix, monkeypatch):
    table = boost.bin_rows(matrix, ["a", "b", "c"], "customer_id", "y")
    specs = [boost.Spec(f, boost.Params(rounds=7, depth=2, growth=g, leaves=4, patience=99)) for f in (1, 2) for g in ("depth", "leaf")]
    whole = boost.fit(table, specs)
    monkeypatch.setattr(boost, "SETTLE", 2)
    for a, b, alone in zip(whole, boost.fit(table, specs), [boost.fit(table, [s])[0] for s in specs], strict=True):
        assert [t.feature for t in a.trees] == [t.feature for t in b.trees] == [t.feature for t in alone.trees]
        assert np.allclose(a.losses, b.losses) and np.allclose(a.losses, alone.losses)


def test_learners_beat_the_former_ones(spark, matrix):
    """Poisson loss on held out rows, and AUC."""
    loss = lambda oof: oof.agg(F.avg(F.greatest("p", F.lit(1e-9)) - F.col("y") * F.log(F.greatest("p", F.lit(1e-9))))).first()[0]
    former = loss(model.train_counts(matrix, ["a", "b", "c"], CFG, "trees").out_of_fold)
    for kind in ("xgb", "lgb"):
        fitted = model.train_counts(matrix, ["a", "b", "c"], CFG, kind, {"rounds": 40, "columns": 1.0, "depth": 3, "leaves": 8})  # no more levels than the former have
        assert loss(fitted.out_of_fold) < former
        shares = {r.feature: r.xgb_imp for r in model.importances({"xgb": fitted.models}, ["a", "b", "c"], spark).collect()}
        assert min(shares["a"], shares["b"]) > shares["c"] > 0
    trees, linear = (model.train_activity(matrix, ["a", "b", "c"], CFG, k).out_of_fold for k in ("trees", "linear"))
    for fold in (1, 2):
        assert model.auc(trees.where(F.col("fold") == fold)) > model.auc(linear.where(F.col("fold") == fold)) - 0.01
    mean = trees.agg(F.avg("p_active"), F.avg("active")).first()
    assert mean[0] == pytest.approx(mean[1], abs=0.08)  # the classes' weights are taken back


def test_nothing_to_learn(spark, matrix):
    none = boost.bin_rows(matrix.limit(0), ["a"], "customer_id", "y")
    assert [m.trees for m in boost.fit(none, [boost.Spec(1, boost.Params())])] == [[]]
    flat = boost.bin_rows(matrix.withColumns({"a": F.lit(None).cast("double"), "y": F.lit(0.0)}), ["a"], "customer_id", "y")
    for loss in ("poisson", "logistic"):
        m = boost.fit(flat, [boost.Spec(2, boost.Params(loss=loss))])[0]
        assert m.trees == [] and m.predict(matrix, "p").agg(F.max("p")).first()[0] < 1e-5
    assert boost.log_errors(none, [boost.Spec(1, boost.Params())], [m]) == [None]


def test_search_is_seeded_and_beats_a_grid():
    """On a function whose least value lies off the grid."""
    space = {"x": tuning.Range(0.0, 10.0), "k": tuning.Range(1, 64, log=True, whole=True)}
    value = lambda s, fold: abs(s["x"] - 7.3) + abs(math.log(s["k"] / 20)) + 0.01 * fold
    runs = []

    def score(settings, fold):
        runs.append(len(settings))
        return [value(s, fold) for s in settings]

    best, tried = tuning.search(score, space, 36, 3, seed=1)
    again, _ = tuning.search(score, space, 36, 3, seed=1)
    grid = min(value({"x": 10 * i / 5, "k": round(64 ** (j / 5))}, 2) for i in range(6) for j in range(6))
    assert best == again and value(best, 2) < grid and len(tried) == 36 and isinstance(best["k"], int)
    given_up = [t for t in tried if t.given_up]
    assert given_up and all(len(t.scores) < 3 for t in given_up) and all(len(t.scores) == 3 for t in tried if not t.given_up)
    assert max(runs) <= 4


def test_tuning_of_models(spark, matrix):
    best, tried = model.tune(matrix, ["a", "b", "c"], CFG, "lgb", trials=3, rounds=3, together=3)
    assert set(best) == {*model.SPACE, *model.GROWN["lgb"]} and len(tried) == 3
    oof = model.train_counts(matrix, ["a", "b", "c"], CFG, "lgb", {**best, "rounds": 3}).out_of_fold
    by_fold = [r.rmsle for r in evaluate.errors(oof, "y", "p", by="fold").orderBy("fold").collect()]
    assert min(t.mean for t in tried if not t.given_up) == pytest.approx(sum(by_fold) / 2, abs=1e-6)


def test_pair_density(spark):
    rows = [(0.0, 0.5), (1.0, 1.25), (3.0, 3.0), (1000.0, 7.0), (1000.0, 7.5), (None, 1.0), (2.0**40, 2.0**40 * 1.9)]
    got = {(r.y_cell, r.p_cell): (r.n, r.least_y, r.largest_p) for r in evaluate.pair_density(spark.createDataFrame(rows, "y double, p double")).collect()}
    assert got == {(0, 0): (1, 0.0, 0.5), (1, 2): (1, 1.0, 1.25), (7, 7): (1, 3.0, 3.0), (40, 12): (2, 1000.0, 7.5), (161, 164): (1, 2.0**40, 2.0**40 * 1.9)}


def test_learners_trained_together_are_those_trained_alone(spark, matrix, monkeypatch):
    passes, one_pass = [], boost._pass
    monkeypatch.setattr(boost, "_pass", lambda *a, **k: passes.append(1) or one_pass(*a, **k))
    few = {"rounds": 2, "leaves": 6, "depth": 3}
    alone, most = {}, 0
    for k in ("xgb", "lgb", "active"):
        passes.clear()
        alone[k] = model.train_activity(matrix, ["a", "b", "c"], CFG) if k == "active" else model.train_counts(matrix, ["a", "b", "c"], CFG, k, few)
        most = max(most, len(passes))
    passes.clear()
    found = model.train_boosted(matrix, ["a", "b", "c"], CFG, few, activity=True)
    assert len(passes) <= most + 5
    for kind, fitted in alone.items():
        for a, b in zip(fitted.models, found[kind].models, strict=True):
            assert [(t.feature, t.bin, pytest.approx(t.value)) for t in a.trees] == [(t.feature, t.bin, t.value) for t in b.trees] and a.params == b.params
        out = "p_active" if kind == "active" else "p"
        want = {r.customer_id: r[out] for r in fitted.out_of_fold.collect()}
        assert {r.customer_id: pytest.approx(r[out]) for r in found[kind].out_of_fold.collect()} == want
