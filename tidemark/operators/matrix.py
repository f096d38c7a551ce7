"""Operators that are fitted on the whole customer matrix (M1, M2, N1-N4). Nulls count as 0."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import TxnConfig
from tidemark.functions.quantiles import percentiles
from tidemark.sources.shared import settle

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC and c not in without]


def filled(c: str):
    return F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))


def zscores(df: DataFrame, cfg: TxnConfig, columns: Sequence[str] | None = None) -> DataFrame:
    """M1: largest and mean absolute z-score of a row, and whether the largest is over 3. Constant columns give 0."""
    if columns is None:
        columns = [c for c in numeric_columns(df, [cfg.customer]) if any(k in c for k in ("txn", "amount", "amt", "vel_", "decay"))]
    stats = df.agg(*[f(filled(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [F.abs(filled(c) - F.lit(stats[f"m_{i}"])) / F.lit(stats[f"s_{i}"]) if stats[f"s_{i}"] else F.lit(0.0) for i, c in enumerate(columns)]
    out = df.withColumn("_z", F.array(*z))
    out = out.withColumns({"anomaly_zscore_max": F.array_max("_z"), "anomaly_zscore_mean": F.aggregate("_z", F.lit(0.0), lambda a, x: a + x) / len(columns)})
    return out.withColumn("anomaly_zscore_flag", (F.col("anomaly_zscore_max") > 3).cast("int")).drop("_z")


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> tuple:
    """A random tree of (feature, split, left, right) and leaves of (expected further depth)."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
    if depth >= limit or len(x) <= 1 or not len(spread):
        return (depth + _average_path(len(x)),)
    f = int(rng.choice(spread))
    split = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    return f, split, _grow(x[x[:, f] <= split], rng, depth + 1, limit), _grow(x[x[:, f] > split], rng, depth + 1, limit)


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _depths(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = _depths(tree[2], x[left]), _depths(tree[3], x[~left])
    return out


def _samples(rows: DataFrame, n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, h, x): for each tree its own rows of least hash, `sample` of them or a few more. One pass, in which only rows
    with hashes below a bound are passed on; the bound leaves fewer than wanted with a probability of about 1e-9."""
    wanted = sample + 6.5 * np.sqrt(sample) + 20
    bound = 2.0**64 if wanted >= n else wanted / n * 2.0**64
    kept = F.array(*[F.lit(t) for t in range(trees)])
    low = lambda t: F.xxhash64(F.lit(seed), t, F.col("u"))
    near = rows.select("u", "x", F.explode(F.filter(kept, lambda t: (low(t).cast("double") + F.lit(2.0**63)) < F.lit(bound))).alias("tree"))
    return near.select("tree", low(F.col("tree")).alias("h"), "x")


def grow_forest(rows: DataFrame, n: int, trees: int, sample: int, seed: int) -> list[tuple]:
    """Trees of (feature, split, left, right) and leaves of (expected depth). rows has a hash u and values x. Each tree is
    grown in a task of its own from its own sample; the driver gets the trees, which have at most 2 x sample nodes."""
    limit = int(np.ceil(np.log2(max(2, min(sample, n)))))

    def grow(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        x = np.array(table.column("x").to_pylist(), dtype=float)
        order = np.lexsort((*x.T, table.column("h").to_numpy()))[:sample]
        return pa.table({"tree": pa.array([tree], pa.int32()), "made": [pickle.dumps(_grow(x[order], np.random.default_rng([seed, tree]), 0, limit))]})

    found = _samples(rows, n, trees, sample, seed).groupBy("tree").applyInArrow(grow, "tree int, made binary").collect()
    return [pickle.loads(r["made"]) for r in sorted(found, key=lambda r: r["tree"])]  # noqa: S301  made in the tasks above


def isolation_forest(df: DataFrame, cfg: TxnConfig, columns: Sequence[str] | None = None, sample: int = 256) -> DataFrame:
    """M2: anomaly_iso_raw (over 0 for outliers) and anomaly_iso_flag (-1 outlier, 1 not).

    Every row is scored on the executors by how soon it stands alone in trees that are grown from samples of their own; the
    share cfg.contamination of largest scores is outlying. df is read three times, so it should be settled; the result is.
    """
    columns = list(columns) if columns is not None else numeric_columns(df, [cfg.customer])
    x, n = F.array(*[filled(c) for c in columns]), df.count()
    forest = grow_forest(df.select(F.xxhash64(cfg.customer).alias("u"), x.alias("x")), n, cfg.trees, sample, cfg.seed)
    if not forest:
        return settle(df.withColumns({"anomaly_iso_raw": F.lit(0.0), "anomaly_iso_flag": F.lit(1)}), "scored")
    held, scale = df.sparkSession.sparkContext.broadcast(forest), max(_average_path(min(sample, n)), 1e-9)

    @F.pandas_udf(T.DoubleType())
    def outlying(v: pd.Series) -> pd.Series:
        m = np.array(v.tolist())
        return pd.Series(2 ** (-np.mean([_depths(t, m) for t in held.value], axis=0) / scale))

    out = settle(df.withColumn("_score", outlying(x)), "scored")
    edge = percentiles(out, [F.col("_score")], [1 - cfg.contamination], settled=True)[0][0]
    return out.withColumn("anomaly_iso_raw", F.col("_score") - F.lit(edge)).withColumn("anomaly_iso_flag", F.when(F.col("anomaly_iso_raw") > 0, -1).otherwise(1)).drop("_score")


def robust_scale(df: DataFrame, columns: Sequence[str], suffix: str = "", settled: bool = False) -> DataFrame:
    """(x - median) / interquartile range, by exact percentiles; a range of 0 counts as 1. A settled df isn't written again."""
    found = percentiles(df, [filled(c) for c in columns], [0.25, 0.5, 0.75], settled)
    low, middle, high = np.array([q or [0.0] * 3 for q in found]).reshape(-1, 3).T.tolist()
    width = [b - a or 1.0 for a, b in zip(low, high, strict=True)]
    return df.withColumns({f"{c}{suffix}": (filled(c) - F.lit(middle[i])) / F.lit(width[i]) for i, c in enumerate(columns)})


def pca(df: DataFrame, columns: Sequence[str], components: int = 10) -> DataFrame:
    """Centred principal components pca_comp_1.., each with its largest loading positive."""
    means = df.agg(*[F.avg(filled(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    k = min(components, len(columns), max(1, df.count() - 1))
    rows = df.withColumn("_v", array_to_vector(F.array(*[filled(c) - F.lit(means[f"m{i}"]) for i, c in enumerate(columns)])))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    axes = model.pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    out = model.transform(rows).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({f"pca_comp_{i + 1}": F.col("_p")[i] * float(sign[i]) for i in range(k)}).drop("_v", "_p")


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn with a probability in proportion to its squared distance from those drawn before."""
    chosen = [x[rng.integers(len(x))]]
    while len(chosen) < k:
        far = np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))])
    return np.array(chosen)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, the first of equals, and its squared distance."""
    far = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    near = far.argmin(axis=1)
    return near, far[np.arange(len(x)), near]


def _step(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every restart's centres (restarts x k x d): the rows that are nearest to each, their sums, and the restart's cost."""
    r, k, d = centres.shape

    def run(batches):
        n, total, cost = np.zeros((r, k)), np.zeros((r, k, d)), np.zeros(r)
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            for begin in range(0, len(x), 4096):
                part = x[begin : begin + 4096]
                for i in range(r):
                    near, far = _nearest(part, centres[i])
                    n[i] += np.bincount(near, minlength=k)
                    np.add.at(total[i], near, part)
                    cost[i] += far.sum()
        i, j = (v.ravel() for v in np.indices((r, k), dtype=np.int32))
        sums = [pa.array(total[:, :, c].ravel()) for c in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n.ravel()), pa.array(np.repeat(cost, k)), *sums], names=["i", "j", "n", "cost", *[f"s{c}" for c in range(d)]])

    made = "i int, j int, n double, cost double, " + ", ".join(f"s{c} double" for c in range(d))
    rows = points.select("_x").mapInArrow(run, made).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *[f"s{c}" for c in range(d)])]).collect()  # restarts x k rows
    n, total, cost = np.zeros((r, k)), np.zeros((r, k, d)), np.zeros(r)
    for row in rows:
        n[row["i"], row["j"]], cost[row["i"]] = row["n"], row["cost"]
        total[row["i"], row["j"]] = row[4:]
    return n, total, cost


def kmeans(df: DataFrame, cfg: TxnConfig, columns: Sequence[str], restarts: int = 10, sample: int = 2000, steps: int = 100) -> DataFrame:
    """customer_segment, numbered by the norm of its centre, and customer_segment_dist to it; the best of restarts.

    Each restart begins with rows that lie far from each other among the `sample` rows of least hash, which is all that the
    driver gets. All restarts take their steps in the same passes over the settled rows, each until its centres stay. An
    empty centre stays where it is."""
    k, x = cfg.clusters, F.array(*[filled(c) for c in columns])
    rows = settle(df.withColumn("_x", x), "points")
    pool = rows.select("_x").orderBy(F.xxhash64(cfg.customer), cfg.customer).limit(sample).toArrow().column("_x")
    pool = np.array(pool.to_pylist(), dtype=float).reshape(-1, len(columns))
    if not len(pool):
        return df.withColumns({"customer_segment": F.lit(0), "customer_segment_dist": F.lit(0.0)})
    rng = np.random.default_rng(cfg.seed)
    centres = np.stack([_spread(pool, k, rng) for _ in range(restarts)])
    cost = np.full(restarts, np.inf)
    for _ in range(steps):
        n, total, cost = _step(rows, centres)
        new = np.where(n[:, :, None] > 0, total / np.maximum(n, 1)[:, :, None], centres)
        moved = np.abs(new - centres).max()
        centres = new
        if moved <= 1e-9 * max(1.0, np.abs(centres).max()):
            break
    best = centres[int(cost.argmin())]
    best = best[np.argsort(np.linalg.norm(best, axis=1), kind="stable")]
    held = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in best])
    far = F.transform(held, lambda c: F.aggregate(F.zip_with("_x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, y: a + y))
    out = rows.withColumn("_far", far).withColumn("customer_segment_dist", F.sqrt(F.array_min("_far")))
    return out.withColumn("customer_segment", (F.array_position("_far", F.array_min("_far")) - 1).cast("int")).drop("_x", "_far")


def segment_dummies(df: DataFrame, cfg: TxnConfig) -> DataFrame:
    """seg_0.., none left out."""
    return df.withColumns({f"seg_{i}": F.col("customer_segment") == i for i in range(cfg.clusters)})


def segments(df: DataFrame, cfg: TxnConfig) -> DataFrame:
    """N1-N4 on all numeric features of a settled df. No copy of it is written, only its components."""
    columns = numeric_columns(df, [cfg.customer])
    scaled = robust_scale(df.select(cfg.customer, *columns), columns, settled=True)
    made = pca(scaled, columns, cfg.components)
    names = [c for c in made.columns if c.startswith("pca_comp_")]
    made = kmeans(made.select(cfg.customer, *names), cfg, names)
    return df.join(segment_dummies(made, cfg), cfg.customer)


def anomaly(df: DataFrame, cfg: TxnConfig) -> DataFrame:
    """M1, M2."""
    columns = numeric_columns(df, [cfg.customer])
    return isolation_forest(zscores(df, cfg), cfg, columns)


