"""Near-duplicate embeddings by collision counting on sorted one-dimensional projections.

All rows can't be compared in one task, so random hyperplanes cut them into cells, several times over: numbers of planes
and of cuts follow from the number of rows, so that a cell has about `cell` rows and a pair at the least cosine shares one
with a probability of at least 1 - miss / 2. Only vectors and their cells' numbers are shuffled, once for each cut.

In a cell, rows are sorted by each of many one-dimensional projections, and each pair's collisions are counted: how often
one lies in the window centred on the other. A pair is verified by its cosine if it has at least `least` collisions, the
count that a pair at the least cosine misses with a probability of at most miss / 2; more alike pairs have more. A pair
is taken up in the first cut whose cell it shares. So pairs never leave a cell: it gives numbers of links, and edges that
span its linked rows. Large cells are cut into blocks that are compared two by two in groups of their own. Equal vectors
are one class and aren't compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.graph import components
from tidemark.llm.storage import settle


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.93
    miss: float = 1e-4
    projections: int = 96
    window: float = 0.6  # half width, in deviations of the projected difference at the least cosine
    cell: int = 256  # rows wanted in a cell
    block: int = 512  # rows compared at once, at most two blocks

    def plan(self, rows: int) -> tuple[int, int]:
        """Hyperplanes of a cut, and cuts, for the largest label's number of rows."""
        k = max(0, math.ceil(math.log2(max(1, rows) / self.cell)))
        p = (1 - math.acos(self.cosine) / math.pi) ** k
        return k, 1 if p == 1 else max(1, math.ceil(math.log(self.miss / 2) / math.log(1 - p)))

    @property
    def least(self) -> int:
        """Most collisions that a pair at the least cosine reaches with a probability of at least 1 - miss / 2."""
        p, n = math.erf(self.window / math.sqrt(2)), self.projections
        below, c = 0.0, 0
        while (below := below + math.comb(n, c) * p**c * (1 - p) ** (n - c)) <= self.miss / 2:
            c += 1
        return c

    @property
    def half_width(self) -> float:
        return self.window * math.sqrt(2 - 2 * self.cosine)


def _cells(x: np.ndarray, k: int, cuts: int) -> np.ndarray:
    """Cell (int32) of each row in each cut."""
    planes = np.random.Generator(np.random.PCG64([x.shape[1], k, cuts])).standard_normal((x.shape[1], cuts * k))
    bits = (x @ planes > 0).reshape(len(x), cuts, k) if k else np.zeros((len(x), cuts, 0), bool)
    return (bits * (1 << np.arange(k))).sum(axis=2).astype(np.int32)


def collisions(x: np.ndarray, s: Settings) -> np.ndarray:
    """counts[i, j], i < j: in how many projections the unit rows i and j of x lie in each other's windows."""
    n = len(x)
    lines = np.random.Generator(np.random.PCG64([x.shape[1], s.projections])).standard_normal((x.shape[1], s.projections))
    projected = (x @ lines).astype(np.float32)
    counts, held, size = np.zeros(n * n, np.int64), [], 0
    for u in range(s.projections):
        order = np.argsort(projected[:, u], kind="stable")
        p = projected[order, u]
        more = np.searchsorted(p, p + np.float32(s.half_width), side="right") - np.arange(n) - 1
        first = np.repeat(np.arange(n), more)
        a, b = order[first], order[first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more)]
        held.append(np.minimum(a, b) * n + np.maximum(a, b))
        size += len(first)
        if size > 2_000_000 or u == s.projections - 1:
            counts += np.bincount(np.concatenate(held), minlength=n * n)
            held, size = [], 0
    return counts.reshape(n, n)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of equal length from a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest row number that the links a-b lead to, of each of n rows."""
    low = np.arange(n)
    while True:
        new = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _links(table: pa.Table, s: Settings) -> pa.Table:
    """(node, links, to): of one cell or two of its blocks, each row's number of links found here and its edge."""
    order = np.argsort(table.column("node").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    t, crossing = table.column("t")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
    cells, x = _matrix(table.column("cells"), np.int32), _matrix(table.column("v"), np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    side, copies, nodes = table.column("side").to_numpy(), table.column("copies").to_numpy(), table.column("node").to_numpy()
    a, b = np.divmod(np.flatnonzero(collisions(x, s).ravel() >= max(1, s.least)), len(x))
    new = ~(cells[a, :t] == cells[b, :t]).any(axis=1)
    if crossing:
        new &= side[a] != side[b]
    a, b = a[new], b[new]
    near = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 100_000]], x[b[i : i + 100_000]]) >= s.cosine for i in range(0, len(a), 100_000)] or [np.zeros(0, bool)])
    a, b = a[near], b[near]
    links = np.bincount(a, weights=copies[b], minlength=len(x)).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=len(x)).astype(np.int64)
    low, some = _spanning(a, b, len(x)), links > 0
    return pa.table({"node": nodes[some], "links": links[some], "to": nodes[low][some]})


def _usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def similar_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(key, n_links, component_id, kept): each row's links to other rows of its label, and the smallest id they lead to.

    Keys are integers. Rows with a null label or a vector that is null, empty, zero or has null or non-finite components
    link with nothing, nor do vectors of different lengths with each other. Rows without a key have no links and a null
    component, and are kept. Rows that share a key count singly as links, and share a component.
    """
    s = settings
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v"))
    rows = rows.select("id", F.when(good, F.col("label")).alias("label"), F.when(good, F.col("v")).alias("v"))
    rows = rows.withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v"))
    same = ["label", "dim", "h", "g"]
    # an id may stand in two classes, and hashes of classes may meet, so they get numbers of their own when they are written
    classes = rows.where("v is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    k, cuts = s.plan(largest)

    base = rows.where("v is not null").join(classes, same).where("id = rep").dropDuplicates(["node"])
    made = T.StructType([T.StructField("label", df.schema[label].dataType)]).add("dim", "integer").add("node", "long").add("copies", "long")
    made = made.add("v", df.schema[vector].dataType).add("cells", T.ArrayType(T.IntegerType()))

    def code(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                cells = _cells(_matrix(part.column("v"), np.float64), k, cuts)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cuts, pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("label", "dim", "node", "copies", "v")] + [codes], names=made.names)

    base = settle(base.select("label", "dim", "node", "copies", "v").mapInArrow(code, made), "codes")
    thin = base.select("label", "dim", "node", F.posexplode("cells").alias("t", "cell"))
    where = ["label", "dim", "t", "cell"]
    large = thin.groupBy(*where).count().where(F.col("count") > s.block).select(*where, F.ceil(F.col("count") / s.block).cast("int").alias("blocks"))
    large = settle(large, "large")
    cut = thin.join(large, where).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("t", "blocks"))).alias("cut"))
    spread = base.join(cut, "node", "left").select("*", F.posexplode("cells").alias("t", "cell"))
    blocks = F.coalesce(F.try_element_at("cut", "t"), F.lit(1))
    spread = spread.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    spread = spread.select(*where, "node", "copies", "v", "cells", "side", other)
    spread = spread.withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o")).drop("o")
    found = spread.groupBy(*where, "i", "j").applyInArrow(lambda table: _links(table, s), "node long, links long, to long")
    found = settle(found, "links")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select("node", "to"), "node", "to")
    named = settle(classes.join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "joined")
    least = named.groupBy("component").agg(F.min("rep").alias("c"))  # the smallest id of the component
    named = named.join(least, "component").select(*same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "c")
    out = rows.join(settle(named, "named"), same, "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links to vectors of its label, and the smallest id they lead to."""
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
