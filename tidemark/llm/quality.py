"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is a sequence of tokens (runs of letters and digits, and runs of other marks). Features are hashed n-grams of
the lower-cased tokens and of their shapes: kind, capitals, length, and whether the token repeats the one to three
before it. A feature's value is its share of the text's tokens, so a score is one sparse dot product and texts of any
length are read whole. Learning uses a bounded sample of labelled rows (`Settings.sample`), nothing else is capped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words
from tidemark.llm.batches import with_arrow

_MARKS = words.NOT_SPACE & ~words.LETTERS


@dataclass(frozen=True)
class Settings:
    bits: int = 18  # size of the hashed feature space
    sample: int = 12_000  # labelled rows that are learned from, at most: those of least hash
    groups: int = 8  # learners whose weights are averaged
    passes: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    scale: float = 16.0  # of the feature values


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature of every n-gram occurrence, five for each token, and for each text the number of tokens before it."""
    letters = words.split(data, offsets, words.LETTERS)
    marks = words.split(data, offsets, _MARKS)
    starts = np.concatenate([letters[0], marks[0]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([letters[1], marks[1]])[order]
    first = letters[2] + marks[2]
    h = words.hashes(data, starts, ends)
    capital = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    length = ends - starts
    shape = (order >= len(letters[0])).astype(np.uint64) + 2 * np.minimum(capital[ends] - capital[starts], 3).astype(np.uint64) + 8 * np.minimum(length, 15).astype(np.uint64)
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    for lag in (1, 2, 3):
        same = np.zeros(len(h), dtype=bool)
        same[lag:] = h[lag:] == h[:-lag]
        shape |= np.uint64(128 << lag) * (same & (place >= lag)).astype(np.uint64)
    families = []
    for k, (x, order_n) in enumerate(((h, 1), (h, 2), (shape, 1), (shape, 2), (shape, 3))):
        g = words.mix(x + np.uint64((k + 1) * words._BASE % 2**64))
        for lag in range(1, order_n):
            before = np.zeros_like(x)
            before[lag:] = x[:-lag]
            before[place < lag] = 0
            g = words.mix(g * np.uint64(words._BASE) + before)
        families.append(g >> np.uint64(64 - bits))
    return np.stack(families, axis=1) if len(h) else np.zeros((0, 5), np.uint64), first


def _sparse(column: pa.Array, s: Settings) -> tuple[pa.Array, pa.Array]:
    """Distinct features of each text and their values."""
    data, offsets = words.utf8(column)
    index, value, ends = [], [], [0]
    for i, j in words.runs(offsets):
        f, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], s.bits)
        for a, b in zip(first[:-1], first[1:], strict=True):
            u, n = np.unique(f[a:b], return_counts=True)
            index.append(u.astype(np.int32))
            value.append((n * (s.scale / max(1, b - a))).astype(np.float32))
            ends.append(ends[-1] + len(u))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return tuple(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cat(x, t))) for x, t in ((index, np.int32), (value, np.float32)))


def _ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights by follow-the-regularised-leader, per coordinate; the bias is the last coordinate and isn't regularised."""
    d = (1 << s.bits) + 1
    z, n, w = np.zeros(d), np.zeros(d), np.zeros(d)
    shrink = np.full(d, s.l1)
    shrink[-1] = 0
    for _ in range(s.passes):
        for y, i, x in rows:
            i, x = np.append(i, d - 1), np.append(x, 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= shrink[i], 0.0, -(zi - np.sign(zi) * shrink[i]) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))
            w[i] = wi
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - y) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * wi
            n[i] = ni + g * g
    w = np.where(np.abs(z) <= shrink, 0.0, -(z - np.sign(z) * shrink) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    return w[:-1], float(w[-1])


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each hashed feature
    bias: float
    settings: Settings


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:  # noqa: B008
    """Learn from the labelled rows for which `usable` holds, at most settings.sample of them.

    The sample is those of least hash of the key. Null keys and labels aren't used; a key that is labelled more than
    once counts with its largest label. With no labelled rows every score is one half.
    """
    s = settings
    ids = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable).groupBy(key).agg(F.max(label).alias("_y"))
    ids = ids.orderBy(F.xxhash64(key), key).limit(s.sample)  # bounded by settings.sample, so it may be broadcast
    rows = docs.select(key, text).join(F.broadcast(ids), key)

    def sparse(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        index, value = _sparse(batch.column(text), s)
        return {"_i": index, "_x": value}

    rows = with_arrow(rows, {"_i": T.ArrayType(T.IntegerType()), "_x": T.ArrayType(T.FloatType())}, sparse, keep=[key, "_y"])
    rows = rows.select(F.xxhash64(key).alias("_h"), F.col("_y").cast("double"), "_i", "_x").withColumn("_g", F.pmod("_h", F.lit(s.groups)))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_h", "_y"])
        order = np.random.Generator(np.random.PCG64(7)).permutation(len(group))
        w, bias = _ftrl([(group["_y"].iat[i], group["_i"].iat[i], group["_x"].iat[i]) for i in order], s)
        at = np.flatnonzero(w)
        return pd.DataFrame({"n": [len(group)], "bias": [bias], "i": [at.astype(np.int32)], "w": [w[at]]})

    w, bias, total = np.zeros(1 << s.bits), 0.0, 0
    for r in rows.groupBy("_g").applyInPandas(learn, "n long, bias double, i array<int>, w array<double>").collect():  # settings.groups rows
        w[np.array(r["i"], dtype=np.int64)] += r["n"] * np.array(r["w"])
        bias, total = bias + r["n"] * r["bias"], total + r["n"]
    return Model((w / max(total, 1)).astype(np.float32), bias / max(total, 1), s)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, the probability of label 1 for the whole text. A null or empty text gets the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(model.weights)
    bias, s = model.bias, model.settings

    def probability(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = words.utf8(batch.column(text))
        p = np.zeros(batch.num_rows)
        for i, j in words.runs(offsets):
            f, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], s.bits)
            total = np.concatenate([[0.0], np.cumsum(held.value[f].sum(axis=1, dtype=np.float64))])
            p[i:j] = (total[first[1:]] - total[first[:-1]]) * (s.scale / np.maximum(1, np.diff(first)))
        return {out: pa.array(1 / (1 + np.exp(-np.clip(p + bias, -35, 35))))}

    return with_arrow(docs, {out: T.DoubleType()}, probability)


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the key's text leaves this remainder; false for null keys."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; held-out rows are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, "quality", ~held_out(F.col("doc_id"), 4, 2))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
