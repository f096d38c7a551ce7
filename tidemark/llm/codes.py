"""Compression of vectors to codes of their parts, by tables over each dimension's distinct values.

Components are turned into integers, of which a dimension has far fewer than there are vectors. Each block of vectors is
stored once as dictionaries: for each dimension its distinct integers, and for each vector the place of its own among
them. For given codebooks the squared differences of every distinct integer to all entries are tabulated; the distances
of a part are then gathers from its dimensions' tables by the stored places, and additions. New entries come from counts
of (entry, place), again without touching the vectors. Only sums, as many as the codebooks have numbers, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import settle


@dataclass(frozen=True)
class Settings:
    scale: int = 4096  # integers are floor(scale * component)
    parts: int = 8
    entries: int = 16  # of each part's codebook, at most 256
    rounds: int = 6


_HEX = np.array([f"{i:02x}" for i in range(256)], dtype="S2")


def _integers(vectors: pa.Array, dim: int, s: Settings) -> np.ndarray:
    """One row for each vector. Squared distances, and their sums over a vector, must fit into 64 bits."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * s.scale).reshape(-1, dim)
    if x.size and 4 * float(np.abs(x).max()) ** 2 * dim >= 2**62:
        raise ValueError("components are too large for distances of 64 bits")
    return x.astype(np.int64)


def tables(values: list[np.ndarray], book: np.ndarray) -> list[np.ndarray]:
    """Of each dimension, the squared differences of its distinct values (rows) to the entries (columns); book is
    parts x entries x width."""
    width = book.shape[2]
    return [(v[:, None] - book[d // width, :, d % width][None, :]) ** 2 for d, v in enumerate(values)]


def assign(values: list[np.ndarray], places: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (parts x vectors; the lower index of equals), and its squared distance."""
    parts, entries, width = book.shape
    squares = tables(values, book)
    nearest, least = np.empty((parts, places.shape[1]), np.int64), np.empty((parts, places.shape[1]), np.int64)
    for p in range(parts):
        far = np.zeros((places.shape[1], entries), np.int64)
        for d in range(p * width, (p + 1) * width):
            far += squares[d][places[d]]
        nearest[p] = far.argmin(axis=1)
        least[p] = far[np.arange(len(far)), nearest[p]]
    return nearest, least


def _unpack(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[dict, list[np.ndarray], np.ndarray]]:
    for row in range(batch.num_rows):
        flat = batch.column("values")[row].values.to_numpy(zero_copy_only=False)
        sizes = batch.column("sizes")[row].values.to_numpy(zero_copy_only=False)
        places = np.frombuffer(batch.column("places")[row].as_buffer(), dtype="<u2").reshape(dim, -1)
        yield {c: batch.column(c)[row].values for c in ("ids", "labels")}, np.split(flat, np.cumsum(sizes)[:-1]), places


def _packed(rows: DataFrame, dim: int, s: Settings) -> DataFrame:
    """Blocks of vectors as dictionaries; rows are (id, label, v)."""
    made = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType))])
    made = made.add("values", T.ArrayType(T.LongType())).add("sizes", T.ArrayType(T.IntegerType())).add("places", T.BinaryType())

    def pack(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 1 << 14):  # places are numbers of 16 bits
                batch = whole.slice(begin, 1 << 14)
                found = [np.unique(x, return_inverse=True) for x in _integers(batch.column("v"), dim, s).T]
                lists = {"ids": batch.column("id"), "labels": batch.column("label"), "values": pa.array(np.concatenate([f[0] for f in found])), "sizes": pa.array([len(f[0]) for f in found], pa.int32())}
                one = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in lists.items()}
                one["places"] = pa.array([np.stack([f[1].ravel() for f in found]).astype("<u2").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([one[c] for c in made.names], names=made.names)

    return rows.mapInArrow(pack, made)


def _means(blocks: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = book.shape

    def run(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros(book.shape, np.int64)
        for batch in batches:
            for _, values, places in _unpack(batch, parts * width):
                nearest, _ = assign(values, places, book)
                for d, v in enumerate(values):
                    p = d // width
                    held = np.bincount(nearest[p] * len(v) + places[d], minlength=entries * len(v)).reshape(entries, len(v))
                    total[p, :, d % width] += held @ v
                    if d % width == 0:
                        n[p] += held.sum(axis=1)
        p, e, i = (x.ravel() for x in np.indices(book.shape, dtype=np.int32))
        held = np.repeat(n.ravel(), width)
        some = held > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (p, e, i, held, total.ravel())], names=["p", "e", "i", "n", "s"])

    sums = blocks.select("ids", "labels", "values", "sizes", "places").mapInArrow(run, "p int, e int, i int, n long, s long")
    found, new = sums.groupBy("p", "e", "i").agg(F.sum("n"), F.sum("s")).collect(), book.copy()  # a row for each number of the codebooks
    for p, e, i, n, s in found:
        new[p, e, i] = s // n
    return new


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray | None]:  # noqa: B008
    """((key, label, code, error) of every vector, the codebooks as parts x entries x width).

    Vectors that are null, empty or hold null or non-finite components are dropped, and those of another length than most
    have (of lengths that the parts divide; of equally frequent ones the shorter). Keys are integers; rows without a key
    stay and come last in the order from which the codebooks begin; rows that share a key come there by their vectors.
    Repeated rows each have their result. With fewer vectors than entries a codebook has as many entries as there are
    vectors. An empty table gives an empty result and no codebooks. Components so large that distances don't fit into 64
    bits raise an error.
    """
    s = settings
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("dim")).count().where(F.col("dim") % s.parts == 0)
    dim = lengths.orderBy(F.desc("count"), "dim").limit(1).collect()
    none = "id long, code string, error long"
    if not dim:
        return df.sparkSession.createDataFrame([], none).select(F.col("id").alias(key), F.lit(None).cast(df.schema[label].dataType).alias("label"), "code", "error"), None
    dim = dim[0]["dim"]
    rows = rows.where(F.size("v") == dim)
    first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(s.entries).toArrow()
    book = np.ascontiguousarray(_integers(first.column("v"), dim, s).reshape(-1, s.parts, dim // s.parts).transpose(1, 0, 2))
    blocks = settle(_packed(rows, dim, s), "blocks")
    for _ in range(s.rounds):
        book = _means(blocks, book)
    made = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", df.schema[label].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        for batch in batches:
            for kept, values, places in _unpack(batch, dim):
                nearest, least = assign(values, places, book)
                code = np.ascontiguousarray(_HEX[nearest.T]).view(f"S{2 * s.parts}").ravel()
                columns = [kept["ids"], kept["labels"], pa.array(code.astype(str), pa.string()), pa.array(least.sum(axis=0))]
                yield pa.RecordBatch.from_arrays(columns, names=made.names)

    return blocks.mapInArrow(run, made).withColumnRenamed("id", key), book


def digest(book: np.ndarray) -> str:
    """SHA-256 of the codebooks' decimal numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's code, its squared error, that of its label's vectors together, and the codebooks' digest."""
    coded, book = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = settle(coded, "coded")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit("" if book is None else digest(book)).alias("codebooks_sha256"))
