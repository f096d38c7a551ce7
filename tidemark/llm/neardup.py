"""Near-duplicate documents by b-bit MinHash: bands give candidates, bit counts estimate, whole sets confirm.

1. One pass over the whole texts gives each document its number of distinct shingles, a 128-bit digest of the set, the
   hashes of its bands of minima, and its packed signature: the low `bits` bits of every minimum.
2. Documents of equal sets are one class, stood for by its smallest id, so copies are never paired.
3. Each class is compared with the leader (smallest id) of every band bucket it is in; of those whose estimate passes,
   the best is confirmed on full sets. That connects groups of any size with at most one confirmation a class.
4. What is left are pairs in one bucket that are not connected yet. All of them whose estimate passes are confirmed, so
   the result is that of confirming every candidate pair, without emitting the pairs inside connected groups. Before,
   a parity sketch rules pairs out for certain: each shingle flips one of its bits, so two sketches differ in no more
   bits than the sets do in shingles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words
from tidemark.llm.batches import with_arrow
from tidemark.llm.graph import components
from tidemark.llm.storage import settle


#: Members of a part of a large bucket.
PART = 256


@dataclass(frozen=True)
class Settings:
    shingle: int = 5  # words
    percent: int = 80  # least similarity: 100 * intersection >= percent * union
    bands: int = 30  # 30 bands of 5 minima miss a pair of similarity 0.8 with probability 7e-6
    rows: int = 5
    lanes: int = 256  # minima whose low bits are kept, those of the bands among them
    bits: int = 2  # kept of each minimum
    sigmas: float = 4.5  # deviations by which a true pair's bit count may be off: 3e-6 of the pairs at the least similarity are off by more
    parity_bits: int = 2048  # of each set's parity sketch, a multiple of 64
    least_bits: int = 24  # binary logarithm of the size of the set by which texts to be confirmed are told apart, at least
    most_bits: int = 30  # and at most; it grows with their number, and beyond, sets are written that aren't needed

    @property
    def minima(self) -> int:
        return max(self.lanes, self.bands * self.rows)

    @property
    def longs(self) -> int:
        return -(-self.minima // 64)

    @property
    def most_different(self) -> int:
        """Most lanes that may differ. Two lanes differ with probability (1 - 2**-bits) * (1 - similarity)."""
        p = (1 - 2.0**-self.bits) * (1 - self.percent / 100)
        return math.floor(self.minima * p + self.sigmas * math.sqrt(self.minima * p * (1 - p)))

    def multipliers(self) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(self.minima)).integers(1, 2**64 - 1, self.minima, dtype=np.uint64) | np.uint64(1)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and for each text the number before it."""
    starts, ends, first = words.split(data, offsets, words.NOT_SPACE)
    h, before, _ = words.shingles(words.hashes(data, starts, ends), first, k)
    out, counts = [], [0]
    for a, b in zip(before[:-1], before[1:], strict=True):
        s = np.sort(h[a:b])
        s = s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
        out.append(s)
        counts.append(len(s))
    return np.concatenate(out) if out else h[:0], np.cumsum(counts)


def _columns(column: pa.Array, s: Settings) -> dict[str, pa.Array]:
    data, offsets = words.utf8(column)
    n = len(offsets) - 1
    size, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    bands, packed = np.zeros((n, s.bands), np.uint64), np.zeros((n, s.bits * s.longs), np.uint64)
    parity = np.zeros((n, s.parity_bits // 64), np.uint64)
    times = s.multipliers()
    for i, j in words.runs(offsets):
        sets, before = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], s.shingle)
        size[i:j] = np.diff(before)
        some = i + np.flatnonzero(np.diff(before))
        if not len(some):
            continue
        at = before[:-1][some - i]
        one[some] = np.add.reduceat(words.mix(sets), at)
        two[some] = np.bitwise_xor.reduceat(words.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), at)
        flipped = np.repeat(np.arange(j - i), np.diff(before)) * s.parity_bits + (sets % np.uint64(s.parity_bits)).astype(np.int64)
        flipped = np.bincount(flipped, minlength=(j - i) * s.parity_bits).astype(np.uint8) & 1
        parity[i:j] = np.packbits(flipped.reshape(j - i, -1), axis=1, bitorder="little").view(np.uint64)
        minima = np.empty((s.minima, len(some)), np.uint64)
        h, high = np.empty_like(sets), np.empty_like(sets)
        for m in range(s.minima):  # a product alone is no fair choice of a minimum, so its halves are folded and multiplied again
            np.multiply(sets, times[m], out=h)
            np.right_shift(h, np.uint64(32), out=high)
            np.bitwise_xor(h, high, out=h)
            np.multiply(h, np.uint64(0xD6E8FEB86659FD93), out=h)
            minima[m] = np.minimum.reduceat(h, at)
        for b in range(s.bands):
            h = np.full(len(some), (b + 1) * words._BASE % 2**64, np.uint64)
            for m in minima[b * s.rows : (b + 1) * s.rows]:
                h = words.mix(h * np.uint64(words._BASE) + m)
            bands[some, b] = h
        for bit in range(s.bits):
            for w in range(s.longs):
                lanes = words.mix(minima[64 * w : 64 * (w + 1)])
                plane = (lanes >> np.uint64(bit)) & np.uint64(1)
                packed[some, bit * s.longs + w] = np.bitwise_or.reduce(plane << np.arange(len(lanes), dtype=np.uint64)[:, None], axis=0)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.view(np.int64).ravel()))
    return {"n": pa.array(size), "s1": pa.array(one.view(np.int64)), "s2": pa.array(two.view(np.int64)), "bands": lists(bands), "packed": lists(packed), "parity": lists(parity)}


def signatures(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """(id, n, s1, s2, bands, packed, parity) of every row with an id."""
    made = {"n": T.LongType(), "s1": T.LongType(), "s2": T.LongType(), "bands": T.ArrayType(T.LongType()), "packed": T.ArrayType(T.LongType()), "parity": T.ArrayType(T.LongType())}
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    return with_arrow(rows, made, lambda batch: _columns(batch.column("t"), settings), keep=["id"])


def _different(a: Column, b: Column, s: Settings) -> Column:
    """Lanes in which two packed signatures differ."""
    total = F.lit(0)
    for w in range(s.longs):
        lane = F.lit(0).cast("long")
        for bit in range(s.bits):
            i = bit * s.longs + w
            lane = lane.bitwiseOR(a[i].bitwiseXOR(b[i]))
        total = total + F.bit_count(lane)
    return total


def _may_be_similar(n: Column, parity: Column, m: Column, other: Column, s: Settings) -> Column:
    """False only for sets of n and m shingles that differ in too many. Similar sets differ in at most
    (n + m) * (100 - percent) / (100 + percent) of them."""
    differ = F.lit(0)
    for w in range(s.parity_bits // 64):
        differ = differ + F.bit_count(parity[w].bitwiseXOR(other[w]))
    return differ * (100 + s.percent) <= (n + m) * (100 - s.percent)


def _shingle_sets(docs: DataFrame, key: str, text: str, ids: DataFrame, s: Settings) -> DataFrame:
    """(id, set) for at least the documents in ids (id). Which texts to read is told from a set of hash bits, whose
    size grows with their number; where it leaves doubt more sets than needed are made."""
    ids = settle(ids, "ids")
    bits_wanted = max(s.least_bits, min(s.most_bits, (16 * ids.count()).bit_length()))
    slot = F.xxhash64("id").bitwiseAND(F.lit((1 << bits_wanted) - 1))
    word = ids.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(xxhash64(id) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = word.toArrow()  # at most 2**(most_bits - 6) rows
    bits = np.zeros(1 << (bits_wanted - 6), np.int64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bits)
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            at = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array(((held.value[at >> 6] >> (at & 63)) & 1).astype(bool)))
            data, offsets = words.utf8(batch.column("t"))
            for i, j in words.runs(offsets):
                sets, before = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], s.shingle)
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(sets.view(np.int64)))], names=["id", "set"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    return rows.select("id", "t", slot.alias("slot")).mapInArrow(run, schema)


def _confirmed(docs: DataFrame, key: str, text: str, pairs: DataFrame, s: Settings) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = settle(_shingle_sets(docs, key, text, ids, s), "sets").dropDuplicates(["id"])
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("n"))
    return both.where(100 * F.col("i") >= s.percent * (F.col("n") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(id, n_shingles, component_id, kept) for every row with an id.

    component_id is the smallest id that links lead to, the row's own included; kept says that it is the row's own.
    Words are runs of bytes other than white space, A-Z folded to a-z. A text with fewer words than a shingle is one
    shingle; null, empty and blank texts have none and link with nothing. Rows that share an id are one document in the
    result's links, each with its own number of shingles. Rows without an id are left out.
    """
    s = settings
    marks = settle(signatures(docs, key, text, s), "signatures")
    filled = marks.where("n > 0")
    # written first, as is `named` below, so that the joins deal out both sides and may split a set that many documents have
    classes = settle(filled.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "class_sets")
    reps = settle(filled.join(classes, ["s1", "s2"]).where("id = rep").select("rep", "n", "bands", "packed", "parity").dropDuplicates(["rep"]), "classes")

    buckets = reps.select("rep", F.explode("bands").alias("k"))
    leaders = buckets.groupBy("k").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("k", "lead")
    buckets = settle(buckets.join(leaders, "k"), "buckets")
    sign = reps.select("rep", "n", "packed", "parity")
    pairs = buckets.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    pairs = pairs.join(sign.select(F.col("rep").alias("a"), F.col("packed").alias("x")), "a").join(sign.select(F.col("rep").alias("b"), F.col("packed").alias("y")), "b")
    pairs = pairs.select("a", "b", _different(F.col("x"), F.col("y"), s).alias("d")).where(F.col("d") <= s.most_different)
    best = settle(pairs.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b")), "pairs")
    edges = settle(_confirmed(docs, key, text, best, s), "links")
    found = settle(components(edges, "a", "b"), "components")

    near = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("k", "rep", F.coalesce("component", "rep").alias("c"))
    near = settle(near, "near")
    # a bucket of many members is dealt out in parts, each of which meets all members outside the bucket's first component
    mixed = near.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("low <> high").select("k", "low", "parts")
    near = near.join(mixed, "k").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    near = settle(near.join(sign, "rep"), "mixed")
    other = near.where("c <> low").select("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rep").alias("b"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("packed").alias("y"), F.col("parity").alias("z"))
    alike = (_different(F.col("packed"), F.col("y"), s) <= s.most_different) & _may_be_similar(F.col("n"), F.col("parity"), F.col("m"), F.col("z"), s)
    rest = near.join(other, ["k", "part"]).where((F.col("c") < F.col("d")) & alike)
    rest = rest.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    rest = rest.join(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = settle(rest, "rest")
    more = settle(_confirmed(docs, key, text, rest, s), "links")
    if not more.isEmpty():
        found = settle(components(edges.unionByName(more), "a", "b"), "components")

    named = settle(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("c")), "named")
    out = filled.select("id", "n", "s1", "s2").join(named, ["s1", "s2"]).select("id", "n", "c").unionByName(marks.where("n = 0").select("id", "n", F.col("id").alias("c")))
    return out.select("id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of two-word shingles and the smallest id that links of similarity 0.8 lead to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, settings=Settings(shingle=2)).withColumnRenamed("id", "doc_id")
