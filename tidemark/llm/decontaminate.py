"""Benchmark decontamination: documents that hold a passage like a benchmark item.

An item of n words is compared with the windows of n words of every text (a window at the end may be shorter). Both are
sets of shingles of five words, or of n where an item has fewer; a shingle's weight is one over the number of items it occurs in, one if in none. Their
similarity is the weight that both have over the weight of the heavier one.

1. One scan of the texts keeps those that have a shingle of some item, told by a set of hash bits, as shingle hashes.
2. A like window lacks at most a fifth of the item's weight, so it has one of the item's heaviest shingles, those that
   make up more than a fifth. A join on these gives the stretches of texts where an item can be.
3. Each stretch is searched by itself: windows, at every word, that have enough of the item's weight get 128-bit SimHash
   fingerprints, in which a shingle counts with the root of its weight, so that the expected share of equal bits follows
   the similarity. A multi-index over 16 blocks of 8 bits finds all windows within the radius of the item's fingerprint:
   of 45 differing bits at most 2 fall into some block. What it finds is verified by the exact similarity.

Nothing of the benchmark but the set of bits is brought to the driver, and texts that are equal are searched once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words
from tidemark.llm.storage import settle


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    radius: int = 45  # of 128 bits; at similarity 0.8 a bit differs with probability 0.205: mean 26.2, deviation 4.6
    blocks: int = 16  # of 8 bits
    bits_per_shingle: int = 64  # of the set by which texts are told apart
    least_bits: int = 22  # binary logarithm of its size at least
    most_bits: int = 30  # and at most; beyond, texts are kept that needn't be


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def fingerprint(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """16 bytes: the signs of the sums of the shingles' bits, each with the root of its weight."""
    bits = np.unpackbits(np.stack([shingles, words.mix(shingles + np.uint64(0x632BE59BD9B4E019))], axis=1).view(np.uint8), axis=1)
    return np.packbits(np.sqrt(weights) @ (bits.astype(np.float32) * 2 - 1) > 0)


def _shingles(column: pa.Array, k: int):
    """For runs of texts: index of the first one, shingle hashes, their number before each text, words before each text."""
    data, offsets = words.utf8(column)
    for i, j in words.runs(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = words.split(part, offsets[i : j + 1] - offsets[i], words.LETTERS)
        h, before, _ = words.shingles(words.hashes(part, starts, ends), first, k)
        yield i, h, before, first


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind)))


def _items(items: DataFrame, item: str, text: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(item, n, x, w, total, heavy): every item with its number of words, distinct shingles, their weights, the weights'
    sum, and its heaviest shingles; and (s, w): every shingle's weight. Repeated items count once."""
    rows = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("t")).distinct()
    made = T.StructType([T.StructField("item", items.schema[item].dataType)]).add("n", "integer").add("x", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            for i, h, before, first in _shingles(batch.column("t"), s.shingle):
                sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(before[:-1], before[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("item")[i : i + len(sets)], pa.array(np.diff(first), pa.int32()), _lists(sets, np.int64)], names=made.names)

    sets = settle(rows.mapInArrow(run, made).where(F.size("x") > 0).withColumn("u", F.xxhash64("x", "n")), "items")
    known = settle(sets.select(F.explode("x").alias("s")).groupBy("s").agg((F.lit(1.0) / F.count("*")).alias("w")), "known")
    weighed = sets.select("item", "n", "u", F.explode("x").alias("s")).join(known, "s").groupBy("item", "n", "u").agg(F.sort_array(F.collect_list(F.struct("w", "s")), asc=False).alias("y"))
    weighed = weighed.select("item", "n", F.col("y.s").alias("x"), F.col("y.w").alias("w")).withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    # the heaviest shingles, until their weight exceeds what a like window may lack
    lacks = F.col("total") * (1 - s.similarity) + 1e-9
    count = F.aggregate("w", F.struct(F.lit(0.0).alias("a"), F.lit(0).alias("c")), lambda a, x: F.when(a["a"] > lacks, a).otherwise(F.struct((a["a"] + x).alias("a"), (a["c"] + 1).alias("c"))))
    return settle(weighed.withColumn("heavy", F.slice("x", F.lit(1), count["c"])), "weighed"), known


def _slot(h: np.ndarray, k: int, size: int) -> np.ndarray:
    """The k-th of three places of each hash in a set of size bits, a power of two."""
    h = words.mix(h ^ np.uint64(k * 0xA0761D6478BD642F % 2**64)) if k else h
    return (h & np.uint64(size - 1)).astype(np.int64)


def _bits(known: DataFrame, s: Settings) -> np.ndarray:
    """The set of the known shingles' hash bits, three for each, of at most 2**most_bits. Tasks send words of it."""
    size = 1 << max(s.least_bits, min(s.most_bits, (s.bits_per_shingle * known.count()).bit_length()))

    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate([_slot(batch.column("s").to_numpy().view(np.uint64), k, size) for k in range(3)]))
            i, first = np.unique(at >> 6, return_index=True)
            b = np.bitwise_or.reduceat(np.int64(1) << (at & 63), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(b, pa.int64())], names=["i", "b"])

    found = known.select("s").mapInArrow(run, "i long, b long").groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2**(most_bits - 6) rows
    bits = np.zeros(size >> 6, np.int64)
    bits[found.column("i").to_numpy()] = found.column("b").to_numpy()
    return bits


def _hits(docs: DataFrame, key: str, text: str, known: DataFrame, s: Settings) -> DataFrame:
    """(d, u1, u2, h, hits): the texts with a shingle whose bit is set, as shingle hashes, and those shingles' places."""
    held = docs.sparkSession.sparkContext.broadcast(_bits(known, s))
    long = T.ArrayType(T.LongType())
    made = T.StructType([T.StructField("d", docs.schema[key].dataType)]).add("u1", "long").add("u2", "long").add("h", long).add("hits", T.ArrayType(T.IntegerType()))

    def run(batches):
        bits = held.value
        for batch in batches:
            for i, h, before, _ in _shingles(batch.column("t"), s.shingle):
                hit = np.arange(len(h))
                for k in range(3):  # few are left after the first
                    at = _slot(h[hit], k, len(bits) * 64)
                    hit = hit[((bits[at >> 6] >> (at & 63)) & 1).astype(bool)]
                texts = np.unique(np.searchsorted(before, hit, side="right") - 1)
                ends = np.searchsorted(hit, before)
                rows = pa.array(texts + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(rows) for c in ("d", "u1", "u2")]
                    + [_lists([h[before[t] : before[t + 1]].view(np.int64) for t in texts], np.int64), _lists([hit[ends[t] : ends[t + 1]] - before[t] for t in texts], np.int32)],
                    names=made.names,
                )

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("d"), F.col(text).alias("t"))
    return rows.withColumns({"u1": F.xxhash64("t"), "u2": F.xxhash64(F.lit(1), "t")}).mapInArrow(run, made)


def search(h: np.ndarray, weights: np.ndarray, x: np.ndarray, w: np.ndarray, n: int, s: Settings, starts: int | None = None) -> tuple[float, int] | None:
    """Largest similarity of an item of n words with a window of the shingles h, and the first such window's place; None
    below s.similarity. weights are those of h; x are the item's distinct shingles in order and w their weights. The
    window begins at one of the first `starts` places."""
    size, total = max(1, n - s.shingle + 1), w.sum()
    at = np.minimum(np.searchsorted(x, h), len(x) - 1)
    inside = x[at] == h
    sums = np.concatenate([[0.0], np.cumsum(np.where(inside, w[at], 0.0))])
    first = np.arange(min(len(h), starts if starts is not None else len(h)))
    enough = sums[np.minimum(first + size, len(h))] - sums[first] >= s.similarity * total - 1e-9  # repeated shingles only add to it
    best, own = None, fingerprint(x, w)
    for p in np.flatnonzero(enough).tolist():
        window, places = np.unique(h[p : p + size], return_index=True)
        of = weights[p + places]
        differ = _POPCOUNT[fingerprint(window, of) ^ own]
        if differ.min() > s.radius // s.blocks or differ.sum() > s.radius:  # no block is near enough, or all together aren't
            continue
        similarity = float(of[inside[p + places]].sum() / max(of.sum(), total))
        if similarity >= s.similarity - 1e-12 and (best is None or similarity > best[0] + 1e-12):
            best = similarity, p
    return best


def _found(rows: DataFrame, s: Settings) -> DataFrame:
    """(u1, u2, item, similarity, first_word, n_words) of the stretches in which the item is found."""
    made = T.StructType([rows.schema[c] for c in ("u1", "u2", "item")]).add("similarity", "double").add("first_word", "integer").add("n_words", "integer")

    def run(batches):
        for batch in batches:
            cols = {c: batch.column(c) for c in ("h", "places", "of", "x", "w")}
            flat = {c: (v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)) for c, v in cols.items()}
            start, n, starts = (batch.column(c).to_numpy() for c in ("start", "n", "starts"))
            found = []
            for r in range(batch.num_rows):
                h, places, of, x, w = (v[o[r] : o[r + 1]] for o, v in flat.values())
                weights = np.ones(len(h))
                weights[places - start[r]] = of
                order = np.argsort(x.view(np.uint64))
                best = search(h.view(np.uint64), weights, x.view(np.uint64)[order], w[order], int(n[r]), s, int(starts[r]))
                if best:
                    found.append((r, best[0], best[1] + int(start[r]), int(n[r])))
            got = list(zip(*found, strict=True)) or [[]] * 4
            take = pa.array(got[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("u1", "u2", "item")] + [pa.array(got[1], pa.float64()), pa.array(got[2], pa.int32()), pa.array(got[3], pa.int32())], names=made.names
            )

    return rows.mapInArrow(run, made)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(key, item, similarity, first_word, n_words): a row for each document id and benchmark item found in it.

    The best window is given, the first of equals, by its first word (from 0) and the item's number of words. Words are
    runs of letters and digits, A-Z folded to a-z. An item of fewer than five words is one shingle of its length, which is
    found anywhere in a text; a text of fewer words than an item's shingles have is one shingle. Null, empty and wordless texts and items match nothing, nor do null ids of either.
    Documents or items that share an id are one, whose best window counts; of repeated rows there is one.
    """
    s = settings
    weighed, known = _items(items, item, item_text, s)
    lengths = weighed.agg(F.collect_set(F.least("n", F.lit(s.shingle)))).first()[0] or [s.shingle]  # at most s.shingle numbers
    named = None
    for k in sorted(lengths):  # texts are cut into shingles of each length that items have: one scan each
        part = _leaks(docs, weighed.where(F.least("n", F.lit(s.shingle)) == k), known, key, text, replace(s, shingle=k))
        named = part if named is None else named.unionByName(part)
    best = F.max_by(F.struct("similarity", "first_word", "n_words"), F.struct("similarity", -F.col("first_word"))).alias("best")
    named = named.groupBy("d", "item").agg(best)
    return named.select(F.col("d").alias(key), F.col("item").alias(item), "best.similarity", "best.first_word", "best.n_words")


def _below(places, x) -> Column:
    """How many of the ascending places are below x, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(31))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(places, at + step - 1) < x, at + step).otherwise(at))


def _leaks(docs: DataFrame, weighed: DataFrame, known: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """(d, item, similarity, first_word, n_words), perhaps several a document and item: of items whose shingles have
    s.shingle words."""
    hits = settle(_hits(docs, key, text, known, s), "hits")
    texts = hits.dropDuplicates(["u1", "u2"]).select("u1", "u2", "h", "hits")
    places = texts.select("u1", "u2", F.explode(F.transform("hits", lambda p: F.struct(p.alias("p"), F.get("h", p).alias("s")))).alias("x")).select("u1", "u2", "x.*")
    places = settle(places.join(known, "s"), "places")
    # an item's stretches of n words with a heavy shingle; windows that have it start in this stretch or the one before
    heavy = weighed.select("item", "n", F.explode("heavy").alias("s")).distinct()
    spots = places.join(heavy, "s").select("u1", "u2", "item", "n", F.floor(F.col("p") / F.col("n")).cast("int").alias("b")).distinct()
    start, end = F.greatest(F.lit(0), (F.col("b") - 1) * F.col("n")), (F.col("b") + 2) * F.col("n")
    spots = spots.select("u1", "u2", F.struct("item", "n", start.alias("start"), end.alias("end"), ((F.col("b") + 1) * F.col("n") - start).alias("starts")).alias("spot"))
    spots = settle(spots.groupBy("u1", "u2").agg(F.collect_list("spot").alias("spots")), "spots")  # as many as three times the text's words for each item
    weights = places.groupBy("u1", "u2").agg(F.sort_array(F.collect_list(F.struct("p", "w"))).alias("known"))  # as many as the text has words
    rows = texts.select("u1", "u2", "h").join(spots, ["u1", "u2"]).join(weights, ["u1", "u2"]).select("*", F.col("known.p").alias("p"))
    rows = rows.select("u1", "u2", "h", "known", "p", F.explode("spots").alias("spot"))  # only the cut is carried on to the join
    low, high = _below(F.col("p"), F.col("spot.start")), _below(F.col("p"), F.col("spot.end"))
    of, h = F.slice("known", low + 1, high - low), F.slice("h", F.col("spot.start") + 1, F.col("spot.end") - F.col("spot.start"))
    rows = rows.select("u1", "u2", "spot.item", "spot.n", "spot.start", "spot.starts", h.alias("h"), of.alias("of")).withColumns({"places": F.col("of.p"), "of": F.col("of.w")})
    found = settle(_found(rows.join(weighed.select("item", "n", "x", "w"), ["item", "n"]), s), "found")
    return hits.select("d", "u1", "u2").join(found, ["u1", "u2"]).drop("u1", "u2")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without those that hold a benchmark passage; rows without an id stay."""
    found = settle(leaks(docs, items, key, text, **options).select(key).distinct(), "leaks")
    return docs.join(found, key, "left_anti").select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which an item of the benchmark is found, with its best window."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
