"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids end together.

Tokens of both are given by the offsets where they end. Where both end, a group closes. Mostly one token stands against
one, so a run is skipped along its diagonal: while the index shift between the two arrays of ends stays the same, stretches
of doubling length are compared at once, and the end of the run is found by halving. What is left is irregular: the
smaller end moves on until both meet again, which gives the new shift.

Ids that end together are counted over the whole corpus. Each task deals its documents out into chunks of bounded size,
and keeps the distinct pairs of ids of a chunk as a dictionary into which the documents' links point. Only dictionaries
meet the corpus' counts, so no pair of ids, however frequent, has more rows than there are chunks.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import vocabulary
from tidemark.llm.storage import settle

CHUNK_BYTES = 1 << 20  # of text; a longer text is a chunk of its own
PROBE = 16  # tokens that are compared one by one, before stretches are


def _skip(x: bytes, y: bytes, i: int, j: int, most: int) -> int:
    """How many entries from i on in x equal those from j on in y, at most `most`: by stretches of doubling length, then
    halving ones."""
    same, step = 0, PROBE
    while same + step <= most and x[(i + same) * 8 : (i + same + step) * 8] == y[(j + same) * 8 : (j + same + step) * 8]:
        same += step
        step *= 2
    while step > 1:
        step //= 2
        if same + step <= most and x[(i + same) * 8 : (i + same + step) * 8] == y[(j + same) * 8 : (j + same + step) * 8]:
            same += step
    return same


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For increasing ends of tokens: the indices in a and in b of the tokens that end together, in order.

    The last entries of a and b must be equal. No tokens at all give no indices.
    """
    n, m = len(a), len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = a.astype("<i8").tobytes(), b.astype("<i8").tobytes()  # stretches compare as bytes
    ends_a, ends_b = [*a.tolist(), -1], [*b.tolist(), -2]  # what follows the last tokens never agrees
    at_a, at_b, runs = [], [], []
    i = j = 0
    while i < n:
        u, v = ends_a[i], ends_b[j]
        while u != v:  # an irregular group: the smaller end moves on; where they meet, the shift j - i is a new one
            if u < v:
                i += 1
                u = ends_a[i]
            else:
                j += 1
                v = ends_b[j]
        at_a.append(i)
        at_b.append(j)
        k, short = 1, PROBE
        while k < short and ends_a[i + k] == ends_b[j + k]:  # few tokens are compared one by one
            k += 1
        if k == short:
            k += _skip(x, y, i + k, j + k, min(n - i, m - j) - k)
        runs.append(k)
        i, j = i + k, j + k
    runs = np.array(runs, np.int64)
    inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(np.array(at_a, np.int64), runs) + inside, np.repeat(np.array(at_b, np.int64), runs) + inside


class Aligner:
    """Encodes by a byte-level BPE (a) and a sentencepiece model (b), and aligns what they give."""

    def __init__(self, bpe: str, pieces: str):
        ranks, _ = vocabulary(bpe)
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_text = np.array([[f"{i},", f"{i}|"] for i in range(len(self.a_bytes))], object)
        self.b_text = np.array([[f"{i},", f"{i};"] for i in range(len(self.b_bytes))], object)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids by a and by b of a text with a space before it; none where the tokens' bytes aren't the text's."""
        spaced = f" {text}"
        whole, b = spaced.encode(), self.b.encode(text, num_threads=1) if text else []
        if text and b"".join(map(self.b_bytes.__getitem__, b)) == whole:
            a = np.array(self.a.encode_ordinary(spaced), np.int64)
            if int(self.a_sizes[a].sum()) == len(whole):
                return a, np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3` of the groups that close at these indices."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        whole = np.empty(len(a) + len(b), object)
        closed = np.cumsum(last_a) - last_a  # groups closed before each token
        whole[np.arange(len(a)) + np.concatenate([[0], at_b + 1])[closed]] = self.a_text[a, last_a]
        closed = np.cumsum(last_b) - last_b
        whole[np.arange(len(b)) + (at_a + 1)[closed]] = self.b_text[b, last_b]
        return "".join(whole.tolist())[:-1]


@lru_cache(maxsize=2)
def aligner(bpe: str, pieces: str) -> Aligner:
    """One for each worker process and pair of files."""
    return Aligner(bpe, pieces)


_BLOCK = "chunk long, pairs array<long>, counts array<int>, ids array<long>, n_a array<int>, n_b array<int>, sha array<string>, links array<int>, places binary"
_COUNTED = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _blocks(rows: DataFrame, bpe: str, pieces: str) -> DataFrame:
    """A row for each chunk of documents: its dictionary of pairs (a << 32 | b) with their counts, and for each document
    its numbers and its links as places in the dictionary."""

    def encoded(batches):
        made = 0
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            begin, size = 0, 0
            for end, text in enumerate(texts):
                if end > begin and size + len(text or "") > CHUNK_BYTES:
                    yield block(made, ids[begin:end], texts[begin:end])
                    begin, size, made = end, 0, made + 1
                size += len(text or "")
            if begin < len(texts):
                yield block(made, ids[begin:], texts[begin:])
                made += 1

    def block(number, ids, texts):
        al = aligner(bpe, pieces)
        n_a, n_b, sha, links = [], [], [], []
        for a, b in (al.encode(t or "") for t in texts):
            at_a, at_b = align(np.cumsum(al.a_sizes[a]), np.cumsum(al.b_sizes[b]))
            n_a.append(len(a))
            n_b.append(len(b))
            sha.append(hashlib.sha256(al.groups(a, b, at_a, at_b).encode()).hexdigest() if len(a) else "")
            links.append(a[at_a] << 32 | b[at_b])
        pairs, places, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), one(pairs, pa.int64()), one(counts.astype(np.int32), pa.int32()), one(ids, pa.int64()), one(n_a, pa.int32()), one(n_b, pa.int32()),
                one(sha, pa.string()), one([len(x) for x in links], pa.int32()), pa.array([places.astype("<i4").tobytes()], pa.binary()),
            ],
            names=["chunk", "pairs", "counts", "ids", "n_a", "n_b", "sha", "links", "places"],
        )

    return rows.mapInArrow(encoded, _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold the pair, and whether no pair of its b id is more frequent."""
    found = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    found = settle(found, "pairs").withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = found.groupBy("b").agg(F.max("n").alias("most"))
    return found.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _numbers(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            of = lambda c: batch.column(c)[row].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            found = batch.column("found")[row].values
            at, n, best = found.field("place").to_numpy(zero_copy_only=False), np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            n[at], best[at] = found.field("n").to_numpy(zero_copy_only=False), found.field("best").to_numpy(zero_copy_only=False)
            links, places = of("links").astype(np.int64), np.frombuffer(batch.column("places")[row].as_buffer(), dtype="<i4")
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[places])])[np.concatenate([[0], np.cumsum(links)])])  # noqa: B023, E731
            columns = [batch.column("ids")[row].values, *[pa.array(of(c).astype(np.int64)) for c in ("n_a", "n_b")], pa.array(links), pa.array(links), pa.array(sums(best)), pa.array(sums(n)), batch.column("sha")[row].values]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in _COUNTED.split(", ")])


def align_texts(docs: DataFrame, bpe: str, pieces: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, the corpus' (a, b, n, best)).

    A link is a token of a and one of b that end at the same byte; tokens are never empty, so each group has one. n is the
    number of links of two ids in the whole corpus, best whether no id of a has more with that id of b. n_best counts a
    row's links whose ids are best, count_sum adds up their n. Null and empty texts, and those whose tokens don't have the
    text's bytes (after a space), have no tokens: zeros, and an empty digest. Keys are integers; rows without one, and
    repeated rows, each have their result and count like others. An empty table gives empty results.
    """
    blocks = settle(_blocks(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), bpe, pieces), "blocks")
    counts = settle(pair_counts(blocks), "counts")
    asked = blocks.select("chunk", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
    found = asked.groupBy("chunk").agg(F.collect_list(F.struct("place", "n", "best")).alias("found"))  # no longer than the chunk's dictionary
    rows = blocks.drop("pairs", "counts").join(found, "chunk", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<place:int,n:bigint,best:boolean>>")))
    out = rows.select("ids", "n_a", "n_b", "sha", "links", "places", "found").mapInArrow(_numbers, _COUNTED).withColumnRenamed("id", key)
    table = counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "n", "best")
    return out, table


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's numbers of tokens, groups and links by both tokenizers, and how usual its links are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
