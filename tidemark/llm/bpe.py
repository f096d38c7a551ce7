"""Byte-level BPE: exact encoding by longest matches and backtracking, decoding, and token counts of every prefix.

A row of tokens is the BPE encoding of its bytes exactly if each two adjacent tokens are the encoding of theirs, so
encoding needs no merge queue: at each place the longest token that begins there, found in an automaton of all tokens
(mapped to Latin-1, one character a byte), or the next shorter one that is compatible with the token before is taken, and
where none is, the last one is given up. Each prefix has one encoding, so a place that was given up is never tried again, and the time
is linear in the piece's length. Whether two tokens are compatible is found by merging their few bytes, and remembered.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain
from pathlib import Path

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.batches import with_arrow

#: Remembered pieces and pairs. Results don't depend on it.
MOST_PIECES, MOST_PAIRS = 200_000, 1_000_000


_SPACE = regex.compile(r"\s+")


class _Pieces(dict):
    """Piece -> what `make` gives for it, for the pieces seen lately: when full, it becomes the older half."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece):
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
        self[piece] = value
        return value

    def trim(self) -> None:
        if len(self) > MOST_PIECES:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Encoding by a rank file: the piece pattern, and byte strings with their ids, in merging order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None):
        self.ranks, self.pattern, self.special = ranks, regex.compile(pattern), special or {}
        self.split_special = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.bytes = {i: b for b, i in ranks.items()} | {i: x.encode() for x, i in self.special.items()}
        self.decimal = {i: str(i).encode() for i in self.bytes}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.tokens = {b.decode("latin-1"): i for b, i in ranks.items() if len(b) == 1 or self.merge(b) == [i]}  # others can only be whole pieces
        self.longest, self.longest_rank = max(map(len, self.tokens)), max(map(len, ranks))
        for b, i in self.tokens.items():
            self.automaton.add_word(b, (i, len(b)))
        self.automaton.make_automaton()
        self.cache = _Pieces(lambda piece: tuple(self.encode_piece(piece.encode())))
        self.counts = _Pieces(lambda piece: self.prefix_counts_of_piece(piece.encode())[-1])

    def merge(self, b: bytes) -> list[int]:
        """The definition: the pair of least rank is merged, the leftmost of equals, until none is left. For short bytes."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 20 | b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def encode_piece(self, b: bytes) -> list[int]:
        whole = self.ranks.get(b)
        if whole is not None:
            return [whole]
        text, end, most = b.decode("latin-1"), len(b), self.longest
        token_of, reach, known = self.tokens.get, self.automaton.longest_prefix, self.pairs.get
        path, sizes, given_up = [], [], None
        at, n = 0, reach(text[:most])
        while True:
            while n:  # the longest token that is left to try here
                token = token_of(text[at : at + n])
                if token is not None and not (given_up and at + n in given_up):
                    if not path:
                        break
                    fits = known(path[-1] << 20 | token)
                    if fits or fits is None and self.compatible(path[-1], token):
                        break
                n -= 1
            if n:
                path.append(token)
                sizes.append(n)
                at += n
                if at == end:
                    return path
                n = reach(text[at : at + most])
            else:
                given_up = (given_up or set()) | {at}
                path.pop()
                n = sizes.pop()
                at -= n
                n -= 1

    def prefix_counts_of_piece(self, b: bytes) -> list[int]:
        """Number of tokens of each prefix of a piece, from the empty one to all of it.

        The encoding of a prefix is that of a shorter one and its one last token, the only one compatible with it.
        """
        last, counts, known = [-1] * (len(b) + 1), [0] * (len(b) + 1), self.pairs.get
        for end, (token, n) in self.automaton.iter(b.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - n
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    fits = known(before << 20 | token)
                    if not (fits or fits is None and self.compatible(before, token)):
                        continue
                last[end], counts[end] = token, counts[start] + 1
        if b in self.ranks:
            counts[-1] = 1
        return counts

    def segments(self, text: str):
        """(part, whether it is a special token's string)."""
        if not self.special:
            yield text, False
            return
        at = 0
        for m in self.split_special.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part, special in self.segments(text):
            ids += [self.special[part]] if special else chain.from_iterable(map(self.cache.__getitem__, self.pattern.findall(part)))
        self.cache.trim()
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def count(self, text: str) -> int:
        n = 0
        for part, special in self.segments(text):
            n += 1 if special else sum(map(self.counts.__getitem__, self.pattern.findall(part)))
        self.counts.trim()
        return n

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of text[:i] for every i from 0: any truncation or budget is answered from these numbers.

        Inside a piece the counts of its prefixes are added to those of the pieces before. Where a cut changes how the
        text before it is split, that part is split again: white space that a cut leaves at the end is one piece, a
        contraction or a special string that is cut falls apart. The time is linear in the text's length.
        """
        counts, done, before = [0], 0, ""
        for part, special in self.segments(text):
            if special:
                base = done - self.plain(before)
                counts += [base + self.plain(before + part[:i]) for i in range(1, len(part))] + [done + 1]
                done += 1
                continue
            run, base, begin, before = None, 0, 0, part
            for piece in self.pattern.findall(part):
                inner = self.prefix_counts_of_piece(piece.encode())
                for i, byte in enumerate(accumulate(len(c.encode()) for c in piece), 1):
                    space = _SPACE.match(part, begin + i - 1) if run is None else _SPACE.match(piece[i - 1])
                    if not space:
                        run = None
                        counts.append(done + (self.plain(piece[:i]) if piece[0] == "'" and i < len(piece) else inner[byte]))
                        continue
                    if run is None:
                        run, base = iter(self._run_counts(space[0])), counts[-1]
                    counts.append(base + next(run))
                done += inner[-1]
                begin += len(piece)
            if run is not None:
                counts[-1] = done
        return counts

    def _run_counts(self, space: str) -> list[int]:
        """Number of tokens of each prefix of a run of white space, from its first character on, each as one piece."""
        b = space.encode()
        counts = self.prefix_counts_of_piece(b)
        for end in range(1, min(len(b), self.longest_rank) + 1):
            if b[:end] in self.ranks:  # also tokens that merges don't lead to
                counts[end] = 1
        return [counts[end] for end in accumulate(len(c.encode()) for c in space)]

    def plain(self, text: str) -> int:
        return sum(self.counts[p] for p in self.pattern.findall(text))

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most `budget` tokens."""
        counts = self.prefix_counts(text)
        return text[: max(i for i, n in enumerate(counts) if n <= budget)]


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Byte strings with their ids, in merging order, and the added special tokens, of a .tiktoken rank file or a
    byte-level BPE .json."""
    if path.endswith(".tiktoken"):
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}, {}
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as their own characters
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [spec["model"]["vocab"]["".join(m)] for m in merges]
    if made != sorted(made):
        raise ValueError("ids are not in merging order")
    return vocab, special


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; one for each worker process and file. Of a .json the added special tokens are
    recognised inside texts, as its library does by default."""
    vocab, special = vocabulary(path)
    return Encoder(vocab, public_tokenizers.PATTERN, special)


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids of each whole text; a null or empty text has none."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        e = encoder(path)
        return {out: pa.array((np.array(e.encode(t or ""), dtype=np.int32) for t in batch.column(text).to_pylist()), pa.list_(pa.int32()))}

    return with_arrow(docs, {out: T.ArrayType(T.IntegerType())}, run)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for; null ids give empty bytes."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        e = encoder(path)
        return {out: pa.array([e.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.binary())}

    return with_arrow(docs, {out: T.BinaryType()}, run)


def token_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded again in the same task."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        e, n, sha, back = encoder(path), [], [], []
        for t in batch.column(text):
            ids = e.encode(t.as_py() or "")
            n.append(len(ids))
            sha.append(hashlib.sha256(b" ".join(map(e.decimal.__getitem__, ids))).hexdigest())
            back.append(hashlib.sha256(e.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

    return with_arrow(docs, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, run)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit of each whole text; a null or empty text has none of either."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        e = encoder(path)
        texts = [t or "" for t in batch.column(text).to_pylist()]
        n = [e.count(t) for t in texts]
        size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        return {"n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}

    return with_arrow(docs, {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}, run)


def truncate_texts(docs: DataFrame, path: str, budget: int, text: str = "text", out: str = "truncated") -> DataFrame:
    """docs with the longest prefix of each text that has at most `budget` tokens; null for null."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        e = encoder(path)
        return {out: pa.array([None if t is None else e.truncate(t, budget) for t in batch.column(text).to_pylist()], pa.string())}

    return with_arrow(docs, {out: T.StringType()}, run)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and digests of its ids and of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's numbers of bytes and tokens, and whether it has more than 512 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")
