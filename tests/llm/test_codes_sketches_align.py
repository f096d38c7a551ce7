"""Vector codes, document fingerprints and token alignment against plain readings, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import align, codes, sketches

SF = "/root/testdata/sf0.001"
JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (None, "no id here at all"), (None, None), (5, "same text twice, word for word"), (5, "same text twice, word for word"), (5, "other text")]


def plain_codes(rows, entries=16, rounds=6, parts=8):
    """rows (id, vector, label) in order -> (code, error, label_error) of each, and the codebooks' digest."""
    x = np.floor(np.array([r[1] for r in rows], np.float64) * 4096).astype(np.int64)
    x = x.reshape(len(rows), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()
    for again in range(rounds + 1):
        far = ((x[:, :, None, :] - book[None]) ** 2).sum(-1)
        near, least = far.argmin(-1), far.min(-1)
        for p in range(parts) if again < rounds else ():
            for e in range(book.shape[1]):
                mine = x[near[:, p] == e, p]
                if len(mine):
                    book[p, e] = [sum(c) // len(mine) for c in mine.T.tolist()]
    sums = defaultdict(int)
    for r, e in zip(rows, least.sum(1).tolist(), strict=True):
        sums[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for v in book.ravel()).encode()).hexdigest()
    return [("".join(f"{c:02x}" for c in n), int(e), sums[r[2]]) for r, n, e in zip(rows, near, least.sum(1), strict=True)], digest


def test_vector_codes_query_equals_plain_reading(spark):
    rows = sorted(duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall())
    want, digest = plain_codes(rows)
    got = {r.vec_id: r for r in codes.op11_vector_codes(spark, SF).collect()}
    assert len(got) == len(rows)
    for r, w in zip(rows, want, strict=True):
        assert (got[r[0]].code, got[r[0]].error, got[r[0]].label_error, got[r[0]].codebooks_sha256) == (*w, digest)


@pytest.mark.parametrize("n", [1, 7, 40])
def test_vector_codes_of_odd_rows(spark, n):
    rng = random.Random(n)
    rows = [(i, [round(rng.uniform(-2, 2), 2) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(0, rows[0][1], 1)] if n > 1 else []  # a repeated row
    rows.sort(key=lambda r: (r[0], r[1]))
    bad = [(90, None, 1), (91, [], 1), (92, [float("nan")] * 16, 1), (93, [float("inf")] + [0.0] * 15, 1), (94, [None] + [0.0] * 15, 1), (95, [1.0] * 15, 1)]
    df = spark.createDataFrame([*bad, *rows], VECTORS).withColumns({"id": F.lit(1), "v": F.lit(1), "code": F.lit("x")})
    got, book = codes.compress(df)
    want, digest = plain_codes([(i, np.float32(v), lab) for i, v, lab in rows])
    assert codes.digest(book) == digest
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == sorted((r[0], w[0], w[1]) for r, w in zip(rows, want, strict=True))


def test_vector_codes_of_nothing_and_of_rows_without_key(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS))[0].count() == 0
    got, _ = codes.compress(spark.createDataFrame([(None, [0.5] * 8, None), (3, [0.25] * 8, 1)], VECTORS))
    assert sorted((str(r.vec_id), r.code) for r in got.collect()) == [("3", "00" * 8), ("None", "01" * 8)]
    with pytest.raises(Exception, match="too large"):
        codes.compress(spark.createDataFrame([(1, [3e30] * 8, 1)], VECTORS))


def plain_versions(rows):
    """(id, text) in descending order -> what fingerprint_versions says of each."""
    piece = r"(?:[^ \t\n\x0b\f\r]{0,63}[^ \t\n\x0b\f\r.!?][ \t]+){0,7}[^ \t\n\x0b\f\r]{1,64}"
    pieces = lambda t: set(re.findall(piece, t))
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(pieces(t), pieces(edited)), like(pieces(t), pieces(after))))
    return out


def told(r):
    return r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next


def test_fingerprints_equal_plain_reading(spark):
    rows = sorted(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall(), reverse=True)
    got = sketches.op12_fingerprints(spark, SF).collect()
    assert sorted(map(told, got)) == sorted(plain_versions(rows))
    text = dict(rows)
    same = defaultdict(set)
    for r in got:
        same[text[r.doc_id]].add(r.fingerprint)
    assert {len(x) for x in same.values()} == {1} and len(set.union(*same.values())) == len(same)


def test_fingerprints_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumns({"p": F.lit(1), "row": F.lit(1), "copies": F.lit(3), "a": F.lit(0)})
    got = sketches.fingerprint_versions(odd).collect()
    h = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in ODD], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in ODD), key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))
    key = lambda x: (str(x[0]), *x[1:])
    assert sorted(map(told, got), key=key) == sorted(plain_versions(order), key=key)
    assert sketches.fingerprint_versions(spark.createDataFrame([], DOCS)).count() == 0
    one = sketches.fingerprint_versions(spark.createDataFrame([(7, "only one.")], DOCS)).first()
    assert one.near_next == 1.0 and one.n_chars == 9


def test_an_id_with_most_rows_is_cut(spark):
    """Three quarters of the rows share an id, and half of those their text."""
    rows = [(5, f"text {i if i % 2 else 0} of the hot id") for i in range(300)] + [(i, f"text of {i}") for i in range(100) if i != 5]
    df = spark.createDataFrame(rows, DOCS)
    got = sketches.fingerprint_versions(df).collect()
    h = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    assert sorted(map(told, got)) == sorted(plain_versions(sorted(rows, key=lambda r: (-r[0], h[r[1]]))))


@pytest.mark.parametrize("n", [0, 1, 5, 60, 400])
def test_peeling_recovers_what_differs(spark, n):
    rng = random.Random(n)
    draw = lambda k: [rng.getrandbits(63) - 2**62 for _ in range(k)]
    rows = []
    for i in range(20):
        common = draw(rng.choice([0, 3, 200]))
        rows.append((i, common + draw(rng.randint(0, n)), draw(rng.randint(0, n)) + common))
    df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>").withColumn("size", (F.size("a") + F.size("b") + 8).cast("int"))
    got = {r.i: r for r in sketches.peel(sketches.differences(df, ["i"], "a", "b", "size"), ["i"], 15, recovered=True).collect()}
    for i, a, b in rows:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        r = got.get(i)
        assert (r.cells_left, list(r.digests_a), list(r.digests_b)) == (0, only_a, only_b) if r else not only_a + only_b
    prints = sketches.sketches(df, ["i"], ["a", "b"])
    near = sketches.peel(sketches.subtract(prints, ["i"], "fingerprint_a", "fingerprint_b"), ["i"], 12, bits=32)
    found = {r.i: r for r in near.collect()}
    for i, a, b in rows:
        r = found.get(i)
        if r and r.cells_left == 0:
            assert (r.only_a, r.only_b) == (len(set(a) - set(b)), len(set(b) - set(a)))
        assert r or set(a) == set(b)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.randoms())
def test_ends_that_meet(sizes, rng):
    """Tokens of b are those of a, joined or cut here and there."""
    a = np.cumsum(sizes)
    b = np.array(sorted({int(a[-1])} | {int(x) for x in a if rng.random() < 0.9} | {rng.randint(1, int(a[-1])) for _ in range(rng.randint(0, 5))}))
    i, j = align.align(a, b)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_ends_of_long_runs():
    a = np.arange(1, 5001)
    b = np.delete(a, [100, 101, 3000])
    i, j = align.align(a, b)
    assert a[i].tolist() == b[j].tolist() == b.tolist()
    assert [len(x) for x in align.align(a[:0], b[:0])] == [0, 0] and align.align(a, a)[0].tolist() == list(range(5000))


def plain_alignment(docs):
    t, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    byte = align.aligner(JSON, PIECES)
    held, counts = [], Counter()
    for i, text in docs:
        x, y = (t.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        joined = b"".join(byte.b_bytes[k] for k in y)
        if not text or joined != f" {text}".encode():
            held.append((i, [], [], [], ""))
            continue
        ends = [np.cumsum([len(s[k]) for k in z]).tolist() for s, z in ((byte.a_bytes, x), (byte.b_bytes, y))]
        groups, links, p, q = [], [], 0, 0
        for v in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0].index(v, p) + 1, ends[1].index(v, q) + 1
            groups.append(",".join(map(str, x[p:m])) + "|" + ",".join(map(str, y[q:n])))
            links.append((x[m - 1], y[n - 1]))
            p, q = m, n
        counts.update(links)
        held.append((i, x, y, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(i, len(x), len(y), len(k), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), sha) for i, x, y, k, sha in held], counts, most


def test_alignment_query_equals_plain_reading(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert sorted(map(tuple, align.op13_token_alignment(spark, SF).collect())) == sorted(plain_alignment(rows)[0])


def test_alignment_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_BYTES", 40)
    rows = [*ODD, (6, "<|endoftext|> and <s> </s> are text"), (7, "\u2581 a mark that stands for a space"), (8, "ünïcödé 全文 \U0001f600\r\n\t  x"), (9, "a" * 3000), (10, " " * 3000)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"chunk": F.lit(1), "n": F.lit(1)})
    out, table = align.align_texts(df, JSON, PIECES)
    want, counts, most = plain_alignment(rows)
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert {(r.a, r.b): (r.n, r.best) for r in table.collect()} == {p: (n, n == most[p[1]]) for p, n in counts.items()}
    empty, table = align.align_texts(df.limit(0), JSON, PIECES)
    assert empty.count() == 0 and table.count() == 0
