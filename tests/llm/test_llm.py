"""Operators for training data against brute force, round trips and held-out accuracy, and their edge cases."""

import base64
import hashlib
import os
import random
import re
import time
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, decontaminate, graph, lines, neardup, quality, sharding, toxicity, vectors, warc

SF = "/root/testdata/sf0.001"
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (None, "no id here at all"), (5, "same text twice, word for word"), (5, "same text twice, word for word")]


def links(sets: dict, percent: int = 80) -> dict:
    """Smallest id reachable, by comparing all pairs."""
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingle_set(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 6)):
            w = [word() if rng.random() < rng.choice([0, 0.02, 0.06, 0.12]) else x for x in base]
            docs.append(" ".join(w))
    return [(i, t) for i, t in enumerate(docs)] + [(900, None), (901, ""), (902, docs[0].upper())]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = near_corpus()
    sets = {i: shingle_set(t, k) for i, t in rows}
    want = links(sets)
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), settings=neardup.Settings(shingle=k)).collect()
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS).withColumn("component_id", F.lit("x"))
    got = [(r.id, r.n_shingles > 0, r.kept) for r in neardup.near_duplicates(df).orderBy("id").collect()]
    assert got == [(1, False, True), (2, False, True), (3, False, True), (4, True, True), (5, True, True), (5, True, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_lines_equal_sql(spark):
    rng = random.Random(2)
    stock = [" ".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    long = [[f"{rng.choice('abcdefghijklm')}{rng.randrange(40)}" for _ in range(rng.randint(15, 60))] for _ in range(6)]

    def edited(line):
        w = line.split(" ")
        at = rng.randrange(len(w))
        return " ".join(rng.choice([w, w[:at] + w[at + 1 :], w[:at] + ["zz"] + w[at:], w[:at] + ["yy"] + w[at + 1 :]]))

    rows = [(i, "\n".join(edited(rng.choice(stock)) for _ in range(rng.randint(1, 8)))) for i in range(60)] + [(60, None), (61, ""), (62, LONG[:900]), (63, "a\n\n\na")]
    rows += [(100 + i, "\n".join(edited(edited(" ".join(rng.choice(long)))) for _ in range(3))) for i in range(20)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    for sql, per in ((lines.ORACLE, None), (lines.ORACLE_LONG, lines.WORDS_PER_EDIT)):
        got = lines.dedup_lines(spark.createDataFrame(rows, DOCS), words_per_edit=per).collect()
        assert {tuple(r) for r in got} == set(c.execute(sql).fetchall())


def test_lines_of_odd_rows(spark):
    rows = [*ODD, (6, "same text twice, word for word"), (8, "all different in this one"), (8, "not at all like the other one")]
    df = spark.createDataFrame([*rows, (9, "all different in this one")], DOCS).withColumns({c: F.lit(i) for i, c in enumerate(["n_lines", "h", "d", "g", "k", "t", "row", "left", "_gone", "_gone_from"])})
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df).collect()), key=str)
    assert (6, "", 1, 1) in got and (1, None, 0, 0) in got and got.count((5, "same text twice, word for word", 1, 0)) == 2 and (0, "no id here at all", 1, 0) in got
    assert (9, "", 1, 1) in got and (8, "all different in this one", 1, 0) in got and (8, "not at all like the other one", 1, 0) in got
    assert {r._gone for r in lines.dedup_lines(df).collect()} == {8}
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        lines.like_lines(df, max_edits=2)


def test_like_lines_bound_grows(spark):
    rng = random.Random(4)
    stock = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(rng.randint(5, 75))] for _ in range(30)]

    def edited(w):
        w = list(w)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["zz", w[at]], [f"y{rng.randrange(9)}"]]) or (["x"] if len(w) == 1 else [])
        return w

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rows = [edited(rng.choice(stock)) for _ in range(150)] + [["same"] * 50, ["same"] * 55, ["same"] * 56, ["only"] * 20 + ["b"] + ["only"] * 19, ["only"] * 40]
    for per in (10, 20):
        bound = lambda a, b: max(1, min(len(a), len(b)) // per)
        want = {i for i, b in enumerate(rows) for a in rows[:i] if min(len(a), len(b)) >= 5 and distance(a, b) <= bound(a, b)}
        got = lines.like_lines(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], DOCS), words_per_edit=per)
        assert {r.d for r in got.collect()} == want
    one = lines.like_lines(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], DOCS), words_per_edit=None)
    assert one.count() < len(want)


def test_like_lines_of_a_large_group(spark, monkeypatch):
    """Lines that share a long passage are one group of keys; they are told apart by their own words."""
    monkeypatch.setattr(lines, "GROUP", 3)
    test_like_lines_bound_grows(spark)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'w{i // 2}x{j}' for j in range(11))} {passage} {'z' * (i % 2)}e") for i in range(60)]
    assert {r.d for r in lines.like_lines(spark.createDataFrame(rows, DOCS)).collect()} == set(range(1, 60, 2))


def test_large_groups_are_not_expanded_into_pairs(spark, monkeypatch):
    """Copies of a line that aren't like the group's earliest line, and such that aren't like each other either, meet few others."""
    monkeypatch.setattr(lines, "GROUP", 3)
    met, pairs = [], lines._pairs
    monkeypatch.setattr(lines, "_pairs", lambda *a, **k: met.append(pairs(*a, **k)) or met[-1])
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]

    def edited(n, other):
        w = list(base)
        for at in rng.sample(range(20, 60), n):
            w[at] = other(at)
        return " ".join(w)

    copies = [edited(4, lambda at: f"lead{at}"), *[edited(3, lambda at: f"x{rng.randrange(10**6)}") for _ in range(120)]]
    assert {r.d for r in lines.like_lines(spark.createDataFrame(list(enumerate(copies)), DOCS)).collect()} == set(range(2, 121))
    assert sum(df.count() for df in met) < 20 * len(copies)
    apart = [edited(4, lambda at: rng.choice(base[:20])) for _ in range(120)]  # words that all of them have
    ws = [x.split(" ") for x in apart]
    near = {i for i, x in enumerate(ws) for y in ws[:i] if sum(a != b for a, b in zip(x, y, strict=True)) <= 6}
    assert {r.d for r in lines.like_lines(spark.createDataFrame(list(enumerate(apart)), DOCS)).collect()} == near


def test_short_copies_go(spark):
    rows = [(1, "Les.\n\n \nno spaces\n"), (2, "Les.\n\n \nno space\n全文没有空格的一行"), (3, "全文没有空格的一行\nLes\nno spaces"), (4, "one two three four five\none two three four six\none two three four")]
    gone = lambda **k: {(r.d, r.l) for r in lines.like_lines(spark.createDataFrame(rows, DOCS), **k).collect()}
    short = {(2, 0), (3, 0), (3, 2)}
    assert gone() == gone(words_per_edit=None) == short | {(4, 1)} and gone(max_edits=0) == short
    stage = dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.createDataFrame(rows, DOCS), SF)
    assert {r.doc_id: r.text for r in stage.collect()} == {1: rows[0][1], 2: "\n \nno space\n全文没有空格的一行", 3: "Les", 4: "one two three four five\none two three four"}


def test_words_numbered_where_hashes_meet(spark):
    """Words whose 8 bits are equal are still different words."""
    df = spark.createDataFrame([([f"w{i}"] * 3, [f"w{j}"] * 3) for i in range(40) for j in range(i)], "a array<string>, b array<string>")
    assert {r[0] for r in df.select(lines._within(F.col("a"), F.col("b"), F.lit(1))).collect()} == {False}


def test_like_lines_only_equal(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e x")]
    assert [r.d for r in lines.like_lines(spark.createDataFrame(rows, DOCS), max_edits=0).collect()] == [2]


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the old river bank while children sing quietly under tall green trees"), (2, "one two three"), (3, None), (4, ""), (5, "Was ist die Antwort auf die große Frage nach dem Leben und allem anderen heute morgen")]


def brute_leaks(docs, items):
    words = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())
    cut = lambda w, k: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    sets = {i: cut(words(t), min(5, len(words(t)))) for i, t in items if t and words(t)}
    held = defaultdict(int)
    for s in sets.values():
        for x in s:
            held[x] += 1
    weigh = lambda s: sum(1 / held[x] if x in held else 1.0 for x in s)
    out = set()
    for d, t in docs:
        w = words(t)
        for i, s in sets.items():
            n = len(words(dict(items)[i]))
            for p in range(len(w)):
                v = cut(w[p : p + n], min(5, n))
                if v and weigh(v & s) >= 0.8 * max(weigh(v), weigh(s)) - 1e-12:
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_brute_force(spark):
    rng, fill = random.Random(3), lambda n: " ".join(random.Random(n).choice("alpha beta gamma delta the of near old".split()) for _ in range(n))
    docs = []
    for i in range(60):
        w = ITEMS[rng.choice([0, 0, 4])][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [rng.choice(["other", "word"])]
        docs.append((i, f"{fill(i)} {' '.join(w)}{rng.choice(['', '.', ' $$$'])} {fill(60 - i)}"))
    docs += [(100, "one two three"), (101, "so one two three four"), (102, None), (103, ""), (104, LONG), (105, fill(300))]
    got = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == brute_leaks(docs, ITEMS) and {(100, 2), (101, 2)} <= found and 20 < len(found) < 62


def test_leaks_of_short_items(spark):
    """Items of fewer than five words are found anywhere, beside longer ones; some share words, an id, or all their text."""
    items = [(1, "alpha bravo charlie delta"), (2, "bravo charlie"), (3, "echo"), (4, "alpha bravo charlie delta echo"), (5, "bravo, Charlie!"), (6, "zulu"), (6, "yankee zulu")]
    words, rng = "alpha bravo charlie delta echo fox golf".split(), random.Random(2)
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    docs += [(100, "so alpha bravo charlie delta echo and more words"), (101, "Bravo."), (102, None), (103, ""), (104, "a yankee zulu"), (105, f"{LONG} bravo charlie")]
    got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()]
    want = brute_leaks(docs, items[:5] + [(60, "zulu"), (61, "yankee zulu")])
    assert len(got) == len(set(got)) and set(got) == {(d, 6 if i > 9 else i) for d, i in want} and {(100, 1), (100, 4), (105, 2), (104, 6)} <= set(got)


def test_leaks_of_items_that_share_a_template(spark):
    """Windows that begin before the item's first shingle, and items of which most shingles are shared with others."""
    name = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    other = lambda k: f"p0 p1 p2 a0 a1 a2 a3 {name(f'o{k}x', 23)}"
    items = [(1, name("a", 20)), (2, name("a", 20)), *[(3 + k, other(k)) for k in range(5)]]
    rng = random.Random(8)
    items += [(20 + k, f"{name('t', 60)} {name(f'own{k}x', rng.randint(1, 9))} {name('u', rng.randint(0, 20))}") for k in range(12)]
    docs = [(1, f"x y z p0 p1 p2 {name('a', 17)} q r s {name('v', 30)}")]
    for i in range(2, 60):
        w = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 0, 1])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [rng.choice(["other", "p0", "a3", "t7"])]
        docs.append((i, f"{name('b', rng.randint(0, 9))} {' '.join(w)} {name('c', rng.randint(0, 30))}"))
    docs += [(1, docs[5][1]), (3, docs[5][1]), (None, docs[5][1])]
    got = decontaminate.leaks(spark.createDataFrame(docs, DOCS).withColumn("u1", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    found = [(r.doc_id, r.item_id) for r in got.collect()]
    assert set(found) == brute_leaks([d for d in docs if d[0]], items) and len(found) == len(set(found)) and {(1, 1), (1, 2)} <= set(found) and len(found) > 30


def test_decontaminate_odd_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminate(spark.createDataFrame([*ODD, (7, ITEMS[0][1])], DOCS).withColumn("similarity", F.lit(1)), items)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5]
    assert decontaminate.leaks(spark.createDataFrame(ODD, DOCS), items.limit(0)).count() == 0
    assert decontaminate.leaks(spark.createDataFrame([], DOCS), items).count() == 0


def fuzz(n, seed):
    rng = random.Random(seed)
    alphabet = list("abcdeThe  \n\t\r'sllrevém0123½²٣.,!?<|>endoftext|>") + ["<|endoftext|>", "  ", "\n\n", "'ll", "\x85", "​", "　", "😀", "漢", "\x00", "é"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["a" * 3000, " " * 999, "é" * 400, "=" * 2000, "\n" * 300 + "x"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(JSON)


def test_encoding_equals_the_libraries(spark, library):
    texts = fuzz(400, 1)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], DOCS).withColumns({"ids": F.lit("x"), "n_tokens": F.lit("y")})
    ids = {r.doc_id: list(r.ids) for r in bpe.encode_texts(rows, RANKS).collect()}
    assert ids == {i: library[0].encode_ordinary(t) for i, t in enumerate(texts)} | {9999: []}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(bpe.encode_texts(rows, RANKS), RANKS).collect()}
    assert back == {i: t.encode() for i, t in enumerate(texts)} | {9999: b""}
    digests = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(rows, RANKS).collect()}
    assert digests[0] == (len(ids[0]), hashlib.sha256(" ".join(map(str, ids[0])).encode()).hexdigest(), hashlib.sha256(texts[0].encode()).hexdigest())
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.count_tokens(rows, JSON).collect()}
    assert counts == {i: (len(t.encode()), n := len(library[1].encode(t, add_special_tokens=False).ids), n > 512) for i, t in enumerate(texts)} | {9999: (0, 0, False)}


def test_prefix_counts_and_truncation(spark, library):
    e, count = bpe.encoder(JSON), lambda t: len(library[1].encode(t, add_special_tokens=False).ids)
    for t in fuzz(120, 7)[:120]:
        assert e.prefix_counts(t) == [count(t[:i]) for i in range(len(t) + 1)]
    cut = bpe.truncate_texts(spark.createDataFrame([(1, "some words that go on and on"), (2, None), (3, "")], DOCS), JSON, 3)
    assert {r.doc_id: r.truncated for r in cut.collect()} == {1: "some words that", 2: None, 3: ""}


def test_sharding(spark):
    df = spark.range(3000).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,), (7,), (7,)], "k long")).withColumns({"_part": F.lit(77), "_s": F.lit(1), "_start": F.lit(2), "_place": F.lit(3), "count": F.lit(4)})
    out = sharding.number_slots(sharding.assign_shards(df, "k", [1.0, 2.0, 0.0, 1.0]), "k", parts=8).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard")) and set(out.shard) == {0, 1, 3}
    assert 0.45 < (out.shard == 1).mean() < 0.55 and (out.k == 7).sum() == 3 and out[out.k == 7].shard.nunique() == 1
    assert out[["_part", "_s", "_start", "_place", "count"]].drop_duplicates().values.tolist() == [[77, 1, 2, 3, 4]]
    more = sharding.assign_shards(sharding.assign_shards(df, "k", [1.0] * 4), "k", [1.0] * 5, out="grown").where("shard <> grown").toPandas()
    assert set(more.grown) == {4} and 0.15 < len(more) / 3003 < 0.25
    assert sharding.number_slots(sharding.assign_shards(df.limit(0), "k", [1.0]), "k").count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("k"), [0.0])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sharding_query_equals_plain_reading(spark):
    """Sizes, digests, slots and the shard of largest score, by a plain loop over rows."""
    import zlib

    rows = sharding.op1_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    u = spark.createDataFrame([(d, s) for d in texts for s in range(25)], "d long, s int").select("d", "s", F.xxhash64("d", "s").alias("x")).collect()
    scores = {(r.d, r.s): -1 / np.log(((r.x % 2**64 >> 11) + 0.5) / 2**53) for r in u}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw) if texts[r.doc_id] is not None else None, "key")
        assert (r.shard, r.grown_shard) == (max(range(24), key=lambda s: scores[r.doc_id, s]), max(range(25), key=lambda s: scores[r.doc_id, s]))
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_ftrl_equals_plain_updates():
    """The learner against one coordinate at a time, by the published rule."""
    s, rng = quality.Settings(bits=4, passes=2), np.random.default_rng(3)
    rows = []
    for _ in range(60):
        i = np.unique(rng.integers(0, 16, 5)).astype(np.int32)
        rows.append((float(rng.integers(0, 2)), i, rng.random(len(i)).astype(np.float32)))
    z, n = [0.0] * 17, [0.0] * 17

    def weight(k):
        l1 = 0.0 if k == 16 else s.l1
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - np.sign(z[k]) * l1) / ((s.beta + n[k] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.passes):
        for y, i, x in rows:
            at = [*zip(i.tolist(), x.tolist(), strict=True), (16, 1.0)]
            p = 1 / (1 + np.exp(-sum(weight(k) * v for k, v in at)))
            for k, w, v in [(k, weight(k), v) for k, v in at]:
                g = (p - y) * v
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / s.alpha * w
                n[k] += g * g
    w, bias = quality._ftrl(rows, s)
    assert np.allclose(w, [weight(k) for k in range(16)]) and bias == pytest.approx(weight(16))


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nX: y", "é" * 200_000), (None, "http://f", "<p>x</p>"), (6, "http://g", "WARC/1.1\r\n\r\nbody\r\n\r\n")]


def test_warc_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)), path)
    got = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    kinds = {k.removeprefix("urn:page:"): (r.record_type, (r.refers_to or "").removeprefix("urn:page:")) for k, r in got.items()}
    assert kinds == {"1": ("response", ""), "2": ("revisit", "1"), "3": ("response", ""), "4": ("revisit", "3"), "5": ("response", ""), "none": ("revisit", "1"), "6": ("response", "")}
    for k, _, html in PAGES:
        r, body = got[f"urn:page:{k or 'none'}"], (html or "").encode()
        assert (r.payload_length, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert r.record_type == "revisit" or bytes(r.payload) == body
    few = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' and target_uri like 'http://b%'")
    assert [(r.record_id, r.payload) for r in few.collect()] == [("urn:page:2", None)]


def test_warc_foreign_and_empty(spark, tmp_path):
    import gzip

    record = warc.encode_record("response", "urn:x:1", "http://a", None, hashlib.sha1(b"hi").digest(), 2, b"hi")
    (tmp_path / "a.warc").write_bytes(record * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) * 2)
    assert [bytes(r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()] == [b"hi"] * 5
    assert warc.read_warc(spark, f"file://{tmp_path}", payload=False).where("record_type = 'revisit'").count() == 0
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "whole.warc.gz").write_bytes(gzip.compress(record * 2 + record.replace(b"sha1:", b"sha256:")) + gzip.compress(record.replace(base64.b32encode(hashlib.sha1(b"hi").digest()), hashlib.sha1(b"hi").hexdigest().encode())))
    sha1 = base64.b32encode(hashlib.sha1(b"hi").digest()).decode()
    assert [(bytes(r.payload), r.payload_digest) for r in warc.read_warc(spark, f"file://{tmp_path}/c").collect()] == [(b"hi", sha1)] * 2 + [(b"hi", f"sha256:{sha1}"), (b"hi", sha1)]
    assert warc.read_warc(spark, f"file://{tmp_path}/c", payload=False).where("record_type = 'response'").count() == 4
    warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "archive")
    page = lambda i: spark.createDataFrame([(i, "u", f"page {i}")], "page_id long, url string, html string")
    ids = lambda: sorted(r.record_id for r in warc.read_warc(spark, path).collect())
    warc.archive_pages(page(1), path)
    warc.archive_pages(page(2), path)
    assert ids() == ["urn:page:1", "urn:page:2"]
    warc.archive_pages(page(3), path, mode="overwrite")
    assert ids() == ["urn:page:3"] and len([f for f in os.listdir(path) if f.endswith(".warc.gz")]) == 1
    broken = page(4).select("page_id", "url", F.expr("CASE WHEN page_id = 4 THEN string(raise_error('no')) END").alias("html"))
    with pytest.raises(Exception, match="no"):
        warc.archive_pages(broken, path)
    assert ids() == ["urn:page:3"]
    warc.archive_pages(page(1).limit(0), path)
    assert ids() == ["urn:page:3"]
    warc.archive_pages(page(1).limit(0), path, mode="overwrite")
    assert ids() == []


def test_warc_cut_off(tmp_path):
    import gzip

    def read(name, data, payload):
        (tmp_path / name).write_bytes(data)
        reader = warc._Reader({"path": f"file://{tmp_path}/{name}", "payload": payload}, None)
        return [row for part in reader.partitions() for row in reader.records(part)]

    record = warc.encode_record("response", "urn:x:1", "http://a", None, hashlib.sha1(b"hi" * 90).digest(), 180, b"hi" * 90)
    for name, data in (("own.warc.gz", warc._member(record)), ("foreign.warc.gz", gzip.compress(record)), ("plain.warc", record.rstrip(b"\r\n"))):
        assert len(read(name, data, "true")) == len(read(name, data, "false")) == 1
        for size in (len(data) - 12, 60, 30):
            with pytest.raises(ValueError):
                read(name, data[:size], "true")
    with pytest.raises(ValueError):
        read("b.warc", record.replace(b"Content-Length: 2", b"Content-Size: 2"), "true")


def test_warc_member_across_the_end_of_the_buffer(tmp_path):
    def member(i, payload):
        return warc._member(warc.encode_record("response", f"urn:x:{i}", "http://a", None, hashlib.sha1(payload).digest(), len(payload), payload))

    noise = np.random.default_rng(0).bytes(1 << 20)
    for left in (1, 2, 12, 23, 24):  # bytes of the second member that the first MB holds
        size = (1 << 20) - 2000
        while (short := (1 << 20) - left - len(member(1, noise[:size]))) != 0:
            size += short
        first, rest = member(1, noise[:size]), member(2, b"two")
        data = first + rest * 2
        (tmp_path / f"{left}.warc.gz").write_bytes(data)
        for payload in ("true", "false"):
            reader = warc._Reader({"path": f"{tmp_path}/{left}.warc.gz", "payload": payload}, None)
            ends = [0, len(first) + len(rest), len(data)]
            parts = [warc._Part(f"{tmp_path}/{left}.warc.gz", a, b) for a, b in zip(ends, ends[1:], strict=False)]
            assert [[row["record_id"] for row in reader.records(p)] for p in parts] == [["urn:x:1", "urn:x:2"], ["urn:x:2"]]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.0, 0.15, 0.3], 400)[:, None]
    label = rng.integers(0, 3, 400)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label, strict=True))]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None), (505, [], 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (None, rows[0][1], 1)]
    s = vectors.Settings(cell=16, block=8)
    got = vectors.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1)), settings=s).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    low = np.arange(400)
    for _ in range(400):
        new = np.array([low[near[i]].min() for i in range(400)])
        if (new == low).all():
            break
        low = new
    want = {i: (int(near[i].sum()) - 1, int(low[i]), bool(low[i] == i)) for i in range(400)} | {i: (0, i, True) for i in (*range(500, 506),)} | {506: (1, 506, True), 507: (1, 506, False), None: (0, None, True)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert vectors.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def planted_pairs(n, dim, cosine, seed):
    """n pairs of unit vectors at that cosine: rows 2 i and 2 i + 1."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return np.stack([a, cosine * a + np.sqrt(1 - cosine**2) * b], axis=1).reshape(2 * n, dim)


def test_collision_plan_keeps_its_promise():
    """Planted pairs at the least cosine share a cell in some cut and have enough collisions, random ones seldom have."""
    s = vectors.Settings()
    for rows in (10, 5_000, 10**7):
        k, cuts = s.plan(rows)
        assert rows / 2**k <= s.cell and 1 - (1 - (1 - np.arccos(0.93) / np.pi) ** k) ** cuts >= 1 - s.miss / 2
    x = planted_pairs(4000, 64, 0.9301, 1)
    k, cuts = s.plan(200_000)
    cells = vectors._cells(x, k, cuts)
    assert (cells[::2] == cells[1::2]).any(axis=1).mean() >= 0.999
    enough, random_ = [], []
    for i in range(0, 1600, 200):
        counts = vectors.collisions(x[i : i + 200], s)
        at = np.arange(0, 200, 2)
        enough += (counts[at, at + 1] >= s.least).tolist()
        counts[at, at + 1] = 0
        random_.append((counts >= s.least).sum() / (200 * 199 / 2))
    assert np.mean(enough) >= 0.999 and np.mean(random_) < 0.01


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize(("query", "label", "least"), [(quality.op8_quality, "quality", 0.9), (toxicity.op10_toxicity, "toxic", 0.7)])
def test_classifiers_on_held_out_rows(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    r = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks, n = r.score.rank(), int(r[label].sum())
    assert (ranks[r[label] == 1].sum() - n * (n + 1) / 2) / (n * (len(r) - n)) >= least
    assert (r.predicted == r[label]).mean() >= 0.9


def test_classifiers_on_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(ODD, DOCS).withColumns({"score": F.lit("x"), "_y": F.lit(1), "_h": F.lit(1)})
    for docs in (df, df.limit(0)):
        q = quality.score(docs, quality.fit(docs, labels, "quality", F.lit(True)))
        t = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)))
        for out in (q, t):
            assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() == docs.count()
    none = quality.score(df, quality.fit(df, labels.limit(0), "quality", F.lit(True)))
    assert {r.score for r in none.collect()} == {0.5}


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot": 5.0, "lowei*": 4.0})
    score = lambda t: g.measures(t)[0]
    assert score("You idiot.") > score("An idiot.") > score("He said idiot.") > 0
    assert score("Not an idiot.") < score("An idiot.") and score("A loweischaft here") == 4.0
    assert score("A clean sentence. Nothing here.") == 0 and score("I will kill time") == 0 < score("they kill you")


def test_long_clause_and_long_white_space_take_linear_time():
    g = toxicity.Grammar({"bad": 2.0})
    began = time.time()
    assert g.clause(["bad"] * 100_000)[0] == pytest.approx(200_000.0)
    assert time.time() - began < 3
    e, text = bpe.encoder(RANKS), "a " + " \n" * 20_000 + " b"
    began = time.time()
    counts = e.prefix_counts(text)
    assert time.time() - began < 3 and len(counts) == len(text) + 1 and counts[-1] == e.count(text)
    for i in (0, 1, 2, 3, 4, 5, 99, 1000, 1001, len(text) - 1):
        assert counts[i] == len(e.encode(text[:i]))


def test_composed_machine_equals_plain_reading():
    """The best path of the composed transducers against a direct reading of the rules."""
    s = toxicity.Settings()
    g = toxicity.Grammar({"idiot": 5.0, "scum*": 3.0}, {"foe": "target", "hardly": "negation", "alleges": "report", "maim": "threat"})
    rng, kinds = random.Random(6), {"target": ["foe", "you"], "negation": ["hardly", "not"], "report": ["alleges", "said"], "threat": ["maim", "kill"]}
    pool = ["idiot", "scummy", "the", "a", "of", *[w for ws in kinds.values() for w in ws]]

    def plain(words):
        at = lambda kind: [i for i, w in enumerate(words) if w in kinds[kind]]
        total, sums, targets = 0.0, dict.fromkeys(toxicity.MARKS, 0.0), bool(at("target"))
        for i, w in enumerate(words):
            weight = 5.0 if w == "idiot" else 3.0 if w.startswith("scum") else s.threat if i in at("threat") and targets else 0.0
            marks = {"negated": any(0 < i - j <= 3 for j in at("negation")), "reported": any(j < i for j in at("report")), "targeted": targets}
            for m, factor in (("negated", s.negated), ("reported", s.reported), ("targeted", s.target)):
                if weight and marks[m]:
                    sums[m] += weight
            if weight and w in kinds["threat"]:
                sums["threat"] += weight
            total += weight * (s.negated if marks["negated"] else 1) * (s.reported if marks["reported"] else 1) * (s.target if targets else 1)
        return [total, *sums.values()]

    for _ in range(3000):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        total, sums = g.clause(words)
        assert [total, *sums] == pytest.approx(plain(words)), words


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_marks_count(spark):
    """Texts that differ only in a target, a negation or a report get different scores, by coefficients that were learned."""
    labels, texts = [], []
    for i in range(400):
        toxic = i % 2
        texts.append((i, f"word{i % 7} some idiot {'you' if toxic else 'not'} here. More words follow" if i % 3 else f"he said an idiot was there{i % 5}. Fine"))
        labels.append((i, int(toxic and bool(i % 3))))
    docs, labels = spark.createDataFrame(texts, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True), settings=toxicity.Settings(least_weight=0.1, least_strength=0.1))
    with_marks = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert {r.doc_id: r.score for r in toxicity.score(docs, model.without("targeted")).collect()} != with_marks
    assert sum((with_marks[i] >= 0.5) == bool(i % 2 and i % 3) for i in with_marks) >= 380


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        after = after.persist()
        assert 0 < after.count() <= before.count(), name
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert out.count() == before.count() and out.where("size(ids) <> n_tokens").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {r.doc_id for r in out.select("doc_id").collect()}
    near = neardup.near_duplicates(before)
    assert near.where("not kept").count() == 0
    assert decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_on_odd_rows(spark):
    """Null, empty, repeated and very long texts, missing ids, columns with names that the stages use, and no rows."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(*r, "en", "s", 1) for r in [*ODD, (20, item), (21, "another text that has some words of its own, all told"), (22, "another text that has some words of its own, all told")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(i) for i, c in enumerate(["_score", "score", "_gone", "d", "h", "g", "k", "t", "item_id", "kept", "id", "u1"])}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumns(clash), SF)
        assert out.columns == [*docs.columns, *clash], name
        found = out.collect()
        assert all([r[c] for c in clash] == list(range(len(clash))) for r in found), name
        kept[name] = sorted(r.doc_id or 0 for r in found)
        assert stage(spark, docs.limit(0), SF).count() == 0
    everything = sorted(r[0] or 0 for r in rows)
    assert kept["line_dedup"] == kept["near_dedup"] == [x for x in everything if x != 22]
    assert kept["decontamination"] == [x for x in everything if x != 20]
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs.withColumns(clash), SF).collect()
    assert len(encoded) == len(rows) and all(r.n_tokens == 0 for r in encoded if r.doc_id in (1, 2))
