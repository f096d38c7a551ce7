"""Fingerprints of texts as invertible Bloom lookup sketches of their paragraphs, and what differs between two versions.

A paragraph is a stretch of a line, up to the end of a sentence or a number of words. Its 64-bit digest is hashed into one
cell of each of three parts of a sketch; a cell holds a count, the exclusive or of its digests, and that of their checks.
Two sketches subtract cell by cell, which leaves the digests that only one version has. A cell with one of them shows it:
its check fits. Taken out of its other cells, it makes more of them show theirs (peeling), one part after another, so
that no digest is taken out twice. Where cells are left over, the sketches of that pair are made anew, larger.

Rows stay where the order of documents has dealt them out: sketches, subtraction and peeling are grouped sums on tables
that are bucketed by that, without shuffles, and a very long text is many small rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, settle, settle_bucketed


@dataclass(frozen=True)
class Settings:
    words: int = 8  # of a paragraph at most
    cells: int = 4  # in each part of a fingerprint
    spare: float = 0.6  # cells in each part of the first larger sketch, for each paragraph of both versions
    rounds: int = 12  # parts that are peeled, in turn


PARTS = 3
SEEN = "p", "row", "pair"


def digests(text: Column, s: Settings = Settings()) -> Column:  # noqa: B008
    """Distinct digests of a text's paragraphs; none of a null or blank text. A word counts for each 64 characters of it."""
    piece = rf"(?:\S{{0,63}}[^\s.!?][ \t]+){{0,{s.words - 1}}}\S{{1,64}}"
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(piece), F.lit(0)), lambda x: F.xxhash64(x)))


def _tagged(digests: str, tag: int) -> Column:
    return F.transform(digests, lambda d: F.struct(d.alias("d"), F.lit(tag).alias("v")))


def _check(digest) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _cell(digest, part: int, size) -> Column:
    return (F.pmod(F.xxhash64(digest, F.lit(part)), size) + part * size).cast("int")


def sketches(df: DataFrame, keys: Sequence[str], versions: Sequence[str], s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(keys, fingerprint_{version} of each column of digests): base64 of the cells' counts (4 bytes), digests (8) and
    checks (4), in order. keys name one row each."""
    n = PARTS * s.cells
    tagged = [_tagged(v, i) for i, v in enumerate(versions)]
    empty = F.array(F.struct(F.lit(None).cast("long").alias("d"), F.lit(-1).alias("v")))  # so that every row has all cells
    rows = df.select(*keys, F.explode(F.concat(empty, *tagged)).alias("x")).select(*keys, "x.d", "x.v")
    at = F.when(F.col("v") < 0, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(*[_cell("d", i, F.lit(s.cells)) for i in range(PARTS)]))
    rows = rows.select(*keys, "d", "v", _check("d").alias("c"), F.explode(at).alias("cell"))
    of = lambda i, x: F.when(F.col("v") == i, x)
    sums = [a for i in range(len(versions)) for a in (F.count(of(i, F.lit(1))).alias(f"n{i}"), F.bit_xor(of(i, F.col("d"))).alias(f"k{i}"), F.bit_xor(of(i, F.col("c"))).alias(f"c{i}"))]
    cells = rows.groupBy(*keys, "cell").agg(*sums)
    fixed = lambda x, digits: F.lpad(F.right(F.hex(F.coalesce(x, F.lit(0))), F.lit(digits)), digits, "0")
    held = [F.concat(fixed(F.col(f"n{i}"), 8), fixed(F.col(f"k{i}"), 16), fixed(F.col(f"c{i}"), 8)).alias(f"s{i}") for i in range(len(versions))]
    whole = cells.select(*keys, F.struct("cell", *held).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select(*keys, *[F.translate(F.base64(F.unhex(F.array_join(F.col(f"x.s{i}"), ""))), "\r\n", "").alias(f"fingerprint_{v}") for i, v in enumerate(versions)])


def _parsed(fingerprint, n: int) -> Column:
    whole = F.hex(F.unbase64(fingerprint))
    number = lambda i, at, digits: F.conv(F.substring(whole, i * 32 + at, F.lit(digits)), 16, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(number(i, 1, 8).alias("n"), number(i, 9, 16).alias("k"), number(i, 25, 8).alias("c")))


def subtract(df: DataFrame, keys: Sequence[str], a: str, b: str, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(keys, size, cell, n, k, c): the cells of two fingerprints' difference that aren't empty. Checks have 32 bits."""
    zipped = F.arrays_zip(_parsed(F.col(a), PARTS * s.cells).alias("a"), _parsed(F.col(b), PARTS * s.cells).alias("b"))
    rows = df.select(*keys, F.posexplode(zipped).alias("cell", "x"))
    x = lambda name: F.col(f"x.a.{name}").bitwiseXOR(F.col(f"x.b.{name}")).alias(name)
    return rows.select(*keys, F.lit(s.cells).alias("size"), "cell", (F.col("x.a.n") - F.col("x.b.n")).alias("n"), x("k"), x("c")).where("n <> 0 or k <> 0 or c <> 0")


def differences(df: DataFrame, keys: Sequence[str], a: str, b: str, size: str) -> DataFrame:
    """As subtract, of sketches of `size` cells a part made from two columns of digests."""
    rows = df.select(*keys, F.col(size).alias("size"), F.explode(F.concat(_tagged(a, 1), _tagged(b, -1))).alias("x")).select(*keys, "size", "x.d", "x.v")
    rows = rows.select(*keys, "size", "v", F.col("d").alias("k"), _check("d").alias("c"), F.explode(F.array(*[_cell("d", i, F.col("size")) for i in range(PARTS)])).alias("cell"))
    return rows.groupBy(*keys, "size", "cell").agg(F.sum("v").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")).where("n <> 0 or k <> 0 or c <> 0")


def peel(cells: DataFrame, keys: Sequence[str], rounds: int, bits: int = 64, recovered: bool = False) -> DataFrame:
    """(keys, cells_left, only_a, only_b): how many digests of each version peeling shows; all of them if no cell is left.
    Checks have so many bits. With recovered the digests themselves too, as arrays in digests_a and digests_b."""
    rows = cells.select(*keys, "size", F.lit(False).alias("out"), F.col("cell").cast("long").alias("cell"), "n", "k", "c", F.lit(0).alias("a"), F.lit(0).alias("b"))
    check = _check("k") if bits == 64 else _check("k").bitwiseAND((1 << bits) - 1)
    pure = (F.abs("n") == 1) & (F.col("c") == check) & ~F.col("out")
    zero = F.lit(0).cast("long")
    for r in range(rounds):
        part = r % PARTS
        one = [F.lit(True).alias("out"), (F.col("k") if recovered else zero).alias("cell"), zero.alias("n"), zero.alias("k"), zero.alias("c")]
        shown = F.struct(*one, (F.col("n") == 1).cast("int").alias("a"), (F.col("n") == -1).cast("int").alias("b"))
        same = F.struct("out", "cell", "n", "k", "c", "a", "b")
        others = [F.struct(F.lit(False).alias("out"), _cell("k", i, F.col("size")).cast("long").alias("cell"), (-F.col("n")).alias("n"), "k", "c", F.lit(0).alias("a"), F.lit(0).alias("b")) for i in range(PARTS) if i != part]
        here = pure & (F.floor(F.col("cell") / F.col("size")) == part)
        rows = rows.select(*keys, "size", F.explode(F.when(here, F.array(shown, *others)).otherwise(F.array(same))).alias("x")).select(*keys, "size", "x.*")
        sums = [F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"), F.sum("a").cast("int").alias("a"), F.sum("b").cast("int").alias("b")]
        rows = rows.groupBy(*keys, "size", "out", "cell").agg(*sums).where("out or n <> 0 or k <> 0 or c <> 0")
    found = [F.count_if(~F.col("out")).alias("cells_left"), F.sum("a").alias("only_a"), F.sum("b").alias("only_b")]
    lists = [F.array_sort(F.collect_list(F.when(F.col("out") & (F.col(x) > 0), F.col("cell")))).alias(f"digests_{x}") for x in "ab"] if recovered else []
    return rows.groupBy(*keys).agg(*found, *lists)


def _place(x: Column, cuts: Sequence[int]) -> Column:
    """How many of the ascending cuts are below x, by halving."""
    if not cuts:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < x, at + step).otherwise(at))


def in_order(rows: DataFrame, parts: int) -> tuple[DataFrame, list[tuple]]:
    """rows (id, text, h) with p, a part of the order by descending id (nulls last), then h, and copies, how many equal rows
    a row stands for; and (p, largest id, least h) of each part, in order.

    Quantiles of ids cut the order. An id that may hold many rows, and null, is a part of its own, cut again by h, and its
    equal rows are counted before they are dealt out.
    """
    cuts = min(parts, 4096)
    found = rows.agg(F.percentile_approx("id", [i / cuts for i in range(1, cuts)], 20 * cuts).alias("q"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    q = sorted(found["q"] or [])
    heavy = sorted({a for a, b in zip(q, q[1:], strict=False) if a == b})
    q = sorted(set(q))
    fine = -(-parts // cuts)  # more parts than cuts: stretches between two cuts are cut evenly
    at = _place(F.col("id"), q)
    inside = F.lit(0)
    if fine > 1:
        bound = F.split(F.lit(",".join(map(str, q))), ",").cast("array<bigint>")
        low, high = F.get(bound, at - 1), F.get(bound, at)
        inside = F.coalesce(F.least(F.floor((high - F.col("id")) / (high - low) * fine), F.lit(fine - 1)), F.lit(0))
    many = F.col("id").isNull() | (F.col("id").isin(heavy) if heavy else F.lit(False))
    by_h = F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * parts), F.lit(parts - 1))
    group = F.when(F.col("id").isNull(), F.lit(2 * len(q) + 2)).otherwise(2 * (len(q) - at) + F.when(many, F.lit(0)).otherwise(F.lit(1)))
    width = max(parts, fine)
    p = group.cast("long") * width + F.when(many, by_h).otherwise(inside).cast("long")
    single = rows.withColumns({"copies": F.lit(1).cast("long"), "p": p})
    if heavy or found["nulls"]:
        repeated = rows.where(many).groupBy("id", "text", "h").agg(F.count("*").alias("copies")).withColumn("p", p)
        single = single.where(~many).unionByName(repeated)
    h = F.min(F.when(many, F.col("h"))) if heavy or found["nulls"] else F.lit(None).cast("long")
    ends = single.groupBy("p").agg(F.max("id"), h).collect()  # a row for each part
    return single, sorted((tuple(r) for r in ends), key=lambda r: r[0])


def with_next(rows: DataFrame, parts: int, s: Settings) -> DataFrame:
    """rows (id, text) as (p, row, id, text, copies, a, next, n): a the text's digests, next the text that follows in the
    order of in_order, and n its digests; after the last one the first follows. Equal rows that share an id follow each
    other. Each part gets the first row of the next one as a guest, so no window is larger than a part."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    dealt, ends = in_order(rows, parts)
    spark = rows.sparkSession
    if not ends:
        return spark.createDataFrame([], "p long, row int, id long, text string, copies long, a array<long>, next string, n array<long>")
    first = spark.createDataFrame([(*e, ends[i - 1][0]) for i, e in enumerate(ends)], "p long, first_id long, first_h long, host long")  # a row for each part
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & F.coalesce(F.col("h") == F.col("first_h"), F.lit(True))
    guests = dealt.join(F.broadcast(first), "p").where(is_first).groupBy("host").agg(F.min_by(F.struct("id", "text", "h"), "h").alias("x"))
    guests = guests.select("x.*", F.lit(0).cast("long").alias("copies"), F.col("host").alias("p"))
    n = buckets(spark)
    whole = dealt.unionByName(guests).repartition(n, "p").withColumn("a", digests(F.col("text"), s)).withColumn("guest", F.col("copies") == 0)
    order = Window.partitionBy("p").orderBy("guest", F.desc_nulls_last("id"), "h")
    whole = whole.withColumns({"next": F.lead("text").over(order), "n": F.lead("a").over(order), "row": F.row_number().over(order) * 2}).where("not guest")
    itself = F.struct((F.col("row") + 1).alias("row"), (F.col("copies") - 1).alias("copies"), F.col("text").alias("next"), F.col("a").alias("n"))
    last = F.struct("row", F.lit(1).cast("long").alias("copies"), "next", "n")
    return whole.select("p", "id", "text", "a", F.explode(F.when(F.col("copies") > 1, F.array(last, itself)).otherwise(F.array(last))).alias("x")).select("p", "x.row", "id", "text", "x.copies", "a", "x.next", "x.n")


def buckets(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def compare(rows: DataFrame, pairs: Sequence[tuple[str, str]], s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(p, row, pair, common): how many digests two versions share, for each pair of columns of `rows` and its number.

    rows has p, row, arrays of digests and their fingerprints, and is bucketed by p. What the fingerprints' difference
    doesn't give up by peeling gets larger sketches, and then ones of twice the size, until nothing is left.
    """
    n = buckets(rows.sparkSession)
    sizes = F.array(*[F.struct(F.lit(i).alias("pair"), (F.size(a) + F.size(b)).alias("both"), F.size(a).alias("of_a")) for i, (a, b) in enumerate(pairs)])
    asked = rows.select("p", "row", F.explode(sizes).alias("x")).select("p", "row", "x.*")
    prints = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"fingerprint_{a}").alias("x"), F.col(f"fingerprint_{b}").alias("y")) for i, (a, b) in enumerate(pairs)])
    cells = subtract(rows.select("p", "row", F.explode(prints).alias("z")).select("p", "row", "z.*"), SEEN, "x", "y", s)
    found, done, size = peel(cells, SEEN, s.rounds, bits=32), [], s.spare
    for _ in range(24):
        state = asked.join(found, list(SEEN), "left")  # what differs nowhere has no cells
        state = state.select(*SEEN, "both", "of_a", F.coalesce("cells_left", F.lit(0)).alias("cells_left"), (F.col("of_a") - F.coalesce("only_a", F.lit(0))).alias("common"))
        state = settle_bucketed(state, "p", n, "peeled")
        done.append(state.where("cells_left = 0").select(*SEEN, "common"))
        if state.where("cells_left > 0").isEmpty():
            break
        asked = state.where("cells_left > 0").select(*SEEN, "both", "of_a", F.ceil(F.col("both") * size + 4).cast("int").alias("size"))
        sets = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)])
        both = rows.select("p", "row", F.explode(sets).alias("z")).select("p", "row", "z.*").join(asked, list(SEEN))
        found, size = peel(differences(both, SEEN, "x", "y", "size"), SEEN, s.rounds), 2 * size
    else:
        raise RuntimeError("sketches could not be peeled")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def fingerprint_versions(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the row's own, but for the last half of its code points (rounded down), which is replaced by as
    many of the first ones of the next row's text, or all it has. Rows are in the order of descending keys; after the last
    one the first follows. A likeness is the share of distinct paragraphs of both texts that both have; 1 if neither has
    any. Keys are integers; rows without one come last, and rows that share a key are ordered by a hash of their texts,
    equal ones following each other. Null texts are empty. A single row follows itself. An empty table gives no rows.
    """
    s, spark = settings, docs.sparkSession
    # all joins here are of tables that are dealt out by p, on p and more: without this they would be shuffled by all keys
    name, n = "spark.sql.requireAllClusterKeysForCoPartition", buckets(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return _versions(docs, key, text, n, s)
    finally:
        spark.conf.set(name, before)


def _versions(docs: DataFrame, key: str, text: str, n: int, s: Settings) -> DataFrame:
    rows = with_next(docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), 4 * n, s)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("left(text, int(n_chars - n_chars div 2))"), F.expr("left(next, int(n_chars div 2))"))
    rows = rows.withColumn("edited", edited).withColumns({"edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "e": digests(F.col("edited"), s)})
    table = settle_bucketed(rows.select("p", "row", "id", "copies", "n_chars", "edited_sha256", "a", "e", "n"), "p", n, "digests")
    prints = settle_bucketed(sketches(table, ["p", "row"], ["a", "e", "n"], s), "p", n, "fingerprints")
    whole = table.join(prints, ["p", "row"])
    common = settle_bucketed(compare(whole, [("a", "e"), ("a", "n")], s), "p", n, "common")
    shared = common.groupBy("p", "row").agg(*[F.max(F.when(F.col("pair") == i, F.col("common"))).alias(f"common_{v}") for i, v in enumerate("en")])
    like = lambda v: F.when(F.size("a") + F.size(v) == 0, F.lit(1.0)).otherwise(F.col(f"common_{v}") / (F.size("a") + F.size(v) - F.col(f"common_{v}")))
    out = whole.join(shared, ["p", "row"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    out = settle(out.select(F.col("id").alias(key), "n_chars", "edited_sha256", F.col("fingerprint_a").alias("fingerprint"), F.col("fingerprint_e").alias("edited_fingerprint"), like("e").alias("near_edited"), like("n").alias("near_next")), "versions")
    for x in (table, prints, common):
        drop(x)
    return out


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to that and to the next document's."""
    return fingerprint_versions(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
