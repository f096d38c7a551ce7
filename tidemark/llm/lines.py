"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

A line is its sequence of words, the parts between single spaces. Equal lines are alike at any length, unless they are
only white space. Of different lines the shorter must have min_words words, and they are alike if at most one word was
inserted, removed or replaced, or one for each words_per_edit words of the shorter line, where that is more. Of like
lines the earliest, by document id and line number, is kept: a line goes if any earlier line is like it.

One edit: every line within the bound of another shares a variant with it: the line with one word removed (a replaced
word is removed at the same place in both; of an inserted word's pair the longer line's variant is the shorter line).
Variants are emitted as hashed keys only for lines that share one half with another line, as all pairs within the bound
do: the edit falls into the first or the last half, and the other half is unchanged. Groups of equal keys are never
expanded into pairs; each is reduced to its earliest line, which every member is within the bound of.

More edits: the variants with k words removed are too many, so they are cut short. An edit touches at most GRAM of a
line's runs of GRAM words, so of two like lines with k edits at most k * GRAM runs of either are missing in the other,
and under any common order of runs their first k * GRAM + 1 share one. These are the keys; the order puts rare runs first,
by a sketch of counts, so that a run of frequent words or a frequent passage is hardly ever a key and groups don't grow
with the data. Keys are dealt out once, as hashes of run and line, and those of a single line end there. Lines of a group of up to GROUP are compared with its earliest and, if
that isn't enough, with each other; what is left of larger ones is keyed again, by the k + 1 words of the line that fewest members
of the group have (an edit touches one word; the second "the" of a line is another word than the first). Those that share such a
word are compared with the earliest of them, and only lines that this leaves with all others, so that many copies of a line
aren't expanded into their pairs. Pairs whose lengths or word parities are too different are left out (in large groups by a
parity of 512 bits, which tells apart lines that have the same many words but for a few), the others verified by the true
distance in words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, settle

#: Lines of fewer words are never removed for a line one edit away, which would leave less than four fifths of them equal.
MIN_WORDS = 5
#: Words of the shorter line for each edit.
WORDS_PER_EDIT = 10
#: Words of the runs by which lines with more than one edit are found; at most half of words_per_edit, so that a run is left.
GRAM = 3
#: Runs are counted in the lines of one of SAMPLE documents, which decides their order alone, by hashes of so many bits at most.
SAMPLE, MOST_COUNT_BITS = 8, 23
#: A line that makes up more than one of so many rows gives its keys once.
HOT = 4096
#: Members of a group that are compared with each other directly.
GROUP = 256
#: Names of the numbers of 64 bits that are the parity of a large group's member.
PARTS = "abcdefgh"
#: Bits for each line whose text is looked up, in the set by which texts are told apart before they are shuffled, and bits at most.
BITS_PER_LINE, MOST_BITS = 16, 28


def _part(line: Column, count: Column) -> Column:
    """The first words of a line, or the last ones if count is negative."""
    return F.call_function("substring_index", line, F.lit(" "), count.cast("int"))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(d, l, line, n): document id, line number from 0, the line and its number of words, of lines that aren't blank."""
    lines = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("d"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("l", "line"))
    lines = lines.where(F.col("line").rlike("[^\\x09-\\x0D\\x20]"))
    return lines.withColumn("n", (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1).cast("int"))


def _ids(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")]


def _halves(line: Column, n: Column) -> Column:
    """Hashes of the first and of the last words that a line shares with a like line. Of a pair whose shorter line has m
    words, either the first m / 2 or the last m - m / 2 are equal; m is n or n - 1, which gives three different parts.
    Each comes with the first and the last place (from 0) at which this line may then have the edit."""
    n = n.cast("int")
    half, less = F.shiftright(n, 1), F.shiftright(n - 1, 1)  # equal if n is odd
    longer, shorter = n - half, n - 1 - less  # equal if n is even
    even = half != less
    first, last = F.xxhash64(F.lit("first"), _part(line, half)), F.xxhash64(F.lit("last"), _part(line, -longer))
    other = F.when(even, F.xxhash64(F.lit("first"), _part(line, less))).otherwise(F.xxhash64(F.lit("last"), _part(line, -shorter)))
    return F.array(
        F.struct(first.alias("k"), half.alias("lo"), (n - 1).alias("hi")),
        F.struct(last.alias("k"), F.lit(0).alias("lo"), (n - 1 - shorter).alias("hi")),
        F.struct(other.alias("k"), F.when(even, less).otherwise(0).alias("lo"), F.when(even, n - 1).otherwise(n - 1 - shorter).alias("hi")),
    )


def _within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are equal but for at most one word inserted, removed or replaced: outside a common
    beginning and a common end at most one word is left of either."""
    least = F.least(F.size(a), F.size(b))
    differs = F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True), F.lit(0))
    begins = F.when(differs == 0, least.cast("long")).otherwise(differs - 1)
    back = F.coalesce(F.array_position(F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: F.coalesce(x != y, F.lit(True))), True), F.lit(0))
    ends = F.when(back == 0, least.cast("long")).otherwise(back - 1)
    return F.greatest(F.size(a), F.size(b)) - F.least(begins + ends, least.cast("long")) <= 1


def _once(x: Column, f) -> Column:
    """f(x), where x is computed once although f uses it for each item of an array."""
    return F.transform(F.array(x), f)[0]


def _runs(line: Column, q: int) -> Column:
    """Hashes of a line's runs of q words, in order; the line has at least q."""
    run = lambda h: F.transform(F.slice(h, 1, F.size(h) - q + 1), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, q)]))
    return _once(F.transform(F.split(line, " "), lambda x: F.xxhash64(x)), run)


def _within(a: Column, b: Column, bound: Column) -> Column:
    """Whether two word arrays are at most bound words inserted, removed or replaced apart: as strings of one character
    for each word, its number among the words of both."""
    number = lambda words: lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, x) + 65536), 8, "0")), "UTF-32")
    near = lambda words: F.call_function("levenshtein", *[F.array_join(F.transform(w, number(words)), "") for w in (a, b)], bound.cast("int")) >= 0
    return _once(F.array_union(a, b), near)


def _texts(lines: DataFrame, some: DataFrame, what: str | Column = "line") -> DataFrame:
    """Those of lines (d, l, line, n) whose place `at` is in some (at, ...), with its columns and `what`, without their n.

    Which lines to shuffle is told from a set of hash bits, whose size grows with the places up to 2**MOST_BITS; where
    it leaves doubt a line is shuffled that isn't needed."""
    bits = max(16, min(MOST_BITS, (BITS_PER_LINE * some.count()).bit_length()))
    slot = lambda d, l: F.pmod(F.xxhash64(d, l), F.lit(1 << bits))
    x = slot("at.d", "at.l")
    words = some.select(F.floor(x / 64).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int")).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    every = lines.sparkSession.range(1 << (bits - 6)).join(words, F.col("id") == F.col("i"), "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    # in two steps, so that what each task sends is a part of the set
    part = every.groupBy((F.col("id") / 1024).cast("int").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda s: s["b"]).alias("part"))
    held = part.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "part"))), lambda s: s["part"])).alias("bits"))
    at = slot("d", "l")
    is_set = F.call_function("shiftright", F.get(F.col("bits"), F.floor(at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    texts = lines.join(F.broadcast(held), is_set).select(F.struct("d", "l").alias("at"), what)  # one row, of at most 32 MB
    return texts.join(some, "at")


def _slot(x: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(x), slots).cast("int")


def _run_counts(lines: DataFrame, bits: int, q: int) -> Column:
    """An array of 2**bits bytes: for each hash of a run how often such runs occur in a sample of lines, in steps of a
    quarter of a power of two. It is a sketch of bounded size, of at most 2**MOST_COUNT_BITS bytes."""
    sample = lines.where(F.pmod(F.xxhash64("d"), F.lit(SAMPLE)) == 0).select(F.explode(_runs(F.col("line"), q)).alias("x"))
    found = sample.groupBy(_slot(F.col("x"), F.lit(1 << bits)).alias("i")).agg(F.least(F.lit(126), F.floor(4 * F.log2(F.count("*") + 1))).cast("tinyint").alias("c"))
    every = lines.sparkSession.range(1 << bits).join(found, F.col("id") == F.col("i"), "left").select("id", F.coalesce("c", F.lit(0).cast("tinyint")).alias("c"))
    # in two steps, so that what each task sends is a part of the array
    part = every.groupBy((F.col("id") / 4096).cast("int").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "c"))), lambda s: s["c"]).alias("part"))
    held = part.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "part"))), lambda s: s["part"])).alias("held"))
    return settle(held, "counts").scalar()


def _shared_runs(lines: DataFrame, unique: DataFrame, per: int, q: int) -> DataFrame:
    """(v, h): the keys that more than one of lines has, and the lines' hashes; all lines have 2 * per words or more."""
    edits = F.floor(F.col("n") / per)
    total = unique.agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("n")).alias("words")).first()
    counts = _run_counts(lines, max(16, min(MOST_COUNT_BITS, ((total["words"] or 0) // (4 * SAMPLE)).bit_length())), q)
    # eight bits for how frequent the run's slot is, then the run
    order = lambda held: lambda x: F.call_function("shiftleft", F.get(held, _slot(x, F.size(held))).cast("long"), F.lit(56)).bitwiseOR(x.bitwiseAND(F.lit(2**56 - 1)))
    ordered = F.transform(F.array("held"), lambda held: F.transform(_runs(F.col("line"), q), order(held)))[0]  # held once, so that it is read in place
    keys = F.slice(F.sort_array(ordered), 1, (edits * q + 1).cast("int"))
    # fewer than HOT lines make up more than one of HOT rows each
    hot = [r["h"] for r in unique.where(F.col("copies") > F.lit(max(100, (total["rows"] or 0) // HOT))).select("h").collect()]
    emit = lambda some: some.withColumn("held", counts).select(F.array_distinct(keys).alias("vs"), F.xxhash64("line").alias("h")).select(F.explode("vs").alias("v"), "h")
    of = emit(lines.where(~F.xxhash64("line").isin(hot))).unionByName(emit(lines.where(F.xxhash64("line").isin(hot))).distinct()) if hot else emit(lines)
    group = Window.partitionBy("v")
    shared = of.withColumns({"lo": F.min("h").over(group), "hi": F.max("h").over(group)}).where("lo <> hi")
    return shared.select("v", "h").distinct()


def _parity(line: Column) -> Column:
    """Two numbers of 64 bits: for each class of word hashes whether the line has an odd number of its words. An edit
    changes at most two bits of each."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    part = lambda h, by: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(F.shiftrightunsigned(x, by))))
    return _once(F.transform(F.split(line, " "), lambda x: F.xxhash64(x)), lambda h: F.struct(part(h, 0).alias("a"), part(h, 6).alias("b")))


def _occurrences(line: Column) -> Column:
    """Hashes of a line's words, each with its number among the equal ones: an edit takes away one and adds one at most."""
    numbered = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, i - F.array_position(h, x)))
    return _once(F.array_sort(F.transform(F.split(line, " "), lambda x: F.xxhash64(x))), numbered)


def _wide_parity(occurrences: Column) -> Column:
    """A number of 64 bits for each of PARTS: as _parity, but all numbers together change in two bits at most by an edit."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    mine = lambda x, i: F.pmod(F.shiftrightunsigned(x, 6), F.lit(len(PARTS))) == i
    part = lambda i: F.aggregate(occurrences, F.lit(0).cast("long"), lambda a, x: F.when(mine(x, i), a.bitwiseXOR(bit(x))).otherwise(a))
    return F.struct(*[part(i).alias(c) for i, c in enumerate(PARTS)])


def _may_be_near(per: int, wide: bool = False) -> Column:
    """False only for a line y that isn't earlier than x or that lengths or parities show to be further away than the bound."""
    bound = F.floor(F.least("x.n", "y.n") / per)
    differ = [F.bit_count(F.col(f"x.p.{i}").bitwiseXOR(F.col(f"y.p.{i}"))) for i in (PARTS if wide else "ab")]
    bits = sum(differ[1:], differ[0]) <= 2 * bound if wide else (differ[0] <= 2 * bound) & (differ[1] <= 2 * bound)
    return (F.col("y.at") < F.col("x.at")) & (F.abs(F.col("x.n") - F.col("y.n")) <= bound) & bits


def _groups(lines: DataFrame, unique: DataFrame, per: int) -> DataFrame:
    """(v, xs, y, c): groups of lines that share a key: all members, the earliest and their number. A group of more than
    GROUP members has a row for each of them."""
    keys = _shared_runs(lines, unique, per, min(GRAM, per // 2)).join(unique.select("h", F.struct("at", "n", "p").alias("x")), "h").select("v", "x")
    group = Window.partitionBy("v")
    keys = keys.withColumns({"y": F.min("x").over(group), "c": F.count("*").over(group)})
    alone = F.when(F.col("c") > GROUP, F.col("x.at"))  # dealt out by v already
    return settle(keys.groupBy("v", alone.alias("alone")).agg(F.collect_list("x").alias("xs"), F.first("y").alias("y"), F.first("c").alias("c")).drop("alone"), "keys")


def _pairs(rows: DataFrame, per: int, wide: bool = False) -> DataFrame:
    """(at, earlier), each once, of those of rows (x, y) that may be near."""
    return settle(rows.where(_may_be_near(per, wide)).select("x.at", F.col("y.at").alias("earlier")).distinct(), "pairs")


def _places(pairs: DataFrame) -> DataFrame:
    return pairs.select("at").unionByName(pairs.select(F.col("earlier").alias("at")))


def _near_long(lines: DataFrame, unique: DataFrame, per: int) -> DataFrame:
    """(at) of those of lines (d, l, line, n), all of 2 * per words or more, that an earlier one is within the bound of."""
    keys = _groups(lines, unique, per)
    lead = _pairs(keys.select("y", F.explode("xs").alias("x")), per)
    near = _verified(lines, lead, per)
    # members that aren't near the earliest of a group: with all earlier ones of small groups, and in large ones with those
    # that share a word which few of the group have
    gone = near.select(F.col("at").alias("gone"))
    rest = keys.where(F.col("c").between(3, GROUP)).select("xs", F.explode("xs").alias("x")).join(gone, F.col("x.at") == F.col("gone"), "left_anti")
    pairs = settle(_pairs(rest.select("x", F.explode("xs").alias("y")), per).join(lead, ["at", "earlier"], "left_anti"), "rest")
    # a large group all of whose members are near its earliest, or gone otherwise, has nothing left to find
    many = settle(keys.where(F.col("c") > GROUP).select("v", F.col("xs")[0].alias("x"), F.col("y.at").alias("lead")), "all_many")
    left = many.where(F.col("x.at") != F.col("lead")).join(gone, F.col("x.at") == F.col("gone"), "left_anti").select("v").distinct()
    many = settle(many.select("v", "x").join(left, "v", "left_semi"), "many")
    drop(keys)
    near = settle(near.unionByName(_verified(lines, pairs, per)).distinct(), "near")
    if many.isEmpty():
        return near
    members = _texts(lines, many.select("x.at").distinct(), _occurrences(F.col("line")).alias("ws")).dropDuplicates(["at"])
    members = settle(members.select("at", "ws", _wide_parity(F.col("ws")).alias("p")), "members")
    of = F.col("x.at") == F.col("at")
    words = settle(many.join(members, of).select("v", F.struct("x.at", "x.n").alias("x"), F.explode("ws").alias("w")), "words")
    count = words.groupBy("v", "w").agg(F.count("*").alias("c"))
    rare = words.join(count, ["v", "w"]).groupBy("v", "x").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "w"))), 1, (F.floor(F.first("x.n") / per) + 1).cast("int")).alias("k"))
    rare = settle(rare.join(members.select("at", "p"), of).select("v", F.struct("x.at", "x.n", "p").alias("x"), F.explode("k.w").alias("w")), "rare")
    drop(words)
    rest = lambda: rare.join(near.select(F.col("at").alias("gone")), F.col("x.at") == F.col("gone"), "left_anti")
    # with the earliest that shares the word, as copies of a line do that is not like the group's earliest
    lead = _pairs(rest().join(rare.groupBy("v", "w").agg(F.min("x").alias("y")), ["v", "w"]), per, wide=True)
    near = settle(near.unionByName(_verified(lines, lead, per)).distinct(), "near")
    more = _pairs(rest().join(rare.select("v", "w", F.col("x").alias("y")), ["v", "w"]), per, wide=True)
    more = settle(more.join(lead, ["at", "earlier"], "left_anti"), "more")
    return settle(near.unionByName(_verified(lines, more, per)).distinct(), "near")


def _verified(lines: DataFrame, pairs: DataFrame, per: int) -> DataFrame:
    """`at` of those of pairs (at, earlier) of lines (d, l, line, n) that are within the bound. Words are first told apart by
    8 bits of their hashes, which can only bring lines nearer: so only a character for each word is shuffled for every
    pair, and whole lines for what these leave."""
    both = lambda pairs, df, c: pairs.join(df.select("at", F.col(c).alias("a")), "at").join(df.select(F.col("at").alias("earlier"), F.col(c).alias("b")), "earlier")
    bound = lambda size: F.floor(F.least(size("a"), size("b")) / per).cast("int")
    code = F.array_join(F.transform(F.split("line", " "), lambda x: F.char(F.xxhash64(x).bitwiseAND(F.lit(255)))), "")
    codes = settle(_texts(lines, _places(pairs).distinct(), code.alias("code")).dropDuplicates(["at"]), "codes")
    coded = both(pairs.select("at", "earlier"), codes, "code")
    coded = settle(coded.where(F.call_function("levenshtein", F.col("a"), F.col("b"), bound(F.length)) >= 0).select("at", "earlier"), "coded")
    drop(codes)
    texts = settle(_texts(lines, _places(coded).distinct()).dropDuplicates(["at"]), "texts")
    exact = both(coded, texts, "line").select("at", F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    near = settle(exact.where(_within(F.col("a"), F.col("b"), bound(F.size))).select("at").distinct(), "near")
    drop(texts)
    return near


def like_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_edits: int = 1, words_per_edit: int | None = WORDS_PER_EDIT) -> DataFrame:
    """(d, l, h): document id, line number and hash of every line that goes.

    max_edits is 0 (equal lines only) or 1; with words_per_edit (4 or more, None for one edit at any length) longer lines
    have one edit for each so many words. min_words binds lines with an edit alone. Null texts, rows without an id and
    lines of nothing but white space take no part. Rows that share an id are one document: equal lines of equal number
    are one line, which no copy of its document removes.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    if words_per_edit is not None and words_per_edit < 4:
        raise ValueError("words_per_edit is 4 or more")
    per = words_per_edit if max_edits else None
    lines, place = _lines(docs, key, text), F.struct("d", "l")
    # a line that may have two edits is here for its pairs with shorter ones only
    short = (F.col("n") >= min_words) & ((F.col("n") <= max(2 * per, min_words)) if per else F.lit(True)) & F.lit(max_edits > 0)
    long = F.col("n") >= max(2 * per, min_words) if per else F.lit(False)
    occurs = lines.select(*_ids(), "d", "l", "n", F.when(short, _halves(F.col("line"), F.col("n"))).alias("keys"), F.when(long, _parity(F.col("line"))).alias("p"))
    occurs = settle(occurs, "lines")
    unique = occurs.groupBy("h", "g").agg(F.min(F.struct(place.alias("at"), "n", "keys", "p")).alias("x"), F.count("*").alias("copies"))
    unique = settle(unique.select("h", "g", "x.*", "copies"), "unique")
    gone = unique.where("copies > 1").select("h", "g", "at", F.lit(False).alias("all"))
    if max_edits:
        shared = unique.select("h", F.explode("keys.k").alias("k")).groupBy("k").agg(F.min("h").alias("low"), F.max("h").alias("high"))
        shared = shared.where("low <> high").select("k")
        chosen = unique.select("h", "at", F.explode("keys").alias("x")).select("h", "at", "x.*").join(shared, "k", "left_semi")
        chosen = settle(chosen.groupBy("at").agg(F.min("h").alias("h"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "chosen")
        texts = settle(_texts(lines, chosen.select("at")).dropDuplicates(["at"]), "texts")
        near = _near(texts.join(chosen, "at"))
        if per:
            near = near.unionByName(_near_long(lines.where(long), unique.where(long), per)).distinct()
        gone = gone.unionByName(unique.join(near, "at", "left_semi").select("h", "g", "at", F.lit(True).alias("all")))
        gone = gone.groupBy("h", "g").agg(F.min("at").alias("at"), F.max("all").alias("all"))
    gone = settle(gone, "gone")  # so that the join deals out both sides and may split a line that is everywhere
    for df in (unique, *((chosen, texts) if max_edits else ())):
        drop(df)
    same = (F.col("d") == F.col("at.d")) & (F.col("l") == F.col("at.l"))
    return occurs.select("h", "g", "d", "l").join(gone, ["h", "g"]).where(F.col("all") | ~same).select("d", "l", "h")


def _near(texts: DataFrame) -> DataFrame:
    """(at) of those of texts (at, h, line, lo, hi), all different, that an earlier one is one edit away from."""
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    before, after = _part(F.col("line"), F.col("p")), _part(F.col("line"), F.col("p") + 1 - F.col("n"))
    without = F.when(F.col("p") == 0, after).when(F.col("p") == F.col("n") - 1, before).otherwise(F.concat(before, F.lit(" "), after))
    removed = texts.select("at", "line", n.alias("n"), F.explode(F.sequence("lo", "hi")).alias("p")).select(F.xxhash64(without).alias("v"), "p", "at")
    variants = settle(removed.unionByName(texts.select(F.col("h").alias("v"), F.lit(-1).alias("p"), "at")), "variants")  # -1: the line itself
    common = variants.groupBy("v").agg(F.count("*").alias("members")).where("members > 1").select("v")
    variants = settle(variants.join(common, "v", "left_semi"), "common")
    earliest = variants.groupBy("v", "p").agg(F.min("at").alias("first"))
    by_key = earliest.groupBy("v").agg(F.min(F.when(F.col("p") >= 0, F.col("first"))).alias("shortened"), F.min(F.when(F.col("p") < 0, F.col("first"))).alias("whole"))
    found = (
        variants.join(earliest.where("p >= 0"), ["v", "p"]).select("at", F.col("first").alias("earlier"))
        .unionByName(variants.join(by_key, "v").select("at", F.when(F.col("p") >= 0, F.col("whole")).otherwise(F.col("shortened")).alias("earlier")))
        .where("earlier < at").distinct()
    )
    text = texts.select("at", F.split("line", " ").alias("w"))
    found = found.join(text, "at").select("at", "earlier", F.col("w").alias("mine")).join(text.select(F.col("at").alias("earlier"), "w"), "earlier")
    return found.where(_within_one(F.col("mine"), F.col("w"))).select("at").distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_edits: int = 1, words_per_edit: int | None = WORDS_PER_EDIT) -> DataFrame:
    """docs without the lines that an earlier like line makes superfluous, and n_lines, n_removed (int).

    The kept lines stay in order, joined by line feeds; a text that loses every line is empty. A null text stays null,
    with 0 lines; rows without an id stay as they are. Lines are parts between line feeds; all of each text is read.
    Columns named n_lines or n_removed are replaced, all others kept, whatever their names.
    """
    gone = like_lines(docs, key, text, min_words, max_edits, words_per_edit).groupBy("d").agg(F.collect_set(F.struct("l", "h")).alias("g"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    parts = F.split("t", "\n", -1)
    left = F.filter(parts, lambda x, i: ~F.array_contains("g", F.struct(i.alias("l"), F.xxhash64(x).alias("h"))))
    out = whole.join(gone, F.col("k") == F.col("d"), "left").withColumn("left", F.when(F.col("g").isNotNull(), left))
    n = F.when(F.col("t").isNull(), 0).otherwise(F.size(parts))
    return out.select(
        *[F.when(F.col("g").isNull(), F.col("t")).otherwise(F.array_join("left", "\n")).alias(c) if c == text else F.col("row")[c].alias(c) for c in rest],
        n.alias("n_lines"), F.when(F.col("g").isNull(), 0).otherwise(n - F.size("left")).alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str, words_per_edit: int | None = None) -> DataFrame:
    """All documents without the lines that an earlier line makes superfluous which is equal or one edit away."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, words_per_edit=words_per_edit)
    return out.select("doc_id", F.col("text"), F.col("n_lines").cast("long"), F.col("n_removed").cast("long"))


def op9_line_dedup_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_line_dedup, with one edit for each WORDS_PER_EDIT words of longer lines, as in the pipeline."""
    return op9_line_dedup(spark, sf_dir, WORDS_PER_EDIT)


#: The same in SQL. Lines with one edit meet by their variants.
_LINES = f"""lines AS (
  SELECT doc_id, doc_id * 1000000 + i AS o, parts[i] AS line, regexp_matches(parts[i], '[^\\x09-\\x0D\\x20]') AS counts
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), LATERAL unnest(range(1, len(parts) + 1)) AS u(i)),
firsts AS MATERIALIZED (SELECT min(o) AS o, line, string_split(line, ' ') AS w, len(w) AS n FROM lines WHERE counts GROUP BY line),
variants AS (SELECT o, p, md5(array_to_string(list_filter(w, lambda x, j: j <> p), ' ')) AS v FROM firsts, LATERAL unnest(range(1, n + 1)) AS u(p) WHERE n BETWEEN {MIN_WORDS} AND {{most}}),
near_short AS (
  SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY v, p) AS first FROM variants) WHERE first < o
  UNION SELECT greatest(a.o, b.o) FROM variants a JOIN firsts b ON a.v = md5(b.line) AND b.n >= {MIN_WORDS})"""
_REST = """gone AS (SELECT x.o FROM lines x JOIN firsts f USING (line) WHERE counts AND (x.o > f.o OR f.o IN (SELECT o FROM near))),
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY lines.o) FILTER (WHERE gone.o IS NULL), '') AS text, count(*) AS n_lines, count(gone.o) AS n_removed
  FROM lines LEFT JOIN gone ON lines.o = gone.o GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed FROM documents d LEFT JOIN kept k USING (doc_id)
"""

ORACLE = f"WITH {_LINES.format(most=1_000_000)}, near AS (SELECT o FROM near_short), {_REST}"

#: Lines with more edits meet by the number of runs of three words that both have; the distance in words fills a band of
#: the table of distances row by row.
ORACLE_LONG = f"""WITH RECURSIVE {_LINES.format(most=2 * WORDS_PER_EDIT)},
runs AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY o) AS c FROM (SELECT DISTINCT o, n, md5(array_to_string(w[p:p + 2], ' ')) AS r FROM firsts, LATERAL unnest(range(1, n - 1)) AS u(p) WHERE n >= {2 * WORDS_PER_EDIT})),
pairs AS MATERIALIZED (
  SELECT x.o AS a, y.o AS b, least(x.n, y.n) // {WORDS_PER_EDIT} AS k, f.w AS aw, g.w AS bw
  FROM (SELECT x.o AS a, y.o AS b FROM runs x JOIN runs y ON x.r = y.r AND x.o < y.o AND abs(x.n - y.n) <= least(x.n, y.n) // {WORDS_PER_EDIT}
        GROUP BY x.o, y.o HAVING count(*) >= greatest(any_value(x.c), any_value(y.c)) - 3 * (least(any_value(x.n), any_value(y.n)) // {WORDS_PER_EDIT})) z
  JOIN firsts f ON z.a = f.o JOIN firsts g ON z.b = g.o JOIN firsts x ON x.o = f.o JOIN firsts y ON y.o = g.o),
steps AS (
  SELECT a, b, 0 AS i, list_transform(range(1, 2 * k + 2), lambda s: CASE WHEN s - 1 < k THEN 1000000 ELSE s - 1 - k END) AS band FROM pairs
  UNION ALL
  SELECT a, b, i, list_transform(range(1, 2 * k + 2), lambda s: s + list_min(list_transform(t[1:s], lambda x, p: x - p))) AS band
  FROM (SELECT s.a, s.b, s.i + 1 AS i, k, list_transform(range(1, 2 * k + 2), lambda p: CASE
          WHEN s.i + p - k < 0 OR s.i + p - k > len(bw) THEN 1000000
          WHEN s.i + p - k = 0 THEN coalesce(band[p + 1], 1000000) + 1
          ELSE least(coalesce(band[p + 1], 1000000) + 1, band[p] + CAST(aw[s.i + 1] <> bw[s.i + p - k] AS BIGINT)) END) AS t
        FROM steps s JOIN pairs USING (a, b) WHERE s.i < len(aw) AND list_min(band) <= k)),
near AS (SELECT o FROM near_short UNION SELECT b FROM steps JOIN pairs USING (a, b) WHERE i = len(aw) AND band[len(bw) - len(aw) + k + 1] <= k),
{_REST}"""
