"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers over word classes are composed into one machine, which reads a clause word by word:

- the lexicon writes each word's class: insult or threat with a weight, target, negation, report, or other;
- negation marks the insults and threats up to three words after a negation;
- reported speech marks those that come after a word of saying in the clause;
- target guesses whether the clause has a target word and marks insults and threats if so; a path whose guess turns out
  wrong is not accepted. A threat counts only in a clause with a target.

An accepted path's weight is the sum of its words' weights, each times the factors of its marks; a clause's weight is
that of its best path. Clauses end at .!?; and line feeds. All classes are learned from labelled texts: insults are words
and beginnings of words that are much more frequent in toxic texts; the others are words whose presence in a clause with
an insult (or, for threats, with a target) changes the odds that the text is toxic, beside short lists of words known to
belong to them. How much each mark counts is learned too: a text's score is a logistic function of its strongest clause,
of the sum of its clauses, of that sum's share of the text, and of the sums under each mark.

Where labelled texts hold few negated, reported or aimed insults, as the given ones do, the insults decide almost alone,
and the grammar amounts to an insult lexicon: the README has the figures of leaving its marks out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import with_arrow
from tidemark.llm.quality import held_out

# Words of four languages that are known to belong to a class.
THREATS = "kill hurt destroy burn punch tuer frapper brûler töten schlagen verbrennen matar golpear quemar"
TARGETS = "you your he she they him her them tu vous il elle ils ihr du sie er tú usted él ella ellos"
NEGATIONS = "not no never isn't aren't wasn't don't ne pas jamais non nicht kein keine nie nunca jamás"
REPORTS = "said says wrote claimed quoted quote dit écrit sagte schrieb dijo escribió"


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # labelled rows that are learned from, at most: those of least hash
    terms: int = 5_000  # at most, those of largest weight
    beginnings: tuple[int, ...] = (4, 5, 6, 7)  # characters of a word's beginning that can be a term
    least_texts: int = 4  # toxic texts that a term occurs in
    least_weight: float = 2.0  # logarithm of the odds
    least_strength: float = 8.0  # of the weight times the root of the number of toxic texts: what is rare must be clearer
    contexts: int = 500  # words of each other class, at most
    context_texts: int = 20  # texts that such a word stands in a clause with a match of
    context_weight: float = 0.7  # change of the logarithm of the odds
    target: float = 1.25
    negated: float = 0.25
    reported: float = 0.5
    threat: float = 1.0  # weight of a threat


CLASSES = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "other", "insult", "threat", "target", "negation", "report"
_END = "end"


@dataclass
class Transducer:
    """arcs[state][symbol] = [(next state, written symbol, factor)]; a symbol without an arc is written as it is."""

    starts: tuple
    finals: frozenset
    arcs: dict

    def step(self, state, symbol: str) -> list[tuple]:
        return self.arcs.get(state, {}).get(symbol, [(state, symbol, 1.0)])

    def compose(self, other: Transducer, symbols: tuple[str, ...] = (*CLASSES, _END)) -> Transducer:
        """Reads what self reads and writes what other writes of self's symbols; factors multiply."""
        starts = tuple((a, b) for a in self.starts for b in other.starts)
        arcs, open_, finals = {}, list(starts), set()
        while open_:
            at = open_.pop()
            if at in arcs:
                continue
            if at[0] in self.finals and at[1] in other.finals:
                finals.add(at)
            arcs[at] = {s: [((x, y), out, f * g) for x, mid, f in self.step(at[0], s) for y, out, g in other.step(at[1], mid)] for s in symbols}
            open_ += [to for found in arcs[at].values() for to, _, _ in found]
        return Transducer(starts, frozenset(finals), arcs)


def _mark(symbol: str, mark: str) -> str:
    return f"{symbol}+{mark}"


def _matches(*marks: str) -> list[str]:
    """Symbols of insults and threats under any of the marks that are written before."""
    found = [INSULT, THREAT]
    for m in marks:
        found += [_mark(x, m) for x in found]
    return found


def machine(s: Settings) -> Transducer:
    """Negation, report and target composed, from word classes to marked insults and threats with their factors."""
    negation = {}
    for n in range(4):
        left = max(0, n - 1)
        negation[n] = {x: [(left, x, 1.0)] for x in (OTHER, TARGET, REPORT)} | {NEGATION: [(3, NEGATION, 1.0)], _END: [(0, _END, 1.0)]}
        negation[n] |= {x: [(left, _mark(x, "negated"), s.negated) if n else (left, x, 1.0)] for x in (INSULT, THREAT)}
    first = Transducer((0,), frozenset({0}), negation)
    said = {x: [("said", _mark(x, "reported"), s.reported)] for x in _matches("negated")} | {_END: [("plain", _END, 1.0)]}
    report = Transducer(("plain",), frozenset({"plain"}), {"plain": {REPORT: [("said", REPORT, 1.0)]}, "said": said})
    before = _matches("negated", "reported")
    marked = {x: _mark(x, "targeted") for x in before}
    insults, threats = [x for x in before if x.startswith(INSULT)], [x for x in before if x.startswith(THREAT)]
    guess = {
        "none": {TARGET: []} | {x: [("none", OTHER, 0.0)] for x in threats} | {_END: [("over", _END, 1.0)]},
        "some": {TARGET: [("seen", TARGET, 1.0)]} | {x: [("some", marked[x], s.target)] for x in insults + threats} | {_END: []},
        "seen": {x: [("seen", marked[x], s.target)] for x in insults + threats} | {_END: [("over", _END, 1.0)]},
    }
    return first.compose(report).compose(Transducer(("none", "some"), frozenset({"over"}), guess))


_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE = re.compile(r"[.!?;\n]+")
MARKS = ("negated", "reported", "targeted", THREAT)


@dataclass
class Grammar:
    weights: dict[str, float]  # of insult terms; a final * marks a beginning
    classes: dict[str, str] = field(default_factory=dict)  # of the other words, beside those of the lists
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self):
        self.sizes = sorted(set(self.settings.beginnings), reverse=True)
        lists = {THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}
        self.words = {w: c for c, text in lists.items() for w in text.split()} | self.classes
        self.known: dict[str, tuple[str, float]] = {}  # words met; forgotten when full
        m = machine(self.settings)
        number = {state: i for i, state in enumerate(m.arcs)}
        self.starts, self.finals = [number[x] for x in m.starts], {number[x] for x in m.finals}
        marks = lambda out: tuple(i for i, k in enumerate(MARKS) if k in out)
        self.arcs = [{c: [(number[to], f, marks(out), out.startswith((INSULT, THREAT))) for to, out, f in found] for c, found in m.arcs[state].items()} for state in number]

    def read(self, word: str) -> tuple[str, float]:
        """The lexicon: class and weight of a word; an insult's is that of the longest term which it is or begins with."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[word] = self._read(word)
        return got

    def _read(self, word: str) -> tuple[str, float]:
        w = self.weights.get(word)
        for n in self.sizes:
            if w is None and len(word) >= n:
                w = self.weights.get(word[:n] + "*")
        if w is not None:
            return INSULT, w
        c = self.words.get(word, OTHER)
        return c, self.settings.threat if c == THREAT else 0.0

    def clause(self, words: list[str]) -> tuple[float, list[float]]:
        """Weight of the clause's best path, and what insults and threats weigh under each mark on it."""
        none = (0.0,) * len(MARKS)
        paths = {x: (0.0, none) for x in self.starts}
        for c, w in [*map(self.read, words), (_END, 0.0)]:
            after: dict = {}
            for state, (total, sums) in paths.items():
                for to, factor, marks, match in self.arcs[state][c]:
                    value = total + w * factor
                    if to not in after or value > after[to][0]:
                        after[to] = value, tuple(x + w if i in marks else x for i, x in enumerate(sums)) if match else sums
            paths = after
        total, sums = max((p for x, p in paths.items() if x in self.finals), default=(0.0, none))
        return total, list(sums)

    def measures(self, text: str) -> tuple[float, ...]:
        """Strongest clause, sum of clauses, the sum's share of the text's words, and sums under each mark; only clauses
        with an insult or threat are read."""
        text = text.lower()
        words = _WORD.findall(text)
        found = {w for w in set(words) if self.read(w)[0] in (INSULT, THREAT)}
        best = total = 0.0
        sums = np.zeros(len(MARKS))
        for clause in _CLAUSE.split(text) if found else ():
            inside = _WORD.findall(clause)
            if not found.isdisjoint(inside):
                weight, marked = self.clause(inside)
                best, total, sums = max(best, weight), total + weight, sums + marked
        return best, total, total / max(1, len(words)), *sums.tolist()


def _terms(sample: DataFrame, text: str, s: Settings) -> dict[str, float]:
    """Terms and weights. sample has `_y`; counted are texts, per word and per beginning of words."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+"))
    terms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, *[F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in s.beginnings]))))
    counts = sample.select("_y", F.explode(terms).alias("t")).where("t is not null and t <> ''").groupBy("t").agg(F.sum("_y").cast("long").alias("bad"), F.count("*").alias("all"))
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).cast("long").alias("bad")).first()
    good_n, bad_n = totals["n"] - totals["bad"], totals["bad"]
    odds = F.log((F.col("bad") + 0.5) / F.lit(bad_n + 1.0)) - F.log((F.col("all") - F.col("bad") + 0.5) / F.lit(good_n + 1.0))
    best = counts.where(F.col("bad") >= s.least_texts).withColumn("w", odds).withColumn("strength", F.col("w") * F.sqrt("bad")).where((F.col("w") >= s.least_weight) & (F.col("strength") >= s.least_strength)).orderBy(F.desc("strength"), "t").limit(s.terms)
    return {r["t"]: r["w"] for r in best.select("t", "w").collect()}


def _contexts(sample: DataFrame, text: str, weights: dict[str, float], s: Settings) -> dict[str, str]:
    """Classes of words, learned from the clauses of labelled texts: of those with an insult, which words before it, or
    anywhere, go with texts that are less or more toxic than such clauses' texts are; of those without one but with a
    target, which words go with toxic texts. Counted are texts, and only words in context_texts of them."""
    held = sample.sparkSession.sparkContext.broadcast((weights, {}, s))
    roles = ("near", "before", "clause", "threat")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        g, out = _grammar(held), []
        for t in batch.column(text):
            seen = set()
            for clause in _CLAUSE.split((t.as_py() or "").lower()):
                words = _WORD.findall(clause)
                kinds = [g.read(w)[0] for w in words]
                at = [i for i, k in enumerate(kinds) if k == INSULT]
                if at:
                    other = [(w, i) for i, w in enumerate(words) if kinds[i] != INSULT]
                    seen |= {f"near {w}" for w, i in other if any(0 < j - i <= 3 for j in at)} | {f"before {w}" for w, i in other if i < at[-1]} | {f"clause {w}" for w, _ in other}
                    seen |= {f"{r} " for r in roles[:3]}
                elif TARGET in kinds:
                    seen |= {f"threat {w}" for w in words} | {"threat "}
            out.append(sorted(seen))
        return {"_t": pa.array(out, pa.list_(pa.string()))}

    rows = with_arrow(sample.select("_y", text), {"_t": T.ArrayType(T.StringType())}, run, keep=["_y"])
    counts = rows.select("_y", F.explode("_t").alias("t")).groupBy("t").agg(F.sum("_y").cast("long").alias("bad"), F.count("*").alias("all")).where(F.col("all") >= s.context_texts)
    parts = counts.withColumns({"role": F.substring_index("t", " ", 1), "w": F.substring_index("t", " ", -1)})
    total = parts.where("w = ''").select("role", F.col("bad").alias("b0"), F.col("all").alias("a0"))
    logit = lambda bad, all_: F.log((F.col(bad) + 0.5) / (F.col(all_) - F.col(bad) + 0.5))
    shift = parts.where("w <> ''").join(F.broadcast(total), "role").withColumn("shift", logit("bad", "all") - logit("b0", "a0"))  # four rows
    wanted = F.when(F.col("role").isin("near", "before"), F.col("shift") <= -s.context_weight).otherwise(F.col("shift") >= s.context_weight)
    best = shift.where(wanted).select("role", "w", F.abs("shift").alias("x"), "all").orderBy(F.desc(F.col("x") * F.sqrt("all")), "w", "role").limit(s.contexts * len(roles))
    kind = dict(zip(roles, (NEGATION, REPORT, TARGET, THREAT), strict=True))
    found: dict[str, str] = {}
    for r in best.select("role", "w").collect():
        found.setdefault(r["w"], kind[r["role"]])
    return found


@dataclass
class Model:
    grammar: Grammar
    coefficients: np.ndarray  # of 1, strongest clause, logarithms of 1 + sum, of 1 + 100 * share, and of 1 + sum under each mark

    def without(self, mark: str) -> Model:
        """As if no word opened that mark: negated, reported, targeted or threat."""
        kind = dict(zip(MARKS, (NEGATION, REPORT, TARGET, THREAT), strict=True))[mark]
        g = Grammar(self.grammar.weights, self.grammar.classes, self.grammar.settings)
        g.words = {w: c for w, c in g.words.items() if c != kind}
        return Model(g, self.coefficients)


def _inputs(m: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(m), 1)), m[:, :1], np.log1p(m[:, 1:2]), np.log1p(100 * m[:, 2:3]), np.log1p(m[:, 3:])], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:  # noqa: B008
    """Learn terms and the logistic function from the labelled rows for which `usable` holds, at most settings.sample.

    Terms, their weights and the other classes come from three quarters of the sample and the function from the rest. Null keys, texts and labels
    aren't used; a key that is labelled more than once counts with its largest label. With no labelled rows every
    score is one half.
    """
    s = settings
    ids = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable).groupBy(key).agg(F.max(label).alias("_y"))
    ids = ids.orderBy(F.xxhash64(key), key).limit(s.sample)  # bounded by settings.sample, so it may be broadcast
    sample = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(ids), key).withColumn("_half", F.pmod(F.xxhash64(F.lit("half"), key), F.lit(4)) == 0)
    weights = _terms(sample.where("not _half"), text, s)
    grammar = Grammar(weights, _contexts(sample.where("not _half"), text, weights, s), s)
    rows = _measured(sample.where("_half"), grammar, text).select("_y", "_m").toArrow()  # settings.sample / 4 rows of numbers
    m = np.array(rows.column("_m").to_pylist(), dtype=float).reshape(-1, 3 + len(MARKS))
    y = np.array(rows.column("_y").to_pylist(), dtype=float)
    return Model(grammar, _logistic(_inputs(m), y) if len(y) else np.zeros(4 + len(MARKS)))


def _measured(docs: DataFrame, grammar: Grammar, text: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((grammar.weights, grammar.words, grammar.settings))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        g = _grammar(held)
        return {"_m": pa.array([g.measures(t.as_py() or "") for t in batch.column(text)], pa.list_(pa.float64()))}

    return with_arrow(docs, {"_m": T.ArrayType(T.DoubleType())}, run)


_grammars: dict[int, Grammar] = {}


def _grammar(held) -> Grammar:
    """The grammar of a broadcast, built once in each worker."""
    key = id(held.value[0])
    if key not in _grammars:
        _grammars.clear()
        weights, known, settings = held.value
        _grammars[key] = Grammar(weights, {}, settings)
        if known:
            _grammars[key].words = known
    return _grammars[key]


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, the probability that the whole text is toxic. A null or empty text has no clause."""
    held = docs.sparkSession.sparkContext.broadcast((model.grammar.weights, model.grammar.words, model.grammar.settings))
    b = model.coefficients

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        g = _grammar(held)
        m = np.array([g.measures(t.as_py() or "") for t in batch.column(text)], dtype=float).reshape(-1, 3 + len(MARKS))
        return {out: pa.array(1 / (1 + np.exp(-np.clip(_inputs(m) @ b, -35, 35))))}

    return with_arrow(docs, {out: T.DoubleType()}, run)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; held-out rows are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs, labels, ~out)
    return score(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
