"""Toxicity by a weighted finite-state grammar over clauses.

Six transducers read a clause's words as symbols: insults (a lexicon of stems learned from labels), threats,
targets, negation, reported speech and abuse that goes on. Their composition is one deterministic machine whose state says
how long ago a target or a negator was read, whether speech is reported and whether the clause has been abusive before;
at an insult or a threat it emits which of these hold. Stems that also occur by chance (weak ones) are composed with all of them like
others, but emit only where the clause has a target in reach or was abusive before. A clause that holds one alone, neither negated nor
reported, is suspect, and suspect clauses count where there are others. The emissions of all clauses are weighed by learned log-odds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, small_batches, spill, table

#: Labelled rows, chosen by hash, from which lexicon and weights are learned.
SAMPLE_ROWS = 20_000
#: A stem begins words of at least this share of toxic texts, and so many times as rarely of others.
MIN_SHARE, MAX_OTHERS = 0.03, 0.02
#: A weak stem may also occur by chance; twice in a text it is found at most so often in others.
MAX_OTHERS_TWICE = 0.25
STEM_LETTERS = range(4, 10)
#: Chance that a prefix is found in toxic texts only must be below this.
CHANCE = 1e-7

# Function words of the four languages of the texts that the grammar knows.
TARGETS = {"you", "your", "youre", "u", "he", "she", "they", "them", "him", "her", "these", "those", "people",
           "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "er", "tu", "te", "toi", "ton", "ta", "vous", "votre", "il", "elle", "ils",
           "tú", "ti", "usted", "ustedes", "vosotros", "él", "ella", "ellos"}
NEGATORS = {"not", "no", "never", "isnt", "arent", "dont", "without", "nicht", "kein", "keine", "nie", "niemals", "ohne",
            "pas", "jamais", "aucun", "sans", "nunca", "jamás", "ningún", "sin"}
REPORTERS = {"said", "says", "say", "wrote", "called", "quoted", "reported", "claimed", "alleged", "sagte", "schrieb", "nannte", "zitierte",
             "dit", "écrit", "appelé", "cité", "dijo", "escribió", "llamó", "citó"}
THREATS = ("kill", "murder", "hurt", "stab", "shoot", "strangle", "töten", "umbringen", "erschieß", "tuer", "assassin", "égorg", "matar", "asesin")

_CLAUSE = re.compile(r"[.!?;:\n\r]+")
_WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = 7
INSULT, THREAT, TARGET, NEGATOR, REPORT, WEAK, OTHER = range(SYMBOLS)
#: How many words a target or a negator reaches.
REACH = 4


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step gives the next state; holds says whether the state marks an emission."""

    start: int
    arcs: dict[tuple[int, int], int]
    marks: frozenset[int]

    def step(self, state: int, symbol: int) -> int:
        return self.arcs.get((state, symbol), self.arcs.get((state, -1), state))


def _fading(symbol: int, reach: int) -> Transducer:
    """Marks for `reach` words after the symbol."""
    arcs = {(s, -1): max(s - 1, 0) for s in range(reach + 1)} | {(s, symbol): reach for s in range(reach + 1)}
    return Transducer(0, arcs, frozenset(range(1, reach + 1)))


def _staying(*symbols: int) -> Transducer:
    """Marks from any of the symbols to the end of the clause."""
    return Transducer(0, {(0, s): 1 for s in symbols}, frozenset({1}))


def emission(symbol: int, marks: list[bool]) -> int:
    """What a symbol emits where the parts hold these marks: targeted, negated, reported, abusive before. -1: nothing."""
    targeted, negated, reported, abusive = marks
    if symbol in (INSULT, THREAT):
        return targeted + 2 * negated + 4 * reported + 8 * (symbol == THREAT)
    if symbol == WEAK and (targeted or abusive):
        return WEAK_AT + (not targeted) + 2 * negated + 4 * reported
    return SUSPECT if symbol == WEAK and not negated and not reported else -1


@dataclass(frozen=True)
class Grammar:
    """The composition, with a table of (next state, emission) for each state and symbol; emission -1 is none."""

    arcs: list[list[tuple[int, int]]]
    start: int

    @staticmethod
    def compose(*parts: Transducer) -> Grammar:
        start = tuple(p.start for p in parts)
        number, todo, arcs = {start: 0}, [start], []
        while todo:
            state, row = todo.pop(0), []
            for symbol in range(SYMBOLS):
                nxt = tuple(p.step(s, symbol) for p, s in zip(parts, state, strict=True))
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append((number[nxt], emission(symbol, [s in p.marks for p, s in zip(parts, state, strict=True)])))
            arcs.append(row)
        return Grammar(arcs, 0)


#: Emissions 0 to 15: bit 0 targeted, 1 negated, 2 reported, 3 a threat; from WEAK_AT, of weak stems: bit 0 in a clause abusive
#: before but without a target in reach, 1 negated, 2 reported; then clauses with more than one emission, targets soon after an insult,
#: suspect clauses after the first, and how many of these there are in a hundred clauses.
WEAK_AT, MANY, AFTER, AGAIN, DENSE, N_FEATURES = 16, 24, 25, 26, 27, 28
SUSPECT = N_FEATURES
GRAMMAR = Grammar.compose(_fading(TARGET, REACH), _fading(NEGATOR, REACH), _staying(REPORT), _staying(INSULT, THREAT, WEAK))
# Where labels show nothing, a negated or reported insult counts less, a threat only with a target.
PRIOR = [2.0, 2.5, 1.0, 1.2, 1.0, 1.2, 0.8, 0.8, 0.5, 2.5, 0.2, 0.8, 0.2, 0.8, 0.1, 0.4, 1.0, 0.6, 0.4, 0.3, 0.4, 0.3, 0.2, 0.2, 1.0, 0.5, 1.0, 0.5]
PRIOR_BIAS = -3.0


@dataclass
class Model:
    stems: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    weights: list[float] = field(default_factory=lambda: [*PRIOR])
    bias: float = PRIOR_BIAS

    def scanner(self) -> re.Pattern:
        return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, sorted((*self.stems, *self.weak, *THREATS), key=len, reverse=True)))})")


def symbol_of(word: str, model: Model) -> int:
    if model.stems and word.startswith(model.stems):
        return INSULT
    if model.weak and word.startswith(model.weak):
        return WEAK
    if word.startswith(THREATS):
        return THREAT
    return TARGET if word in TARGETS else NEGATOR if word in NEGATORS else REPORT if word in REPORTERS else OTHER


def features(text: str | None, model: Model, scanner: re.Pattern) -> list[float]:
    """log(1 + emissions) of a whole text. Clauses without an insult or a threat emit nothing and are passed over."""
    out = [0.0] * N_FEATURES
    low, suspects = (text or "").lower(), 0
    end = 0
    for hit in scanner.finditer(low):
        if hit.start() < end:
            continue
        begin = max((m.end() for m in _CLAUSE.finditer(low, end, hit.start())), default=end)
        stop = _CLAUSE.search(low, hit.start())
        end = stop.start() if stop else len(low)
        state, emitted, last, suspect = GRAMMAR.start, 0, None, False
        for m in _WORD.finditer(low, begin, end):
            symbol = symbol_of(m[0], model)
            state, e = GRAMMAR.arcs[state][symbol]
            last = REACH + 1 if symbol == INSULT else last and last - 1
            if e == SUSPECT:
                suspect = True
            elif e >= 0:
                out[e] += 1
                emitted += 1
            elif symbol == TARGET and last:
                out[AFTER] += 1
        out[MANY] += emitted > 1
        suspects += suspect
    if suspects > 1:
        out[AGAIN], out[DENSE] = suspects - 1, 100 * suspects / (1 + len(_CLAUSE.findall(low)))
    return [math.log1p(x) for x in out]


def _prefixes(text: str | None) -> Counter[str]:
    n: Counter[str] = Counter()
    for w, c in Counter(_WORD.findall((text or "").lower())).items():
        for k in STEM_LETTERS:
            if len(w) >= k:
                n[w[:k]] += c
    return n


def _counting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a kind a prefix begins a word, and more than one."""
    for b in batches:
        once: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        twice: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for t, kind in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            p = _prefixes(t)
            once[kind].update(p.keys())
            twice[kind].update(x for x, c in p.items() if c > 1)
        for kind, of in once.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.string()), pa.array([kind] * len(of), pa.int32()),
                pa.array(list(of.values()), pa.int64()),
                                              pa.array([twice[kind][x] for x in of], pa.int64())], ["prefix", "toxic", "n", "n2"])


def worth_of(n_toxic: int, n_other: int) -> tuple[Column, Column]:
    """worth and weak of a prefix by the texts that it occurs in: it begins words that are all but only found in toxic texts, or
    is weak and does so where it occurs more than once. Null: neither."""
    base = n_toxic / max(1, n_toxic + n_other)
    least = max(4, MIN_SHARE * n_toxic, math.log(CHANCE) / math.log(min(max(base, 1e-3), 0.9)))
    strong = (F.col("n_1") >= least) & (F.col("n_0") <= MAX_OTHERS * F.col("n_1"))
    weak = (F.col("n2_1") >= least) & (F.col("n2_0") <= MAX_OTHERS_TWICE * F.col("n2_1"))
    worth = F.when(strong, F.col("n_1") - 10 * F.col("n_0")).when(weak, F.col("n2_1") - 3 * F.col("n2_0"))
    return worth.alias("worth"), (~strong).alias("weak")


def stems_of(worth: dict[str, tuple[int, bool]]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Stems and weak stems: of a chain of prefixes the one that separates best, and the longest of equals."""
    chosen: set[str] = set()
    heads: set[str] = set()  # all that chosen stems begin with
    for p in sorted(worth, key=lambda p: (-worth[p][0], -len(p), p)):
        if p not in heads and not any(p[:k] in chosen for k in STEM_LETTERS):
            chosen.add(p)
            heads.update(p[:k] for k in range(1, len(p) + 1))
    return tuple(sorted(p for p in chosen if not worth[p][1])), tuple(sorted(p for p in chosen if worth[p][1]))


def fit(x: np.ndarray, y: np.ndarray, pull: float = 2.0, steps: int = 40) -> tuple[list[float], float]:
    """Logistic regression by Newton steps, drawn towards the prior weights."""
    a = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array([*PRIOR, PRIOR_BIAS])
    w, keep = prior.copy(), np.diag([pull] * len(PRIOR) + [0.1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (p - y) + keep @ (w - prior))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns stems and weights from labelled rows that are not held out. Equal texts count once. Without both
    kinds of labels the prior weights stand, with no stems."""
    small_batches(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    sample = (known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS))
    # at most SAMPLE_ROWS rows of two numbers: the size is bounded, so it may be broadcast
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string")).join(F.broadcast(sample), "_id")
    own = spill(own.filter("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")
    n = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model()
    # prefixes are counted, joined and judged in Spark; only the stems come to the driver, and there are few
    counted = own.mapInArrow(_counting, "prefix string, toxic int, n long, n2 long").groupBy("prefix").agg(*[
        F.coalesce(F.sum(F.when(F.col("toxic") == kind, F.col(c))), F.lit(0)).alias(f"{c}_{kind}") for kind in (0, 1) for c in ("n", "n2")])
    worth = {r.prefix: (r.worth, r.weak) for r in counted.select("prefix", *worth_of(n[1], n[0])).filter("worth is not null").collect()}
    model = Model(*stems_of(worth))
    rows = own.mapInArrow(_features(model), "toxic int, x array<double>").collect()
    rows.sort(key=lambda r: (r.toxic, r.x))  # at most SAMPLE_ROWS; sums must not depend on the order in which tasks end
    model.weights, model.bias = fit(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float))
    return model


def _features(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = model.scanner()
        for b in batches:
            x = [features(t, model, scanner) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])
    return run


def score_of(x: list[float], model: Model) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, model.bias + sum(w * v for w, v in zip(model.weights, x, strict=True))))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score (0 to 1) of its whole texts; null and empty texts get the score of no emission.
    Other columns pass through; one named score is replaced. Each row is judged alone, so repeated rows and null ids need no care. Texts of
    any length are read whole, in linear time. An empty table gives an empty one."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts):
        scanner = model.scanner()
        return texts.map(lambda t: score_of(features(t, model, scanner), model)).astype("float64")

    return docs.withColumn("score", scored(F.col("text").cast("string")))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score below 0.5, with the columns of `docs`, which keep their own values. Null and empty texts stay
    unless the labels make most texts toxic; ties and repeated rows are judged alike, each alone."""
    own, back = apart(docs, ("score",))
    return score(own, train(own, labels)).filter(F.col("score") < 0.5).select(*back)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
