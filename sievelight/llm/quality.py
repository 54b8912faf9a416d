"""Quality rules learned as an ordered decision list over native text statistics.

Sequential covering (grow a conjunction of thresholds on one part of the labelled rows, prune it on the other,
remove what it covers, go on) gives rules that are emitted as one ordered CASE WHEN expression. Statistics and
verdicts are DataFrame functions only; the learner itself sees a bounded sample of labelled statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, apart, table, words_of

#: Labelled rows, chosen by hash, that the learner sees. The statistics of each are a dozen numbers.
SAMPLE_ROWS = 8_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A rule needs this precision on the pruning rows, and this many rejected growing rows.
MIN_PRECISION = 0.9
MIN_COVER = 8
MAX_RULES = 12
MAX_CONDITIONS = 4
#: Thresholds tried for each statistic.
CUTS = 48

FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "bangs_per_word",
            "digits_per_word", "distinct_share", "pipes_per_word", "stops_per_word", "words_per_line")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICTS = ("base_failed", "rule", "kept")


def statistics(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the FEATURES as `_f_*`.

    Null and empty texts have zeros everywhere. Repeated windows are found by sorting 64-bit hashes of the three
    words inside the row, so a long text costs n log n and nothing is exploded or shuffled.
    """
    text = F.coalesce(F.col("_q_text"), F.lit(""))
    docs = docs.drop(*BASE)
    a = docs.withColumn("_q_text", F.col("text").cast("string"))
    a = a.withColumn("_q_words", words_of(F.col("_q_text"))).withColumn(
        "_q_lines", F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]"))))
    w = F.col("_q_words")
    a = a.withColumn("n_words", F.size(w).cast("long")).withColumn("_q_win", F.slice(F.transform(
        w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))
    win = F.col("_q_win")
    a = a.withColumn("_q_sorted", F.sort_array(win))
    s = F.col("_q_sorted")
    a = a.withColumn("_q_twice", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, F.greatest(i - 1, F.lit(0)))))))
    twice = F.col("_q_twice")
    few = F.filter(F.transform(win, lambda x, i: F.when(F.array_contains(twice, x), i).otherwise(-1)), lambda i: i >= 0)
    a = a.withColumn("_q_pairs", F.when(F.size(twice) > 8, F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    p = F.col("_q_pairs")
    many = F.sort_array(F.transform(F.filter(p, lambda x,
        i: (x["h"] == F.get(p, i + 1)["h"]) & (i + 1 < F.size(p)) | (i > 0) & (x["h"] == F.get(p, F.greatest(i - 1, F.lit(0)))["h"])),
            lambda x: x["i"]))
    a = a.withColumn("_q_at", F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(F.size(twice) <= 8, few).otherwise(many))
    at = F.col("_q_at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda m, x: m + x)
    n = F.col("n_words")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    a = (a.withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
         .withColumn("n_symbols", count("[#*$%&|<>]").cast("long"))
         .withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
         .withColumn("n_repeat_words", covered.cast("long")))
    share = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    of = {
        "n_words": n.cast("double"), "mean_word": share(F.col("word_chars"), n), "symbols_per_word": share(F.col("n_symbols"), n),
        "dup_line_share": share(F.col("n_dup_lines"), F.size("_q_lines")), "repeat_share": share(F.col("n_repeat_words"), n),
        "upper_share": share(count("\\p{Lu}"), F.col("word_chars")), "bangs_per_word": share(count("[!?]"), n),
        "digits_per_word": share(count("[0-9]"), n),
        "distinct_share": share(F.size(F.array_distinct(w)), n), "pipes_per_word": share(count("[|]"), n), "stops_per_word": share(count("[.]"), n),
        "words_per_line": share(n, F.size("_q_lines")),
    }
    a = a.withColumns({f"_f_{k}": of[k] for k in FEATURES})
    made = [c for c in a.columns if c not in docs.columns and not c.startswith("_q_")]
    # a one-row generator: the optimizer would push a later filter below these projections, and with it copies of all their expressions
    return a.select(*docs.columns, F.inline(F.array(F.struct(*made))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.value if self.at_least else row[self.feature] <= self.value

    def column(self) -> Column:
        c = F.col(f"_f_{self.feature}")
        return c >= F.lit(self.value) if self.at_least else c <= F.lit(self.value)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[tuple[dict, bool]]) -> list[tuple[dict, bool]]:
    return [r for r in rows if all(c.holds(r[0]) for c in rule)]


def _bad(rows: list[tuple[dict, bool]]) -> int:
    return sum(b for _, b in rows)


def _grow(rows: list[tuple[dict, bool]]) -> Rule:
    """Adds the condition of the largest information gain until only rejected rows are covered."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS and 0 < _bad(rows) < len(rows):
        p0, best = math.log2(_bad(rows) / len(rows)), (0.0, None)
        for f in FEATURES:
            order = sorted((r[f], b) for r, b in rows)
            n, total = len(order), _bad(rows)
            below, at = 0, set(range(0, n, max(1, n // CUTS)))
            for i in range(n):
                if i and order[i][0] != order[i - 1][0] and (i in at or i < CUTS or n - i < CUTS or order[i][1] != order[i - 1][1] and n <= 2_000):
                    cut = (order[i][0] + order[i - 1][0]) / 2
                    for up, bad, size in ((True, total - below, n - i), (False, below, i)):
                        if bad >= MIN_COVER and (gain := bad * (math.log2(bad / size) - p0)) > best[0]:
                            best = (gain, Condition(f, up, cut))
                below += order[i][1]
        if best[1] is None:
            break
        rule += (best[1],)
        rows = _covered(rule, rows)
    return rule


def _prune(rule: Rule, rows: list[tuple[dict, bool]]) -> Rule:
    """Drops final conditions while the share of covered rejected over kept rows gets no worse."""
    def worth(r: Rule) -> float:
        c = _covered(r, rows)
        return (2 * _bad(c) - len(c)) / len(c) if c else -1.0
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (round(worth(r), 9), -len(r))) if rule else rule


def learn(rows: list[tuple[dict[str, float], bool]]) -> list[Rule]:
    """Rules that reject, in order. rows: statistics and whether the label rejects; every third row prunes."""
    grow, prune, rules = [r for i, r in enumerate(rows) if i % 3], rows[::3], []
    while len(rules) < MAX_RULES and _bad(grow) >= MIN_COVER:
        rule = _prune(_grow(grow), prune)
        hit = _covered(rule, prune)
        if not rule or not hit or _bad(hit) < MIN_PRECISION * len(hit):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r[0]) for c in rule)] for part in (grow, prune))
    return rules


def train(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list for `labels.quality` (0: reject). Without labelled rows there are no rules."""
    sample = (labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_quality"))
              .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS))
    # at most SAMPLE_ROWS rows of two numbers: the size is bounded, so it may be broadcast
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(sample), "_id")
    got = statistics(own).withColumn("_base_failed", base_failed()).groupBy("_id").agg(
        F.min(F.struct("_base_failed", "_quality", *[f"_f_{f}" for f in FEATURES])).alias("s"))
    rows = [({f: r.s[f"_f_{f}"] for f in FEATURES}, r.s["_quality"] == 0)
            for r in got.orderBy(F.xxhash64("_id"), "_id").collect() if not r.s["_base_failed"]]
    return learn(rows)


def verdict(rules: list[Rule]) -> Column:
    """1 for the first rule that rejects, and so on; 0 where none does."""
    if not rules:
        return F.lit(0)
    expr = reduce(lambda e, ir: e.when(reduce(lambda a, b: a & b, [c.column() for c in ir[1]]), ir[0]), enumerate(rules, 1), F)
    return expr.otherwise(0)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with its statistics, base_failed, rule (which rejects; 0: none) and kept.

    Null and empty texts have no words and fail the base rules. Columns of `docs` with these names are replaced; ties,
    repeated rows and null ids need no care, as each row is judged alone. Texts of any length are counted whole, inside the row. An
    empty table gives an empty one; without labels only the base rules judge.
    """
    judged = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(train(docs, labels)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns of `docs`, which keep their own values."""
    own, back = apart(docs, (*BASE, *VERDICTS))
    return quality(own, labels).filter("kept").select(*back)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("rule").cast("int").alias("rule"))
