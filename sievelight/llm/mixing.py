"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import apart, n_words_of, numbered, small, spill, table

MADE = ("size", "source_size", "target", "copies", "taken")
KEPT = ("_key", "_k", "_nth", "_from", "_longs", "_rate", "_step", "_u")
#: No document is taken more often than this, so a source's target stops at so many times its size.
MAX_COPIES = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: A document is long if it has more than one part in so many of its source's target.
LONG_SHARE = 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target): 100% of all sizes shared by weight; targets stop at
    max_copies times the source's size, the excess reshared by weight until none is above.

    Resharing ends with target = min(cap, level * weight) for one level. Sources in the order of cap / weight
    reach their cap one after the other, so running sums give the level without iterating. The table has one row
    a source; a window over it is no window over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("_reach", F.col("source").asc_nulls_last())
    a = sizes.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    a = a.withColumn("_cap", F.lit(float(max_copies)) * F.col("source_size")).withColumn("_reach", F.col("_cap") / F.col("_w"))
    upto, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    a = a.withColumn("_done", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))).withColumn("_gone", F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    a = a.withColumn("_total", F.sum("source_size").over(everything).cast("double")).withColumn("_weights", F.sum("_w").over(everything))
    # the level if exactly the sources before this one are at their caps; the first for which this one is not above is right
    a = a.withColumn("_level", (F.col("_total") - F.col("_done")) / (F.col("_weights") - F.col("_gone")))
    level = F.min(F.when(F.col("_level") <= F.col("_reach"), F.struct("_reach", "_level"))).over(everything)["_level"]
    return a.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w")).alias("target"))


def offset_of(source: Column, seed: str = SEED) -> Column:
    """One random offset of a source, from 0 to below 1."""
    name = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _copies(step: Column, rank: Column, u: Column) -> Column:
    """Whole numbers that the step of this rank crosses."""
    return F.least(F.floor(step * (rank + 1) + u) - F.floor(step * rank + u), F.lit(MAX_COPIES)).cast("long")


def _taken(sized: DataFrame, seed: str) -> DataFrame:
    """(source, size, doc_id, _key), a written table, with _rank, source_size, target and what gives the copies of a rank."""
    sums = spill(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), "mix-sources")
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    goals = targets(sums.select("source", "source_size")).withColumn("_rate", rate).withColumnRenamed("source", "_source")
    goals = small(spill(goals.withColumn("_u", offset_of(F.col("_source"), seed)), "mix-targets"))
    here = F.col("source").eqNullSafe(F.col("_source"))
    placed = numbered(sized.withColumn("_less", -F.col("size")), ["source"], ["_less", "doc_id", "_key"], "_rank", total).drop("_less")
    # long documents come first; what they give beyond or below their due is made good by the others of the source
    is_long = F.col("size") * LONG_SHARE > F.col("target")
    a = placed.join(goals, here, "left")
    told = a.groupBy("_source").agg(
        F.count_if(is_long).alias("_longs"), F.coalesce(F.sum(F.when(~is_long, F.col("size"))), F.lit(0)).alias("_short_size"),
        F.coalesce(F.sum(F.when(is_long, _copies(F.col("_rate"), F.col("_rank"), F.col("_u")) * F.col("size"))), F.lit(0)).alias("_long_taken"))
    rest = F.coalesce(F.try_divide(F.col("target") - F.col("_long_taken"), F.col("_short_size").cast("double")), F.lit(0.0))
    told = goals.join(told.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    told = small(spill(told.withColumn("_step", F.least(F.greatest(rest, F.lit(0.0)), F.lit(float(MAX_COPIES)))), "mix-steps"))
    return placed.join(told, here, "left")


def _copies_at(rank: Column) -> Column:
    longs, rate, step, u = F.col("_longs"), F.col("_rate"), F.col("_step"), F.col("_u")
    return F.when(rank < longs, _copies(rate, rank, u)).otherwise(
        F.least(F.floor(rate * longs + step * (rank - longs + 1) + u) - F.floor(rate * longs + step * (rank - longs) + u),
            F.lit(MAX_COPIES))).cast("long")


def _row_key(text: Column) -> Column:
    """Names a row by what it is judged by: its id, source and text."""
    told = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("|", told("doc_id"), told("source"), F.coalesce(text, F.lit(""))))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """`docs` with size (words), source_size, target (of its source), copies and taken (copies times size).

    Within a source the documents stand in the order of their sizes, longest first, and each adds its expected copies to
    a running sum; the sum is moved by one random offset, and a document is emitted once for each whole number that its
    step crosses. Everybody's expectation is target / source_size. As few long documents weigh much, the steps of those
    that are not long (under a LONG_SHARE-th of the target) are set once the long ones have been dealt, so that
    the source's expected words stay at its target; over all offsets their expectation is the same.

    Null text: size 0, never taken more than its copies of nothing. Null source: a source of its own, last by
    name. Ties are broken by doc_id and text; rows that agree in these and the source are alike, so reruns agree. A source
    without words has target 0. An empty table gives an empty result. Texts of any length are counted whole. Columns
    with these names are replaced.
    """
    own = docs.drop(*MADE, *KEPT).withColumn("source", F.col("source").cast("string"))
    text = F.col("text").cast("string")
    sized = spill(own.select("source", n_words_of(text).alias("size"), "doc_id", _row_key(text).alias("_key")), "mix-sizes")
    ranked = _taken(sized, seed)
    # rows that are alike stand next to each other: one row for them all
    alike = ranked.groupBy("_key").agg(F.min("_rank").alias("_from"),
        *[F.first(c).alias(c) for c in ("size", "source_size", "target", "_longs", "_rate", "_step", "_u")])
    alike = spill(alike.withColumnRenamed("_key", "_k"), "mix-alike")
    keyed = own.withColumn("_key", _row_key(text))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key")) - 1
    a = keyed.withColumn("_nth", nth).join(alike, F.col("_key") == F.col("_k")).withColumn("copies", _copies_at(F.col("_from") + F.col("_nth")))
    return a.withColumn("taken", F.col("copies") * F.col("size")).select(*own.columns, *MADE)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("source", n_words_of(F.col("text")).alias("size"), "doc_id", _row_key(F.col("text")).alias("_key"))
    a = _taken(spill(sized, "mix-sizes"), SEED)
    return a.select("doc_id", "size", "source_size", "target", (_copies_at(F.col("_rank")) * F.col("size")).alias("taken"), "source")


def emitted(docs: DataFrame) -> DataFrame:
    """The rows of the mix with the columns of `docs`, which keep their own values: each as often as it is taken.
    Nulls, ties, repeated rows and empty tables: as `mix` has them; wordless texts are emitted as often as their steps cross."""
    own, back = apart(docs, (*MADE, *KEPT, "_copy"))
    a = mix(own).filter("copies > 0")
    return a.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*back)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
c AS (SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / w AS reach FROM w),
r AS (SELECT *, coalesce(sum(cap) OVER q, 0) AS done, coalesce(sum(w) OVER q, 0) AS gone,
             sum(source_size) OVER () AS total, sum(w) OVER () AS ws
      FROM c WINDOW q AS (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by((total - done) / (ws - gone), reach) AS level FROM r WHERE (total - done) / (ws - gone) <= reach),
t AS (SELECT source, source_size, least(cap, level * w) AS target,
             CASE WHEN source_size > 0 THEN least(cap, level * w) / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix-1|' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u0
      FROM r, l),
p AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target, t.rate, t.u0,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) - 1 AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, count(*) FILTER (size * 20 > target) AS longs, coalesce(sum(size) FILTER (size * 20 <= target), 0) AS short_size,
             coalesce(sum(least(floor(rate * (k + 1) + u0) - floor(rate * k + u0), 3) * size) FILTER (size * 20 > target), 0) AS long_taken, any_value(target) AS goal
      FROM p GROUP BY source),
b AS (SELECT source, longs, CASE WHEN short_size > 0 THEN least(greatest((goal - long_taken) / short_size::DOUBLE, 0), 3) ELSE 0 END AS step FROM g)
SELECT doc_id, size, source_size, target, p.source,
       (CASE WHEN k < longs THEN least(floor(rate * (k + 1) + u0) - floor(rate * k + u0), 3)
             ELSE least(floor(rate * longs + step * (k - longs + 1) + u0) - floor(rate * longs + step * (k - longs) + u0), 3) END)::BIGINT * size AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""
