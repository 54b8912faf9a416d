"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words everywhere in this subpackage are runs of other characters than these.
SPACE = r"\x20\x09-\x0D"
#: Rows that a Python worker gets at once where rows carry whole texts.
TEXT_BATCH_ROWS = 256
#: Rows of one range when rows are numbered without a single-task sort, and the most ranges (sorts spill beyond).
RANGE_ROWS, MAX_RANGES = 50_000, 20_000
#: Narrow tables of at most so many rows may be broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or f"file://{tempfile.mkdtemp(prefix='sievelight-')}")
    return configured or sc.getCheckpointDir()


def spill(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again, so that its rows are fixed, its lineage is cut
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """`docs` with its own columns of these names (in any case) under others, and the columns that give `docs` back:
    what an operator adds under these names does not touch them."""
    made = {n.lower() for n in names}
    away = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in made}
    return docs.withColumnsRenamed(away), [F.col(away.get(c, c)).alias(c) for c in docs.columns]


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are counted to be few, else joined as any other."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words_of(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words, counted by the places where one begins."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?<![^{SPACE}])[^{SPACE}]")).cast("long")


def numbered(df: DataFrame, key: list[str], order: list[str], out: str, total: int | None = None) -> DataFrame:
    """Adds `out`, each row's place from 0 among those with its key in the order of `order`, without one task for a key.

    Rows are dealt by ranges of (key, order) and sorted inside each, so a key of any size is spread over as many
    ranges as it needs; each row's place is that in its range, moved on by what earlier ranges hold of its key. The
    places are those of one sort, whatever the ranges. Ties are rows that agree in all that `key` and `order` name;
    they get places next to each other. `df` should be narrow: its rows are shuffled and written once.
    """
    n = df.count() if total is None else total
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    by = [*key, *order]
    lined = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    # the number of a row's task and its place there, in one long
    lined = spill(lined.withColumn("_at", F.monotonically_increasing_id()), "lined")
    place = F.shiftright("_at", 33)
    spans = lined.groupBy(*key, place.alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # a row for each key and one more for each range that a key goes on in
    spans = small(spill(spans.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_range", "_first", "_start"), "spans"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    joined = lined.withColumn("_r", place).join(spans, [*same, F.col("_r") == F.col("_range")])
    return joined.select(*df.columns, (F.col("_start") + F.col("_at") - F.col("_first")).alias(out))


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.Table]:
    """Joins small Arrow batches to larger ones."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: Keys with more than this share of the rows are joined apart; there can't be more than its inverse.
HEAVY = 256


def matched(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` joined with `side`, which has one row a key, where all keys are alike (nulls too). Both are written tables.

    A side of few rows is broadcast. Else keys that hold over a 256th of the rows, which are at most 255, are broadcast with what
    the side has of them, and all others are shuffled: no key lands in one task however many rows it has."""
    other = side.withColumnsRenamed({k: f"_side_{k}" for k in keys})
    join = lambda left, right: left.join(right, [F.col(k).eqNullSafe(F.col(f"_side_{k}")) for k in keys]).drop(*[f"_side_{k}" for k in keys])
    if side.count() <= BROADCAST_ROWS:
        return join(rows, F.broadcast(other))
    heavy = rows.groupBy(*keys).count().filter(F.col("count") * HEAVY > rows.count())
    heavy = F.broadcast(spill(heavy.select(*[F.col(k).alias(f"_heavy_{k}") for k in keys]), "heavy"))
    split = lambda df, name, how: df.join(heavy, [F.col(name + k).eqNullSafe(F.col(f"_heavy_{k}")) for k in keys], how)
    return join(split(rows, "", "left_semi"), F.broadcast(split(other, "_side_", "left_semi"))).unionByName(join(split(rows, "", "left_anti"), other))
