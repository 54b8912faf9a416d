"""Scans along a key in order of time, for keys of any size.

Rows are cut into ranges of (key, order). Each range is scanned by itself; what it hands on (its last row, its sums) goes to the
ranges behind it through a table of one row a key and range. No window and no task holds a key whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Rows of a range, and the most ranges (windows and sorts spill beyond).
RANGE_ROWS, MAX_RANGES = 50_000, 20_000


def ranged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows in ranges of (key, order), written; adds _range, the number of a row's range, and _at, which rises within it."""
    ranges = max(1, min(MAX_RANGES, -(-df.count() // RANGE_ROWS)))
    lined = df.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order)
    return written(lined.withColumn("_at", F.monotonically_increasing_id()), "ranged").withColumn("_range", F.shiftright("_at", 33))


def scanned(df: DataFrame, key: str, order: list[str], before: dict[str, str] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds for each of `before` what the named column was in the key's row before (null: none), and for each of `sums` the sum
    of an expression over the key's rows up to and with this one. Rows that agree in key and order stand in any order."""
    before, sums = before or {}, sums or {}
    lined = ranged(df, key, order)
    for out, c in sums.items():
        lined = lined.withColumn(out, c)
    here = Window.partitionBy(key, "_range").orderBy("_at")
    spans = lined.groupBy(key, "_range").agg(F.max_by(F.struct(F.lit(0), *before.values()), "_at").alias("_last"), F.struct(F.lit(0), *[F.sum(out).alias(out) for out in sums]).alias("_sums"))
    earlier = Window.partitionBy(key).orderBy("_range")
    past = earlier.rowsBetween(Window.unboundedPreceding, -1)
    # a row a key and range
    spans = written(spans.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), *[F.lag(F.col("_last")[c]).over(earlier).alias(f"_b_{out}") for out, c in before.items()],
        *[F.sum(F.col("_sums")[out]).over(past).alias(f"_s_{out}") for out in sums]), "spans")
    a = lined
    for out, c in before.items():
        a = a.withColumn(out, F.lag(F.struct(c)).over(here))
    for out in sums:
        a = a.withColumn(out, F.sum(out).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    a = a.join(spans, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    # a range's first row is told by the struct, as the value itself may be null
    made = [F.when(F.col(out).isNotNull(), F.col(out)[c]).otherwise(F.col(f"_b_{out}")).alias(out) for out, c in before.items()]
    made += [(F.col(out) + F.coalesce(F.col(f"_s_{out}"), F.lit(0))).alias(out) for out in sums]
    return a.select(*df.columns, *made)


def first_of(df: DataFrame, key: str, flag: Column, value: Column, out: str) -> DataFrame:
    """Adds `out`, the least `value` of the key's rows with the flag (null: none). The key's value goes to its rows by way of parts
    of the key, of which there are as many as rows need, so that no key is met by all its rows at once."""
    least = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.when(flag, value)).alias(out), F.count("*").alias("_n")).filter(F.col(out).isNotNull())
    # no part has more rows than a range, or than a ten-thousandth of all: that many keys at most have several
    unit = max(RANGE_ROWS, df.count() // 10_000)
    parts = least.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / unit).cast("int")))).select("_key", "_part", out)
    large = F.broadcast(least.filter(F.col("_n") >= unit).select(F.col("_key").alias("_big"), F.floor(F.col("_n") / unit).alias("_most")))
    dealt = df.join(large, F.col(key).eqNullSafe(F.col("_big")), "left")
    dealt = dealt.withColumn("_p", F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("_most") + 1), F.lit(0)).cast("int"))
    return dealt.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_p") == F.col("_part")), "left").select(*df.columns, out)


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that stand together, by their keys."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        tb = pa.Table.from_batches([b])
        if held:
            tb = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), tb])
        new = np.zeros(tb.num_rows - 1, bool)
        for k in keys:
            c = tb.column(k).combine_chunks()
            new |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(False) | (c[1:].is_null().to_numpy(False) != c[:-1].is_null().to_numpy(False))
        cuts = np.flatnonzero(new) + 1
        if held:
            tb, cuts = tb.slice(1), cuts - 1
        at = 0
        for c in cuts.tolist():
            held.append(tb.slice(at, c - at))
            yield pa.concat_tables(held)
            held, at = [], c
        held.append(tb.slice(at))
    if held:
        yield pa.concat_tables(held)


def _ends(times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row `span` later, and the last start in the range of the chain that begins with it."""
    after = np.searchsorted(times, times + span)
    last = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            last[i] = last[after[i]]
    return after, last


def _next_range(spans: dict, key, time: int):
    """The range of the key in which its first row at or after a time stands; None: there is none."""
    ranges, _, lasts = spans[key]
    i = int(np.searchsorted(lasts, time))
    return ranges[i] if i < len(ranges) else None


def _doors(spans, key: str, ms: str, span: int, kind: str):
    """Of each range all times at which a chain that leaves it may go on: (key, the range where it goes on, time). The key's first row is one too."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tb in _groups(batches, [key, "_range"]):
            k, r, times = tb.column(key)[0].as_py(), tb.column("_range")[0].as_py(), tb.column(ms).to_numpy()
            found = np.unique(times[_ends(times, span)[1]] + span).tolist()
            ranges = spans.value[k][0]
            rows = [(k, q, t) for t in found if (q := _next_range(spans.value, k, t)) is not None] + ([(k, r, int(times[0]))] if r == ranges[0] else [])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], tb.schema.field(key).type), *[pa.array([x[i] for x in rows], pa.int64()) for i in (1, 2)]], ["key", "at", "time"])
    return run, f"key {kind}, at long, time long"


def _steps(spans, key: str, ms: str, span: int, kind: str):
    """Rows of ranges and doors to edges: (key, at, time) to the door by which a chain that came in there goes out, (to, then), with the place of its last
    start in the key and that start's time."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "at", "time", "to", "then", "start", "began"]
        for tb in _groups(batches, [key, "_range"]):
            k, r = tb.column(key)[0].as_py(), tb.column("_range")[0].as_py()
            door = tb.column("_door").to_numpy().astype(bool)
            times, doors = tb.column(ms).to_numpy()[~door], np.unique(tb.column(ms).to_numpy()[door])
            if not len(doors):
                continue
            last = _ends(times, span)[1][np.searchsorted(times, doors)]
            ranges, firsts, _ = spans.value[k]
            n = len(doors)
            then = times[last] + span
            to = [_next_range(spans.value, k, t) for t in then.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, tb.schema.field(key).type), pa.array([r] * n, pa.int64()), pa.array(doors), pa.array(to, pa.int64()), pa.array(then),
                pa.array(last + firsts[ranges.index(r)]), pa.array(times[last])], names)
    return run, f"key {kind}, at long, time long, to long, then long, start long, began long"


def orbit(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (key, at, time) that chains of edges reach from the roots, by doubling: after i joins the first 2^i nodes of each
    chain are found, and edges are as many steps long."""
    found, jumps = written(roots.distinct(), "orbit"), edges.select("key", "at", "time", "to", "then").filter("to is not null")
    while not jumps.isEmpty():
        a, b = found.alias("a"), jumps.alias("b")
        ahead = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.time") == F.col("b.time")))
        found = written(found.unionByName(ahead.select("b.key", F.col("b.to").alias("at"), F.col("b.then").alias("time"))).distinct(), "orbit")
        c = jumps.alias("c")
        jumps = written(b.join(c, F.col("b.key").eqNullSafe(F.col("c.key")) & (F.col("b.to") == F.col("c.at")) & (F.col("b.then") == F.col("c.time"))).select("b.key", "b.at", "b.time", "c.to", "c.then"), "jumps")
    return found


def chained(df: DataFrame, key: str, ms: str, tie: str, span: int, mark: Callable[[np.ndarray, np.ndarray], np.ndarray], out: str) -> DataFrame:
    """Windows that begin with a key's first row, and again with the first row `span` after the last beginning. Adds the boolean `out`: mark(places, starts), of rows'
    places in their key and those of their windows' beginnings.

    The beginnings of a key that fills several ranges depend on all before. Each range tells for every time by which a chain may
    come in how it goes out; these edges are followed by doubling, so that log n joins find where the key's own chain enters each range. Then all
    ranges are marked at once. Times are whole; rows without one are refused."""
    if dict(df.dtypes)[ms] not in ("bigint", "int"):
        raise ValueError("times are whole milliseconds")
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    timed = F.coalesce(F.col(ms).cast("bigint"), F.raise_error(F.lit("a row has no time")).cast("bigint"))
    lined = ranged(df.withColumn(ms, timed), key, [ms, tie])
    spans = lined.groupBy(F.col(key).alias("key"), F.col("_range").alias("at")).agg(F.count("*").alias("n"), F.max(ms).alias("last"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # at most two keys of a range go on in another, so this has a few rows a range, however many keys there are
    spans = spans.withColumns({"ranges": F.count("*").over(whole), "first": F.coalesce(F.sum("n").over(before), F.lit(0))})
    spans = written(spans.filter("ranges > 1"), "spans")
    cut: dict = {}
    for s in spans.orderBy("at").collect():
        for values, v in zip(cut.setdefault(s.key, ([], [], [])), (s.at, s["first"], s["last"]), strict=True):
            values.append(v)
    entered: dict = {}
    if cut:
        sent = spark.sparkContext.broadcast(cut)
        ends = F.broadcast(spans.select(F.col("key").alias("_k"), F.col("at").alias("_r")))
        rows = lined.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")), "left_semi").select(key, "_range", "_at", ms)
        group, line = [key, "_range"], [key, "_range", "_at"]
        run, ddl = _doors(sent, key, ms, span, kind)
        doors = rows.repartition(*group).sortWithinPartitions(*line).mapInArrow(run, ddl).distinct()
        doors = doors.select(F.col("key").alias(key), F.col("at").alias("_range"), F.lit(-1).cast("long").alias("_at"), F.col("time").alias(ms), F.lit(1).alias("_door"))
        run, ddl = _steps(sent, key, ms, span, kind)
        both = rows.withColumn("_door", F.lit(0)).unionByName(doors)
        edges = written(both.repartition(*group).sortWithinPartitions(*line).mapInArrow(run, ddl), "edges")
        roots = edges.join(F.broadcast(spans.filter("first = 0").select(F.col("key").alias("_k"), F.col("at").alias("_r"))),
            F.col("key").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_r")), "left_semi")
        # nothing leads into a key's first range but its first row
        found = orbit(edges, roots.groupBy("key", "at").agg(F.min("time").alias("time")))
        f = found.select(F.col("key").alias("_k"), F.col("at").alias("_r"), F.col("time").alias("_t"))
        met = edges.join(f, F.col("key").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_r")) & (F.col("time") == F.col("_t"))).select("_k", "_r", "time", "start")
        # a chain enters a range once, so there is a row a key and range again
        state = spans.join(met, F.col("key").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_r")), "left").withColumn("held", F.last("start", True).over(before))
        entered = {(s.key, s.at): (s["first"], s.time, s.held) for s in state.select("key", "at", "first", "time", "held").collect()}
    sent = spark.sparkContext.broadcast(entered)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tb in _groups(batches, [key, "_range"]):
            times = tb.column(ms).to_numpy()
            first, time, held = sent.value.get((tb.column(key)[0].as_py(), tb.column("_range")[0].as_py()), (0, int(times[0]), None))
            i = len(times) if time is None else int(np.searchsorted(times, time))
            begun = [] if held is None else [held]
            at = [] if held is None else [0]
            after = np.searchsorted(times, times + span)
            while i < len(times):
                begun.append(first + i)
                at.append(i)
                i = int(after[i])
            starts = np.array(begun)[np.searchsorted(np.array(at), np.arange(len(times)), side="right") - 1]
            marks = mark(first + np.arange(len(times)), starts)
            yield from tb.drop_columns(["_at", "_range"]).append_column(out, pa.array(marks)).combine_chunks().to_batches()
    ddl = ", ".join(f"`{n}` {t if n != ms else 'bigint'}" for n, t in df.dtypes) + f", `{out}` boolean"
    return lined.repartition(key, "_range").sortWithinPartitions(key, "_range", "_at").mapInArrow(run, ddl)
