"""Approximate nearest neighbours by shifted space-filling curves.

Each curve rotates the vectors to a few dimensions, shifts them and orders them by their Hilbert keys. The curves
are cut into ranges of rows; a query looks through its own range and its neighbours on every curve, and the finds are merged
and ranked by the exact distance of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gathered, small, spill, table

K = 10
QUERY_EVERY = 100
CURVES = 64
DIMENSIONS, BITS = 16, 3
#: A query's window on each curve is 2 * REACH + 1 ranges, together WINDOW * rows ** GROWTH rows. On random directions, where
#: nothing is alike and no curve is selective, this finds nine of ten at every size; where vectors are alike far fewer would do.
WINDOW, GROWTH, REACH = 0.052, 0.83, 3
LEAST_WINDOW = 24
#: Vectors, chosen by hash, on which the curves' quantiles and ranges are fitted (fewer where they are long, but 1,024). Every
#: vector is indexed.
FIT_ROWS, FIT_VALUES = 65_536, 1 << 22
#: Of these, so many give each query a bound: what is farther than their k-th is no neighbour.
BOUND_ROWS = 128
#: Candidates of each query and range, and of each query in all, that are left over k for the exact ranking.
SPARE = 6
#: 2 ** CHUNK_BITS neighbouring ranges are searched by one task; it holds so many candidates before it merges or sends them.
CHUNK_BITS, HELD = 7, 500_000
SEED = 20


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows, dimensions), by Gray-code rotations from the top bit down."""
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    x[1:] = np.bitwise_xor.accumulate(x, axis=0)[1:]
    flip = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> b & 1)
    return key


@dataclass(frozen=True)
class Curve:
    turn: np.ndarray  # (dimension of the vectors, DIMENSIONS)
    cuts: np.ndarray  # quantiles of each projection
    shift: np.ndarray
    salt: int

    def keys(self, x: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Hilbert key, then bits of a hash of the row, so that any number of rows of one key is cut into ranges too."""
        y = x @ self.turn
        place = np.stack([np.searchsorted(c, y[:, i]) for i, c in enumerate(self.cuts)], axis=1) / (self.cuts.shape[1] + 1)
        cells = ((place + self.shift) / 1.5 * (1 << BITS)).astype(np.int64)
        mixed = tie.view(np.uint64) * np.uint64(2 * self.salt + 1)
        return hilbert(cells, BITS) << 15 | (mixed >> np.uint64(49)).astype(np.int64)


@dataclass(frozen=True)
class Index:
    """What is fitted on the sample: curves, the first keys of their ranges, the centre and scale of packed vectors."""

    curves: list[Curve]
    starts: list[np.ndarray]
    centre: np.ndarray
    scale: float
    bound: np.ndarray  # packed vectors of the sample that give queries their bound

    def packed(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) * self.scale, -6e4, 6e4).astype("<f2")


def window(n: int) -> int:
    """Rows of a query's window on each curve, among n."""
    return max(LEAST_WINDOW, round(WINDOW * n ** GROWTH))


def fit(sample: np.ndarray, tie: np.ndarray, n: int) -> Index:
    """sample: vectors of at most FIT_ROWS of n rows; tie: hashes of the rows."""
    rng, cs, starts = np.random.default_rng(SEED), [], []
    centre = sample.mean(axis=0)
    spread = float(np.sqrt(((sample - centre) ** 2).sum(axis=1).mean()))
    ranges = max(1, round((2 * REACH + 1) * n / window(n)))
    for c in range(CURVES):
        turn = np.linalg.qr(rng.normal(size=(sample.shape[1],) * 2))[0][:, :DIMENSIONS]
        y = sample @ turn
        cuts = np.quantile(y, np.linspace(0, 1, 129)[1:-1], axis=0).T
        curve = Curve(turn, cuts, rng.random(turn.shape[1]) * 0.5, c)
        keys = np.sort(curve.keys(sample, tie))
        cs.append(curve)
        starts.append(np.unique(keys[np.arange(1, ranges) * len(keys) // ranges]))
    one = Index(cs, starts, centre, 1 / spread if spread > 0 else 1.0, np.zeros(0))
    return Index(cs, starts, centre, one.scale, one.packed(sample[:BOUND_ROWS]).astype(np.float32))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * q @ x.T


def _dealt(index: Index, k: int):
    """A row for each place (curve and range) that a vector stands in (role 0) or looks through (role 1)."""
    names = ["place", "role", "rep", "bound", "v"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tb in gathered(batches, 4_096):
            x, tie = _vectors(tb.column("v")), tb.column("tie").to_numpy()
            half = index.packed(x)
            rep, asks = tb.column("rep").to_numpy(), tb.column("asks").to_numpy()
            bound = np.full(len(x), np.inf, np.float32)
            ask = np.flatnonzero(asks)
            if len(ask) and len(index.bound) > k:
                # one more than k, as a query may itself be in the sample; and some room for rounding
                near = _squares(half[ask].astype(np.float32), index.bound)
                bound[ask] = np.partition(near, k, axis=1)[:, k] * 1.01 + 1e-3
            v = pa.array([r.tobytes() for r in half], pa.binary())
            for c, curve in enumerate(index.curves):
                own = np.searchsorted(index.starts[c], curve.keys(x, tie), side="right").astype(np.int32)
                n = len(index.starts[c]) + 1
                at, where, role = [np.arange(len(x))], [own], [np.zeros(len(x), np.int8)]
                low = np.clip(own - REACH, 0, max(0, n - 2 * REACH - 1))  # at an end of the curve the window is moved, not cut
                for d in range(min(2 * REACH + 1, n)):
                    at.append(ask)
                    where.append((low[ask] + d).astype(np.int32))
                    role.append(np.ones(len(ask), np.int8))
                i = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(where) + (np.int64(c) << 40)), pa.array(np.concatenate(role)),
                                                  pa.array(rep[i]), pa.array(bound[i]), v.take(pa.array(i))], names)
    return run


def _near(x: np.ndarray, reps: np.ndarray, q: np.ndarray, own: np.ndarray, bound: np.ndarray, take: int) -> list[np.ndarray]:
    """For each query at most `take` rows of a range within its bound, nearest first kept: (query, row, distance squared)."""
    d = _squares(q, x)
    d[own[:, None] == reps[None]] = np.inf
    if take < len(x):
        nearest = np.argpartition(d, take - 1, axis=1)[:, :take]
        d = np.take_along_axis(d, nearest, 1)
    else:
        nearest = np.broadcast_to(np.arange(len(x)), d.shape)
    rows, cols = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
    return [own[rows], reps[nearest[rows, cols]], d[rows, cols]]


def _nearest(found: list[list[np.ndarray]], take: int) -> list[np.ndarray]:
    """Of each query the `take` nearest rows, each once."""
    q, rep, d = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((d, rep, q))
    q, rep, d = q[order], rep[order], d[order]
    once = np.concatenate(([True], (q[1:] != q[:-1]) | (rep[1:] != rep[:-1]))) if len(q) else np.zeros(0, bool)
    q, rep, d = q[once], rep[once], d[once]
    order = np.lexsort((rep, d, q))
    q, rep, d = q[order], rep[order], d[order]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(q)])))) < take
    return [q[keep], rep[keep], d[keep]]


def _found(take: int):
    """Rows sorted by (place, role): the nearest candidates of each query. A range is held, queries pass by; what they find in
    the ranges of their windows, which stand one behind the other, is merged before it is sent on."""
    names = ["q", "rep", "near"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, reps = -1, np.zeros((0, 0), np.float32), np.zeros(0, np.int64)
        out: list[list[np.ndarray]] = []
        held = 0
        for tb in gathered(batches, 16_384):
            at, role, rep, bound = (tb.column(c).to_numpy() for c in ("place", "role", "rep", "bound"))
            v = np.frombuffer(b"".join(tb.column("v").to_pylist()), "<f2").reshape(len(rep), -1).astype(np.float32)
            cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rep)], strict=True):
                if at[s] != now:
                    now, x, reps = at[s], v[:0], rep[:0]
                m = s + int(np.searchsorted(role[s:e], 1))
                if m > s:
                    x, reps = (v[s:m], rep[s:m]) if not len(x) else (np.concatenate((x, v[s:m])), np.concatenate((reps, rep[s:m])))
                step = max(1, 4_000_000 // max(1, len(x)))
                for f in range(m, e if len(x) else m, step):
                    out.append(_near(x, reps, v[f:min(e, f + step)], rep[f:min(e, f + step)], bound[f:min(e, f + step)], take))
                    held += len(out[-1][0])
                    if held > HELD:
                        out = [_nearest(out, take)]
                        held = len(out[0][0])
                        if held > HELD // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(o) for o in out[0]], names)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(o) for o in _nearest(out, take)], names)
    return run


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose vec_id `every` divides.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id or
    of another dimension than most (of equally frequent ones the smaller). Equal vectors are indexed once, with the
    smallest k + 1 ids that any query can need, so copies cost nothing and ties go to the smaller id exactly. Repeated rows
    count once. Fewer candidates than k: all of them that windows hold, which for few rows are all. Other columns are left
    out, so none can clash. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    valid = F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("_v")).filter("vec_id is not null").filter(valid)
    # two hashes stand for a vector where rows are joined
    own = own.withColumn("d", F.size("_v")).withColumn("h", F.xxhash64("_v")).withColumn("h2", F.xxhash64(F.lit(1), "_v"))
    sizes = own.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim = sizes[0].d
    own = spill(own.filter(F.col("d") == dim).select("vec_id", "h", "h2", "_v").distinct(), "ann-vectors")
    # the smallest ids of equal vectors: Spark limits each group before the shuffle
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy("h", "h2", "_v").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    groups = first.groupBy("h", "h2", "_v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = own.filter(F.col("vec_id") % every == 0).select("vec_id", "h", "h2")
    asked = asking.select("h", "h2").distinct().withColumn("asks", F.lit(1))
    index = groups.join(asked, ["h", "h2"], "left").select(F.get("ids", 0).alias("rep"), "ids", F.coalesce("asks", F.lit(0)).alias("asks"),
        F.xxhash64(F.get("ids", 0)).alias("tie"), "_v", "h", "h2")
    index = spill(index.mapInArrow(_pack, "rep long, ids array<long>, asks int, tie long, v binary, h long, h2 long"), "ann-index")
    n = index.count()
    sample = index.orderBy("tie").limit(max(1_024, min(FIT_ROWS, FIT_VALUES // dim))).select("v", "tie").collect()
    fitted = fit(np.frombuffer(b"".join(bytes(r.v) for r in sample), "<f8").reshape(len(sample), -1), np.array([r.tie for r in sample], np.int64), n)
    dealt = index.select("rep", "v", "tie", "asks").mapInArrow(_dealt(fitted, k), "place long, role byte, rep long, bound float, v binary")
    # ranges side by side go to one task, as many as make up some windows
    dealt = dealt.repartition(F.shiftright("place", CHUNK_BITS)).sortWithinPartitions("place", "role")
    found = dealt.mapInArrow(_found(k + SPARE), "q long, rep long, near float").groupBy("q", "rep").agg(F.min("near").alias("near"))
    likely = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("near",
        "rep"))).filter(F.col("_r") <= k + SPARE).select("q", "rep")
    # the exact distance of the original vectors
    asks = index.filter("asks = 1").select(F.col("rep").alias("q"), F.col("v").alias("qv"))
    exact = likely.join(asks, "q").join(index.select("rep", "v"), "rep").select("q", "rep", "qv", "v").mapInArrow(_measured,
        "q long, rep long, score double")
    # equal vectors of the query stand at distance 0
    same = index.filter("asks = 1").select(F.col("rep").alias("q"), "rep", F.lit(0.0).alias("score"))
    named = exact.union(same).join(index.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    best = named.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("_r") <= k + 1)
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    ask = asking.withColumnRenamed("vec_id", "query_id").join(index.filter("asks = 1").select("h", "h2", F.col("rep").alias("q")), ["h", "h2"])
    listed = ask.join(small(spill(lists, "ann-lists")), "q").select("query_id",
        F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
    return listed.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
        F.col("x.score").alias("score"))


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tb in gathered(batches, 4_096):
        d = np.sqrt(((_vectors(tb.column("qv")) - _vectors(tb.column("v"))) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([tb.column("q").combine_chunks(), tb.column("rep").combine_chunks(), pa.array(d)], ["q", "rep", "score"])


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = np.array(b.column("_v").to_pylist(), "<f8")
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("ids"), b.column("asks"), b.column("tie"),
                pa.array([r.tobytes() for r in x], pa.binary()),
                                              b.column("h"), b.column("h2")], ["rep", "ids", "asks", "tie", "v", "h", "h2"])


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
