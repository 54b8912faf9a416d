"""Pairs of vectors at or above a cosine, within a window of sizes: a threshold join in a metric space.

The angle between vectors is a metric. Rows stand in cells (bucket of sizes, nearest pivot); what a cell holds is summed up by the
span of its sizes and of its angles to some pivots. By the triangle inequality two cells, or a row and a cell, whose spans lie
farther apart than the threshold's angle hold no pair, and are never multiplied. The join is exact: all that is left is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

COSINE, SIZE_RATIO = 0.999, 3.0
#: All rows of a length make so many blocks, so a row is sent to as many at most and what is sent grows with the table, until blocks
#: come to BLOCK_BYTES of vectors, which two of a task must leave room for. Small tables have fewer blocks.
BLOCKS, LEAST_ROWS, BLOCK_BYTES = 12, 512, 16 << 20
#: Rows of both sides of one product.
ROWS_AT_ONCE, PARTNERS_AT_ONCE = 512, 4_096
#: Pivots are chosen from so many rows, a pivot for so many rows of all, and not more than so many.
SAMPLE_ROWS, ROWS_A_PIVOT, MOST_PIVOTS = 4_096, 32, 256
#: Angles to so many pivots sum up a cell. Farther than this angle no pivot helps.
SPANS, WIDEST = 16, math.pi / 4
#: More than rounding takes from an angle.
SLIP = 1e-4


@dataclass(frozen=True)
class Cells:
    """What all cells of one length of vectors hold, and the pivots."""

    pivots: np.ndarray
    place: dict  # (bucket, pivot) to number
    pivot: np.ndarray
    blocks: np.ndarray
    sizes: np.ndarray  # (cell, 2)
    spans: np.ndarray  # (cell, span, 2)
    partners: list[np.ndarray]


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Zero vectors stand at a right angle to everything, so the triangle inequality holds for them too."""
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _units(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1))[:, None]
    return v / np.where(norm > 0, norm, 1.0)


def farthest_first(unit: np.ndarray, n: int) -> np.ndarray:
    """Rows of which each is as far as can be from those before."""
    chosen, far = [0], angles(unit, unit[:1])[:, 0]
    while len(chosen) < min(n, len(unit)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, angles(unit, unit[chosen[-1:]])[:, 0])
    return unit[chosen]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of one length each, and their vectors."""
    for b in batches:
        pdf = b.to_pandas()
        for _, part in pdf.groupby("dim", sort=False):
            yield part, np.stack(part["v"].to_numpy()).astype(np.float64)


def _placed(pivots):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _rows(batches):
            unit = _units(v)
            d = angles(unit, pivots.value[int(part["dim"].iloc[0])])
            near = np.pad(d[:, :SPANS], ((0, 0), (0, max(0, SPANS - d.shape[1]))))
            yield pa.RecordBatch.from_arrays([pa.array(part["name"]), pa.array(part["size"]), pa.array(part["b"], pa.int32()), pa.array(part["dim"], pa.int32()),
                pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(list(near)), pa.array([u.tobytes() for u in unit], pa.binary())],
                ["name", "size", "b", "dim", "pivot", "near", "v"])
    return run


def _windows(low: np.ndarray, high: np.ndarray, sizes: np.ndarray, r: float) -> np.ndarray:
    """Whether sizes in [low, high] and in each of `sizes` (cell, 2) can meet, whichever side opens the window."""
    a, b = sizes[:, 0], sizes[:, 1]
    return ((b >= low / r) & (a < high * r + 1)) | ((high >= a / r) & (low < b * r + 1))


def block_rows(rows: int, dim: int) -> int:
    """Rows of a block, for a table of so many rows of one length."""
    return max(min(LEAST_ROWS, max(1, BLOCK_BYTES // (8 * dim))), min(-(-rows // BLOCKS), BLOCK_BYTES // (8 * dim)))


def _planned(rows: list, pivots: np.ndarray, block: int, theta: float, r: float) -> Cells:
    """Which cells can hold a pair with which."""
    spans = np.array([[(getattr(x, f"l{i}"), getattr(x, f"h{i}")) for i in range(SPANS)] for x in rows])
    sizes, blocks = np.array([(x.small, x.large) for x in rows], float), np.array([-(-x.n // block) for x in rows])
    partners = []
    for i in range(len(rows)):
        gap = np.maximum(spans[i, :, 0] - spans[:, :, 1], spans[:, :, 0] - spans[i, :, 1]).max(axis=1)
        partners.append(np.flatnonzero((gap <= theta) & _windows(sizes[i, 0], sizes[i, 1], sizes, r)))
    return Cells(pivots, {(x.b, x.pivot): i for i, x in enumerate(rows)}, np.array([x.pivot for x in rows]), blocks, sizes, spans, partners)


def _dealt(plans, theta: float, r: float):
    """A row for each pair of blocks in which a vector may have a partner."""
    names = ["dim", "ca", "cb", "i", "j", "part", "name", "size", "v"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            for (dim, b, pivot), part in pdf.groupby(["dim", "b", "pivot"], sort=False):
                plan = plans.value[dim]
                a = plan.place[b, pivot]
                unit = np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), -1)
                d, size = angles(unit, plan.pivots), part["size"].to_numpy()
                near = np.pad(d[:, :SPANS], ((0, 0), (0, max(0, SPANS - d.shape[1]))))
                own = part["tie"].to_numpy().astype(np.uint64) % np.uint64(plan.blocks[a])
                for c in plan.partners[a].tolist():
                    # whoever stands at another pivot is at most twice the angle nearer to it than to his own
                    fits = (d[:, plan.pivot[c]] - d[:, pivot] <= 2 * theta) & (near >= plan.spans[c, :, 0] - theta).all(axis=1) & (near <= plan.spans[c, :, 1] + theta).all(axis=1)
                    fits &= _windows(size, size, plan.sizes[c:c + 1], r)
                    at = np.flatnonzero(fits)
                    if not len(at):
                        continue
                    rows, i, n = part.iloc[at], own[at].astype(np.int64), int(plan.blocks[c])
                    for j in range(n):
                        full = np.full(len(at), j)
                        if c == a:
                            key, side = (a, a, np.minimum(i, full), np.maximum(i, full)), (i > j)
                        else:
                            key, side = ((a, c, i, full), np.zeros(len(at))) if a < c else ((c, a, full, i), np.ones(len(at)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x), pa.int32()) for x in (dim, *key[:2])] + [pa.array(x, pa.int32()) for x in (*key[2:], side.astype(np.int32))]
                            + [pa.array(rows["name"], pa.string()), pa.array(rows["size"], pa.float64()), pa.array(rows["v"], pa.binary())], names)
    return run, "dim int, ca int, cb int, i int, j int, part int, name string, size double, v binary"


def linked(size: np.ndarray, unit: np.ndarray, sizes: np.ndarray, units: np.ndarray, threshold: float, r: float) -> np.ndarray:
    """Whether each row of the first side, which opens the window, and each of the second are a pair."""
    near = cosines(unit, units)
    return (near >= threshold) & (sizes >= size[:, None] / r) & (sizes < size[:, None] * r + 1)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    near = x @ y.T
    near[np.ix_(~x.any(axis=1), ~y.any(axis=1))] = 1.0
    return near


def _products(threshold: float, r: float):
    """Pairs of two blocks, or of a block with itself: products of unit vectors, then the size window. A task holds two blocks and the
    pairs of one product."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        with_itself = key[1] == key[2] and key[3] == key[4]
        x = np.frombuffer(b"".join(rows["v"].to_pylist()), np.float64).reshape(len(rows), -1)
        name, size, part = rows["name"].combine_chunks(), rows["size"].to_numpy(), rows["part"].to_numpy()
        rank = pc.rank(name, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)  # in the order of their bytes
        here = np.flatnonzero(part == 0)
        there = here if with_itself else np.flatnonzero(part == 1)
        for f in range(0, len(here), ROWS_AT_ONCE):
            at = here[f:f + ROWS_AT_ONCE]
            # in a block met with itself whoever stands before has been met
            for g in range(f if with_itself else 0, len(there), PARTNERS_AT_ONCE):
                to = there[g:g + PARTNERS_AT_ONCE]
                near = cosines(x[at], x[to])
                i, j = np.nonzero(near >= threshold)
                score, i, j = near[i, j], at[i], to[j]
                # the smaller name's size opens the window
                first = rank[i] < rank[j]
                a, c = np.where(first, i, j), np.where(first, j, i)
                keep = (rank[i] != rank[j]) & (size[c] >= size[a] / r) & (size[c] < size[a] * r + 1)
                keep &= (i < j) if with_itself else True
                if keep.any():
                    yield pa.RecordBatch.from_arrays([name.take(pa.array(a[keep])), name.take(pa.array(c[keep])), pa.array(score[keep])], ["a", "c", "cosine"])
    return run


def dealt(df: DataFrame, name: str, size: str, vector: str, threshold: float, r: float, block: int | None) -> DataFrame | None:
    """Rows of the blocks that are to be multiplied (None: no rows). Blocks of `block` rows (None: `block_rows`)."""
    spark = df.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bucket = F.floor(F.log(F.greatest(F.col(size), F.lit(1)).cast("double")) / math.log(r)).cast("int")
    base = df.select(F.col(name).cast("string").alias("name"), F.col(size).cast("double").alias("size"), v.alias("v"), bucket.alias("b"), F.size(vector).alias("dim"))
    base = base.filter(F.col("v").isNotNull() & (F.col("dim") > 0) & F.forall("v", lambda x: x.isNotNull()))
    theta = math.acos(min(1.0, max(-1.0, threshold))) + SLIP
    counts = {x.dim: x.n for x in base.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    pivots = {dim: np.eye(1, dim) for dim in counts}  # one for all, where none helps
    if theta <= WIDEST:
        sample: dict[int, list] = {}
        for row in base.orderBy(F.xxhash64("name")).select("dim", "v").limit(SAMPLE_ROWS).collect():
            sample.setdefault(row.dim, []).append(row.v)
        pivots |= {dim: farthest_first(_units(np.array(v)), min(MOST_PIVOTS, max(1, counts[dim] // ROWS_A_PIVOT))) for dim, v in sample.items()}
    placed = written(base.mapInArrow(_placed(spark.sparkContext.broadcast(pivots)), "name string, size double, b int, dim int, pivot int, near array<double>, v binary"), "placed")
    spans = [f(F.get("near", i)).alias(f"{k}{i}") for i in range(SPANS) for f, k in ((F.min, "l"), (F.max, "h"))]
    # some dozen buckets (sizes are 64-bit numbers) times at most MOST_PIVOTS pivots
    cells: dict[int, list] = {}
    for row in placed.groupBy("dim", "b", "pivot").agg(F.count("*").alias("n"), F.min("size").alias("small"), F.max("size").alias("large"), *spans).orderBy("dim", "b", "pivot").collect():
        cells.setdefault(row.dim, []).append(row)
    plans = spark.sparkContext.broadcast({dim: _planned(rows, pivots[dim], block or block_rows(counts[dim], dim), theta, r) for dim, rows in cells.items()})
    run, ddl = _dealt(plans, theta, r)
    return placed.select("name", "size", "b", "dim", "pivot", "v", F.xxhash64("name").alias("tie")).mapInArrow(run, ddl)


def similar_pairs(df: DataFrame, name: str, size: str, vector: str, threshold: float = COSINE, r: float = SIZE_RATIO, block: int | None = None) -> DataFrame:
    """(a, c, cosine): pairs within the size window at or above the threshold, a the smaller name. Two zero vectors have cosine 1, one
    of them 0. Vectors of another length, empty ones or ones that hold nulls are like none. Cells are cut into blocks of about `block` rows
    (None: `block_rows`), so a task multiplies two blocks of bounded size, whatever a cell holds."""
    cells = dealt(df, name, size, vector, threshold, r, block)
    if cells is None:
        return df.sparkSession.createDataFrame([], "a string, c string, cosine double")
    return cells.groupBy("dim", "ca", "cb", "i", "j").applyInArrow(_products(threshold, r), "a string, c string, cosine double")
