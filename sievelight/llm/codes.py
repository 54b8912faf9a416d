"""Product codes of vectors, with codebooks moved by Lloyd rounds over heaps of slack.

Each block of vectors keeps, for each part position and codebook entry, a heap of the parts assigned to it, keyed by slack: the lower
bound of the distance to any other entry minus the upper bound of that to their own. When entries move, only the
parts whose slack their summed drift has used up are popped and looked through exactly; the others can't have changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, matched, spill, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of one block, whose heaps stand together; a place among them takes two bytes.
BLOCK_ROWS = 16_384
#: Components (after scaling) are below this, so that no sum of squares of a part passes 64 bits.
LIMIT = 1 << 28
#: What rounding may take from a bound, relative and absolute.
SLIP = 1e-5
STATE = "ids binary, labels array<{label}>, v binary, width int, order binary, starts binary, keys binary, sums binary, popped long"


@dataclass(frozen=True)
class Books:
    """Entries (part, entry, position) and the summed drift of each since the start."""

    entries: np.ndarray
    drift: np.ndarray

    def moved(self, to: np.ndarray) -> Books:
        """An entry's own move takes slack from its parts, and so does the longest of the others'."""
        step = np.sqrt(((to - self.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + SLIP)
        longest = np.sort(step, axis=1)[:, ::-1]
        others = np.where(np.arange(step.shape[1]) == step.argmax(axis=1)[:, None], longest[:, 1:2] if step.shape[1] > 1 else 0.0, longest[:, :1])
        return Books(to, self.drift + step + others)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (row, entry), exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # doubles hold every number on the way
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None].astype(np.int64) - entries[None, :, i]) ** 2
    return out


def looked_through(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the nearest entry, ties to the lower one, and its slack."""
    nearest, slack = np.zeros(len(x), np.int64), np.zeros(len(x))
    for f in range(0, len(x), 4_096):
        d = squares(x[f:f + 4_096], entries)
        own = d.argmin(axis=1)
        rows = np.arange(len(d))
        upper = np.sqrt(d[rows, own].astype(np.float64))
        rest = d.astype(np.float64)
        rest[rows, own] = np.inf
        nearest[f:f + 4_096] = own
        lower = np.sqrt(rest.min(axis=1))
        slack[f:f + 4_096] = lower * (1 - SLIP) - upper * (1 + SLIP)
    return nearest, slack


@dataclass
class Heaps:
    """A part position's heaps in one block. Entry e has the places order[starts[e]:starts[e + 1]], least key first: an array in
    the order of its keys is a heap, and what is popped from it is its beginning. A key is the slack at the time when
    the place was put in, plus the entry's drift until then."""

    order: np.ndarray
    starts: np.ndarray
    keys: np.ndarray

    @staticmethod
    def filled(own: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((keys, own))
        return Heaps(order, np.searchsorted(own[order], np.arange(entries + 1)), keys[order])

    def assigned(self) -> np.ndarray:
        own = np.empty(len(self.order), np.int64)
        own[self.order] = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return own

    def popped(self, drift: np.ndarray) -> np.ndarray:
        """Places whose key the drift of their entry has reached, as positions in `order`."""
        found = []
        for e, (s, t) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            n = int(np.searchsorted(self.keys[s:t], drift[e] * (1 + SLIP) + SLIP, side="right"))
            found.append(np.arange(s, s + n))
        return np.concatenate(found)

    def moved(self, x: np.ndarray, books: np.ndarray, drift: np.ndarray) -> tuple[Heaps, int]:
        """Pops what may have changed, looks it through and puts it in again."""
        out = self.popped(drift)
        if not len(out):
            return self, 0
        own, keys = self.assigned(), np.empty(len(self.order))
        keys[self.order] = self.keys
        at = self.order[out]
        nearest, slack = looked_through(x[at], books)
        own[at], keys[at] = nearest, _low(slack + drift[nearest])
        return Heaps.filled(own, keys, len(books)), len(at)


def _low(keys: np.ndarray) -> np.ndarray:
    """Keys as they are stored, in 32 bits, rounded down."""
    return np.nextafter(keys.astype(np.float32), np.float32(-np.inf)).astype(np.float64)


def _sums(v: np.ndarray, own: list[np.ndarray], entries: int) -> bytes:
    """Of each part and entry the number of parts, then their sums by position."""
    width = v.shape[1] // len(own)
    counts = [np.bincount(o, minlength=entries) for o in own]
    totals = [np.bincount(o, v[:, p * width + i], minlength=entries) for p, o in enumerate(own) for i in range(width)]
    return np.concatenate([*counts, *totals]).astype("<i8").tobytes()


def _narrow(v: np.ndarray) -> tuple[bytes, int]:
    """Integers in two bytes where they all fit, else in four."""
    width = 2 if np.abs(v).max(initial=0) < 1 << 15 else 4
    return v.astype(f"<i{width}").tobytes(), width


def _first(books, parts: int):
    """Rows to blocks: scaled, cut and assigned for the first time."""
    names = ["ids", "labels", "v", "width", "order", "starts", "keys", "sums", "popped"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = books.value
        for tb in gathered(batches, BLOCK_ROWS):
            for f in range(0, tb.num_rows, BLOCK_ROWS):
                part = tb.slice(f, BLOCK_ROWS).combine_chunks()
                v = np.array(part.column("v").to_pylist(), np.int64)
                heaps = []
                for p in range(parts):
                    own, slack = looked_through(np.ascontiguousarray(_part(v, p, parts)), b.entries[p])
                    heaps.append(Heaps.filled(own, _low(slack + b.drift[p][own]), b.entries.shape[1]))
                yield _block(names, part.column("vec_id"), part.column("label"), v, heaps, part.num_rows * parts)
    return run


def _part(v: np.ndarray, p: int, parts: int) -> np.ndarray:
    width = v.shape[1] // parts
    return v[:, p * width:(p + 1) * width]


def _block(names: list[str], ids, labels, v: np.ndarray, heaps: list[Heaps], popped: int) -> pa.RecordBatch:
    packed, width = _narrow(v)
    one = lambda x: pa.array([x])
    id_bytes = np.array([(i is None, i or 0) for i in ids.to_pylist()], "<i8").tobytes() if not isinstance(ids, bytes) else ids
    label_list = labels if isinstance(labels, pa.ListArray) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), _flat(labels))
    sums = _sums(v, [h.assigned() for h in heaps], len(heaps[0].starts) - 1)
    return pa.RecordBatch.from_arrays([one(id_bytes), label_list, one(packed), pa.array([width], pa.int32()),
        one(np.stack([h.order for h in heaps]).astype("<u2").tobytes()), one(np.stack([h.starts for h in heaps]).astype("<u2").tobytes()),
        one(np.stack([h.keys for h in heaps]).astype("<f4").tobytes()), one(sums), pa.array([popped], pa.int64())], names)


def _flat(a) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _opened(row: dict, books: Books) -> tuple[np.ndarray, list[Heaps]]:
    parts, entries, width = books.entries.shape
    v = np.frombuffer(row["v"], f"<i{row['width']}").astype(np.int64).reshape(-1, parts * width)
    order = np.frombuffer(row["order"], "<u2").reshape(parts, -1).astype(np.int64)
    starts = np.frombuffer(row["starts"], "<u2").reshape(parts, entries + 1).astype(np.int64)
    keys = np.frombuffer(row["keys"], "<f4").reshape(parts, -1).astype(np.float64)
    return v, [Heaps(o, s, k) for o, s, k in zip(order, starts, keys, strict=True)]


def _again(books, names: list[str]):
    """Blocks to blocks, after the entries have moved."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in ("ids", "v", "width", "order", "starts", "keys")}
                v, heaps, popped = *_opened(row, books.value), 0
                for p, h in enumerate(heaps):
                    heaps[p], n = h.moved(_part(v, p, len(heaps)), books.value.entries[p], books.value.drift[p])
                    popped += n
                yield _block(names, row["ids"], b.column("labels").slice(i, 1), v, heaps, popped)
    return run


def _coded(books, key_name: str, label_name: str):
    """Blocks to rows, after the last move: codes and exact errors."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = books.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("ids", "v", "width", "order", "starts", "keys")}
                v, heaps = _opened(row, b)
                codes, error = np.zeros((len(v), len(heaps)), np.uint8), np.zeros(len(v), np.int64)
                for p, h in enumerate(heaps):
                    x = _part(v, p, len(heaps))
                    own = h.moved(x, b.entries[p], b.drift[p])[0].assigned()
                    codes[:, p] = own
                    error += ((x - b.entries[p][own]) ** 2).sum(axis=1)
                ids = np.frombuffer(row["ids"], "<i8").reshape(-1, 2)
                hexed = codes.tobytes().hex()
                n = 2 * len(heaps)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 1], mask=ids[:, 0] == 1), pa.array([hexed[k:k + n] for k in range(0, len(hexed), n)]),
                    pa.array(error), batch.column("labels").slice(i, 1).flatten()], [key_name, "code", "error", label_name])
    return run


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a task's block sums added up, by slot."""
    total = None
    for b in batches:
        for s in b.column(0).to_pylist():
            one = np.frombuffer(s, "<i8").astype(object) if total is None else np.frombuffer(s, "<i8")
            total = one if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total])], ["slot", "total"])


def integers(vector: Column) -> Column:
    """floor(256 x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def _books(kept: DataFrame, parts: int, entries: int) -> Books | None:
    """The first codebooks: of the smallest ids, ascending; where rows share an id, the least vector."""
    ids = kept.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    first = kept.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    if not first:
        return None
    v = np.array([r.v for r in first], np.int64)
    return Books(np.ascontiguousarray(v.reshape(len(v), parts, -1).transpose(1, 0, 2)), np.zeros((parts, len(v))))


def _next(books: Books, blocks: DataFrame) -> Books:
    """Entries at the floors of their parts' means. A row a codebook number comes to the driver, however many vectors there are."""
    parts, entries, width = books.entries.shape
    totals = blocks.select("sums").mapInArrow(_totals, "slot int, total string")
    rows = totals.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by = {r.slot: int(r.total) for r in rows}
    to = books.entries.copy()
    for p in range(parts):
        for e in range(entries):
            if n := by[p * entries + e]:
                to[p, e] = [by[parts * entries + (p * width + i) * entries + e] // n for i in range(width)]
    return books.moved(to)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """(vec_id, code, error, label) of each vector, and the codebooks after so many rounds (None: there is no vector with an id).

    Vectors that are null or hold null or non-finite components are left out, and so are those whose number of components is not that of
    most (of equally frequent ones the smaller) among those that can be cut into equal parts. Rows without an id are coded too, but begin no
    entry. Repeated rows each count; an id begins one entry, from its least vector. Ties go to the lower entry. Fewer ids than entries: as many entries
    as ids. Components of 2^20 or more in size are refused. Other columns are left out, so none can clash. An empty table gives
    an empty one. At most 256 entries, as a code has two hex digits a part.
    """
    if entries > 256:
        raise ValueError("a code's byte holds at most 256 entries")
    spark = vectors.sparkSession
    label = dict(vectors.dtypes)["label"]
    e = F.col("embedding")
    valid = e.isNotNull() & (F.size(e) > 0) & (F.size(e) % parts == 0) & F.forall(e,
        lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter(valid)
    sizes = kept.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    nothing = spark.createDataFrame([], f"vec_id long, code string, error long, label {label}")
    if not sizes:
        return nothing, None
    kept = kept.filter(F.size("embedding") == sizes[0].d)
    fits = F.forall("v", lambda x: F.abs(x) < LIMIT)
    kept = kept.select("vec_id", "label", integers(F.col("embedding")).alias("v"))
    kept = kept.withColumn("v", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large to be coded exactly"))))
    books = _books(kept, parts, entries)
    if books is None:
        return nothing, None
    schema = STATE.format(label=label)
    names = [s.split()[0] for s in schema.split(", ")]
    send = spark.sparkContext.broadcast  # some 100 KB, of a size that the parameters give
    blocks = spill(kept.mapInArrow(_first(send(books), parts), schema), "codes-blocks")
    for r in range(rounds):
        books = _next(books, blocks)
        if r < rounds - 1:
            blocks = spill(blocks.mapInArrow(_again(send(books), names), schema), "codes-blocks")
    coded = blocks.mapInArrow(_coded(send(books), "vec_id", "label"), f"vec_id long, code string, error long, label {label}")
    return spill(coded, "codes"), books


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    by_label = spill(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    return matched(coded, by_label, ["label"]).select("vec_id", "code", "error", "label_error",
        F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _assigned(n: int) -> str:
    return f"""
a{n} AS (SELECT row, p, any_value(v) AS v, min_by(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.row, x.p, x.v, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts x JOIN c{n} c ON c.p = x.p) GROUP BY row, p)"""


def _moved(n: int) -> str:
    return f"""
m{n} AS (SELECT p, e, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
    SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY p, e, i)),
c{n + 1} AS (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT p, e, list(x ORDER BY i) AS v FROM m{n} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)"""


OP12_SQL = f"""
WITH kept AS (SELECT row_number() OVER () AS row, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT row, vec_id, p, list_transform(embedding[p * len(embedding) // {PARTS} + 1:(p + 1) * len(embedding) // {PARTS}],
    lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM kept, range({PARTS}) t(p)),
c0 AS (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, v FROM parts
    WHERE vec_id IN (SELECT DISTINCT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{_assigned(0)},
{_moved(0)},
{_assigned(1)},
{_moved(1)},
{_assigned(2)},
coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY row),
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (
    SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c2))
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, b.codebooks_sha256
FROM kept k JOIN coded c ON c.row = k.row, books b
"""
