"""Packing documents into token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, small, small_batches, spill, table

CAPACITY = 2_048
END_ID = 0
#: Remainders that one island packs; there are as many cells as the documents need.
CELL_ITEMS = 4_000
#: Islands that evolve the same cell apart before their elites meet.
ISLANDS = 3
POPULATION = 6
GENERATIONS = 16
#: Bins filled less than this share are opened again, together with those of other cells.
WELL_FILLED = 0.97

#: The pattern of the vocabulary, and the same without its look-ahead, for texts where no two white-space characters
#: meet: an automaton matches it without backtracking. The third takes a run of white space as one piece.
_FULL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_WHOLE = r"(?s:.+)"
# Fixed value: what the pattern means by white space.
_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TWO_SPACES = re.compile(f"[{_WHITE}]{{2}}")
#: Longer runs of white space are cut out before the pattern, whose look-ahead goes back over all of a run, is matched.
_LONG_RUN = re.compile(f"[{_WHITE}]{{64,}}")
#: Fixed value: the vocabulary's special token, read as one id wherever a text holds it.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50_256
_encoders: dict[str, tuple] = {}


def encoders(path: str) -> tuple:
    """Three encoders for each worker process: for texts, for texts without adjoining white space, for runs of white space."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tuple(tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}) for n,
            p in (("full", _FULL), ("plain", _PLAIN), ("whole", _WHOLE)))
    return _encoders[path]


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a text and the end id. A text's special tokens are read first and part it. A run of white space is one
    piece without its last character, which goes with what follows; at an end it is one piece."""
    full, plain, whole = encoders(path)
    ids: list[int] = []
    for i, part in enumerate((text or "").split(SPECIAL)):
        if i:
            ids.append(SPECIAL_ID)
        if not _TWO_SPACES.search(part):
            ids += plain.encode_ordinary(part)
            continue
        at = 0
        for run in _LONG_RUN.finditer(part):
            stop = run.end() - (run.end() < len(part))
            ids += full.encode_ordinary(part[at:run.start()]) + whole.encode_ordinary(part[run.start():stop])
            at = stop
        ids += full.encode_ordinary(part[at:])
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


def _tokenised(path: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = token_ids(text, path)
                ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                for piece, end in enumerate(ends):
                    start = max(0, end - capacity) if piece else 0
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c,
                t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; only those above the capacity are cut."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _tokenised(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """A solution: bins as lists of items, and what each bin holds."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.lengths, self.capacity, self.bins = lengths, capacity, bins or []
        self.fills = [sum(map(lengths.__getitem__, b)) for b in self.bins]

    def best_fit(self, items: list[int]) -> Packing:
        """Puts each item where the least room is left. Rooms are bits of one number, so the search is a shift."""
        rooms: dict[int, list[int]] = {}
        mask = 0
        for b, f in enumerate(self.fills):
            if f < self.capacity:
                rooms.setdefault(self.capacity - f, []).append(b)
                mask |= 1 << (self.capacity - f)
        for i in items:
            n = self.lengths[i]
            fitting = mask >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    mask ^= 1 << room
                self.bins[b].append(i)
                self.fills[b] += n
            else:
                b, room = len(self.bins), self.capacity
                self.bins.append([i])
                self.fills.append(n)
            if room > n:
                rooms.setdefault(room - n, []).append(b)
                mask |= 1 << (room - n)
        return self

    @property
    def fitness(self) -> tuple[int, int]:
        """Fewer bins, then fuller ones."""
        return -len(self.bins), sum(f * f for f in self.fills)


def crossover(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """Injects whole well-filled bins of b into a, takes a's bins apart that share items with them or are the
    worst filled, and best-fits what is displaced."""
    good = [k for k, f in enumerate(b.fills) if f >= WELL_FILLED * b.capacity]
    chosen = [b.bins[k] for k in good if rng.random() < 0.4]
    taken = {i for x in chosen for i in x}
    worst = set(sorted(range(len(a.fills)), key=a.fills.__getitem__)[: 1 + int(rng.integers(0, 5))])
    kept, displaced = [list(x) for x in chosen], []
    for k, x in enumerate(a.bins):
        if k in worst or not taken.isdisjoint(x):
            displaced += [i for i in x if i not in taken]
        else:
            kept.append(list(x))
    displaced.sort(key=a.lengths.__getitem__, reverse=True)
    return Packing(a.lengths, a.capacity, kept).best_fit(displaced)


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = (), generations: int = GENERATIONS) -> Packing:
    """Best solution of one island. Ends at once where the sum of the lengths admits no better one."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [Packing(lengths, capacity, [list(b) for b in e]) for e in elites] or [Packing(lengths, capacity).best_fit(order)]
    if max(p.fitness for p in people)[0] < -least:
        while len(people) < POPULATION:
            noise = rng.normal(1, 0.08, len(lengths))
            people.append(Packing(lengths, capacity).best_fit(sorted(order, key=lambda i, z=noise: -lengths[i] * z[i])))
        for _ in range(generations):
            people.sort(key=lambda p: p.fitness, reverse=True)
            if -people[0].fitness[0] <= least:
                break
            i, j = sorted(rng.choice(len(people), 2, replace=False))
            people[-1] = max(people[-1], crossover(people[i], people[j], rng), crossover(people[j], people[i], rng), key=lambda p: p.fitness)
    return max(people, key=lambda p: p.fitness)


def _seed(*x: int) -> int:
    return zlib.crc32(repr(tuple(map(int, x))).encode())


def _elites(pdf: pd.DataFrame) -> tuple[np.ndarray, list[int], list[list[list[int]]]]:
    """The items of a cell in the order of their uids, their lengths, and a solution for each origin that has one."""
    elites, uids, lengths = [], np.zeros(0, np.int64), []
    for origin, one in pdf.sort_values(["origin", "uid"]).groupby("origin"):
        uids, lengths = one["uid"].to_numpy(), one["length"].tolist()
        if origin >= 0:
            elites.append(_bins(one["bin"].to_numpy()))
    return uids, lengths, elites


def _bins(of: np.ndarray) -> list[list[int]]:
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)]


def _island(capacity: int, epoch: int):
    """One island of a cell: its elite, as a bin for each item, and how many bins it is above the least that could be."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        uids, lengths, elites = _elites(pdf)
        best = evolve(lengths, capacity, _seed(*key, epoch), elites)
        at = np.empty(len(uids), np.int64)
        for k, b in enumerate(best.bins):
            at[b] = k
        return pd.DataFrame({"uid": uids, "length": lengths, "cell": key[0], "island": key[1], "bin": at,
            "above": len(best.bins) - -(-sum(lengths) // capacity)})
    return run


def _meeting(capacity: int, level: int):
    """The elites of a cell's islands migrate to one, which evolves them further; a row for each item."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        uids, lengths, elites = _elites(pdf)
        best = evolve(lengths, capacity, _seed(*key, -1), elites)
        rows = []
        for k, b in enumerate(best.bins):
            at = 0
            for i in b:
                rows.append((uids[i], lengths[i], (level << 60) | (int(key[0]) << 24) | k, at, best.fills[k]))
                at += lengths[i]
        return pd.DataFrame(rows, columns=["uid", "length", "sequence_id", "offset", "fill"])
    return run


_EVOLVED = "uid long, length long, cell long, island int, bin long, above long"
_PLACED = "uid long, length long, sequence_id long, offset long, fill long"


def islands(items: DataFrame, capacity: int) -> DataFrame:
    """(uid, length, cell) to (uid, length, sequence_id, offset, fill). ISLANDS evolve each cell apart; where none came to
    the least number of bins that could be, the elite of each migrates to the next in the ring and is crossed there; then
    all elites of a cell meet."""
    none = F.lit(-1).cast("long")
    dealt = items.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS))))).withColumns({"bin": none, "origin": F.lit(-1)})
    first = spill(dealt.groupBy("cell", "island").applyInPandas(_island(capacity, 0), _EVOLVED), "pack-islands")
    poor = small(spill(first.groupBy("cell").agg(F.min("above").alias("_above")).filter("_above > 0").select("cell"), "pack-cells"))
    moved = first.join(poor, "cell", "left_semi").withColumn("origin", F.col("island"))
    moved = moved.withColumn("island", F.explode(F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)))
    second = moved.groupBy("cell", "island").applyInPandas(_island(capacity, 1), _EVOLVED)
    met = first.join(poor, "cell", "left_anti").unionByName(second).withColumn("origin", F.col("island"))
    return met.groupBy("cell").applyInPandas(_meeting(capacity, 1), _PLACED)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the end id; null and empty texts are the end id alone. The special
    token in a text becomes its id, as the vocabulary's tokenizer has it. Whole pieces are
    sequences by themselves. The rest, at most one piece a document, is dealt by hash to cells of a bounded
    size. Islands evolve each cell apart; their elites migrate and are crossed; what then stands in bins that
    are not well filled is packed again together with that of other cells, beginning from the bins it had.
    Repeated rows and null ids are documents like others, and texts of any length and kind are read whole. Pieces are
    numbered by what they hold, so reruns agree on any split of the table. Columns other than doc_id and text are left
    out, so none can clash. An empty table gives an empty result.
    """
    own = numbered(spill(pieces(docs, path, capacity), "pack-pieces"), [], ["doc_id", "piece", "start", "length", "ids_crc32"], "uid")
    rest = own.filter(F.col("length") < capacity).select("uid", "length")
    cells = max(1, -(-rest.count() // CELL_ITEMS))
    placed = spill(islands(rest.withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(cells))), capacity), "pack-placed")
    poor = placed.filter(F.col("fill") < WELL_FILLED * capacity)
    again = max(1, -(-poor.count() // CELL_ITEMS))
    reopened = poor.select("uid", "length", F.pmod(F.xxhash64("sequence_id"), F.lit(again)).alias("cell"), F.lit(0).alias("origin"),
        F.col("sequence_id").alias("bin"))
    repacked = reopened.groupBy("cell").applyInPandas(_reopening(capacity), _PLACED)
    whole = own.filter(F.col("length") == capacity).select("uid", F.col("uid").bitwiseOR(F.lit(4 << 60)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    at = whole.union(placed.filter(F.col("fill") >= WELL_FILLED * capacity).select("uid", "sequence_id",
        "offset")).union(repacked.select("uid", "sequence_id", "offset"))
    return own.join(at, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _reopening(capacity: int):
    """Packs poorly filled bins anew; the bins as they were and a packing from nothing are the first elites."""
    meeting, fresh = _meeting(capacity, 2), _island(capacity, 2)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        other = fresh((*key, 1), pdf.assign(origin=-1, bin=-1)).assign(origin=1)
        return meeting(key, pd.concat([pdf[["uid", "length", "origin", "bin"]], other[["uid", "length", "origin", "bin"]]]))
    return run


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
