"""Near copies for the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints cannot find these: at a similarity of 0.8 some 10 of 64 bits differ, and no partition of the bits
that a probe can afford finds pairs so far apart. Beside what fingerprints link, candidates therefore share all five MinHash values of one of 26 bands. At
a similarity of exactly 0.8 a pair is missed with probability (1 - 0.8^5)^26 = 0.00003, above it less often; the hashes
are fixed, so reruns agree. What may be alike is brought together by components of the candidates, and every link is
verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, small_batches, spill
from .components import components

SHINGLE_WORDS = 5
SEED = 43
#: The least similarity of a link, as a fraction.
ALIKE = (4, 5)
BANDS, BAND_ROWS = 26, 5
#: Texts, and their shingles, of one block. A set of candidates with more is compared by pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1_024, 1_000_000

_rng = np.random.default_rng(SEED)
_MULTIPLY = _rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the text's runs of 5 words in lower case. Shorter texts are one shingle, and all wordless ones
    the same."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        return np.array([hashed(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE_WORDS])).tolist()
    return np.unique(np.array([hashed(line[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE_WORDS - 1:] - 1).tolist(), strict=True)], np.uint64))


def bands(h: np.ndarray) -> list[int]:
    """One key of each band, as signed 64-bit numbers."""
    least = np.full(len(_ADD), 2**64 - 1, np.uint64)
    for i in range(0, len(h), 256):
        x = h[i:i + 256, None] * _MULTIPLY[None] + _ADD[None]
        # the high bits depend on all of the hash
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - 2**63 for i, r in enumerate(rows)]


def _banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["key", "n", "bands"])


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all sets that are alike, without all pairs: what is linked is not compared again."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    holders, starts = owner[order], np.concatenate(([0], np.cumsum(np.bincount(ids))))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    free, out = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first], front = False, [first]
        while front and free.any():
            f = front.pop()
            mine = ids[ends[f]:ends[f + 1]]
            mine = mine[starts[mine + 1] - starts[mine] > 1]
            if not len(mine):
                continue
            common = np.bincount(np.concatenate([holders[starts[i]:starts[i + 1]] for i in mine.tolist()]), minlength=len(sets))
            found = np.flatnonzero(free & (common * ALIKE[1] >= ALIKE[0] * (sizes[f] + sizes - common)))
            free[found] = False
            out += [(f, int(x)) for x in found]
            front += found.tolist()
    return out


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, i, j): verified links of each set of candidates."""
    now, keys, sets = None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        if len(keys) > 1 and (found := forest(sets)):
            yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in found]), pa.array([keys[b] for _, b in found])], ["a", "b"])

    for batch in batches:
        for r in batch.to_pylist():
            if (at := (r["root"], r["i"], r["j"])) != now:
                yield from links()
                now, keys, sets = at, [], []
            keys.append(r["id"])
            sets.append(shingles(r["text"]))
    yield from links()


def key_of(text: Column) -> Column:
    """What names a text; null texts are like empty ones."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def _band_links(made: DataFrame) -> DataFrame:
    """(a, b): ids that join all texts that share a band."""
    banded = made.select("id", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter("head < last").drop("last")
    return banded.join(heads, "band").filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))


def classes(docs: DataFrame, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, root): each distinct text that has near copies, with what names its component. `candidates` makes more links (a, b) of
    (key, id); all are verified."""
    small_batches(docs.sparkSession)
    texts = docs.select(key_of(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    made = texts.mapInArrow(_banded, "key string, n long, bands array<long>").withColumn("id", F.monotonically_increasing_id())
    # equal texts are one from here on, and go by a number
    made = spill(made, "copies-bands").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    made = spill(made, "copies-distinct")
    met = _band_links(made)
    near = components(met if candidates is None else met.unionByName(candidates(made.select("key", "id"))))
    member = spill(near.join(made, near.node == made.id).select("key", "id", "root", "n"), "copies-candidates")
    cut = member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("g"))
    # any two blocks of a set of candidates meet, and with them all their texts
    dealt = member.join(cut, "root").withColumn("own", F.pmod(F.xxhash64("key"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("g") == 1,
        F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda x: x != F.col("own")))))
    dealt = dealt.select("key", "id", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    once = texts.join(small(member.select("key")), "key", "left_semi").dropDuplicates(["key"])
    met = once.join(dealt, "key").select("root", "i", "j", "id", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "id")
    found = components(met.mapInArrow(_verified, "a long, b long"))
    return spill(found.join(member.select("key", "id"), found.node == member.id).select("key",
        F.concat(F.lit("c"), found.root.cast("string")).alias("root")), "copies-classes")
