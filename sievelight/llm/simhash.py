"""Near duplicates by SimHash fingerprints under the general pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits. Partition i gets its own threshold T_i >= -1 with
sum(T_i) = k - m + 1; then any two fingerprints at k or fewer differing bits differ in at most T_i bits of some
partition i. The thresholds come from dynamic programming over candidate counts estimated on a bounded sample;
the sample steers the cost only, every fingerprint is probed and every candidate verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import copies
from .common import apart, gathered, small_batches, spill, table
from .components import components

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
MAX_DIFFERENCE = 4
#: Fingerprints sampled, by hash, to estimate bit correlations and candidate counts.
PLAN_SAMPLE = 2_000
#: Fingerprints of one bucket that a task holds; larger buckets are split into blocks, compared pairwise.
BLOCK = 4_096


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in over half the hashes of the text's 4-word shingles, repeats included.
    Null and wordless texts: 0. Fewer than 4 words: the whole sequence is the only shingle."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE_WORDS])).tolist()
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(line[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE_WORDS - 1:] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, the last column, gives way to its fingerprint."""
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], [*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    masks: tuple[int, ...]
    thresholds: tuple[int, ...]


def _partitions(bits: np.ndarray, m: int) -> list[list[int]]:
    """Greedy: each partition starts with the free bit that is the most correlated with any other and takes the
    bits that correlate most with those it has. Sizes differ by one at most."""
    spread = bits.std(axis=0)
    centred = np.where(spread > 0, (bits - bits.mean(axis=0)) / np.maximum(spread, 1e-9), 1.0)
    corr = np.abs(centred.T @ centred) / max(len(bits), 1)
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for i in range(m):
        want = BITS // m + (i < BITS % m)
        got = [max(free, key=lambda b: (corr[b, free].max(), -b))]
        free.remove(got[0])
        while len(got) < want:
            b = max(free, key=lambda x: (corr[x, got].mean(), -x))
            got.append(b)
            free.remove(b)
        out.append(sorted(got))
    return out


def _variants(width: int, t: int) -> float:
    """Keys that a fingerprint probes besides its own: half of the flips, as one of two partners probes."""
    n, c = 0.0, 1.0
    for d in range(1, t + 1):
        c = c * (width - d + 1) / d
        n += c / 2
    return n


def plan_for(sample: np.ndarray, n: int, k: int = MAX_DIFFERENCE) -> Plan:
    """Partitions and thresholds of the least estimated cost: keys made and compared, and candidates verified."""
    best: tuple[float, Plan] | None = None
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, BITS))
    a, b = sample[: len(sample) // 2], sample[len(sample) // 2:]
    for m in range(2, k + 2):
        parts = _partitions(bits, m)
        masks = [sum(1 << x for x in p) for p in parts]
        cost = []
        for p, mask in zip(parts, masks, strict=True):
            if len(a):
                d = np.bitwise_count((a[:, None] ^ b[None]) & np.uint64(mask))
                share = [float((d <= t).mean()) for t in range(k + 1)]
            else:
                share = [0.0] * (k + 1)
            even = [sum(float(np.prod([(len(p) - j) / (j + 1) for j in range(d)])) for d in range(t + 1)) / 2.0 ** len(p) for t in range(k + 1)]
            # one key costs about as much as 20 compared candidates
            cost.append([0.0] + [20 * (1 + _variants(len(p), t)) + n * max(share[t], even[t]) / 2 for t in range(k + 1)])
        # dynamic programming: least cost of the first i partitions with thresholds of sum s
        table_: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in cost:
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (v, ts) in table_.items():
                for t in range(-1, k + 1):
                    if (w := v + c[t + 1]) < nxt.get(s + t, (float("inf"),))[0]:
                        nxt[s + t] = (w, (*ts, t))
            table_ = nxt
        v, ts = table_[k - m + 1]
        if best is None or v < best[0]:
            best = (v, Plan(tuple(masks), ts))
    return best[1]


def _flips(mask: int, t: int) -> list[tuple[int, int]]:
    """(flip, lowest flipped bit) of 1 to t bits of the mask."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    return [(sum(1 << b for b in c), 1 << c[0]) for d in range(1, t + 1) for c in combinations(bits, d)]


def _keys(plan: Plan, probes: bool = True):
    """A row for each bucket that a fingerprint is at home in (role 0) or probes (role 1)."""
    flips = [(i, np.uint64(m), np.array([f for f, _ in _flips(m, t * probes)], np.uint64),
        np.array([low for _, low in _flips(m, t * probes)], np.uint64))
             for i, (m, t) in enumerate(zip(plan.masks, plan.thresholds, strict=True)) if t >= 0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tb in gathered(batches, 8_192):
            fp = tb.column("fp").to_numpy().view(np.uint64)
            for i, mask, flip, low in flips:
                home = fp & mask
                who, what = np.nonzero((fp[:, None] & low[None]) == 0) if len(flip) else (np.zeros(0, np.int64),) * 2
                key = np.concatenate((home, home[who] ^ flip[what])) if len(flip) else home
                role = np.concatenate((np.zeros(len(fp), np.int8), np.ones(len(who), np.int8)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), i, np.int32)), pa.array(key.view(np.int64)),
                        pa.array(np.concatenate((fp, fp[who])).view(np.int64)), pa.array(role)],
                    ["part", "key", "fp", "role"])
    return run


def _forest(fp: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Links that join what is within k bits inside one bucket, without all its pairs; and class numbers."""
    label, left, out, c = np.full(len(fp), -1), np.arange(len(fp)), [], 0
    while len(left):
        front, left = left[:1], left[1:]
        label[front] = c
        while len(front) and len(left):
            found = []
            for f in range(0, len(front), 256):
                if not len(left):
                    break
                near = np.bitwise_count(fp[front[f:f + 256]][:, None] ^ fp[left][None]) <= k
                hit = near.any(axis=0)
                if hit.any():
                    new = left[hit]
                    out.append(np.stack((fp[front[f + near[:, hit].argmax(axis=0)]], fp[new]), axis=1))
                    label[new] = c
                    found.append(new)
                    left = left[~hit]
            front = np.concatenate(found) if found else front[:0]
        c += 1
    return out, label


def _against(home: np.ndarray, label: np.ndarray, probe: np.ndarray, k: int) -> list[np.ndarray]:
    """One link of each probe to each class of the bucket that it reaches."""
    out = []
    for f in range(0, len(probe), 256):
        p, h = np.nonzero(np.bitwise_count(probe[f:f + 256][:, None] ^ home[None]) <= k)
        if len(p):
            _, first = np.unique(p * (label.max() + 1) + label[h], return_index=True)
            out.append(np.stack((home[h[first]], probe[f + p[first]]), axis=1))
    return out


def _links(k: int):
    """Rows sorted by (part, key, block, role): verified links of each bucket."""

    def large(fp: np.ndarray, role: np.ndarray) -> list[np.ndarray]:
        out, label = _forest(fp[role == 0], k)
        return out + (_against(fp[role == 0], label, fp[role != 0], k) if (role == 0).any() else [])

    def closed(seg: np.ndarray, fp: np.ndarray, role: np.ndarray) -> list[np.ndarray]:
        """seg: bucket numbers, ascending."""
        out = []
        starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(seg)])))
        big = sizes > 64
        for s, n in zip(starts[big], sizes[big], strict=True):
            out += large(fp[s:s + n], role[s:s + n])
        keep = ~np.repeat(big, sizes)
        seg, fp, role = seg[keep], fp[keep], role[keep]
        for d in range(1, min(64, int(sizes[~big].max(initial=1)))):
            i = np.flatnonzero((seg[d:] == seg[:-d]) & (role[:-d] == 0))
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= k]
            if len(i):
                out.append(np.stack((fp[i], fp[i + d]), axis=1))
        return out

    def batch(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if pairs:
            ab = np.concatenate(pairs)
            ab = ab[ab[:, 0] != ab[:, 1]].view(np.int64)
            ab = np.unique(np.sort(ab, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for tb in gathered(batches):
            now = tuple(tb.column(c).to_numpy() for c in ("part", "key", "block", "fp", "role"))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            part, key, block, fp, role = now
            change = np.concatenate(([False], (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            seg = np.cumsum(change)
            cut = int(np.searchsorted(seg, seg[-1]))  # the last bucket may go on
            ufp = fp.view(np.uint64)
            if cut:
                yield from batch(closed(seg[:cut], ufp[:cut], role[:cut]))
            held = tuple(x[cut:] for x in now)
            if len(held[0]) > 2 * BLOCK and (held[4] != 0).any():  # its homes are complete: link the probes so far and let them go
                yield from batch(large(held[3].view(np.uint64), held[4]))
                held = tuple(x[held[4] == 0] for x in held)
        if held is not None and len(held[0]):
            yield from batch(large(held[3].view(np.uint64), held[4]))
    return run


def links(distinct: DataFrame, k: int = MAX_DIFFERENCE) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints `fp` that are within k bits of each other.
    Inside a bucket only a spanning set is returned, never all pairs; the classes are the same."""
    n = distinct.count()
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).collect()], np.int64).view(np.uint64)
    plan, made = plan_for(sample, n, k), "part int, key long, fp long, role byte"
    keys = distinct.mapInArrow(_keys(plan), made)
    hot = distinct.mapInArrow(_keys(plan, probes=False), made).groupBy("part", "key").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)
    hot = spill(hot.withColumn("_g", F.ceil(F.col("_n") / BLOCK).cast("int")).drop("_n"), "simhash-hot")
    if hot.isEmpty():
        dealt = keys.withColumn("block", F.lit(0))
    else:  # a bucket of g blocks: a row is at home in one, and probes the later ones (others probe them all)
        dealt = keys.join(hot, ["part", "key"], "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
        dealt = dealt.withColumn("_own", F.when(F.col("role") == 0, F.pmod(F.xxhash64("fp"), F.col("_g"))).otherwise(0).cast("int"))
        dealt = dealt.withColumn("block", F.explode(F.sequence("_own", F.col("_g") - 1)))
        dealt = dealt.withColumn("role", F.when((F.col("role") == 0) & (F.col("block") == F.col("_own")), 0).otherwise(1).cast("byte"))
    dealt = dealt.select("part", "key", "block", "fp", "role").repartition("part", "key", "block").sortWithinPartitions("part", "key",
        "block", "role")
    return dealt.mapInArrow(_links(k), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = MAX_DIFFERENCE) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id (the smallest doc_id that its links reach).

    Null and wordless texts have fingerprint 0 and are linked like any other. Equal fingerprints are collapsed
    before links are searched, so copies cost nothing. Null ids take part but never name a component unless it
    has no other id. Repeated rows give rows of their own. Texts of any length are read whole. Only doc_id and text are read, so
    other columns can't clash. An empty table gives an empty result.
    """
    fps = spill(fingerprints(docs), "simhash-fps")
    first = spill(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    roots = components(links(first.select("fp"), k))
    rooted = spill(first.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "doc_id"), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = rooted.join(least, "root").select("fp", "component_id")
    classes = first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _linked(texts: DataFrame) -> DataFrame:
    """(id, fp) to (a, b): ids that join all texts whose fingerprints are equal or linked."""
    held = spill(texts.select("id", "fp"), "simhash-ids")
    heads = spill(held.groupBy("fp").agg(F.min("id").alias("head")), "simhash-distinct")
    equal = held.join(heads, "fp").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    of = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"_{side}"))
    near = links(heads.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return equal.unionByName(near)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near copies: of each component one row stays, that of the smallest id (null ids last;
    among equal ids, that of the smallest hash of the text). Rows that share an id but no text are judged apart, and rows
    with a null id follow their component like others. Other columns pass through, whatever their names. Null texts are like empty
    ones, of which one stays. Texts of any length are compared whole. An empty table gives an empty one.

    Candidates are what SimHash fingerprints link, at MAX_DIFFERENCE bits as in `near_duplicates`. 4 of 64 bits stand for a similarity
    of about 0.96, so MinHash bands add theirs. An exact check follows: copies are texts with a Jaccard similarity of 0.8 or more in their
    5-word shingles (`copies`)."""
    small_batches(docs.sparkSession)
    key = copies.key_of(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), key.alias("key"), F.col("text").cast("string").alias("text"))
    rows = spill(rows.mapInArrow(_fingerprints, "doc_id long, key string, fp long"), "simhash-fps")
    alike = copies.classes(docs, lambda texts: _linked(texts.join(rows.select("key", "fp").distinct(), "key")))
    rooted = rows.join(alike, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("r"))
    first = first.select(F.col("r.doc_id").alias("_kept_id"), F.col("r.key").alias("_kept_key"))
    own, back = apart(docs, ["_kept_id", "_kept_key", "_row_id", "_row_key"])
    keyed = own.withColumns({"_row_id": F.col("doc_id").cast("long"), "_row_key": key})
    kept = keyed.join(first, F.col("_row_id").eqNullSafe(F.col("_kept_id")) & (F.col("_row_key") == F.col("_kept_key")), "left_semi")
    return kept.dropDuplicates(["_row_id", "_row_key"]).select(*back)
