"""Phrases whose words occur together more often than their parts would.

Each shard of the texts is counted into tries of limited depth, which are serialised in the order of their paths, a run for each range
of paths. The runs of a range come together and are merged; a walk down the merged trie gives the counts of left parts, links
from each path to the one without its first word those of right parts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MAX_RANGES, gathered, matched, small_batches, spill, table

LONGEST, LEAST, TOP, INSIDE, SCORE = 4, 30, 2_000, 80, 2_000_000
#: Word occurrences of one shard, and bytes of text that one range of paths stands for (more where there would be too many ranges).
SHARD_WORDS, RANGE_BYTES, MOST_RANGES = 1_000_000, 4 << 20, 200_000
#: About so many rows, and so many bytes of each, are sampled to place the bounds of the ranges evenly; where they lie changes no count.
BOUND_ROWS, BOUND_BYTES = 1_000, 1 << 14
#: Rows of runs that a merge holds before it adds up those of one path.
HELD_ROWS = 1 << 18
#: What ends a piece (all of it as the first of them), and letters that are lowered.
ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS, b"abcdefghijklmnopqrstuvwxyz" + ENDS[:1] * len(ENDS))
#: Bits of the filter of frequent pairs: so many a pair, and the most in all (64 MB). A filter that is too small lets more pairs
#: pass than are frequent, which costs work but changes no count.
PAIR_BITS, MOST_BITS = 16, 29
#: The top is first taken in so many parts of a language.
TOP_PARTS = 64


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with a full stop, which no word is, where a piece ends."""
    return text.translate(_LOWER).replace(ENDS[:1], b" . ").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _pair_places(first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter of each pair of word hashes."""
    h = (first ^ first >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(64 - bits), (h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - bits)


def _passes(filter_: np.ndarray, places: Iterable[np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([(filter_[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1 for p in places])


class Shard:
    """Texts of one language as numbers of their words; 0 parts pieces."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.words[ENDS[:1]]  # 0
        self.texts: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        found = tokens(text)
        self.texts.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        self.texts.append(np.zeros(1, np.int32))
        return len(found)

    def trie(self, depths: range, pairs: tuple[np.ndarray, int] | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words in order, paths (rows of word numbers, -1 behind the end) in order, and their counts. Only depths in `depths`
        are given; with `pairs` only paths all of whose pairs of neighbours pass the filter."""
        words = list(self.words)
        order = sorted(range(1, len(words)), key=words.__getitem__)
        rank = np.full(len(words), -1, np.int64)
        rank[order] = np.arange(len(order))
        words = [words[i] for i in order]
        at, v = rank[np.concatenate(self.texts)], len(order)
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        # nodes of a level are numbered in the order of their paths; node[i]: that of the path that begins at place i, or -1
        node, paths = at, np.arange(v)[:, None]
        if 1 in depths:
            levels.append((paths, np.bincount(at[at >= 0], minlength=v)))
        follows = None
        for depth in range(2, depths.stop):
            n = len(at) - depth + 1
            if n <= 0 or not len(paths):
                break
            live = (node[:n] >= 0) & (at[depth - 1:] >= 0)
            if follows is not None:
                live &= follows[:n] & follows[depth - 2:depth - 2 + n]
            places = np.flatnonzero(live)
            keys, inverse, counts = np.unique(node[places].astype(np.int64) * v + at[places + depth - 1], return_inverse=True, return_counts=True)
            paths = np.concatenate((paths[keys // v], (keys % v)[:, None]), axis=1)
            node = np.full(len(at), -1, np.int32)
            node[places] = inverse
            if depth == 2 and pairs is not None:
                h = _hashes(words)
                passing = _passes(pairs[0], _pair_places(h[paths[:, 0]], h[paths[:, 1]], pairs[1]))
                follows = np.zeros(len(at), bool)
                follows[places] = passing[inverse]
            if depth in depths:
                levels.append((paths, counts))
        deepest = depths.stop - 1
        rows = np.concatenate([np.pad(p, ((0, 0), (0, deepest - p.shape[1])), constant_values=-1) for p, _ in levels]) if levels else np.zeros((0, deepest), np.int64)
        n = np.concatenate([c for _, c in levels]) if levels else np.zeros(0, np.int64)
        line = np.lexsort(rows.T[::-1])
        return words, rows[line], n[line]


def _names(longest: int) -> list[str]:
    return ["lang", *[f"w{i}" for i in range(1, longest + 1)]]


def _schema(longest: int) -> pa.Schema:
    return pa.schema([("lang", pa.string()), *[(k, pa.binary()) for k in _names(longest)[1:]], ("n", pa.int64())])


def _serialised(table_: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table_.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table_)
    return sink.getvalue().to_pybytes()


def _parts(lang: str, words: list[bytes], rows: np.ndarray, bounds: list[tuple]) -> list[int]:
    """Where each range begins among rows in order: a bound is (language, words), the first path of its range."""
    path = lambda i: (lang, tuple(words[w] for w in rows[i] if w >= 0))
    return [bisect_left(range(len(rows)), b, key=path) for b in bounds]


def _runs(depths: range, longest: int, pairs, bounds):
    """(lang, text) to runs: of each shard's tries, what lies in one range of paths, in order."""
    def written(shards: dict[str, Shard]) -> Iterator[pa.RecordBatch]:
        parts: defaultdict[int, list[pa.Table]] = defaultdict(list)
        for lang in sorted(shards):
            words, rows, n = shards[lang].trie(depths, pairs and pairs.value)
            known = pa.array(words, pa.binary())
            cells = [known.take(pa.array(rows[:, i], mask=rows[:, i] < 0)) for i in range(rows.shape[1])]
            cells += [pa.nulls(len(rows), pa.binary())] * (longest - len(cells))
            whole = pa.table([pa.array([lang] * len(rows), pa.string()), *cells, pa.array(n)], schema=_schema(longest))
            starts = [0, *_parts(lang, words, rows, bounds.value), len(rows)]
            for r, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                if s < e:
                    parts[r].append(whole.slice(s, e - s))
        for r, tables in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([_serialised(pa.concat_tables(tables))], pa.binary())], ["range", "run"])
        parts.clear()
        pa.default_memory_pool().release_unused()  # two workers share what an executor leaves them

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, held = defaultdict(Shard), 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held += shards[lang].add(text.as_py())
                if held >= SHARD_WORDS:
                    yield from written(shards)
                    shards, held = defaultdict(Shard), 0
        yield from written(shards)
    return run


def _again(longest: int, bounds):
    """Rows of a merged trie to runs, so that they can be merged with those of longer paths."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tb in gathered(batches, 1 << 17):
            columns = [tb.column(k).to_pylist() for k in _names(longest)]
            at = np.array([bisect_right(bounds.value, (row[0], tuple(w for w in row[1:] if w is not None))) for row in zip(*columns, strict=True)])
            whole = tb.select([*_names(longest), "n"]).cast(_schema(longest))
            for r in np.unique(at).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([_serialised(whole.filter(pa.array(at == r)))], pa.binary())], ["range", "run"])
    return run


def _bounds(sample: list, depths: range, longest: int, pairs, ranges: int) -> list[tuple]:
    """First paths of ranges that hold about as many paths of the sample each."""
    shards = defaultdict(Shard)
    for lang, text in sample:
        shards[lang].add(bytes(text))
    paths = []
    for lang in sorted(shards):
        words, rows, _ = shards[lang].trie(depths, pairs)
        paths += [(lang, tuple(words[w] for w in r if w >= 0)) for r in rows.tolist()]
    return sorted({paths[i * len(paths) // ranges] for i in range(1, ranges)}) if paths else []


def _walked(longest: int, least: int):
    """Runs by their ranges to the merged trie: equal paths of all runs are added up, rare ones go, and each path gets the counts of
    its beginnings. A beginning that stands in an earlier range is null; the paths that a later range may go on from are given once
    more, as open. A row without words has the number of all words of a language in its range."""
    keys = _names(longest)
    lefts = [f"l{k}" for k in range(1, longest)]
    schema = pa.schema([*_schema(longest), *[(x, pa.int64()) for x in lefts], ("open", pa.bool_())])

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"])

    def lines(tb: pa.Table) -> list[tuple]:
        """The frequent paths of one range, in order, with the counts of their beginnings."""
        rows = tb.filter(pc.greater_equal(tb.column("n"), least))
        rows = sorted(((lang, *(w for w in words if w is not None)), n) for lang, *words, n in zip(*[rows.column(k).to_pylist() for k in (*keys, "n")], strict=True))
        path: list[tuple] = [((), 0)] * (longest + 1)  # by depth: the last path and its count
        wide = lambda own: (*own, *[None] * (longest + 1 - len(own)))
        out = []
        for own, n in rows:
            depth = len(own) - 1
            before = [path[d][1] if d < depth and path[d][0] == own[:d + 1] else None for d in range(1, longest)]
            path[depth] = (own, n)
            out.append((*wide(own), n, *before, False))
        last = rows[-1][0] if rows else ()
        out += [(*wide(own), n, *[None] * (longest - 1), True) for d, (own, n) in enumerate(path) if 0 < d < longest and last[:d + 1] == own]
        one = tb.filter(pc.is_null(tb.column("w2"))).group_by("lang").aggregate([("n", "sum")])
        return out + [(lang, *[None] * longest, n, *[None] * (longest - 1), False) for lang, n in zip(one.column("lang").to_pylist(), one.column("n_sum").to_pylist(), strict=True)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            out = lines(added(held)) if held else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            pa.default_memory_pool().release_unused()
        for b in batches:
            for r, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if r != now:
                    yield from done()
                    now, held, waiting = r, [], 0
                held.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
                waiting += held[-1].num_rows
                if waiting > HELD_ROWS:
                    held, waiting = [added(held)], 0
        yield from done()
    ddl = ", ".join(["lang string", *[f"{k} binary" for k in keys[1:]], "n long", *[f"{x} long" for x in lefts], "open boolean"])
    return run, ddl


def _merged(runs: DataFrame, longest: int, least: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """The merged trie of runs: (lang, words, n, l1, ..), paths that occur `least` times or more; and (lang, n) of all words."""
    keys = _names(longest)
    run, ddl = _walked(longest, least)
    dealt = runs.repartition(min(MAX_RANGES, ranges), "range").sortWithinPartitions("range")
    nodes = spill(dealt.mapInArrow(run, ddl), "phrases-trie")
    done = nodes.filter("not open and w1 is not null").drop("open")
    # at most one path a depth and range, so their size is that of the number of ranges
    for k in range(1, longest):
        mine = keys[:k + 1]
        ends = nodes.filter("open").filter(F.col(f"w{k}").isNotNull() & F.col(f"w{k + 1}").isNull())
        ends = F.broadcast(ends.select(*[F.col(c).alias(f"_{c}") for c in mine], F.col("n").alias("_n")))
        done = done.join(ends, [F.col(c) == F.col(f"_{c}") for c in mine], "left")
        done = done.withColumn(f"l{k}", F.when(F.col(f"w{k + 1}").isNotNull(), F.coalesce(f"l{k}", "_n"))).drop(*[f"_{c}" for c in mine], "_n")
    return done, nodes.filter("w1 is null").groupBy("lang").agg(F.sum("n").alias("n"))


def _filter(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """Bits for the pairs of words in w1 and w2. Its size is bounded: at most 2 ** MOST_BITS bits pass the driver."""
    bits = min(MOST_BITS, max(16, (PAIR_BITS * max(1, pairs.count()) - 1).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tb in gathered(batches):
            first, second = (_hashes(tb.column(c).to_pylist()) for c in ("w1", "w2"))
            p = np.unique(np.concatenate(_pair_places(first, second, bits)))
            slots, starts = np.unique(p >> np.uint64(6), return_index=True)
            words = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), starts)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(words.view(np.int64))], ["slot", "bits"])
    found = pairs.select("w1", "w2").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out, bits


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _linked(level: list[DataFrame], depth: int) -> DataFrame:
    """Paths of a depth with r1, ..: the counts of what is left behind each cut. The link to the path without the first word gives
    the first, and what that path's own link gave the others."""
    words = [f"w{i}" for i in range(1, depth + 1)]
    to = level[depth - 1].select("lang", *[F.col(f"w{i}").alias(f"w{i + 1}") for i in range(1, depth)], F.col("n").alias("r1"),
        *[F.col(f"r{k}").alias(f"r{k + 1}") for k in range(1, depth - 1)])
    linked = matched(level[0].filter(F.col(f"depth") == depth), to, ["lang", *words[1:]])
    return spill(linked, "phrases-linked")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` phrases of 2 to `longest` words with the highest scores.

    Null texts are empty, a null language is `und`, and one named so is the same; languages without phrases give no rows. Repeated rows
    count again. Ties of scores go to the higher count, then to the phrase that comes first in UTF-8; ties of cuts to the shorter
    left part. Texts of any length are read whole; bytes that are no UTF-8 are counted as they are and shown as replacement characters. Only
    `lang` and `text` are read, so other columns can't clash. An empty table gives an empty one. All counts are exact: pairs
    are counted first, then longer phrases where all their pairs are frequent enough, which those of frequent phrases are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keys = _names(longest)
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    read = read.filter("text is not null")
    size = read.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    ranges = max(1, min(MOST_RANGES, -(-size.bytes // RANGE_BYTES)))
    some = read.sample(min(1.0, BOUND_ROWS / max(1, size.rows)), seed=13).select("lang", F.substring("text", 1, BOUND_BYTES)).limit(2 * BOUND_ROWS)
    sample = [tuple(r) for r in some.collect()] if ranges > 1 else []
    send = spark.sparkContext.broadcast

    def runs(depths: range, pairs, bounds) -> DataFrame:
        return read.mapInArrow(_runs(depths, longest, pairs, bounds), "range int, run binary")
    bounds = send(_bounds(sample, range(1, 3), longest, None, ranges))
    nodes, words = _merged(runs(range(1, 3), None, bounds), longest, least, ranges)
    if longest > 2:
        nodes = spill(nodes.select(*keys, "n"), "phrases-pairs")
        pairs = send(_filter(nodes.filter("w2 is not null")))
        bounds = send(_bounds(sample, range(1, longest + 1), longest, pairs.value, ranges))
        longer = runs(range(3, longest + 1), pairs, bounds)
        nodes, _ = _merged(longer.unionByName(nodes.mapInArrow(_again(longest, bounds), "range int, run binary")), longest, least, ranges)
    depth = sum((F.col(k).isNotNull().cast("int") for k in keys[1:]), F.lit(0))
    nodes = spill(nodes.withColumn("depth", depth), "phrases-nodes")
    level = [nodes, nodes.filter("depth = 1").select("lang", "w1", "n")]
    for d in range(2, longest + 1):
        level.append(_linked(level, d))
    cut = lambda k: F.struct(F.expr(f"cast(n as decimal(20,0)) * {SCORE} div cast(l{k} + r{k} as decimal(20,0))").alias("score"), F.lit(k).alias("k"),
        F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    scored = None
    for d in range(2, longest + 1):
        best = F.array_min(F.array(*[cut(k) for k in range(1, d)])).alias("cut")
        part = level[d].select(*keys, F.col("n").alias("a"), best)
        scored = part if scored is None else scored.unionByName(part)
    # the highest count of a longer phrase around each
    around = []
    for d in range(3, longest + 1):
        for width in range(2, d):
            for f in range(1, d - width + 2):
                around.append(F.when(F.col("depth") == d, F.struct("lang", *[(F.col(f"w{f + i - 1}") if i <= width else F.lit(None).cast("binary")).alias(f"w{i}")
                                                                            for i in range(1, longest + 1)])))
    if around:
        held = nodes.filter("depth > 2").select("n", F.explode(F.array(*around)).alias("s")).filter("s is not null").select("n", "s.*")
        held = held.groupBy(*keys).agg(F.max("n").alias("_most")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_most")
        # both sides have each path once
        scored = scored.join(held, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
        scored = scored.filter(F.coalesce(_exact(F.col("_most")) * 100 < _exact(F.col("a")) * inside, F.lit(True)))
    phrase = F.concat_ws(" ", *[F.make_valid_utf8(F.col(k).cast("string")) for k in keys[1:]]).alias("phrase")
    scored = scored.select("lang", phrase, "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language may hold most rows: its top is taken in parts first
    parted = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    parted = parted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_r") <= top)
    ranked = parted.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_r") <= top)
    ranked = spill(ranked.select("lang", F.col("_r").cast("long").alias("rank"), "phrase", "a", "l", "r", "score"), "phrases-top")
    return matched(ranked, spill(words, "phrases-words"), ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
lines AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
    FROM lines, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL),
words AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
phrases AS (SELECT lang, k, g, a, string_split(g, ' ') AS w FROM f WHERE k >= 2 AND a >= {LEAST}),
cuts AS (SELECT lang, k, g, a, w, c, array_to_string(w[1:c], ' ') AS lg, array_to_string(w[c + 1:k], ' ') AS rg
    FROM phrases, range(1, {LONGEST}) t(c) WHERE c < k),
scores AS (SELECT x.lang, x.g, x.a, x.c, l.a AS l, r.a AS r, ({SCORE}::HUGEINT * x.a // (l.a + r.a))::BIGINT AS score
    FROM cuts x JOIN f l ON l.lang = x.lang AND l.g = x.lg AND l.k = x.c JOIN f r ON r.lang = x.lang AND r.g = x.rg AND r.k = x.k - x.c),
best AS (SELECT lang, g, a, l, r, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, c) AS one FROM scores) WHERE one = 1),
held AS (SELECT lang, g, max(a) AS most FROM (
    SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS g FROM phrases, range(2, {LONGEST}) s(m), range(1, {LONGEST}) t(i)
    WHERE m < k AND i + m - 1 <= k) GROUP BY lang, g),
left_over AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.g = b.g
    WHERE h.most IS NULL OR 100::HUGEINT * h.most < {INSIDE}::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM left_over)
SELECT r.lang, r.rank, r.g AS phrase, r.a, r.l, r.r, w.n, r.score FROM ranked r JOIN words w ON w.lang = r.lang WHERE r.rank <= {TOP}
"""
