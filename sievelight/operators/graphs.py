"""Graphs of names: connected components, and greedy stars in the order of names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Links of a component that is solved in one group, and names of a part of a larger one.
SMALL_LINKS, PART_NAMES = 500_000, 50_000
#: More than any graph of 2^64 names needs to come together.
MAX_ROUNDS, MAX_COMPONENT_ROUNDS = 10_000, 80


def _large_star(links: DataFrame) -> DataFrame:
    """Every name's larger neighbours move to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("m").alias("n"), F.col("n").alias("m")))
    low = both.groupBy("n").agg(F.min(F.least("n", "m")).alias("low"))
    return both.filter("m > n").join(low, "n").select(F.col("m").alias("n"), F.col("low").alias("m")).filter("n <> m").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every name and its smaller neighbours move to the smallest of them."""
    low = links.groupBy("n").agg(F.min("m").alias("low"))
    moved = links.join(low, "n")
    return moved.select("n", F.col("low").alias("m")).unionByName(moved.select(F.col("m").alias("n"), F.col("low").alias("m"))).filter("n <> m").distinct()


def components(links: DataFrame) -> DataFrame:
    """(n, m) links to (n, root): each name that has a link, with the smallest name that it reaches. Rounds of large and small stars,
    each written, until nothing moves; their number grows with the logarithm of the names, not with the longest chain."""
    down = lambda a: a.select(F.greatest("n", "m").alias("n"), F.least("n", "m").alias("m")).filter("n <> m").distinct()
    now, before = written(down(links), "links"), None
    for _ in range(MAX_COMPONENT_ROUNDS):
        now = written(_small_star(_large_star(now)), "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("n", "m").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select("n", F.col("m").alias("root")).unionByName(now.select(F.col("m").alias("n"), F.col("m").alias("root"))).distinct()
        before = state
    raise RuntimeError("components did not settle")


def _swept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (part, n, m, s) by part and n: one sweep over a part in the order of names. s is what m is known to be. A name is a
    member if a smaller neighbour is a seed, a seed if all are members, and open while that is not settled. Of a part what
    each name is held, of its links one at a time."""
    part, known, now = object(), {}, None
    smaller: list[str] = []  # of the name at hand
    names: list[str] = []
    kinds: list[str] = []

    def settle() -> None:
        kind = "seed" if all(s == "member" for s in smaller) else "member" if "seed" in smaller else None
        known[now] = kind
        if kind:
            names.append(now)
            kinds.append(kind)
    for b in batches:
        for p, n, m, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if p != part or n != now:
                if now is not None:
                    settle()
                if p != part:
                    part, known = p, {}
                now, smaller = n, []
            smaller.append(s or known.get(m) or "open")
        if len(names) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.string())], ["n", "s"])
            names, kinds = [], []
    if now is not None:
        settle()
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.string())], ["n", "s"])


def star_clusters(names: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(name, seed): greedy stars in order of names, as the lexicographically first maximal independent set. A name is a seed when all
    its smaller neighbours are members, a member of its smallest seed when one is a seed.

    A component of up to SMALL_LINKS links is settled in one sweep of one group. A larger one is cut into parts by ranges of names, which are
    swept again until no name is open: a round settles whatever hangs on its own part, so rounds grow with the parts that a chain
    of smaller neighbours crosses, not with its length. Names without links are seeds."""
    every = written(names.select(F.col(name).cast("string").alias("n")).distinct(), "names")
    down = written(pairs.select(F.greatest("a", "c").alias("n"), F.least("a", "c").alias("m")).filter("n <> m").distinct(), "links")
    roots = components(down)
    sizes = down.join(roots, "n").groupBy("root").agg(F.count("*").alias("links"))
    placed = written(roots.join(sizes, "root"), "roots")
    large = placed.filter(F.col("links") > SMALL_LINKS)
    # numbers of ranges of names, where there are large components
    parts = max(1, -(-large.count() // PART_NAMES))
    cut = large.repartitionByRange(parts, "n").select("n", F.concat_ws("|", F.lit("part"), F.spark_partition_id().cast("string"), "root").alias("part"))
    where = written(placed.filter(F.col("links") <= SMALL_LINKS).select("n", F.concat(F.lit("whole|"), F.col("root")).alias("part")).unionByName(cut), "parts")
    # names that only stand below others are seeds; all others are open
    state = written(every.join(down.select("n").distinct(), "n", "left_anti").select("n", F.lit("seed").alias("s")), "state")
    open_ = written(down.join(where, "n"), "open")
    for _ in range(MAX_ROUNDS):
        told = open_.join(state.select(F.col("n").alias("m"), "s"), "m", "left").select("part", "n", "m", "s")
        settled = written(told.repartition("part").sortWithinPartitions("part", "n", "m").mapInArrow(_swept, "n string, s string"), "settled")
        state = written(state.unionByName(settled), "state")
        open_ = written(open_.join(settled.select("n"), "n", "left_anti"), "open")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError("star clusters did not settle")
    seeds = state.filter("s = 'seed'").select(F.col("n").alias("m"))
    joined = down.join(seeds, "m").groupBy("n").agg(F.min("m").alias("seed"))
    members = state.filter("s = 'member'").join(joined, "n").select(F.col("n").alias(name), "seed")
    return members.unionByName(seeds.select(F.col("m").alias(name), F.col("m").alias("seed")))
