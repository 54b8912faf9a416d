"""The metric join against all products, and stars against the greedy sweep."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.operators import graphs, pairs, stars


def _plain(name, size, x, threshold, r):
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    cos = unit @ unit.T
    cos[np.ix_(norm == 0, norm == 0)] = 1.0
    out = set()
    for i, j in zip(*np.nonzero(cos >= threshold), strict=True):
        if name[i] < name[j] and size[j] >= size[i] / r and size[j] < size[i] * r + 1:
            out.add((name[i], name[j]))
    return out


def _frame(spark, name, size, x):
    return spark.createDataFrame([(n, int(s), v.tolist()) for n, s, v in zip(name, size, x, strict=True)], "name string, size long, v array<double>")


@pytest.mark.parametrize("threshold", [-0.2, 0.35, 0.75, 0.9, 0.97, 1.0 - 1e-9])
def test_all_pairs_are_found(spark, threshold):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12, 8))[rng.integers(12, size=400)] + rng.normal(size=(400, 8)) * rng.choice([0.0, 0.05, 0.3, 2.0], 400)[:, None]
    x[7] = x[8] = x[9] = 0
    size = np.exp(rng.normal(size=400) * 2 + 5).astype(int) + 1
    name = [f"n{i:04d}" for i in rng.permutation(400)]
    df = _frame(spark, name, size, x)
    got = [(r.a, r.c) for r in pairs.similar_pairs(df, "name", "size", "v", threshold, block=37).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain(name, size, x, threshold, 3.0)


def test_few_products_on_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    n = 6_000
    x = rng.normal(size=(60, 32))[rng.integers(60, size=n)] + rng.normal(size=(n, 32)) * 0.01
    df = _frame(spark, [f"n{i:05d}" for i in range(n)], np.full(n, 500), x)
    cells = pairs.dealt(df, "name", "size", "v", 0.999, 3.0, 2_048).groupBy("dim", "ca", "cb", "i", "j").agg(F.count_if(F.col("part") == 0).alias("p"), F.count_if(F.col("part") == 1).alias("q"))
    work = sum(r.p * r.q if (r.ca, r.i) != (r.cb, r.j) else r.p * r.p // 2 for r in cells.collect())
    assert work < 0.1 * n * n / 2
    got = pairs.similar_pairs(df, "name", "size", "v", 0.999)
    assert got.count() == len(_plain([f"n{i:05d}" for i in range(n)], np.full(n, 500), x, 0.999, 3.0)) > n


def test_lengths_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("c", 1, [1.0, 0.0, 0.0]), ("d", 1, None), ("e", 1, []), ("f", 1, [1.0, None])],
                               "name string, size long, v array<double>")
    assert [(r.a, r.c) for r in pairs.similar_pairs(df, "name", "size", "v").collect()] == [("a", "b")]
    assert pairs.similar_pairs(df.limit(0), "name", "size", "v").count() == 0


def _greedy(names, links):
    near = {n: set() for n in names}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    seed = {}
    for n in sorted(names):
        if n not in seed:
            seed[n] = n
            seed |= {m: n for m in near[n] if m not in seed}
    return seed


def _stars(spark, names, links):
    got = graphs.star_clusters(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(links, "a string, c string"), "name")
    return {r.name: r.seed for r in got.collect()}


@pytest.mark.parametrize("small, part", [(500_000, 50_000), (5, 7)])
def test_stars_are_the_greedy_sweep(spark, small, part, monkeypatch):
    monkeypatch.setattr(graphs, "SMALL_LINKS", small)
    monkeypatch.setattr(graphs, "PART_NAMES", part)
    rnd = random.Random(5)
    names = [f"n{i:03d}" for i in range(90)]
    links = [(rnd.choice(names), rnd.choice(names)) for _ in range(70)] + [(names[i], names[i + 1]) for i in range(60, 89)]
    links = [x for x in links if x[0] != x[1]]
    assert _stars(spark, names, links) == _greedy(names, links)


def test_a_path_of_names_takes_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(graphs, "written", lambda df, tag, real=graphs.written: (tables.append(tag), real(df, tag))[1])
    names = [f"n{i:06d}" for i in range(100_000)]
    got = _stars(spark, names, list(zip(names[:-1], names[1:], strict=True)))
    assert got == {n: names[i - i % 2] for i, n in enumerate(names)}
    assert tables.count("links") + tables.count("settled") < 40 and tables.count("settled") == 1


def test_components(spark):
    rnd = random.Random(3)
    links = [(f"a{rnd.randrange(300)}", f"a{rnd.randrange(300)}") for _ in range(180)] + [("x", "x")]
    root = {}
    find = lambda n: n if root.setdefault(n, n) == n else find(root[n])
    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.n: r.root for r in graphs.components(spark.createDataFrame(links, "n string, m string")).collect()}
    assert got == {n: find(n) for n in {n for x in links if x[0] != x[1] for n in x}}


@pytest.mark.parametrize("threshold, stretch", [(-0.2, 16), (0.35, 16), (0.35, 100), (0.75, 16), (0.97, 16), (0.97, 40), (0.35, 4_096)])
def test_stars_of_vectors_are_those_of_their_pairs(spark, threshold, stretch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(12, 8))[rng.integers(12, size=400)] + rng.normal(size=(400, 8)) * rng.choice([0.0, 0.05, 0.3, 2.0], 400)[:, None]
    x[7] = x[8] = x[9] = 0
    size = np.exp(rng.normal(size=400) * 2 + 5).astype(int) + 1
    name = [f"n{i:04d}" for i in rng.permutation(400)]
    odd = spark.createDataFrame([("m", 9, None), ("o", 9, []), ("p", 9, [1.0, None]), ("q", 9, [1.0, 2.0]), ("n0000x", 10, [2.0, 4.0])], "name string, size long, v array<double>")
    df = _frame(spark, name, size, x).unionByName(odd)
    got = [(r.name, r.seed) for r in stars.similar_stars(df, "name", "size", "v", threshold, stretch=stretch).collect()]
    links = _plain(name, size, x, threshold, 3.0) | {("n0000x", "q")}
    assert len(got) == len(dict(got)) and dict(got) == _greedy([*name, "m", "o", "p", "q", "n0000x"], links)


def test_stars_of_repeated_names_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("b", 1, [1.0, 0.0]), ("c", 1, [0.0, 1.0])], "name string, size long, v array<double>")
    assert {(r.name, r.seed) for r in stars.similar_stars(df, "name", "size", "v").collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert stars.similar_stars(df.limit(0), "name", "size", "v").count() == 0


def test_dense_stars_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "similar_pairs", lambda *a, **k: pytest.fail("pairs were listed"))
    rng = np.random.default_rng(3)
    name = [f"n{i:04d}" for i in range(1_500)]
    x = rng.normal(size=(1_500, 8))
    got = stars.similar_stars(_frame(spark, name, np.full(1_500, 9), x), "name", "size", "v", 0.35, stretch=128)
    assert {r.name: r.seed for r in got.collect()} == _greedy(name, _plain(name, np.full(1_500, 9), x, 0.35, 3.0))


def test_what_blocks_are_sent_grows_with_the_table(spark):
    rng = np.random.default_rng(7)
    sent = []
    for n in (7_000, 28_000):
        df = spark.createDataFrame([(f"n{i:05d}", v.tolist()) for i, v in enumerate(rng.normal(size=(n, 4)))], "name string, v array<double>").withColumn("size", F.lit(9))
        sent.append(pairs.dealt(df, "name", "size", "v", 0.35, 3.0, None).count() / n)
    assert max(sent) <= pairs.BLOCKS and sent[1] <= sent[0] * 1.01
    assert pairs.block_rows(10**7, 64) == 32_768 and pairs.block_rows(10**7, 10**8) == 1 and pairs.block_rows(5, 64) == 512
