"""Product codes against plain Lloyd rounds in integers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import codes, common


def _plain(ids, vectors, parts, entries, rounds):
    """Codes, errors and codebooks with a full search in every round."""
    v = np.floor(256 * np.asarray(vectors, np.float64)).astype(np.int64).reshape(len(ids), parts, -1)
    first = [min((tuple(v[i].ravel().tolist()), i) for i in range(len(ids)) if ids[i] == d)[1] for d in sorted({i for i in ids if i is not None})[:entries]]
    books = v[first].transpose(1, 0, 2).copy()
    search = lambda: ((v[:, :, None] - books[None]) ** 2).sum(axis=3)
    for _ in range(rounds):
        own = search().argmin(axis=2)
        for p in range(parts):
            for e in range(books.shape[1]):
                if len(x := v[own[:, p] == e, p]):
                    books[p, e] = [int(s) // len(x) for s in x.sum(axis=0)]
    d = search()
    return [bytes(r.tolist()).hex() for r in d.argmin(axis=2)], d.min(axis=2).sum(axis=1), books


@pytest.mark.parametrize("kind", ["normal", "clustered", "few values", "large"])
def test_equal_to_plain_rounds(spark, kind, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 300)
    rng, n = np.random.default_rng(5), 1_500
    x = {"normal": rng.normal(size=(n, 16)), "clustered": rng.normal(size=(20, 16))[rng.integers(20, size=n)] + rng.normal(size=(n, 16)) * 0.01,
         "few values": rng.integers(-2, 3, size=(n, 16)) / 256, "large": rng.normal(size=(n, 16)) * 1e5}[kind]
    ids = rng.permutation(n).tolist()
    df = spark.createDataFrame([(i, r, i % 3) for i, r in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>, label int")
    coded, books = codes.compress(df.repartition(3), parts=4, entries=20, rounds=3)
    want, error, end = _plain(ids, x, 4, 20, 3)
    got = {r.vec_id: (r.code, r.error) for r in coded.collect()}
    assert got == {i: (c, e) for i, c, e in zip(ids, want, error.tolist(), strict=True)}
    assert np.array_equal(books.entries, end)


def test_heaps_give_up_only_what_drift_has_reached():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(5, 4))[rng.integers(5, size=4_000)] * 1_000 + rng.normal(size=(4_000, 4)) * 40).astype(np.int64)
    start = codes.Books(x[None, :12].copy(), np.zeros((1, 12)))
    own, slack = codes.looked_through(x, start.entries[0])
    heaps = codes.Heaps.filled(own, codes._low(slack), 12)
    to = start.moved(start.entries + rng.integers(-3, 4, start.entries.shape))
    after, popped = heaps.moved(x, to.entries[0], to.drift[0])
    assert 0 < popped < 4_000
    assert np.array_equal(after.assigned(), codes.squares(x, to.entries[0]).argmin(axis=1))
    still, none = after.moved(x, to.entries[0], to.drift[0])
    # what ties stays on top and is looked through again
    assert none < popped and np.array_equal(still.assigned(), after.assigned())


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0] * 16, "a"), (7, [1.0, 2.0] * 16, None), (7, [1.0, 2.0] * 16, None), (3, [-0.001] * 32, "a"), (3, [5.0] * 32, "b"), (1, None, "a"),
            (2, [1.0, None] * 16, "a"), (4, [nan] * 32, "a"), (5, [inf] * 32, "a"), (6, [], "a"), (8, [1.0] * 16, "a"), (9, [1.0] * 5, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("code", F.lit("x")).withColumn("v", F.lit(1))
    coded, books = codes.compress(df)
    kept = [(i, v, l) for i, v, l in rows if v and len(v) == 32 and all(c is not None and np.isfinite(c) for c in v)]
    want, error, end = _plain([k[0] for k in kept], [k[1] for k in kept], 16, 64, 2)
    assert sorted(map(repr, ((r.vec_id, r.code, r.error, r.label) for r in coded.collect()))) == sorted(map(repr, ((k[0], c, e, k[2]) for k, c, e in zip(kept, want, error.tolist(), strict=True))))
    assert books.sha256() == hashlib.sha256(",".join(map(str, end.ravel().tolist())).encode()).hexdigest()
    for none in (df.limit(0), df.filter("vec_id is null"), df.filter("vec_id = 9")):
        assert codes.compress(none)[0].count() == 0
    with pytest.raises(Exception, match="too large"):
        codes.compress(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9)))


def test_heavy_keys_are_joined_apart(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("k"), "id")
    side = rows.groupBy("k").agg(F.sum("id").alias("s"))
    key = lambda r: (r.id, r.k, r.s)
    few = sorted(map(key, common.matched(rows, side, ["k"]).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    many = sorted(map(key, common.matched(rows, side, ["k"]).collect()))
    assert few == many and len(many) == 20_000
