"""Collocations against plain counting, with small shards and many ranges."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight.llm import common, phrases

DOCS = "text string, lang string, n long, score string, w1 string, phrase string"


def _plain(rows, longest, least, top, inside=80):
    counts = {}
    for text, lang in rows:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        low = (text or "").translate({a: a + 32 for a in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n, found = sum(v for p, v in c.items() if len(p) == 1), []
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = {}
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i:i + m]] = max(a, around.get(p[i:i + m], 0))
        for p, a in frequent.items():
            if 100 * around.get(p, 0) >= inside * a:
                continue
            score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def _got(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture()
def texts():
    rnd = random.Random(4)
    words = ["the", "of", "The", "a", "b\x01", "b", "B", "new", "york", "times", "é", "É", "\x02", "x-y", "a\xa0b"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "; ", "?", "!:"]
    rows = []
    for i in range(600):
        t = "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randrange(60)))
        rows.append((t + rnd.choice(["", " new york times square", " the the the the the"]), rnd.choice(["en", "en", "de", None, "und", ""])))
    return [*rows, *rows[:5] * 40, (None, "en"), ("", "fr"), (" ", "fr"), (".", None), ("word " * 20_000, "long")]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_equal_to_plain_counting(spark, texts, longest, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_BYTES", 2_000)  # many ranges, so that beginnings stand in earlier ones
    monkeypatch.setattr(phrases, "HELD_ROWS", 100)
    monkeypatch.setattr(phrases, "PAIR_BITS", 1)
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in texts], DOCS).repartition(5)
    want = _plain(texts, longest, 12, 40)
    assert len({r[0] for r in want}) == 5 and _got(phrases.collocations(df, longest, 12, 40)) == want


def test_without_broadcast_of_sides(spark, texts, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(common, "HEAVY", 16)
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in texts], DOCS)
    assert _got(phrases.collocations(df, 4, 12, 40)) == _plain(texts, 4, 12, 40)


def test_nothing(spark):
    df = spark.createDataFrame([(None, "en"), ("", None), ("a b c", "en")], "text string, lang string")
    assert phrases.collocations(df).count() == phrases.collocations(df.limit(0)).count() == 0


def test_shards_may_be_of_any_size(texts, monkeypatch):
    rows = [(r[1] or "und", (r[0] or "").encode()) for r in texts]
    bounds = phrases._bounds(rows, range(1, 5), 4, None, 9)

    class Sent:
        value = bounds

    def counted(most):
        monkeypatch.setattr(phrases, "SHARD_WORDS", most)
        b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
        c = Counter()
        for out in phrases._runs(range(1, 5), 4, None, Sent)([b]):
            at, blob = out.column(0)[0].as_py(), out.column(1)[0].as_buffer()
            lines = list(zip(*[x.to_pylist() for x in pa.ipc.open_stream(blob).read_all().columns], strict=True))
            keys = [(line[0], tuple(x for x in line[1:5] if x is not None)) for line in lines]
            assert keys == sorted(keys) and (not at or keys[0] >= bounds[at - 1]) and (at == len(bounds) or keys[-1] < bounds[at])
            for line in lines:
                c[line[:5]] += line[5]
        return c
    assert len(bounds) > 4 and counted(50) == counted(10**9)


def test_filter_lets_all_its_pairs_through(spark):
    pairs = [(f"w{i}".encode(), f"v{i * 7}".encode()) for i in range(3_000)]
    bits, size = phrases._filter(spark.createDataFrame(pairs, "w1 binary, w2 binary"))
    h = [phrases._hashes(list(x)) for x in zip(*pairs, strict=True)]
    assert phrases._passes(bits, phrases._pair_places(*h, size)).all()
    assert phrases._passes(bits, phrases._pair_places(np.roll(h[0], 1), h[1], size)).mean() < 0.1


def test_scores_beyond_64_bits(spark):
    n = 9 * 10**17
    df = spark.createDataFrame([(n, n + 3, n + 5)], "n long, l1 long, r1 long")
    got = df.select(F.expr("cast(n as decimal(20,0)) * 2000000 div cast(l1 + r1 as decimal(20,0))").alias("s")).first().s
    assert got == 2_000_000 * n // (2 * n + 8)
