"""Scans over ranges: the same whatever the ranges, with one key that fills most of them."""

import random

import pytest
from pyspark.sql import functions as F

from sievelight.operators import ingest, runtime, scans


@pytest.fixture(params=[100, 50_000])
def ranges(request, monkeypatch):
    monkeypatch.setattr(scans, "RANGE_ROWS", request.param)
    return request.param


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    keys = [1] * 6 + [2, 3, None] + list(range(10, 30))
    return [(rnd.choice(keys), rnd.randrange(60_000), i, rnd.choice(["low", "high", None])) for i in range(2_500)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "key long, ms long, id long, level string")


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_row_before_and_sums(spark, rows, ranges):
    got = scans.scanned(_frame(spark, rows), "key", ["ms", "id"], {"was": "level", "at": "ms"}, {"n": F.lit(1), "t": F.col("id")}).collect()
    want = set()
    for k, mine in _by_key(rows).items():
        t = 0
        for n, r in enumerate(mine):
            t += r[2]
            want.add((*r, mine[n - 1][3] if n else None, mine[n - 1][1] if n else None, n + 1, t))
    assert {(r.key, r.ms, r.id, r.level, r.was, r["at"], r.n, r.t) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("span, rate", [(1, 1), (50, 1), (3_000, 4), (20_000, 3), (100_000, 5)])
def test_windows_from_their_first_event(spark, rows, ranges, span, rate):
    got = {r.id: r.allowed for r in ingest.rate_limited(_frame(spark, rows), "key", "ms", "id", rate, span).collect()}
    want = {}
    for mine in _by_key(rows).values():
        allowed, _ = ingest.gate([r[1] for r in mine], None, rate, span)
        want |= {r[2]: a for r, a in zip(mine, allowed, strict=True)}
    assert got == want


def test_level_changes_and_lateness(spark, rows, ranges):
    df = _frame(spark, rows)
    changes = {(r.id, r.before) for r in runtime.level_changes(df, "key", "ms", "id").collect()}
    late = {r.key: (r.samples, r.late_ms, r.max_late_ms) for r in runtime.lateness(df, "key", "ms", "id", 20).collect()}
    want_changes, want_late = set(), {}
    for k, mine in _by_key(rows).items():
        pairs = list(zip(mine[:-1], mine[1:], strict=True))
        want_changes |= {(b[2], a[3]) for a, b in pairs if a[3] and b[3] and a[3] != b[3]}
        if pairs:
            over = [max(0, b[1] - a[1] - 20) for a, b in pairs]
            want_late[k] = (len(over), sum(over), max(over))
    assert changes == want_changes and late == want_late


def test_timing_stops(spark, rows, ranges):
    rnd = random.Random(1)
    calls = [(k, ms, i, rnd.randrange(4) if k != 2 else 9) for k, ms, i, _ in rows]
    got = {r.key: (r.call_count, r.wasm_time_ms, r.longest_call_ms, r.timing_stopped) for r in
           runtime.call_times(spark.createDataFrame(calls, "key long, ms long, id long, t long"), "key", ["ms", "id"], "t", 30, 1.4).collect()}
    want = {}
    for k, mine in _by_key(calls).items():
        total = n = 0
        timed, stopped = [], False
        for r in mine:
            if not stopped:
                timed.append(r[3])
                n, total = n + 1, total + r[3]
                stopped = n >= 30 and total / n < 1.4
        want[k] = (len(mine), sum(timed), max(timed), stopped)
    assert got == want and {v[3] for v in want.values()} == {True, False}


def test_empty_and_refused(spark):
    empty = _frame(spark, [])
    assert scans.scanned(empty, "key", ["ms"], {"was": "level"}, {"n": F.lit(1)}).count() == 0
    assert ingest.rate_limited(empty, "key", "ms", "id").count() == 0
    with pytest.raises(Exception, match="no time"):
        ingest.rate_limited(_frame(spark, [(1, None, 1, "x")]), "key", "ms", "id").count()


def test_one_frame_over_many_ranges_in_few_joins(spark, monkeypatch):
    """10^5 events of one frame; doubling meets 100 ranges in about seven rounds."""
    monkeypatch.setattr(scans, "RANGE_ROWS", 1_000)
    rounds = []
    monkeypatch.setattr(scans, "written", lambda df, tag, real=scans.written: (rounds.append(tag), real(df, tag))[1])
    df = spark.range(100_000).select(F.lit(5).alias("key"), (F.col("id") * 7 + F.pmod(F.xxhash64("id"), F.lit(5))).alias("ms"), "id")
    got = ingest.rate_limited(df, "key", "ms", "id", 10, 900)
    times = sorted((r.ms, r.id) for r in df.collect())
    allowed, _ = ingest.gate([t for t, _ in times], None, 10, 900)
    assert {r.id for r in got.filter("allowed").select("id").collect()} == {i for (_, i), a in zip(times, allowed, strict=True) if a}
    assert 5 <= rounds.count("jumps") <= 9
