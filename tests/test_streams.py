"""Keyed streams: several files, restarts, expiry, and what each processor makes of hostile orders."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from sievelight.operators.ingest import gate
from sievelight.plans import rules
from sievelight.streaming import keyed

DAY = 86_400_000


def _captures(spark, rows):
    df = spark.createDataFrame([(u, k, ms + 1_700_000_000_000, i) for u, k, ms, i in rows], "user_id long, k long, ms long, event_id long")
    return df.withColumn("at", F.timestamp_millis("ms"))


def _plain_intake(rows, rate, window, horizon):
    out, last, frames = [], {}, {}
    for u, k, ms, i in sorted(rows, key=lambda r: (r[2], r[3])):
        fresh = (u, k) not in last or ms - last[u, k] >= horizon
        last[u, k] = ms
        if fresh:
            (ok,), frames[u] = gate([ms], frames.get(u), rate, window)
            if ok:
                out.append(i)
    return sorted(out)


@pytest.mark.parametrize("files", [1, 3])
def test_intake_does_not_depend_on_files(spark, files):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), rnd.randrange(25), rnd.randrange(40 * DAY), i) for i in range(400)]
    got = keyed.taken_in(_captures(spark, rows), spark.createDataFrame([(3,), (3,), (4,)], "k long"), files, 2, DAY, 5 * DAY)
    want = _plain_intake(rows, 2, DAY, 5 * DAY)
    assert 0 < len(want) < 300 and sorted(r.event_id for r in got.collect()) == want
    assert {(r.k in (3, 4), r.status) for r in got.collect()} == {(True, "known"), (False, "queued")}


def test_six_captures_in_three_files_at_a_rate_of_two(spark):
    rows = [(1, k, ms, i) for i, (k, ms) in enumerate([(7, 0), (8, 10), (7, 1_000), (9, 1_010), (7, 2_000), (5, 2_010)])]
    for files in (1, 3):
        got = keyed.taken_in(_captures(spark, rows), spark.createDataFrame([], "k long"), files, 2, 60_000)
        assert sorted(r.event_id for r in got.collect()) == [0, 1]


def test_state_expires(spark):
    """A silent frame and a fingerprint that is not seen for the horizon are taken anew, in whatever file they come."""
    rows = [(1, 7, 0, 0), (1, 8, DAY, 1), (1, 7, 3 * DAY, 2), (2, 1, 0, 3), (2, 1, 30 * DAY, 4), (1, 8, 30 * DAY, 5), (1, 8, 30 * DAY + 1, 6)]
    for files in (1, 3, 6):
        got = keyed.taken_in(_captures(spark, rows), spark.createDataFrame([], "k long"), files, 60, DAY, 2 * DAY)
        assert sorted(r.event_id for r in got.collect()) == [0, 1, 2, 3, 4, 5]


def test_no_rows(spark):
    assert keyed.taken_in(_captures(spark, []), spark.createDataFrame([], "k long"), 3, 2, DAY).count() == 0


@pytest.mark.parametrize("files", [1, 2])
def test_alert_is_silent_after_199_and_fires_after_201(spark, files):
    def run(between):
        keys = ["a", *[f"x{i}" for i in range(between)], "a"]
        rows = [(1, i, i, k, "high", 1) for i, k in enumerate(keys)] + [(1, 10_000, 10_000, "quiet", "medium", 1), (2, 10_001, 10_001, "a", "critical", None)]
        df = spark.createDataFrame(rows, "viewer long, id long, ms long, origin string, level string, hash long")
        return sorted((r.viewer, r.id) for r in keyed.alerted(df, files).collect())
    assert run(199) == [*((1, i) for i in range(200)), (2, 10_001)]
    assert run(201) == [*((1, i) for i in range(203)), (2, 10_001)]


REPORT = ("k long, context long, at long, id long, kind string, observed_ms long, longest_call_ms long, wasm_time_ms long, call_count long, drift_ms double, "
          "worker_count long, socket_count long, socket_messages long, hardware_concurrency long, timing_stopped boolean")


def _plain_scorings(rows, cuts):
    """A fold of everything after each file, scored where it is worth it."""
    last, scored, out = {}, {}, []
    for f in range(len(cuts) + 1):
        now = [r for r in rows if (f == 0 or r[2] >= cuts[f - 1]) and (f == len(cuts) or r[2] < cuts[f])]
        for r in now:
            if (r[0], r[1]) not in last or (r[2], r[3]) > (last[r[0], r[1]][2:4]):
                last[r[0], r[1]] = r
        for k in sorted({r[0] for r in now}):
            mine = [r for (m, _), r in last.items() if m == k]
            share = sum(int(min(r[7] / r[5], 1.0) * keyed.UNIT + 0.5) for r in mine)
            fold = (len(mine), share, max(r[5] for r in mine))
            if k not in scored or fold[0] != scored[k][0] or abs(share - scored[k][1]) * 10 >= keyed.UNIT or scored[k][2] < 20_000 <= fold[2]:
                scored[k] = fold
                kinds = sorted({r[4] for r in mine})
                out.append((k, *fold, sum(r[7] for r in mine), max(r[6] for r in mine), max(r[12] for r in mine), kinds, any(r[14] for r in mine), round(sum(r[9] for r in mine) / len(mine), 6)))
    return sorted(out)


def test_evidence_is_what_a_recomputation_gives(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(6), rnd.randrange(8), t, t, rnd.choice(["page", "worker"]), rnd.choice([5_000, 19_999, 20_000, 30_000]), rnd.randrange(900), rnd.randrange(4_000), 1,
             rnd.random() * 400, rnd.randrange(4), rnd.randrange(2), rnd.randrange(20), 8, rnd.random() < 0.2) for t in range(160)]
    df = spark.createDataFrame(rows, REPORT)
    got = keyed.in_files(df, "at", 4, lambda s, target, check: keyed.drained(keyed.evidence(s), target, check)).collect()
    cuts = [159 * i // 4 for i in (1, 2, 3)]
    mine = sorted((r.k, r.context_count, round(r.cpu_share * keyed.UNIT), r.observed_ms, r.wasm_time_ms, r.longest_call_ms, r.socket_messages, list(r.contexts), r.timing_stopped, round(r.mean_drift_ms, 6)) for r in got)
    want = _plain_scorings(rows, cuts)
    assert mine == want and len(want) < 24


def test_level_moves_with_evidence(spark):
    """A module with a kernel is rated anew when it is seen to run flat out."""
    rep = lambda k, c, at, observed, t: (k, c, at, at, "page", observed, 10, t, 1, 0.0, 0, 0, 0, 8, False)
    rows = [rep(1, 1, 0, 10_000, 9_000), rep(2, 1, 0, 10_000, 10), rep(1, 1, 100, 30_000, 29_000), rep(2, 1, 100, 15_000, 20), rep(2, 1, 101, 15_000, 30)]
    lit = F.lit
    kernel = F.from_json(lit('{"bitwise_ratio":0.4,"largest_loop":400,"order":-3,"arithmetic_ratio":0.6,"call_ratio":0.0,"func_idx":3}'),
                         "struct<bitwise_ratio:double,largest_loop:bigint,order:bigint,arithmetic_ratio:double,call_ratio:double,func_idx:bigint>")
    none = F.array().cast("array<string>")
    columns = {c: lit(0).cast("long") for c in ("instruction_count", "n_atomic", "export_count", "data_bytes", "byte_length", "memory_initial_pages", "memory_grow_sites", "memory_max_pages",
                                                "total_loops", "truncated_functions", "skipped")}
    features = spark.range(1, 3).select(F.col("id").alias("k"), kernel.alias("kernel"), *[none.alias(c) for c in ("import_names", "export_names", "custom_names")],
        *[v.alias(c) for c, v in columns.items()], *[lit(0.0).alias(c) for c in ("bitwise_ratio", "float_ratio")], *[lit(False).alias(c) for c in ("memory_shared", "stripped")])
    got = keyed.with_level_before(keyed.rescored(spark.createDataFrame(rows, REPORT), features, 2), "k", "epoch").collect()
    level = {(r.epoch, r.k): (r.before, r.level) for r in got}
    assert level[0, 1] == (None, "medium") and level[1, 1] == ("medium", "high") and (1, 2) not in level
    assert rules.LEVELS.index(level[1, 1][1]) > rules.LEVELS.index(level[0, 1][1])


def test_features_do_not_pass_the_driver(spark):
    batch, features = spark.range(3).withColumnRenamed("id", "k").localCheckpoint(), spark.range(5).withColumnRenamed("id", "k")
    joined = keyed._with_features(batch, features)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 3


def test_only_reported_modules_are_decoded(spark):
    from sievelight.queries import modules

    sf = "/root/testdata/sf0.001"
    asked = spark.createDataFrame([(4,), (7,), (10**9,)], "k long")
    assert sorted(r.hash for r in modules.part_modules(spark, sf, asked).collect()) == ["4", "7"]


def test_store_of_the_session_is_put_back(spark):
    before = spark.conf.get(keyed.PROVIDER)
    test_no_rows(spark)
    assert spark.conf.get(keyed.PROVIDER) == before


def test_gate_by_hand():
    rows = [(1, i, t, i) for i, t in enumerate([0, 10, 20, 60_000, 60_001, 60_002, 125_000])]
    assert collections.Counter(_plain_intake(rows, 2, 60_000, DAY)) == collections.Counter([0, 1, 3, 4, 6])
