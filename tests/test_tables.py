"""Stored tables: many batches, repeated and half-done ones, and files that stay."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sievelight.operators import store
from sievelight.sources.tables import Stored


@pytest.fixture()
def table(spark, tmp_path):
    t = Stored(f"{tmp_path}/artifacts", "hash", store.ARTIFACTS, 8)
    t.create(spark)
    return t


def _batch(spark, rows):
    return store.upsert_artifacts(spark.createDataFrame(rows, "hash long, size long, page_url string, ts long"))


def _files(table):
    return {b: sorted(f for f in os.listdir(f"{table.path}/{b}") if f.endswith(".parquet")) for b in os.listdir(table.path) if b.startswith("bucket=")}


def _rows(df):
    return sorted((r.hash, r.size, r.first_seen, r.last_seen, r.seen_count, r.last_page_url) for r in df.collect())


def test_twenty_batches_are_one_upsert(spark, table):
    rnd, every = random.Random(7), []
    for n in range(20):
        rows = [(rnd.randrange(60) if n != 5 else 3, 10, rnd.choice(["p", "q", None]), rnd.randrange(1_000)) for _ in range(12 if n != 9 else 0)]
        every += rows
        before = _files(table)
        touched = table.merge(_batch(spark, rows), n, store.artifacts_of_both)
        after = _files(table)
        assert {b for b in after if before.get(b) != after[b]} == {f"bucket={b}" for b in touched}
        assert (len(touched) == 1) if n == 5 else (touched == []) if n == 9 else True
    got = table.read(spark)
    assert _rows(got) == _rows(_batch(spark, every)) and got.count() == got.select("hash").distinct().count()
    assert got.filter("first_batch > last_batch").isEmpty()


def test_repeats_change_nothing(spark, table):
    first, second = [(1, 5, "a", 1), (2, 5, "b", 2)], [(1, 5, "c", 9), (3, 5, "d", 4)]
    for n, rows in ((0, first), (0, first), (1, second), (1, second), (0, first)):
        table.merge(_batch(spark, rows), n, store.artifacts_of_both)
    assert _rows(table.read(spark)) == [(1, 5, 1, 9, 2, "c"), (2, 5, 2, 2, 1, "b"), (3, 5, 4, 4, 1, "d")]
    assert {r.hash: (r.first_batch, r.last_batch) for r in table.read(spark).collect()} == {1: (0, 1), 2: (0, 0), 3: (1, 1)}


def test_batch_that_failed_between_two_buckets(spark, table):
    """Some keys of the batch are stored already; the whole batch comes again."""
    rows = [(i, 1, "p", i) for i in range(30)]
    table.merge(_batch(spark, rows), 0, store.artifacts_of_both)
    again = [(i, 1, "q", 100 + i) for i in range(30)]
    table.merge(_batch(spark, again).filter("hash % 3 = 0"), 1, store.artifacts_of_both)
    table.merge(_batch(spark, again), 1, store.artifacts_of_both)
    assert [r[4] for r in _rows(table.read(spark))] == [2] * 30


def test_latest_result_wins_whatever_the_order(spark, tmp_path):
    t = Stored(f"{tmp_path}/results", "hash", store.RESULTS, 4)
    t.create(spark)
    for n, rows in enumerate(([(1, 50, 1, "late"), (None, 1, 1, "no key")], [(1, 10, 2, "early"), (2, 5, 3, "x")], [(2, 5, 2, "smaller id"), (3, 1, 1, None)])):
        t.merge(spark.createDataFrame(rows, store.RESULTS), n, store.last_of_both)
    assert {r.hash: r.value for r in t.read(spark).collect()} == {1: "late", 2: "x", 3: None}


def test_empty_table(spark, table):
    assert table.read(spark).count() == 0 and table.merge(_batch(spark, []), 0, store.artifacts_of_both) == []
    assert table.read(spark).select(F.col("bucket")).count() == 0
