"""The decoder against hand-made bytes, rules against published scores, and every query against its SQL."""

import math
import os

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievelight.functions import wasm
from sievelight.operators import ingest, ml, modules, reports
from sievelight.plans import rules
from sievelight.sources import files

SF = "/root/testdata/sf0.001"


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=200, deadline=None)
def test_unsigned_numbers_round_trip(n):
    assert wasm.Bytes(wasm.uleb(n)).u32() == n


@given(st.integers(-2**31, 2**31 - 1))
@settings(max_examples=200, deadline=None)
def test_signed_numbers_round_trip(n):
    assert wasm.Bytes(wasm.sleb(n)).signed(32) == n


@given(st.binary(max_size=200))
@settings(max_examples=200, deadline=None)
def test_bad_bytes_never_raise(data):
    assert wasm.parse(wasm.MAGIC + wasm.VERSION + data)["ok"] is True
    assert wasm.parse(data)["ok"] is (data[:8] == wasm.MAGIC + wasm.VERSION)


def test_truncated_and_foreign_inputs():
    whole = wasm.parametric_module(25, True)
    assert wasm.parse(whole[:-20])["ok"] and wasm.parse(whole[:-20])["warnings"]
    assert wasm.parse(b"<html>")["reason"] == "not a WebAssembly module"
    assert wasm.parse(None)["ok"] is False and wasm.parse(whole[:6])["ok"] is False
    assert wasm.parse(whole, budget=10)["functions"][0]["truncated"] == "exceeded 10 instructions in a single function"
    long_types = bytearray(wasm.parametric_module(1, True))
    long_types[9] = 0x7F
    damaged = wasm.parse(bytes(long_types))
    assert damaged["warnings"] and damaged["types"] == []


def test_every_immediate_shape():
    ops = [b"\x0e\x01\x00\x00", b"\x1c\x01\x7f", b"\x43\0\0\x80\x3f", b"\x44" + b"\0" * 8, b"\x42\x7f", b"\xd0\x70", b"\xfc\x08\x00\x00", b"\xfd\x0c" + b"\0" * 16, b"\xfd\x15\x01",
           b"\xfd\x54\x00\x00\x01", b"\xfe\x03\x00", b"\x28\x40\x01\x02", b"\x11\x00\x00", b"\x02\x40", b"\x02\x05", b"\xfd\xff\x01", b"\xfe\x20\x02\x01"]
    got = [wasm.instruction(wasm.Bytes(o)) for o in ops]
    assert [n for n, _ in got] == ["br_table", "select", "f32.const", "f64.const", "i64.const", "ref.null", "memory.init", "v128.const", "v128.op_21", "v128.op_84", "atomic.fence", "i32.load", "call_indirect", "block", "block", "v128.op_255", "atomic.op_32"]
    assert [" ".join(a) for _, a in got] == ["0 0", "127", "1", "0", "-1", "112", "0 0", "", "1", "0 0 1", "", "64 1 2", "0 0", "64", "5", "", "2 1"]
    for o in ops:
        n, counts, _, why = wasm.scan(o, 0, len(o), 10)
        assert n == 1 and list(counts) == [wasm.instruction(wasm.Bytes(o))[0]] and why is None
        assert wasm.scan(o[:-1], 0, len(o) - 1, 10)[0] == 0
    with pytest.raises(wasm.Bad):
        wasm.instruction(wasm.Bytes(b"\xfc\x63"))


@given(st.lists(st.sampled_from([*range(0x12), 0x1C, 0x20, 0x28, 0x3F, 0x41, 0x42, 0x43, 0x44, 0x6A, 0x80, 0xD0, 0xFC, 0xFD, 0xFE, 0xFF]), max_size=60), st.integers(0, 60))
@settings(max_examples=500, deadline=None)
def test_scan_and_listing_agree(data, end):
    data, end = bytes(data), min(end, len(data))
    n, counts, control, _ = wasm.scan(data, 0, end, 50)
    names = [name for name, _ in wasm.listing(data, 0, end, 50)]
    assert n == len(names) and counts == {x: names.count(x) for x in set(names)}
    flow = wasm.control_flow(n, control)
    assert 0 <= flow["back_edges"] and flow["edges"] <= 300 and flow["blocks"] <= max(n, 0)


@pytest.mark.parametrize(("x", "text"), [(0.1, "0.1"), (-0.0, "0"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (1e-6, "0.000001"), (123456789012345680000.0, "123456789012345680000"), (-2.5e-5, "-0.000025"), (3.0, "3"), (5e-324, "5e-324"), (100.0, "100"), (1234.5, "1234.5")])
def test_numbers_as_scripts_write_them(x, text):
    assert wasm.number(x) == text


def test_categories_of_names_and_columns_agree(spark):
    from pyspark.sql import functions as F

    names = sorted({n for n, _ in wasm.OPCODES.values()} | {*wasm._BULK, *wasm._SIMD.values(), *wasm._ATOMIC.values(), "v128.op_9", "atomic.op_9", ""})
    got = {r.name: r.c for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", modules.category(F.col("name")).alias("c")).collect()}
    assert got == {n: wasm.category(n) for n in names}


@pytest.mark.parametrize(("rounds", "shared", "score"), [(1, True, 30), (1, False, 14), (6, True, 30), (7, True, 46), (7, False, 31), (25, True, 63), (25, False, 51), (31, True, 65), (32, True, 79), (32, False, 72), (50, True, 82), (50, False, 76)])
def test_published_scores(spark, rounds, shared, score):
    df = spark.createDataFrame([("h", wasm.parametric_module(rounds, shared))], "hash string, bytes binary")
    assert rules.assess(modules.features(modules.decode(df)), rules.module_rules()).first().score == score


def test_rule_counts():
    every = rules.module_rules() + rules.runtime_rules() + rules.model_rules() + rules.script_rules() + rules.supply_chain_rules()
    assert len(every) == 25 and len({r.id for r in every}) == 25 and len(ml.FEATURE_NAMES) == 73


@pytest.mark.parametrize(("buckets", "times", "want"), [(4, (-299999, -149999, -1, -1), [1, 0, 1, 2]), (5, (-300000,), [1, 0, 0, 0, 0]), (5, (0,), [0, 0, 0, 0, 1]), (3, (-300001,), [0, 0, 0]), (3, (40,), [0, 0, 1])])
def test_histogram_edges(spark, buckets, times, want):
    df = spark.createDataFrame([(telemetry_now() + t,) for t in times], "ms long")
    assert [r.n for r in reports.histogram(df, "ms", telemetry_now(), 300_000, buckets).orderBy("bucket").collect()] == want


def telemetry_now():
    return 1_700_000_000_000


def test_gate_restarts_at_an_event():
    assert ingest.gate([0, 10, 20, 60_000, 60_001], None, 2, 60_000)[0] == [True, True, False, True, True]


def test_base64_without_padding(spark):
    df = spark.createDataFrame([("QUI",), ("QUI=",), ("Q!I",)], "t string").select(ingest.from_base64(F.col("t")).alias("b"))
    assert [bytes(r.b) if r.b is not None else None for r in df.collect()] == [b"AB", b"AB", None]


def test_auc_ties_and_one_class(spark):
    one = lambda rows: ml.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first().auc
    assert one([(0.1, 0), (0.9, 1)]) == 1 and one([(0.5, 0), (0.5, 1)]) == 0.5 and one([(0.5, 1)]) == 0.5


def test_training_learns_and_refuses(spark, tmp_path):
    rows = [([float(i % 7), float(i % 2)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vector array<double>, label int")
    model = ml.train(df, ["a", "b"], epochs=60)
    assert model["losses"][-1] < model["losses"][0] / 2
    right = ml.predict(df, model).filter((F.col("probability") >= 0.5) == (F.col("label") == 1)).count()
    assert right == 60
    files.write_model(spark, model, str(tmp_path / "model"))
    assert files.read_model(spark, str(tmp_path / "model")) == model
    assert files.read_model_or_none(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        ml.train(df.filter("label = 1"), ["a", "b"])
    with pytest.raises(ValueError):
        ml.check_model(model | {"bias": math.nan})


def test_sequences_come_back_first_row_first(spark, tmp_path):
    path = str(tmp_path / "seq")
    rows = [("a", [2, 6], 0, "z", True, 2), ("a", [2, 7], 1, "b", False, 2), ("b", [2], 1, "c", False, 1)]
    df = spark.createDataFrame(rows, "sha256 string, tokens array<int>, label int, source string, kernel boolean, real_tokens long").coalesce(1)
    files.write_sequences(df, path)
    assert sorted((r.sha256, r.source) for r in files.read_sequences(spark, path).collect()) == [("a", "z"), ("b", "c")]
    files.write_sequences(df.withColumn("label", F.lit(2)), path)
    with pytest.raises(ValueError, match="label"):
        files.read_sequences(spark, path)
    files._write_text(spark, f"{path}.vocab", '{"tokens": ["x"]}')
    with pytest.raises(ValueError, match="token table"):
        files.read_sequences(spark, path)


def test_evidence_is_written_by_name(spark, tmp_path):
    path = str(tmp_path / "evidence")
    files.write_evidence(spark.createDataFrame([("m1", 3), ("m2", 4)], "name string, score int"), path, "name")
    got = spark.read.text(path)
    assert sorted((r.name, r.value) for r in got.collect()) == [("m1", '{"name":"m1","score":3}'), ("m2", '{"name":"m2","score":4}')]


def test_first_script_of_a_tab(spark):
    rows = [(1, "u", 5, 2, "late"), (1, "u", 5, 1, "first"), (2, "u", 9, 3, "other")]
    got = ingest.external_scripts(spark.createDataFrame(rows, "tab_id long, url string, ts long, id long, what string"))
    assert sorted((r.tab_id, r.what) for r in got.collect()) == [(1, "first"), (2, "other")]


def test_rate_limit_goes_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f, i * 10, i) for f in (None, 1, 2) for i in range(50)]
        got = ingest.rate_limited(spark.createDataFrame(rows, "f long, ms long, i long"), "f", "ms", "i", 3, 100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 150 and all(r.allowed == (r.i % 10 < 3) for r in got)


def test_upserts_of_a_stream_do_not_depend_on_repeats(spark, tmp_path):
    from sievelight.streaming import flows

    for _ in range(2):
        flows.merged(flows.events(spark, SF), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/t")
    assert got.count() == got.select("hash").distinct().count() > 0


def test_pairs_of_blocks_are_all_pairs(spark):
    import numpy as np

    from sievelight.operators import pairs

    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 4))
    x[5] = x[6] = 0
    size = rng.integers(1, 400, 160)
    df = spark.createDataFrame([(f"n{i:03d}", int(s), v.tolist()) for i, (s, v) in enumerate(zip(size, x))], "name string, size long, v array<double>")
    got = {(r.a, r.c) for r in pairs.similar_pairs(df, "name", "size", "v", 0.7, block=16).collect()}
    want = set()
    for i in range(160):
        for j in range(i + 1, 160):
            n = np.linalg.norm(x[i]) * np.linalg.norm(x[j])
            c = x[i] @ x[j] / n if n else float(not x[i].any() and not x[j].any())
            if c >= 0.7 and size[j] >= size[i] / 3 and size[j] < size[i] * 3 + 1:
                want.add((f"n{i:03d}", f"n{j:03d}"))
    assert got == want and len(want) > 300


def test_fingerprints_of_a_batch():
    def one(d):
        n, w = len(d), 4_096
        h = 0x811C9DC5
        for b in n.to_bytes(4, "little") + (d if n <= 3 * w else d[:w] + d[(n - w) // 2:(n - w) // 2 + w] + d[-w:]):
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        return f"{ingest.base36(n)}:{ingest.base36(h)}"
    import random

    rng = random.Random(2)
    some = [rng.randbytes(n) for n in (0, 1, 5, 5, 4_096, 12_288, 12_289, 50_000, 3, 700)]
    assert ingest.fingerprints(some) == [one(d) for d in some]


def test_module_files(spark, tmp_path):
    folder = tmp_path / "bad"
    files.write_modules(spark, str(folder), {"a.wasm": wasm.parametric_module(3, True), "b.txt": b"x"})
    got = files.modules(spark, str(folder)).collect()
    assert [(r["class"], r.name) for r in got] == [("bad", "a.wasm")] and bytes(got[0].bytes) == wasm.parametric_module(3, True)
    assert files.modules(spark, str(folder), least=10_000).count() == 0


def _rows(d: pd.DataFrame) -> list:
    cell = lambda x: None if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    return sorted((repr([cell(x) for x in r]) for r in d[sorted(d.columns)].itertuples(index=False)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


REFERENCE = [n for n in entry.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"]


@pytest.mark.parametrize("name", [n for n in REFERENCE if n in entry.oracle_sql()])
def test_query_against_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", [n for n in REFERENCE if n not in entry.oracle_sql()])
def test_query_without_sql(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_equal_contents_are_decoded_once(spark, monkeypatch):
    seen, parse = [], wasm.parse
    monkeypatch.setattr(wasm, "parse", lambda data, *more: seen.append(data) or parse(data, *more))
    a, b = wasm.parametric_module(3, False), wasm.parametric_module(50, True)
    data = [a, None, b, a, b"x", b, a, None]
    batch = pa.RecordBatch.from_pydict({"hash": pa.array([str(i) for i in range(8)]), "bytes": pa.array(data, pa.binary())})
    got = [r for out in modules._decoding(10**6, True)([batch]) for r in out.to_pylist()]
    assert seen == [a, None, b, b"x"] and [r["hash"] for r in got] == [str(i) for i in range(8)]
    assert [len(r["functions"]) for r in got] == [1, 0, 1, 1, 0, 1, 1, 0] and got[2]["functions"] == got[5]["functions"] and got[0]["ops"] == got[6]["ops"]
    # what a task holds is bounded, in modules that differ and in all
    monkeypatch.setattr(modules, "HELD", 300)
    assert [out.num_rows for out in modules._decoding(10**6, True)([batch])] == [3, 3, 2]
    monkeypatch.setattr(modules, "HELD", 10**6)
    monkeypatch.setattr(modules, "HELD_APART", 100)
    assert max(out.num_rows for out in modules._decoding(10**6, True)([batch])) < 8


def test_depths_and_bodies_need_no_shuffle(spark):
    blobs = spark.createDataFrame([("a", bytearray(wasm.shaped_module(0, 2))), ("b", bytearray(b"<html>"))], "hash string, bytes binary")
    d = modules.decode(blobs, listings=True)
    for df in (modules.instructions(d), modules.wat_bodies(d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    rows = sorted(modules.instructions(d).filter("func_idx = 0").collect(), key=lambda r: r.pos)
    assert [(r.name, r.depth) for r in rows] == [("block", 0), ("loop", 1), ("local.get", 2), ("local.get", 2), ("if", 2), ("br", 3), ("else", 2), ("br_if", 3), ("end", 2), ("end", 1),
        ("end", 0), ("local.get", 0), ("if", 0), ("nop", 1), ("end", 0), ("end", 0)]
    body = {r.func_idx: r.wat for r in modules.wat_bodies(d).collect()}
    assert body[1] == "end" and body[0].split("\n")[:3] == ["block 64", "  loop 64", "    local.get 0"]


def test_tasks_grow_with_the_table(spark, monkeypatch):
    from sievelight.queries import modules

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    monkeypatch.setattr(modules, "ROWS_A_TASK", 10)
    assert modules._spread(spark, sf).rdd.getNumPartitions() == -(-n // 10) > spark.sparkContext.defaultParallelism


def test_sequences_of_two_lengths_decode_once(spark):
    from sievelight.queries import modules as queries

    plan = queries.shape_sequences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    d = modules.decode(queries.shaped_modules(spark, "/root/testdata/sf0.001", "kernels"), listings=True)
    both = {r.hash: r.made for r in ml.sequences_of(d, 64, 40).collect()}
    for i, n in enumerate((64, 40)):
        assert {r.hash: r.tokens for r in ml.sequences(d, n).collect()} == {h: made[i].tokens for h, made in both.items()}


@pytest.mark.parametrize("query", ["rescored_on_evidence", "rescored_modules"])
def test_only_what_is_scored_again_is_decoded(spark, query):
    from sievelight import queries

    plan = queries.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("LeftSemi")


def test_equal_modules_are_made_once():
    assert wasm.parametric_module(7, True) is wasm.parametric_module(7, True) != wasm.parametric_module(7, False)
    assert wasm.shaped_module(7, 3) is wasm.shaped_module(7, 3) != wasm.shaped_module(7, 4)
