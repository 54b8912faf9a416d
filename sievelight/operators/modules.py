"""Compiled modules: decode once to a nested row, then every measurement is a native expression over it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import wasm

_LIMITS = "struct<min:bigint,max:bigint,shared:boolean>"
_LOOPS = "array<struct<header:bigint,end:bigint,depth:bigint,size:bigint>>"
_FUNCTION = (
    "struct<func_idx:bigint,type_idx:bigint,locals:bigint,n:bigint,cats:array<bigint>,indirect:bigint,truncated:string,"
    f"loops:{_LOOPS},blocks:bigint,edges:bigint,back_edges:bigint,max_nesting:bigint,approximate:boolean,"
    "listing:array<struct<name:string,operands:string,depth:int>>>")
DECODED = (
    "hash string, ok boolean, reason string, byte_length bigint, version bigint, "
    "types array<struct<params:array<string>,results:array<string>>>, "
    f"imports array<struct<module:string,name:string,kind:string,type_idx:bigint,limits:{_LIMITS},val_type:string,mutable:boolean>>, "
    f"exports array<struct<name:string,kind:string,index:bigint>>, tables array<struct<ref_type:string,limits:{_LIMITS}>>, "
    f"memories array<{_LIMITS}>, globals array<struct<val_type:string,mutable:boolean>>, customs array<string>, "
    "data_segments bigint, data_bytes bigint, elements bigint, start bigint, function_count bigint, skipped bigint, "
    f"ops map<string,bigint>, warnings array<string>, functions array<{_FUNCTION}>")

CATEGORIES = wasm.CATEGORIES
KERNEL_LOOP, KERNEL_CALLS = 40, 0.02
#: What a task holds before it passes modules on, in listed instructions (a module or a function weighs as much as six): of
#: modules that differ, as Python objects, and of all, as Arrow columns.
HELD_APART, HELD = 60_000, 600_000


def _arrow(fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(fields))


def _repeated(rows: list[dict], taken: list[int], hashes: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as often and in the order as they are taken, each under a hash of its own."""
    b = pa.RecordBatch.from_pylist(rows, schema=schema).take(pa.array(taken, pa.int32()))
    return b.set_column(schema.get_field_index("hash"), schema.field("hash"), pa.array(hashes, pa.string()))


def _decoding(budget: int, listings: bool):
    """Batches of (hash, bytes) to decoded rows; of equal contents in a batch one is decoded."""
    schema = _arrow(DECODED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, rows, weights = {}, [], []  # of contents that differ
            hashes, taken, held = [], [], 0
            for h, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data not in place:
                    place[data] = len(rows)
                    row = wasm.parse(data, budget, listings) | {"hash": None}
                    row["ops"] = list(row["ops"].items())
                    rows.append({n: row[n] for n in schema.names})
                    weights.append(6 + sum(6 + len(f["listing"] or ()) for f in row["functions"]))
                hashes.append(h)
                taken.append(place[data])
                held += weights[place[data]]
                if held >= HELD or (place[data] == len(rows) - 1 and sum(weights) >= HELD_APART):
                    yield _repeated(rows, taken, hashes, schema)
                    place, rows, weights = {}, [], []
                    hashes, taken, held = [], [], 0
            if taken:
                yield _repeated(rows, taken, hashes, schema)
    return run


def decode(blobs: DataFrame, budget: int = wasm.MAX_INSTRUCTIONS, listings: bool = False, key: str = "hash", content: str = "bytes") -> DataFrame:
    """(hash, bytes) to one nested row a module. Put filters on metadata before this: it is the only Python step.
    Never fails on a bad input (ok = false and a reason). `functions` has every function within the budget, `ops` counts
    the opcodes of them all. `listings` keeps names, operands and depths in order. Equal contents of a batch are decoded once."""
    return blobs.select(F.col(key).cast("string").alias("hash"), F.col(content).alias("bytes")).mapInArrow(_decoding(budget, listings), DECODED)


def category(name: Column) -> Column:
    """The category of an opcode's name; the rule is `wasm.category`, for names that the decoder does not know too."""
    op = F.split_part(name, F.lit("."), F.lit(2))
    starts = lambda *p: reduce(lambda a, b: a | b, [name.startswith(x) for x in p])
    return (F.when(starts(*wasm.VECTORS), "simd").when(name.contains("atomic"), "atomic").when(name.startswith("ref."), "reference")
            .when(name.isin("call", "call_indirect"), "call").when(starts("local.", "global."), "variable")
            .when(starts("memory.", "data.", "table.", "elem.") | name.contains(".load") | name.contains(".store"), "memory")
            .when(starts("i32.", "i64.") & op.isin(*wasm.BITWISE), "bitwise").when(starts("i32.", "i64."), "integer")
            .when(starts("f32.", "f64."), "float").when(name == "", "other").otherwise("control"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def cat(f: Column, name: str) -> Column:
    return F.get(f["cats"], F.lit(CATEGORIES.index(name)))


def largest_loop(f: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(f["loops"], lambda x: x["size"])), F.lit(0))


def is_kernel(f: Column) -> Column:
    """Whether a function is a kernel candidate: a long loop, no floats, hardly a call."""
    return (largest_loop(f) >= KERNEL_LOOP) & (cat(f, "float") == 0) & (ratio(cat(f, "call"), f["n"]) < KERNEL_CALLS)


def functions(decoded: DataFrame) -> DataFrame:
    """One row a decoded function with its conditional counts, ratios and largest loop."""
    a = decoded.select("hash", F.explode("functions").alias("f"))
    f = F.col("f")
    a = a.select("hash", "f.*", *[cat(f, c).alias(f"n_{c}") for c in CATEGORIES], largest_loop(f).alias("largest_loop"),
        f["indirect"].alias("n_indirect"))
    n = F.col("n")
    return (a.withColumn("bitwise_ratio", ratio(F.col("n_bitwise"), n)).withColumn("arithmetic_ratio",
        ratio(F.col("n_bitwise") + F.col("n_integer"), n))
            .withColumn("call_ratio", ratio(F.col("n_call"), n)))


def stored_functions(decoded: DataFrame, most: int = wasm.MAX_FUNCTIONS) -> DataFrame:
    """Rows of the functions that are stored of a module, the first `most`; totals are over all of them."""
    return functions(decoded.withColumn("functions", F.slice("functions", 1, most)))


def opcode_histogram(decoded: DataFrame) -> DataFrame:
    """(hash, name, category, n) over all functions of a module."""
    return decoded.select("hash", F.explode("ops").alias("name", "n")).withColumn("category", category(F.col("name")))


def features(decoded: DataFrame) -> DataFrame:
    """One flat row a module: counts, shares, memory facts and the kernel candidate (null: none). Everything is found inside
    the module's row: nothing is exploded, shuffled or joined."""
    fs = F.col("functions")
    total = lambda of: F.aggregate(fs, F.lit(0).cast("long"), lambda m, f: m + of(f))
    a = decoded.filter("ok").withColumn("_cats", F.aggregate(
        fs, F.array_repeat(F.lit(0).cast("long"), len(CATEGORIES)), lambda m, f: F.zip_with(m, f["cats"], lambda x, y: x + y)))
    n = F.col("instruction_count")
    kernels = F.transform(F.filter(fs, is_kernel), lambda f: F.struct(
        ratio(cat(f, "bitwise"), f["n"]).alias("bitwise_ratio"), largest_loop(f).alias("largest_loop"), (-f["func_idx"]).alias("order"),
        ratio(cat(f, "bitwise") + cat(f, "integer"), f["n"]).alias("arithmetic_ratio"),
        ratio(cat(f, "call"), f["n"]).alias("call_ratio"), f["func_idx"].alias("func_idx")))
    own = F.coalesce(F.get("memories", 0), F.get(F.filter("imports", lambda i: i["kind"] == "memory"), 0)["limits"])
    a = a.select(
        "hash", "byte_length", "function_count", "skipped", "data_bytes", "ops", "warnings",
        F.transform("imports", lambda i: F.concat(i["module"], F.lit("."), i["name"])).alias("import_names"),
        F.transform("exports", lambda e: e["name"]).alias("export_names"), F.col("customs").alias("custom_names"),
        F.size("exports").cast("long").alias("export_count"),
        F.size(F.filter("imports", lambda i: i["kind"] == "func")).cast("long").alias("imported_functions"),
        F.coalesce(own["min"], F.lit(0)).alias("memory_initial_pages"), own["max"].alias("memory_max_pages"),
        F.coalesce(own["shared"], F.lit(False)).alias("memory_shared"),
        (~F.array_contains("customs", "name")).alias("stripped"), total(lambda f: f["n"]).alias("instruction_count"),
        F.size(fs).cast("long").alias("decoded_functions"),
        F.size(F.filter(fs, lambda f: f["truncated"].isNotNull())).cast("long").alias("truncated_functions"),
        *[F.get("_cats", i).alias(f"n_{c}") for i, c in enumerate(CATEGORIES)], total(lambda f: f["indirect"]).alias("indirect_calls"),
        F.coalesce(F.try_element_at("ops", F.lit("memory.grow")), F.lit(0)).alias("memory_grow_sites"),
        total(lambda f: F.size(f["loops"]).cast("long")).alias("total_loops"),
        total(lambda f: f["back_edges"]).alias("total_back_edges"), F.coalesce(F.array_max(F.transform(fs, lambda f: f["max_nesting"])),
            F.lit(0)).alias("max_nesting"),
        F.array_max(kernels).alias("kernel"))
    # a one-row generator: the optimizer would copy these folds into every rule that reads them
    a = a.select(F.inline(F.array(F.struct(*a.columns))))
    a = a.withColumn("bitwise_ratio", ratio(F.col("n_bitwise"), n)).withColumn("float_ratio", ratio(F.col("n_float"), n))
    return a.withColumn("coverage", F.when(F.col("function_count") == 0, 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio(F.col("truncated_functions") + F.col("skipped"), F.col("function_count"))))))


def threshold_probe(fn: DataFrame, top: int = 6) -> DataFrame:
    """Functions with a loop of 40 or more and 15% bitwise, the densest of each module."""
    w = Window.partitionBy("hash").orderBy(F.desc("bitwise_ratio"), "func_idx")
    return fn.filter("largest_loop >= 40 and bitwise_ratio >= 0.15").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def summary(f: DataFrame) -> DataFrame:
    """What is stored of a module: names cut to 40, warnings to 10."""
    return f.select("hash", "byte_length", "instruction_count", "function_count", "decoded_functions", "truncated_functions", "skipped",
        "imported_functions", "export_count",
                    "total_loops", "max_nesting", "memory_initial_pages", "memory_max_pages", "memory_shared", "memory_grow_sites",
                    "data_bytes", "stripped",
                    F.slice("import_names", 1, 40).alias("import_names"), F.slice("export_names", 1, 40).alias("export_names"),
                    F.slice("warnings", 1, 10).alias("warnings"))


def header_text() -> Column:
    """Text form of what a module declares, over a decoded row."""
    text = lambda c: c.cast("string")
    bounds = lambda m: F.concat(text(m["min"]), F.coalesce(F.concat(F.lit(" "), text(m["max"])), F.lit("")), F.when(m["shared"], " shared").otherwise(""))
    words = lambda what, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"({what} "), F.array_join(xs, " "), F.lit(")"))).otherwise("")
    cell = lambda g: F.when(g["mutable"], F.concat(F.lit("(mut "), g["val_type"], F.lit(")"))).otherwise(g["val_type"])
    imported = lambda i: (
        F.when(i["kind"] == "func", F.concat(F.lit("(func (type $t"), text(i["type_idx"]), F.lit("))")))
        .when(i["kind"] == "memory", F.concat(F.lit("(memory "), bounds(i["limits"]), F.lit(")")))
        .when(i["kind"] == "global", F.concat(F.lit("(global "), cell(i), F.lit(")")))
        .otherwise(F.concat(F.lit("(table "), text(i["limits"]["min"]), F.lit(" "), i["val_type"], F.lit(")"))))
    lines = F.concat(
        F.array(F.lit("(module")),
        F.transform("types", lambda t, i: F.concat(F.lit("  (type $t"), text(i), F.lit(" (func "),
            F.trim(F.concat(words("param", t["params"]), F.lit(" "), words("result", t["results"]))), F.lit("))"))),
        F.transform("imports", lambda i: F.concat(F.lit('  (import "'), i["module"], F.lit('" "'), i["name"], F.lit('" '), imported(i), F.lit(")"))),
        F.transform("memories", lambda m: F.concat(F.lit("  (memory "), bounds(m), F.lit(")"))),
        F.transform("globals", lambda g, i: F.concat(F.lit("  (global $g"), text(i), F.lit(" "), cell(g), F.lit(")"))),
        F.transform("exports", lambda e: F.concat(F.lit('  (export "'), e["name"], F.lit('" ('), e["kind"], F.lit(" "), text(e["index"]),
            F.lit("))"))),
        F.when(F.col("start").isNotNull(),
            F.array(F.concat(F.lit("  (start $f"), text(F.col("start")), F.lit(")")))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("  ;; "), text(F.col("function_count")), F.lit(" function bodies, "), text(F.col("data_segments")),
            F.lit(" data segments"))), F.array(F.lit(")")))
    return F.array_join(lines, "\n")


def wat_header(decoded: DataFrame) -> DataFrame:
    return decoded.filter("ok").select("hash", header_text().alias("wat"))


def _line(op: Column) -> Column:
    """Indented text of an instruction."""
    return F.concat(F.repeat(F.lit("  "), op["depth"]), op["name"], F.when(op["operands"] != "", F.concat(F.lit(" "), op["operands"])).otherwise(""))


def instructions(decoded: DataFrame) -> DataFrame:
    """On demand: one row an instruction with its depth and its indented text (decode with listings=True)."""
    a = decoded.select("hash", F.explode("functions").alias("f")).select("hash", "f.func_idx", F.posexplode("f.listing").alias("pos", "op"))
    return a.select("hash", "func_idx", "pos", "op.name", "op.operands", F.col("op.depth").cast("long").alias("depth"), _line(F.col("op")).alias("wat"))


def body_text(f: Column) -> Column:
    """The indented text of a function, built inside its module's row."""
    return F.array_join(F.transform(f["listing"], _line), "\n")


def wat_bodies(decoded: DataFrame) -> DataFrame:
    """(hash, func_idx, wat): the indented text of each function."""
    a = decoded.select("hash", F.explode("functions").alias("f")).filter(F.size("f.listing") > 0)
    return a.select("hash", "f.func_idx", body_text(F.col("f")).alias("wat"))


def ascii_runs(content: Column, least: int = 5, clip: int = 200) -> Column:
    """Printable runs of a binary column."""
    return F.transform(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"[\x20-\x7e]{{{least},}}"), F.lit(0)),
        lambda s: F.substring(s, 1, clip))
