"""Queries over modules made of `part` rows: parametric ones of p_size rounds, shared where p_partkey is even, and ones of
other shapes. The SQL tells what the format's and the measurements' rules give for each shape, from its description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wasm
from ..operators import ml, modules
from ..plans import rules


ROWS_A_TASK = 20_000


def _spread(spark: SparkSession, sf_dir: str, *columns: str, keys: DataFrame | None = None) -> DataFrame:
    """Rows of `part`, dealt over all cores: the table is one small file, but its modules are large. A part of the rows is some
    ROWS_A_TASK at most, however many there are. With `keys` (k) only those."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", *columns)
    tasks = max(spark.sparkContext.defaultParallelism, -(-part.count() // ROWS_A_TASK))
    part = part if keys is None else part.join(keys, part.p_partkey == keys.k, "left_semi")
    return part.repartition(tasks, "p_partkey")


def part_modules(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """(hash, bytes): a module for each row."""
    @F.pandas_udf("binary")
    def encoded(rounds, shared):
        return rounds.combine(shared, lambda r, s: wasm.parametric_module(int(r), bool(s)))
    return _spread(spark, sf_dir, keys=keys).select(F.col("p_partkey").cast("string").alias("hash"),
        encoded("p_size", F.col("p_partkey") % 2 == 0).alias("bytes"))


def decoded(spark: SparkSession, sf_dir: str, listings: bool = False, keys: DataFrame | None = None) -> DataFrame:
    return modules.decode(part_modules(spark, sf_dir, keys), listings=listings)


def shaped_modules(spark: SparkSession, sf_dir: str, *shapes: str) -> DataFrame:
    """(hash, bytes) of modules of `wasm.SHAPES`: which one the key tells, how large p_size. With `shapes` only those."""
    @F.pandas_udf("binary")
    def encoded(shape, size):
        return shape.combine(size, lambda a, b: wasm.shaped_module(int(a), int(b)))
    few = F.element_at(F.array(*[F.lit(i) for i in (0, 1, 3, 4, 5, 6, 7)]), (F.col("p_partkey") % 7 + 1).cast("int"))
    a = _spread(spark, sf_dir).withColumn("shape", F.when(F.col("p_partkey") % 400 == 2, 2).otherwise(few))
    a = a.filter(F.col("shape").isin(*[wasm.SHAPES.index(x) for x in shapes])) if shapes else a
    return a.select(F.col("p_partkey").cast("string").alias("hash"), encoded("shape", "p_size").alias("bytes"))


def features(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    return modules.features(decoded(spark, sf_dir, keys=keys))


def features_of(spark: SparkSession, sf_dir: str, changed: DataFrame) -> DataFrame:
    """Features of the modules of some hashes; no others are decoded."""
    return features(spark, sf_dir, changed.select(F.col("hash").cast("long").alias("k")))


def assessed(spark: SparkSession, sf_dir: str, with_evidence: bool = False) -> DataFrame:
    return rules.assess(features(spark, sf_dir), rules.module_rules(), with_evidence)


def module_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("hash"), "p_brand", "p_partkey")
    a = assessed(spark, sf_dir).select("hash", "score", "level", "headline").join(part, "hash")
    return rules.page_scorecard(a, "p_brand", "p_partkey").select("p_brand", "level", "max_score", "modules", "unanalysed", "headline")


def module_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select(F.col("hash").cast("long").alias("p_partkey"), "instruction_count", "n_bitwise", "n_integer",
        "n_atomic", "n_float", "n_call", "total_loops", "total_back_edges",
                                          "max_nesting", "memory_initial_pages", "memory_max_pages", "memory_shared", "memory_grow_sites",
                                          "export_count", "imported_functions", "function_count", "coverage", "stripped")


def module_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("kernel")
    return features(spark, sf_dir).filter(k.isNotNull()).select(F.col("hash").cast("long").alias("p_partkey"),
        k["func_idx"].alias("func_idx"), k["largest_loop"].alias("loop_size"),
                                                                rules.half_up(k["bitwise_ratio"], 6).alias("bitwise_ratio"),
                                                                rules.half_up(k["arithmetic_ratio"], 6).alias("arithmetic_ratio"))


def module_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir).select(F.col("hash").cast("long").alias("p_partkey"), F.posexplode("findings").alias("place", "f"))
    return a.select("p_partkey", F.col("place").cast("long").alias("place"), "f.id", "f.weight", "f.confidence")


def module_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select(F.col("hash").cast("long").alias("p_partkey"), "score", "level", "headline")


def opcode_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = modules.opcode_histogram(decoded(spark, sf_dir)).groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("modules"))
    return a.select("name", modules.category(F.col("name")).alias("category"), "n", "modules")  # of names, not of modules' names


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select(F.col("hash").cast("long").alias("p_partkey"),
        *[F.col(f"n_{c}").alias(f"cat_{c}") for c in modules.CATEGORIES])


def threshold_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.threshold_probe(modules.functions(decoded(spark, sf_dir))).select(F.col("hash").cast("long").alias("p_partkey"),
        "func_idx", "largest_loop", F.col("rank").cast("long").alias("rank"))


def instruction_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running total in SQL: modules of a brand share a budget of 10,000 instructions, in order of their keys."""
    from pyspark.sql.window import Window

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("hash"), "p_brand", "p_partkey")
    a = features(spark, sf_dir).select("hash", "instruction_count").join(part, "hash")
    before = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("used", F.coalesce(F.sum("instruction_count").over(before), F.lit(0)))
    return a.groupBy("p_brand").agg(F.count_if(F.col("used") < 10000).alias("decoded"), F.count_if(F.col("used") >= 10000).alias("skipped"))


def wat_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.wat_header(decoded(spark, sf_dir)).select(F.col("hash").cast("long").alias("p_partkey"), "wat")


def instruction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = decoded(spark, sf_dir, listings=True)
    return modules.instructions(few).groupBy(F.col("hash").cast("long").alias("p_partkey")).agg(F.count("*").alias("instructions"),
        F.max("depth").cast("long").alias("deepest"), F.count_if(F.col("name") == "end").alias("ends"))


def module_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = modules.summary(features(spark, sf_dir))
    return s.select(F.col("hash").cast("long").alias("p_partkey"), "instruction_count", "decoded_functions", "truncated_functions",
        F.array_join("import_names", ",").alias("imports"), F.array_join("export_names", ",").alias("exports"))


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ml.vectorise(features(spark, sf_dir))
    at = lambda i: rules.half_up(F.get("vector", i), 6)
    return v.select(F.col("hash").cast("long").alias("p_partkey"), F.size("vector").cast("long").alias("columns"), at(1).alias("log_instructions"),
        at(6).alias("bitwise_ratio"), at(35 + 5).alias("xor_share"), at(29).alias("coverage"))


def opcode_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ml.sequences(decoded(spark, sf_dir, listings=True))
    return s.select(F.col("hash").cast("long").alias("p_partkey"), F.size("tokens").cast("long").alias("length"), "real_tokens",
        F.size(F.filter("tokens", lambda t: t == ml.token_id("i32.rotl"))).cast("long").alias("rotl"),
                    F.size(F.filter("tokens", lambda t: t == 4)).cast("long").alias("others"))


def shape_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of modules of several functions, in full and where only 40 have room."""
    d = modules.decode(shaped_modules(spark, sf_dir, "nested", "kernels", "many"), listings=True)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    both = ml.sequences_of(d, ml.SEQUENCE_LENGTH, 40)
    whole, short = F.get("made", 0), F.get("made", 1)
    return both.select(F.col("hash").cast("long").alias("p_partkey"), text(whole["tokens"]).alias("tokens"), whole["real_tokens"].alias("real_tokens"),
        text(short["tokens"]).alias("short"))


def shape_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 73 columns of modules of several shapes."""
    v = ml.vectorise(modules.features(modules.decode(shaped_modules(spark, sf_dir, "nested", "kernels", "many", "broken", "declared"))))
    z = v.select(F.col("hash").cast("long").alias("p_partkey"), F.posexplode("vector").alias("i", "v"))
    return z.select("p_partkey", F.get(F.array(*map(F.lit, ml.FEATURE_NAMES)), F.col("i")).alias("name"), rules.half_up(F.col("v"), 6).alias("value"))


def module_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = modules.decode(shaped_modules(spark, sf_dir))
    f = modules.features(d)
    k = F.col("kernel")
    return f.select(F.col("hash").cast("long").alias("p_partkey"), "function_count", "decoded_functions", "truncated_functions",
        "instruction_count", "total_loops", "total_back_edges", "max_nesting", "memory_initial_pages", "memory_grow_sites", "data_bytes",
                    "export_count", "imported_functions", "stripped", "coverage", F.size("warnings").cast("long").alias("warnings"),
                    *[f"n_{c}" for c in ("control", "call", "variable", "integer", "bitwise", "float", "atomic", "memory")],
                    k["func_idx"].alias("kernel"), k["largest_loop"].alias("kernel_loop"))


def shape_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = modules.functions(modules.decode(shaped_modules(spark, sf_dir, "nested", "table", "broken", "kernels")))
    return a.select(F.col("hash").cast("long").alias("p_partkey"), "func_idx", "n", "locals", "blocks", "edges", "back_edges",
        "max_nesting", "largest_loop", "approximate", F.col("truncated").isNotNull().alias("cut"),
                    F.get("loops", 0)["header"].alias("header"), F.get("loops", 0)["depth"].alias("depth"))


def stored_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = modules.decode(shaped_modules(spark, sf_dir, "many"))
    return modules.stored_functions(a).groupBy(F.col("hash").cast("long").alias("p_partkey")).agg(F.count("*").alias("functions"),
        F.max("func_idx").alias("last"), F.sum("n").alias("instructions"))


def shape_wat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = modules.decode(shaped_modules(spark, sf_dir, "declared", "nested"), listings=True)
    first = F.get(F.filter("functions", lambda f: f["func_idx"] == 0), 0)
    a = d.filter("ok").select("hash", modules.header_text().alias("header"), first.alias("f")).filter(F.size("f.listing") > 0)
    return a.select(F.col("hash").cast("long").alias("p_partkey"), "header", modules.body_text(F.col("f")).alias("body"))


def shape_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = modules.features(modules.decode(shaped_modules(spark, sf_dir, "kernels"), budget=60))
    return f.select(F.col("hash").cast("long").alias("p_partkey"), "instruction_count", "decoded_functions", "truncated_functions",
        "skipped", F.round("coverage", 6).alias("coverage"))


def foreign_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.decode(shaped_modules(spark, sf_dir)).filter("not ok").select(F.col("hash").cast("long").alias("p_partkey"), "reason",
        "byte_length")


def risk_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    a = assessed(spark, sf_dir).groupBy(F.coalesce("level", F.lit("unanalysed")).alias("level")).agg(F.count("*").alias("n"))
    return a.withColumn("share", rules.half_up(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def hero_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("hash"), "p_brand")
    a = assessed(spark, sf_dir).select("hash", "score", "level").join(part, "hash")
    return a.agg(F.count_if(rules.level_rank(F.col("level")) >= 3).alias("flagged"), F.max("score").alias("peak"),
        F.count_distinct("p_brand").alias("sites"))


def findings_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.by_layer(assessed(spark, sf_dir)).select(F.col("hash").cast("long").alias("p_partkey"),
        F.col("static").alias("static_findings"), F.col("runtime").alias("runtime_findings"), F.col("model").alias("model_findings"))


def alert_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir).withColumn("origin", F.lit("site"))
    # more than are remembered: the oldest hundred count no more
    seen = spark.range(0, 300).select(F.concat_ws("|", F.lit("site"), F.lit("high"), F.col("id").cast("string")).alias("alert_key"),
        F.col("id").alias("ts"))
    return rules.alerts(a, seen).select("alert_key", "score")


def stale_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store

    a = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey",
        F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 3).alias("ruleset"), F.when(F.col("p_size") % 7 != 0, F.lit("m1")).alias("model"))
    return store.stale(a, ruleset=1, model="m1").select("p_partkey")


QUERIES = {f.__name__: f for f in (module_scorecard, module_features, module_kernels, module_findings, module_scores, opcode_histogram,
    category_counts, threshold_probe, instruction_budget, wat_header, instruction_rows,
                                   module_summary, feature_vectors, opcode_sequences, shape_sequences, shape_vectors, module_shapes, shape_functions, stored_functions,
                                   shape_wat, shape_budget, foreign_bytes, risk_breakdown, hero_figures, findings_by_layer, alert_dedupe,
                                   stale_hashes)}

_M = """WITH m AS (SELECT p_partkey, p_brand, p_size::BIGINT AS r, p_partkey % 2 = 0 AS shared, 6 * p_size::BIGINT + 11 AS n, 6 * p_size::BIGINT + 5 AS loop FROM part),
b AS (SELECT *, r >= 6 AS kernel, 2.0::DOUBLE * r / n AS bw, (3.0::DOUBLE * r + 3) / n AS ar FROM m),
k AS (SELECT *, kernel AND bw >= 0.22 AND ar >= 0.45 AS hit,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, (bw - 0.22::DOUBLE) / (0.4::DOUBLE - 0.22::DOUBLE))) * 0.7::DOUBLE + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (loop - 40.0::DOUBLE) / (400.0::DOUBLE - 40.0::DOUBLE))) * 0.3::DOUBLE AS conf FROM b),
f AS (
  SELECT p_partkey, 'hash-loop-density' AS id, 22 AS weight, least(conf, 1.0) AS c, 2 AS o FROM k WHERE hit
  UNION ALL SELECT p_partkey, 'mining-corroborated', 40, least(least(conf, 1.0) * (0.6::DOUBLE + 0.2::DOUBLE * (2 + shared::INT)), 1.0), 3 FROM k WHERE hit
  UNION ALL SELECT p_partkey, 'bitwise-dominant-module', 25, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (bw - 0.12::DOUBLE) / (0.3::DOUBLE - 0.12::DOUBLE))), 4 FROM k WHERE n >= 200 AND bw >= 0.12
  UNION ALL SELECT p_partkey, 'shared-memory-parallelism', 15, 0.7, 5 FROM k WHERE shared
  UNION ALL SELECT p_partkey, 'socket-transport', 15, 0.5, 6 FROM k),
g AS (SELECT p_partkey, id, weight, o, floor(c * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS confidence FROM f WHERE c > 0),
t AS (SELECT p_partkey, sum(weight * confidence) AS raw FROM g GROUP BY p_partkey),
s AS (SELECT k.p_partkey, p_brand, floor(100 * (1 - exp(-coalesce(raw, 0) / 50.0::DOUBLE)) + 0.5)::INT AS score FROM k LEFT JOIN t USING (p_partkey)),
l AS (SELECT *, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' WHEN score >= 10 THEN 'low' ELSE 'benign' END AS level FROM s),
top AS (SELECT p_partkey, id FROM g QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY weight * confidence DESC, o) = 1),
h AS (SELECT l.*, CASE level WHEN 'benign' THEN 'Nothing unusual found. This looks like ordinary compiled code.'
   ELSE CASE level WHEN 'low' THEN 'Mostly ordinary, with one thing to note: ' WHEN 'medium' THEN 'Worth a closer look: ' ELSE 'Behaves like cryptomining code: ' END
     || CASE id WHEN 'hash-loop-density' THEN 'tight loop of integer and bitwise arithmetic' WHEN 'mining-corroborated' THEN 'compute kernel combined with mining infrastructure'
        WHEN 'bitwise-dominant-module' THEN 'module-wide instruction mix is bitwise integer work' WHEN 'shared-memory-parallelism' THEN 'shared memory with atomics, the shape of worker fan-out' ELSE 'imports a socket or message transport' END || '.' END AS headline,
   list_position(['benign', 'low', 'medium', 'high', 'critical'], level) AS rank FROM l LEFT JOIN top USING (p_partkey))
"""
# s is how often a shape's part is repeated; what each shape holds is told where it is made
_SHAPED = """WITH a AS (SELECT p_partkey, p_size::BIGINT AS s, CASE WHEN p_partkey % 400 = 2 THEN 'many'
    ELSE ['nested', 'table', 'broken', 'overlong', 'foreign', 'declared', 'kernels'][p_partkey % 7 + 1] END AS shape FROM part)
"""


def _by_shape(**values: str) -> str:
    """CASE over the shapes; 0 where none is given."""
    other = values.pop("other", "0::BIGINT")
    return "CASE shape " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


_SHAPE_COLUMNS = {
    "function_count": _by_shape(nested="2", table="1", many="2500", broken="2", overlong="1", declared="1", kernels="3"),
    "decoded_functions": _by_shape(nested="2", table="1", many="2500", broken="2", overlong="1", declared="1", kernels="3"),
    "truncated_functions": _by_shape(broken="1"),
    "instruction_count": _by_shape(nested="15 + s", table="7 + s", many="7500 + 7 * s", broken="s + 2", overlong="1", declared="8",
        kernels="171 + 13 * s"),
    "total_loops": _by_shape(nested="1", table="1", many="1", kernels="3"),
    "total_back_edges": _by_shape(nested="1", table="1"),
    "max_nesting": _by_shape(nested="3", table="2", many="1", kernels="1"),
    "memory_initial_pages": _by_shape(declared="s"), "memory_grow_sites": _by_shape(declared="1"), "data_bytes": _by_shape(declared="s + 5"),
    "export_count": _by_shape(declared="2"), "imported_functions": _by_shape(declared="1"),
    "warnings": _by_shape(broken="1", overlong="1", declared="1"),
    "stripped": "shape <> 'declared'", "coverage": "CASE WHEN shape = 'broken' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END",
    "n_control": _by_shape(nested="14", table="6 + s", many="5001 + 2 * s", broken="s + 2", overlong="1", declared="4", kernels="49 + 3 * s"),
    "n_call": _by_shape(kernels="2 + s"), "n_variable": _by_shape(nested="s + 1", table="1", many="3 * s", kernels="80 + 6 * s"),
    "n_integer": _by_shape(many="2499 + s", declared="1"), "n_bitwise": _by_shape(many="s", kernels="40 + 3 * s"),
    "n_float": _by_shape(declared="1"), "n_atomic": _by_shape(declared="1"), "n_memory": _by_shape(declared="1"),
    "kernel": "CASE WHEN shape = 'nested' AND s >= 34 OR shape = 'kernels' THEN 0::BIGINT WHEN shape = 'many' AND s >= 6 THEN 2499 END",
    "kernel_loop": "CASE WHEN shape = 'nested' AND s >= 34 THEN 6 + s WHEN shape = 'kernels' THEN 41 + 4 * s WHEN shape = 'many' AND s >= 6 THEN 7 * s + 1 END",
}
# the functions of a module in the order of its sequence, as names, and where the largest loop of the first begins
_REPEAT = lambda names, n: f"flatten(list_transform(range(0, {n}), lambda i: {names}))"
_TURN = "['local.get', 'local.get', 'i32.xor', 'drop']"
_ORDERED = _SHAPED + f""", o AS (SELECT p_partkey, shape, s,
    CASE shape WHEN 'nested' THEN ['block', 'loop'] || {_REPEAT("['local.get']", "s")} || ['if', 'br', 'else', 'br_if', 'end', 'end', 'end', 'local.get', 'if', 'nop', 'end', 'end']
        WHEN 'kernels' THEN ['loop'] || {_REPEAT(_TURN, "10 + s")} || ['end', 'end']
        ELSE ['loop'] || {_REPEAT("['local.get', 'i32.eqz', 'drop', 'local.get', 'local.get', 'i32.xor', 'drop']", "s")} || ['end', 'end'] END AS t1,
    CASE shape WHEN 'nested' THEN ['end'] WHEN 'kernels' THEN ['loop'] || {_REPEAT(_TURN, "20 + s")} || {_REPEAT("['call']", "2 + s")} || ['end', 'end'] ELSE ['i32.const', 'drop', 'end'] END AS t2,
    CASE shape WHEN 'nested' THEN NULL WHEN 'kernels' THEN ['loop'] || {_REPEAT(_TURN, "10 + s")} || ['end', 'end'] ELSE ['i32.const', 'drop', 'end'] END AS t3,
    CASE shape WHEN 'many' THEN ['i32.const', 'drop', 'end'] END AS t4, CASE shape WHEN 'nested' THEN 1 ELSE 0 END AS h1
    FROM a WHERE shape IN ('nested', 'kernels', 'many')),
i AS (SELECT p_partkey, h1, """ + ", ".join(f"list_transform(t{k}, lambda x: coalesce(list_position({ml.VOCABULARY}, x) + {len(ml.SPECIAL) - 1}, 4)::BIGINT) AS t{k}" for k in (1, 2, 3, 4)) + " FROM o)"


def _joined(length: int, name: str) -> str:
    """A sequence of so many tokens: functions one after the other, each cut to the room that is left."""
    out = f"{name}0 AS (SELECT *, [2::BIGINT] AS acc FROM i)"
    for k in (1, 2, 3, 4):
        room, head = f"({length} - len(acc) - (len(acc) > 1)::INT)", "h1" if k == 1 else "0"
        begin = f"greatest(least({head}, len(t{k}) - {room}), 0)"
        out += f""", {name}{k} AS (SELECT * EXCLUDE (acc), CASE WHEN t{k} IS NULL OR {room} <= 0 THEN acc ELSE acc || CASE WHEN len(acc) > 1 THEN [5::BIGINT] ELSE [] END
            || CASE WHEN len(t{k}) <= {room} THEN t{k} ELSE t{k}[{begin} + 1:{begin} + {room}] END END AS acc FROM {name}{k - 1})"""
    return out + f", {name} AS (SELECT p_partkey, len(acc)::BIGINT AS n, array_to_string(acc || list_transform(range(0, {length} - len(acc)), lambda i: 0::BIGINT), ' ') AS tokens FROM {name}4)"


_LEB = lambda n: f"(CASE WHEN {n} < 128 THEN 1 WHEN {n} < 16384 THEN 2 ELSE 3 END)"
_SECTION = lambda n: f"(1 + {_LEB(f'({n})')} + ({n}))"
_BODY = lambda n: f"({_LEB(f'({n})')} + ({n}))"
# bytes of a module, section by section
_BYTES = _by_shape(nested="8 + 6 + 5 + " + _SECTION("1 + " + _BODY("24 + 2 * s") + " + 3"), broken="8 + 6 + 5 + 11 + " + _SECTION("1 + " + _BODY("s + 3") + " + 4"), declared="165 + s",
    kernels="8 + 6 + 6 + " + _SECTION("1 + 2 * " + _BODY("67 + 6 * s") + " + " + _BODY("131 + 8 * s")), many="8 + 6 + 2505 + " + _SECTION("2 + 14994 + " + _BODY("7 + 10 * s")))
_OPS = {"local.get": _by_shape(nested="s + 1", many="3 * s", kernels="80 + 6 * s"), "i32.xor": _by_shape(many="s", kernels="40 + 3 * s"), "call": _by_shape(kernels="2 + s"),
    "br_if": _by_shape(nested="1"), "br": _by_shape(nested="1"), "loop": _by_shape(nested="1", many="1", kernels="3"), "block": _by_shape(nested="1"), "if": _by_shape(nested="2"),
    "memory.grow": _by_shape(declared="1")}
_KERNEL = {"kernel_bitwiseRatio": _by_shape(kernels="(10 + s)::DOUBLE / (43 + 4 * s)", many="s::DOUBLE / (7 * s + 3)", other="0.0::DOUBLE"),
    "kernel_arithmeticRatio": _by_shape(kernels="(10 + s)::DOUBLE / (43 + 4 * s)", many="2.0::DOUBLE * s / (7 * s + 3)", other="0.0::DOUBLE"),
    "kernel_callRatio": "0.0::DOUBLE", "log_kernel_loopSize": "ln(1.0::DOUBLE + coalesce(kernel_loop, 0))"}
_LN = lambda c: f"ln(1.0::DOUBLE + {c})"
_PER = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"
_VECTOR = {"log_byteLength": _LN("bytes"), "log_instructionCount": _LN("instruction_count"), "log_functionCount": _LN("function_count"), "log_importedFunctionCount": _LN("imported_functions"),
    "log_exportCount": _LN("export_count"), "exports_per_function": _PER("export_count", "function_count"), "bitwiseRatio": _PER("n_bitwise", "instruction_count"),
    "floatRatio": _PER("n_float", "instruction_count"), **{f"cat_{c}": _PER(f"n_{c}", "instruction_count") if f"n_{c}" in _SHAPE_COLUMNS else "0" for c in
        ("control", "call", "variable", "memory", "integer", "bitwise", "float", "simd", "atomic", "reference", "other")},
    "loops_per_function": _PER("total_loops", "function_count"), "backEdges_per_function": _PER("total_back_edges", "function_count"), "log_maxNesting": _LN("max_nesting"),
    "indirectCall_ratio": "0", "log_memoryInitialPages": _LN("memory_initial_pages"), "memory_bounded": "0", "memoryShared": "0", "log_memoryGrowSites": _LN("memory_grow_sites"),
    "dataSection_share": _PER("data_bytes", "bytes"), "stripped": "stripped::INT", "coverage": _PER("decoded_functions", "decoded_functions + truncated_functions"), "has_kernel": "(kernel IS NOT NULL)::INT", **{k: f"CASE WHEN kernel IS NULL THEN 0 ELSE {v} END" for k, v in _KERNEL.items()},
    **{f"op_{o}": _PER(f'"{o}"', "instruction_count") if o in _OPS else "0" for o in ml.VOCABULARY}}
_CATS = {"control": "4", "call": "0", "variable": "3 * r + 2", "memory": "0", "integer": "r + 3", "bitwise": "2 * r", "float": "0",
    "simd": "0", "atomic": "1", "reference": "0", "other": "0"}
ORACLE_SQL = {
    "module_scorecard": _M + """SELECT p_brand, ['benign', 'low', 'medium', 'high', 'critical'][max(rank)] AS level, max(score) AS max_score, count(*) AS modules, 0::BIGINT AS unanalysed,
        arg_max(headline, rank::BIGINT * 1000000000 - p_partkey) AS headline FROM h GROUP BY p_brand""",
    "module_features": _M + """SELECT p_partkey, n AS instruction_count, 2 * r AS n_bitwise, r + 3 AS n_integer, 1::BIGINT AS n_atomic, 0::BIGINT AS n_float, 0::BIGINT AS n_call, 1::BIGINT AS total_loops, 1::BIGINT AS total_back_edges,
        1::BIGINT AS max_nesting, 16::BIGINT AS memory_initial_pages, 32::BIGINT AS memory_max_pages, shared AS memory_shared, 0::BIGINT AS memory_grow_sites, 1::BIGINT AS export_count, 1::BIGINT AS imported_functions,
        1::BIGINT AS function_count, 1.0::DOUBLE AS coverage, true AS stripped FROM m""",
    "module_kernels": _M + "SELECT p_partkey, 0::BIGINT AS func_idx, loop AS loop_size, floor(bw * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS bitwise_ratio, floor(ar * "
        "1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS arithmetic_ratio FROM b WHERE kernel",
    "module_findings": _M + "SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY weight * confidence DESC, o) - 1 AS place, id, weight, confidence FROM g",
    "module_scores": _M + "SELECT p_partkey, score, level, headline FROM h",
    "opcode_histogram": _M + """, x AS (SELECT unnest([{'name': 'i32.const', 'category': 'integer', 'n': r + 2}, {'name': 'i32.atomic.load', 'category': 'atomic', 'n': 1}, {'name': 'drop', 'category': 'control', 'n': 1},
        {'name': 'loop', 'category': 'control', 'n': 1}, {'name': 'local.get', 'category': 'variable', 'n': 2 * r + 2}, {'name': 'i32.rotl', 'category': 'bitwise', 'n': r}, {'name': 'i32.xor', 'category': 'bitwise', 'n': r},
        {'name': 'local.set', 'category': 'variable', 'n': r}, {'name': 'i32.gt_s', 'category': 'integer', 'n': 1}, {'name': 'br_if', 'category': 'control', 'n': 1}, {'name': 'end', 'category': 'control', 'n': 2}]) AS e FROM m)
        SELECT e.name AS name, e.category AS category, sum(e.n)::BIGINT AS n, count(*) AS modules FROM x GROUP BY ALL""",
    "category_counts": _M + "SELECT p_partkey, " + ", ".join(f"({x.replace('4', '5') if c == 'control' else x})::BIGINT AS cat_{c}" for c,
        x in _CATS.items()) + " FROM m",
    "threshold_probe": _M + "SELECT p_partkey, 0::BIGINT AS func_idx, loop AS largest_loop, 1::BIGINT AS rank FROM b WHERE loop >= 40 AND bw >= 0.15",
    "instruction_budget": _M + """, u AS (SELECT p_brand, coalesce(sum(n) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m)
        SELECT p_brand, count(*) FILTER (used < 10000) AS decoded, count(*) FILTER (used >= 10000) AS skipped FROM u GROUP BY p_brand""",
    "wat_header": """SELECT p_partkey, concat_ws(chr(10), '(module', '  (type $t0 (func ))', '  (type $t1 (func (result i32)))', '  (import "pool" "websocket_send" (func (type $t0)))',
        CASE WHEN p_partkey % 2 = 0 THEN '  (memory 16 32 shared)' ELSE '  (memory 16 32)' END, '  (export "run" (func 1))', '  ;; 1 function bodies, 0 data segments', ')') AS wat FROM part""",
    "instruction_rows": _M + "SELECT p_partkey, n AS instructions, 1::BIGINT AS deepest, 2::BIGINT AS ends FROM m",
    "module_shapes": _SHAPED + "SELECT p_partkey, " + ", ".join(f"{v} AS {k}" for k,
        v in _SHAPE_COLUMNS.items()) + " FROM a WHERE shape <> 'foreign'",
    "shape_functions": _SHAPED + """
        SELECT p_partkey, 0::BIGINT AS func_idx, 14 + s AS n, 1::BIGINT AS locals, 15::BIGINT AS blocks, 17::BIGINT AS edges, 1::BIGINT AS back_edges, 3::BIGINT AS max_nesting, 6 + s AS largest_loop, false AS approximate, false AS cut, 1::BIGINT AS header, 1::BIGINT AS depth FROM a WHERE shape = 'nested'
        UNION ALL SELECT p_partkey, 1, 1, 0, 1, 0, 0, 0, 0, false, false, NULL, NULL FROM a WHERE shape = 'nested'
        UNION ALL SELECT p_partkey, 0, 7 + s, 1, 7, 7, 1, 2, 5, false, false, 0, 0 FROM a WHERE shape = 'table'
        UNION ALL SELECT p_partkey, 0, s, 0, 1, 0, 0, 0, 0, false, true, NULL, NULL FROM a WHERE shape = 'broken'
        UNION ALL SELECT p_partkey, 1, 2, 0, 2, 1, 0, 0, 0, false, false, NULL, NULL FROM a WHERE shape = 'broken'
        UNION ALL SELECT p_partkey, f, CASE WHEN f < 2 THEN 43 + 4 * s ELSE 85 + 5 * s END, 1, 4, 3, 0, 1, CASE WHEN f < 2 THEN 41 + 4 * s ELSE 83 + 5 * s END, false, false, 0, 0 FROM a, (SELECT unnest(range(3)) AS f) WHERE shape = 'kernels'""",
    "stored_functions": _SHAPED + "SELECT p_partkey, 2000::BIGINT AS functions, 1999::BIGINT AS last, 6000::BIGINT AS instructions FROM a WHERE shape = 'many'",
    "shape_wat": _SHAPED + """SELECT p_partkey, CASE shape WHEN 'nested' THEN concat_ws(chr(10), '(module', '  (type $t0 (func ))', '  ;; 2 function bodies, 0 data segments', ')')
        ELSE concat_ws(chr(10), '(module', '  (type $t0 (func (param i32 i64) (result f32)))', '  (type $t1 (func ))', '  (import "env" "f" (func (type $t1)))', '  (import "env" "t" (table 5 funcref))', '  (import "env" "g" (global (mut f64)))',
          '  (memory ' || s || ')', '  (global $g0 (mut i32))', '  (global $g1 v128)', '  (export "m" (memory 0))', '  (export "f" (func 1))', '  (start $f1)', '  ;; 1 function bodies, 1 data segments', ')') END AS header,
        CASE shape WHEN 'nested' THEN concat_ws(chr(10), 'block 64', '  loop 64', rtrim(repeat('    local.get 0' || chr(10), s::INT), chr(10)), '    if 64', '      br 1', '    else', '      br_if 2', '    end', '  end', 'end', 'local.get 0', 'if 64', '  nop', 'end', 'end')
        ELSE concat_ws(chr(10), 'f64.const 0.5', 'drop', 'i64.const -1', 'drop', 'atomic.fence', 'memory.grow 0', 'drop', 'end') END AS body FROM a WHERE shape IN ('nested', 'declared')""",
    "shape_budget": _SHAPED + """SELECT p_partkey, 60::BIGINT AS instruction_count, CASE WHEN s <= 4 THEN 2 ELSE 1 END::BIGINT AS decoded_functions, 1::BIGINT AS truncated_functions, CASE WHEN s <= 4 THEN 1 ELSE 2 END::BIGINT AS skipped,
        CASE WHEN s <= 4 THEN 0.333333::DOUBLE ELSE 0.0::DOUBLE END AS coverage FROM a WHERE shape = 'kernels'""",
    "foreign_bytes": _SHAPED + "SELECT p_partkey, 'not a WebAssembly module' AS reason, 6 + s AS byte_length FROM a WHERE shape = 'foreign'",
    "module_summary": _M + "SELECT p_partkey, n AS instruction_count, 1::BIGINT AS decoded_functions, 0::BIGINT AS truncated_functions, 'pool.websocket_send' AS imports, 'run' AS "
        "exports FROM m",
    "feature_vectors": _M + """SELECT p_partkey, 73::BIGINT AS columns, floor(ln(1.0::DOUBLE + n) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS log_instructions, floor(bw * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS bitwise_ratio,
        floor(r::DOUBLE / n * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS xor_share, 1.0::DOUBLE AS coverage FROM b""",
    "opcode_sequences": _M + """SELECT p_partkey, 512::BIGINT AS length, least(n + 1, 512) AS real_tokens, r AS rotl, least(r + 2, r + 2) + 1 + 1 + 1 + 2 AS others FROM m""",
    "shape_sequences": _ORDERED + ", " + _joined(512, "w") + ", " + _joined(40, "q")
        + " SELECT w.p_partkey, w.tokens, w.n AS real_tokens, q.tokens AS short FROM w JOIN q USING (p_partkey)",
    "shape_vectors": _SHAPED + ", b AS (SELECT p_partkey, shape, s, " + ", ".join(f'{v} AS "{k}"' for k, v in (_SHAPE_COLUMNS | _OPS).items()) + f", {_BYTES} AS bytes FROM a"
        " WHERE shape IN ('nested', 'kernels', 'many', 'broken', 'declared')), v AS (SELECT p_partkey, unnest([" + ", ".join(f"{{'name': '{k}', 'value': ({v})::DOUBLE}}" for k, v in _VECTOR.items())
        + "]) AS x FROM b) SELECT p_partkey, x.name AS name, floor(x.value * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS value FROM v",
    "risk_breakdown": _M + "SELECT level, count(*) AS n, floor(count(*)::DOUBLE / sum(count(*)) OVER () * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS share FROM h GROUP BY "
        "level",
    "hero_figures": _M + "SELECT count(*) FILTER (rank >= 3) AS flagged, max(score) AS peak, count(DISTINCT p_brand) AS sites FROM h",
    "findings_by_layer": _M + "SELECT p_partkey, count(*) AS static_findings, 0::BIGINT AS runtime_findings, 0::BIGINT AS model_findings FROM g GROUP BY p_partkey",
    "alert_dedupe": _M + "SELECT 'site|' || level || '|' || p_partkey AS alert_key, score FROM h WHERE level IN ('high', 'critical') AND NOT (level = 'high' AND p_partkey "
        "BETWEEN 100 AND 299)",
    "stale_hashes": "SELECT p_partkey FROM part WHERE (CASE WHEN p_size % 5 <> 0 THEN p_size % 3 END) IS DISTINCT FROM 1 OR (CASE WHEN p_size % 7 <> 0 THEN 'm1' END) IS "
        "DISTINCT FROM 'm1'",
}
