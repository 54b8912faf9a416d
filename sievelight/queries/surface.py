"""What findings say, every rule in a case of its own, stored results, activity reports, training sets and stream intake."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wasm
from ..operators import ingest, intake, ml, reports, runtime, store
from ..plans import rules
from ..plans.rules import half_up
from ..sources.shared import written
from . import modules, telemetry

_KERNEL = "struct<bitwise_ratio:double,largest_loop:bigint,order:bigint,arithmetic_ratio:double,call_ratio:double,func_idx:bigint>"
_RUNTIME = ("struct<observed_ms:bigint,cpu_share:double,context_count:bigint,contexts:array<string>,mean_drift_ms:double,socket_count:bigint,"
            "socket_messages:bigint,wasm_time_ms:bigint,hardware_concurrency:bigint,timing_stopped:boolean>")
CASES = 9


def _case(k: int, value, other):
    return F.when(F.col("case") == k, value).otherwise(other)


def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements in which the rules hold that no module of the other queries is a case of; which ones the key tells."""
    a = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % CASES).alias("case"))
    none, lit = F.array().cast("array<string>"), F.lit
    kernel = F.from_json(lit('{"bitwise_ratio":0.4,"largest_loop":400,"order":-3,"arithmetic_ratio":0.6,"call_ratio":0.0,"func_idx":3}'), _KERNEL)
    long_run = F.from_json(lit('{"observed_ms":30000,"cpu_share":2.0,"context_count":4,"contexts":["page","worker"],"mean_drift_ms":900.4,"socket_count":1,"socket_messages":42,"wasm_time_ms":61250,"hardware_concurrency":8,"timing_stopped":true}'), _RUNTIME)
    short_run = F.from_json(lit('{"observed_ms":5040,"cpu_share":2.0,"context_count":1,"contexts":["page"],"mean_drift_ms":0.0,"socket_count":0,"socket_messages":0,"wasm_time_ms":5000,"hardware_concurrency":8,"timing_stopped":false}'), _RUNTIME)
    a = a.withColumns({
        "import_names": _case(0, F.array(lit("env.cryptonight_hash")), none), "export_names": F.array(lit("run")), "custom_names": none,
        "kernel": F.when(F.col("case").isin(5, 8), kernel), "runtime": F.when(F.col("case") == 5, long_run).when(F.col("case") == 6, short_run),
        "instruction_count": F.when(F.col("case").isin(1, 8), lit(5000)).otherwise(lit(100)).cast("long"),
        "total_loops": _case(1, lit(2), lit(0)).cast("long"), "stripped": F.col("case") == 1,
        "memory_shared": lit(False), "n_atomic": lit(0).cast("long"), "export_count": lit(1).cast("long"), "bitwise_ratio": lit(0.0),
        "float_ratio": lit(0.0),
        "memory_initial_pages": _case(2, lit(500), lit(1)).cast("long"), "memory_max_pages": _case(2, lit(None), lit(10)).cast("long"),
        "memory_grow_sites": lit(0).cast("long"),
        "data_bytes": _case(3, lit(524_288), lit(0)).cast("long"), "byte_length": lit(600_000).cast("long"),
        "truncated_functions": _case(4, lit(2), lit(0)).cast("long"), "skipped": _case(4, lit(3), lit(0)).cast("long"),
        "probability": _case(7, lit(0.95), lit(None)),
        "drivers": F.array(F.struct(lit("op_i32.xor").alias("name"), lit(1.2345).alias("value")),
            F.struct(lit("coverage").alias("name"), lit(-0.5).alias("value")))})
    every = rules.module_rules() + rules.runtime_rules() + rules.model_rules(12, 34, F.col("drivers"))
    return rules.assess(a, every).select("p_partkey", F.explode("findings").alias("f")).select("p_partkey", "f.id", "f.confidence",
        "f.evidence", "f.reference")


def finding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = modules.assessed(spark, sf_dir, with_evidence=True).select(F.col("hash").cast("long").alias("p_partkey"), F.explode("findings").alias("f"))
    return a.select("p_partkey", "f.id", "f.evidence", "f.reference", F.length("f.summary").cast("long").alias("summary_chars"))


def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = rules.module_rules() + rules.runtime_rules() + rules.model_rules() + rules.script_rules() + rules.supply_chain_rules()
    return rules.catalogue(every, spark).groupBy("kind").agg(F.count("*").alias("rules"), F.sum("weight").alias("weights"),
        F.count("reference").alias("cited"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored result for each even part, its analysis as JSON; every tenth is damaged."""
    a = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 2 = 0")
    text = F.to_json(F.struct(F.col("p_size").cast("long").alias("instructions"),
        F.array(F.struct(F.lit("stripped-binary").alias("id"), F.lit(4).alias("weight"), F.lit(0.2).alias("confidence"))).alias("findings")))
    return a.select("p_partkey", (F.col("p_size") * 2).alias("score"),
        F.when(F.col("p_partkey") % 10 == 0, "{broken").otherwise(text).alias("analysis"))


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = store.parsed(_results(spark, sf_dir))
    return a.select("p_partkey", "score", "readable", F.col("analysis.instructions").alias("instructions"),
        F.get("analysis.findings", 0)["id"].alias("first_id"))


def known_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    return store.known(part, _results(spark, sf_dir), "p_partkey").select("p_partkey", "status", F.col("result.score").alias("score"))


def activity_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as artifacts, last seen by their price; results as analyses."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.floor(F.col("p_retailprice")).cast("long").alias("seen"))
    return reports.newest_modules(part, _results(spark, sf_dir).select("p_partkey", "score"), "seen", "p_partkey").select("p_partkey",
        "seen", "score")


def activity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id",
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ms"), "event_type")
    kinds = [r.k for r in e.agg(F.min("event_type").alias("k")).collect()]
    last = reports.last_capture(e, "ms", "event_id", "event_type", kinds[0])
    now = e.agg(F.max("ms")).first()[0]
    return last.join(F.broadcast(reports.peak(reports.histogram(e, "ms", now, 86_400_000, 24))))


def page_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("hash"), "p_brand", "p_partkey")
    return reports.badges(modules.assessed(spark, sf_dir).select("hash", "score", "level", "headline").join(part, "hash"), "p_brand", "p_partkey")


def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand: parts, those with a result, and as many blind spots as parts of size 1."""
    a = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.count("*").alias("n"),
        F.count_if(F.col("p_partkey") % 2 == 0).alias("done"), F.count_if(F.col("p_size") == 1).alias("blind"))
    return a.select("p_brand", reports.unanalysed(F.col("n"), F.col("done"), F.col("blind")).alias("unanalysed"))


def classifier_against_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether shared modules are told better by a model of a module's bitwise share and atomics, or by the rules' score at 0.5."""
    a = modules.assessed(spark, sf_dir).select("hash", (F.col("hash").cast("long") % 2).alias("label"),
        rules.unit_score(F.col("score")).alias("baseline"),
                                               F.least(F.lit(1.0), F.col("bitwise_ratio") * 2 + F.col("n_atomic") * 0.1).alias("probability"))
    a = written(a, "scores")  # read twice, decoded once
    f1 = lambda score: ml.rates(ml.confusion(a, score, "label")).select("f1")
    both = f1("probability").withColumnRenamed("f1", "model").join(F.broadcast(f1("baseline").withColumnRenamed("f1", "rules")))
    return both.select(half_up(F.col("model"), 6).alias("model_f1"), half_up(F.col("rules"), 6).alias("rules_f1"),
        ml.verdict(F.col("model"), F.col("rules")).alias("verdict"))


def sequence_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training set of parametric modules, of which many are alike, and of bytes that are no module."""
    part = modules._spread(spark, sf_dir)

    @F.pandas_udf("binary")
    def encoded(key, rounds):
        return key.combine(rounds, lambda k, r: b"<html>" if k % 11 == 0 else wasm.parametric_module(int(r), False))
    files = part.select(F.format_string("f%08d", "p_partkey").alias("name"), (F.col("p_partkey") % 2).cast("int").alias("label"),
        encoded("p_partkey", "p_size").alias("bytes"))
    return ml.sequence_job(files)[1]


def network_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as responses: every third is declared a module, every fifth has a module's path, every seventh no type."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    kind = F.when(F.col("page_id") % 7 == 0, None).when(F.col("page_id") % 3 == 0, "Application/WASM").otherwise("text/html")
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/A.WASM?x#y"))).otherwise(F.concat("url",
        F.lit("?q=.wasm")))
    return ingest.network_notes(p.select(url.alias("url"), (F.col("page_id") % 10).alias("tab_id"), F.col("page_id").alias("ts"),
        kind.alias("content_type")))


def upload_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, (200, 202, 413, 500, None))), (F.col("p_size") % 5).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(ingest.upload_outcome(status).alias("outcome")).agg(F.count("*").alias("n"))


def first_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.external_scripts(telemetry.sightings(spark, sf_dir)).select("tab_id", "url", "id")


def runtime_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a report on two modules."""
    e = telemetry.events(spark, sf_dir)
    module = lambda f, t: F.struct(f.alias("fingerprint"), t.alias("wasm_time_ms"))
    zero = F.lit(0).cast("long")
    report = F.struct(F.col("event_type").alias("context"), F.lit(30_000).alias("observed_ms"),
        F.struct(F.col("k").alias("samples"), (F.col("k") * 3).alias("late_ms")).alias("drift"), zero.alias("worker_count"),
                      zero.alias("socket_count"), zero.alias("socket_messages"), zero.alias("hardware_concurrency"),
                      F.array(module(F.col("k"), F.col("ms") % 1000), module(F.col("k") + 1000, F.lit(5).cast("long"))).alias("modules"))
    a = runtime.samples(e.select(F.col("event_id").alias("context_id"), report.alias("report")))
    return a.select(F.col("context_id").alias("event_id"), "context", "fingerprint", "wasm_time_ms", "drift_ms")


def rescored_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second module has come to run in another context."""
    f = lambda changed: modules.features_of(spark, sf_dir, changed)
    at = lambda n: spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("hash"), n.alias("context_count"), F.lit(0.5).alias("cpu_share"), F.lit(30_000).alias("observed_ms"))
    a = intake.rescored(at(1 + F.col("p_partkey") % 2), at(F.lit(1)), f, rules.module_rules(), with_evidence=False)
    return a.select(F.col("hash").cast("long").alias("p_partkey"), "score")


def report_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reports.visible(modules.assessed(spark, sf_dir))
    flags = reports.flags(F.col("memory_shared"), F.col("memory_grow_sites"), F.col("indirect_calls"), F.col("stripped"),
        F.col("truncated_functions"))
    return a.select(F.col("hash").cast("long").alias("p_partkey"), F.array_join(flags, ",").alias("flags"))


def active_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that most of a tenth's events are of, if it has over 5 more than the average."""
    e = telemetry.events(spark, sf_dir).groupBy((F.col("user_id") % 50).alias("g"), "event_type").agg(F.count("*").alias("n"))
    a = e.withColumn("o", F.conv(F.substring(F.md5("event_type"), 1, 6), 16, 10).cast("long")).withColumn("n", F.col("n") - 30)
    return reports.argmax_sticky(a, "g", "event_type", "n", "o", "none")


QUERIES = {f.__name__: f for f in (rule_cases, finding_evidence, rule_catalogue, stored_results, known_results, activity_modules,
    activity_status, page_badges, coverage_gap, classifier_against_rules, sequence_counters,
                                   network_notes, upload_outcomes, first_scripts, runtime_samples,
                                   rescored_modules, report_flags, active_types)}

_SAYS = "floor({} * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE"
_PCT = lambda x: f"printf('%.1f%%', {_SAYS.format(x)})"
_SPRING, _MINOS, _DEEP = "Silent Spring: Characterizing Cryptojacking in the Wild", "MINOS: A Lightweight Real-Time Cryptojacking Detection System", "Deep-Wasm: Detecting Malicious WebAssembly Binaries via Deep Learning"
_RUNS = "function 3 runs a 400-instruction loop that is 40.0% shifts, rotates and xors and 60.0% integer arithmetic overall, with no floating point and no calls out (compression and checksum routines also take this shape)"
_ROWS = [
    (0, "known-miner-family", 0.95, 'module references "env.cryptonight_hash"', _SPRING),
    (0, "hash-primitive-symbols", 0.4, 'symbols "env.cryptonight_hash" are hash primitives, which also appear in honest password hashing', None),
    (1, "compute-kernel-surface", 0.45, "5000 instructions and 2 loops behind only 1 exported function(s) -- the shape of a kernel rather than a library", None),
    (1, "stripped-binary", 0.2, "no name section, so function names are unavailable (normal for production builds)", None),
    (2, "aggressive-memory-growth", 0.5, "asks for 500 pages (31.3 MiB) with no declared maximum, with 0 memory.grow site(s)", None),
    (3, "large-embedded-payload", 1.0, "512 KB of the module's 586 KB is data rather than code", None),
    (4, "incomplete-coverage", 1.0, "2 function(s) could not be fully decoded and 3 were skipped for budget; findings below cover the rest", None),
    (5, "hash-loop-density", 1.0, _RUNS, _MINOS),
    (5, "sustained-execution", 1.0, "spent 61.3s executing during 30.0s of observation across 4 context(s) — 2.00 core-equivalents, and that is a floor: per-call timing was stopped to "
        "avoid becoming the cost itself", _MINOS),
    (5, "mining-runtime-corroborated", 1.0,
        _RUNS + "; it then ran for 61.3s of 30.0s (2.00 core-equivalents), with 4 contexts at once and its own timers running 900ms late and 42 messages over 1 "
            "socket(s) — compression and checksum routines do not run continuously", _MINOS),
    (5, "worker-fan-out", 0.4, "the same module is executing in 4 contexts on a 8-core machine, for 61.3s in total — the shape of claiming every core", _SPRING),
    (5, "persistent-socket-traffic", 0.45,
        "42 messages across 1 socket(s) while executing for 61.3s — a mining pool hands out work and takes back shares this way", None),
    (6, "runtime-not-yet-observed", 1.0, "watched for 5.0s so far; runtime rules need 20.0s before a busy page can be told from a mining page", None),
    (7, "classifier-opinion", 1.0, "a model trained on 12 malicious and 34 benign modules scores this 0.95, driven by op_i32.xor=1.235, coverage=-0.500 (a model's opinion, not a "
        "measurement of intent)", _DEEP),
    (8, "hash-loop-density", 1.0, _RUNS, _MINOS),
    (8, "mining-corroborated", 0.8, _RUNS + ", alongside only 1 exported function(s) over 5000 instructions", _SPRING),
]
_QUOTE = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_R = "WITH r AS (SELECT p_partkey, p_size * 2 AS score, p_size::BIGINT AS n, p_partkey % 10 <> 0 AS readable FROM part WHERE p_partkey % 2 = 0) "
_MS = "(epoch_us(ts) // 1000)::BIGINT"
ORACLE_SQL = {
    "rule_cases": f"SELECT p_partkey, v.id, v.confidence, v.evidence, v.reference FROM part JOIN (VALUES {', '.join(f'({k}, {_QUOTE(i)}, {c}::DOUBLE, {_QUOTE(e)}, {_QUOTE(r)}::VARCHAR)' for k, i, c, e, r in _ROWS)}) AS v(c, id, confidence, evidence, reference) ON p_partkey % {CASES} = v.c",
    "finding_evidence": modules._M + f""", w AS (SELECT p_partkey, 'function 0 runs a ' || loop || '-instruction loop that is ' || {_PCT('bw')} || ' shifts, rotates and xors and ' || {_PCT('ar')} || ' integer arithmetic overall, with no floating point and no calls out (compression and checksum routines also take this shape)' AS runs, n, bw, shared FROM k)
        SELECT g.p_partkey, id, CASE id WHEN 'hash-loop-density' THEN runs
          WHEN 'mining-corroborated' THEN runs || ', alongside ' || CASE WHEN shared THEN 'shared memory for worker fan-out and ' ELSE '' END || '1 atomic operations and a socket or message transport import'
          WHEN 'bitwise-dominant-module' THEN {_PCT('bw')} || ' of ' || n || ' instructions are bitwise integer operations, against 0.0% floating point (ordinary compiled code measures 3-4%)'
          WHEN 'shared-memory-parallelism' THEN 'memory is declared shared with 1 atomic operations, which lets one module saturate every core through Web Workers'
          ELSE 'imports "pool.websocket_send"; mining pools are reached over a persistent socket' END AS evidence,
        CASE id WHEN 'hash-loop-density' THEN '{_MINOS}' WHEN 'bitwise-dominant-module' THEN '{_DEEP}' WHEN 'socket-transport' THEN NULL ELSE '{_SPRING}' END AS reference,
        CASE id WHEN 'hash-loop-density' THEN 138 WHEN 'mining-corroborated' THEN 154 WHEN 'bitwise-dominant-module' THEN 151 WHEN 'shared-memory-parallelism' THEN 119 ELSE 93 END::BIGINT AS summary_chars FROM g JOIN w USING (p_partkey)""",
    "rule_catalogue": "SELECT * FROM (VALUES ('static', 19::BIGINT, 375::BIGINT, 8::BIGINT), ('runtime', 5, 105, 3), ('model', 1, 18, 1)) AS v(kind, rules, weights, cited)",
    "stored_results": _R + "SELECT p_partkey, score, readable, CASE WHEN readable THEN n END AS instructions, CASE WHEN readable THEN 'stripped-binary' END AS first_id FROM r",
    "known_results": _R + "SELECT p_partkey, CASE WHEN r.p_partkey IS NULL THEN 'queued' ELSE 'complete' END AS status, score FROM part LEFT JOIN r USING (p_partkey)",
    "activity_modules": _R + "SELECT p_partkey, seen, score FROM (SELECT p_partkey, floor(p_retailprice)::BIGINT AS seen FROM part ORDER BY seen DESC, p_partkey DESC LIMIT 200) "
        "LEFT "
        ""
        ""
        "JOIN r USING (p_partkey)",
    "activity_status": f"WITH e AS (SELECT event_id, {_MS} AS ms, event_type FROM events), n AS (SELECT max(ms) AS now FROM e), h AS (SELECT count(*) AS n FROM e, n WHERE ms >= now - 86400000 GROUP BY least(23, floor((ms - (now - 86400000)) * 24 / 86400000.0::DOUBLE))), "
        "l AS (SELECT * FROM e ORDER BY ms DESC, event_id DESC LIMIT 200) SELECT (SELECT max(ms) FROM l WHERE event_type = (SELECT min(event_type) FROM e)) AS "
            "last_capture, (SELECT max(n) FROM h) AS peak",
    "page_badges": modules._M + "SELECT p_brand, count(*) AS modules, ['#6b7280', '#4a7c59', '#e8a200', '#d9480f', '#b00020'][max(rank)] AS colour FROM h GROUP BY p_brand",
    "coverage_gap": "SELECT p_brand, greatest(0, count(*) - count(*) FILTER (p_partkey % 2 = 0) + count(*) FILTER (p_size = 1)) AS unanalysed FROM part GROUP BY p_brand",
    "classifier_against_rules": modules._M + """, x AS (SELECT p_partkey % 2 AS y, least(1.0::DOUBLE, bw * 2 + 0.1::DOUBLE) >= 0.5 AS m, score / 100.0::DOUBLE >= 0.5 AS r FROM k JOIN s USING (p_partkey)),
        c AS (SELECT count(*) FILTER (m AND y = 1) AS mt, count(*) FILTER (m AND y = 0) AS mf, count(*) FILTER (NOT m AND y = 1) AS mn, count(*) FILTER (r AND y = 1) AS rt, count(*) FILTER (r AND y = 0) AS rf, count(*) FILTER (NOT r AND y = 1) AS rn FROM x),
        fm AS (SELECT 2.0::DOUBLE * mt / (2 * mt + mf + mn) AS a, 2.0::DOUBLE * rt / (2 * rt + rf + rn) AS b FROM c)
        SELECT """ + telemetry._6("a") + " AS model_f1, " + telemetry._6("b") + " AS rules_f1, CASE WHEN a - b > 0.01 THEN 'better' WHEN a - b < -0.01 THEN 'worse' ELSE 'same' END AS verdict FROM fm",
    "sequence_counters": "WITH p AS (SELECT p_size::BIGINT AS r, count(*) AS n FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1) SELECT count(*) AS written, count(*) FILTER (r >= "
        "6) AS kernels, count(*) FILTER (6 * r + 12 < 512) AS padded, (SELECT count(*) FROM part WHERE p_partkey % 11 = 0) AS skipped, sum(n - 1)::BIGINT AS "
        "duplicates FROM p",
    "network_notes": """SELECT CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^[^?#]*') || '/A.WASM?x#y' ELSE url || '?q=.wasm' END AS url, page_id % 10 AS tab_id, page_id AS ts, 'network' AS reason
        FROM pages WHERE page_id % 5 = 0 OR page_id % 3 = 0 AND page_id % 7 <> 0""",
    "upload_outcomes": "SELECT ['known', 'accepted', 'too-large', 'rejected', 'unreachable'][p_size % 5 + 1] AS outcome, count(*) AS n FROM part GROUP BY 1",
    "first_scripts": telemetry._S + "SELECT tab_id, url, id FROM s QUALIFY row_number() OVER (PARTITION BY tab_id, url ORDER BY ts, id) = 1",
    "runtime_samples": telemetry._E + """SELECT event_id, event_type AS context, k AS fingerprint, ms % 1000 AS wasm_time_ms, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE 3.0::DOUBLE END AS drift_ms FROM e
        UNION ALL SELECT event_id, event_type, k + 1000, 5, CASE WHEN k = 0 THEN 0.0 ELSE 3.0 END FROM e""",
    "rescored_modules": modules._M + "SELECT p_partkey, score FROM h WHERE p_partkey % 2 = 1",
    "report_flags": modules._M + "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'shared memory,stripped' ELSE 'stripped' END AS flags FROM h WHERE score > 0",
    "active_types": telemetry._E + """, c AS (SELECT user_id % 50 AS g, event_type, count(*) - 30 AS n, ('0x' || substr(md5(event_type), 1, 6))::BIGINT AS o FROM e GROUP BY 1, 2),
        t AS (SELECT * FROM c WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, o) = 1) SELECT g, coalesce(t.event_type, 'none') AS active FROM (SELECT DISTINCT g FROM c) LEFT JOIN t USING (g)""",
}
