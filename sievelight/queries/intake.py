"""Intake, evidence and roll-up queries over `documents`, `events`, `embeddings` and parametric modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical
from ..operators import intake
from ..operators.modules import ascii_runs
from ..plans import rules
from . import modules, scripts, telemetry


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: every 13th can't be decoded, every 17th is empty, every 10th begins as a module."""
    c = telemetry.content(spark, sf_dir).select("doc_id", "bytes", "source")
    sent = F.when(F.col("doc_id") % 13 == 0, F.lit("Q!I")).when(F.col("doc_id") % 17 == 0, F.lit("")).otherwise(F.base64("bytes"))
    return c.select("doc_id", F.regexp_replace(sent, "\\s", "").alias("bytes_base64"), F.col("source").alias("page_url"),
        F.col("doc_id").alias("ts"), (F.col("doc_id") % 7).alias("tab_id"))


def capture_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.captures(_messages(spark, sf_dir)).select("doc_id", "outcome", "size", "hash")


def captured_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.capture_sinks(intake.captures(_messages(spark, sf_dir)))[0].select("hash", "size", "first_seen", "last_seen", "seen_count")


def skip_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = telemetry.events(spark, sf_dir).select("event_id", F.col("event_type").alias("api"), F.when(F.col("k") % 3 > 0, "worker").alias("context"))
    return intake.skips(e).groupBy("sink", "api", "context").agg(F.count("*").alias("n"))


def script_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scripts.sources(spark, sf_dir).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100).alias("ts"), "source")
    return intake.inline_store(s).select("hash", "id", "byte_length")


def report_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = telemetry.events(spark, sf_dir).groupBy("user_id").agg(F.max(F.abs("value")).alias("longest_call_ms"))
    return intake.snapshot(e, "longest_call_ms")


def classifier_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id",
        F.when(F.col("vec_id") % 7 > 0, (F.col("vec_id") % 101).cast("double") / 100).alias("probability"))
    return rules.assess(p, rules.model_rules()).select("vec_id", F.get(F.transform("findings", lambda f: f["confidence"]),
        0).alias("confidence"), "score", "level")


def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = modules.part_modules(spark, sf_dir).select("hash", ascii_runs(F.col("bytes")).alias("runs"))
    e = intake.evidence(modules.assessed(spark, sf_dir, with_evidence=True), lexical.signature_contexts(runs, "hash", "runs", scripts.SIGNATURES))
    return e.select(F.col("hash").cast("long").alias("p_partkey"), "instruction_count", "bitwise_ratio", "float_ratio", "memory_pages",
        F.col("kernel.loop_size").alias("loop_size"), F.col("risk.score").alias("score"),
                    F.array_join("risk.findings", ",").alias("findings"), F.array_join("exports", ",").alias("exports"),
                    F.to_json("signatures").alias("signatures"))


def inspection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.inspection(modules.assessed(spark, sf_dir)).select(F.col("hash").cast("long").alias("p_partkey"), "line")


def decode_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.profile(modules.part_modules(spark, sf_dir)).select(F.col("hash").cast("long").alias("p_partkey"), "ok", "suspect")


def union_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules and, in place of scripts, events rated by their property: all on one page in ten."""
    m = modules.assessed(spark, sf_dir).select((F.col("hash").cast("long") % 10).alias("page"),
        F.col("hash").cast("long").alias("position"), "score", "level", "headline")
    s = telemetry.events(spark, sf_dir).select((F.col("user_id") % 10).alias("page"), (F.col("event_id") + 1_000_000_000).alias("position"),
        F.col("k").cast("int").alias("score"),
                                               F.when(F.col("k") % 4 > 0, rules.level(F.col("k").cast("int"))).alias("level"),
                                               F.lit("script").alias("headline"))
    return rules.page_scorecard(m.unionByName(s), "page", "position").select("page", "level", "max_score", "modules", "unanalysed")


def tab_report_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ('{"artifacts": [], "notes": [1], "scorecard": {"a": 1}}', '{"artifacts": [], "notes": {}, "scorecard": {}}',
        '{"artifacts": [], "notes": [], "scorecard": null}', "[")
    e = telemetry.events(spark, sf_dir).withColumn("report", F.get(F.array(*map(F.lit, shapes)), (F.col("k") % 4).cast("int")))
    return e.groupBy(intake.is_tab_report(F.col("report")).alias("valid")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (capture_intake, captured_artifacts, skip_intake, script_intake, report_snapshot, classifier_findings,
    evidence_records, inspection_lines, decode_profile, union_scorecard, tab_report_shapes)}

_C = r"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '\x00asm\x01\x00\x00\x00'::BLOB || encode(text) ELSE encode(text) END AS b FROM documents),
o AS (SELECT doc_id, b, CASE WHEN doc_id % 13 = 0 THEN 'undecodable' WHEN doc_id % 17 = 0 OR octet_length(b) = 0 THEN 'size' WHEN doc_id % 10 = 0 THEN 'captured' ELSE 'not-wasm' END AS outcome FROM c) """
_P = "floor({} * {}.0::DOUBLE + 0.5) / {}.0::DOUBLE"
_4 = lambda x: _P.format(x, 10000, 10000)
ORACLE_SQL = {
    "capture_intake": _C + "SELECT doc_id, outcome, CASE WHEN outcome = 'captured' THEN octet_length(b) END AS size, CASE WHEN outcome = 'captured' THEN sha256(b) END AS hash "
        "FROM o",
    "captured_artifacts": _C + "SELECT sha256(b) AS hash, max(octet_length(b)) AS size, min(doc_id) AS first_seen, max(doc_id) AS last_seen, count(*) AS seen_count FROM o WHERE "
        "outcome = 'captured' GROUP BY sha256(b)",
    "skip_intake": telemetry._E + "SELECT sink, event_type AS api, CASE WHEN k % 3 > 0 THEN 'worker' ELSE 'page' END AS context, count(*) AS n FROM e, (VALUES ('events'), ('notes')) "
        "v(sink) GROUP BY ALL",
    "script_intake": scripts._S + "SELECT sha256(source) AS hash, arg_min(doc_id, (doc_id % 100) * 1000000000 + doc_id) AS id, max(length(source)) AS byte_length FROM s GROUP BY "
        "sha256(source)",
    "report_snapshot": telemetry._E + "SELECT user_id, floor(max(abs(value)) + 0.5)::BIGINT AS longest_call_ms FROM e GROUP BY user_id",
    "classifier_findings": "WITH p AS (SELECT vec_id, CASE WHEN vec_id % 7 > 0 THEN (vec_id % 101)::DOUBLE / 100 END AS p FROM embeddings), "
        "c AS (SELECT vec_id, CASE WHEN p > 0.6::DOUBLE THEN " + _P.format("least(1.0::DOUBLE, (p - 0.6::DOUBLE) / (0.95::DOUBLE - 0.6::DOUBLE))", 1000, 1000) + " END AS confidence FROM p), "
        "s AS (SELECT *, floor(100 * (1 - exp(-coalesce(18 * confidence, 0) / 50.0::DOUBLE)) + 0.5)::INT AS score FROM c) "
        "SELECT vec_id, confidence, score, CASE WHEN score >= 25 THEN 'medium' WHEN score >= 10 THEN 'low' ELSE 'benign' END AS level FROM s",
    "evidence_records": modules._M + ", i AS (SELECT p_partkey, string_agg(id, ',' ORDER BY weight * confidence DESC, o) AS findings FROM g GROUP BY p_partkey) "
        "SELECT p_partkey, n AS instruction_count, " + _4("bw") + " AS bitwise_ratio, 0.0::DOUBLE AS float_ratio, 16::BIGINT AS memory_pages, CASE WHEN kernel THEN loop END AS loop_size, score, findings, 'run' AS "
            "exports, '{\"websocket\":\"websocket_send\"}' AS signatures FROM b JOIN s USING (p_partkey) LEFT JOIN i USING (p_partkey)",
    "inspection_lines": modules._M + "SELECT p_partkey, p_partkey || ' | funcs=1 truncated=0 | instrs=' || n || ' | loops=1 nest=1 | bitwise=' || printf('%.1f', " + _P.format("bw * 100", 10, 10) + ") || '% float=0.0% | mem=16p shared=' || shared || ' | warnings=0 | risk=' || score || '/100 ' || level AS line FROM b JOIN (SELECT p_partkey, score, "
        "level FROM l) USING (p_partkey)",
    "decode_profile": "SELECT p_partkey, true AS ok, false AS suspect FROM part",
    "union_scorecard": modules._M + ", ev AS (SELECT user_id, regexp_extract(props, '(\\d+)', 1)::INT AS k FROM events), "
        "a AS (SELECT p_partkey % 10 AS page, score, level FROM l UNION ALL SELECT user_id % 10, k, CASE WHEN k % 4 > 0 THEN CASE WHEN k >= 75 THEN 'critical' "
            "WHEN k >= 50 THEN 'high' WHEN k >= 25 THEN 'medium' WHEN k >= 10 THEN 'low' ELSE 'benign' END END FROM ev) "
        "SELECT page, ['benign', 'low', 'medium', 'high', 'critical'][max(coalesce(list_position(['benign', 'low', 'medium', 'high', 'critical'], level), 1))] "
            "AS level, max(score) AS max_score, count(*) AS modules, count(*) FILTER (level IS NULL) AS unanalysed FROM a GROUP BY page",
    "tab_report_shapes": telemetry._E + "SELECT k % 4 = 0 AS valid, count(*) AS n FROM e GROUP BY 1",
}
