"""Queries whose inputs cross the limits of the operators, and those of orders, stores and rescoring on runtime evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical
from ..operators import corpus, ingest, intake, reports, store
from ..plans import rules
from . import modules, telemetry


def text_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first characters of documents with zero bytes behind them: of some, a twentieth or more is no text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    zeros = F.expr("unhex(repeat('00', cast(doc_id % 60 as int)))")
    content = F.concat(F.encode(F.substring("text", 1, 400), "UTF-8"), zeros)
    return d.select("doc_id", rules.half_up(ingest.text_share(content), 6).alias("share"), ingest.kind(content, F.lit("")).alias("kind"))


def capture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 400th document as a module of 16 MiB, every second of these a byte longer."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    n = F.when(F.col("doc_id") % 400 == 0, F.lit(ingest.MAX_BYTES - 8) + F.col("doc_id") / 400 % 2).otherwise(F.col("doc_id") % 50).cast("int")
    sent = d.withColumn("n", n).select("doc_id", F.base64(F.concat(F.expr("X'0061736D01000000'"), F.encode(F.repeat(F.lit("x"), F.col("n")), "UTF-8"))).alias("bytes_base64"))
    sent = sent.withColumn("bytes_base64", F.regexp_replace("bytes_base64", "\\s", ""))
    return intake.captures(sent).select("doc_id", "outcome", "size")


def long_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 400th document stands behind more characters than are searched; calls at its end are not found, those of others are."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = F.concat(F.repeat(F.lit("x"), F.lit(lexical.SCAN_CHARS - 10)), F.col("text"))
    source = F.concat(F.when(F.col("doc_id") % 400 == 0, long).otherwise(F.col("text")), F.lit(" eval(1); xmrig"))
    m = lexical.measure(d.select("doc_id", source.alias("source")))
    return m.select("doc_id", "byte_length", rules.half_up(F.col("coverage"), 6).alias("coverage"), "eval", F.size("miner_names").cast("long").alias("miner_names"))


def script_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of a tab in the order of a report: unrated ones count as 0 there, below those rated and above none."""
    s = telemetry.sightings(spark, sf_dir)
    a = s.select("tab_id", F.col("id").alias("hash"), F.col("ts").alias("last_seen"), F.when(F.col("hash") % 3 > 0, F.col("hash") % 4 - 1).alias("score"))
    return reports.placed(a, "tab_id", missing=0).select("tab_id", "hash", "place")


def module_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for modules: unrated ones stand last."""
    s = telemetry.sightings(spark, sf_dir)
    a = s.select("tab_id", F.col("id").alias("hash"), F.col("ts").alias("last_seen"), F.when(F.col("hash") % 3 > 0, F.col("hash") % 4).alias("score"))
    return reports.placed(a, "tab_id").select("tab_id", "hash", "place")


def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a folder (their language), the largest first."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = d.select("lang", F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("length"))
    return corpus.largest_first(files, "lang")


def cleared_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each of the ten stores before, after a tab is cleared and after all is."""
    s = telemetry.sightings(spark, sf_dir)
    stores = {name: s.filter(F.col("id") % 10 >= i) for i, name in enumerate(store.STORES)}
    sizes = lambda of, name: [(df.groupBy().agg(F.count("*").alias(name)).withColumn("store", F.lit(n))) for n, df in of.items()]
    together = lambda of, name: reports.united(sizes(of, name))
    a = together(stores, "before").join(together(store.clear_tab(F.lit(3), stores), "after_tab"), "store")
    return a.join(together(store.clear_all(stores), "after_all"), "store")


def _running():
    """What is seen of a module that runs in two contexts for most of the time."""
    zero = F.lit(0).cast("long")
    return F.struct(F.lit(30_000).cast("long").alias("observed_ms"), F.lit(1.25).alias("cpu_share"), F.lit(2).cast("long").alias("context_count"),
        F.array(F.lit("page"), F.lit("worker")).alias("contexts"), F.lit(300.0).alias("mean_drift_ms"), zero.alias("socket_count"), zero.alias("socket_messages"),
        F.lit(37_500).cast("long").alias("wasm_time_ms"), F.lit(2).cast("long").alias("hardware_concurrency"), F.lit(False).alias("timing_stopped"))


def rescored_on_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second module has come to run, nearly flat out and in two contexts; all rules are run again for these."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    fold = lambda n: part.select(F.col("p_partkey").cast("string").alias("hash"), n.alias("context_count"), F.lit(1.25).alias("cpu_share"), F.lit(30_000).cast("long").alias("observed_ms"))
    seen = lambda changed: modules.features_of(spark, sf_dir, changed).withColumn("runtime", _running())
    a = intake.rescored(fold(1 + F.col("p_partkey") % 2), fold(F.lit(1)), seen, [*rules.module_rules(), *rules.runtime_rules()], with_evidence=False)
    return a.select(F.col("hash").cast("long").alias("p_partkey"), "score", "level")


def layers_of_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each layer, where every second module ran nearly flat out and a model has its opinion of each."""
    odd = F.col("hash").cast("long") % 2 == 1
    seen = modules.features(spark, sf_dir).withColumn("runtime", F.when(odd, _running())).withColumn("probability", (F.col("hash").cast("long") % 101) / F.lit(100.0))
    a = rules.by_layer(rules.assess(seen, [*rules.module_rules(), *rules.runtime_rules(), *rules.model_rules()]))
    return a.select(F.col("hash").cast("long").alias("p_partkey"), F.col("static").alias("static_findings"), F.col("runtime").alias("runtime_findings"),
        F.col("model").alias("model_findings"))


def shape_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether modules of all shapes, broken and foreign ones too, can be decoded, and that none takes suspiciously long."""
    a = intake.profile(modules.shaped_modules(spark, sf_dir))
    return a.select(F.col("hash").cast("long").alias("p_partkey"), "ok", "byte_length", "suspect")


QUERIES = {f.__name__: f for f in (text_shares, capture_sizes, long_scripts, script_places, module_places, scan_order, cleared_stores, rescored_on_evidence, layers_of_findings, shape_profile)}

_6, _S = telemetry._6, telemetry._S
_PLACE = "row_number() OVER (PARTITION BY tab_id ORDER BY coalesce(CASE WHEN hash % 3 > 0 THEN {} END, {}) DESC, ts DESC, id) AS place"
ORACLE_SQL = {
    "text_shares": "WITH b AS (SELECT doc_id, octet_length(encode(text[1:400])) AS n, doc_id % 60 AS z FROM documents), s AS (SELECT doc_id, CASE WHEN n + z = 0 THEN 0 "
        "ELSE n::DOUBLE / (n + z) END AS s FROM b) "
        f"SELECT doc_id, {_6('s')} AS share, CASE WHEN s > 0.95 THEN 'js' END AS kind FROM s",
    "capture_sizes": "SELECT doc_id, CASE WHEN doc_id % 800 = 400 THEN 'size' ELSE 'captured' END AS outcome, CASE WHEN doc_id % 400 > 0 THEN 8 + doc_id % 50 WHEN doc_id % "
        "800 = 0 THEN 16777216 END AS size FROM documents",
    "long_scripts": "WITH s AS (SELECT doc_id, length(text) + 15 + CASE WHEN doc_id % 400 = 0 THEN 4194294 ELSE 0 END AS n FROM documents) "
        f"SELECT doc_id, n AS byte_length, {_6('least(1.0::DOUBLE, 4194304.0::DOUBLE / n)')} AS coverage, (n <= 4194304)::BIGINT AS eval, (n <= 4194304)::BIGINT AS miner_names FROM s",
    "script_places": _S + f"SELECT tab_id, id AS hash, {_PLACE.format('hash % 4 - 1', 0)} FROM s",
    "module_places": _S + f"SELECT tab_id, id AS hash, {_PLACE.format('hash % 4', -1)} FROM s",
    "scan_order": "SELECT lang, doc_id AS path, octet_length(encode(text)) AS length, row_number() OVER (PARTITION BY lang ORDER BY octet_length(encode(text)) DESC, "
        "doc_id) AS place FROM documents",
    "cleared_stores": _S + f", n AS (SELECT unnest({list(store.STORES)}) AS store, unnest(range(10)) AS i) SELECT store, count(*) AS before, "
        f"count(*) FILTER (tab_id <> 3 OR store NOT IN ({', '.join(repr(x) for x in store.TAB_STORES)})) AS after_tab, 0::BIGINT AS after_all FROM s, n WHERE id % 10 >= i GROUP BY store",
    "layers_of_findings": modules._M + """, n AS (SELECT p_partkey, count(*) AS found FROM g GROUP BY p_partkey)
        SELECT p_partkey, coalesce(found, 0) AS static_findings, CASE WHEN p_partkey % 2 = 1 THEN 2 + hit::INT ELSE 0 END::BIGINT AS runtime_findings, (p_partkey % 101 > 60)::BIGINT AS model_findings
        FROM k LEFT JOIN n USING (p_partkey) WHERE coalesce(found, 0) > 0 OR p_partkey % 2 = 1 OR p_partkey % 101 > 60""",
    "shape_profile": modules._SHAPED + f", b AS (SELECT p_partkey, shape, s, {modules._BYTES} AS bytes FROM a) SELECT p_partkey, shape <> 'foreign' AS ok, "
        "CASE shape WHEN 'table' THEN bytes_of_table WHEN 'overlong' THEN bytes_of_overlong WHEN 'foreign' THEN 6 + s ELSE bytes END AS byte_length, false AS suspect FROM (SELECT *, "
        f"8 + 6 + 4 + {modules._SECTION('1 + ' + modules._BODY('316 + s'))} AS bytes_of_table, 8 + 6 + 4 + 6 + 3 + s AS bytes_of_overlong FROM b)",
    "rescored_on_evidence": modules._M + """, e AS (SELECT p_partkey, 28 * 0.5::DOUBLE + 20 * 1.0::DOUBLE + CASE WHEN hit THEN 45 * (floor(least(least(conf, 1.0) * least(0.7::DOUBLE + 0.15::DOUBLE * 2, 1.3::DOUBLE), 1.0) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE) ELSE 0 END AS more FROM k WHERE p_partkey % 2 = 1),
        z AS (SELECT p_partkey, floor(100 * (1 - exp(-(more + coalesce(raw, 0)) / 50.0::DOUBLE)) + 0.5)::INT AS score FROM e LEFT JOIN t USING (p_partkey))
        SELECT p_partkey, score, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' WHEN score >= 10 THEN 'low' ELSE 'benign' END AS level FROM z""",
}
