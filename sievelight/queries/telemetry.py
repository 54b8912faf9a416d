"""Queries over `events` as telemetry, sightings and logs, and over `documents` as artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, ingest, pairs, reports, runtime, stars, store
from ..plans import rules
from ..plans.rules import half_up

NOW = 1_700_000_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ms, user_id, event_type, value, k (of the props)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ms"), "user_id", "event_type", "value", F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"))


def module_samples(e: DataFrame) -> DataFrame:
    """Latest sample of each (context, module)."""
    a = store.latest(e.withColumn("_id", F.col("event_id")), ["user_id", "k"], "ms", "event_id")
    t = F.floor(F.abs(F.col("value")) * 100).cast("long")
    return a.select(F.col("k").alias("fingerprint"), F.col("event_type").alias("context"), F.lit(30000).cast("long").alias("observed_ms"),
        (F.col("user_id") % 500).cast("double").alias("drift_ms"), (F.col("user_id") % 4).alias("worker_count"),
        (F.col("k") % 2).alias("socket_count"),
                    (F.col("k") % 20).alias("socket_messages"), F.lit(8).cast("long").alias("hardware_concurrency"),
                    t.alias("wasm_time_ms"), F.lit(1).cast("long").alias("call_count"), t.alias("longest_call_ms"),
                    (F.col("k") % 7 == 0).alias("timing_stopped"))


def runtime_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = runtime.fold(module_samples(events(spark, sf_dir)))
    return f.select("fingerprint", "wasm_time_ms", "longest_call_ms", half_up(F.col("cpu_share"), 6).alias("cpu_share"),
        half_up(F.col("mean_drift_ms"), 6).alias("mean_drift_ms"), "worker_count", "socket_messages",
        F.array_join("contexts", ",").alias("contexts"), "context_count", "timing_stopped")


def runtime_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = runtime.fold(module_samples(events(spark, sf_dir)))
    a = f.select("fingerprint", F.struct(*[c for c in f.columns if c != "fingerprint"]).alias("runtime"),
        F.lit(None).cast("struct<bitwise_ratio:double,largest_loop:bigint,order:bigint,arithmetic_ratio:double,call_ratio:double,func_idx:bigint>").alias("kernel"))
    return rules.assess(a, rules.runtime_rules()).select("fingerprint",
        F.array_join(F.array_sort(F.transform("findings", lambda x: x["id"])), ",").alias("ids"))


def fingerprint_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = runtime.fold(module_samples(events(spark, sf_dir)))
    known = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("fingerprint"),
        F.col("p_brand").alias("hash"))
    return runtime.by_hash(f, known).groupBy("hash").agg(F.sum("wasm_time_ms").alias("wasm_time_ms"), F.count("*").alias("modules"))


def rescore_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    now, old = runtime.fold(module_samples(e), "fingerprint"), runtime.fold(module_samples(e.filter("event_id % 2 = 0")), "fingerprint")
    return runtime.worth_rescoring(now.withColumnRenamed("fingerprint", "hash"),
        old.withColumnRenamed("fingerprint", "hash")).groupBy("rescore").agg(F.count("*").alias("n"))


def level_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("hash"), F.col("ms").alias("ts"), F.col("event_id").alias("id"),
        rules.level((F.col("k")).cast("int")).alias("level"))
    return runtime.level_changes(e).select("hash", "id", "before", "level")


def timer_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.lateness(events(spark, sf_dir), "user_id", "ms", "event_id", 60_000)


def timing_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("t", F.floor(F.abs("value")).cast("long"))
    return runtime.call_times(e, "user_id", ["ms", "event_id"], "t", 20, 60.0)


def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.get(F.array(*map(F.lit, ("socket-open", "socket-sent", "socket-received", "worker-start"))), (F.col("k") % 4).cast("int"))
    return runtime.message_counts(events(spark, sf_dir).withColumn("kind", kinds), "user_id")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("k").alias("hash"),
        F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("url"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("page_url"), (F.col("user_id") % 10).alias("tab_id"), F.col("ms").alias("ts"))


def latest_sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("hash"), "n_chars")
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("hash"), "toxic")
    return reports.tab_report(sightings(spark, sf_dir), docs, lab).select("hash", "sightings", "id", "url", "n_chars", "toxic")


def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    return reports.blind_spots(s.filter("hash >= 10"), s.filter("hash < 10")).select("id", "url")


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = store.upsert_artifacts(sightings(spark, sf_dir).withColumn("size", F.col("hash"))).withColumn("score",
        F.when(F.col("hash") % 3 > 0, F.col("hash") % 5))
    return reports.ordered(a).limit(25).select("hash", "score", "last_seen")


def activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("k"), "quality")
    return reports.activity_feed(events(spark, sf_dir), lab, "ms", "event_id", "k").select("event_id", "k", "quality")


def activity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("at", F.lit(NOW - 330_000) + F.pmod(F.col("ms"), F.lit(340_000)))
    return reports.histogram(e, "at", NOW)


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    return reports.page_url(s.filter("tab_id < 5"), s.filter("tab_id > 3"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", reports.format_bytes(F.col("n_chars") * F.col("doc_id")).alias("size"),
        reports.relative_time(F.col("doc_id") * 997_000).alias("age"), reports.source_label(F.col("source")).alias("label"),
        reports.first_three(F.slice(F.split("text", " "), 1, 5)).alias("names"))


def artifact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir).withColumn("size", F.col("hash") * 10)
    early = (F.col("id") % 3 > 0) & (F.col("hash") < 90)
    first = store.upsert_artifacts(s.filter(early))
    return store.upsert_artifacts(s.filter(~early), first).select("hash", "size", "first_seen", "last_seen", "seen_count", "is_new")


def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(events(spark, sf_dir).select(F.col("k").alias("hash"), "ms", "event_id", "event_type"), "hash", "ms",
        "event_id").select("hash", "event_id", "event_type")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.get(F.array(*map(F.lit, ("queued", "running", "complete", "failed"))), (F.col("event_id") % 4).cast("int"))
    return store.job_states(events(spark, sf_dir).select(F.col("user_id").alias("id"), step.alias("status"), F.col("event_id").alias("ts"),
        F.repeat(F.lit("e"), (F.col("k") * 30).cast("int")).alias("error")))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("id", "status", "created_at", "started_at", "finished_at", F.length("error").cast("long").alias("error_chars"))


def next_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.next_queued(store.requeue(jobs(spark, sf_dir))).select("id", "status")


def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.count_status(jobs(spark, sf_dir))


def lru_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", (F.col("doc_id") * 7919 % 1000).alias("last_seen"))
    return store.prune(d, 300, 400_000, "doc_id", "last_seen", "n_chars").select("doc_id")


def log_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(events(spark, sf_dir), "ms", "event_id").select("event_id")


def memo_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return store.unseen(d, lab, "doc_id").select("doc_id")


def clear_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without_tab(F.lit(3), sightings(spark, sf_dir))[0].groupBy("tab_id").agg(F.count("*").alias("n"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rate_limited(events(spark, sf_dir).select("user_id", "ms", "event_id"), "user_id", "ms", "event_id", 3,
        86_400_000).select("event_id", "allowed")


def frame_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_seen(events(spark, sf_dir), "user_id", "k", "ms", "event_id").select("user_id", "k", "event_id")


def message_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir).select(F.col("event_type").alias("api"),
        F.when(F.col("k") % 5 > 0, F.element_at(F.array(*map(F.lit, ("page", "worker", "other"))),
            (F.col("k") % 3 + 1).cast("int"))).alias("context"), F.when(F.col("k") % 11 > 0, F.col("k")).alias("size"))
    return ingest.validated(m, ("click", "view", "purchase", "page_view"), ("page", "worker")).groupBy("context",
        F.coalesce("reject", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.withColumn("bytes", F.when(F.col("doc_id") % 10 == 0, F.concat(F.expr("X'0061736D01000000'"),
        F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8")))


def sniff_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = content(spark, sf_dir)
    t = F.get(F.array(*map(F.lit, ("text/javascript", "application/wasm", "image/png", ""))), (F.col("doc_id") % 4).cast("int"))
    return c.select("doc_id", ingest.kind(F.col("bytes"), t).alias("kind"), ingest.is_version_1(F.col("bytes")).alias("version_1"))


def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    b = F.base64(F.encode("text", "UTF-8"))
    return d.select("doc_id", F.sha2("text", 256).alias("hash"), ingest.short_hash(F.sha2("text", 256)).alias("short"),
        (ingest.from_base64(F.rtrim(F.replace(F.replace(b, F.lit("\r\n"), F.lit("")), F.lit("="), F.lit(" ")))) == F.encode("text",
            "UTF-8")).alias("round_trip"))


def upload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = content(spark, sf_dir).withColumn("hash", F.sha2("bytes", 256))
    claim = F.when(F.col("doc_id") % 3 == 0, F.lit("00")).when(F.col("doc_id") % 3 == 1, F.upper("hash"))
    return c.select(ingest.upload_status(F.octet_length("bytes"), ingest.is_module(F.col("bytes")), claim, F.col("hash"),
        F.col("doc_id") % 20 == 0).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def page_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", ingest.page_fingerprint(F.encode("text", "UTF-8")).alias("fingerprint"))


def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 2).alias("klass"), F.sha2("text", 256).alias("hash"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"))
    return corpus.exact_dedupe(d, "klass", "hash", "name")


def label_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.sha2("text", 256).alias("hash"))
    return corpus.contradictions(d, "source", "hash")


def corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = content(spark, sf_dir)
    a = c.select("lang", corpus.gate(F.octet_length("bytes"), ingest.is_module(F.col("bytes")) | (F.col("doc_id") % 3 > 0),
        F.col("doc_id") % 5 > 0, (F.col("doc_id") % 10) / F.lit(10.0) + 0.15).alias("reason"))
    return corpus.rejections(a, "lang", "reason")


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", corpus.holdout(F.sha2("text", 256)).alias("held"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("name"),
        (F.col("vec_id") % 50 + 100).alias("size"), "embedding")


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.similar_pairs(vectors(spark, sf_dir), "name", "size", "embedding", 0.35).select("a", F.col("c").alias("b"),
        half_up(F.col("cosine"), 6).alias("cosine"))


def tight_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors drawn towards their label's axis, so that pivots tell most cells apart, with sizes of which some are outside each other's windows."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    drawn = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), 4.0).otherwise(0.0))
    v = e.select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("name"), drawn.alias("v"),
        ((F.col("vec_id") % 50 + 100) * F.when(F.col("vec_id") % 3 == 0, 4).otherwise(1)).alias("size"))
    return pairs.similar_pairs(v, "name", "size", "v", 0.95).select("a", F.col("c").alias("b"), half_up(F.col("cosine"), 6).alias("cosine"))


def near_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.keep_first(stars.similar_stars(vectors(spark, sf_dir), "name", "size", "embedding", 0.35), "name")


def sighting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as a large sighting fact: upsert per part."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("hash"),
        F.col("l_suppkey").cast("string").alias("page_url"), F.lit(1).cast("long").alias("size"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))").alias("ts"))
    return store.upsert_artifacts(li).select("hash", "first_seen", "last_seen", "seen_count", "last_page_url")


QUERIES = {f.__name__: f for f in (runtime_fold, runtime_findings, fingerprint_join, rescore_gate, level_changes, timer_drift,
    timing_cutoff, message_counts, latest_sighting, blind_spots, report_order, activity_feed, activity_histogram, page_urls, formats,
    artifact_upsert, result_upsert,
                                   job_states, next_queued, job_counts, lru_prune, log_cap, memo_antijoin, clear_tab, rate_limit,
                                   frame_dedupe, message_validation, sniff_kind, content_identity, upload_status, page_fingerprints,
                                   exact_dedupe, label_contradictions, corpus_gate, holdout_split,
                                   near_duplicate_pairs, tight_pairs, near_duplicate_clusters, sighting_facts)}

_E = "WITH e AS (SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ms, user_id, event_type, value, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k FROM events) "
_L = _E + ", l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ms DESC, event_id DESC) = 1), m AS (SELECT k AS fingerprint, event_type AS context, floor(abs(value) * 100)::BIGINT AS t, user_id, k FROM l) "
_S = _E + ", s AS (SELECT event_id AS id, k AS hash, 'u' || (user_id % 40) AS url, 'p' || user_id AS page_url, user_id % 10 AS tab_id, ms AS ts FROM e) "
_J = _E + ", j AS (SELECT user_id AS id, ['queued', 'running', 'complete', 'failed'][event_id % 4 + 1] AS status, event_id AS ts, least(k * 30, 2000) AS chars FROM e), x AS (SELECT id, arg_max(status, ts) AS status, min(ts) AS created_at, min(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status IN ('complete', 'failed')) AS finished_at, arg_max(chars, ts) AS error_chars FROM j GROUP BY id) "
_6 = lambda x: f"floor({x} * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"
_SHA = "sha256(text)"
_P = "v AS (SELECT lpad(vec_id::VARCHAR, 8, '0') AS name, vec_id % 50 + 100 AS size, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT x.name AS a, y.name AS b, list_cosine_similarity(x.e, y.e) AS c FROM v x JOIN v y ON x.name < y.name AND y.size >= x.size / 3.0 AND y.size < x.size * 3 + 1) "
_SCALED = lambda by: f"printf('%.1f', floor(n / {by}::DOUBLE * 10 + 0.5) / 10)"
ORACLE_SQL = {
    "runtime_fold": _L + "SELECT fingerprint, sum(t)::BIGINT AS wasm_time_ms, max(t) AS longest_call_ms, " + _6("sum(least(t / 30000.0::DOUBLE, 1.0))") + " AS cpu_share, " + _6("avg((user_id % 500)::DOUBLE)") + " AS mean_drift_ms, max(user_id % 4) AS worker_count, max(k % 20) AS socket_messages, string_agg(DISTINCT context, ',' ORDER BY context) AS contexts, "
        "count(*) AS context_count, bool_or(k % 7 = 0) AS timing_stopped FROM m GROUP BY fingerprint",
    "runtime_findings": _L + ", f AS (SELECT fingerprint, sum(t) AS t, sum(least(t / 30000.0::DOUBLE, 1.0)) AS share, max(k % 20) AS msgs, max(k % 2) AS sockets FROM m GROUP BY "
        "fingerprint) SELECT fingerprint, concat_ws(',', CASE WHEN sockets > 0 AND msgs >= 10 AND t >= 5000 THEN 'persistent-socket-traffic' END, CASE WHEN "
        "share > 0.5 THEN 'sustained-execution' END) AS ids FROM f",
    "fingerprint_join": _L + ", f AS (SELECT fingerprint, sum(t)::BIGINT AS t FROM m GROUP BY 1) SELECT p_brand AS hash, sum(t)::BIGINT AS wasm_time_ms, count(*) AS modules FROM f "
        "JOIN part ON p_partkey = fingerprint AND p_partkey % 2 = 0 GROUP BY 1",
    "rescore_gate": _E + """, a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ms DESC, event_id DESC) = 1), b AS (SELECT * FROM e WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ms DESC, event_id DESC) = 1),
        x AS (SELECT k, count(*) AS c, sum(least(floor(abs(value) * 100) / 30000.0::DOUBLE, 1.0)) AS s FROM a GROUP BY k), y AS (SELECT k, count(*) AS c, sum(least(floor(abs(value) * 100) / 30000.0::DOUBLE, 1.0)) AS s FROM b GROUP BY k)
        SELECT y.k IS NULL OR x.c <> y.c OR abs(x.s - y.s) >= 0.1 AS rescore, count(*) AS n FROM x LEFT JOIN y USING (k) GROUP BY 1""",
    "level_changes": _E + ", v AS (SELECT user_id AS hash, event_id AS id, ms, CASE WHEN k >= 75 THEN 'critical' WHEN k >= 50 THEN 'high' WHEN k >= 25 THEN 'medium' WHEN k >= "
        "10 THEN 'low' ELSE 'benign' END AS level FROM e), w AS (SELECT *, lag(level) OVER (PARTITION BY hash ORDER BY ms, id) AS before FROM v) SELECT hash, "
        "id, before, level FROM w WHERE before <> level",
    "timer_drift": _E + ", g AS (SELECT user_id, greatest(0, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) - 60000) AS late, lag(ms) OVER (PARTITION BY "
        "user_id ORDER BY ms, event_id) AS p FROM e) SELECT user_id, count(*) AS samples, sum(late)::BIGINT AS late_ms, max(late) AS max_late_ms FROM g WHERE "
        "p IS NOT NULL GROUP BY user_id",
    "timing_cutoff": _E + """, a AS (SELECT user_id, floor(abs(value))::BIGINT AS t, row_number() OVER w AS n, sum(floor(abs(value))) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
        b AS (SELECT *, min(CASE WHEN n >= 20 AND c / n::DOUBLE < 60 THEN n END) OVER (PARTITION BY user_id) AS cut FROM a)
        SELECT user_id, count(*) AS call_count, coalesce(sum(t) FILTER (cut IS NULL OR n <= cut), 0)::BIGINT AS wasm_time_ms, max(t) FILTER (cut IS NULL OR n <= cut) AS longest_call_ms, bool_or(cut IS NOT NULL) AS timing_stopped FROM b GROUP BY user_id""",
    "message_counts": _E + "SELECT user_id, count(*) FILTER (k % 4 = 0) AS sockets, count(*) FILTER (k % 4 IN (1, 2)) AS messages, count(*) FILTER (k % 4 = 3) AS workers FROM e "
        "GROUP BY user_id",
    "latest_sighting": _S + ", t AS (SELECT *, count(*) OVER (PARTITION BY hash) AS sightings FROM s QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ts DESC, id) = 1) "
        "SELECT hash, sightings, id, url, n_chars, toxic FROM t JOIN documents d ON d.doc_id = hash LEFT JOIN labels l ON l.doc_id = hash",
    "blind_spots": _S + ", t AS (SELECT * FROM s WHERE hash < 10 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ts DESC, id) = 1) SELECT id, url FROM s WHERE hash >= "
        "10 AND url NOT IN (SELECT url FROM t)",
    "report_order": _S + ", a AS (SELECT hash, CASE WHEN hash % 3 > 0 THEN hash % 5 END AS score, max(ts) AS last_seen FROM s GROUP BY hash) SELECT hash, score, last_seen FROM "
        "a ORDER BY coalesce(score, -1) DESC, last_seen DESC, hash LIMIT 25",
    "activity_feed": _E + ", n AS (SELECT * FROM e ORDER BY ms DESC, event_id DESC LIMIT 200) SELECT event_id, k, quality FROM n LEFT JOIN labels ON doc_id = k",
    "activity_histogram": _E + f", a AS (SELECT {NOW - 330_000} + ms % 340000 AS t FROM e), b AS (SELECT least(59, floor((t - {NOW - 300_000}) * 60 / 300000.0::DOUBLE))::BIGINT AS bucket, count(*) AS n FROM a WHERE t >= {NOW - 300_000} GROUP BY 1) SELECT r.bucket, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(60)) AS bucket) r LEFT JOIN b USING (bucket)",
    "page_urls": _S + ", a AS (SELECT tab_id, arg_max(page_url, id) AS u FROM s WHERE tab_id < 5 GROUP BY 1), b AS (SELECT tab_id, arg_min(page_url, id) AS v FROM s WHERE "
        "tab_id > 3 GROUP BY 1) SELECT coalesce(a.tab_id, b.tab_id) AS tab_id, coalesce(u, v) AS page_url FROM a FULL JOIN b ON a.tab_id = b.tab_id",
    "artifact_upsert": _S + "SELECT hash, hash * 10 AS size, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen_count, NOT bool_or(id % 3 > 0 AND hash < 90) AS is_new "
        "FROM s GROUP BY hash",
    "result_upsert": _E + "SELECT k AS hash, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY ms DESC, event_id DESC) = 1",
    "job_states": _J + "SELECT * FROM x",
    "next_queued": _J + "SELECT id, 'queued' AS status FROM x WHERE status IN ('queued', 'running') ORDER BY created_at, id LIMIT 1",
    "job_counts": _J + "SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("queued", "running", "complete",
        "failed")) + " FROM x",
    "lru_prune": "WITH a AS (SELECT doc_id, row_number() OVER w AS n, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM documents WINDOW w AS (ORDER BY doc_id * "
        "7919 % 1000 DESC, doc_id DESC)) SELECT doc_id FROM a WHERE n <= 300 AND s <= 400000",
    "log_cap": _E + "SELECT event_id FROM e ORDER BY ms DESC, event_id DESC LIMIT 500",
    "memo_antijoin": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "clear_tab": _S + "SELECT tab_id, count(*) AS n FROM s WHERE tab_id <> 3 GROUP BY 1",
    "rate_limit": _E + """, o AS (SELECT user_id, event_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM e), r AS (
        WITH RECURSIVE q AS (SELECT user_id, i, ms AS start, 1 AS c FROM o WHERE i = 1 UNION ALL
          SELECT o.user_id, o.i, CASE WHEN o.ms - q.start >= 86400000 THEN o.ms ELSE q.start END, CASE WHEN o.ms - q.start >= 86400000 THEN 1 ELSE q.c + 1 END FROM q JOIN o ON o.user_id = q.user_id AND o.i = q.i + 1) SELECT * FROM q)
        SELECT event_id, c <= 3 AS allowed FROM r JOIN o USING (user_id, i)""",
    "frame_dedupe": _E + "SELECT user_id, k, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ms, event_id) = 1",
    "message_validation": _E + ", m AS (SELECT event_type AS api, coalesce(CASE WHEN k % 5 > 0 THEN ['page', 'worker', 'other'][k % 3 + 1] END, 'page') AS context, CASE WHEN k % 11 "
        "> 0 THEN k END AS size FROM e) SELECT context, CASE WHEN api NOT IN ('click', 'view', 'purchase', 'page_view') THEN 'api' WHEN context NOT IN "
        "('page', 'worker') THEN 'context' WHEN size IS NULL THEN 'size' ELSE 'accepted' END AS outcome, count(*) AS n FROM m GROUP BY ALL",
    "sniff_kind": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'wasm' WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 IN (0, 3) THEN 'js' END AS kind, doc_id % 10 = 0 "
        "AS version_1 FROM documents",
    "content_identity": f"SELECT doc_id, {_SHA} AS hash, left({_SHA}, 12) AS short, true AS round_trip FROM documents",
    "upload_status": "WITH s AS (SELECT CASE WHEN doc_id % 10 <> 0 THEN 415 WHEN doc_id % 3 = 0 THEN 409 WHEN doc_id % 20 = 0 THEN 200 ELSE 202 END AS status FROM "
        "documents) SELECT status, count(*) AS n FROM s GROUP BY status",
    "exact_dedupe": f"WITH d AS (SELECT doc_id % 2 AS klass, {_SHA} AS hash, lpad(doc_id::VARCHAR, 12, '0') AS name FROM documents), x AS (SELECT hash FROM d GROUP BY 1 HAVING count(DISTINCT klass) > 1) SELECT klass, hash, min(name) AS name, count(*) AS copies FROM d WHERE hash NOT IN (SELECT hash FROM x) GROUP BY 1, 2 UNION ALL SELECT klass, hash, name, 1 FROM d WHERE hash IN (SELECT hash FROM x)",
    "label_contradictions": f"SELECT {_SHA} AS hash, count(DISTINCT source) AS classes, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "corpus_gate": "WITH a AS (SELECT lang, doc_id, strlen(text) + CASE WHEN doc_id % 10 = 0 THEN 8 ELSE 0 END AS n FROM documents) SELECT lang, CASE WHEN n < 1024 THEN "
        "'too-small' WHEN n > 20971520 THEN 'too-large' WHEN doc_id % 10 <> 0 AND doc_id % 3 = 0 THEN 'not-wasm-magic' WHEN doc_id % 5 = 0 THEN 'parse-failed' "
        "WHEN (doc_id % 10) / 10.0::DOUBLE + 0.15::DOUBLE < 0.9::DOUBLE THEN 'low-coverage' ELSE 'kept' END AS reason, count(*) AS n FROM a GROUP BY ALL",
    "holdout_split": f"SELECT doc_id, right({_SHA}, 1) IN ('0', '1', '2') AS held FROM documents",
    "near_duplicate_pairs": "WITH " + _P + "SELECT a, b, " + _6("c") + " AS cosine FROM p WHERE c >= 0.35",
    "tight_pairs": "WITH " + _P.replace("vec_id % 50 + 100 AS size", "(vec_id % 50 + 100) * CASE WHEN vec_id % 3 = 0 THEN 4 ELSE 1 END AS size").replace("embedding::DOUBLE[] AS e",
        "list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i - 1 = label THEN 4 ELSE 0 END) AS e") + "SELECT a, b, " + _6("c") + " AS cosine FROM p WHERE c >= 0.95",
    "near_duplicate_clusters": "WITH RECURSIVE " + _P + """, n AS (SELECT a, b FROM p WHERE c >= 0.35), o AS (SELECT name, row_number() OVER (ORDER BY name) AS i, coalesce(below, []) AS below FROM v LEFT JOIN (SELECT b, list(a) AS below FROM n GROUP BY b) ON b = name),
        w AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS seeds UNION ALL SELECT o.i, CASE WHEN list_has_any(below, seeds) THEN seeds ELSE list_append(seeds, name) END FROM w JOIN o ON o.i = w.i + 1),
        s AS (SELECT unnest(arg_max(seeds, i)) AS seed FROM w), m AS (SELECT b AS name, min(a) AS seed FROM n JOIN s ON a = seed WHERE b NOT IN (SELECT seed FROM s) GROUP BY b UNION ALL SELECT seed, seed FROM s)
        SELECT seed, min(name) AS kept, count(*) - 1 AS collapsed FROM m GROUP BY seed""",
    "formats": "WITH d AS (SELECT doc_id, source, n_chars * doc_id AS n, doc_id * 997000 // 1000 AS s, string_split(text, ' ')[1:5] AS w FROM documents) SELECT "
        "doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN " + _SCALED(1024) + " || ' KB' ELSE " + _SCALED(1048576) + """ || ' MB' END AS size,
        CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age,
        array_to_string(list_transform(string_split(replace(coalesce(source, 'unknown'), '-', ' '), ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') AS label,
        array_to_string(w[1:3], ', ') || CASE WHEN len(w) > 3 THEN ' +' || (len(w) - 3) || ' more' ELSE '' END AS names FROM d""",
    "page_fingerprints": """WITH b AS (SELECT doc_id, strlen(text)::BIGINT AS n, hex(encode(text)) AS h FROM documents), c AS (SELECT doc_id, n, CASE WHEN n <= 12288 THEN h ELSE substr(h, 1, 8192) || substr(h, (n - 4096) // 2 * 2 + 1, 8192) || right(h, 8192) END AS h FROM b),
        l AS (SELECT doc_id, n, list_concat([n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216 % 256], list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes FROM c)
        SELECT doc_id, lower(to_base(n, 36)) || ':' || lower(to_base(list_reduce(bytes, lambda m, x: xor(m, x) * 16777619 % 4294967296, 2166136261::BIGINT), 36)) AS fingerprint FROM l""",
    "sighting_facts": "SELECT l_partkey AS hash, (epoch_us(min(l_shipdate)) // 1000)::BIGINT AS first_seen, (epoch_us(max(l_shipdate)) // 1000)::BIGINT AS last_seen, "
        "count(*) AS seen_count, max({'t': l_shipdate, 'p': l_suppkey::VARCHAR}).p AS last_page_url FROM lineitem GROUP BY 1",
}
