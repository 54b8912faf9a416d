"""Queries over `events` as streams of several files, and the SQL of one pass over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import modules as module_operators
from ..operators import store
from ..plans import rules
from ..plans.rules import half_up
from ..sources.shared import written
from ..sources.tables import Stored
from ..streaming import keyed
from . import modules, telemetry

FILES, RATE, WINDOW_MS, HORIZON_MS = 3, 3, 86_400_000, 2 * 86_400_000


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.events(spark, sf_dir).withColumn("at", F.timestamp_millis("ms"))


def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of the event stream in three files, three a day and frame; fingerprints below 20 have a stored result."""
    e = _timed(spark, sf_dir).select("user_id", "k", "ms", "event_id", "at")
    taken = keyed.taken_in(e, spark.range(20).withColumnRenamed("id", "k"), FILES, RATE, WINDOW_MS, HORIZON_MS)
    return taken.select("user_id", "event_id", "status")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as the report of a context (a user) on a module (k)."""
    e = telemetry.events(spark, sf_dir)
    t = F.floor(F.abs("value") * 100).cast("long")
    return e.select("k", F.col("user_id").alias("context"), F.col("ms").alias("at"), F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "worker").otherwise("page").alias("kind"), (F.lit(5_000) * (1 + F.col("event_id") % 6)).alias("observed_ms"),
        t.alias("longest_call_ms"), t.alias("wasm_time_ms"), F.lit(1).cast("long").alias("call_count"), (F.col("user_id") % 500).cast("double").alias("drift_ms"),
        (F.col("user_id") % 4).alias("worker_count"), (F.col("k") % 2).alias("socket_count"), (F.col("event_id") % 20).alias("socket_messages"),
        F.lit(8).cast("long").alias("hardware_concurrency"), (F.col("event_id") % 7 == 0).alias("timing_stopped"))


def stream_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scoring of a module that new runtime evidence was worth, after each of three files, and the level before it."""
    told = reports(spark, sf_dir)
    # only modules that are reported are decoded, once for all files
    of_reported = modules.part_modules(spark, sf_dir, told.select("k").distinct())
    features = written(module_operators.features(module_operators.decode(of_reported)), "features").withColumn("k", F.col("hash").cast("long"))
    r = keyed.rescored(told, features, FILES)
    return keyed.with_level_before(r, "k", "epoch").select(F.col("epoch").cast("long").alias("file"), "k", F.col("runtime.context_count").alias("contexts"),
        half_up(F.col("runtime.cpu_share"), 6).alias("cpu_share"), F.col("runtime.observed_ms").alias("observed_ms"),
        F.array_join("runtime.contexts", ",").alias("kinds"), F.col("runtime.longest_call_ms").alias("longest_call_ms"), "score", "level", "before")


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results: five viewers, thirteen origins, the property as score. More keys than are remembered."""
    e = telemetry.events(spark, sf_dir)
    origin = F.when(F.col("user_id") % 13 > 0, F.concat(F.lit("o"), (F.col("user_id") % 13).cast("string")))
    results = e.select((F.col("user_id") % 5).alias("viewer"), F.col("event_id").alias("id"), "ms", origin.alias("origin"),
        rules.level(F.col("k").cast("int")).alias("level"), F.when(F.col("k") < 99, F.col("k")).alias("hash"))
    return keyed.alerted(results, FILES)


def _stored(rows: DataFrame, table_of, made_of, combine) -> DataFrame:
    """A stored table after all files of rows have been merged into it, each by a run of its own."""
    def run(stream: DataFrame, target: str, checkpoint: str) -> None:
        table = table_of(target)
        table.create(stream.sparkSession)
        stream.writeStream.foreachBatch(lambda batch, epoch: table.merge(made_of(batch), epoch, combine) and None).option("checkpointLocation",
            checkpoint).trigger(availableNow=True).start().awaitTermination()
    return keyed.in_files(rows, "ts", FILES, run)


def stored_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = telemetry.sightings(spark, sf_dir).select((F.col("hash") * 1_000 + F.col("id") % 40).alias("hash"), "page_url", "ts", (F.col("hash") * 10).alias("size"))
    done = _stored(s, lambda path: Stored(path, "hash", store.ARTIFACTS, 16), store.upsert_artifacts, store.artifacts_of_both)
    return done.select("hash", "size", "first_seen", "last_seen", "seen_count", "last_page_url", "first_batch")


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = telemetry.events(spark, sf_dir).select(F.col("k").alias("hash"), F.col("ms").alias("ts"), F.col("ms").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("value"))
    done = _stored(e, lambda path: Stored(path, "hash", store.RESULTS, 16), lambda b: store.latest(b.drop("ts"), "hash", "at", "id"), store.last_of_both)
    return done.select("hash", F.col("id").alias("event_id"), F.col("value").alias("event_type"))


QUERIES = {f.__name__: f for f in (stream_intake, stream_rescored, stream_alerts, stored_artifacts, stored_results)}

_E = telemetry._E
_6 = telemetry._6


def _fold(n: int) -> str:
    """Folds of the last report of each context in the files up to n."""
    return f"""
l{n} AS (SELECT * FROM p WHERE f <= {n} QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ms DESC, event_id DESC) = 1),
f{n} AS (SELECT k, count(*) AS n, sum(share)::BIGINT AS share, max(observed) AS observed, sum(t)::BIGINT AS t, max(t) AS longest, avg(user_id % 500) AS drift,
    max(event_id % 20) AS messages, count(*) FILTER (event_type = 'error') AS errors FROM l{n}
    WHERE k IN (SELECT k FROM p WHERE f = {n}) GROUP BY k)"""


def _scored(n: int) -> str:
    """What of the folds of file n is scored, and the fold that each module was scored by last."""
    worth = "s.k IS NULL OR f.n <> s.n OR abs(f.share - s.share) * 10 >= 1000000000 OR (s.observed < 20000 AND f.observed >= 20000)"
    return f"""
r{n} AS (SELECT {n} AS file, f.* FROM f{n} f LEFT JOIN s{n - 1} s ON s.k = f.k WHERE {worth}),
s{n} AS (SELECT k, n, share, observed FROM r{n} UNION ALL SELECT * FROM s{n - 1} WHERE k NOT IN (SELECT k FROM r{n}))"""


_RAMP = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({} - {}::DOUBLE) / ({}::DOUBLE - {}::DOUBLE)))"
_STREAMED = f"""
w AS (SELECT min(ms) AS low, max(ms) AS high FROM e),
p AS (SELECT e.*, CASE WHEN ms < low + (high - low) * 1 // {FILES} THEN 0 WHEN ms < low + (high - low) * 2 // {FILES} THEN 1 ELSE 2 END AS f,
    floor(abs(value) * 100)::BIGINT AS t, 5000 * (1 + event_id % 6) AS observed,
    floor(least(floor(abs(value) * 100) / (5000 * (1 + event_id % 6))::DOUBLE, 1.0::DOUBLE) * 1000000000 + 0.5)::BIGINT AS share FROM e, w),
{_fold(0)},
r0 AS (SELECT 0 AS file, * FROM f0), s0 AS (SELECT k, n, share, observed FROM f0),
{_fold(1)},
{_scored(1)},
{_fold(2)},
{_scored(2)},
folds AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2),
c AS (SELECT folds.*, x.hit, x.conf, share / 1e9::DOUBLE AS cpu, observed >= 20000 AND share / 1e9::DOUBLE >= 0.5 AS sustained,
    (folds.n > 1)::INT + (drift >= 250)::INT + (messages > 0)::INT AS signs FROM folds JOIN k x ON x.p_partkey = folds.k),
rt AS (SELECT file, k, 28 AS weight, {_RAMP.format('cpu', '0.5', '2', '0.5')} AS c FROM c WHERE sustained
  UNION ALL SELECT file, k, 45, least(least(conf, 1.0) * least(0.7::DOUBLE + 0.15::DOUBLE * signs, 1.3::DOUBLE), 1.0) FROM c WHERE sustained AND hit
  UNION ALL SELECT file, k, 20, least(0.4::DOUBLE + 0.6::DOUBLE * {_RAMP.format('n / 8.0::DOUBLE', '0.5', '1', '0.5')}, 1.0) FROM c WHERE n >= 4 AND errors > 0
  UNION ALL SELECT file, k, 12, 0.45 FROM c WHERE k % 2 > 0 AND messages >= 10 AND t >= 5000),
raw AS (SELECT file, k, sum(weight * confidence) AS raw FROM (
    SELECT file, k, weight, floor(c * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS confidence FROM rt WHERE c > 0
    UNION ALL SELECT c.file, c.k, g.weight, g.confidence FROM c JOIN g ON g.p_partkey = c.k) GROUP BY ALL),
rated AS (SELECT c.*, floor(100 * (1 - exp(-coalesce(raw, 0) / 50.0::DOUBLE)) + 0.5)::INT AS points FROM c LEFT JOIN raw USING (file, k)),
named AS (SELECT *, CASE WHEN points >= 75 THEN 'critical' WHEN points >= 50 THEN 'high' WHEN points >= 25 THEN 'medium' WHEN points >= 10 THEN 'low' ELSE 'benign' END AS named FROM rated)
SELECT file, k, n AS contexts, {_6('cpu')} AS cpu_share, observed AS observed_ms, concat_ws(',', CASE WHEN errors < n THEN 'page' END, CASE WHEN errors > 0 THEN 'worker' END) AS kinds,
    longest AS longest_call_ms, points AS score, named AS level, lag(named) OVER (PARTITION BY k ORDER BY file) AS before FROM named
"""

ORACLE_SQL = {
    "stream_intake": _E + f""",
s AS (SELECT *, lag(ms) OVER (PARTITION BY user_id, k ORDER BY ms, event_id) AS before FROM e),
o AS (SELECT user_id, k, event_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM s WHERE before IS NULL OR ms - before >= {HORIZON_MS}),
r AS (WITH RECURSIVE q AS (SELECT user_id, i, ms AS start, 1 AS c FROM o WHERE i = 1 UNION ALL
    SELECT o.user_id, o.i, CASE WHEN o.ms - q.start >= {WINDOW_MS} THEN o.ms ELSE q.start END, CASE WHEN o.ms - q.start >= {WINDOW_MS} THEN 1 ELSE q.c + 1 END
    FROM q JOIN o ON o.user_id = q.user_id AND o.i = q.i + 1) SELECT * FROM q)
SELECT user_id, event_id, CASE WHEN k < 20 THEN 'known' ELSE 'queued' END AS status FROM r JOIN o USING (user_id, i) WHERE c <= {RATE}""",
    "stream_rescored": _E + ", " + modules._M.strip().removeprefix("WITH ") + "," + _STREAMED,
    "stored_artifacts": telemetry._S + f""", w AS (SELECT min(ts) AS low, max(ts) AS high FROM s),
t AS (SELECT hash * 1000 + id % 40 AS hash, hash * 10 AS size, page_url, ts, CASE WHEN ts < low + (high - low) * 1 // {FILES} THEN 0 WHEN ts < low + (high - low) * 2 // {FILES} THEN 1 ELSE 2 END AS f FROM s, w)
SELECT hash, max(size) AS size, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen_count, max({{'t': ts, 'p': page_url}}).p AS last_page_url, min(f) AS first_batch FROM t GROUP BY hash""",
    "stored_results": telemetry.ORACLE_SQL["result_upsert"],
    "stream_alerts": _E + f""",
a AS (SELECT user_id % 5 AS viewer, event_id AS id, ms, coalesce(CASE WHEN user_id % 13 > 0 THEN 'o' || user_id % 13 END, 'unknown page') || '|'
    || CASE WHEN k >= 75 THEN 'critical' ELSE 'high' END || '|' || CASE WHEN k < 99 THEN k::VARCHAR ELSE 'none' END AS alert_key FROM e WHERE k >= 50),
o AS (SELECT *, row_number() OVER (PARTITION BY viewer ORDER BY ms, id) AS i FROM a),
r AS (WITH RECURSIVE q AS (SELECT viewer, i, [alert_key] AS mem, true AS fired FROM o WHERE i = 1 UNION ALL
    SELECT o.viewer, o.i, CASE WHEN list_contains(q.mem, o.alert_key) THEN q.mem ELSE list_append(q.mem, o.alert_key)[-{keyed.REMEMBERED}:] END,
    NOT list_contains(q.mem, o.alert_key) FROM q JOIN o ON o.viewer = q.viewer AND o.i = q.i + 1) SELECT viewer, i FROM q WHERE fired)
SELECT viewer, id, ms, alert_key FROM r JOIN o USING (viewer, i)""",
}
