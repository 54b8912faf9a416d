"""Runtime telemetry: cumulative reports, latest per context, folded per module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import scans

CUTOFF_CALLS, CUTOFF_MEAN_MS = 20_000, 0.05


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def latest(reports: DataFrame) -> DataFrame:
    """Last report of each context; reports are cumulative, so earlier ones are never summed."""
    rest = [c for c in reports.columns if c != "context_id"]
    return reports.groupBy("context_id").agg(F.max_by(F.struct(*rest), "updated_at").alias("_r")).select("context_id", "_r.*")


def samples(reports: DataFrame) -> DataFrame:
    """One row a module sample, with its report's figures."""
    r = F.col("report")
    a = reports.select("context_id", r["context"].alias("context"), r["observed_ms"].alias("observed_ms"),
        _share(r["drift"]["late_ms"], r["drift"]["samples"]).alias("drift_ms"), r["worker_count"].alias("worker_count"),
                       r["socket_count"].alias("socket_count"), r["socket_messages"].alias("socket_messages"),
                       r["hardware_concurrency"].alias("hardware_concurrency"), F.explode(r["modules"]).alias("m"))
    return a.select("*", "m.*").drop("m")


def fold(rows: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Per module: capped shares and times are summed, windows are maxima, contexts are counted."""
    return rows.groupBy(key).agg(
        F.sum("wasm_time_ms").alias("wasm_time_ms"), F.sum("call_count").alias("call_count"), F.max("observed_ms").alias("observed_ms"),
        F.max("longest_call_ms").alias("longest_call_ms"),
        F.sum(F.least(_share(F.col("wasm_time_ms"), F.col("observed_ms")), F.lit(1.0))).alias("cpu_share"),
        F.avg("drift_ms").alias("mean_drift_ms"), F.max("worker_count").alias("worker_count"),
        F.max("socket_count").alias("socket_count"), F.max("socket_messages").alias("socket_messages"),
        F.max("hardware_concurrency").alias("hardware_concurrency"), F.bool_or("timing_stopped").alias("timing_stopped"),
        F.sort_array(F.collect_set("context")).alias("contexts"), F.count("*").alias("context_count"))


def by_hash(folded: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Fingerprints that are not known are dropped; ones that lead to the same hash come together."""
    return folded.join(fingerprints.select("fingerprint", "hash"), "fingerprint")


def worth_rescoring(now: DataFrame, before: DataFrame, key: str = "hash") -> DataFrame:
    """Adds `rescore`: new, other context count, share moved by 0.1 or more, or 20 s of observation just reached."""
    old = before.select(key, *[F.col(c).alias(f"_{c}") for c in ("context_count", "cpu_share", "observed_ms")])
    a = now.join(old, key, "left")
    gate = F.col("_observed_ms").isNull() | (F.col("context_count") != F.col("_context_count")) | (F.abs(F.col("cpu_share") - F.col("_cpu_share")) >= 0.1) | ((F.col("_observed_ms") < 20_000) & (F.col("observed_ms") >= 20_000))
    return a.withColumn("rescore", gate).drop("_context_count", "_cpu_share", "_observed_ms")


def level_changes(results: DataFrame, key: str = "hash", at: str = "ts", tie: str = "id") -> DataFrame:
    return scans.scanned(results, key, [at, tie], before={"before": "level"}).filter("before is not null and before <> level")


def lateness(ticks: DataFrame, context: str, ms: str, tie: str, tick: int) -> DataFrame:
    a = scans.scanned(ticks.select(context, ms, tie), context, [ms, tie], before={"_ms": ms})
    a = a.withColumn("late", F.greatest(F.lit(0), F.col(ms) - F.col("_ms") - tick)).filter("_ms is not null")
    return a.groupBy(context).agg(F.count("*").alias("samples"), F.sum("late").alias("late_ms"), F.max("late").alias("max_late_ms"))


def call_times(calls: DataFrame, key: str, order: list[str], ms: str, most: int = CUTOFF_CALLS, mean: float = CUTOFF_MEAN_MS) -> DataFrame:
    """Calls are always counted; they are timed until so many have a mean below the limit."""
    a = scans.scanned(calls.select(*dict.fromkeys([key, *order, ms])), key, order, sums={"_n": F.lit(1), "_t": F.col(ms)})
    cheap = (F.col("_n") >= most) & (F.col("_t") / F.col("_n") < mean)
    a = scans.first_of(written(a, "calls"), key, cheap, F.col("_n"), "_cut")
    timed = F.col("_cut").isNull() | (F.col("_n") <= F.col("_cut"))
    return a.groupBy(key).agg(F.count("*").alias("call_count"), F.sum(F.when(timed, F.col(ms)).otherwise(0)).alias("wasm_time_ms"),
        F.max(F.when(timed, F.col(ms))).alias("longest_call_ms"), F.bool_or(F.col("_cut").isNotNull()).alias("timing_stopped"))


def message_counts(events: DataFrame, key: str) -> DataFrame:
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return events.groupBy(key).agg(is_("socket-open").alias("sockets"),
        F.count_if(F.col("kind").isin("socket-sent", "socket-received")).alias("messages"), is_("worker-start").alias("workers"))
