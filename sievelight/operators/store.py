"""Upserts, states and retention, as aggregates over append-only facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_ARTIFACTS, MAX_BYTES, MAX_EVENTS, MAX_ERROR = 300, 134_217_728, 500, 2_000


def upsert_artifacts(seen: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Sightings (hash, size, page_url, ts) to artifacts; the latest page wins, of equal times the larger URL."""
    a = seen.groupBy("hash").agg(F.max("size").alias("size"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count("*").alias("seen_count"), F.max(F.struct("ts", "page_url"))["page_url"].alias("last_page_url"))
    if before is None:
        return a.withColumn("is_new", F.lit(True))
    both = before.select("hash", "size", "first_seen", "last_seen", "seen_count", "last_page_url").withColumn("_old",
        F.lit(1)).unionByName(a.withColumn("_old", F.lit(0)))
    return both.groupBy("hash").agg(F.max("size").alias("size"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"),
                                    F.max(F.struct("last_seen", "last_page_url"))["last_page_url"].alias("last_page_url"),
                                    (F.max("_old") == 0).alias("is_new"))


def latest(df: DataFrame, key: str | list[str], at: str, tie: str | None = None) -> DataFrame:
    """Last write wins. A max of structs is combined before the shuffle, unlike a window."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(at, *([tie] if tie else [])))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, "_r.*")


def job_states(transitions: DataFrame) -> DataFrame:
    """(id, hash, status, ts, error) events to one row a job."""
    order = F.struct("ts", F.array_position(F.array(*map(F.lit, ("queued", "running", "complete", "failed"))), F.col("status")).alias("o"))
    return transitions.groupBy("id").agg(F.max_by("status", order).alias("status"), F.min("ts").alias("created_at"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
                                         F.max(F.when(F.col("status").isin("complete", "failed"), F.col("ts"))).alias("finished_at"),
                                         F.substring(F.max_by("error", order), 1, MAX_ERROR).alias("error"))


def next_queued(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(1)


def requeue(jobs: DataFrame) -> DataFrame:
    running = F.col("status") == "running"
    return jobs.withColumn("started_at", F.when(~running, F.col("started_at"))).withColumn("error",
        F.when(~running, F.col("error"))).withColumn("status", F.when(running, "queued").otherwise(F.col("status")))


def count_status(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "complete", "failed")])


def stale(results: DataFrame, ruleset: int | None = None, model: str | None = None) -> DataFrame:
    """Results made by another rule set or model; an axis that isn't named isn't tested, none: nothing is stale."""
    tests = [~F.col(c).eqNullSafe(F.lit(v)) for c, v in (("ruleset", ruleset), ("model", model)) if v is not None]
    return results.filter(tests[0] | tests[-1] if tests else F.lit(False))


def prune(artifacts: DataFrame, rows: int = MAX_ARTIFACTS, size: int = MAX_BYTES, key: str = "hash", at: str = "last_seen",
    of: str = "size") -> DataFrame:
    """The newest artifacts within both limits. At most `rows` can stay, so these are taken first (each task
    hands on no more) and only they are summed."""
    top = artifacts.orderBy(F.desc(at), F.desc(key)).limit(rows)
    running = Window.orderBy(F.desc(at), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("_sum", F.sum(of).over(running)).filter(F.col("_sum") <= size).drop("_sum")


def newest(df: DataFrame, at: str, tie: str, n: int = MAX_EVENTS) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(tie)).limit(n)


def without_tab(tab: Column, *stores: DataFrame) -> list[DataFrame]:
    return [s.filter(~F.col("tab_id").eqNullSafe(tab)) for s in stores]


#: The stores, and those that hold rows of a tab.
STORES = ("artifacts", "blobs", "sightings", "notes", "events", "results", "runtime", "fingerprints", "scripts", "externalScripts")
TAB_STORES = ("sightings", "notes", "runtime", "scripts", "externalScripts")


def clear_tab(tab: Column, stores: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All stores, those that hold rows of a tab without this tab's."""
    return {n: without_tab(tab, s)[0] if n in TAB_STORES else s for n, s in stores.items()}


def clear_all(stores: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All stores, with their columns and no rows; nothing is read."""
    return {n: s.sparkSession.createDataFrame([], s.schema) for n, s in stores.items()}


def unseen(artifacts: DataFrame, results: DataFrame, key: str = "hash") -> DataFrame:
    """Memoisation: only what has no result is analysed."""
    return artifacts.join(results.select(key), key, "left_anti")


#: What a stored analysis holds as JSON.
ANALYSIS = "struct<instructions:bigint,findings:array<struct<id:string,weight:int,confidence:double>>>"


def parsed(results: DataFrame, text: str = "analysis") -> DataFrame:
    """Stored results with their analysis read back from JSON; level, score and versions stay their own columns. A text that is no
    such JSON gives a null analysis and `readable` = false."""
    a = results.withColumn(text, F.from_json(F.col(text), ANALYSIS, {"mode": "PERMISSIVE"}))
    return a.withColumn("readable", F.coalesce(F.col(text)["findings"].isNotNull(), F.lit(False)))


def known(artifacts: DataFrame, results: DataFrame, key: str = "hash") -> DataFrame:
    """Artifacts with the result that is stored of them, if any: only the others are queued."""
    rest = [c for c in results.columns if c != key]
    a = artifacts.join(results.select(F.col(key).alias("_k"), F.struct(*rest).alias("result")), F.col(key) == F.col("_k"), "left")
    return a.withColumn("status", F.when(F.col("_k").isNotNull(), "complete").otherwise("queued")).drop("_k")


#: Stored artifacts and results.
ARTIFACTS = "hash long, size long, first_seen long, last_seen long, seen_count long, last_page_url string"
RESULTS = "hash long, at long, id long, value string"


def artifacts_of_both(old: Column, new: Column) -> dict[str, Column]:
    """An artifact seen before and again: what upsert_artifacts makes of all its sightings. What it was put in with stays."""
    later = F.struct(new["last_seen"], new["last_page_url"]) > F.struct(old["last_seen"], old["last_page_url"])
    return {"size": F.greatest(old["size"], new["size"]), "first_seen": F.least(old["first_seen"], new["first_seen"]), "last_seen": F.greatest(old["last_seen"], new["last_seen"]),
            "seen_count": old["seen_count"] + new["seen_count"], "last_page_url": F.when(later, new["last_page_url"]).otherwise(old["last_page_url"])}


def last_of_both(old: Column, new: Column) -> dict[str, Column]:
    """The later write wins, of equal times the one of the larger id, whichever batch it came in."""
    later = F.coalesce(F.struct(new["at"], new["id"]) >= F.struct(old["at"], old["id"]), F.lit(True))
    return {c: F.when(later, new[c]).otherwise(old[c]) for c in ("at", "id", "value")}
