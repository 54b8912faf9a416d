"""Report queries: latest sightings, blind spots, feeds, histograms and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scans

from .ingest import host


def latest_sightings(sightings: DataFrame) -> DataFrame:
    """Newest sighting of each hash (of equal times the smallest id) and how many there are."""
    rest = [c for c in sightings.columns if c != "hash"]
    return sightings.groupBy("hash").agg(F.max_by(F.struct(*rest), F.struct("ts", -F.col("id"))).alias("_r"),
        F.count("*").alias("sightings")).select("hash", "sightings", "_r.*")


def tab_report(sightings: DataFrame, artifacts: DataFrame, analyses: DataFrame) -> DataFrame:
    return latest_sightings(sightings).join(artifacts, "hash").join(analyses, "hash", "left")


def ordered(report: DataFrame, missing: int = -1) -> DataFrame:
    return report.orderBy(F.coalesce("score", F.lit(missing)).desc(), F.col("last_seen").desc(), "hash")


def placed(report: DataFrame, group: str, missing: int = -1) -> DataFrame:
    """Adds the place of each row in its group's report, from 1, in the order of `ordered`; a group of any size is counted by ranges."""
    keyed = report.withColumns({"_score": -F.coalesce("score", F.lit(missing)), "_seen": -F.col("last_seen")})
    return scans.scanned(keyed, group, ["_score", "_seen", "hash"], sums={"place": F.lit(1).cast("long")}).drop("_score", "_seen")


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blind_spots(notes: DataFrame, sightings: DataFrame) -> DataFrame:
    """Notes whose URL is not the most recent URL of a captured hash."""
    return notes.join(latest_sightings(sightings).select("url").distinct(), "url", "left_anti")


def unanalysed(artifacts: Column, assessed: Column, blind: Column) -> Column:
    return F.greatest(F.lit(0), artifacts - assessed + blind)


def page_url(sightings: DataFrame, scripts: DataFrame) -> DataFrame:
    """Page of a tab: of its last sighting by id, else of its first script."""
    a = sightings.groupBy("tab_id").agg(F.max_by("page_url", "id").alias("_s"))
    b = scripts.groupBy("tab_id").agg(F.min_by("page_url", "id").alias("_c"))
    return a.join(b, "tab_id", "full").select("tab_id", F.coalesce("_s", "_c").alias("page_url"))


def activity_feed(events: DataFrame, analyses: DataFrame, at: str, tie: str, key: str, n: int = 200) -> DataFrame:
    return events.orderBy(F.desc(at), F.desc(tie)).limit(n).join(analyses, key, "left")


def histogram(events: DataFrame, ms: str, now: int, span: int = 300_000, buckets: int = 60) -> DataFrame:
    """(bucket, n), zero-filled: what is older than the span is dropped, what is in the future is in the last bucket."""
    spark = events.sparkSession
    if buckets <= 0:
        return spark.createDataFrame([], "bucket long, n long")
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    if span <= 0:
        return every.withColumn("n", F.lit(0).cast("long"))
    start = now - span
    at = F.least(F.lit(buckets - 1), F.floor((F.col(ms) - start) * buckets / F.lit(float(span))))
    return every.join(events.filter(F.col(ms) >= start).groupBy(at.cast("long").alias("bucket")).agg(F.count("*").alias("n")), "bucket",
        "left").na.fill(0, ["n"])


def badge(level: Column) -> Column:
    return F.when(level == "critical", "#b00020").when(level == "high", "#d9480f").when(level == "medium", "#e8a200").when(level == "low",
        "#4a7c59").otherwise("#6b7280")


def visible(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("score", F.lit(1)) > 0)


def flags(shared: Column, grow: Column, indirect: Column, stripped: Column, undecodable: Column) -> Column:
    named = (("shared memory", shared), ("grows memory", grow > 0), ("indirect calls", indirect > 0), ("stripped", stripped),
        ("undecodable", undecodable > 0))
    return F.array_compact(F.array(*[F.when(t, n) for n, t in named]))


def first_three(names: Column) -> Column:
    more = F.size(names) - 3
    return F.concat(F.array_join(F.slice(names, 1, 3), ", "),
        F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def host_or(url: Column, fallback: Column) -> Column:
    return F.coalesce(host(url), fallback)


def format_bytes(n: Column) -> Column:
    scaled = lambda by: F.format_string("%.1f", F.floor(n / by * 10 + 0.5) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 ** 2,
        F.concat(scaled(1024.0), F.lit(" KB"))).otherwise(F.concat(scaled(1024.0 ** 2), F.lit(" MB")))


def relative_time(ms: Column) -> Column:
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    part = lambda by, unit: F.concat(F.floor(s / by).cast("string"), F.lit(unit))
    return F.when(s < 5, "just now").when(s < 60, part(1, "s ago")).when(s < 3600, part(60, "m ago")).when(s < 86400,
        part(3600, "h ago")).otherwise(part(86400, "d ago"))


def source_label(source: Column) -> Column:
    return F.initcap(F.replace(F.coalesce(source, F.lit("unknown")), F.lit("-"), F.lit(" ")))


def argmax_sticky(df: DataFrame, group: str, name: str, value: str, order: str, default: str) -> DataFrame:
    """Name of the largest positive value, the first of equals; the default where none is."""
    best = F.max(F.when(F.col(value) > 0, F.struct(F.col(value).alias("worth"), (-F.col(order)).alias("place"), F.col(name).alias("name"))))
    return df.groupBy(group).agg(F.coalesce(best["name"], F.lit(default)).alias("active"))


def newest_modules(artifacts: DataFrame, analyses: DataFrame, at: str, key: str = "hash", n: int = 200) -> DataFrame:
    """The modules' half of an activity report: the newest n with what is known of them."""
    return artifacts.orderBy(F.desc(at), F.desc(key)).limit(n).join(analyses, key, "left")


def last_capture(events: DataFrame, at: str, tie: str, kind: str = "kind", captured: str = "captured", n: int = 200) -> DataFrame:
    """One row: when a capture last happened, among the newest n events; null where none of these is one."""
    return events.orderBy(F.desc(at), F.desc(tie)).limit(n).agg(F.max(F.when(F.col(kind) == captured, F.col(at))).alias("last_capture"))


def peak(counts: DataFrame) -> DataFrame:
    """The largest bucket of a histogram, 0 of an empty one."""
    return counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak"))


def badges(assessed: DataFrame, page: str, position: str) -> DataFrame:
    """Per page how many modules it has and the colour of its worst level."""
    from ..plans.rules import page_scorecard

    a = page_scorecard(assessed, page, position)
    return a.select(page, "modules", badge(F.col("level")).alias("colour"))
