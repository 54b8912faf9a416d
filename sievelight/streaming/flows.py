"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import store
from ..operators.ingest import gate
from ..sources.shared import shared_folder
from ..sources.tables import Stored


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stream of events, with event time and milliseconds."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a glob, as a file stream takes folders and patterns
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events[.]parquet")
    return e.withColumn("at", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("at")).withColumn("k",
        F.regexp_extract("props", r"(\d+)", 1).cast("long")).select("event_id", "at", "ms", "user_id", "event_type", "value", "k")


def latest_state(e: DataFrame) -> DataFrame:
    """Last write of each context: an aggregate kept in the state store, one row a context (no history)."""
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ms", "event_id")).alias("event_id"))


def deduplicated(e: DataFrame, horizon: str = "7 days") -> DataFrame:
    """First event of each (frame, fingerprint) within the watermark; what is remembered of older ones is dropped."""
    return e.withWatermark("at", horizon).dropDuplicatesWithinWatermark(["user_id", "k"])


def windowed(e: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Activity histogram by event time. The watermark is an extension: it bounds the state for late data."""
    return e.withWatermark("at", late).groupBy(F.window("at", size),
        "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def rate_limited(e: DataFrame, rate: int, window: int) -> DataFrame:
    """Windows restart at the first event after the last one ends; a frame's state is its window's start and count. Once the watermark has passed
    a window's end, its state goes: the next event begins a new window in any case. What is later than a window is dropped."""
    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ms", "event_id"], kind="stable")
        allowed, now = gate(pdf["ms"].tolist(), tuple(state.get) if state.exists else None, rate, window)
        state.update(now)
        state.setTimeoutTimestamp(max(now[0] + window, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "allowed": allowed})
    e = e.withWatermark("at", f"{window} milliseconds")
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "start long, n long", "append",
        GroupStateTimeout.EventTimeTimeout)


def merged(e: DataFrame, target: str, checkpoint: str, buckets: int = 64):
    """Upserts the last write of each context into a stored table: one row a context, whatever batches come or are repeated."""
    table = Stored(target, "hash", store.RESULTS, buckets)
    table.create(e.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        last = store.latest(batch.select(F.col("user_id").alias("hash"), F.col("ms").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("value")), "hash", "at", "id")
        table.merge(last, epoch, store.last_of_both)
    return e.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is now and returns what its sink, a table in the shared folder, then holds. Each batch
    writes under its own number, so one that is repeated writes the same again; complete results replace those before."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table" if mode == "complete" else f"{base}/table/epoch={epoch}")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation",
        f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table").select(*stream.columns)
