"""Streams whose state goes on from one micro-batch to the next: intake of captures, runtime evidence and alert memory.

Each operator is a keyed state processor. Its state stands in the state store, so that however the rows are cut into files, and
wherever a stream is stopped and started again, its result is that of one pass over all of them in order.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators import ingest
from ..operators.ingest import gate
from ..plans import rules
from ..sources.shared import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a fingerprint or a silent frame is remembered, in milliseconds of event time.
HORIZON_MS = 7 * 86_400_000
#: Keys that alerts remember.
REMEMBERED = 200
#: Shares and times are kept in whole billionths, so that what is taken back leaves nothing behind.
UNIT = 1_000_000_000


@contextlib.contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    """Keyed processors need the store on disk; the session's own choice is put back when the stream has started."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def drained(stream: DataFrame, target: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Runs a stream over what there is now and adds it to the table `target`, each micro-batch under its own number, so that a
    repeated one changes nothing; `then` is what is made of a micro-batch before it is written."""
    def write(batch: DataFrame, epoch: int) -> None:
        (then(batch) if then else batch).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
    with _store(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def in_files(rows: DataFrame, at: str, files: int, run: Callable[[DataFrame, str, str], None]) -> DataFrame:
    """Puts rows into a folder, one delivery after the other in the order of `at`, and runs a stream over it after each, from its
    checkpoint. Returns the table that the runs have written; `run` gets the stream, the table's folder and the checkpoint's."""
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(at), F.max(at)).first()
    for i in range(files):
        if low is None and i:
            break
        bound = lambda k: low + (high - low) * k // files
        part = rows if low is None else rows.filter((F.col(at) >= bound(i)) & (F.col(at) < bound(i + 1) if i < files - 1 else F.lit(True)))
        part.write.parquet(f"{base}/in/{i}")
        run(spark.readStream.schema(rows.schema).parquet(f"{base}/in/*"), f"{base}/table", f"{base}/state")
    return spark.read.parquet(f"{base}/table")


def _joined(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


class Intake(StatefulProcessor):
    """Of a frame: when each fingerprint was last seen, the window's start and count. A timer clears what is older than the horizon."""

    def __init__(self, rate: int, window: int, horizon: int) -> None:
        self.rate, self.window, self.horizon = rate, window, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "k long", "ms long")
        self.gate = handle.getValueState("gate", "start long, n long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _joined(rows, ["ms", "event_id"])
        held = self.gate.get() if self.gate.exists() else None
        state, last = (held[:2], held[2]) if held else (None, None)
        times: dict[int, int] = {}
        first = []
        for k, ms in zip(pdf["k"].tolist(), pdf["ms"].tolist(), strict=True):
            if k not in times and self.seen.containsKey((k,)):
                times[k] = self.seen.getValue((k,))[0]
            first.append(k not in times or ms - times[k] >= self.horizon)
            times[k] = max(ms, times.get(k, ms))
        for k, ms in times.items():
            self.seen.updateValue((k,), (ms,))
        pdf = pdf[first]
        allowed, state = gate(pdf["ms"].tolist(), state, self.rate, self.window)
        newest = max([*times.values(), *([] if last is None else [last])])
        self.gate.update((*state, newest) if state else (None, None, newest))
        if last is None:
            self.handle.registerTimer(newest + self.horizon)
        yield pdf.assign(allowed=allowed)[["user_id", "k", "ms", "event_id", "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        newest = self.gate.get()[2]
        if newest + self.horizon <= now:
            self.seen.clear()
            self.gate.clear()
        else:
            old = [k for k, v in self.seen.iterator() if v[0] + self.horizon <= now]
            for k in old:
                self.seen.removeKey(k)
            self.handle.registerTimer(newest + self.horizon)
        return iter(())

    def close(self) -> None:
        pass


def intake(e: DataFrame, rate: int = ingest.RATE, window: int = ingest.WINDOW_MS, horizon: int = HORIZON_MS) -> DataFrame:
    """Captures (user_id, k, ms, event_id, at) as an intake takes them: of each fingerprint of a frame the first, and again what was
    not seen for `horizon`; of these `allowed` tells whether the frame's rate lets them through. A micro-batch goes in the order of
    its times, which are after 1970; what is later than the watermark of one horizon is dropped."""
    e = e.withWatermark("at", f"{horizon} milliseconds")
    return e.groupBy("user_id").transformWithStateInPandas(Intake(rate, window, horizon),
        "user_id long, k long, ms long, event_id long, allowed boolean", "append", "EventTime")


def marked(taken: DataFrame, seen: DataFrame) -> DataFrame:
    """What was allowed, known where there is a stored result of its fingerprint (k), else to be analysed."""
    known = seen.select(F.col("k").alias("_k")).distinct()
    a = taken.filter("allowed").join(known, F.col("k") == F.col("_k"), "left")
    return a.withColumn("status", F.when(F.col("_k").isNotNull(), "known").otherwise("queued")).drop("_k", "allowed")


def taken_in(rows: DataFrame, seen: DataFrame, files: int, rate: int, window: int, horizon: int = HORIZON_MS) -> DataFrame:
    """(user_id, k, ms, event_id, status) of the captures that get through, from a stream that gets `files` files."""
    def run(stream: DataFrame, target: str, checkpoint: str) -> None:
        drained(intake(stream, rate, window, horizon), target, checkpoint, lambda batch: marked(batch, seen))
    return in_files(rows, "ms", files, run).drop("epoch")


#: What a context's last report gives to its module, in state; shares and drifts in billionths.
_GIVEN = "at long, id long, kind string, observed long, longest long, wasm long, calls long, share long, drift long, workers long, sockets long, messages long, cores long, stopped boolean"
_SUMS, _MOST = ("wasm", "calls", "share", "drift"), ("observed", "longest", "workers", "sockets", "messages", "cores")
RUNTIME = ("wasm_time_ms long, call_count long, observed_ms long, longest_call_ms long, cpu_share double, mean_drift_ms double, worker_count long, socket_count long, "
           "socket_messages long, hardware_concurrency long, timing_stopped boolean, contexts array<string>, context_count long")


class Evidence(StatefulProcessor):
    """Of a module: what each context gave last, the fold of it all, and what the last scoring saw. A new report takes its context's
    old share out of the sums and puts the new one in; maxima are looked up again only where the context that held one falls."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getMapState("given", "context long", _GIVEN)
        self.fold = handle.getValueState("fold", ", ".join(f"{c} long" for c in ("n", *_SUMS, *_MOST, "stopped")) + ", kinds string")
        self.scored = handle.getValueState("scored", "n long, share long, observed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _GIVEN.split(", ")]
        pdf = _joined(rows, ["at", "id"]).drop_duplicates("context", keep="last")
        held = self.fold.get() if self.fold.exists() else None
        n, sums, most, stopped = (held[0], dict(zip(_SUMS, held[1:5], strict=True)), dict(zip(_MOST, held[5:11], strict=True)), held[11]) if held else (0, dict.fromkeys(_SUMS, 0), {}, 0)
        kinds = dict((k, int(c)) for k, c in (x.rsplit(":", 1) for x in held[12].split("|") if x)) if held else {}
        fallen: set[str] = set()
        for row in pdf.to_dict("records"):
            new = {c: row[c] for c in names}
            if self.given.containsKey((row["context"],)):
                old = dict(zip(names, self.given.getValue((row["context"],)), strict=True))
                if (new["at"], new["id"]) < (old["at"], old["id"]):
                    continue
                for c in _SUMS:
                    sums[c] -= old[c]
                stopped -= int(old["stopped"])
                kinds[old["kind"]] -= 1
                fallen |= {c for c in _MOST if old[c] == most[c] and new[c] < old[c]}
            else:
                n += 1
            for c in _SUMS:
                sums[c] += new[c]
            stopped += int(new["stopped"])
            kinds[new["kind"]] = kinds.get(new["kind"], 0) + 1
            most = {c: max(most.get(c, new[c]), new[c]) for c in _MOST}
            self.given.updateValue((row["context"],), tuple(new[c] for c in names))
        if fallen:
            every = [dict(zip(names, v, strict=True)) for _, v in self.given.iterator()]
            most |= {c: max(v[c] for v in every) for c in fallen}
        kinds = {k: c for k, c in kinds.items() if c}
        self.fold.update((n, *(sums[c] for c in _SUMS), *(most[c] for c in _MOST), stopped, "|".join(f"{k}:{c}" for k, c in sorted(kinds.items()))))
        if self._worth(n, sums["share"], most["observed"]):
            self.scored.update((n, sums["share"], most["observed"]))
            yield pd.DataFrame([{"k": key[0], "wasm_time_ms": sums["wasm"], "call_count": sums["calls"], "observed_ms": most["observed"], "longest_call_ms": most["longest"],
                "cpu_share": sums["share"] / UNIT, "mean_drift_ms": sums["drift"] / UNIT / n, "worker_count": most["workers"], "socket_count": most["sockets"],
                "socket_messages": most["messages"], "hardware_concurrency": most["cores"], "timing_stopped": stopped > 0, "contexts": sorted(kinds), "context_count": n}])

    def _worth(self, n: int, share: int, observed: int) -> bool:
        if not self.scored.exists():
            return True
        was = self.scored.get()
        return n != was[0] or abs(share - was[1]) * 10 >= UNIT or was[2] < 20_000 <= observed

    def close(self) -> None:
        pass


def units(x: Column) -> Column:
    """Whole billionths, halves up."""
    return F.floor(x * UNIT + 0.5).cast("long")


def evidence(samples: DataFrame) -> DataFrame:
    """Reports (k, context, at, id, kind, observed_ms, ...: cumulative, so a context's last one counts) to the folds worth a new scoring, one a
    module and micro-batch: the first, another number of contexts, a share moved by 0.1 or more, or 20 s of observation just reached,
    each against the fold of the last scoring."""
    share = F.least(F.coalesce(F.try_divide(F.col("wasm_time_ms").cast("double"), F.col("observed_ms").cast("double")), F.lit(0.0)), F.lit(1.0))
    given = samples.select("k", "context", "at", "id", "kind", F.col("observed_ms").alias("observed"), F.col("longest_call_ms").alias("longest"),
        F.col("wasm_time_ms").alias("wasm"), F.col("call_count").alias("calls"), units(share).alias("share"), units(F.col("drift_ms")).alias("drift"),
        F.col("worker_count").alias("workers"), F.col("socket_count").alias("sockets"), F.col("socket_messages").alias("messages"),
        F.col("hardware_concurrency").alias("cores"), F.col("timing_stopped").alias("stopped"))
    return given.groupBy("k").transformWithStateInPandas(Evidence(), f"k long, {RUNTIME}", "append", "None")


def _with_features(batch: DataFrame, features: DataFrame) -> DataFrame:
    """Features are as many as there are modules, however small their table looks to the optimizer: a shuffle brings them together."""
    return batch.join(features.hint("merge"), "k")


def rescored(samples: DataFrame, features: DataFrame, files: int, with_evidence: bool = False) -> DataFrame:
    """(epoch, k, runtime, findings, score, level, ...): all rules run again, with the runtime evidence, for each fold that is
    worth it; features has `k` and the columns of module features. Modules without features are dropped."""
    fields = [c.split()[0] for c in RUNTIME.split(", ")]
    every = [*rules.module_rules(), *rules.runtime_rules()]

    def scored(batch: DataFrame) -> DataFrame:
        now = _with_features(batch.select("k", F.struct(*fields).alias("runtime")), features)
        return rules.assess(now, every, with_evidence).select("k", "runtime", "findings", "score", "level", "headline")

    def run(stream: DataFrame, target: str, checkpoint: str) -> None:
        drained(evidence(stream), target, checkpoint, scored)
    return in_files(samples, "at", files, run)


class Alerts(StatefulProcessor):
    """Of a viewer: the keys last alerted, oldest first."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getListState("keys", StructType().add("alert_key", "string"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _joined(rows, ["ms", "id"])
        memory = [k for (k,) in self.keys.get()] if self.keys.exists() else []
        there, fired = set(memory), []
        for k in pdf["alert_key"].tolist():
            fired.append(k not in there)
            if fired[-1]:
                memory.append(k)
                there.add(k)
                if len(memory) > self.keep:
                    there.discard(memory[-self.keep - 1])
        if any(fired):
            self.keys.put([(k,) for k in memory[-self.keep:]])
        yield pdf[fired][["viewer", "id", "ms", "alert_key"]]

    def close(self) -> None:
        pass


def alerts(assessed: DataFrame, keep: int = REMEMBERED) -> DataFrame:
    """Results (viewer, id, ms, origin, level, hash) to those that alert: high or critical ones whose key is not among the
    last `keep` keys that the viewer was alerted of. A key that is silent is not moved up."""
    hot = assessed.filter(F.col("level").isin("high", "critical"))
    key = F.concat_ws("|", F.coalesce("origin", F.lit("unknown page")), "level", F.coalesce(F.col("hash").cast("string"), F.lit("none")))
    return hot.select("viewer", "id", "ms", key.alias("alert_key")).groupBy("viewer").transformWithStateInPandas(Alerts(keep),
        "viewer long, id long, ms long, alert_key string", "append", "None")


def alerted(assessed: DataFrame, files: int, keep: int = REMEMBERED) -> DataFrame:
    """The alerts of a stream that gets `files` files, one after the other."""
    return in_files(assessed, "ms", files, lambda stream, target, checkpoint: drained(alerts(stream, keep), target, checkpoint)).drop("epoch")


def with_level_before(scored: DataFrame, key: str, at: str) -> DataFrame:
    """Adds `before`, the level of the key's last scoring before (null: none); where it is another, the level has changed."""
    return scored.withColumn("before", F.lag("level").over(Window.partitionBy(key).orderBy(at)))
