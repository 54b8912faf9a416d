"""Intake of captures, skips and scripts, and the records written of analysed modules."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical, wasm
from ..plans import rules
from . import ingest, runtime, store

SUSPECT_MS = 3_000


def captures(messages: DataFrame) -> DataFrame:
    """Adds outcome (captured, or the reason of the first failed test), and of captured rows bytes, size and hash.
    The bytes are sniffed again: what the page says of them isn't asked."""
    a = messages.withColumn("bytes", ingest.from_base64(F.col("bytes_base64"))).drop("bytes_base64")
    n = F.octet_length("bytes")
    a = a.withColumn("outcome", F.when(F.col("bytes").isNull(), "undecodable").when((n == 0) | (n > ingest.MAX_BYTES), "size")
                     .when(~ingest.is_module(F.col("bytes")), "not-wasm").otherwise("captured"))
    kept = F.col("outcome") == "captured"
    return a.withColumns({"size": F.when(kept, n.cast("long")), "hash": F.when(kept, ingest.identity(F.col("bytes"))),
        "bytes": F.when(kept, F.col("bytes"))})


def capture_sinks(captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts and log events of a batch of captures; a stream hands its micro-batches to this."""
    good = captured.filter("outcome = 'captured'")
    return store.upsert_artifacts(good.select("hash", "size", "page_url", "ts")), good.select("ts", F.lit("captured").alias("kind"),
        "page_url", "tab_id", "hash", "size")


def skips(messages: DataFrame) -> DataFrame:
    """Each skipped capture as two rows, by the sink that they go to: a log event and a note."""
    m = messages.withColumn("context", F.coalesce("context", F.lit("page")))
    return m.withColumn("sink", F.explode(F.array(F.lit("events"), F.lit("notes"))))


def inline_store(messages: DataFrame) -> DataFrame:
    """One row a script text, of its first sighting: measured and scored here, the source goes no further."""
    a = messages.withColumn("hash", F.sha2(F.encode("source", "UTF-8"), 256))
    rest = [c for c in a.columns if c not in ("hash", "ts", "id")]
    first = a.groupBy("hash").agg(F.min_by(F.struct("ts", "id", *rest), F.struct("ts", "id")).alias("_r")).select("hash", "_r.*")
    scored = rules.assess(lexical.measure(first), rules.script_rules())
    return scored.select("hash", "id", "ts", "byte_length", "score", "level", F.transform("findings", lambda f: f["id"]).alias("finding_ids"))


def snapshot(df: DataFrame, *times: str) -> DataFrame:
    """Report of a monitor: times are whole milliseconds, halves up."""
    return df.withColumns({c: F.floor(F.col(c) + F.lit(0.5)) for c in times})


def rescored(now: DataFrame, before: DataFrame, assessed: DataFrame | Callable[[DataFrame], DataFrame], rule_set: list, key: str = "hash",
        with_evidence: bool = True) -> DataFrame:
    """Runs all rules again for the keys that the gate lets through, and no others. A function is given these keys and makes their
    rows, so that no other module need be decoded."""
    changed = runtime.worth_rescoring(now, before, key).filter("rescore").select(key)
    rows = assessed(changed) if callable(assessed) else assessed.join(changed, key, "left_semi")
    return rules.assess(rows, rule_set, with_evidence)


def evidence(assessed: DataFrame, signatures: DataFrame) -> DataFrame:
    """A labelling record for each module; signatures are (hash, term, context)."""
    found = signatures.groupBy("hash").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "context")))).alias("signatures"))
    k = F.col("kernel")
    return assessed.join(found, "hash", "left").select(
        "hash", "byte_length", "stripped", "function_count", "instruction_count", rules.half_up(F.col("bitwise_ratio"), 4).alias("bitwise_ratio"),
        rules.half_up(F.col("float_ratio"), 4).alias("float_ratio"), F.col("memory_initial_pages").alias("memory_pages"),
        F.when(k.isNotNull(), F.struct(k["largest_loop"].alias("loop_size"),
            rules.half_up(k["bitwise_ratio"], 4).alias("bitwise_ratio"))).alias("kernel"),
        F.struct("score", "level", F.transform("findings", lambda f: f["id"]).alias("findings")).alias("risk"),
        F.slice("export_names", 1, 40).alias("exports"), F.slice("import_names", 1, 40).alias("imports"),
        F.coalesce("signatures", F.create_map().cast("map<string,string>")).alias("signatures"))


def inspection(assessed: DataFrame, name: str = "hash") -> DataFrame:
    """One line of text a module."""
    text = lambda c: F.col(c).cast("string")
    share = lambda c: F.format_string("%.1f%%", rules.half_up(F.col(c) * 100, 1))
    parts = [text(name), F.concat(F.lit("funcs="), text("decoded_functions"), F.lit(" truncated="), text("truncated_functions")),
        F.concat(F.lit("instrs="), text("instruction_count")),
             F.concat(F.lit("loops="), text("total_loops"), F.lit(" nest="), text("max_nesting")),
             F.concat(F.lit("bitwise="), share("bitwise_ratio"), F.lit(" float="), share("float_ratio")),
             F.concat(F.lit("mem="), text("memory_initial_pages"), F.lit("p shared="), text("memory_shared")),
             F.concat(F.lit("warnings="), F.size("warnings").cast("string")),
             F.concat(F.lit("risk="), text("score"), F.lit("/100 "), F.col("level"))]
    return assessed.select(name, F.concat_ws(" | ", *parts).alias("line"))


def _timed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for h, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            start = time.perf_counter()
            ok = wasm.parse(data)["ok"]
            rows.append({"hash": h, "byte_length": len(data or b""), "ok": ok, "elapsed_ms": (time.perf_counter() - start) * 1000})
        yield pa.RecordBatch.from_pylist(rows,
            schema=pa.schema([("hash", pa.string()), ("byte_length", pa.int64()), ("ok", pa.bool_()), ("elapsed_ms", pa.float64())]))


def profile(blobs: DataFrame) -> DataFrame:
    """How long each module takes to decode, and whether that is suspect."""
    a = blobs.select(F.col("hash").cast("string"), "bytes").mapInArrow(_timed, "hash string, byte_length long, ok boolean, elapsed_ms double")
    return a.withColumn("suspect", F.col("elapsed_ms") > SUSPECT_MS)


def is_tab_report(report: Column) -> Column:
    """Whether a JSON text has the shape of a tab report."""
    kind = lambda path: F.substring(F.trim(F.get_json_object(report, path)), 1, 1)
    return F.coalesce((kind("$.artifacts") == "[") & (kind("$.notes") == "[") & (kind("$.scorecard") == "{"), F.lit(False))
