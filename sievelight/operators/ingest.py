"""Intake: sniffing, identity, codecs, validation, dedupe and rate limits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans

MAX_BYTES, SNIFF_BYTES, TEXT_SHARE = 16 << 20, 4_096, 0.95
RATE, WINDOW_MS = 60, 60_000
SCRIPT_LEAST, SCRIPT_MOST = 40, 2 << 20


def is_module(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.expr("X'0061736D'"), F.lit(False))


def is_version_1(content: Column) -> Column:
    return F.coalesce(F.substring(content, 5, 4) == F.expr("X'01000000'"), F.lit(False))


def text_share(content: Column) -> Column:
    """Share of printable ASCII, tab, CR, LF and bytes from 0x80 in the first 4096 bytes; empty: 0."""
    head = F.decode(F.substring(content, 1, SNIFF_BYTES), "ISO-8859-1")
    return F.coalesce(F.try_divide(F.regexp_count(head, F.lit("[\\t\\r\\n\\x20-\\x7e\\x80-\\xff]")).cast("double"),
        F.length(head).cast("double")), F.lit(0.0))


def kind(content: Column, content_type: Column) -> Column:
    """wasm by magic; else null if the type claims wasm; else js if the type is textual and nearly all is text."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    textual = t.contains("javascript") | t.contains("ecmascript") | t.startswith("text/") | (t == "")
    return F.when(is_module(content), "wasm").when(t.contains("wasm"), F.lit(None)).when(textual & (text_share(content) > TEXT_SHARE), "js")


def identity(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(h: Column) -> Column:
    return F.substring(h, 1, 12)


def from_base64(text: Column) -> Column:
    """Padding may be missing; null where a character is wrong."""
    bare = F.regexp_replace(text, "=+$", "")
    return F.try_to_binary(F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "="), F.lit("base64"))


def page_fingerprint(content: Column) -> Column:
    """`length:hash` in base 36: FNV-1a of four length bytes and three windows of 4 KiB, at most 12,292 bytes a row."""
    @F.pandas_udf("string")
    def made(col: pd.Series) -> pd.Series:
        some = col.notna().to_numpy()
        out = pd.Series([None] * len(col), index=col.index, dtype=object)
        out[some] = fingerprints(col[some].tolist())
        return out
    return made(content)


def fingerprints(contents: list[bytes]) -> list[str]:
    """The hash goes byte by byte, but through all contents of a batch at once."""
    w = 4_096
    sizes = [len(d) for d in contents]
    read = [n.to_bytes(8, "little")[:4] + (d if n <= 3 * w else d[:w] + d[(n - w) // 2:(n - w) // 2 + w] + d[-w:]) for d,
        n in zip(contents, sizes, strict=True)]
    order = sorted(range(len(read)), key=lambda i: -len(read[i]))
    h = np.full(len(read), 0x811C9DC5, np.uint32)
    for f in range(0, len(order), 256):
        part = order[f:f + 256]
        longest = len(read[part[0]])
        table = np.zeros((longest, len(part)), np.uint32)
        for c, i in enumerate(part):
            table[:len(read[i]), c] = np.frombuffer(read[i], np.uint8)
        live = np.searchsorted([-len(read[i]) for i in part], -np.arange(longest), side="left")  # longer than the byte's place
        now = np.full(len(part), 0x811C9DC5, np.uint32)
        for row, n in zip(table, live.tolist(), strict=True):
            now[:n] = (now[:n] ^ row[:n]) * np.uint32(0x01000193)
        h[part] = now
    return [f"{base36(n)}:{base36(int(x))}" for n, x in zip(sizes, h, strict=True)]


def fingerprint(data: bytes) -> str:
    return fingerprints([data])[0]


def base36(n: int) -> str:
    out = ""
    while True:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        if not n:
            return out


def upload_status(size: Column, is_wasm: Column, claimed: Column, hashed: Column, known: Column) -> Column:
    """Answer of the ingest endpoint for one body."""
    return F.when((size == 0) | (size > MAX_BYTES), 400).when(~is_wasm, 415).when(claimed.isNotNull() & (F.lower(claimed) != hashed),
        409).when(known, 200).otherwise(202)


def upload_outcome(status: Column) -> Column:
    return F.when(status.isNull(), "unreachable").when(status == 200, "known").when(status == 202, "accepted").when(status == 413,
        "too-large").otherwise("rejected")


def validated(messages: DataFrame, apis: tuple[str, ...], contexts: tuple[str, ...]) -> DataFrame:
    """Adds context (default page) and reject (null: accepted)."""
    a = messages.withColumn("context", F.coalesce("context", F.lit("page")))
    return a.withColumn("reject", F.when(~F.coalesce(F.col("api").isin(*apis), F.lit(False)), "api").when(~F.col("context").isin(*contexts),
        "context").when(F.col("size").isNull() | (F.col("size") < 0) | (F.col("size") > MAX_BYTES), "size"))


def first_seen(df: DataFrame, frame: str, fp: str, at: str, tie: str) -> DataFrame:
    """First row of each fingerprint of a frame; deduped strictly before the rate gate."""
    cols = [c for c in df.columns if c not in (frame, fp)]
    return df.groupBy(frame, fp).agg(F.min_by(F.struct(*cols), F.struct(at, tie)).alias("_r")).select(frame, fp, "_r.*")


def gate(times: list[int], state: tuple[int, int] | None = None, rate: int = RATE, window: int = WINDOW_MS) -> tuple[list[bool],
    tuple[int, int] | None]:
    """Windows restart at the first event that is `window` after the last start."""
    out = []
    for t in times:
        if state is None or t - state[0] >= window:
            state = (t, 0)
        state = (state[0], state[1] + 1)
        out.append(state[1] <= rate)
    return out, state


def rate_limited(df: DataFrame, frame: str, ms: str, tie: str, rate: int = RATE, window: int = WINDOW_MS) -> DataFrame:
    """Adds `allowed`: whether an event is among the first `rate` of its frame's window. Windows depend on all events before, but no frame
    goes through one task: see scans.chained."""
    return scans.chained(df, frame, ms, tie, window, lambda places, starts: places - starts < rate, "allowed")


def inline_scripts(pages: DataFrame) -> DataFrame:
    """(page_id, pos, code, length, big_enough) of scripts without src and of a code type."""
    every = F.regexp_extract_all("html", F.lit(r"(?is)<script\b([^>]*)>.*?</script>"), F.lit(0))
    a = pages.select("page_id", F.posexplode(every).alias("pos", "tag"))
    head = F.regexp_extract("tag", r"(?is)^<script\b([^>]*)>", 1)
    kind_ = F.lower(F.regexp_extract(head, r"""(?i)\btype\s*=\s*["']?([^"'\s>]+)""", 1))
    a = a.filter(~F.regexp_like(head, F.lit(r"(?i)\bsrc\s*="))).filter(kind_.isin("", "module", "text/javascript", "application/javascript"))
    a = a.withColumn("code", F.regexp_extract("tag", r"(?is)^<script\b[^>]*>(.*)</script>$", 1)).withColumn("length", F.length("code").cast("long"))
    return a.select("page_id", F.col("pos").cast("long").alias("pos"), "code", "length",
        ((F.col("length") >= SCRIPT_LEAST) & (F.col("length") <= SCRIPT_MOST)).alias("big_enough"))


def host(url: Column) -> Column:
    """Lower-case host with a port that isn't the scheme's own; null where the URL can't be read."""
    scheme, name = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url,
        r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:(\d+)", 1)
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(name != "", F.when(own, name).otherwise(F.concat(name, F.lit(":"), port)))


def origin(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), host(url))


def third_party(script: Column, page: Column) -> Column:
    return F.coalesce(origin(script) != origin(page), F.lit(False))


def unpinned(references: DataFrame, page: str = "page_id") -> DataFrame:
    """Per page: third-party scripts without integrity, their origins and the first three by name, and how many were injected."""
    r = references.filter("third_party and not has_integrity")
    by = r.groupBy(page, "origin").agg(F.count("*").alias("_n"), F.count_if(F.col("injected")).alias("_i"))
    return by.groupBy(page).agg(F.sum("_n").alias("unpinned"), F.count("origin").alias("origins"), F.sum("_i").alias("injected"),
        F.slice(F.sort_array(F.collect_list("origin")), 1, 3).alias("first_origins"))


def network_notes(seen: DataFrame) -> DataFrame:
    path = F.lower(F.regexp_extract("url", r"^[^?#]*", 0))
    return seen.filter(F.coalesce(F.lower("content_type").contains("wasm"), F.lit(False)) | path.endswith(".wasm")).select("url", "tab_id",
        "ts", F.lit("network").alias("reason"))


def external_scripts(rows: DataFrame, at: str = "ts", tie: str = "id") -> DataFrame:
    """The first row of each script URL of a tab."""
    rest = [c for c in rows.columns if c not in ("tab_id", "url")]
    return rows.groupBy("tab_id", "url").agg(F.min_by(F.struct(*rest), F.struct(at, tie)).alias("_r")).select("tab_id", "url",
        "_r.*").select(*rows.columns)
