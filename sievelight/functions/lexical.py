"""Measurements of script source, as native string expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAN_CHARS, ENTROPY_CHARS = 4_194_304, 1_000_000
MIN_LITERAL, BASE64_LEAST, BASE64_MOST = 16, 64, 4_096
# What scripts are searched for. A word boundary is ASCII here, hence the look-behind.
_B = "(?<![A-Za-z0-9_])"
FAMILY = r"(?i)coinhive|cryptonight|crypto-?loot|jsecoin|webminepool|deepminer|minero|coinimp|monero|randomx|xmrig|nicehash|coinhave|minr\.pw"
ENDPOINT = r"""(?i)stratum\+tcp://[^\s"']{1,80}|wss?://[^\s"']*(?:pool|xmr|monero|mine|stratum)[^\s"']{0,60}"""
ESCAPES = r"\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|[0-7]{2,3})"
LITERAL = r"""(?s)"(?:\\.|[^"\\\r\n])*+"|'(?:\\.|[^'\\\r\n])*+'|`(?:\\.|[^`\\])*+`"""
SIGNATURES = (r"(?i)crypto-?night|cryptonote|\bcn_(?:slow_)?hash|_hash_cn|_loot_cn|coin-?hive|coinimp|crypto-?loot|deepminer|webminer|minero|equihash|randomx|yespower|yescrypt|argon2d"
              r"|cuckoo|nimiq|webdollar|stratum|getwork|\bnonce\b|jsecoin|monero|\bxmr\b|zcash|hushminer|yazec|jazec")
APIS = {
    "eval": _B + r"eval\s*\(", "function_constructor": _B + r"new\s+Function\s*\(|" + _B + r"""Function\s*\(\s*["'`]""",
    "atob": _B + r"atob\s*\(|decodeURIComponent\s*\(\s*escape\s*\(",
    "from_char_code": "fromCharCode", "document_write": r"document\s*\.\s*write(?:ln)?\s*\(",
    "create_element_script": r"""(?i)createElement\s*\(\s*["'`]script["'`]""",
    "import_scripts": _B + r"importScripts\s*\(", "dynamic_import": _B + r"import\s*\(", "web_assembly": _B + r"WebAssembly\s*\.",
    "worker": _B + r"new\s+(?:Shared)?Worker\s*\(",
    "web_socket": _B + r"new\s+WebSocket\s*\(", "timer_string": r"""set(?:Timeout|Interval)\s*\(\s*["'`]""",
}
#: Of each search, texts of which one (in lower case) is in whatever it finds. Searching for these is far cheaper.
LITERALS = {
    "eval": ("eval",), "function_constructor": ("function",), "atob": ("atob", "decodeuricomponent"), "from_char_code": ("fromcharcode",), "document_write": ("write",),
    "create_element_script": ("createelement",), "import_scripts": ("importscripts",), "dynamic_import": ("import",), "web_assembly": ("webassembly",),
    "worker": ("worker",), "web_socket": ("websocket",), "timer_string": ("settimeout", "setinterval"),
}
FAMILY_LITERALS = ("coinhive", "cryptonight", "cryptoloot", "crypto-loot", "jsecoin", "webminepool", "deepminer", "minero", "coinimp", "monero", "randomx", "xmrig", "nicehash",
                   "coinhave", "minr.pw")
ENDPOINT_LITERALS = ("stratum+tcp://", "ws://", "wss://")


def _any_api() -> str:
    """One alternation of all calls. None can begin inside a match of another, so one pass finds what twelve would."""
    return "|".join(f"(?i:{p.removeprefix('(?i)')})" if p.startswith("(?i)") else f"(?:{p})" for p in APIS.values())


def _holds(low: Column, literals: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(x) for x in literals])


def api_counts(hits: Column) -> dict[str, Column]:
    """The number of calls of each kind among the hits, which their literal tells apart."""
    of = lambda literals: F.size(F.filter(hits, lambda h: _holds(F.lower(h), literals))).cast("long")
    # the hits of one kind may hold the literal of another: a worker's script is imported by importScripts, not by import
    own = {n: of(x) for n, x in LITERALS.items()}
    return own | {"dynamic_import": own["dynamic_import"] - own["import_scripts"]}


def entropy_of(text: str) -> float | None:
    """Bits a character; none for an empty text."""
    codes = np.frombuffer(text[:ENTROPY_CHARS].encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return None
    n = np.unique(codes, return_counts=True)[1].astype(float)
    return float(np.log2(len(codes)) - (n * np.log2(n)).sum() / len(codes))


def entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entropy) in bits a character of the first million. Characters are counted inside the row, with NumPy; nothing
    is exploded or shuffled. Rows without text are left out."""
    @F.pandas_udf("double")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(entropy_of, na_action="ignore").astype("float64")
    return df.select(key, measured(F.col(text)).alias("entropy")).filter("entropy is not null and not isnan(entropy)")


def _names(text: Column, pattern: str) -> Column:
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.substring(m, 1, 80))), 1, 5)


def measure(df: DataFrame, text: str = "source") -> DataFrame:
    """Adds all measurements but the entropy. Empty or null sources have ok = false; of sources over 4 Mi
    characters the first 4 Mi are searched, byte_length stays true and coverage is the searched share."""
    full, s = F.coalesce(F.col(text), F.lit("")), F.col("_scan")
    a = df.withColumn("ok", F.length(full) > 0).withColumn("byte_length", F.length(full).cast("long")).withColumn("_scan",
        F.substring(full, 1, SCAN_CHARS))
    a = a.withColumn("coverage", F.when(F.col("ok"), F.length(s) / F.col("byte_length")).otherwise(1.0)).withColumn("_lines", F.split(s, "\n", -1))
    longest = F.array_max(F.transform("_lines", lambda x: F.length(x)))
    a = a.withColumn("line_count", F.size("_lines").cast("long")).withColumn("max_line", longest.cast("long"))
    a = a.withColumn("mean_line", F.length(s) / F.col("line_count"))
    escaped = F.aggregate(F.regexp_extract_all(s, F.lit(ESCAPES), F.lit(0)), F.lit(0), lambda m, x: m + F.length(x))
    a = a.withColumn("escape_density", F.coalesce(F.try_divide(escaped.cast("double"), F.length(s).cast("double")), F.lit(0.0)))
    inner = F.transform(F.regexp_extract_all(s, F.lit(LITERAL), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    a = a.withColumn("_literals", F.filter(inner, lambda x: F.length(x) >= MIN_LITERAL))
    a = a.withColumn("longest_literal", F.coalesce(F.array_max(F.transform("_literals", lambda x: F.length(x))), F.lit(0)).cast("long"))
    a = a.withColumn("base64_literals", F.size(F.filter("_literals", lambda x: (F.length(x) <= BASE64_MOST) & F.regexp_like(x,
        F.lit(rf"\A[A-Za-z0-9+/=]{{{BASE64_LEAST},}}\z")))).cast("long"))
    low, hits = F.col("_low"), F.col("_hits")
    a = a.withColumn("_low", F.lower(s))
    none = F.array().cast("array<string>")
    called = _holds(low, tuple(x for literals in LITERALS.values() for x in literals))
    a = a.withColumn("_hits", F.when(called, F.regexp_extract_all(s, F.lit(_any_api()), F.lit(0))).otherwise(none))
    a = a.withColumns(api_counts(hits))
    a = a.withColumn("miner_names", F.when(_holds(low, FAMILY_LITERALS), _names(s, FAMILY)).otherwise(none))
    a = a.withColumn("pool_endpoints", F.when(_holds(low, ENDPOINT_LITERALS), _names(s, ENDPOINT)).otherwise(none))
    a = a.withColumn("reads_concurrency", s.contains("hardwareConcurrency"))
    return a.drop("_scan", "_lines", "_literals", "_low", "_hits")


def stored(measured: DataFrame) -> DataFrame:
    """What is kept of a script: never its source."""
    down = lambda c, n: F.floor(F.col(c) * 10.0 ** n + 0.5).cast("double") / 10.0 ** n
    return measured.select("hash", "byte_length", "line_count", "max_line", down("escape_density", 5).alias("escape_density"),
        down("entropy", 2).alias("entropy"), "longest_literal", "base64_literals",
                           (F.col("eval") + F.col("function_constructor") + F.col("timer_string")).alias("eval_sites"), "atob",
                           "miner_names", "pool_endpoints", "reads_concurrency")


def signature_contexts(df: DataFrame, key: str, runs: str, terms: str) -> DataFrame:
    """First context (80 characters) of each lower-cased term over an array of runs, in order of the runs."""
    a = df.select(key, F.posexplode(runs).alias("pos", "run"))
    a = a.withColumn("term", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("run", F.lit(terms), F.lit(0)), lambda t: F.lower(t)))))
    return a.groupBy(key, "term").agg(F.min_by(F.substring("run", 1, 80), "pos").alias("context"))
