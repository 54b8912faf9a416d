"""Lexical queries: `documents` as scripts, with a tail of rare calls on every seventh; `pages` for inline scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical
from ..operators import ingest
from ..plans import rules
from ..plans.rules import half_up

# The tail, the same in both engines.
TAIL = (""" ;eval(atob("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5ejAxMjM0NTY3ODk=")); new WebSocket("wss://pool.example/x"); WebAssembly.instantiate; new Worker("w.js");"""
        """ navigator.hardwareConcurrency; xmrig; CoinHive; document.write("\\x41\\x42\\u0043"); setTimeout("go()", 1);"""
        """ import ("a"); importScripts("b.js"); String.fromCharCode(65); document.createElement("script"); new Function("x"); "stratum+tcp://a.example:1";""")

#: Terms of a query on modules that have no name of a miner.
SIGNATURES = "(?i)websocket|webassembly|coinhive|hardwareconcurrency"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(TAIL))).otherwise(F.col("text")).alias("source"))


def script_line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.measure(sources(spark, sf_dir)).select("doc_id", "line_count", "max_line", half_up(F.col("mean_line"), 6).alias("mean_line"))


def script_escape_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.measure(sources(spark, sf_dir)).select("doc_id", half_up(F.col("escape_density"), 6).alias("escape_density"))


def script_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.measure(sources(spark, sf_dir)).select("doc_id", "longest_literal", "base64_literals")


def script_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.entropy(sources(spark, sf_dir), "doc_id", "source").select("doc_id", half_up(F.col("entropy"), 6).alias("entropy"))


def script_api_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.measure(sources(spark, sf_dir)).select("doc_id", *lexical.APIS, "reads_concurrency")


def script_names_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.measure(sources(spark, sf_dir)).select("doc_id", F.array_join("miner_names", ",").alias("miner_names"),
        F.array_join("pool_endpoints", ",").alias("pool_endpoints"))


def script_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rules.assess(lexical.measure(sources(spark, sf_dir)), rules.script_rules())
    return a.select("doc_id", F.array_join(F.array_sort(F.transform("findings", lambda f: f["id"])), ",").alias("ids"), "score", "level")


def script_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = sources(spark, sf_dir)
    m = lexical.measure(src).join(lexical.entropy(src, "doc_id", "source"), "doc_id").withColumn("hash", F.sha2("source", 256))
    assert "source" not in lexical.stored(m).columns
    return lexical.stored(m).groupBy("hash").agg(F.max("byte_length").alias("byte_length"), F.max("eval_sites").alias("eval_sites"),
        F.max("entropy").alias("entropy"), F.count("*").alias("n"))


def label_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms are in lines of their own behind every third document."""
    from ..operators import modules

    told = F.concat("source", F.lit("\nnonce of yespower\n"), F.element_at(F.array(*map(F.lit, TERMS)),
        (F.col("doc_id") % len(TERMS) + 1).cast("int")), F.lit("\nstratum nonce _hash_cn\n"))
    a = sources(spark, sf_dir).withColumn("source", F.when(F.col("doc_id") % 3 == 0, told).otherwise(F.col("source")))
    a = a.select("doc_id", modules.ascii_runs(F.encode("source", "UTF-8")).alias("runs"))
    found = lexical.signature_contexts(a, "doc_id", "runs", lexical.SIGNATURES)
    return found.groupBy("term").agg(F.count("*").alias("docs"), F.max(F.length("context")).cast("long").alias("longest"))


# One for each alternative of the pattern, and what is none.
TERMS = ("CryptoNight", "crypto-night", "cryptonote", "my cn_slow_hash", "cn_hash", "x_hash_cn", "x_loot_cn", "coin-hive", "CoinImp",
    "crypto-loot", "deepMiner", "webminer", "minero", "equihash", "RandomX", "yescrypt", "argon2d",
         "cuckoo", "nimiq", "webdollar", "getwork", "jsecoin", "monero", "an xmr b", "zcash", "hushminer", "yazec", "jazec", "announced",
         "xmrx", "acn_hash")


def ascii_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import modules

    a = sources(spark, sf_dir).select("doc_id", modules.ascii_runs(F.encode("source", "UTF-8")).alias("runs"))
    return a.select("doc_id", F.size("runs").cast("long").alias("runs"),
        F.aggregate("runs", F.lit(0), lambda m, r: m + F.length(r)).cast("long").alias("chars"))


def inline_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.inline_scripts(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "pos", "length", "big_enough",
        F.md5("code").alias("code"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's scripts come from the three next pages' URLs; every third page pins them."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    q = p.select(F.col("page_id").alias("_p"), F.col("url").alias("src"),
        F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("d")).select((F.col("_p") - F.col("d")).alias("page_id"), "src")
    r = p.join(q, "page_id")
    return r.select("page_id", "url", "src", ingest.third_party(F.col("src"), F.col("url")).alias("third_party"),
        (F.col("page_id") % 3 == 0).alias("has_integrity"), (F.col("page_id") % 2 == 0).alias("injected"),
        ingest.origin(F.col("src")).alias("origin"))


def supply_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rules.assess(ingest.unpinned(references(spark, sf_dir)), rules.supply_chain_rules())
    return a.select("page_id", "unpinned", "origins", F.col("injected").alias("injected_scripts"), "score", "level")


def host_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.groupBy(ingest.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (script_line_stats, script_escape_density, script_literals, script_entropy, script_api_counts,
    script_names_endpoints, script_findings, script_summary, label_evidence, ascii_runs, inline_scripts, supply_chain, host_of)}

_Q = TAIL.replace("'", "''")
_S = f"WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '{_Q}' ELSE text END AS source FROM documents) "
_UP = "floor({} * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"
# The SQL spells its own patterns, in the dialect of its engine: it does not read those under test.
_RE2 = {
    "eval": r"\beval\s*\(", "function_constructor": r"""\bnew\s+Function\s*\(|\bFunction\s*\(\s*["''`]""",
    "atob": r"\batob\s*\(|decodeURIComponent\s*\(\s*escape\s*\(",
    "from_char_code": "fromCharCode", "document_write": r"document\s*\.\s*write(?:ln)?\s*\(",
    "create_element_script": r"""(?i)createElement\s*\(\s*["''`]script["''`]""",
    "import_scripts": r"\bimportScripts\s*\(", "dynamic_import": r"\bimport\s*\(", "web_assembly": r"\bWebAssembly\s*\.",
    "worker": r"\bnew\s+(?:Shared)?Worker\s*\(",
    "web_socket": r"\bnew\s+WebSocket\s*\(", "timer_string": r"""set(?:Timeout|Interval)\s*\(\s*["''`]""",
}
_N = lambda n: f"len(regexp_extract_all(source, '{_RE2[n]}'))::BIGINT"
_ESC = r"\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|[0-7]{2,3})"
_DENSITY = f"length(array_to_string(regexp_extract_all(source, '{_ESC}'), ''))::DOUBLE / length(source)"
_LIT = r"""(?s)"(?:\\.|[^"\\\r\n])*"|''(?:\\.|[^''\\\r\n])*''|`(?:\\.|[^`\\])*`"""
_INNER = f"list_filter(list_transform(regexp_extract_all(source, '{_LIT}'), lambda x: substr(x, 2, length(x) - 2)), lambda x: length(x) >= 16)"
_SIGNATURES = (r"(?i)crypto-?night|cryptonote|\bcn_(?:slow_)?hash|_hash_cn|_loot_cn|coin-?hive|coinimp|crypto-?loot|deepminer|webminer|minero|equihash|randomx|yespower|yescrypt|argon2d|cuckoo|nimiq"
               r"|webdollar|stratum|getwork|\bnonce\b|jsecoin|monero|\bxmr\b|zcash|hushminer|yazec|jazec")
_FAMILY = r"(?i)coinhive|cryptonight|crypto-?loot|jsecoin|webminepool|deepminer|minero|coinimp|monero|randomx|xmrig|nicehash|coinhave|minr\.pw"
_ENDPOINT = r"""(?i)stratum\+tcp://[^\s"'']{1,80}|wss?://[^\s"'']*(?:pool|xmr|monero|mine|stratum)[^\s"'']{0,60}"""
# distinct ones in the order of their first appearance, five at most
_FIND = lambda p: f"array_to_string(list_transform(list_filter(regexp_extract_all(source, '{p}'), lambda x, i: list_position(regexp_extract_all(source, '{p}'), x) = i)[1:5], lambda x: substr(x, 1, 80)), ',')"
_HOST = r"regexp_extract(lower({}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
_ORIGIN = r"regexp_extract(lower({}), '^[a-z][a-z0-9+.-]*://', 0) || " + _HOST
ORACLE_SQL = {
    "script_line_stats": _S + "SELECT doc_id, len(string_split(source, chr(10)))::BIGINT AS line_count, list_max(list_transform(string_split(source, chr(10)), lambda x: "
        "length(x)))::BIGINT AS max_line, " + _UP.format("(length(source)::DOUBLE / len(string_split(source, chr(10))))") + " AS mean_line FROM s",
    "script_escape_density": _S + "SELECT doc_id, " + _UP.format(f"({_DENSITY})") + " AS escape_density FROM s",
    "script_literals": _S + f"SELECT doc_id, coalesce(list_max(list_transform({_INNER}, lambda x: length(x))), 0)::BIGINT AS longest_literal, len(list_filter({_INNER}, lambda x: length(x) <= 4096 AND regexp_full_match(x, '[A-Za-z0-9+/=]{{64,}}')))::BIGINT AS base64_literals FROM s",
    "script_entropy": _S + ", c AS (SELECT doc_id, unnest(string_split(source, '')) AS c FROM s), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT *, "
        "sum(n) OVER (PARTITION BY doc_id) AS t FROM n) SELECT doc_id, " + _UP.format("(-sum(n::DOUBLE / t * log2(n::DOUBLE / t)))") + " AS entropy FROM t GROUP BY doc_id",
    "script_api_counts": _S + "SELECT doc_id, " + ", ".join(f"{_N(n)} AS {n}" for n in _RE2) + ", contains(source, 'hardwareConcurrency') AS reads_concurrency FROM s",
    "script_names_endpoints": _S + "SELECT doc_id, " + _FIND(_FAMILY) + " AS miner_names, " + _FIND(_ENDPOINT) + " AS pool_endpoints FROM s",
    "script_findings": _S + f""", f AS (SELECT doc_id, {_DENSITY} AS d, length(source) AS n, doc_id % 7 = 0 AS tail FROM s),
        g AS (SELECT *, tail AND d >= 0.05 AND n >= 200 AND d > 0.05 AS obf, least((d - 0.05::DOUBLE) / 0.25::DOUBLE, 1.0::DOUBLE) AS oc FROM f),
        r AS (SELECT doc_id, CASE WHEN tail THEN 45 * 0.95::DOUBLE + 35 * 0.8::DOUBLE + 30 * CASE WHEN d >= 0.05 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END + 25 * 0.7::DOUBLE + 8 * 0.3::DOUBLE + CASE WHEN obf THEN 20 * (floor(oc * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE) ELSE 0 END ELSE 0 END AS raw,
          CASE WHEN tail THEN 'js-decoded-code-execution,js-injects-remote-script,js-known-miner-family,js-miner-bootstrap-shape,js-mining-pool-endpoint' || CASE WHEN obf THEN ',js-obfuscated-source' ELSE '' END ELSE '' END AS ids FROM g),
        t AS (SELECT *, floor(100 * (1 - exp(-raw / 50.0::DOUBLE)) + 0.5)::INT AS score FROM r)
        SELECT doc_id, ids, score, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' WHEN score >= 10 THEN 'low' ELSE 'benign' END AS level FROM t""",
    "ascii_runs": _S + r", r AS (SELECT doc_id, list_transform(regexp_extract_all(source, '[\x20-\x7e]{5,}'), lambda x: substr(x, 1, 200)) AS runs FROM s) SELECT doc_id, "
        r"len(runs)::BIGINT AS runs, length(array_to_string(runs, ''))::BIGINT AS chars FROM r",
    "label_evidence": _S + ", v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || chr(10) || 'nonce of yespower' || chr(10) || [" + ", ".join(f"'{t}'" for t in TERMS) + f"][doc_id % {len(TERMS)} + 1] || chr(10) || 'stratum nonce _hash_cn' || chr(10) ELSE source END AS source FROM s)"
        r", r AS (SELECT doc_id, list_transform(regexp_extract_all(source, '[\x20-\x7e]{5,}'), lambda x: substr(x, 1, 200)) AS runs FROM v), u AS (SELECT "
            r"doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS pos FROM r),"
        f" t AS (SELECT doc_id, pos, run, unnest(list_distinct(list_transform(regexp_extract_all(run, '{_SIGNATURES}'), lambda x: lower(x)))) AS term FROM u), c AS (SELECT doc_id, term, length(substr(arg_min(run, pos), 1, 80)) AS n FROM t GROUP BY doc_id, term) SELECT term, count(*) AS docs, max(n)::BIGINT AS longest FROM c GROUP BY term",
    "inline_scripts": r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script>') AS tags FROM pages), u AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM t),
        c AS (SELECT page_id, pos, regexp_extract(tag, '(?is)^<script\b[^>]*>(.*)</script>$', 1) AS code FROM u) SELECT page_id, pos, length(code)::BIGINT AS length, length(code) BETWEEN 40 AND 2097152 AS big_enough, md5(code) AS code FROM c""",
    "supply_chain": "WITH r AS (SELECT p.page_id, " + _ORIGIN.format("q.url", "q.url") + " AS origin, " + _ORIGIN.format("p.url",
        "p.url") + """ AS own, p.page_id % 2 = 0 AS injected FROM pages p JOIN pages q ON q.page_id BETWEEN p.page_id + 1 AND p.page_id + 3),
        u AS (SELECT page_id, count(*) AS unpinned, count(DISTINCT origin) AS origins, count(*) FILTER (injected) AS injected_scripts FROM r WHERE origin <> own AND page_id % 3 <> 0 GROUP BY page_id)
        SELECT *, floor(100 * (1 - exp(-(6 * 0.35::DOUBLE) / 50.0::DOUBLE)) + 0.5)::INT AS score, 'benign' AS level FROM u""",
    "host_of": "SELECT " + _HOST.format("url") + " AS host, count(*) AS n FROM pages GROUP BY 1",
    "script_summary": _S + ", c AS (SELECT doc_id, unnest(string_split(source, '')) AS c FROM s), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT *, "
        "sum(n) OVER (PARTITION BY doc_id) AS t FROM n), e AS (SELECT doc_id, -sum(n::DOUBLE / t * log2(n::DOUBLE / t)) AS e FROM t GROUP BY doc_id)"
        " SELECT sha256(source) AS hash, max(length(source))::BIGINT AS byte_length, max(CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END)::BIGINT AS eval_sites, "
            "max(floor(e * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE) AS entropy, count(*) AS n FROM s JOIN e USING (doc_id) GROUP BY 1",
}
