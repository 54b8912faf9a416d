"""Detection rules as data: each is a predicate, a confidence and its evidence, compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import CITATIONS, SUMMARIES, fixed, listed, percent, quoted, said, seconds

# Names of mining families, hash primitives and transports; what scripts are searched for is its own list.
MODULE_FAMILY = "(?i)coinhive|cryptonight|crypto-?loot|jsecoin|webminepool|deepminer|minero|monero|randomx|xmrig|nicehash"
HASH_PRIMITIVE = "(?i)argon2|scrypt|keccak|blake2|cryptonight"
SOCKET_HINT = "(?i)websocket|(?<![A-Za-z0-9_])ws(?![A-Za-z0-9_])|socket|stratum|postmessage|onmessage"
MIN_OBSERVED_MS = 20_000
RULESET_VERSION = 1
LEVELS = ("benign", "low", "medium", "high", "critical")


def ramp(v: Column, low: float, high: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))))


def half_up(v: Column, places: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n: the same IEEE steps in every engine."""
    scale = float(10 ** places)
    return F.floor(v * scale + 0.5).cast("double") / scale if places else F.floor(v + 0.5)


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    severity: str
    weight: int
    when: Column
    confidence: Column
    evidence: Column
    summary: str
    kind: str = "static"
    reference: str | None = None


def _matching(names: Column, pattern: str) -> Column:
    return F.filter(names, lambda n: F.regexp_like(n, F.lit(pattern)))


def _kernel_hit() -> Column:
    k = F.col("kernel")
    return k.isNotNull() & (k["bitwise_ratio"] >= 0.22) & (k["arithmetic_ratio"] >= 0.45)


def _kernel_confidence() -> Column:
    k = F.col("kernel")
    return F.least(ramp(k["bitwise_ratio"], 0.22, 0.4) * 0.7 + ramp(k["largest_loop"], 40, 400) * 0.3, F.lit(1.0))


def _some(*tests: Column) -> Column:
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))


def _rule(id: str, title: str, severity: str, weight: int, when: Column, confidence: Column, *measured: Column, kind: str = "static") -> Rule:
    return Rule(id, title, severity, weight, when, confidence, said(id, *measured), SUMMARIES[id], kind, CITATIONS.get(id))


def _kernel_said() -> Column:
    k = F.col("kernel")
    return said("hash-loop-density", k["func_idx"], k["largest_loop"], percent(k["bitwise_ratio"]), percent(k["arithmetic_ratio"]))


def module_rules() -> list[Rule]:
    """RUL-01 to RUL-12, over columns of module features."""
    c = F.col
    everything = F.concat("import_names", "export_names", "custom_names")
    family, primitive = _matching(everything, MODULE_FAMILY), _matching(F.concat("import_names", "export_names"), HASH_PRIMITIVE)
    socket = _matching(c("import_names"), SOCKET_HINT)
    n, kernel, conf = c("instruction_count"), _kernel_hit(), _kernel_confidence()
    shared, atomics, exports = c("memory_shared"), c("n_atomic"), c("export_count")
    small_api = (exports >= 1) & (exports <= 3) & (n > 2000)
    signs = _some(shared, atomics > 0, F.size(socket) > 0, small_api)
    beside = listed(" and ", F.when(shared, "shared memory for worker fan-out"),
        F.when(atomics > 0, F.concat(atomics.cast("string"), F.lit(" atomic operations"))),
                    F.when(F.size(socket) > 0, "a socket or message transport import"),
                    F.when(small_api, F.concat(F.lit("only "), exports.cast("string"), F.lit(" exported function(s) over "),
                        n.cast("string"), F.lit(" instructions"))))
    share = F.coalesce(F.try_divide(c("data_bytes").cast("double"), c("byte_length").cast("double")), F.lit(0.0))
    pages, grows, bounded = c("memory_initial_pages"), c("memory_grow_sites"), c("memory_max_pages").isNotNull()
    # Titles, weights and thresholds.
    return [
        _rule("known-miner-family", "Names a known browser mining family", "high", 45, F.size(family) > 0, F.lit(0.95), quoted(family, 4)),
        _rule("hash-primitive-symbols", "Exports a hashing primitive by name", "low", 12, F.size(primitive) > 0, F.lit(0.4), quoted(primitive)),
        Rule("hash-loop-density", "Tight loop of integer and bitwise arithmetic", "medium", 22, kernel, conf, _kernel_said(),
            SUMMARIES["hash-loop-density"], "static", CITATIONS["hash-loop-density"]),
        _rule("mining-corroborated", "Compute kernel combined with mining infrastructure", "high", 40, kernel & (signs >= 1),
            F.least(conf * (F.lit(0.6) + F.lit(0.2) * signs), F.lit(1.0)), _kernel_said(), beside),
        _rule("bitwise-dominant-module", "Module-wide instruction mix is bitwise integer work", "medium", 25,
            (n >= 200) & (c("bitwise_ratio") >= 0.12),
              ramp(c("bitwise_ratio"), 0.12, 0.3) * F.when(c("float_ratio") > 0.05, 0.5).otherwise(1.0), percent(c("bitwise_ratio")), n,
              percent(c("float_ratio"))),
        _rule("shared-memory-parallelism", "Shared memory with atomics, the shape of worker fan-out", "medium", 15, shared,
            F.when(atomics > 0, 0.7).otherwise(0.35), atomics),
        _rule("socket-transport", "Imports a socket or message transport", "low", 15, F.size(socket) > 0, F.lit(0.5), quoted(socket)),
        _rule("compute-kernel-surface", "Large compute body behind a very small API", "low", 10,
            (n >= 2000) & (exports <= 6) & (c("total_loops") >= 1), F.lit(0.45), n, c("total_loops"), exports),
        _rule("aggressive-memory-growth", "Requests and grows a large linear memory", "low", 10, (pages >= 256) | (grows > 0),
            F.when((pages >= 256) & ~bounded, 0.5).otherwise(0.25),
              pages, fixed(pages / 16, 1), F.when(~bounded, " with no declared maximum"), grows),
        _rule("large-embedded-payload", "Large embedded data payload", "info", 8, (c("data_bytes") >= 262_144) & (share >= 0.4),
            ramp(share, 0.4, 0.8), fixed(c("data_bytes") / 1024, 0), fixed(c("byte_length") / 1024, 0)),
        _rule("stripped-binary", "Symbol names stripped", "info", 4, c("stripped") & (n >= 500), F.lit(0.2)),
        _rule("incomplete-coverage", "Analysis did not cover the whole module", "info", 0, c("truncated_functions") + c("skipped") > 0,
            F.lit(1.0), c("truncated_functions"), c("skipped")),
    ]


def runtime_rules() -> list[Rule]:
    """RUL-13 to RUL-17, over a `runtime` struct beside the features; a null struct yields nothing."""
    r = F.col("runtime")
    kernel, conf = _kernel_hit(), _kernel_confidence()
    there = r.isNotNull()
    sustained = there & (r["observed_ms"] >= MIN_OBSERVED_MS) & (r["cpu_share"] >= 0.5)
    late, many, talks = r["mean_drift_ms"] >= 250, r["context_count"] > 1, r["socket_messages"] > 0
    signs = _some(many, late, talks)
    text = lambda x: x.cast("string")
    beside = listed(" and ", F.when(many, F.concat(text(r["context_count"]), F.lit(" contexts at once"))),
        F.when(late, F.concat(F.lit("its own timers running "), fixed(r["mean_drift_ms"], 0), F.lit("ms late"))),
                    F.when(talks, F.concat(text(r["socket_messages"]), F.lit(" messages over "), text(r["socket_count"]), F.lit(" socket(s)"))))
    cores = F.when(r["hardware_concurrency"] > 0, r["hardware_concurrency"]).otherwise(4)
    fanned = there & (r["context_count"] >= 2) & F.array_contains(r["contexts"],
        "worker") & (r["context_count"] >= F.greatest(F.lit(2), F.ceil(cores / 2)))
    ran, watched, share = seconds(r["wasm_time_ms"]), seconds(r["observed_ms"]), fixed(r["cpu_share"], 2)
    floor = F.when(r["timing_stopped"], ", and that is a floor: per-call timing was stopped to avoid becoming the cost itself")
    # Titles, weights and thresholds.
    return [
        _rule("sustained-execution", "Runs continuously rather than in bursts", "medium", 28, sustained, ramp(r["cpu_share"], 0.5, 2), ran,
            watched, r["context_count"], share, floor, kind="runtime"),
        _rule("mining-runtime-corroborated", "Compute kernel that then ran flat out", "high", 45, kernel & sustained,
            F.least(conf * F.least(F.lit(0.7) + F.lit(0.15) * signs, F.lit(1.3)), F.lit(1.0)),
              _kernel_said(), ran, watched, share, F.when(beside != "", F.concat(F.lit(", with "), beside)), kind="runtime"),
        _rule("worker-fan-out", "Executes in several workers at once", "medium", 20, fanned,
            F.least(F.lit(0.4) + F.lit(0.6) * ramp(r["context_count"] / cores, 0.5, 1), F.lit(1.0)), r["context_count"], cores, ran, kind="runtime"),
        _rule("persistent-socket-traffic", "Keeps a socket busy while it computes", "low", 12,
            there & (r["socket_count"] > 0) & (r["socket_messages"] >= 10) & (r["wasm_time_ms"] >= 5000), F.lit(0.45),
              r["socket_messages"], r["socket_count"], ran, kind="runtime"),
        _rule("runtime-not-yet-observed", "Runtime behaviour not observed for long enough", "info", 0,
            there & (r["observed_ms"] < MIN_OBSERVED_MS), F.lit(1.0), watched, seconds(F.lit(MIN_OBSERVED_MS)), kind="runtime"),
    ]


def model_rules(malicious: int = 0, benign: int = 0, contributions: Column | None = None) -> list[Rule]:
    """RUL-18, over a nullable column `probability`; what the model was trained on, and what moved it most."""
    p = F.col("probability")
    drivers = F.lit("") if contributions is None else F.array_join(F.transform(F.slice(contributions, 1, 3),
        lambda c: F.concat(c["name"], F.lit("="), fixed(c["value"], 3))), ", ")
    return [_rule("classifier-opinion", "A trained classifier considers this module suspicious", "medium", 18, p >= 0.6, ramp(p, 0.6, 0.95),
        F.lit(malicious), F.lit(benign), fixed(p, 2), drivers, kind="model")]


def script_rules() -> list[Rule]:
    """RUL-19 to RUL-24, over columns of script features."""
    c = F.col
    dense = c("escape_density") >= 0.05
    evaluators = c("eval") + c("function_constructor") + c("timer_string")
    decoders = c("atob") + c("base64_literals")
    shape = _some(c("web_assembly") > 0, c("worker") > 0, c("reads_concurrency"), c("web_socket") > 0)
    sites = lambda n, what: F.when(c(n) > 0, F.concat(c(n).cast("string"), F.lit(what)))
    loader = listed(", ", sites("web_assembly", " WebAssembly call(s)"), sites("worker", " Worker construction(s)"),
        F.when(c("reads_concurrency"), "a read of hardwareConcurrency"), sites("web_socket", " WebSocket(s)"))
    injections = c("create_element_script") + c("document_write") + c("import_scripts")
    # Titles, weights and thresholds.
    return [
        _rule("js-known-miner-family", "Names a known browser mining family", "high", 45, F.size("miner_names") > 0, F.lit(0.95),
            quoted(c("miner_names"), 4)),
        _rule("js-mining-pool-endpoint", "Contains a mining pool address", "high", 35, F.size("pool_endpoints") > 0, F.lit(0.8),
            quoted(c("pool_endpoints"))),
        _rule("js-obfuscated-source", "Source is escaped rather than merely minified", "medium", 20, dense & (c("byte_length") >= 200),
            F.least((c("escape_density") - 0.05) / 0.25, F.lit(1.0)), percent(c("escape_density"), 2)),
        _rule("js-decoded-code-execution", "Builds code at runtime out of encoded data", "high", 30, (evaluators > 0) & (decoders > 0),
            F.when(dense, 0.85).otherwise(0.5), evaluators, c("atob"), c("base64_literals"),
              F.when(dense, F.concat(F.lit(", in source that is "), percent(c("escape_density"), 2), F.lit(" escapes")))),
        _rule("js-miner-bootstrap-shape", "Has the shape of a WebAssembly miner's loader", "medium", 25, shape >= 3,
            F.when(shape == 4, 0.7).otherwise(0.45), loader),
        _rule("js-injects-remote-script", "Injects further scripts at runtime", "low", 8, injections > 0, F.lit(0.3), injections),
    ]


def supply_chain_rules() -> list[Rule]:
    """RUL-25, over columns unpinned, origins, first_origins and injected of a page's script references."""
    late = F.when(F.col("injected") > 0, F.concat(F.lit(", "), F.col("injected").cast("string"), F.lit(" of them added after the page parsed")))
    return [_rule("js-third-party-unpinned", "Runs third-party scripts with no integrity pin", "info", 6, F.col("unpinned") > 0,
        F.lit(0.35), F.col("unpinned"), F.col("origins"), quoted(F.col("first_origins")), late)]


def findings(rules: list[Rule], with_evidence: bool = True) -> Column:
    """Array of findings that hold, by weight times confidence, ties in the order of declaration. A confidence
    of 0 or less is dropped before rounding. Where only scores are asked for, evidence need not be put into words."""
    all_ = F.filter(F.array(*[
        F.when(F.coalesce(r.when, F.lit(False)) & (r.confidence > 0), F.struct(
            F.lit(r.id).alias("id"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), F.lit(r.weight).alias("weight"),
            half_up(r.confidence.cast("double"), 3).alias("confidence"), (r.evidence if with_evidence else F.lit(None).cast("string")).alias("evidence"), F.lit(r.title).alias("title"),
            F.lit(r.summary).alias("summary"), F.lit(r.reference).cast("string").alias("reference"), F.lit(i).alias("rule_order")))
        for i, r in enumerate(rules)]), lambda f: f.isNotNull())
    worth = lambda f: f["weight"] * f["confidence"]
    return F.array_sort(all_, lambda a, b: F.when(worth(a) > worth(b), -1).when(worth(a) < worth(b),
        1).when(a["rule_order"] < b["rule_order"], -1).when(a["rule_order"] > b["rule_order"], 1).otherwise(0))


def raw_score(f: Column) -> Column:
    return F.aggregate(f, F.lit(0.0), lambda m, x: m + x["weight"] * x["confidence"])


def score(f: Column) -> Column:
    return half_up(F.lit(100.0) * (F.lit(1.0) - F.exp(-raw_score(f) / F.lit(50.0)))).cast("int")


def unit_score(s: Column) -> Column:
    """The rules' score on 0..1, to be held against a classifier's probability."""
    return s / F.lit(100.0)


def level(s: Column) -> Column:
    return F.when(s >= 75, "critical").when(s >= 50, "high").when(s >= 25, "medium").when(s >= 10, "low").otherwise("benign")


def headline(lvl: Column, f: Column) -> Column:
    top = F.lower(F.get(F.filter(f, lambda x: x["weight"] > 0), 0)["title"])
    say = lambda a, b: F.coalesce(F.concat(F.lit(a), top, F.lit(".")), F.lit(b))
    return (F.when(lvl.isin("critical", "high"), say("Behaves like cryptomining code: ", "Strong indicators of unwanted computation."))
            .when(lvl == "medium", say("Worth a closer look: ", "Some indicators worth a closer look."))
            .when(lvl == "low", say("Mostly ordinary, with one thing to note: ", "Mostly ordinary, with minor notes."))
            .otherwise("Nothing unusual found. This looks like ordinary compiled code."))


def assess(df: DataFrame, rules: list[Rule], with_evidence: bool = True) -> DataFrame:
    """Adds findings, score, level and headline: one projection, no shuffle."""
    a = df.withColumn("findings", findings(rules, with_evidence)).withColumn("score", score(F.col("findings")))
    a = a.withColumn("level", level(F.col("score")))
    return a.withColumn("headline", headline(F.col("level"), F.col("findings"))).withColumn("ruleset_version", F.lit(RULESET_VERSION))


def level_rank(lvl: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), lvl), F.lit(0))


def page_scorecard(assessed: DataFrame, page: str, position: str) -> DataFrame:
    """Worst level (benign if none), highest score, counts, and the headline of the first at the worst level."""
    rank = level_rank(F.col("level"))
    best = F.struct(rank.alias("r"), (-F.col(position)).alias("p"), F.col("headline").alias("headline"))
    a = assessed.groupBy(page).agg(F.max(rank).alias("_r"), F.coalesce(F.max("score"), F.lit(0)).alias("max_score"), F.count("*").alias("modules"),
                                   F.count_if(F.col("level").isNull()).alias("unanalysed"), F.max(best)["headline"].alias("headline"))
    return a.withColumn("level", F.get(F.array(*map(F.lit, LEVELS)), F.greatest(F.col("_r").cast("int"), F.lit(1)) - 1)).drop("_r")


def catalogue(rules: list[Rule], spark) -> DataFrame:
    return spark.createDataFrame([(i, r.id, r.title, r.summary, r.severity, r.weight, r.kind, r.reference) for i, r in enumerate(rules)],
                                 "rule_order int, id string, title string, summary string, severity string, weight int, kind string, reference string")


def by_layer(assessed: DataFrame) -> DataFrame:
    return assessed.select("hash", F.explode("findings").alias("f")).groupBy("hash").pivot("f.kind",
        ["static", "runtime", "model"]).count().na.fill(0)


def alerts(assessed: DataFrame, seen: DataFrame, enabled: bool = True, keep: int = 200) -> DataFrame:
    """High and critical results whose key (origin|level|hash) is not among the newest `keep` seen ones."""
    recent = seen.orderBy(F.desc("ts"), F.desc("alert_key")).limit(keep)
    hot = assessed.filter(F.lit(enabled) & F.col("level").isin("high", "critical")).withColumn("alert_key",
        F.concat_ws("|", "origin", "level", "hash"))
    return hot.join(recent.select("alert_key"), "alert_key", "left_anti").dropDuplicates(["alert_key"])
