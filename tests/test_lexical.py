"""One pass over a script finds what a pass a pattern would."""

import random
import re

from sievelight.functions import lexical

PIECES = ["eval", "new ", "Function", "(", '"', "'", " ", "\n", "atob", "decodeURIComponent", "escape", "fromCharCode", "document", ".", "write", "writeln", "createElement",
          "CREATEELEMENT", "script", "SCRIPT", "import", "importScripts", "WebAssembly", "Worker", "Shared", "WebSocket", "setTimeout", "setInterval", "_", "x", "é", "İ", "`",
          "eval(", "atob(", "import(", "new Worker(", 'setTimeout("', "CoinHive", "xmrig", "crypto-loot", "wss://pool", "stratum+tcp://a", "K"]


def test_calls_are_those_of_twelve_passes(spark):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(3_000)]
    got = lexical.measure(spark.createDataFrame(list(enumerate(texts)), "id long, source string")).select("id", *lexical.APIS, "miner_names", "pool_endpoints").collect()
    found = 0
    for r in got:
        for name, p in lexical.APIS.items():
            n = len(re.findall(p, texts[r.id]))
            assert r[name] == n, (name, texts[r.id])
            found += n
        names = list(dict.fromkeys(m.group(0)[:80] for m in re.finditer(lexical.FAMILY, texts[r.id])))[:5]
        assert r.miner_names == names
    assert found > 1_000


def test_every_search_has_its_literals():
    assert lexical.LITERALS.keys() == lexical.APIS.keys()
    for name, p in lexical.APIS.items():
        words = {w.lower() for w in re.findall("[A-Za-z]{4,}", p)}
        assert all(any(w in literal for w in words) for literal in lexical.LITERALS[name]), name


def test_one_regular_expression_for_all_calls(spark):
    plan = lexical.measure(spark.createDataFrame([("x",)], "source string")).select(*lexical.APIS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
