"""Operators against brute force and their SQL, and the awkward inputs that each must bear."""

import collections
import itertools
import html
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievelight.llm import chat, common, copies, extraction, mixing, neighbours, packing, quality, sharding, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, g string, score string, fp string"
LONG = "word " * 60_000
AWKWARD = [(1, "A b c d e f", "en", "s", 1, "x", "y", "z", "w"), (1, "A b c d e f", "en", "s", 1, "x", "y", "z", "w"), (2, None, None, None, None, None, None, None, None), (3, "", "en", "t", 0, "", "", "", ""),
           (None, "some text here", "en", "s", 3, "", "", "", ""), (5, LONG, "en", "s", 9, "", "", "", ""), (6, "a b c d e f", "en", None, 1, "", "", "", "")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if re.match(r"op\d", n)])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    cell = lambda x: None if x is None or x != x else round(float(x), 6) if not isinstance(x, str) else x
    rows = lambda d: sorted(repr([cell(x) for x in r]) for r in d[sorted(d.columns)].astype(object).where(lambda v: v.notna(), None).itertuples(index=False))
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for n in (10, 10**4, 10**7):
        p = simhash.plan_for(sample, n)
        assert sum(p.thresholds) == simhash.MAX_DIFFERENCE - len(p.masks) + 1 and sum(m.bit_count() for m in p.masks) == 64
        for _ in range(300):
            d = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any((d & m).bit_count() <= t for m, t in zip(p.masks, p.thresholds, strict=True))


def test_links_give_all_components(spark, monkeypatch):
    """Random centres with flips, in buckets above the block size too."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = np.random.default_rng(3)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in rng.integers(0, 2**63, 8) for k in (0, 1, 2, 3, 4, 5) for _ in range(25)} | {int(x) for x in rng.integers(0, 2**63, 300)}
    f = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 4
    label = np.arange(len(f))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    got = [root.get(int(x), int(x)) for x in f.view(np.int64)]
    assert len({*zip(got, label.tolist())}) == len(set(got)) == len(set(label.tolist()))


def test_fingerprint_against_a_plain_reading(docs):
    """By the words of the contract: A-Z lower-cased, words of other characters than white space, 4-word shingles with repeats."""
    import xxhash

    def plain(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not words:
            return 0
        grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
        hashes = [xxhash.xxh64(g.encode("utf-8"), seed=42).intdigest() for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    texts = [r.text for r in docs.select("text").collect()] + [None, "", " \n", "A", "a b c", "a b c d", "É É é e\u00a0x y", "same " * 9, "x\x1cy Z\x0bq \u3000 w"]
    assert all(simhash.fingerprint(t) == plain(t) for t in texts)


def test_simhash_awkward(awkward, empty):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD) and {r.component_id for r in got if r.doc_id in (2, 3)} == {2} and {r.component_id for r in got if r.doc_id in (1, 6)} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(awkward)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 5] and kept.columns == awkward.columns
    assert simhash.fingerprint("A b") == simhash.fingerprint("a\tb") != 0 == simhash.fingerprint(" \n")


def test_near_copies_of_the_pipeline(spark, monkeypatch):
    monkeypatch.setattr(copies, "BLOCK", 16)
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        for edits in (0, 1, 2, 3, 4, 5, 7, 9, 12, 20):
            now = list(base)
            for at in rng.choice(200, edits, replace=False):
                now[at] = f"v{rng.integers(10**6)}"
            texts.append(" ".join(now))
    hot = [f"w{x}" for x in rng.integers(0, 10**6, 200)]  # more copies than a block holds
    texts += [" ".join([*hot[:i], "x", *hot[i + 1:]]) for i in range(60)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and 13 < len(set(root)) < 100


def test_near_copies_are_dropped_by_row(spark):
    run = lambda c: [f"{c}{i}" for i in range(100)]
    a, b, d = run("a"), run("b"), run("d")
    near = lambda x: " ".join([*x[:99], "other"])
    rows = [(1, " ".join(a)), (7, near(a)), (7, " ".join(b)), (7, " ".join(b)), (None, near(b)), (None, " ".join(d)), (None, near(d))]
    kept = [(r.doc_id, r.text[0]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == [(1, "a"), (7, "b"), (None, "d")]


def test_quality_statistics(docs, labels, awkward, empty):
    def want(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(win)
        ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len({j for i, x in enumerate(win) if c[x] > 1 for j in (i, i + 1, i + 2)})
    for df in (docs.select("doc_id", "text"), awkward.select("doc_id", "text")):
        for r in quality.statistics(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want(r.text)
    out = quality.quality(awkward, labels)
    assert out.count() == len(AWKWARD) and not any(r.kept for r in out.collect() if r.doc_id in (2, 3))
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_rules_are_learned():
    rng = np.random.default_rng(0)
    rows = [({f: float(rng.random()) for f in quality.FEATURES} | {"upper_share": float(u), "n_words": 100.0}, bool(u > 0.7)) for u in rng.random(900)]
    rules = quality.learn(rows)
    assert rules and sum(any(all(c.holds(r) for c in rule) for rule in rules) == bad for r, bad in rows) > 880


def test_mixing(spark, awkward, empty):
    got = {r.source: r for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 10), ("c", 1000), (None, 0)], "source string, source_size long")).collect()}
    assert sum(r.target for r in got.values()) == pytest.approx(1020) and got["a"].target == 30 and got["b"].target == 30 and got["c"].target == pytest.approx(960)
    out = mixing.mix(awkward)
    assert out.count() == len(AWKWARD) and all(0 <= r.taken <= 3 * r.size for r in out.collect())
    assert mixing.mix(empty).count() == 0 and mixing.emitted(awkward).columns == awkward.columns


def test_stages_leave_own_columns_alone(spark, awkward, labels):
    names = ("N_Words", "kept", "rule", "score", "size", "copies", "_copy", "_id", "component_id")
    text = " ".join(f"w{i}" for i in range(80))
    own = awkward.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(7, text, "s")], "doc_id long, text string, source string"))
    own = own.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for out in (quality.accepted(own, labels), toxicity.clean(own, labels), simhash.keep_one(own), mixing.emitted(own)):
        rows = out.collect()
        assert out.dtypes == own.dtypes and rows and all(r[n] == f"own {n}" for r in rows for n in names)


def test_packing(awkward, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    path = packing.vocabulary()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("a  b", "x\n\ny", " lead", "trail  ", "é ü <|endoftext|> 12'll", "　　", "日本 語", ""):
        assert packing.token_ids(t, path).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0]
    rows = packing.pack(awkward, path, 64).collect()
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    ids = packing.token_ids(LONG, path)
    assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in rows if r.doc_id == 5) and sum(r.length for r in rows if r.doc_id == 5) == len(ids)
    assert packing.pack(empty, path).count() == 0


def test_tokens_of_long_runs():
    from tokenizers import Tokenizer
    import public_tokenizers

    path, tok = packing.vocabulary(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(6)
    parts = [*" \n\t\u3000\x85\xa0\x1cab1!é<|>'s", "<|endoftext|>", " " * 70, "\n" * 65, " " * 66, "x\x1d"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(600)] + [c * 20_000 + e for c in " \na!1é\u3000" for e in ("", "b", " b")]
    for t in texts:
        assert packing.token_ids(t, path).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], t[:80]
    for c in " \na!\u3000":
        assert len(packing.token_ids(c * 1_000_000 + "b", path)) > 1_000


def test_islands_beat_best_fit_on_triplets(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(500, 820, (2, 100)).tolist()
    lengths = [x for i, j in zip(a, b) for x in (i, j, 2048 - i - j)]
    plain = packing.Packing(lengths, 2048).best_fit(sorted(range(300), key=lambda i: -lengths[i]))
    rows = packing.islands(spark.createDataFrame([(i, n, 0) for i, n in enumerate(lengths)], "uid long, length long, cell long"), 2048).collect()
    assert sorted(r.uid for r in rows) == list(range(300)) and len({r.sequence_id for r in rows}) < len(plain.bins)
    one = packing.evolve(lengths, 2048, 1)
    assert packing.evolve(lengths, 2048, 2, [one.bins, packing.evolve(lengths, 2048, 3).bins]).fitness >= one.fitness > plain.fitness


def test_evolution_is_no_worse_than_best_fit():
    rng = np.random.default_rng(5)
    lengths = rng.integers(300, 900, 300).tolist()
    plain = packing.Packing(lengths, 2048).best_fit(sorted(range(300), key=lambda i: -lengths[i]))
    best = packing.evolve(lengths, 2048, 1)
    assert best.fitness >= plain.fitness and sorted(i for b in best.bins for i in b) == list(range(300)) and max(best.fills) <= 2048


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[50:90] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(600, None, 0), (700, [0.0] * 16, 0), (800, [float("nan")] * 16, 0), (900, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = collections.defaultdict(list)
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    for q, near in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        hit += len({v for v, _ in near} & set(best.tolist()))
        assert [s for _, s in near] == pytest.approx([d[v] for v, _ in near], abs=1e-12) and len(near) == 10
    assert hit >= 0.9 * 60 and [v for v, _ in got[0]] == list(range(50, 60))
    assert neighbours.search(df.limit(0)).count() == 0 and neighbours.search(df.filter("vec_id < 3")).count() == 2


def test_neighbours_of_clustered_and_far_off_vectors(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 24)) + 1e4
    df = spark.createDataFrame([(i, v.tolist(), 5) for i, v in enumerate(x)] + [(i, [1.0, 2.0], 5) for i in range(5000, 5100)], "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(set)
    for r in neighbours.search(df).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert sorted(got) == list(range(0, 3000, 100)) and hit >= 0.95 * 300


def test_of_two_equally_frequent_dimensions_the_smaller_takes_part(spark):
    rows = [(i, [float(i + 1)] * (2 + i % 2), "x") for i in range(0, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = neighbours.search(df, k=3, every=10).collect()
    assert {r.query_id for r in got} == {0, 10, 20, 30} and all(r.vec_id % 2 == 0 for r in got) and len(got) == 12
    assert [r.vec_id for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 10] == [8, 12, 6]


def test_windows_grow_slower_than_rows():
    share = [neighbours.CURVES * neighbours.window(n) / n for n in (5_000, 10_000, 100_000, 10**7, 10**9)]
    assert share == sorted(share, reverse=True) and share[0] < 1 and share[-1] < 0.1


def test_hilbert_is_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = neighbours.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_sharding(spark, docs, awkward, empty):
    hot = docs.select("doc_id", "text").union(spark.range(1000, 1150).select("id", F.lit("same").alias("text")))
    for df, n in ((hot, hot.count()), (awkward, len(AWKWARD))):
        rows = sharding.shard(df).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in by.values()) and all(0 <= s < 24 for s in by)
        sizes = [len(by.get(s, [])) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.shard(empty).count() == 0
    where = collections.defaultdict(set)
    for r in sharding.shard(hot).collect():
        where[r.text_crc32].add(r.shard)
    assert len(where[zlib.crc32(b"same")]) <= 12


def _shards_of_texts(spark, texts):
    where = collections.defaultdict(set)
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    for r in rows:
        where[r.text_crc32].add(r.shard)
    return where


def test_sharding_of_groups_only(spark):
    sizes = [2, 3, 4] * 400
    where = _shards_of_texts(spark, [f"group {i}" for i, n in enumerate(sizes) for _ in range(n)])
    assert sum(len(s) > 1 for s in where.values()) < 24


def _least_cut(sizes, quota):
    """Fewest cuts of any sharding, by search: groups whole or in parts over shards with these quotas."""
    best = [10**9]

    def go(i, room, cuts):
        if cuts >= best[0]:
            return
        if i == len(sizes):
            best[0] = cuts
            return
        for k in range(1, len(room) + 1):
            for where in itertools.combinations(range(len(room)), k):
                if sum(room[s] for s in where) >= sizes[i] and all(sum(room[s] for s in where if s != w) < sizes[i] for w in where):
                    left, now = sizes[i], list(room)
                    for s in sorted(where, key=lambda s: now[s]):  # fill the smaller rooms
                        take = min(left, now[s])
                        now[s], left = now[s] - take, left - take
                    go(i + 1, now, cuts + k - 1)
    go(0, list(quota), 0)
    return best[0]


def test_cut_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        sizes = rng.integers(2, 9, 6).tolist()
        texts = [f"group {i}" for i, n in enumerate(sizes) for _ in range(n)] + [f"one {i}" for i in range(int(rng.integers(0, 6)))]
        at = sharding.placed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3)
        r = sharding.cut_links(at, 3).first()
        best = _least_cut(sorted(sizes, reverse=True), sharding.quotas(len(texts), 3))
        assert r.links == sum(sizes) - 6 and r.least <= best <= r.cut < best + 3


def test_places_are_those_of_one_sort(spark, monkeypatch):
    monkeypatch.setattr(common, "RANGE_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = [(None if k == 3 else f"k{k}", int(v), i) for i, (k, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2, 3], 900), rng.integers(0, 30, 900)))]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    at = collections.defaultdict(list)
    for r in common.numbered(df, ["k"], ["v", "i"], "place").collect():
        at[r.k].append((r.place, r.v, r.i))
    for k, got in at.items():
        assert [(v, i) for _, v, i in sorted(got)] == sorted((v, i) for kk, v, i in rows if kk == k) and sorted(p for p, _, _ in got) == list(range(len(got)))


def test_mixing_does_not_depend_on_ranges(spark, docs, monkeypatch):
    rows = lambda: sorted((r.doc_id, r.taken) for r in mixing.op3_mixing(spark, SF).collect())
    whole = rows()
    monkeypatch.setattr(common, "RANGE_ROWS", 20)
    assert rows() == whole == sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())


def test_sharding_beside_a_hot_group(spark):
    texts = ["hot"] * 1600 + [f"pair {i // 2}" for i in range(480)] + [f"one {i}" for i in range(2720)]
    where = _shards_of_texts(spark, texts)
    assert len(where[zlib.crc32(b"hot")]) == 8
    assert all(len(where[zlib.crc32(f"pair {i}".encode())]) == 1 for i in range(240))


@pytest.mark.parametrize("compress", [False, True])
def test_warc(spark, tmp_path, compress):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(3, "http://a/\r\nX: é", big, 1), (1, "http://b", big, 2), (2, None, None, 3), (None, "u", big, 4), (4, "v", "", 5), (5, "w", "<p>\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 200_000, 6)], "page_id long, url string, html string, payload int")
    made = warc.archive(pages, f"file://{tmp_path}/w", compress)
    warc.pushing(spark)
    got = {r.record_id: r for r in warc.read(spark, made, manifest=True).collect()}
    assert got["<urn:page:3>"].refers_to == "<urn:page:1>" and got["<urn:page:1>"].record_type == "response" and bytes(got["<urn:page:1>"].payload) == big.encode()
    assert bytes(got["<urn:page:2>"].payload) == b"" and got["<urn:page:2>"].target_uri is None and bytes(got["<urn:page:5>"].payload).endswith(b"y" * 200_000) and len(got) == 6
    assert got["<urn:page:>"].record_type == "revisit" and got["<urn:page:>"].payload is None and got["<urn:page:>"].payload_length == len(big)
    some = warc.read(spark, made, manifest=True).filter("record_type = 'revisit' and target_uri like 'http%'")
    assert some.count() == 1
    bare = {r.record_id: r for r in warc.read(spark, f"file://{tmp_path}/w", payload=False).collect()}
    assert all(bare[i].payload is None and bare[i].payload_length == got[i].payload_length for i in got)
    assert got["<urn:page:5>"].payload_length == len(got["<urn:page:5>"].payload)
    none = warc.archive(pages.limit(0), f"file://{tmp_path}/none", compress)
    assert warc.read(spark, none, manifest=True).count() == 0


def test_pushdown_tests_headers_before_payloads():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    r = warc.WarcReader({"path": "x"})
    assert len(list(r.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))) == 1
    assert r._wants({"warc-type": "revisit"}) and not r._wants({"warc-type": "response"})


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", r"<|end|> <\|end|> </s\> [/INST\] <", "<|role|>|>", "", None, "a<|text|>b\n"]
    rows = [(c, i, "assistant" if i % 2 else "user", t, "x") for c in (1, 2) for i, t in enumerate(nasty)] + [(3, 0, "assistant", "only", "x"), (4, 0, None, "q", "x"), (None, 0, "user", "n", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    made = chat.examples(df)
    back = {(r.conv_id, r.example): r for r in made.withColumn("turns", chat.turns_of(F.col("formatted"))).collect()}
    assert [tuple(t) for t in back[1, 6].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(nasty)]
    assert sum(1 for c, _ in back if c == 1) == 3 and back[4, 1].loss_length == 0
    d = {r.conv_id: r for r in chat.digest(made).collect()}
    assert d[1].n_turns == 6 and d[1].loss_chars == sum(len(t or "") for t in nasty[1::2]) and d[3].loss_chars == 4 and None in d
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


def test_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|end|>") for i in range(2_000)]
    d = chat.digest(chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert d.n_turns == 2_000 and d.loss_chars == sum(len(t) for _, i, _, t in rows if i % 2)


def test_toxicity(spark, docs, labels, awkward, empty):
    model = toxicity.Model(stems=("idiot",))
    scan = model.scanner()
    plain, negated = (toxicity.score_of(toxicity.features(t, model, scan), model) for t in ("You are an idiot, idiot.", "She is not an idiot"))
    assert plain > negated and toxicity.features("nothing here. said he", model, scan) == [0.0] * toxicity.N_FEATURES
    assert toxicity.features("he said you idiot", model, scan)[5] > 0
    assert toxicity.features("First. he said " + "word " * 5_000 + "idiot", model, scan)[4] > 0
    weak = toxicity.Model(stems=("idiot",), weak=("rot",))
    scan = weak.scanner()
    of = lambda t: toxicity.features(t, weak, scan)
    assert not any(of("some rot here. nothing else")) and of("you rot here")[toxicity.WEAK_AT] > 0 and of("idiot and rot")[toxicity.WEAK_AT + 1] > 0
    assert of("some rot. more rot")[toxicity.AGAIN] > 0 and not any(of("rotten. fine")[:toxicity.AGAIN])
    learned = toxicity.train(docs, labels)
    out = toxicity.score(awkward, learned).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out) and toxicity.score(empty, learned).count() == 0
    assert toxicity.train(docs, labels.limit(0)) == toxicity.Model()


def test_grammar_against_a_second_reading():
    """Every emission, told from the words before it in the clause instead of a state."""
    model = toxicity.Model(stems=("idiot",), weak=("rot",))
    scan, rng = model.scanner(), np.random.default_rng(8)
    words = ["idiot", "rotten", "kill", "you", "not", "said", "the", "sky", "."]
    for _ in range(2_000):
        text = " ".join(rng.choice(words, rng.integers(1, 25)))
        want = collections.Counter()
        suspects = 0
        for clause in text.split("."):
            seen, emitted, suspect = clause.split(), 0, False
            for i, w in enumerate(seen):
                near = lambda x: x in seen[max(0, i - toxicity.REACH):i]  # noqa: B023, E731
                abusive = any(x in ("idiot", "kill", "rotten") for x in seen[:i])
                if w in ("idiot", "kill"):
                    want[near("you") + 2 * near("not") + 4 * ("said" in seen[:i]) + 8 * (w == "kill")] += 1
                elif w == "rotten" and (near("you") or abusive):
                    want[toxicity.WEAK_AT + (not near("you")) + 2 * near("not") + 4 * ("said" in seen[:i])] += 1
                elif w == "rotten":
                    suspect |= not near("not") and "said" not in seen[:i]
                    continue
                else:
                    want[toxicity.AFTER] += w == "you" and "idiot" in seen[max(0, i - toxicity.REACH):i]
                    continue
                emitted += 1
            suspects += suspect
            want[toxicity.MANY] += emitted > 1
        got = toxicity.features(text, model, scan)
        if suspects > 1:
            want[toxicity.AGAIN], want[toxicity.DENSE] = suspects - 1, 100 * suspects / (1 + text.count("."))
        assert got == pytest.approx([np.log1p(want[i]) for i in range(toxicity.N_FEATURES)]), text


def test_weak_stems_are_negated_and_reported_like_others():
    model = toxicity.Model(stems=("idiot",), weak=("rot",))
    scan = model.scanner()
    of = lambda t: toxicity.score_of(toxicity.features(t, model, scan), model)
    assert of("You are rot.") > of("You are not rot.") > of("") and of("You are rot.") > of("He said you are rot.")
    assert of("The rot. A rot lies here.") > of("Not rot. It said rot.") == of("A rot lies here.") == of("")


def test_toxicity_held_out(spark):
    d = spark.createDataFrame([(i, f"{'you are an idiot and a moron' if i % 5 == 0 else 'words of the'} text {i} with some filler") for i in range(600)], "doc_id long, text string")
    lab = d.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    out = toxicity.score(d, toxicity.train(d, lab)).join(lab, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    assert out.filter((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count() == out.count()


def test_extraction(spark):
    w = extraction.learn(extraction.labelled_pages())
    page = ('<html><head><title>t</title><style>p{}</style></head><body><header class="site">Top bar</header><nav><a href=x>Home</a></nav><div id="sidebar">side words here</div><div class="post"><h1>T &amp; x</h1><p>one two  three four\nfive<p>six &lt;b&gt; seven eight'
            '<script>var a="</p>";</script><div class="ad-box">buy buy buy</div><p>nine <b>t</b>en eleven twelve</p><form>mail <input></form><div class="comments"><p>nice post my dear friend</p></div></div><aside>x y</aside><footer>&copy; z</footer></body></html>')
    assert extraction.extract(page, w) == "T & x\none two three four five\nsix <b> seven eight\nnine ten eleven twelve"
    assert extraction.extract(None, w) == extraction.extract("", w) == extraction.extract("<script>x", w) == ""
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    for r in extraction.main_text(rows).collect():
        a = r.html[r.html.find("<article>") + 9:r.html.find("</article>")]
        a = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>", "\0", a).replace("<br>", " "))
        assert r.text == "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in a.split("\0")) if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, "u", None, "x"), (2, None, "plain " * 50_000, "y")], "page_id long, url string, html string, text string")
    assert [r.n_chars for r in extraction.main_text(odd).orderBy("page_id").collect()] == [0, 299_999]


@pytest.mark.parametrize("page", ["<a '" * 8_000, "<a " * 8_000, "<div>" * 8_000 + "</b>" * 8_000, "<svg>" * 8_000, '<a b="' * 8_000, "<!--" * 8_000, "<p>&#" + "9" * 9_000, "<b>" * 8_000 + "</i>" * 8_000, "<p>" * 8_000, "<a class=" * 8_000])
def test_hostile_pages_take_linear_time(page):
    w = extraction.Weights()
    took = []
    for k in (4, 16):
        at = time.process_time()
        extraction.extract(page * k, w)
        took.append(time.process_time() - at)
    assert took[1] < 8 * took[0] + 0.2


def test_extraction_reads_text_nodes():
    w = extraction.learn(extraction.labelled_pages())
    assert extraction.extract("<article><p>AT&<b>amp;</b>T &lt;x&gt; foo<img>bar a<br>b &#0065;&#99999999999;</p></article>", w) == "AT&amp;T <x> foobar a b A\ufffd"
    run = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    for name in ("warenkorb", "kommentare"):
        page = f"<body><nav>{run('n', 20)}</nav><div class=post><h1>T</h1><p>{run('a', 30)}</p><div class='{name}'>{run('z', 20)}</div><p>{run('b', 30)}</p><div class='{name}'><p>{run('z', 9)}</p></div></div></body>"
        assert extraction.extract(page, w) == f"T\n{run('a', 30)}\n{run('b', 30)}"


BOXES_OF_ARTICLES = ["<div class='highlight'><pre>x0 = 1</pre></div>", "<div class='pullquote'>some quoted words here</div>", "<div class='figure-wrap'><p>caption</p></div>",
                     "<div class='answer'><p>" + "word " * 90 + "</p></div>", "<div class='x'><h2>Sub</h2><p>one two</p><p>three four</p></div>", "<ul><li><a>Reference one</a></li><li><a>Reference two</a></li></ul>",
                     "<figure>art<figcaption>what is seen</figcaption></figure>", "<ol><li>one</li><li>two</li></ol>", "<aside class='zufo'><p>a note beside</p></aside>", "<section class=qa><p>why</p><p>because</p></section>"]


@pytest.mark.parametrize("inner", BOXES_OF_ARTICLES)
@pytest.mark.parametrize("tag", ["article", "div class=post", "div class=zz"])
def test_extraction_keeps_boxes_of_articles(tag, inner):
    w = extraction.learn(extraction.labelled_pages())
    run = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    p, q = f"<p>{run('a', 30)}</p>", f"<p>{run('b', 30)}</p>"
    for order in (p + inner + q, p + q + inner):
        page = f"<body><nav><ul><li><a>Home</a></li></ul></nav><{tag}><h1>T</h1>{order}</{tag.split()[0]}><div class=tuvebo><p>a comment that a reader wrote</p></div><footer>foot</footer></body>"
        want = [" ".join(x.split()) for x in re.sub(r"<[^>]*>", "\n", f"<h1>T</h1>{order}").split("\n") if x.strip()]
        assert extraction.extract(page, w).split("\n") == want


def _strange_page(rng):
    """A page whose boxes have names of their own. Words of the article begin with a, all others with z."""
    words = lambda c, a, b: " ".join(f"{c}{rng.randrange(10**6)}" for _ in range(rng.randint(a, b)))
    name = lambda: "".join(rng.choice("cfhjkmpqrtvwxz") + rng.choice("aeiouy") for _ in range(5))
    box = lambda inside, tag="div": f'<{tag} class="{name()}">{inside}</{tag}>'
    menu = lambda: "<ul>" + "".join(f"<li><a href=/>{words('z', 1, 2)}</a></li>" for _ in range(rng.randint(3, 9))) + "</ul>"
    kin = name()
    comments = box(f"<h3>{words('z', 0, 1)} comments</h3>" * rng.randint(0, 1) + "".join(f'<div class="{kin}"><b>{words("z", 1, 2)}</b><p>{words("z", 4, 40)}</p></div>' for _ in range(rng.randint(2, 7))))
    advert = box(f"{words('z', 1, 12)} {rng.choice(['Advertisement', 'Sponsored', 'buy', 'Anzeige', 'Publicité', 'oferta'])} {words('z', 1, 12)}")
    inside = [f"<p>{words('a', 6, 70)}</p>" for _ in range(rng.randint(2, 7))]
    for extra in (box(f"<pre>{words('a', 3, 20)}</pre>"), box(words("a", 4, 30)), box(f"<p>{words('a', 2, 8)}</p>"), box(f"<h2>{words('a', 1, 3)}</h2><p>{words('a', 9, 30)}</p>"),
                  f"<figure><figcaption>{words('a', 2, 9)}</figcaption></figure>", f"<ul><li><a href=x>{words('a', 2, 5)}</a></li><li><a href=y>{words('a', 2, 5)}</a></li></ul>", advert):
        if rng.random() < 0.35:
            inside.insert(rng.randint(1, len(inside)), extra)
    if rng.random() < 0.4:
        inside.append(comments)
    main = f"<h1>{words('a', 1, 9)}</h1>" + "".join(inside)
    main = rng.choice([f"<article>{main}</article>", f"<main>{box(main)}</main>", box(main), f"<div>{box(main, 'section')}</div>"])
    before = rng.choice([f"<nav>{menu()}</nav>", box(menu()), f"<header>{words('z', 1, 5)}</header><nav>{menu()}</nav>"])
    after = rng.choice([f"<footer>{words('z', 3, 20)}</footer>", box(menu()) + f"<footer>{words('z', 3, 20)}</footer>", f"<aside>{words('z', 3, 20)}</aside><footer>{words('z', 3, 9)}</footer>"])
    return f"<html><body>{before}{main}{after}</body></html>"


def test_extraction_of_pages_with_names_in_no_list():
    w = extraction.learn(extraction.labelled_pages())
    rng = random.Random(20_261_128)
    good = kept = every = 0
    for _ in range(600):
        page = _strange_page(rng)
        words = extraction.extract(page, w).split()
        good += sum(x[0] == "a" and x[1:].isdigit() for x in words)
        kept += len(words)
        every += len(re.findall(r"\ba\d+", page))
    assert good / kept > 0.97 and good / every > 0.99, (good / kept, good / every)


def test_extraction_of_no_pages(spark):
    assert extraction.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_of_articles_with_long_noise():
    w = extraction.learn(extraction.labelled_pages())
    run = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    share = '<div class="share"><ul>' + '<li><a href="/x">share</a></li>' * 30 + "</ul></div>"
    advert = f'<div class="advert"><p>{run("z", 300)}</p></div>'
    comments = '<div class="comments">' + f'<div class="comment"><p>{run("z", 40)}</p></div>' * 10 + "</div>"
    for tag in ("article", 'div class="post"', 'div class="qx"'):
        inner = f'<h1>{run("h", 5)}</h1>{share}<p>{run("a", 20)}</p>{advert}<p>{run("b", 20)}</p>{comments}<p>{run("c", 20)}</p>'
        page = f'<html><body><nav>{run("n", 30)}</nav><div>{run("t", 3)}</div><nav>{run("n", 30)}</nav><{tag}>{inner}</{tag.split()[0]}><footer>{run("f", 40)}</footer><div>{run("u", 4)}</div></body></html>'
        assert extraction.extract(page, w) == "\n".join([run("h", 5), run("a", 20), run("b", 20), run("c", 20)]), tag


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = corpus_pipeline.spill(docs, "test")
    assert docs.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, empty):
    import corpus_pipeline

    for df in (awkward, empty):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.spill(stage(spark, docs, SF), "test")
            assert docs.columns == df.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_fingerprints_find_copies_of_the_pipeline(spark, monkeypatch):
    """Without any band, near copies are found by their fingerprints, and checked on their shingles."""
    monkeypatch.setattr(copies, "_band_links", lambda made: made.select(made.id.alias("a"), made.id.alias("b")).limit(0))
    run = [f"w{i}" for i in range(3000)]
    ends = ["a b c d e " * 100 + " ".join(f"{c}{i}" for i in range(8)) for c in "xy"]  # one fingerprint, few shingles in common
    texts = [" ".join(run), " ".join([*run[:-1], "other"]), *ends, None, " "]
    apart = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
    assert apart(*texts[:2]) <= simhash.MAX_DIFFERENCE and apart(*ends) <= simhash.MAX_DIFFERENCE
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
