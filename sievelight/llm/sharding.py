"""Sharding by balanced label propagation: equal texts move together, and every shard gets as many rows.

Groups of equal texts are the linked documents. Each document begins with the label (shard) of its hash; the labels of
a group's documents are joined and counted, and the group proposes to gather where most of its documents are. Shards
grant proposals within their quotas, larger groups first; who is refused proposes elsewhere, until no group that still
waits fits anywhere. Groups larger than a shard take part as pieces of a shard's size. What waits then (fewer groups than
there are shards) is cut, and documents without links fill up the rest, so counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, small, spill, table

SHARDS = 24
LAW = "rows"
_UNIT = "g string, piece long, size long, shard int"


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def grants(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """asked: proposals by (shard, size). How many of each are granted, larger sizes first; takes from `room`."""
    out = {}
    for (s, size), n in sorted(asked.items(), key=lambda x: (x[0][0], -x[0][1])):
        out[s, size] = min(n, room[s] // size)
        room[s] -= out[s, size] * size
    return out


def _wish(room: list[int]) -> Column:
    """Where a group would gather: of the shards with room for all of it the one with most of its documents, ties and groups
    that have none there by hash. Null if no shard has room."""
    rooms = F.array(*[F.lit(r).cast("long") for r in room])
    own = F.filter("parts", lambda p: F.get(rooms, p["shard"]) >= F.col("size"))
    ranked = F.transform(own, lambda p: F.struct(p["cnt"].alias("cnt"), F.xxhash64("g", p["shard"]).alias("h"), p["shard"].alias("shard")))
    open_ = F.filter(F.sequence(F.lit(0), F.lit(len(room) - 1)), lambda s: F.get(rooms, s) >= F.col("size"))
    other = F.get(open_, F.pmod(F.xxhash64("g", "piece"), F.greatest(F.size(open_), F.lit(1))).cast("int"))
    return F.coalesce(F.array_max(ranked)["shard"], other)


def propagate(units: DataFrame, room: list[int]) -> tuple[DataFrame | None, DataFrame]:
    """units: (g, piece, size, parts), a written table. Rounds of proposals and grants to a fixed point; takes from `room`.
    Returns what was granted (g, piece, size, shard) and what waits. A shard that refuses a group has less room than the
    group needs and never gains any, so no group is refused by one shard twice and rounds are at most one more than shards."""
    spark, done = units.sparkSession, None
    for _ in range(len(room) + 2):
        asked = units.withColumn("shard", _wish(room)).filter("shard is not null")
        # a row for each shard and size: d sizes take over d * d / 2 documents
        counts = {(r.shard, r["size"]): r.n for r in asked.groupBy("shard", "size").agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        told = grants(counts, room)
        rows = [(s, size, k, k == counts[s, size]) for (s, size), k in told.items() if k]
        lot = asked.select("g", "piece", "shard",
            "size").join(F.broadcast(spark.createDataFrame(rows, "shard int, size long, k long, everyone boolean")), ["shard", "size"])
        lot = spill(lot, "shard-asked")
        lucky = lot.filter("everyone")
        if not all(r[3] for r in rows):
            lucky = lucky.unionByName(numbered(lot.filter("not everyone"), ["shard", "size"], ["g", "piece"], "_k").filter("_k < k").drop("_k"))
        lucky = spill(lucky.select("g", "piece", "size", "shard"), "shard-granted")
        done = lucky if done is None else done.unionByName(lucky)
        units = spill(units.join(small(lucky.select("g", "piece")), ["g", "piece"], "left_anti"), "shard-waiting")
    return done, units


def cut(waiting: list[tuple[str, int, int]], room: list[int]) -> list[tuple[str, int, int, int]]:
    """(g, piece, size) to (g, piece, documents, shard): each is spread over the emptiest shards."""
    out = []
    for g, piece, n in sorted(waiting, key=lambda x: (-x[2], x[0], x[1])):
        while n:
            s = max(range(len(room)), key=lambda s: (room[s], -s))
            k = min(n, room[s])
            out.append((g, piece, k, s))
            room[s] -= k
            n -= k
    return out


def _gathered(own: DataFrame, n: int, room: list[int]) -> DataFrame:
    """(g, parts): for each group of several documents how many go to which shard, at most one entry a shard."""
    shards, whole = len(room), max(1, n // len(room))
    labels = own.groupBy("g", F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("cnt"))
    groups = labels.groupBy("g").agg(F.sum("cnt").alias("all"), F.collect_list(F.struct("shard", "cnt")).alias("parts")).filter("all > 1")
    units = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(all - 1) div {whole}"))))
    units = units.withColumn("size", F.least(F.lit(whole), F.col("all") - F.col("piece") * whole))
    units = units.withColumn("parts", F.when(F.col("all") > whole, F.slice("parts", 1, 0)).otherwise(F.col("parts")))
    done, waiting = propagate(spill(units.select("g", "piece", "size", "parts"), "shard-units"), room)
    # each that waits is larger than any room, and all rooms together hold them: fewer than there are shards
    pieces = cut([(r.g, r.piece, r["size"]) for r in waiting.select("g", "piece", "size").collect()], room)
    placed = own.sparkSession.createDataFrame(pieces, _UNIT)
    placed = placed if done is None else placed.unionByName(done)
    parts = placed.groupBy("g", "shard").agg(F.sum("size").alias("cnt")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("shard",
        "cnt"))).alias("parts"))
    return spill(parts, "shard-parts")


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, g (the MD5 of the text), shard and slot of every row; see `shard`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = spill(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("g")), "shard-rows")
    n = own.count()
    quota = quotas(n, shards)
    room = list(quota)
    linked = spill(own.join(small(_gathered(own, n, room)), "g", "left"), "shard-joined")
    whole = linked.filter(F.size("parts") == 1).withColumn("shard", F.get("parts", 0)["shard"])
    # only documents of groups in several shards need their place in the group
    ends = F.transform("parts", lambda p, i: F.aggregate(F.slice("parts", 1, i + 1), F.lit(0).cast("long"), lambda m, q: m + q["cnt"]))
    parted = numbered(linked.filter(F.size("parts") > 1).withColumn("_ends", ends), ["g"], ["doc_id"], "_k")
    parted = parted.withColumn("shard", F.get("parts", F.size(F.filter("_ends", lambda e: e <= F.col("_k"))))["shard"])
    cols = ["doc_id", "size", "text_crc32", "g", "shard"]
    sat = numbered(whole.select(cols).unionByName(parted.select(cols)), ["shard"], ["g", "doc_id"], "slot", n)
    rest = numbered(linked.filter("parts is null").select(cols[:-1]), [], ["g", "doc_id"], "_k", n)
    # single documents fill up what room is left, shard by shard
    upto = [sum(room[:s + 1]) for s in range(shards)]
    rest = rest.withColumn("shard", sum(((F.col("_k") >= e).cast("int") for e in upto), F.lit(0)))
    pick = lambda xs: F.get(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("shard"))
    rest = rest.withColumn("slot", F.col("_k") - pick([0, *upto[:-1]]) + pick([q - r for q, r in zip(quota, room, strict=True)]))
    return sat.select(*cols, "slot").unionByName(rest.select(*cols, "slot"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is `rows`) of every row.

    Size is the UTF-8 bytes of the text plus 8; null texts have none and are equal to each other and to empty
    ones. Null ids and repeated rows are rows like others. Groups larger than a shard take whole shards and one part
    of another; besides them fewer groups than shards are cut, all others stay whole. Rows that agree in id and text are
    alike, so reruns agree. An empty table gives an empty result. Texts of any length are hashed whole; columns other than
    doc_id and text are left out, so none can clash.
    """
    out = placed(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"))


def cut_links(at: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row about `placed` documents: links (documents of a group beyond its first), cut (shards of a group beyond its
    first) and least (what any sharding with these quotas must cut)."""
    most = max(1, -(-at.count() // shards))
    by = at.groupBy("g", "shard").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by.agg(total(F.col("n") - 1).alias("links"), total(F.col("parts") - 1).alias("cut"), total(F.expr(f"(n - 1) div {most}")).alias("least"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
