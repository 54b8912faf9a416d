"""Feature vectors, opcode sequences, logistic regression and its evaluation."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import modules
from ..functions.wasm import number
from ..sources.shared import written
from .modules import ratio

# The opcodes that have a column and a token of their own, in schema order.
VOCABULARY = ("i32.add i32.sub i32.mul i32.and i32.or i32.xor i32.shl i32.shr_u i32.shr_s i32.rotl i32.rotr i64.add i64.mul i64.xor i64.shl i64.rotl i32.load "
    "i32.store i64.load i64.store "
              "local.get local.set local.tee global.get call call_indirect br_if br loop block if return f64.add f64.mul f32.add f32.mul memory.grow memory.size").split()
SPECIAL = ("PAD", "MASK", "CLS", "UNK", "OTHER", "SEP")
SEQUENCE_LENGTH, SEQUENCE_FUNCTIONS = 512, 4
FEATURE_NAMES = ["log_byteLength", "log_instructionCount", "log_functionCount", "log_importedFunctionCount", "log_exportCount",
    "exports_per_function", "bitwiseRatio", "floatRatio",
                 *[f"cat_{c}" for c in modules.CATEGORIES], "loops_per_function", "backEdges_per_function", "log_maxNesting",
                 "indirectCall_ratio", "log_memoryInitialPages", "memory_bounded", "memoryShared",
                 "log_memoryGrowSites", "dataSection_share", "stripped", "coverage", "has_kernel", "kernel_bitwiseRatio",
                 "kernel_arithmeticRatio", "kernel_callRatio", "log_kernel_loopSize", *[f"op_{o}" for o in VOCABULARY]]
EPOCHS, RATE, L2 = 400, 0.3, 0.01
#: Tasks that sum up what others have summed, where there are four times as many or more.
TREE = 64


def vectorise(features: DataFrame) -> DataFrame:
    """`features` with a vector of 73 columns. Logs of counts, shares elsewhere; nothing non-finite."""
    a = features
    n, fns, k = F.col("instruction_count"), F.greatest("function_count", F.lit(1)), F.col("kernel")
    log = lambda c: F.log1p(F.coalesce(c, F.lit(0)).cast("double"))
    flag = lambda c: c.cast("int").cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cols = [log(F.col("byte_length")), log(n), log(F.col("function_count")), log(F.col("imported_functions")), log(F.col("export_count")),
        ratio(F.col("export_count"), fns), F.col("bitwise_ratio"), F.col("float_ratio"),
            *[ratio(F.col(f"n_{c}"), n) for c in modules.CATEGORIES], ratio(F.col("total_loops"), fns),
            ratio(F.col("total_back_edges"), fns), log(F.col("max_nesting")), ratio(F.col("indirect_calls"), n), log(F.col("memory_initial_pages")),
            flag(F.col("memory_max_pages").isNotNull()), flag(F.col("memory_shared")), log(F.col("memory_grow_sites")),
            ratio(F.col("data_bytes"), F.col("byte_length")), flag(F.col("stripped")),
            ratio(F.col("decoded_functions"), F.col("decoded_functions") + F.col("skipped") + F.col("truncated_functions")),
            flag(k.isNotNull()), zero(k["bitwise_ratio"]), zero(k["arithmetic_ratio"]), zero(k["call_ratio"]),
            log(k["largest_loop"]), *[ratio(F.coalesce(F.try_element_at("ops", F.lit(o)), F.lit(0)), n) for o in VOCABULARY]]
    finite = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return a.withColumn("vector", F.transform(F.array(*[c.cast("double") for c in cols]), finite))


def token_id(name: str) -> int:
    return len(SPECIAL) + VOCABULARY.index(name) if name in VOCABULARY else 4


def sequences(decoded: DataFrame, length: int = SEQUENCE_LENGTH, most: int = SEQUENCE_FUNCTIONS) -> DataFrame:
    """hash, tokens (CLS, up to four functions joined by SEP, padded) and real_tokens, of modules with functions. The kernel's
    function comes first, then larger ones, then by index; a function that doesn't fit is cut to a window that begins at its
    largest loop, moved back where the function ends before the room does. All of it is done inside the module's row."""
    made = F.get("made", 0)
    return sequences_of(decoded, length, most=most).select("hash", made["tokens"].alias("tokens"), made["real_tokens"].alias("real_tokens"))


def sequences_of(decoded: DataFrame, *lengths: int, most: int = SEQUENCE_FUNCTIONS) -> DataFrame:
    """(hash, made): for each length the tokens and real_tokens of `sequences`, from functions that are turned to tokens once."""
    ids = F.create_map(*[F.lit(x) for i, n in enumerate(VOCABULARY) for x in (n, len(SPECIAL) + i)])
    best = F.array_max(F.transform(F.filter("functions", modules.is_kernel), lambda f: F.struct(ratio(modules.cat(f, "bitwise"), f["n"]).alias("b"),
        modules.largest_loop(f).alias("l"), (-f["func_idx"]).alias("o"))))["o"]
    head = lambda f: F.array_max(F.transform(f["loops"], lambda x: F.struct(x["size"].alias("s"), (-x["header"]).alias("h"))))["h"]
    place = lambda f: F.struct((~(-f["func_idx"]).eqNullSafe(F.col("_best"))).alias("a"), (-f["n"]).alias("b"), f["func_idx"].alias("c"),
        F.coalesce(-head(f), F.lit(0)).cast("int").alias("head"), f["listing"].alias("l"))
    first = F.slice(F.array_sort(F.transform("functions", place), lambda x, y: _before(x, y, "a", "b", "c")), 1, most)
    # only functions that are taken are turned to tokens
    tokens = F.transform(first, lambda f: F.struct(f["head"].alias("head"), F.transform(f["l"], lambda x: F.coalesce(F.try_element_at(ids, x["name"]), F.lit(4))).alias("t")))
    top = decoded.filter(F.size("functions") > 0).withColumn("_best", best)
    # one-row generators: the optimizer would copy what follows into each place that reads it
    top = top.select(F.inline(F.array(F.struct("hash", tokens.alias("fs")))))

    def add(acc: Column, f: Column, length: int) -> Column:
        joint = F.when(F.size(acc) > 1, 1).otherwise(0)
        room = F.lit(length) - F.size(acc) - joint
        window = F.slice(f["t"], F.greatest(F.least(f["head"], F.size(f["t"]) - room), F.lit(0)) + 1, F.greatest(room, F.lit(0)))
        return F.when(room > 0, F.concat(acc, F.when(joint == 1, F.array(F.lit(5))).otherwise(F.array().cast("array<int>")),
            F.when(F.size(f["t"]) <= room, f["t"]).otherwise(window))).otherwise(acc)
    adding = lambda n: lambda acc, f: add(acc, f, n)
    real = [F.aggregate("fs", F.array(F.lit(2)), adding(n)).alias(f"real{i}") for i, n in enumerate(lengths)]
    a = top.select(F.inline(F.array(F.struct("hash", *real))))
    return a.select("hash", F.array(*[F.struct(F.concat(f"real{i}", F.array_repeat(F.lit(0), F.lit(n) - F.size(f"real{i}"))).alias("tokens"),
        F.size(f"real{i}").cast("long").alias("real_tokens")) for i, n in enumerate(lengths)]).alias("made"))


def _before(x: Column, y: Column, *fields: str) -> Column:
    """Order of structs by their first fields."""
    out = F.lit(0)
    for f in reversed(fields):
        out = F.when(x[f] < y[f], -1).when(x[f] > y[f], 1).otherwise(out)
    return out


def sequence_job(files: DataFrame, order: str = "name") -> tuple[DataFrame, DataFrame]:
    """(name, label, bytes) to the sequences of a training set and one row of counters.

    Of equal contents the first by name is taken; what is no module, or has no function that can be decoded, is skipped. Like
    the order in which files are read, benign ones (label 0) come before others. Counters: written, kernels (led by a kernel
    candidate), padded, skipped, duplicates.
    """
    a = files.select(order, "label", "bytes", F.sha2("bytes", 256).alias("hash"))
    first = a.groupBy("hash").agg(F.min(F.struct("label", order)).alias("r"), F.count("*").alias("copies"))
    one = a.join(first, (a["hash"] == first["hash"]) & (a["label"].eqNullSafe(F.col("r")["label"])) & (a[order] == F.col("r")[order]),
        "left_semi").dropDuplicates(["hash"])
    decoded = written(modules.decode(one, listings=True), "decoded")
    kernel = modules.features(decoded).select("hash", F.col("kernel").isNotNull().alias("kernel"))
    made = sequences(decoded).join(kernel, "hash").join(first.select("hash", F.col("r.label").alias("label"),
        F.col(f"r.{order}").alias("source")), "hash")
    read = decoded.select("hash", "ok", F.coalesce(F.exists("functions", lambda f: f["n"] > 0), F.lit(False)).alias("some"))
    told = first.join(read, "hash").join(made.select("hash", F.col("kernel").alias("_k"), "real_tokens"), "hash", "left")
    good = F.col("ok") & F.col("some")
    # a repeat of what was skipped is read, and skipped, again
    counters = told.agg(F.count_if(good).alias("written"), F.count_if(good & F.col("_k")).alias("kernels"),
        F.count_if(good & (F.col("real_tokens") < SEQUENCE_LENGTH)).alias("padded"),
                        F.coalesce(F.sum(F.when(~good, F.col("copies"))), F.lit(0)).alias("skipped"),
                        F.coalesce(F.sum(F.when(good, F.col("copies") - 1)), F.lit(0)).alias("duplicates"))
    return made.join(read.filter(good), "hash").select("hash", "tokens", "label", "source", "kernel", "real_tokens"), counters


def masked(sequences_: DataFrame, seed: int = 1, share: float = 0.15) -> DataFrame:
    """Masked copies of token sequences: of 15% of the maskable tokens 80% become MASK, 10% another token, 10% stay."""
    u = lambda i, salt: F.pmod(F.xxhash64("hash", i, F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0
    new = lambda t, i: F.when((t < 6) | (u(i, 0) >= share), t).when(u(i, 1) < 0.8, 1).when(u(i, 1) < 0.9, (F.floor(u(i, 2) * len(VOCABULARY)) + 6).cast("int")).otherwise(t)
    return sequences_.withColumn("masked", F.transform("tokens", new))


def standardiser(df: DataFrame, vector: str = "vector") -> DataFrame:
    """(i, mean, sd): population statistics of each column; sd is 1e-9 at least."""
    return df.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"),
        F.greatest(F.stddev_pop("v"), F.lit(1e-9)).alias("sd"))


def scaled(vector: Column, mean: list[float], sd: list[float]) -> Column:
    """Zero where a column's spread is 1e-12 or less."""
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, sd))
    return F.transform(vector, lambda v, i: F.when(F.get(s, i) <= 1e-12, 0.0).otherwise((v - F.get(m, i)) / F.get(s, i)))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def dot(x: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda m, v: m + v)


def predict(df: DataFrame, model: dict, vector: str = "vector", names: list[str] | None = None) -> DataFrame:
    """Probability and largest contributions. names: those of the vector's columns, held against the model's."""
    check_model(model, names)
    x = scaled(F.col(vector), model["mean"], model["sd"])
    return df.withColumn("probability", sigmoid(dot(x, model["weights"]) + F.lit(model["bias"]))).withColumn("contributions",
        contributions(x, model["weights"], model["schema"]))


def contributions(x: Column, weights: list[float], names: list[str], top: int = 5) -> Column:
    """Largest weight times value by absolute value; zeros are dropped, ties keep column order."""
    w, n = F.array(*map(F.lit, weights)), F.array(*map(F.lit, names))
    all_ = F.filter(F.transform(x, lambda v, i: F.struct((-F.abs(v * F.get(w, i))).alias("k"), i.alias("i"), F.get(n, i).alias("name"),
        (v * F.get(w, i)).alias("value"))), lambda c: c["value"] != 0)
    return F.transform(F.slice(F.sort_array(all_), 1, top), lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value")))


def model_version(model: dict) -> str:
    text = json.dumps({"schema": model["schema"]})[:-1] + "".join(f',"{k}":[{",".join(map(number, model[k]))}]' for k in ("weights", "mean",
        "sd")) + f',"bias":{number(model["bias"])}}}'
    return hashlib.sha256(text.encode()).hexdigest()


def check_model(model: dict, names: list[str] | None = None) -> None:
    """Refuses a model that is not whole, or whose columns are not, by name and in order, those that it is to be used on."""
    n = len(model["schema"])
    if names is not None and list(names) != list(model["schema"]):
        other = next((f"{a} where {b} is" for a, b in zip(names, model["schema"], strict=False) if a != b), f"{len(names)} columns, not {n}")
        raise ValueError(f"the model was made for other columns: {other}")
    if not all(len(model[k]) == n for k in ("weights", "mean", "sd")):
        raise ValueError("model columns differ in number")
    if not all(math.isfinite(x) for k in ("weights", "mean", "sd") for x in model[k]) or not math.isfinite(model["bias"]):
        raise ValueError("model holds a number that is not finite")
    if "version" in model and model["version"] != model_version(model):
        raise ValueError("model version does not fit its content")


def _blocks(df: DataFrame, vector: str, label: str, fold: str | None) -> DataFrame:
    """Vectors of a fold in blocks: (fold, x, y), matrices as bytes, so that no epoch reads lists again."""
    rows = df.select((F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), F.col(vector).alias("x"), F.col(label).cast("double").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy()
            x, y = np.array(b.column(1).to_pylist(), np.float64), b.column(2).to_numpy()
            own = np.unique(f)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([x[f == k].tobytes() for k in own], pa.binary()), pa.array([y[f == k].tobytes() for k in own], pa.binary())], ["fold", "x", "y"])
    return rows.filter("y is not null").mapInArrow(run, "fold int, x binary, y binary")


def _opened(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in batches:
        for f, x, y in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield f, np.frombuffer(x).reshape(-1, columns), np.frombuffer(y)


def _summed(blocks: DataFrame, partial, tasks: int) -> np.ndarray:
    """The sum of what `partial` makes of each task's blocks. Where there are many tasks, sums of theirs are summed up first, so
    that the driver gets some hundred."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(hashlib.md5(total.tobytes()).digest()[:4], "little") % TREE]), pa.array([total.tobytes()], pa.binary())], ["slot", "g"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(g) for b in batches for g in b.column(1).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], ["slot", "g"])
    sums = blocks.mapInArrow(run, "slot long, g binary")
    if tasks > 4 * TREE:
        sums = sums.repartition(TREE, "slot").mapInArrow(added, "slot long, g binary")
    parts = sorted(bytes(r.g) for r in sums.collect())  # in an order that does not depend on which task was first
    return np.sum([np.frombuffer(g) for g in parts], axis=0) if parts else np.zeros(0)


def _moments(columns: int, folds_: int, centre: np.ndarray | None):
    """Of each fold: rows of label 1 and of all, sums of columns, and of their squares about the centre."""
    def run(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((folds_, 2 + 2 * columns))
        for f, x, y in _opened(batches, columns):
            x = x if centre is None else x - centre
            out[f] += np.concatenate(([(y == 1).sum(), len(y)], x.sum(axis=0), (x * x).sum(axis=0)))
        return out.ravel()
    return run


def _gradients(w: np.ndarray, b: np.ndarray, mean: np.ndarray, sd: np.ndarray, k1: np.ndarray, k0: np.ndarray, centre: np.ndarray, held: np.ndarray):
    """Gradients and loss of all models at once: a matrix of weights against each block. held: the fold that a model may not see."""
    def run(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        models, columns = w.shape
        v, shift = (w / sd).T, b - (mean / sd * w).sum(axis=1)
        g, e_sum, loss = np.zeros((models, columns)), np.zeros(models), np.zeros(models)
        for f, x, y in _opened(batches, columns):
            x = x - centre
            p = 1 / (1 + np.exp(-np.clip(x @ v + shift, -700, 700)))
            k = np.where(y[:, None] == 1, k1, k0) * (held != f)
            e = k * (p - y[:, None])
            g += e.T @ x
            e_sum += e.sum(axis=0)
            q = np.clip(p, 1e-12, 1 - 1e-12)
            loss -= (k * (y[:, None] * np.log(q) + (1 - y[:, None]) * np.log(1 - q))).sum(axis=0)
        return np.concatenate(((g - e_sum[:, None] * mean) / sd, e_sum[:, None], loss[:, None]), axis=1).ravel()
    return run


def _descended(df: DataFrame, names: list[str], vector: str, label: str, epochs: int, rate: float, l2: float, fold: str | None, held: list[int]) -> list[dict]:
    """A model for each of `held`, trained on all rows of other folds, in one job an epoch for all of them together."""
    columns, folds_ = len(names), max([0, *held]) + 1
    blocks = written(_blocks(df, vector, label, fold), "blocks").persist()
    tasks = blocks.rdd.getNumPartitions()
    try:
        # about the mean of all rows, so that squares don't swallow a spread far from zero
        first = _summed(blocks, _moments(columns, folds_, None), tasks).reshape(-1, 2 + 2 * columns).sum(axis=0)
        if not len(first) or not first[1]:
            raise ValueError("nothing to train on")
        centre = first[2:2 + columns] / first[1]
        per = _summed(blocks, _moments(columns, folds_, centre), tasks).reshape(folds_, -1)
        seen = np.stack([per.sum(axis=0) - (per[f] if f >= 0 else 0) for f in held])
        ones, total = seen[:, 0], seen[:, 1]
        if (ones == 0).any() or (ones == total).any():
            raise ValueError("one class only")
        mean = seen[:, 2:2 + columns] / total[:, None]
        sd = np.maximum(np.sqrt(np.maximum(seen[:, 2 + columns:] / total[:, None] - mean ** 2, 0.0)), 1e-9)
        k1, k0 = total / (2 * ones), total / (2 * (total - ones))
        w, b, losses = np.zeros((len(held), columns)), np.zeros(len(held)), []
        for epoch in range(epochs):
            got = _summed(blocks, _gradients(w, b, mean, sd, k1, k0, centre, np.array(held)), tasks).reshape(len(held), columns + 2)
            w, b = w - rate * (got[:, :columns] / total[:, None] + l2 * w), b - rate * got[:, columns] / total
            if epoch % max(1, epochs // 20) == 0 or epoch == epochs - 1:
                losses.append(got[:, -1] / total)
    finally:
        blocks.unpersist()
    models = []
    for i in range(len(held)):
        model = {"schema": list(names), "weights": w[i].tolist(), "bias": float(b[i]), "mean": (mean[i] + centre).tolist(), "sd": sd[i].tolist(), "losses": [float(x[i]) for x in losses]}
        models.append(model | {"version": model_version(model)})
    return models


def train(df: DataFrame, names: list[str], vector: str = "vector", label: str = "label", epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> dict:
    """Weighted logistic regression by batch gradient descent, one job of partial sums over stored blocks an epoch. Rows without a
    label are left out."""
    return _descended(df, names, vector, label, epochs, rate, l2, None, [-1])[0]


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    s, y = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(F.count_if(s & y).alias("tp"), F.count_if(s & ~y).alias("fp"), F.count_if(~s & y).alias("fn"), F.count_if(~s & ~y).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    a = counts.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    a = a.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return a.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def auc(df: DataFrame, score: str, label: str, ranges: int = 64) -> DataFrame:
    """Area under the ROC curve, ties half, 0.5 with one class. Distinct scores are dealt by ranges of about equal size; the
    running count of what lies below goes on over the ranges, of which there are few."""
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"),
        F.count_if(F.col(label) == 0).alias("n"))
    cuts = per.agg(F.percentile_approx("s", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10_000)).alias("c")).first().c or []
    part = sum(((F.col("s") > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    per = per.withColumn("part", part)
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    sums = per.groupBy("part").agg(F.sum("n").alias("_n"))
    starts = sums.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_start"))
    a = per.withColumn("_below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), "part")
    a = a.withColumn("wins", F.col("p") * (F.col("_start") + F.col("_below") + F.col("n") / 2.0))
    return a.agg(F.coalesce(F.try_divide(F.sum("wins"), F.sum("p").cast("double") * F.sum("n")), F.lit(0.5)).alias("auc"))


def shuffled(n: int, seed: int) -> list[int]:
    """Fisher-Yates by a linear congruential generator."""
    order, state = list(range(n)), seed & 0xFFFFFFFF
    for i in range(n - 1, 0, -1):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        j = int(state / 4294967296 * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def folds(df: DataFrame, key: str, k: int = 5, label: str | None = None) -> DataFrame:
    """Fold of each row: ranges of the MD5 of its key, so nothing is sorted, shuffled or numbered; with a label, rows of a label
    are dealt in the order of their hashes (stratified, in buckets of the hash, so no label is one task)."""
    h = F.md5(F.col(key).cast("string"))
    if label is None:
        return df.withColumn("fold", F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))
    w = Window.partitionBy(label, F.substring(h, 1, 1)).orderBy(h, key)
    return df.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k)))


def cross_validate(df: DataFrame, names: list[str], key: str, k: int = 5, vector: str = "vector", label: str = "label",
    epochs: int = 60) -> DataFrame:
    """Each row with the probability of a model that has not seen its fold; one class in a fold's rest is refused."""
    dealt = written(folds(df, key, k, label), "folds")
    models = _descended(dealt, names, vector, label, epochs, RATE, L2, "fold", list(range(k)))
    parts = [predict(dealt.filter(F.col("fold") == f), models[f], vector).drop("contributions") for f in range(k)]
    # written, as all measures of it read it again
    return written(reduce(DataFrame.unionByName, parts), "validated")


def verdict(f1_model: Column, f1_baseline: Column) -> Column:
    d = f1_model - f1_baseline
    return F.when(d > 0.01, "better").when(d < -0.01, "worse").otherwise("same")


def strongest(model: dict, top: int = 10) -> list[tuple[str, float]]:
    return sorted(zip(model["schema"], model["weights"], strict=True), key=lambda x: -abs(x[1]))[:top]
