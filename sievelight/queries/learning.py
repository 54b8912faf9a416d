"""Learning and streaming queries over `embeddings`, `labels` and `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ml
from ..plans.rules import half_up
from ..streaming import flows
from . import telemetry

NAMES = [f"v{i}" for i in range(64)]
MODEL = {"schema": NAMES, "weights": [((i * 37) % 11 - 5) / 4 for i in range(64)], "bias": -0.25, "mean": [0.0] * 64, "sd": [0.125] * 64}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"), (F.col("label") == 0).cast("int").alias("label"))


def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.standardiser(samples(spark, sf_dir)).select(F.col("i").cast("long").alias("i"), half_up(F.col("mean"), 6).alias("mean"),
        half_up(F.col("sd"), 6).alias("sd"))


def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.predict(samples(spark, sf_dir), MODEL, names=NAMES).select("vec_id", half_up(F.col("probability"), 6).alias("probability"))


def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ml.predict(samples(spark, sf_dir), MODEL, names=NAMES).select("vec_id", F.posexplode("contributions").alias("place", "c"))
    return a.select("vec_id", F.col("place").cast("long").alias("place"), half_up(F.col("c.value"), 5).alias("value"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.pmod(F.col("n_chars"), F.lit(97)) / F.lit(97.0)).alias("score"))
    return d.join(lab, "doc_id")


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ml.rates(ml.confusion(scored_labels(spark, sf_dir), "score", "quality"))
    return a.select("tp", "fp", "fn", "tn", *[half_up(F.col(c), 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.auc(scored_labels(spark, sf_dir), "score", "quality").select(half_up(F.col("auc"), 6).alias("auc"))


def train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weights after the operator's own number of epochs."""
    model = ml.train(samples(spark, sf_dir), NAMES)
    rows = [*zip(NAMES, model["weights"], strict=True), ("bias", model["bias"])]
    return spark.createDataFrame(rows, "name string, weight double").select("name", half_up(F.col("weight"), 6).alias("weight"))


def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model held against a rule, that the first component is positive."""
    a = ml.cross_validate(samples(spark, sf_dir), NAMES, "vec_id").withColumn("rule", (F.get("vector", 0) > 0).cast("double"))
    f1 = lambda c: ml.rates(ml.confusion(a, c, "label")).select(F.col("f1").alias(c))
    # three tables of one row
    one = ml.auc(a, "probability", "label").join(F.broadcast(f1("probability"))).join(F.broadcast(f1("rule")))
    return one.select(half_up(F.col("auc"), 6).alias("auc"), half_up(F.col("probability"), 6).alias("f1"),
        half_up(F.col("rule"), 6).alias("rule_f1"), ml.verdict(F.col("probability"), F.col("rule")).alias("verdict"))


def holdout_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ml.folds(samples(spark, sf_dir), "vec_id", 5, "label")
    return a.groupBy("label", "fold").agg(F.count("*").alias("n"))


def stream_runtime_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.drained(flows.latest_state(flows.events(spark, sf_dir)), "complete").select("user_id", "event_id")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.drained(flows.deduplicated(flows.events(spark, sf_dir)), "append").groupBy("user_id").agg(F.count("*").alias("n"))


def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.drained(flows.windowed(flows.events(spark, sf_dir)), "complete").select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.drained(flows.rate_limited(flows.events(spark, sf_dir), 3, 86_400_000), "append").groupBy("allowed").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (standardise, predict, top_contributions, confusion_metrics, roc_auc, train_logistic, cross_validate,
    holdout_folds, stream_runtime_fold, stream_dedupe, stream_histogram, stream_rate_limit)}

_6, _E = telemetry._6, telemetry._E
_V = "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT vec_id, i, (v / 0.125::DOUBLE) * (((i * 37) % 11 - 5) / 4.0::DOUBLE) AS c FROM v) "
_R = "WITH s AS (SELECT (n_chars % 97) / 97.0::DOUBLE AS score, quality FROM documents JOIN labels USING (doc_id)) "
_FOLDS = "WITH h AS (SELECT vec_id, embedding::DOUBLE[] AS v, (label = 0)::INT AS label, md5(vec_id::VARCHAR) AS h FROM embeddings), d AS (SELECT vec_id, v, label, ((row_number() OVER (PARTITION BY label, h[1:1] ORDER BY h, vec_id) - 1) % 5)::INT AS fold FROM h) "
_UNIT = "list_transform(list_zip(d.v, s.m, s.sd), lambda t: CASE WHEN t[3] <= 1e-12 THEN 0 ELSE (t[1] - t[2]) / t[3] END)"


def _descent(epochs: int, seen: str) -> str:
    """Gradient descent for each fold on the rows that it may see, as a recursion over (fold, epoch, weights, bias)."""
    each = lambda of: "[" + ", ".join(of.format(i=i) for i in range(1, 65)) + "]"
    return f"""f AS (SELECT DISTINCT fold FROM d),
        s AS (SELECT f.fold, {each('avg(d.v[{i}])')} AS m, {each('greatest(stddev_pop(d.v[{i}]), 1e-9)')} AS sd, count(*)::DOUBLE AS n, count(*) FILTER (d.label = 1) AS ones FROM f JOIN d ON {seen} GROUP BY f.fold),
        x AS (SELECT f.fold, d.label AS y, s.n / (2 * CASE WHEN d.label = 1 THEN s.ones ELSE s.n - s.ones END) AS k, s.n AS n, {_UNIT} AS x FROM f JOIN d ON {seen} JOIN s ON s.fold = f.fold),
        g AS (SELECT fold, 0 AS epoch, {each('0.0::DOUBLE')} AS w, 0.0::DOUBLE AS b FROM f UNION ALL
          SELECT fold, epoch + 1, {each('any_value(w[{i}]) - 0.3::DOUBLE * (sum(e * x[{i}]) / any_value(n) + 0.01::DOUBLE * any_value(w[{i}]))')}, any_value(b) - 0.3::DOUBLE * sum(e) / any_value(n)
          FROM (SELECT g.fold, epoch, w, b, x.x, x.n, k * (1 / (1 + exp(-(list_dot_product(w, x.x) + b))) - y) AS e FROM g JOIN x USING (fold) WHERE epoch < {epochs}) GROUP BY fold, epoch)"""


ORACLE_SQL = {
    "standardise": _V + "SELECT i, " + _6("avg(v)") + " AS mean, " + _6("greatest(stddev_pop(v), 1e-9)") + " AS sd FROM v GROUP BY i",
    "predict": _V + "SELECT vec_id, " + _6("(1 / (1 + exp(-(sum(c) - 0.25::DOUBLE))))") + " AS probability FROM c GROUP BY vec_id",
    "top_contributions": _V + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC, i) - 1 AS place FROM c WHERE c <> 0) SELECT vec_id, place, floor(c * "
        "100000.0::DOUBLE + 0.5) / 100000.0::DOUBLE AS value FROM r WHERE place < 5",
    "confusion_metrics": _R + ", c AS (SELECT count(*) FILTER (score >= 0.5 AND quality = 1) AS tp, count(*) FILTER (score >= 0.5 AND quality = 0) AS fp, count(*) FILTER (score < "
        "0.5 "
        ""
        ""
        "AND quality = 1) AS fn, count(*) FILTER (score < 0.5 AND quality = 0) AS tn FROM s), d AS (SELECT *, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS a, "
        "tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r FROM c)"
        " SELECT tp, fp, fn, tn, " + _6("a") + " AS accuracy, " + _6("p") + " AS precision, " + _6("r") + " AS recall, " + _6("(2 * p * r / (p + r))") + " AS f1 FROM d",
    "roc_auc": _R + ", w AS (SELECT sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS auc FROM s p, s n "
        "WHERE p.quality = 1 AND n.quality = 0) SELECT " + _6("auc") + " AS auc FROM w",
    "holdout_folds": _FOLDS + "SELECT label, fold, count(*) AS n FROM d GROUP BY ALL",
    "train_logistic": "WITH RECURSIVE d AS (SELECT vec_id, embedding::DOUBLE[] AS v, (label = 0)::INT AS label, 0 AS fold FROM embeddings), " + _descent(400, "true")
        + f", e AS (SELECT w, b FROM g WHERE epoch = 400) SELECT 'v' || i AS name, {_6('w[i + 1]')} AS weight FROM e, (SELECT unnest(range(64)) AS i) UNION ALL SELECT 'bias', {_6('b')} FROM e",
    "cross_validate": _FOLDS.replace("WITH", "WITH RECURSIVE", 1).removesuffix(" ") + ", " + _descent(60, "d.fold <> f.fold")
        + f""", p AS (SELECT d.label AS y, d.v[1] > 0 AS r, 1 / (1 + exp(-(list_dot_product(e.w, {_UNIT}) + e.b))) AS p FROM d JOIN s USING (fold) JOIN g e USING (fold) WHERE e.epoch = 60),
        a AS (SELECT sum(CASE WHEN x.p > z.p THEN 1.0::DOUBLE WHEN x.p = z.p THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS auc FROM p x, p z WHERE x.y = 1 AND z.y = 0),
        m AS (SELECT coalesce(2.0::DOUBLE * count(*) FILTER (p >= 0.5 AND y = 1) / (count(*) FILTER (p >= 0.5) + count(*) FILTER (y = 1)), 0) AS f, 2.0::DOUBLE * count(*) FILTER (r AND y = 1) / (count(*) FILTER (r) + count(*) FILTER (y = 1)) AS q FROM p)
        SELECT {_6('auc')} AS auc, {_6('f')} AS f1, {_6('q')} AS rule_f1, CASE WHEN f - q > 0.01 THEN 'better' WHEN f - q < -0.01 THEN 'worse' ELSE 'same' END AS verdict FROM a, m""",
    "stream_runtime_fold": _E + "SELECT user_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) = 1",
    "stream_dedupe": _E + "SELECT user_id, count(DISTINCT k) AS n FROM e GROUP BY user_id",
    "stream_histogram": "SELECT epoch(time_bucket(INTERVAL 1 day, ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_rate_limit": telemetry.ORACLE_SQL["rate_limit"].replace("SELECT event_id, c <= 3 AS allowed FROM r JOIN o USING (user_id, i)",
        "SELECT c <= 3 AS allowed, count(*) AS n FROM r JOIN o USING (user_id, i) GROUP BY 1"),
}
