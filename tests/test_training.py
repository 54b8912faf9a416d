"""Training of all folds at once against one model at a time, in plain steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.operators import ml


def _plain(x, y, epochs, rate=0.3, l2=0.01):
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = (x - mean) / sd
    k = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        e = k * (1 / (1 + np.exp(-(z @ w + b))) - y)
        w, b = w - rate * (z.T @ e / len(y) + l2 * w), b - rate * e.sum() / len(y)
    return w, b, mean, sd


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)) * [1, 5, 0.1, 1, 1, 0] + [0, 10, 1e6, 0, -3, 2]
    return x, (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=500) > 3).astype(int)


def _frame(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, vector array<double>, label int").repartition(4)


@pytest.mark.parametrize("tree", [64, 0])
def test_one_model(spark, data, tree, monkeypatch):
    if not tree:  # sums of sums
        monkeypatch.setattr(ml, "TREE", 1)
    x, y = data
    model = ml.train(_frame(spark, x, y).union(spark.createDataFrame([(-1, [1.0] * 6, None)], "id long, vector array<double>, label int")), list("abcdef"), epochs=40)
    w, b, mean, sd = _plain(x, y, 40)
    assert np.allclose(model["weights"], w, atol=1e-7) and abs(model["bias"] - b) < 1e-7 and np.allclose(model["mean"], mean) and np.allclose(model["sd"], sd, rtol=1e-6)
    assert len(model["losses"]) == 21 and model["losses"][-1] < model["losses"][0]


def test_all_folds_in_one_job_an_epoch(spark, data):
    x, y = data
    sc = spark.sparkContext
    sc.setJobGroup("folds", "cross validation")
    try:
        got = ml.cross_validate(_frame(spark, x, y), list("abcdef"), "id", 4, epochs=50)
        jobs = len(sc.statusTracker().getJobIdsForGroup("folds"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 50 + 10
    fold = {r.id: r.fold for r in got.select("id", "fold").collect()}
    p = {r.id: r.probability for r in got.collect()}
    for f in range(4):
        mine = np.array([fold[i] == f for i in range(500)])
        w, b, mean, sd = _plain(x[~mine], y[~mine], 50)
        want = 1 / (1 + np.exp(-((x - mean) / sd @ w + b)))
        assert all(abs(p[i] - want[i]) < 1e-6 for i in np.flatnonzero(mine))


def test_refused(spark, data):
    x, y = data
    with pytest.raises(ValueError, match="one class"):
        ml.train(_frame(spark, x, np.ones_like(y)), list("abcdef"))
    with pytest.raises(ValueError, match="nothing"):
        ml.train(_frame(spark, x, y).filter(F.lit(False)), list("abcdef"))


def test_model_of_other_columns_is_refused(spark, data):
    x, y = data
    df = _frame(spark, x, y)
    model = ml.train(df, list("abcdef"), epochs=2)
    assert ml.predict(df, model, names=list("abcdef")).count() == 500
    for names, said in ((list("abdcef"), "d where c is"), (list("abcde"), "5 columns, not 6"), ([*"abcdefg"], "7 columns, not 6")):
        with pytest.raises(ValueError, match=said):
            ml.predict(df, model, names=names)
