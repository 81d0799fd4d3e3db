"""Boosting on the softmax loss: equal to a plain computation, warm starts, falling loss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotally.operators import boost, learn


def rows(n, seed, shift=0.0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) + shift
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] * x[:, 0] > 0.2)
    w = r.uniform(0.5, 2, n)
    return x, y, w


def frame(spark, x, y, w):
    return spark.createDataFrame([(i, *map(float, a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))], "id int, a double, b double, c double, label int, weight double").repartition(3)


def plain_trees(x, y, w, m, classes, cuts, depth, rate, penalty, least):
    """One round by trying every cut of every node; the margins afterwards."""
    e = np.exp(m - m.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    out = m.copy()

    def grow(g, h, at, left_depth):
        best = None
        if left_depth:
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    right = x[at, f] > c
                    a, b = at[~right], at[right]
                    if h[a].sum() >= least and h[b].sum() >= least:
                        gain = g[a].sum() ** 2 / (h[a].sum() + penalty) + g[b].sum() ** 2 / (h[b].sum() + penalty) - g[at].sum() ** 2 / (h[at].sum() + penalty)
                        if round(gain, 9) > 0 and (best is None or round(gain, 9) > best[0]):
                            best = round(gain, 9), a, b
        if best is None:
            return [(at, -rate * g[at].sum() / (h[at].sum() + penalty))]
        return grow(g, h, best[1], left_depth - 1) + grow(g, h, best[2], left_depth - 1)

    for k in range(classes):
        for at, value in grow((p[:, k] - (y == k)) * w, p[:, k] * (1 - p[:, k]) * w, np.arange(len(y)), depth):
            out[at, k] += value
    return out


def test_equals_a_plain_computation(spark):
    x, y, w = rows(250, 1)
    df = frame(spark, x, y, w)
    model = boost.fit(df, ["a", "b", "c"], 3, weight="weight", rounds=3, depth=3, bins=8)
    cuts = [np.unique(q) for q in df.approxQuantile(["a", "b", "c"], [i / 8 for i in range(1, 8)], 1e-3)]
    m = np.zeros((250, 3))
    for _ in range(3):
        m = plain_trees(x, y, w, m, 3, cuts, 3, 0.3, 1.0, 1.0)
    got = np.array([r["margins"] for r in boost.margins(df, model).orderBy("id").collect()])
    assert np.allclose(got, m, atol=1e-8)


def test_warm_start(spark):
    source, target = frame(spark, *rows(300, 2)), frame(spark, *rows(200, 3, 0.6))
    first = boost.fit(source, ["a", "b", "c"], 3, weight="weight", rounds=4, depth=2)
    same = boost.fit(target, ["a", "b", "c"], 3, weight="weight", rounds=0, start=first)
    a, b = (boost.margins(target, m).orderBy("id").select("margins").collect() for m in (first, same))
    assert a == b
    tuned = boost.fit(target, ["a", "b", "c"], 3, weight="weight", rounds=10, depth=2, start=first)
    assert len(tuned.rounds) == 14 and all(t is u for t, u in zip(tuned.rounds, first.rounds))
    losses = [*tuned.losses, boost.log_loss(target, tuned, weight="weight")]
    assert losses[0] == pytest.approx(boost.log_loss(target, first, weight="weight")) and all(a > b for a, b in zip(losses, losses[1:]))
    halfway = boost.fit(target, ["a", "b", "c"], 3, weight="weight", rounds=4, depth=2, start=boost.fit(target, ["a", "b", "c"], 3, weight="weight", rounds=6, depth=2, start=first))
    assert boost.log_loss(target, halfway, weight="weight") == pytest.approx(losses[-1])
    with pytest.raises(ValueError):
        boost.fit(target, ["a", "b"], 3, start=first)


def test_missing_values_and_nothing(spark):
    x, y, w = rows(100, 4)
    df = frame(spark, x, y, w).withColumn("a", F.when(F.col("id") % 5 != 0, F.col("a"))).withColumn("label", F.when(F.col("id") != 3, F.col("label")))
    model = boost.fit(df, ["a", "b", "c"], 3, rounds=2, depth=2)
    assert boost.classified(df, model).where("prediction is null").count() == 0
    assert boost.fit(df.limit(0), ["a", "b", "c"], 3).rounds == [] and boost.fit(df.limit(0), ["a", "b", "c"], 3, start=model).rounds == model.rounds


def test_curve_and_coordinates(spark):
    x, y, w = rows(240, 5)
    df = frame(spark, x, y, w)
    source = boost.fit(df.where("id < 80"), ["a", "b", "c"], 3, rounds=2, depth=2)
    curve = learn.boosted_learning_curve(source, df.where("id between 80 and 199"), df.where("id >= 200"), [0.5, 1.0], 2, depth=2)
    assert {(r["fraction"], r["model"]) for r in curve.collect()} == {(0.0, "source"), (0.5, "finetuned"), (0.5, "scratch"), (1.0, "finetuned"), (1.0, "scratch")} and curve.count() == 200
    placed = df.selectExpr("id", "a as x", "b as y", "label", "1.0 as weight")
    model = learn.coordinates_forest(numTrees=5, maxDepth=3).fit(placed)
    right = learn.predictions(model, placed).where("y_true = y_pred").count()
    assert right > 150
