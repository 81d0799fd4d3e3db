"""Neighbour searches in a quadtree: equal to brute force where half the points crowd one place, and no task gets them all."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotally.operators import quadtree, spatial


def crowd(n=1200, seed=1):
    """Half the points in a square metre, some at one place, the rest over a square kilometre; one corner of a single class."""
    r = np.random.default_rng(seed)
    dense = np.arange(n) % 2 == 0
    x, y = np.where(dense, r.uniform(5, 6, n), r.uniform(0, 1000, n)), np.where(dense, r.uniform(5, 6, n), r.uniform(0, 1000, n))
    x[:60], y[:60] = 7.0, 7.0
    c = np.where(x < 400, 0, r.integers(0, 3, n))
    return x, y, c, r.normal(size=n)


@pytest.fixture(scope="module")
def table(spark):
    x, y, c, f = crowd()
    rows = [(i, "N" if i % 97 == 0 else f"c{k}", float(a), float(b), "one" if i % 3 else "two", float(v)) for i, (a, b, k, v) in enumerate(zip(x, y, c, f, strict=True))]
    rows = [(i, None if k == "N" else k, a, b, g, v) for i, k, a, b, g, v in rows]
    return rows, spark.createDataFrame(rows, "id long, cls string, x double, y double, city string, f double").repartition(4)


def distances(rows):
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    return np.hypot(x[:, None] - x, y[:, None] - y)


def test_tree(table):
    rows, df = table
    tree = quadtree.build(df, 16)
    assert tree.points.count() == len(rows) and tree.nodes.where("leaf and n > 16").count() == 1  # the 60 at one place
    assert tree.points.groupBy("leaf").count().where("count > 16").count() == 1
    assert tree.nodes.where("leaf").agg(F.sum("n")).first()[0] == len(rows)


def test_nearest_other_class(table):
    rows, df = table
    d, c = distances(rows), np.array([r[1] or "" for r in rows])
    want = np.where(c[:, None] == c, np.inf, d).min(axis=1)
    got = {r["id"]: r["distance"] for r in spatial.nearest_other_class_distance(df, "cls").collect()}
    assert len(got) == len(rows) and all(got[i] == (None if r[1] is None else pytest.approx(want[i])) for i, r in enumerate(rows))
    near = {r["id"]: r["distance"] for r in spatial.nearest_other_class_distance(df, "cls", max_radius=3.0).collect()}
    assert all(near[i] == (None if r[1] is None else pytest.approx(want[i]) if want[i] <= 3 else math.inf) for i, r in enumerate(rows))
    kept = {r["id"] for r in spatial.proximity_filter(df, 3.0, "cls").collect()}
    assert spatial.crowded(df, 3.0) and kept == {i for i, r in enumerate(rows) if r[1] is not None and want[i] >= 3}


def test_k_nearest(table):
    rows, df = table
    d = distances(rows)
    order = np.argsort(d, axis=1, kind="stable")[:, :8]
    got = {(r["id"], r["rank"]): (r["site"], r["distance"]) for r in spatial.k_nearest(df, 8).collect()}
    assert len(got) == 8 * len(rows) and all(got[i, k + 1] == (j, pytest.approx(d[i, j])) for i in range(len(rows)) for k, j in enumerate(order[i]))
    other = {r["id"]: r["distance"] for r in spatial.nearest_other_class_knn(df, "cls", 7).collect()}
    for i, r in enumerate(rows):
        first = next((k for k, j in enumerate(order[i]) if rows[j][1] != r[1]), 0)
        assert other[i] == (None if r[1] is None else pytest.approx(d[i, order[i][first]]) if first else math.inf)


def test_moran_and_ripley_and_borders(table):
    rows, df = table
    d, f, city = distances(rows), np.array([r[5] for r in rows]), np.array([r[4] for r in rows])
    got = {(r["city"], r["lag"]): r["morans_i"] for r in spatial.morans_i(df, ["f"], [2.0, 150.0]).collect()}
    for g in ("one", "two"):
        i = np.flatnonzero(city == g)
        z = f[i] - f[i].mean()
        for lag in (2.0, 150.0):
            w = (d[np.ix_(i, i)] <= lag) & ~np.eye(len(i), dtype=bool)
            n = w.sum(axis=1)
            want = len(i) / (n > 0).sum() * (z * (w @ z) / np.maximum(n, 1)).sum() / (z * z).sum()
            assert got[g, lag] == pytest.approx(want, abs=1e-9)
    k = {r["distance"]: r["k"] for r in spatial.ripley_k(df, [2.0, 80.0], 1e6).collect()}
    assert all(k[r] == pytest.approx(1e6 * ((d <= r).sum() - len(rows)) / (len(rows) * (len(rows) - 1))) for r in k)
    border = {r["id"] for r in spatial.split_boundary_rows(df, "city", "one", "two", 5.0).collect()}
    assert border == {i for i in range(len(rows)) if (d[i][city != city[i]] <= 5).any()}


def test_work_is_even(table):
    """Half the points crowd one place, yet leaves look at about as many points each, and no task of eight gets twice the median."""
    _, df = table
    places = df.select("x", "y", F.pmod(F.xxhash64("id"), F.lit(3)).cast("string").alias("c")).groupBy("x", "y").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    tree = quadtree.build(places, 8, {"lo": (F.min("lo"), F.min("lo")), "hi": (F.max("hi"), F.max("hi"))})
    sizes = quadtree.candidates(tree, 1, True, None).join(tree.nodes.select(F.col("id").alias("b"), "n"), "b").groupBy("g", "a").agg(F.sum("n").alias("n"))
    of_tasks = sizes.groupBy(F.pmod(F.hash("g", "a", F.lit(0).cast("long")), F.lit(8))).agg(F.sum("n").alias("n")).toPandas().n
    assert tree.nodes.where("leaf").agg(F.max("n")).first()[0] <= 8 and sizes.agg(F.max("n")).first()[0] <= 8 * 30 and of_tasks.max() <= 2 * of_tasks.median()


def test_little(spark):
    none = spark.createDataFrame([], "id long, cls string, x double, y double")
    assert spatial.nearest_other_class_distance(none, "cls").count() == 0 and spatial.k_nearest(none, 3).count() == 0
    one = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "b", None, 1.0)], "id long, cls string, x double, y double")
    assert [tuple(r) for r in spatial.k_nearest(one, 3).select("id", "rank", "distance").collect()] == [(1, 1, 0.0)]
    assert {r["id"]: r["distance"] for r in spatial.nearest_other_class_knn(one, "cls", 3).collect()} == {1: math.inf, 2: None}
