"""Sums over neighbours within a lag: equal to brute force whichever way cells are compared, and in tasks whose number doesn't follow the bytes."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotally.operators import quadtree, spatial


def test_runs_against_all_pairs():
    r = np.random.default_rng(2)
    x, y = (np.concatenate([r.normal(0, 60, 700), r.uniform(5, 6, 300), np.full(40, 7.0), np.arange(60.0)]) for _ in range(2))
    v = r.normal(size=(len(x), 2))
    sites = np.column_stack([x, y, v])
    for lag in (0.0, 1.0, 5.0, 80.0, 1e4):
        near = np.hypot(x[:, None] - x, y[:, None] - y) <= lag
        got = quadtree.sums_within(x, y, sites, lag)
        assert (got[:, 0] == near.sum(axis=1)).all() and np.allclose(got[:, 1:], near @ v)
    assert not quadtree.sums_within(x, y, sites[:0], 1.0).any() and quadtree.sums_within(x[:0], y[:0], sites, 1.0).shape == (0, 3)


@pytest.mark.parametrize("group", [4096, 40])
def test_within_against_all_pairs(spark, monkeypatch, group):
    """Points of a normal distribution, a dense place, one place of 90 rows, and far ones that are alone; places lie exactly a lag apart."""
    monkeypatch.setattr(quadtree, "GROUP", group)
    r = np.random.default_rng(3)
    x, y = (np.concatenate([r.normal(0, 100, 500), r.uniform(20, 21, 300), np.full(90, 30.0), np.arange(0, 400, 8.0), r.uniform(-3000, 3000, 60)]) for _ in range(2))
    v, city = r.normal(size=len(x)), np.where(np.arange(len(x)) % 4 == 0, "b", "a")
    df = spark.createDataFrame([(i, float(a), float(b), float(c), str(g)) for i, (a, b, c, g) in enumerate(zip(x, y, v, city, strict=True))], "id long, x double, y double, v double, city string")
    lags = [8.0, 90.0, 700.0]
    tree = quadtree.build(df, 16, {"v": (F.sum("v"), F.sum("v"))}, "city")
    got = {(k["id"], k["lag"]): (k["n"], k["v"]) for k in quadtree.within(tree, lags, ["v"], "id").collect()}
    d, same = np.hypot(x[:, None] - x, y[:, None] - y), city[:, None] == city
    assert len(got) == len(x) * len(lags)
    for lag in lags:
        near = (d <= lag) & same
        assert all(got[i, lag][0] == near[i].sum() and got[i, lag][1] == pytest.approx(near[i] @ v, abs=1e-9) for i in range(len(x)))


def test_points_are_compared_in_groups(spark):
    """Rings of leaves are looked at a cell at a time: leaves travel as arrays, in as many tasks as the session's partitions, not pair by pair of points."""
    df = spark.range(3000).select("id", (F.rand(1) * 100).alias("x"), (F.rand(2) * 100).alias("y"))
    near = quadtree.within(quadtree.build(df, 64), [9.0], [], "id")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and len(re.findall(r"hashpartitioning\([^)]*, 4\), REPARTITION_BY_NUM", plan)) >= 2


def test_morans_table_is_written_once(spark):
    """The block sizes read their small table twice, and the independence of splits its borders many times; neither is worked out again."""
    df = spark.range(60).select("id", F.lit("a").alias("city"), (F.col("id") % 8).cast("double").alias("x"), (F.col("id") / 8).alias("y"), F.sin("id").alias("f"))
    plan = spatial.block_size_recommendation(spatial.decay_distance(spatial.morans_i(df, ["f"], [2.0, 4.0])))._jdf.queryExecution().optimizedPlan().toString()
    assert "hypot" not in plan.lower()
    split = spatial.post_split_independence(df.withColumn("s", F.when(F.col("x") < 4, "l").otherwise("r")), "s", "f", 2.0, buffer=2.0)
    assert "hypot" not in split._jdf.queryExecution().optimizedPlan().toString().lower()
