import numpy as np
import pytest
from pyspark.sql import functions as F

from geotally.operators import splits


def blocks_of(spark, n, rare=False):
    """About 12 rows in each of n blocks, classes in shares that differ from block to block."""
    i, b = F.col("id"), (F.col("id") % n).alias("b")
    df = spark.range(n * 12).select("id", b)
    draw = F.pmod(F.xxhash64(i), F.lit(1000)) / 1000
    tilt = F.pmod(F.xxhash64("b", F.lit(1)), F.lit(100)) / 100
    cls = F.when(draw < 0.2 + 0.6 * tilt, "oak").when(draw < 0.95, "elm").otherwise("yew")
    return df.where(F.pmod(F.xxhash64(i, F.lit(2)), F.lit(10)) < 2 + F.pmod(F.xxhash64("b"), F.lit(8))).withColumn("cls", cls)


def seen(monkeypatch):
    """The numbers of groups that reach the driver."""
    sizes, deal = [], splits._deal
    monkeypatch.setattr(splits, "_deal", lambda n, *rest: sizes.append(len(n)) or deal(n, *rest))
    return sizes


@pytest.mark.parametrize("groups", [4096, 40])
def test_folds_of_many_blocks(spark, monkeypatch, groups):
    monkeypatch.setattr(splits, "GROUPS", groups)
    sizes = seen(monkeypatch)
    df = blocks_of(spark, 3000).cache()
    folds = splits.stratified_group_folds(df, "b", "cls", 5).cache()
    assert folds.count() == df.count() and splits.block_overlap(folds, "fold", "b").count() == 0
    rows = [r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(rows) == 5 and max(rows) < 1.05 * min(rows)
    assert max(r["kl"] for r in splits.split_kl(folds, "fold", "cls").collect()) < 0.005
    source = splits.split_source(df, "b", "cls").cache()
    assert splits.split_validation(source, "split", "b", "cls", 0.07).where("n_overlap = 0").count() == 3
    share = {r["split"]: r["n"] / df.count() for r in source.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert all(abs(share[k] - v) < 0.02 for k, v in {"train": 0.7, "val": 0.15, "test": 0.15}.items())
    target = splits.split_target(df, "b", "cls")
    assert splits.split_validation(target, "split", "b", "cls", 0.07).first()["n_overlap"] == 0
    assert max(sizes) <= max(groups, 64 * 3)


def test_groups_dont_grow_with_blocks(spark, monkeypatch):
    monkeypatch.setattr(splits, "GROUPS", 40)
    sizes = seen(monkeypatch)
    for n in (500, 8000):
        splits.stratified_group_folds(blocks_of(spark, n), "b", "cls", 3)
    assert max(sizes) <= 40


def test_equal_blocks_are_dealt_in_equal_numbers(spark):
    rows = [(b, c) for b in range(1003) for c in ("oak", "elm", None)] + [(None, "oak"), (None, None)]
    df = spark.createDataFrame(rows, "b int, cls string")
    out = splits.stratified_group_folds(df, "b", "cls", 5)
    assert out.count() == len(rows)
    n = sorted(r["n"] for r in out.groupBy("fold").agg(F.countDistinct(F.coalesce("b", F.lit(-1))).alias("n")).collect())
    assert sum(n) == 1004 and n[-1] - n[0] <= 1
    again = splits.stratified_group_folds(df.repartition(7), "b", "cls", 5)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))


def test_dealing_is_even():
    rng = np.random.default_rng(5)
    sizes, sums = rng.integers(1, 30, 200), None
    sums = rng.integers(0, 50, (200, 4)) * sizes[:, None].astype(float)
    quota = splits._deal(sizes, sums, 5, 1)
    assert (quota.sum(axis=1) == sizes).all() and (quota >= (sizes // 5)[:, None]).all()
    shares = quota.T @ (sums / sizes[:, None]) / sums.sum(axis=0)
    assert abs(shares - 0.2).max() < 0.01
