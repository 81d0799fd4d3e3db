"""Stratified draws by thresholds: equal to putting whole classes in order, without a window over a class."""

import random
import re

import pytest
from pyspark.sql import functions as F

from geotally.operators import splits


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(i, r.choice("aaaaaaabbbc") if i % 40 else None, i % 7) for i in r.sample(range(-5000, 5000), 700)] + [(9999, "d", 1)]


def in_order(spark, rows, seed):
    """class -> its (place, key) in order."""
    df = spark.createDataFrame(rows, "id long, cls string, v int")
    placed = df.select("cls", "id", (F.col("id") if seed is None else F.xxhash64(F.lit(seed), "id")).alias("h")).collect()
    return df.repartition(5), {c: sorted((r["h"], r["id"]) for r in placed if r["cls"] == c) for c in "abcd"}


@pytest.mark.parametrize("seed", [None, 42])
def test_fractions(spark, rows, seed):
    df, order = in_order(spark, rows, seed)
    want = {i: None for i, c, _ in rows if c is None}
    for places in order.values():
        for k, (_, i) in enumerate(places, 1):
            want[i] = next((f for f in (0.05, 0.3, 0.75) if k / len(places) <= f), None)
    got = splits.stratified_fractions(df, "cls", [0.3, 0.75, 0.05], "id", seed)
    assert {r["id"]: r["min_fraction"] for r in got.collect()} == want and got.columns == [*df.columns, "min_fraction"]
    assert re.search(r"Window \[.*cls", got._jdf.queryExecution().optimizedPlan().toString()) is None  # no window by the class itself


@pytest.mark.parametrize("n", [1, 3, 10, 57, 300, 701, 5000])
def test_subsets(spark, rows, n):
    df, order = in_order(spark, rows, 7)
    total = sum(map(len, order.values()))
    quota = {c: max(1, int(len(p) * n / total + 0.5)) for c, p in order.items()}
    ranked = sorted((max(0, k - quota[c]), k, h, i) for c, p in order.items() for k, (h, i) in enumerate(p, 1))
    got = sorted(r["id"] for r in splits.stratified_subset_n(df, "cls", n, "id", 7).collect())
    assert got == sorted(i for *_, i in ranked[:n])


def test_equal_places_and_other_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "id long, cls string")
    assert splits.stratified_fractions(df, "cls", [1.0], "id", None).where("min_fraction = 1").count() == 4
    with pytest.raises(ValueError):
        splits.stratified_fractions(df.withColumn("id", F.lit("x")), "cls", [0.5], "id", None)
