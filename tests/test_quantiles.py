"""Exact quantiles by counting in ranges: equal to numpy's, with ties, small groups and keys that are null."""

import random

import numpy as np
import pytest

from geotally.operators import outliers, stats


def test_quantiles_of_large_groups(spark):
    r = random.Random(2)
    rows = [("big", i % 2, r.gauss(0, 1) if i % 3 else 7.0) for i in range(900)] + [("flat", 0, 5.0)] * 40 + [("one", 0, -3.5), (None, 1, 2.0), (None, 1, 4.0), ("none", 0, None), ("skew", 0, 1e12), *(("skew", 0, float(k)) for k in range(30))]
    df = spark.createDataFrame(rows, "city string, k int, v double").repartition(5)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    groups = {}
    for c, k, v in rows:
        if v is not None:
            groups.setdefault((c, k), []).append(v)
    for held in (0, stats.HELD):
        got = {(x["city"], x["k"]): x["__q"] for x in stats.exact_quantiles(df, ["city", "k"], "v", qs, held).collect()}
        assert got.keys() == groups.keys()
        for g, values in groups.items():
            assert got[g] == pytest.approx(np.quantile(values, qs).tolist(), rel=1e-12)


def test_flags_do_not_depend_on_the_way(spark, monkeypatch):
    r = random.Random(3)
    df = spark.createDataFrame([(i, "ab"[i % 2], r.gauss(0, 1) * (10 if i % 50 == 0 else 1)) for i in range(500)], "id int, city string, v double")
    flagged = {x["id"] for x in outliers.outlier_iqr(df, "v", ["city"]).where("outlier_iqr").collect()}
    quantiles = stats.exact_quantiles
    monkeypatch.setattr(stats, "exact_quantiles", lambda *a: quantiles(*a, held=0))
    assert flagged and flagged == {x["id"] for x in outliers.outlier_iqr(df, "v", ["city"]).where("outlier_iqr").collect()}
