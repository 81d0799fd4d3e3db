"""Operators whose last step is small algebra on the driver, against plain computations over the same rows."""

import math
import random

import numpy as np
import pytest

from geotally.operators import stats


def test_separability_of_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(c, *map(float, rng.normal(m, s, 3) + 1e6)) for c, m, s, n in (("a", 0, 1, 40), ("b", 1, 2, 60), ("c", 30, 1, 25), ("one", 5, 1, 1)) for _ in range(n)]
    got = stats.jm_multivariate(spark.createDataFrame(rows, "cls string, f double, g double, h double").repartition(5), ["f", "g", "h"], "cls")
    x = {c: np.array([r[1:] for r in rows if r[0] == c]) for c in "abc"}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (p, q), v in got.items():
        cp, cq = (np.cov(x[k].T) + 1e-6 * np.eye(3) for k in (p, q))
        mid, d = (cp + cq) / 2, x[p].mean(axis=0) - x[q].mean(axis=0)
        b = d @ np.linalg.inv(mid) @ d / 8 + 0.5 * math.log(np.linalg.det(mid) / math.sqrt(np.linalg.det(cp) * np.linalg.det(cq)))
        assert v == pytest.approx(2 * (1 - math.exp(-b)), rel=1e-6)


def test_redundancy_needs_both_tables(spark):
    kind = "a string, b string, r double"
    first = spark.createDataFrame([("u", "v", 0.99), ("u", "w", 0.2), ("v", "w", -0.97), ("w", "z", 0.98)], kind)
    second = spark.createDataFrame([("u", "v", -0.96), ("u", "w", 0.1), ("v", "w", 0.98), ("w", "z", 0.5)], kind)
    assert stats.redundancy_consensus(first, second, {"u": 1.0, "v": 0.5, "w": 0.7}) == ["v"]  # v goes for w; then it is gone from the pair with u
    assert stats.redundancy_consensus(first, second, {"v": 9.0}) == ["w", "u"]
    assert stats.redundancy_consensus(first, second, {"v": 9.0}, {"w": "only"}) == ["u"]
    assert stats.redundancy_consensus(first, second, {"v": 9.0}, min_keep=3) == ["w"]


def alexander_govern(groups):
    """The statistic by Hill's normal approximation of t, from the groups' standard errors."""
    se = {k: np.std(g, ddof=1) / math.sqrt(len(g)) for k, g in groups.items()}
    mean = sum(np.mean(g) / se[k] ** 2 for k, g in groups.items()) / sum(1 / e**2 for e in se.values())
    total = 0.0
    for k, g in groups.items():
        t, nu = (np.mean(g) - mean) / se[k], len(g) - 1
        a = nu - 0.5
        b, c = 48 * a * a, math.sqrt(a * math.log(1 + t * t / nu))
        total += (c + (c**3 + 3 * c) / b - (4 * c**7 + 33 * c**5 + 240 * c**3 + 855 * c) / (10 * b * b + 8 * b * c**4 + 1000 * b)) ** 2
    return total


def test_equal_means(spark):
    rng = random.Random(6)
    near = {k: [rng.gauss(m, s) for _ in range(n)] for k, m, s, n in (("a", 0, 1, 30), ("b", 0, 3, 12), ("c", 0.1, 1, 50))}
    far = {k: [v + 5 * (k == "b") for v in g] for k, g in near.items()}
    left_out = [("flat", 1.0), ("flat", 1.0), ("one", 2.0), ("a", None)]
    for groups in (near, far):
        df = spark.createDataFrame([(k, v) for k, g in groups.items() for v in g] + left_out, "cls string, v double")
        got, want = stats.welch_anova(df, "v", "cls"), alexander_govern(groups)
        assert got["statistic"] == pytest.approx(want) and got["pvalue"] == pytest.approx(math.exp(-want / 2))  # two degrees of freedom
    with pytest.raises(ValueError):
        stats.welch_anova(df.where("cls in ('a', 'flat', 'one')"), "v", "cls")
