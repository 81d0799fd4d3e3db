"""Scores within groups: equal to a plain computation, and no plan sorts or buffers a whole group in one task."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from geotally.operators import stats

ROWS = [(i, "a", "hot", float(i % 17)) for i in range(300)] + [(300 + i, "a", "rare", v) for i, v in enumerate([1.0, 1.0, None, 40.0])]
ROWS += [(400 + i, "a", None, float(i * i % 29)) for i in range(30)] + [(500 + i, "b", "flat", 5.0) for i in range(20)] + [(600, "b", "flat", None), (700, None, "hot", 3.0)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id long, city string, cls string, v double").repartition(3)


def z(v, group):
    sd = statistics.stdev(group) if len(group) > 1 else 0
    return 0.0 if sd == 0 else None if v is None else (v - statistics.fmean(group)) / sd


def percent(v, group):
    return None if v is None else (sum(u < v for u in group) + (sum(u == v for u in group) + 1) / 2) * 100 / len(group)


def same(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def sorted_by_group(df):
    """The plan's windows, those within a range of values and those over the counts of ranges (a bounded number of rows a group) apart."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in text.split("\n") if re.match(r"[\W:]*Window ", line) and not re.search(r"__range#|sum\(__s#|sum\(__c#", line)]


def nodes(df):
    """Exchanges and scans of the plan that Spark runs for df."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (?:hash|range|Single|Round)", text)), len(re.findall(r"FileScan|Scan ExistingRDD|LocalTableScan", text))


def test_ranks_sort_ranges_only(frame):
    assert not sorted_by_group(stats.rank_table(frame, "v", ["city", "cls"]))


def test_scores_with_fallback(frame):
    out = stats.group_scores_with_fallback(frame, "v", "cls")
    assert out.columns == ["id", "city", "cls", "v", "v_zscore", "v_percentile"]
    exchanges, scans = nodes(out)
    assert exchanges <= 3 and scans == 2
    got = out.collect()
    assert sorted(r["id"] for r in got) == [r[0] for r in ROWS]
    for r in got:
        own = [x for x in ROWS if x[1:3] == (r["city"], r["cls"])]
        group = [x[3] for x in (own if len(own) >= 10 else [x for x in ROWS if x[1] == r["city"]]) if x[3] is not None]
        assert same(r["v_zscore"], z(r["v"], group)) and same(r["v_percentile"], percent(r["v"], group)), r


def test_scores(frame):
    out = stats.group_scores(frame, "v", ["city", "cls"])
    exchanges, scans = nodes(out)
    assert exchanges <= 3 and scans == 2
    got = out.collect()
    assert sorted(r["id"] for r in got) == [r[0] for r in ROWS if r[3] is not None]
    for r in got:
        group = [x[3] for x in ROWS if x[1:3] == (r["city"], r["cls"]) and x[3] is not None]
        assert same(r["zscore"], z(r["v"], group)) and same(r["pct_rank"], percent(r["v"], group)), r


def test_groups_without_spread_or_values(spark):
    rows = [(i, "a", "one", 0.1) for i in range(12)] + [(20 + i, "a", "two", 0.1) for i in range(3)] + [(30, "a", "three", 0.1)] + [(40 + i, "b", "none", None) for i in range(12)] + [(60, None, None, 1e9), (61, None, None, 1e9 + 1)]
    df = spark.createDataFrame(rows, "id long, city string, cls string, v double")
    got = {r["id"]: (r["v_zscore"], r["v_percentile"]) for r in stats.group_scores_with_fallback(df, "v", "cls").collect()}
    assert len(got) == len(rows) and got[0] == (0.0, 13 / 24 * 100) and got[20] == got[30] == (0.0, 17 / 32 * 100) and got[40] == (0.0, None)
    assert same(got[60][0], -(0.5**0.5)) and got[61][1] == 100.0
    assert stats.group_scores_with_fallback(df.where("id < 0"), "v", "cls").count() == 0 and stats.group_scores(df, "v", ["city"]).count() == 18


def test_values_that_end_in_another_bit_when_worked_out_again(spark):
    """Means of a shuffled table depend on the order of its rows, so each evaluation may give other bits; no row may lose its score by that."""
    @F.udf("double")
    def unsteady(i):
        return i % 7 + random.SystemRandom().random() * 1e-9

    df = spark.range(60).select("id", F.lit("a").alias("city"), F.lit("hot").alias("cls"), unsteady.asNondeterministic()("id").alias("v"))
    for r in stats.group_scores_with_fallback(df, "v", "cls").collect():
        assert r["v_zscore"] is not None and r["v_percentile"] is not None
    assert all(r["zscore"] is not None and r["pct_rank"] is not None for r in stats.group_scores(df, "v", ["city"]).collect())
    assert sorted(r["k"] for r in stats.with_rank(df, "v", "k").collect()) == list(range(1, 61))
