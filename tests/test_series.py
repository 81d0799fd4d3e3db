import pytest

from geotally.operators import prep, series, stats


def frame(spark, rows, names, kinds="double"):
    return spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'id' else 'string' if n in ('city', 'cls') else kinds}" for n in names))


def values(df):
    return [tuple(r) for r in df.collect()]


def test_inner_gap_is_linear_and_own(spark):
    df = frame(spark, [(1, 0.2, None, 0.4), (2, 0.9, 0.8, 0.7)], ["id", "NDVI_04", "NDVI_05", "NDVI_06"])
    out = dict((r[0], r[1:]) for r in values(series.interpolate_within_entity(df, [4, 5, 6])))
    assert out[1] == pytest.approx((0.2, 0.3, 0.4)) and out[2] == pytest.approx((0.9, 0.8, 0.7))


@pytest.mark.parametrize(("given", "wanted"), [((None, 0.3, 0.5), (0.3, 0.3, 0.5)), ((None, None, 0.6), (None, None, 0.6)), ((0.3, 0.5, None), (0.3, 0.5, 0.5)), ((None, None, None), (None, None, None))])
def test_edges(spark, given, wanted):
    df = frame(spark, [(1, *given)], ["id", "N_04", "N_05", "N_06"])
    assert values(series.interpolate_within_entity(df, [4, 5, 6]))[0][1:] == wanted


def test_mixed(spark):
    df = frame(spark, [(1, None, 0.4, None, 0.6)], ["id", "N_04", "N_05", "N_06", "N_07"])
    assert values(series.interpolate_within_entity(df, [4, 5, 6, 7]))[0][1:] == pytest.approx((0.4, 0.4, 0.5, 0.6))


def test_gappy_rows_go(spark):
    df = frame(spark, [(1, None, None, 0.4), (2, 0.2, 0.3, 0.4)], ["id", "N_04", "N_05", "N_06"])
    assert [r[0] for r in values(series.filter_gappy_series(df, [4, 5, 6], 1))] == [2]


def test_plausible_max(spark):
    df = frame(spark, [(1, 0.2, 0.1), (2, 0.4, 0.5), (3, 0.6, 0.2), (4, None, None), (5, float("nan"), 0.1)], ["id", "a", "b"])
    assert [r[0] for r in values(prep.filter_plausible_max(df, ["a", "b"], 0.3))] == [2, 3]


def test_scores_fall_back_to_the_city(spark):
    df = frame(spark, [(1, "b", "T", 10.0), (2, "b", "T", 14.0), (3, "l", "T", 20.0)], ["id", "city", "cls", "h"])
    out = {r["id"]: r for r in stats.group_scores_with_fallback(df, "h", "cls").collect()}
    assert out[1]["h_zscore"] == pytest.approx(-2 / 8**0.5) and out[3]["h_percentile"] == 100 and out[3]["h_zscore"] == 0


def test_no_spread_and_nulls(spark):
    df = frame(spark, [(1, "b", "T", 10.0), (2, "b", "T", 10.0), (3, "b", "T", None)], ["id", "city", "cls", "h"])
    out = {r["id"]: r for r in stats.group_scores_with_fallback(df, "h", "cls").collect()}
    assert [out[i]["h_zscore"] for i in (1, 2, 3)] == [0, 0, 0] and out[3]["h_percentile"] is None


def test_guards(spark):
    df = frame(spark, [(1, 0.2, None, 0.4)], ["id", "N_04", "N_05", "N_06"])
    with pytest.raises(ValueError, match="inner gaps"):
        series.assert_interior_filled(df, [4, 5, 6])
    with pytest.raises(ValueError, match="N_05"):
        series.assert_no_nulls(df, ["N_04", "N_05"])
    assert {r["feature"]: r["n_missing"] for r in series.missing_profile(df, ["N_04", "N_05"]).collect()} == {"N_04": 0, "N_05": 1}


def test_select_months_contract(spark):
    df = frame(spark, [(1, 0.2)], ["id", "N_04"])
    for months in ([], [13]):
        with pytest.raises(ValueError):
            prep.select_months(df, months, ["N"], ["id"])
    with pytest.raises(ValueError, match="city"):
        prep.select_months(df, [4], ["N"], ["city"])


def test_quality_pipeline_reads_its_input_twice(spark):
    """Counted in the plans: the written one of the value's counts, and the result's."""
    import re

    from geotally.plans import preparation
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    if not __import__("pathlib").Path(d).exists():
        pytest.skip("no test tables")
    out = preparation.ts4_quality_pipeline(spark, d)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?:hash|range|Single|Round)", text)) <= 12 and len(re.findall("FileScan", text)) <= 3
