import pytest
from pyspark.sql import functions as F

from geotally.functions import columns
from geotally.operators import evaluate, spatial, splits


def names(spark, cols):
    return spark.range(1).select(*(F.lit(1.0).alias(c) for c in cols))


def test_names(spark):
    df = names(spark, ["tree_id", "city", "genus_latin", "CHM_1m", "NDVI_04", "NDVI_05", "EVI_04", "outlier_iqr", "x", "y"])
    assert columns.temporal_columns(df) == {4: ["NDVI_04", "EVI_04"], 5: ["NDVI_05"]}
    with pytest.raises(ValueError, match="6"):
        columns.temporal_columns(df, [4, 6])
    with pytest.raises(ValueError, match="differ"):
        columns.same_temporal_columns({"a": df, "b": names(spark, ["NDVI_04"])})
    assert columns.feature_names(["A", "B"], [4, 11]) == ["A_04", "B_04", "A_11", "B_11"]
    assert columns.metadata_columns(df) == ["city", "genus_latin", "outlier_iqr", "tree_id"]
    conifer = names(spark, ["tree_id", "city", "genus_latin", "is_conifer", "NDVI_04", "CHM_1m"])
    assert columns.feature_columns(conifer) == ["CHM_1m", "NDVI_04"] and columns.metadata_columns(conifer) == ["city", "genus_latin", "is_conifer", "tree_id"]
    for wrong in ({"height": ["NDVI_04"]}, {"height": ["CHM_1m_zscore"]}, {"expected": ["is_conifer"]}):
        with pytest.raises(ValueError):
            columns.feature_columns(conifer, **wrong)
    assert columns.feature_columns(df) == ["CHM_1m", "EVI_04", "NDVI_04", "NDVI_05"] and columns.feature_columns(df, height=[]) == ["EVI_04", "NDVI_04", "NDVI_05"]
    with pytest.raises(ValueError):
        columns.feature_columns(df, expected=["NDVI_09"])
    assert columns.resolve(df, "EVI") == "EVI_04" and columns.resolve(df, "CHM_1m") == "CHM_1m"
    with pytest.raises(ValueError):
        columns.resolve(df, "other")


def test_prepare_dataset_keeps_the_test_split_whole(spark):
    rows = [(i, ("train", "test")[i % 2], i % 3 == 0, ("none", "high")[i % 5 == 0], float(i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, split string, filtered boolean, outlier_severity string, f double, n long")
    for split, near in (("train", 10), ("test", 30)):
        out, counts = splits.prepare_dataset(df, split, "filtered", "remove_high", "no_chm", ["f", "n"], ["id"])
        assert counts["n_split"] == 30 and counts["n_after_proximity"] == near and counts["n_after_outliers"] == out.count()
        assert dict(out.dtypes) == {"id": "int", "f": "float", "n": "tinyint"}
    with pytest.raises(ValueError):
        splits.prepare_dataset(df, "train", "nearby", "no_removal", "no_chm", ["f"], ["id"])


def test_moran_permutations_and_hypotheses(spark):
    df = spark.range(64).select(F.col("id").cast("int").alias("id"), (F.col("id") % 8).cast("double").alias("x"), F.floor(F.col("id") / 8).cast("double").alias("y"), (F.col("id") % 8).cast("double").alias("v"), F.lit("a").alias("city"))
    r = spatial.morans_i_pvalue(df, "v", 1.0, 4)
    assert r["morans_i"] > 0.6 and r["pvalue"] == 1 / 5
    assert spatial.morans_i(df, ["v"], [1.0]).first()["morans_i"] == pytest.approx(r["morans_i"])
    d = df.withColumn("w", F.col("v") * 2 + F.col("y") / 100).withColumn("g", (F.col("v") > 3).cast("string")).withColumn("b", F.col("v") > 3)
    assert evaluate.hypothesis_test(d, "pearson", "v", "w")["conclusion"] == "supported" and evaluate.hypothesis_test(d, "spearman", "v", "w")["effect"] > 0.9
    assert evaluate.hypothesis_test(d, "kruskal", "w", "g")["pvalue"] < 0.01 and evaluate.hypothesis_test(d, "mann_whitney", "w", "b")["effect"] == pytest.approx(1.0)
    assert evaluate.hypothesis_test(d.limit(1), "pearson", "v", "w")["conclusion"] == "too few rows"
    ci = evaluate.cohens_d_ci(d.withColumn("city", F.when(F.col("b"), "s").otherwise("t")), "w", "city", "s", "t", "id", 40)
    assert 0 < ci["low"] < ci["high"]
