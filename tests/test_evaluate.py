import numpy as np
import pytest
from pyspark.sql import functions as F

from geotally.operators import evaluate, learn, outliers, stats, validate
from geotally.sources import io


def preds(spark):
    return spark.createDataFrame([(i, i % 3, i % 3 if i % 4 else (i + 1) % 3, i % 3 if i % 5 else 0) for i in range(60)], "id int, y_true int, y_pred int, y_other int")


def test_bootstrap_holds_the_value(spark):
    r = evaluate.bootstrap_ci(preds(spark), replicates=200)
    assert r["low"] <= r["value"] <= r["high"]
    assert r["value"] == pytest.approx(evaluate.metrics(preds(spark)).first()["f1"])


def test_mcnemar(spark):
    df = spark.createDataFrame([(1, 1, 0)] * 6 + [(1, 0, 1)] * 2 + [(1, 1, 1)] * 4, "y_true int, a int, b int")
    r = evaluate.mcnemar(df, "a", "b").first()
    assert (r["b_count"], r["c_count"], r["statistic"]) == (6, 2, 9 / 8)
    assert evaluate.mcnemar_p(df, "a", "b") == pytest.approx(2 * 37 / 256)


def test_vif_and_ill_conditioned_mahalanobis(spark):
    df = spark.range(200).select(F.col("id"), F.lit("A").alias("cls"), F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("c", F.col("a") + F.col("b"))
    assert stats.vif(df, ["a", "b", "c"])["c"] == float("inf") and stats.vif(df, ["a"]) == {"a": 1.0}
    out = outliers.outlier_mahalanobis(df, ["a", "b", "c"], "cls", 0.001)
    assert out.where("mahalanobis_d2 is null").count() == 0


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "cls string")
    assert sorted({(r["cls"], round(r["weight"], 6)) for r in learn.balanced_weights(df, "cls").collect()}) == [("a", round(4 / 6, 6)), ("b", 2.0)]


def test_param_candidates():
    assert len(learn.param_candidates({"a": [1, 2], "b": 3})) == 2
    drawn = learn.param_candidates({"a": [1, 9], "b": [0.1, 0.2], "c": ["x", "y", "z"], "d": 4}, 5)
    assert all(1 <= p["a"] <= 9 and 0.1 <= p["b"] <= 0.2 and p["c"] in "xyz" and p["d"] == 4 for p in drawn)


def test_io_round_trip_and_contracts(spark, tmp_path):
    df = spark.createDataFrame([("t1", "a", "b1", "T", False, False, False, "none", 0, 1.0, 2.0, 3.0, float("nan"), "plain", "reduced", "train")], "tree_id string, city string, block_id string, genus_latin string, outlier_zscore boolean, outlier_mahalanobis boolean, outlier_iqr boolean, outlier_severity string, outlier_method_count int, x double, y double, height_m double, f double, variant string, feature_set string, split string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in io.REQUIRED if c not in df.columns})
    path = str(tmp_path / "splits")
    io.write_splits(df, path)
    back = io.read_splits(spark, path, "a", ("train", "test"))
    assert back["train"].first()["f"] is None and "height_m" not in back["train"].columns and back["test"].count() == 0
    assert io.read_split_by_strategy(spark, path, "a", "train", "baseline").count() == 1
    io.write_splits(df.withColumn("city", F.lit("b")), path)
    io.write_splits(df.withColumn("variant", F.lit("filtered")).unionByName(df.withColumn("variant", F.lit("filtered"))), path)
    io.write_splits(df, path)
    assert [io.read_splits(spark, path, c, ("train",), v)["train"].count() for c, v in (("a", ""), ("b", ""), ("a", "filtered"), ("b", "filtered"))] == [1, 1, 2, 0]
    with pytest.raises(ValueError):
        io.read_split_by_strategy(spark, path, "a", "train", "other")
    with pytest.raises(ValueError):
        io.write_splits(df.limit(0), path)
    with pytest.raises(ValueError, match="missing"):
        io.read_points(spark, path, ("nothing",))
    (tmp_path / "a.xyz").write_text("0 0 5\n1 0 6\n1 1 7\n1 1 8\n\nbad line\n")
    assert {(r["col"], r["row"], r["value"]) for r in io.read_xyz_cells(spark, str(tmp_path / "a.xyz"), "a").collect()} == {(0, 1, 5.0), (1, 1, 6.0), (1, 0, 8.0)}
    assert not validate.validate_schema(df, {"f": "string"})["valid"]
    with pytest.raises(ValueError):
        validate.validate_phase_schema(df, "a")


def test_bootstrap_weights_equal_brute_force(spark):
    rows = [(i, "ab"[i % 3 == 0] if i % 50 else None, float(i * i % 37) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, city string, v double").repartition(5)
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.lit(42), "id").alias("h")).collect()}
    weights = {i: evaluate.poisson_weights(np.array([h]), 60)[0] for i, h in hashes.items()}
    got = {(r["city"], r["replicate"]): r["mean"] for r in evaluate.poisson_bootstrap(df, "v", ["city"], 60, "id").collect()}
    assert len(got) == 180
    for (city, k), mean in got.items():
        mine = [(weights[i][k - 1], v) for i, c, v in rows if c == city and v is not None]
        assert mean == (pytest.approx(sum(w * v for w, v in mine) / sum(w for w, _ in mine)) if sum(w for w, _ in mine) else None)
    every = np.concatenate(list(weights.values()))
    assert abs(every.mean() - 1) < 0.03 and abs(every.var() - 1) < 0.05
    a, b = ([v for _, c, v in rows if c == g and v is not None] for g in "ab")
    d = (np.mean(a) - np.mean(b)) / (((len(a) - 1) * np.var(a, ddof=1) + (len(b) - 1) * np.var(b, ddof=1)) / (len(a) + len(b) - 2)) ** 0.5
    ci = evaluate.cohens_d_ci(df, "v", "city", "a", "b", "id")
    assert ci["low"] < d < ci["high"]
    plan = evaluate.poisson_bootstrap(df, "v", ["city"], 60, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > plan.index("Generate")  # vectors are taken apart after the tasks' sums, not rows before


