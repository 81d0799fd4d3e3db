import math
import random

import pytest
from pyspark.sql import functions as F

from geotally.operators import raster, spatial, splits


def pts(spark, rows):
    return spark.createDataFrame(rows, "id int, cls string, x double, y double, city string")


def test_nearest_other_class(spark):
    df = pts(spark, [(1, "T", 0.0, 0.0, "a"), (2, "A", 15.0, 0.0, "a")])
    assert [r["distance"] for r in spatial.nearest_other_class_distance(df, "cls").collect()] == [15.0, 15.0]
    one = pts(spark, [(1, "T", 0.0, 0.0, "a"), (2, "T", 15.0, 0.0, "a"), (3, "T", None, 1.0, "a")])
    out = {r["id"]: r["distance"] for r in spatial.nearest_other_class_distance(one, "cls").collect()}
    assert out == {1: math.inf, 2: math.inf, 3: None}


def test_nearest_agrees_with_brute_force_and_filter(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "B", None]), rng.uniform(0, 300), rng.gauss(0, 50), "a") for i in range(200)]
    df = pts(spark, rows)
    want = {}
    for i, c, x, y, _ in rows:
        others = [math.hypot(x - u, y - v) for j, k, u, v, _ in rows if j != i and k != c]
        want[i] = None if c is None else min(others, default=math.inf)
    got = {r["id"]: r["distance"] for r in spatial.nearest_other_class_distance(df, "cls").collect()}
    assert all((got[i] is None and want[i] is None) or got[i] == pytest.approx(want[i]) for i in want)
    kept = {r["id"] for r in spatial.proximity_filter(df, 6.0, "cls").collect()}
    assert kept == {i for i, d in want.items() if d is not None and d >= 6.0}


def test_neighbour_joins_are_equi_joins(spark):
    df = pts(spark, [(1, "T", 0.0, 0.0, "a"), (2, "A", 15.0, 0.0, "a")])
    for out in (spatial.proximity_filter(df, 5.0, "cls"), spatial.morans_i(df.withColumn("f", F.col("x")), ["f"], [20.0])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_blocks_and_splits_are_disjoint(spark):
    rows = [(100 * b + i, "TILIA" if i % 2 else "ACER", 10.0 * b + i, 10.0 * b, "berlin") for b in range(12) for i in range(4)]
    df = pts(spark, rows).withColumn("block_id", F.concat(F.lit("b"), (F.col("id") / 100).cast("int").cast("string")))
    out = splits.split_source(df, "block_id", "cls")
    assert splits.block_overlap(out, "split", "block_id").count() == 0 and out.count() == 48
    assert {r["split"] for r in out.select("split").distinct().collect()} == {"train", "val", "test"}
    few = df.where("block_id in ('b0', 'b1')")
    with pytest.raises(ValueError):
        splits.split_source(few, "block_id", "cls")
    with pytest.raises(ValueError):
        splits.split_source(df, "block_id", "cls", (0.5, 0.2, 0.2))
    with pytest.raises(ValueError):
        splits.stratified_group_folds(df.where("cls = 'ACER'"), "block_id", "cls", 3)


def test_boundary_and_reprojection(spark):
    ring = spark.createDataFrame([("a", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "city string, ring array<struct<x:double,y:double>>")
    df = pts(spark, [(1, "T", 5.0, 5.0, "a"), (2, "T", 12.0, 5.0, "a"), (3, "T", 14.0, 5.0, "a")])
    assert [r["id"] for r in spatial.within_buffered_boundary(df, ring, 3.0).orderBy("id").collect()] == [1, 2]
    assert spatial.validate_within(df, ring, 0.0).first()["n_outside"] == 2
    out = spatial.reproject(pts(spark, [(1, "T", 15.0, 52.0, "a")]), "EPSG:4326").first()
    assert out["x"] == pytest.approx(500000.0) and out["y"] == pytest.approx(5761038.212, abs=0.01)
    with pytest.raises(ValueError):
        spatial.reproject(df, None)


def test_peaks(spark):
    cells = spark.createDataFrame([("a", c, r, 10.0 if (c, r) == (3, 2) else 1.0) for c in range(6) for r in range(6)], "city string, col long, row long, value double")
    assert [(r["col"], r["row"]) for r in raster.local_maxima(cells, 3).where("value > 5").collect()] == [(3, 2)]
    out = raster.snap_to_peak(pts(spark, [(1, "T", 1.5, 2.5, "a"), (2, "T", None, None, "a")]), cells, 3.0).orderBy("id").collect()
    assert (out[0]["x"], out[0]["y"], out[0]["correction_distance"]) == (3.5, 2.5, 2.0) and not out[1]["position_corrected"]
    with pytest.raises(ValueError):
        raster.local_maxima(cells, 4)


def test_projection_there_and_back(spark):
    grid = spark.createDataFrame([(float(lon), float(lat)) for lon in (9, 11.5, 13.4, 15, 16.2, 21) for lat in (-60, 0.5, 30, 47.3, 52.5, 55, 70)], "x double, y double")
    there = spatial.reproject(grid.select("*", F.col("x").alias("lon"), F.col("y").alias("lat")), "EPSG:4326")
    back = spatial.reproject(there, "EPSG:25833", to="EPSG:4326").collect()
    assert all(abs(r["x"] - r["lon"]) < 1e-8 * 0.9 and abs(r["y"] - r["lat"]) < 1e-8 * 0.9 for r in back)  # a millimetre
    known = spatial.reproject(spark.createDataFrame([(500000.0, 5761038.212)], "x double, y double"), "EPSG:25833", to="EPSG:4326").first()
    assert known["x"] == pytest.approx(15.0) and known["y"] == pytest.approx(52.0, abs=1e-7)
    assert spatial.reproject(grid, "EPSG:4258", to="EPSG:4326") is grid
    with pytest.raises(ValueError):
        spatial.reproject(grid, "EPSG:4326", to="EPSG:3857")


def moran(rows, values, lag):
    """Moran's I by all pairs, row-standardised; rows without neighbour count 0."""
    z = [v - sum(values) / len(values) for v in values]
    total, some = 0.0, 0
    for i, (xi, yi) in enumerate(rows):
        near = [z[j] for j, (xj, yj) in enumerate(rows) if j != i and math.hypot(xi - xj, yi - yj) <= lag]
        if near:
            total, some = total + z[i] * sum(near) / len(near), some + 1
    return len(rows) / some * total / sum(v * v for v in z)


@pytest.mark.parametrize("crowd", [512, 3])
def test_permutations_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(spatial, "CROWD", crowd)
    monkeypatch.setattr(spatial, "TOGETHER", 4)
    rng = random.Random(2)
    places = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(70)]
    df = pts(spark, [(i, "T", x, y, "a") for i, (x, y) in enumerate(places)]).withColumn("v", F.col("x") / 30 + F.pmod(F.xxhash64("id"), F.lit(100)) / 40)
    values = [r["v"] for r in df.orderBy("id").collect()]
    dealt = spatial.permuted(df, "v", list(range(1, 7))).orderBy("id").collect()
    got = spatial.morans_i_pvalue(df, "v", 9.0, 6)
    observed = moran(places, values, 9.0)
    assert got["morans_i"] == pytest.approx(observed)
    each = [[r[f"p{k}"] for r in dealt] for k in range(1, 7)]
    assert all(sorted(p) == sorted(values) and p != values for p in each) and len({tuple(p) for p in each}) == 6
    assert got["pvalue"] == (sum(moran(places, p, 9.0) >= observed for p in each) + 1) / 7
    assert spatial.morans_i_pvalue(df, "v", 1e-9, 6)["morans_i"] is None


def test_near_points_of_a_dense_place(spark):
    rng = random.Random(4)
    rows = [(i, "T", rng.uniform(0, 300), rng.uniform(0, 300), "a") for i in range(300)] + [(i, "T", rng.uniform(0, 3), rng.uniform(0, 3), "a") for i in range(300, 900)]
    rng.shuffle(rows)
    rows += [(2000, "T", None, 1.0, "a"), (None, "T", 1.0, 1.0, "a"), (2001, "T", -7.0, -7.0, "a"), (2002, "T", -7.0, -2.0, "a")]
    kept = {r["id"] for r in spatial.remove_near_points(pts(spark, rows), 5.0).collect()}
    known = [r for r in rows if r[0] is not None and r[2] is not None]
    want = {r[0] for r in known if not any(o[0] < r[0] and math.hypot(o[2] - r[2], o[3] - r[3]) <= 5.0 for o in known)}
    assert kept == want | {2000, None} and 2002 not in kept


@pytest.mark.parametrize("crowd", [512, 3])
def test_independence_of_splits_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(spatial, "CROWD", crowd)
    rng = random.Random(8)
    rows = [(i, "train" if x < 30 else "test", x, rng.uniform(0, 40), "a") for i in range(80) for x in [rng.uniform(0, 60)]]
    df = pts(spark, rows).withColumn("v", F.col("y") / 10 + F.pmod(F.xxhash64("id"), F.lit(50)) / 10)
    value = {r["id"]: r["v"] for r in df.collect()}
    border = [r for r in rows if any(o[1] != r[1] and math.hypot(o[2] - r[2], o[3] - r[3]) <= 6.0 for o in rows)]
    groups = {"train": [r for r in rows if r[1] == "train"], "test": [r for r in rows if r[1] == "test"], "test|train": border}
    want = {k: moran([r[2:4] for r in g], [value[r[0]] for r in g], 8.0) for k, g in groups.items()}
    got = spatial.post_split_independence(df, "cls", "v", 8.0, buffer=6.0).collect()
    assert {r["part"]: pytest.approx(r["morans_i"]) for r in got} == want
    assert {r["independent"] for r in got} == {want["test|train"] < max(want["train"], want["test"])}
