"""Learning operators whose results SQL can't give, against plain computations over the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotally.operators import evaluate, learn, raster, splits, stats

SMALL = {"numTrees": 6, "maxDepth": 3}


def weighted_f1(true, pred):
    total = 0.0
    for c in set(true):
        tp = sum(t == p == c for t, p in zip(true, pred, strict=True))
        total += true.count(c) * 2 * tp / (true.count(c) + pred.count(c))
    return total / len(true)


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(300, 3))
    y = (x[:, 0] + 0.4 * r.normal(size=300) > 0).astype(int) + (x[:, 0] > 1)
    return spark.createDataFrame([(i, i % 3, *map(float, a), int(b), "abc"[b], 1.0) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, fold int, f double, g double, h double, label int, cls string, weight double").repartition(3).cache()


def test_training_data_is_scaled_and_encoded_by_the_training_rows(spark, data):
    d = data.drop("label")
    frames, labels, table = learn.prepare_training_data(d.where("id % 4 <> 0"), {"test": d.where("id % 4 = 0")}, ["f", "g"], "cls")
    train = [r for r in data.collect() if r["id"] % 4]
    want = {f: (np.mean([r[f] for r in train]), np.std([r[f] for r in train])) for f in "fg"}
    assert {r["cls"]: r["label"] for r in labels.collect()} == {"a": 0, "b": 1, "c": 2}
    raw = {r["id"]: r for r in data.collect()}
    got = frames["test"].collect()
    assert len(got) == sum(i % 4 == 0 for i in raw)
    for r in got:
        assert r["label"] == raw[r["id"]]["label"]
        assert r["features"].toArray() == pytest.approx([(raw[r["id"]][f] - want[f][0]) / want[f][1] for f in "fg"])


def test_random_baseline_draws_by_the_training_shares(spark):
    train = spark.createDataFrame([("a",)] * 10 + [("b",)] * 30 + [("c",)] * 60, "cls string")
    df = spark.range(20_000)
    one, two = (learn.random_baseline(d, train, "cls", "id").collect() for d in (df, df.repartition(7)))
    assert {r["id"]: r["y_pred"] for r in one} == {r["id"]: r["y_pred"] for r in two}
    for c, share in (("a", 0.1), ("b", 0.3), ("c", 0.6)):
        assert sum(r["y_pred"] == c for r in one) / 20_000 == pytest.approx(share, abs=0.015)
    assert {r["y_pred"] for r in learn.random_baseline(df, train.where("cls = 'b'"), "cls", "id").collect()} == {"b"}


def test_cross_validation_equals_fits_of_each_fold(data):
    pipeline, val, train = learn.forest(["f", "g"], **SMALL), [], []
    for k in range(3):
        p = [(r["fold"] == k, r["label"], int(r["prediction"])) for r in pipeline.fit(data.where(F.col("fold") != k)).transform(data).collect()]
        val.append(weighted_f1([t for held, t, _ in p if held], [y for held, _, y in p if held]))
        train.append(weighted_f1([t for held, t, _ in p if not held], [y for held, _, y in p if not held]))
    got = learn.cross_validate_blocks(data, pipeline)
    assert got == pytest.approx({"val_f1_mean": np.mean(val), "val_f1_std": np.std(val), "train_f1_mean": np.mean(train), "gap": np.mean(train) - np.mean(val)})
    assert got["val_f1_mean"] > 0.7


def test_search_takes_the_first_best_candidate(data):
    space = {"numTrees": [1, 6], "maxDepth": 2}
    make = lambda q: learn.forest(["f", "g"], **q)
    scores = [(learn.cross_validate_blocks(data, make(q))["val_f1_mean"], q) for q in learn.param_candidates(space)]
    best, score = learn.param_search(data, make, space)
    assert score == max(s for s, _ in scores) and best == next(q for s, q in scores if s == score)


def test_importance_finds_the_feature_that_decides(spark, data):
    got = learn.feature_importance(learn.forest(["g", "f", "h"], **SMALL).fit(data), ["g", "f", "h"], spark).collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["feature"] == "f" and got[0]["importance"] > 0.6
    assert sum(r["importance"] for r in got) == pytest.approx(1) and [r["importance"] for r in got] == sorted((r["importance"] for r in got), reverse=True)


def test_learning_curve_judges_every_model_on_the_same_rows(data):
    source = learn.forest(["f", "g"], **SMALL).fit(data.where("id < 150"))
    pool, test = data.where("id >= 150 and id % 5 <> 0"), data.where("id >= 150 and id % 5 = 0")
    got = learn.learning_curve(source, pool, test, ["f", "g"], 3, [0.5, 1.0], **SMALL).collect()
    rows = {r["id"]: r["label"] for r in test.collect()}
    for f in (0.5, 1.0):
        for m in ("finetuned", "scratch"):
            part = {r["id"]: r for r in got if r["fraction"] == f and r["model"] == m}
            assert {i: r["y_true"] for i, r in part.items()} == rows
    alone = learn.predictions(learn.forest(["f", "g"], **SMALL).fit(learn.balanced_weights(pool.drop("weight"), "label")), test)
    assert {r["id"]: r["y_pred"] for r in alone.collect()} == {r["id"]: r["y_pred"] for r in got if r["fraction"] == 1.0 and r["model"] == "scratch"}


def test_adaptive_radius_is_the_90th_percentile_of_distances(spark):
    r = np.random.default_rng(2)
    cells = [("a", i, j, float(r.uniform(0, 12))) for i in range(60) for j in range(60)]
    points = [(k, "a", float(x), float(y)) for k, (x, y) in enumerate(r.uniform(5, 55, (200, 2)))]
    height = {(i, j): v for _, i, j, v in cells}
    found = []
    for _, _, x, y in points:
        c, w = math.floor(x), math.floor(y)
        window = {(i, j): height[c + i, w + j] for i in range(-5, 6) for j in range(-5, 6) if (c + i, w + j) in height}
        peaks = [(math.hypot(i, j) / (v + 1), w + j, c + i, math.hypot(i, j)) for (i, j), v in window.items() if v >= 3 and math.hypot(i, j) <= 5 and v >= max(window.get((i + a, j + b), -1) for a in (-1, 0, 1) for b in (-1, 0, 1))]
        if peaks:
            found.append(min(peaks)[3])
    got = raster.adaptive_radius(spark.createDataFrame(points, "id int, city string, x double, y double"), spark.createDataFrame(cells, "city string, col int, row int, value double"))
    assert got == max(1, math.ceil(np.percentile(found, 90)))
    flat = spark.createDataFrame([("a", 0, 0, 1.0)], "city string, col int, row int, value double")
    assert raster.adaptive_radius(spark.createDataFrame(points, "id int, city string, x double, y double"), flat) == 5


def test_final_preparation_gives_every_row_once(spark):
    r = np.random.default_rng(5)
    rows = [(i, "ab"[i % 5 == 0], ["PINUS", "ACER", "TILIA"][i % 3], float(x), float(y), float(z), float(h)) for i, (x, y, z, h) in enumerate(np.c_[r.uniform(0, 6000, (600, 2)), r.normal(size=(600, 1)), r.uniform(5, 20, (600, 1))])]
    df = spark.createDataFrame(rows, "id int, city string, cls string, x double, y double, f double, CHM_1m double")
    got = splits.final_preparation(df, ["f"], "cls", source="a").collect()
    assert sorted(v["id"] for v in got) == list(range(600))
    names, blocks = {"a": set(), "b": set()}, {}
    for v in got:
        names[v["city"]].add(v["split"])
        blocks.setdefault((v["city"], v["block_id"]), set()).add(v["split"])
        near = any(o[0] != v["id"] and o[1] == v["city"] and o[2] != v["cls"] and math.dist(o[3:5], (v["x"], v["y"])) < 5 for o in rows)
        assert v["filtered"] != near, v["id"]
    assert all(len(s) == 1 for s in blocks.values()) and len(names["a"]) == 3 and len(names["b"]) == 2


def tail(f, t, n=200_001, far=60.0):
    """The integral of f from t to far, by Simpson's rule."""
    x = np.linspace(t, far, n)
    w = np.ones(n)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float((w * f(x)).sum() * (far - t) / (n - 1) / 3)


def test_a_constant_column_correlates_with_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.5, 7.0), (4.0, 5.0, 7.0), (None, 1.0, 7.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlations(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.5, 5])[0, 1]) and got["a", "c"] is None and got["b", "c"] is None
    assert stats.spearman(df, "a", "c").first()["rho"] == 0


def test_p_values_of_hypotheses(spark):
    r = np.random.default_rng(8)
    a = r.normal(size=60)
    b = 0.25 * a + r.normal(size=60)
    df = spark.createDataFrame([(float(x), float(y), bool(x + y > 0.3), "k") for x, y in zip(a, b, strict=True)] + [(None, 1.0, True, "k"), (1.0, None, None, "k")], "a double, b double, c boolean, one string")
    student = lambda v: math.gamma((v + 1) / 2) / math.sqrt(v * math.pi) / math.gamma(v / 2)
    for kind, x, y in (("pearson", a, b), ("spearman", a.argsort().argsort(), b.argsort().argsort())):
        got, want = evaluate.hypothesis_test(df, kind, "a", "b"), np.corrcoef(x, y)[0, 1]
        t = abs(want) * math.sqrt(58 / (1 - want**2))
        assert got["n"] == 60 and got["statistic"] == pytest.approx(want)
        assert got["pvalue"] == pytest.approx(2 * tail(lambda z: student(58) * (1 + z * z / 58) ** -29.5, t), abs=1e-7)
    got = evaluate.hypothesis_test(df, "mann_whitney", "b", "c")
    yes, no = b[a + b > 0.3], b[a + b <= 0.3]
    u = sum((p > q) + 0.5 * (p == q) for p in [*yes, 1.0] for q in no)
    sd = math.sqrt((yes.size + 1) * no.size / 12 * (yes.size + no.size + 2))
    assert got["statistic"] == pytest.approx(u) and got["effect"] == pytest.approx(2 * u / (yes.size + 1) / no.size - 1)
    assert got["pvalue"] == pytest.approx(math.erfc(abs(u - (yes.size + 1) * no.size / 2) / sd / math.sqrt(2)), abs=1e-7)
    same = df.withColumn("d", F.lit(2.0)).withColumn("e", F.lit(True))
    assert evaluate.hypothesis_test(same, "spearman", "a", "d")["conclusion"] == "not supported"
    for kind, x, y in (("pearson", "a", "d"), ("kruskal", "a", "one"), ("mann_whitney", "a", "e"), ("mann_whitney", "d", "c")):
        assert evaluate.hypothesis_test(same, kind, x, y)["conclusion"] == "no statistic", (kind, x, y)
