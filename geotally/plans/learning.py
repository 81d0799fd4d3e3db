"""Queries: learning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotally.operators import boost, evaluate, learn, splits
from geotally.plans.bindings import FEATURES, PTS, R, points, rounded
from geotally.plans.registry import query

SOME = FEATURES[:5]
SMALL = {"numTrees": 8, "maxDepth": 4}


def labelled(spark, d):
    return learn.balanced_weights(points(spark, d).withColumnRenamed("label", "label_"), "label_").withColumnRenamed("label_", "label")


@query(f"WITH {PTS} SELECT id, " + ", ".join(f"{R(f'({f} - (SELECT avg({f}) FROM pts WHERE id % 4 <> 0)) / (SELECT stddev_pop({f}) FROM pts WHERE id % 4 <> 0)')} AS {f}" for f in SOME) + " FROM pts")
def ml1_standard_scale(spark, d):
    p = points(spark, d)
    return rounded(learn.standard_scale(p, learn.scale_table(p.where("id % 4 <> 0"), SOME)).select("id", *SOME))


@query(f"WITH {PTS} SELECT id, {R('(SELECT count(*) FROM pts) / ((SELECT count(DISTINCT cls) FROM pts) * count(*) OVER (PARTITION BY cls))')} AS weight FROM pts")
def ml2_balanced_weights(spark, d):
    return rounded(learn.balanced_weights(points(spark, d), "cls").select("id", "weight"))


@query(f"WITH {PTS} SELECT CAST(dense_rank() OVER (ORDER BY cls) - 1 AS INTEGER) AS label, n FROM (SELECT c.cls, count(*) FILTER (WHERE id % 4 = 0) AS n FROM pts c WHERE cls IN (SELECT cls FROM pts WHERE id % 4 <> 0) GROUP BY c.cls) QUALIFY n > 0")
def ml3_prepare_training_data(spark, d):
    p = points(spark, d).drop("label")
    frames, _, _ = learn.prepare_training_data(p.where("id % 4 <> 0"), {"test": p.where("id % 4 = 0")}, SOME, "cls")
    return frames["test"].groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {PTS} SELECT cls, count(*) AS n FROM pts GROUP BY cls ORDER BY n DESC, cls LIMIT 1")
def ml4_majority_baseline(spark, d):
    return learn.majority_baseline(points(spark, d), "cls")


@query()
def ml4_random_baseline(spark, d):
    p = points(spark, d)
    return learn.random_baseline(p, p.where("city = 'source'"), "cls", "id").groupBy("y_pred").agg(F.count("*").alias("n"))


@query()
def ml5_forest(spark, d):
    p = labelled(spark, d)
    return learn.predictions(learn.forest(SOME, **SMALL).fit(p.where("city = 'source'")), p.where("city = 'target'"))


@query()
def ml6_boosted(spark, d):
    p = labelled(spark, d)
    return learn.predictions(learn.boosted(SOME, rounds=3, depth=2).fit(p.where("city = 'source'")), p.where("city = 'target'"))


@query()
def ml7_cross_validate(spark, d):
    p = splits.stratified_group_folds(labelled(spark, d).withColumn("block_id", F.col("id") % 30), "block_id", "label", 3)
    r = learn.cross_validate_blocks(p, learn.forest(SOME, **SMALL))
    return spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} double" for k in r))


@query()
def ml8_feature_importance(spark, d):
    return learn.feature_importance(learn.forest(SOME, **SMALL).fit(labelled(spark, d)), SOME, spark)


@query("WITH r(n_features, f1) AS (SELECT p_size, max(p_retailprice) / 2000 FROM part GROUP BY p_size) SELECT n_features, round(f1, 6) + 0.0 AS f1 FROM r WHERE f1 >= (SELECT max(f1) FROM r) - 0.05 ORDER BY n_features LIMIT 1")
def ml8_optimal_size(spark, d):
    from geotally.plans.bindings import table

    r = table(spark, d, "part").groupBy(F.col("p_size").alias("n_features")).agg((F.max("p_retailprice") / 2000).alias("f1"))
    return rounded(learn.optimal_size(r, 0.05))


@query()
def ml9_poisson_bootstrap(spark, d):
    return evaluate.poisson_bootstrap(points(spark, d), "CHM_1m", ["cls"], 50, "id")


@query("WITH r AS (SELECT p_brand AS variant, count(*) AS n_rows, avg(p_retailprice) / 2000 AS val_f1, avg(p_size) / 97 AS gap FROM part GROUP BY 1), b AS (SELECT * FROM r WHERE variant = (SELECT min(p_brand) FROM part)) SELECT r.variant, r.n_rows, round(r.val_f1, 6) + 0.0 AS val_f1, round(r.gap, 6) + 0.0 AS gap, CASE WHEN r.variant = b.variant THEN 'baseline' WHEN r.val_f1 - b.val_f1 < 0.001 THEN 'reject: improvement' WHEN 1 - r.n_rows / b.n_rows > 0.2 THEN 'reject: rows lost' WHEN r.gap - b.gap > 0.02 THEN 'reject: gap' ELSE 'adopt' END AS decision FROM r, b")
def ml10_choose_variant(spark, d):
    from geotally.plans.bindings import table

    part = table(spark, d, "part")
    r = part.groupBy(F.col("p_brand").alias("variant")).agg(F.count("*").alias("n_rows"), (F.avg("p_retailprice") / 2000).alias("val_f1"), (F.avg("p_size") / 97).alias("gap"))
    first = part.agg(F.min("p_brand")).first()[0]
    return rounded(learn.choose_variant(r, first, 0.001, 0.2, 0.02))


@query()
def ml11_param_search(spark, d):
    p = splits.stratified_group_folds(labelled(spark, d).withColumn("block_id", F.col("id") % 30), "block_id", "label", 2)
    best, score = learn.param_search(p, lambda q: learn.forest(SOME, **q), {"numTrees": [4, 8], "maxDepth": 3}, 2)
    return spark.createDataFrame([(str(best["numTrees"]), score)], "num_trees string, f1 double")


@query()
def ml12_learning_curve(spark, d):
    p = labelled(spark, d)
    source = learn.forest(SOME, **SMALL).fit(p.where("city = 'source'"))
    t = p.where("city = 'target'")
    curve = learn.learning_curve(source, t.where("id % 10 <> 0"), t.where("id % 10 = 0"), SOME, 10, [0.5, 1.0], **SMALL)
    return evaluate.metrics(curve, ["fraction", "model"])


def source_model(p, rounds=2):
    return boost.fit(p.where("city = 'source'"), SOME, 10, weight="weight", rounds=rounds, depth=2)


@query()
def ml6_softmax_boosted(spark, d):
    p = labelled(spark, d)
    return boost.classified(p.where("city = 'target'"), source_model(p), "y_pred").select("id", F.col("label").cast("int").alias("y_true"), "y_pred")


@query()
def ml6_finetuned(spark, d):
    p = labelled(spark, d)
    tuned = boost.fit(p.where("city = 'target' and id % 10 <> 0"), SOME, 10, weight="weight", rounds=2, depth=2, start=source_model(p))
    return boost.classified(p.where("city = 'target'"), tuned, "y_pred").select("id", F.col("label").cast("int").alias("y_true"), "y_pred")


@query()
def ml12_boosted_learning_curve(spark, d):
    p = labelled(spark, d)
    t = p.where("city = 'target'")
    curve = learn.boosted_learning_curve(source_model(p), t.where("id % 10 <> 0"), t.where("id % 10 = 0"), [0.5, 1.0], 1, depth=2)
    return rounded(evaluate.metrics(curve, ["fraction", "model"]))
