"""Learning operators on Spark ML, and what prepares and judges them."""

from __future__ import annotations

import itertools
import random
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotally.functions.folders import checkpointed
from geotally.operators import boost, evaluate, prep, splits

#: Folds that are fitted at the same time.
SIDE_BY_SIDE = 4


def scale_table(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """feature -> mean and standard deviation (ddof 0; 1 without spread), of the training rows alone."""
    r = train.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (r[f"m_{c}"] or 0.0, r[f"s_{c}"] or 1.0) for c in features}


def standard_scale(df: DataFrame, table: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*(((F.col(c) - table[c][0]) / table[c][1]).alias(c) if c in table else F.col(c) for c in df.columns))


def balanced_weights(df: DataFrame, cls: str, out: str = "weight") -> DataFrame:
    """df with n / (k n_c) per row. The weights are a row a class, and written: while their size wasn't known, Spark could send df's rows to the driver to broadcast them instead."""
    by = df.groupBy(F.col(cls).alias("__c")).agg(F.count("*").alias("__n"))
    every = Window.partitionBy()
    weights = checkpointed(by.select("__c", (F.sum("__n").over(every) / (F.count(F.lit(1)).over(every) * F.col("__n"))).alias(out)))
    return df.join(weights, df[cls].eqNullSafe(weights["__c"])).drop("__c")


def prepare_training_data(train: DataFrame, others: dict[str, DataFrame], features: list[str], cls: str) -> tuple[dict[str, DataFrame], DataFrame, dict]:
    """Scaled, encoded frames with a vector; the label table and the scaling, both fitted on train."""
    table, labels = scale_table(train, features), prep.label_table(train, cls, "label")
    assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    frames = {k: assemble.transform(standard_scale(prep.encode_labels(d, cls, "label", labels), table)) for k, d in {"train": train, **others}.items()}
    return frames, labels, table


def majority_baseline(train: DataFrame, cls: str) -> DataFrame:
    """The most frequent class, the smallest on ties: one row."""
    by = train.groupBy(cls).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), cls).limit(1)


def random_baseline(df: DataFrame, train: DataFrame, cls: str, key: str, seed: int = 42, out: str = "y_pred") -> DataFrame:
    """df with a class drawn by the training shares, by hash of the key. The shares are a row a class."""
    by = train.groupBy(cls).agg(F.count("*").alias("n"))
    rows = by.orderBy(cls).collect()
    total, up, cuts = sum(r["n"] for r in rows), 0, []
    for r in rows:
        up += r["n"]
        cuts.append((up / total, r[cls]))
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40)
    return df.withColumn(out, F.coalesce(*(F.when(u < c, F.lit(v)) for c, v in cuts), F.lit(cuts[-1][1])))


def forest(features: list[str], seed: int = 42, **params) -> Pipeline:
    params = {"numTrees": 50, "maxDepth": 10, "minInstancesPerNode": 5, "weightCol": "weight"} | params
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), RandomForestClassifier(labelCol="label", featuresCol="features", seed=seed, **params)])


def coordinates_forest(seed: int = 42, **params) -> Pipeline:
    """The baseline that sees the place alone."""
    return forest(["x", "y"], seed, **params)


def boosted(features: list[str], seed: int = 42, rounds: int = 20, depth: int = 4) -> Pipeline:
    one = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), OneVsRest(classifier=one, labelCol="label", featuresCol="features", weightCol="weight")])


def neural(features: list[str], k: int, hidden: int = 32, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), MultilayerPerceptronClassifier(labelCol="label", featuresCol="features", layers=[len(features), hidden, k], seed=seed, maxIter=60)])


def stacked(source_model: PipelineModel, target: DataFrame, features: list[str], k: int, seed: int = 42, **params) -> tuple[PipelineModel, list[str]]:
    """Fine-tuning: a target model that also sees the source model's class scores (columns s0..)."""
    scored, names = source_scores(source_model, target, k)
    return forest([*features, *names], seed, **params).fit(scored), names


def source_scores(model: PipelineModel, df: DataFrame, k: int) -> tuple[DataFrame, list[str]]:
    out = model.transform(df)
    score = vector_to_array("probability" if "probability" in out.columns else "rawPrediction")
    names = [f"s{i}" for i in range(k)]
    return out.select(*df.columns, *(F.coalesce(F.get(score, F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(names))), names


def predictions(model: PipelineModel, df: DataFrame, key: str = "id") -> DataFrame:
    return model.transform(df).select(key, F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


def cross_validate_blocks(df: DataFrame, pipeline: Pipeline, fold: str = "fold") -> dict:
    """Weighted F1 of each fold held out in turn, on it and on the rest: mean, std (ddof 0), gap. Predictions of all folds are judged in one job."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # a few
    with ThreadPool(min(len(folds), SIDE_BY_SIDE)) as pool:  # fits of small jobs leave room for each other
        models = pool.map(inheritable_thread_target(df.sparkSession)(lambda k: pipeline.fit(df.where(F.col(fold) != k))), folds)
    held = [m.transform(df).select(F.lit(k).alias("k"), (F.col(fold) == k).alias("held"), F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred")) for k, m in zip(folds, models, strict=True)]
    both = reduce(DataFrame.unionByName, held)
    rows = evaluate.metrics(both, ["k", "held"]).select("k", "held", "f1").collect()
    val, train = ([r["f1"] for r in rows if r["held"] == h] for h in (True, False))
    mean = sum(val) / len(val)
    return {"val_f1_mean": mean, "val_f1_std": (sum((v - mean) ** 2 for v in val) / len(val)) ** 0.5, "train_f1_mean": sum(train) / len(train), "gap": sum(train) / len(train) - mean}


def feature_importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """(feature, importance, rank), the most important first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(features, map(float, values), strict=True), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)], "feature string, importance double, rank int")


def feature_subsets(importance: DataFrame, sizes: list[int]) -> dict[str, list[str]]:
    names = [r[0] for r in importance.orderBy("rank").select("feature").collect()]  # features
    return {f"top_{n}": names[:n] for n in sizes if n < len(names)} | {"all": names}


def optimal_size(results: DataFrame, most_drop: float = 0.01) -> DataFrame:
    """The smallest n_features whose f1 is at least the best minus most_drop. results: (n_features, f1), a row a subset."""
    best = results.agg(F.max("f1").alias("__best"))
    return results.join(F.broadcast(best)).where(F.col("f1") >= F.col("__best") - most_drop).orderBy("n_features").limit(1).drop("__best")  # one row


def evaluate_variants(variants: dict[str, DataFrame], pipeline: Pipeline, spark) -> DataFrame:
    """(variant, n_rows, val_f1, gap) of each, by cross_validate_blocks()."""
    rows = []
    for name, d in variants.items():
        cv = cross_validate_blocks(d, pipeline)
        rows.append((name, d.count(), cv["val_f1_mean"], cv["gap"]))
    return spark.createDataFrame(rows, "variant string, n_rows long, val_f1 double, gap double")


def choose_variant(results: DataFrame, baseline: str, min_improvement: float = 0.01, max_loss: float = 0.2, max_gap: float = 0.05) -> DataFrame:
    """results with a decision: adopt where it improves on the baseline enough, loses few rows and widens the gap little."""
    base = results.where(F.col("variant") == baseline).select(*(F.col(c).alias(f"b_{c}") for c in ("n_rows", "val_f1", "gap"))).limit(1)
    both = results.join(F.broadcast(base))  # one row
    rules = [(f"variant = '{baseline}'", "baseline"), (f"val_f1 - b_val_f1 < {min_improvement}", "reject: improvement"), (f"1 - n_rows / b_n_rows > {max_loss}", "reject: rows lost"), (f"gap - b_gap > {max_gap}", "reject: gap")]
    return prep.rule_table(both, rules, "adopt").select("variant", "n_rows", "val_f1", "gap", "decision")


def champion(results: DataFrame, least: float = 0.5, most_gap: float = 0.35) -> DataFrame:
    return results.where((F.col("val_f1") >= least) & (F.col("gap") < most_gap)).orderBy(F.desc("val_f1"), "variant").limit(1)


def param_candidates(space: dict[str, list], n: int | None = None, seed: int = 42) -> list[dict]:
    """All combinations, or n drawn ones: a list of two numbers is then a range, other lists are choices; scalars are constants."""
    if n is None:
        keys = list(space)
        return [dict(zip(keys, v, strict=True)) for v in itertools.product(*(v if isinstance(v, list) else [v] for v in space.values()))]
    draw, out = random.Random(seed), []
    for _ in range(n):
        row = {}
        for k, v in space.items():
            if isinstance(v, list) and len(v) == 2 and all(isinstance(x, int) and not isinstance(x, bool) for x in v):
                row[k] = draw.randint(*v)
            elif isinstance(v, list) and len(v) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
                row[k] = draw.uniform(*v)
            else:
                row[k] = draw.choice(v) if isinstance(v, list) else v
        out.append(row)
    return out


def param_search(df: DataFrame, make, space: dict[str, list], n: int | None = None, seed: int = 42) -> tuple[dict, float]:
    """The first best candidate by blocked cross validation. make(params) gives a pipeline."""
    scored = [(p, cross_validate_blocks(df, make(p))["val_f1_mean"]) for p in param_candidates(space, n, seed)]
    return max(scored, key=lambda s: s[1])


def learning_curve(source_model: PipelineModel, pool: DataFrame, test: DataFrame, features: list[str], k: int, fractions: list[float], cls: str = "label", key: str = "id", seed: int = 42, **params) -> DataFrame:
    """(fraction, model, key, y_true, y_pred) of fine-tuned and from-scratch models on one fixed test set: a table that evaluate.metrics() judges in one job."""
    nested, out = splits.stratified_fractions(pool, cls, fractions, key, seed), None
    scored_test, names = source_scores(source_model, test, k)
    for f in fractions:
        part = balanced_weights(nested.where(F.col("min_fraction") <= f).drop("min_fraction", "weight"), cls)
        tuned, _ = stacked(source_model, part, features, k, seed, **params)
        for name, p in (("finetuned", predictions(tuned, scored_test, key)), ("scratch", predictions(forest(features, seed, **params).fit(part), test, key))):
            p = p.select(F.lit(f).alias("fraction"), F.lit(name).alias("model"), "*")
            out = p if out is None else out.unionByName(p)
    return out


def boosted_learning_curve(source: boost.Boosted, pool: DataFrame, test: DataFrame, fractions: list[float], rounds: int, cls: str = "label", key: str = "id", seed: int = 42, **params) -> DataFrame:
    """(fraction, model, key, y_true, y_pred) on one fixed test set: of the source model with rounds added on each subset of the pool, of models fitted on the subset alone, and of the source model itself (fraction 0)."""
    nested = splits.stratified_fractions(pool, cls, fractions, key, seed)

    def judged(model: boost.Boosted, fraction: float, name: str) -> DataFrame:
        return boost.classified(test, model, "y_pred").select(F.lit(fraction).alias("fraction"), F.lit(name).alias("model"), key, F.col(cls).cast("int").alias("y_true"), "y_pred")

    out = judged(source, 0.0, "source")
    for f in fractions:
        part = balanced_weights(nested.where(F.col("min_fraction") <= f).drop("min_fraction", "weight"), cls)
        tuned = boost.fit(part, source.features, source.classes, cls, "weight", rounds, start=source, **params)
        scratch = boost.fit(part, source.features, source.classes, cls, "weight", rounds, **params)
        out = out.unionByName(judged(tuned, f, "finetuned")).unionByName(judged(scratch, f, "scratch"))
    return out
