"""Queries: sources and sinks written and read again, name contracts, guards and decision rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.functions import columns
from geotally.functions.folders import shared_folder
from geotally.operators import decide, evaluate, series, spatial, validate
from geotally.plans.bindings import BASES, MONTHS, PTS, SER, WID, WIDE, R, cells, cells_sql, points, rounded, table, wide
from geotally.plans.registry import query
from geotally.sources import io


def folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def contract(spark, d) -> DataFrame:
    """The points with every column that a split must have; f01 is NaN in some rows."""
    i = F.col("id")
    return points(spark, d).select(
        i.cast("string").alias("tree_id"), "city", (i % 10).cast("string").alias("block_id"), F.col("cls").alias("genus_latin"), F.concat(F.lit("de_"), "cls").alias("genus_german"), F.lower("cls").alias("species_latin"), F.lit(None).cast("string").alias("species_german"),
        F.when(i % 2 == 0, "street").otherwise("park").alias("tree_type"), "plant_year", (i % 6 == 0).alias("position_corrected"), (i % 6 / 2).alias("correction_distance"), (F.col("label") < 3).alias("is_conifer"),
        (i % 17 == 0).alias("outlier_zscore"), (i % 19 == 0).alias("outlier_mahalanobis"), (i % 23 == 0).alias("outlier_iqr"), F.when(i % 17 == 0, "high").otherwise("none").alias("outlier_severity"), (i % 3).cast("int").alias("outlier_method_count"),
        "CHM_1m", F.when(i % 7 == 0, F.lit(float("nan"))).otherwise(F.col("f01")).alias("f01"), F.col("f02"), "x", "y", F.col("CHM_1m").alias("height_m"), F.when(i % 3 == 0, "filtered").otherwise("plain").alias("variant"), F.lit("reduced").alias("feature_set"), F.when(i % 4 == 0, "val").otherwise("train").alias("split"),
    )


F01 = f"CASE WHEN id % 7 <> 0 THEN {R('f01')} END AS f01"


@query(f"WITH {PTS} SELECT CAST(id AS VARCHAR) AS tree_id, city, cls AS genus_latin, {F01} FROM pts")
def io1_read_points(spark, d):
    contract(spark, d).write.parquet(path := folder(spark))
    return rounded(io.read_points(spark, path).select("tree_id", "city", "genus_latin", "f01"))


@query(f"WITH {PTS} SELECT CAST(id AS VARCHAR) AS tree_id, city, CASE WHEN id % 4 = 0 THEN 'val' ELSE 'train' END AS split, {F01} FROM pts WHERE city = 'source' AND id % 3 <> 0")
def io2_read_splits(spark, d):
    io.write_splits(contract(spark, d), path := folder(spark))
    found = io.read_splits(spark, path, "source", ("train", "val"))
    return rounded(found["train"].unionByName(found["val"]).select("tree_id", "city", "split", "f01"))


@query(f"WITH {PTS} SELECT city, count(*) AS n, 0 AS n_geometry, {R('avg(f02)')} AS f02 FROM pts GROUP BY city")
def io3_write_splits(spark, d):
    io.write_splits(contract(spark, d), path := folder(spark))
    back = spark.read.parquet(path)
    return rounded(back.groupBy("city").agg(F.count("*").alias("n"), F.lit(len({"x", "y", "height_m"} & set(back.columns))).alias("n_geometry"), F.avg("f02").alias("f02")))


@query(f"WITH {PTS} SELECT city, CASE WHEN id % 3 = 0 THEN 'filtered' ELSE 'plain' END AS variant, CASE WHEN id % 4 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM pts GROUP BY ALL")
def io3_two_cities(spark, d):
    """City after city and variant after variant in one place; the first city is written twice."""
    c, path = contract(spark, d), folder(spark)
    for city, variant in (("source", "plain"), ("target", "plain"), ("target", "filtered"), ("source", "filtered"), ("source", "plain")):
        io.write_splits(c.where((F.col("city") == city) & (F.col("variant") == variant)), path)
    return spark.read.parquet(path).groupBy("city", "variant", "split").agg(F.count("*").alias("n"))


@query(f"WITH {cells_sql('c')} SELECT 'A' AS city, col - (SELECT min(col) FROM c WHERE city = 'A') AS col, (SELECT max(row) FROM c WHERE city = 'A') - row AS row, round(value, 3) + 0.0 AS value FROM c WHERE city = 'A'")
def io5_read_xyz(spark, d):
    lines = cells(spark, d).where("city = 'A'").select(F.concat_ws(" ", F.col("col") + 4000, F.col("row") + 5000, F.round("value", 3)).alias("value"))
    lines.write.text(path := folder(spark))
    return rounded(io.read_xyz_cells(spark, path, "A"), 3)


@query(f"WITH {PTS} SELECT city, cls, count(*) AS n FROM pts GROUP BY city, cls")
def io7_report_records(spark, d):
    io.export_report_records(points(spark, d).groupBy("city", "cls").agg(F.count("*").alias("n")), path := folder(spark))
    return spark.read.json(path).select("city", "cls", "n")


@query(f"WITH {PTS} SELECT CAST(id AS VARCHAR) AS tree_id FROM pts WHERE city = 'source' AND id % 3 = 0 AND id % 4 <> 0")
def io8_split_by_strategy(spark, d):
    io.write_splits(contract(spark, d), path := folder(spark))
    return io.read_split_by_strategy(spark, path, "source", "train", "filtered").select("tree_id")


@query(
    f"WITH {PTS} SELECT id % 10 AS block_id, city, (id % 6) / 2 AS correction_distance, 'de_' || cls AS genus_german, cls AS genus_latin, label < 3 AS is_conifer, id % 23 = 0 AS outlier_iqr, id % 19 = 0 AS outlier_mahalanobis, CAST(id % 3 AS INTEGER) AS outlier_method_count, "
    "CASE WHEN id % 17 = 0 THEN 'high' ELSE 'none' END AS outlier_severity, id % 17 = 0 AS outlier_zscore, CAST(plant_year AS DOUBLE) AS plant_year, id % 6 = 0 AS position_corrected, NULL AS species_german, lower(cls) AS species_latin, CAST(id AS VARCHAR) AS tree_id, CASE WHEN id % 2 = 0 THEN 'street' ELSE 'park' END AS tree_type FROM pts"
)
def pr10_metadata_columns(spark, d):
    c = contract(spark, d)
    return c.select(*columns.metadata_columns(c)).withColumns({"plant_year": F.col("plant_year").cast("double"), "block_id": F.col("block_id").cast("long")})


@query(f"WITH {PTS} SELECT {R('CHM_1m')} AS CHM_1m, {F01}, {R('f02')} AS f02 FROM pts")
def pr11_feature_columns(spark, d):
    c = columns.null_nan(contract(spark, d)).drop("variant", "feature_set", "split")
    return rounded(c.select(*columns.feature_columns(c, height=["CHM_1m"])))


@query(f"WITH {WID} SELECT id, {', '.join(f'{R(c)} AS {c}' for c in WIDE if c.endswith(('_03', '_04')))} FROM wid")
def pr13_temporal_columns(spark, d):
    w = wide(spark, d)
    return rounded(w.select("id", *(c for some in columns.temporal_columns(w, [3, 4]).values() for c in some)))


@query(f"WITH {WID} SELECT id, {', '.join(f'{R(f'{b}_{m:02d}')} AS {b}_{m:02d}' for m in MONTHS[:2] for b in BASES[:2])} FROM wid")
def pr14_feature_names(spark, d):
    return rounded(wide(spark, d).select("id", *columns.feature_names(BASES[:2], MONTHS[:2])))


@query(f"WITH {WID} SELECT id, {R('click_07')} AS click, {R('view_07')} AS view, {R('CHM_1m')} AS height FROM wid")
def pr19_feature_alias(spark, d):
    w = wide(spark, d)
    return rounded(w.select("id", F.col(columns.resolve(w, "click")).alias("click"), F.col(columns.resolve(w, "view")).alias("view"), F.col(columns.resolve(w, "CHM_1m")).alias("height")))


METRICS = "SELECT p_brand AS feature, avg(p_size) / 50 AS importance, avg(p_retailprice) / 20000 AS gap_increase, (avg(p_retailprice) - 1400) / 5000 AS f1_improvement, 1 - count(*) / 60.0 AS sample_loss, count(*) AS n_rows, avg(p_retailprice) / 2000 AS val_f1 FROM part GROUP BY p_brand"


def ablation(spark, d) -> DataFrame:
    price, n = F.avg("p_retailprice"), F.count("*")
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.avg("p_size") / 50).alias("importance"), (price / 20000).alias("gap_increase"), ((price - 1400) / 5000).alias("f1_improvement"), (1 - n / 60.0).alias("sample_loss"), n.alias("n_rows"), (price / 2000).alias("val_f1"))


@query(f"WITH m AS ({METRICS}) SELECT feature, CASE WHEN importance > 0.52 OR gap_increase > 0.07 OR f1_improvement < 0 THEN 'exclude' ELSE 'include' END AS decision, CASE WHEN importance > 0.52 THEN 'importance > 0.52' WHEN gap_increase > 0.07 THEN 'gap_increase > 0.07' WHEN f1_improvement < 0 THEN 'f1_improvement < 0' ELSE 'no rule' END AS reason FROM m")
def fl11_height_rules(spark, d):
    return decide.height_decisions(ablation(spark, d), 0.52, 0.07, 0).select("feature", "decision", "reason")


@query(f"WITH m AS ({METRICS}) SELECT feature, CASE WHEN sample_loss > 0.4 OR f1_improvement < 0.001 THEN 'baseline' ELSE 'filtered' END AS decision, CASE WHEN sample_loss > 0.4 THEN 'sample_loss > 0.4' WHEN f1_improvement < 0.001 THEN 'f1_improvement < 0.001' ELSE 'no rule' END AS reason FROM m")
def fl11_proximity_rules(spark, d):
    return decide.proximity_decisions(ablation(spark, d), 0.4, 0.001).select("feature", "decision", "reason")


@query(
    f"WITH m AS ({METRICS}), b AS (SELECT * FROM m WHERE feature = (SELECT min(p_brand) FROM part)), e AS (SELECT m.feature AS variant, m.n_rows, m.val_f1, 1 - m.n_rows / b.n_rows AS sample_loss, m.val_f1 - b.val_f1 AS f1_improvement, m.feature = b.feature AS base FROM m, b), "
    "p AS (SELECT *, NOT base AND sample_loss <= 0.3 AND f1_improvement >= 0.001 AND f1_improvement > 0 AS ok FROM e) "
    f"SELECT variant, n_rows, {R('val_f1')} AS val_f1, {R('sample_loss')} AS sample_loss, {R('f1_improvement')} AS f1_improvement, row_number() OVER (ORDER BY CASE WHEN ok THEN 0 WHEN base THEN 1 ELSE 2 END, val_f1 DESC, variant) = 1 AS chosen FROM p"
)
def fl11_outlier_rules(spark, d):
    results, first = ablation(spark, d).select(F.col("feature").alias("variant"), "n_rows", "val_f1"), table(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return rounded(decide.outlier_decisions(results, 0.3, 0.001, first))


@query(f"WITH {WID} SELECT id, {', '.join(f'{R(f'coalesce({c}, 0)')} AS {c}' for c in WIDE[:6])} FROM wid")
def ts3_guards(spark, d):
    filled = wide(spark, d).fillna(0.0, WIDE)
    return rounded(series.assert_interior_filled(series.assert_no_nulls(filled, WIDE), MONTHS).select("id", *WIDE[:6]))


@query(f"WITH {PTS} SELECT count(*) AS n, 'genus_latin' AS missing, 'cls' AS extra, 'label' AS wrong, false AS valid FROM pts")
def va1_validate_schema(spark, d):
    p = points(spark, d).select("id", "cls", "label")
    found = validate.validate_schema(p, {"id": dict(p.dtypes)["id"], "label": "double", "genus_latin": "string"})
    return p.agg(F.count("*").alias("n"), *(F.lit(",".join(found[k])).alias(k) for k in ("missing", "extra", "wrong")), F.lit(found["valid"]).alias("valid"))


@query(f"WITH {PTS} SELECT city, count(*) AS n FROM pts GROUP BY city")
def va4_phase_schema(spark, d):
    return validate.validate_phase_schema(contract(spark, d), "c").groupBy("city").agg(F.count("*").alias("n"))


@query()
def sp14_morans_i_pvalue(spark, d):
    """A smooth field of the points' places: I near 1, the smallest p-value that so many permutations allow."""
    r = spatial.morans_i_pvalue(points(spark, d).withColumn("v", F.col("x") + F.col("y") / 2), "v", 60.0, 19)
    return spark.createDataFrame([(r["morans_i"], r["pvalue"], r["permutations"])], "morans_i double, pvalue double, permutations int")


@query()
def st7_cohens_d_ci(spark, d):
    r = evaluate.cohens_d_ci(points(spark, d), "f01", "city", "source", "target", "id", 100)
    return spark.createDataFrame([(r["low"], r["high"])], "low double, high double")
