"""Sources and sinks: splits as one partitioned dataset, raw layers, XYZ text, report records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.functions.columns import METADATA, OUTLIER, null_nan
from geotally.operators.prep import union_layers

REQUIRED = ("tree_id", "block_id", *METADATA, *OUTLIER)
PARTITIONS = ("variant", "feature_set", "city", "split")


def read_points(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A point table with NaN as NULL; missing required columns are an error that lists them."""
    df = spark.read.parquet(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return null_nan(df)


def write_splits(df: DataFrame, path: str) -> None:
    """One snappy dataset partitioned by variant, feature_set, city and split, without geometry and height_m. An empty table is an error.

    Only the partitions that df has are replaced, all in one commit: other cities, variants and feature sets written before stay as they are.
    """
    if df.isEmpty():
        raise ValueError("an empty split can't be written")
    df.drop("x", "y", "height_m").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*PARTITIONS).parquet(path)


def read_splits(spark: SparkSession, path: str, city: str, splits: tuple[str, ...], variant: str = "", feature_set: str = "reduced") -> dict[str, DataFrame]:
    """split -> its rows; only the partitions asked for are read."""
    every = read_points(spark, path)
    mine = every.where((F.col("variant") == (variant or "plain")) & (F.col("feature_set") == feature_set) & (F.col("city") == city))
    return {s: mine.where(F.col("split") == s) for s in splits}


def read_split_by_strategy(spark: SparkSession, path: str, city: str, split: str, strategy: str) -> DataFrame:
    variants = {"baseline": "plain", "filtered": "filtered"}
    if strategy not in variants:
        raise ValueError(f"unknown proximity strategy {strategy}")
    return read_splits(spark, path, city, (split,), variants[strategy])[split]


def geometry_lookup(df: DataFrame, split: str, variant: str, key: str = "tree_id", city: str = "city") -> DataFrame:
    """(key, city, split, filtered, x, y) of rows with a place; rows of several splits stay several."""
    return df.where("x is not null and y is not null").select(key, city, split, F.col(variant).endswith("_filtered").alias("filtered"), "x", "y")


def read_xyz_cells(spark: SparkSession, path: str, city: str, step: float = 1.0) -> DataFrame:
    """'X Y Z' lines as cells (city, col, row, value) counted from the least x and the largest y; the last line of a cell wins."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(*(F.get(part, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyz")), F.monotonically_increasing_id().alias("line")).where("x is not null and y is not null")
    box = lines.agg(F.min("x").alias("x0"), F.max("y").alias("y0"))
    cells = lines.join(F.broadcast(box)).select(F.round((F.col("x") - F.col("x0")) / step).cast("long").alias("col"), F.round((F.col("y0") - F.col("y")) / step).cast("long").alias("row"), "z", "line")  # one row
    return cells.groupBy(F.lit(city).alias("city"), "col", "row").agg(F.max_by("z", "line").alias("value"))


def read_raw_cadastre(spark: SparkSession, layers: dict[str, str]) -> DataFrame:
    """Raw layers (name -> path), tagged and joined; columns that a layer lacks are NULL there."""
    return union_layers({k: spark.read.parquet(p) for k, p in layers.items()})


def export_report_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
