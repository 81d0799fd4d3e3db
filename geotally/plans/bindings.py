"""The driver's tables as the library's schemas, in Spark and as SQL common table expressions of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = [f"f{i:02d}" for i in range(1, 13)]
BASES, MONTHS = ["click", "error", "purchase", "signup", "view"], list(range(1, 9))
WIDE = [f"{b}_{m:02d}" for m in MONTHS for b in BASES]
BANDS = ["B2", "B3", "B4", "B5", "B6", "B7", "B8", "B11", "B12"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    city = F.when(F.col("vec_id") % 5 == 0, "target").otherwise("source")
    year = F.when(F.col("vec_id") % 11 != 0, 1950 + F.col("vec_id") % 70).cast("int")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), city.alias("city"), F.concat(F.lit("G"), "label").alias("cls"), "label", year.alias("plant_year"), (e[0].cast("double") * 1000).alias("x"), (e[1].cast("double") * 1000).alias("y"),
        F.when(F.col("vec_id") % 13 != 0, 10 + 20 * e[2].cast("double")).alias("CHM_1m"), *(e[i + 3].cast("double").alias(f) for i, f in enumerate(FEATURES)),
    )


PTS = (
    "pts AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'target' ELSE 'source' END AS city, 'G' || label AS cls, label, CAST(CASE WHEN vec_id % 11 <> 0 THEN 1950 + vec_id % 70 END AS INTEGER) AS plant_year, "
    "CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, CASE WHEN vec_id % 13 <> 0 THEN 10 + 20 * CAST(embedding[3] AS DOUBLE) END AS CHM_1m, "
    + ", ".join(f"CAST(embedding[{i + 4}] AS DOUBLE) AS {f}" for i, f in enumerate(FEATURES))
    + " FROM embeddings)"
)


def series(spark: SparkSession, d: str) -> DataFrame:
    month = (1 + F.least(F.lit(7), F.floor((F.dayofmonth("ts") - 1) / 4))).cast("int")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("base"), month.alias("month")).agg(F.avg("value").alias("v"))


def entity(df: DataFrame) -> DataFrame:
    return df.withColumns({"city": F.when(F.col("id") % 2 == 0, "source").otherwise("target"), "cls": F.concat(F.lit("G"), (F.col("id") % 3).cast("string"))})


SER = "ser AS (SELECT user_id AS id, event_type AS base, CAST(1 + least(7, floor((day(ts) - 1) / 4)) AS INTEGER) AS month, avg(value) AS v FROM events GROUP BY ALL)"
ENTITY = "CASE WHEN id % 2 = 0 THEN 'source' ELSE 'target' END AS city, 'G' || CAST(id % 3 AS VARCHAR) AS cls"


def wide(spark: SparkSession, d: str) -> DataFrame:
    long = series(spark, d)
    cells = [F.max(F.when((F.col("base") == b) & (F.col("month") == m), F.col("v"))).alias(f"{b}_{m:02d}") for m in MONTHS for b in BASES]
    return entity(long.groupBy("id").agg(*cells, F.avg("v").alias("CHM_1m")))


WID = f"{SER}, wid AS (SELECT id, {', '.join(f'''max(CASE WHEN base = '{b}' AND month = {m} THEN v END) AS {b}_{m:02d}''' for m in MONTHS for b in BASES)}, avg(v) AS CHM_1m, {ENTITY} FROM ser GROUP BY id)"


def cells(spark: SparkSession, d: str, value: str = "avg(l_quantity)") -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("city"), (F.col("l_partkey") % 40).alias("col"), (F.col("l_suppkey") % 40).alias("row")).agg(F.expr(value).alias("value"))


def cells_sql(name: str, value: str = "avg(l_quantity)") -> str:
    return f"{name} AS (SELECT l_returnflag AS city, l_partkey % 40 AS col, l_suppkey % 40 AS row, {value} AS value FROM lineitem GROUP BY ALL)"


#: Bands as functions of a line item; the same text in both dialects.
BAND_SQL = {b: f"CAST({k} * l_quantity + l_extendedprice / {j} + {o} * l_discount * 1000 + l_tax * 100 AS DOUBLE)" for b, k, j, o in zip(BANDS, (11, 13, 17, 19, 23, 29, 31, 37, 41), (40, 41, 43, 47, 53, 59, 61, 67, 71), (1, 2, 3, 4, 5, 6, 7, 8, 9), strict=True)}


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("city"), (F.col("l_partkey") % 10).alias("col"), (F.col("l_suppkey") % 10).alias("row"), F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("scl"), *(F.expr(e).alias(b) for b, e in BAND_SQL.items()))


OBS = f"obs AS (SELECT l_returnflag AS city, l_partkey % 10 AS col, l_suppkey % 10 AS row, l_shipdate AS ts, l_linenumber AS scl, {', '.join(f'{e} AS {b}' for b, e in BAND_SQL.items())} FROM lineitem)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    i, y = F.col("id"), F.col("label")
    p = points(spark, d)
    return p.select("id", "city", "x", "y", y.alias("y_true"), F.when(i % 3 == 0, (y + i % 4) % 10).otherwise(y).cast("int").alias("y_pred"), F.when(i % 7 == 0, (y + 1) % 10).otherwise(y).cast("int").alias("y_other"), "plant_year", (i % 4).cast("int").alias("species"))


PRE = f"{PTS}, pre AS (SELECT id, city, x, y, label AS y_true, CAST(CASE WHEN id % 3 = 0 THEN (label + id % 4) % 10 ELSE label END AS INTEGER) AS y_pred, CAST(CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS y_other, plant_year, CAST(id % 4 AS INTEGER) AS species FROM pts)"


def R(e: str, n: int = 6) -> str:
    """e rounded, without a negative zero."""
    return f"round({e}, {n}) + 0.0"


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
