"""Validation of schemas and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.functions.columns import OUTLIER


def validate_schema(df: DataFrame, expected: dict[str, str]) -> dict:
    """missing and extra columns and differing types; valid ignores extra ones."""
    have = dict(df.dtypes)
    missing = sorted(set(expected) - set(have))
    wrong = {c: (t, have[c]) for c, t in expected.items() if c in have and have[c] != t}
    return {"missing": missing, "extra": sorted(set(have) - set(expected)), "wrong": wrong, "valid": not missing and not wrong}


def null_geometry(df: DataFrame) -> DataFrame:
    missing = F.col("x").isNull() | F.col("y").isNull()
    return df.agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing"))


def validate_crs(found: str | None, expected: str = "EPSG:25833") -> bool:
    return found == expected


def validate_dataset(name: str, df: DataFrame, expected: dict[str, str], crs: str | None = "EPSG:25833") -> DataFrame:
    """One row: dataset, n, n_missing, schema_valid, crs_valid, valid."""
    schema, ok = validate_schema(df, expected)["valid"], validate_crs(crs)
    return null_geometry(df).select(F.lit(name).alias("dataset"), "n", "n_missing", F.lit(schema).alias("schema_valid"), F.lit(ok).alias("crs_valid"), (F.lit(schema and ok) & (F.col("n_missing") == 0)).alias("valid"))


def report(results: list[DataFrame]) -> DataFrame:
    """Counts over validate_dataset() rows."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    return every.agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"), F.bool_and("valid").alias("all_valid"))


#: The columns that each phase must deliver.
PHASES = {"a": ("tree_id", "city", "genus_latin", "x", "y", "CHM_1m"), "b": ("tree_id", "city", "genus_latin", "x", "y", "CHM_1m", "CHM_1m_zscore", "CHM_1m_percentile"), "c": ("tree_id", "city", "genus_latin", "block_id", *OUTLIER)}


def validate_phase_schema(df: DataFrame, phase: str) -> DataFrame:
    """df; missing columns or an empty table are an error."""
    missing = sorted(set(PHASES[phase]) - set(df.columns))
    if missing:
        raise ValueError(f"phase {phase}: missing {missing}")
    if df.isEmpty():
        raise ValueError(f"phase {phase}: the table is empty")
    return df
