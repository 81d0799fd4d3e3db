"""Names and small column expressions that the operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The form of monthly names, metadata columns of the point table beside ids and outlier columns, outlier and height columns.
MONTHLY = re.compile(r"^(.+)_([0-1][0-9])$")
METADATA = ("city", "genus_latin", "genus_german", "species_latin", "species_german", "tree_type", "plant_year", "correction_distance", "position_corrected", "is_conifer")
OUTLIER = ("outlier_zscore", "outlier_mahalanobis", "outlier_iqr", "outlier_severity", "outlier_method_count")
HEIGHT = ("CHM_1m", "CHM_1m_zscore", "CHM_1m_percentile")


def null_nan(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL, in one select: Spark's aggregates skip only NULL."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def slug(c: Column | str) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def monthly_name(base: str, month: int) -> str:
    return f"{base}_{month:02d}"


def feature_names(bases: list[str], months: list[int]) -> list[str]:
    """Names {base}_{MM}, month by month."""
    return [monthly_name(b, m) for m in months for b in bases]


def temporal_columns(df: DataFrame, months: list[int] | None = None) -> dict[int, list[str]]:
    """month -> its columns. A wanted month without columns is an error."""
    found: dict[int, list[str]] = {}
    for c in df.columns:
        m = MONTHLY.match(c)
        if m and 1 <= int(m[2]) <= 12:
            found.setdefault(int(m[2]), []).append(c)
    missing = [m for m in months or () if m not in found]
    if missing:
        raise ValueError(f"no columns for months {missing}")
    return {m: found[m] for m in sorted(found) if months is None or m in months}


def same_temporal_columns(frames: dict[str, DataFrame]) -> dict[int, list[str]]:
    """temporal_columns() that all cities agree on; else an error."""
    found = {k: temporal_columns(f) for k, f in frames.items()}
    first = next(iter(found.values()))
    if any({m: sorted(c) for m, c in x.items()} != {m: sorted(c) for m, c in first.items()} for x in found.values()):
        raise ValueError("cities differ in their monthly columns")
    return first


def resolve(df: DataFrame, name: str) -> str:
    """A column of this name, or of this base in July, or in its first month."""
    if name in df.columns:
        return name
    if monthly_name(name, 7) in df.columns:
        return monthly_name(name, 7)
    months = sorted(c for c in df.columns if (m := MONTHLY.match(c)) and m[1] == name)
    if not months:
        raise ValueError(f"no column for {name}")
    return months[0]


def metadata_columns(df: DataFrame) -> list[str]:
    """Ids, the label and what else describes a row without being a feature."""
    return sorted({c for c in df.columns if c.endswith("_id") or c in METADATA or c.startswith("outlier_")})


def feature_columns(df: DataFrame, target: str = "genus_latin", height: list[str] | None = None, expected: list[str] | None = None) -> list[str]:
    """Features: neither id, target, metadata, outlier column nor place. height: the height columns to take (None: those there are; empty:
    none); expected: exactly these, in order. Unknown or absent height columns and absent expected ones are errors."""
    other = {target, *metadata_columns(df), "x", "y", "height_m"}
    every = [c for c in df.columns if c not in other]
    if unknown := [c for c in height or () if c not in HEIGHT]:
        raise ValueError(f"not height features: {unknown}")
    if missing := [c for c in (height if expected is None else expected) or () if c not in every]:
        raise ValueError(f"missing features {missing}")
    if expected is not None:
        return list(expected)
    return sorted(c for c in every if c not in HEIGHT or height is None or c in height)
