"""Time series per entity: profiles, gap filters, interpolation, guards and the cleaning pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotally.functions.columns import MONTHLY, monthly_name, null_nan
from geotally.operators import prep, stats


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n_missing, pct_missing; most missing first. One pass."""
    counts = df.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = counts.unpivot(["__n"], columns, "feature", "n_missing")
    return rows.select("feature", "n_missing", (F.col("n_missing") * 100.0 / F.col("__n")).alias("pct_missing")).orderBy(F.desc("n_missing"), "feature")


def bases_of(columns: list[str], months: list[int]) -> dict[str, list[str]]:
    """base -> its columns of these months, in order."""
    found: dict[str, list[str]] = {}
    for m in sorted(months):
        for c in columns:
            if (k := MONTHLY.match(c)) and int(k[2]) == m:
                found.setdefault(k[1], []).append(c)
    return found


def _valid(v: Column) -> Column:
    return F.filter(F.transform(v, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())


def filter_gappy_series(df: DataFrame, months: list[int], max_missing: int = 2, max_edge: int = 1, least: int = 2) -> DataFrame:
    """Rows in which every base has few missing values, short missing edges and enough values. No shuffle: arrays in the row."""
    ok = F.lit(True)
    for columns in bases_of(df.columns, months).values():
        places = _valid(F.array(*columns))
        n, k = len(columns), F.size(places)
        edge = F.greatest(F.array_min(places), n - 1 - F.array_max(places))
        ok = ok & (k >= max(n - max_missing, least)) & (F.coalesce(edge, F.lit(n)) <= max_edge)
    return df.where(ok)


def interpolate_within_entity(df: DataFrame, months: list[int], max_edge: int = 1) -> DataFrame:
    """Inner gaps linear by position; edge runs of at most max_edge take the nearest value. Only a row's own values matter."""
    bases = bases_of(df.columns, months)
    values, places, filled = ({b: f"__{n}_{b}" for b in bases} for n in ("v", "at", "f"))
    arrays = df.select("*", *(F.array(*c).alias(values[b]) for b, c in bases.items()), *(_valid(F.array(*c)).alias(places[b]) for b, c in bases.items()))
    done = arrays.select("*", *(_filled(values[b], places[b], len(c), max_edge).alias(filled[b]) for b, c in bases.items()))
    new = {c: F.get(filled[b], F.lit(i)) for b, columns in bases.items() for i, c in enumerate(columns)}
    return done.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def _filled(values: str, places: str, n: int, max_edge: int) -> Column:
    """The array of values with its gaps filled; places: where it has values."""
    at, v = F.col(places), F.col(values)
    leading, trailing = F.array_min(at) <= max_edge, n - 1 - F.array_max(at) <= max_edge

    def fill(x: Column, i: Column) -> Column:
        left, right = F.array_max(F.filter(at, lambda j: j < i)), F.array_min(F.filter(at, lambda j: j > i))
        before, after = F.get(v, left), F.get(v, right)
        inner = before + (after - before) * (i - left) / (right - left)
        return F.when(x.isNotNull(), x).when(left.isNotNull() & right.isNotNull(), inner).when(left.isNull() & leading, after).when(right.isNull() & trailing, before)

    return F.transform(v, fill)


def assert_no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; an error with the counts if any column has a NULL. One pass."""
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    bad = {c: row[c] for c in columns if row[c]}
    if bad:
        raise ValueError(f"NULLs remain: {bad}")
    return df


def assert_interior_filled(df: DataFrame, months: list[int]) -> DataFrame:
    """df; an error if a base has a NULL between two values."""
    checks = {}
    for base, columns in bases_of(df.columns, months).items():
        places = _valid(F.array(*columns))
        checks[base] = F.count_if((F.size(places) > 0) & (F.array_max(places) - F.array_min(places) + 1 != F.size(places)))
    row = df.agg(*(c.alias(b) for b, c in checks.items())).first()
    bad = {b: row[b] for b in checks if row[b]}
    if bad:
        raise ValueError(f"inner gaps remain: {bad}")
    return df


def quality_pipeline(df: DataFrame, months: list[int], bases: list[str], metadata: list[str], plausible: str, cls: str, city: str = "city", value: str = "CHM_1m", least_value: float = 0.3, max_missing: int = 2, max_edge: int = 1, least_group: int = 10) -> DataFrame:
    """Months, gap filter, interpolation, group z-score and percentile, plausibility. The cleaning is run once and written."""
    clean = prep.select_months(null_nan(df), months, bases, metadata)
    clean = interpolate_within_entity(filter_gappy_series(clean, months, max_missing, max_edge), months, max_edge)
    scored = stats.group_scores_with_fallback(clean, value, cls, city, least_group)
    return prep.filter_plausible_max(scored, [monthly_name(plausible, m) for m in months], least_value)


def completeness(df: DataFrame, columns: list[str], corrected: str | None = None) -> DataFrame:
    """feature, completeness (1 - share of NULLs), and n_rows, n_corrected of the table. One pass."""
    flag = F.count_if(corrected).alias("n_corrected") if corrected else F.lit(0).cast("long").alias("n_corrected")
    one = df.agg(F.count("*").alias("n_rows"), flag, *(F.count(c).cast("double").alias(c) for c in columns))
    return one.unpivot(["n_rows", "n_corrected"], columns, "feature", "k").select("feature", (F.col("k") / F.col("n_rows")).alias("completeness"), "n_rows", "n_corrected")
