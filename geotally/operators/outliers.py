"""Outlier flags, their consensus and their sensitivity. No operator removes rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.operators import stats


def outlier_zscore(df: DataFrame, features: list[str], city: str = "city", threshold: float = 3.0, least: int = 10, out: str = "outlier_zscore") -> DataFrame:
    """Flag: at least so many features with abs(z) above the threshold, z (ddof 0) within the city. A count column beside it."""
    by = df.groupBy(F.col(city).alias("__city")).agg(*(f(c).alias(f"__{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    joined = df.join(by, df[city].eqNullSafe(by["__city"]))
    many = sum((F.when((F.col(f"__s_{c}") > 0) & (F.abs((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")) > threshold), 1).otherwise(0) for c in features), F.lit(0))
    return joined.select(*df.columns, many.alias("z_count"), (many >= least).alias(out))


def shrunk(cov: np.ndarray, n: int, fourth: float) -> np.ndarray:
    """Ledoit-Wolf shrinkage of a covariance towards its mean variance. fourth: sum of squared norms' squares of the centred rows."""
    p = len(cov)
    s = cov * (n - 1) / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, max(0.0, (fourth / n - (s**2).sum()) / (n * p)))
    return s if d2 == 0 else b2 / d2 * mu * np.eye(p) + (1 - b2 / d2) * s


def outlier_mahalanobis(df: DataFrame, features: list[str], cls: str, alpha: float = 0.001, least: int | None = None, out: str = "outlier_mahalanobis") -> DataFrame:
    """Flag and distance (mahalanobis_d2) of complete rows within their class: d2 above the chi-squared quantile.

    Classes under p + 2 (or least) rows aren't judged. Ill-conditioned covariances are shrunk, which takes a second pass over those classes alone.
    """
    p = len(features)
    rows = {r[cls]: stats.moments(r, p) for r in stats.gram(df.where(F.col(cls).isNotNull()), features, [cls]).where(F.col("n") >= (least or p + 2)).collect()}  # a row a class
    ill = {k: m for k, (_, m, c) in rows.items() if np.linalg.cond(c) > 1e10}
    if ill:
        means = df.sparkSession.createDataFrame([(k, [float(v) for v in m]) for k, m in ill.items()], f"`{cls}` {df.schema[cls].dataType.simpleString()}, __m array<double>")
        norm = sum(((F.col(f) - F.get("__m", F.lit(i))) ** 2 for i, f in enumerate(features)), F.lit(0.0))
        fourth = df.dropna(subset=features).join(means, cls).groupBy(cls).agg(F.sum(norm * norm).alias("q"))
        for r in fourth.collect():
            n, m, c = rows[r[cls]]
            rows[r[cls]] = n, m, shrunk(c, n, r["q"])
    table = {k: (m, np.linalg.pinv(c)) for k, (_, m, c) in rows.items()}
    shared = df.sparkSession.sparkContext.broadcast(table)  # a small matrix a class
    limit = float(df.sparkSession._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(p)).inverseCumulativeProbability(1 - alpha))

    @F.pandas_udf("double")
    def distance(key, *values):
        import pandas as pd

        x = np.stack([v.to_numpy(float) for v in values], 1)
        found = np.full(len(key), np.nan)
        for k in key.dropna().unique():
            if k in shared.value:
                m, inverse = shared.value[k]
                at = (key == k).to_numpy()
                d = x[at] - m
                found[at] = ((d @ inverse) * d).sum(axis=1)
        return pd.Series(found)

    d2 = F.nanvl(distance(F.col(cls), *(F.col(f).cast("double") for f in features)), F.lit(None).cast("double"))
    return df.withColumn("mahalanobis_d2", d2).withColumn(out, F.coalesce(F.col("mahalanobis_d2") > limit, F.lit(False)))


def outlier_iqr(df: DataFrame, value: str, keys: list[str], multiplier: float = 1.5, out: str = "outlier_iqr") -> DataFrame:
    """Flag outside [q1 - m iqr, q3 + m iqr] of the group; NULL values and groups with a NULL key: false."""
    q = stats.exact_quantiles(df, keys, value, [0.25, 0.75])
    iqr = F.col("__q")[1] - F.col("__q")[0]
    far = (F.col(value) < F.col("__q")[0] - multiplier * iqr) | (F.col(value) > F.col("__q")[1] + multiplier * iqr)
    return df.join(q, keys, "left").withColumn(out, F.coalesce(far, F.lit(False))).drop("__q").select(*df.columns, out)


def consensus(df: DataFrame, flags: list[str]) -> DataFrame:
    """outlier_method_count and outlier_severity (none, low, medium, high) from three flags."""
    n = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0))
    return df.withColumn("outlier_method_count", n).withColumn("outlier_severity", F.element_at(F.array(*map(F.lit, ("none", "low", "medium", "high"))), F.col("outlier_method_count") + 1))


def zscore_sensitivity(df: DataFrame, features: list[str], city: str, thresholds: list[float], counts: list[int]) -> DataFrame:
    """(threshold, min_count, flag_rate): z-scores once, all pairs of parameters in one aggregate."""
    by = df.groupBy(F.col(city).alias("__city")).agg(*(f(c).alias(f"__{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = df.join(by, df[city].eqNullSafe(by["__city"])).select(*(F.when(F.col(f"__s_{c}") > 0, F.abs((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}"))).alias(c) for c in features))
    over = z.select(*(sum((F.when(F.col(c) > t, 1).otherwise(0) for c in features), F.lit(0)).alias(f"t{i}") for i, t in enumerate(thresholds)))
    grid = [(i, t, n) for i, t in enumerate(thresholds) for n in counts]
    rates = over.agg(*(F.avg((F.col(f"t{i}") >= n).cast("int")).alias(f"r{k}") for k, (i, _, n) in enumerate(grid)))
    return rates.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(n).alias("min_count"), F.col(f"r{k}").alias("flag_rate")) for k, (_, t, n) in enumerate(grid)))))


def iqr_sensitivity(df: DataFrame, value: str, keys: list[str], multipliers: list[float]) -> DataFrame:
    """(multiplier, flag_rate): quartiles once."""
    q = stats.exact_quantiles(df, keys, value, [0.25, 0.75])
    iqr = F.col("__q")[1] - F.col("__q")[0]
    joined = df.join(q, keys, "left")
    flag = lambda m: F.coalesce((F.col(value) < F.col("__q")[0] - m * iqr) | (F.col(value) > F.col("__q")[1] + m * iqr), F.lit(False))
    rates = joined.agg(*(F.avg(flag(m).cast("int")).alias(f"r{i}") for i, m in enumerate(multipliers)))
    return rates.select(F.inline(F.array(*(F.struct(F.lit(m).alias("multiplier"), F.col(f"r{i}").alias("flag_rate")) for i, m in enumerate(multipliers)))))


def method_overlap(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Rows that exactly these methods flag: (methods, n)."""
    A, B, C = (F.coalesce(F.col(x), F.lit(False)) for x in (a, b, c))
    cells = {"a": A & ~B & ~C, "b": B & ~A & ~C, "c": C & ~A & ~B, "ab": A & B & ~C, "ac": A & C & ~B, "bc": B & C & ~A, "abc": A & B & C}
    one = df.agg(*(F.count_if(v).alias(k) for k, v in cells.items()))
    return one.unpivot([], list(cells), "methods", "n")


def flag_rate_by_group(df: DataFrame, flags: list[str], cls: str) -> DataFrame:
    """(cls, n, flag_rate, high): any flag; high: over twice the mean of the classes' rates."""
    any_flag = F.greatest(*(F.coalesce(F.col(f), F.lit(False)) for f in flags)) if len(flags) > 1 else F.col(flags[0])
    by = df.groupBy(cls).agg(F.count("*").alias("n"), F.avg(any_flag.cast("int")).alias("flag_rate"))
    mean = by.agg(F.avg("flag_rate").alias("__mean"))
    return by.join(F.broadcast(mean)).select(cls, "n", "flag_rate", (F.col("flag_rate") > 2 * F.col("__mean")).alias("high"))  # one row


def severity_by_city(df: DataFrame, city: str = "city") -> DataFrame:
    """Severity counts per city and overall (city NULL)."""
    return df.rollup("outlier_severity", city).agg(F.count("*").alias("n")).where("outlier_severity is not null")


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the rows with group true, sizes, and z of the normal approximation with tie correction (null for one group or one value)."""
    d = df.where(F.col(group).isNotNull())
    flagged = d.where(F.col(group)).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__k"))
    table = stats.rank_table(d, value)
    ties = table.join(flagged, F.col(value) == F.col("__v"), "left")
    one = ties.agg(F.coalesce(F.sum("__k"), F.lit(0)).alias("n1"), (F.sum("__n") - F.coalesce(F.sum("__k"), F.lit(0))).alias("n2"), F.sum(F.col("__k") * F.col("__rank")).alias("r"), F.sum(F.pow("__n", F.lit(3.0)) - F.col("__n")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2.0
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.try_divide("ties", n * (n - 1))))
    return one.select("n1", "n2", u.alias("u"), F.try_divide(u - F.col("n1") * F.col("n2") / 2.0, sd).alias("z"))
