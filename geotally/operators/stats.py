"""Grouped statistics, normalisation, correlation and separability."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotally.functions.folders import checkpointed


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation of the rows where neither is null; null where either is constant (F.corr fails there)."""
    a, b = F.when(_c(b).isNotNull(), _c(a)), F.when(_c(a).isNotNull(), _c(b))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def zscore(v: Column, mean: Column, sd: Column) -> Column:
    """0 for every row of a group without spread, NULL values too."""
    return F.when(sd.isNull() | F.isnan(sd) | (sd == 0), F.lit(0.0)).otherwise((v - mean) / sd)


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's other columns, NULL keys matching. right: one row a key; without keys one row in all."""
    if not keys:
        return left.join(F.broadcast(right))  # one row
    renamed = right.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return left.join(renamed, on, "left").drop(*(f"__k_{k}" for k in keys))


def rank_table(df: DataFrame, value: str, keys: list[str] = (), cuts: int = 100) -> DataFrame:
    """(keys, value, __n, __rank, __all): every distinct value of a group with its count, its average rank and the group's size.

    Distinct values are counted first, so ties cost nothing; within a group they are ranked in ranges cut at approximate quantiles
    and the ranges' sizes are added up. No task sorts a whole group, whatever share of the rows it has.
    """
    keys = list(keys)
    return _ranked(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n")), value, keys, cuts)


def _ranked(distinct: DataFrame, value: str, keys: list[str], cuts: int = 100) -> DataFrame:
    """rank_table() of values that are counted already: (keys, value, __n), no value NULL."""
    at = distinct.groupBy(*keys).agg(F.percentile_approx(value, F.array(*(F.lit(i / cuts) for i in range(1, cuts))), F.lit(1000)).alias("__cuts"))
    ranged = _on(distinct, at, keys).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    sizes = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__s"))
    group = Window.partitionBy(*keys)  # at most cuts rows of sizes each
    before = sizes.select(*keys, "__range", (F.sum("__s").over(group.orderBy("__range")) - F.col("__s")).alias("__before"), F.sum("__s").over(group).alias("__all"))
    up_to = F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy(value))
    return _on(ranged.withColumn("__up_to", up_to), before, [*keys, "__range"]).select(*keys, value, "__n", (F.col("__before") + F.col("__up_to") - (F.col("__n") - 1) / 2.0).alias("__rank"), "__all")


def with_rank(df: DataFrame, value: str, out: str, keys: list[str] = (), n: str | None = None) -> DataFrame:
    """df with the average rank of its value in its group (NULL for NULL), and with n the number of values there. df is written first, as its values are joined."""
    df = checkpointed(df)
    table = rank_table(df, value, keys)
    return _on(df, table.select(*keys, value, F.col("__rank").alias(out), *([F.col("__all").alias(n)] if n else [])), [*keys, value])


def city_percentiles(counted: DataFrame, rare: DataFrame, value: str, city: str) -> DataFrame:
    """(city, value, __p): percentile among all values of the city of each distinct value in rare, which is a bounded table.

    The city's values, as (city, value, __n), are only counted between the rare ones, so nothing is sorted.
    """
    marks = rare.groupBy(city).agg(F.array_sort(F.collect_set(value)).alias("__marks"))
    below = F.size(F.filter("__marks", lambda u: u < F.col(value)))
    near = _on(counted.where(F.col(value).isNotNull()), marks, [city]).where("__marks is not null")
    counts = near.groupBy(city, below.alias("__j")).agg(F.sum("__n").alias("__c"), F.sum(F.when(F.array_contains("__marks", F.col(value)), F.col("__n")).otherwise(0)).alias("__e"))
    spread = _on(counts, marks, [city]).select(city, "__c", "__e", "__j", F.get("__marks", F.col("__j")).alias(value))
    group = Window.partitionBy(city)
    at_most = F.sum("__c").over(group.orderBy("__j"))
    rank = at_most - (F.col("__e") - 1) / 2.0
    return spread.select(city, value, (rank * 100.0 / F.sum("__c").over(group)).alias("__p")).where(F.col(value).isNotNull())


def _value_counts(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, __n), written: the one pass over df by which its groups are described. NULL is a value here."""
    return checkpointed(df.groupBy(*keys, value).agg(F.count("*").alias("__n")))


def _moments(counted: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, __g, __v, __lo, __hi, __m, __q, __s) of groups of counted values: rows, values, least, largest, mean, sum of squares about it and
    spread (ddof 1). A row a group. Equal values have no spread at all, whatever their sum is rounded to."""
    v = F.col(value).cast("double")
    n = F.when(v.isNotNull(), F.col("__n")).otherwise(0)
    means = counted.groupBy(*keys).agg(F.sum("__n").alias("__g"), F.sum(n).alias("__v"), F.min(v).alias("__lo"), F.max(v).alias("__hi"), (F.sum(F.col("__n") * v) / F.nullif(F.sum(n), F.lit(0))).alias("__m"))
    about = _on(counted, means.select(*keys, F.col("__m")), keys)
    squares = about.groupBy(*keys).agg(F.sum(F.col("__n") * (v - F.col("__m")) * (v - F.col("__m"))).alias("__q"))
    q = F.when(F.col("__lo") == F.col("__hi"), F.lit(0.0)).otherwise(F.col("__q"))
    return _on(means, squares, keys).withColumn("__q", q).withColumn("__s", F.when(F.col("__v") > 1, F.sqrt(F.col("__q") / (F.col("__v") - 1))))


def _merged_moments(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __cm, __cs): mean and spread of groups of groups."""
    total = groups.groupBy(*keys).agg(F.sum("__v").alias("__cv"), (F.sum(F.col("__v") * F.col("__m")) / F.nullif(F.sum("__v"), F.lit(0))).alias("__cm"), (F.min("__lo") == F.max("__hi")).alias("__flat"))
    apart = _on(groups, total.select(*keys, "__cm"), keys)
    between = apart.groupBy(*keys).agg(F.sum(F.coalesce(F.col("__q"), F.lit(0.0)) + F.coalesce(F.col("__v") * F.pow(F.col("__m") - F.col("__cm"), F.lit(2.0)), F.lit(0.0))).alias("__cq"))
    spread = F.when(F.col("__flat"), F.lit(0.0)).when(F.col("__cv") > 1, F.sqrt(F.col("__cq") / (F.col("__cv") - 1)))
    return _on(total, between, keys).select(*keys, "__cm", spread.alias("__cs"))


def group_scores_with_fallback(df: DataFrame, value: str, cls: str, city: str = "city", least: int = 10) -> DataFrame:
    """{value}_zscore and {value}_percentile within (city, class), or within the city where the class has few rows there.

    z: 0 for a whole group without spread. Percentile: the average rank in per cent of the group's values. Both follow from (city, class, value) alone:
    df is written once (a mean that is worked out again can end in another bit, and would miss its score), read to count those, and read for the one join with their scores.
    """
    df = checkpointed(df)
    v, keys, few = F.col(value), [city, cls], F.col("__g") < least
    counted = _value_counts(df, value, keys)
    groups = checkpointed(_moments(counted, value, keys))
    values = counted.where(v.isNotNull())
    ranked = checkpointed(_on(_ranked(values, value, keys).select(*keys, value, (F.col("__rank") * 100.0 / F.col("__all")).alias("__p1")), groups.select(*keys, "__g"), keys))
    fallback = city_percentiles(values, ranked.where(few).select(city, value), value, city)  # under least rows a class and city
    found = _on(_on(_on(counted, ranked.drop("__g"), [*keys, value]), groups, keys), _merged_moments(groups, [city]), [city])
    z = F.when(few, zscore(v, F.col("__cm"), F.col("__cs"))).otherwise(zscore(v, F.col("__m"), F.col("__s")))
    p = F.when(few, F.col("__p")).otherwise(F.col("__p1"))
    scores = checkpointed(_on(found, fallback, [city, value]).select(*keys, value, z.alias("__z"), p.alias("__percentile")))
    out = _on(df, scores, [*keys, value])
    return out.select(*df.columns, F.col("__z").alias(f"{value}_zscore"), F.col("__percentile").alias(f"{value}_percentile"))


def group_scores(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """zscore (ddof 1) and pct_rank (average rank / n * 100) per group, NULL values left out. df is written first, as its values are joined."""
    d = checkpointed(df.where(F.col(value).isNotNull()))
    counted = _value_counts(d, value, keys)
    found = _on(_ranked(counted, value, list(keys)), _moments(counted, value, keys), keys)
    scores = checkpointed(found.select(*keys, value, zscore(F.col(value), F.col("__m"), F.col("__s")).alias("__z"), (F.col("__rank") * 100.0 / F.col("__all")).alias("__p")))
    return _on(d, scores, [*keys, value]).select(*df.columns, F.col("__z").alias("zscore"), F.col("__p").alias("pct_rank"))


def eta_squared(df: DataFrame, value: str, cls: str, least: int = 2) -> DataFrame:
    """SS between viable classes over SS of all non-NULL values: one aggregate a class, then one of the classes."""
    by = df.where(F.col(value).isNotNull()).groupBy(cls).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    total = by.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    joined = by.join(F.broadcast(total))  # one row
    d2 = F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2.0))
    between = F.sum(F.when((F.col("n") >= least) & F.col(cls).isNotNull(), d2).otherwise(0.0))
    return joined.agg((between / (F.sum(d2) + F.sum(F.col("n") * F.col("v")))).alias("eta_squared"))


def chi2_sf(spark, x: float, df: float) -> float:
    return 1 - spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(df)).cumulativeProbability(float(x))


def welch_anova(df: DataFrame, value: str, cls: str) -> dict:
    """Alexander-Govern test of equal means; classes of two rows and more with spread. Closed form from a row a class."""
    rows = df.where(F.col(value).isNotNull()).groupBy(cls).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n > 1 and v > 0").collect()
    n, m, v = (np.array([r[k] for r in rows], float) for k in ("n", "m", "v"))
    if len(rows) < 2:
        raise ValueError("two classes are needed")
    w = (n / v) / (n / v).sum()
    t = (m - (w * m).sum()) / np.sqrt(v / n)
    a = n - 1.5
    b = 48 * a**2
    c = np.sqrt(a * np.log(1 + t**2 / (n - 1)))
    z = c + (c**3 + 3 * c) / b - (4 * c**7 + 33 * c**5 + 240 * c**3 + 855 * c) / (10 * b**2 + 8 * b * c**4 + 1000 * b)
    statistic = float((z**2).sum())
    return {"statistic": statistic, "pvalue": chi2_sf(df.sparkSession, statistic, len(rows) - 1)}


def cohens_d(df: DataFrame, value: str, cls: str, city: str, a: str, b: str) -> DataFrame:
    """(cls, d) between two cities, pooled ddof 1; classes with a city of under two rows or no spread left out."""
    one = df.where(F.col(value).isNotNull()).groupBy(cls).agg(*(f(F.when(F.col(city) == k, F.col(value))).alias(f"{n}{i}") for i, k in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    return one.where("n0 > 1 and n1 > 1").select(cls, ((F.col("m0") - F.col("m1")) / F.nullif(pooled, F.lit(0.0))).alias("d")).where("d is not null")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) of every pair, over the rows that have both: one aggregate."""
    pairs = list(combinations(features, 2))
    one = df.agg(*(corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    stacked = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(stacked))


def spearman(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """rho per group: Pearson of average ranks over rows that have both."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = with_rank(with_rank(d, a, "__ra", keys), b, "__rb", keys)
    return d.groupBy(*keys).agg(F.coalesce(corr("__ra", "__rb"), F.lit(0.0)).alias("rho"))


def base_correlations(long: DataFrame, bases: list[str], entity: str = "id", month: str = "month", base: str = "base", value: str = "v") -> DataFrame:
    """(a, b, r) between bases: each (base, month) column standardised (ddof 0), a base's months stacked."""
    by = long.groupBy(base, month).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    v = F.col(value)
    z = _on(long, by, [base, month]).withColumn("z", F.when(F.col("__s") > 0, (v - F.col("__m")) / F.col("__s")).otherwise(F.when(v.isNotNull(), 0.0)))
    wide = z.groupBy(entity, month).pivot(base, bases).agg(F.first("z"))
    return correlations(wide, bases)


def target_correlation(df: DataFrame, features: list[str], cls: str) -> DataFrame:
    """(feature, mean_abs_corr) with the one-against-rest indicator of each class, from sums per class."""
    long = df.unpivot([cls], features, "feature", "v").where(F.col("v").isNotNull())
    by = long.groupBy("feature", cls).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    w = Window.partitionBy("feature")
    n, s, q = (F.sum(c).over(w) for c in "nsq")
    r = (F.col("s") - F.col("n") * s / n) / F.nullif(F.sqrt((q - s * s / n) * F.col("n") * (n - F.col("n")) / n), F.lit(0.0))
    return by.withColumn("r", F.abs(r)).groupBy("feature").agg(F.avg("r").alias("mean_abs_corr"))


def redundant_pairs(pairs: DataFrame, threshold: float = 0.95, importance: DataFrame | None = None) -> DataFrame:
    """(a, b, r, drop) with abs(r) above the threshold: b goes, or a where b is strictly more important. importance: (feature, importance), a row a feature."""
    found = pairs.where(F.abs("r") > threshold)
    if importance is None:
        return found.withColumn("drop", F.col("b"))
    ia, ib = (importance.select(F.col("feature").alias(x), F.col("importance").alias(f"i{x}")) for x in "ab")
    both = found.join(ia, "a", "left").join(ib, "b", "left")
    return both.select("a", "b", "r", F.when(F.coalesce("ib", F.lit(0.0)) > F.coalesce("ia", F.lit(0.0)), F.col("a")).otherwise(F.col("b")).alias("drop"))


def redundancy_consensus(first: DataFrame, second: DataFrame, preference: dict[str, float], family: dict[str, str] | None = None, threshold: float = 0.95, min_keep: int = 1) -> list[str]:
    """Features to remove: pairs redundant in both cities, strongest first; the less preferred goes, unless too few or none of its family would stay."""
    a = first.where(F.abs("r") > threshold).select("a", "b", F.abs("r").alias("r1"))
    b = second.where(F.abs("r") > threshold).select("a", "b", F.abs("r").alias("r2"))
    pairs = a.join(b, ["a", "b"]).select("a", "b", F.least("r1", "r2").alias("r")).orderBy(F.desc("r"), "a", "b").collect()  # pairs of features
    kept = {x for r in first.select("a", "b").collect() for x in r}
    family = family or {}
    removed: list[str] = []
    for p in pairs:
        if p["a"] in removed or p["b"] in removed:
            continue
        out = min((p["b"], p["a"]), key=lambda f: preference.get(f, 0.0))
        left = kept - {*removed, out}
        if len(left) >= min_keep and (out not in family or any(family.get(f) == family[out] for f in left)):
            removed.append(out)
    return removed


def gram(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """Per group, over complete rows: n, mean array and sums of products about a common shift (upper triangle): one aggregate."""
    d = df.dropna(subset=features)
    shift = d.agg(*(F.avg(f).alias(f) for f in features)).first()
    x = {f: F.col(f) - F.lit(float(shift[f] or 0.0)) for f in features}
    upper = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.avg(x[f]) for f in features)).alias("mean"), F.array(*(F.sum(x[a] * x[b]) for a, b in upper)).alias("products"), F.array(*(F.lit(float(shift[f] or 0.0)) for f in features)).alias("shift"))


def moments(row, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance (ddof 1) from a row of gram()."""
    n, m = row["n"], np.array(row["mean"])
    s = np.zeros((p, p))
    s[np.triu_indices(p)] = row["products"]
    s = s + np.triu(s, 1).T - n * np.outer(m, m)
    return n, m + np.array(row["shift"]), s / max(1, n - 1)


def vif(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Variance inflation: the diagonal of the inverse correlation matrix, from one pass; inf for exact combinations; 1 alone."""
    if len(features) == 1:
        return {features[0]: 1.0}
    _, _, cov = moments(gram(df, features).first(), len(features))
    sd = np.sqrt(np.diag(cov))
    r = cov / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1))
    np.fill_diagonal(r, 1)
    out = {}
    for i, f in enumerate(features):
        rest = [j for j in range(len(features)) if j != i]
        r2 = float(r[i, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)]) @ r[rest, i])
        out[f] = math.inf if r2 >= 1 - 1e-10 else 1 / (1 - r2)
    return out


def jm_univariate(long: DataFrame, least: int = 500, dispersion: str = "std", cls: str = "cls", city: str = "city", base: str = "base", month: str = "month", value: str = "v") -> DataFrame:
    """(city, month, class_a, class_b, jm): mean over bases of the Jeffries-Matusita distance between two classes.

    dispersion 'std' puts standard deviations where the textbook ('var') has variances.
    """
    spread = F.stddev_samp(value) if dispersion == "std" else F.var_samp(value)
    by = long.where(F.col(value).isNotNull() & F.col(cls).isNotNull()).groupBy(city, base, month, cls).agg(F.avg(value).alias("m"), F.greatest(F.lit(1e-6), spread).alias("s"), F.count("*").alias("n")).where(F.col("n") >= least)
    a, b = (by.select(city, base, month, *(F.col(c).alias(f"{c}_{x}") for c in (cls, "m", "s"))) for x in "ab")
    pair = a.join(b, [city, base, month]).where(F.col(f"{cls}_a") < F.col(f"{cls}_b"))  # classes, not rows
    mid = (F.col("s_a") + F.col("s_b")) / 2
    d = F.pow(F.col("m_a") - F.col("m_b"), F.lit(2.0)) / (8 * mid) + 0.5 * F.ln(mid / F.sqrt(F.col("s_a") * F.col("s_b")))
    jm = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 2 * (1 - F.exp(-d))))
    return pair.groupBy(city, month, F.col(f"{cls}_a").alias("class_a"), F.col(f"{cls}_b").alias("class_b")).agg(F.avg(jm).alias("jm"))


def jm_multivariate(df: DataFrame, features: list[str], cls: str) -> dict[tuple[str, str], float]:
    """Jeffries-Matusita distance of each pair of classes from their means and covariances (ridge 1e-6): one pass, then small matrices."""
    p = len(features)
    found = {r[cls]: moments(r, p) for r in gram(df.where(F.col(cls).isNotNull()), features, [cls]).where("n > 1").collect()}  # a row a class
    out = {}
    for a, b in combinations(sorted(found), 2):
        (_, ma, ca), (_, mb, cb) = found[a], found[b]
        ca, cb = ca + 1e-6 * np.eye(p), cb + 1e-6 * np.eye(p)
        mid, d = (ca + cb) / 2, ma - mb
        dets = [np.linalg.det(x) for x in (mid, ca, cb)]
        log = 0.5 * math.log(dets[0] / math.sqrt(dets[1] * dets[2])) if min(dets) > 0 else 0.0
        out[a, b] = float(np.clip(2 * (1 - math.exp(-(d @ np.linalg.solve(mid, d) / 8 + log))), 0, 2))
    return out


def month_selection(monthly: DataFrame, top: int, seasons: dict[str, tuple[list[int], int]], cap: int = 10, month: str = "month", score: str = "jm") -> DataFrame:
    """Months by mean score: the best ``top``, and the best of each season up to its minimum; at most cap. monthly: (month, score), 12 rows at most."""
    season = F.coalesce(*(F.when(F.col(month).isin(ms), F.lit(s)) for s, (ms, _) in seasons.items()), F.lit("none"))
    need = F.coalesce(*(F.when(F.col("season") == s, F.lit(n)) for s, (_, n) in seasons.items()), F.lit(0))
    best = monthly.groupBy(month).agg(F.avg(score).alias("score")).withColumn("season", season)
    order = [F.desc("score"), F.asc(month)]
    ranked = best.withColumns({"rank": F.row_number().over(Window.orderBy(*order)), "in_season": F.row_number().over(Window.partitionBy("season").orderBy(*order))})
    chosen = ranked.where((F.col("in_season") <= need) | (F.col("rank") <= top))
    keep = chosen.withColumn("k", F.row_number().over(Window.orderBy(F.desc(F.col("in_season") <= need), *order)))
    return keep.where(F.col("k") <= cap).select(month, "score", "rank", "season")


def monthly_stats(df: DataFrame, month: str, value: str) -> DataFrame:
    return df.groupBy(month).agg(*(F.round(f(value), 4).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))))


#: Values of a group that one aggregation buffer may hold; ranges that larger groups are counted in at a time.
HELD, RANGES = 1_000_000, 4096


def _narrowed(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """wanted (g, i, k, lo, hi, ...) with k counted within, and lo and hi of, the range of values that holds the k-th. rows: g, v. by: what tells the ranges of before apart."""
    open_ = wanted.select("g", "lo", "hi").distinct()
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))).otherwise(0)
    counted = rows.join(open_, "g").where("v between lo and hi").groupBy(*by, place.alias("range")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("range")))  # RANGES rows
    found = wanted.join(upto, by).where("upto >= k and upto - n < k")
    return checkpointed(found.select("g", "i", "part", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), F.col("low").alias("lo"), F.col("high").alias("hi")))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], held: int = HELD) -> DataFrame:
    """(keys, __q): an array of the exact quantiles of each group's values, linear between neighbours; groups without values are missing.

    Groups of up to held values are aggregated as they are. If there is a larger one, values are counted in ranges, then in ranges of the range that
    holds a wanted rank; only distinct values of a narrow range are put in order, so no task holds a group. Values are finite.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= held:
        return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, qs))).alias("__q"))
    each = sizes.select("*", F.posexplode(F.array(*(F.lit(float(q)) for q in qs))).alias("i", "q")).withColumn("p", F.col("q") * (F.col("n") - 1))
    low = F.floor("p") + 1
    ranks = F.array(F.struct(low.alias("k"), F.lit(0).alias("up")), F.struct(F.least(low + 1, F.col("n")).alias("k"), F.lit(1).alias("up")))
    wanted = checkpointed(each.select("g", "i", "lo", "hi", (F.col("p") - F.floor("p")).alias("rest"), F.inline(ranks)).select("g", "i", "k", "lo", "hi", F.struct("up", "rest").alias("part")))
    state = _narrowed(rows, _narrowed(rows, wanted, ["g", "lo", "hi"]), ["g", "lo", "hi"])
    values = rows.join(state.select("g", "lo", "hi").distinct(), "g").where("v between lo and hi").groupBy("g", "lo", "hi", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("v")))
    found = state.join(upto, ["g", "lo", "hi"]).where("upto >= k and upto - n < k").groupBy("g", "i").agg(F.max(F.when(F.col("part.up") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("part.up") == 1, F.col("v"))).alias("b"), F.max("part.rest").alias("rest"))
    q = F.col("a") + (F.col("b") - F.col("a")) * F.col("rest")
    return found.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", q.alias("q")))), lambda z: z["q"]).alias("__q")).select("g.*", "__q")


def year_cutoff(df: DataFrame, year: str, value: str, least: float = 2.0) -> DataFrame:
    """The year before the first whose median falls under least, but not before the first year; without one the last year."""
    by = df.where(F.col(year).isNotNull() & F.col(value).isNotNull())
    by = exact_quantiles(by, [year], value, [0.5]).select(year, F.col("__q")[0].alias("median"))
    first = F.min(F.when(F.col("median") < least, F.col(year)))
    return by.agg(F.coalesce(F.greatest(first - 1, F.min(year)), F.max(year)).alias("cutoff_year"))


def class_inventory(df: DataFrame, cls: str, city: str, cities: list[str]) -> DataFrame:
    wide = df.where(F.col(cls).isNotNull()).groupBy(cls).pivot(city, cities).count()
    wide = wide.select(cls, *(F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in cities))
    return wide.withColumn("total", sum((F.col(f"n_{c}") for c in cities[1:]), F.col(f"n_{cities[0]}")))


def class_count_matrix(df: DataFrame, cls: str, split: str, splits: list[str], least: int = 500) -> DataFrame:
    wide = class_inventory(df, cls, split, splits)
    low = F.least(*(F.col(f"n_{s}") for s in splits)) if len(splits) > 1 else F.col(f"n_{splits[0]}")
    return wide.withColumn("viable", low >= least)


def cadastre_summary(df: DataFrame, layer: str, city: str = "city") -> DataFrame:
    return df.groupBy(city, layer).agg(F.count("*").alias("n_rows"), F.count("genus_latin").alias("n_genus"), F.countDistinct("genus_latin").alias("n_classes"))


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def crosstab_normalized(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    wide = df.where(F.col(row).isNotNull()).groupBy(row).pivot(column, values).count()
    cells = [F.coalesce(F.col(str(v)), F.lit(0)) for v in values]
    total = sum(cells[1:], cells[0])
    return wide.select(row, *((c / total).alias(f"p_{v}") for c, v in zip(cells, values, strict=True)))
