"""Metrics over predictions (y_true, y_pred). Everything starts from the confusion counts, one aggregate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from geotally.operators import stats


def confusion_matrix(df: DataFrame, keys: list[str] = (), normalize: bool = False) -> DataFrame:
    """(keys, y_true, y_pred, n); normalised: share of the true class."""
    n = df.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "y_true"))) if normalize else n


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class_metrics(df: DataFrame, keys: list[str] = (), classes: DataFrame | None = None) -> DataFrame:
    """(keys, label, precision, recall, f1, support) of the labels seen, or of all in classes (label), absent ones 0."""
    cm = confusion_matrix(df, keys)
    sides = cm.select(*keys, F.inline(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("true"), F.lit(0).cast("long").alias("pred"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("true"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("tp")))))
    by = sides.groupBy(*keys, "label").agg(*(F.sum(c).alias(c) for c in ("true", "pred", "tp")))
    if classes is not None:
        by = classes.select("label").distinct().join(by, "label", "left").fillna(0, ["true", "pred", "tp"])
    p, r = _ratio(F.col("tp"), F.col("pred")), _ratio(F.col("tp"), F.col("true"))
    return by.select(*keys, "label", p.alias("precision"), r.alias("recall"), _ratio(2.0 * F.col("tp"), F.col("pred") + F.col("true")).alias("f1"), F.col("true").alias("support"))


def metrics(df: DataFrame, keys: list[str] = (), average: str = "weighted") -> DataFrame:
    """(keys, accuracy, precision, recall, f1, n), averaged over the labels in either column: weighted, macro or micro."""
    by = per_class_metrics(df, keys)
    n = F.sum("support")
    right = F.sum(F.col("recall") * F.col("support")) / n
    if average == "micro":
        p, r, f = right, right, right
    else:
        w = F.col("support") / 1.0 if average == "weighted" else F.lit(1.0)
        p, r, f = (F.sum(F.col(c) * w) / F.sum(w) for c in ("precision", "recall", "f1"))
    return by.groupBy(*keys).agg(right.alias("accuracy"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("n"))


def weighted_f1(counts: np.ndarray) -> float:
    tp, true, pred = np.diag(counts), counts.sum(axis=1), counts.sum(axis=0)
    f1 = np.where(true + pred > 0, 2 * tp / np.maximum(true + pred, 1), 0)
    return float((f1 * true).sum() / max(1, true.sum()))


def bootstrap_ci(df: DataFrame, metric=weighted_f1, replicates: int = 1000, level: float = 0.95, seed: int = 42) -> dict:
    """Percentile interval of a metric of the confusion counts. Resampling rows with replacement is one multinomial draw of the counts, so its cost doesn't depend on the rows."""
    rows = confusion_matrix(df).orderBy("y_true", "y_pred").collect()  # labels squared
    labels = sorted({r[0] for r in rows} | {r[1] for r in rows})
    at = {v: i for i, v in enumerate(labels)}
    counts = np.zeros((len(labels), len(labels)))
    for r in rows:
        counts[at[r[0]], at[r[1]]] = r[2]
    n = int(counts.sum())
    draws = np.random.default_rng(seed).multinomial(n, counts.ravel() / n, replicates).reshape(replicates, *counts.shape)
    values = [metric(d) for d in draws]
    low, high = np.quantile(values, [(1 - level) / 2, (1 + level) / 2])
    return {"value": metric(counts), "low": float(low), "high": float(high)}


#: Upper ends of the ranges of a uniform number that stand for Poisson(1) weights 0, 1, ... 8.
POISSON = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(9)])
#: Weights drawn at a time in a task.
DRAWS = 1 << 20


def poisson_weights(hashes: np.ndarray, replicates: int) -> np.ndarray:
    """[row, replicate]: Poisson(1) weights that depend on the row's hash and the number of the replicate (from 1) alone."""
    step = np.uint64(0x9E3779B97F4A7C15)
    z = hashes.view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * step
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(POISSON, u, side="right")


def weighted_moments(df: DataFrame, value: str, keys: list[str], replicates: int, key: str, seed: int = 42) -> DataFrame:
    """(keys, replicate, w, s, q): sums of the weights, of weight * value and of weight * value^2 of every bootstrap replicate.

    A task draws its rows' weights in blocks and sends one row of vectors over the replicates for each combination of keys; rows are never
    multiplied by replicates. Rows without value are left out.
    """
    if not keys:
        return weighted_moments(df.withColumn("__all", F.lit(0)), value, ["__all"], replicates, key, seed).drop("__all")
    found = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("k"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(value).cast("double").alias("v"))
    group = found.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = [tuple(k.values()) for k in batch.column(0).to_pylist()]
            numbers = {k: i for i, k in enumerate(dict.fromkeys(names))}
            which, h, v = np.array([numbers[k] for k in names], int), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            step = max(1, DRAWS // replicates)
            for k, i in numbers.items():
                mine = np.flatnonzero(which == i)
                total = sums.setdefault(k, np.zeros((3, replicates)))
                for at in range(0, mine.size, step):
                    rows = mine[at : at + step]
                    total += np.stack([np.ones(rows.size), v[rows], v[rows] ** 2]) @ poisson_weights(h[rows], replicates)
        columns = [pa.array([dict(zip(keys, k, strict=True)) for k in sums], kind), *(pa.array([t[j].tolist() for t in sums.values()], pa.list_(pa.float64())) for j in range(3))]
        yield pa.RecordBatch.from_arrays(columns, ["k", "w", "s", "q"])

    kind = to_arrow_type(found.schema["k"].dataType)
    parts = found.mapInArrow(run, f"k {group}, w array<double>, s array<double>, q array<double>")
    each = parts.select("k", F.posexplode(F.arrays_zip("w", "s", "q")).alias("at", "z"))
    return each.groupBy("k", (F.col("at") + 1).alias("replicate")).agg(*(F.sum(f"z.{c}").alias(c) for c in "wsq")).select("k.*", "replicate", "w", "s", "q")


def poisson_bootstrap(df: DataFrame, value: str, keys: list[str], replicates: int, key: str, seed: int = 42) -> DataFrame:
    """(keys, replicate, mean): each row weighs Poisson(1), by a hash of its key and the replicate. One pass."""
    sums = weighted_moments(df, value, keys, replicates, key, seed)
    return sums.select(*keys, "replicate", (F.col("s") / F.nullif("w", F.lit(0.0))).alias("mean"))


def cohens_d_ci(df: DataFrame, value: str, city: str, a: str, b: str, key: str, replicates: int = 200, level: float = 0.95, seed: int = 42) -> dict:
    """Interval of Cohen's d over all rows by Poisson bootstrap of moments; the replicates' sums are all that is collected."""
    sums = {(r["replicate"], r[city]): (r["w"], r["s"], r["q"]) for r in weighted_moments(df.where(F.col(city).isin(a, b)), value, [city], replicates, key, seed).collect()}
    values = []
    for k in range(1, replicates + 1):
        (n1, s1, q1), (n2, s2, q2) = (sums.get((k, c), (0, 0, 0)) for c in (a, b))
        if n1 and n2:
            pooled = (q1 - s1 * s1 / n1 + q2 - s2 * s2 / n2) / max(1, n1 + n2 - 2)
            if pooled > 0:
                values.append((s1 / n1 - s2 / n2) / pooled**0.5)
    low, high = np.quantile(values, [(1 - level) / 2, (1 + level) / 2])
    return {"low": float(low), "high": float(high)}


def worst_confused_pairs(df: DataFrame, k: int) -> DataFrame:
    """The k largest off-diagonal counts with their share of the true class."""
    cm = confusion_matrix(df, normalize=True).where("y_true <> y_pred")
    return cm.orderBy(F.desc("n"), F.desc("share"), "y_true", "y_pred").limit(k)


def metrics_by_group_sets(df: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, f1, n): weighted F1 over the true labels of a group, with the group's labels as the label set. groups: (label, grp), a row a label."""
    right = groups.withColumnRenamed("label", "y_true")
    d = df.join(right, "y_true")
    by = per_class_metrics(d, ["grp"]).join(groups, ["label", "grp"])  # only the group's own labels
    return by.groupBy("grp").agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"), F.sum("support").alias("n"))


def metrics_by_metadata(df: DataFrame, meta: str, bins: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """(label, accuracy, f1, n) a category, or a bin (name, low, high inclusive), empty bins as zeros; sorted by label."""
    name = F.coalesce(*(F.when(F.col(meta).between(lo, hi), F.lit(b)) for b, lo, hi in bins)) if bins else F.col(meta).cast("string")
    m = metrics(df.withColumn("grp", name).where("grp is not null"), ["grp"])
    m = m.select(F.col("grp").alias("label"), "accuracy", "f1", "n")
    if bins:
        names = df.sparkSession.createDataFrame([(b[0],) for b in bins], "label string")
        m = names.join(m, "label", "left").fillna(0)
    return m.orderBy("label")


def bin_years(year: Column, bins: list[tuple[str, int, int]]) -> Column:
    """The last bin (name, first, last) that holds the year."""
    return F.coalesce(*(F.when(year.between(lo, hi), F.lit(name)) for name, lo, hi in reversed(bins)))


def accuracy_by_block(df: DataFrame, blocks: DataFrame, block: str = "block_id") -> DataFrame:
    """(block, n, errors, accuracy) of every block of blocks; 0 without rows."""
    ok = F.col("y_true") == F.col("y_pred")
    by = df.groupBy(block).agg(F.count("*").alias("n"), F.count_if(~ok).alias("errors"), F.avg(ok.cast("int")).alias("accuracy"))
    return blocks.select(block).distinct().join(by, block, "left").fillna(0)


def species_breakdown(df: DataFrame, species: str, below: float = 0.5) -> DataFrame:
    """(y_true, species, n, accuracy, most_confused) for classes with F1 under ``below``; '-' without errors, ties to the smallest label."""
    weak = per_class_metrics(df).where((F.col("f1") < below) & (F.col("support") > 0)).select(F.col("label").alias("y_true"))
    d = df.join(weak, "y_true", "left_semi")
    by = d.groupBy("y_true", species).agg(F.count("*").alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"))
    wrong = d.where("y_true <> y_pred").groupBy("y_true", species, "y_pred").agg(F.count("*").alias("k"))
    first = F.row_number().over(Window.partitionBy("y_true", species).orderBy(F.desc("k"), "y_pred"))
    top = wrong.withColumn("r", first).where("r = 1").select("y_true", species, F.col("y_pred").cast("string").alias("most_confused"))
    return by.join(top, ["y_true", species], "left").fillna("-", ["most_confused"])


def transfer_gap(df: DataFrame, source: str, target: str) -> DataFrame:
    gap = F.col(source) - F.col(target)
    return df.withColumns({"absolute_drop": gap, "relative_drop": F.when(F.col(source) > 0, gap / F.col(source)).otherwise(0.0)})


def transfer_metrics(source: DataFrame, target: DataFrame) -> DataFrame:
    """(domain, accuracy, precision, recall, f1, n) of both prediction tables."""
    both = source.select(F.lit("source").alias("domain"), "y_true", "y_pred").unionByName(target.select(F.lit("target").alias("domain"), "y_true", "y_pred"))
    return metrics(both, ["domain"])


def robustness_ranking(source: DataFrame, target: DataFrame) -> DataFrame:
    """(label, f1_source, f1_target, relative_drop, robustness) from two per-class frames; a class absent in the target has 0."""
    s, t = source.select("label", F.col("f1").alias("f1_source")), target.select("label", F.col("f1").alias("f1_target"))
    d = transfer_gap(s.join(t, "label", "left").fillna(0.0, ["f1_target"]), "f1_source", "f1_target")
    kind = F.when(F.col("relative_drop") <= 0.05, "robust").when(F.col("relative_drop") <= 0.15, "medium").otherwise("poor")
    return d.drop("absolute_drop").withColumn("robustness", kind).orderBy("relative_drop", "label")


def importance_stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spearman's rho of the importances of the features that both have."""
    both = a.select("feature", F.col("importance").alias("ia")).join(b.select("feature", F.col("importance").alias("ib")), "feature")
    return stats.spearman(both, "ia", "ib")


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts b_count (a right, b wrong), c_count, and the statistic (abs(b - c) - 1)^2 / (b + c)."""
    ra, rb = F.col(a) == F.col("y_true"), F.col(b) == F.col("y_true")
    one = df.agg(F.count_if(ra & ~rb).alias("b_count"), F.count_if(~ra & rb).alias("c_count"))
    n = F.col("b_count") + F.col("c_count")
    return one.withColumn("statistic", F.when(n > 0, F.pow(F.abs(F.col("b_count") - F.col("c_count")) - 1, F.lit(2.0)) / n).otherwise(0.0))


def mcnemar_p(df: DataFrame, a: str, b: str) -> float:
    """Exact two-sided binomial p-value."""
    r = mcnemar(df, a, b).first()
    n = r["b_count"] + r["c_count"]
    if not n:
        return 1.0
    cdf = df.sparkSession._jvm.org.apache.commons.math3.distribution.BinomialDistribution(int(n), 0.5).cumulativeProbability(int(min(r["b_count"], r["c_count"])))
    return min(1.0, 2 * cdf)


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """H with tie correction, effect H / (n - 1), n and k groups; equal values alone have no H."""
    d = stats.with_rank(df.where(F.col(group).isNotNull() & F.col(value).isNotNull()), value, "__rank")
    by = d.groupBy(group).agg(F.count("*").alias("n"), F.sum("__rank").alias("r")).agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.count("*").alias("k"))
    ties = d.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    one = by.join(F.broadcast(ties))  # one row
    n = F.col("n")
    h = F.try_divide(12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.try_divide("ties", F.pow(n, F.lit(3.0)) - n))
    return one.select(h.alias("h"), F.try_divide(h, n - 1).alias("effect"), "n", "k")


def hypothesis_test(df: DataFrame, kind: str, a: str, b: str, least: int = 3) -> dict:
    """pearson, spearman (columns a and b), kruskal, mann_whitney (value a by group b): statistic, effect, p-value and a conclusion.

    Rows with a null in either don't count. One value or one group alone has no statistic, and the conclusion says so (rank correlation: 0).
    """
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = df.count()
    if n < least:
        return {"kind": kind, "n": n, "conclusion": "too few rows"}
    none = {"kind": kind, "n": n, "conclusion": "no statistic"}
    maths = df.sparkSession._jvm.org.apache.commons.math3.distribution
    if kind in ("pearson", "spearman"):
        r = df.agg(stats.corr(a, b)).first()[0] if kind == "pearson" else stats.spearman(df, a, b).first()[0]
        if r is None or r != r:
            return none
        t = abs(r) * ((n - 2) / max(1e-300, 1 - r * r)) ** 0.5
        p, statistic, effect = 2 * (1 - maths.TDistribution(float(n - 2)).cumulativeProbability(float(min(t, 1e6)))), r, r
    elif kind == "kruskal":
        k = kruskal(df, a, b).first()
        if k["h"] is None or k["h"] != k["h"] or k["k"] < 2:
            return none
        p, statistic, effect = stats.chi2_sf(df.sparkSession, k["h"], k["k"] - 1), k["h"], k["effect"]
    else:
        from geotally.operators.outliers import mann_whitney

        m = mann_whitney(df, a, b).first()
        if m["z"] is None or m["z"] != m["z"]:
            return none
        p, statistic, effect = 2 * (1 - maths.NormalDistribution().cumulativeProbability(float(abs(m["z"])))), m["u"], 2 * m["u"] / (m["n1"] * m["n2"]) - 1
    return {"kind": kind, "n": n, "statistic": statistic, "effect": effect, "pvalue": p, "conclusion": "supported" if p < 0.05 else "not supported"}


def power_law(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """(keys, a, b, r2) of y = a x^b by least squares of the logarithms; r2 on the raw scale."""
    d = df.where((F.col(x) > 0) & (F.col(y) > 0))
    fit = d.groupBy(*keys).agg(F.exp(F.regr_intercept(F.ln(y), F.ln(x))).alias("a"), F.regr_slope(F.ln(y), F.ln(x)).alias("b"), F.avg(y).alias("m"))
    both = d.join(fit, list(keys)) if keys else d.join(F.broadcast(fit))  # without keys one row
    return both.groupBy(*keys, "a", "b").agg((1 - F.sum((F.col(y) - F.col("a") * F.pow(x, F.col("b"))) ** 2) / F.sum((F.col(y) - F.col("m")) ** 2)).alias("r2"))


def extrapolate(fit: DataFrame, target: float, low: float, high: float) -> DataFrame:
    """x at which a fit reaches target, if within [low, 10 high]."""
    x = F.pow(F.lit(target) / F.col("a"), 1 / F.col("b"))
    return fit.withColumn("x_target", F.when(x.between(low, 10 * high), x))


def recovery_fraction(curves: DataFrame, source: DataFrame, share: float = 0.9) -> DataFrame:
    """(label, fraction): the least fraction whose F1 is at least share of the source's. curves: (label, fraction, f1)."""
    s = source.select("label", F.col("f1").alias("__s"))
    return curves.join(s, "label").groupBy("label").agg(F.min(F.when(F.col("f1") >= share * F.col("__s"), F.col("fraction"))).alias("fraction"))


def class_summary(source: DataFrame, target: DataFrame, flags: DataFrame, jm: DataFrame) -> DataFrame:
    """(label, f1_source, f1_target, gap, flag, mean_jm). flags: (label, flag); jm: (label, jm), a row a merged member."""
    s, t = source.select("label", F.col("f1").alias("f1_source")), target.select("label", F.col("f1").alias("f1_target"))
    j = jm.groupBy("label").agg(F.avg("jm").alias("mean_jm"))
    return s.join(t, "label", "left").join(flags, "label", "left").join(j, "label", "left").withColumn("gap", F.col("f1_source") - F.col("f1_target"))
