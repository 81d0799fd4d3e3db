"""Queries: evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotally.operators import evaluate
from geotally.plans.bindings import PRE, R, predictions, rounded
from geotally.plans.registry import query


def per_class(source: str, key: str = "''", pred: str = "y_pred") -> str:
    """Common table expressions cm and pc (k, label, p, r, f, support)."""
    return f"""cm AS (SELECT {key} AS k, y_true, {pred} AS y_pred, count(*) AS n FROM {source} GROUP BY ALL),
 lb AS (SELECT k, y_true AS label FROM cm UNION SELECT k, y_pred FROM cm),
 ct AS (SELECT k, label, coalesce((SELECT sum(n) FROM cm WHERE cm.k = lb.k AND y_true = label AND y_pred = label), 0) AS tp, coalesce((SELECT sum(n) FROM cm WHERE cm.k = lb.k AND y_pred = label), 0) AS pp, coalesce((SELECT sum(n) FROM cm WHERE cm.k = lb.k AND y_true = label), 0) AS tt FROM lb),
 pc AS (SELECT k, label, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS p, CASE WHEN tt > 0 THEN tp / tt ELSE 0 END AS r, CASE WHEN pp + tt > 0 THEN 2.0 * tp / (pp + tt) ELSE 0 END AS f, CAST(tt AS BIGINT) AS support FROM ct)"""


@query(f"WITH {PRE} SELECT y_true, y_pred, n, {R('n / sum(n) OVER (PARTITION BY y_true)')} AS share FROM (SELECT y_true, y_pred, count(*) AS n FROM pre GROUP BY ALL)")
def ev1_confusion_matrix(spark, d):
    return rounded(evaluate.confusion_matrix(predictions(spark, d), normalize=True))


def averaged(weight: str) -> str:
    return ", ".join(f"{R(f'sum({c} * {weight}) / sum({weight})')} AS {n}" for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1")))


@query(f"WITH {PRE}, {per_class('pre')} SELECT 'weighted' AS average, {R('sum(r * support) / sum(support)')} AS accuracy, {averaged('support')}, CAST(sum(support) AS BIGINT) AS n FROM pc UNION ALL SELECT 'macro', {R('sum(r * support) / sum(support)')}, {averaged('1')}, CAST(sum(support) AS BIGINT) FROM pc UNION ALL SELECT 'micro', {', '.join([R('sum(r * support) / sum(support)')] * 4)}, CAST(sum(support) AS BIGINT) FROM pc")
def ev2_metrics(spark, d):
    p, out = predictions(spark, d), None
    for a in ("weighted", "macro", "micro"):
        m = evaluate.metrics(p, average=a).select(F.lit(a).alias("average"), "*")
        out = m if out is None else out.unionByName(m)
    return rounded(out)


@query(f"WITH {PRE}, {per_class('pre')} SELECT CAST(l AS INTEGER) AS label, {R('coalesce(p, 0)')} AS precision, {R('coalesce(r, 0)')} AS recall, {R('coalesce(f, 0)')} AS f1, coalesce(support, 0) AS support FROM (SELECT unnest(range(0, 12)) AS l) LEFT JOIN pc ON label = l")
def ev3_per_class_metrics(spark, d):
    classes = spark.range(12).select(F.col("id").cast("int").alias("label"))
    return rounded(evaluate.per_class_metrics(predictions(spark, d), classes=classes))


@query()
def ev4_bootstrap_ci(spark, d):
    r = evaluate.bootstrap_ci(predictions(spark, d))
    return spark.createDataFrame([(r["value"], r["low"], r["high"])], "value double, low double, high double")


@query(f"WITH {PRE}, c AS (SELECT *, n / sum(n) OVER (PARTITION BY y_true) AS share FROM (SELECT y_true, y_pred, count(*) AS n FROM pre GROUP BY ALL)) SELECT y_true, y_pred, n, {R('share')} AS share FROM c WHERE y_true <> y_pred ORDER BY n DESC, c.share DESC, y_true, y_pred LIMIT 8")
def ev5_worst_confused_pairs(spark, d):
    return rounded(evaluate.worst_confused_pairs(predictions(spark, d), 8))


@query(f"WITH {PRE}, g AS (SELECT *, CASE WHEN y_true < 4 THEN 'low' ELSE 'high' END AS grp FROM pre), {per_class('g', 'grp')} SELECT k AS grp, {R('sum(f * support) / sum(support)')} AS f1, CAST(sum(support) AS BIGINT) AS n FROM pc WHERE (label < 4) = (k = 'low') GROUP BY k")
def ev6_metrics_by_group(spark, d):
    groups = spark.createDataFrame([(i, "low" if i < 4 else "high") for i in range(10)], "label int, grp string")
    return rounded(evaluate.metrics_by_group_sets(predictions(spark, d), groups))


BINS = [("1950-1969", 1950, 1969), ("1970-1989", 1970, 1989), ("1990-2019", 1990, 2019), ("2020-", 2020, 2100)]
BIN_SQL = "CASE " + " ".join(f"WHEN plant_year BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in BINS) + " END"


@query(f"WITH {PRE}, g AS (SELECT *, {BIN_SQL} AS b FROM pre WHERE plant_year IS NOT NULL), {per_class('g', 'b')} SELECT b.n AS label, {R('coalesce(sum(r * support) / sum(support), 0)')} AS accuracy, {R('coalesce(sum(f * support) / sum(support), 0)')} AS f1, CAST(coalesce(sum(support), 0) AS BIGINT) AS n FROM (VALUES {', '.join(f'''('{n}')''' for n, _, _ in BINS)}) b(n) LEFT JOIN pc ON k = b.n GROUP BY b.n")
def ev7_metrics_by_metadata(spark, d):
    return rounded(evaluate.metrics_by_metadata(predictions(spark, d), "plant_year", BINS))


@query(f"WITH {PRE} SELECT id, CASE WHEN plant_year BETWEEN 1985 AND 2010 THEN 'late' WHEN plant_year BETWEEN 1950 AND 1990 THEN 'early' END AS era FROM pre")
def ev8_bin_years(spark, d):
    return predictions(spark, d).select("id", evaluate.bin_years(F.col("plant_year"), [("early", 1950, 1990), ("late", 1985, 2010)]).alias("era"))


@query(f"WITH {PRE} SELECT CAST(b AS BIGINT) AS block_id, count(id) AS n, count(*) FILTER (WHERE y_true <> y_pred) AS errors, {R('coalesce(avg(CAST(y_true = y_pred AS INTEGER)), 0)')} AS accuracy FROM (SELECT unnest(range(0, 45)) AS b) LEFT JOIN pre ON id % 40 = b GROUP BY b")
def ev9_accuracy_by_block(spark, d):
    return rounded(evaluate.accuracy_by_block(predictions(spark, d).withColumn("block_id", F.col("id") % 40), spark.range(45).withColumnRenamed("id", "block_id")))


@query(f"WITH {PRE}, {per_class('pre')}, w AS (SELECT pre.* FROM pre JOIN pc ON label = y_true WHERE f < 0.78), x AS (SELECT * FROM (SELECT y_true, species, y_pred, count(*) AS c FROM w WHERE y_true <> y_pred GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY y_true, species ORDER BY c DESC, y_pred) = 1) SELECT y_true, species, count(*) AS n, {R('avg(CAST(w.y_true = w.y_pred AS INTEGER))')} AS accuracy, coalesce(CAST(any_value(x.y_pred) AS VARCHAR), '-') AS most_confused FROM w LEFT JOIN x USING (y_true, species) GROUP BY y_true, species")
def ev10_species_breakdown(spark, d):
    return rounded(evaluate.species_breakdown(predictions(spark, d), "species", 0.78))


TWO = f"{PRE}, {per_class('pre', 'city')}"


@query(f"WITH {TWO}, f AS (SELECT label, coalesce(max(CASE WHEN k = 'source' THEN f END), 0) AS s, coalesce(max(CASE WHEN k = 'target' THEN f END), 0) AS t FROM pc GROUP BY label) SELECT label, {R('s')} AS f1_source, {R('t')} AS f1_target, {R('s - t')} AS absolute_drop, {R('CASE WHEN s > 0 THEN (s - t) / s ELSE 0 END')} AS relative_drop FROM f")
def ev11_transfer_gap(spark, d):
    m = evaluate.per_class_metrics(predictions(spark, d), ["city"])
    f = m.groupBy("label").agg(*(F.coalesce(F.max(F.when(F.col("city") == c, F.col("f1"))), F.lit(0.0)).alias(f"f1_{c}") for c in ("source", "target")))
    return rounded(evaluate.transfer_gap(f, "f1_source", "f1_target"))


@query(f"WITH {TWO} SELECT k AS domain, {R('sum(r * support) / sum(support)')} AS accuracy, {averaged('support')}, CAST(sum(support) AS BIGINT) AS n FROM pc GROUP BY k")
def ev12_transfer_metrics(spark, d):
    p = predictions(spark, d)
    return rounded(evaluate.transfer_metrics(p.where("city = 'source'"), p.where("city = 'target'")))


@query(f"WITH {TWO}, f AS (SELECT s.label, s.f AS s, coalesce(t.f, 0) AS t FROM pc s LEFT JOIN pc t ON s.label = t.label AND t.k = 'target' WHERE s.k = 'source'), g AS (SELECT *, CASE WHEN s > 0 THEN (s - t) / s ELSE 0 END AS q FROM f) SELECT label, {R('s')} AS f1_source, {R('t')} AS f1_target, {R('q')} AS relative_drop, CASE WHEN q <= 0.05 THEN 'robust' WHEN q <= 0.15 THEN 'medium' ELSE 'poor' END AS robustness FROM g")
def ev13_robustness(spark, d):
    p = predictions(spark, d)
    return rounded(evaluate.robustness_ranking(*(evaluate.per_class_metrics(p.where(F.col("city") == c)) for c in ("source", "target"))))


@query("WITH a AS (SELECT p_brand AS feature, avg(p_retailprice) AS ia, avg(p_size) AS ib FROM part GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY ia) + (count(*) OVER (PARTITION BY ia) - 1) / 2.0 AS x, rank() OVER (ORDER BY ib) + (count(*) OVER (PARTITION BY ib) - 1) / 2.0 AS y FROM a) SELECT round(coalesce(corr(x, y), 0), 6) + 0.0 AS rho FROM r")
def ev14_importance_stability(spark, d):
    from geotally.plans.bindings import table

    a = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("ia"), F.avg("p_size").alias("ib"))
    return rounded(evaluate.importance_stability(a.select("feature", F.col("ia").alias("importance")), a.select("feature", F.col("ib").alias("importance"))))


@query(f"WITH {PRE}, o AS (SELECT count(*) FILTER (WHERE y_pred = y_true AND y_other <> y_true) AS b_count, count(*) FILTER (WHERE y_pred <> y_true AND y_other = y_true) AS c_count FROM pre) SELECT b_count, c_count, {R('pow(abs(b_count - c_count) - 1, 2) / (b_count + c_count)')} AS statistic FROM o")
def ev15_mcnemar(spark, d):
    return rounded(evaluate.mcnemar(predictions(spark, d), "y_pred", "y_other"))


@query(f"WITH {PRE}, r AS (SELECT y_true, rank() OVER (ORDER BY plant_year) + (count(*) OVER (PARTITION BY plant_year) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY plant_year) AS t FROM pre WHERE plant_year IS NOT NULL), g AS (SELECT count(*) AS n, sum(r) AS s FROM r GROUP BY y_true), o AS (SELECT (SELECT count(*) FROM r) AS n, sum(s * s / g.n) AS q, count(*) AS k, (SELECT sum(t * t - 1) FROM r) AS ties FROM g), h AS (SELECT (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h, n, k FROM o) SELECT {R('h', 5)} AS h, {R('h / (n - 1)')} AS effect, n, k FROM h")
def ev16_kruskal(spark, d):
    k = evaluate.kruskal(predictions(spark, d), "plant_year", "y_true")
    return k.select(F.round("h", 5).alias("h"), F.round("effect", 6).alias("effect"), "n", "k")


def tested(spark, d, kind: str, a: str, b: str):
    """A hypothesis test of predictions as one row; its p-value has no SQL (tests/test_models.py)."""
    p = predictions(spark, d).withColumn("wrong", F.col("y_true") != F.col("y_pred"))
    t = evaluate.hypothesis_test(p, kind, a, b)
    return rounded(spark.createDataFrame([(kind, t["n"], t.get("statistic"), t.get("effect"))], "kind string, n long, statistic double, effect double"))


MEAN_RANK = "rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"


@query(f"WITH {PRE} SELECT 'pearson' AS kind, count(*) AS n, {R('corr(x, plant_year)')} AS statistic, {R('corr(x, plant_year)')} AS effect FROM pre WHERE plant_year IS NOT NULL AND x IS NOT NULL")
def ev16_pearson(spark, d):
    return tested(spark, d, "pearson", "x", "plant_year")


@query(f"WITH {PRE}, r AS (SELECT {MEAN_RANK.format(v='x')} AS a, {MEAN_RANK.format(v='plant_year')} AS b FROM pre WHERE plant_year IS NOT NULL AND x IS NOT NULL) SELECT 'spearman' AS kind, count(*) AS n, {R('corr(a, b)')} AS statistic, {R('corr(a, b)')} AS effect FROM r")
def ev16_spearman(spark, d):
    return tested(spark, d, "spearman", "x", "plant_year")


@query(f"WITH {PRE}, r AS (SELECT y_true <> y_pred AS wrong, {MEAN_RANK.format(v='plant_year')} AS r FROM pre WHERE plant_year IS NOT NULL), o AS (SELECT count(*) AS n, count(*) FILTER (WHERE wrong) AS n1, count(*) FILTER (WHERE NOT wrong) AS n2, sum(r) FILTER (WHERE wrong) AS s FROM r) SELECT 'mann_whitney' AS kind, n, {R('s - n1 * (n1 + 1) / 2.0')} AS statistic, {R('2 * (s - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1')} AS effect FROM o")
def ev16_mann_whitney(spark, d):
    return tested(spark, d, "mann_whitney", "plant_year", "wrong")


CURVE = [0.1, 0.25, 0.5, 1.0]
NESTED = f"{PRE}, pos AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY id) / count(*) OVER (PARTITION BY y_true) AS p FROM pre), cur AS (SELECT * FROM pos CROSS JOIN (SELECT unnest([0.1, 0.25, 0.5, 1.0]) AS fraction) WHERE p <= fraction)"


def curves(spark, d):
    from geotally.operators.splits import stratified_fractions

    p = stratified_fractions(predictions(spark, d), "y_true", CURVE, "id", None)
    return p.select("*", F.explode(F.array(*map(F.lit, CURVE))).alias("fraction")).where(F.col("min_fraction") <= F.col("fraction"))


@query(f"WITH {NESTED}, {per_class('cur', 'fraction')}, m AS (SELECT CAST(k AS DOUBLE) AS x, sum(f * support) / sum(support) AS y FROM pc GROUP BY k), fit AS (SELECT exp(regr_intercept(ln(y), ln(x))) AS a, regr_slope(ln(y), ln(x)) AS b, avg(y) AS m FROM m) SELECT {R('a')} AS a, {R('b')} AS b, {R('1 - (SELECT sum(pow(y - a * pow(x, b), 2)) / sum(pow(y - fit.m, 2)) FROM m)', 5)} AS r2 FROM fit")
def ev17_power_law(spark, d):
    m = evaluate.metrics(curves(spark, d), ["fraction"])
    p = evaluate.power_law(m, "fraction", "f1")
    return p.select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("r2", 5).alias("r2"))


@query(f"WITH {NESTED}, {per_class('cur', 'fraction')} SELECT a.label, CAST(min(CASE WHEN a.f >= 0.97 * s.f THEN a.k END) AS DOUBLE) AS fraction FROM pc a JOIN pc s ON s.label = a.label AND s.k = 1.0 GROUP BY a.label")
def ev18_recovery_fraction(spark, d):
    m = evaluate.per_class_metrics(curves(spark, d), ["fraction"])
    return evaluate.recovery_fraction(m, m.where("fraction = 1.0").select("label", "f1"), 0.97)


@query(f"WITH {TWO} SELECT s.label, {R('s.f')} AS f1_source, {R('t.f')} AS f1_target, s.label IN (1, 4) AS flag, {R('s.label / 3.0 + 0.5')} AS mean_jm, {R('s.f - t.f')} AS gap FROM pc s LEFT JOIN pc t ON s.label = t.label AND t.k = 'target' WHERE s.k = 'source'")
def ev19_class_summary(spark, d):
    p = predictions(spark, d)
    labels = p.select(F.col("y_true").alias("label")).distinct()
    flags = labels.select("label", F.col("label").isin(1, 4).alias("flag"))
    jm = labels.select("label", F.explode(F.array(F.col("label") / 3.0, F.col("label") / 3.0 + 1)).alias("jm"))
    return rounded(evaluate.class_summary(*(evaluate.per_class_metrics(p.where(F.col("city") == c)) for c in ("source", "target")), flags, jm))
