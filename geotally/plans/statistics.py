"""Queries: grouped statistics, outliers, splits and samples."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from geotally.operators import outliers, splits, stats
from geotally.plans.bindings import BASES, ENTITY, FEATURES, PTS, SER, R, entity, points, rounded, series
from geotally.plans.registry import query

SOME = FEATURES[:4]
AVG_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0"


@query(f"WITH {PTS}, r AS (SELECT id, CASE WHEN stddev_samp(CHM_1m) OVER w > 0 THEN (CHM_1m - avg(CHM_1m) OVER w) / stddev_samp(CHM_1m) OVER w ELSE 0 END AS z, ({AVG_RANK.format(k='cls', v='CHM_1m')}) * 100.0 / count(*) OVER w AS p FROM pts WHERE CHM_1m IS NOT NULL WINDOW w AS (PARTITION BY cls)) SELECT id, {R('z')} AS zscore, {R('p')} AS pct_rank FROM r")
def st3_group_scores(spark, d):
    return rounded(stats.group_scores(points(spark, d), "CHM_1m", ["cls"]).select("id", "zscore", "pct_rank"))


@query(f"WITH {PTS}, g AS (SELECT avg(CHM_1m) AS m, sum(pow(CHM_1m - (SELECT avg(CHM_1m) FROM pts), 2)) AS t FROM pts), c AS (SELECT cls, count(CHM_1m) AS n, avg(CHM_1m) AS m FROM pts GROUP BY cls) SELECT {R('sum(CASE WHEN c.n >= 20 THEN c.n * pow(c.m - g.m, 2) END) / max(g.t)')} AS eta_squared FROM c, g")
def st4_eta_squared(spark, d):
    return rounded(stats.eta_squared(points(spark, d), "CHM_1m", "cls", 20))


@query()
def st5_welch_anova(spark, d):
    r = stats.welch_anova(points(spark, d), "CHM_1m", "cls")
    return spark.createDataFrame([(r["statistic"], r["pvalue"])], "statistic double, pvalue double")


@query(f"WITH {PTS}, c AS (SELECT cls, city, count(CHM_1m) AS n, avg(CHM_1m) AS m, var_samp(CHM_1m) AS v FROM pts GROUP BY ALL) SELECT s.cls, {R('(s.m - t.m) / sqrt(((s.n - 1) * s.v + (t.n - 1) * t.v) / (s.n + t.n - 2))')} AS d FROM c s JOIN c t ON s.cls = t.cls AND s.city = 'source' AND t.city = 'target' AND s.n > 1 AND t.n > 1")
def st6_cohens_d(spark, d):
    return rounded(stats.cohens_d(points(spark, d), "CHM_1m", "cls", "city", "source", "target"))


@query(f"WITH {PTS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS r FROM pts" for a, b in combinations([*SOME, "CHM_1m"], 2)))
def st8_correlations(spark, d):
    return rounded(stats.correlations(points(spark, d), [*SOME, "CHM_1m"]))


ZW = f"{SER}, z AS (SELECT *, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z FROM ser WINDOW w AS (PARTITION BY base, month)), zw AS (SELECT id, month, {', '.join(f'''max(CASE WHEN base = '{b}' THEN coalesce(z, 0) END) AS {b}''' for b in BASES)} FROM z GROUP BY ALL)"


@query(f"WITH {ZW} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS r FROM zw" for a, b in combinations(BASES, 2)))
def st9_base_correlations(spark, d):
    return rounded(stats.base_correlations(series(spark, d), BASES))


@query(f"WITH {PTS}, r AS (SELECT city, {AVG_RANK.format(k='city', v='f01')} AS a, {AVG_RANK.format(k='city', v='f02')} AS b FROM pts) SELECT city, {R('corr(a, b)')} AS rho FROM r GROUP BY city")
def st10_spearman(spark, d):
    return rounded(stats.spearman(points(spark, d), "f01", "f02", ["city"]))


@query(f"WITH {PTS}, r AS (SELECT {AVG_RANK.format(k='1', v='CHM_1m')} AS a, {AVG_RANK.format(k='1', v='f02')} AS b FROM pts WHERE CHM_1m IS NOT NULL) SELECT {R('corr(a, b)')} AS rho FROM r")
def st10_spearman_overall(spark, d):
    return rounded(stats.spearman(points(spark, d), "CHM_1m", "f02"))


@query(f"WITH {PTS}, k AS (SELECT DISTINCT cls AS k FROM pts) " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {R('avg(abs(r))')} AS mean_abs_corr FROM (SELECT k, corr({f}, CASE WHEN cls = k THEN 1.0 ELSE 0.0 END) AS r FROM pts CROSS JOIN k GROUP BY k)" for f in SOME))
def st11_target_correlation(spark, d):
    return rounded(stats.target_correlation(points(spark, d), SOME, "cls"))


PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM pts" for a, b in combinations(SOME, 2))


@query(f"WITH {PTS}, p AS ({PAIRS}), i(feature, importance) AS (VALUES ('f01', 0.1), ('f02', 0.5), ('f03', 0.2)) SELECT p.a, p.b, {R('p.r')} AS r, CASE WHEN coalesce(ib.importance, 0) > coalesce(ia.importance, 0) THEN p.a ELSE p.b END AS drop FROM p LEFT JOIN i ia ON ia.feature = p.a LEFT JOIN i ib ON ib.feature = p.b WHERE abs(p.r) > 0.01")
def st12_redundant_pairs(spark, d):
    importance = spark.createDataFrame([("f01", 0.1), ("f02", 0.5), ("f03", 0.2)], "feature string, importance double")
    return rounded(stats.redundant_pairs(stats.correlations(points(spark, d), SOME), 0.01, importance))


@query()
def st13_redundancy_consensus(spark, d):
    p = points(spark, d)
    pair = [stats.correlations(p.where(F.col("city") == c), FEATURES) for c in ("source", "target")]
    gone = stats.redundancy_consensus(*pair, preference={f: i for i, f in enumerate(FEATURES)}, threshold=0.01)
    return spark.createDataFrame([(g,) for g in gone], "feature string")


@query()
def st14_vif(spark, d):
    return rounded(spark.createDataFrame(list(stats.vif(points(spark, d), FEATURES).items()), "feature string, vif double"))


def jm_sql(spread: str) -> str:
    return f"""{SER}, e AS (SELECT *, {ENTITY} FROM ser), k AS (SELECT city, base, month, cls, avg(v) AS m, greatest(1e-6, {spread}(v)) AS s, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 10),
 j AS (SELECT a.city, a.month, a.cls AS class_a, b.cls AS class_b, avg(greatest(0, least(2, 2 * (1 - exp(-(pow(a.m - b.m, 2) / (8 * ((a.s + b.s) / 2)) + 0.5 * ln(((a.s + b.s) / 2) / sqrt(a.s * b.s)))))))) AS jm FROM k a JOIN k b ON a.city = b.city AND a.base = b.base AND a.month = b.month AND a.cls < b.cls GROUP BY ALL)"""


@query(f"WITH {jm_sql('stddev_samp')} SELECT city, month, class_a, class_b, {R('jm')} AS jm FROM j")
def st15_jm_univariate(spark, d):
    return rounded(stats.jm_univariate(entity(series(spark, d)), 10))


@query(f"WITH {jm_sql('var_samp')} SELECT city, month, class_a, class_b, {R('jm')} AS jm FROM j")
def st15_jm_univariate_variance(spark, d):
    return rounded(stats.jm_univariate(entity(series(spark, d)), 10, "var"))


@query()
def st16_jm_multivariate(spark, d):
    found = stats.jm_multivariate(points(spark, d), SOME, "cls")
    return rounded(spark.createDataFrame([(a, b, v) for (a, b), v in found.items()], "class_a string, class_b string, jm double"))


SEASONS = {"spring": ([1, 2, 3], 1), "summer": ([4, 5, 6], 2), "autumn": ([7, 8], 1)}


@query(f"WITH {jm_sql('stddev_samp')}, m AS (SELECT month, avg(jm) AS score, CASE WHEN month <= 3 THEN 'spring' WHEN month <= 6 THEN 'summer' ELSE 'autumn' END AS season FROM j GROUP BY month), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, month) AS rank, row_number() OVER (PARTITION BY season ORDER BY score DESC, month) AS s FROM m) SELECT month, {R('score')} AS score, CAST(rank AS INTEGER) AS rank, season FROM r WHERE rank <= 4 OR s <= CASE season WHEN 'summer' THEN 2 ELSE 1 END")
def st17_month_selection(spark, d):
    return rounded(stats.month_selection(stats.jm_univariate(entity(series(spark, d)), 10), 4, SEASONS))


@query(f"WITH {SER} SELECT month, round(avg(v), 4) + 0.0 AS mean, round(stddev_samp(v), 4) + 0.0 AS std, round(min(v), 4) + 0.0 AS min, round(max(v), 4) + 0.0 AS max FROM ser GROUP BY month")
def st18_monthly_stats(spark, d):
    return stats.monthly_stats(series(spark, d), "month", "v")


@query(f"WITH {PTS}, m AS (SELECT plant_year AS y, quantile_cont(CHM_1m, 0.5) AS m FROM pts WHERE plant_year IS NOT NULL AND CHM_1m IS NOT NULL GROUP BY 1) SELECT CAST(coalesce(greatest(min(CASE WHEN m < 9.5 THEN y END) - 1, min(y)), max(y)) AS INTEGER) AS cutoff_year FROM m WHERE EXISTS (SELECT 1)")
def st19_year_cutoff(spark, d):
    return stats.year_cutoff(points(spark, d), "plant_year", "CHM_1m", 9.5)


COUNTS = "count(*) FILTER (WHERE city = 'source') AS n_source, count(*) FILTER (WHERE city = 'target') AS n_target"


@query(f"WITH {PTS} SELECT cls, {COUNTS}, count(*) AS total FROM pts GROUP BY cls")
def st20_class_inventory(spark, d):
    return stats.class_inventory(points(spark, d), "cls", "city", ["source", "target"])


@query(f"WITH {PTS} SELECT cls, {COUNTS}, count(*) AS total, least(count(*) FILTER (WHERE city = 'source'), count(*) FILTER (WHERE city = 'target')) >= 10 AS viable FROM pts GROUP BY cls")
def st21_class_count_matrix(spark, d):
    return stats.class_count_matrix(points(spark, d), "cls", "city", ["source", "target"], 10)


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 12")
def st23_top_k(spark, d):
    from geotally.plans.bindings import table

    return stats.top_k(table(spark, d, "lineitem"), "l_partkey", 12)


@query(f"WITH {PTS} SELECT cls, {R('count(*) FILTER (WHERE city = ' + chr(39) + 'source' + chr(39) + ') / count(*)')} AS p_source, {R('count(*) FILTER (WHERE city = ' + chr(39) + 'target' + chr(39) + ') / count(*)')} AS p_target FROM pts GROUP BY cls")
def st24_crosstab(spark, d):
    return rounded(stats.crosstab_normalized(points(spark, d), "cls", "city", ["source", "target"]))


def z_count(t: float) -> str:
    return " + ".join(f"CASE WHEN abs(({f} - avg({f}) OVER w) / nullif(stddev_pop({f}) OVER w, 0)) > {t} THEN 1 ELSE 0 END" for f in FEATURES)


ZF = f"zf AS (SELECT id, {z_count(1.5)} AS zc FROM pts WINDOW w AS (PARTITION BY city))"
IQ = "qs AS (SELECT cls, city, quantile_cont(CHM_1m, 0.25) AS q1, quantile_cont(CHM_1m, 0.75) AS q3 FROM pts GROUP BY ALL), qf AS (SELECT id, coalesce(CHM_1m < q1 - {m} * (q3 - q1) OR CHM_1m > q3 + {m} * (q3 - q1), false) AS f FROM pts JOIN qs USING (cls, city))"


@query(f"WITH {PTS}, {ZF} SELECT id, CAST(zc AS INTEGER) AS z_count, zc >= 3 AS outlier_zscore FROM zf")
def ou1_outlier_zscore(spark, d):
    return outliers.outlier_zscore(points(spark, d), FEATURES, threshold=1.5, least=3).select("id", "z_count", "outlier_zscore")


@query()
def ou2_outlier_mahalanobis(spark, d):
    return rounded(outliers.outlier_mahalanobis(points(spark, d), SOME, "cls", 0.01).select("id", "mahalanobis_d2", "outlier_mahalanobis"))


@query(f"WITH {PTS}, {IQ.format(m=0.8)} SELECT id, f AS outlier_iqr FROM qf")
def ou3_outlier_iqr(spark, d):
    return outliers.outlier_iqr(points(spark, d), "CHM_1m", ["cls", "city"], 0.8).select("id", "outlier_iqr")


def flagged(spark, d):
    p = outliers.outlier_iqr(outliers.outlier_zscore(points(spark, d), FEATURES, threshold=1.5, least=3), "CHM_1m", ["cls", "city"], 0.8)
    return p.withColumn("outlier_other", F.col("f01") > 0.15)


FLG = f"{PTS}, {ZF}, {IQ.format(m=0.8)}, flg AS (SELECT p.id, city, cls, plant_year, zc >= 3 AS fa, f AS fb, f01 > 0.15 AS fc FROM pts p JOIN zf USING (id) JOIN qf USING (id)), sev AS (SELECT *, CAST(fa AS INTEGER) + CAST(fb AS INTEGER) + CAST(fc AS INTEGER) AS n, ['none', 'low', 'medium', 'high'][CAST(fa AS INTEGER) + CAST(fb AS INTEGER) + CAST(fc AS INTEGER) + 1] AS outlier_severity FROM flg)"
FLAGS = ["outlier_zscore", "outlier_iqr", "outlier_other"]


@query(f"WITH {FLG} SELECT id, n AS outlier_method_count, outlier_severity FROM sev")
def ou4_consensus(spark, d):
    return outliers.consensus(flagged(spark, d), FLAGS).select("id", "outlier_method_count", "outlier_severity")


@query(f"WITH {PTS}, k AS (SELECT {', '.join(f'{z_count(t)} AS t{i}' for i, t in enumerate((1.0, 1.5, 2.0)))} FROM pts WINDOW w AS (PARTITION BY city)) " + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, {n} AS min_count, {R(f'avg(CAST(t{i} >= {n} AS INTEGER))')} AS flag_rate FROM k" for i, t in enumerate((1.0, 1.5, 2.0)) for n in (2, 4)))
def ou5_zscore_sensitivity(spark, d):
    return rounded(outliers.zscore_sensitivity(points(spark, d), FEATURES, "city", [1.0, 1.5, 2.0], [2, 4]))


@query(f"WITH {PTS}, {IQ.format(m=0.5)} " + " UNION ALL ".join(f"SELECT CAST({m} AS DOUBLE) AS multiplier, {R(f'avg(CAST(coalesce(CHM_1m < q1 - {m} * (q3 - q1) OR CHM_1m > q3 + {m} * (q3 - q1), false) AS INTEGER))')} AS flag_rate FROM pts JOIN qs USING (cls, city)" for m in (0.5, 0.8, 1.5)))
def ou5_iqr_sensitivity(spark, d):
    return rounded(outliers.iqr_sensitivity(points(spark, d), "CHM_1m", ["cls", "city"], [0.5, 0.8, 1.5]))


@query(f"WITH {FLG} " + " UNION ALL ".join(f"SELECT '{k}' AS methods, count(*) FILTER (WHERE {c}) AS n FROM flg" for k, c in {"a": "fa AND NOT fb AND NOT fc", "b": "fb AND NOT fa AND NOT fc", "c": "fc AND NOT fa AND NOT fb", "ab": "fa AND fb AND NOT fc", "ac": "fa AND fc AND NOT fb", "bc": "fb AND fc AND NOT fa", "abc": "fa AND fb AND fc"}.items()))
def ou6_method_overlap(spark, d):
    return outliers.method_overlap(flagged(spark, d), *FLAGS)


@query(f"WITH {FLG}, r AS (SELECT cls, count(*) AS n, avg(CAST(fa OR fb OR fc AS INTEGER)) AS rate FROM flg GROUP BY cls) SELECT cls, n, {R('rate')} AS flag_rate, rate > 2 * (SELECT avg(rate) FROM r) AS high FROM r")
def ou7_flag_rate(spark, d):
    return rounded(outliers.flag_rate_by_group(flagged(spark, d), FLAGS, "cls"))


@query(f"WITH {FLG} SELECT outlier_severity, city, count(*) AS n FROM sev GROUP BY ROLLUP (outlier_severity, city) HAVING outlier_severity IS NOT NULL")
def ou7_severity_by_city(spark, d):
    return outliers.severity_by_city(outliers.consensus(flagged(spark, d), FLAGS))


@query(f"WITH {FLG}, r AS (SELECT fa, {AVG_RANK.format(k='1', v='plant_year')} AS r, count(*) OVER (PARTITION BY plant_year) AS t FROM flg WHERE plant_year IS NOT NULL), o AS (SELECT CAST(count(*) FILTER (WHERE fa) AS BIGINT) AS n1, CAST(count(*) FILTER (WHERE NOT fa) AS BIGINT) AS n2, sum(r) FILTER (WHERE fa) AS s, sum(t * t - 1) AS ties FROM r) SELECT n1, n2, {R('s - n1 * (n1 + 1) / 2.0')} AS u, {R('(s - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))))')} AS z FROM o")
def ou8_mann_whitney(spark, d):
    return rounded(outliers.mann_whitney(flagged(spark, d), "plant_year", "outlier_zscore"))


# splits and samples


def blocked(spark, d):
    from geotally.operators.spatial import spatial_blocks

    return spatial_blocks(points(spark, d), 150.0)


@query()
def sl1_group_folds(spark, d):
    return splits.stratified_group_folds(blocked(spark, d), "block_id", "cls", 5).groupBy("fold", "cls").agg(F.count("*").alias("n"))


@query()
def sl2_split_source(spark, d):
    return splits.split_summary(splits.split_source(blocked(spark, d).where("city = 'source'"), "block_id", "cls"), ["city", "split"], "block_id")


@query()
def sl3_split_target(spark, d):
    return splits.split_summary(splits.split_target(blocked(spark, d).where("city = 'target'"), "block_id", "cls"), ["city", "split"], "block_id")


def invariants(df, label):
    """Each class's rows, the number of labels, and whether no block has two of them."""
    shared = splits.block_overlap(df, label, "block_id").agg((F.count("*") == 0).alias("disjoint"))
    return df.groupBy("cls").agg(F.count("*").alias("n")).join(shared).join(df.agg(F.countDistinct(label).alias("n_labels")))  # one row each


def invariants_sql(where: str, labels: int) -> str:
    return f"WITH {PTS} SELECT cls, count(*) AS n, true AS disjoint, CAST({labels} AS BIGINT) AS n_labels FROM pts WHERE {where} GROUP BY cls"


@query(invariants_sql("true", 3))
def sl1_fold_invariants(spark, d):
    return invariants(splits.stratified_group_folds(blocked(spark, d), "block_id", "cls", 3), "fold")


@query(invariants_sql("city = 'source'", 3))
def sl2_source_invariants(spark, d):
    return invariants(splits.split_source(blocked(spark, d).where("city = 'source'"), "block_id", "cls"), "split")


@query(invariants_sql("city = 'target'", 2))
def sl3_target_invariants(spark, d):
    return invariants(splits.split_target(blocked(spark, d).where("city = 'target'"), "block_id", "cls"), "split")


def halves(spark, d):
    return points(spark, d).withColumns({"split": F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")), "block_id": F.col("id") % 40})


HLV = f"{PTS}, hlv AS (SELECT *, ['train', 'val', 'test'][id % 3 + 1] AS split, id % 40 AS block_id FROM pts), sn AS (SELECT s.split, c.cls, count(h.id) AS n FROM (SELECT DISTINCT split FROM hlv) s CROSS JOIN (SELECT DISTINCT cls FROM hlv) c LEFT JOIN hlv h ON h.split = s.split AND h.cls = c.cls GROUP BY ALL), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY split) AS p FROM sn)"


@query(f"WITH {HLV} SELECT a.split AS split_a, b.split AS split_b, {R('sum((a.p + 1e-12) * ln((a.p + 1e-12) / (b.p + 1e-12)))')} AS kl, (SELECT count(*) FROM (SELECT block_id FROM hlv GROUP BY block_id HAVING count(DISTINCT split) > 1)) AS n_overlap FROM sh a JOIN sh b ON a.cls = b.cls AND a.split < b.split GROUP BY ALL")
def sl4_split_validation(spark, d):
    return rounded(splits.split_validation(halves(spark, d), "split", "block_id", "cls", 9.0))


@query(f"WITH {HLV}, f AS (SELECT split, cls, CASE WHEN n = 0 THEN 1e-10 ELSE p END AS p FROM sh WHERE split IN ('train', 'test')), g AS (SELECT split, cls, p / sum(p) OVER (PARTITION BY split) AS p FROM f) SELECT {R('sum(a.p * ln(a.p / b.p))')} AS kl FROM g a JOIN g b ON a.cls = b.cls AND a.split = 'train' AND b.split = 'test'")
def sl5_kl_filled(spark, d):
    return rounded(splits.kl_filled(halves(spark, d), "split", "cls", "train", "test"))


@query(f"WITH {PTS} SELECT id, cls FROM pts QUALIFY row_number() OVER (PARTITION BY cls ORDER BY id) <= 15")
def sl6_capped_sample(spark, d):
    return splits.capped_sample_per_class(points(spark, d), "cls", 15, "id", None).select("id", "cls")


@query(f"WITH {PTS}, c AS (SELECT cls, greatest(1, CAST(round(count(*) * 120 / CAST(sum(count(*)) OVER () AS DOUBLE)) AS BIGINT)) AS q FROM pts GROUP BY cls), r AS (SELECT id, cls, row_number() OVER (PARTITION BY cls ORDER BY id) AS k FROM pts) SELECT id, r.cls FROM r JOIN c USING (cls) ORDER BY greatest(0, k - q), k, id LIMIT 120")
def sl7_stratified_subset(spark, d):
    return splits.stratified_subset_n(points(spark, d), "cls", 120, "id", None).select("id", "cls")


@query(f"WITH {PTS}, r AS (SELECT id, row_number() OVER w2 / count(*) OVER w AS p FROM pts WINDOW w AS (PARTITION BY cls), w2 AS (PARTITION BY cls ORDER BY id)) SELECT id, CAST(CASE WHEN p <= 0.1 THEN 0.1 WHEN p <= 0.25 THEN 0.25 WHEN p <= 0.5 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS min_fraction FROM r")
def sl8_stratified_fractions(spark, d):
    return splits.stratified_fractions(points(spark, d), "cls", [0.1, 0.25, 0.5, 1.0], "id", None).select("id", "min_fraction")


@query(f"WITH {PTS} SELECT id, city FROM pts ORDER BY id LIMIT 77")
def sl9_random_sample(spark, d):
    return splits.random_sample_n(points(spark, d), 77, "id", None).select("id", "city")


@query(f"WITH {PTS} SELECT id, row_number() OVER (PARTITION BY cls ORDER BY id) / count(*) OVER (PARTITION BY cls) <= 0.1 AS held_out FROM pts")
def sl12_stratified_holdout(spark, d):
    return splits.stratified_holdout(points(spark, d), "cls", 0.1, "id", None).select("id", "held_out")


@query(f"WITH {HLV}, b AS (SELECT DISTINCT block_id FROM hlv ORDER BY block_id LIMIT 8) SELECT id, block_id IN (SELECT block_id FROM b) AS held_out FROM hlv")
def sl14_group_holdout(spark, d):
    return splits.group_holdout(halves(spark, d), "block_id", 0.2, None).select("id", "held_out")


@query(f"WITH {HLV} SELECT city, split, count(*) AS n_rows, count(DISTINCT block_id) AS n_blocks FROM hlv GROUP BY ALL")
def sl13_split_summary(spark, d):
    return splits.split_summary(halves(spark, d), ["city", "split"], "block_id")


@query(f"WITH {PTS} SELECT city, cls, count(*) AS n FROM pts GROUP BY ALL")
def sl13_class_distribution(spark, d):
    return splits.class_distribution(points(spark, d), "city", "cls")


@query()
def sl11_final_preparation(spark, d):
    p = splits.final_preparation(points(spark, d), SOME, "cls", block_size=150.0, threshold=5.0)
    return p.groupBy("city", "split", "filtered", "outlier_severity").agg(F.count("*").alias("n"))


@query(f"WITH {FLG} SELECT id, city, {R('CAST(CAST(f01 AS FLOAT) AS DOUBLE)', 4)} AS f01, {R('CAST(CAST(f02 AS FLOAT) AS DOUBLE)', 4)} AS f02 FROM sev JOIN pts USING (id, city) WHERE id % 4 <> 0 AND id % 3 <> 0 AND outlier_severity <> 'high'")
def sl10_prepare_dataset(spark, d):
    i = F.col("id")
    p = outliers.consensus(flagged(spark, d), FLAGS).withColumns({"split": F.when(i % 4 == 0, "test").otherwise("train"), "filtered": i % 3 != 0})
    out, _ = splits.prepare_dataset(p, "train", "filtered", "remove_high", "no_chm", ["f01", "f02"], ["id", "city"])
    return out.select(F.col("id").cast("long").alias("id"), "city", *(F.round(F.col(f).cast("double"), 4).alias(f) for f in ("f01", "f02")))
