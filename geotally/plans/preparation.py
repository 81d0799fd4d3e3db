"""Queries: sources, projections, filters, series cleaning, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotally.operators import prep, series, stats, validate
from geotally.plans.bindings import BASES, FEATURES, MONTHS, PTS, SER, WID, WIDE, R, cells, cells_sql, points, rounded, table, wide
from geotally.plans.registry import query
from geotally.sources import io

CUSTOMER = {"tree_id": "c_custkey", "genus_latin": "c_mktsegment", "species_latin": "c_name", "plant_year": "substr(c_name, 15, 4)", "height_m": "c_acctbal", "tree_type": "c_mktsegment"}
SUPPLIER = {"tree_id": "s_suppkey", "species_latin": "s_name", "genus_latin": "concat(' ', s_name, ' ')", "height_m": "s_acctbal"}


def cadastre(spark, d):
    return prep.harmonize(table(spark, d, "customer"), CUSTOMER, " Berlin ").unionByName(prep.harmonize(table(spark, d, "supplier"), SUPPLIER, "Leipzig"))


CAD = """cad AS (
 SELECT CAST(c_custkey AS VARCHAR) AS tree_id, 'berlin' AS city, nullif(upper(trim(c_mktsegment)), '') AS genus_latin, lower(c_name) AS species_latin, CAST(NULL AS VARCHAR) AS genus_german, CAST(NULL AS VARCHAR) AS species_german,
        TRY_CAST(substr(c_name, 15, 4) AS INTEGER) AS plant_year, c_acctbal AS height_m, c_mktsegment AS tree_type, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y FROM customer
 UNION ALL
 SELECT CAST(s_suppkey AS VARCHAR), 'leipzig', nullif(upper(trim(' ' || s_name || ' ')), ''), lower(s_name), NULL, NULL, NULL, s_acctbal, NULL, NULL, NULL FROM supplier)"""


@query(f"WITH {PTS} SELECT id, city, {R('x')} AS x, {R('y')} AS y, CASE WHEN id % 2 = 0 THEN 'train' ELSE 'test' END AS split, id % 3 = 0 AS filtered FROM pts")
def io4_geometry_lookup(spark, d):
    p = points(spark, d).withColumns({"split": F.when(F.col("id") % 2 == 0, "train").otherwise("test"), "variant": F.when(F.col("id") % 3 == 0, "s_filtered").otherwise("s")})
    return rounded(io.geometry_lookup(p, "split", "variant", "id"))


@query("SELECT 'customer' AS source_layer, CAST(c_custkey AS BIGINT) AS key, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def io6_raw_layers(spark, d):
    layers = {"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")), "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"))}
    return prep.union_layers(layers).select("source_layer", "key", "bal", "segment")


@query(f"WITH {CAD} SELECT * REPLACE (CAST(plant_year AS DOUBLE) AS plant_year) FROM cad")
def pr1_harmonize(spark, d):
    return cadastre(spark, d).withColumn("plant_year", F.col("plant_year").cast("double"))


@query("SELECT p_partkey AS id, nullif(upper(trim(p_type)), '') AS genus FROM part")
def pr2_normalize_genus(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), prep.normalize_genus(F.col("p_type")).alias("genus"))


@query("SELECT p_partkey AS id, nullif(lower(CASE WHEN contains(p_type || ' ' || p_name, ' ') AND regexp_matches(p_type, '^[A-Z]') THEN array_to_string(string_split_regex(trim(p_type || ' ' || p_name), '\\s+')[2:], ' ') ELSE array_to_string(string_split_regex(trim(p_type || ' ' || p_name), '\\s+'), ' ') END), '') AS species FROM part")
def pr3_normalize_species(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), prep.normalize_species(F.concat_ws(" ", "p_type", "p_name")).alias("species"))


@query("SELECT n_nationkey AS id, lower(trim('  ' || n_name || ' ')) AS city FROM nation")
def pr4_normalize_city(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), prep.normalize_city(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("city"))


@query(f"WITH {PTS} SELECT id, {R('x')} AS x, {R('y')} AS y FROM pts")
def pr5_multipoint_to_point(spark, d):
    p = points(spark, d).select("id", F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))).alias("coords"), F.when(F.col("id") % 2 == 0, "Point").otherwise("MultiPoint").alias("kind"))
    return rounded(prep.multipoint_to_point(p, "coords", "kind").select("id", "x", "y"))


@query(f"WITH {PTS} SELECT id, cls, coalesce(upper(cls) IN ('G1', 'G7'), false) AS is_conifer FROM pts")
def pr6_class_group(spark, d):
    return prep.add_class_group(points(spark, d), ["g1", "G7"], "cls").select("id", "cls", "is_conifer")


@query(f"WITH {WID} SELECT id, city, {R('CHM_1m')} AS CHM_1m, " + ", ".join(f"{R(f'{b}_{m:02d}')} AS {b}_{m:02d}" for m in (3, 5) for b in BASES) + " FROM wid")
def pr7_select_months(spark, d):
    return rounded(prep.select_months(wide(spark, d), [5, 3], BASES, ["id", "city"]))


@query(f"WITH {PTS} SELECT id, " + ", ".join(f"{R(f)} AS {f}" for f in FEATURES if f not in ("f01", "f05")) + " FROM pts")
def pr8_drop_redundant(spark, d):
    return rounded(prep.drop_redundant(points(spark, d), ["f01", "f05", "x", "unknown"]).select("id", *(f for f in FEATURES if f not in ("f01", "f05"))))


@query(f"WITH {PTS} SELECT id, city, CAST(plant_year AS DOUBLE) AS plant_year, {R('f02')} AS f02, {R('f07')} AS f07 FROM pts")
def pr9_select_features(spark, d):
    return rounded(prep.select_features(points(spark, d), ["f02", "f07"], ["id", "city", "plant_year"]).withColumn("plant_year", F.col("plant_year").cast("double")))


@query(f"WITH {PTS} SELECT id, {R('CHM_1m', 4)} AS CHM_1m FROM pts")
def pr12_height_strategy(spark, d):
    p = points(spark, d).withColumns({"CHM_1m_zscore": F.lit(0.0), "CHM_1m_percentile": F.lit(1.0)})
    return rounded(prep.height_strategy(p, "raw_chm").select("id", *(c for c in prep.HEIGHT if c in prep.height_strategy(p, "raw_chm").columns)), 4)


STRATEGIES = {"no_chm": "", "zscore_only": "CHM_1m_zscore", "percentile_only": "CHM_1m_percentile", "both_engineered": "CHM_1m_zscore,CHM_1m_percentile", "raw_chm": "CHM_1m"}


@query(f"WITH {PTS} SELECT strategy, count(*) AS n, kept FROM pts, (VALUES {', '.join(map(str, STRATEGIES.items()))}) AS s(strategy, kept) GROUP BY strategy, kept")
def pr12_every_height_strategy(spark, d):
    p = points(spark, d).withColumns({"CHM_1m_zscore": F.lit(0.0), "CHM_1m_percentile": F.lit(1.0)})
    out = None
    for k in STRATEGIES:
        part = prep.height_strategy(p, k)
        part = part.agg(F.lit(k).alias("strategy"), F.count("*").alias("n"), F.lit(",".join(c for c in prep.HEIGHT if c in part.columns)).alias("kept"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderkey AS o_orderkey, o_custkey AS o_custkey, CAST(o_totalprice AS FLOAT) > 1000 AS big FROM orders")
def pr15_downcast(spark, d):
    o = prep.downcast(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    return o.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), (F.col("o_totalprice") > 1000).alias("big"))


MAPPING = "(VALUES ('G1', 'A', 'Alder'), ('G2', 'A', 'Alder'), ('G3', 'B', 'Birch'), ('G4', 'C', NULL)) AS m(cls, final_class, display_name)"


def mapping(spark):
    return spark.createDataFrame([("G1", "A", "Alder"), ("G2", "A", "Alder"), ("G3", "B", "Birch"), ("G4", "C", None)], "cls string, final_class string, display_name string")


@query(f"WITH {PTS} SELECT id, final_class AS cls, display_name FROM pts JOIN {MAPPING} USING (cls)")
def pr16_remap_labels(spark, d):
    return prep.remap_labels(points(spark, d), mapping(spark), "cls").select("id", "cls", "display_name")


@query(f"WITH {PTS} SELECT id, final_class AS cls, coalesce(display_name, 'Cedar') AS display_name FROM pts JOIN {MAPPING} USING (cls)")
def pr17_fill_from_map(spark, d):
    return prep.fill_from_map(prep.remap_labels(points(spark, d), mapping(spark), "cls"), {"A": "Alder", "B": "Birch", "C": "Cedar"}, "cls", "display_name").select("id", "cls", "display_name")


@query(f"WITH {PTS}, k AS (SELECT cls, CAST(row_number() OVER (ORDER BY cls) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT cls FROM pts)) SELECT id, cls, label_idx FROM pts JOIN k USING (cls)")
def pr18_encode_labels(spark, d):
    return prep.encode_labels(points(spark, d), "cls").select("id", "cls", "label_idx")


@query(f"WITH {PTS}, fl AS (SELECT DISTINCT cls, cls IN ('G1', 'G4') AS is_conifer FROM pts) SELECT final_class, coalesce(bool_or(is_conifer), false) AS is_conifer FROM {MAPPING} LEFT JOIN fl USING (cls) GROUP BY final_class")
def pr20_merged_group_flag(spark, d):
    flags = prep.add_class_group(points(spark, d).select("cls").distinct(), ["G1", "G4"], "cls")
    return prep.merged_group_flag(mapping(spark), flags, "cls", "is_conifer")


@query(f"WITH {PTS} SELECT id, cls FROM pts WHERE cls IN ('G2', 'G5', 'G8')")
def fl1_filter_classes(spark, d):
    return prep.filter_classes(points(spark, d), ["G2", "G5", "G8"], "cls").select("id", "cls")


@query(f"WITH {PTS} SELECT id, CAST(plant_year AS DOUBLE) AS plant_year FROM pts WHERE plant_year <= 1990 OR plant_year IS NULL")
def fl2_filter_max_year(spark, d):
    return prep.filter_max_year(points(spark, d), 1990).select("id", F.col("plant_year").cast("double"))


@query(f"WITH {PTS}, n AS (SELECT cls, city, count(*) AS n FROM pts GROUP BY ALL), v AS (SELECT cls FROM n GROUP BY cls HAVING count(*) FILTER (WHERE n >= 10) = (SELECT count(DISTINCT city) FROM pts)) SELECT id, city, cls FROM pts WHERE cls IN (SELECT cls FROM v)")
def fl3_viable_classes(spark, d):
    return prep.filter_viable_classes(points(spark, d), 10, "cls").select("id", "city", "cls")


@query(f"WITH {PTS} SELECT id, city, cls FROM pts QUALIFY count(*) OVER (PARTITION BY city, cls) >= 12")
def fl4_viable_per_city(spark, d):
    return prep.filter_viable_per_city(points(spark, d), 12, "cls").select("id", "city", "cls")


GAPS = f"""grid AS (SELECT e.id, b.base, m.month, v FROM (SELECT DISTINCT id FROM ser) e CROSS JOIN (SELECT DISTINCT base FROM ser) b CROSS JOIN (SELECT unnest(range(1, 9)) AS month) m LEFT JOIN ser s ON s.id = e.id AND s.base = b.base AND s.month = m.month),
 k AS (SELECT id, base, count(v) AS n, min(month) FILTER (WHERE v IS NOT NULL) AS a, max(month) FILTER (WHERE v IS NOT NULL) AS z FROM grid GROUP BY ALL),
 good AS (SELECT id FROM k GROUP BY id HAVING bool_and(coalesce(8 - n <= 3 AND n >= 2 AND greatest(a - 1, 8 - z) <= 2, false)))"""


@query(f"WITH {SER}, {GAPS} SELECT id FROM good")
def fl5_gappy_series(spark, d):
    return series.filter_gappy_series(wide(spark, d), MONTHS, 3, 2).select("id")


@query(f"WITH {WID} SELECT id FROM wid WHERE greatest(" + ", ".join(f"click_{m:02d}" for m in MONTHS) + ") >= 60")
def fl6_plausible_max(spark, d):
    return prep.filter_plausible_max(wide(spark, d), [f"click_{m:02d}" for m in MONTHS], 60).select("id")


@query(f"WITH {PTS} SELECT id, CASE WHEN id % 9 = 0 THEN 'high' WHEN id % 5 = 0 THEN 'medium' WHEN id % 2 = 0 THEN 'low' ELSE 'none' END AS outlier_severity FROM pts WHERE id % 9 <> 0 AND id % 5 <> 0")
def fl7_outlier_severity(spark, d):
    i = F.col("id")
    s = F.when(i % 9 == 0, "high").when(i % 5 == 0, "medium").when(i % 2 == 0, "low").otherwise("none")
    return prep.filter_outlier_severity(points(spark, d).withColumn("outlier_severity", s), "remove_high_medium").select("id", "outlier_severity")


@query(f"WITH {cells_sql('c', 'avg(l_quantity) - 23')} SELECT city, col, row, CASE WHEN value < -2 THEN 0 WHEN value > 5 THEN NULL ELSE {R('value')} END AS value FROM c")
def fl8_value_range(spark, d):
    return rounded(cells(spark, d, "avg(l_quantity) - 23").withColumn("value", prep.filter_value_range(F.col("value"), -2, 5)))


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(l_extendedprice - 20000, 10000)) AS b FROM lineitem WHERE l_linenumber IN (4, 5)")
def fl9_mask_clamp(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 20000).alias("b"))
    return prep.mask_and_clamp(li, ["b"], "l_linenumber")


@query("SELECT c_custkey, 't_' || lpad(CAST(c_custkey % 400 AS VARCHAR), 3, '0') || '_' || lpad(CAST(c_custkey % 7000 AS VARCHAR), 4, '0') AS tile FROM customer WHERE c_custkey % 400 < 120 AND c_custkey % 400 >= 50 AND c_custkey % 7000 < 900")
def fl10_prune_tiles(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select("c_custkey", F.concat_ws("_", F.lit("t"), F.lpad((k % 400).cast("string"), 3, "0"), F.lpad((k % 7000).cast("string"), 4, "0")).alias("tile"))
    return prep.prune_tiles(t, "tile", 50_000.0, -10.0, 120_000.0, 900_000.0)


@query("SELECT p_brand, n, CASE WHEN price > 1400 THEN 'high' WHEN n > 10 THEN 'many' ELSE 'other' END AS decision, CASE WHEN price > 1400 THEN 'price > 1400' WHEN n > 10 THEN 'n > 10' ELSE 'no rule' END AS reason FROM (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS price FROM part GROUP BY p_brand)")
def ab5_rule_table(spark, d):
    m = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("price"))
    return prep.rule_table(m, [("price > 1400", "high"), ("n > 10", "many")], "other").select("p_brand", "n", "decision", "reason")


@query(f"WITH {WID} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, {R(f'(count(*) - count({c})) * 100.0 / count(*)')} AS pct_missing FROM wid" for c in WIDE))
def ts1_missing_profile(spark, d):
    return rounded(series.missing_profile(wide(spark, d), WIDE))


#: Filled values of the long grid: neighbours by position, edges up to two.
FILL = """nb AS (SELECT *, last_value(v IGNORE NULLS) OVER l AS lv, last_value(CASE WHEN v IS NOT NULL THEN month END IGNORE NULLS) OVER l AS lm,
   first_value(v IGNORE NULLS) OVER r AS rv, first_value(CASE WHEN v IS NOT NULL THEN month END IGNORE NULLS) OVER r AS rm,
   min(CASE WHEN v IS NOT NULL THEN month END) OVER w AS a, max(CASE WHEN v IS NOT NULL THEN month END) OVER w AS z FROM grid
   WINDOW l AS (PARTITION BY id, base ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY id, base ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), w AS (PARTITION BY id, base)),
 filled AS (SELECT id, base, month, CASE WHEN v IS NOT NULL THEN v WHEN lv IS NOT NULL AND rv IS NOT NULL THEN lv + (rv - lv) * (month - lm) / (rm - lm) WHEN lv IS NULL AND a - 1 <= 2 THEN rv WHEN rv IS NULL AND 8 - z <= 2 THEN lv END AS v FROM nb)"""
UNPIVOT = [c for c in WIDE]


@query(f"WITH {SER}, {GAPS}, {FILL} SELECT id, base, month, {R('v')} AS v FROM filled")
def ts2_interpolate(spark, d):
    w = series.interpolate_within_entity(wide(spark, d), MONTHS, 2)
    long = w.unpivot(["id"], UNPIVOT, "name", "v")
    return rounded(long.select("id", F.substring_index("name", "_", 1).alias("base"), F.substring_index("name", "_", -1).cast("int").alias("month"), "v"))


@query(f"WITH {WID} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'count({c}) / CAST(count(*) AS DOUBLE)')} AS completeness, count(*) AS n_rows, count(*) FILTER (WHERE id % 4 = 0) AS n_corrected FROM wid" for c in WIDE[:10]))
def ts5_completeness(spark, d):
    return rounded(series.completeness(wide(spark, d).withColumn("moved", F.col("id") % 4 == 0), WIDE[:10], "moved"))


def scores_sql(source: str, value: str, least: int, keys: str = "city, cls") -> str:
    """Common table expressions that end in ``scored``: z and p with the city as fallback."""
    def one(part: str, n: str) -> str:
        return (f"CASE WHEN stddev_samp({value}) OVER ({part}) > 0 THEN ({value} - avg({value}) OVER ({part})) / stddev_samp({value}) OVER ({part}) ELSE 0 END AS z{n}, "
                f"CASE WHEN {value} IS NOT NULL THEN (rank() OVER ({part}, {value} IS NULL ORDER BY {value}) + cume_dist() OVER ({part}, {value} IS NULL ORDER BY {value}) * count({value}) OVER ({part})) * 50.0 / count({value}) OVER ({part}) END AS p{n}")  # fmt: skip

    return f"sc AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS nn, {one('PARTITION BY city, cls', '1')}, {one('PARTITION BY city', '2')} FROM {source}), scored AS (SELECT *, CASE WHEN nn < {least} THEN z2 ELSE z1 END AS z, CASE WHEN nn < {least} THEN p2 ELSE p1 END AS p FROM sc)"


CLEAN = "w2 AS (SELECT e.*, w.CHM_1m, CASE WHEN e.id % 2 = 0 THEN 'source' ELSE 'target' END AS city, 'G' || CAST(e.id % 3 AS VARCHAR) AS cls FROM (SELECT id, " + ", ".join(f"max(CASE WHEN base = '{b}' AND month = {m} THEN v END) AS {b}_{m:02d}" for m in MONTHS for b in BASES) + " FROM filled WHERE id IN (SELECT id FROM good) GROUP BY id) e JOIN (SELECT id, avg(v) AS CHM_1m FROM ser GROUP BY id) w USING (id))"


@query(f"WITH {SER}, {GAPS}, {FILL}, {CLEAN}, {scores_sql('w2', 'CHM_1m', 10)} SELECT id, city, cls, {R('CHM_1m')} AS CHM_1m, " + ", ".join(f"{R(c)} AS {c}" for c in WIDE) + f", {R('z')} AS CHM_1m_zscore, {R('p')} AS CHM_1m_percentile FROM scored WHERE greatest(" + ", ".join(f"click_{m:02d}" for m in MONTHS) + ") >= 60")
def ts4_quality_pipeline(spark, d):
    return rounded(series.quality_pipeline(wide(spark, d), MONTHS, BASES, ["id", "city", "cls"], "click", "cls", least_value=60, max_missing=3, max_edge=2))


@query(f"WITH {PTS}, {scores_sql('pts', 'CHM_1m', 10)} SELECT id, {R('z')} AS CHM_1m_zscore FROM scored")
def st1_group_zscore_fallback(spark, d):
    return rounded(stats.group_scores_with_fallback(points(spark, d), "CHM_1m", "cls").select("id", "CHM_1m_zscore"))


@query(f"WITH {PTS}, {scores_sql('pts', 'CHM_1m', 10)} SELECT id, {R('p')} AS CHM_1m_percentile FROM scored")
def st2_group_percentile_fallback(spark, d):
    return rounded(stats.group_scores_with_fallback(points(spark, d), "CHM_1m", "cls").select("id", "CHM_1m_percentile"))


@query(f"WITH {CAD} SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS n_missing FROM cad")
def va2_null_geometry(spark, d):
    return validate.null_geometry(cadastre(spark, d))


@query(f"WITH {CAD}, {PTS} SELECT CAST(1 AS BIGINT) AS n_valid, CAST(1 AS BIGINT) AS n_invalid, false AS all_valid FROM (SELECT count(*) FROM cad), (SELECT count(*) FROM pts)")
def va3_report(spark, d):
    return validate.report([validate.validate_dataset("cadastre", cadastre(spark, d), prep.POINT_SCHEMA), validate.validate_dataset("points", points(spark, d), {"id": "bigint", "x": "double"})])


@query(f"WITH {CAD} SELECT city, CASE WHEN city = 'berlin' THEN 'c' ELSE 's' END AS source_layer, count(*) AS n_rows, count(genus_latin) AS n_genus, count(DISTINCT genus_latin) AS n_classes FROM cad GROUP BY city")
def st22_cadastre_summary(spark, d):
    c = cadastre(spark, d).withColumn("source_layer", F.when(F.col("city") == "berlin", "c").otherwise("s"))
    return stats.cadastre_summary(c, "source_layer")
