"""Queries: cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotally.operators import prep, raster
from geotally.plans.bindings import BANDS, OBS, R, cells, cells_sql, observations, rounded, table
from geotally.plans.registry import query

TERRAIN = "avg(l_discount) * 100"


@query(f"WITH {cells_sql('s')}, {cells_sql('t', TERRAIN)} SELECT city, col, row, {R('s.value - t.value')} AS value FROM s FULL JOIN t USING (city, col, row)")
def ra1_cell_difference(spark, d):
    return rounded(raster.cell_difference(cells(spark, d), cells(spark, d, TERRAIN)))


@query("WITH t AS (SELECT l_returnflag AS city, l_partkey % 40 AS col, l_suppkey % 40 AS row, l_linenumber AS tile_ord, avg(CASE WHEN l_quantity > 10 THEN l_quantity END) AS value FROM lineitem GROUP BY ALL) SELECT city, col, row, round(arg_min(value, tile_ord) FILTER (WHERE value IS NOT NULL), 6) + 0.0 AS value FROM t GROUP BY city, col, row")
def ra2_mosaic(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("city"), (F.col("l_partkey") % 40).alias("col"), (F.col("l_suppkey") % 40).alias("row"), F.col("l_linenumber").alias("tile_ord")).agg(F.avg(F.when(F.col("l_quantity") > 10, F.col("l_quantity"))).alias("value"))
    return rounded(raster.mosaic(t))


@query(f"WITH {cells_sql('c')}, t AS (SELECT DISTINCT city, col // 2 AS col, row // 2 AS row FROM c), n AS (SELECT t.*, (col * 2.0 + 0.5) AS u, (row * 2.0 + 0.25) AS v FROM t), k AS (SELECT n.*, i, j, CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END AS w FROM n CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j)) SELECT k.city, k.col, k.row, round(sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) + 0.0 AS value FROM k LEFT JOIN c ON c.city = k.city AND c.col = floor(u) + i AND c.row = floor(v) + j WHERE w > 0 GROUP BY ALL")
def ra3_align_grid(spark, d):
    c = cells(spark, d)
    target = c.select("city", F.floor(F.col("col") / 2).alias("col"), F.floor(F.col("row") / 2).alias("row")).distinct()
    return rounded(raster.align_grid(c, target, 2.0, 0.5, 0.25))


@query(f"WITH {cells_sql('c')} SELECT city, col, row, {R('value')} AS value FROM c WHERE city = 'A' AND greatest(5 - (col + 0.5), 0, (col + 0.5) - 20) * greatest(5 - (col + 0.5), 0, (col + 0.5) - 20) + greatest(8 - (row + 0.5), 0, (row + 0.5) - 30) * greatest(8 - (row + 0.5), 0, (row + 0.5) - 30) <= 9")
def ra4_clip_cells(spark, d):
    ring = spark.createDataFrame([("A", [(5.0, 8.0), (20.0, 8.0), (20.0, 30.0), (5.0, 30.0)])], "city string, ring array<struct<x:double,y:double>>")
    return rounded(raster.clip_cells(cells(spark, d), ring, 3.0))


#: Two parts, the first with a hole; sides lie between the centres of cells.
HOLED = [("A", 1, [(5.0, 8.0), (20.0, 8.0), (20.0, 30.0), (5.0, 30.0)]), ("A", 1, [(9.0, 12.0), (16.0, 12.0), (16.0, 25.0), (9.0, 25.0)]), ("A", 2, [(26.0, 3.0), (38.0, 3.0), (38.0, 18.0), (26.0, 18.0)])]
BOXED = "(x BETWEEN 5 AND 20 AND y BETWEEN 8 AND 30 AND NOT (x BETWEEN 9 AND 16 AND y BETWEEN 12 AND 25)) OR (x BETWEEN 26 AND 38 AND y BETWEEN 3 AND 18)"


@query(f"WITH {cells_sql('c')}, m AS (SELECT *, col + 0.5 AS x, row + 0.5 AS y FROM c) SELECT city, col, row, {R('value')} AS value FROM m WHERE city = 'A' AND ({BOXED})")
def ra4_clip_cells_parts(spark, d):
    return rounded(raster.clip_cells(cells(spark, d), spark.createDataFrame(HOLED, "city string, part int, ring array<struct<x:double,y:double>>"), 0.0))


INDEX_SQL = {
    "NDVI": "(B8 - B4) / nullif(B8 + B4, 0)", "GNDVI": "(B8 - B3) / nullif(B8 + B3, 0)", "EVI": "2.5 * (B8 / 10000 - B4 / 10000) / nullif(B8 / 10000 + 6 * (B4 / 10000) - 7.5 * (B2 / 10000) + 1, 0)", "VARI": "(B3 - B4) / nullif(B3 + B4 - B2, 0)",
    "NDre1": "(B8 - B5) / nullif(B8 + B5, 0)", "NDVIre": "(B8 - B6) / nullif(B8 + B6, 0)", "CIre": "B8 / nullif(B5, 0) - 1", "IRECI": "(B7 - B4) / nullif(B5 / nullif(B6, 0), 0)", "RTVIcore": "100 * (B8 - B5) - 10 * (B8 - B3)",
    "NDWI": "(B8 - B11) / nullif(B8 + B11, 0)", "MSI": "B11 / nullif(B8, 0)", "NDII": "(B8 - B12) / nullif(B8 + B12, 0)", "kNDVI": "tanh(pow((B8 - B4) / nullif(B8 + B4, 0), 2))",
}


@query(f"WITH {OBS} SELECT city, col, row, scl, count(*) AS n, " + ", ".join(f"{R(f'avg({e})', 5)} AS {k}" for k, e in INDEX_SQL.items()) + " FROM obs GROUP BY ALL")
def ra5_spectral_indices(spark, d):
    o = observations(spark, d).withColumns(raster.spectral_indices())
    return rounded(o.groupBy("city", "col", "row", "scl").agg(F.count("*").alias("n"), *(F.avg(k).alias(k) for k in INDEX_SQL)), 5)


CLEAR = "clear AS (SELECT city, col, row, ts, " + ", ".join(f"greatest(0, least({b}, 10000)) AS {b}" for b in BANDS) + " FROM obs WHERE scl IN (4, 5))"


@query(f"WITH {OBS}, {CLEAR} SELECT city, col, row, CAST(month(ts) AS INTEGER) AS month, {R('quantile_cont(B8, 0.5)', 5)} AS B8, {R('quantile_cont(B4, 0.5)', 5)} AS B4, round(quantile_cont({INDEX_SQL['NDVI']}, 0.5), 6) + 0.0 AS NDVI FROM clear GROUP BY ALL")
def ra6_monthly_composite(spark, d):
    clear = prep.mask_and_clamp(observations(spark, d), BANDS).withColumns(raster.spectral_indices())
    c = raster.monthly_composite(clear, ["B8", "B4", "NDVI"])
    return c.select("city", "col", "row", "month", F.round("B8", 5).alias("B8"), F.round("B4", 5).alias("B4"), F.round("NDVI", 6).alias("NDVI"))


def tree_points(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("city"), (F.col("o_custkey") % 45 + 0.25).alias("x"), (F.col("o_orderkey") % 43 + 0.5).alias("y"))


TREES = "trees AS (SELECT o_orderkey AS id, ['A', 'N', 'R'][o_orderkey % 3 + 1] AS city, o_custkey % 45 + 0.25 AS x, o_orderkey % 43 + 0.5 AS y FROM orders)"


@query(f"WITH {cells_sql('c')}, {TREES} SELECT id, {R('value')} AS CHM_1m FROM trees t LEFT JOIN c ON c.city = t.city AND c.col = floor(x) AND c.row = floor(y)")
def ra7_sample_raster(spark, d):
    return rounded(raster.sample_raster(tree_points(spark, d), cells(spark, d), "CHM_1m").select("id", "CHM_1m"))


@query(f"WITH {OBS}, m AS (SELECT city, col, row, month(ts) AS month, avg(B8) AS B8, avg(B4) AS B4 FROM obs GROUP BY ALL), w AS (SELECT city, col, row, " + ", ".join(f"max(CASE WHEN month = {m} THEN {b} END) AS {b}_{m:02d}" for m in (4, 6) for b in ("B8", "B4")) + f" FROM m GROUP BY ALL), {TREES} SELECT id, " + ", ".join(f"{R(f'{b}_{m:02d}', 5)} AS {b}_{m:02d}" for m in (4, 6) for b in ("B8", "B4")) + " FROM trees t LEFT JOIN w ON w.city = t.city AND w.col = floor(x / 10) AND w.row = floor(y / 10)")
def ra8_sample_stack(spark, d):
    m = observations(spark, d).groupBy("city", "col", "row", F.month("ts").alias("month")).agg(F.avg("B8").alias("B8"), F.avg("B4").alias("B4"))
    s = raster.sample_monthly_stack(tree_points(spark, d), m, ["B8", "B4"], [4, 6])
    return rounded(s.drop("city", "x", "y"), 5)


@query(f"WITH {cells_sql('c')} SELECT a.city, a.col, a.row, {R('a.value')} AS value FROM c a WHERE a.value >= (SELECT max(b.value) FROM c b WHERE b.city = a.city AND abs(b.col - a.col) <= 1 AND abs(b.row - a.row) <= 1)")
def ra9_local_maxima(spark, d):
    return rounded(raster.local_maxima(cells(spark, d), 3))


@query(f"""WITH {cells_sql('c')}, {TREES}, g AS (SELECT DISTINCT city, floor(x) AS pc, floor(y) AS pr FROM trees),
 s AS (SELECT g.city, pc, pr, c.col - pc AS i, c.row - pr AS j, c.col, c.row, value FROM g JOIN c ON c.city = g.city AND abs(c.col - pc) <= 3 AND abs(c.row - pr) <= 3),
 p AS (SELECT a.*, sqrt(i * i + j * j) AS dd FROM s a WHERE value >= 3 AND sqrt(i * i + j * j) <= 3 AND value >= (SELECT max(b.value) FROM s b WHERE b.city = a.city AND b.pc = a.pc AND b.pr = a.pr AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1)),
 best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY city, pc, pr ORDER BY dd / (value + 1), row, col) = 1)
 SELECT t.id, coalesce(best.col + 0.5, t.x) AS x, coalesce(best.row + 0.5, t.y) AS y, best.city IS NOT NULL AS position_corrected, {R('coalesce(dd, 0)')} AS correction_distance FROM trees t LEFT JOIN best ON best.city = t.city AND pc = floor(t.x) AND pr = floor(t.y)""")
def ra10_snap_to_peak(spark, d):
    return rounded(raster.snap_to_peak(tree_points(spark, d), cells(spark, d)).select("id", "x", "y", "position_corrected", "correction_distance"))


@query()
def ra10_snap_to_peak_every_point(spark, d):
    return rounded(raster.snap_to_peak(tree_points(spark, d), cells(spark, d)).select("id", "x", "y", "position_corrected", "correction_distance"))


@query()
def ra11_adaptive_radius(spark, d):
    t = tree_points(spark, d)
    return raster.snap_to_peak(t, cells(spark, d), raster.adaptive_radius(t, cells(spark, d))).groupBy("position_corrected").agg(F.count("*").alias("n"))


@query(f"WITH {OBS}, m AS (SELECT city, col, row, CAST(month(ts) AS INTEGER) AS month, avg(CASE WHEN scl IN (4, 5) THEN B8 END) AS B8, avg(B4) AS B4 FROM obs GROUP BY ALL) SELECT city, month, count(*) AS n_cells, {R('(count(B8) + count(B4)) / (count(*) * 2)')} AS coverage, min(col) AS min_col, max(col) AS max_col, min(row) AS min_row, max(row) AS max_row, (count(B8) + count(B4)) / (count(*) * 2) > 0.5 AS valid FROM m GROUP BY city, month")
def ra12_raster_validate(spark, d):
    m = observations(spark, d).groupBy("city", "col", "row", F.month("ts").alias("month")).agg(F.avg(F.when(F.col("scl").isin(4, 5), F.col("B8"))).alias("B8"), F.avg("B4").alias("B4"))
    return rounded(raster.raster_validate(m, ["B8", "B4"]))
