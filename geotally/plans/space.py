"""Queries: spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotally.operators import spatial
from geotally.plans.bindings import PTS, R, points, rounded
from geotally.plans.registry import query

DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
BOX = [(-150.0, -200.0), (220.0, -180.0), (250.0, 160.0), (-120.0, 190.0)]


def boundary(spark):
    ring = "array<struct<x:double,y:double>>"
    return spark.createDataFrame([("source", BOX), ("target", [(x + 10, y - 5) for x, y in BOX])], f"city string, ring {ring}")


def near_ring(buffer: float, dx: float = 0, dy: float = 0) -> str:
    """SQL of "within a ring or at most buffer away from it", edge by edge."""
    p = [(x + dx, y + dy) for x, y in BOX]
    odd, close = [], []
    for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True):
        odd.append(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2 - x1}) * (y - ({y1})) / ({y2 - y1}) + ({x1}) THEN 1 ELSE 0 END")
        t = f"greatest(0, least(1, ((x - ({x1})) * ({x2 - x1}) + (y - ({y1})) * ({y2 - y1})) / {(x2 - x1) ** 2 + (y2 - y1) ** 2}))"
        close.append(f"pow(x - ({x1}) - {t} * ({x2 - x1}), 2) + pow(y - ({y1}) - {t} * ({y2 - y1}), 2) <= {buffer * buffer}")
    return f"(({' + '.join(odd)}) % 2 = 1 OR {' OR '.join(close)})"


@query(f"WITH {PTS} SELECT id, city FROM pts WHERE (city = 'source' AND {near_ring(30.0)}) OR (city = 'target' AND {near_ring(30.0, 10, -5)})")
def sp2_within_buffered_boundary(spark, d):
    return spatial.within_buffered_boundary(points(spark, d), boundary(spark), 30.0).select("id", "city")


@query(f"WITH {PTS} SELECT city, count(*) AS n, count(*) FILTER (WHERE NOT ((city = 'source' AND {near_ring(10.0)}) OR (city = 'target' AND {near_ring(10.0, 10, -5)}))) AS n_outside FROM pts GROUP BY city")
def sp3_validate_within(spark, d):
    return spatial.validate_within(points(spark, d), boundary(spark), 10.0)


#: (city, part, ring): a part with a hole that reaches over x = 0, a part apart from it, and one that overlaps the first.
PARTS = [
    ("source", 1, [(-150.0, -200.0), (120.0, -180.0), (90.0, 160.0), (-120.0, 190.0)]), ("source", 1, [(-60.0, -90.0), (55.0, -70.0), (40.0, 60.0), (-10.0, 20.0), (-50.0, 70.0)]),
    ("source", 2, [(160.0, -40.0), (260.0, -60.0), (230.0, 80.0), (200.0, 10.0)]), ("source", 3, [(60.0, 100.0), (180.0, 120.0), (150.0, 210.0)]),
    ("target", 1, [(-180.0, -20.0), (0.0, -190.0), (170.0, 10.0), (20.0, 180.0)]), ("target", 1, [(-30.0, -30.0), (30.0, -30.0), (30.0, 30.0), (-30.0, 30.0)]),
]


def parts(spark):
    return spark.createDataFrame(PARTS, "city string, part int, ring array<struct<x:double,y:double>>")


#: The edges of PARTS and, of each of the points p, whether its city's region has it and how far the nearest edge is: edge by edge, part by part.
EDGES = ", ".join(f"('{c}', {k}, CAST({x1} AS DOUBLE), CAST({y1} AS DOUBLE), CAST({x2} AS DOUBLE), CAST({y2} AS DOUBLE))" for c, k, r in PARTS for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True))
FOUND = f"""edg(city, part, px, py, qx, qy) AS (VALUES {EDGES}),
pe AS (SELECT p.id, p.city, e.part, CASE WHEN (py > p.y) <> (qy > p.y) AND p.x < (qx - px) * (p.y - py) / nullif(qy - py, 0) + px THEN 1 ELSE 0 END AS odd,
    greatest(0, least(1, ((p.x - px) * (qx - px) + (p.y - py) * (qy - py)) / ((qx - px) * (qx - px) + (qy - py) * (qy - py)))) AS t, p.x - px AS ux, p.y - py AS uy, qx - px AS dx, qy - py AS dy FROM p JOIN edg e ON p.city = e.city),
pp AS (SELECT id, city, part, sum(odd) % 2 = 1 AS within, min(pow(ux - t * dx, 2) + pow(uy - t * dy, 2)) AS away2 FROM pe GROUP BY ALL),
found AS (SELECT id, city, bool_or(within) AS within, min(away2) AS away2 FROM pp GROUP BY ALL)"""


@query(f"WITH {PTS}, p AS (SELECT id, city, x, y FROM pts), {FOUND} SELECT id, city FROM found WHERE within OR away2 <= 225")
def sp2_within_buffered_parts(spark, d):
    return spatial.within_buffered_boundary(points(spark, d), parts(spark), 15.0).select("id", "city")


@query(f"WITH {PTS}, p AS (SELECT id, city, x, y FROM pts), {FOUND} SELECT id, city FROM found WHERE within")
def sp3_clip_to_parts(spark, d):
    return spatial.within_buffered_boundary(points(spark, d), parts(spark), 0.0).select("id", "city")


@query(f"WITH {PTS}, p AS (SELECT id, city, x, y FROM pts), {FOUND} SELECT city, count(*) AS n, count(*) FILTER (WHERE NOT within AND away2 > 100) AS n_outside FROM found GROUP BY city")
def sp3_validate_within_parts(spark, d):
    return spatial.validate_within(points(spark, d), parts(spark), 10.0)


@query(f"WITH {PTS}, t AS (SELECT city, id, abs(x * y) AS a FROM pts) SELECT city, max(a) AS top FROM (SELECT city, {R('a')} AS a FROM t) GROUP BY city")
def sp4_largest_polygon(spark, d):
    parts = points(spark, d).select("city", F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', x, 'y', 0D), named_struct('x', x, 'y', y), named_struct('x', 0D, 'y', y))").alias("ring"))
    return rounded(spatial.largest_polygon(parts, "city").select("city", spatial.ring_area(F.col("ring")).alias("top")))


@query(f"WITH {PTS}, o AS (SELECT city, min(x) AS mx, min(y) AS my FROM pts GROUP BY city) SELECT id, format('{{}}_{{:04d}}_{{:04d}}', substr(city, 1, 8), CAST(floor((x - mx) / 200) AS BIGINT), CAST(floor((y - my) / 200) AS BIGINT)) AS block_id FROM pts JOIN o USING (city)")
def sp5_spatial_blocks(spark, d):
    return spatial.spatial_blocks(points(spark, d), 200.0).select("id", "block_id")


@query(f"WITH {PTS}, s AS (SELECT unnest([50.0, 100.0, 200.0, 400.0]) AS size), c AS (SELECT city, size, floor(x / size) AS cx, floor(y / size) AS cy, count(*) AS n FROM pts CROSS JOIN s GROUP BY ALL) SELECT city, CAST(size AS DOUBLE) AS size, count(*) AS n_blocks, {R('avg(n)')} AS mean_per_block, count(*) >= 30 AS feasible FROM c GROUP BY city, size")
def sp6_grid_counts(spark, d):
    return rounded(spatial.grid_counts(points(spark, d), [50.0, 100.0, 200.0, 400.0]))


NEAR = f"nd AS (SELECT a.id, a.city, a.cls, min({DIST}) AS distance FROM pts a JOIN pts b ON a.cls <> b.cls GROUP BY ALL)"


@query(f"WITH {PTS}, {NEAR} SELECT id, {R('distance')} AS distance FROM nd")
def sp7_nearest_other_class(spark, d):
    return rounded(spatial.nearest_other_class_distance(points(spark, d), "cls").select("id", "distance"))


@query(f"WITH {PTS}, {NEAR} SELECT id, CASE WHEN distance <= 20 THEN {R('distance')} ELSE 'infinity'::DOUBLE END AS distance FROM nd")
def sp8_nearest_other_class_bounded(spark, d):
    return rounded(spatial.nearest_other_class_distance(points(spark, d), "cls", max_radius=20.0).select("id", "distance"))


@query(f"WITH {PTS}, k AS (SELECT a.id, a.cls, b.cls AS other, {DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS rank FROM pts a, pts b), f AS (SELECT id, min(rank) FILTER (WHERE cls <> other) AS first FROM k WHERE rank <= 4 GROUP BY id) SELECT id, {R("coalesce((SELECT d FROM k WHERE k.id = f.id AND k.rank = f.first AND f.first > 1), 'infinity'::DOUBLE)")} AS distance FROM f")
def sp8_nearest_other_class_knn(spark, d):
    return rounded(spatial.nearest_other_class_knn(points(spark, d), "cls", 3).select("id", "distance"))


@query(f"WITH {PTS}, k AS (SELECT a.id, b.id AS site, {DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS rank FROM pts a, pts b) SELECT id, CAST(rank AS INTEGER) AS rank, site, {R('d')} AS distance FROM k WHERE rank <= 51")
def sp8_k_nearest(spark, d):
    return rounded(spatial.k_nearest(points(spark, d), 51).select("id", "rank", "site", "distance"))


@query(f"WITH {PTS}, {NEAR} SELECT id, cls FROM nd WHERE distance >= 5")
def sp9_proximity_filter(spark, d):
    return spatial.proximity_filter(points(spark, d), 5.0, "cls").select("id", "cls")


@query(f"WITH {PTS}, {NEAR}, r AS (SELECT cls, count(*) AS total, count(*) FILTER (WHERE distance < 5) AS removed FROM nd GROUP BY cls), q AS (SELECT *, removed / total AS rate FROM r) SELECT cls, total, removed, {R('rate')} AS rate, abs(rate - (SELECT avg(rate) FROM q)) > 0.10 AS deviates FROM q")
def sp10_proximity_impact(spark, d):
    return rounded(spatial.proximity_impact(points(spark, d), 5.0, "cls"))


@query(f"WITH {PTS}, {NEAR}, t AS (SELECT unnest([5.0, 10.0, 20.0]) AS threshold), c AS (SELECT threshold, cls, city, count(*) AS n, count(*) FILTER (WHERE distance < threshold) AS removed FROM nd CROSS JOIN t GROUP BY GROUPING SETS ((threshold, cls, city), (threshold, cls))) SELECT CAST(threshold AS DOUBLE) AS threshold, city, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(n) - sum(removed) AS BIGINT) AS retained, {R('1 - sum(removed) / sum(n)')} AS retention, {R('max(removed / n) - min(removed / n)')} AS class_range FROM c GROUP BY threshold, city")
def sp11_proximity_sensitivity(spark, d):
    dist = spatial.nearest_other_class_distance(points(spark, d), "cls")
    return rounded(spatial.proximity_sensitivity(dist, [5.0, 10.0, 20.0], "cls"))


@query(f"WITH {PTS}, {NEAR} SELECT city, count(*) AS n, {R('avg(distance)')} AS mean, {R('stddev_pop(distance)')} AS std, {R('min(distance)')} AS min, {R('max(distance)')} AS max, " + ", ".join(f"{R(f'quantile_cont(distance, {q})')} AS p{int(q * 100):02d}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM nd GROUP BY city")
def sp12_distance_distribution(spark, d):
    return rounded(spatial.distance_distribution(spatial.nearest_other_class_distance(points(spark, d), "cls")))


def moran_sql(lags: list[float], features: list[str]) -> str:
    z = ", ".join(f"{f} - avg({f}) OVER (PARTITION BY city) AS {f}" for f in features)
    one = " UNION ALL ".join(f"SELECT p.city, '{f}' AS feature, CAST({lag} AS DOUBLE) AS lag, (SELECT count(*) FROM z c WHERE c.city = p.city) / count(*) * sum(z.{f} * w) / (SELECT sum(c.{f} * c.{f}) FROM z c WHERE c.city = p.city) AS i FROM (SELECT a.city, a.id, avg(b.{f}) AS w FROM z a JOIN z b ON a.city = b.city AND a.id <> b.id AND {DIST} <= {lag} GROUP BY ALL) p JOIN z ON z.id = p.id GROUP BY p.city" for lag in lags for f in features)
    return f"z AS (SELECT id, city, x, y, {z} FROM pts), moran AS ({one})"


@query(f"WITH {PTS}, {moran_sql([50.0, 120.0], ['f01', 'f02'])} SELECT city, feature, lag, {R('i')} AS morans_i FROM moran")
def sp13_morans_i(spark, d):
    return rounded(spatial.morans_i(points(spark, d), ["f01", "f02"], [50.0, 120.0]))


DECAY = "d AS (SELECT city, feature, lag, i, lag(i) OVER w AS i0, lag(lag) OVER w AS l0 FROM moran WINDOW w AS (PARTITION BY city, feature ORDER BY lag)), dec AS (SELECT city, feature, coalesce(min(CASE WHEN i < 0.05 THEN CASE WHEN i0 IS NULL THEN lag WHEN i0 >= 0.05 THEN l0 + (i0 - 0.05) / (i0 - i) * (lag - l0) END END), max(lag)) AS decay FROM d GROUP BY city, feature)"


@query(f"WITH {PTS}, {moran_sql([30.0, 50.0, 120.0], ['f01', 'f02'])}, {DECAY} SELECT city, feature, {R('decay', 4)} AS decay FROM dec")
def sp15_decay_distance(spark, d):
    return rounded(spatial.decay_distance(spatial.morans_i(points(spark, d), ["f01", "f02"], [30.0, 50.0, 120.0])), 4)


@query(f"WITH {PTS}, {moran_sql([30.0, 50.0, 120.0], ['f01', 'f02'])}, {DECAY} SELECT feature, {R('avg(decay)', 4)} AS mean, {R('stddev_pop(decay)', 4)} AS std, {R('max(decay)', 4)} AS max, max(decay) - min(decay) <= 50 AS agree, (SELECT CAST(ceil(max(decay) / 100) * 100 AS BIGINT) FROM dec) AS recommended FROM dec GROUP BY feature")
def sp16_block_size(spark, d):
    return rounded(spatial.block_size_recommendation(spatial.decay_distance(spatial.morans_i(points(spark, d), ["f01", "f02"], [30.0, 50.0, 120.0]))), 4)


@query(f"WITH {PTS}, s AS (SELECT *, CASE WHEN x < 0 THEN 'train' ELSE 'test' END AS split FROM pts) SELECT id, split FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE a.split <> b.split AND {DIST} <= 25)")
def sp17_split_boundary_rows(spark, d):
    p = points(spark, d).withColumn("split", F.when(F.col("x") < 0, "train").otherwise("test"))
    return spatial.split_boundary_rows(p.select("id", "split", "x", "y"), "split", "train", "test", 25.0).select("id", "split")


@query()
def sp18_post_split_independence(spark, d):
    p = points(spark, d).withColumn("split", F.when(F.col("x") < 0, "train").otherwise("test"))
    return rounded(spatial.post_split_independence(p, "split", "f01", 60.0, buffer=60.0))


@query(f"WITH {PTS} SELECT CAST(r AS DOUBLE) AS distance, {R('640000.0 * (SELECT count(*) FROM pts a JOIN pts b ON a.id <> b.id AND ' + DIST + ' <= r) / ((SELECT count(*) FROM pts) * ((SELECT count(*) FROM pts) - 1))', 4)} AS k, {R('pi() * r * r', 4)} AS expected FROM (SELECT unnest([20.0, 50.0, 100.0]) AS r)")
def sp19_ripley_k(spark, d):
    return rounded(spatial.ripley_k(points(spark, d), [20.0, 50.0, 100.0], 640000.0), 4)


@query("SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def sp20_remove_duplicate_ids(spark, d):
    from geotally.plans.bindings import table

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return spatial.remove_duplicate_ids(li, ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber")


@query(f"WITH {PTS}, g AS (SELECT id, round(x / 50) AS x, round(y / 50) AS y FROM pts) SELECT min(id) AS id FROM g GROUP BY x, y")
def sp21_remove_coincident(spark, d):
    p = points(spark, d).select("id", F.round(F.col("x") / 50).alias("x"), F.round(F.col("y") / 50).alias("y"))
    return spatial.remove_coincident_points(p, ["id"]).select("id")


@query(f"WITH {PTS} SELECT id FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.id < a.id AND {DIST} <= 12)")
def sp21_remove_near(spark, d):
    return spatial.remove_near_points(points(spark, d), 12.0).select("id")


@query()
def sp1_reproject(spark, d):
    lonlat = points(spark, d).select("id", (13.4 + F.col("x") / 100000).alias("x"), (52.5 + F.col("y") / 100000).alias("y"))
    return rounded(spatial.reproject(lonlat, "EPSG:4326"), 3)


@query(f"WITH {PTS} SELECT id, {R('13.4 + x / 100000', 8)} AS x, {R('52.5 + y / 100000', 8)} AS y FROM pts")
def sp1_there_and_back(spark, d):
    """Degrees to metres and back to degrees; 1e-8 degrees are a millimetre."""
    lonlat = points(spark, d).select("id", (13.4 + F.col("x") / 100000).alias("x"), (52.5 + F.col("y") / 100000).alias("y"))
    return rounded(spatial.reproject(spatial.reproject(lonlat, "EPSG:4326"), "EPSG:25833", to="EPSG:4326"), 8)
