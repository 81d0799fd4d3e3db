import math
import random

from pyspark.sql import functions as F

from geotally.operators import polygons, spatial

RING = "city string, part int, ring array<struct<x:double,y:double>>"


def star(rng, cx, cy, low, high, n):
    """A ring without crossings: places about a middle in the order of their angles."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in angles for r in [rng.uniform(low, high)]]


def brute(parts, x, y):
    """Within any part by crossings, and the distance from the nearest edge."""
    odd, away = {}, math.inf
    for part, ring in parts:
        for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px:
                odd[part] = not odd.get(part, False)
            length = (qx - px) ** 2 + (qy - py) ** 2
            t = max(0.0, min(1.0, ((x - px) * (qx - px) + (y - py) * (qy - py)) / length)) if length else 0.0
            away = min(away, math.hypot(x - px - t * (qx - px), y - py - t * (qy - py)))
    return any(odd.values()), away


def test_random_polygons_with_holes_and_parts(spark):
    rng = random.Random(11)
    shapes = {}
    for c in range(8):
        outer = star(rng, 0, 0, 60, 100, 40 + 20 * c)
        shapes[f"c{c}"] = [(1, outer), (1, star(rng, 0, 0, 10, 45, 12)), (2, star(rng, 230, 20, 20, 60, 9)), (3, star(rng, 90, 40, 30, 70, 15)), (4, [(0.0, 0.0), (1.0, 1.0)])]
    boundary = spark.createDataFrame([(c, p, r) for c, rings in shapes.items() for p, r in rings], RING)
    rows = [(i, f"c{i % 9}", rng.uniform(-150, 320), rng.uniform(-150, 150)) for i in range(3000)] + [(3000, None, 0.0, 0.0), (3001, "c1", None, 1.0)]
    df = spark.createDataFrame(rows, "id int, city string, x double, y double")
    for buffer in (0.0, 7.5, 60.0):
        want = set()
        for i, c, x, y in rows:
            if c in shapes and x is not None:
                within, away = brute([v for v in shapes[c] if len(v[1]) > 2], x, y)
                if within or (buffer and away <= buffer):
                    want.add(i)
        got = [r["id"] for r in spatial.within_buffered_boundary(df, boundary, buffer).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_whole_coordinates_on_edges_and_cells(spark):
    square = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]  # closed by hand
    hole = [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)]
    boundary = spark.createDataFrame([("a", 1, square), ("a", 1, hole)], RING)
    df = spark.range(400).select("id", F.lit("a").alias("city"), (F.col("id") % 20 - 5).cast("double").alias("x"), (F.floor(F.col("id") / 20) - 5).cast("double").alias("y"))
    for size in (None, 1.0, 2.0, 3.7):
        cover, s = polygons.covering(boundary, 0.0, size=size)
        cell = df.withColumns({"cx": F.floor(F.col("x") / s), "cy": F.floor(F.col("y") / s)}).join(cover, ["city", "cx", "cy"])
        got = {(r["x"], r["y"]) for r in cell.where(polygons.contains(F.col("whole"), F.col("parts"), F.col("x"), F.col("y"))).collect()}
        want = {(float(x), float(y)) for x in range(-5, 15) for y in range(-5, 15) if brute([(1, square), (1, hole)], x, y)[0]}
        assert got == want


def test_points_meet_only_edges_of_their_cell(spark):
    n = 2000
    ring = [(1000 * math.cos(2 * math.pi * i / n), 1000 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    boundary = spark.createDataFrame([("a", 1, ring)], RING)
    cover, size = polygons.covering(boundary)
    found = cover.agg(F.max(F.size("parts")), F.max(F.aggregate(F.coalesce("parts", F.array().cast(cover.schema["parts"].dataType)), F.lit(0), lambda s, p: s + F.size(p["edges"]))), F.count_if("whole"), F.count(F.lit(1))).first()
    assert found[1] <= 30 and found[2] * size * size < math.pi * 1e6 < found[3] * size * size and found[3] < 5 * polygons.CELLS_AN_EDGE * n
    near, size = polygons.covering(boundary, 300.0)
    assert near.where("whole").count() * size * size < math.pi * 1.3e3**2 < near.count() * size * size
    df = spark.createDataFrame([(1, "a", 0.0, 0.0)], "id int, city string, x double, y double")
    plan = spatial.within_buffered_boundary(df, boundary, 300.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    nothing = boundary.where("city = 'b'")
    assert spatial.within_buffered_boundary(df, nothing).count() == 0 and spatial.validate_within(df, nothing).first()["n_outside"] == 1
