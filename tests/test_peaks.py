"""Snapping to peaks: each cell with points is searched around once, and every point gets what a search of its own would give."""

import math
import random
import re

import pytest

from geotally.operators import raster


def best_peak(place, city, grid, radius, least, edge_mode):
    """(score, row, col, distance) of the best peak about a point, or None."""
    pc, pr, r = math.floor(place[0]), math.floor(place[1]), int(radius)
    square = {(c, w): v for (g, c, w), v in grid.items() if g == city and abs(c - pc) <= r and abs(w - pr) <= r}
    seen = square if edge_mode == "window" else {(c, w): v for (g, c, w), v in grid.items() if g == city}
    found = []
    for (c, w), v in square.items():
        d = math.hypot(c - pc, w - pr)
        if v >= least and d <= radius and all(v >= u for (a, b), u in seen.items() if abs(a - c) <= 1 and abs(b - w) <= 1):
            found.append((d / (v + 1), w, c, d))
    return min(found, default=None)


@pytest.mark.parametrize("edge_mode", ["window", "global"])
def test_many_points_of_few_cells(spark, edge_mode):
    rng = random.Random(5)
    grid = {(g, c, w): float(rng.randint(0, 9)) for g in ("a", "b") for c in range(12) for w in range(12) if rng.random() < 0.8}
    rows = [(i, rng.choice(["a", "b", "none", None]), rng.uniform(-2, 14), rng.choice([3.5, 3.7, 8.1, -20.0, None])) for i in range(400)]
    cells = spark.createDataFrame([(*k, v) for k, v in grid.items()], "city string, col long, row long, value double")
    out = raster.snap_to_peak(spark.createDataFrame(rows, "id long, city string, x double, y double"), cells, 3.0, edge_mode=edge_mode)
    assert out.columns == ["id", "city", "x", "y", "position_corrected", "correction_distance"]
    got = {r["id"]: tuple(r)[2:] for r in out.collect()}
    assert len(got) == len(rows)
    for i, city, x, y in rows:
        best = None if y is None else best_peak((x, y), city, grid, 3.0, 3.0, edge_mode)
        assert got[i] == ((x, y, False, 0.0) if best is None else (best[2] + 0.5, best[1] + 0.5, True, pytest.approx(best[3]))), i


def test_cells_are_searched_around_once(spark):
    """What is spread over the square are distinct cells, not points."""
    points = spark.range(100).selectExpr("id", "'a' as city", "id % 3 + 0.5D as x", "id % 2 + 0.5D as y")
    cells = spark.range(9).selectExpr("'a' as city", "id % 3 as col", "id div 3 as row", "double(id) as value")
    plan = raster.snap_to_peak(points, cells)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    spread = [i for i, line in enumerate(plan) if re.search(r"Generate inline\(\[", line)]
    assert spread and all(any("Aggregate [" in line for line in plan[i + 1 : i + 4]) for i in spread)
