"""Polygons of several parts with holes, as rows (city, part, ring), covered by square cells so that points find them by an equi-join.

Rings of one part are told apart by crossings: a ring within another is a hole. A point belongs to a city where any of its parts has it. Rings are arrays of
(x, y), closed or not; a ring that is null or has fewer than three places encloses nothing. Without the column part each row is a part of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotally.functions.folders import checkpointed

#: Least number of cells of a covering, and cells an edge: a covering grows with the edges, and a cell lists few of them.
CELLS, CELLS_AN_EDGE = 1024, 4
#: Where a cell's reference place lies in it; uneven, so that edges on round coordinates don't pass through it.
AT_X, AT_Y = 0.41421356, 0.57721566


def edges_of(ring: Column) -> Column:
    """Edges (p, q) of a closed ring of (x, y)."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.get(ring, (i + 1) % n).alias("q")))


def ring_area(ring: Column) -> Column:
    return F.abs(F.aggregate(edges_of(ring), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def crossing_x(e: Column, y: Column) -> Column:
    """Where an edge passes the level y; null if it doesn't. A level's own places belong to what lies above it."""
    rises = (e["py"] > y) != (e["qy"] > y)
    return F.when(rises, (e["qx"] - e["px"]) * (y - e["py"]) / F.nullif(e["qy"] - e["py"], F.lit(0.0)) + e["px"])


def crossing_y(e: Column, x: Column) -> Column:
    passes = (e["px"] > x) != (e["qx"] > x)
    return F.when(passes, (e["qy"] - e["py"]) * (x - e["px"]) / F.nullif(e["qx"] - e["px"], F.lit(0.0)) + e["py"])


def away2(e: Column, x: Column, y: Column) -> Column:
    """Square of the distance from an edge."""
    dx, dy = e["qx"] - e["px"], e["qy"] - e["py"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - e["px"]) * dx + (y - e["py"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return F.pow(x - e["px"] - t * dx, F.lit(2.0)) + F.pow(y - e["py"] - t * dy, F.lit(2.0))


def _edge_rows(boundary: DataFrame, city: str) -> DataFrame:
    """(city, part, e): the edges of all rings, e of (px, py, qx, qy)."""
    part = F.col("part").cast("string") if "part" in boundary.columns else F.monotonically_increasing_id().cast("string")
    rings = boundary.where(F.col(city).isNotNull() & (F.size("ring") > 2)).select(F.col(city).alias("city"), part.alias("part"), "ring")
    rows = rings.select("city", "part", F.explode(edges_of(F.col("ring"))).alias("v"))
    double = [F.col("v")[a][b].cast("double").alias(a + b) for a in "pq" for b in "xy"]
    return rows.select("city", "part", F.struct(*double).alias("e"))


def cell_size(edges: DataFrame, buffer: float) -> float:
    """One size for all cities, by their bounding boxes and the number of edges: one row comes to the driver."""
    ends = [F.min(F.least("e.px", "e.qx")), F.max(F.greatest("e.px", "e.qx")), F.min(F.least("e.py", "e.qy")), F.max(F.greatest("e.py", "e.qy"))]
    boxes = edges.groupBy("city").agg(*(v.alias(n) for v, n in zip(ends, ("x0", "x1", "y0", "y1"), strict=True)), F.count(F.lit(1)).alias("n"))
    total = boxes.agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), F.sum("n").alias("n")).first()
    size = math.sqrt((total["area"] or 0.0) / max(CELLS, CELLS_AN_EDGE * (total["n"] or 0)))
    return max(size, buffer / 2) or 1.0


def covering(boundary: DataFrame, buffer: float = 0.0, city: str = "city", size: float | None = None) -> tuple[DataFrame, float]:
    """(city, cx, cy, whole, parts) of every cell that a boundary, or the region at most buffer away from it, may reach; and the size of cells.

    A whole cell belongs to the region with all its places. For the others parts lists (odd, edges, rx, ry): the edges near the cell of each part, and
    whether the place (rx, ry) is within it, so that a path from there settles any place of the cell. A cell's edges and a row of cells of a part
    are the most that a task holds at once.
    """
    if buffer < 0:
        raise ValueError("a buffer can't be negative")
    edges = _edge_rows(boundary, city)
    size = float(size or cell_size(edges, buffer))
    pad = buffer + size * 1e-9
    e = F.col("e")

    def cell(v: Column) -> Column:
        return F.floor(v / size)

    rows = edges.select("*", F.explode(F.sequence(cell(F.least("e.py", "e.qy") - pad), cell(F.greatest("e.py", "e.qy") + pad))).alias("cy"))
    # only the piece of an edge that is within reach of the row's cells is followed along the row
    dy = F.nullif(e["qy"] - e["py"], F.lit(0.0))
    t1, t2 = (F.col("cy") * size - pad - e["py"]) / dy, ((F.col("cy") + 1) * size + pad - e["py"]) / dy
    first, last = F.coalesce(F.greatest(F.lit(0.0), F.least(t1, t2)), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), F.greatest(t1, t2)), F.lit(1.0))
    x1, x2 = e["px"] + first * (e["qx"] - e["px"]), e["px"] + last * (e["qx"] - e["px"])
    near = rows.select("*", F.explode(F.sequence(cell(F.least(x1, x2) - pad), cell(F.greatest(x1, x2) + pad))).alias("cx"))
    rx, ry = (F.col("cx") + AT_X) * size, (F.col("cy") + AT_Y) * size
    corners = [away2(e, (F.col("cx") + i) * size, (F.col("cy") + j) * size) for i in (0, 1) for j in (0, 1)]
    at = crossing_x(e, ry)
    here = cell(at) == F.col("cx")
    cells = near.groupBy("city", "part", "cy", "cx").agg(
        F.collect_list("e").alias("edges"), F.max(F.greatest(*corners) <= buffer * buffer).alias("reached"),
        F.count_if(here).alias("passes"), F.count_if(here & (at > rx)).alias("right"),
    )
    row = Window.partitionBy("city", "part", "cy").orderBy("cx")
    beyond = F.coalesce(F.sum("passes").over(row.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    known = cells.withColumns({"beyond": beyond, "next": F.lead("cx").over(row)})
    border = known.select("city", "cx", "cy", F.col("reached").alias("whole"), F.struct(((F.col("right") + F.col("beyond")) % 2 == 1).alias("odd"), "edges", rx.alias("rx"), ry.alias("ry")).alias("p"))
    gaps = known.where("beyond % 2 = 1 and next > cx + 1").select("city", F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"), "cy", F.lit(True).alias("whole"))
    both = border.unionByName(gaps, allowMissingColumns=True)
    found = both.groupBy("city", "cx", "cy").agg(F.max("whole").alias("whole"), F.collect_list("p").alias("parts"))
    return found.withColumn("parts", F.when(~F.col("whole"), F.col("parts"))), size


def contains(whole: Column, parts: Column, x: Column, y: Column, buffer: float = 0.0) -> Column:
    """Whether the region has the place, given the cell of the covering that it lies in: first up or down from the cell's reference place, then along y."""
    def one(p: Column) -> Column:
        up = F.size(F.filter(p["edges"], lambda e: F.coalesce((crossing_y(e, p["rx"]) > p["ry"]) != (crossing_y(e, p["rx"]) > y), F.lit(False))))
        along = F.size(F.filter(p["edges"], lambda e: F.coalesce((crossing_x(e, y) > p["rx"]) != (crossing_x(e, y) > x), F.lit(False))))
        within = p["odd"] != ((up + along) % 2 == 1)
        return within if not buffer else within | F.exists(p["edges"], lambda e: away2(e, x, y) <= buffer * buffer)

    return F.coalesce(whole | F.exists(parts, one), F.lit(False))


def located(df: DataFrame, boundary: DataFrame, buffer: float = 0.0, city: str = "city") -> DataFrame:
    """df with __within: whether a row's place lies in its city's region, or at most buffer away; false without city, place or boundary."""
    cover, size = covering(boundary, buffer, city)
    cover = checkpointed(cover).select(F.col("city").alias("__city"), F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), "whole", "parts")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    keyed = df.withColumns({"__x": F.floor(x / size), "__y": F.floor(y / size)})
    cover = cover.withColumn("__cell", F.struct("whole", "parts")).drop("whole", "parts")
    joined = keyed.join(cover, (F.col(city) == F.col("__city")) & (F.col("__x") == F.col("__cx")) & (F.col("__y") == F.col("__cy")), "left")
    within = contains(F.col("__cell")["whole"], F.col("__cell")["parts"], x, y, buffer)
    return joined.select(*(df[c] for c in df.columns), within.alias("__within"))
