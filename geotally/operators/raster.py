"""Raster layers as cell tables (city, col, row, value)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["city", "col", "row"]


def cell_difference(surface: DataFrame, terrain: DataFrame, how: str = "full") -> DataFrame:
    """surface - terrain per cell; NULL if either is missing."""
    b = terrain.withColumnRenamed("value", "__t")
    return surface.join(b, CELL, how).select(*CELL, (F.col("value") - F.col("__t")).alias("value"))


def mosaic(tiles: DataFrame, order: str = "tile_ord") -> DataFrame:
    """Per cell the value of the first tile that has one."""
    first = F.min(F.when(F.col("value").isNotNull(), F.struct(F.col(order).alias("o"), F.col("value").alias("v"))))
    return tiles.groupBy(*CELL).agg(first["v"].alias("value"))


def align_grid(cells: DataFrame, target: DataFrame, scale: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Bilinear values at target cells (city, col, row): source position = target * scale + shift; missing neighbours leave their weight out."""
    at = target.select(*CELL, (F.col("col") * scale + dx).alias("u"), (F.col("row") * scale + dy).alias("v"))
    c0, r0 = F.floor("u"), F.floor("v")
    fu, fv = F.col("u") - c0, F.col("v") - r0
    four = F.array(*(F.struct((c0 + i).alias("__c"), (r0 + j).alias("__r"), ((fu if i else 1 - fu) * (fv if j else 1 - fv)).alias("w")) for i in (0, 1) for j in (0, 1)))
    spread = at.select(*CELL, F.inline(four)).where("w > 0")
    source = cells.where("value is not null").select(F.col("city").alias("__city"), F.col("col").alias("__sc"), F.col("row").alias("__sr"), F.col("value").alias("__v"))
    joined = spread.join(source, (F.col("city") == F.col("__city")) & (F.col("__c") == F.col("__sc")) & (F.col("__r") == F.col("__sr")), "left")
    weight = F.sum(F.when(F.col("__v").isNotNull(), F.col("w")))
    return joined.groupBy(*CELL).agg((F.sum(F.col("w") * F.col("__v")) / weight).alias("value"))


def clip_cells(cells: DataFrame, boundary: DataFrame, buffer: float, resolution: float = 1.0) -> DataFrame:
    """Cells whose centre lies within the buffered ring of their city."""
    from geotally.operators.spatial import within_buffered_boundary

    centred = cells.withColumns({"x": (F.col("col") + 0.5) * resolution, "y": (F.col("row") + 0.5) * resolution})
    return within_buffered_boundary(centred, boundary, buffer).drop("x", "y")


def spectral_indices() -> dict[str, Column]:
    """The 13 indices over columns B2..B12; NULL where a denominator is 0."""
    b2, b3, b4, b5, b6, b7, b8, b11, b12 = (F.col(f"B{i}").cast("double") for i in (2, 3, 4, 5, 6, 7, 8, 11, 12))

    def ratio(a: Column, b: Column) -> Column:
        return a / F.nullif(b, F.lit(0.0))

    ndvi = ratio(b8 - b4, b8 + b4)
    r8, r4, r2 = b8 / 10000, b4 / 10000, b2 / 10000
    return {
        "NDVI": ndvi, "GNDVI": ratio(b8 - b3, b8 + b3), "EVI": ratio(2.5 * (r8 - r4), r8 + 6 * r4 - 7.5 * r2 + 1), "VARI": ratio(b3 - b4, b3 + b4 - b2), "NDre1": ratio(b8 - b5, b8 + b5),
        "NDVIre": ratio(b8 - b6, b8 + b6), "CIre": ratio(b8, b5) - 1, "IRECI": ratio(b7 - b4, ratio(b5, b6)), "RTVIcore": 100 * (b8 - b5) - 10 * (b8 - b3), "NDWI": ratio(b8 - b11, b8 + b11),
        "MSI": ratio(b11, b8), "NDII": ratio(b8 - b12, b8 + b12), "kNDVI": F.tanh(ndvi * ndvi),
    }


def monthly_composite(obs: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """Median per cell and month of each column (an index's median is over its own values)."""
    return obs.groupBy(*CELL, F.month(ts).alias("month")).agg(*(F.percentile(c, 0.5).alias(c) for c in columns))


def sample_raster(points: DataFrame, cells: DataFrame, out: str, resolution: float = 1.0) -> DataFrame:
    """The value of the cell that holds each point; points without place keep NULL."""
    right = cells.select(F.col("city").alias("__city"), F.col("col").alias("__col"), F.col("row").alias("__row"), F.col("value").alias(out))
    on = (F.col("city") == F.col("__city")) & (F.floor(F.col("x") / resolution) == F.col("__col")) & (F.floor(F.col("y") / resolution) == F.col("__row"))
    return points.drop(out).join(right, on, "left").drop("__city", "__col", "__row")


def sample_monthly_stack(points: DataFrame, composite: DataFrame, bands: list[str], months: list[int], key: str = "id", resolution: float = 10.0) -> DataFrame:
    """points with {band}_{MM} of their cell; absent months are NULL. composite: (city, month, col, row, bands)."""
    missing = sorted(set(bands) - set(composite.columns))
    if missing:
        raise ValueError(f"missing bands {missing}")
    wide = composite.where(F.col("month").isin(months)).groupBy(*(F.col(c).alias(f"__{c}") for c in CELL)).agg(*(F.max(F.when(F.col("month") == m, F.col(b))).alias(f"{b}_{m:02d}") for m in months for b in bands))
    on = (F.col("city") == F.col("__city")) & (F.floor(F.col("x") / resolution) == F.col("__col")) & (F.floor(F.col("y") / resolution) == F.col("__row"))
    names = [f"{b}_{m:02d}" for m in months for b in bands]
    kept = [c for c in points.columns if c not in names]
    return points.select(*kept).join(wide, on, "left").select(*kept, *names)


def local_maxima(cells: DataFrame, footprint: int = 3) -> DataFrame:
    """Cells that hold the largest value of their footprint (odd); absent and NULL cells count as lowest."""
    if footprint <= 0 or footprint % 2 == 0:
        raise ValueError("the footprint must be odd")
    p = footprint // 2
    valid = cells.where("value is not null")
    shifts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-p, p + 1) for j in range(-p, p + 1)))
    spread = valid.select("city", "col", "row", "value", F.inline(shifts)).select("city", (F.col("col") + F.col("i")).alias("col"), (F.col("row") + F.col("j")).alias("row"), "value")
    top = spread.groupBy(*CELL).agg(F.max("value").alias("__top"))
    return valid.join(top, CELL).where("value = __top").drop("__top")


def snap_to_peak(points: DataFrame, cells: DataFrame, radius: float = 3.0, footprint: int = 3, least: float = 3.0, key: str = "id", edge_mode: str = "window") -> DataFrame:
    """points moved to their best peak: position_corrected, correction_distance, x, y.

    Peaks are local maxima of at least ``least`` within radius of the point's cell (distances between cell centres); the best has the least
    distance / (height + 1), ties by row, then column. With edge_mode "window" a cell need only be the largest of its footprint inside the
    searched square, with "global" of its whole footprint. Without peak a point stays. Points of one cell have one best peak: each cell with
    points is searched around once, however many points it holds.
    """
    r, at = int(radius), {"__city": F.col("city"), "__pc": F.floor("x"), "__pr": F.floor("y")}
    pc = points.where("x is not null and y is not null and city is not null").select(*(c.alias(k) for k, c in at.items())).distinct()
    square = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-r, r + 1) for j in range(-r, r + 1)))
    window = pc.select("*", F.inline(square)).select("*", F.col("__city").alias("city"), (F.col("__pc") + F.col("i")).alias("col"), (F.col("__pr") + F.col("j")).alias("row"))
    source = (cells.where("value is not null") if edge_mode == "window" else local_maxima(cells, footprint)).select(*CELL, "value")
    seen = window.join(source, CELL)
    if edge_mode == "window":
        p = footprint // 2
        grid = seen.groupBy(*at).agg(F.collect_list(F.struct("row", "col", "value", "i", "j")).alias("g"))  # at most the square's cells
        around = lambda g, c: F.array_max(F.transform(F.filter(g, lambda o: (F.abs(o["i"] - c["i"]) <= p) & (F.abs(o["j"] - c["j"]) <= p)), lambda o: o["value"]))
        peaks = grid.select(*at, F.inline(F.filter("g", lambda c: c["value"] >= around(F.col("g"), c))))
    else:
        peaks = seen
    d = F.hypot(F.col("i").cast("double"), F.col("j").cast("double"))
    ok = peaks.where((F.col("value") >= least) & (d <= radius)).withColumn("d", d)
    best = ok.groupBy(*at).agg(F.min(F.struct((F.col("d") / (F.col("value") + 1)).alias("score"), "row", "col", "d")).alias("b"))
    joined = points.join(best, reduce(and_, (c == F.col(k) for k, c in at.items())), "left").drop(*at)
    moved = F.col("b").isNotNull()
    new = {"x": F.when(moved, F.col("b.col") + 0.5).otherwise(F.col("x")), "y": F.when(moved, F.col("b.row") + 0.5).otherwise(F.col("y")), "position_corrected": moved, "correction_distance": F.coalesce("b.d", F.lit(0.0))}
    return joined.withColumns(new).drop("b")


def adaptive_radius(points: DataFrame, cells: DataFrame, sample: int = 1000, most: float = 5.0, key: str = "id", footprint: int = 3) -> int:
    """max(1, ceil(P90 of the best peak's distance within ``most``)) over a sample of rows by hash; ceil(most) without peaks."""
    some = points.orderBy(F.xxhash64(F.lit(42), key), key).limit(sample)
    found = snap_to_peak(some, cells, most, footprint, key=key).where("position_corrected").agg(F.percentile("correction_distance", 0.9)).first()[0]
    import math

    return math.ceil(most) if found is None else max(1, math.ceil(found))


def raster_validate(composite: DataFrame, bands: list[str], least: float = 0.5) -> DataFrame:
    """(city, month, n_cells, coverage, valid) and bounds: coverage is the mean share of non-NULL values of the bands."""
    share = sum((F.count(b) for b in bands[1:]), F.count(bands[0])) / (F.count(F.lit(1)) * len(bands))
    by = composite.groupBy("city", "month").agg(F.count("*").alias("n_cells"), share.alias("coverage"), *(f(c).alias(f"{n}_{c}") for c in ("col", "row") for n, f in (("min", F.min), ("max", F.max))))
    return by.withColumn("valid", F.col("coverage") > least)
