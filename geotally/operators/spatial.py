"""Spatial operators over points in metres. Neighbour searches are equi-joins on grid cells, never distance-only joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotally.functions.folders import checkpointed
from geotally.operators import polygons, quadtree
from geotally.operators.polygons import ring_area
from geotally.operators.stats import exact_quantiles


def cells(size: float, x: str = "x", y: str = "y") -> tuple[Column, Column]:
    return F.floor(F.col(x) / size), F.floor(F.col(y) / size)


def around(df: DataFrame, size: float) -> DataFrame:
    """df once for each of the nine cells about its own, as (__cx, __cy)."""
    cx, cy = cells(size)
    nine = F.array(*(F.struct((cx + i).alias("__cx"), (cy + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return df.select("*", F.inline(nine))


def in_cells(df: DataFrame, size: float) -> DataFrame:
    cx, cy = cells(size)
    return df.select("*", cx.alias("__cx"), cy.alias("__cy"))


def distance() -> Column:
    return F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))


def utm_from_lonlat(lon: Column, lat: Column, central: float = 15.0) -> tuple[Column, Column]:
    """Easting and northing (transverse Mercator on the GRS 80 ellipsoid, scale 0.9996) by the third-order Krueger series."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - central)
    e = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + reduce(lambda s, k: s + alpha[k] * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta), range(3), F.lit(0.0))
    north = xi + reduce(lambda s, k: s + alpha[k] * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta), range(3), F.lit(0.0))
    return 500000.0 + 0.9996 * radius * east, 0.9996 * radius * north


def lonlat_from_utm(x: Column, y: Column, central: float = 15.0) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of an easting and northing: the inverse of utm_from_lonlat(), fourth order."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi, eta = y / (0.9996 * radius), (x - 500000.0) / (0.9996 * radius)
    north = xi - reduce(lambda s, k: s + beta[k] * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta), range(4), F.lit(0.0))
    east = eta - reduce(lambda s, k: s + beta[k] * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta), range(4), F.lit(0.0))
    conformal = F.asin(F.sin(north) / F.cosh(east))
    phi = conformal + reduce(lambda s, k: s + delta[k] * F.sin(2 * (k + 1) * conformal), range(4), F.lit(0.0))
    return central + F.degrees(F.atan2(F.sinh(east), F.cos(north))), F.degrees(phi)


METRES, DEGREES = "EPSG:25833", ("EPSG:4326", "EPSG:4258")


def reproject(df: DataFrame, crs: str | None, lon: str = "x", lat: str = "y", to: str = METRES) -> DataFrame:
    """x and y in metres (zone of 15 degrees east) or, with to="EPSG:4326", in degrees. A table already in that system stays; a missing reference system is an error."""
    if crs is None:
        raise ValueError("the table has no reference system")
    for name in (crs, to):
        if name != METRES and name not in DEGREES:
            raise ValueError(f"unsupported reference system {name}")
    if (crs == METRES) == (to == METRES):
        return df
    x, y = (utm_from_lonlat if to == METRES else lonlat_from_utm)(F.col(lon), F.col(lat))
    return df.withColumns({"x": x, "y": y})


def within_buffered_boundary(df: DataFrame, boundary: DataFrame, buffer: float = 500.0, city: str = "city") -> DataFrame:
    """Points within buffer of their city's polygons. boundary: (city, part, ring array of (x, y)), see polygons; without part each row is one."""
    return polygons.located(df, boundary, buffer, city).where("__within").drop("__within")


def validate_within(df: DataFrame, boundary: DataFrame, tolerance: float = 10.0, city: str = "city") -> DataFrame:
    found = polygons.located(df, boundary, tolerance, city)
    return found.groupBy(city).agg(F.count("*").alias("n"), F.count_if(~F.col("__within")).alias("n_outside"))


def largest_polygon(parts: DataFrame, key: str) -> DataFrame:
    """(key, ring): the part of largest area. parts: (key, ring)."""
    return parts.groupBy(key).agg(F.max_by("ring", ring_area(F.col("ring"))).alias("ring"))


def spatial_blocks(df: DataFrame, size: float, city: str = "city", out: str = "block_id") -> DataFrame:
    """Block ids: 8 letters of the city and the cell counted from the city's least x and y."""
    least = df.groupBy(F.col(city).alias("__city")).agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    joined = df.join(least, df[city].eqNullSafe(least["__city"]))
    bx, by = F.floor((F.col("x") - F.col("__x")) / size), F.floor((F.col("y") - F.col("__y")) / size)
    name = F.format_string("%s_%04d_%04d", F.substring(F.lower(F.regexp_replace(F.trim(city), r"\s+", "_")), 1, 8), bx, by)
    return joined.select(*df.columns, name.alias(out))


def grid_counts(df: DataFrame, sizes: list[float], least_blocks: int = 30, city: str = "city") -> DataFrame:
    """(city, size, n_blocks, mean_per_block, feasible) for candidate block sizes: cells counted once for all sizes."""
    many = df.select(city, "x", "y", F.explode(F.array(*(F.lit(float(s)) for s in sizes))).alias("size"))
    cell = many.groupBy(city, "size", F.floor(F.col("x") / F.col("size")).alias("cx"), F.floor(F.col("y") / F.col("size")).alias("cy")).agg(F.count("*").alias("n"))
    return cell.groupBy(city, "size").agg(F.count("*").alias("n_blocks"), F.avg("n").alias("mean_per_block"), (F.count("*") >= least_blocks).alias("feasible"))


#: Points of a leaf in searches; points of a grid cell from which on a radius is searched by the tree instead of by the grid's cells.
LEAF, CROWD = 64, 512
#: Points of a leaf where neighbours within a lag are summed.
CLUMP = 256


def _classed(df: DataFrame, cls: str) -> Column:
    """The class as text; rows without one make up a class of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(cls).cast("string")), F.lit(""))


def nearest_other_class_distance(df: DataFrame, cls: str, key: str = "id", max_radius: float | None = None) -> DataFrame:
    """df with distance: exact to the nearest row of another class; inf if there is none (or none within max_radius); NULL without class or place.

    Rows without class count as neighbours of another class. Rows of one class and place are searched for once, in a quadtree of the places.
    """
    d = df.select(_classed(df, cls).alias("c"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    kinds = checkpointed(d.distinct().withColumn("q", F.monotonically_increasing_id()))
    places = kinds.groupBy("x", "y").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    tree = quadtree.build(places, LEAF, {"lo": (F.min("lo"), F.min("lo")), "hi": (F.max("hi"), F.max("hi"))})
    queries = kinds.where("c <> ''").join(tree.points.select("x", "y", "__g", "leaf"), ["x", "y"])
    sites = tree.points.select("__g", "leaf", "x", "y", F.lit(0).cast("long").alias("q"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("c"))
    found = quadtree.nearest(queries, tree, sites, 1, "q", other_class=True, limit=max_radius).select("q", "distance")
    known = kinds.join(found, "q").select(F.col("c").alias("__c"), F.col("x").alias("__x"), F.col("y").alias("__y"), "distance")
    has = F.col(cls).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    joined = df.join(known, (_classed(df, cls) == F.col("__c")) & (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")), "left")
    return joined.withColumn("distance", F.when(has, F.coalesce("distance", F.lit(math.inf)))).drop("__c", "__x", "__y")


def k_nearest(df: DataFrame, k: int, key: str = "id", cls: str | None = None) -> DataFrame:
    """(key, rank, site, site_c, distance): the k nearest rows of each row with a place, itself included; equal distances by key. Keys are unique.

    Of rows at one place only the k with the least keys can be among anybody's nearest; the others aren't searched for.
    """
    c = _classed(df, cls) if cls else F.lit("")
    d = df.select(key, c.alias("c"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    first = d.withColumn("__k", F.row_number().over(Window.partitionBy("x", "y").orderBy(key))).where(F.col("__k") <= k).drop("__k")
    tree = quadtree.build(first, max(LEAF, 2 * k))
    queries = d.join(tree.points.select("x", "y", "__g", "leaf").distinct(), ["x", "y"])
    return quadtree.nearest(queries, tree, tree.points, k, key)


def nearest_other_class_knn(df: DataFrame, cls: str, k: int = 50, key: str = "id") -> DataFrame:
    """df with distance to the first row of another class among the k nearest besides the row itself (k + 1 with it).

    inf in two cases: all of them have its class, or the very first of the k + 1 is of another class, which is a row at the same place with
    a smaller key. NULL without class or place.
    """
    near = k_nearest(df, k + 1, key, cls).select(F.col(key).alias("__key"), "rank", "site_c", F.col("distance").alias("__d"))
    both = df.join(near, df[key] == F.col("__key")).where(F.col("site_c") != _classed(df, cls))
    first = both.groupBy(F.col("__key")).agg(F.min(F.struct("rank", "__d")).alias("__first"))
    has = F.col(cls).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    found = F.when(F.col("__first.rank") > 1, F.col("__first.__d"))
    return df.join(first, df[key] == F.col("__key"), "left").withColumn("distance", F.when(has, F.coalesce(found, F.lit(math.inf)))).drop("__key", "__first")


def crowded(df: DataFrame, size: float, *keys: str) -> bool:
    """Whether a cell of this size holds over CROWD points (of one combination of keys): then its points aren't compared by the grid's cells."""
    cx, cy = cells(size)
    return not df.groupBy(*keys, cx.alias("__cx"), cy.alias("__cy")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).isEmpty()


def proximity_filter(df: DataFrame, threshold: float, cls: str, key: str = "id") -> DataFrame:
    """Rows with class and place and no row of another class strictly nearer than the threshold."""
    d = df.where(F.col(cls).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    sites = df.select(F.col(cls).alias("__c"), "x", "y").where("x is not null and y is not null").distinct()
    if crowded(sites, threshold):
        return nearest_other_class_distance(df, cls, key, max_radius=threshold).where(F.col("distance") >= threshold).select(*df.columns)
    a = around(d.select(key, F.col(cls).alias("__c"), "x", "y"), threshold).alias("a")
    close = a.join(in_cells(sites, threshold).alias("b"), ["__cx", "__cy"]).where(~F.col("a.__c").eqNullSafe(F.col("b.__c")) & (distance() < threshold)).select(F.col(f"a.{key}").alias(key)).distinct()
    return d.join(close, key, "left_anti")


def proximity_impact(df: DataFrame, threshold: float, cls: str, key: str = "id") -> DataFrame:
    """(cls, total, removed, rate, deviates): deviates by more than 0.10 from the mean rate of classes."""
    kept = proximity_filter(df, threshold, cls, key).select(key, F.lit(1).alias("__kept"))
    by = df.where(F.col(cls).isNotNull()).join(kept, key, "left").groupBy(cls).agg(F.count("*").alias("total"), F.count_if(F.col("__kept").isNull()).alias("removed"))
    by = by.withColumn("rate", F.col("removed") / F.col("total"))
    mean = by.agg(F.avg("rate").alias("__mean"))
    return by.join(F.broadcast(mean)).withColumn("deviates", F.abs(F.col("rate") - F.col("__mean")) > 0.10).drop("__mean")  # one row


def proximity_sensitivity(distances: DataFrame, thresholds: list[float], cls: str, city: str = "city") -> DataFrame:
    """(threshold, city, removed, retained, retention, class_range), city NULL: overall; class_range: largest minus least rate of removal of a class."""
    many = distances.where("distance is not null").select(city, cls, "distance", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    cube = many.groupBy("threshold", cls, city).agg(F.count("*").alias("n"), F.count_if(F.col("distance") < F.col("threshold")).alias("removed"))
    both = cube.unionByName(cube.groupBy("threshold", cls).agg(F.sum("n").alias("n"), F.sum("removed").alias("removed")).withColumn(city, F.lit(None).cast("string")))
    rate = F.col("removed") / F.col("n")
    return both.groupBy("threshold", city).agg(F.sum("removed").alias("removed"), (F.sum("n") - F.sum("removed")).alias("retained"), (1 - F.sum("removed") / F.sum("n")).alias("retention"), (F.max(rate) - F.min(rate)).alias("class_range"))


def distance_distribution(distances: DataFrame, city: str = "city") -> DataFrame:
    d = distances.where(F.col("distance") < math.inf)
    qs = {f"p{int(q * 100):02d}": q for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}
    by = d.groupBy(city).agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"), F.min("distance").alias("min"), F.max("distance").alias("max"))
    by = by.join(exact_quantiles(d, [city], "distance", list(qs.values())).withColumnRenamed(city, "__city"), F.col(city).eqNullSafe(F.col("__city")))
    return by.select(city, "n", "mean", "std", "min", "max", *(F.col("__q")[i].alias(k) for i, k in enumerate(qs)))


def _of_neighbours(z: DataFrame, features: list[str], lags: list[float], key: str, city: str) -> DataFrame:
    """(key, n0.., s0_feature..): of each row, the other rows of its city within each lag and the sums of their values."""
    size = max(lags)
    names = [(i, f) for i in range(len(lags)) for f in features]
    if crowded(z, size, city):
        placed = z.where("x is not null and y is not null").select(key, F.col(city), "x", "y", *(F.coalesce(F.col(f), F.lit(0.0)).alias(f"v{j}") for j, f in enumerate(features)))
        values = [f"v{j}" for j in range(len(features))]
        tree = quadtree.build(placed, CLUMP, {v: (F.sum(v), F.sum(v)) for v in values}, city)
        near = quadtree.within(tree, lags, values, key).join(placed.select(key, *(F.col(v).alias(f"own_{v}") for v in values)), key)
        mine = [F.when(F.col("lag") == float(lag), F.col("n") - 1) for lag in lags]
        sums = [F.coalesce(F.max(n), F.lit(0)).alias(f"n{i}") for i, n in enumerate(mine)]
        sums += [F.max(F.when(F.col("lag") == float(lags[i]), F.col(f"v{features.index(f)}") - F.col(f"own_v{features.index(f)}"))).alias(f"s{i}_{f}") for i, f in names]
        return near.groupBy(key).agg(*sums)
    a, b = around(z.select(key, city, "x", "y"), size).alias("a"), in_cells(z, size).alias("b")
    near = a.join(b, [city, "__cx", "__cy"]).where((F.col(f"a.{key}") != F.col(f"b.{key}")) & (distance() <= size))
    sums = [F.count_if(distance() <= lag).alias(f"n{i}") for i, lag in enumerate(lags)]
    sums += [F.sum(F.when(distance() <= lags[i], F.col(f"b.{f}"))).alias(f"s{i}_{f}") for i, f in names]
    return near.groupBy(F.col(f"a.{key}").alias(key)).agg(*sums)


def morans_i(df: DataFrame, features: list[str], lags: list[float], key: str = "id", city: str = "city") -> DataFrame:
    """(city, feature, lag, morans_i): binary distance bands, row-standardised; rows without neighbour count 0. One search for all lags and features.

    Where a cell of the largest lag is crowded, cells that lie within a lag as a whole count by number and sum; only the others' points are compared.
    """
    mean = df.groupBy(F.col(city).alias("__city")).agg(*(F.avg(f).alias(f"__m_{f}") for f in features))
    z = checkpointed(df.join(mean, df[city] == mean["__city"]).select(key, city, "x", "y", *((F.col(f) - F.col(f"__m_{f}")).alias(f) for f in features)))
    joined = z.join(_of_neighbours(z, features, lags, key, city), key, "left")
    out = [F.sum(F.when(F.col(f"n{i}") > 0, F.col(f) * F.col(f"s{i}_{f}") / F.col(f"n{i}"))).alias(f"w{i}_{f}") for i in range(len(lags)) for f in features]
    out += [F.count_if(F.col(f"n{i}") > 0).alias(f"k{i}") for i in range(len(lags))] + [F.sum(F.col(f) * F.col(f)).alias(f"q_{f}") for f in features]
    by = joined.groupBy(city).agg(F.count("*").alias("n"), *out)
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(float(lag)).alias("lag"), (F.col("n") / F.nullif(F.col(f"k{i}"), F.lit(0)) * F.col(f"w{i}_{f}") / F.nullif(F.col(f"q_{f}"), F.lit(0.0))).alias("morans_i")) for i, lag in enumerate(lags) for f in features))
    return by.select(city, F.inline(rows)).where("morans_i is not null")


#: Permutations whose values make one table and are looked up among neighbours in one search.
TOGETHER = 33


def permuted(df: DataFrame, feature: str, numbers: list[int], key: str = "id", seed: int = 42) -> DataFrame:
    """(key, x, y, p1, p2, ...): for each number the feature's values dealt anew to the rows, the row of k-th key getting the value of the row whose
    hash of number and key is the k-th. Work grows as rows times numbers; ranks are made within ranges."""
    from geotally.operators.stats import with_rank

    d = df.select(key, "x", "y", F.col(feature).alias("v"))
    place = with_rank(d.withColumn("h", F.col(key).cast("double")), "h", "r").select(F.col("r").cast("long").alias("s"), "v")
    many = d.select(key, "x", "y", F.explode(F.array(*(F.lit(k) for k in numbers))).alias("k")).withColumn("h", F.xxhash64(F.lit(seed), "k", key))
    dealt = with_rank(many, "h", "s", ["k"]).withColumn("s", F.col("s").cast("long")).join(place, "s")
    return dealt.groupBy(key).agg(F.first("x").alias("x"), F.first("y").alias("y"), *(F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"p{k}") for k in numbers))


def morans_i_pvalue(df: DataFrame, feature: str, lag: float, permutations: int = 99, key: str = "id", seed: int = 42) -> dict:
    """Moran's I of one table and its pseudo p-value: values dealt anew by hash order for each permutation. Keys are unique.

    Permutations are columns of one table, a block of them at a time, and each block is one search for neighbours, where crowded cells count by
    their sums: pairs of neighbours are never written, nor repeated for each permutation.
    """
    d = checkpointed(df.where(F.col(feature).isNotNull()).select(key, "x", "y", F.col(feature).cast("double").alias("v")))

    def values(table: DataFrame, columns: list[str]) -> list[float]:
        return [r["morans_i"] for r in morans_i(table.withColumn("__all", F.lit("")), columns, [lag], key, "__all").collect()]  # a row a permutation

    observed = values(d, ["v"])
    if not observed:
        return {"morans_i": None, "pvalue": None, "permutations": permutations}
    above = 0
    for start in range(1, permutations + 1, TOGETHER):
        numbers = list(range(start, min(start + TOGETHER, permutations + 1)))
        above += sum(v >= observed[0] for v in values(checkpointed(permuted(d, "v", numbers, key, seed)), [f"p{k}" for k in numbers]))
    return {"morans_i": observed[0], "pvalue": (above + 1) / (permutations + 1), "permutations": permutations}


def decay_distance(moran: DataFrame, least: float = 0.05, city: str = "city") -> DataFrame:
    """(city, feature, decay): where I first falls under least, interpolated between lags; the first lag if it starts there, the last if it never does."""
    w = Window.partitionBy(city, "feature").orderBy("lag")
    i0, l0 = F.lag("morans_i").over(w), F.lag("lag").over(w)
    crossing = F.when(F.col("morans_i") < least, F.when(i0.isNull(), F.col("lag")).when(i0 >= least, l0 + (i0 - least) / (i0 - F.col("morans_i")) * (F.col("lag") - l0)))
    return moran.select(city, "feature", "lag", crossing.alias("c")).groupBy(city, "feature").agg(F.coalesce(F.min("c"), F.max("lag")).alias("decay"))


def block_size_recommendation(decay: DataFrame) -> DataFrame:
    """(feature, mean, std, max, agree, recommended): agree: the cities differ by at most 50 m; recommended: the largest decay of all, up to a full 100 m."""
    decay = checkpointed(decay)  # a row a city and feature, read twice
    by = decay.groupBy("feature").agg(F.avg("decay").alias("mean"), F.stddev_pop("decay").alias("std"), F.max("decay").alias("max"), (F.max("decay") - F.min("decay") <= 50).alias("agree"))
    top = decay.agg((F.ceil(F.max("decay") / 100) * 100).cast("long").alias("recommended"))
    return by.join(F.broadcast(top))  # one row


def split_boundary_rows(df: DataFrame, split: str, a: str, b: str, buffer: float = 250.0) -> DataFrame:
    """Rows of two splits within buffer of a row of the other."""
    both = df.where(F.col(split).isin(a, b))
    if crowded(both.select(split, "x", "y").distinct(), buffer):
        return nearest_other_class_distance(both, split, max_radius=buffer).where(F.col("distance") <= buffer).select(*df.columns)
    out = None
    for x, y in ((a, b), (b, a)):
        left, right = around(df.where(F.col(split) == x), buffer), in_cells(df.where(F.col(split) == y).select("x", "y").distinct(), buffer)
        hit = left.alias("a").join(right.alias("b"), ["__cx", "__cy"]).where(distance() <= buffer).select(*(F.col(f"a.{c}").alias(c) for c in df.columns)).distinct()
        out = hit if out is None else out.unionByName(hit)
    return out


def post_split_independence(df: DataFrame, split: str, feature: str, lag: float, key: str = "id", buffer: float = 250.0) -> DataFrame:
    """(part, morans_i, independent): within each split and on the border of each pair; independent: the borders' largest is under the splits' largest."""
    names = sorted(r[0] for r in df.select(split).distinct().collect())  # splits
    parts = [df.where(F.col(split) == s).withColumn("part", F.lit(s)) for s in names]
    parts += [split_boundary_rows(df, split, a, b, buffer).withColumn("part", F.lit(f"{a}|{b}")) for i, a in enumerate(names) for b in names[i + 1 :]]
    every = checkpointed(reduce(DataFrame.unionByName, parts).select("part", "x", "y", feature, F.concat_ws(":", "part", F.col(key).cast("string")).alias("__id")))  # a row can be in several parts
    found = checkpointed(morans_i(every, [feature], [lag], "__id", "part"))  # a row a part, read twice
    between = F.col("part").contains("|")
    rule = found.agg((F.max(F.when(between, F.col("morans_i"))) < F.max(F.when(~between, F.col("morans_i")))).alias("independent"))
    return found.select("part", "morans_i").join(F.broadcast(rule))  # one row


def ripley_k(df: DataFrame, distances: list[float], area: float, key: str = "id") -> DataFrame:
    """(distance, k, expected): area * ordered pairs within the distance / (n (n - 1)), against pi d^2."""
    size = max(distances)
    if crowded(df, size):
        tree = quadtree.build(checkpointed(df.select(key, "x", "y").where("x is not null and y is not null")), CLUMP)
        near = quadtree.within(tree, distances, [], key).agg(*(F.coalesce(F.sum(F.when(F.col("lag") == float(d), F.col("n") - 1)), F.lit(0)).alias(f"n{i}") for i, d in enumerate(distances)))
    else:
        a, b = around(df.select(key, "x", "y"), size).alias("a"), in_cells(df.select(key, "x", "y"), size).alias("b")
        near = a.join(b, ["__cx", "__cy"]).where(F.col(f"a.{key}") != F.col(f"b.{key}")).agg(*(F.count_if(distance() <= d).alias(f"n{i}") for i, d in enumerate(distances)))
    both = near.join(F.broadcast(df.agg(F.count("*").alias("n"))))  # one row
    return both.select(F.inline(F.array(*(F.struct(F.lit(float(d)).alias("distance"), (area * F.col(f"n{i}") / (F.col("n") * (F.col("n") - 1))).alias("k"), F.lit(math.pi * d * d).alias("expected")) for i, d in enumerate(distances)))))


def remove_duplicate_ids(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, in an explicit order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", first).where("__k = 1").drop("__k")


def remove_coincident_points(df: DataFrame, order: list) -> DataFrame:
    return remove_duplicate_ids(df, ["x", "y"], order)


def remove_near_points(df: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """Rows without a row of smaller key within the radius. Rows without place or key stay.

    Cells are so small that all of a cell's rows lie within the radius: only its least key can stay, and is compared with the 25 cells around it. So a row
    meets 25 others at most, however dense the rows are.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    cell = in_cells(df.select(key, "x", "y").where("x is not null and y is not null"), radius / 1.5)
    least = cell.groupBy("__cx", "__cy").agg(F.min(key).alias("__least"))
    own = cell.join(least, ["__cx", "__cy"])
    reach = range(-2, 3)
    around25 = F.array(*(F.struct((F.col("__cx") + i).alias("__cx"), (F.col("__cy") + j).alias("__cy")) for i in reach for j in reach))
    a, b = own.where(F.col(key) == F.col("__least")).select(key, "x", "y", F.inline(around25)).alias("a"), cell.alias("b")
    near = a.join(b, ["__cx", "__cy"]).where((F.col(f"b.{key}") < F.col(f"a.{key}")) & (distance() <= radius)).select(F.col(f"a.{key}").alias(key))
    later = own.where(F.col(key) > F.col("__least")).select(key).unionByName(near).distinct()
    return df.join(later, key, "left_anti")
