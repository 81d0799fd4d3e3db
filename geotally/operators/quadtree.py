"""A quadtree over points as tables, and neighbour searches that descend it: no cell size to choose, dense places just split further.

A cell is split until it holds at most `most` points. Searches start from the pairs of a few coarse cells (at most
4 ** START a group) and replace pairs of cells by pairs of their children, round by round; what their bounding boxes rule out or settle goes, and only
pairs of leaves that are left are looked at point by point. A node's box and stats travel with it, so points of no interest are never joined.
Ids pack level and cell: level << 48 | column << 24 | row, with DEPTH levels at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotally.functions.folders import checkpointed

DEPTH, START = 22, 2
#: Levels that are counted in one pass, and by which a search descends in one round.
COUNTED, STRIDE = 4, 2
#: Query points of one leaf that are handled in one group; more are dealt over several.
GROUP = 4096
#: Sites of a run that count as a whole where they can, query points that are looked up together, and sites that these are compared with at a time.
RUN, QUERIES, SITES = 32, 64, 2048
BOX = {"x0": F.min, "x1": F.max, "y0": F.min, "y1": F.max}


@dataclass
class Tree:
    """nodes: g, id, parent, level, leaf, n, x0, x1, y0, y1 and the stats. points: the given rows with leaf. levels: of the leaves."""

    nodes: DataFrame
    points: DataFrame
    levels: list[int]


def _packed(level, fx: Column, fy: Column) -> Column:
    """Id of the cell of this level about a point, from its cell of the deepest level."""
    level = F.lit(level) if isinstance(level, int) else level
    by = (F.lit(DEPTH) - level).cast("int")
    return F.shiftleft(level.cast("long"), 48).bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", fx, by), F.lit(24))).bitwiseOR(F.call_function("shiftright", fy, by))


def ancestor(node: Column, level: Column, up: Column) -> Column:
    """Id of the node so many levels above."""
    mask = F.lit((1 << 24) - 1).cast("long")
    col, row = F.shiftright(node, 24).bitwiseAND(mask), node.bitwiseAND(mask)
    return F.shiftleft((level - up).cast("long"), 48).bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", col, up.cast("int")), F.lit(24))).bitwiseOR(F.call_function("shiftright", row, up.cast("int")))


def build(points: DataFrame, most: int, stats: dict[str, tuple[Column, Column]] | None = None, group: str | None = None) -> Tree:
    """The tree of points (x, y, not null); one a group. stats: name -> (aggregate of points, the same of nodes' columns of that name).

    Points at one place can't be split: a leaf of the deepest level may hold more than `most`.
    """
    stats = stats or {}
    g = F.col(group) if group else F.lit(0)
    box = points.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("u"), F.max("y").alias("v"), F.count(F.lit(1)).alias("n")).first()
    span = max((box["u"] or 0) - (box["x"] or 0), (box["v"] or 0) - (box["y"] or 0), 1e-9) * (1 + 1e-9)
    cell = lambda c, low: F.least(F.floor((F.col(c) - low) / span * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long")
    placed = points.select("*", g.alias("__g"), cell("x", box["x"] or 0.0).alias("__fx"), cell("y", box["y"] or 0.0).alias("__fy"))
    own = [F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), *(a.alias(k) for k, (a, _) in stats.items())]
    merged = [F.sum("n").alias("n"), *(f(k).alias(k) for k, f in BOX.items()), *(m.alias(k) for k, (_, m) in stats.items())]
    level = min(DEPTH - 1, max(START, math.ceil(math.log((box["n"] or 0) / most + 1, 4)) + 1))

    def counted(rows: DataFrame, levels: list[int]) -> DataFrame:
        at = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), _packed(k, F.col("__fx"), F.col("__fy")).alias("id")) for k in levels)))
        return checkpointed(rows.withColumn("__at", at).groupBy(F.col("__g").alias("g"), "__at").agg(*own).select("g", "__at.*", "n", *BOX, *stats))

    first = counted(placed, [level])
    above = first.withColumn("__up", F.explode(F.sequence(F.lit(1), F.lit(level)))).select("g", ancestor(F.col("id"), F.col("level"), F.col("__up")).alias("id"), (F.col("level") - F.col("__up")).alias("level"), "n", *BOX, *stats)
    every, open_, last = [above.groupBy("g", "id", "level").agg(*merged), first], placed, first
    while level < DEPTH:
        dense = last.where((F.col("n") > most) & (F.col("level") == level)).select(F.col("g").alias("__g"), F.col("id").alias("__id"))
        if dense.isEmpty():
            break
        here = open_.withColumn("__id", _packed(level, F.col("__fx"), F.col("__fy")))
        open_, down = here.join(dense, ["__g", "__id"], "left_semi").drop("__id"), list(range(level + 1, min(DEPTH, level + COUNTED) + 1))
        last, level = counted(open_, down), down[-1]
        every.append(last)
    nodes = reduce(DataFrame.unionByName, every).withColumn("parent", F.when(F.col("level") > 0, ancestor(F.col("id"), F.col("level"), F.lit(1))))
    over = nodes.where(F.col("n") > most).select(F.col("g").alias("__g"), F.col("id").alias("__p"))
    real = nodes.join(over, (F.col("g") == F.col("__g")) & (F.col("parent") == F.col("__p")), "left_semi").unionByName(nodes.where("level = 0"))
    real = checkpointed(real.withColumn("leaf", (F.col("n") <= most) | (F.col("level") == DEPTH)))
    levels = sorted(r[0] for r in real.where("leaf").select("level").distinct().collect())
    leaves = real.where("leaf").select(F.col("g").alias("__g"), F.col("id").alias("leaf"))
    many = placed.withColumn("leaf", F.explode(F.array(*(_packed(k, F.col("__fx"), F.col("__fy")) for k in levels)))) if levels else placed.withColumn("leaf", F.lit(0).cast("long"))
    return Tree(real, checkpointed(many.join(leaves, ["__g", "leaf"]).drop("__fx", "__fy")), levels)


def _gap(a: str, b: str, c: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{b}.{c}0") - F.col(f"{a}.{c}1"), F.col(f"{a}.{c}0") - F.col(f"{b}.{c}1"))


def nearest_of_boxes() -> Column:
    """Least distance of points in the boxes of a and b, a little less for the sake of rounding."""
    return F.hypot(_gap("a", "b", "x"), _gap("a", "b", "y")) * (1 - 1e-12)


def farthest_of_boxes() -> Column:
    wide = [F.greatest(F.col(f"b.{c}1") - F.col(f"a.{c}0"), F.col(f"a.{c}1") - F.col(f"b.{c}0")) for c in "xy"]
    return F.hypot(*wide) * (1 + 1e-12)


def _steps(nodes: DataFrame, loops: bool) -> DataFrame:
    """(g, from, node): what a node becomes in the next round, its descendants STRIDE levels below or leaves before that; with loops a leaf becomes itself."""
    short = F.when(F.col("leaf"), F.sequence(F.lit(0 if loops else 1), F.least(F.lit(STRIDE), F.col("level"))))
    ups = F.coalesce(F.when(F.col("leaf") & (F.col("level") == 0), F.array(F.lit(0)) if loops else F.array().cast("array<int>")), short, F.when(F.col("level") >= STRIDE, F.array(F.lit(STRIDE))))
    return nodes.withColumn("up", F.explode(ups)).select("g", ancestor(F.col("id"), F.col("level"), F.col("up")).alias("from"), "node")


def _start(nodes: DataFrame) -> DataFrame:
    """(g, a, b): all pairs of the few nodes that searches begin with, those of level START and the leaves above it; 4 ** START nodes a group at most."""
    first = nodes.where((F.col("level") == START) | (F.col("leaf") & (F.col("level") < START)))
    return first.select("g", F.col("node").alias("a")).join(first.select("g", F.col("node").alias("b")), "g")


def _rounds(tree: Tree) -> int:
    return max(0, -(-(max(tree.levels, default=0) - START) // STRIDE))


def _nodes(tree: Tree, fields: list[str]) -> DataFrame:
    """(g, id, level, leaf, node): node has all that a search asks of it; point says that it is a single place."""
    node = F.struct("id", "level", "leaf", F.lit(False).alias("point"), "n", *BOX, *fields)
    return tree.nodes.select("g", "id", "level", "leaf", node.alias("node"))


def _places(tree: Tree, fields: dict[str, Column], key: str | None = None) -> DataFrame:
    """(g, id, node): the points of each leaf as nodes of their own, so that a leaf with a wide box isn't compared as a whole with all of a dense place."""
    of = F.struct(F.col("leaf").alias("id"), F.lit(DEPTH).alias("level"), F.lit(True).alias("leaf"), F.lit(True).alias("point"), F.lit(1).cast("long").alias("n"), *(F.col(k[0]).alias(k) for k in BOX), *(v.alias(k) for k, v in fields.items()))
    return tree.points.select(F.col("__g").alias("g"), F.col("leaf").alias("id"), of.alias("node"), *([F.col(key).alias("key")] if key else []))


def candidates(tree: Tree, k: int, other_class: bool, limit: float | None) -> DataFrame:
    """(g, a, b): pairs of leaves such that b may hold one of the k nearest points (of another class) of a point in a.

    Of each node a, enough points are known within some distance (the farthest of enough boxes, nearest boxes first): boxes beyond it
    go. A leaf that still has undivided cells to look at goes on as its single places.
    """
    fields = ["lo", "hi"] if other_class else []
    nodes, places = _nodes(tree, fields), _places(tree, {f: F.col(f) for f in fields}).distinct()
    one_a, one_b = F.col("a.lo") == F.col("a.hi"), F.col("b.lo") == F.col("b.hi")
    same = one_a & one_b & (F.col("a.lo") == F.col("b.lo")) if other_class else F.lit(False)
    usable = F.when(~one_b, 1).when(one_a & (F.col("a.lo") != F.col("b.lo")), F.col("b.n")).otherwise(0) if other_class else F.col("b.n")
    each = Window.partitionBy("g", "a")

    def pruned(pairs: DataFrame) -> DataFrame:
        both = pairs.where(~same).select("g", "a", F.col("b.id").alias("b"), F.col("b.leaf").alias("lb"), nearest_of_boxes().alias("near"), farthest_of_boxes().alias("far"), usable.alias("u"))
        upto = F.sum("u").over(each.orderBy("far", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        reach = F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("far"))).over(each), F.lit(math.inf))
        found = both.withColumn("upto", upto).withColumn("reach", reach).where(F.col("near") <= (F.col("reach") if limit is None else F.least("reach", F.lit(float(limit)))))
        return checkpointed(found.select("g", "a", "b", (F.col("a.leaf") & ~F.col("a.point") & F.max(~F.col("lb")).over(each)).alias("apart")))

    pairs, down, into = pruned(_start(nodes)), _steps(nodes, False), _steps(nodes, True).select("g", F.col("from").alias("b"), F.col("node").alias("to"))
    for _ in range(_rounds(tree)):
        p = pairs.withColumn("from", F.col("a.id"))
        lower = p.where(~F.col("a.leaf")).join(down, ["g", "from"]).select("g", F.col("node").alias("a"), "b")
        single = p.where("apart").join(places.withColumnRenamed("id", "from"), ["g", "from"]).select("g", F.col("node").alias("a"), "b")
        every = lower.unionByName(single).unionByName(p.where(F.col("a.leaf") & ~F.col("apart")).select("g", "a", "b"))
        pairs = pruned(every.join(into, ["g", "b"]).select("g", "a", F.col("to").alias("b")))
    return pairs.select("g", F.col("a.id").alias("a"), "b").distinct()


def nearest(queries: DataFrame, tree: Tree, sites: DataFrame, k: int, key: str, other_class: bool = False, limit: float | None = None) -> DataFrame:
    """(key, rank, site, site_c, distance) of the k nearest sites of each query, equal distances by the site's key.

    queries and sites: key, c, x, y, __g, leaf, with leaves of the tree; the tree's points are the sites' places at least. With other_class sites
    of the query's own class don't count. A leaf's queries are handled together, GROUP of them at a time, with the sites of the leaves that may matter.
    """
    pairs = candidates(tree, k, other_class, limit)
    counts = queries.groupBy("__g", "leaf").agg(F.count(F.lit(1)).alias("__n"))
    parts = counts.select("__g", "leaf", F.ceil(F.col("__n") / GROUP).alias("__parts"))
    q = queries.join(parts, ["__g", "leaf"]).select(F.col("__g").alias("g"), F.col("leaf").alias("a"), F.pmod(F.xxhash64(key), F.col("__parts")).alias("part"), F.col(key).alias("key"), "c", "x", "y")
    wanted = pairs.join(parts.select(F.col("__g").alias("g"), F.col("leaf").alias("a"), "__parts"), ["g", "a"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    s = wanted.join(sites.select(F.col("__g").alias("g"), F.col("leaf").alias("b"), F.col(key).alias("site"), F.col("c").alias("sc"), F.col("x").alias("sx"), F.col("y").alias("sy")), ["g", "b"]).drop("b", "__parts")

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x, y = left["key"], left["x"].to_numpy(), left["y"].to_numpy()
        order = np.argsort(right["site"].to_numpy(), kind="stable")
        sites_, sx, sy = right["site"].to_numpy()[order], right["sx"].to_numpy()[order], right["sy"].to_numpy()[order]
        c, sc = np.array(left["c"].to_pylist(), object), np.array(right["sc"].to_pylist(), object)[order]
        rows, ranks, found, classes, far = [], [], [], [], []
        step = max(1, (1 << 21) // max(1, len(sites_)))
        for at in range(0, len(x), step):
            d = np.hypot(x[at : at + step, None] - sx, y[at : at + step, None] - sy)
            if other_class:
                d[c[at : at + step, None] == sc] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(d, best, 1)
            i, r = np.nonzero(np.isfinite(dist) & (dist <= (np.inf if limit is None else limit)))
            rows.append(i + at)
            ranks.append(r + 1)
            found.append(sites_[best[i, r]])
            classes.append(sc[best[i, r]])
            far.append(dist[i, r])
        i = np.concatenate(rows) if rows else np.zeros(0, int)
        columns = [ids.take(pa.array(i)).combine_chunks(), *(pa.array(np.concatenate(v) if v else [], t) for v, t in ((ranks, pa.int32()), (found, right["site"].type), (classes, pa.string()), (far, pa.float64())))]
        return pa.table(dict(zip((key, "rank", "site", "site_c", "distance"), columns, strict=True)))

    kind = queries.schema[key].dataType.simpleString()
    return q.groupBy("g", "a", "part").cogroup(s.groupBy("g", "a", "part")).applyInArrow(ranked, f"`{key}` {kind}, rank int, site {kind}, site_c string, distance double")


def _shuffled(v: np.ndarray) -> np.ndarray:
    """Bits of 16-bit numbers with a zero after each."""
    for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = (v | v << by) & mask
    return v


def _along(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An order of points in which those next to each other are mostly near each other."""
    span = max(np.ptp(x), np.ptp(y), 1e-9)
    a, b = (((v - v.min()) / span * 65535).astype(np.int64) for v in (x, y))
    return np.argsort(_shuffled(a) << 1 | _shuffled(b), kind="stable")


def sums_within(x: np.ndarray, y: np.ndarray, sites: np.ndarray, lag: float) -> np.ndarray:
    """[point, 1 + values]: number and sums of values of the sites (rows of x, y, values) at most lag away from each point.

    Both are cut into runs of near ones; runs of sites that lie within or beyond the lag as a whole aren't looked at one by one.
    """
    out = np.zeros((len(x), sites.shape[1] - 1))
    if not len(x) or not len(sites):
        return out
    sites = sites[_along(sites[:, 0], sites[:, 1])]
    sx, sy, v = np.ascontiguousarray(sites[:, 0]), np.ascontiguousarray(sites[:, 1]), np.hstack([np.ones((len(sites), 1)), sites[:, 2:]])
    starts = np.arange(0, len(sites), RUN)
    (x0, y0), (x1, y1) = ([f.reduceat(c, starts) for c in (sx, sy)] for f in (np.minimum, np.maximum))
    totals = np.add.reduceat(v, starts)
    order, places = _along(x, y), np.arange(RUN)
    for at in range(0, len(x), QUERIES):
        i = order[at : at + QUERIES]
        qx, qy = x[i], y[i]
        gx, gy = (np.maximum(0, np.maximum(lo - q.max(), q.min() - hi)) for lo, hi, q in ((x0, x1, qx), (y0, y1, qy)))
        fx, fy = (np.maximum(hi - q.min(), q.max() - lo) for lo, hi, q in ((x0, x1, qx), (y0, y1, qy)))
        whole = np.hypot(fx, fy) * (1 + 1e-12) <= lag
        some = np.flatnonzero((np.hypot(gx, gy) * (1 - 1e-12) <= lag) & ~whole)
        total = np.repeat(totals[whole].sum(axis=0)[None], len(i), 0)
        j = (starts[some][:, None] + places).ravel()
        j = j[j < len(sites)]
        for k in range(0, len(j), SITES):
            near = j[k : k + SITES]
            dx, dy = qx[:, None] - sx[near], qy[:, None] - sy[near]
            d2 = dx * dx + dy * dy
            inside = d2 <= lag * lag
            edge = np.abs(d2 - lag * lag) <= 1e-9 * lag * lag
            if edge.any():
                inside[edge] = np.hypot(dx[edge], dy[edge]) <= lag
            total += inside.astype(float) @ v[near]
        out[i] = total
    return out


def within(tree: Tree, lags: list[float], sums: list[str], key: str) -> DataFrame:
    """(key, lag, n, sums): of each point, the number of points at most lag away, itself included, and the sums of their values.

    sums: stats of the tree that add up, and columns of its points. Pairs of cells that lie within a lag as a whole count by their n and
    sums. Searching cells are divided until they hold at most GROUP points and are narrow beside the lag; what is left is the ring of leaves
    about each, whose points are compared with the cell's in one group. A wide leaf beside an undivided cell goes on as its single points.
    """
    nodes, places = _nodes(tree, sums), _places(tree, {v: F.col(v) for v in sums}, key)
    down, into = _steps(nodes, False), _steps(nodes, True).select("g", F.col("from").alias("b"), F.col("node").alias("to"))
    totals = [F.sum(v).alias(v) for v in ("n", *sums)]
    settled, close = [], []
    kind = tree.points.schema[key].dataType
    narrow = F.hypot(F.col("a.x1") - F.col("a.x0"), F.col("a.y1") - F.col("a.y0")) <= F.col("lag") / 4
    last = F.col("a.leaf") | ((F.col("a.n") <= GROUP) & narrow)

    def split(pairs: DataFrame) -> DataFrame:
        """Takes what is settled and the pairs of last cells and leaves out of (g, a, key, b, lag); the rest goes on. key: of a single point."""
        far = checkpointed(pairs.select("g", "a", "key", F.col("b.id").alias("b"), F.col("b.leaf").alias("lb"), "lag", (farthest_of_boxes() <= F.col("lag")).alias("all"), nearest_of_boxes().alias("near"), F.col("b.n").alias("n"), *(F.col(f"b.{v}").alias(v) for v in sums)).where(F.col("near") <= F.col("lag")))
        settled.append(far.where("all").groupBy("g", F.col("a.id").alias("id"), "key", "lag").agg(*totals))
        close.append(far.where(~F.col("all") & last & F.col("lb")).select("g", F.col("a.id").alias("id"), "key", "b", "lag"))
        return far.where(~F.col("all") & ~(last & F.col("lb"))).select("g", "a", "key", "b", "lag")

    begin = _start(nodes).withColumn("key", F.lit(None).cast(kind))
    pairs = split(begin.withColumn("lag", F.explode(F.array(*(F.lit(float(v)) for v in lags)))))
    for _ in range(_rounds(tree)):
        p = pairs.withColumn("from", F.col("a.id"))
        apart = F.col("a.leaf") & ~F.col("a.point") & ~narrow
        lower = p.where(~last).join(down, ["g", "from"]).select("g", F.col("node").alias("a"), "key", "b", "lag")
        single = p.where(apart).drop("key").join(places.withColumnRenamed("id", "from"), ["g", "from"]).select("g", F.col("node").alias("a"), "key", "b", "lag")
        every = lower.unionByName(single).unionByName(p.where(last & ~apart).select("g", "a", "key", "b", "lag"))
        pairs = split(every.join(into, ["g", "b"]).select("g", "a", "key", F.col("to").alias("b"), "lag"))
    found, left = reduce(DataFrame.unionByName, settled), checkpointed(reduce(DataFrame.unionByName, close))
    of_nodes = found.where("key is null").groupBy("g", "id", "lag").agg(*totals)
    up = F.explode(F.transform(F.sequence(F.lit(0), F.col("level")), lambda up: ancestor(F.col("id"), F.col("level"), up)))
    leaves = tree.nodes.where("leaf").select("g", F.col("id").alias("leaf"), up.alias("id"))
    of_leaves = leaves.join(of_nodes, ["g", "id"]).groupBy("g", "leaf", "lag").agg(*totals)
    points = tree.points.select(F.col("__g").alias("g"), "leaf", F.col(key).alias("key"), "x", "y", *sums)
    whole = points.select("g", "leaf", "key").join(of_leaves, ["g", "leaf"]).select("key", "lag", "n", *sums)
    ones = left.where("key is not null").withColumnsRenamed({"key": "only", "id": "leaf"}).join(points.select("g", "leaf", "key", F.col("x").alias("ax"), F.col("y").alias("ay")), ["g", "leaf"]).where("only = key")
    near = ones.drop("leaf").join(points.drop("key").withColumnRenamed("leaf", "b"), ["g", "b"]).where(F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= F.col("lag"))
    parts = [whole, found.where("key is not null").select("key", "lag", "n", *sums), near.select("key", "lag", F.lit(1).cast("long").alias("n"), *sums)]
    parts.append(_compared(left.where("key is null").drop("key"), leaves, points, tree, sums, kind.simpleString()))
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("key").alias(key), "lag").agg(*totals)


def _compared(close: DataFrame, leaves: DataFrame, points: DataFrame, tree: Tree, sums: list[str], kind: str) -> DataFrame:
    """(key, lag, n, sums) of the points of cells against those of leaves: close is (g, id, b, lag), leaves is (g, leaf, id) with the cells above each leaf.

    Leaves travel as arrays, GROUP points a row at most; a cell's points are GROUP a group at most. The number of tasks doesn't follow the bytes,
    which say little about the work.
    """
    sizes = tree.nodes.where("leaf").select("g", F.col("id").alias("leaf"), F.ceil(F.col("n") / GROUP).alias("parts"))
    parted = points.join(sizes, ["g", "leaf"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    packed = parted.groupBy("g", F.col("leaf").alias("b"), "part").agg(F.flatten(F.collect_list(F.array("x", "y", *sums))).alias("s")).drop("part")
    cells, tasks = close.select("g", "id", "lag").distinct().join(leaves, ["g", "id"]).join(sizes, ["g", "leaf"]), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of, by = cells.groupBy("g", "id", "lag").agg(F.max("parts").alias("most")), ["g", "id", "lag", "part"]
    q = cells.drop("parts").join(parted.select("g", "leaf", "part", "key", "x", "y"), ["g", "leaf"]).select(*by, "key", "x", "y")
    s = close.join(of, ["g", "id", "lag"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1))).join(packed, ["g", "b"]).select(*(F.col(c).alias(f"s_{c}") for c in by), "s")

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"key": left["key"], "lag": pa.array([], pa.float64()), "n": pa.array([], pa.int64()), **{v: pa.array([], pa.float64()) for v in sums}})
        flat = [c.flatten().to_numpy() for c in right["s"].chunks]
        sites = np.concatenate(flat).reshape(-1, 2 + len(sums)) if flat else np.zeros((0, 2 + len(sums)))
        total = sums_within(left["x"].to_numpy(), left["y"].to_numpy(), sites, left["lag"][0].as_py())
        return pa.table({"key": left["key"], "lag": left["lag"], "n": pa.array(np.rint(total[:, 0]).astype(np.int64)), **{v: pa.array(total[:, i + 1]) for i, v in enumerate(sums)}})

    schema = ", ".join([f"key {kind}", "lag double", "n long", *(f"`{v}` double" for v in sums)])
    same = [f"s_{c}" for c in by]
    return q.repartition(tasks, *by).groupBy(*by).cogroup(s.repartition(tasks, *same).groupBy(*same)).applyInArrow(counted, schema)
