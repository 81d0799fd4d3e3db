"""Spatially disjoint splits, their validation, and samples."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotally.functions.folders import checkpointed


#: Groups of blocks that are dealt to folds on the driver, and the bases of the logarithms by which counts are taken for alike when there are more.
GROUPS, BASES = 4096, (2**0.125, 2**0.5, 2.0, 4.0, 16.0)


def _histograms(df: DataFrame, block: str, cls: str) -> tuple[DataFrame, list]:
    """(b, key, counts): the class counts of every block; and the classes in order. Rows without class count nowhere, their blocks are blocks all the same."""
    classes = [r[0] for r in df.where(F.col(cls).isNotNull()).select(cls).distinct().orderBy(cls).collect()]  # a row a class
    by = df.groupBy(F.col(block).alias("b"), F.col(cls).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    found = by.groupBy("b").agg(F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "n")))).alias("m"))
    kind = df.schema[cls].dataType
    counts = F.array(*(F.coalesce(F.try_element_at("m", F.lit(c).cast(kind)), F.lit(0).cast("long")) for c in classes)) if classes else F.array().cast("array<bigint>")
    key = F.coalesce(F.concat(F.lit("="), F.col("b").cast("string")), F.lit(""))
    return checkpointed(found.select("b", key.alias("key"), counts.alias("counts"))), classes


def _code(base: float | None) -> Column:
    """Blocks of one code are dealt as alike: of equal counts, or without base of the same largest class and about the same size."""
    if base == 1:
        return F.concat_ws(",", F.col("counts").cast("array<string>"))
    if base is None:
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)
        return F.concat_ws(":", F.array_position("counts", F.array_max("counts")).cast("string"), F.floor(F.log2(total + 1)).cast("string"))
    return F.concat_ws(",", F.transform("counts", lambda n: F.floor(F.ln(n + 1) / math.log(base)).cast("string")))


def _deal(sizes: np.ndarray, sums: np.ndarray, n_splits: int, seed: int) -> np.ndarray:
    """How many blocks of each group go to each fold: as many to all as can be, the rest one by one, groups of the most uneven class counts
    first, each block to the fold that keeps the classes' shares most even."""
    mean = sums / sizes[:, None]
    whole, rest = np.divmod(sizes, n_splits)
    quota = np.repeat(whole[:, None], n_splits, axis=1)
    folds = np.repeat((whole[:, None] * mean).sum(axis=0)[None], n_splits, axis=0)
    order = np.random.default_rng(seed).permutation(len(sizes))
    order = order[np.argsort(-mean[order].std(axis=1), kind="stable")]
    total, one = np.maximum(sums.sum(axis=0), 1), np.eye(n_splits)[:, :, None]
    for g in order:
        for _ in range(rest[g]):
            spread = ((folds[None] + one * mean[g]) / total).std(axis=1).mean(axis=1)
            k = np.lexsort((folds.sum(axis=1), np.round(spread, 12)))[0]
            folds[k] += mean[g]
            quota[g, k] += 1
    return quota


def _dealt(blocks: DataFrame, n_classes: int, n_splits: int, seed: int) -> DataFrame:
    """blocks with their fold. The driver gets a row a group of blocks, never more than GROUPS or 64 a class, however many blocks there are.

    Groups are made of blocks with equal class counts, or with counts in the same range where there are too many, by wider and wider ranges. Which of a
    group's blocks go to which fold is a matter of their hash, by a threshold a fold.
    """
    for base in (1, *BASES, None):
        coded = blocks.withColumn("code", _code(base))
        if base is None or coded.select("code").distinct().limit(GROUPS + 1).count() <= GROUPS:
            break
    groups = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col("counts")[i]) for i in range(n_classes))).alias("sums")).orderBy("code").collect()
    sizes = np.array([r["n"] for r in groups])
    quota = _deal(sizes, np.array([r["sums"] for r in groups], float).reshape(len(groups), n_classes), n_splits, seed)
    last = [int(np.flatnonzero(q)[-1]) for q in quota]
    spark = blocks.sparkSession
    numbered = coded.join(spark.createDataFrame([(r["code"], g, last[g]) for g, r in enumerate(groups)], "code string, g int, last int"), "code").drop("code")
    upto = quota.cumsum(axis=1)
    wanted = [(g, f, int(upto[g, f])) for g in range(len(groups)) for f in np.flatnonzero(quota[g]).tolist() if f != last[g]]
    if not wanted:
        return numbered.withColumnRenamed("last", "fold").drop("g")
    places = kth_places(numbered, "g", spark.createDataFrame(wanted, "c int, name int, k long"), "key", seed)
    limits = places.groupBy(F.col("c").alias("g")).agg(F.sort_array(F.collect_list(F.struct("name", F.struct("h", "key").alias("place")))).alias("limits"))  # the folds
    mine = F.struct(_place(numbered, "key", seed).alias("h"), F.col("key").alias("key"))
    first = F.get(F.filter("limits", lambda v: mine <= v["place"]), F.lit(0))["name"]
    return numbered.join(limits, "g", "left").withColumn("fold", F.coalesce(first, "last")).drop("g", "last", "limits")


def _labelled(df: DataFrame, block: str, blocks: DataFrame, label: Column, out: str) -> DataFrame:
    table = blocks.select(F.col("b").alias("__b"), label.alias(out))
    return df.join(table, df[block].eqNullSafe(table["__b"])).drop("__b")


def stratified_group_folds(df: DataFrame, block: str, cls: str, n_splits: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """df with its fold: whole blocks, classes balanced greedily over groups of blocks of like class counts."""
    blocks, classes = _histograms(df, block, cls)
    if n_splits < 2 or len(classes) < 2 or blocks.limit(n_splits).count() < n_splits:
        raise ValueError("two splits, two classes and a block a split are needed")
    return _labelled(df, block, checkpointed(_dealt(blocks, len(classes), n_splits, seed)), F.col("fold"), out)


def split_source(df: DataFrame, block: str, cls: str, ratios: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """df with split train, val or test: about 30 % of ten folds held out and halved again."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    blocks, classes = _histograms(df, block, cls)
    n = blocks.limit(10).count()
    if n < 3:
        raise ValueError("three blocks are needed")
    dealt = checkpointed(_dealt(blocks, len(classes), n, seed))
    out = F.col("fold") < max(1, round((ratios[1] + ratios[2]) * n))
    held = dealt.where(out).drop("fold")
    if held.limit(2).count() < 2:
        raise ValueError("two blocks must be held out")
    half = _dealt(held, len(classes), 2, seed).select("b", F.element_at(F.array(F.lit("val"), F.lit("test")), F.col("fold") + 1).alias("split"))
    both = checkpointed(dealt.where(~out).select("b", F.lit("train").alias("split")).unionByName(half))
    return _labelled(df, block, both, F.col("split"), "split")


def split_target(df: DataFrame, block: str, cls: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split finetune or test: the first of five folds is the test."""
    blocks, classes = _histograms(df, block, cls)
    n = blocks.limit(5).count()
    if n < 2:
        raise ValueError("two blocks are needed")
    label = F.when(F.col("fold") < max(1, round(share * n)), "test").otherwise("finetune")
    return _labelled(df, block, checkpointed(_dealt(blocks, len(classes), n, seed)), label, "split")


def class_shares(df: DataFrame, split: str, cls: str) -> DataFrame:
    """(split, class, n, p), absent combinations as 0."""
    by = df.where(F.col(cls).isNotNull()).groupBy(split, cls).agg(F.count("*").alias("n"))
    classes = by.agg(F.sort_array(F.collect_set(cls)).alias("c"))
    full = by.select(split).distinct().join(F.broadcast(classes)).select(split, F.explode("c").alias(cls))  # splits times classes
    dense = full.join(by, [split, cls], "left").fillna(0, ["n"])
    return dense.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def split_kl(df: DataFrame, split: str, cls: str, add: float = 1e-12) -> DataFrame:
    """(split_a, split_b, kl) of each pair."""
    p = class_shares(df, split, cls)
    a, b = p.select(F.col(split).alias("split_a"), cls, (F.col("p") + add).alias("pa")), p.select(F.col(split).alias("split_b"), cls, (F.col("p") + add).alias("pb"))
    return a.join(b, cls).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.sum(F.col("pa") * F.ln(F.col("pa") / F.col("pb"))).alias("kl"))


def kl_filled(df: DataFrame, split: str, cls: str, a: str, b: str, fill: float = 1e-10) -> DataFrame:
    """KL divergence of two splits, absent classes filled and shares normalised again."""
    p = class_shares(df.where(F.col(split).isin(a, b)), split, cls).withColumn("p", F.when(F.col("n") == 0, F.lit(fill)).otherwise(F.col("p")))
    p = p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(split)))
    wide = p.groupBy(cls).agg(F.max(F.when(F.col(split) == a, F.col("p"))).alias("pa"), F.max(F.when(F.col(split) == b, F.col("p"))).alias("pb"))
    return wide.agg(F.sum(F.col("pa") * F.ln(F.col("pa") / F.col("pb"))).alias("kl"))


def block_overlap(df: DataFrame, split: str, block: str) -> DataFrame:
    """Blocks with rows in more than one split."""
    return df.groupBy(block).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def split_validation(df: DataFrame, split: str, block: str, cls: str, kl_threshold: float = 0.07) -> DataFrame:
    """split_kl() with n_overlap; an error if a pair's divergence is above the threshold."""
    kl = split_kl(df, split, cls)
    bad = kl.where(F.col("kl") > kl_threshold).collect()  # pairs of splits
    if bad:
        raise ValueError(f"splits differ in their classes: {[tuple(r) for r in bad]}")
    return kl.join(F.broadcast(block_overlap(df, split, block).agg(F.count("*").alias("n_overlap"))))  # one row


def hash_order(key: str, seed: int | None) -> list[Column]:
    return [F.col(key).asc()] if seed is None else [F.xxhash64(F.lit(seed), key), F.col(key).asc()]


def capped_sample_per_class(df: DataFrame, cls: str, most: int, key: str, seed: int | None = 42) -> DataFrame:
    """At most so many rows a class, by hash (or by key without seed)."""
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(*hash_order(key, seed)))
    return df.withColumn("__k", rank).where(F.col("__k") <= most).drop("__k")


#: Ranges that the rows of a class are counted in at a time, and how often, when the place of its k-th row is looked for.
RANGES, REFINED = 4096, 2


def _place(df: DataFrame, key: str, seed: int | None) -> Column:
    """The number by which rows are put in order: a hash of the key, or the key itself without seed, which must then be a whole number."""
    if seed is not None:
        return F.xxhash64(F.lit(seed), key)
    if df.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("without seed the key must be a whole number")
    return F.col(key).cast("long")


def kth_places(df: DataFrame, cls: str, wanted: DataFrame, key: str, seed: int | None) -> DataFrame:
    """(c, name, h, key): of each wanted (c, name, k) the k-th row of class c in the order of its place and key.

    Rows are counted in ranges of places, first of the whole class, then of the range that holds the k-th, as partial sums; only what is left in a narrow
    range is put in order. No task gets a class. wanted: a few rows a class, k from 1 to the class's rows.
    """
    rows = df.select(F.col(cls).alias("c"), _place(df, key, seed).alias("h"), F.col(key).alias("key")).where("c is not null")
    ends = rows.groupBy("c").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    state = wanted.select("c", "name", "k").join(ends, "c")
    for _ in range(REFINED):
        part = (F.col("h").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double") + 1) * RANGES
        near = rows.join(state, "c").where("h between lo and hi")
        counted = near.groupBy("c", "name", "k", F.floor(part).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "name").orderBy("range")))  # RANGES rows
        state = checkpointed(upto.where("upto >= k and upto - n < k").select("c", "name", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), F.col("low").alias("lo"), F.col("high").alias("hi")))
    last = rows.join(state, "c").where("h between lo and hi").withColumn("__k", F.row_number().over(Window.partitionBy("c", "name").orderBy("h", "key")))
    return last.where("__k = k").select("c", "name", "h", "key")


def _class_sizes(df: DataFrame, cls: str) -> list:
    return df.where(F.col(cls).isNotNull()).groupBy(F.col(cls).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect()  # a row a class


def _first_of_classes(df: DataFrame, cls: str, takes: dict, key: str, seed: int | None) -> DataFrame:
    """The first rows of each class, so many as takes says, by a threshold a class."""
    kind = df.schema[cls].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(c, 0, k) for c, k in takes.items() if k], f"c {kind}, name int, k long")
    limits = kth_places(df, cls, wanted, key, seed).select(F.col("c").alias("__c"), F.struct("h", "key").alias("__limit"))
    return df.join(limits, df[cls] == F.col("__c")).where(F.struct(_place(df, key, seed).alias("h"), F.col(key).alias("key")) <= F.col("__limit")).select(*df.columns)


def stratified_subset_n(df: DataFrame, cls: str, n: int, key: str, seed: int | None = 42) -> DataFrame:
    """n rows in proportion to the classes (at least one each), topped up or cut in the classes' common order.

    The order is: rows within their class's quota, by their number in the class; then those beyond it, by how far and by number; equal ones by
    place. How many of each class that makes follows from the classes' sizes, but for the last level, where the places of one row a class decide.
    """
    sizes = {r["c"]: r["n"] for r in _class_sizes(df, cls)}
    total = sum(sizes.values())
    quota = {c: max(1, int(math.floor(m * n / total + 0.5))) for c, m in sizes.items()}
    within = {c: min(quota[c], m) for c, m in sizes.items()}
    n = max(0, min(n, total))
    base = dict.fromkeys(sizes, 0) if sum(within.values()) > n else within  # cut from nothing, or top up from the quotas
    most = within if sum(within.values()) > n else sizes
    levels, room = sorted({most[c] - base[c] for c in sizes}), n - sum(base.values())

    def taken(level: int) -> int:
        return sum(min(level, most[c] - base[c]) for c in sizes)

    low, high = 0, max(levels, default=0)
    while low < high:  # the last level that fits as a whole
        middle = (low + high + 1) // 2
        low, high = (middle, high) if taken(middle) <= room else (low, middle - 1)
    takes = {c: base[c] + min(low, most[c] - base[c]) for c in sizes}
    more, left = [c for c in sizes if most[c] - base[c] > low], room - taken(low)
    if left and more:
        kind = df.schema[cls].dataType.simpleString()
        wanted = df.sparkSession.createDataFrame([(c, 0, takes[c] + 1) for c in more], f"c {kind}, name int, k long")
        rows = sorted(kth_places(df, cls, wanted, key, seed).collect(), key=lambda r: (takes[r["c"]], r["h"], r["key"]))  # a row a class
        for r in rows[:left]:
            takes[r["c"]] += 1
    return _first_of_classes(df, cls, takes, key, seed)


def stratified_fractions(df: DataFrame, cls: str, fractions: list[float], key: str, seed: int | None = 42) -> DataFrame:
    """df with min_fraction, the smallest of the fractions whose subset has the row: subsets are nested. Null without class."""
    if any(not 0 < f <= 1 for f in fractions):
        raise ValueError("fractions must be in (0, 1]")
    wanted = []
    for r in _class_sizes(df, cls):
        for i, f in enumerate(sorted(fractions)):
            k = int(f * r["n"]) + 1
            while k and not k / r["n"] <= f:
                k -= 1
            wanted += [(r["c"], i, min(k, r["n"]))] if k else []
    kind = df.schema[cls].dataType.simpleString()
    places = kth_places(df, cls, df.sparkSession.createDataFrame(wanted, f"c {kind}, name int, k long"), key, seed)
    limits = places.groupBy(F.col("c").alias("__c")).agg(F.sort_array(F.collect_list(F.struct("name", F.struct("h", "key").alias("place")))).alias("__limits"))  # the fractions
    mine = F.struct(_place(df, key, seed).alias("h"), F.col(key).alias("key"))
    first = F.get(F.filter("__limits", lambda v: mine <= v["place"]), F.lit(0))["name"]
    values = F.array(*(F.lit(float(f)) for f in sorted(fractions)))
    return df.join(limits, df[cls] == F.col("__c"), "left").withColumn("min_fraction", F.get(values, first)).drop("__c", "__limits")


def stratified_holdout(df: DataFrame, cls: str, share: float, key: str, seed: int | None = 42) -> DataFrame:
    return stratified_fractions(df, cls, [share], key, seed).withColumn("held_out", F.col("min_fraction").isNotNull()).drop("min_fraction")


def random_sample_n(df: DataFrame, n: int, key: str, seed: int | None = 42) -> DataFrame:
    return df.orderBy(*hash_order(key, seed)).limit(n)


def group_holdout(df: DataFrame, block: str, share: float = 0.2, seed: int | None = 42) -> DataFrame:
    """df with held_out: the first share of the blocks, by hash."""
    blocks = df.select(block).distinct()
    n = blocks.count()
    chosen = blocks.orderBy(*hash_order(block, seed)).limit(max(1, round(share * n))).select(F.col(block).alias("__b"))
    return df.join(chosen.withColumn("__h", F.lit(True)), F.col(block) == F.col("__b"), "left").withColumn("held_out", F.coalesce("__h", F.lit(False))).drop("__b", "__h")


def split_summary(df: DataFrame, keys: list[str], block: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct(block).alias("n_blocks"))


def class_distribution(df: DataFrame, city: str, cls: str) -> DataFrame:
    return df.groupBy(city, cls).agg(F.count("*").alias("n")).orderBy(city, cls)


def cross_variant_overlap(variants: dict[str, DataFrame], split: str, block: str) -> list[tuple[str, str, int]]:
    """Blocks that two variants put in different splits."""
    out = []
    for (a, x), (b, y) in combinations(variants.items(), 2):
        left, right = x.select(block, F.col(split).alias("s")).distinct(), y.select(block, F.col(split).alias("t")).distinct()
        out.append((a, b, left.join(right, block).where("s <> t").select(block).distinct().count()))
    return out


def final_preparation(df: DataFrame, features: list[str], cls: str, key: str = "id", block_size: float = 500.0, threshold: float = 5.0, redundant: list[str] = (), height: str = "CHM_1m", conifers: list[str] = ("PINUS", "PICEA"), seed: int = 42, city: str = "city", source: str = "source") -> DataFrame:
    """Class group, flags, blocks and splits of a clean table, with column filtered: kept by the proximity filter.

    Blocks are assigned once and every variant uses the same assignment, so no block is in training in one and in the test of another.
    """
    from geotally.operators import outliers, prep, spatial

    d = prep.drop_redundant(prep.add_class_group(df, list(conifers), cls), list(redundant))
    d = outliers.outlier_zscore(d, features, city).drop("z_count")
    d = outliers.outlier_mahalanobis(d, features, cls).drop("mahalanobis_d2")
    d = outliers.consensus(outliers.outlier_iqr(d, height, [cls, city]), ["outlier_zscore", "outlier_mahalanobis", "outlier_iqr"])
    d = spatial.spatial_blocks(d, block_size, city)
    both = split_source(d.where(F.col(city) == source), "block_id", cls, seed=seed).unionByName(split_target(d.where(F.col(city) != source), "block_id", cls, seed=seed))
    kept = spatial.proximity_filter(d, threshold, cls, key).select(key, F.lit(True).alias("filtered"))
    return both.join(kept, key, "left").fillna(False, ["filtered"])


def prepare_dataset(df: DataFrame, split: str, proximity: str, outlier_strategy: str, height: str, features: list[str], metadata: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """The rows and columns that a decision asks for, and how many rows each step left. df has columns split and filtered.

    The test split is never filtered by proximity, so every model meets the same rows there. The counts take one pass.
    """
    from geotally.operators import prep

    if proximity not in ("baseline", "filtered"):
        raise ValueError(f"unknown proximity strategy {proximity}")
    mine = df.where(F.col("split") == split)
    near = F.lit(True) if proximity == "baseline" or split == "test" else F.col("filtered")
    kept = prep.filter_outlier_severity(mine.where(near), outlier_strategy)
    dropped = {"no_removal": [], "remove_high": ["high"], "remove_high_medium": ["high", "medium"]}[outlier_strategy]
    clean = near & ~F.col("outlier_severity").isin(dropped) if dropped else near
    counts = mine.agg(F.count("*").alias("n"), F.count_if(near).alias("near"), F.count_if(clean).alias("kept")).first()
    out = prep.select_features(prep.height_strategy(kept, height), features, metadata)
    return prep.downcast(out), {"n_split": counts["n"], "n_after_proximity": counts["near"], "n_after_outliers": counts["kept"]}
