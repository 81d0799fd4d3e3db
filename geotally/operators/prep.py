"""Projections, schema operators and filters over point tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotally.functions.columns import HEIGHT, metadata_columns, monthly_name

#: The harmonised point schema; the order is part of the contract.
POINT_SCHEMA = {"tree_id": "string", "city": "string", "genus_latin": "string", "species_latin": "string", "genus_german": "string", "species_german": "string", "plant_year": "int", "height_m": "double", "tree_type": "string", "x": "double", "y": "double"}


def normalize_genus(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def normalize_species(c: Column) -> Column:
    """Lower case, without a leading capitalised word where more follow."""
    words = F.split(F.trim(c), r"\s+")
    rest = F.when((F.size(words) > 1) & words[0].rlike(r"^\p{Lu}"), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    return F.nullif(F.lower(F.concat_ws(" ", rest)), F.lit(""))


def normalize_city(c: Column) -> Column:
    return F.lower(F.trim(c))


def harmonize(df: DataFrame, mapping: dict[str, str], city: str) -> DataFrame:
    """One source's columns on the point schema; unmapped ones NULL, numbers that don't parse NULL. mapping: schema column -> SQL expression."""
    out = []
    for name, kind in POINT_SCHEMA.items():
        c = F.lit(city) if name == "city" else F.expr(mapping[name]) if name in mapping else F.lit(None)
        c = {"genus_latin": normalize_genus, "species_latin": normalize_species, "city": normalize_city}.get(name, lambda v: v)(c.cast("string") if kind == "string" else c)
        out.append((c.cast("string").try_cast(kind) if kind in ("int", "double") else c.cast(kind)).alias(name))
    return df.select(*out)


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """All layers, each row tagged with its source_layer."""
    out = None
    for name, df in layers.items():
        tagged = df.withColumn("source_layer", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def multipoint_to_point(df: DataFrame, coords: str, kind: str) -> DataFrame:
    """x and y of the first point of each geometry; a type other than Point and MultiPoint is an error when the row is read."""
    ok = F.col(kind).isin("Point", "MultiPoint")
    first = F.when(ok, F.element_at(coords, 1)).otherwise(F.raise_error(F.concat(F.lit("unsupported geometry "), F.col(kind))))
    return df.withColumns({"x": first["x"], "y": first["y"]})


def add_class_group(df: DataFrame, members: list[str], cls: str = "genus_latin", out: str = "is_conifer") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.upper(cls).isin([m.upper() for m in members]), F.lit(False)))


def select_months(df: DataFrame, months: list[int], bases: list[str], metadata: list[str]) -> DataFrame:
    """Metadata, CHM_1m and the chosen months' columns that exist."""
    if not months or any(not 1 <= m <= 12 for m in months):
        raise ValueError("months must be 1 to 12, and some")
    missing = sorted(set(metadata) - set(df.columns))
    if missing:
        raise ValueError(f"missing metadata {missing}")
    wide = [monthly_name(b, m) for m in sorted(months) for b in bases]
    return df.select(*dict.fromkeys([*metadata, *(c for c in ("CHM_1m", *wide) if c in df.columns)]))


def drop_redundant(df: DataFrame, features: list[str]) -> DataFrame:
    return df.drop(*(c for c in features if c in df.columns and c not in ("x", "y")))


def select_features(df: DataFrame, features: list[str], metadata: list[str] | None = None) -> DataFrame:
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"missing features {missing}")
    return df.select(*dict.fromkeys([*(metadata_columns(df) if metadata is None else metadata), *features]))


def height_strategy(df: DataFrame, strategy: str) -> DataFrame:
    """df without the height features that the strategy leaves out."""
    keep = {"no_chm": (), "zscore_only": HEIGHT[1:2], "percentile_only": HEIGHT[2:], "both_engineered": HEIGHT[1:], "raw_chm": HEIGHT[:1]}
    if strategy not in keep:
        raise ValueError(f"unknown height strategy {strategy}")
    return df.drop(*(c for c in HEIGHT if c not in keep[strategy]))


def downcast(df: DataFrame) -> DataFrame:
    """double to float; long to the narrowest type that holds its range. One aggregate pass."""
    longs = [c for c, t in df.dtypes if t == "bigint"]
    row = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(longs) for n, f in (("a", F.min), ("b", F.max)))).first() if longs else None
    kinds = {}
    for i, c in enumerate(longs):
        low, high = row[f"a{i}"], row[f"b{i}"]
        kinds[c] = "bigint" if low is None else next((t for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31)) if -(1 << b) <= low and high < 1 << b), "bigint")
    return df.select(*(F.col(c).cast("float" if t == "double" else kinds.get(c, t)).alias(c) for c, t in df.dtypes))


def remap_labels(df: DataFrame, mapping: DataFrame, cls: str) -> DataFrame:
    """Classes by their mapping (cls, final_class, display_name); classes it hasn't go. A mapping is a row a class."""
    return df.join(mapping, cls).drop(cls).withColumnRenamed("final_class", cls)


def fill_from_map(df: DataFrame, names: dict[str, str], cls: str, display: str) -> DataFrame:
    """NULL display names by label. A label the map hasn't is an error when its row is read."""
    pairs = F.create_map(*(F.lit(v) for kv in names.items() for v in kv))
    missing = F.raise_error(F.concat(F.lit("no display name for "), F.col(cls)))
    return df.withColumn(display, F.coalesce(F.col(display), pairs[F.col(cls)], missing))


def encode_labels(df: DataFrame, cls: str, out: str = "label_idx", fitted: DataFrame | None = None) -> DataFrame:
    """Classes as 0..k-1 in sorted order; NULL, or a class that fitted (label_table()) hasn't, is an error when its row is read."""
    table = label_table(df, cls, out) if fitted is None else fitted
    joined = df.join(table.withColumnRenamed(cls, "__cls"), F.col(cls) == F.col("__cls"), "left").drop("__cls")
    return joined.withColumn(out, F.coalesce(F.col(out), F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(cls), F.lit("NULL")))).cast("int")))


def label_table(df: DataFrame, cls: str, out: str = "label_idx") -> DataFrame:
    """(class, index); one row a class."""
    ranked = F.row_number().over(Window.orderBy(cls)) - 1
    return df.where(F.col(cls).isNotNull()).groupBy(cls).agg(F.lit(1).alias("one")).select(cls, ranked.cast("int").alias(out))


def merged_group_flag(mapping: DataFrame, flags: DataFrame, cls: str, flag: str) -> DataFrame:
    """A final class has the flag if any member has."""
    return mapping.join(flags, cls, "left").groupBy("final_class").agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag))


def filter_classes(df: DataFrame, classes: list[str], cls: str) -> DataFrame:
    return df.where(F.col(cls).isin(classes))


def filter_max_year(df: DataFrame, most: int, year: str = "plant_year", reference_year: int = 2021) -> DataFrame:
    """Rows up to a year or without one."""
    if most > reference_year:
        raise ValueError(f"{most} is after {reference_year}")
    return df.where((F.col(year) <= most) | F.col(year).isNull())


def filter_viable_classes(df: DataFrame, least: int, cls: str, city: str = "city") -> DataFrame:
    """Rows of classes with at least so many rows in every city."""
    counts = df.where(F.col(cls).isNotNull()).groupBy(cls, city).count()
    cities = df.select(city).distinct().agg(F.count("*").alias("cities"))
    viable = counts.groupBy(cls).agg(F.count_if(F.col("count") >= least).alias("ok")).join(F.broadcast(cities), F.col("ok") == F.col("cities"), "left_semi")  # one row
    return df.join(viable.select(cls), cls, "left_semi")


def filter_viable_per_city(df: DataFrame, least: int, cls: str, city: str = "city") -> DataFrame:
    counts = df.groupBy(city, cls).count().where(F.col("count") >= least).drop("count")
    return df.join(counts, [city, cls], "left_semi")


def filter_plausible_max(df: DataFrame, columns: list[str], least: float = 0.3) -> DataFrame:
    values = [F.when(~F.isnan(c), F.col(c)) for c in columns]
    return df.where((F.greatest(*values) if len(values) > 1 else values[0]) >= least)


def filter_outlier_severity(df: DataFrame, strategy: str) -> DataFrame:
    drop = {"no_removal": [], "remove_high": ["high"], "remove_high_medium": ["high", "medium"]}
    if strategy not in drop:
        raise ValueError(f"unknown outlier strategy {strategy}")
    return df if not drop[strategy] else df.where(~F.col("outlier_severity").isin(drop[strategy]))


def filter_value_range(c: Column, low: float = -2.0, high: float = 50.0) -> Column:
    """Below low: 0; above high: NULL."""
    return F.when(c < low, F.lit(0.0)).when(c > high, F.lit(None)).otherwise(c)


def mask_and_clamp(df: DataFrame, bands: list[str], scl: str = "scl", keep: tuple[int, ...] = (4, 5), high: float = 10000.0) -> DataFrame:
    """Clear observations, bands within [0, high]."""
    kept = df.where(F.col(scl).isin(list(keep)))
    return kept.select(*(F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.col(c), F.lit(high)))).alias(c) if c in bands else F.col(c) for c in df.columns))


def prune_tiles(df: DataFrame, name: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Tiles (km coordinates NNN_NNNN in the name) whose 1 km box meets the box given in metres; names without stay."""
    e, n = (F.regexp_extract(name, r"(\d{3})_(\d{4})", i).try_cast("double") * 1000 for i in (1, 2))
    return df.where(e.isNull() | ((e < x1) & (e + 1000 > x0) & (n < y1) & (n + 1000 > y0)))


def rule_table(metrics: DataFrame, rules: list[tuple[str, str]], otherwise: str, out: str = "decision") -> DataFrame:
    """The first rule (SQL condition, decision) that holds for a row of metrics, with the condition as reason."""
    decision, reason = F.lit(otherwise), F.lit("no rule")
    for condition, name in reversed(rules):
        decision = F.when(F.expr(condition), F.lit(name)).otherwise(decision)
        reason = F.when(F.expr(condition), F.lit(condition)).otherwise(reason)
    return metrics.withColumns({out: decision, "reason": reason})


def cast_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType) for f in schema))
