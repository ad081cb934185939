"""Snapshots and counts over all features of a layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import SEVERITIES, severity
from ..functions.geo import cluster_pixels, mercator_x, mercator_y

# Column names of the class counts.
CLASS_COLUMNS = {"Normal/Wet": "normal_wet", "D0": "d0", "D1": "d1", "D2": "d2", "D3": "d3", "D4": "d4"}


def class_counts(rows: DataFrame, value: str, keys: Sequence[str] = ("dataset_key", "date")) -> DataFrame:
    """Severity counts per group; missing counts rows without a value."""
    v = F.col(value)
    level = severity(v)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("with_value"),
        F.count_if(v.isNull()).alias("missing"),
        *[F.count_if(level == name).alias(CLASS_COLUMNS[name]) for name in SEVERITIES],
    )


def value_range(rows: DataFrame, value: str, keys: Sequence[str] = ("dataset_key", "date")) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("with_value"),
        F.count_if(v.isNull()).alias("missing"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
    )


def class_shares(rows: DataFrame, value: str, keys: Sequence[str] = ("dataset_key", "date")) -> DataFrame:
    """Percent of classified features in each class (the classes present)."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, severity(F.col(value)).alias("severity")).agg(
        F.count("*").alias("features")
    )
    total = F.sum("features").over(Window.partitionBy(*keys))
    return counted.withColumn("percent", F.col("features") * 100.0 / total)


def page(rows: DataFrame, order: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in key order from ``offset`` on, ``limit`` of them; None gives all.

    ``total`` counts the rows of all pages, and ``truncated`` tells whether any follow this one.
    Deep pages are better asked for by key, see ``page_after``.
    """
    _checked(limit)
    if offset < 0:
        raise ValueError(f"offset {offset} is negative")
    total = rows.select(F.count("*")).scalar()
    shown = rows.orderBy(order)
    if offset:
        shown = shown.offset(offset)
    if limit is not None:
        shown = shown.limit(limit)
    more = F.lit(False) if limit is None else total > offset + limit
    return shown.withColumns({"total": total, "truncated": more})


def page_after(rows: DataFrame, order: str, last_seen: object | None, limit: int | None = None) -> DataFrame:
    """The same page by key instead of by position: cost does not grow with depth."""
    _checked(limit)
    later = rows if last_seen is None else rows.where(F.col(order) > F.lit(last_seen))
    shown, more = later.orderBy(order), F.lit(False)
    if limit is not None:
        shown, more = shown.limit(limit), later.select(F.count("*")).scalar() > limit
    return shown.withColumns({"total": rows.select(F.count("*")).scalar(), "truncated": more})


def _checked(limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise ValueError(f"limit {limit} is below one")


def map_clusters(points: DataFrame, zoom: int, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Points gathered on a screen grid: count, centre, mean value, extent."""
    pixels = cluster_pixels(zoom)
    return points.groupBy(
        *keys,
        F.floor(mercator_x(F.col("lon"), zoom) / pixels).alias("cell_x"),
        F.floor(mercator_y(F.col("lat"), zoom) / pixels).alias("cell_y"),
    ).agg(
        F.count("*").alias("features"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.avg(value).alias("mean_value"),
        F.min("lon").alias("minx"),
        F.min("lat").alias("miny"),
        F.max("lon").alias("maxx"),
        F.max("lat").alias("maxy"),
    )


def cluster_pyramid(points: DataFrame, zooms: Sequence[int], value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """The clusters of ``map_clusters`` at all zooms, from one pass over the points.

    Where zooms share a cell size, a cell holds exactly four of the next zoom. So points are added up once per size, in the cells of its
    deepest zoom, and the sums of these cells make all coarser ones.
    """
    deepest = {}
    for zoom in zooms:
        pixels = cluster_pixels(zoom)
        deepest[pixels] = max(zoom, deepest.get(pixels, zoom))
    cell = lambda at, zoom, pixels: F.floor(at / pixels).cast("bigint")
    sizes = F.array(*[
        F.struct(F.lit(z).alias("deep"), cell(mercator_x(F.col("lon"), z), z, p).alias("x"), cell(mercator_y(F.col("lat"), z), z, p).alias("y")) for p, z in deepest.items()
    ])
    placed = points.select(*keys, "lat", "lon", F.col(value).alias("_value"), F.explode(sizes).alias("cell"))
    sums = {"features": F.count("*"), "_lat": F.sum("lat"), "_lon": F.sum("lon"), "_sum": F.sum("_value"), "_with": F.count("_value")}
    ends = {"minx": F.min("lon"), "miny": F.min("lat"), "maxx": F.max("lon"), "maxy": F.max("lat")}
    fine = placed.groupBy(*keys, "cell.deep", "cell.x", "cell.y").agg(*[e.alias(n) for n, e in {**sums, **ends}.items()])
    shared = {z: F.array(*[F.lit(other) for other in sorted(set(zooms)) if cluster_pixels(other) == p]) for p, z in deepest.items()}
    levels = F
    for deep, own in shared.items():
        levels = levels.when(F.col("deep") == deep, own)
    spread = fine.withColumn("zoom", F.explode(levels))
    halved = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("deep") - F.col("zoom"))).cast("bigint")
    coarse = spread.groupBy(*keys, "zoom", halved("x").alias("cell_x"), halved("y").alias("cell_y")).agg(
        *[F.sum(n).alias(n) for n in sums], *[f(n).alias(n) for f, n in zip((F.min, F.min, F.max, F.max), ends, strict=True)]
    )
    return coarse.select(
        *keys, "zoom", "cell_x", "cell_y", "features", (F.col("_lat") / F.col("features")).alias("lat"), (F.col("_lon") / F.col("features")).alias("lon"),
        F.when(F.col("_with") > 0, F.col("_sum") / F.col("_with")).alias("mean_value"), *ends,
    )


def with_radius(points: DataFrame, keys: Sequence[str] = ("dataset_key", "date"), value: str = "value") -> DataFrame:
    """Marker radius between 4 and 14 from the value's place in its group's range."""
    limits = points.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.col("_high") - F.col("_low")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("_low")) / span))
    radius = (
        F.when(F.col(value).isNull(), 6.0).when(F.col("_low").isNull(), 6.0).when(span <= 0, 8.0).otherwise(share * 10 + 4)
    )
    return points.join(limits, list(keys), "left").withColumn("radius", radius).drop("_low", "_high")


def suggestions(features: DataFrame, query: str, matches: Column, limit: int, name: str = "name", fid: str = "feature_id") -> DataFrame:
    """The ``limit`` best search hits: names or ids starting with the query first."""
    q = (query or "").strip().lower()
    starts = F.lower(F.col(name)).startswith(q) | F.lower(F.col(fid)).startswith(q)
    return (
        features.where(matches)
        .withColumn("starts", F.when(starts, 0).otherwise(1))
        .orderBy("starts", name, fid)
        .limit(limit)
    )


def best_id_column(table: DataFrame, feature_ids: DataFrame, preferred: Sequence[str], fid: str = "feature_id") -> DataFrame:
    """Column whose distinct values meet most feature ids; listed columns win if they meet any.

    One row, or none when no column meets an id.
    """
    as_text = table.select(*[F.col(c).cast("string").alias(c) for c in table.columns])
    values = as_text.unpivot([], list(table.columns), "column_name", "cell").where(F.col("cell").isNotNull()).distinct()
    met = values.join(feature_ids.select(F.col(fid).alias("cell")).distinct(), "cell", "left_semi")
    scored = met.groupBy("column_name").agg(F.count("*").alias("overlap"))
    rank = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("column_name")), F.lit(0)),
        F.lit(len(preferred) + 1),
    )
    place = F.array_position(F.array(*[F.lit(c) for c in table.columns]), F.col("column_name"))
    listed = rank <= len(preferred)
    return (
        scored.orderBy(rank, F.when(listed, F.lit(0)).otherwise(-F.col("overlap")), place)
        .limit(1)
        .select("column_name", "overlap")
    )
