"""Spatial features from GeoJSON (EPSG:4326)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import props as P
from ..functions.text import repair_text
from .collections import read_collection

FEATURE = "struct<id:string,geometry:string,properties:map<string,string>>"
RING = "array<array<double>>"


PLACE = "struct<file:string,block:bigint,at:bigint>"


def read_features(spark: SparkSession, path: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Rows (id, geometry, properties) of feature collections, or (``lines``) of files with one feature per line; both split."""
    return placed_features(spark, path, lines).drop("place")


def placed_features(spark: SparkSession, path: str | Sequence[str], lines: bool = False) -> DataFrame:
    """The same with ``place``, which orders features as they stand in their files."""
    if lines:
        rows = spark.read.schema("id string, geometry string, properties map<string,string>").json(path)
        return rows.select("*", file_place().alias("place"))
    rows = read_collection(spark, path).select(F.from_json("value", FEATURE).alias("f"), F.struct("file", "block", "at").cast(PLACE).alias("place"))
    return rows.select("f.*", "place")


def file_place() -> Column:
    """The place of a row of a file source."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).cast(PLACE)


def geometry_type(geometry: Column) -> Column:
    return F.get_json_object(geometry, "$.type")


def polygons(geometry: Column) -> Column:
    """Polygons as array of ring arrays; null for other geometries."""
    coordinates = F.get_json_object(geometry, "$.coordinates")
    kind = geometry_type(geometry)
    return F.when(
        kind == "Polygon", F.array(F.from_json(coordinates, f"array<{RING}>"))
    ).when(kind == "MultiPolygon", F.from_json(coordinates, f"array<array<{RING}>>"))


def _positions(geometry: Column) -> Column:
    """All positions of a geometry in one array."""
    coordinates = F.get_json_object(geometry, "$.coordinates")
    kind = geometry_type(geometry)
    return (
        F.when(kind == "Point", F.array(F.from_json(coordinates, "array<double>")))
        .when(kind.isin("MultiPoint", "LineString"), F.from_json(coordinates, RING))
        .when(kind.isin("Polygon", "MultiLineString"), F.flatten(F.from_json(coordinates, f"array<{RING}>")))
        .when(kind == "MultiPolygon", F.flatten(F.flatten(F.from_json(coordinates, f"array<array<{RING}>>"))))
    )


def with_bbox(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Add minx, miny, maxx, maxy (third coordinates are ignored)."""
    spots = features.withColumn("_at", _positions(F.col(geometry)))
    x, y = F.transform("_at", lambda p: F.get(p, F.lit(0))), F.transform("_at", lambda p: F.get(p, F.lit(1)))
    return spots.select(
        *features.columns,
        F.array_min(x).alias("minx"),
        F.array_min(y).alias("miny"),
        F.array_max(x).alias("maxx"),
        F.array_max(y).alias("maxy"),
    )


def feature_rows(raw: DataFrame, dataset_key: str | Column, id_hint: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Feature table rows: repaired texts, id, display name, attributes, box.

    Features without any id are dropped; columns named in ``keep`` are carried along.
    """
    key = F.lit(dataset_key) if isinstance(dataset_key, str) else dataset_key
    repaired = raw.select(
        key.alias("dataset_key"),
        F.col("id").alias("_own"),
        *keep,
        "geometry",
        F.transform_values(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda _, v: repair_text(v)).alias("props"),
    )
    named = repaired.withColumn("feature_id", P.feature_id(F.col("props"), id_hint, F.col("_own"))).where(
        F.col("feature_id").isNotNull()
    )
    return with_bbox(
        named.select(
            *keep,
            "dataset_key",
            "feature_id",
            P.display_name(F.col("props"), F.col("feature_id")).alias("name"),
            P.without_ids(F.col("props")).alias("props"),
            "geometry",
        )
    )
