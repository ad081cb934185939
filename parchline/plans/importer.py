"""Import layer folders into the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import index_columns, valid_dataset_key
from ..operators.series import to_long
from ..operators.trend import trend_statistics
from ..operators.upsert import newest_per_key
from ..schema import DATASETS, FEATURE_KEY
from ..sources.discover import LayerFolder, grouped_layers, layer_folders, layer_key, read_layers
from ..sources.geojson import feature_rows, file_place, geometry_type, placed_features
from ..sources.store import TableStore


def layer_features(spark: SparkSession, layers: Sequence[LayerFolder]) -> DataFrame:
    """Feature rows of folders: GeoJSON, or Parquet with the same three columns, one scan for all of one form and id column.

    Of features with one id the last in the file stays. ``geometry`` is kept beside the box.
    """
    forms: dict[tuple[str, bool, str], list[LayerFolder]] = {}
    for group in grouped_layers(spark, layers):
        for layer in group.layers:
            forms.setdefault((layer.geo.rsplit(".", 1)[-1], layer.geo_lines, group.id_column), []).append(layer)
    found = None
    for (kind, lines, hint), own in forms.items():
        paths = [layer.geo for layer in own]
        if kind == "geojson":
            placed = placed_features(spark, paths, lines)
        else:
            placed = spark.read.parquet(*paths).select("id", "geometry", "properties", file_place().alias("place"))
        rows = feature_rows(placed.withColumnRenamed("place", "_place"), layer_key(own, F.col("_place.file")), hint, keep=("_place",))
        found = rows if found is None else found.unionByName(rows)
    return newest_per_key(found, FEATURE_KEY, "_place").drop("_place")


def registry_rows(spark: SparkSession, layers: Sequence[LayerFolder], features: DataFrame) -> DataFrame:
    """Registry entries of all layers from their metadata files and feature geometries; a layer without features has one too."""
    fields = ("title", "source_key", "source_title", "boundary_key", "boundary_title")
    named = spark.createDataFrame([(layer.dataset_key,) for layer in layers], "dataset_key string")
    kinds = features.groupBy("dataset_key").agg(F.first(geometry_type(F.col("geometry")), ignorenulls=True).alias("kind"))
    rows = named.join(kinds, "dataset_key", "left").select("dataset_key", F.coalesce("kind", F.lit("Geometry")).alias("geom_type"))
    told = [layer for layer in layers if layer.metadata]
    if told:
        texts = spark.read.text([layer.metadata for layer in told], wholetext=True).select(layer_key(told, F.col("_metadata.file_path")).alias("dataset_key"), F.col("value").alias("metadata"))
        rows = rows.join(texts.groupBy("dataset_key").agg(F.max("metadata").alias("metadata")), "dataset_key", "left")
    else:
        rows = rows.withColumn("metadata", F.lit(None).cast("string"))
    rows = rows.select("*", *[F.get_json_object("metadata", f"$.{f}").alias(f) for f in fields])
    bounds = [F.lit(None).cast("date").alias(c) for c in ("min_date", "max_date")]
    out = rows.withColumn("title", F.coalesce("title", "dataset_key")).select("*", *bounds)
    return out.select(*[c.split()[0] for c in DATASETS.split(", ")])


def with_feature_bounds(features: DataFrame, series: DataFrame) -> DataFrame:
    """First and last month of every feature; features without rows keep none."""
    bounds = series.groupBy(*FEATURE_KEY).agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    return features.drop("min_date", "max_date").join(bounds, list(FEATURE_KEY), "left")


def with_dataset_bounds(datasets: DataFrame, series: DataFrame) -> DataFrame:
    bounds = series.groupBy("dataset_key").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    joined = datasets.join(bounds, "dataset_key", "left")
    return joined.withColumns({"min_date": F.col("_lo"), "max_date": F.col("_hi")}).select(*datasets.columns)


def all_trends(series: DataFrame, indices: Sequence[str] | None = None) -> DataFrame:
    """Trend rows of every layer, index and feature in one job."""
    names = list(indices) if indices is not None else index_columns(series.columns)
    long = to_long(series, ["dataset_key", "feature_id", "date"], names)
    return trend_statistics(long, ["dataset_key", "index_name", "feature_id"])


def import_layers(store: TableStore, base: str, only: Sequence[str] | None = None, trends: bool = True) -> list[str]:
    """Import the layers below a folder; layers already stored are replaced."""
    spark = store.spark
    layers = layer_folders(spark, base, only)
    if not layers:
        raise ValueError(f"no layers below {base}")
    keys = [valid_dataset_key(layer.dataset_key) for layer in layers]
    store.write_series(read_layers(spark, layers))
    series = store.read("series").where(F.col("dataset_key").isin(*keys))
    features = layer_features(spark, layers)
    store.replace("features", with_feature_bounds(features, series), ["dataset_key"], ["minx", "feature_id"])
    store.replace("datasets", with_dataset_bounds(registry_rows(spark, layers, features), series), ["dataset_key"])
    if trends:
        store.replace("trend_stats", all_trends(series), ["dataset_key", "index_name"])
    return keys
