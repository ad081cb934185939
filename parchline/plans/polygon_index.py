"""Gridded precipitation and polygon layers to standardized-index layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.store import TableStore
from ..operators.series import on_common_months
from ..operators.standardize import standardized_index
from ..operators.zonal import (
    GridSpec, complete_months, eligible_features, monthly_cells, polygon_areas, polygon_weights, spatial_coverage, zonal_mean,
)

LAYER = ("layer_key", "feature_id")


def layer_weights(polygons: DataFrame, grid: GridSpec, minimum_coverage: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights of the polygons covered enough, their coverage, and the excluded ones.

    Weights are checkpointed: clipping is the costly step and three plans use it.
    """
    ensure_checkpoint_dir(polygons.sparkSession)
    weights = polygon_weights(polygons, grid, LAYER).checkpoint()
    coverage = spatial_coverage(weights, polygon_areas(polygons, LAYER), LAYER)
    kept = eligible_features(coverage, minimum_coverage)
    left_out = coverage.join(kept.select(*LAYER), list(LAYER), "left_anti")
    return weights.join(kept.select(*LAYER), list(LAYER), "left_semi"), kept, left_out


def monthly_zonal(slices: DataFrame, weights: DataFrame, grid: GridSpec, daily: bool) -> DataFrame:
    """Zonal means per month; incomplete months of daily sources have none."""
    used = slices
    if daily:
        used = slices.withColumn("_month", F.trunc(F.to_date("ts"), "MM")).join(
            complete_months(slices).withColumnRenamed("date", "_month"), "_month", "left_semi"
        )
    cells = monthly_cells(used).select(
        grid.cell_id(F.col("lat_idx"), F.col("lon_idx")).alias("cell_id"), "date", "value"
    )
    # Zonal means are kept in single precision: equal means stay equal whatever the
    # order in which their cells were added, which matters for ranks.
    return zonal_mean(weights, cells, LAYER).withColumn("value", F.col("value").cast("float").cast("double"))


def polygon_index(
    zonal: DataFrame,
    scales: Sequence[int] = (3,),
    start: str | None = None,
    end: str | None = None,
    minimum_years: int = 20,
) -> DataFrame:
    """Index columns for every polygon of every layer, all scales in one shuffle."""
    complete = on_common_months(zonal, LAYER)
    indexed = standardized_index(complete, LAYER, scales, start, end, minimum_years)
    return indexed.select(*LAYER, "date", "value", *[F.col(f"spi{s}").cast("float").alias(f"spi{s}") for s in scales])


def empty_months(zonal: DataFrame) -> DataFrame:
    """Months of a layer in which no polygon has a value."""
    return (
        on_common_months(zonal, LAYER)
        .groupBy("layer_key", "date")
        .agg(F.count("value").alias("_n"))
        .where(F.col("_n") == 0)
        .select("layer_key", "date")
    )


def layer_series(indexed: DataFrame, source_key: str, scales: Sequence[int]) -> DataFrame:
    """Wide series of every layer and scale under the key ``source_layer_spi<scale>``."""
    out = None
    for scale in scales:
        name = f"spi{scale}"
        key = F.concat(F.lit(f"{source_key}_"), F.col("layer_key"), F.lit(f"_{name}"))
        rows = indexed.select(
            key.alias("dataset_key"), "feature_id", "date", F.col(name).cast("double").alias(name), F.col("value").alias("precip")
        )
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def layer_records(
    indexed: DataFrame, excluded: DataFrame, incomplete: DataFrame, source_key: str, scales: Sequence[int]
) -> DataFrame:
    """Registry facts per layer and scale: period, features kept and left out, months without any value."""
    spans = indexed.groupBy("layer_key").agg(
        F.date_format(F.min("date"), "yyyy-MM").alias("min_month"), F.date_format(F.max("date"), "yyyy-MM").alias("max_month"),
        F.count_distinct("feature_id").alias("feature_count"),
    )
    lost = excluded.groupBy("layer_key").agg(F.count("*").alias("excluded_feature_count"))
    months = incomplete.groupBy("layer_key").agg(F.array_sort(F.collect_list(F.date_format("date", "yyyy-MM"))).alias("incomplete_months"))
    known = spans.join(lost, "layer_key", "left").join(months, "layer_key", "left")
    return known.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).select(
        F.concat_ws("_", F.lit(source_key), "layer_key", F.concat(F.lit("spi"), "scale")).alias("dataset_key"),
        F.lit(source_key).alias("source_key"), F.col("layer_key").alias("boundary_key"), "scale",
        F.array(F.concat(F.lit("spi"), "scale"), F.lit("precip")).alias("available_indices"), "min_month", "max_month", "feature_count",
        F.coalesce("excluded_feature_count", F.lit(0).cast("bigint")).alias("excluded_feature_count"),
        F.coalesce("incomplete_months", F.array().cast("array<string>")).alias("incomplete_months"),
    )


def write_layers(
    store: TableStore, indexed: DataFrame, polygons: DataFrame, excluded: DataFrame, incomplete: DataFrame, source_key: str, scales: Sequence[int]
) -> None:
    """Series, features and registry records of all layers and scales of one source.

    ``polygons`` holds the feature columns beside ``layer_key``; only features with an index are stored. One job per table serves any
    number of layers.
    """
    store.write_series(layer_series(indexed, source_key, scales))
    store.replace("layer_records", layer_records(indexed, excluded, incomplete, source_key, scales), ["dataset_key"])
    kept = store.read("series").select("dataset_key", "feature_id").distinct()
    named = polygons.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).withColumn(
        "dataset_key", F.concat_ws("_", F.lit(source_key), "layer_key", F.concat(F.lit("spi"), "scale"))
    )
    store.replace("features", named.drop("layer_key", "scale").join(kept, ["dataset_key", "feature_id"], "left_semi"), ["dataset_key"])
