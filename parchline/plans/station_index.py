"""Daily station files to a standardized-index layer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import checked_scales, named_at, scale_place
from ..operators.series import on_common_months
from ..operators.standardize import standardized_index, with_reference_mode
from ..operators.station import (
    clean_observations, monthly_precipitation, reference_label, run_counters, station_profiles,
)

from ..session import ensure_checkpoint_dir

STATION = ("feature_id",)
DAY_COLUMNS = ("station_name", "lon", "lat", "station_elevation", "precip_mm")


@dataclass(frozen=True)
class StationRun:
    """Settings of a station run; ``{scale}`` in key and title stands for the scale of a layer."""

    dataset_key: str
    title: str
    scales: tuple[int, ...] = (3,)
    reference_start: str | None = None
    reference_end: str | None = None
    minimum_years: int = 20
    minimum_coverage: float = 0.8
    fallback: bool = True

    @classmethod
    def from_mapping(cls, raw: Mapping[str, object]) -> StationRun:
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        known["scales"] = checked_scales(raw.get("scales"))
        known["dataset_key"] = scale_place(str(known["dataset_key"]).strip(), append=True)
        known["title"] = scale_place(str(known["title"]).strip(), append=True)
        return cls(**known)

    def at_scale(self, scale: int) -> StationRun:
        return replace(
            self, dataset_key=named_at(self.dataset_key, scale), title=named_at(self.title, scale), scales=(scale,)
        )


def station_days(raw: DataFrame, columns: Sequence[str] = DAY_COLUMNS, shared: bool = False) -> DataFrame:
    """One row per station and day, the one recorded last, with ``recorded``, the number of valid rows of the day.

    ``columns`` are carried along, so an index alone asks for the precipitation only. ``shared`` days are kept in the
    shared folder: index, features and counters of a run then read the raw rows once.
    """
    rows = clean_observations(raw).select("station_id", "date", "seq", *columns)
    newest = F.max_by(F.struct(*columns), "seq").alias("newest")
    days = rows.groupBy("station_id", "date").agg(newest, F.max("seq").alias("seq"), F.count("*").alias("recorded"))
    days = days.select("station_id", "date", "seq", "recorded", *[f"newest.{c}" for c in columns])
    if shared:
        ensure_checkpoint_dir(raw.sparkSession)
        days = days.checkpoint()
    return days


def station_index(days: DataFrame, run: StationRun) -> DataFrame:
    """Monthly precipitation and one index column per scale, on one range of months."""
    monthly = monthly_precipitation(days, run.minimum_coverage).select(F.col("station_id").alias("feature_id"), "date", "precip")
    complete = on_common_months(monthly, STATION, ["precip"])
    moded = with_reference_mode(
        complete, STATION, run.reference_start, run.reference_end, run.minimum_years, run.fallback, "precip"
    )
    indexed = standardized_index(
        moded, STATION, run.scales, run.reference_start, run.reference_end, run.minimum_years, "precip"
    )
    return indexed.select(
        *STATION, "date", *[F.col(f"spi{s}").cast("float").alias(f"spi{s}") for s in run.scales],
        F.col("precip").cast("float").alias("precip"), "reference_mode",
    )


def station_features(days: DataFrame, indexed: DataFrame, run: StationRun) -> DataFrame:
    """Feature rows of the stations with their reference mode."""
    modes = indexed.groupBy(*STATION).agg(F.first("reference_mode").alias("reference_mode"))
    profiles = station_profiles(days).withColumnRenamed("station_id", "feature_id")
    mode = F.coalesce("reference_mode", F.lit("configured"))
    return profiles.join(modes, list(STATION), "left").select(
        *profiles.columns,
        F.col("station_name").alias("name"),
        mode.alias("reference_mode"),
        (mode == "fallback_available").alias("uses_fallback_reference"),
        reference_label(mode, run.reference_start, run.reference_end).alias("reference_label"),
    )


def station_counters(days: DataFrame, indexed: DataFrame, run: StationRun) -> DataFrame:
    monthly = monthly_precipitation(days, run.minimum_coverage)
    modes = indexed.groupBy(*STATION).agg(F.first("reference_mode").alias("reference_mode"))
    return run_counters(days, monthly, modes)


def layer_metadata(data: DataFrame, features: DataFrame, facts: Mapping[str, object]) -> DataFrame:
    """One metadata row: given facts, month range and feature count, written with ``.json``."""
    span = data.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    count = features.select(F.count("*")).scalar()
    return span.select(
        *[F.lit(list(v) if isinstance(v, Sequence) and not isinstance(v, str) else v).alias(k) for k, v in facts.items()],
        F.date_format("lo", "yyyy-MM").alias("min_month"),
        F.date_format("hi", "yyyy-MM").alias("max_month"),
        count.alias("feature_count"),
    )


def write_layer(folder: str, data: DataFrame, features: DataFrame, metadata: DataFrame) -> None:
    """Data, features and metadata of one layer below its folder, clustered by month."""
    order = ("date", "feature_id")
    data.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option(
        "compression", "zstd"
    ).parquet(f"{folder}/data.parquet")
    features.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/geoinfo.parquet")
    metadata.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata.json")
