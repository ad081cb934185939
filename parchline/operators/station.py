"""Daily station observations to monthly totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import days_in_month, month_start
from ..functions.numeric import finite
from .upsert import newest_per_key


def clean_observations(raw: DataFrame) -> DataFrame:
    """Typed rows with an id, a day and a place; others are dropped.

    Expects station_id, station_name, lon, lat, station_elevation, date, precip_mm
    and seq (the order in which rows were recorded).
    """
    station = F.trim(F.col("station_id").cast("string"))
    typed = raw.select(
        station.alias("station_id"),
        F.coalesce(F.col("station_name").cast("string"), station).alias("station_name"),
        finite(F.col("lon")).alias("lon"),
        finite(F.col("lat")).alias("lat"),
        finite(F.col("station_elevation")).alias("station_elevation"),
        F.col("date").try_cast("date").alias("date"),
        finite(F.col("precip_mm")).alias("precip_mm"),
        F.col("seq"),
    )
    return typed.dropna(subset=["station_id", "date", "lon", "lat"]).where(F.col("station_id") != "")


def latest_per_day(rows: DataFrame) -> DataFrame:
    """The last recorded row of each station and day."""
    return newest_per_key(rows, ["station_id", "date"], "seq")


def dropped_duplicates(days: DataFrame) -> DataFrame:
    """How many rows were left out of days that count their ``recorded`` rows (one row)."""
    return days.agg(F.coalesce(F.sum(F.col("recorded") - 1), F.lit(0)).alias("duplicate_rows"))


def station_profiles(days: DataFrame) -> DataFrame:
    """Latest name, place and elevation of each station, its period and counts."""
    when = F.struct("date", "seq")

    def latest(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), when)).alias(name)

    return days.groupBy("station_id").agg(
        latest("station_name"),
        latest("lon"),
        latest("lat"),
        latest("station_elevation"),
        F.min("date").alias("min_input_date"),
        F.max("date").alias("max_input_date"),
        F.count("*").alias("daily_rows"),
        F.count("precip_mm").alias("valid_daily_precip"),
    )


def monthly_precipitation(days: DataFrame, minimum_coverage: float = 0.8) -> DataFrame:
    """Monthly total per station, null where too few days have a value."""
    month = days.groupBy("station_id", month_start(F.col("date")).alias("date")).agg(
        F.sum("precip_mm").alias("_total"),
        F.count("precip_mm").alias("valid_days"),
        F.count("*").alias("observed_days"),
    )
    share = F.col("valid_days") / F.col("expected_days")
    return (
        month.withColumn("expected_days", days_in_month(F.col("date")))
        .withColumn("coverage_ratio", share)
        .withColumn("precip", F.when(F.col("coverage_ratio") >= minimum_coverage, F.col("_total")))
        .drop("_total")
    )


def run_counters(days: DataFrame, monthly: DataFrame, modes: DataFrame) -> DataFrame:
    """One row of counts that describe a run."""
    dupes = dropped_duplicates(days).scalar()
    failures = monthly.select(F.count_if(F.col("precip").isNull())).scalar()
    return modes.agg(
        F.count("*").alias("feature_count"),
        F.count_if(F.col("reference_mode") == "fallback_available").alias("fallback_count"),
        F.count_if(F.col("reference_mode") == "configured_insufficient").alias("insufficient_count"),
    ).select(
        dupes.alias("duplicate_rows"), failures.alias("coverage_failures"), "feature_count", "fallback_count",
        "insufficient_count",
    )


# Labels of the reference period.
LABEL_CONFIGURED = "Configured baseline ({start} to {end})"
LABEL_AVAILABLE = "Available period"
LABEL_OWN = "Station-specific available period"


def reference_label(mode: Column, start: str | None, end: str | None) -> Column:
    configured = LABEL_CONFIGURED.format(start=start, end=end) if start and end else LABEL_AVAILABLE
    return F.when(mode == "fallback_available", LABEL_OWN).otherwise(configured)


def matches_reference(is_point: Column, mode: Column, shown: Sequence[str], own_period: Column | None = None) -> Column:
    """Whether a feature passes the filter on its reference period.

    ``shown`` names the modes asked for (``configured``, ``fallback_available``); a feature must match each of them, and none
    lets all pass. Only points are filtered. ``own_period`` marks stations that use their own period whatever their mode says.
    """
    fits = F.lit(True)
    for name in shown:
        hit = F.coalesce(mode == name, F.lit(False))
        if name == "fallback_available" and own_period is not None:
            hit = hit | F.coalesce(own_period, F.lit(False))
        fits = fits & hit
    return ~is_point | fits
