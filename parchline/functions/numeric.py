"""Finite values and precipitation units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted unit spellings.
DEPTH_UNITS = ("mm", "millimeter", "millimeters", "kg m-2", "kg/m2")
DAILY_DEPTH_UNITS = ("mm d-1", "mm d^-1", "mm/day", "mm per day")
RATE_UNITS = ("kg m-2 s-1", "kg m^-2 s^-1", "kg/m2/s", "mm s-1", "mm/s")
SECONDS_PER_DAY = 86400.0


def finite(value: Column) -> Column:
    """Double with NaN, infinities and unparsable text turned into null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def unit_name(units: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(F.trim(units)), r"\s+", " "), F.lit("**"), F.lit("^"))


def to_millimetres(value: Column, units: Column, seconds: Column) -> Column:
    """Depth in mm of an amount or a rate lasting ``seconds``; unknown units fail the job."""
    unit = unit_name(units)
    return (
        F.when(unit.isin(*DEPTH_UNITS), value)
        .when(unit.isin(*DAILY_DEPTH_UNITS), value * (seconds / SECONDS_PER_DAY))
        .when(unit.isin(*RATE_UNITS), value * seconds)
        .otherwise(
            F.raise_error(F.concat(F.lit("Unsupported precipitation units: "), F.coalesce(units, F.lit("null")))).cast("double")
        )
    )
