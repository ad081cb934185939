"""Resolve requested months to months that have a value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_number
from .series import Keys


def _beside(series: DataFrame, requests: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Each distinct request with the values at or before and after it.

    Requests are made distinct first, so that a feature asked for a billion times
    still has no more rows than there are months; then both sides are laid out on
    one timeline per series and read with ordered windows (no join on a range).
    """
    wanted = requests.select(*keys, F.trunc("requested", "MM").alias("date")).distinct()
    known = series.where(F.col(value).isNotNull()).select(*keys, "date", F.col(value).alias("_value"))
    both = known.select(*keys, "date", "_value", F.lit(0).alias("_ask")).unionByName(
        wanted.select(*keys, "date", F.lit(None).cast("double").alias("_value"), F.lit(1).alias("_ask"))
    )
    ordered = Window.partitionBy(*keys).orderBy("date", "_ask")
    past = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    point = F.when(F.col("_ask") == 0, F.struct("date", "_value"))
    return (
        both.select(
            *keys,
            "date",
            "_ask",
            F.last(point, ignorenulls=True).over(past).alias("_before"),
            F.first(point, ignorenulls=True).over(future).alias("_after"),
        )
        .where(F.col("_ask") == 1)
        .select(*keys, F.col("date").alias("requested"), "_before", "_after")
    )


def effective_month(series: DataFrame, requests: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """One row per distinct request: the month used, its value, and why.

    Requests outside the values' range move to the nearer end. Inside it the exact
    month is used, else the nearest earlier month. A series without values keeps
    the request and says so.
    """
    near = _beside(series, requests, keys, value)
    before, after = F.col("_before"), F.col("_after")
    chosen = F.coalesce(before, after)
    exact = before["date"] == F.col("requested")
    note = (
        F.when(before.isNull() & after.isNull(), "no-data")
        .when(before.isNull(), "clamped-to-start")
        .when(exact, F.lit(None).cast("string"))
        .when(after.isNull(), "clamped-to-end")
        .otherwise("nearest-previous")
    )
    return near.select(
        *keys,
        "requested",
        F.coalesce(chosen["date"], F.col("requested")).alias("effective"),
        chosen["_value"].alias("value"),
        note.alias("note"),
    )


def nearest_month(series: DataFrame, requests: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """The available month closest to each distinct request; the earlier one on ties."""
    near = _beside(series, requests, keys, value)
    before, after = F.col("_before")["date"], F.col("_after")["date"]
    back = month_number(F.col("requested")) - month_number(before)
    ahead = month_number(after) - month_number(F.col("requested"))
    nearest = F.when(after.isNull() | (back <= ahead), before).otherwise(after)
    return near.select(*keys, "requested", F.coalesce(nearest, before, after, F.col("requested")).alias("nearest"))
