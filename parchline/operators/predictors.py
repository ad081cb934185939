"""Monthly helper predictors from gridded fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_start
from ..functions.numeric import finite


def area_weighted_mean(
    field: DataFrame, box: tuple[float, float, float, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Mean over a box per time step, weighted by the cosine of latitude, nulls left out."""
    minx, miny, maxx, maxy = box
    inside = F.col("lon").between(minx, maxx) & F.col("lat").between(miny, maxy)
    v = finite(F.col("value"))
    w = F.cos(F.radians("lat"))
    summed = field.where(inside).groupBy(*keys, "ts").agg(
        F.sum(v * w).alias("_top"), F.sum(F.when(v.isNotNull(), w)).alias("_bottom")
    )
    return summed.select(*keys, "ts", F.when(F.col("_bottom") != 0, F.col("_top") / F.col("_bottom")).alias("value"))


def monthly_mean(steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the time steps of each month (the second of two averaging levels)."""
    return steps.groupBy(*keys, month_start(F.col("ts")).alias("date")).agg(F.avg("value").alias("value"))


def side_by_side(variables: Mapping[str, DataFrame], keys: Sequence[str] = ("date",)) -> DataFrame:
    """Full outer merge of (keys, value) tables, one column each.

    Stacked and aggregated once, so any number of variables costs one shuffle.
    """
    stacked: DataFrame | None = None
    for name, frame in variables.items():
        tagged = frame.select(*keys, F.lit(name).alias("_variable"), "value")
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    assert stacked is not None, "no variables"
    return stacked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_variable") == name, F.col("value"))).alias(name) for name in variables]
    )


def with_mean_temperature(frame: DataFrame, low: str = "tmin", high: str = "tmax", name: str = "tmean") -> DataFrame:
    if name in frame.columns or not {low, high} <= set(frame.columns):
        return frame
    return frame.withColumn(name, (finite(F.col(low)) + finite(F.col(high))) / 2.0)


def with_anomalies(
    frame: DataFrame, columns: Sequence[str], start: object, end: object, keys: Sequence[str] = ()
) -> DataFrame:
    """Difference from the calendar-month mean of the baseline; no baseline counts as 0."""
    per_month = Window.partitionBy(*keys, F.month("date"))
    based = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return frame.withColumns(
        {
            f"{c}_anom": F.col(c) - F.coalesce(F.avg(F.when(based, F.col(c))).over(per_month), F.lit(0.0))
            for c in columns
        }
    )


def predictor_table(
    variables: Mapping[str, DataFrame],
    source_key: str,
    start: object,
    end: object,
    enso: DataFrame | None = None,
) -> DataFrame:
    """Anomalies of all variables by month beside the ENSO index, tagged with the source."""
    merged = with_mean_temperature(side_by_side(variables))
    numbers = [c for c in merged.columns if c != "date"]
    out = with_anomalies(merged, numbers, start, end).select("date", *[f"{c}_anom" for c in numbers])
    if enso is not None:
        out = out.join(enso.select("date", "enso_nino34"), "date", "left")
    return out.select("date", F.lit(source_key).alias("source_key"), *[c for c in out.columns if c != "date"])


def climatology(predictors: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("source_key",)) -> DataFrame:
    """Calendar-month means used for months that have no predictors yet; absent means 0."""
    return predictors.groupBy(*keys, F.month("date").alias("calendar_month")).agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]
    )
