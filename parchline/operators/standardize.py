"""Nonparametric standardized index of monthly totals.

All windows partition by the series keys, or by the series keys and calendar
month, which the same exchange satisfies: one shuffle, then sorts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import with_normal_quantiles
from .series import Keys, by_date, whole

PLOT_SHIFT = 0.44
PLOT_SPAN = 0.12


def rolling_total(keys: Keys, scale: int, value: str = "value", date: str = "date") -> Column:
    """Sum of the last ``scale`` rows; null unless every one of them has a value.

    The series must be complete (one row per month).
    """
    if scale < 1:
        raise ValueError("scale must be at least 1")
    frame = by_date(keys, date).rowsBetween(1 - scale, 0)
    return F.when(F.count(value).over(frame) == scale, F.sum(value).over(frame))


def _in_period(start: object | None, end: object | None, date: str = "date") -> Column:
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(date) >= F.trunc(F.lit(start).cast("date"), "MM"))
    if end is not None:
        inside = inside & (F.col(date) <= F.trunc(F.lit(end).cast("date"), "MM"))
    return inside


def plotting_probability(rank: Column, size: Column) -> Column:
    return (rank - PLOT_SHIFT) / (size + PLOT_SPAN)


def reference_counts(series: DataFrame, keys: Keys, start: object, end: object, value: str = "value") -> DataFrame:
    """Fewest valid months of any calendar month in the reference period, per series."""
    per_month = [
        F.count_if(_in_period(start, end) & F.col(value).isNotNull() & (F.month("date") == m)) for m in range(1, 13)
    ]
    return series.groupBy(*keys).agg(F.least(*per_month).alias("fewest_years"))


def with_reference_mode(
    series: DataFrame,
    keys: Keys,
    start: object | None,
    end: object | None,
    minimum_years: int,
    fallback: bool = True,
    value: str = "value",
) -> DataFrame:
    """Whether a series uses the configured period or everything it has.

    A series qualifies when each of the twelve calendar months has enough valid
    monthly values inside the period.
    """
    everything = whole(keys)
    inside = _in_period(start, end) & F.col(value).isNotNull()
    fewest = F.least(*[F.count_if(inside & (F.month("date") == m)).over(everything) for m in range(1, 13)])
    ready = fewest >= max(minimum_years, 1)
    other = "fallback_available" if fallback else "configured_insufficient"
    return series.withColumn("reference_mode", F.when(ready, "configured").otherwise(other))


def standardized_index(
    series: DataFrame,
    keys: Keys,
    scales: Sequence[int] = (3,),
    start: object | None = None,
    end: object | None = None,
    minimum_years: int = 20,
    value: str = "value",
    prefix: str = "spi",
) -> DataFrame:
    """Add one index column per scale to a complete monthly series.

    The rank of a rolling total among the reference totals of its calendar month
    comes from a RANGE window, whose peers give the ``<=`` count. Totals below all
    reference totals get rank 1. A series with any negative input has no index. A
    ``reference_mode`` column, when present, lifts the period for series that fall
    back to everything they have.
    """
    everything = whole(keys)
    inside = _in_period(start, end)
    if "reference_mode" in series.columns:
        inside = inside | (F.col("reference_mode") == "fallback_available")
    need = max(1, int(minimum_years))
    work = series.withColumn("_negative", F.coalesce(F.min(value).over(everything) < 0, F.lit(False))).withColumn(
        "_calendar", F.month("date")
    )
    # All totals first: they share one order by date, and only the ranks need an order each.
    for scale in scales:
        work = work.withColumn(f"_total{scale}", rolling_total(keys, scale, value))
    for scale in scales:
        total, rank, size = f"_total{scale}", f"_rank{scale}", f"_size{scale}"
        counted = F.count_if(inside & F.col(total).isNotNull())
        group = Window.partitionBy(*keys, "_calendar")
        ordered = group.orderBy(total).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        work = work.withColumn(rank, counted.over(ordered)).withColumn(size, counted.over(group))
        probability = plotting_probability(F.greatest(F.col(rank), F.lit(1)).cast("double"), F.col(size).cast("double"))
        usable = ~F.col("_negative") & F.col(total).isNotNull() & (F.col(size) >= need)
        work = work.withColumn(f"_p{scale}", F.when(usable, probability))
    helpers = ["_negative", "_calendar"] + [f"_{n}{s}" for s in scales for n in ("total", "rank", "size", "p")]
    return with_normal_quantiles(work, {f"_p{s}": f"{prefix}{s}" for s in scales}).drop(*helpers)


def _positional(series: DataFrame, keys: Keys, scale: int, value: str) -> DataFrame:
    everything = whole(keys)
    order = by_date(keys)
    # NaN counts as "not >= 0" here, as a missing value does.
    bad = F.col(value).isNull() | F.isnan(value) | (F.col(value) < 0)
    work = (
        series.withColumn("_bad", F.max(bad).over(everything))
        .withColumn("_row", F.row_number().over(order))
        .withColumn("_rows", F.count("*").over(everything))
        .withColumn("_total", rolling_total(keys, scale, value))
        .withColumn("_slot", F.pmod(F.col("_row") - scale, F.lit(12)))
        .withColumn("_late", F.col("_row") >= scale)
    )
    group = Window.partitionBy(*keys, "_late", "_slot")
    rank = F.count("*").over(group.orderBy("_total").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    p = plotting_probability(rank.cast("double"), F.count("*").over(group).cast("double"))
    return work.withColumn("_p", F.when(F.col("_late") & ~F.col("_bad"), p))


def _finish(work: DataFrame, spoiled: Column, name: str) -> DataFrame:
    scored = with_normal_quantiles(work, {"_p": "_idx"})
    return scored.withColumn(name, F.when(F.col("_bad"), spoiled).otherwise(F.col("_idx"))).drop(
        "_bad", "_row", "_rows", "_total", "_slot", "_late", "_p", "_idx"
    )


def standardized_by_position(
    series: DataFrame, keys: Keys, scale: int = 6, value: str = "value", name: str = "index"
) -> DataFrame:
    """The older variant, grouping every twelfth rolling total by position.

    A series with any missing or negative input keeps the older output: zero
    everywhere except a null last row.
    """
    work = _positional(series, keys, scale, value)
    spoiled = F.when(F.col("_row") < F.col("_rows"), F.lit(0.0))
    return _finish(work, spoiled, name)


def standardized_cube(
    cube: DataFrame, cell: Keys = ("lat_idx", "lon_idx"), scale: int = 3, value: str = "value", name: str = "index"
) -> DataFrame:
    """The positional variant for every cell of a grid; spoiled cells are all null."""
    work = _positional(cube, cell, scale, value)
    return _finish(work, F.lit(None).cast("double"), name)
