"""Monthly series as rows: gaps, bounds, tails, neighbours and straight lines.

A series is identified by key columns and has one row per month, so one series
has at most a few thousand rows however large the table is. Windows partition by
the series keys only; they share one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

Keys = Sequence[str]


def by_date(keys: Keys, date: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(date)


def whole(keys: Keys) -> WindowSpec:
    return Window.partitionBy(*keys)


def monthly_total(rows: DataFrame, keys: Keys, when: Column, value: Column) -> DataFrame:
    """Null-aware monthly sums; the map-side partial sums absorb hot keys."""
    return rows.groupBy(*keys, F.trunc(F.to_date(when), "MM").alias("date")).agg(F.sum(value).alias("value"))


def month_steps(first: Column, last: Column) -> Column:
    """All months from first to last, or an empty array when first is after last."""
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )


def value_bounds(series: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """First and last month that has a value."""
    return series.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date")
    )


def filled_between(series: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Every month from the first to the last value of each series, null in the gaps.

    Each row emits itself and the missing months up to the next row, so there is
    one exchange on the series keys and no join with a month table.
    """
    following = F.lead("date").over(by_date(keys))
    return (
        series.where(F.col(value).isNotNull())
        .select(*keys, "date", value, following.alias("_next"))
        .withColumn(
            "_month",
            F.explode(month_steps(F.col("date"), F.coalesce(F.add_months("_next", -1), F.col("date")))),
        )
        .select(
            *keys,
            F.col("_month").alias("date"),
            F.when(F.col("_month") == F.col("date"), F.col(value)).alias(value),
        )
    )


def on_common_months(
    series: DataFrame, keys: Keys, values: Sequence[str] = ("value",), within: Keys = ()
) -> DataFrame:
    """Every series on the same months: from the earliest to the latest month.

    ``within`` names the keys that share one range (a dataset); by default the
    range is global. The range is one row per group of ``within``. The series is
    read twice (range, rows), so it is checkpointed: what produced it, often a scan
    of all raw data, runs once.
    """
    ensure_checkpoint_dir(series.sparkSession)
    series = series.select(*keys, "date", *values).checkpoint()
    if within:
        limits = series.groupBy(*within).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
        bounded = series.join(limits, list(within))
        low, high = F.col("_lo"), F.col("_hi")
    else:
        bounded = series
        ends = series.select(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
        low, high = ends["lo"], ends["hi"]
    order = by_date(keys)
    marked = bounded.select(
        *keys,
        "date",
        *values,
        low.alias("_low"),
        high.alias("_high"),
        F.lag("date").over(order).isNull().alias("_first"),
        F.lead("date").over(order).alias("_next"),
    )
    before = F.when(F.col("_first"), month_steps(F.col("_low"), F.add_months("date", -1))).otherwise(
        F.array().cast("array<date>")
    )
    onward = month_steps(
        F.col("date"), F.when(F.col("_next").isNull(), F.col("_high")).otherwise(F.add_months("_next", -1))
    )
    return marked.withColumn("_month", F.explode(F.concat(before, onward))).select(
        *keys,
        F.col("_month").alias("date"),
        *[F.when(F.col("_month") == F.col("date"), F.col(v)).alias(v) for v in values],
    )


def between_months(series: DataFrame, start: object | None, end: object | None, value: str = "value") -> DataFrame:
    """Non-null rows between optional inclusive bounds."""
    kept = series.where(F.col(value).isNotNull())
    if start is not None:
        kept = kept.where(F.col("date") >= F.lit(start))
    if end is not None:
        kept = kept.where(F.col("date") <= F.lit(end))
    return kept


def tail(series: DataFrame, keys: Keys, count: int) -> DataFrame:
    """The last ``count`` rows of each series."""
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return (
        series.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= count).drop("_back")
    )


def summary(series: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Point count and value summary over the whole series."""
    v = F.col(value)
    return series.groupBy(*keys).agg(
        F.count("*").alias("point_count"),
        F.count(v).alias("value_count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.max_by(v, F.when(v.isNotNull(), F.col("date"))).alias("latest"),
    )


def compacted(series: DataFrame, keys: Keys, max_points: int, value: str = "value") -> DataFrame:
    """Last points of each series beside counts and values of the full series."""
    everything = whole(keys)
    v = F.col(value)
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return (
        series.select(
            *keys,
            "date",
            v.alias(value),
            F.count("*").over(everything).alias("point_count"),
            F.count(v).over(everything).alias("value_count"),
            F.min(v).over(everything).alias("min"),
            F.max(v).over(everything).alias("max"),
            F.avg(v).over(everything).alias("mean"),
            F.max_by(v, F.when(v.isNotNull(), F.col("date"))).over(everything).alias("latest"),
            F.row_number().over(newest).alias("_back"),
        )
        .where(F.col("_back") <= max_points)
        .drop("_back")
        .withColumn("included_point_count", F.least(F.col("point_count"), F.lit(max_points).cast("bigint")))
    )


def with_line(series: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Least-squares line over the position in the series, nulls left out of the fit.

    Fewer than two values give a null line; a series of one row keeps its value.
    """
    everything = whole(keys)
    placed = series.withColumn("_x", (F.row_number().over(by_date(keys)) - 1).cast("double"))
    x = F.when(F.col(value).isNotNull(), F.col("_x"))
    mean_x = F.avg(x).over(everything)
    mean_y = F.avg(value).over(everything)
    centred = (
        placed.withColumn("_n", F.count(value).over(everything))
        .withColumn("_rows", F.count("*").over(everything))
        .withColumn("_mx", mean_x)
        .withColumn("_my", mean_y)
    )
    dx = F.when(F.col(value).isNotNull(), F.col("_x") - F.col("_mx"))
    dy = F.col(value) - F.col("_my")
    fitted = centred.withColumn("_num", F.sum(dx * dy).over(everything)).withColumn(
        "_den", F.sum(dx * dx).over(everything)
    )
    slope = F.when(F.col("_den") == 0, F.lit(0.0)).otherwise(F.col("_num") / F.col("_den"))
    line = F.col("_my") + slope * (F.col("_x") - F.col("_mx"))
    return fitted.withColumn(
        "line", F.when(F.col("_rows") < 2, F.col(value)).when(F.col("_n") >= 2, line)
    ).drop("_x", "_n", "_rows", "_mx", "_my", "_num", "_den")


def last_years(series: DataFrame, keys: Keys, years: int = 5) -> DataFrame:
    """Rows of the last years before each series' end."""
    end = F.max("date").over(whole(keys))
    return series.withColumn("_end", end).where(F.col("date") >= F.add_months("_end", -12 * years)).drop("_end")


def with_neighbours(series: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Values of the calendar months before and after each row (null when absent)."""
    order = by_date(keys)
    before = F.when(F.lag("date").over(order) == F.add_months("date", -1), F.lag(value).over(order))
    after = F.when(F.lead("date").over(order) == F.add_months("date", 1), F.lead(value).over(order))
    return series.withColumn("previous", before).withColumn("following", after)


def timeline(observed: DataFrame, forecast: DataFrame, keys: Keys) -> DataFrame:
    """Distinct months that are observed or forecast."""
    return observed.select(*keys, "date").union(
        forecast.select(*keys, F.col("target_date").alias("date"))
    ).distinct()


def panel_range(observed: DataFrame, forecast: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """First observed month to the later of the last observed and last forecast month."""
    ahead = forecast.groupBy(*keys).agg(F.max("target_date").alias("forecast_max"))
    return (
        value_bounds(observed, keys, value)
        .join(ahead, list(keys), "left")
        .select(*keys, "min_date", F.greatest("max_date", "forecast_max").alias("max_date"))
    )


def to_long(wide: DataFrame, keys: Keys, values: Sequence[str] | None = None) -> DataFrame:
    """Wide table to (keys, index_name, value) rows without nulls."""
    names = list(values) if values is not None else [c for c in wide.columns if c not in keys]
    numbers = wide.select(*keys, *[F.col(n).try_cast("double").alias(n) for n in names])
    return numbers.unpivot(list(keys), names, "index_name", "value").where(F.col("value").isNotNull())
