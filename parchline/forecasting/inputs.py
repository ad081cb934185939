"""Model inputs of monthly series: lags, season, helper predictors, windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import season_cos, season_sin

# Input columns every model has, and defaults of the training jobs.
BASE_INPUTS = ("y", "y_lag_1", "y_lag_3", "y_lag_6", "month_sin", "month_cos")
LAGS = (1, 3, 6)
INPUT_WINDOW = 18
HORIZON = 12
BACKTEST_MONTHS = 36
MINIMUM_HELPER_COVERAGE = 0.02
MINIMUM_TRAINING_ROWS = 32
SERIES = ("dataset_key", "feature_id")
LEAST_SPREAD = 1e-6


def forecast_datasets(datasets: DataFrame, only: str | None = None) -> DataFrame:
    """Layers that are forecast: all but stations."""
    boundary = F.lower(F.coalesce("boundary_key", F.lit("")))
    kept = datasets.where((boundary != "station") & ~F.lower("dataset_key").contains("station"))
    if only is not None:
        kept = kept.where(F.lower("dataset_key") == only.lower())
    return kept.select(
        "dataset_key",
        F.coalesce("title", "dataset_key").alias("title"),
        F.lower(F.coalesce(F.nullif("source_key", F.lit("")), F.col("dataset_key"))).alias("source_key"),
        boundary.alias("boundary_key"),
    )


def shared_indices(available: DataFrame) -> DataFrame:
    """Indices that every layer has; ``available`` holds (dataset_key, index_name)."""
    layers = available.select(F.count_distinct("dataset_key")).scalar()
    counted = available.distinct().groupBy("index_name").agg(F.count("*").alias("_n"))
    return counted.where(F.col("_n") == layers).select("index_name")


def with_lags(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Positional lags (over the rows that have a value) and the season.

    A lag reaching before the series starts takes the current value.
    """
    order = Window.partitionBy(*keys).orderBy("date")
    lags = {f"y_lag_{k}": F.coalesce(F.lag("y", k).over(order), F.col("y")) for k in LAGS}
    return series.withColumns(
        {**lags, "month_sin": season_sin(F.col("date")), "month_cos": season_cos(F.col("date"))}
    )


def helper_coverage(frame: DataFrame, helpers: Sequence[str]) -> DataFrame:
    """Share of rows with a value, per layer and helper."""
    return frame.groupBy("dataset_key").agg(*[F.avg(F.col(h).isNotNull().cast("double")).alias(h) for h in helpers])


def with_helpers(
    frame: DataFrame,
    predictors: DataFrame,
    helpers: Sequence[str],
    on: Sequence[str] = ("date",),
    minimum: float = MINIMUM_HELPER_COVERAGE,
) -> DataFrame:
    """Join helpers by month and fill gaps: calendar-month mean, then median, then 0.

    A helper a layer hardly has is 0 throughout that layer. Means, medians and shares come from the number of rows of each layer and month
    (few rows per layer), and the rows are joined once.
    """
    keys = list(dict.fromkeys(["dataset_key", "date", *on]))
    n, month, layer = F.col("_n"), Window.partitionBy("dataset_key", F.month("date")), Window.partitionBy("dataset_key")
    # Rows of a layer and month share their helpers, so what fills a gap is found from one row for each of them.
    counted = frame.groupBy(*keys).agg(F.count("*").alias("_n")).join(predictors.select(*on, *helpers), list(on), "left")

    def fill(h: str) -> Column:
        known = F.when(F.col(h).isNotNull(), n).otherwise(F.lit(0))
        rows = F.sum(known).over(month)
        mean = F.when(rows > 0, F.sum(F.col(h) * n).over(month) / rows)
        middle = F.percentile(F.col(h), F.lit(0.5), known).over(layer)
        share = F.sum(known).over(layer) / F.sum(n).over(layer)
        return F.when(share < minimum, F.lit(0.0)).otherwise(F.coalesce(h, mean, middle, F.lit(0.0))).alias(h)

    filled = counted.select(*[F.col(k).alias(f"_{k}") for k in keys], *[fill(h) for h in helpers])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return frame.drop(*helpers).join(filled, same).drop(*[f"_{k}" for k in keys])


def scaling(frame: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Mean and population deviation per group; a flat column keeps deviation 1."""
    deviation = {c: F.stddev_pop(c) for c in columns}
    return frame.groupBy(*groups).agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in columns],
        *[F.when(d > LEAST_SPREAD, d).otherwise(1.0).alias(f"std_{c}") for c, d in deviation.items()],
    )


def standardized(frame: DataFrame, stats: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    others = [c for c in frame.columns if c not in columns]
    return frame.join(stats, list(groups)).select(
        *others, *[((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(c) for c in columns]
    )


def supervised_rows(
    frame: DataFrame, columns: Sequence[str], window: int = INPUT_WINDOW, cutoff: object | Column | None = None
) -> DataFrame:
    """Training rows: past the first ``window`` rows of a series, up to the cutoff, complete."""
    order = Window.partitionBy(*SERIES).orderBy("date")
    rows = frame.withColumn("_row", F.row_number().over(order)).where(F.col("_row") > window)
    if cutoff is not None:
        rows = rows.where(F.col("date") <= (cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast("date")))
    complete = F.lit(True)
    for c in dict.fromkeys([*columns, "y"]):
        complete = complete & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.where(complete).drop("_row")


def sequence_rows(
    frame: DataFrame, columns: Sequence[str], window: int = INPUT_WINDOW, cutoff: object | Column | None = None
) -> DataFrame:
    """Each row with the inputs of the ``window`` rows before it, oldest first."""
    before = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(-window, -1)
    row = F.array(*[F.col(c).cast("double") for c in columns])
    windows = frame.withColumn("window", F.collect_list(row).over(before)).where(F.size("window") == window)
    if cutoff is not None:
        windows = windows.where(F.col("date") <= (cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast("date")))
    return windows.where(~F.exists(F.flatten("window"), lambda v: v.isNull() | F.isnan(v))).select(
        *SERIES, "date", "y", "window"
    )


def histories(frame: DataFrame, columns: Sequence[str], window: int = INPUT_WINDOW) -> DataFrame:
    """Each row as a possible origin: recent values and inputs up to and including it."""
    upto = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(1 - window, 0)
    row = F.array(*[F.col(c).cast("double") for c in columns])
    return frame.select(
        *SERIES,
        F.col("date").alias("origin"),
        F.collect_list("y").over(upto).alias("recent"),
        F.collect_list(row).over(upto).alias("window"),
        F.row_number().over(Window.partitionBy(*SERIES).orderBy("date")).alias("rows"),
        F.max("date").over(Window.partitionBy(*SERIES)).alias("last_date"),
    )


def final_origins(history: DataFrame) -> DataFrame:
    """The last row of every series."""
    return history.where(F.col("origin") == F.col("last_date"))


def backtest_origins(
    history: DataFrame, cutoff: object | Column, window: int = INPUT_WINDOW, horizon: int = HORIZON, step: int = 3
) -> DataFrame:
    """Every third origin from the cutoff on that still leaves ``horizon`` months to check."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast("date")
    open_ended = history.where(
        (F.col("origin") >= limit) & (F.col("origin") <= F.add_months("last_date", -horizon))
    )
    order = Window.partitionBy(*SERIES).orderBy("origin")
    return (
        open_ended.withColumn("_n", F.row_number().over(order) - 1)
        .where((F.col("_n") % step == 0) & (F.col("rows") >= window))
        .drop("_n")
    )


def pooled_layers(layers: Mapping[str, DataFrame], keys: Sequence[str] = ("feature_id", "date")) -> DataFrame:
    """One training frame of several layers, with the input columns of the first.

    Inputs that a later layer lacks are 0 there; inputs that only later layers have are left out. Missing values within a
    column stay missing.
    """
    frames = [frame.withColumn("dataset_key", F.lit(name)) for name, frame in layers.items()]
    if not frames:
        raise ValueError("no layers to pool")
    order = ["dataset_key", *keys, *[c for c in frames[0].columns if c not in ("dataset_key", *keys)]]
    pooled = frames[0].select(*order)
    for frame in frames[1:]:
        pooled = pooled.unionByName(frame.select(*[F.col(c) if c in frame.columns else F.lit(0.0).alias(c) for c in order]))
    return pooled
