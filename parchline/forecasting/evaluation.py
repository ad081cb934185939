"""Forecast errors, uncertainty spreads, interval payloads and realized feedback."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import severity
from ..functions.keys import DEFAULT_INTERVAL, INTERVAL_LABELS, interval_label
from ..functions.numeric import finite
from ..session import ensure_checkpoint_dir
from .inputs import HORIZON, LEAST_SPREAD, SERIES

# Constants of the spread rules.
SPREAD_FLOOR = 0.15
RMSE_FACTOR = 1.64
QUANTILE = 0.90
QUANTILE_ROWS = 8
RMSE_ROWS = 3
FALLBACK_BASE = 0.45
FALLBACK_STEP = 0.05
ACCURACY = 10_000


def matched(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Forecasts beside the values that came true; months without a value are left out."""
    known = actuals.where(F.col("y").isNotNull()).select(*keys, F.col("date").alias("target_date"), F.col("y").alias("actual"))
    return forecasts.join(known, [*keys, "target_date"])


def forecast_metrics(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Error metrics per group; R² and correlation are null without variance."""
    a, p = F.col("actual"), F.col("predicted")
    good = pairs.withColumn("actual", finite(a)).withColumn("predicted", finite(p)).where(a.isNotNull() & p.isNotNull())
    error = p - a
    n = F.count("*")
    spread = F.var_pop(a)
    both = (n > 1) & (spread > 0) & (F.var_pop(p) > 0)
    return good.groupBy(*groups).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
        F.when(spread > 0, F.lit(1.0) - F.avg(error * error) / spread).alias("r2"),
        # corr itself divides by zero under ANSI rules when a side is flat.
        F.when(both, F.covar_pop(a, p) / (F.stddev_pop(a) * F.stddev_pop(p))).alias("correlation"),
        F.avg((severity(a) == severity(p)).cast("double")).alias("drought_class_accuracy"),
        n.alias("sample_count"),
    )


def exact_quantile(rows: DataFrame, groups: Sequence[str], value: str, q: float, accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantile with linear interpolation, for groups of any size and shape.

    A quantile sketch per group (combined before the shuffle) is off by at most one in ``accuracy`` of the ranks, so two
    of its answers bracket the wanted ranks, whatever the values. What lies below the bracket is counted, and only the
    values inside, a few in ``accuracy`` of the group, are ordered.
    """
    v = F.col(value)
    kept = rows.where(v.isNotNull())
    slack = 2.0 / accuracy
    around = [F.percentile_approx(v, p, accuracy) for p in (max(0.0, q - slack), min(1.0, q + slack))]
    # Ranks next to each other may fall on both sides of an answer, so in tiny groups everything is looked at.
    tiny = F.count("*") <= accuracy
    limits = kept.groupBy(*groups).agg(
        F.count("*").alias("_n"), F.when(tiny, F.min(v)).otherwise(around[0]).alias("_lo"), F.when(tiny, F.max(v)).otherwise(around[1]).alias("_hi")
    )
    inside = kept.join(limits, list(groups)).where(v <= F.col("_hi"))
    counts = inside.groupBy(*groups, F.when(v >= F.col("_lo"), v).alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*groups).orderBy(F.col("_v").asc_nulls_first())
    ranked = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    rank = (F.col("_n") - 1) * F.lit(q)

    def at(wanted: Column) -> Column:
        return F.max(F.when((F.col("_start") <= wanted) & (F.col("_end") > wanted), F.col("_v")))

    picked = ranked.groupBy(*groups).agg(at(F.floor(rank)).alias("_a"), at(F.ceil(rank)).alias("_z"), F.first(rank - F.floor(rank)).alias("_f"))
    return picked.select(*groups, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias("quantile"))


EVERY_LAYER = "all"


def _residual_spreads(residual: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group: the quantile rule and the RMSE rule (null where there are too few rows)."""
    base = residual.groupBy(*groups).agg(
        F.count("*").alias("_n"), F.sqrt(F.avg(F.col("_abs") * F.col("_abs"))).alias("_rmse")
    )
    quantiles = exact_quantile(residual, groups, "_abs", QUANTILE)
    scaled = F.col("_rmse") * RMSE_FACTOR
    by_rmse = F.when(F.col("_n") >= RMSE_ROWS, scaled)
    return base.join(quantiles, list(groups), "left").select(
        *groups,
        # A spread of exactly zero counts as absent.
        F.nullif(F.when(F.col("_n") >= QUANTILE_ROWS, F.col("quantile")).otherwise(by_rmse), F.lit(0.0)).alias("by_quantile"),
        F.when(by_rmse.isNotNull(), F.greatest(by_rmse, F.lit(SPREAD_FLOOR))).alias("by_rmse"),
    )


def interval_spreads(pairs: DataFrame, history: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Half-widths per layer and lead for the three interval methods.

    Residuals of the layer come first, then those of all layers together, then a
    fallback from the spread of the history.
    """
    # The residuals are read several times below; a checkpoint keeps that cheap.
    ensure_checkpoint_dir(pairs.sparkSession)
    residual = (
        pairs.select("dataset_key", "lead_month", F.abs(finite(F.col("predicted") - F.col("actual"))).alias("_abs"))
        .where(F.col("_abs").isNotNull())
        .checkpoint()
    )
    # Every residual counts for its layer and for all layers together; both are bracketed and ordered in one pass.
    scopes = residual.withColumn("scope", F.explode(F.array(F.concat(F.lit("layer "), "dataset_key"), F.lit(EVERY_LAYER))))
    spreads = _residual_spreads(scopes, ["scope", "lead_month"]).checkpoint()
    own = spreads.where(F.col("scope") != EVERY_LAYER).withColumn("dataset_key", F.expr("substring(scope, 7)")).drop("scope")
    pooled = spreads.where(F.col("scope") == EVERY_LAYER).select(
        "lead_month", F.col("by_quantile").alias("pooled_quantile"), F.col("by_rmse").alias("pooled_rmse")
    )
    sigma = F.stddev_pop("y")
    layers = history.groupBy("dataset_key").agg(F.when(sigma > LEAST_SPREAD, sigma).otherwise(1.0).alias("_sigma"))
    leads = layers.withColumn("lead_month", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    fallback = F.col("_sigma") * (F.col("lead_month") * FALLBACK_STEP + FALLBACK_BASE)

    def floored(*choices: Column) -> Column:
        return F.greatest(F.coalesce(*choices), F.lit(SPREAD_FLOOR))

    return (
        leads.join(own, ["dataset_key", "lead_month"], "left")
        .join(pooled, ["lead_month"], "left")
        .select(
            "dataset_key",
            "lead_month",
            floored(F.col("by_quantile"), F.col("pooled_quantile"), fallback).alias("backtest_q90"),
            floored(F.col("by_rmse"), F.col("pooled_rmse"), fallback).alias("rmse_164"),
            floored(fallback).alias("historical_spread"),
        )
    )


def interval_payload(value: Column, spreads: Mapping[str, Column]) -> Column:
    """Map of interval method to (label, lower, upper); empty without a value."""
    entries = [
        F.when(
            finite(spread).isNotNull(),
            F.struct(
                F.lit(name).alias("key"),
                F.struct(
                    F.lit(INTERVAL_LABELS.get(name, name.replace("_", " ").title())).alias("label"),
                    (value - F.greatest(spread, F.lit(SPREAD_FLOOR))).alias("lower"),
                    (value + F.greatest(spread, F.lit(SPREAD_FLOOR))).alias("upper"),
                ).alias("value"),
            ),
        )
        for name, spread in spreads.items()
    ]
    present = F.filter(F.array(*entries), lambda e: e.isNotNull() & finite(value).isNotNull())
    return F.map_from_entries(present)


def with_intervals(forecasts: DataFrame, spreads: DataFrame) -> DataFrame:
    """Forecast rows with lower and upper bounds and the interval map."""
    names = ("backtest_q90", "rmse_164", "historical_spread")
    v = F.col("value")
    half = F.coalesce("backtest_q90", F.lit(SPREAD_FLOOR))
    return (
        forecasts.join(spreads, ["dataset_key", "lead_month"], "left")
        .withColumn("lower", v - half)
        .withColumn("upper", v + half)
        .withColumn("intervals", interval_payload(v, {n: F.col(n) for n in names}))
        .drop(*names)
    )


def chosen_bounds(rows: DataFrame, interval: str | None = None) -> DataFrame:
    """Bounds of the chosen interval, else the default ones, with label and band width."""
    name = (interval or "").strip().lower()
    picked = F.try_element_at("intervals", F.lit(name)) if name else F.lit(None).cast("struct<label:string,lower:double,upper:double>")
    usable = finite(picked["lower"]).isNotNull() & finite(picked["upper"]).isNotNull()
    default = interval_label(F.lit(name or DEFAULT_INTERVAL))
    out = (
        rows.withColumn("bound_lower", F.when(usable, picked["lower"]).otherwise(finite(F.col("lower"))))
        .withColumn("bound_upper", F.when(usable, picked["upper"]).otherwise(finite(F.col("upper"))))
        .withColumn("bound_label", F.when(usable, F.coalesce(picked["label"], default)).otherwise(default))
    )
    return out.withColumn("band_width", F.greatest(F.lit(0.0), F.col("bound_upper") - F.col("bound_lower")))


def errors() -> list[Column]:
    """Error, its size and its square, of ``predicted_value`` against ``actual_value``."""
    error = F.col("predicted_value") - F.col("actual_value")
    return [error.alias("error"), F.abs(error).alias("absolute_error"), (error * error).alias("squared_error")]


def realized_feedback(forecasts: DataFrame, dataset_models: DataFrame, actuals: DataFrame) -> DataFrame:
    """Errors of forecasts whose month has been observed since.

    ``actuals`` holds (dataset_key, index_name, feature_id, date, value).
    """
    method = ("dataset_key", "index_name", "method_name")
    seen = actuals.where(F.col("value").isNotNull()).select(
        "dataset_key", "index_name", "feature_id", F.col("date").alias("target_date"), F.col("value").alias("actual_value")
    )
    due = forecasts.where(F.col("value").isNotNull()).withColumnRenamed("value", "predicted_value")
    return (
        due.join(seen, ["dataset_key", "index_name", "feature_id", "target_date"])
        .join(dataset_models.select(*method, "model_key"), list(method), "left")
        .select(
            *method,
            "model_key",
            "feature_id",
            "issue_date",
            "target_date",
            "lead_month",
            "predicted_value",
            "actual_value",
            *errors(),
        )
    )


def feedback_summary(feedback: DataFrame, groups: Sequence[str] = ("dataset_key", "index_name", "method_name")) -> DataFrame:
    return feedback.groupBy(*groups).agg(
        F.count("*").alias("feedback_count"),
        F.avg("absolute_error").alias("feedback_mae"),
        F.sqrt(F.avg("squared_error")).alias("feedback_rmse"),
        F.avg("error").alias("feedback_bias"),
        F.max("target_date").alias("last_realized"),
    )
