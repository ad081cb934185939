"""Train, backtest, forecast and store, for one source and index."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..forecasting.evaluation import (
    forecast_metrics, interval_spreads, matched, realized_feedback, with_intervals,
)
from ..forecasting.inputs import (
    BACKTEST_MONTHS, HORIZON, INPUT_WINDOW, MINIMUM_TRAINING_ROWS, backtest_origins, final_origins, histories,
)
from ..forecasting.models import TreeForecaster, WindowForecaster, recursive_forecast
from ..functions.keys import is_retired, model_key, normalized_method
from ..schema import FEEDBACK_KEY
from ..session import ensure_checkpoint_dir
from ..sources.store import TableStore

Forecaster = TreeForecaster | WindowForecaster


@dataclass
class ForecastRun:
    """What one run produced; every table is a DataFrame over checkpointed state."""

    method: str
    model_key: str
    final: Forecaster
    frame: DataFrame
    backtest: DataFrame
    evaluation: DataFrame
    summary: DataFrame
    forecasts: DataFrame
    issue_dates: DataFrame
    training_rows: int
    final_rows: int


@dataclass
class TooFewRows:
    """Why a run made no forecasts."""

    method: str
    index_name: str
    training_rows: int
    least_rows: int
    layers: DataFrame

    def status(self) -> DataFrame:
        """One row per layer."""
        return self.layers.select(
            "dataset_key", F.lit(self.index_name).alias("index_name"), F.lit(self.method).alias("method_name"),
            F.lit("insufficient_rows").alias("status"), F.lit(self.training_rows).alias("training_rows"), F.lit(self.least_rows).alias("least_rows"),
        )


def run_forecast(
    frame: DataFrame,
    make: Callable[[], Forecaster],
    source_key: str,
    index_name: str,
    horizon: int = HORIZON,
    backtest_months: int = BACKTEST_MONTHS,
    window: int = INPUT_WINDOW,
    least_rows: int = MINIMUM_TRAINING_ROWS,
) -> ForecastRun | TooFewRows:
    """Evaluate on the last months with a model that has not seen them, then fit on all.

    ``frame`` pools the layers of a source. Fewer training rows than ``least_rows``
    give no forecast but a status.
    """
    # Training, backtest and forecast all read the frame; it is computed once.
    ensure_checkpoint_dir(frame.sparkSession)
    frame = frame.checkpoint()
    last = frame.select(F.add_months(F.max("date"), -backtest_months).alias("c")).first()["c"]
    judged, final = make(), make()
    known, rows = judged.training(frame, last, window)
    if rows < least_rows:
        return TooFewRows(judged.method, index_name, rows, least_rows, frame.select("dataset_key").distinct())
    past = histories(frame, judged.columns, window)

    def backtest() -> DataFrame:
        judged.train(known, rows)
        tested = recursive_forecast(judged, backtest_origins(past, last, window, horizon), horizon)
        return matched(tested, frame).checkpoint()

    # Neither model waits for the other: their many small jobs fill the cores side by side.
    with ThreadPoolExecutor(1) as side:
        waiting = side.submit(inheritable_thread_target(frame.sparkSession)(final.fit), frame, None, window)
        pairs = backtest()
        final_rows = waiting.result()
    issue = frame.groupBy("dataset_key").agg(F.max("date").alias("issue_date"))
    ahead = recursive_forecast(final, final_origins(past), horizon).withColumnRenamed("predicted", "value")
    method_columns = [F.lit(index_name).alias("index_name"), F.lit(final.method).alias("method_name")]
    forecasts = with_intervals(ahead.join(issue, "dataset_key"), interval_spreads(pairs, frame, horizon)).select(
        "dataset_key", *method_columns, "feature_id", "issue_date", "target_date", "lead_month", "value", "lower",
        "upper", "intervals",
    )
    evaluation = forecast_metrics(pairs, ["dataset_key", "lead_month"]).select(
        "dataset_key", *method_columns, "lead_month", "mae", "rmse", "bias", "r2", "correlation",
        "drought_class_accuracy", "sample_count",
    )
    key = model_key(source_key, index_name, final.method)
    return ForecastRun(
        final.method, key, final, frame, pairs, evaluation, forecast_metrics(pairs, []), forecasts, issue, rows, final_rows
    )


def store_run(
    store: TableStore, run: ForecastRun, source_key: str, index_name: str, actuals: DataFrame, stamp: dt.datetime
) -> str:
    """Keep realized errors of the old forecasts, then replace forecasts and evaluation.

    The model is saved under its version and as the latest one. Returns the version.
    """
    version = f"{run.model_key}_{stamp.strftime('%Y%m%dT%H%M%SZ')}"
    partitions = ["dataset_key", "index_name", "method_name"]
    if store.exists("forecasts") and store.exists("dataset_models"):
        old = store.read("forecasts").where((F.col("index_name") == index_name) & (F.col("method_name") == run.method))
        learned = realized_feedback(old, store.read("dataset_models"), actuals)
        # Actuals that come twice give one row; of two values the larger stays.
        store.upsert("feedback", learned, FEEDBACK_KEY, partitions, "actual_value")
    artifact = store.path(f"artifacts/{run.model_key}")
    versioned = store.path(f"artifacts/{version}")
    stored = run.final.pipeline()
    stored.write().overwrite().save(versioned)
    stored.write().overwrite().save(artifact)
    store.replace("forecasts", run.forecasts, partitions)
    store.replace("evaluation", run.evaluation, partitions)
    # A layer without backtest pairs now must not keep an old evaluation. What the run did write stays in place all along.
    for layer in run.issue_dates.select("dataset_key").distinct().join(run.evaluation.select("dataset_key"), "dataset_key", "left_anti").collect():
        store.clear("evaluation", {"dataset_key": layer["dataset_key"], "index_name": index_name, "method_name": run.method})
    spans = store.read("forecasts").where(
        (F.col("index_name") == index_name) & (F.col("method_name") == run.method)
    ).groupBy(*partitions).agg(
        F.first("issue_date").alias("issue_date"),
        F.min("target_date").alias("forecast_min_date"),
        F.max("target_date").alias("forecast_max_date"),
    )
    store.replace("dataset_models", spans.withColumn("model_key", F.lit(run.model_key)), partitions)
    row = run.summary.select(
        F.lit(run.model_key).alias("model_key"),
        F.lit(run.method).alias("method_name"),
        F.lit(source_key).alias("source_key"),
        F.lit(index_name).alias("index_name"),
        F.lit(INPUT_WINDOW).alias("input_window"),
        F.lit(HORIZON).alias("horizon"),
        F.lit("ready").alias("status"),
        F.lit(artifact).alias("artifact_path"),
        F.array(*[F.lit(c) for c in run.final.columns]).alias("feature_columns"),
        F.create_map(F.lit("training_rows"), F.lit(str(run.training_rows))).alias("training_params"),
        F.create_map(*[x for c in ("mae", "rmse", "bias", "r2") for x in (F.lit(c), F.col(c))]).alias("summary_metrics"),
        F.lit(stamp).alias("trained_at"),
    )
    store.upsert("models", row, ["model_key", "source_key", "index_name"], ["source_key", "index_name"])
    entry = store.read("models").where(F.col("model_key") == run.model_key).select(
        F.lit(version).alias("version_key"), "model_key", "method_name", F.lit(versioned).alias("artifact_path"),
        "trained_at", "feature_columns", "training_params", "summary_metrics",
    )
    store.append_once("model_versions", entry, ["version_key"])
    return version


def without_retired(table: DataFrame, key: str | None = None) -> DataFrame:
    """Drop rows of retired methods and give rows without a method the default one."""
    kept = table.where(~is_retired(F.col("method_name"), F.col(key) if key else None, key == "version_key"))
    return kept.withColumn("method_name", normalized_method(F.col("method_name")))
