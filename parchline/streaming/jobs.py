"""Incremental jobs: daily rows to months, readings to days, actuals to feedback."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..forecasting.evaluation import errors
from ..schema import FEEDBACK_KEY
from ..sources.store import TableStore
from .state import monthly_versions

MONTH_KEY = ("station_id", "date")
# State that outgrows memory and has timers is kept by the embedded key-value store.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEY_VALUE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def key_value_state(spark: SparkSession) -> Iterator[None]:
    """The session's choice of state store, set for a query that is started within and then put back."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, KEY_VALUE_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def monthly_stream(
    days: DataFrame, store: TableStore, checkpoint: str, minimum_coverage: float = 0.8, lateness: str = "400 days"
) -> StreamingQuery:
    """Keep monthly totals up to date with a stream of (station_id, date, precip_mm, seq).

    The row recorded last wins whichever batch brings it. A batch writes the months it changed and nothing else; a
    batch that is run again replaces what it wrote.
    """

    def log(batch: DataFrame, number: int) -> None:
        store.replace("monthly_versions", batch.withColumn("batch", F.lit(number)), ["batch"])

    with key_value_state(days.sparkSession):
        return (
            monthly_versions(days, minimum_coverage, lateness).writeStream.foreachBatch(log)
            .option("checkpointLocation", checkpoint)
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )


def monthly_totals(store: TableStore) -> DataFrame:
    """The newest version of every month."""
    rows = store.read("monthly_versions").drop("batch")
    others = [c for c in rows.columns if c not in MONTH_KEY]
    newest = rows.groupBy(*MONTH_KEY).agg(F.max_by(F.struct(*others), "version").alias("newest"))
    return newest.select(*MONTH_KEY, *[f"newest.{c}" for c in others])


def daily_totals(readings: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Daily totals of gauge readings (reading_id, station_id, ts, value) as a stream.

    A reading sent twice counts once. A day is final, and its state dropped, once
    the watermark has passed its end; later readings of it are left out and counted
    in the query's progress.
    """
    return (
        readings.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["reading_id"])
        .groupBy(F.window("ts", "1 day").alias("day"), "station_id")
        .agg(F.sum("value").alias("precip_mm"), F.count("value").alias("readings"))
        .select("station_id", F.to_date("day.start").alias("date"), "precip_mm", "readings")
    )


def daily_totals_stream(readings: DataFrame, out: str, checkpoint: str, lateness: str = "2 days") -> StreamingQuery:
    return (
        daily_totals(readings, lateness)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def realized_pairs(forecasts: DataFrame, actuals: DataFrame, dataset_models: DataFrame, lateness: str = "400 days") -> DataFrame:
    """Streams of forecasts and observations, joined by feature and month.

    Either side may come first. A month's state is dropped once the watermarks of both streams have passed it by ``lateness``, so state is
    bounded by the months still open. A forecast that meets several observations of its month counts once.
    """
    keys = ("dataset_key", "index_name", "feature_id")
    due = forecasts.where(F.col("value").isNotNull()).select(
        *keys, "method_name", "issue_date", "target_date", "lead_month", F.col("value").alias("predicted_value"), F.col("target_date").cast("timestamp").alias("month")
    ).withWatermark("month", lateness)
    seen = actuals.where(F.col("value").isNotNull()).select(*keys, F.col("value").alias("actual_value"), F.col("date").cast("timestamp").alias("month")).withWatermark("month", lateness)
    pairs = due.join(seen, [*keys, "month"]).dropDuplicatesWithinWatermark(list(FEEDBACK_KEY))
    return pairs.join(dataset_models.select("dataset_key", "index_name", "method_name", "model_key"), ["dataset_key", "index_name", "method_name"], "left").select(
        "dataset_key", "index_name", "method_name", "model_key", "feature_id", "issue_date", "target_date", "lead_month", "predicted_value", "actual_value", *errors()
    )


def feedback_stream(
    actuals: DataFrame, forecasts: DataFrame, dataset_models: DataFrame, out: str, checkpoint: str, lateness: str = "400 days"
) -> StreamingQuery:
    """Compare arriving observations with arriving forecasts.

    ``actuals`` streams (dataset_key, index_name, feature_id, date, value), ``forecasts`` rows of the forecast table. Errors are
    appended in files by target month; what is written is not touched again.
    """
    return (
        realized_pairs(forecasts, actuals, dataset_models, lateness)
        .writeStream.format("parquet")
        .partitionBy("target_date")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
