"""Checked queries: streams over the driver's files against their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import month_start
from ..session import scratch_path
from ..sources.store import TableStore
from ..streaming import jobs
from .base import dataset_models, query, rnd, rounded, seasonal, table, wide
from .forecasts import FEEDBACK, FEEDBACK_NUMBERS, FEEDBACK_OUT, actuals


def stream_table(spark, rows, label, **options):
    """Rows written as files and opened as a stream."""
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).options(**options).parquet(path)


@query("monthly_stream", sql=f"""
    WITH days AS (SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS date, arg_max(CASE WHEN event_id % 11 <> 0 THEN value ELSE -1 END, event_id) AS v FROM events GROUP BY 1, 2)
    SELECT station_id, CAST(date_trunc('month', date) AS DATE) AS date, count(*) FILTER (WHERE v >= 0) AS valid_days, count(*) AS observed_days,
           CASE WHEN count(*) FILTER (WHERE v >= 0) / day(last_day(min(date))) >= 6e-1 THEN {rnd("sum(v) FILTER (WHERE v >= 0)")} END AS precip FROM days GROUP BY 1, 2""")
def monthly_stream(spark, folder):
    """Daily rows arriving in several files, merged batch by batch."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("station_id"), F.to_date("ts").alias("date"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("precip_mm"), F.col("event_id").alias("seq"),
    ).repartition(3, F.col("seq") % 3)
    store = TableStore(spark, scratch_path(spark, "tables"))
    days = stream_table(spark, rows, "days", maxFilesPerTrigger=1)
    jobs.monthly_stream(days, store, scratch_path(spark, "progress"), 0.6).awaitTermination()
    out = jobs.monthly_totals(store).select("station_id", "date", "valid_days", "observed_days", "precip")
    return rounded(out, "precip")


@query("daily_stream", sql=f"""
    SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS date, {rnd("sum(value)")} AS precip_mm, count(value) AS readings FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2""")
def daily_stream(spark, folder):
    """Readings sent twice, summed by day; days the watermark has passed are final."""
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("reading_id"), "ts", F.col("user_id").cast("string").alias("station_id"), "value"
    )
    twice = rows.unionByName(rows)
    out = scratch_path(spark, "daily")
    jobs.daily_totals_stream(stream_table(spark, twice, "readings"), out, scratch_path(spark, "progress")).awaitTermination()
    return rounded(spark.read.schema("station_id string, date date, precip_mm double, readings bigint").parquet(out), "precip_mm")


@query("feedback_stream", views="seasonal dataset_models wide", sql=f"WITH {FEEDBACK} {FEEDBACK_OUT}")
def feedback_stream(spark, folder):
    """Forecasts and observations arriving in several files each, joined as they come; every file may hold any month, so none is late."""
    parts = ["dataset_key", "index_name", "method_name"]
    forecasts = stream_table(spark, seasonal(spark, folder).repartition(3, "target_date"), "forecasts", maxFilesPerTrigger=1)
    arriving = stream_table(spark, actuals(spark, folder).repartition(2, "feature_id"), "actuals", maxFilesPerTrigger=1)
    out = scratch_path(spark, "feedback")
    jobs.feedback_stream(arriving, forecasts, dataset_models(spark, folder), out, scratch_path(spark, "progress"), "36500 days").awaitTermination()
    rows = spark.read.parquet(out)
    return rounded(rows.select(*parts, "model_key", "feature_id", "issue_date", "target_date", "lead_month", *FEEDBACK_NUMBERS), *FEEDBACK_NUMBERS)
