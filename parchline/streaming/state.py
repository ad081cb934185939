"""Keyed state of streams that run on for years."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.calendar import month_start

MONTH_ROW = "station_id string, date date, valid_days bigint, observed_days bigint, expected_days int, coverage_ratio double, precip double, version bigint"


class MonthOfStation(StatefulProcessor):
    """The days of one station's month, at most 31, each with what was recorded last.

    Every batch that brings a row of the month gives its total anew, under a higher version. When the watermark has
    passed the month's end a timer drops the state, and the last version stands.
    """

    def __init__(self, minimum_coverage: float) -> None:
        self.minimum_coverage = minimum_coverage

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A month is read and written as one value: each call crosses to the state store and back.
        self.month = handle.getValueState("month", "version bigint, days array<struct<day int, value double, seq bigint>>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        station, month = key
        stored = self.month.get()
        version = stored[0] if stored is not None else 0
        known = {day[0]: (day[1], day[2]) for day in stored[1]} if stored is not None else {}
        changed = False
        for row in rows:
            day = row["date"].day
            recorded = (row["precip_mm"], row["seq"])
            # What is known already changes nothing.
            if day not in known or (row["seq"] >= known[day][1] and recorded != known[day]):
                known[day] = recorded
                changed = True
        if not changed:
            return
        if stored is None:
            end = month.replace(day=calendar.monthrange(month.year, month.month)[1]) + dt.timedelta(days=1)
            self.handle.registerTimer(int(dt.datetime(end.year, end.month, end.day, tzinfo=dt.timezone.utc).timestamp() * 1000))
        version += 1
        self.month.update((version, [(day, value, seq) for day, (value, seq) in known.items()]))
        values = [value for value, _ in known.values() if value is not None]
        expected = calendar.monthrange(month.year, month.month)[1]
        share = len(values) / expected
        total = float(sum(values)) if values and share >= self.minimum_coverage else None
        yield Row(
            station_id=station, date=month, valid_days=len(values), observed_days=len(known), expected_days=expected, coverage_ratio=share, precip=total, version=version,
        )

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802
        self.month.clear()
        return iter(())

    def close(self) -> None:
        pass


def monthly_versions(days: DataFrame, minimum_coverage: float = 0.8, lateness: str = "400 days") -> DataFrame:
    """Monthly totals of a stream of (station_id, date, precip_mm, seq), a new version whenever a month changes.

    Only the months that a batch brings rows for are touched. Rows later than ``lateness`` behind the newest are left out, and
    their state is gone by then.
    """
    timed = days.select("station_id", "date", F.col("precip_mm").cast("double").alias("precip_mm"), F.col("seq").cast("bigint").alias("seq"), F.col("date").cast("timestamp").alias("ts"))
    keyed = timed.withWatermark("ts", lateness).withColumn("month", month_start(F.col("date"))).groupBy("station_id", "month")
    return keyed.transformWithState(MonthOfStation(minimum_coverage), MONTH_ROW, "Update", "EventTime")
