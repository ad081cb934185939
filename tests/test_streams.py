"""Streams: keyed month state, joined feedback, and what a batch touches."""

import datetime as dt
from pathlib import Path

from parchline.operators.station import monthly_precipitation
from parchline.operators.upsert import newest_per_key
from parchline.sources.store import TableStore
from parchline.streaming import jobs

D = dt.date
DAYS = "station_id string, date date, precip_mm double, seq bigint"


def arrive(spark, folder, rows, schema, name):
    """One more file in the folder of a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / name))


def test_late_repeated_and_single_batches(spark, tmp_path):
    first = [("a", D(2000, 2, i), 1.0, i) for i in range(1, 29)] + [("a", D(2000, 3, 1), 9.0, 100), ("b", D(2000, 2, 1), None, 1)]
    late = [("a", D(2000, 2, 29), 4.0, 200), ("a", D(2000, 2, 1), 3.0, 201), ("a", D(2000, 2, 2), 50.0, 0)]
    store = TableStore(spark, str(tmp_path / "tables"))
    folder = tmp_path / "in"

    def run():
        days = spark.readStream.schema(DAYS).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
        jobs.monthly_stream(days, store, str(tmp_path / "progress"), 0.9).awaitTermination()
        return {(r["station_id"], r["date"]): r for r in jobs.monthly_totals(store).collect()}

    for number, rows in enumerate((first, late, first, late)):
        arrive(spark, folder, rows, DAYS, str(number))
        got = run()
    every = spark.createDataFrame(first + late, DAYS)
    batch = {(r["station_id"], r["date"]): r for r in monthly_precipitation(newest_per_key(every, ["station_id", "date"], "seq"), 0.9).collect()}
    columns = ("valid_days", "observed_days", "expected_days", "precip")
    assert {k: [r[c] for c in columns] for k, r in got.items()} == {k: [r[c] for c in columns] for k, r in batch.items()}
    assert got["a", D(2000, 2, 1)]["precip"] == 34.0 and got["a", D(2000, 3, 1)]["precip"] is None

    # A batch of one station writes one month; what other batches wrote stays as it is.
    before = {p: p.stat().st_mtime_ns for p in Path(store.path("monthly_versions")).rglob("*.parquet")}
    arrive(spark, folder, [("b", D(2000, 2, 2), 2.0, 5)], DAYS, "single")
    got = run()
    after = {p: p.stat().st_mtime_ns for p in Path(store.path("monthly_versions")).rglob("*.parquet")}
    assert before.items() <= after.items()
    newest = store.read("monthly_versions")
    last = newest.where(newest.batch == newest.agg({"batch": "max"}).first()[0]).collect()
    assert [(r["station_id"], r["date"], r["valid_days"], r["observed_days"], r["version"]) for r in last] == [("b", D(2000, 2, 1), 1, 2, 2)]

    # Two years later the month is closed: its state is gone and rows of it are left out.
    arrive(spark, folder, [("b", D(2002, 6, 1), 1.0, 9)], DAYS, "later")
    run()
    arrive(spark, folder, [("a", D(2000, 2, 5), 700.0, 999)], DAYS, "too late")
    assert run()["a", D(2000, 2, 1)]["precip"] == 34.0


FORECASTS = "dataset_key string, index_name string, method_name string, feature_id string, issue_date date, target_date date, lead_month int, value double"
ACTUALS = "dataset_key string, index_name string, feature_id string, date date, value double"


def test_feedback_joins_both_ways_once_and_leaves_old_files(spark, tmp_path):
    models = spark.createDataFrame([("d", "spi3", "m", "key")], "dataset_key string, index_name string, method_name string, model_key string")
    out = tmp_path / "out"
    forecast = lambda f, month, value=1.0: ("d", "spi3", "m", f, D(2000, 1, 1), D(2000, month, 1), month - 1, value)
    actual = lambda f, month, value: ("d", "spi3", f, D(2000, month, 1), value)

    def run(forecasts=(), actuals=(), name=""):
        for rows, schema, kind in ((forecasts, FORECASTS, "forecasts"), (actuals, ACTUALS, "actuals")):
            if rows:
                arrive(spark, tmp_path / kind, list(rows), schema, name)
        reads = [spark.readStream.schema(schema).parquet(str(tmp_path / kind / "*")) for schema, kind in ((ACTUALS, "actuals"), (FORECASTS, "forecasts"))]
        jobs.feedback_stream(*reads, models, str(out), str(tmp_path / "progress")).awaitTermination()
        return sorted((r.feature_id, r.target_date.month, r.predicted_value, r.actual_value, r.error, r.model_key) for r in spark.read.parquet(str(out)).collect())

    run([forecast("x", 2), forecast("x", 3), forecast("x", 4, None)], [actual("x", 2, 0.5), actual("y", 3, 2.0), actual("x", 5, None)], "1")
    assert run() == [("x", 2, 1.0, 0.5, 0.5, "key")]
    before = {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}
    # Observed after its forecast, observed before it, and observed once more.
    found = run([forecast("y", 3)], [actual("x", 3, 3.0), actual("x", 2, 9.0)], "2")
    assert found == [("x", 2, 1.0, 0.5, 0.5, "key"), ("x", 3, 1.0, 3.0, -2.0, "key"), ("y", 3, 1.0, 2.0, -1.0, "key")]
    after = {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}
    assert before.items() <= after.items()
    assert {p.parent.name for p in after} == {"target_date=2000-02-01", "target_date=2000-03-01"}


def test_a_month_is_read_and_written_once_a_batch():
    """However many days a batch brings, a month costs one read and one write of state."""
    from parchline.streaming.state import MonthOfStation

    calls = []

    class Value:
        kept = None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Value()

        def registerTimer(self, _):  # noqa: N802
            calls.append("timer")

    month = MonthOfStation(0.1)
    month.init(Handle())
    rows = [{"date": D(2000, 2, i), "precip_mm": 1.0, "seq": i} for i in range(1, 29)]
    first = list(month.handleInputRows(("a", D(2000, 2, 1)), iter(rows), None))
    again = list(month.handleInputRows(("a", D(2000, 2, 1)), iter([{"date": D(2000, 2, 3), "precip_mm": 5.0, "seq": 99}]), None))
    assert [(r["precip"], r["version"]) for r in first + again] == [(28.0, 1), (32.0, 2)]
    assert calls == ["get", "timer", "update", "get", "update"]
