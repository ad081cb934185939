"""Physical plans: filters reach the scan, exchanges stay few, nothing is a cross join."""

import datetime as dt

import numpy as np
from parchline.forecasting.inputs import with_helpers
from parchline.plans.station_index import StationRun, station_counters, station_days, station_features, station_index

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parchline.operators.overview import class_counts
from parchline.operators.series import filled_between
from parchline.operators.standardize import standardized_index
from parchline.plans.catalog import Catalog
from parchline.sources.store import TableStore


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("store")))
    ids = spark.range(200).select(F.when(F.col("id") % 2 == 0, "Asia").otherwise("europe").alias("dataset_key"), F.col("id").cast("string").alias("feature_id"))
    months = F.explode(F.sequence(F.lit(dt.date(2000, 1, 1)), F.lit(dt.date(2003, 12, 1)), F.expr("interval 1 month")))
    store.write_series(ids.select("*", months.alias("date"), F.rand(1).alias("spi3"), F.rand(2).alias("spi6")))
    places = ids.select("*", F.lit("n").alias("name"), F.create_map(F.lit("a"), F.lit("b")).alias("props"), F.lit("{}").alias("geometry"),
                        *[F.col("feature_id").cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    store.replace("features", places, ["dataset_key"], ["minx"])
    return Catalog(ids.select("dataset_key").distinct(), store.read("features"), store.read("series"))


def test_map_reads_one_layer_month_and_index(shelf):
    text = plan(shelf.map_data("asia", "spi3", "2001-05", bbox="10,10,50,50"))
    assert "PartitionFilters: [isnotnull(dataset_key" in text and "(lower(dataset_key" in text
    assert "EqualTo(date,2001-05-01)" in text and "LessThanOrEqual(minx,50.0)" in text
    assert "spi6" not in text
    assert shelf.map_data("asia", "spi3", "2001-05", bbox="10,10,50,50").count() == 21


def test_overview_needs_no_row_exchange(shelf):
    text = plan(class_counts(shelf.series, "spi3"))
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_index_and_gap_filling_take_one_exchange(spark, shelf):
    keys = ("dataset_key", "feature_id")
    indexed = plan(standardized_index(shelf.series, keys, (1, 3, 12), minimum_years=2, value="spi6"))
    assert indexed.count("Exchange hashpartitioning") == 1
    filled = plan(filled_between(shelf.series, keys, "spi3"))
    assert filled.count("Exchange") == 1 and "Join" not in filled


def test_hot_layer_spreads_over_files(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.range(0, 40000, 1, 8).select(
        F.lit("hot").alias("dataset_key"), (F.col("id") % 1000).cast("string").alias("feature_id"),
        F.add_months(F.lit(dt.date(2000, 1, 1)), (F.col("id") / 1000).cast("int")).alias("date"), F.rand(1).alias("spi3"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_series(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert store.read("series").select(F.input_file_name()).distinct().count() > 1
    assert store.read("series").count() == 40000


def frames_read(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_helpers_join_the_rows_once(spark, tmp_path):
    """The frame is read for its counts and for its rows; gaps are filled as from the joined rows."""
    rows = [("a" if i % 3 else "b", f"f{i % 5}", dt.date(2000 + i // 60, i // 5 % 12 + 1, 1), float(i)) for i in range(300)]
    spark.createDataFrame(rows, "dataset_key string, feature_id string, date date, y double").write.parquet(str(tmp_path / "frame"))
    helpers = [(dt.date(2000 + i // 12, i % 12 + 1, 1), None if i % 7 == 0 or i % 12 == 3 else float(i), 1.0 if i == 5 else None) for i in range(60)]
    spark.createDataFrame(helpers, "date date, rain double, rare double").write.parquet(str(tmp_path / "helpers"))
    frame, predictors = (spark.read.parquet(str(tmp_path / n)) for n in ("frame", "helpers"))
    found = with_helpers(frame, predictors, ["rain", "rare"], minimum=0.2)
    assert frames_read(found, "Relation [dataset_key") == 2 and frames_read(found, "Relation [date") == 1
    known = {d: (a, b) for d, a, b in helpers}
    joined = [(k, f, d, *known.get(d, (None, None))) for k, f, d, _ in rows]
    for r in found.collect():
        own = [j for j in joined if j[0] == r["dataset_key"]]
        month = [j[3] for j in own if j[2].month == r["date"].month and j[3] is not None]
        values = [j[3] for j in own if j[3] is not None]
        wanted = known.get(r["date"], (None, None))[0]
        wanted = wanted if wanted is not None else float(np.mean(month)) if month else float(np.median(values))
        assert abs(r["rain"] - wanted) < 1e-9 and r["rare"] == 0.0


def test_station_runs_read_the_raw_rows_once(spark, tmp_path):
    rows = [("s", "S", 1.0, 2.0, None, dt.date(2000, 1, 1 + i // 2), float(i), i) for i in range(40)]
    spark.createDataFrame(rows, "station_id string, station_name string, lon double, lat double, station_elevation double, date date, precip_mm double, seq bigint").write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    run = StationRun("s_spi1", "S", (1,), minimum_years=1)
    days = station_days(raw, shared=True)
    index = station_index(days, run)
    for made in (index, station_features(days, index, run), station_counters(days, index, run)):
        assert frames_read(made, "parquet") == 0
    counters = station_counters(days, index, run).first()
    assert counters["duplicate_rows"] == 20 and station_features(days, index, run).first()["daily_rows"] == 20
    alone = station_days(raw, ("precip_mm",))
    assert "station_name" not in alone._jdf.queryExecution().executedPlan().toString()
