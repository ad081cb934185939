"""Standardized index: variants agree, gaps, periods, ties, and a numpy check."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchline.operators.series import filled_between, on_common_months, with_line
from parchline.operators.standardize import (
    standardized_by_position, standardized_cube, standardized_index, with_reference_mode,
)

ONE = ("feature_id",)


def months(first: str, count: int) -> list[dt.date]:
    y, m = int(first[:4]), int(first[5:7])
    return [dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1) for i in range(count)]


def series(spark, values, first="1981-01", fid="a"):
    rows = [(fid, d, None if v is None or np.isnan(v) else float(v)) for d, v in zip(months(first, len(values)), values)]
    return spark.createDataFrame(rows, "feature_id string, date date, value double")


def column(df, name):
    return np.array([np.nan if r[name] is None else r[name] for r in df.orderBy("date").collect()])


def brute(values, dates, scale, start, end, least):
    """Straight from the definition, one value at a time."""
    out = np.full(len(values), np.nan)
    if any(v < 0 for v in values if np.isfinite(v)):
        return out
    total = [np.nan] * (scale - 1) + [sum(values[i - scale + 1 : i + 1]) for i in range(scale - 1, len(values))]
    for i, t in enumerate(total):
        if not np.isfinite(t):
            continue
        ref = [total[j] for j in range(len(values)) if np.isfinite(total[j]) and dates[j].month == dates[i].month
               and (start is None or dates[j] >= start) and (end is None or dates[j] <= end)]
        if len(ref) >= max(1, least):
            rank = max(1, sum(r <= t for r in ref))
            out[i] = NormalDist().inv_cdf((rank - 0.44) / (len(ref) + 0.12))
    return out


def test_full_period_equals_the_positional_variant(spark):
    values = np.random.default_rng(42).gamma(2.0, 20.0, 480)
    df = series(spark, values)
    a = column(standardized_index(df, ONE, (3,), minimum_years=1), "spi3")
    b = column(standardized_by_position(df, ONE, 3), "index")
    c = column(standardized_cube(df, ONE, 3), "index")
    np.testing.assert_allclose(a, b, equal_nan=True)
    np.testing.assert_allclose(b, c, equal_nan=True)
    np.testing.assert_allclose(a, brute(values, months("1981-01", 480), 3, None, None, 1), equal_nan=True, atol=1e-12)


def test_too_few_reference_years_give_nothing(spark):
    df = series(spark, np.arange(120) + 1.0, "2000-01")
    out = standardized_index(df, ONE, (3,), "2000-01-01", "2004-12-01", 10)
    assert np.isnan(column(out, "spi3")).all()


def test_missing_month_spoils_only_its_windows(spark):
    values = np.random.default_rng(7).gamma(2.0, 10.0, 360)
    values[100] = np.nan
    out = column(standardized_index(series(spark, values, "1991-01"), ONE, (3,), minimum_years=20), "spi3")
    assert np.isnan(out[100:103]).all() and np.isfinite(out[99]) and np.isfinite(out[103])


@pytest.mark.parametrize("scale,start,end", [(1, None, None), (6, dt.date(1985, 1, 1), dt.date(1994, 12, 1))])
def test_against_definition_with_ties_and_gaps(spark, scale, start, end):
    values = np.random.default_rng(3).integers(0, 6, 240).astype(float)
    values[[5, 60, 61, 130]] = np.nan
    out = column(standardized_index(series(spark, values), ONE, (scale,), start, end, 5), f"spi{scale}")
    np.testing.assert_allclose(out, brute(values, months("1981-01", 240), scale, start, end, 5), equal_nan=True, atol=1e-12)


def test_negative_or_missing_input(spark):
    values = [5.0] * 60
    values[30] = -1.0
    df = series(spark, values)
    assert np.isnan(column(standardized_index(df, ONE, (3,), minimum_years=1), "spi3")).all()
    old = column(standardized_by_position(df, ONE, 3), "index")
    assert (old[:-1] == 0).all() and np.isnan(old[-1])
    assert np.isnan(column(standardized_cube(df, ONE, 3), "index")).all()


def test_reference_falls_back_when_a_calendar_month_is_thin(spark):
    values = np.random.default_rng(1).gamma(2.0, 10.0, 120)
    thin = values.copy()
    thin[3::12] = np.nan
    df = series(spark, values).union(series(spark, thin, fid="b"))
    moded = with_reference_mode(df, ONE, "1981-01-01", "1990-12-01", 10)
    modes = {r["feature_id"]: r["reference_mode"] for r in moded.select("feature_id", "reference_mode").distinct().collect()}
    assert modes == {"a": "configured", "b": "fallback_available"}
    strict = with_reference_mode(df, ONE, "1981-01-01", "1990-12-01", 10, fallback=False)
    assert strict.where(F.col("reference_mode") == "configured_insufficient").count() == 120


def test_spines(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2000, 1, 1), 1.0), ("a", dt.date(2000, 4, 1), None), ("a", dt.date(2000, 5, 1), 2.0), ("b", dt.date(1999, 12, 1), 3.0), ("c", dt.date(2000, 6, 1), None)],
        "feature_id string, date date, value double",
    )
    filled = filled_between(df, ONE)
    assert [r["value"] for r in filled.where("feature_id = 'a'").orderBy("date").collect()] == [1.0, None, None, None, 2.0]
    assert filled.where("feature_id = 'c'").count() == 0
    common = on_common_months(df, ONE)
    assert common.groupBy("feature_id").count().select("count").distinct().collect()[0][0] == 7
    assert common.where("value is not null").count() == 3
    assert on_common_months(df.limit(0), ONE).count() == 0


def test_line_skips_nulls(spark):
    out = column(with_line(series(spark, [1.0, np.nan, 3.0, 4.0]), ONE), "line")
    np.testing.assert_allclose(out, [1, 2, 3, 4])
    assert np.isnan(column(with_line(series(spark, [1.0, np.nan, np.nan]), ONE), "line")).all()
