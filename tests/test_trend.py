"""Trend tests against a step-by-step computation."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pytest
from parchline.operators import trend
from parchline.operators.trend import Slopes, average_ranks, inversions, kendall_score, lagged, pair_statistics, plain_trend, trend_statistics
from pyspark.sql import functions as F

ONE = ("feature_id",)


def normal_sf(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def frame(spark, named):
    rows = []
    for fid, values in named.items():
        for i, v in enumerate(values):
            rows.append((fid, dt.date(1950 + i // 12, i % 12 + 1, 1), v))
    return spark.createDataFrame(rows, "feature_id string, date date, value double")


def stepwise(y):
    n = len(y)
    s = sum(np.sign(b - a) for a, b in combinations(y, 2))
    slope = float(np.median([(y[j] - y[i]) / (j - i) for i, j in combinations(range(n), 2)]))
    ties = sum(t * (t - 1) * (2 * t + 5) for t in (list(y).count(v) for v in set(y)))
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    d = [v - slope * (i + 1) for i, v in enumerate(y)]
    r = np.array([sum(x < v for x in d) + (sum(x == v for x in d) + 1) / 2 for v in d])
    c = r - r.mean()
    acc = 0.0
    for k in range(1, n):
        rho = float((c[: n - k] * c[k:]).sum() / (c * c).sum())
        if abs(rho) > 1.959963984540054 / math.sqrt(n):
            acc += (n - k) * (n - k - 1) * (n - k - 2) * rho
    var *= 1 + 2 / (n * (n - 1) * (n - 2)) * acc
    z = 0.0 if s == 0 else (s - np.sign(s)) / math.sqrt(var) if var > 0 else math.nan
    return s / (n * (n - 1) / 2), slope, 1.0 if math.isnan(z) else 2 * normal_sf(abs(z))


def test_against_stepwise(spark):
    rng = np.random.default_rng(5)
    walks = {
        "noise": rng.normal(size=80),
        "rising": rng.normal(size=90) + np.arange(90) * 0.05,
        "ties": rng.integers(0, 4, 70).astype(float),
        "walk": np.cumsum(rng.normal(size=100)),
    }
    got = {r["feature_id"]: r for r in trend_statistics(frame(spark, {k: [float(x) for x in v] for k, v in walks.items()}), ONE).collect()}
    for name, values in walks.items():
        tau, slope, p = stepwise(list(values))
        np.testing.assert_allclose([got[name]["tau"], got[name]["sen_slope"], got[name]["p_value"]], [tau, slope, p], atol=1e-10)
    assert got["rising"]["trend_category"] == "inc" and got["rising"]["trend_symbol"] == "↑"


def test_short_flat_and_empty(spark):
    rows = {"none": [None, None], "one": [1.0], "two": [1.0, 2.0], "flat": [3.0] * 20}
    got = {r["feature_id"]: r for r in trend_statistics(frame(spark, rows), ONE).collect()}
    assert (got["none"]["tau"], got["none"]["p_value"], got["one"]["p_value"]) == (0.0, 1.0, 1.0)
    assert (got["two"]["tau"], got["two"]["sen_slope"], got["two"]["p_value"]) == (1.0, 1.0, 1.0)
    assert (got["flat"]["sen_slope"], got["flat"]["p_value"], got["flat"]["trend"]) == (0.0, 1.0, "no trend")


def test_row_order_does_not_matter(spark):
    df = frame(spark, {"a": [float(x) for x in np.random.default_rng(2).normal(size=60)]})
    a = trend_statistics(df, ONE).collect()
    b = trend_statistics(df.repartition(7, "value").orderBy("value"), ONE).collect()
    assert a == b


def test_plain_variant(spark):
    y = [float(v) for v in np.random.default_rng(9).normal(size=50)]
    got = plain_trend(frame(spark, {"a": y, "b": [1.0]}), ONE).orderBy("feature_id").collect()
    n, s = 50, pair_statistics(np.array(y))[1]
    z = (abs(s) - 1) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    assert abs(got[0]["p_value"] - 2 * normal_sf(z)) < 1e-6
    assert got[1]["tau"] is None and got[1]["trend"] == "—"


def test_average_ranks():
    assert list(average_ranks(np.array([3.0, 1.0, 3.0, 2.0]))) == [3.5, 1.0, 3.5, 2.0]


KINDS = {
    "noise": lambda rng, n: rng.normal(size=n), "ties": lambda rng, n: rng.integers(0, 3, n).astype(float), "steps": lambda rng, n: np.arange(n) * 0.1 + rng.integers(0, 2, n),
    "walk": lambda rng, n: np.cumsum(rng.normal(size=n)), "flat": lambda rng, n: np.full(n, 2.5), "line": lambda rng, n: np.arange(n) / 3.0, "falling": lambda rng, n: -np.sort(rng.random(n)) ** 3,
}


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("n", [2, 3, 5, 61, 300, 900])
def test_selected_slope_and_counted_pairs_match_all_pairs(monkeypatch, kind, n):
    """With few pairs listed at once, the slope is found by counting."""
    y = KINDS[kind](np.random.default_rng(n), n)
    first, second = np.triu_indices(n, k=1)
    rise = y[second] - y[first]
    monkeypatch.setattr(trend, "LISTED_PAIRS", 50)
    assert kendall_score(y, np.unique(y, return_counts=True)[1]) == np.sign(rise).sum()
    np.testing.assert_allclose(Slopes(y).median(), np.median(rise / (second - first)), rtol=1e-12, atol=1e-12)


def test_inversions_are_counted_and_listed():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 64, 100):
        places = rng.permutation(n)
        wanted = sorted((int(a), int(b)) for a, b in combinations(places, 2) if a > b)
        count, larger, smaller = inversions(places, listed=True)
        assert count == len(wanted) == inversions(places)[0]
        assert sorted(zip(larger.tolist(), smaller.tolist(), strict=True)) == wanted


def test_lagged_products_by_transform(monkeypatch):
    centred = np.random.default_rng(3).normal(size=500)
    direct = lagged(centred)
    monkeypatch.setattr(trend, "DIRECT_LAGS", 10)
    np.testing.assert_allclose(lagged(centred), direct, atol=1e-10)


def test_a_series_of_200_000_values(spark):
    """Two millennia of days: far more pairs than could be listed."""
    n = 200_000
    rows = spark.range(n, numPartitions=8).select(
        F.lit("long").alias("feature_id"), F.date_add(F.lit("1500-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (F.col("id") * 0.001 + F.pmod(F.col("id") * 7919, F.lit(1000)) / 10.0).alias("value"),
    )
    found = trend_statistics(rows, ONE).collect()[0]
    assert abs(found["sen_slope"] - 0.001) < 1e-5 and found["tau"] > 0
    plain = plain_trend(rows, ONE).collect()[0]
    assert plain["tau"] == found["tau"] and plain["sen_slope"] == found["sen_slope"]
