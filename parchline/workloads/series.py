"""Checked queries: month spines, standardized index, windows, trend, as-of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import asof, series as S, standardize as Z, trend as T
from ..plans.station_index import StationRun, station_days, station_index
from . import sqltext as Q
from .base import CUTOFF, flow, gauges, obs, query, rnd, rounded, seasonal, targets, wide

ONE = ("feature_id",)
KEYS = ("dataset_key", "feature_id")


def complete(spark, folder):
    return S.on_common_months(flow(spark, folder), ONE)


COMPLETE = Q.common_months("flow", "feature_id")


@query("observed_severity_counts", views="obs", sql=f"""
    WITH {Q.common_months("obs", "feature_id")}, {Q.standardized("complete", "feature_id", 3, 5)},
    shown AS (SELECT date, {Q.severity("idx")} AS level FROM indexed)
    SELECT date, count(level) AS with_value, count(*) FILTER (WHERE level IS NULL) AS missing,
           count(*) FILTER (WHERE level = 'Normal/Wet') AS normal_wet, count(*) FILTER (WHERE level = 'D0') AS d0,
           count(*) FILTER (WHERE level = 'D1') AS d1, count(*) FILTER (WHERE level = 'D2') AS d2,
           count(*) FILTER (WHERE level = 'D3') AS d3, count(*) FILTER (WHERE level = 'D4') AS d4
    FROM shown GROUP BY date""")
def observed_severity_counts(spark, folder):
    """Flagship: order values to a complete monthly series, index, class counts per month."""
    from ..operators.overview import class_counts

    full = S.on_common_months(obs(spark, folder), ONE)
    return class_counts(Z.standardized_index(full, ONE, (3,), minimum_years=5), "spi3", ["date"])


@query("standardized_index", views="flow", sql=f"""
    WITH {COMPLETE}, {Q.standardized("complete", "feature_id", 3, 5)}
    SELECT feature_id, date, {rnd("idx")} AS spi3 FROM indexed""")
def standardized_index(spark, folder):
    out = Z.standardized_index(complete(spark, folder), ONE, (3,), minimum_years=5)
    return rounded(out.select(*ONE, "date", "spi3"), "spi3")


@query("standardized_index_reference", views="flow", sql=f"""
    WITH {COMPLETE}, {Q.standardized("complete", "feature_id", 6, 4, "date BETWEEN DATE '1996-01-01' AND DATE '2000-12-01'")}
    SELECT feature_id, date, {rnd("idx")} AS spi6 FROM indexed""")
def standardized_index_reference(spark, folder):
    out = Z.standardized_index(complete(spark, folder), ONE, (6,), "1996-01-15", "2000-12-31", 4)
    return rounded(out.select(*ONE, "date", "spi6"), "spi6")


@query("standardized_index_scales", views="flow", sql=f"""
    WITH {COMPLETE}, a AS (WITH {Q.standardized("complete", "feature_id", 1, 5)} SELECT * FROM indexed),
    b AS (WITH {Q.standardized("complete", "feature_id", 12, 5)} SELECT * FROM indexed)
    SELECT feature_id, date, {rnd("a.idx")} AS spi1, {rnd("b.idx")} AS spi12 FROM a JOIN b USING (feature_id, date)""")
def standardized_index_scales(spark, folder):
    out = Z.standardized_index(complete(spark, folder), ONE, (1, 12), minimum_years=5)
    return rounded(out.select(*ONE, "date", "spi1", "spi12"), "spi1", "spi12")


POSITIONAL = """
    placed AS (
        SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY {keys}) AS n,
               bool_or(value IS NULL OR value < 0) OVER (PARTITION BY {keys}) AS bad,
               CASE WHEN count(value) OVER f = {scale} THEN sum(value) OVER f END AS total
        FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY date),
             f AS (PARTITION BY {keys} ORDER BY date ROWS BETWEEN {before} PRECEDING AND CURRENT ROW)),
    slots AS (
        SELECT *, (count(*) OVER (PARTITION BY {keys}, r >= {scale}, (r - {scale} + 24) % 12 ORDER BY total
                   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 0.44::DOUBLE)
                  / (count(*) OVER (PARTITION BY {keys}, r >= {scale}, (r - {scale} + 24) % 12) + 0.12::DOUBLE) AS p0
        FROM placed),
    scored AS (SELECT *, CASE WHEN r >= {scale} AND NOT bad THEN p0 END AS p FROM slots)"""


@query("index_by_position", views="flow", sql=f"""
    WITH {COMPLETE}, {POSITIONAL.format(keys="feature_id", scale=6, before=5, source="complete")}
    SELECT feature_id, date, CASE WHEN bad THEN CASE WHEN r < n THEN 0.0::DOUBLE END
           ELSE {rnd(Q.normal_quantile("p"))} END AS idx FROM scored""")
def index_by_position(spark, folder):
    out = Z.standardized_by_position(complete(spark, folder), ONE, 6, name="idx")
    return rounded(out.select(*ONE, "date", "idx"), "idx")


@query("index_cube", views="grid", sql=f"""
    WITH cells AS (SELECT lat_idx, lon_idx, CAST(date_trunc('month', ts) AS DATE) AS date, sum(value) AS value FROM grid GROUP BY 1, 2, 3),
    {Q.common_months("cells", "lat_idx, lon_idx")},
    {POSITIONAL.format(keys="lat_idx, lon_idx", scale=3, before=2, source="complete")}
    SELECT lat_idx, lon_idx, date, {rnd(Q.normal_quantile("p"))} AS idx FROM scored""")
def index_cube(spark, folder):
    from ..operators.zonal import monthly_cells
    from .base import grid

    cell = ("lat_idx", "lon_idx")
    cube = S.on_common_months(monthly_cells(grid(spark, folder)), cell)
    return rounded(Z.standardized_cube(cube, cell, 3, name="idx").select(*cell, "date", "idx"), "idx")


@query("rolling_total", views="flow", sql=f"""
    WITH {COMPLETE}
    SELECT feature_id, date, CASE WHEN count(value) OVER w = 3 THEN sum(value) OVER w END AS total FROM complete
    WINDOW w AS (PARTITION BY feature_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_total(spark, folder):
    return complete(spark, folder).select(*ONE, "date", Z.rolling_total(ONE, 3).alias("total"))


MODES = """
    counted AS (SELECT feature_id, month(date) AS m, count(value) FILTER (WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-01') AS n
                FROM complete GROUP BY 1, 2),
    modes AS (SELECT feature_id, CASE WHEN min(n) >= 5 AND count(*) = 12 THEN 'configured' ELSE 'fallback_available' END AS reference_mode
              FROM counted GROUP BY 1)"""


@query("reference_mode", views="flow", sql=f"""
    WITH {COMPLETE}, {MODES} SELECT feature_id, reference_mode FROM modes""")
def reference_mode(spark, folder):
    moded = Z.with_reference_mode(complete(spark, folder), ONE, "1996-01-01", "2000-12-31", 5)
    return moded.select(*ONE, "reference_mode").distinct()


@query("station_index", views="gauges", sql=f"""
    WITH days AS (SELECT * FROM gauges QUALIFY row_number() OVER (PARTITION BY station_id, date ORDER BY seq DESC) = 1),
    flow AS (SELECT station_id AS feature_id, CAST(date_trunc('month', date) AS DATE) AS date,
                    CASE WHEN count(precip_mm) / day(last_day(min(date))) >= 0.1::DOUBLE THEN sum(precip_mm) END AS value
             FROM days GROUP BY 1, 2), {COMPLETE}, {MODES},
    moded AS (SELECT * FROM complete JOIN modes USING (feature_id)),
    {Q.standardized("moded", "feature_id", 3, 5, "reference_mode = 'fallback_available' OR date BETWEEN DATE '1996-01-01' AND DATE '2000-12-01'")}
    SELECT feature_id, date, round(CAST(CAST(idx AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS spi3, CAST(value AS DOUBLE) AS precip, reference_mode FROM indexed""")
def station_index_query(spark, folder):
    """Daily station rows to an index: dedupe, months, coverage, spine, reference choice, index."""
    run = StationRun("gauges_spi3", "Gauges", (3,), "1996-01-01", "2000-12-31", 5, 0.1)
    out = station_index(station_days(gauges(spark, folder), ("precip_mm",)), run)
    typed = out.withColumns({"spi3": F.col("spi3").cast("double"), "precip": F.col("precip").cast("double")})
    return rounded(typed, "spi3", digits=5)


# -- spines and bounds ---------------------------------------------------------


@query("common_months", views="flow", sql=f"WITH {COMPLETE} SELECT * FROM complete")
def common_months(spark, folder):
    return complete(spark, folder)


@query("densified_series", views="wide", sql="""
    WITH known AS (SELECT * FROM wide WHERE spi3 IS NOT NULL),
    spine AS (SELECT dataset_key, feature_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date
              FROM known GROUP BY 1, 2)
    SELECT dataset_key, feature_id, date, """ + rnd("spi3") + """ AS spi3 FROM spine LEFT JOIN known USING (dataset_key, feature_id, date)""")
def densified_series(spark, folder):
    return rounded(S.filled_between(wide(spark, folder).drop("precip"), KEYS, "spi3"), "spi3")


@query("value_bounds", views="wide", sql="""
    SELECT dataset_key, feature_id, min(date) AS min_date, max(date) AS max_date FROM wide WHERE spi3 IS NOT NULL GROUP BY 1, 2""")
def value_bounds(spark, folder):
    return S.value_bounds(wide(spark, folder), KEYS, "spi3")


@query("series_between", views="wide", sql="""
    SELECT dataset_key, feature_id, date, """ + rnd("spi3") + """ AS spi3 FROM wide
    WHERE spi3 IS NOT NULL AND date BETWEEN DATE '1997-03-01' AND DATE '1999-02-01'""")
def series_between(spark, folder):
    rows = S.between_months(wide(spark, folder).drop("precip"), C.require_month("1997-03"), C.require_month("1999-02"), "spi3")
    return rounded(rows, "spi3")


@query("series_tail", views="wide", sql="""
    SELECT dataset_key, feature_id, date, precip FROM wide
    QUALIFY row_number() OVER (PARTITION BY dataset_key, feature_id ORDER BY date DESC) <= 18""")
def series_tail(spark, folder):
    return S.tail(wide(spark, folder).drop("spi3"), KEYS, 18)


@query("series_summary", views="wide", sql="""
    SELECT dataset_key, feature_id, count(*) AS point_count, count(spi3) AS value_count, """ + ", ".join(
        f"{rnd(e)} AS {n}" for e, n in (("min(spi3)", "min"), ("max(spi3)", "max"), ("avg(spi3)", "mean"), ("arg_max(spi3, date) FILTER (WHERE spi3 IS NOT NULL)", "latest"))
    ) + " FROM wide GROUP BY 1, 2")
def series_summary(spark, folder):
    return rounded(S.summary(wide(spark, folder), KEYS, "spi3"), "min", "max", "mean", "latest")


@query("compact_series", views="flow", sql="""
    SELECT feature_id, date, value, count(*) OVER e AS point_count, count(value) OVER e AS value_count,
           min(value) OVER e AS min, max(value) OVER e AS max, """ + rnd("avg(value) OVER e") + """ AS mean,
           last_value(value) OVER (PARTITION BY feature_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest,
           least(count(*) OVER e, 60) AS included_point_count
    FROM flow WINDOW e AS (PARTITION BY feature_id)
    QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY date DESC) <= 60""")
def compact_series(spark, folder):
    return rounded(S.compacted(flow(spark, folder), ONE, 60), "mean")


@query("trend_line", views="wide", sql="""
    WITH placed AS (SELECT *, row_number() OVER (PARTITION BY dataset_key, feature_id ORDER BY date) - 1 AS x FROM wide),
    fit AS (SELECT dataset_key, feature_id, regr_slope(spi3, x) AS b, regr_intercept(spi3, x) AS a, count(spi3) AS n FROM placed GROUP BY 1, 2)
    SELECT dataset_key, feature_id, date, CASE WHEN n >= 2 THEN """ + rnd("a + b * x") + """ END AS line FROM placed JOIN fit USING (dataset_key, feature_id)""")
def trend_line(spark, folder):
    return rounded(S.with_line(wide(spark, folder).drop("precip"), KEYS, "spi3").drop("spi3"), "line")


@query("last_five_years", views="flow", sql="""
    SELECT * FROM flow QUALIFY date >= max(date) OVER (PARTITION BY feature_id) - INTERVAL 60 MONTH""")
def last_five_years(spark, folder):
    return S.last_years(flow(spark, folder), ONE)


@query("neighbour_months", views="flow", sql="""
    SELECT c.feature_id, c.date, c.value, p.value AS previous, n.value AS following FROM flow c
    LEFT JOIN flow p ON p.feature_id = c.feature_id AND p.date = c.date - INTERVAL 1 MONTH
    LEFT JOIN flow n ON n.feature_id = c.feature_id AND n.date = c.date + INTERVAL 1 MONTH""")
def neighbour_months(spark, folder):
    return S.with_neighbours(flow(spark, folder), ONE)


@query("observed_and_forecast_months", views="targets seasonal", sql="""
    SELECT dataset_key, feature_id, date FROM targets UNION SELECT dataset_key, feature_id, target_date FROM seasonal""")
def observed_and_forecast_months(spark, folder):
    return S.timeline(targets(spark, folder), seasonal(spark, folder), KEYS)


@query("panel_range", views="targets seasonal", sql="""
    WITH o AS (SELECT dataset_key, feature_id, min(date) AS lo, max(date) AS hi FROM targets WHERE (month(date) + length(feature_id)) % 4 <> 0 GROUP BY 1, 2),
    f AS (SELECT dataset_key, feature_id, max(target_date) AS hi FROM seasonal GROUP BY 1, 2)
    SELECT dataset_key, feature_id, o.lo AS min_date, greatest(o.hi, coalesce(f.hi, o.hi)) AS max_date FROM o LEFT JOIN f USING (dataset_key, feature_id)""")
def panel_range(spark, folder):
    """Months without a value in every series, every fourth by its name's length."""
    seen = targets(spark, folder).withColumn("y", F.when((F.month("date") + F.length("feature_id")) % 4 != 0, F.col("y")))
    return S.panel_range(seen, seasonal(spark, folder), KEYS, "y")


@query("wide_to_long", views="wide", sql="""
    SELECT feature_id, date, 'spi3' AS index_name, """ + rnd("spi3") + """ AS value FROM wide WHERE spi3 IS NOT NULL
    UNION ALL SELECT feature_id, date, 'precip', """ + rnd("precip") + """ FROM wide WHERE precip IS NOT NULL""")
def wide_to_long(spark, folder):
    return rounded(S.to_long(wide(spark, folder).drop("dataset_key"), ["feature_id", "date"]), "value")


# -- trend ---------------------------------------------------------------------

PAIRS = """
    placed AS (SELECT feature_id, value, row_number() OVER (PARTITION BY feature_id ORDER BY date) AS i,
                      count(*) OVER (PARTITION BY feature_id) AS n FROM flow WHERE value IS NOT NULL),
    pairs AS (SELECT feature_id, count(*) AS c, sum(sign(b.value - a.value)) AS s, median((b.value - a.value) / (b.i - a.i)) AS slope
              FROM placed a JOIN placed b USING (feature_id) WHERE a.i < b.i GROUP BY 1)"""


@query("trend_statistics", views="flow", sql=f"""
    WITH {PAIRS},
    ties AS (SELECT feature_id, n, sum(t * (t - 1) * (2 * t + 5)) AS tied
             FROM (SELECT feature_id, n, value, count(*) AS t FROM placed GROUP BY 1, 2, 3) GROUP BY 1, 2),
    level AS (SELECT p.feature_id, p.i, p.n, p.value - q.slope * p.i AS d FROM placed p JOIN pairs q USING (feature_id)),
    ranks AS (SELECT *, rank() OVER (PARTITION BY feature_id ORDER BY d) + (count(*) OVER (PARTITION BY feature_id, d) - 1) / 2 AS r FROM level),
    centred AS (SELECT *, r - avg(r) OVER (PARTITION BY feature_id) AS y FROM ranks),
    power AS (SELECT feature_id, sum(y * y) AS p0 FROM centred GROUP BY 1),
    lags AS (SELECT a.feature_id, a.n, b.i - a.i AS k, sum(a.y * b.y) AS c FROM centred a JOIN centred b ON a.feature_id = b.feature_id AND b.i > a.i GROUP BY 1, 2, 3),
    strong AS (SELECT feature_id, sum((n - k) * (n - k - 1) * (n - k - 2) * c / p0) AS w FROM lags JOIN power USING (feature_id)
               WHERE abs(c / p0) > 1.959963984540054 / sqrt(n) GROUP BY 1),
    tested AS (SELECT t.feature_id, q.s / q.c AS tau, q.slope, q.s,
                      (n * (n - 1) * (2 * n + 5) - tied) / 18 * (1 + 2 / (n * (n - 1) * (n - 2)) * coalesce(w, 0)) AS v
               FROM ties t JOIN pairs q USING (feature_id) LEFT JOIN strong USING (feature_id)),
    scored AS (SELECT *, CASE WHEN s = 0 THEN 0 WHEN v > 0 THEN (s - sign(s)) / sqrt(v) END AS z FROM tested),
    finished AS (SELECT *, coalesce({Q.two_sided_p("z")}, 1) AS p FROM scored)
    SELECT feature_id, {rnd("tau")} AS tau, {rnd("slope")} AS sen_slope, {rnd("p")} AS p_value,
           CASE WHEN abs(z) > 1.959963984540054 THEN CASE WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'no trend' END AS trend,
           CASE WHEN p > 5e-2 OR slope = 0 THEN 'none' WHEN slope > 0 THEN 'inc' ELSE 'dec' END AS trend_category FROM finished""")
def trend_statistics(spark, folder):
    out = T.trend_statistics(flow(spark, folder), ONE)
    return rounded(out.select(*ONE, "tau", "sen_slope", "p_value", "trend", "trend_category"), "tau", "sen_slope", "p_value")


@query("plain_trend", views="flow", sql=f"""
    WITH {PAIRS},
    tested AS (SELECT DISTINCT feature_id, s / c AS tau, slope, abs(CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18) END) / sqrt(2) AS x
               FROM pairs JOIN placed USING (feature_id)),
    stepped AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM tested)
    SELECT feature_id, {rnd("tau")} AS tau, {rnd("slope")} AS sen_slope,
           {rnd("2 * (1 - (1 + (1 - " + Q.polynomial("t", Q.N.ERF_SERIES) + " * t * exp(-x * x))) / 2)")} AS p_value,
           CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS trend FROM stepped""")
def plain_trend(spark, folder):
    return rounded(T.plain_trend(flow(spark, folder), ONE), "tau", "sen_slope", "p_value")


# -- as-of -----------------------------------------------------------------------


def _requests(spark, folder):
    """Every supplier asked for the month of each of its orders' dates, many times over."""
    from .base import table

    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    dates = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return rows.join(dates, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").cast("string").alias("feature_id"), F.to_date("o_orderdate").alias("requested")
    )


ASKED = """
    asked AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS feature_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS requested
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    dry AS (SELECT feature_id, date, value FROM flow WHERE value < 100 AND (month(date) + length(feature_id)) % 3 <> 1),
    around AS (SELECT a.feature_id, requested, max(date) FILTER (WHERE date <= requested) AS b, min(date) FILTER (WHERE date >= requested) AS n
               FROM asked a LEFT JOIN dry USING (feature_id) GROUP BY 1, 2)"""


def _dry(spark, folder):
    """All months; those of much water and a third of the others have no value."""
    good = (F.col("value") < 100) & ((F.month("date") + F.length("feature_id")) % 3 != 1)
    return flow(spark, folder).withColumn("value", F.when(good, F.col("value")))


@query("effective_month", views="flow", sql=f"""
    WITH {ASKED}
    SELECT r.feature_id, r.requested, coalesce(b, n, requested) AS effective, dry.value,
           CASE WHEN b IS NULL AND n IS NULL THEN 'no-data' WHEN b IS NULL THEN 'clamped-to-start' WHEN b = requested THEN NULL
                WHEN n IS NULL THEN 'clamped-to-end' ELSE 'nearest-previous' END AS note
    FROM around r LEFT JOIN dry ON dry.feature_id = r.feature_id AND dry.date = coalesce(b, n)""")
def effective_month(spark, folder):
    return asof.effective_month(_dry(spark, folder), _requests(spark, folder), ONE)


@query("nearest_month", views="flow", sql=f"""
    WITH {ASKED}
    SELECT feature_id, requested, CASE WHEN b IS NULL AND n IS NULL THEN requested WHEN n IS NULL THEN b WHEN b IS NULL THEN n
           WHEN date_diff('month', b, requested) <= date_diff('month', requested, n) THEN b ELSE n END AS nearest FROM around""")
def nearest_month(spark, folder):
    return asof.nearest_month(_dry(spark, folder), _requests(spark, folder), ONE)
