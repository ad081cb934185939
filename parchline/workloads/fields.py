"""Checked queries: daily stations, grids, polygons and predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import cell_area_m2
from ..operators import predictors as R, station as D, zonal as G
from ..plans import polygon_index as L
from ..plans.station_index import StationRun, layer_metadata, station_counters, station_days, station_features, station_index, write_layer
from ..session import scratch_path
from ..sources.store import TableStore
from . import sqltext as Q
from .base import FIRST_MONTH, boxes, daily, gauges, grid, query, rnd, rounded, table

# The grid of the driver's shipments: 10 rows from 40.25 N down, 20 columns from 49.75 E.
SPEC = G.GridSpec(40.25, 49.75, 0.5, 0.5, 10, 20)
R2 = "6371008.8::DOUBLE * 6371008.8::DOUBLE"


# -- stations ----------------------------------------------------------------------


@query("valid_station_rows", views="clean_days", sql="SELECT * FROM clean_days")
def valid_station_rows(spark, folder):
    return D.clean_observations(daily(spark, folder))


@query("latest_per_day", views="days", sql="SELECT station_id, date, precip_mm, seq FROM days")
def latest_per_day(spark, folder):
    return D.latest_per_day(D.clean_observations(daily(spark, folder))).select("station_id", "date", "precip_mm", "seq")


@query("station_profiles", views="days", sql="""
    SELECT station_id, arg_max(station_name, seq) AS station_name, arg_max(lon, seq) AS lon, arg_max(lat, seq) AS lat,
           arg_max(station_elevation, seq) FILTER (WHERE station_elevation IS NOT NULL) AS station_elevation, min(date) AS min_input_date, max(date) AS max_input_date,
           count(*) AS daily_rows, count(precip_mm) AS valid_daily_precip FROM days GROUP BY 1""")
def station_profiles(spark, folder):
    return D.station_profiles(D.latest_per_day(D.clean_observations(daily(spark, folder))))


@query("monthly_precipitation", views="days", sql=f"""
    SELECT station_id, CAST(date_trunc('month', date) AS DATE) AS date, count(precip_mm) AS valid_days, count(*) AS observed_days,
           CAST(day(last_day(min(date))) AS INTEGER) AS expected_days, {rnd("count(precip_mm) / day(last_day(min(date)))")} AS coverage_ratio,
           CASE WHEN count(precip_mm) / day(last_day(min(date))) >= 0.6::DOUBLE THEN {rnd("sum(precip_mm)")} END AS precip FROM days GROUP BY 1, 2""")
def monthly_precipitation(spark, folder):
    days = D.latest_per_day(D.clean_observations(daily(spark, folder)))
    return rounded(D.monthly_precipitation(days, 0.6), "coverage_ratio", "precip").withColumn(
        "expected_days", F.col("expected_days").cast("int")
    )


GAUGE_RUN = StationRun("gauges_spi3", "Gauges SPI-3", (3,), "1996-01-01", "2000-12-31", 5, 0.1)


@query("run_counters", views="gauges", sql="""
    WITH per_day AS (SELECT station_id, date, count(*) AS n, arg_max(precip_mm, seq) FILTER (WHERE TRUE) AS any_value,
                            count(*) FILTER (WHERE TRUE) AS c FROM gauges GROUP BY 1, 2),
    days AS (SELECT * FROM gauges QUALIFY row_number() OVER (PARTITION BY station_id, date ORDER BY seq DESC) = 1),
    months AS (SELECT station_id, date_trunc('month', date)::DATE AS m, CASE WHEN count(precip_mm) / day(last_day(min(date))) >= 0.1::DOUBLE THEN sum(precip_mm) END AS v FROM days GROUP BY 1, 2),
    ok AS (SELECT station_id, count(*) FILTER (WHERE n >= 5) AS good FROM
           (SELECT station_id, month(m) AS c, count(v) FILTER (WHERE m BETWEEN DATE '1996-01-01' AND DATE '2000-12-01') AS n FROM months GROUP BY 1, 2) GROUP BY 1)
    SELECT (SELECT sum(n - 1)::BIGINT FROM per_day) AS duplicate_rows, (SELECT count(*) FROM months WHERE v IS NULL) AS coverage_failures,
           count(*) AS feature_count, count(*) FILTER (WHERE good < 12) AS fallback_count, 0::BIGINT AS insufficient_count FROM ok""")
def run_counters(spark, folder):
    days = station_days(gauges(spark, folder), ("precip_mm",), shared=True)
    return station_counters(days, station_index(days, GAUGE_RUN), GAUGE_RUN)


@query("station_layer_written", views="gauges", sql="""
    SELECT 'gauges_spi3' AS dataset_key, 3 AS scale, ['spi3', 'precip'] AS available_indices, strftime(min(date), '%Y-%m') AS min_month,
           strftime(max(date), '%Y-%m') AS max_month, count(DISTINCT station_id) AS feature_count,
           count(DISTINCT station_id) * (date_diff('month', date_trunc('month', min(date)), date_trunc('month', max(date))) + 1) AS data_rows FROM gauges""")
def station_layer_written(spark, folder):
    """Write a station layer and read its metadata back, with the number of data rows."""
    days = station_days(gauges(spark, folder), shared=True)
    data = station_index(days, GAUGE_RUN)
    places = station_features(days, data, GAUGE_RUN)
    facts = {"dataset_key": GAUGE_RUN.dataset_key, "scale": 3, "available_indices": ["spi3", "precip"]}
    target = scratch_path(spark, "layer")
    write_layer(target, data.drop("reference_mode"), places, layer_metadata(data, places, facts))
    stored = spark.read.parquet(f"{target}/data.parquet").select(F.count("*")).scalar()
    schema = "dataset_key string, scale int, available_indices array<string>, min_month string, max_month string, feature_count bigint"
    return spark.read.schema(schema).json(f"{target}/metadata.json").select("*", stored.alias("data_rows"))


# -- grids ---------------------------------------------------------------------------


@query("monthly_cells", views="grid", sql="""
    SELECT lat_idx, lon_idx, CAST(date_trunc('month', ts) AS DATE) AS date, sum(value) AS value FROM grid GROUP BY 1, 2, 3""")
def monthly_cells(spark, folder):
    return G.monthly_cells(grid(spark, folder))


@query("month_completeness", sql="""
    WITH s AS (SELECT DISTINCT l_shipdate + to_hours(CAST(l_linenumber % 2 * (l_suppkey % 40 = 7)::INT AS INTEGER)) AS ts FROM lineitem),
    d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM s GROUP BY 1)
    SELECT CAST(date_trunc('month', day) AS DATE) AS date, CAST(sum(n) AS BIGINT) AS slices, count(*) AS days, sum(n) <> count(*) AS has_duplicates,
           count(*) = day(last_day(min(day))) AS complete FROM d GROUP BY 1""")
def month_completeness(spark, folder):
    shifted = F.expr("l_shipdate + make_dt_interval(0, if(l_suppkey % 40 = 7, l_linenumber % 2, 0))")
    return G.month_completeness(table(spark, folder, "lineitem").select(shifted.alias("ts")))


@query("complete_months", sql="""
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem GROUP BY 1, last_day(l_shipdate) HAVING count(DISTINCT l_shipdate) = day(last_day(l_shipdate))""")
def complete_months(spark, folder):
    return G.complete_months(grid(spark, folder))


@query("grid_extent", views="grid", sql=f"""
    WITH lats AS (SELECT median(d) AS dy, min(lat) AS lo, max(lat) AS hi, count(*) AS n FROM (SELECT lat, lead(lat) OVER (ORDER BY lat) - lat AS d FROM (SELECT DISTINCT lat FROM grid))),
    lons AS (SELECT median(d) AS dx, min(lon) AS lo, max(lon) AS hi, count(*) AS n FROM (SELECT lon, lead(lon) OVER (ORDER BY lon) - lon AS d FROM (SELECT DISTINCT lon FROM grid)))
    SELECT x.lo - dx / 2 AS minx, y.lo - dy / 2 AS miny, x.hi + dx / 2 AS maxx, y.hi + dy / 2 AS maxy, dy AS dlat, dx AS dlon, CAST(y.n AS INTEGER) AS rows, CAST(x.n AS INTEGER) AS cols FROM lats y, lons x""")
def grid_extent(spark, folder):
    return G.grid_extent(grid(spark, folder))


@query("cell_area", views="grid", sql=f"""
    SELECT DISTINCT lat, round(radians(5e-1) * abs(sin(least(pi() / 2, radians(lat) + radians(5e-1) / 2)) - sin(radians(lat) - radians(5e-1) / 2)) * {R2} / 1e6, 4) AS km2 FROM grid""")
def cell_area(spark, folder):
    area = cell_area_m2(F.col("lat"), F.lit(0.5), F.lit(0.5)) / 1e6
    return grid(spark, folder).select("lat", F.round(area, 4).alias("km2")).distinct()


BOX_CELLS = f"""
    cells AS (SELECT feature_id, r * 20 + c AS cell_id, r,
                     greatest(0, least(maxy, 4025e-2 - r * 5e-1) - greatest(miny, 4025e-2 - (r + 1) * 5e-1)) * greatest(0, least(maxx, 4975e-2 + (c + 1) * 5e-1) - greatest(minx, 4975e-2 + c * 5e-1)) / 25e-2 AS coverage
              FROM boxes, range(0, 10) a(r), range(0, 20) b(c)),
    weights AS (SELECT feature_id, cell_id, coverage, coverage * radians(5e-1) * (sin(radians(4025e-2 - r * 5e-1)) - sin(radians(4025e-2 - (r + 1) * 5e-1))) * {R2} AS weight
                FROM cells WHERE coverage > 1e-9)"""


@query("box_cell_weights", views="boxes", sql=f"""
    WITH {BOX_CELLS} SELECT feature_id, CAST(cell_id AS BIGINT) AS cell_id, {rnd("coverage")} AS coverage, round(weight / 1e6, 3) AS km2 FROM weights""")
def box_cell_weights(spark, folder):
    weights = G.box_weights(boxes(spark, folder), SPEC).where(F.col("coverage") > 1e-9)
    return rounded(weights, "coverage").select("feature_id", "cell_id", "coverage", F.round(F.col("weight") / 1e6, 3).alias("km2"))


def _polygons(spark, folder, with_holes: bool = False):
    """The boxes as polygons of one ring, or as diamonds with a diamond hole."""
    def point(x, y):
        return F.array(x, y)

    x1, y1, x2, y2 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    if not with_holes:
        ring = F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1))
        return boxes(spark, folder).select("feature_id", F.array(F.array(ring)).alias("polygons"), "minx", "miny", "maxx", "maxy")
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2

    def diamond(share: float):
        dx, dy = (x2 - mx) * share, (y2 - my) * share
        return F.array(point(mx, my - dy), point(mx + dx, my), point(mx, my + dy), point(mx - dx, my), point(mx, my - dy))

    return boxes(spark, folder).select("feature_id", F.array(F.array(diamond(1.0), diamond(0.5))).alias("polygons"), "minx", "miny", "maxx", "maxy")


@query("polygon_cell_weights", views="boxes", sql=f"""
    WITH {BOX_CELLS} SELECT feature_id, CAST(cell_id AS BIGINT) AS cell_id, {rnd("coverage")} AS coverage FROM weights""")
def polygon_cell_weights(spark, folder):
    """The general polygon path on boxes, where SQL can check it."""
    weights = G.polygon_weights(_polygons(spark, folder), SPEC).where(F.col("coverage") > 1e-9)
    return rounded(weights.select("feature_id", "cell_id", "coverage"), "coverage")


@query("polygon_hole_area", views="boxes", sql=f"""
    SELECT feature_id, round((maxx - minx) * (maxy - miny) / 2 * 75e-2, 6) AS area FROM boxes""")
def polygon_hole_area(spark, folder):
    """Planar area of diamonds with diamond holes, summed over the cells of a world grid."""
    world = G.GridSpec(90.0, -180.0, 0.5, 0.5, 360, 720)
    return G.polygon_weights(_polygons(spark, folder, True), world).groupBy("feature_id").agg(F.round(F.sum("coverage") * 0.25, 6).alias("area"))


ZONAL = f"""{BOX_CELLS},
    monthly AS (SELECT lat_idx * 20 + lon_idx AS cell_id, CAST(date_trunc('month', ts) AS DATE) AS date, sum(value) AS value FROM grid GROUP BY 1, 2)"""


def _cells(spark, folder):
    return G.monthly_cells(grid(spark, folder)).select(SPEC.cell_id(F.col("lat_idx"), F.col("lon_idx")).alias("cell_id"), "date", "value")


@query("zonal_mean", views="boxes grid", sql=f"""
    WITH {ZONAL}
    SELECT feature_id, date, {rnd("sum(weight * value) / sum(weight) FILTER (WHERE value IS NOT NULL)")} AS value FROM weights JOIN monthly USING (cell_id) GROUP BY 1, 2""")
def zonal_mean(spark, folder):
    weights = G.box_weights(boxes(spark, folder), SPEC)
    return rounded(G.zonal_mean(weights, _cells(spark, folder)), "value")


AREA = f"radians(maxx - minx) * (sin(radians(maxy)) - sin(radians(miny))) * {R2}"
COVERED = f"""{BOX_CELLS},
    shares AS (SELECT b.feature_id, greatest(0, least(1, coalesce(sum(weight), 0) / any_value({AREA}))) AS spatial_coverage FROM boxes b LEFT JOIN weights w ON w.feature_id = b.feature_id GROUP BY 1)"""


@query("coverage_eligibility", views="boxes", sql=f"""
    WITH {COVERED} SELECT feature_id, {rnd("spatial_coverage")} AS spatial_coverage, spatial_coverage >= 8e-1 AS kept FROM shares""")
def coverage_eligibility(spark, folder):
    places = boxes(spark, folder)
    areas = places.select("feature_id", G.box_area(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]).alias("area"))
    shares = G.spatial_coverage(G.box_weights(places, SPEC), areas)
    kept = G.eligible_features(shares, 0.8).select("feature_id", F.lit(True).alias("kept"))
    return rounded(shares.join(kept, "feature_id", "left").fillna({"kept": False}), "spatial_coverage")


@query("weight_normalization", views="boxes", sql=f"""
    WITH {BOX_CELLS} SELECT feature_id, CAST(cell_id AS BIGINT) AS cell_id, {rnd("weight / sum(weight) OVER (PARTITION BY feature_id)")} AS weight FROM weights""")
def weight_normalization(spark, folder):
    weights = G.box_weights(boxes(spark, folder), SPEC).where(F.col("coverage") > 1e-9)
    return rounded(G.normalized_weights(weights).drop("coverage"), "weight")


@query("polygon_index", views="boxes grid", sql=f"""
    WITH {COVERED},
    monthly AS (SELECT lat_idx * 20 + lon_idx AS cell_id, CAST(date_trunc('month', ts) AS DATE) AS date, sum(value) AS value FROM grid GROUP BY 1, 2),
    flow AS (SELECT feature_id, date, CAST(CAST(sum(weight * value) / sum(weight) FILTER (WHERE value IS NOT NULL) AS FLOAT) AS DOUBLE) AS value
             FROM weights JOIN monthly USING (cell_id) WHERE feature_id IN (SELECT feature_id FROM shares WHERE spatial_coverage >= 8e-1) GROUP BY 1, 2),
    {Q.common_months("flow", "feature_id")}, {Q.standardized("complete", "feature_id", 3, 5)}
    SELECT 'boxes' AS layer_key, feature_id, date, {rnd("value")} AS value, round(CAST(CAST(idx AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS spi3 FROM indexed""")
def polygon_index(spark, folder):
    """Grid and polygons to an index layer: weights, coverage filter, zonal means, index."""
    layer = _polygons(spark, folder).withColumn("layer_key", F.lit("boxes"))
    weights, _, _ = L.layer_weights(layer, SPEC, 0.8)
    zonal = L.monthly_zonal(grid(spark, folder), weights, SPEC, daily=False)
    out = L.polygon_index(zonal, (3,), minimum_years=5)
    return rounded(rounded(out.withColumn("spi3", F.col("spi3").cast("double")), "spi3", digits=5), "value")


@query("daily_zonal_mean", views="boxes grid", sql=f"""
    WITH {COVERED},
    whole AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS date FROM grid GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) = day(last_day(min(CAST(ts AS DATE))))),
    monthly AS (SELECT lat_idx * 20 + lon_idx AS cell_id, CAST(date_trunc('month', ts) AS DATE) AS date, sum(value) AS value FROM grid GROUP BY 1, 2)
    SELECT 'boxes' AS layer_key, feature_id, date, {rnd("CAST(CAST(sum(weight * value) / sum(weight) FILTER (WHERE value IS NOT NULL) AS FLOAT) AS DOUBLE)")} AS value
    FROM weights JOIN monthly USING (cell_id) WHERE feature_id IN (SELECT feature_id FROM shares WHERE spatial_coverage >= 8e-1) AND date IN (SELECT date FROM whole) GROUP BY 1, 2, 3""")
def daily_zonal_mean(spark, folder):
    """A grid of daily slices through the polygon plan: only months with every day have values."""
    layer = _polygons(spark, folder).withColumn("layer_key", F.lit("boxes"))
    weights, _, _ = L.layer_weights(layer, SPEC, 0.8)
    return rounded(L.monthly_zonal(grid(spark, folder), weights, SPEC, daily=True), "value")


@query("polygon_layers_written", views="boxes grid", sql=f"""
    WITH {COVERED},
    monthly AS (SELECT lat_idx * 20 + lon_idx AS cell_id, CAST(date_trunc('month', ts) AS DATE) AS date, sum(value) AS value FROM grid GROUP BY 1, 2),
    flow AS (SELECT feature_id, date, sum(weight * value) / sum(weight) FILTER (WHERE value IS NOT NULL) AS value
             FROM weights JOIN monthly USING (cell_id) WHERE feature_id IN (SELECT feature_id FROM shares WHERE spatial_coverage >= 8e-1) GROUP BY 1, 2),
    {Q.common_months("flow", "feature_id")},
    gaps AS (SELECT count(*) AS n FROM (SELECT date FROM complete GROUP BY date HAVING count(value) = 0))
    SELECT 'rain_boxes_spi' || s AS dataset_key, 'rain' AS source_key, 'boxes' AS boundary_key, CAST(s AS INTEGER) AS scale, strftime(min(date), '%Y-%m') AS min_month,
           strftime(max(date), '%Y-%m') AS max_month, count(DISTINCT feature_id) AS feature_count, (SELECT count(*) FROM shares WHERE spatial_coverage < 8e-1) AS excluded_feature_count,
           (SELECT n FROM gaps) AS incomplete, count(*) AS data_rows, count(DISTINCT feature_id) AS features FROM complete, (SELECT unnest([3, 6]) AS s) GROUP BY s""")
def polygon_layers_written(spark, folder):
    """Layers of two scales written and read back: records, series rows and features."""
    places = _polygons(spark, folder).withColumn("layer_key", F.lit("boxes"))
    weights, _, left_out = L.layer_weights(places, SPEC, 0.8)
    zonal = L.monthly_zonal(grid(spark, folder), weights, SPEC, daily=False)
    store = TableStore(spark, scratch_path(spark, "layers"))
    L.write_layers(store, L.polygon_index(zonal, (3, 6), minimum_years=5), places, left_out, L.empty_months(zonal), "rain", (3, 6))
    rows = store.read("series").groupBy("dataset_key").agg(F.count("*").alias("data_rows"))
    stored = store.read("features").groupBy("dataset_key").agg(F.count("*").alias("features"))
    records = store.read("layer_records").withColumn("incomplete", F.size("incomplete_months").cast("bigint")).drop("incomplete_months", "available_indices")
    return records.join(rows, "dataset_key").join(stored, "dataset_key")


# -- predictors -------------------------------------------------------------------------

AREA_BOX = (51.0, 36.0, 57.5, 39.0)
STEPS = f"""
    steps AS (SELECT ts, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) FILTER (WHERE value IS NOT NULL) AS value FROM grid
              WHERE lon BETWEEN {AREA_BOX[0]} AND {AREA_BOX[2]} AND lat BETWEEN {AREA_BOX[1]} AND {AREA_BOX[3]} GROUP BY 1),
    months AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS date, avg(value) AS value FROM steps GROUP BY 1)"""


@query("box_mean", views="grid", sql=f"WITH {STEPS} SELECT ts, {rnd('value')} AS value FROM steps")
def box_mean(spark, folder):
    return rounded(R.area_weighted_mean(grid(spark, folder), AREA_BOX), "value")


@query("monthly_box_mean", views="grid", sql=f"WITH {STEPS} SELECT date, {rnd('value')} AS value FROM months")
def monthly_box_mean(spark, folder):
    return rounded(R.monthly_mean(R.area_weighted_mean(grid(spark, folder), AREA_BOX)), "value")


@query("monthly_anomaly", views="flow", sql=f"""
    SELECT feature_id, date, {rnd("value - coalesce(avg(value) FILTER (WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') OVER (PARTITION BY feature_id, month(date)), 0)")} AS value_anom FROM flow""")
def monthly_anomaly(spark, folder):
    from .base import flow

    out = R.with_anomalies(flow(spark, folder), ["value"], "1996-01-01", "1999-12-31", ["feature_id"])
    return rounded(out.drop("value"), "value_anom")


def _variables(spark, folder):
    """Three monthly variables of quantity, discount and tax, each without a value in some months of the whole range."""
    monthly = table(spark, folder, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "MM").alias("date"))
    place = F.year("date") * 12 + F.month("date")

    def variable(column, every, gap):
        mean = monthly.agg((F.sum(column) / F.count("*")).alias("value"))
        return mean.withColumn("value", F.when(place % every != gap, F.col("value")))

    return {
        "precip": variable(F.col("l_quantity"), 5, 0),
        "tmin": variable(F.round(F.col("l_discount") * 100).cast("bigint"), 7, 2),
        "tmax": variable(F.round(F.col("l_tax") * 100).cast("bigint") + 10, 4, 1),
    }


VARIABLES = """
    m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) / count(*) AS precip,
                 sum(round(l_discount * 100)) / count(*) AS tmin, sum(round(l_tax * 100) + 10) / count(*) AS tmax FROM lineitem GROUP BY 1),
    v AS (SELECT date, CASE WHEN place % 5 <> 0 THEN precip END AS precip, CASE WHEN place % 7 <> 2 THEN tmin END AS tmin, CASE WHEN place % 4 <> 1 THEN tmax END AS tmax
          FROM (SELECT *, year(date) * 12 + month(date) AS place FROM m))"""


@query("predictor_outer_merge", sql=f"""
    WITH {VARIABLES} SELECT date, {rnd("precip")} AS precip, {rnd("tmin")} AS tmin, {rnd("tmax")} AS tmax FROM v""")
def predictor_outer_merge(spark, folder):
    return rounded(R.side_by_side(_variables(spark, folder)), "precip", "tmin", "tmax")


def _anom(c: str) -> str:
    return rnd(f"{c} - coalesce(avg({c}) FILTER (WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') OVER (PARTITION BY month(date)), 0)") + f" AS {c}_anom"


@query("predictor_table", sql=f"""
    WITH {VARIABLES}, t AS (SELECT *, (tmin + tmax) / 2 AS tmean FROM v),
    e AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*)::DOUBLE AS enso_nino34 FROM orders GROUP BY 1)
    SELECT date, 'shipments' AS source_key, {", ".join(_anom(c) for c in ("precip", "tmin", "tmax", "tmean"))}, enso_nino34 FROM t LEFT JOIN e USING (date)""")
def predictor_table(spark, folder):
    enso = table(spark, folder, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("date")).agg(F.count("*").cast("double").alias("enso_nino34"))
    out = R.predictor_table(_variables(spark, folder), "shipments", "1996-01-01", "1999-12-31", enso)
    return rounded(out, "precip_anom", "tmin_anom", "tmax_anom", "tmean_anom")


@query("climatology", sql=f"""
    WITH {VARIABLES} SELECT 's' AS source_key, CAST(month(date) AS INTEGER) AS calendar_month, {rnd("coalesce(avg(precip), 0)")} AS precip, {rnd("coalesce(avg(tmin), 0)")} AS tmin FROM v GROUP BY 2""")
def climatology(spark, folder):
    merged = R.side_by_side(_variables(spark, folder)).withColumn("source_key", F.lit("s"))
    return rounded(R.climatology(merged, ["precip", "tmin"]), "precip", "tmin")
