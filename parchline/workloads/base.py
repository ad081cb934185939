"""Registry of checked queries, and domain views over the driver's tables.

Every view exists twice: as Spark code and as a DuckDB common table expression, so
that a query and its check start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query and the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql)
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles for comparison; adding 0.0 turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def rnd(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round({expression}, {digits}) + 0.0::DOUBLE)"


# -- views -------------------------------------------------------------------

# Months of the driver's orders and shipments.
FIRST_MONTH = "1995-01-01"
CUTOFF = "2000-08-01"


def flow(spark: SparkSession, folder: str) -> DataFrame:
    """Shipped quantity per supplier and month: one long monthly series per supplier."""
    rows = table(spark, folder, "lineitem")
    return rows.groupBy(
        F.col("l_suppkey").cast("string").alias("feature_id"), F.trunc(F.to_date("l_shipdate"), "MM").alias("date")
    ).agg(F.sum("l_quantity").alias("value"))


def obs(spark: SparkSession, folder: str) -> DataFrame:
    """Order value per nation and month, in whole units.

    Orders are summed per customer and month before the join, so a customer with a
    third of all orders sends at most one row per month through it.
    """
    orders = table(spark, folder, "orders")
    per_customer = orders.groupBy("o_custkey", F.trunc(F.to_date("o_orderdate"), "MM").alias("date")).agg(
        F.sum(F.round("o_totalprice").cast("bigint")).alias("amount")
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").cast("string").alias("feature_id"), "date").agg(
        F.sum("amount").cast("double").alias("value")
    )


def key_text(name: Column) -> Column:
    return F.lower(F.translate(name, " ", "_"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as point features; the layer is the supplier's region."""
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    k = F.col("s_suppkey")
    lon, lat = (k * 37) % 3600 / F.lit(10.0) - 180, (k * 53) % 1400 / F.lit(10.0) - 70
    return joined.select(
        key_text(F.col("r_name")).alias("dataset_key"),
        k.cast("string").alias("feature_id"),
        F.when(k % 7 != 0, F.col("s_name")).alias("name"),
        F.create_map(
            F.lit("Province"), F.when(k % 5 != 0, F.col("n_name")),
            F.lit("country"), F.col("r_name"),
            F.lit("balance"), F.col("s_acctbal").cast("string"),
        ).alias("props"),
        F.format_string('{"type":"Point","coordinates":[%.1f,%.1f]}', lon, lat).alias("geometry"),
        lon.alias("lon"),
        lat.alias("lat"),
        (lon - 0.5).alias("minx"),
        (lat - 0.5).alias("miny"),
        (lon + 0.5).alias("maxx"),
        (lat + 0.5).alias("maxy"),
    )


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """Two index columns per feature and month; spi3 is null in very dry months.

    Values are multiples of 1/64, so their sums do not depend on the order of rows.
    """
    layers = features(spark, folder).select("dataset_key", "feature_id")
    v = F.col("value")
    return flow(spark, folder).join(layers, "feature_id").select(
        "dataset_key", "feature_id", "date", F.when(v >= 40, (v - 180) / 64).alias("spi3"), v.alias("precip")
    )


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """Rows to forecast: (dataset_key, feature_id, date, y) with a value."""
    return wide(spark, folder).where(F.col("spi3").isNotNull()).select(
        "dataset_key", "feature_id", "date", F.col("spi3").alias("y")
    )


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Registry with one row per layer, its period taken from the series."""
    spans = wide(spark, folder).groupBy("dataset_key").agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    region = table(spark, folder, "region")
    key = key_text(F.col("r_name"))
    return region.select(
        key.alias("dataset_key"),
        F.when(F.col("r_regionkey") != 2, F.initcap("r_name")).alias("title"),
        F.lit("Point").alias("geom_type"),
        F.when(F.col("r_regionkey") != 4, F.when(F.col("r_regionkey") < 2, "alpha").otherwise("beta")).alias("source_key"),
        F.when(F.col("r_regionkey") != 4, F.when(F.col("r_regionkey") < 2, "Alpha").otherwise("Beta")).alias("source_title"),
        F.when(F.col("r_regionkey") == 0, "station").otherwise(F.concat(F.lit("zone"), F.col("r_regionkey"))).alias("boundary_key"),
        F.when(F.col("r_regionkey") != 3, F.concat(F.lit("Zone "), F.col("r_regionkey"))).alias("boundary_title"),
    ).join(spans, "dataset_key", "left").withColumn("metadata", F.lit(None).cast("string"))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Events as daily station rows, several per day."""
    u = F.col("user_id")
    return table(spark, folder, "events").select(
        F.when(F.col("event_id") % 97 != 0, u.cast("string")).otherwise(" ").alias("station_id"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("Gauge "), u)).alias("station_name"),
        (u % 360 - 180).cast("double").alias("lon"),
        F.when(F.col("event_id") % 89 != 0, (u % 120 - 60).cast("double")).alias("lat"),
        F.when(F.col("event_id") % 5 != 0, (u * 3 % 2000).cast("double")).alias("station_elevation"),
        F.to_date("ts").alias("date"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("precip_mm"),
        F.col("event_id").alias("seq"),
    )


def gauges(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments as daily station rows over many years: one station per supplier."""
    s = F.col("l_suppkey")
    return table(spark, folder, "lineitem").select(
        s.cast("string").alias("station_id"),
        F.concat(F.lit("Gauge "), s).alias("station_name"),
        (s % 360 - 180).cast("double").alias("lon"),
        (s % 120 - 60).cast("double").alias("lat"),
        (s * 3 % 2000).cast("double").alias("station_elevation"),
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("precip_mm"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


GRID_ROWS, GRID_COLS = 10, 20


def grid(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments as a 10 x 20 grid of time slices."""
    row, col = (F.col("l_suppkey") % GRID_ROWS).cast("int"), (F.col("l_partkey") % GRID_COLS).cast("int")
    return table(spark, folder, "lineitem").select(
        row.alias("lat_idx"),
        col.alias("lon_idx"),
        (F.lit(40.0) - row * 0.5).alias("lat"),
        (F.lit(50.0) + col * 0.5).alias("lon"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("value"),
        F.lit("mm").alias("units"),
        F.lit(86400.0).alias("seconds"),
    )


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as boxes over the grid, some reaching beyond it."""
    k = F.col("s_suppkey")
    minx, miny = F.lit(49.0) + (k * 37) % 100 / F.lit(10.0), F.lit(34.0) + (k * 53) % 60 / F.lit(10.0)
    return table(spark, folder, "supplier").select(
        k.cast("string").alias("feature_id"),
        minx.alias("minx"),
        miny.alias("miny"),
        (minx + 0.3 + k % 4 * 0.4).alias("maxx"),
        (miny + 0.3 + k % 3 * 0.4).alias("maxy"),
    )


def seasonal(spark: SparkSession, folder: str) -> DataFrame:
    """Stored-forecast rows of the seasonal baseline, issued at the cutoff."""
    from ..forecasting.models import seasonal_forecast

    ahead = seasonal_forecast(targets(spark, folder), CUTOFF)
    return ahead.select(
        "dataset_key",
        F.lit("spi3").alias("index_name"),
        F.lit("seasonal_mean").alias("method_name"),
        "feature_id",
        F.lit(CUTOFF).cast("date").alias("issue_date"),
        "target_date",
        "lead_month",
        F.when(F.col("lead_month") != 5, F.col("predicted")).alias("value"),
        (F.col("predicted") - 0.5).alias("lower"),
        (F.col("predicted") + 0.5).alias("upper"),
    )


def dataset_models(spark: SparkSession, folder: str) -> DataFrame:
    return seasonal(spark, folder).groupBy("dataset_key", "index_name", "method_name").agg(
        F.first("issue_date").alias("issue_date"),
        F.min("target_date").alias("forecast_min_date"),
        F.max("target_date").alias("forecast_max_date"),
    ).withColumn("model_key", F.concat_ws("_", "dataset_key", "index_name", "method_name"))


# The same views in DuckDB SQL, each with the views it needs.
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "flow": ((), """
        SELECT CAST(l_suppkey AS VARCHAR) AS feature_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               SUM(l_quantity) AS value
        FROM lineitem GROUP BY 1, 2"""),
    "obs": ((), """
        SELECT CAST(c_nationkey AS VARCHAR) AS feature_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               CAST(SUM(CAST(round(o_totalprice) AS BIGINT)) AS DOUBLE) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""),
    "features": ((), """
        SELECT lower(replace(r_name, ' ', '_')) AS dataset_key, CAST(s_suppkey AS VARCHAR) AS feature_id,
               CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS name,
               CASE WHEN s_suppkey % 5 <> 0 THEN n_name END AS province, r_name AS country, s_acctbal,
               (s_suppkey * 37) % 3600 / 1e1 - 180 AS lon, (s_suppkey * 53) % 1400 / 1e1 - 70 AS lat,
               lon - 0.5::DOUBLE AS minx, lat - 0.5::DOUBLE AS miny, lon + 0.5::DOUBLE AS maxx, lat + 0.5::DOUBLE AS maxy
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "wide": (("flow", "features"), """
        SELECT dataset_key, feature_id, date, CASE WHEN value >= 40 THEN (value - 180) / 64 END AS spi3, value AS precip
        FROM flow JOIN features USING (feature_id)"""),
    "targets": (("wide",), """
        SELECT dataset_key, feature_id, date, spi3 AS y FROM wide WHERE spi3 IS NOT NULL"""),
    "datasets": (("wide",), """
        SELECT lower(replace(r_name, ' ', '_')) AS dataset_key,
               CASE WHEN r_regionkey <> 2 THEN array_to_string(list_transform(string_split(lower(r_name), ' '),
                    lambda w: upper(w[1]) || w[2:]), ' ') END AS title,
               'Point' AS geom_type,
               CASE WHEN r_regionkey <> 4 THEN CASE WHEN r_regionkey < 2 THEN 'alpha' ELSE 'beta' END END AS source_key,
               CASE WHEN r_regionkey <> 4 THEN CASE WHEN r_regionkey < 2 THEN 'Alpha' ELSE 'Beta' END END AS source_title,
               CASE WHEN r_regionkey = 0 THEN 'station' ELSE 'zone' || r_regionkey END AS boundary_key,
               CASE WHEN r_regionkey <> 3 THEN 'Zone ' || r_regionkey END AS boundary_title,
               (SELECT min(date) FROM wide w WHERE w.dataset_key = lower(replace(r_name, ' ', '_'))) AS min_date,
               (SELECT max(date) FROM wide w WHERE w.dataset_key = lower(replace(r_name, ' ', '_'))) AS max_date
        FROM region"""),
    "daily": ((), """
        SELECT CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS VARCHAR) ELSE ' ' END AS station_id,
               CASE WHEN event_id % 3 <> 0 THEN 'Gauge ' || user_id END AS station_name,
               CAST(user_id % 360 - 180 AS DOUBLE) AS lon,
               CASE WHEN event_id % 89 <> 0 THEN CAST(user_id % 120 - 60 AS DOUBLE) END AS lat,
               CASE WHEN event_id % 5 <> 0 THEN CAST(user_id * 3 % 2000 AS DOUBLE) END AS station_elevation,
               CAST(ts AS DATE) AS date, CASE WHEN event_id % 11 <> 0 THEN value END AS precip_mm, event_id AS seq
        FROM events"""),
    "clean_days": (("daily",), """
        SELECT trim(station_id) AS station_id, coalesce(station_name, trim(station_id)) AS station_name, lon, lat,
               station_elevation, date, precip_mm, seq
        FROM daily WHERE trim(station_id) <> '' AND date IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL"""),
    "days": (("clean_days",), """
        SELECT * FROM clean_days QUALIFY row_number() OVER (PARTITION BY station_id, date ORDER BY seq DESC) = 1"""),
    "gauges": ((), """
        SELECT CAST(l_suppkey AS VARCHAR) AS station_id, CAST(l_shipdate AS DATE) AS date,
               CASE WHEN l_linenumber <> 7 THEN l_quantity END AS precip_mm,
               l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq
        FROM lineitem"""),
    "grid": ((), f"""
        SELECT CAST(l_suppkey % {GRID_ROWS} AS INTEGER) AS lat_idx, CAST(l_partkey % {GRID_COLS} AS INTEGER) AS lon_idx,
               4e1 - lat_idx * 5e-1 AS lat, 5e1 + lon_idx * 5e-1 AS lon, l_shipdate AS ts,
               CASE WHEN l_linenumber <> 7 THEN l_quantity END AS value
        FROM lineitem"""),
    "boxes": ((), """
        SELECT CAST(s_suppkey AS VARCHAR) AS feature_id,
               49e0 + (s_suppkey * 37) % 100 / 1e1 AS minx, 34e0 + (s_suppkey * 53) % 60 / 1e1 AS miny,
               minx + 3e-1 + s_suppkey % 4 * 4e-1 AS maxx, miny + 3e-1 + s_suppkey % 3 * 4e-1 AS maxy
        FROM supplier"""),
    "seasonal": (("targets",), f"""
        SELECT l.dataset_key, 'spi3' AS index_name, 'seasonal_mean' AS method_name, l.feature_id,
               DATE '{CUTOFF}' AS issue_date, l.target_date, l.lead_month,
               CASE WHEN lead_month <> 5 THEN coalesce(mean, 0) END AS value,
               coalesce(mean, 0) AS predicted, coalesce(mean, 0) - 5e-1 AS lower, coalesce(mean, 0) + 5e-1 AS upper
        FROM (SELECT dataset_key, feature_id, CAST(k AS INTEGER) AS lead_month,
                     CAST(origin + to_months(CAST(k AS INTEGER)) AS DATE) AS target_date
              FROM (SELECT dataset_key, feature_id, max(date) AS origin FROM targets WHERE date <= DATE '{CUTOFF}' GROUP BY 1, 2),
                   range(1, 13) t(k)) l
        LEFT JOIN (SELECT dataset_key, feature_id, month(date) AS m, avg(y) AS mean FROM targets
                   WHERE date <= DATE '{CUTOFF}' GROUP BY 1, 2, 3) c
          ON c.dataset_key = l.dataset_key AND c.feature_id = l.feature_id AND c.m = month(l.target_date)"""),
    "dataset_models": (("seasonal",), """
        SELECT dataset_key, index_name, method_name, min(issue_date) AS issue_date, min(target_date) AS forecast_min_date,
               max(target_date) AS forecast_max_date, dataset_key || '_' || index_name || '_' || method_name AS model_key
        FROM seasonal GROUP BY 1, 2, 3"""),
}


def with_views(names: list[str], body: str) -> str:
    """A statement with the views it uses in front, each once and after its needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in SQL_VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    body = body.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1].strip()})" for n in ordered)
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
