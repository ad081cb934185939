"""Checked queries: files written from the tables and read back through the sources."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.upsert import duplicated_keys, newest_per_key
from ..plans.importer import import_layers, with_dataset_bounds
from ..session import scratch_path
from ..sources import discover as D, geojson as J, tables as T, wide as S
from ..sources.store import TableStore
from .base import daily, datasets, features, flow, query, rnd, rounded, table, wide

KEYS = ("dataset_key", "feature_id")


def _as_csv(df, path, **options):
    df.write.mode("overwrite").options(header=True, **options).csv(path)
    return path


@query("wide_csv_import", views="wide", sql=f"SELECT feature_id, date, {rnd('spi3')} AS spi3, precip, NULL::DOUBLE AS spei6 FROM wide")
def wide_csv_import(spark, folder):
    """CSV with untidy headers: names trimmed, id and month found, a missing index null."""
    rows = wide(spark, folder).select(
        F.col("spi3").alias(" SPI3 "), F.col("feature_id").alias("﻿Station_ID"), F.date_format("date", "yyyy-MM-15").alias("Date "), F.col("precip").alias("Precip")
    )
    path = _as_csv(rows, scratch_path(spark, "wide") + "/data.csv", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rounded(S.read_wide(spark, path, ["spi3", "precip", "spei6"]), "spi3")


@query("month_normalization", sql="""
    WITH t AS (SELECT o_orderkey, o_orderdate AS d, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS feature_id FROM orders)
    SELECT 'date' AS mode, feature_id, CAST(date_trunc('month', d) AS DATE) AS date, 1.0::DOUBLE AS v FROM t WHERE feature_id IS NOT NULL AND o_orderkey % 7 <> 0
    UNION ALL SELECT 'year_month', feature_id, CAST(date_trunc('month', d) AS DATE), 2.0 FROM t WHERE feature_id IS NOT NULL AND o_orderkey % 7 <> 0
    UNION ALL SELECT 'yyyymm', feature_id, CAST(date_trunc('month', d) AS DATE), NULL FROM t WHERE feature_id IS NOT NULL AND o_orderkey % 7 <> 0""")
def month_normalization(spark, folder):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    base = table(spark, folder, "orders").withColumn("code", F.when(k % 10 != 0, k.cast("string")))
    bad = k % 7 == 0
    by_date = base.select("code", F.when(bad, "soon").otherwise(F.date_format(d, "yyyy-MM-dd")).alias("DATE"), F.lit("1").alias("V"))
    by_parts = base.select("code", F.year(d).alias("Year"), F.when(bad, 13).otherwise(F.month(d)).alias("Month"), F.lit(" 2 ").alias("V"))
    by_text = base.select("code", F.when(bad, "2001").otherwise(F.date_format(d, "yyyyMM")).alias("YYYYMM"), F.lit("n/a").alias("V"))
    out = None
    for rows in (by_date, by_parts, by_text):
        part = S.normalized(rows).select(F.lit(S.infer_layout(rows.columns).date_mode).alias("mode"), "feature_id", "date", "v")
        out = part if out is None else out.unionByName(part)
    return out


@query("series_store", views="wide", sql=f"""
    SELECT dataset_key, feature_id, date, {rnd('spi3')} AS spi3, precip FROM wide WHERE dataset_key <> 'asia'
    UNION ALL SELECT dataset_key, feature_id, date, NULL, precip + 1 FROM wide WHERE dataset_key = 'asia'""")
def series_store(spark, folder):
    """Layers written, one of them replaced, all read back."""
    store = TableStore(spark, scratch_path(spark, "series"))
    rows = wide(spark, folder)
    store.write_series(rows)
    store.write_series(rows.where(F.col("dataset_key") == "asia").select(*KEYS, "date", F.lit(None).cast("double").alias("spi3"), (F.col("precip") + 1).alias("precip")))
    return rounded(store.read("series").select(*KEYS, "date", "spi3", "precip"), "spi3")


@query("registry_upsert", views="datasets", sql="""
    SELECT dataset_key, CASE WHEN source_key = 'beta' THEN 'Renamed' ELSE title END AS title, min_date, max_date FROM datasets
    UNION ALL SELECT 'extra', 'Extra', NULL, NULL""")
def registry_upsert(spark, folder):
    store = TableStore(spark, scratch_path(spark, "registry"))
    now = with_dataset_bounds(datasets(spark, folder), wide(spark, folder))
    store.upsert("datasets", now, ["dataset_key"], ["dataset_key"])
    renamed = now.where(F.col("source_key") == "beta").withColumn("title", F.lit("Renamed"))
    extra = now.where(F.col("source_key") == "alpha").limit(1).select(
        *[F.lit("extra" if c == "dataset_key" else "Extra").alias(c) if c in ("dataset_key", "title") else F.lit(None).cast(t).alias(c) for c, t in now.dtypes]
    )
    store.upsert("datasets", renamed.unionByName(extra), ["dataset_key"], ["dataset_key"])
    return store.read("datasets").select("dataset_key", "title", "min_date", "max_date")


LAYERS = ("africa", "america", "asia", "europe", "middle_east")


def _write_layers(spark, folder, base):
    """Layer folders below a base: data, features as GeoJSON lines, metadata."""
    rows, places = wide(spark, folder), features(spark, folder)
    for key in LAYERS:
        data = rows.where(F.col("dataset_key") == key).drop("dataset_key")
        if key != "europe":
            data.write.mode("overwrite").parquet(f"{base}/{key}/data.parquet")
        else:
            _as_csv(data.drop("spi3"), f"{base}/{key}/data.csv")
        one = places.where(F.col("dataset_key") == key)
        lines = one.select(
            F.to_json(F.struct(F.col("feature_id").alias("station_id"), F.col("name").alias("station_name"), F.col("props")["Province"].alias("Province"))).alias("p"), "geometry"
        ).select(F.format_string('{"type":"Feature","properties":%s,"geometry":%s}', "p", "geometry").alias("value"))
        lines.write.mode("overwrite").text(f"{base}/{key}/geoinfo.geojson")
        meta = json.dumps({"title": f"Layer {key}", "source_key": "alpha", "boundary_key": key})
        one.limit(1).select(F.lit(meta).alias("value")).write.mode("overwrite").text(f"{base}/{key}/metadata.json")
    return base


@query("discovered_layers", views="wide", sql=f"""
    SELECT dataset_key, feature_id, date, precip, {rnd("CASE WHEN dataset_key <> 'europe' THEN spi3 END")} AS spi3 FROM wide""")
def discovered_layers(spark, folder):
    base = _write_layers(spark, folder, scratch_path(spark, "import"))
    found = D.read_layers(spark, D.layer_folders(spark, base))
    return rounded(found.select(*KEYS, "date", "precip", "spi3"), "spi3")


@query("imported_features", views="wide features", sql=f"""
    SELECT f.dataset_key, feature_id, coalesce(name, feature_id) AS name, province, {rnd("lon")} AS minx, {rnd("lat")} AS maxy, min(date) AS min_date, max(date) AS max_date,
           'Layer ' || f.dataset_key AS title, 'Point' AS geom_type
    FROM features f JOIN wide w USING (feature_id) GROUP BY ALL""")
def imported_features(spark, folder):
    """Whole import: layers found, series and features stored, registry and bounds written back."""
    store = TableStore(spark, scratch_path(spark, "catalog"))
    import_layers(store, _write_layers(spark, folder, scratch_path(spark, "import")), trends=False)
    out = store.read("features").join(store.read("datasets").select("dataset_key", "title", "geom_type"), "dataset_key")
    out = out.select(*KEYS, "name", F.col("props")["Province"].alias("province"), "minx", "maxy", "min_date", "max_date", "title", "geom_type")
    return rounded(out, "minx", "maxy")


@query("import_repeated_features", views="features", sql="SELECT dataset_key, 'f' || feature_id AS feature_id, 'last ' || feature_id AS name FROM features")
def import_repeated_features(spark, folder):
    """Every feature comes twice, with its place in the properties; the later one stays, in however many files they are."""
    path = scratch_path(spark, "twice")
    f = features(spark, folder).select("dataset_key", "feature_id", F.explode(F.array(F.lit("first"), F.lit("last"))).alias("turn"))
    line = F.format_string('{"type":"Feature","id":"f%s","properties":%s,"geometry":{"type":"Point","coordinates":[1,2]}}', F.col("feature_id"), F.to_json(F.struct(F.concat_ws(" ", "turn", "feature_id").alias("title"), F.col("dataset_key").alias("layer"), F.concat_ws(" ", "feature_id", F.when(F.col("turn") == "first", "1").otherwise("2")).alias("place"))))
    f.select(line.alias("value")).write.text(path)
    placed = J.read_features(spark, path, lines=True).withColumn("place", F.col("properties")["place"])
    rows = J.feature_rows(placed, F.col("properties")["layer"], keep=("place",))
    return newest_per_key(rows, KEYS, "place").select(*KEYS, "name")


@query("store_upsert_repeated", sql="""
    SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def store_upsert_repeated(spark, folder):
    """Rows that come twice, in one batch and over two, leave the newest per key."""
    store = TableStore(spark, scratch_path(spark, "feed"))
    rows = table(spark, folder, "events").select("user_id", "event_type", "value", "event_id")
    for part in (F.col("event_id") % 2 == 0, F.lit(True)):
        store.upsert("feed", rows.where(part), ["user_id", "event_type"], ["event_type"], "event_id")
    return store.read("feed").select("user_id", "event_type", "value")


@query("evaluation_replaced", views="datasets", sql="SELECT dataset_key, 'spi3' AS index_name, 'm' AS method_name, 2 AS lead_month FROM datasets WHERE dataset_key <> 'asia'")
def evaluation_replaced(spark, folder):
    """A layer without new evaluation rows loses its old ones, the others get theirs."""
    store, parts = TableStore(spark, scratch_path(spark, "evaluation")), ["dataset_key", "index_name", "method_name"]
    rows = datasets(spark, folder).select("dataset_key", F.lit("spi3").alias("index_name"), F.lit("m").alias("method_name"))
    store.replace("evaluation", rows.withColumn("lead_month", F.lit(1)), parts)
    for key in LAYERS:
        store.clear("evaluation", {"dataset_key": key, "index_name": "spi3", "method_name": "m"})
    store.replace("evaluation", rows.where(F.col("dataset_key") != "asia").withColumn("lead_month", F.lit(2)), parts)
    return store.read("evaluation").select(*parts, "lead_month")


@query("geojson_lines", views="features", sql="""
    SELECT dataset_key, 'f' || feature_id AS feature_id, coalesce(name, 'f' || feature_id) AS name, 'Polygon' AS kind,
           round(minx, 4) + 0.0::DOUBLE AS minx, round(miny, 4) + 0.0::DOUBLE AS miny, round(maxx, 4) + 0.0::DOUBLE AS maxx, round(maxy, 4) + 0.0::DOUBLE AS maxy FROM features""")
def geojson_lines(spark, folder):
    """Polygon features, one per line; ids come from the feature itself."""
    ring = "[[%.4f,%.4f],[%.4f,%.4f],[%.4f,%.4f],[%.4f,%.4f],[%.4f,%.4f]]"
    x1, y1, x2, y2 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    text = F.format_string(
        '{"type":"Feature","id":"f%s","properties":%s,"geometry":{"type":"Polygon","coordinates":[' + ring + "]}}",
        F.col("feature_id"), F.to_json(F.struct(F.col("name").alias("title"), F.col("dataset_key").alias("layer"))), x1, y1, x2, y1, x2, y2, x1, y2, x1, y1,
    )
    path = scratch_path(spark, "lines")
    features(spark, folder).select(text.alias("value")).write.text(path)
    raw = J.read_features(spark, path, lines=True)
    out = J.feature_rows(raw, F.col("properties")["layer"]).select(*KEYS, "name", J.geometry_type(F.col("geometry")).alias("kind"), "minx", "miny", "maxx", "maxy")
    return rounded(out, "minx", "miny", "maxx", "maxy", digits=4)


@query("geojson_collections", sql="""
    SELECT 'orders' AS dataset_key, 'o' || o_orderkey AS feature_id, 'Order } "' || o_orderkey AS name, o_orderpriority AS priority, 'Point' AS kind, (o_orderkey % 360)::DOUBLE - 180 AS minx, (o_orderkey % 180)::DOUBLE - 90 AS maxy FROM orders""")
def geojson_collections(spark, folder):
    """Every order as a feature of collections without line breaks, with braces and quotes in their texts, read in ranges."""
    k = F.col("o_orderkey")
    feature = F.format_string(
        '{"type":"Feature","id":"o%s","properties":%s,"geometry":{"type":"Point","coordinates":[%s,%s]}}', k,
        F.to_json(F.struct(F.concat(F.lit('Order } "'), k).alias("title"), F.col("o_orderpriority").alias("priority"))), k % 360 - 180, k % 180 - 90,
    )
    collected = table(spark, folder, "orders").groupBy((k / 20_000).cast("bigint").alias("part")).agg(F.array_join(F.collect_list(feature), ",").alias("features"))
    path = scratch_path(spark, "collections")
    head = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"CRS84 {"}},"features":['
    collected.select("part", F.concat(F.lit(head), "features", F.lit("]}")).alias("value")).write.partitionBy("part").text(path)
    rows = J.feature_rows(J.read_features(spark, path), "orders")
    return rows.select(*KEYS, "name", F.col("props")["priority"].alias("priority"), J.geometry_type(F.col("geometry")).alias("kind"), "minx", "maxy")


@query("station_csv_scan", views="daily", sql="""
    SELECT nullif(trim(station_id), '') AS station_id, lon, lat, date, precip_mm, seq FROM daily""")
def station_csv_scan(spark, folder):
    renamed = daily(spark, folder).select(
        F.col("station_id").alias("ID"), F.col("station_name").alias("NAME"), F.col("lon").alias("LON"), F.col("lat").alias("LAT"), F.col("date").alias("DAY"),
        F.col("precip_mm").alias("rrr24"), F.col("seq").alias("n"), F.lit("unused").alias("note"),
    )
    path = _as_csv(renamed, scratch_path(spark, "stations"))
    columns = {"station_id": "ID", "station_name": "NAME", "lon": "LON", "lat": "LAT", "date": "DAY", "precip_mm": "rrr24", "seq": "n"}
    typed = T.read_station_days(spark, path, columns)
    return typed.select(
        F.nullif(F.trim("station_id"), F.lit("")).alias("station_id"), F.col("lon").try_cast("double").alias("lon"), F.col("lat").try_cast("double").alias("lat"),
        F.col("date").try_cast("date").alias("date"), F.col("precip_mm").try_cast("double").alias("precip_mm"), "seq",
    )


MONTH_COUNTS = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*)::DOUBLE AS n FROM orders GROUP BY 1"


def _month_counts(spark, folder):
    d = F.trunc(F.to_date("o_orderdate"), "MM")
    return table(spark, folder, "orders").groupBy(d.alias("date")).agg(F.count("*").cast("double").alias("n"))


@query("enso_text", sql=f"SELECT date, n AS enso_nino34 FROM ({MONTH_COUNTS}) WHERE month(date) <> 4")
def enso_text(spark, folder):
    """A text table of years and twelve values with headings, notes and missing marks."""
    value = F.when(F.month("date") == 4, -99.99).otherwise(F.col("n"))
    by_year = _month_counts(spark, folder).groupBy(F.year("date").alias("y")).agg(
        *[F.coalesce(F.max(F.when(F.month("date") == m, value)), F.lit(-99.99)).alias(f"m{m}") for m in range(1, 13)]
    )
    lines = by_year.select(F.concat(F.lit("  "), F.concat_ws("   ", "y", *[f"m{m}" for m in range(1, 13)])).alias("value"))
    notes = by_year.select(F.concat(F.lit("NINO3.4 table "), "y").alias("value"))
    path = scratch_path(spark, "enso")
    lines.unionByName(notes).write.text(path)
    return T.read_enso_text(spark, path)


@query("enso_table", sql=f"SELECT date, CASE WHEN month(date) <> 4 THEN n END AS enso_nino34 FROM ({MONTH_COUNTS})")
def enso_table(spark, folder):
    rows = _month_counts(spark, folder).select(F.date_add("date", 9).alias("date"), F.when(F.month("date") != 4, F.col("n").cast("string")).otherwise("x").alias("enso_nino34"))
    return T.read_enso_table(spark, _as_csv(rows, scratch_path(spark, "enso") + "/enso.csv"))


@query("predictors_read", sql=f"SELECT date, 'Alpha' AS source_key, n AS precip_anom, NULL::DOUBLE AS pet_anom FROM ({MONTH_COUNTS})")
def predictors_read(spark, folder):
    rows = _month_counts(spark, folder).select("date", F.explode(F.array(F.lit("ALPHA"), F.lit("beta"))).alias("source_key"), F.col("n").cast("string").alias("precip_anom"), F.lit("-").alias("pet_anom"))
    path = scratch_path(spark, "predictors")
    rows.write.parquet(path)
    return T.read_predictors(spark, path, "Alpha")


@query("series_table_read", views="flow", sql="SELECT strftime(date, '%Y-%m-%d') AS date, value FROM flow WHERE feature_id = '1' AND value >= 60")
def series_table_read(spark, folder):
    rows = flow(spark, folder).select(F.col("feature_id").alias(" ID"), F.col("date").alias("DATE"), F.when(F.col("value") < 60, "low").otherwise(F.concat(F.lit(" "), "value")).alias(" VALUE "))
    path = _as_csv(rows, scratch_path(spark, "table"), sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return T.read_series_table(spark, path, id_column="ID", id_value="1")


@query("number_lines", views="flow", sql="SELECT row_number() OVER (ORDER BY date) AS n, sum(value) AS value FROM flow GROUP BY date")
def number_lines(spark, folder):
    """The monthly totals of all shipments as text files of numbers, in order over all of them."""
    path = scratch_path(spark, "numbers")
    totals = flow(spark, folder).groupBy("date").agg(F.sum("value").alias("value"))
    totals.repartitionByRange(4, "date").sortWithinPartitions("date").select(F.col("value").cast("string")).write.text(path)
    return T.read_number_lines(spark, path)


def _listing(spark, folder):
    """Shipments as a listing of dated input files, two sources."""
    source = F.when(F.col("l_suppkey") % 3 == 0, "alpha").otherwise("beta")
    day = F.to_date("l_shipdate")
    return table(spark, folder, "lineitem").groupBy(source.alias("source_key"), day.alias("day")).agg(
        F.count("*").alias("length"), F.max("l_shipdate").alias("modificationTime")
    ).select(
        "source_key", "day", "length", "modificationTime",
        F.concat(F.lit("/in/"), "source_key", F.lit("/precip_"), F.when(F.dayofmonth("day") == 31, "latest").otherwise(F.date_format("day", "yyyyMMdd")), F.lit(".nc")).alias("path"),
    )


LISTING = """
    listing AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'alpha' ELSE 'beta' END AS source_key, CAST(l_shipdate AS DATE) AS d, count(*) AS length FROM lineitem GROUP BY 1, 2)"""


@query("dated_files", sql=f"""
    WITH {LISTING} SELECT source_key, CAST(d AS TIMESTAMP) AS ts, '/in/' || source_key || '/precip_' || strftime(d, '%Y%m%d') || '.nc' AS path FROM listing WHERE day(d) <> 31""")
def dated_files(spark, folder):
    return D.dated_files(_listing(spark, folder), r"precip_(\d{8})\.nc", "yyyyMMdd").select("source_key", "ts", "path")


@query("input_inventory", sql=f"WITH {LISTING} SELECT source_key, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM listing GROUP BY 1")
def input_inventory(spark, folder):
    return D.inventory(_listing(spark, folder))


@query("boundary_layers", sql="""
    SELECT lower(regexp_replace(k, '[^a-zA-Z0-9]+', '_', 'g')) AS boundary_key, t AS boundary_title, path FROM (
        SELECT '/b/' || p_brand || '/' || CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE 'L ' || p_partkey END || '.GeoJSON' AS path,
               CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || '_L ' || p_partkey END AS k, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || ' / L ' || p_partkey END AS t
        FROM part WHERE p_partkey % 4 <> 0)""")
def boundary_layers(spark, folder):
    k = F.col("p_partkey")
    leaf = F.when(k % 3 == 0, F.lower("p_brand")).otherwise(F.concat(F.lit("L "), k))
    files = table(spark, folder, "part").select(F.concat(F.lit("/b/"), "p_brand", F.lit("/"), leaf, F.when(k % 4 == 0, ".txt").otherwise(".GeoJSON")).alias("path"))
    return D.boundary_layers(files, "/b")


@query("stale_months", sql=f"""
    WITH {LISTING} SELECT source_key, CAST(date_trunc('month', d) AS DATE) AS month FROM listing GROUP BY 1, 2 HAVING month(month) = 3 OR year(month) = 2001""")
def stale_months(spark, folder):
    """Months whose inputs differ from a manifest that lacks 2001 and saw other sizes in March."""
    now = _listing(spark, folder).withColumn("month", F.trunc("day", "MM"))
    before = now.where(F.year("month") != 2001).withColumn("length", F.when(F.month("month") == 3, F.col("length") + 1).otherwise(F.col("length")))
    keys = ["source_key", "month"]
    return D.stale(D.fingerprinted(now, keys, "grid"), D.fingerprinted(before, keys, "grid"), keys).select(*keys)


@query("repeated_series_keys", views="wide", sql="SELECT dataset_key, feature_id, date, 2::BIGINT AS copies FROM wide WHERE date = DATE '1999-01-01'")
def repeated_series_keys(spark, folder):
    rows = wide(spark, folder)
    again = rows.where(F.col("date") == F.lit("1999-01-01").cast("date"))
    return duplicated_keys(rows.unionByName(again), [*KEYS, "date"])


@query("expanded_inputs", sql="""
    SELECT DISTINCT event_type, CAST(year(ts) AS INTEGER) AS year FROM events""")
def expanded_inputs(spark, folder):
    """A folder, a glob and a file list over the events' files, each file listed once however many of them name it."""
    path = scratch_path(spark, "inputs")
    kinds = table(spark, folder, "events").select("event_type", F.year("ts").alias("year"), "event_id")
    kinds.write.partitionBy("event_type", "year").parquet(path)
    files = D.input_files(spark, [path, f"{path}/event_type=*", f"{path}/event_type=*/year=*"], "*.parquet")
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]+)/", 1)
    listed = files.select(part("event_type").alias("event_type"), part("year").cast("int").alias("year"), "path")
    once = listed.groupBy("event_type", "year").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))
    return once.where("n = paths").select("event_type", "year")
