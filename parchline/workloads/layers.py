"""Checked queries: layers, features, maps, overviews, search, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C, classes, geo, keys as K, numeric, props as P, text as X
from ..operators import overview as O, search, series as S, trend as T, upsert as U
from ..operators.boxes import seeded_series
from ..operators.station import matches_reference
from ..plans.catalog import Catalog
from ..session import scratch_path
from ..sources.layout import LaidOutFeatures, hilbert_cell
from . import sqltext as Q
from .base import (
    daily, dataset_models, datasets, features, flow, obs, query, rnd, rounded, seasonal, table, targets, wide,
)

KEYS = ("dataset_key", "feature_id")
BOX = "-60,50,20.5,-30"


def catalog(spark, folder, forecasts: bool = False) -> Catalog:
    extra = {}
    if forecasts:
        extra = {"forecasts": seasonal(spark, folder), "dataset_models": dataset_models(spark, folder)}
    return Catalog(datasets(spark, folder), features(spark, folder), wide(spark, folder), **extra)


# -- filters and scalars -------------------------------------------------------


@query("dataset_resolve", views="wide", sql="SELECT dataset_key, feature_id, date, precip FROM wide WHERE lower(dataset_key) = lower('ASIA')")
def dataset_resolve(spark, folder):
    return wide(spark, folder).where(K.same_key(F.col("dataset_key"), "ASIA")).drop("spi3")


@query("month_parse", sql="""
    WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y/%m')
               WHEN 2 THEN year(o_orderdate) || '-' || (o_orderkey % 20) ELSE 'bad' END AS txt FROM orders),
    p AS (SELECT *, TRY_CAST(regexp_extract(txt, '^(\\d{4})-(\\d{1,2})$', 1) AS INTEGER) AS y,
                 TRY_CAST(regexp_extract(txt, '^(\\d{4})-(\\d{1,2})$', 2) AS INTEGER) AS m FROM t)
    SELECT o_orderkey, CASE WHEN m BETWEEN 1 AND 12 THEN make_date(y, m, 1) END AS month FROM p""")
def month_parse(spark, folder):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(k % 4 == 0, F.date_format(d, "yyyy-MM"))
        .when(k % 4 == 1, F.date_format(d, "yyyy/MM"))
        .when(k % 4 == 2, F.concat(F.year(d), F.lit("-"), k % 20))
        .otherwise("bad")
    )
    return table(spark, folder, "orders").select("o_orderkey", C.parse_month(text).alias("month"))


@query("month_arithmetic", sql="""
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS number,
           CAST(date_trunc('month', o_orderdate) - INTERVAL 7 MONTH AS DATE) AS earlier, day(last_day(o_orderdate)) AS days,
           CAST(date_trunc('month', o_orderdate) AS DATE) AS again, strftime(o_orderdate, '%Y-%m') AS label FROM orders""")
def month_arithmetic(spark, folder):
    month = C.month_start(F.col("o_orderdate"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        month.alias("month"),
        C.month_number(month).alias("number"),
        C.shift_months(month, -7).alias("earlier"),
        C.days_in_month(month).cast("bigint").alias("days"),
        C.month_from_number(C.month_number(month)).alias("again"),
        C.month_label(month).alias("label"),
    )


@query("season_terms", sql=f"""
    SELECT DISTINCT month(o_orderdate) AS month, {rnd("sin(2 * pi() * month(o_orderdate) / 12)")} AS s, {rnd("cos(2 * pi() * month(o_orderdate) / 12)")} AS c FROM orders""")
def season_terms(spark, folder):
    d = F.col("o_orderdate")
    out = table(spark, folder, "orders").select(F.month(d).cast("bigint").alias("month"), C.season_sin(d).alias("s"), C.season_cos(d).alias("c"))
    return rounded(out, "s", "c").distinct()


@query("bbox_filter", views="features", sql="""
    SELECT dataset_key, feature_id, lon, lat FROM features WHERE minx <= 20.5 AND maxx >= -60 AND miny <= 50 AND maxy >= -30""")
def bbox_filter(spark, folder):
    box = geo.parse_bbox(BOX)
    return features(spark, folder).where(geo.overlaps(box, *[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])).select(*KEYS, "lon", "lat")


@query("finite_values", sql="""
    WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'n/a' WHEN 3 THEN NULL ELSE CAST(value AS VARCHAR) END AS txt FROM events)
    SELECT event_id, CASE WHEN isfinite(TRY_CAST(txt AS DOUBLE)) THEN TRY_CAST(txt AS DOUBLE) END AS value FROM t""")
def finite_values(spark, folder):
    k = F.col("event_id")
    text = (
        F.when(k % 6 == 0, "NaN").when(k % 6 == 1, "Infinity").when(k % 6 == 2, "n/a")
        .when(k % 6 == 3, F.lit(None).cast("string")).otherwise(F.col("value").cast("string"))
    )
    return table(spark, folder, "events").select("event_id", numeric.finite(text).alias("value"))


@query("severity_classes", views="wide", sql=f"""
    SELECT dataset_key, feature_id, date, {Q.severity("spi3")} AS level,
           CASE WHEN spi3 IS NULL THEN 'No Data' ELSE {Q.severity("spi3")} END AS map_level,
           CASE WHEN spi3 > 0 THEN 'positive' WHEN spi3 < 0 THEN 'negative' ELSE 'neutral' END AS tone FROM wide""")
def severity_classes(spark, folder):
    v = F.col("spi3")
    return wide(spark, folder).select(
        *KEYS, "date", classes.severity(v).alias("level"), classes.map_severity(v, "spi3").alias("map_level"), classes.sign_class(v).alias("tone")
    )


@query("trend_categories", sql="""
    WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 5 - 2)::DOUBLE END AS slope,
                      CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE ELSE value / 500 END AS p FROM events),
    c AS (SELECT *, CASE WHEN p IS NULL OR isnan(p) OR p > 5e-2 THEN 'none' WHEN slope > 0 THEN 'inc' WHEN slope < 0 THEN 'dec' ELSE 'none' END AS category FROM t)
    SELECT event_id, category, CASE category WHEN 'inc' THEN 'Increasing Trend (Wetter)' WHEN 'dec' THEN 'Decreasing Trend (Drier)' ELSE 'No Significant Trend' END AS label,
           CASE category WHEN 'inc' THEN '↑' WHEN 'dec' THEN '↓' ELSE '—' END AS symbol,
           CASE category WHEN 'inc' THEN 'روند افزایشی' WHEN 'dec' THEN 'روند کاهشی' ELSE 'بدون روند معنی‌دار' END AS neutral_label FROM c""")
def trend_categories(spark, folder):
    k = F.col("event_id")
    slope = F.when(k % 7 != 0, (k % 5 - 2).cast("double"))
    p = F.when(k % 11 == 0, F.lit(None).cast("double")).when(k % 13 == 0, float("nan")).otherwise(F.col("value") / 500)
    category = F.col("category")
    return table(spark, folder, "events").select("event_id", classes.trend_category(slope, p).alias("category")).select(
        "*",
        classes.trend_label_en(category).alias("label"),
        classes.trend_symbol(category).alias("symbol"),
        classes.trend_label_for_index(category, "precip").alias("neutral_label"),
    )


@query("normal_functions", sql=f"""
    WITH t AS (SELECT event_id, (event_id % 9973 + 5e-1) / 9973 AS p, (value - 250) / 100 AS x FROM events),
    s AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(x)) AS t, 1 / (1 + 0.3275911::DOUBLE * abs(x / sqrt(2))) AS u FROM t)
    SELECT event_id, {rnd(Q.normal_quantile("p"))} AS quantile,
           {rnd("sign(x) * (1 - " + Q.polynomial("t", Q.N.ERF_SERIES) + " * t * exp(-x * x))")} AS erf,
           {rnd("(1 + sign(x) * (1 - " + Q.polynomial("u", Q.N.ERF_SERIES) + " * u * exp(-x * x / 2))) / 2")} AS cdf FROM s""")
def normal_functions(spark, folder):
    from ..functions.normal import erf, normal_cdf, normal_quantile

    p = (F.col("event_id") % 9973 + 0.5) / 9973.0
    x = (F.col("value") - 250) / 100
    out = table(spark, folder, "events").select("event_id", normal_quantile(p).alias("quantile"), erf(x).alias("erf"), normal_cdf(x).alias("cdf"))
    return rounded(out, "quantile", "erf", "cdf")


@query("unit_conversion", sql="""
    SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value * (3600e0 / 86400) WHEN 2 THEN value / 1e6 * 86400 ELSE value * (172800e0 / 86400) END, 6) AS mm FROM events""")
def unit_conversion(spark, folder):
    k = F.col("event_id") % 4
    units = F.when(k == 0, " MM ").when(k == 1, "mm  d**-1").when(k == 2, "kg m-2 s-1").otherwise("mm/day")
    value = F.when(k == 2, F.col("value") / 1e6).otherwise(F.col("value"))
    seconds = F.when(k == 1, 3600.0).when(k == 3, 172800.0).otherwise(86400.0)
    return table(spark, folder, "events").select("event_id", F.round(numeric.to_millimetres(value, units, seconds), 6).alias("mm"))


GARBLED_FROM = "abcdefghijklmnopqrstuvwxyz"
# Latin-1 characters of Windows-1256 letter bytes.
GARBLED_TO = bytes(range(0xC7, 0xD7)).decode("latin-1") + bytes(range(0xD8, 0xE2)).decode("latin-1")


@query("text_repair", sql=f"""
    WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN translate(lower(text), '{GARBLED_FROM}', '{GARBLED_TO}') WHEN 1 THEN text || ' كي' WHEN 2 THEN text || ' Œ' ELSE text END AS t FROM documents),
    s AS (SELECT *, translate(t, '{X.LATIN_HIGH}', '{X.ARABIC_HIGH}') AS swapped FROM t)
    SELECT doc_id, md5(CASE WHEN regexp_matches(t, '[\\x{{0600}}-\\x{{06FF}}]') OR NOT regexp_matches(t, '[\\x{{0080}}-\\x{{009F}}\\x{{00C0}}-\\x{{00FF}}]') THEN translate(t, 'يك', 'یک')
                        WHEN regexp_matches(t, '[^\\x{{0000}}-\\x{{00FF}}]') THEN t
                        WHEN regexp_matches(swapped, '[\\x{{0600}}-\\x{{06FF}}]') THEN translate(swapped, 'يك', 'یک') ELSE translate(t, 'يك', 'یک') END) AS digest,
           length(t) AS characters FROM s""")
def text_repair(spark, folder):
    k, t = F.col("doc_id") % 4, F.col("text")
    garbled = (
        F.when(k == 0, F.translate(F.lower(t), GARBLED_FROM, GARBLED_TO)).when(k == 1, F.concat(t, F.lit(" كي")))
        .when(k == 2, F.concat(t, F.lit(" Œ"))).otherwise(t)
    )
    return table(spark, folder, "documents").select("doc_id", garbled.alias("t")).select(
        "doc_id", F.md5(X.repair_text(F.col("t"))).alias("digest"), F.length("t").cast("bigint").alias("characters")
    )


@query("digit_forms", sql=f"""
    WITH t AS (SELECT event_id, CAST(event_id AS VARCHAR) || ',' || CAST(user_id AS VARCHAR) || '.5' AS t FROM events)
    SELECT event_id, translate(t, '0123456789.,', '{X.PERSIAN_DIGITS}/٬') AS localized, translate(t, '0123456789', '{X.PERSIAN_DIGITS}') AS persian, t AS latin FROM t""")
def digit_forms(spark, folder):
    t = F.concat_ws("", F.col("event_id"), F.lit(","), F.col("user_id"), F.lit(".5"))
    return table(spark, folder, "events").select("event_id", t.alias("t")).select(
        "event_id", X.localized_number(F.col("t")).alias("localized"), X.persian_digits(F.col("t")).alias("persian"),
        X.latin_digits(X.persian_digits(F.col("t"))).alias("latin"),
    )


@query("slugs", sql="""
    SELECT p_partkey, CASE WHEN s = '' THEN 'dataset' ELSE s END AS slug FROM (
        SELECT p_partkey, lower(trim(regexp_replace(CASE WHEN p_partkey % 50 = 0 THEN '--' ELSE ' ' || p_name || ' / ' || p_brand || '! ' END, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS s FROM part)""")
def slugs(spark, folder):
    text = F.when(F.col("p_partkey") % 50 == 0, "--").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_brand", F.lit("! ")))
    return table(spark, folder, "part").select("p_partkey", X.slug(text).alias("slug"))


@query("props_json_extract", sql="""
    SELECT event_id, coalesce(json_extract_string(props, '$.Country'), json_extract_string(props, '$.k')) AS country FROM events""")
def props_json_extract(spark, folder):
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, folder, "events").select("event_id", F.coalesce(P.attribute(parsed, "Country"), P.attribute(parsed, "k")).alias("country"))


def raw_props(spark, folder):
    """Customers as raw features: attributes under several of the known names."""
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        k.alias("key"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(k.cast("string")).alias("own"),
        F.map_from_entries(
            F.filter(
                F.array(
                    F.when(k % 3 == 0, F.struct(F.lit("station_id").alias("k"), F.concat(F.lit("S"), k).alias("v"))),
                    F.when(k % 5 == 0, F.struct(F.lit("code").alias("k"), F.when(k % 10 != 0, F.concat(F.lit("C"), k)).otherwise("").alias("v"))),
                    F.when(k % 2 == 0, F.struct(F.lit("NAME_1").alias("k"), F.col("c_name").alias("v"))),
                    F.when(k % 7 == 0, F.struct(F.lit("localname").alias("k"), F.concat(F.lit("L"), k).alias("v"))),
                    F.struct(F.lit("Segment").alias("k"), F.col("c_mktsegment").alias("v")),
                    F.struct(F.lit("note").alias("k"), F.repeat("c_name", 12).alias("v")),
                ),
                lambda e: e.isNotNull(),
            )
        ).alias("props"),
    )


IDENTITY = """
    raw AS (SELECT c_custkey AS key, CASE WHEN key % 3 = 0 THEN 'S' || key WHEN key % 5 = 0 AND key % 10 <> 0 THEN 'C' || key
                        WHEN key % 10 <> 0 THEN CAST(key AS VARCHAR) END AS fid, c_name, c_mktsegment FROM customer)"""


@query("feature_identity", sql=f"""
    WITH {IDENTITY}
    SELECT key, fid AS feature_id, CASE WHEN key % 2 = 0 THEN c_name WHEN key % 7 = 0 THEN 'L' || key ELSE fid END AS name,
           CAST(2 + (key % 5 = 0)::INT + (key % 2 = 0)::INT + (key % 7 = 0)::INT AS BIGINT) AS attributes FROM raw WHERE fid IS NOT NULL""")
def feature_identity(spark, folder):
    named = raw_props(spark, folder).withColumn("feature_id", P.feature_id(F.col("props"), None, F.col("own")))
    return named.where(F.col("feature_id").isNotNull()).select(
        "key", "feature_id", P.display_name(F.col("props"), F.col("feature_id")).alias("name"),
        F.size(P.without_ids(F.col("props"))).cast("bigint").alias("attributes"),
    )


@query("map_attributes", sql="""
    SELECT c_custkey AS key, c_mktsegment AS segment, repeat(c_name, 12) AS note, CASE WHEN length(repeat(c_name, 12)) > 180 THEN repeat(c_name, 12)[:179] || '…' ELSE repeat(c_name, 12) END AS brief,
           CAST(2 + (key % 5 = 0 AND key % 10 <> 0)::INT + (key % 2 = 0)::INT + (key % 7 = 0)::INT AS BIGINT) AS attributes FROM customer""")
def map_attributes(spark, folder):
    attrs = raw_props(spark, folder).select("key", P.map_attributes(F.col("props")).alias("a"), P.map_attributes(F.col("props"), longest=180)["note"].alias("brief"))
    return attrs.select("key", F.col("a")["Segment"].alias("segment"), F.col("a")["note"].alias("note"), "brief", F.size("a").cast("bigint").alias("attributes"))


@query("feature_search", views="features", sql="""
    SELECT dataset_key, feature_id FROM features
    WHERE contains(lower(coalesce(name, '') || '|' || coalesce(country, '') || '|' || coalesce(province, '') || '|' || feature_id || '|' || s_acctbal), '_1')
       OR contains(feature_id, '_1')""")
def feature_search(spark, folder):
    """Searched through the places of short strings; the features' texts are read once, to lay these out."""
    p = F.col("props")
    texts = [F.col("name"), P.country(p), P.province(p), F.col("feature_id"), F.concat_ws(" ", F.map_values(p))]
    return _searched(spark, features(spark, folder), texts, " _1 ").select(*KEYS)


def _searched(spark, rows, texts, wanted):
    path = scratch_path(spark, "postings")
    search.write_postings(search.postings(rows, texts), path)
    return search.found_features(spark.read.parquet(path), wanted)


@query("reference_filter", views="features", sql="""
    SELECT feature_id, CASE WHEN s % 3 = 0 THEN 'configured' WHEN s % 3 = 1 THEN 'fallback_available' END AS reference_mode, s % 4 <> 0 AS is_point
    FROM (SELECT feature_id, CAST(feature_id AS BIGINT) AS s FROM features) WHERE s % 4 = 0 OR s % 3 = 1""")
def reference_filter(spark, folder):
    s = F.col("feature_id").cast("bigint")
    tagged = features(spark, folder).select(
        "feature_id",
        F.when(s % 3 == 0, "configured").when(s % 3 == 1, "fallback_available").alias("reference_mode"),
        (s % 4 != 0).alias("is_point"),
    )
    return tagged.where(matches_reference(F.col("is_point"), F.col("reference_mode"), ["fallback_available"]))


@query("reference_filter_modes", views="features", sql="""
    WITH t AS (SELECT CAST(feature_id AS BIGINT) AS s FROM features), m AS (
      SELECT s, CASE WHEN s % 3 = 0 THEN 'configured' WHEN s % 3 = 1 THEN 'fallback_available' END AS mode, s % 5 = 0 AS own, s % 4 <> 0 AS is_point FROM t)
    SELECT s AS feature, NOT is_point OR coalesce(mode = 'configured', false) AS configured, NOT is_point OR coalesce(mode = 'fallback_available', false) OR own AS fallback,
           NOT is_point OR (coalesce(mode = 'configured', false) AND own) AS both FROM m""")
def reference_filter_modes(spark, folder):
    s = F.col("feature_id").cast("bigint")
    mode, own = F.when(s % 3 == 0, "configured").when(s % 3 == 1, "fallback_available"), s % 5 == 0
    shown = lambda *names: matches_reference(s % 4 != 0, mode, names, own)
    return features(spark, folder).select(
        s.alias("feature"), shown("configured").alias("configured"), shown("fallback_available").alias("fallback"),
        shown("configured", "fallback_available").alias("both"),
    )


@query("index_order", sql="""
    WITH t AS (SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'spi' WHEN 1 THEN 'spei' WHEN 2 THEN 'ssi' ELSE 'precip' END
                    || CASE WHEN l_linenumber % 4 = 3 THEN '' ELSE CAST(l_suppkey % 24 + 1 AS VARCHAR) END AS name FROM lineitem),
    k AS (SELECT name, CASE regexp_extract(name, '^(spi|spei|ssi)(\\d+)$', 1) WHEN 'spi' THEN 0 WHEN 'spei' THEN 1 WHEN 'ssi' THEN 2 ELSE 3 END AS family,
                 coalesce(TRY_CAST(regexp_extract(name, '^(spi|spei|ssi)(\\d+)$', 2) AS BIGINT), 9007199254740991) AS span FROM t)
    SELECT name, family, span FROM k""")
def index_order(spark, folder):
    n = F.col("l_linenumber") % 4
    name = F.concat(
        F.when(n == 0, "spi").when(n == 1, "spei").when(n == 2, "ssi").otherwise("precip"),
        F.when(n == 3, "").otherwise((F.col("l_suppkey") % 24 + 1).cast("string")),
    )
    names = table(spark, folder, "lineitem").select(name.alias("name")).distinct()
    family, span = K.index_family(F.col("name")), K.index_window(F.col("name"))
    return names.select("name", family.alias("family"), span.alias("span")).orderBy("family", "span", "name")


@query("method_labels", sql="""
    WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' Random_Forest ' WHEN 2 THEN 'xgboost' WHEN 3 THEN 'seasonal_mean' ELSE ' ' END AS m FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'Random Forest' WHEN 2 THEN 'XGBoost' WHEN 3 THEN 'Seasonal Mean' ELSE 'LSTM + Attention' END AS label,
           CASE event_id % 5 WHEN 1 THEN 'random_forest' WHEN 2 THEN 'xgboost' WHEN 3 THEN 'seasonal_mean' ELSE 'lstm_attention' END AS method,
           CASE event_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 99 ELSE 0 END AS rank,
           CASE event_id % 3 WHEN 0 THEN 'RMSE x 1.64' WHEN 1 THEN 'Backtest Q90' ELSE 'Some Other' END AS interval_label FROM t""")
def method_labels(spark, folder):
    k = F.col("event_id")
    method = (
        F.when(k % 5 == 1, " Random_Forest ").when(k % 5 == 2, "xgboost").when(k % 5 == 3, "seasonal_mean").when(k % 5 == 4, " ")
    )
    interval = F.when(k % 3 == 0, "RMSE_164").when(k % 3 == 2, "some_other")
    clean = K.normalized_method(method)
    return table(spark, folder, "events").select(
        "event_id", K.method_label(method).alias("label"), clean.alias("method"), K.method_rank(clean).alias("rank"),
        K.interval_label(interval).alias("interval_label"),
    )


# -- layers and registry ---------------------------------------------------------


@query("dataset_list", views="datasets", sql="""
    SELECT dataset_key, coalesce(title, dataset_key) AS title, geom_type, strftime(min_date, '%Y-%m') AS min_month, strftime(max_date, '%Y-%m') AS max_month,
           source_key, source_title, boundary_key, boundary_title FROM datasets""")
def dataset_list(spark, folder):
    return catalog(spark, folder).list_datasets()


@query("source_layers", views="datasets", sql="""
    WITH n AS (SELECT dataset_key, lower(coalesce(source_key, dataset_key)) AS source_key,
                      coalesce(source_title, lower(coalesce(source_key, dataset_key))) AS source_title,
                      coalesce(boundary_title, title, boundary_key, dataset_key) AS boundary_title FROM datasets)
    SELECT * FROM n WHERE source_key = 'beta'""")
def source_layers(spark, folder):
    return catalog(spark, folder).source_layers("beta")


@query("dataset_meta", views="datasets features dataset_models", sql=f"""
    SELECT d.dataset_key, coalesce(title, d.dataset_key) AS title, geom_type, strftime(min_date, '%Y-%m') AS min_month, strftime(max_date, '%Y-%m') AS max_month,
           coalesce(n, 0) AS feature_count, {", ".join(rnd(c) + " AS " + c for c in ("minx", "miny", "maxx", "maxy"))},
           'precip,spi3' AS indices, forecast_max_month
    FROM datasets d
    LEFT JOIN (SELECT dataset_key, count(*) AS n, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM features GROUP BY 1) f USING (dataset_key)
    LEFT JOIN (SELECT dataset_key, strftime(max(forecast_max_date), '%Y-%m') AS forecast_max_month FROM dataset_models GROUP BY 1) p USING (dataset_key)""")
def dataset_meta(spark, folder):
    out = catalog(spark, folder, True).meta().withColumn("indices", F.concat_ws(",", "indices"))
    return rounded(out, "minx", "miny", "maxx", "maxy")


@query("region_list", views="features", sql="SELECT feature_id AS id, coalesce(name, feature_id) AS name, dataset_key AS level FROM features WHERE dataset_key = 'europe'")
def region_list(spark, folder):
    return catalog(spark, folder).regions("Europe")


@query("forecast_layers", views="datasets", sql="""
    SELECT dataset_key, coalesce(title, dataset_key) AS title, lower(coalesce(source_key, dataset_key)) AS source_key, boundary_key FROM datasets WHERE boundary_key <> 'station'""")
def forecast_layers(spark, folder):
    from ..forecasting.inputs import forecast_datasets

    return forecast_datasets(datasets(spark, folder))


@query("date_bounds", views="wide features", sql="""
    SELECT dataset_key, feature_id, min(date) AS min_date, max(date) AS max_date FROM features LEFT JOIN wide USING (dataset_key, feature_id) GROUP BY 1, 2""")
def date_bounds(spark, folder):
    from ..plans.importer import with_feature_bounds

    return with_feature_bounds(features(spark, folder), wide(spark, folder)).select(*KEYS, "min_date", "max_date")


@query("feature_upsert", views="features", sql="""
    WITH fresh AS (SELECT feature_id, 'new ' || feature_id AS name FROM features WHERE lat > 0
                   UNION ALL SELECT 'x' || feature_id, 'added' FROM features WHERE lon > 0)
    SELECT feature_id, name FROM fresh UNION ALL SELECT feature_id, name FROM features WHERE feature_id NOT IN (SELECT feature_id FROM fresh)""")
def feature_upsert(spark, folder):
    places = features(spark, folder)
    now = places.select("feature_id", "name")
    twice = places.where(F.col("lat") > 0).select(
        "feature_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("old").alias("name")), F.struct(F.lit(2).alias("seq"), F.concat(F.lit("new "), "feature_id").alias("name")))).alias("v")
    ).select("feature_id", "v.name", "v.seq")
    added = places.where(F.col("lon") > 0).select(F.concat(F.lit("x"), "feature_id").alias("feature_id"), F.lit("added").alias("name"), F.lit(1).alias("seq"))
    return U.upsert(now, twice.unionByName(added), ["feature_id"], "seq").select("feature_id", "name")


@query("repeated_keys", sql="SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS copies FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"))
    return U.duplicated_keys(rows, ["user_id", "day"])


@query("numbered_duplicates", sql="""
    WITH t AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'u' || c_custkey ELSE c_mktsegment END AS id FROM customer),
    n AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM t)
    SELECT key, id FROM n WHERE c = 1 UNION ALL SELECT key, id || '_' || row_number() OVER (ORDER BY key) FROM n WHERE c > 1""")
def numbered_duplicates(spark, folder):
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(k.alias("key"), F.when(k % 4 == 0, F.concat(F.lit("u"), k)).otherwise(F.col("c_mktsegment")).alias("id"))
    return U.numbered_duplicates(rows, "id", "key")


@query("retired_methods", sql="""
    WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'garch' WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE 'random_forest' END AS method_name,
                      'm' || event_id || CASE WHEN event_id % 9 = 4 THEN '_sarimax' ELSE '_x' END AS model_key FROM events)
    SELECT event_id, model_key, coalesce(nullif(trim(method_name), ''), 'lstm_attention') AS method_name FROM t
    WHERE method_name IS DISTINCT FROM 'garch' AND model_key NOT LIKE '%\\_sarimax' ESCAPE '\\'""")
def retired_methods(spark, folder):
    from ..plans.forecast import without_retired

    k = F.col("event_id")
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(k % 6 == 0, "garch").when(k % 6 == 2, " ").when(k % 6 > 2, "random_forest").alias("method_name"),
        F.concat(F.lit("m"), k, F.when(k % 9 == 4, "_sarimax").otherwise("_x")).alias("model_key"),
    )
    return without_retired(rows, "model_key")


@query("shared_indices", views="wide", sql="""
    WITH a AS (SELECT DISTINCT dataset_key, 'precip' AS i FROM wide UNION SELECT DISTINCT dataset_key, 'spi3' FROM wide WHERE spi3 IS NOT NULL
               UNION SELECT DISTINCT dataset_key, 'spi' || (CAST(precip AS BIGINT) % 50) FROM wide)
    SELECT i AS index_name FROM a GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT dataset_key) FROM a)""")
def shared_indices(spark, folder):
    from ..forecasting.inputs import shared_indices as shared

    w = wide(spark, folder)
    available = (
        w.select("dataset_key", F.lit("precip").alias("index_name"))
        .union(w.where(F.col("spi3").isNotNull()).select("dataset_key", F.lit("spi3")))
        .union(w.select("dataset_key", F.concat(F.lit("spi"), F.col("precip").cast("bigint") % 50)))
    )
    return shared(available)


@query("id_column_guess", views="features", sql="""
    SELECT 'l_suppkey' AS column_name, count(DISTINCT l_suppkey) AS overlap FROM lineitem
    WHERE CAST(l_suppkey AS VARCHAR) IN (SELECT feature_id FROM features)""")
def id_column_guess(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_suppkey", F.col("l_linenumber").alias("n"))
    return O.best_id_column(rows, features(spark, folder), ["station_id", "unit_id", "id", "region_id", "name"])


@query("region_seed_join", sql="""
    SELECT n_nationkey AS region_id, n_name AS region_name, CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice) AS BIGINT))::DOUBLE AS precip FROM orders
    JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0 JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3""")
def region_seed_join(spark, folder):
    rows = table(spark, folder, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("date")).agg(F.sum(F.round("o_totalprice").cast("bigint")).alias("v"))
    # Customers in debt are filed under a name no region has.
    name = F.when(F.col("c_acctbal") < 0, "ELSEWHERE").otherwise(F.concat(F.lit("NATION_"), "c_nationkey"))
    places = table(spark, folder, "customer").select("c_custkey", name.alias("region_name"))
    named = rows.join(places, F.col("o_custkey") == F.col("c_custkey")).groupBy("region_name", "date").agg(F.sum("v").cast("double").alias("precip"))
    regions = table(spark, folder, "nation").select(F.col("n_name").alias("name"), F.lit("province").alias("level"), F.col("n_nationkey").alias("region_id"))
    counties = regions.withColumns({"level": F.lit("county"), "region_id": F.col("region_id") + 1000})
    return seeded_series(named, regions.unionByName(counties), "province").select("region_id", "region_name", "date", "precip")


@query("subregion_boxes", views="features", sql=f"""
    WITH s AS (SELECT feature_id, level, i, minx, miny, (maxx - minx) / 2 AS dx, (maxy - miny) / 2 AS dy FROM features,
               (SELECT unnest(['county', 'level1', 'level2', 'level3']) AS level), range(1, 3) r(i))
    SELECT feature_id, level, CAST(i AS INTEGER) AS part, {rnd("minx + (i - 1) * dx * 6e-1")} AS minx, {rnd("miny + (i - 1) * dy * 4e-1")} AS miny,
           {rnd("minx + i * dx")} AS maxx, {rnd("miny + i * dy * 6e-1")} AS maxy FROM s""")
def subregion_boxes(spark, folder):
    from ..operators.boxes import subregions

    out = subregions(features(spark, folder), ["county", "level1", "level2", "level3"]).select("feature_id", "level", "part", "minx", "miny", "maxx", "maxy")
    return rounded(out, "minx", "miny", "maxx", "maxy")


# -- maps and overviews ------------------------------------------------------------


@query("map_snapshot", views="wide features", sql=f"""
    SELECT f.dataset_key, f.feature_id, coalesce(name, f.feature_id) AS name, province, country, {rnd("spi3")} AS value, spi3 IS NOT NULL AS has_value,
           CASE WHEN spi3 IS NULL THEN 'No Data' ELSE {Q.severity("spi3")} END AS severity, count(*) OVER () AS total, false AS truncated
    FROM features f LEFT JOIN wide w ON w.dataset_key = f.dataset_key AND w.feature_id = f.feature_id AND w.date = DATE '1998-03-01'
    WHERE f.dataset_key = 'asia' AND minx <= 170 AND maxx >= -170 AND miny <= 60 AND maxy >= -60""")
def map_snapshot(spark, folder):
    out = catalog(spark, folder).map_data("Asia", "spi3", "1998-03", bbox="170,-60,-170,60")
    return rounded(out.drop("attrs", "geometry"), "value")


TREND_PAIRS = """
    placed AS (SELECT dataset_key, feature_id, spi3 AS v, row_number() OVER (PARTITION BY feature_id ORDER BY date) AS i FROM wide WHERE spi3 IS NOT NULL),
    trend AS (SELECT a.dataset_key, a.feature_id, sum(sign(b.v - a.v)) / count(*) AS tau, median((b.v - a.v) / (b.i - a.i)) AS slope
              FROM placed a JOIN placed b USING (feature_id) WHERE a.i < b.i GROUP BY 1, 2)"""


@query("map_with_trend", views="wide features", sql=f"""
    WITH {TREND_PAIRS}
    SELECT f.feature_id, {rnd("precip")} AS value, {rnd("tau")} AS tau, {rnd("slope")} AS sen_slope
    FROM features f LEFT JOIN wide w ON w.feature_id = f.feature_id AND w.date = DATE '1999-07-01' LEFT JOIN trend t ON t.feature_id = f.feature_id
    WHERE f.dataset_key = 'europe'""")
def map_with_trend(spark, folder):
    from ..plans.importer import all_trends

    shown = catalog(spark, folder)
    # The map of one index shows the trend of another here, so that both joins are seen.
    shown.trends = all_trends(shown.series, ["spi3"]).withColumn("index_name", F.lit("precip"))
    out = shown.map_data("europe", "precip", "1999-07").select(
        "feature_id", "value", F.col("trend.tau").alias("tau"), F.col("trend.sen_slope").alias("sen_slope")
    )
    return rounded(out, "value", "tau", "sen_slope")


@query("trend_lookup", views="wide", sql=f"""
    WITH {TREND_PAIRS} SELECT dataset_key, feature_id, {rnd("tau")} AS tau, {rnd("slope")} AS sen_slope FROM trend WHERE dataset_key = 'africa'""")
def trend_lookup(spark, folder):
    from ..plans.importer import all_trends

    stats = all_trends(wide(spark, folder))
    wanted = stats.where((F.col("index_name") == "spi3") & K.same_key(F.col("dataset_key"), "Africa"))
    return rounded(wanted.select(*KEYS, "tau", "sen_slope"), "tau", "sen_slope")


@query("map_forecast_override", views="wide features seasonal", sql=f"""
    WITH base AS (SELECT f.feature_id, spi3, s.feature_id IS NOT NULL AS is_prediction, s.value AS ahead
        FROM features f LEFT JOIN wide w ON w.feature_id = f.feature_id AND w.date = DATE '2001-01-01'
        LEFT JOIN seasonal s ON s.feature_id = f.feature_id AND s.target_date = DATE '2001-01-01' WHERE f.dataset_key = 'america')
    SELECT feature_id, {rnd("CASE WHEN is_prediction THEN ahead ELSE spi3 END")} AS value, is_prediction,
           CASE WHEN is_prediction THEN ahead IS NOT NULL ELSE spi3 IS NOT NULL END AS has_value,
           CASE WHEN is_prediction AND ahead IS NOT NULL THEN {Q.severity("ahead")} WHEN spi3 IS NULL THEN 'No Data' ELSE {Q.severity("spi3")} END AS severity
    FROM base""")
def map_forecast_override(spark, folder):
    out = catalog(spark, folder, True).map_data("america", "spi3", "2001-01")
    return rounded(out.select("feature_id", "value", "is_prediction", "has_value", "severity"), "value")


@query("feature_page", views="features", sql="SELECT dataset_key, feature_id, count(*) OVER () AS total, count(*) OVER () > 8 AS truncated FROM features WHERE dataset_key = 'asia' ORDER BY feature_id LIMIT 5 OFFSET 3")
def feature_page(spark, folder):
    """From the files that hold the page, of features laid out by key."""
    laid = LaidOutFeatures(spark, scratch_path(spark, "by_key"))
    laid.write(features(spark, folder).select(*KEYS), KEYS, files=12)
    return laid.page("asia", 5, 3)


@query("features_in_box", views="features", sql="SELECT dataset_key, feature_id FROM features WHERE dataset_key = 'asia' AND minx <= 20.5 AND maxx >= -60 AND miny <= 50 AND maxy >= -30")
def features_in_box(spark, folder):
    """From the files that meet the box, of features laid out along a Hilbert curve."""
    laid = LaidOutFeatures(spark, scratch_path(spark, "by_place"))
    centre = hilbert_cell((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2)
    laid.write(features(spark, folder).select(*KEYS, "minx", "miny", "maxx", "maxy"), ["dataset_key", centre, "feature_id"], files=12)
    return laid.in_box("asia", (-60.0, -30.0, 20.5, 50.0)).select(*KEYS)


@query("large_feature_page", sql="""
    SELECT CAST(o_orderkey AS VARCHAR) AS feature_id, o_orderkey AS place, count(*) OVER () AS total, count(*) OVER () > 12000 AS truncated FROM orders ORDER BY o_orderkey LIMIT 12000""")
def large_feature_page(spark, folder):
    """A page larger than any screen's: as many rows as asked for."""
    places = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("feature_id"), F.col("o_orderkey").alias("place"))
    return O.page(places, "place", 12000)


@query("feature_page_by_key", views="features", sql="""
    SELECT dataset_key, feature_id, (SELECT count(*) FROM features WHERE dataset_key = 'asia') AS total, count(*) OVER () > 5 AS truncated
    FROM features WHERE dataset_key = 'asia' AND feature_id > '3' ORDER BY feature_id LIMIT 5""")
def feature_page_by_key(spark, folder):
    asia = features(spark, folder).where(F.col("dataset_key") == "asia").select(*KEYS)
    return O.page_after(asia, "feature_id", "3", 5)


@query("map_total", views="features", sql="SELECT count(*) AS total FROM features WHERE dataset_key = 'asia' AND minx <= 20.5 AND maxx >= -60 AND miny <= 50 AND maxy >= -30")
def map_total(spark, folder):
    return catalog(spark, folder).map_total("asia", BOX)


COUNTS = ", ".join(
    ["count({v}) AS with_value", "count(*) FILTER (WHERE {v} IS NULL) AS missing"]
    + [f"count(*) FILTER (WHERE {Q.severity('{v}')} = '{name}') AS {col}" for name, col in O.CLASS_COLUMNS.items()]
)
RANGE = "count({v}) AS with_value, count(*) FILTER (WHERE {v} IS NULL) AS missing, min({v}) AS min, max({v}) AS max, " + rnd("avg({v})") + " AS mean"


@query("overview_counts", views="wide", sql="SELECT dataset_key, date, " + COUNTS.format(v="spi3") + " FROM wide GROUP BY 1, 2")
def overview_counts(spark, folder):
    return O.class_counts(wide(spark, folder), "spi3")


@query("climate_overview", views="wide", sql="SELECT dataset_key, date, " + RANGE.format(v="precip") + " FROM wide GROUP BY 1, 2")
def climate_overview(spark, folder):
    return rounded(O.value_range(wide(spark, folder), "precip"), "mean")


@query("forecast_overview", views="seasonal", sql="SELECT dataset_key, target_date, " + COUNTS.format(v="value") + " FROM seasonal WHERE value IS NOT NULL GROUP BY 1, 2")
def forecast_overview(spark, folder):
    known = seasonal(spark, folder).where(F.col("value").isNotNull())
    return O.class_counts(known, "value", ["dataset_key", "target_date"])


@query("overview_observed", views="wide", sql="SELECT " + COUNTS.format(v="spi3") + ", false AS prediction FROM wide WHERE dataset_key = 'asia' AND date = DATE '1999-02-01'")
def overview_observed(spark, folder):
    return catalog(spark, folder, True).overview("asia", "spi3", "1999-02")


@query("overview_forecast", views="seasonal", sql="SELECT " + COUNTS.format(v="value") + ", true AS prediction FROM seasonal WHERE dataset_key = 'asia' AND target_date = DATE '2001-03-01' AND value IS NOT NULL")
def overview_forecast(spark, folder):
    return catalog(spark, folder, True).overview("asia", "spi3", "2001-03")


@query("class_shares", views="wide", sql=f"""
    SELECT dataset_key, date, level AS severity, n AS features, {rnd("n * 100e0 / sum(n) OVER (PARTITION BY dataset_key, date)")} AS percent
    FROM (SELECT dataset_key, date, {Q.severity("spi3")} AS level, count(*) AS n FROM wide WHERE spi3 IS NOT NULL GROUP BY 1, 2, 3)""")
def class_shares(spark, folder):
    return rounded(O.class_shares(wide(spark, folder), "spi3"), "percent")


def _map_points(spark, folder):
    at = wide(spark, folder).where(F.col("date") == F.lit("1998-03-01").cast("date"))
    return features(spark, folder).join(at.select(*KEYS, F.col("spi3").alias("value")), list(KEYS), "left")


@query("map_clusters", views="features wide", sql=f"""
    WITH p AS (SELECT lon, lat, spi3, sin(radians(lat)) AS s FROM features f LEFT JOIN wide w ON w.feature_id = f.feature_id AND w.date = DATE '1998-03-01')
    SELECT CAST(floor((lon / 360 + 5e-1) * 256 * 8 / 56) AS BIGINT) AS cell_x, CAST(floor((5e-1 - ln((1 + s) / (1 - s)) / (4 * pi())) * 256 * 8 / 56) AS BIGINT) AS cell_y,
           count(*) AS features, {rnd("avg(lat)")} AS lat, {rnd("avg(lon)")} AS lon, {rnd("avg(spi3)")} AS mean_value,
           {rnd("min(lon)")} AS minx, {rnd("min(lat)")} AS miny, {rnd("max(lon)")} AS maxx, {rnd("max(lat)")} AS maxy FROM p GROUP BY 1, 2""")
def map_clusters(spark, folder):
    return rounded(O.map_clusters(_map_points(spark, folder), 3), "lat", "lon", "mean_value", "minx", "miny", "maxx", "maxy")


def _clusters_sql(zoom: int) -> str:
    grid = f"256 * {2**zoom} / {geo.cluster_pixels(zoom)}"
    return f"""SELECT {zoom} AS zoom, CAST(floor((lon / 360 + 5e-1) * {grid}) AS BIGINT) AS cell_x, CAST(floor((5e-1 - ln((1 + s) / (1 - s)) / (4 * pi())) * {grid}) AS BIGINT) AS cell_y,
        count(*) AS features, {rnd("avg(lat)")} AS lat, {rnd("avg(lon)")} AS lon, {rnd("avg(spi3)")} AS mean_value,
        {rnd("min(lon)")} AS minx, {rnd("min(lat)")} AS miny, {rnd("max(lon)")} AS maxx, {rnd("max(lat)")} AS maxy FROM p GROUP BY 2, 3"""


@query("map_cluster_pyramid", views="features wide", sql=f"""
    WITH p AS (SELECT lon, lat, spi3, sin(radians(lat)) AS s FROM features f LEFT JOIN wide w ON w.feature_id = f.feature_id AND w.date = DATE '1998-03-01')
    {" UNION ALL ".join(_clusters_sql(zoom) for zoom in range(19))}""")
def map_cluster_pyramid(spark, folder):
    """The clusters of every zoom of the map at once."""
    return rounded(O.cluster_pyramid(_map_points(spark, folder), range(19)), "lat", "lon", "mean_value", "minx", "miny", "maxx", "maxy")


@query("marker_radius", views="wide", sql=f"""
    WITH r AS (SELECT *, min(precip) OVER w AS lo, max(precip) OVER w AS hi FROM wide WINDOW w AS (PARTITION BY dataset_key, date))
    SELECT dataset_key, feature_id, date, {rnd("CASE WHEN hi <= lo THEN 8 ELSE 4 + 10 * (precip - lo) / (hi - lo) END")} AS radius FROM r""")
def marker_radius(spark, folder):
    out = O.with_radius(wide(spark, folder), value="precip").drop("spi3", "precip")
    return rounded(out, "radius")


@query("search_suggestions", views="features", sql="""
    SELECT feature_id, coalesce(name, feature_id) AS name, CASE WHEN starts_with(feature_id, '1') THEN 0 ELSE 1 END AS starts FROM features
    WHERE contains(lower(coalesce(name, feature_id)), '1') OR contains(feature_id, '1')
    ORDER BY starts, name, feature_id LIMIT 8""")
def search_suggestions(spark, folder):
    named = features(spark, folder).select(*KEYS, F.coalesce("name", "feature_id").alias("name"))
    found = _searched(spark, named, [F.col("name"), F.col("feature_id")], "1")
    hits = named.join(found, list(KEYS)).select("feature_id", "name")
    return O.suggestions(hits, "1", F.lit(True), 8)


# -- series of the catalog -----------------------------------------------------------


@query("kpi", views="wide features", sql=f"""
    WITH known AS (SELECT * FROM wide WHERE dataset_key = 'asia' AND spi3 IS NOT NULL),
    eff AS (SELECT f.dataset_key, f.feature_id, coalesce(name, f.feature_id) AS feature, max(date) FILTER (WHERE date <= DATE '1999-04-01') AS b, min(date) FILTER (WHERE date >= DATE '1999-04-01') AS n
            FROM features f LEFT JOIN known k ON k.feature_id = f.feature_id WHERE f.dataset_key = 'asia' GROUP BY ALL),
    res AS (SELECT *, coalesce(b, n, DATE '1999-04-01') AS effective FROM eff)
    SELECT r.dataset_key, r.feature_id, feature, '1999-04' AS requested_month, strftime(effective, '%Y-%m') AS effective_month,
           CASE WHEN b IS NULL AND n IS NULL THEN 'no-data' WHEN b IS NULL THEN 'clamped-to-start' WHEN b = DATE '1999-04-01' THEN NULL WHEN n IS NULL THEN 'clamped-to-end' ELSE 'nearest-previous' END AS note,
           {rnd("min(spi3)")} AS min, {rnd("max(spi3)")} AS max, {rnd("avg(spi3)")} AS mean, {rnd("arg_max(spi3, date)")} AS latest,
           {Q.severity("arg_max(spi3, date)")} AS severity, CASE WHEN count(spi3) = 0 THEN 'no_series' END AS error
    FROM res r LEFT JOIN known k ON k.feature_id = r.feature_id AND k.date <= effective GROUP BY ALL""")
def kpi(spark, folder):
    out = catalog(spark, folder).kpi("asia", "spi3", "1999-04")
    fields = ("dataset_key", "feature_id", "feature", "requested_month", "effective_month", "note", "min", "max", "mean", "latest", "severity", "error")
    return rounded(out.select(*fields), "min", "max", "mean", "latest")


@query("time_series", views="wide", sql="""
    WITH known AS (SELECT * FROM wide WHERE spi3 IS NOT NULL AND dataset_key = 'africa'),
    spine AS (SELECT dataset_key, feature_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date FROM known GROUP BY 1, 2)
    SELECT dataset_key, feature_id, date, """ + rnd("spi3") + " AS value FROM spine LEFT JOIN known USING (dataset_key, feature_id, date)")
def time_series(spark, folder):
    return rounded(catalog(spark, folder).time_series("africa", "spi3"), "value")


@query("has_prediction", views="dataset_models", sql="SELECT count(*) > 0 AS has_prediction FROM dataset_models WHERE dataset_key = 'asia' AND index_name = 'spi3'")
def has_prediction(spark, folder):
    return catalog(spark, folder, True).has_prediction("Asia", "SPI3")


@query("typed_attributes", sql="""
    SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value AS depth, event_type AS tag, event_id % 2 = 0 AS checked, CAST(NULL AS DOUBLE) AS level,
           'NaN ' || event_type AS note, CAST(NULL AS INTEGER) AS wrong FROM events""")
def typed_attributes(spark, folder):
    """Attributes with a list and an object in them: a nested number, a list entry, a truth value, and numbers that are none."""
    text = F.concat(
        F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "gauge": {"depth": '), F.col("value").cast("string"), F.lit(', "tags": [NaN, "'), F.col("event_type"),
        F.lit('"]}, "checked": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit(', "level": -Infinity, "note": "NaN '), F.col("event_type"), F.lit('"}'),
    )
    rows = table(spark, folder, "events").select("event_id", P.typed_attributes(text).alias("attrs"))
    a = F.col("attrs")
    return rows.select(
        "event_id", P.typed_attribute(a, "$.k", "int").alias("k"), P.typed_attribute(a, "$.gauge.depth", "double").alias("depth"), P.typed_attribute(a, "$.gauge.tags[1]", "string").alias("tag"),
        P.typed_attribute(a, "$.checked", "boolean").alias("checked"), P.typed_attribute(a, "$.level", "double").alias("level"), P.typed_attribute(a, "$.note", "string").alias("note"),
        P.typed_attribute(a, "$.gauge", "int").alias("wrong"),
    )


@query("resolved_indices", sql="""
    WITH asked AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'SPI-3' WHEN 1 THEN ' spi_6 ' WHEN 2 THEN 'spi3' WHEN 3 THEN 'S-P-E-I_1' ELSE event_type END AS name FROM events)
    SELECT event_id, name, CASE event_id % 5 WHEN 0 THEN 'spi3' WHEN 1 THEN 'SPI6' WHEN 2 THEN 'spi3' WHEN 3 THEN 'spei_1' END AS index_name FROM asked""")
def resolved_indices(spark, folder):
    """Requested names, written in several ways, and the index column each means."""
    turn = F.col("event_id") % 5
    name = F.when(turn == 0, "SPI-3").when(turn == 1, " spi_6 ").when(turn == 2, "spi3").when(turn == 3, "S-P-E-I_1").otherwise(F.col("event_type"))
    rows = table(spark, folder, "events").select("event_id", name.alias("name"))
    return rows.withColumn("index_name", K.resolved_index(F.col("name"), ["spi3", "SPI6", "spei_1"]))
