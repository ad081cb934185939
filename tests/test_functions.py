"""Scalar helpers."""

import datetime as dt
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from parchline.functions import calendar as C, classes, geo, keys as K, numeric, props as P, text as X
from parchline.functions.normal import normal_quantile
from parchline.plans.station_index import StationRun
from parchline.sources.tables import guess_delimiter
from parchline.sources.wide import clean_header, infer_layout


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_month_parse(spark):
    assert C.require_month("2024-03") == dt.date(2024, 3, 1)
    for bad in ("bad", "2024-13", "2024-03-01", ""):
        with pytest.raises(ValueError):
            C.require_month(bad)
    assert one(spark, C.parse_month(F.lit("bad"))) is None


def test_bbox():
    assert geo.rounded_bbox("1.12345,2.34567,3.98765,4.54321") == "1.123,2.346,3.988,4.543"
    assert geo.parse_bbox("3,4,1,2") == (1.0, 2.0, 3.0, 4.0)
    assert geo.parse_bbox("1,2,3") is None and geo.parse_bbox(None) is None


def test_flux_to_depth(spark):
    mm = numeric.to_millimetres(F.lit(1e-5), F.lit("kg m-2 s-1"), F.lit(86400.0))
    assert abs(one(spark, mm) - 0.864) < 1e-12
    with pytest.raises(Exception, match="Unsupported precipitation units"):
        one(spark, numeric.to_millimetres(F.lit(1.0), F.lit("inch"), F.lit(1.0)))


def test_quantile(spark):
    for p in (0.0, 1e-14, 1e-9, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9, 1.0):
        want = NormalDist().inv_cdf(min(max(p, 1e-12), 1 - 1e-12))
        assert abs(one(spark, normal_quantile(F.lit(p))) - want) < 1e-9
    assert one(spark, normal_quantile(F.lit(None).cast("double"))) is None


def test_severity_edges(spark):
    edges = {0.0: "Normal/Wet", -0.8: "D0", -0.81: "D1", -1.3: "D1", -1.6: "D2", -2.0: "D3", -2.01: "D4"}
    for value, level in edges.items():
        assert one(spark, classes.severity(F.lit(value))) == level
    assert classes.is_drought_index("SPEI12") and not classes.is_drought_index("ssi3")


def test_scale_names():
    run = StationRun.from_mapping({"dataset_key": "gauge_station_spi3", "title": "Stations SPI-3 — all", "scales": [6, 1, 6]})
    assert run.scales == (1, 6)
    assert run.at_scale(6).dataset_key == "gauge_station_spi6" and run.at_scale(6).title == "Stations SPI-6 — all"
    assert K.scale_place("stations", append=True) == "stations_spi{scale}" and K.scale_place("Stations") == "Stations"
    assert K.scale_place("a_SPI-12 of spi3") == "a_SPI-{scale} of spi{scale}" and K.scale_place("spi{scale}") == "spi{scale}"
    assert K.checked_scales([12, 3, 6, 3]) == (3, 6, 12) and K.checked_scales(None) == (3,) and K.checked_scales(6) == (6,)
    for wrong in (0, -1, "3", [], [1, 0], [True], [1.5]):
        with pytest.raises(ValueError):
            K.checked_scales(wrong)


def test_index_names():
    cols = ["dataset_key", "feature_id", "date", "spi3", "precip"]
    assert K.index_columns(cols) == ["precip", "spi3"]
    assert K.require_index(cols, " SPI3 ") == "spi3"
    with pytest.raises(ValueError, match="the series has precip, spi3"):
        K.require_index(cols, "spi9")
    assert K.loose_index(["spi_3"], "SPI-3") == "spi_3"
    assert K.requested_indices([], ["SPI3 ", "spi3", " "], [12, 6]) == ["spi3", "spi6", "spi12"]
    assert K.requested_indices(["spi3", "precip", "ssi1"]) == ["spi3", "ssi1"]
    for scale in (0, -3, True, []):
        with pytest.raises(ValueError):
            K.requested_indices([], scales=scale)
    assert K.model_key("Alpha-1", "spi3", "xgboost") == "alpha_1_spi3_xgboost"
    with pytest.raises(ValueError):
        K.valid_dataset_key("a;b")


def test_layout():
    assert infer_layout(["Code", "Date", "SPI3"]).id_column == "Code"
    assert infer_layout(["unit", "year", "month", "spi1"]).date_mode == "year_month"
    assert infer_layout(["unit", "yyyymm", "spi1"]).index_columns == ("spi1",)
    assert clean_header(["﻿id ", " a"]) == ["id", "a"]
    with pytest.raises(ValueError):
        infer_layout(["id", "spi3"])


def test_delimiters():
    assert [guess_delimiter(h) for h in ("a,b", "a;b;c", "a\tb", "a|b", "a")] == [",", ";", "\t", "|", ","]


def test_text_repair(spark):
    word = "سلام"
    garbled = word.encode("cp1256").decode("latin-1")
    assert one(spark, X.repair_text(F.lit(garbled))) == word
    assert one(spark, X.repair_text(F.lit("علي ك"))) == "علی ک"
    assert one(spark, X.repair_text(F.lit("Œuvre é"))) == "Œuvre é"
    assert one(spark, X.latin_digits(F.lit("۱۲٫٣"))) == "12.3"


def test_attribute_limits(spark):
    many = F.map_from_arrays(F.array(*[F.lit(f"k{i}") for i in range(40)] + [F.lit("VALUE")]), F.array(*[F.lit("v")] * 41))
    assert one(spark, F.size(P.map_attributes(many))) == 40
    assert one(spark, F.size(P.map_attributes(many, most=32))) == 32
    wordy = F.create_map(F.lit("a"), F.lit("x" * 200))
    assert one(spark, P.map_attributes(wordy)["a"]) == "x" * 200
    text = one(spark, P.map_attributes(wordy, longest=180)["a"])
    assert len(text) == 180 and text.endswith("…")


def test_retired_names_count_at_the_end_only(spark):
    hit = lambda key, **more: one(spark, K.is_retired(F.lit("x"), F.lit(key), **more))
    assert hit("a_spi3_garch") and not hit("a_garch_spi3_xgboost") and not hit("a_garch_20240101T000000Z")
    assert hit("a_spi3_garch_20240101T000000Z", dated=True) and not hit("a_garch_spi3_xgboost_20240101T000000Z", dated=True)


def test_display_name_differs_from_id(spark):
    props = F.create_map(F.lit("name"), F.lit("7"), F.lit("River_Name"), F.lit("Aras"))
    assert one(spark, P.display_name(props, F.lit("7"))) == "Aras"
    assert one(spark, P.display_name(F.create_map(F.lit("name"), F.lit("7")), F.lit("7"))) == "7"
    assert one(spark, P.feature_id(props, "hint", F.lit("own"))) == "7"


def test_typed_attributes(spark):
    from parchline.functions import props as P
    from pyspark.sql import functions as F

    texts = ['{"a": {"b": [1, NaN, "NaN", -Infinity, true, 2.5]}, "NaN": "x\\"Infinity"}', '{"a": "unfinished NaN', None, "[1, 2]", '{"a": {"b": null}}', ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").withColumn("v", P.typed_attributes(F.col("t"))).orderBy("n")
    got = rows.select(*[P.typed_attribute(F.col("v"), path, kind) for path, kind in (
        ("$.a.b[0]", "int"), ("$.a.b[1]", "double"), ("$.a.b[2]", "string"), ("$.a.b[3]", "double"), ("$.a.b[4]", "boolean"), ("$.a.b[5]", "double"), ("$['NaN']", "string"), ("$.a", "int"), ("$[1]", "int"))]).collect()
    assert tuple(got[0]) == (1, None, "NaN", None, True, 2.5, 'x"Infinity', None, None)
    assert got[3][8] == 2 and all(v is None for i in (1, 2, 4, 5) for v in got[i])
