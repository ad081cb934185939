"""Laid-out tables: what a box, a page and a search read, and the cluster pyramid."""

import numpy as np
import pytest
from parchline.functions.text import contains_query
from parchline.operators import overview as O
from parchline.operators.search import found_features, postings, write_postings
from parchline.sources.layout import LaidOutFeatures, hilbert_cell
from pyspark.sql import functions as F

SCHEMA = "dataset_key string, feature_id string, minx double, miny double, maxx double, maxy double"


def test_neighbours_on_the_curve_are_neighbours_on_the_map(spark):
    side = 16
    rows = [(x, y, (x + 0.5) / side * 360 - 180, (y + 0.5) / side * 180 - 90) for x in range(side) for y in range(side)]
    cells = spark.createDataFrame(rows, "i int, j int, x double, y double").select("i", "j", hilbert_cell(F.col("x"), F.col("y"), 4).alias("d"))
    order = [(r["i"], r["j"]) for r in sorted(cells.collect(), key=lambda r: r["d"])]
    assert [r["d"] for r in cells.orderBy("d").collect()] == list(range(side * side))
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(order, order[1:], strict=False))
    outside = spark.createDataFrame([(999.0, -999.0), (None, 1.0)], "x double, y double").select(hilbert_cell(F.col("x"), F.col("y")).alias("d")).collect()
    assert outside[0]["d"] >= 0


@pytest.fixture(scope="module")
def places(spark):
    random = np.random.default_rng(4)
    rows = [("a" if i % 4 else "b", f"f{i:04d}", float(x), float(y), float(x), float(y)) for i, (x, y) in enumerate(zip(random.uniform(-170, 170, 4000), random.uniform(-80, 80, 4000), strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def test_a_box_reads_the_files_it_meets(spark, places, tmp_path):
    laid = LaidOutFeatures(spark, str(tmp_path))
    laid.write(places, ["dataset_key", hilbert_cell(F.col("minx"), F.col("miny")), "feature_id"], files=40)
    box = (10.0, 10.0, 40.0, 30.0)
    inside = lambda df: sorted(r["feature_id"] for r in df.collect())
    found = laid.in_box("a", box)
    assert inside(found) == inside(places.where("dataset_key = 'a' AND minx BETWEEN 10 AND 40 AND miny BETWEEN 10 AND 30")) != []
    assert len(found.inputFiles()) <= 5 and laid.directory("a").count() >= 28
    assert laid.in_box("a", (179.5, 89.0, 179.6, 89.5)).count() == 0 and laid.in_box("none", box).count() == 0


def test_a_deep_page_reads_its_files(spark, places, tmp_path):
    laid = LaidOutFeatures(spark, str(tmp_path))
    laid.write(places, ["dataset_key", "feature_id"], files=40)
    keys = sorted(r["feature_id"] for r in places.where("dataset_key = 'a'").collect())
    for limit, offset in ((10, 0), (150, 2500), (None, 2990), (7, 2999), (None, 0), (5, 5000)):
        page = laid.page("a", limit, offset)
        assert [r["feature_id"] for r in page.collect()] == keys[offset : None if limit is None else offset + limit]
        if limit == 150:
            assert len(page.inputFiles()) <= 4
            assert page.first()["total"] == 3000 and page.first()["truncated"]
    assert not laid.page("a", 7, 2993).first()["truncated"]
    with pytest.raises(ValueError):
        laid.page("a", 0)


def test_search_reads_strings_not_texts(spark, tmp_path):
    texts = ["Mashhad", "MASHHAD north", None, "aaaa", "aaa", "a", "", "Ba%_sin", "دشت مشهد", "ababab", "Österreich"]
    rows = spark.createDataFrame([("d", str(i), t, t[::-1] if t else None) for i, t in enumerate(texts)], "dataset_key string, feature_id string, name string, gram string")
    write_postings(postings(rows, [F.col("name"), F.col("gram")]), str(tmp_path / "postings"))
    table = spark.read.parquet(str(tmp_path / "postings"))
    for query in ["mash", "MASHHAD", "aaaa", "aa", "a", "h", "_s", "%_", "مشهد", "abab", "bab", "zzz", "österr", "mashhad n", "dahhsam", " ", "aaaaa"]:
        wanted = rows.where(contains_query(query, F.col("name"), F.col("gram")) & (F.coalesce("name", F.lit("")) != "")).select("feature_id")
        found = found_features(table, query)
        assert sorted(r["feature_id"] for r in found.collect()) == sorted(r["feature_id"] for r in wanted.collect()), query
    begins = {r["feature_id"]: r["first_field"] for r in found_features(table, "mash").collect()}
    assert begins == {"0": 0, "1": 0}
    plan = found_features(table, "mash")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram, [ash,mas])]" in plan.replace("mas,ash", "ash,mas") and plan.count("FileScan") == 1


def test_all_zooms_from_one_pass(spark):
    random = np.random.default_rng(9)
    points = spark.createDataFrame([(str(i % 2), float(x), float(y), None if i % 3 else float(x)) for i, (x, y) in enumerate(zip(random.uniform(-200, 200, 300), random.uniform(-89, 89, 300), strict=True))], "layer string, lon double, lat double, value double")
    pyramid = O.cluster_pyramid(points, range(14), keys=["layer"])
    assert pyramid._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    found = {}
    for r in pyramid.collect():
        found.setdefault(r["zoom"], {})[r["layer"], r["cell_x"], r["cell_y"]] = [r[c] for c in ("features", "lat", "lon", "mean_value", "minx", "miny", "maxx", "maxy")]
    for zoom in (0, 3, 6, 7, 9, 10, 13):
        plain = {(r["layer"], r["cell_x"], r["cell_y"]): [r[c] for c in ("features", "lat", "lon", "mean_value", "minx", "miny", "maxx", "maxy")] for r in O.map_clusters(points, zoom, keys=["layer"]).collect()}
        assert set(plain) == set(found[zoom])
        for key, row in plain.items():
            assert row == pytest.approx(found[zoom][key], rel=1e-9) if row[3] is not None else found[zoom][key][3] is None
