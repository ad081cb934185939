"""Sources, stores and streams on small files."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchline.operators.station import monthly_precipitation
from parchline.operators.upsert import numbered_duplicates, upsert
from parchline.plans.importer import import_layers
from parchline.sources import discover as D, geojson as J, tables as T
from parchline.sources.collections import read_collection
from parchline.sources.store import TableStore

MULTI = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 7], [5, 5]]]]}


def write_layer(folder, key):
    place = folder / key
    place.mkdir(parents=True)
    (place / "data.csv").write_text("station_id,date,SPI3,level\na,2000-01-15,0.5,x\na,2000-03-01,NaN,y\nb,bad,1,z\n,2000-01-01,1,z\n", encoding="utf-8")
    collection = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"station_id": "a", "station_name": "علي", "Elevation": 12}, "geometry": {"type": "Point", "coordinates": [59, 36.5, 900]}},
        {"type": "Feature", "id": "z", "properties": {"title": ""}, "geometry": MULTI},
        {"type": "Feature", "properties": {}, "geometry": MULTI},
    ]}
    (place / "geoinfo.geojson").write_text(json.dumps(collection, indent=1), encoding="utf-8")
    return place


def test_import(spark, tmp_path):
    write_layer(tmp_path / "in", "Alpha")
    (tmp_path / "in" / "Alpha" / "metadata.json").write_text(json.dumps({"title": "First", "source_key": "s"}))
    write_layer(tmp_path / "in", "beta")
    (tmp_path / "in" / "nothing").mkdir()
    base = str(tmp_path / "in")
    assert [f.dataset_key for f in D.layer_folders(spark, base)] == ["Alpha", "beta"]
    assert [f.dataset_key for f in D.layer_folders(spark, base, need_metadata=True)] == ["Alpha"]
    assert [f.dataset_key for f in D.layer_folders(spark, f"{base}/beta")] == ["station"]
    store = TableStore(spark, str(tmp_path / "out"))
    assert import_layers(store, base, only=["ALPHA", "beta"]) == ["Alpha", "beta"]
    series = store.read("series").where("dataset_key = 'Alpha'").orderBy("date").collect()
    assert [(r["feature_id"], r["date"], r["spi3"], r["level"]) for r in series] == [("a", dt.date(2000, 1, 1), 0.5, None), ("a", dt.date(2000, 3, 1), None, None)]
    places = {r["feature_id"]: r for r in store.read("features").where("dataset_key = 'Alpha'").collect()}
    assert set(places) == {"a", "z"} and places["a"]["name"] == "علی" and places["a"]["maxy"] == 36.5
    assert (places["z"]["minx"], places["z"]["maxy"]) == (0.0, 7.0) and places["a"]["max_date"] == dt.date(2000, 3, 1)
    registry = {r["dataset_key"]: r for r in store.read("datasets").collect()}
    assert registry["Alpha"]["title"] == "First" and registry["beta"]["title"] == "beta" and registry["beta"]["geom_type"] == "Point"
    assert store.read("trend_stats").where("dataset_key = 'beta'").count() == 1
    import_layers(store, base, only=["beta"])
    assert store.read("series").count() == 4


def test_repeated_keys_fail(spark, tmp_path):
    rows = spark.createDataFrame([("d", "a", dt.date(2000, 1, 1), 1.0)] * 2, "dataset_key string, feature_id string, date date, spi3 double")
    with pytest.raises(ValueError, match="repeated key"):
        TableStore(spark, str(tmp_path)).write_series(rows)


def test_polygons(spark):
    shapes = spark.createDataFrame([(json.dumps(MULTI),)], "geometry string")
    got = shapes.select(J.polygons(F.col("geometry")).alias("p")).first()["p"]
    assert len(got) == 2 and got[1][0][1] == [6.0, 5.0]


def in_small_ranges(spark, size):
    """Files are cut into ranges of this many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, str(size))
    return names


def test_number_lines_keep_their_order(spark, tmp_path):
    numbers = np.random.default_rng(2).normal(size=3000).round(6).tolist()
    texts, at = {}, 0
    for name, size in (("a.txt", 1700), ("b.txt", 1), ("c.txt", 0), ("d.txt", 1299)):
        own, at = numbers[at : at + size], at + size
        texts[name] = "".join(f" {v}" + ("\n" if i % 3 else "\n\n" if i % 5 == 0 else "\t") for i, v in enumerate(own))
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    names = in_small_ranges(spark, 500)
    try:
        rows = T.read_number_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert [(r["n"], r["value"]) for r in rows.orderBy("n").collect()] == [(i + 1, v) for i, v in enumerate(numbers)]
    finally:
        for name in names:
            spark.conf.unset(name)


@pytest.mark.parametrize(("size", "indent"), [(90, None), (400, 1), (1 << 20, None)])
def test_collections_read_in_ranges(spark, tmp_path, size, indent):
    """Wherever ranges begin, also within texts that look like features, the features are the same."""
    trap = '{"type":"Feature","id":"no","properties":{},"geometry":null},"features":[{ \\ " }'
    features = [
        {"type": "Feature", "id": f"f{i}", "properties": {"name": trap * (i % 3), "deep": {"a": {"b": [{}, {"c": "}"}]}}, "empty": {}}, "geometry": {"type": "Point", "coordinates": [i, -i]} if i % 4 else None}
        for i in range(30)
    ]
    features[7]["properties"]["long"] = "{" * 2000
    collections = [{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x}{"}}, "features": features[:20]}, {"features": features[20:], "type": "FeatureCollection", "note": {"a": {}}}, {"type": "FeatureCollection", "features": []}]
    for i, c in enumerate(collections):
        (tmp_path / f"{i}.geojson").write_text(json.dumps(c, indent=indent, ensure_ascii=False) + "\n")
    names = in_small_ranges(spark, size)
    try:
        found = [json.loads(r["value"]) for r in read_collection(spark, str(tmp_path)).collect()]
    finally:
        for name in names:
            spark.conf.unset(name)
    assert sorted(found, key=lambda f: int(f["id"][1:])) == features



def test_dated_files_and_stale_inputs(spark, tmp_path):
    for name in ("rain_200001.nc", "rain_200002.nc", "notes.txt"):
        (tmp_path / name).write_text(name)
    files = D.input_files(spark, [str(tmp_path), str(tmp_path / "rain_200001.nc")])
    dated = D.dated_files(files, r"rain_(\d{6})\.nc", "yyyyMM")
    assert sorted(r["ts"].month for r in dated.collect()) == [1, 2]
    before = D.fingerprinted(dated, ["ts"], "v1")
    assert D.stale(before, before, ["ts"]).count() == 0
    kept = before.where(F.month("ts") == 1)
    assert [r["ts"].month for r in D.stale(before, kept, ["ts"]).collect()] == [2]
    assert D.stale(D.fingerprinted(dated, ["ts"], "v2"), before, ["ts"]).count() == 2


def test_series_table(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("ID;DATE ; VALUE\n1;2000-02;5\n1;2000-01; 4 \n2;2000-01;9\n1;2000-03;\n1;2000-04;x\n")
    rows = T.read_series_table(spark, str(path), id_column="ID", id_value="1").collect()
    assert [(r["date"], r["value"]) for r in rows] == [("2000-01", 4.0), ("2000-02", 5.0)]
    with pytest.raises(KeyError):
        T.read_series_table(spark, str(path), value_column="nope")


def test_station_file_order_decides(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("id,nm,x,y,d,r\n1,A,1,2,2000-01-01,5\n1,A,1,2,2000-01-01,7\n")
    from parchline.operators.station import clean_observations, latest_per_day

    columns = {"station_id": "id", "station_name": "nm", "lon": "x", "lat": "y", "date": "d", "precip_mm": "r"}
    rows = latest_per_day(clean_observations(T.read_station_days(spark, str(path), columns))).collect()
    assert [r["precip_mm"] for r in rows] == [7.0]


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = upsert(now, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_duplicate_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(i, "x" if i % 2 else f"u{i}") for i in range(200)], "n int, id string").repartition(6)
    got = {r["n"]: r["id"] for r in numbered_duplicates(rows, "id", "n").collect()}
    assert len(got) == 200 and got[0] == "u0" and got[1] == "x_1" and got[199] == "x_100"


def test_store_merges_repeated_keys_by_order_or_refuses_them(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 1, 2, 6.0), ("b", 1, 1, 7.0)], "part string, id int, turn int, v double")
    for _ in range(2):
        store.upsert("t", rows, ["part", "id"], ["part"], "turn")
        assert sorted((r.part, r.v) for r in store.read("t").collect()) == [("a", 6.0), ("b", 7.0)]
    with pytest.raises(ValueError, match="repeated key"):
        store.upsert("t", rows, ["part", "id"], ["part"])
    store.clear("t", {"part": "a"})
    assert [r.part for r in store.read("t").collect()] == ["b"]


def test_checkpoint_folder_of_the_context_comes_first(spark):
    from parchline.session import ensure_checkpoint_dir, shared_folder

    ensure_checkpoint_dir(spark)
    assert shared_folder(spark) == spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def test_repeated_features_are_written_in_many_files(spark, tmp_path, monkeypatch):
    from parchline.workloads import files as W

    every = W.features(spark, "/root/testdata/sf0.001").repartition(4)
    monkeypatch.setattr(W, "features", lambda *_: every)
    monkeypatch.setattr(W, "scratch_path", lambda *_: str(tmp_path / "twice"))
    names = [r["name"] for r in W.import_repeated_features(spark, "").collect()]
    assert len(names) == every.count() and all(n.startswith("last ") for n in names)
    assert len([p for p in (tmp_path / "twice").glob("part-*") if p.stat().st_size]) > 1


def test_many_layers_take_as_many_jobs_as_one(spark, tmp_path):
    """200 layers of two headers: plan branches and jobs follow the headers, not the layers."""
    for i in range(200):
        place = tmp_path / "many" / f"layer_{i}"
        place.mkdir(parents=True)
        (place / "data.csv").write_text("station_id,date,SPI3\n" + f"a,2000-01-15,{i}\n" if i % 2 else "code,year,month,level\n" + f"a,2000,1,{i}\n", encoding="utf-8")
        (place / "geoinfo.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"station_id" if i % 2 else "code": "a"}, "geometry": {"type": "Point", "coordinates": [i / 10, 1]}}]}))
        if i % 3 == 0:
            (place / "metadata.json").write_text(json.dumps({"title": f"Layer {i}"}))
    found = D.layer_folders(spark, str(tmp_path / "many"))
    table = D.read_layers(spark, found)
    assert len(found) == 200 and len(D.grouped_layers(spark, found)) == 2
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    got = {r["dataset_key"]: (r["spi3"], r["level"]) for r in table.collect()}
    assert got == {f"layer_{i}": (float(i), None) if i % 2 else (None, float(i)) for i in range(200)}
    store = TableStore(spark, str(tmp_path / "catalog"))
    import_layers(store, str(tmp_path / "many"), trends=False)
    assert {(r["dataset_key"], r["feature_id"], r["minx"]) for r in store.read("features").collect()} == {(f"layer_{i}", "a", i / 10) for i in range(200)}
    assert {(r["dataset_key"], r["title"], r["geom_type"]) for r in store.read("datasets").collect()} == {(f"layer_{i}", f"Layer {i}" if i % 3 == 0 else f"layer_{i}", "Point") for i in range(200)}


def test_small_collections_are_cut_in_one_pass(spark, tmp_path, monkeypatch):
    """Files of one range need neither the pass over nestings nor one for parts."""
    from parchline.sources import collections

    for number in range(3):
        (tmp_path / f"{number}.geojson").write_text('{"type":"FeatureCollection","features":[' + ",".join('{"type":"Feature","id":"%d-%d","properties":{"t":"} {"},"geometry":null}' % (number, i) for i in range(4)) + "]}")
    monkeypatch.setattr(collections, "_beginnings", lambda ranges: pytest.fail("no range needs its beginning"))
    rows = collections.read_collection(spark, str(tmp_path))
    assert rows.count() == 12
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
