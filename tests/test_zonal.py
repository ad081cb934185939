"""Polygon weights against geometry that can be worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchline.functions.geo import EARTH_RADIUS_M
from parchline.operators import zonal as G

SPEC = G.GridSpec(4.0, 0.0, 1.0, 1.0, 4, 5)


def layer(spark, **shapes):
    return spark.createDataFrame(list(shapes.items()), "feature_id string, polygons array<array<array<array<double>>>>")


L_SHAPE = [[0.5, 0.5], [3.5, 0.5], [3.5, 1.5], [1.5, 1.5], [1.5, 3.5], [0.5, 3.5], [0.5, 0.5]]


def covered(spark, polygons):
    rows = G.polygon_weights(layer(spark, a=polygons), SPEC).collect()
    return {r["cell_id"]: r["coverage"] for r in rows}


def test_concave_polygon(spark):
    got = covered(spark, [[L_SHAPE]])
    assert math.isclose(sum(got.values()), 5.0)
    # Cell of row 3 (lat 0..1), column 0: the corner from 0.5 on covers a quarter.
    assert math.isclose(got[15], 0.25) and math.isclose(got[16], 0.5)
    assert 7 not in got and math.isclose(got[12], 0.5)


def test_hole_and_two_parts(spark):
    outer = [[0.0, 0.0], [3.0, 0.0], [3.0, 3.0], [0.0, 3.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [2.0, 1.0], [1.0, 1.0]]
    island = [[4.0, 3.0], [5.0, 3.0], [5.0, 4.0], [4.0, 4.0], [4.0, 3.0]]
    got = covered(spark, [[outer, hole], [island]])
    assert math.isclose(sum(got.values()), 9.0) and 2 * 5 + 1 not in got and math.isclose(got[4], 1.0)


def test_polygon_beyond_the_grid(spark):
    big = [[-10.0, -10.0], [10.0, -10.0], [10.0, 10.0], [-10.0, 10.0], [-10.0, -10.0]]
    assert len(covered(spark, [[big]])) == 20
    away = [[20.0, 20.0], [21.0, 20.0], [21.0, 21.0], [20.0, 20.0]]
    assert covered(spark, [[away]]) == {}


def test_random_triangles_keep_their_area(spark):
    rng = np.random.default_rng(4)
    shapes = {f"t{i}": [[(lambda p: p + p[:1])([[float(x), float(y)] for x, y in zip(rng.uniform(0, 5, 3), rng.uniform(0, 4, 3))])]] for i in range(20)}
    got = {r["feature_id"]: r["s"] for r in G.polygon_weights(layer(spark, **shapes), SPEC).groupBy("feature_id").agg(F.sum("coverage").alias("s")).collect()}
    for name, (((a, b, c, _),),) in shapes.items():
        area = abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2
        assert math.isclose(got[name], area, rel_tol=1e-9)


def test_weights_sum_to_one_and_coverage(spark):
    shapes = layer(spark, a=[[L_SHAPE]], b=[[[[4.0, 0.0], [6.0, 0.0], [6.0, 1.0], [4.0, 1.0], [4.0, 0.0]]]])
    weights = G.polygon_weights(shapes, SPEC)
    totals = G.normalized_weights(weights).groupBy("feature_id").agg(F.sum("weight").alias("t")).collect()
    assert all(math.isclose(r["t"], 1.0) for r in totals)
    cover = {r["feature_id"]: r["spatial_coverage"] for r in G.spatial_coverage(weights, G.polygon_areas(shapes)).collect()}
    assert math.isclose(cover["b"], 0.5, rel_tol=1e-9) and math.isclose(cover["a"], 1.0, rel_tol=1e-3)


def test_sphere_area(spark):
    ring = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, -90.0), (360.0, -90.0), (360.0, 90.0), (0.0, 90.0))])
    area = spark.range(1).select(G.spherical_ring_area(ring)).first()[0]
    assert math.isclose(area, 4 * math.pi * EARTH_RADIUS_M**2, rel_tol=1e-12)


def test_extent(spark):
    cells = spark.createDataFrame([(1.5, 0.5), (0.5, 1.5)], "lat double, lon double")
    spec = G.grid_spec(cells)
    assert spec.extent == (0.0, 0.0, 2.0, 2.0)


def test_zonal_mean_skips_missing_cells(spark):
    weights = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0)], "feature_id string, cell_id long, weight double")
    cells = spark.createDataFrame([(0, "2000-01-01", 4.0), (1, "2000-01-01", None), (0, "2000-02-01", None), (1, "2000-02-01", None)], "cell_id long, date string, value double")
    got = {r["date"]: r["value"] for r in G.zonal_mean(weights, cells).collect()}
    assert got == {"2000-01-01": 4.0, "2000-02-01": None}


def test_duplicate_day_fails(spark):
    slices = spark.sql("select timestamp '2000-02-01 00:00:00' as ts union all select timestamp '2000-02-01 06:00:00'")
    with pytest.raises(Exception, match="Duplicate daily time step"):
        G.complete_months(slices).collect()


def test_leap_february_is_complete(spark):
    days = spark.sql("select explode(sequence(timestamp '2000-02-01 00:00:00', timestamp '2000-02-29 00:00:00', interval 1 day)) as ts")
    assert G.complete_months(days).count() == 1
    assert G.complete_months(days.where("ts < timestamp '2000-02-29'")).count() == 0
