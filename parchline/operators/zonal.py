"""Grid cells, polygon-cell weights and zonal means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import days_in_month, month_start
from ..functions.geo import EARTH_RADIUS_M, cell_area_m2
from ..functions.numeric import finite, to_millimetres

# Shares of a cell below this are rounding errors of sums.
LEAST_COVERAGE = 1e-12


@dataclass(frozen=True)
class GridSpec:
    """A regular grid: row 0 is northernmost, column 0 westernmost."""

    north: float
    west: float
    dlat: float
    dlon: float
    rows: int
    cols: int

    @property
    def extent(self) -> tuple[float, float, float, float]:
        return (
            self.west,
            self.north - self.rows * self.dlat,
            self.west + self.cols * self.dlon,
            self.north,
        )

    def lat(self, row: Column) -> Column:
        return F.lit(self.north) - (row + 0.5) * self.dlat

    def cell_id(self, row: Column, col: Column) -> Column:
        return row.cast("bigint") * self.cols + col


def _axis(cells: DataFrame, column: str) -> tuple[Column, Column, Column, Column]:
    """Smallest and largest centre, median spacing and size of one axis (an aggregate)."""
    centres = F.array_sort(F.collect_set(column))
    size = F.size(centres)
    gaps = F.array_sort(
        F.zip_with(F.slice(centres, F.lit(2), size), F.slice(centres, F.lit(1), size - 1), lambda a, b: a - b)
    )
    count = F.size(gaps)
    middle = (F.get(gaps, F.floor((count - 1) / 2).cast("int")) + F.get(gaps, F.floor(count / 2).cast("int"))) / 2
    return F.array_min(centres), F.array_max(centres), middle, size


def grid_extent(cells: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row: outer edges of the grid from its cell centres.

    The distinct centres of an axis are bounded by the grid's resolution.
    """
    south, north, dy, rows = _axis(cells, lat)
    west, east, dx, cols = _axis(cells, lon)
    return cells.agg(
        (west - dx / 2).alias("minx"),
        (south - dy / 2).alias("miny"),
        (east + dx / 2).alias("maxx"),
        (north + dy / 2).alias("maxy"),
        dy.alias("dlat"),
        dx.alias("dlon"),
        rows.alias("rows"),
        cols.alias("cols"),
    )


def grid_spec(cells: DataFrame, lat: str = "lat", lon: str = "lon") -> GridSpec:
    one = grid_extent(cells, lat, lon).first()
    return GridSpec(one["maxy"], one["minx"], one["dlat"], one["dlon"], one["rows"], one["cols"])


def monthly_cells(slices: DataFrame, keys: tuple[str, ...] = ("lat_idx", "lon_idx")) -> DataFrame:
    """Monthly depth per cell; null only where no slice has a finite value.

    Needs columns ts, value, units and seconds.
    """
    depth = to_millimetres(finite(F.col("value")), F.col("units"), F.col("seconds"))
    return slices.groupBy(*keys, month_start(F.col("ts")).alias("date")).agg(F.sum(depth).alias("value"))


def month_completeness(slices: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per month of daily slices: how many, on how many days, and whether it is complete.

    The cells of a slice are combined before the shuffle, so only (day, slice)
    pairs travel.
    """
    per_slice = slices.groupBy(*keys, F.col("ts")).agg(F.count("*").alias("cells"))
    per_day = per_slice.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.count("*").alias("slices"))
    per_month = per_day.groupBy(*keys, month_start(F.col("day")).alias("date")).agg(
        F.sum("slices").alias("slices"), F.count("*").alias("days")
    )
    return per_month.withColumn("has_duplicates", F.col("slices") != F.col("days")).withColumn(
        "complete", F.col("days") == days_in_month(F.col("date"))
    )


def complete_months(slices: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Months with every day; a day that occurs twice fails the job."""
    checked = month_completeness(slices, keys)
    label = F.concat(F.lit("Duplicate daily time step(s) in "), F.date_format("date", "yyyy-MM"))
    sound = F.when(F.col("has_duplicates"), F.raise_error(label).cast("boolean")).otherwise(F.col("complete"))
    return checked.where(sound).select(*keys, "date")


def _span(low: Column, high: Column, origin: float, step: float, count: int) -> tuple[Column, Column]:
    """First and last cell index a closed interval reaches, kept on the grid."""
    first = F.floor((low - origin) / step)
    last = F.ceil((high - origin) / step) - 1
    return F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(count - 1)).cast("int")


def _indices(first: Column, last: Column) -> Column:
    return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))


def _overlap(low: Column, high: Column, cell_low: Column, step: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(high, cell_low + step) - F.greatest(low, cell_low))


def box_weights(boxes: DataFrame, grid: GridSpec, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """Coverage fraction and area weight of every cell a box touches (no join, no UDF).

    Needs columns minx, miny, maxx, maxy.
    """
    # Rows count down from the north, so distances are measured southwards.
    top, bottom = F.lit(grid.north) - F.col("maxy"), F.lit(grid.north) - F.col("miny")
    row_first, row_last = _span(top, bottom, 0.0, grid.dlat, grid.rows)
    col_first, col_last = _span(F.col("minx"), F.col("maxx"), grid.west, grid.dlon, grid.cols)
    rows = boxes.withColumn("lat_idx", _indices(row_first, row_last))
    cells = rows.withColumn("lon_idx", _indices(col_first, col_last))
    tall = _overlap(top, bottom, F.col("lat_idx") * grid.dlat, grid.dlat)
    wide = _overlap(F.col("minx"), F.col("maxx"), F.lit(grid.west) + F.col("lon_idx") * grid.dlon, grid.dlon)
    return _weighted(cells.withColumn("coverage", tall * wide / (grid.dlat * grid.dlon)), grid, keys)


def _weighted(cells: DataFrame, grid: GridSpec, keys: tuple[str, ...]) -> DataFrame:
    area = cell_area_m2(grid.lat(F.col("lat_idx")), F.lit(grid.dlat), F.lit(grid.dlon))
    return cells.where(F.col("coverage") > 0).select(
        *keys,
        grid.cell_id(F.col("lat_idx"), F.col("lon_idx")).alias("cell_id"),
        "coverage",
        (F.col("coverage") * area).alias("weight"),
    )


def polygon_rings(features: DataFrame, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """One row per ring with sign +1 (outer) or -1 (hole).

    Needs column polygons: array of polygons, each an array of rings.
    """
    parts = features.select(*keys, F.explode("polygons").alias("_polygon"))
    return parts.select(*keys, F.posexplode("_polygon").alias("_ring_no", "ring")).select(
        *keys, F.when(F.col("_ring_no") == 0, 1).otherwise(-1).alias("sign"), "ring"
    )


def _edges(rings: DataFrame, grid: GridSpec, keys: tuple[str, ...]) -> DataFrame:
    """Edges of the rings in cell units, from their upper to their lower end, with a sign.

    ``u`` counts columns from the west and ``v`` rows from the north. The sign is that of the ring (outer or hole), of its
    direction and of the edge's, so that sums over a polygon's edges give covered area.
    """
    points = F.transform(
        "ring",
        lambda p: F.struct(
            ((F.get(p, F.lit(0)) - grid.west) / grid.dlon).alias("u"), ((F.lit(grid.north) - F.get(p, F.lit(1))) / grid.dlat).alias("v")
        ),
    )
    ahead = F.concat(F.slice("points", F.lit(2), F.size("points")), F.slice("points", 1, 1))
    pairs = F.zip_with("points", ahead, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    turn = F.aggregate("pairs", F.lit(0.0), lambda total, e: total + e["p"]["u"] * e["q"]["v"] - e["q"]["u"] * e["p"]["v"])
    paired = rings.select(*keys, "sign", points.alias("points")).select(*keys, "sign", pairs.alias("pairs"))
    edges = paired.select(*keys, (F.col("sign") * F.signum(turn)).alias("sign"), F.explode("pairs").alias("e"))
    p, q = F.col("e.p"), F.col("e.q")
    down = q["v"] > p["v"]
    upper, lower = F.when(down, p).otherwise(q), F.when(down, q).otherwise(p)
    # Level edges cover nothing.
    return edges.where(p["v"] != q["v"]).select(
        *keys, (F.col("sign") * F.when(down, 1).otherwise(-1)).alias("sign"),
        upper["u"].alias("u0"), upper["v"].alias("v0"), lower["u"].alias("u1"), lower["v"].alias("v1"),
    )


def polygon_weights(features: DataFrame, grid: GridSpec, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """Coverage fraction and area weight of every cell a polygon touches.

    A cell is covered as far as the edges to its right, taken with their signs, pass by its height; an edge inside the
    cell counts up to where it runs. So every edge is split at the rows and columns it crosses, its parts are summed
    per cell (combined before the shuffle), and a running sum along each row, from the east, fills the cells between.
    All terms add up, so holes and parts need nothing more, and no ring is copied or gathered.
    """
    edges = _edges(polygon_rings(features, keys), grid, keys)
    u0, v0, v1 = F.col("u0"), F.col("v0"), F.col("v1")
    row_first = F.greatest(F.floor(v0), F.lit(0)).cast("int")
    row_last = F.least(F.ceil(v1) - 1, F.lit(grid.rows - 1)).cast("int")
    row = F.col("lat_idx")
    slope = (F.col("u1") - u0) / (v1 - v0)
    upper, lower = F.greatest(v0, row.cast("double")), F.least(v1, row + 1.0)
    x0, x1 = u0 + (upper - v0) * slope, u0 + (lower - v0) * slope
    bands = edges.withColumn("lat_idx", _indices(row_first, row_last)).select(
        *keys, "sign", "lat_idx", (lower - upper).alias("height"), F.least(x0, x1).alias("low"), F.greatest(x0, x1).alias("high")
    )
    low, high = F.col("low"), F.col("high")
    # Column ``cols`` stands for everything east of the grid; what lies west of it covers no cell.
    col_first = F.least(F.greatest(F.floor(low), F.lit(0)), F.lit(grid.cols)).cast("int")
    col_last = F.least(F.greatest(F.ceil(high) - 1, F.floor(low)), F.lit(grid.cols)).cast("int")
    col = F.col("lon_idx")
    east = col == grid.cols
    start, end = F.greatest(low, col.cast("double")), F.when(east, high).otherwise(F.least(high, col + 1.0))
    height = F.col("sign") * F.col("height") * F.when(high > low, (end - start) / F.nullif(high - low, F.lit(0.0))).otherwise(1.0)
    parts = bands.withColumn("lon_idx", _indices(col_first, col_last)).select(
        *keys, "lat_idx", "lon_idx", height.alias("passed"), F.when(east, 0.0).otherwise(height * ((start + end) / 2 - col)).alias("inside")
    )
    met = parts.groupBy(*keys, "lat_idx", "lon_idx").agg(F.sum("passed").alias("passed"), F.sum("inside").alias("inside"))
    along = Window.partitionBy(*keys, "lat_idx").orderBy(F.col("lon_idx").desc())
    summed = met.select(
        *keys, "lat_idx", "lon_idx", "inside", "passed", F.sum("passed").over(along).alias("after"),
        F.coalesce(F.lead("lon_idx").over(along), F.lit(-1)).alias("west"),
    )
    own = F.struct(F.col("lon_idx").alias("col"), (F.col("after") - F.col("passed") + F.col("inside")).alias("coverage"))
    # Cells between this one and the next to the west have no edge of their own.
    gaps = summed.withColumn(
        "cells",
        F.concat(
            F.array(own),
            F.when(
                (F.abs("after") > LEAST_COVERAGE) & (F.col("west") + 1 <= F.col("lon_idx") - 1),
                F.transform(F.sequence(F.col("west") + 1, F.col("lon_idx") - 1), lambda c: F.struct(c.alias("col"), F.col("after").alias("coverage"))),
            ).otherwise(F.array().cast("array<struct<col:int,coverage:double>>")),
        ),
    )
    cells = gaps.select(*keys, "lat_idx", F.explode("cells").alias("c")).select(
        *keys, "lat_idx", F.col("c.col").alias("lon_idx"), F.least(F.col("c.coverage"), F.lit(1.0)).alias("coverage")
    )
    return _weighted(cells.where((F.col("lon_idx") < grid.cols) & (F.col("coverage") > LEAST_COVERAGE)), grid, keys)


def spherical_ring_area(ring: Column) -> Column:
    """Area on the sphere enclosed by a ring of [lon, lat] points (exact for boxes)."""
    edges = F.zip_with(
        ring,
        F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)),
        lambda a, b: F.radians(F.get(b, F.lit(0)) - F.get(a, F.lit(0)))
        * (F.sin(F.radians(F.get(a, F.lit(1)))) + F.sin(F.radians(F.get(b, F.lit(1)))) + 2.0),
    )
    total = F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + e)
    return F.abs(total) * (EARTH_RADIUS_M**2 / 2)


def polygon_areas(features: DataFrame, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    return polygon_rings(features, keys).groupBy(*keys).agg(
        F.sum(F.col("sign") * spherical_ring_area(F.col("ring"))).alias("area")
    )


def box_area(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.radians(maxx - minx) * (F.sin(F.radians(maxy)) - F.sin(F.radians(miny))) * (EARTH_RADIUS_M**2)


def spatial_coverage(weights: DataFrame, areas: DataFrame, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """Share of each polygon the grid covers, between 0 and 1 (0 off the grid)."""
    met = weights.groupBy(*keys).agg(F.sum("weight").alias("met"))
    share = F.when(F.col("area") > 0, F.coalesce(F.col("met"), F.lit(0.0)) / F.col("area")).otherwise(0.0)
    return areas.join(met, list(keys), "left").select(
        *keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("spatial_coverage")
    )


def normalized_weights(weights: DataFrame, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """Weights summing to one per polygon; totals are aggregated before they are joined back."""
    totals = weights.groupBy(*keys).agg(F.sum("weight").alias("_total"))
    return weights.join(totals, list(keys)).select(
        *keys, "cell_id", "coverage", (F.col("weight") / F.col("_total")).alias("weight")
    )


def eligible_features(coverage: DataFrame, minimum: float) -> DataFrame:
    return coverage.where(F.col("spatial_coverage") >= minimum)


def zonal_mean(weights: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """Weighted mean of the cells with a value, per feature and month.

    Needs cells with columns cell_id, date, value. A month with no valid cell of a
    feature has a null value.
    """
    valid = F.when(F.col("value").isNotNull(), F.col("weight"))
    joined = weights.select(*keys, "cell_id", "weight").join(cells, "cell_id")
    summed = joined.groupBy(*keys, "date").agg(
        F.sum(F.col("weight") * F.col("value")).alias("_top"), F.sum(valid).alias("_bottom")
    )
    return summed.select(*keys, "date", F.when(F.col("_bottom") > 0, F.col("_top") / F.col("_bottom")).alias("value"))
