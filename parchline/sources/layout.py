"""Feature tables laid out in an order, with a directory of what each file holds.

A viewport or a page then reads only the files it needs: the directory has one row per file and layer with its number of rows, its
least and greatest key and its extent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HILBERT_BITS = 16
EXTENT = ("minx", "miny", "maxx", "maxy")


def hilbert_cell(x: Column, y: Column, bits: int = HILBERT_BITS) -> Column:
    """Place on a Hilbert curve of a point in degrees: near places are near each other on the map."""
    side = 1 << bits
    on_grid = lambda v, low, span: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((v - low) / span * side))).cast("bigint")
    start = F.struct(on_grid(x, -180.0, 360.0).alias("x"), on_grid(y, -90.0, 180.0).alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(state: Column, bit: Column) -> Column:
        half = F.pow(F.lit(2.0), bit).cast("bigint")
        right, upper = (state["x"].bitwiseAND(half) > 0).cast("bigint"), (state["y"].bitwiseAND(half) > 0).cast("bigint")
        d = state["d"] + half * half * (right * 3).bitwiseXOR(upper)
        # Lower quarters are turned, the right one of them also mirrored.
        mirrored = (upper == 0) & (right == 1)
        mx = F.when(mirrored, F.lit(side - 1) - state["x"]).otherwise(state["x"])
        my = F.when(mirrored, F.lit(side - 1) - state["y"]).otherwise(state["y"])
        return F.struct(F.when(upper == 0, my).otherwise(state["x"]).alias("x"), F.when(upper == 0, mx).otherwise(state["y"]).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["d"]


class LaidOutFeatures:
    """Features in files of one order: along a Hilbert curve for viewports, or by key for pages."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, order: Sequence[Column | str], files: int | None = None) -> None:
        """Rows of several layers (dataset_key, feature_id and, for viewports, an extent), sorted over all files, and their directory."""
        ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
        ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/rows")
        table = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows")
        extent = [f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), EXTENT, strict=True) if c in rows.columns]
        directory = table.groupBy(F.col("_metadata.file_path").alias("file"), "dataset_key").agg(
            F.count("*").alias("rows"), F.min("feature_id").alias("least"), F.max("feature_id").alias("most"), *extent
        )
        directory.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/directory")

    def directory(self, dataset_key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/directory").where(F.col("dataset_key") == dataset_key)

    def _rows(self, files: Sequence[str], dataset_key: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files).where(F.col("dataset_key") == dataset_key)

    def in_box(self, dataset_key: str, box: tuple[float, float, float, float]) -> DataFrame:
        """Features of a layer whose extent meets the box (minx, miny, maxx, maxy)."""
        minx, miny, maxx, maxy = box
        meets = (F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)
        files = [r["file"] for r in self.directory(dataset_key).where(meets).select("file").collect()]
        return self._rows(files, dataset_key).where(meets)

    def page(self, dataset_key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Rows of a layer laid out by key, from ``offset`` on, ``limit`` of them (None: all), with ``total`` and ``truncated``.

        Counts per file say where the page begins and ends, so the files before and after are not read.
        """
        if offset < 0 or (limit is not None and limit < 1):
            raise ValueError(f"no page of {limit} rows from {offset}")
        listed = self.directory(dataset_key).select("file", "rows").orderBy("least", "most").collect()
        total, end = sum(r["rows"] for r in listed), None if limit is None else offset + limit
        files, skipped, at = [], 0, 0
        for row in listed:
            if at + row["rows"] <= offset:
                skipped = at + row["rows"]
            elif end is None or at < end:
                files.append(row["file"])
            at += row["rows"]
        rows = self._rows(files, dataset_key)
        if files and offset > skipped:
            # The page begins within its first file.
            first = self._rows(files[:1], dataset_key).select("feature_id").orderBy("feature_id").offset(offset - skipped).limit(1).collect()
            rows = rows.where(F.col("feature_id") >= F.lit(first[0]["feature_id"]))
        rows = rows.orderBy("feature_id") if limit is None else rows.orderBy("feature_id").limit(limit)
        return rows.withColumns({"total": F.lit(total).cast("bigint"), "truncated": F.lit(end is not None and total > end)})
