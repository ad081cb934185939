"""Boxes derived from the extent of a feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How the two derived boxes of a level share the parent's extent.
X_SHIFT, Y_SHIFT, Y_REACH = 0.6, 0.4, 0.6


def subregions(features: DataFrame, levels: Sequence[str], parts: int = 2) -> DataFrame:
    """Two smaller boxes per feature and level, placed along its diagonal."""
    spread = features.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn(
        "part", F.explode(F.sequence(F.lit(1), F.lit(parts)))
    )
    half_x, half_y = (F.col("maxx") - F.col("minx")) / 2, (F.col("maxy") - F.col("miny")) / 2
    before = F.col("part") - 1
    return spread.withColumns(
        {
            "minx": F.col("minx") + before * half_x * X_SHIFT,
            "miny": F.col("miny") + before * half_y * Y_SHIFT,
            "maxx": F.col("minx") + F.col("part") * half_x,
            "maxy": F.col("miny") + F.col("part") * half_y * Y_REACH,
        }
    )


def seeded_series(series: DataFrame, regions: DataFrame, level: str) -> DataFrame:
    """Rows of a series named by region, with the ``region_id`` of the region of that name and level.

    ``series`` has ``region_name``, ``regions`` has ``region_id``, ``name`` and ``level``. Rows under a name that no
    region of the level has are dropped.
    """
    known = regions.where(F.col("level") == level).select("region_id", F.col("name").alias("region_name"))
    return series.join(known, "region_name")
