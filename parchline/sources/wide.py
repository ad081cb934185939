"""Wide monthly tables: one row per feature and month, one column per index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite

# Header names with a meaning.
ID_CANDIDATES = ("feature_id", "station_id", "region_id", "id", "code", "gid", "fid", "name")
NEVER_INDEX = ("feature_id", "station_id", "region_id", "id", "code")


@dataclass(frozen=True)
class Layout:
    """How a wide file names its id, its month and its indices."""

    id_column: str
    date_mode: str
    date_columns: tuple[str, ...]
    index_columns: tuple[str, ...]


def clean_header(names: Sequence[str]) -> list[str]:
    return [str(n).strip().replace("﻿", "") for n in names]


def infer_layout(names: Sequence[str]) -> Layout:
    """Id column by preference (else the first), month by one of three modes."""
    by_lower: dict[str, str] = {}
    for name in names:
        by_lower.setdefault(name.lower(), name)
    id_column = next((by_lower[c] for c in ID_CANDIDATES if c in by_lower), names[0])
    for mode, needed in (("date", ("date",)), ("year_month", ("year", "month")), ("yyyymm", ("yyyymm",))):
        if all(n in by_lower for n in needed):
            dates = tuple(by_lower[n] for n in needed)
            break
    else:
        raise ValueError("the table needs a 'date', 'year' and 'month', or 'yyyymm' column")
    taken = {id_column.lower(), *NEVER_INDEX, *(d.lower() for d in dates)}
    indices = tuple(n for n in by_lower if n not in taken)
    return Layout(id_column, mode, dates, indices)


def read_table(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Parquet or CSV with cleaned header names."""
    kind = file_format or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    table = reader.format(kind).load(path)
    return table.toDF(*clean_header(table.columns))


def month_of(layout: Layout) -> Column:
    """First day of the row's month; null when it cannot be read."""
    columns = [F.col(f"`{c}`") for c in layout.date_columns]
    if layout.date_mode == "date":
        return F.trunc(F.to_date(columns[0].try_cast("timestamp")), "MM")
    if layout.date_mode == "year_month":
        year, month = (c.try_cast("double").try_cast("int") for c in columns)
    else:
        text = columns[0].cast("string")
        year, month = (F.substring(text, at, size).try_cast("int") for at, size in ((1, 4), (5, 2)))
    return F.when(month.between(1, 12) & year.between(1, 9999), F.make_date(year, month, F.lit(1)))


def normalized(table: DataFrame, indices: Sequence[str] | None = None, layout: Layout | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows keyed by (feature_id, date) with double index columns.

    Rows without id or month are dropped; declared indices the file lacks are null. Columns in
    ``keep`` are carried along.
    """
    plan = layout or infer_layout(table.columns)
    by_lower = {c.lower(): c for c in reversed(table.columns)}
    wanted = [i.strip().lower() for i in (indices if indices is not None else plan.index_columns)]
    columns = [
        finite(F.col(f"`{by_lower[i]}`")).alias(i) if i in by_lower else F.lit(None).cast("double").alias(i)
        for i in wanted
    ]
    return table.select(
        *keep, F.col(f"`{plan.id_column}`").cast("string").alias("feature_id"), month_of(plan).alias("date"), *columns
    ).where(F.col("feature_id").isNotNull() & F.col("date").isNotNull())


def read_wide(spark: SparkSession, path: str, indices: Sequence[str] | None = None) -> DataFrame:
    return normalized(read_table(spark, path), indices)
