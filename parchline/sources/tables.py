"""Text and delimited inputs: ENSO tables, value series, station files, predictors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_start
from ..functions.numeric import finite
from .wide import clean_header, read_table

MISSING_BELOW = -90.0
DELIMITERS = ",;\t|"


def read_enso_text(spark: SparkSession, path: str) -> DataFrame:
    """Rows of "year v1 … v12" as (date, enso_nino34); other lines and missing marks are skipped."""
    words = F.split(F.trim("value"), r"\s+")
    table = spark.read.text(path).select(words.alias("w")).where((F.size("w") == 13) & F.get("w", F.lit(0)).rlike(r"^\d+$"))
    months = table.select(
        F.get("w", F.lit(0)).try_cast("int").alias("year"), F.posexplode(F.slice("w", 2, 12)).alias("at", "raw")
    )
    return months.select(
        F.make_date("year", F.col("at") + 1, F.lit(1)).alias("date"), finite(F.col("raw")).alias("enso_nino34")
    ).where(F.col("enso_nino34") >= MISSING_BELOW)


def read_enso_table(spark: SparkSession, path: str) -> DataFrame:
    table = read_table(spark, path)
    if not {"date", "enso_nino34"} <= set(table.columns):
        raise ValueError("the ENSO file needs 'date' and 'enso_nino34' columns")
    return table.select(
        month_start(F.col("date").try_cast("timestamp")).alias("date"), finite(F.col("enso_nino34")).alias("enso_nino34")
    ).where(F.col("date").isNotNull())


def read_predictors(spark: SparkSession, path: str, source_key: str) -> DataFrame:
    """Monthly predictors of one source, matched without regard to case."""
    table = read_table(spark, path)
    if "date" not in table.columns:
        raise ValueError(f"{path} must contain a date column")
    if "source_key" in table.columns:
        table = table.where(F.lower(F.col("source_key").cast("string")) == source_key.lower())
    numbers = [c for c in table.columns if c not in ("date", "source_key")]
    return table.select(
        month_start(F.col("date").try_cast("timestamp")).alias("date"),
        F.lit(source_key).alias("source_key"),
        *[finite(F.col(f"`{c}`")).alias(c) for c in numbers],
    )


def guess_delimiter(header: str) -> str:
    """The candidate that occurs most in the header line; a comma when none does."""
    best = max(DELIMITERS, key=header.count)
    return best if header.count(best) else ","


def read_series_table(
    spark: SparkSession,
    path: str,
    value_column: str = "VALUE",
    date_column: str | None = "DATE",
    id_column: str | None = None,
    id_value: str | None = None,
    delimiter: str | None = None,
) -> DataFrame:
    """Usable rows (date text, value), in date order; unreadable numbers are skipped."""
    sep = delimiter or guess_delimiter(spark.read.text(path).head(1)[0][0])
    table = spark.read.option("header", True).option("sep", sep).csv(path)
    table = table.toDF(*clean_header(table.columns))
    if value_column not in table.columns:
        raise KeyError(f"Value column '{value_column}' not found. Available columns: {table.columns}")
    if id_column is not None and id_value is not None:
        if id_column not in table.columns:
            raise KeyError(f"ID column '{id_column}' not found in table.")
        table = table.where(F.trim(F.col(f"`{id_column}`")) == str(id_value))
    has_date = date_column is not None and date_column in table.columns
    date = F.trim(F.col(f"`{date_column}`")) if has_date else F.lit(None).cast("string")
    rows = table.select(date.alias("date"), F.trim(F.col(f"`{value_column}`")).try_cast("double").alias("value"))
    return rows.where(F.col("value").isNotNull()).orderBy(F.col("date").asc_nulls_first())


def read_number_lines(spark: SparkSession, path: str) -> DataFrame:
    """Texts of numbers as (n, value), numbered from 1 over all files, in order of their names.

    Numbers may share lines. Files are read in ranges; each is numbered by itself, and starts after as many numbers as all ranges before it
    hold.
    """
    lines = spark.read.text(path).select("value", *_place())
    words = lines.where(F.trim("value") != "").select(
        "file", "block", "line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "word")
    )
    # One row per range of some megabytes.
    ranges = words.groupBy("file", "block").agg(F.count("*").alias("numbers"))
    files = ranges.groupBy("file").agg(F.sum("numbers").alias("numbers"))
    earlier = lambda order: F.coalesce(F.sum("numbers").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = files.select("file", earlier(Window.orderBy("file")).alias("in_files"))
    starts = ranges.select("file", "block", earlier(Window.partitionBy("file").orderBy("block")).alias("in_ranges")).join(before, "file")
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("line", "at"))
    placed = words.withColumn("within", within).join(starts, ["file", "block"])
    return placed.select((F.col("in_files") + F.col("in_ranges") + F.col("within")).cast("bigint").alias("n"), F.col("word").cast("double").alias("value"))


def _place() -> list[Column]:
    """Where a row came from; its order within one file is (block, line)."""
    return [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    ]


def read_station_days(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """Daily station rows from CSV: only the named columns are parsed.

    ``columns`` maps station_id, station_name, lon, lat, date, precip_mm and
    optionally station_elevation and seq to header names. Without a seq column the
    order in the files is used.
    """
    raw = spark.read.option("header", True).csv(path)
    placed = raw.select(*[F.col(f"`{c}`") for c in raw.columns], F.struct(*_place()).alias("_place"))
    table = placed.toDF(*clean_header(raw.columns), "_place")
    picked = {name: F.col(f"`{header}`") for name, header in columns.items()}
    picked.setdefault("station_elevation", F.lit(None).cast("double"))
    seq = picked.pop("seq", None)
    order = F.col("_place") if seq is None else seq.try_cast("bigint")
    return table.select(*[c.alias(name) for name, c in picked.items()], order.alias("seq"))
