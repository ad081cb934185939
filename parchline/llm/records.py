"""The text view of features that the corpus operators share.

A feature is a row ``(dataset_key, feature_id, name, props, …)``; its free text is one
attribute in ``props``, by default ``description``. ``feature_id`` is text in the
stored tables; any orderable type works and comes back unchanged.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from parchline.session import scratch_path

DESCRIPTION = "description"
LANGUAGE = "language"
KEY = ("dataset_key", "feature_id")


def described(features: DataFrame, attribute: str = DESCRIPTION, *more: str) -> DataFrame:
    """``(dataset_key, feature_id, text, …)``: one attribute as text, null as empty.

    ``more`` names further attributes, which keep their names and their nulls. All other columns of the input,
    whatever they are called, are left behind.
    """
    props = F.col("props")
    return features.select(
        *KEY, F.coalesce(props[attribute], F.lit("")).alias("text"), *[props[m].alias(m) for m in more]
    )


def in_parts(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` bytes in ``column`` (or one row), to bound the Python objects made of them."""
    for batch in batches:
        size = pc.cumulative_sum(pc.binary_length(batch.column(column)).cast(pa.int64())).to_pylist()
        start, done = 0, 0
        for row, total in enumerate(size):
            if total - done > most and row > start:
                yield batch.slice(start, row - start)
                start, done = row, size[row - 1]
        if start < len(size):
            yield batch.slice(start)


def release_memory() -> None:
    """Gives what earlier work of this Python worker has freed back to the system; workers serve many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def schema_of(df: DataFrame, keep: tuple[str, ...], *fields: tuple[str, DataType]) -> StructType:
    """Schema with the columns ``keep`` of ``df`` followed by new fields."""
    return StructType([df.schema[c] for c in keep] + [StructField(n, t) for n, t in fields])


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again: recomputation starts here."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, f"{label}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
