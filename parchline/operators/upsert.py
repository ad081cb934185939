"""Keyed last-write-wins merge of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the largest ``order`` value.

    An aggregate rather than a row number: it is combined before the shuffle, so
    a key repeated in a third of the table does not land in one task.
    """
    payload = [c for c in rows.columns if c not in keys]
    if len(payload) == 2 and order in payload:
        # One plain value: its aggregation buffer fits a hash aggregate, a struct's does not.
        other = next(c for c in payload if c != order)
        best = rows.groupBy(*keys).agg(F.max_by(other, order).alias(other), F.max(order).alias(order))
        return best.select(*rows.columns)
    packed = F.struct(*[F.col(c) for c in payload])
    kept = rows.groupBy(*keys).agg(F.max_by(packed, F.col(order)).alias("_row"))
    return kept.select(*keys, *[F.col("_row")[c].alias(c) for c in payload]).select(*rows.columns)


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of ``incoming`` replace rows of ``current`` with equal keys."""
    fresh = newest_per_key(incoming, keys, order) if order else incoming
    kept = current.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def duplicated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty when the keys identify rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def numbered_duplicates(rows: DataFrame, id_column: str, order: str) -> DataFrame:
    """Give every row whose id is shared a suffix counted over all shared rows.

    The running number spans the table, so it is built from per-partition counts:
    rows are range-partitioned by the order column, numbered inside their
    partition, and shifted by the counts of the partitions before it. The counts
    are one row per partition.
    """
    shared = duplicated_keys(rows, [id_column]).select(id_column)
    doubled = rows.join(shared, id_column, "left_semi")
    single = rows.join(shared, id_column, "left_anti")
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(rows.sparkSession)
    placed = doubled.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")
    ).checkpoint()
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"),
    )
    start_of_part = F.shiftleft(F.col("_part").cast("bigint"), 33)
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(
        id_column,
        F.concat(
            F.col(id_column),
            F.lit("_"),
            (F.col("_offset") + F.col("_seq") - start_of_part + 1).cast("string"),
        ),
    )
    return single.select(*rows.columns).unionByName(numbered.select(*rows.columns))
