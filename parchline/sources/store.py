"""Tables of a catalog kept as partitioned Parquet folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.upsert import duplicated_keys, newest_per_key, upsert
from ..session import ensure_checkpoint_dir

COMPRESSION = "zstd"


class TableStore:
    """Named Parquet tables below one root folder.

    Writers replace only the partitions they touch (dynamic overwrite): Spark stages
    the new files and swaps them in when the job commits, so a lost executor or a
    failed job leaves the old partitions as they were.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return False
        return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(folder))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        if schema and not self.exists(name):
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", True)
        return reader.parquet(self.path(name))

    def replace(self, name: str, rows: DataFrame, partitions: Sequence[str], sort: Sequence[str] = ()) -> None:
        """Write rows, replacing the partitions they fall in."""
        # REBALANCE lets adaptive execution split a hot partition over several tasks.
        laid = rows.hint("rebalance", *partitions) if partitions else rows
        if sort:
            laid = laid.sortWithinPartitions(*partitions, *sort)
        writer = laid.write.mode("overwrite").option("compression", COMPRESSION)
        if partitions:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
        writer.parquet(self.path(name))

    def write_series(self, rows: DataFrame) -> None:
        """Wide series keyed by (dataset_key, feature_id, date).

        Repeated keys fail the write. Rows are range-partitioned by layer, month and
        feature: a layer holding most rows spreads over many tasks, and row-group
        statistics prune a month.
        """
        ensure_checkpoint_dir(self.spark)
        rows = rows.checkpoint()
        self._refuse_repeated(rows, ["dataset_key", "feature_id", "date"])
        order = ("dataset_key", "date", "feature_id")
        laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        (
            laid.write.mode("overwrite")
            .option("compression", COMPRESSION)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dataset_key")
            .parquet(self.path("series"))
        )

    def upsert(
        self, name: str, incoming: DataFrame, keys: Sequence[str], partitions: Sequence[str], order: str | None = None
    ) -> None:
        """Merge rows by key into the partitions they fall in.

        The partition columns must be part of the key, so that untouched partitions
        cannot hold a row to replace. Of incoming rows with one key the largest ``order`` wins (the column is stored like
        any other); without an order repeated keys fail, and nothing is written.
        """
        ensure_checkpoint_dir(self.spark)
        incoming = (newest_per_key(incoming, keys, order) if order else incoming).checkpoint()
        if order is None:
            self._refuse_repeated(incoming, keys)
        if not self.exists(name):
            self.replace(name, incoming, partitions)
            return
        touched = incoming.select(*partitions).distinct()
        current = self.read(name).join(touched, list(partitions), "left_semi")
        self.replace(name, upsert(current, incoming, keys), partitions)

    def clear(self, name: str, partitions: Mapping[str, str]) -> None:
        """Remove one partition folder, so that a run without rows leaves no old ones; values must be plain names."""
        if not self.exists(name):
            return
        parts = "/".join(f"{c}={v}" for c, v in partitions.items())
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{parts}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    @staticmethod
    def _refuse_repeated(rows: DataFrame, keys: Sequence[str]) -> None:
        clash = duplicated_keys(rows, keys).head(1)
        if clash:
            raise ValueError(f"repeated key {clash[0].asDict()}")

    def append_once(self, name: str, incoming: DataFrame, keys: Sequence[str]) -> None:
        """Append rows whose key is not stored yet."""
        fresh = incoming
        if self.exists(name):
            fresh = incoming.join(self.read(name).select(*keys), list(keys), "left_anti")
        fresh.write.mode("append").option("compression", COMPRESSION).parquet(self.path(name))
