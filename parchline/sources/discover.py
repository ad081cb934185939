"""Find layers and input files through the Hadoop file system."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import valid_dataset_key
from ..functions.text import slug_text
from .wide import clean_header, infer_layout, normalized, read_table

# File names of a layer folder, preferred first.
DATA_FILES = ("data.parquet", "data.csv")
GEO_FILES = ("geoinfo.parquet", "geoinfo.geojson")
METADATA_FILE = "metadata.json"
SINGLE_LAYER = "station"
KEY_COLUMN = "__layer"
BOUNDARY_SUFFIXES = (".shp", ".gpkg", ".geojson", ".json")


@dataclass(frozen=True)
class LayerFolder:
    dataset_key: str
    data: str
    geo: str
    metadata: str | None
    geo_lines: bool = False


def _listing(spark: SparkSession, path: str) -> dict[str, bool]:
    """Names in a folder and whether each is a folder."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    return {s.getPath().getName(): s.isDirectory() for s in fs.listStatus(folder)}


def _layer(spark: SparkSession, key: str, path: str) -> LayerFolder | None:
    names = _listing(spark, path)
    data = next((f for f in DATA_FILES if f in names), None)
    geo = next((f for f in GEO_FILES if f in names), None)
    if not data or not geo:
        return None
    meta = f"{path}/{METADATA_FILE}" if METADATA_FILE in names else None
    # GeoJSON written by Spark is a folder of files with one feature per line.
    return LayerFolder(key, f"{path}/{data}", f"{path}/{geo}", meta, names[geo])


def layer_folders(
    spark: SparkSession, base: str, only: Iterable[str] | None = None, need_metadata: bool = False
) -> list[LayerFolder]:
    """Layer folders below ``base``; a base that is itself a layer is the only one."""
    base = base.rstrip("/")
    single = _layer(spark, SINGLE_LAYER, base)
    if single:
        found = [single]
    else:
        children = sorted(n for n, is_dir in _listing(spark, base).items() if is_dir and not n.startswith("."))
        layers = (_layer(spark, name, f"{base}/{name}") for name in children)
        found = [layer for layer in layers if layer]
        for layer in found:
            valid_dataset_key(layer.dataset_key)
    if only is not None:
        wanted = {k.lower() for k in only}
        found = [f for f in found if f.dataset_key.lower() in wanted]
    return [f for f in found if f.metadata or not need_metadata]


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names and types of a layer's data, from the head of one file and without a job; text files have no types."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    file = folder
    if fs.getFileStatus(folder).isDirectory():
        parts = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        if not parts:
            raise ValueError(f"no data in {path}")
        file = jvm.org.apache.hadoop.fs.Path(parts[0])
    if path.lower().endswith(".csv"):
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(file), "UTF-8"))
        try:
            return (reader.readLine() or "",)
        finally:
            reader.close()
    footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
    try:
        return tuple(str(f) for f in footer.getFooter().getFileMetaData().getSchema().getFields())
    finally:
        footer.close()


@dataclass(frozen=True)
class LayerGroup:
    """Layers whose data have one format and header, so that one scan reads them all."""

    layers: tuple[LayerFolder, ...]
    columns: tuple[str, ...]

    @property
    def id_column(self) -> str:
        return infer_layout(self.columns).id_column


def grouped_layers(spark: SparkSession, layers: Iterable[LayerFolder]) -> list[LayerGroup]:
    """Layers by format and header; only heads of files are read."""
    groups: dict[tuple, list[LayerFolder]] = {}
    for layer in layers:
        groups.setdefault((layer.data.rsplit(".", 1)[-1], header_of(spark, layer.data)), []).append(layer)
    return [LayerGroup(tuple(own), tuple(read_table(spark, own[0].data).columns)) for own in groups.values()]


def layer_key(layers: Sequence[LayerFolder], file: Column) -> Column:
    """The layer a file belongs to: the folder above its data or features."""
    if len(layers) == 1:
        return F.lit(layers[0].dataset_key)
    return F.regexp_extract(file, r"/([A-Za-z0-9_]+)/(?:data|geoinfo|metadata)\.[a-z]+(?:/|$)", 1)


def read_layers(spark: SparkSession, layers: Iterable[LayerFolder]) -> DataFrame:
    """All layers as one table; indices a layer lacks are null. One scan reads all layers of one format and header."""
    frames = []
    for group in grouped_layers(spark, layers):
        csv = group.layers[0].data.lower().endswith(".csv")
        reader = spark.read.option("header", True) if csv else spark.read
        table = reader.format("csv" if csv else "parquet").load([layer.data for layer in group.layers])
        named = table.select(layer_key(group.layers, F.col("_metadata.file_path")).alias(KEY_COLUMN), *[F.col(f"`{c}`") for c in table.columns])
        named = named.toDF(KEY_COLUMN, *clean_header(table.columns))
        frames.append(normalized(named, layout=infer_layout(clean_header(table.columns)), keep=(KEY_COLUMN,)).withColumnRenamed(KEY_COLUMN, "dataset_key"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def input_files(spark: SparkSession, paths: Iterable[str], pattern: str = "*") -> DataFrame:
    """Distinct input files with size and time: folders are walked, globs expanded.

    Listing is done by the data source; file contents are not read.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(list(paths))
    )
    return listed.select("path", "length", "modificationTime").distinct()


def inventory(files: DataFrame, source: str = "source_key") -> DataFrame:
    """Files and bytes per source."""
    return files.groupBy(source).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def boundary_layers(files: DataFrame, root: str) -> DataFrame:
    """Boundary files below a root with key and title from their place in it.

    A file in a folder of the same name is named by the folder alone.
    """
    relative = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1), r"\.[^./]+$", "")
    parts = F.split(relative, "/")
    count = F.size(parts)
    doubled = (count > 1) & (
        F.lower(F.element_at(parts, -1)) == F.lower(F.get(parts, count - 2))
    )
    named = F.when(doubled, F.slice(parts, F.lit(1), count - 1)).otherwise(parts)
    from ..functions.text import slug

    kept = files.where(F.lower("path").rlike(r"\.(shp|gpkg|geojson|json)$"))
    return kept.select(
        slug(F.concat_ws("_", named)).alias("boundary_key"), F.concat_ws(" / ", named).alias("boundary_title"), "path"
    )


def dated_files(files: DataFrame, pattern: str, date_format: str) -> DataFrame:
    """Files whose name carries a date; the others are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    stamp = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return files.withColumn("ts", F.try_to_timestamp(stamp, F.lit(date_format))).where(F.col("ts").isNotNull())


def fingerprinted(files: DataFrame, keys: Iterable[str], *settings: str) -> DataFrame:
    """One digest per group over its files' path, size and time, and the run settings.

    Files are hashed one by one and combined by count, xor and sum, which need no
    order and no list: a group of any size is combined before the shuffle.
    """
    facts = ("path", "length", F.unix_micros(F.col("modificationTime").cast("timestamp")))
    first, second = F.xxhash64(*facts), F.xxhash64(F.lit("second"), *facts)
    combined = (F.count("*"), F.bit_xor(first), F.sum(second.cast("decimal(20,0)")))
    text = F.concat_ws("|", *[F.lit(s) for s in settings], *[c.cast("string") for c in combined])
    return files.groupBy(*keys).agg(F.sha2(text, 256).alias("fingerprint"))


def stale(current: DataFrame, manifest: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Groups that are new or whose digest changed since the manifest was written."""
    return current.join(manifest.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


def dataset_key(source: str, boundary: str, scale: int) -> str:
    return slug_text(f"{source}_{boundary}_spi{scale}")
