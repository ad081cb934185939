"""Merkle manifest of layers: a digest per feature, a root per layer, a root of all, and a proof for every feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import DESCRIPTION, LANGUAGE, written

# Nodes of a run, as binary digits of a place, and runs of runs that one row nests.
RUN_BITS = 4
BLOCK_LEVELS = 3
PART_BITS = 33
STEPS = "array<struct<left:string,right:string>>"


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value with its length before it, so that no two lists of values read alike; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(props: Column, attributes: tuple[str, ...], text: str) -> Column:
    """The digest of a feature: its key, its layer, further attributes and its text."""
    return hashed(F.concat(field(F.col("feature_id")), field(F.col("dataset_key")), *[field(props[a]) for a in attributes], field(props[text])))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def numbered(rows: DataFrame, group: str | None, order: tuple[str, ...], label: str) -> DataFrame:
    """``rows`` with ``place``, their rank from 0 in their group, and ``size``, the rows of the group.

    Rows are sorted by ranges over all tasks, so a group may be of any size; only one row per group and task goes on
    to be added up. Equal rows of different tasks are told apart by their task, so that they too spread.
    """
    keys = ([group] if group else []) + list(order)
    ranged = rows.withColumn("task", F.spark_partition_id())
    ranged = ranged.repartitionByRange(*[F.col(k).asc_nulls_first() for k in [*keys, "task"]]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    table = written(ranged.drop("task").withColumn("at", F.monotonically_increasing_id()), label)
    table = table.withColumn("part", F.shiftright("at", PART_BITS)).withColumn("one", F.col(group) if group else F.lit(0))
    parts = table.groupBy("one", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("one")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The window's sum of the whole group is of one row per task.
    parts = parts.select("one", "part", "first", before.alias("before"), F.sum("n").over(own).alias("size")).alias("p")
    found = table.alias("t").join(parts, same(F.col("t.one"), F.col("p.one")) & (F.col("t.part") == F.col("p.part")))
    return found.select("t.*", "p.size", (F.col("at") - F.col("first") + F.col("before")).alias("place")).drop("at", "part", "one")


def rolled(nodes: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """Nodes ``(layer, place, size, hash, …)`` as one row per block, ``(layer, size, block, hash, kids)``, children nested in their runs.

    The digits of a place are grouped away one after the other, the last first. A level is only there where its layer
    has more than one node on it; elsewhere the only child goes up as it is.
    """
    digit = lambda level: F.shiftright("place", RUN_BITS * level).bitwiseAND((1 << RUN_BITS) - 1).cast("int").alias(f"digit{level}")
    block = F.shiftright("place", RUN_BITS * BLOCK_LEVELS).alias("block")
    dealt = nodes.select("layer", "size", block, *[digit(level) for level in range(BLOCK_LEVELS)], "hash", *kept).repartition("layer", "block")
    payload = tuple(kept)
    for level in range(BLOCK_LEVELS):
        child = F.struct(F.col(f"digit{level}").alias("digit"), "hash", *payload)
        kids = F.array_sort(F.collect_list(child))
        dealt = dealt.groupBy("layer", "size", "block", *[f"digit{up}" for up in range(level + 1, BLOCK_LEVELS)]).agg(kids.alias("kids"))
        hashes = F.array_join(F.col("kids.hash"), "")
        dealt = dealt.withColumn("hash", F.when(F.col("size") > (1 << (RUN_BITS * level)), hashed(hashes)).otherwise(F.col("kids")[0]["hash"]))
        payload = ("kids",)
    return dealt


def opened(blocks: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """Block rows with ``path`` back to nodes ``(layer, place, root, path, hash, …)``, whose path begins with the steps within the block.

    A step is what stands left and right of the node in its run. Runs are opened one digit after the other, the
    first first, by a transform of the children and an explode.
    """
    rows = blocks.withColumn("place", F.col("block"))
    for level in reversed(range(BLOCK_LEVELS)):
        def with_step(kid: Column, at: Column) -> Column:
            hashes = F.col("kids.hash")
            step = F.struct(F.array_join(F.slice(hashes, 1, at), "").alias("left"), F.array_join(F.slice(hashes, at + 2, F.size(hashes)), "").alias("right"))
            return F.struct(kid.alias("kid"), step.alias("step"))

        exploded = rows.select("layer", "size", "root", "place", "path", F.explode(F.transform("kids", with_step)).alias("made"))
        path = F.when(F.col("size") > (1 << (RUN_BITS * level)), F.concat(F.array("made.step"), "path")).otherwise(F.col("path"))
        columns = ("kids",) if level else ("hash", *kept)
        rows = exploded.select(
            "layer", "size", "root", (F.shiftleft("place", RUN_BITS) + F.col("made.kid.digit")).alias("place"), path.alias("path"), *[F.col(f"made.kid.{c}").alias(c) for c in columns]
        )
    return rows


def tiers(nodes: DataFrame, kept: tuple[str, ...], label: str) -> list[DataFrame]:
    """Block rows of the nodes, of their blocks, and so on, until every layer has one block."""
    found = []
    while True:
        found.append(written(rolled(nodes, kept if not found else ()), label))
        most = found[-1].agg(F.max("block")).head()[0]
        if not most:
            return found
        bits = RUN_BITS * BLOCK_LEVELS
        size = F.shiftright(F.col("size") + ((1 << bits) - 1), bits)
        nodes = found[-1].select("layer", F.col("block").alias("place"), size.alias("size"), "hash")


def with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Block rows with the root and the path above them, which come as rows of their own and meet them in one group per block."""
    empty = lambda df, names, like: [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in names]
    mine, theirs = ("size", "kids"), ("root", "path")
    rows = blocks.select("layer", "block", *mine, *empty(blocks, theirs, paths))
    above = paths.select("layer", F.col("place").alias("block"), *empty(paths, mine, blocks), *theirs)
    picked = [F.first(c, ignorenulls=True).alias(c) for c in (*mine, *theirs)]
    return rows.unionByName(above).groupBy("layer", "block").agg(*picked)


def down(found: list[DataFrame], paths: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    for at, blocks in reversed(list(enumerate(found))):
        paths = opened(with_paths(blocks, paths), () if at else kept)
    return paths


def feature_manifest(
    features: DataFrame, received: Column | None = None, attributes: tuple[str, ...] = (LANGUAGE,), text: str = DESCRIPTION
) -> DataFrame:
    """A Merkle manifest over all features, by layer, with the check of a received copy.

    A leaf is the SHA-256 of a feature's key, layer, ``attributes`` and text. Per layer, leaves stand by ``feature_id`` (null
    first, ties by leaf); while there are several nodes, each run of 16 becomes the SHA-256 of its digests as text. What
    is left is the layer's root, and the roots of all layers, by name (null first, by bytes), make the root in the same way.
    ``received`` is a map of attributes as they arrived elsewhere; a feature is ``verified`` if its leaf from there, folded with the siblings
    of its proof, gives the root. Where ``received`` is null, the feature's own leaf is folded.

    Returns, per input row, ``dataset_key, feature_id, leaf, subroot, root, proof`` (steps of left and right siblings from
    the leaf up), ``proof_sha256`` (of all siblings), ``folded_root`` and ``verified``. A null map has null attributes; repeated
    rows have a leaf each; an empty table gives no rows; other columns, whatever they are called, are ignored.

    Places come from a sort by ranges, so a layer may hold any share of the rows. Blocks of at most 4096 leaves nest in one row; the roots
    of blocks are nodes of the next tier, with a row for every 4096 rows below, and proofs come back by opening the rows.
    """
    own = leaf_of(F.col("props"), attributes, text)
    arrived = F.when(received.isNotNull(), leaf_of(received, attributes, text)) if received is not None else F.lit(None).cast("string")
    # Written before it is sorted, since a sort by ranges reads its input twice.
    made = written(features.select("dataset_key", "feature_id", own.alias("leaf"), arrived.alias("arrived")), "leaf-digests")
    leaves = numbered(made, "dataset_key", ("feature_id", "leaf", "arrived"), "leaves")
    # From here on a layer is known by its place among all layers.
    layers = written(numbered(leaves.where("place = 0").select("dataset_key"), None, ("dataset_key",), "layers"), "layer-places")
    here = layers.select(F.col("place").alias("layer"), F.col("dataset_key").alias("key"))
    nodes = leaves.join(here, same(F.col("dataset_key"), F.col("key"))).select("layer", "place", leaves["size"], F.col("leaf").alias("hash"), "dataset_key", "feature_id", "arrived")
    kept = ("dataset_key", "feature_id", "arrived")
    found = tiers(nodes, kept, "blocks")
    subroots = found[-1].select(F.lit(0).cast("bigint").alias("layer"), F.col("layer").alias("place"), F.lit(layers.count()).cast("bigint").alias("size"), "hash")
    top = tiers(subroots, (), "tops")
    start = top[-1].select("layer", F.col("block").alias("place"), F.col("hash").alias("root"), F.array().cast(STEPS).alias("path"))
    above = down(top, start, ()).select(F.col("place").alias("layer"), F.lit(0).cast("bigint").alias("place"), F.struct(F.col("hash").alias("subroot"), "root").alias("root"), "path")
    proofs = down(found, above, kept)
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    folded = F.aggregate("path", F.coalesce("arrived", "hash"), lambda node, step: hashed(F.concat(step["left"], node, step["right"])))
    rows = proofs.select(
        "dataset_key", "feature_id", F.col("hash").alias("leaf"), "root.subroot", "root.root", F.col("path").alias("proof"), hashed(siblings).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
