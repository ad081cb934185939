"""Exact duplicates of feature descriptions: Patricia tries owned by partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .records import DESCRIPTION, described, schema_of

# Characters that do not count when texts are compared.
IGNORED = b" \t\n\x0b\x0c\r"
HELD_BYTES = 64 << 20


class Node:
    """A trie node: the bytes on the edge to it, its children, and a tally if a text ends here."""

    __slots__ = ("children", "label", "tally")

    def __init__(self, label: bytes, tally: list | None = None) -> None:
        self.label, self.tally, self.children = label, tally, {}


class PatriciaTrie:
    """Compressed radix trie over byte strings; terminal nodes keep a tally.

    A tally is ``[best, rows]``, ``best`` being an order key of which the smallest
    stays. ``insert`` returns the bytes that it added, for memory accounting.
    """

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, text: bytes, best: tuple, rows: int) -> int:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], [best, rows])
                return len(text) - at
            label = child.label
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = common_prefix(label, text, at)
            upper = Node(label[:shared])
            child.label = label[shared:]
            upper.children[child.label[0]] = child
            node.children[text[at]] = upper
            node, at = upper, at + shared
        if node.tally is None:
            node.tally = [best, rows]
        else:
            node.tally[0] = min(node.tally[0], best)
            node.tally[1] += rows
        return 0

    def drain(self) -> Iterator[list]:
        """All tallies; the trie is empty afterwards."""
        stack, self.root = [self.root], Node(b"")
        while stack:
            node = stack.pop()
            if node.tally is not None:
                yield node.tally
            stack.extend(node.children.values())

    def spill(self, text: bytes) -> Iterator[list]:
        """Hand over every subtree that sorts before ``text``.

        With texts inserted in byte order nothing can be added to such a subtree any
        more, so only the path to ``text`` stays in memory.
        """
        node, at = self.root, 0
        while node is not None and at < len(text):
            for first in [b for b in node.children if b < text[at]]:
                stack = [node.children.pop(first)]
                while stack:
                    done = stack.pop()
                    if done.tally is not None:
                        yield done.tally
                    stack.extend(done.children.values())
            child = node.children.get(text[at])
            if child is None or not text.startswith(child.label, at):
                return
            node, at = child, at + len(child.label)


def common_prefix(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def normalized(text: str) -> bytes:
    return text.encode().translate(None, IGNORED)


def order_key(points: int, feature_id: object, dataset_key: object) -> tuple:
    """The longest original first, then the smallest id, then the smallest layer; nulls last."""
    return (
        -points, feature_id is None, 0 if feature_id is None else feature_id,
        dataset_key is None, "" if dataset_key is None else dataset_key,
    )


def exact_duplicates(features: DataFrame, attribute: str = DESCRIPTION, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Groups of features whose descriptions are equal without white space.

    Parameters: ``features`` with ``dataset_key``, ``feature_id`` and ``props``;
    ``attribute``, the attribute compared; ``held_bytes``, the label bytes a trie keeps
    before it hands over finished subtrees.

    Each task first folds the copies within a batch, so a text held by a third of all features
    reaches its owner as a few rows per task. Rows go to the owner of their normalized
    length and content hash, sorted there by their bytes; the owner inserts full byte strings into a
    Patricia trie, whose terminal nodes keep the smallest order key and the number
    of rows. Only this tally is joined back, by digest, to the features.

    Returns one row per input row: ``dataset_key, feature_id, points, keep_dataset_key, keep_id, group_size,
    kept, text_sha256`` (characters of the original text; hex digest of the normalized text). The feature with most characters in the original text stays, then the
    smallest ``feature_id``, then the smallest ``dataset_key``; nulls come last. Null
    and missing descriptions count as empty, and empty ones are equal to each other. Of rows repeated
    with the same key and text exactly one stays. An empty table gives no rows; other columns are ignored.
    """
    texts = described(features, attribute)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("text").to_pylist()
            found = [hashlib.sha256(normalized(t)).digest() for t in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column("dataset_key"), batch.column("feature_id"),
                 pa.array([len(t) for t in values], pa.int64()), pa.array(found, pa.binary())],
                ["dataset_key", "feature_id", "points", "digest"],
            )

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list] = {}
            for text, fid, layer in zip(*[batch.column(c).to_pylist() for c in ("text", "feature_id", "dataset_key")], strict=True):
                best = order_key(len(text), fid, layer)
                tally = seen.setdefault(normalized(text), [best, fid, layer, 0])
                if best < tally[0]:
                    tally[:3] = best, fid, layer
                tally[3] += 1
            tallies = list(seen.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([t[2] for t in tallies], batch.schema.field("dataset_key").type),
                 pa.array([t[1] for t in tallies], batch.schema.field("feature_id").type),
                 pa.array([-t[0][0] for t in tallies], pa.int64()), pa.array([t[3] for t in tallies], pa.int64()),
                 pa.array([len(s) for s in seen], pa.int64()),
                 pa.array([hashlib.sha256(s).digest() for s in seen], pa.binary()), pa.array(list(seen), pa.binary())],
                ["dataset_key", "feature_id", "points", "n", "length", "digest", "body"],
            )

    def owned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, types = PatriciaTrie(), 0, None

        def batch_of(tallies: Iterable[list]) -> pa.RecordBatch:
            done = list(tallies)
            keys = [t[0] for t in done]
            return pa.RecordBatch.from_arrays(
                [pa.array([None if k[3] else k[4] for k in keys], types[0]), pa.array([None if k[1] else k[2] for k in keys], types[1]),
                 pa.array([-k[0] for k in keys], pa.int64()), pa.array([t[1] for t in done], pa.int64()),
                 pa.array([k[5] for k in keys], pa.binary())],
                ["keep_dataset_key", "keep_id", "keep_points", "group_size", "digest"],
            )

        for batch in batches:
            types = types or (batch.schema.field("dataset_key").type, batch.schema.field("feature_id").type)
            rows = zip(*[batch.column(c).to_pylist() for c in ("dataset_key", "feature_id", "points", "n", "digest", "body")], strict=True)
            for layer, fid, points, n, digest, body in rows:
                # The digest rides behind the order key; it is the same for all rows of a terminal node.
                held += trie.insert(body, (*order_key(points, fid, layer), digest), n)
                if held > held_bytes:
                    yield batch_of(trie.spill(body))
                    held = len(body)
        if types:
            yield batch_of(trie.drain())

    keyed = texts.mapInArrow(digests, schema_of(texts, ("dataset_key", "feature_id"), ("points", LongType()), ("digest", BinaryType())))
    bodies = texts.mapInArrow(
        folded,
        schema_of(texts, ("dataset_key", "feature_id"), ("points", LongType()), ("n", LongType()), ("length", LongType()),
                  ("digest", BinaryType()), ("body", BinaryType())),
    )
    ids = texts.schema["feature_id"].dataType
    tries = bodies.repartition("length", "digest").sortWithinPartitions("body")
    owners = tries.mapInArrow(
        owned, f"keep_dataset_key string, keep_id {ids.simpleString()}, keep_points bigint, group_size bigint, digest binary"
    )
    # Rows repeated with one key and text become one row with a count, so that one of them can stay.
    rows = keyed.groupBy("dataset_key", "feature_id", "points", "digest").agg(F.count("*").alias("repeats"))
    joined = rows.join(owners, "digest").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    is_best = (
        F.col("feature_id").eqNullSafe(F.col("keep_id"))
        & F.col("dataset_key").eqNullSafe(F.col("keep_dataset_key"))
        & (F.col("points") == F.col("keep_points"))
    )
    return joined.select(
        "dataset_key", "feature_id", "points", "keep_dataset_key", "keep_id", "group_size",
        (is_best & (F.col("repeat") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
