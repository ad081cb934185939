"""Features whose descriptions share most of their word n-grams: MinHash banding, verified on whole sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from .components import components
from .records import DESCRIPTION, described, in_parts, schema_of, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
BLOCK = 512
KNOWN_WORDS = 200_000
SEED = 20240229


def bands_for(threshold: float, recall: float, least_rows: int = 2, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which pairs at ``threshold`` share a band with chance ``recall``."""
    best = None
    for rows in range(least_rows, 13):
        hit = threshold**rows
        bands = 1 if hit >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))
        if bands * rows <= most_hashes and (best is None or bands * rows <= 128):
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


class Shingles:
    """64-bit hashes of the distinct word n-grams of texts."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[str, int] = {}
        rng = np.random.default_rng(SEED)
        self.powers = rng.integers(1, 2**63, words, np.uint64) | np.uint64(1)

    def of(self, text: str) -> np.ndarray:
        """Sorted hashes; a text with fewer words than an n-gram has one n-gram, one without words none."""
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            codes = [known[w] for w in words]
        except KeyError:
            if len(known) > KNOWN_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            codes = [known[w] for w in words]
        h = np.array(codes, np.uint64)
        n = min(self.words, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            total += h[i : len(h) - n + 1 + i] * self.powers[i]
        return np.unique(mixed(total))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def band_hashes(shingles: np.ndarray, bands: int, rows: int, keys: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature of a set."""
    signature = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        for k in range(0, len(keys), 20):
            hashed = (part[None, :] ^ keys[k : k + 20, None]) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
            hashed *= np.uint64(0xBF58476D1CE4E5B9)
            np.minimum(signature[k : k + 20], hashed.min(axis=1), out=signature[k : k + 20])
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for row in signature.reshape(bands, rows).T:
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + row)
    return out.view(np.int64)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set on the left, the sizes of its intersections with every set on the right."""
    terms = np.concatenate(right) if right else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(right)), [len(r) for r in right])
    order = np.argsort(terms, kind="stable")
    terms, owner = terms[order], owner[order]
    for own in left:
        low, high = np.searchsorted(terms, own, "left"), np.searchsorted(terms, own, "right")
        n = high - low
        total = int(n.sum())
        if not total:
            yield np.zeros(len(right), np.int64)
            continue
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        yield np.bincount(owner[at], minlength=len(right))


def jaccard_links(
    features: DataFrame, attribute: str = DESCRIPTION, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """Near-duplicate classes of features, and how many others each is linked to.

    Parameters: ``words`` per n-gram, ``threshold`` on the Jaccard similarity of the n-gram sets,
    ``recall``, the chance that a pair at the threshold shares a band (bands and rows follow from both), and ``block``,
    the number of sets compared at once.

    Features with equal sets are one class representative, so copies cost nothing further. Band hashes of representatives are
    shuffled and counted; those in a bucket of several are linked to its least member, and the components of these
    candidates are verified on their full sets, in tasks of at most two blocks: a large component is dealt into blocks, and each
    pair of blocks is compared once. A task gives back one row per representative, its
    number of links and a root, never pairs.

    Returns one row per input row: ``dataset_key, feature_id, content, kept, class_dataset_key, class_id, class_size, n_links``. The class is the
    component of verified links, named by its smallest key (by ``feature_id``, then ``dataset_key``, nulls last, then ``content``, the first half
    of the text's SHA-256), whose feature is the one to keep; ``n_links``
    counts the other features with similarity at or above the threshold, equal sets included. Null, empty and
    wordless descriptions link to nothing; with fewer than ``words`` words the whole text is one n-gram. Repeated
    rows are copies of each other. An empty table gives no rows; other columns are ignored.
    """
    bands, rows = bands_for(threshold, recall)
    keys = np.random.default_rng(SEED).integers(0, 2**63, bands * rows, np.uint64)
    texts = described(features, attribute).withColumn("content", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in in_parts(batches):
            sizes, names, signatures = [], [], []
            seen: dict[str, tuple] = {}
            for text in batch.column("text").to_pylist():
                found = seen.get(text)
                if found is None:
                    own = shingles.of(text)
                    found = seen[text] = (
                        len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None,
                        band_hashes(own, bands, rows, keys) if len(own) else None,
                    )
                sizes.append(found[0])
                names.append(found[1])
                signatures.append(found[2])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("dataset_key", "feature_id", "content")],
                 pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(signatures, pa.list_(pa.int64()))],
                ["dataset_key", "feature_id", "content", "n_grams", "set_id", "bands"],
            )

    signatures = written(
        texts.mapInArrow(
            signed, schema_of(texts, ("dataset_key", "feature_id", "content"), ("n_grams", LongType()), ("set_id", BinaryType()), ("bands", ArrayType(LongType())))
        ),
        "signatures",
    )
    key = F.struct(F.col("feature_id").isNull().alias("no_id"), "feature_id", F.col("dataset_key").isNull().alias("no_layer"), "dataset_key", "content")
    representatives = written(
        signatures.where("set_id is not null").groupBy("set_id").agg(
            F.min(key).alias("key"), F.count("*").alias("size"), F.min(F.struct("content", "bands")).alias("some")
        ).select("set_id", "key", "size", F.col("some.content").alias("content"), F.col("some.bands").alias("bands"), F.monotonically_increasing_id().alias("rep")),
        "representatives",
    )
    entries = representatives.select("rep", F.explode("bands").alias("band"))
    # What is joined to a side with hot keys is written first: a join of two fresh shuffles can be split by adaptive execution.
    buckets = written(entries.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least"), "buckets")
    candidates = entries.join(buckets, "band").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    member = written(components(candidates), "candidates")

    # Blocks: members of a component are dealt by a hash; a component of one block is one task's work.
    blocks = written(member.groupBy("root").agg(F.count("*").alias("members")).select("root", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "blocks")
    placed = member.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = placed.join(representatives.select("rep", "content", "size"), placed["node"] == F.col("rep")).select("content", "rep", "size", "root", "blocks", "own")
    # One text per content: copies are folded before the shuffle.
    contents = texts.groupBy("content").agg(F.first("text").alias("text"))
    work = contents.join(wanted, "content").select(
        "rep", "size", "text", "root", "own",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("low"), F.greatest("own", o).alias("high")))).alias("pair"),
    ).select("root", "pair.low", "pair.high", "own", "rep", "size", "text")

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        task, members = None, []

        def out() -> pa.RecordBatch:
            linked = links_of(members, task[1] == task[2], threshold)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in linked], pa.int64()) for i in range(3)], ["rep", "root", "links"])

        for batch in in_parts(batches):
            columns = [batch.column(c).to_pylist() for c in ("root", "low", "high", "own", "rep", "size", "text")]
            for root, low, high, own, rep, size, text in zip(*columns, strict=True):
                if (root, low, high) != task:
                    if members:
                        yield out()
                    task, members = (root, low, high), []
                members.append((own, rep, size, shingles.of(text)))
        if members:
            yield out()

    tasks = work.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    links = written(tasks.mapInArrow(verified, "rep bigint, root bigint, links bigint"), "links")
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    named = written(
        representatives.select("set_id", "key", "size", "rep")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
        .withColumn("root", F.coalesce("root", "rep")),
        "named",
    )
    classes = written(named.groupBy("root").agg(F.min("key").alias("first"), F.sum("size").alias("class_size")), "classes")
    known = named.join(classes, "root").select(
        "set_id", F.col("first.dataset_key").alias("class_dataset_key"), F.col("first.feature_id").alias("class_id"), F.col("first.content").alias("first_content"), "class_size",
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.lit(True).alias("known"),
    )
    joined = signatures.select("dataset_key", "feature_id", "content", "set_id").join(known, "set_id", "left")
    own = F.col("known").isNull()
    first = F.col("feature_id").eqNullSafe(F.col("class_id")) & F.col("dataset_key").eqNullSafe(F.col("class_dataset_key")) & (F.col("content") == F.col("first_content"))
    return joined.select(
        "dataset_key", "feature_id", "content", (own | first).alias("kept"),
        F.when(own, F.col("dataset_key")).otherwise(F.col("class_dataset_key")).alias("class_dataset_key"),
        F.when(own, F.col("feature_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def links_of(members: list[tuple[int, int, int, np.ndarray]], same: bool, threshold: float) -> list[tuple[int, int, int]]:
    """(rep, root within the task, linked features) of each member with a link.

    Members are (block, rep, size, set). One block (``same``) is compared with itself, of two blocks only the
    pairs across, since each block is also compared with itself once.
    """
    low = min(m[0] for m in members)
    left = [m for m in members if m[0] == low]
    right = left if same else [m for m in members if m[0] != low]
    sizes = np.array([len(m[3]) for m in right])
    weights = np.array([m[2] for m in right])
    at = np.arange(len(right))
    count: dict[int, int] = {}
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (shared, member) in enumerate(zip(shared_counts([m[3] for m in left], [m[3] for m in right]), left, strict=True)):
        near = shared / (len(member[3]) + sizes - shared) >= threshold
        if same:
            near &= at != i
        hits = np.flatnonzero(near)
        if not len(hits):
            continue
        count[member[1]] = count.get(member[1], 0) + int(weights[hits].sum())
        for j in hits.tolist():
            other = right[j][1]
            if not same:
                count[other] = count.get(other, 0) + member[2]
            a, b = find(member[1]), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(rep, find(rep), n) for rep, n in count.items()]
