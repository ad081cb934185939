"""Token sequences of fixed length from feature descriptions, packed best-fit decreasing."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .records import DESCRIPTION, described, in_parts, release_memory, schema_of, written
from .words import KNOWN_WORDS, Words

WINDOW = 2048
END = 1
SHARD_ROWS = 100_000
# Text tokenized together; the arrays of a part take some thirty times as much.
BATCH_BYTES = 4 << 20


@lru_cache(maxsize=2)
def words_of(tokenizer_file: str, known_words: int) -> Words:
    """The words of a tokenizer file, built once per Python worker."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(tokenizer_file)
    # Names of special tokens in a text are ordinary text.
    tokenizer.encode_special_tokens = True

    def tokenize(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return Words(tokenize, known_words)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree finds the tightest that fits.

    Leaf ``c`` counts the windows with ``c`` free places; an inner node holds the sum of its
    leaves, so the smallest capacity of at least ``length`` is one climb and one descent.
    """

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.sums = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        self._count(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out a window with the least capacity of at least ``length``: (capacity, window)."""
        node = length + self.size
        if not self.sums[node]:
            while node > 1 and (node & 1 or not self.sums[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node <<= 1
                if not self.sums[node]:
                    node += 1
        capacity = node - self.size
        self._count(capacity, -1)
        return capacity, self.at[capacity].pop()

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.sums[node] += by
            node >>= 1


def best_fit(lengths: Iterable[int], window: int) -> Iterator[tuple[int, int]]:
    """(window number, offset) for each length, which must come in decreasing order."""
    open_, used = OpenWindows(window), 0
    for length in lengths:
        found = open_.tightest(length)
        if found is None:
            capacity, number = window, used
            used += 1
        else:
            capacity, number = found
        yield number, window - capacity
        if capacity > length:
            open_.add(capacity - length, number)


def pack_descriptions(
    features: DataFrame, tokenizer_file: str, attribute: str = DESCRIPTION, window: int = WINDOW, end: int = END, shard_rows: int = SHARD_ROWS,
    known_words: int = KNOWN_WORDS, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Descriptions as token pieces placed in windows of at most ``window`` tokens.

    A document is the ids of one whole description (no special tokens) and the id ``end``. Documents longer
    than a window are first cut into full windows and a rest; rests and shorter documents
    are packed best-fit decreasing. Packing runs in shards of about ``shard_rows`` pieces, dealt in
    turn, each sorted by length in Spark before it streams through the segment tree, so
    padding is lost once per shard. A worker keeps at most ``known_words`` words and
    tokenizes ``batch_bytes`` of text together, which trade memory for time.

    Returns one row per piece: ``dataset_key, feature_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``; pieces of a sequence lie without gaps from 0. Null and
    empty descriptions are documents of the one id ``end``; repeated rows are packed each; an empty
    table gives no rows; other columns are ignored.
    """
    texts = described(features, attribute)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        words, last = words_of(tokenizer_file, known_words), np.array([end], "<u4").tobytes()
        for batch in in_parts(batches, most=batch_bytes):
            # Equal texts of a batch are tokenized once.
            texts = batch.column("text").dictionary_encode()
            pieces = []
            for ids in words.ids_of(texts.dictionary):
                content = memoryview(ids.tobytes() + last)
                total = len(content) // 4
                pieces.append([(at, min(window, total - at), zlib.crc32(content[4 * at : 4 * (at + window)]), total) for at in range(0, total, window)])
            rows: list[int] = []
            found: list[tuple[int, int, int, int]] = []
            for row, text in enumerate(texts.indices.to_pylist()):
                rows += [row] * len(pieces[text])
                found += pieces[text]
            take = pa.array(rows, pa.int64())
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("dataset_key").take(take), batch.column("feature_id").take(take), *[pa.array(c, pa.int64()) for c in columns]],
                ["dataset_key", "feature_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    numbers = [("start", LongType()), ("length", LongType()), ("ids_crc32", LongType()), ("doc_tokens", LongType())]
    pieces = written(texts.mapInArrow(cut, schema_of(texts, ("dataset_key", "feature_id"), *numbers)), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lengths, places = None, [], None

        # The generator is fed one length at a time, so a shard streams through.
        def feed() -> Iterator[int]:
            while True:
                yield lengths.pop()

        for batch in batches:
            sequence, offset = [], []
            for own, length in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if own != shard:
                    shard, places = own, best_fit(feed(), window)
                lengths.append(length)
                number, at = next(places)
                sequence.append((own << 32) + number)
                offset.append(at)
            keep = [batch.column(c) for c in batch.schema.names if c != "shard"]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                [*[c for c in batch.schema.names if c != "shard"], "sequence_id", "offset"],
            )

    names = ("dataset_key", "feature_id", "start", "length", "ids_crc32", "doc_tokens")
    # Dealt in turn, not by a key, so repeated rows spread too; the written pieces are read in the same order when a task is run again.
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("bigint")
    dealt = pieces.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions(
        "shard", F.col("length").desc(), "feature_id", "dataset_key", "start", "ids_crc32"
    )
    return dealt.mapInArrow(placed, schema_of(pieces, names, ("sequence_id", LongType()), ("offset", LongType())))
