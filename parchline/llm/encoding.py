"""Byte-level BPE tokens of feature descriptions with the tiktoken library, and back."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from .records import DESCRIPTION, described, in_parts, schema_of
from .words import Words

LONG_TEXT = 200_000
LONG_RUN = 10_000
ROWS = 200
KNOWN_WORDS = 200_000
# A cut between two of these characters never lies within a match of the split pattern: no alternative
# matches a letter or number followed by a space, and none looks back.
BOUNDARY = re.compile(r"[^\W_](?= [^\W_])")
# White space as the split pattern sees it (Unicode White_Space), in runs too long for its engine.
RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_RUN)


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a local rank file, built once per Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def words_of(rank_file: str, pattern: str, size: int) -> Words:
    encoding = encoder(rank_file, pattern)
    return Words(lambda texts: [array("I", encode_text(encoding, t, size)).tobytes() for t in texts], KNOWN_WORDS)


def each_ids(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row without making them Python objects; null is none."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for row, valid in enumerate(column.is_valid().to_pylist()):
        yield flat[ends[row] : ends[row + 1]] if valid else flat[:0]


def cut(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters whose tokens, joined, are the tokens of ``text``."""
    at = 0
    while len(text) - at > size:
        found = BOUNDARY.search(text, at + size)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def encode_text(encoding: tiktoken.Encoding, text: str, size: int = LONG_TEXT) -> list[int]:
    """Ids as ``encoding.encode_ordinary(text)`` gives them, for any length."""
    if len(text) <= min(size, LONG_RUN):
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in RUN.finditer(text):
        # Within a run the pattern takes all but the last character as one piece when something follows, and
        # everything at the end of the text.
        end = run.end() if run.end() == len(text) else run.end() - 1
        for part in cut(text[at : run.start()], size):
            ids += encoding.encode_ordinary(part)
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    for part in cut(text[at:], size):
        ids += encoding.encode_ordinary(part)
    return ids


def encode_descriptions(features: DataFrame, rank_file: str, pattern: str, attribute: str = DESCRIPTION, size: int = LONG_TEXT) -> DataFrame:
    """``(dataset_key, feature_id, ids)``: token ids of each whole description.

    ``rank_file`` is the path of a local rank file on every executor, ``pattern`` the split pattern whose
    matches are encoded separately; there are no special tokens, so their names are
    ordinary text. Texts are split before single spaces, where no match can span the cut, so known words are looked
    up; what cannot be split so is cut between words once it is longer than ``size`` characters. Null and
    empty descriptions have no ids; repeated rows are encoded each; an empty table gives no rows; other columns are ignored.
    """
    texts = described(features, attribute)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(rank_file, pattern, size)
        for batch in in_parts(batches):
            found = [words.ids(text) for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(f) // 4 for f in found], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("dataset_key"), batch.column("feature_id"), ids], ["dataset_key", "feature_id", "ids"])

    return texts.mapInArrow(encoded, schema_of(texts, ("dataset_key", "feature_id"), ("ids", ArrayType(IntegerType()))))


def decode_descriptions(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``(dataset_key, feature_id, ids, content)``: the raw bytes the ids stand for.

    Bytes are joined token by token without a detour over text, so ids that split a
    character decode too. Null ids count as none; an id outside the ranks raises ``KeyError``.
    """
    rows = tokens.select("dataset_key", "feature_id", "ids")

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(rank_file, pattern)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                content = [encoding.decode_bytes(ids.tolist()) for ids in each_ids(part.column("ids"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("dataset_key"), part.column("feature_id"), part.column("ids"), pa.array(content, pa.binary())],
                    ["dataset_key", "feature_id", "ids", "content"],
                )

    return rows.mapInArrow(decoded, schema_of(rows, ("dataset_key", "feature_id", "ids"), ("content", BinaryType())))
