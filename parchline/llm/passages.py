"""Repeated lines, paragraphs and sentences of feature descriptions, by hashing units."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .records import DESCRIPTION, described, in_parts, schema_of, written

# Each pattern tiles a text: a unit takes the marks that end it along.
UNITS = {
    "paragraph": re.compile(r"(?:[^\n]|\n(?!\n))+\n*|\n+"),
    "line": re.compile(r"[^\n]+\n*|\n+"),
    "sentence": re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+"),
}
# Repeated lines and paragraphs go whatever their length. Sentences, a level beside the lines for passages within them, go from this many code points on:
# shorter ones are names, abbreviations and set phrases.
LEAST_SENTENCE = 40
BATCH_BYTES = 1 << 20
SPACES = re.compile(r"[ \t-\r]+")
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RUNS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def normalized(unit: str) -> str:
    """Lower case, one space between words."""
    return SPACES.sub(" ", unit).strip(" ").lower()


def units_of(text: str, levels: tuple[str, ...], least_sentence: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of every unit that counts; levels do not mix."""
    for level in levels:
        least = least_sentence if level == "sentence" else 1
        for found in UNITS[level].finditer(text):
            plain = normalized(found[0])
            if len(plain) >= least:
                yield found.start(), found.end(), hashlib.blake2b(plain.encode(), digest_size=16, person=level.encode()).digest()


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of intervals that overlap or touch."""
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(r) for r in out]


def repeated_passages(features: DataFrame, attribute: str = DESCRIPTION, levels: tuple[str, ...] = ("line", "sentence"), least_sentence: int = LEAST_SENTENCE) -> DataFrame:
    """Parts of descriptions that repeat an earlier ranked unit.

    Parameters: ``levels``, the units compared (``paragraph``, ``line``, ``sentence``), each level for itself;
    ``least_sentence``, the code points (normalized) below which a sentence always stays; lines and paragraphs of any length go.

    A unit is normalized (case, white space) and hashed. Of units with one digest the earliest stays, in order of ``feature_id``
    (null last), ``dataset_key`` (null last), row, start; all others are removed. Digests are counted with partial aggregates, and only units
    of digests seen twice are looked at again, so a line in a third of all features costs one row per
    task, and is then joined, never gathered.

    Returns one row per input row: ``dataset_key, feature_id, n_chars, n_units, removed``, the last being the maximal removed runs
    (start, end) in code points of the original text. Null and empty descriptions have no
    units; of repeated rows the first keeps its units; an empty table gives no rows; other columns are ignored.
    """
    texts = described(features, attribute).withColumn("row", F.monotonically_increasing_id())

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Flat buffers: a number per unit, not an object.
        for batch in in_parts(batches, most=BATCH_BYTES):
            starts, ends, counts, sizes, digests = array("i"), array("i"), [0], [], bytearray()
            for text in batch.column("text").to_pylist():
                sizes.append(len(text))
                for start, end, digest in units_of(text, levels, least_sentence):
                    starts.append(start)
                    ends.append(end)
                    digests += digest
                counts.append(len(starts))
            offsets = pa.array(counts, pa.int32())
            cuts = pa.py_buffer(np.arange(len(starts) + 1, dtype=np.int32) * 16)
            units = pa.Array.from_buffers(pa.binary(), len(starts), [None, cuts, pa.py_buffer(bytes(digests))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("dataset_key"), batch.column("feature_id"), batch.column("row"), pa.array(sizes, pa.int64()),
                 *[pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(v, np.int32))) for v in (starts, ends)], pa.ListArray.from_arrays(offsets, units)],
                ["dataset_key", "feature_id", "row", "n_chars", "starts", "ends", "digests"],
            )

    ints = ArrayType(IntegerType())
    table = written(
        texts.mapInArrow(hashed, schema_of(texts, ("dataset_key", "feature_id", "row"), ("n_chars", LongType()), ("starts", ints), ("ends", ints), ("digests", ArrayType(BinaryType())))),
        "units",
    )
    # What is joined to a side with hot digests is written first: a join of two fresh shuffles can be split by adaptive execution.
    twice = written(table.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "twice")
    places = table.select("row", F.posexplode("digests").alias("unit", "digest"))
    # Few units repeat, so what is written here is small, and it is read twice.
    repeated = written(places.join(twice, "digest", "left_semi"), "repeated")
    rows = table.select("row", "dataset_key", "feature_id", "starts", "ends")
    ranked = repeated.join(rows, "row").select(
        "digest", "row", "unit", "feature_id", "dataset_key", F.col("starts")[F.col("unit")].alias("start"), F.col("ends")[F.col("unit")].alias("end")
    )
    rank = F.struct(
        F.col("feature_id").isNull().alias("no_id"), "feature_id", F.col("dataset_key").isNull().alias("no_layer"), "dataset_key", "row", "start"
    )
    first = written(
        ranked.groupBy("digest").agg(F.min(rank).alias("first")).select("digest", F.col("first.row").alias("kept_row"), F.col("first.start").alias("kept_start")), "first"
    )
    later = ranked.join(first, "digest").where((F.col("row") != F.col("kept_row")) | (F.col("start") != F.col("kept_start")))
    runs = later.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    whole = table.select("dataset_key", "feature_id", "row", "n_chars", F.size("digests").cast("bigint").alias("n_units")).join(runs, "row", "left")

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = [[{"start": s, "end": e} for s, e in merged((r["start"], r["end"]) for r in own or [])] for own in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("dataset_key", "feature_id", "n_chars", "n_units")], pa.array(removed, ARROW_RUNS)],
                ["dataset_key", "feature_id", "n_chars", "n_units", "removed"],
            )

    return whole.mapInArrow(joined, schema_of(whole, ("dataset_key", "feature_id", "n_chars", "n_units"), ("removed", RUNS)))


def without_runs(text: str, runs: Iterable[tuple[int, int]]) -> str:
    """The text without the given runs."""
    parts, at = [], 0
    for start, end in runs:
        parts.append(text[at:start])
        at = end
    return "".join([*parts, text[at:]])
