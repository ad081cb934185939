"""Feature collections of any size, read in byte ranges.

A collection is one JSON document, so a range of its bytes says nothing about where it begins: it may lie
within a text or deep within a geometry. Spark's text source cuts the files at closing braces, wherever a range starts. A
first pass finds for every range what it does to the nesting if it begins inside or outside a text; these few rows, put together in file
order, give each range its true beginning. The second pass cuts out the features, and those that cross ranges are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

PIECE_END = "}"
TEXT = re.compile(r'"(?:[^"\\]|\\.)*"')
TEXT_END = re.compile(r'(?:[^"\\]|\\.)*"')
RANGES = "file string, block bigint, begins boolean, change bigint, least bigint, ends boolean"
# Braces open around a feature: the collection's own.
OUTSIDE = 1


class Nesting:
    """Open braces and whether a text is open, carried from piece to piece."""

    def __init__(self, depth: int, quoted: bool) -> None:
        self.depth, self.quoted = depth, quoted
        self.least = depth

    def openings(self, piece: str) -> str:
        """What of a piece stands outside of texts; moves on to the end of the piece, without its brace."""
        if self.quoted:
            closed = TEXT_END.match(piece)
            if closed is None:
                return ""
            piece, self.quoted = piece[closed.end() :], False
        bare = TEXT.sub("", piece)
        if '"' in bare:
            bare, self.quoted = bare[: bare.index('"')], True
        self.depth += bare.count("{")
        return bare

    def closing(self) -> None:
        if not self.quoted:
            self.depth -= 1
            self.least = min(self.least, self.depth)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text up to each closing brace, in order within a task."""
    return spark.read.option("lineSep", PIECE_END).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range and assumed beginning: change of depth, least depth and whether it ends within a text."""
    found: dict[tuple[str, int], list[Nesting]] = {}
    for batch in batches:
        for file, block, piece in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "value")], strict=True):
            states = found.setdefault((file, block), [Nesting(0, False), Nesting(0, True)])
            for state in states:
                state.openings(piece)
                state.closing()
    rows = [(file, block, begins, s.depth, s.least, s.quoted) for (file, block), own in found.items() for begins, s in zip((False, True), own, strict=True)]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "block", "begins", "change", "least", "ends"])


def _beginnings(ranges: DataFrame) -> list[tuple[str, int, int, bool, int]]:
    """(file, block, depth, within a text, block in which the open feature began) of every range, one row per range of some megabytes."""
    known = {(r["file"], r["block"], r["begins"]): r for r in ranges.collect()}
    out: list[tuple[str, int, int, bool, int]] = []
    for file, block in sorted({(f, b) for f, b, _ in known}):
        if not out or out[-1][0] != file:
            depth, quoted, owner = 0, False, block
        out.append((file, block, depth, quoted, owner))
        row = known[file, block, quoted]
        # A range that leaves the feature it began in, or begins in none, may begin one that goes on.
        owner = block if depth <= OUTSIDE or depth + row["least"] <= OUTSIDE else owner
        depth, quoted = depth + row["change"], row["ends"]
    return out


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, at, value)``: the text and place of every feature of the collections at a path, whatever their size and line breaks.

    Members of a collection that are no features are left out, and so is what a damaged file leaves open at its end. Work is
    spread over ranges of ``spark.sql.files.maxPartitionBytes``.
    """
    pieces = _pieces(spark, path)
    # A file of one range begins outside of everything. Only what several ranges hold is looked at beforehand.
    split = [r["file"] for r in pieces.where("block > 0").select("file").distinct().collect()]
    starts = _beginnings(pieces.where(F.col("file").isin(split)).mapInArrow(_ranges, RANGES)) if split else []
    shared = spark.sparkContext.broadcast({(f, b): rest for f, b, *rest in starts})

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole features (no owner), and parts of those that cross ranges, by the range they began in."""
        at, state, open_parts, owner, own, number = None, None, [], None, False, 0

        def rows(texts: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*texts, strict=True)) or [[]] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "owner", "block", "at", "complete", "value"])

        def part(complete: bool) -> tuple:
            """A feature is numbered where it begins."""
            return (at[0], at[1] if own else owner, at[1], number if own else -1, complete, "".join(open_parts))

        def left() -> list[tuple]:
            return [part(False)] if open_parts else []

        for batch in batches:
            out: list[tuple] = []
            for file, block, piece in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "value")], strict=True):
                if (file, block) != at:
                    out += left()
                    at, open_parts, own, number = (file, block), [], False, 0
                    depth, quoted, owner = shared.value.get(at, (0, False, block))
                    state = Nesting(depth, quoted)
                inside = state.depth > OUTSIDE
                # A text that is open here ends before any feature can begin.
                closed = TEXT_END.match(piece) if state.quoted else None
                outside_text = state.openings(piece)
                if not inside and state.depth > OUTSIDE:
                    # Of what stands before a feature nothing is kept. At most one feature begins in a piece, since each ends with a brace.
                    piece = piece[_begin(piece, outside_text, state.depth, closed.end() if closed else 0) :]
                    own, number = True, number + 1
                if inside or state.depth > OUTSIDE:
                    open_parts += [piece, PIECE_END]
                state.closing()
                if open_parts and not state.quoted and state.depth <= OUTSIDE:
                    out.append(part(own))
                    open_parts = []
            yield rows(out)
        if at is not None:
            yield rows(left())

    found = pieces.mapInArrow(cut, "file string, owner bigint, block bigint, at bigint, complete boolean, value string")
    if split:
        # Features and parts both come from it; the text is cut once.
        cut_once = scratch_path(spark, "features")
        found.write.parquet(cut_once)
        found = spark.read.schema(found.schema).parquet(cut_once)
    whole = found.where("complete").select("file", "block", "at", "value")
    if not split:
        return whole.where(F.get_json_object("value", "$.type") == "Feature")
    # A feature over several ranges has one part in each.
    parts = found.where("NOT complete").groupBy("file", "owner").agg(F.max("at").alias("at"), F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts"))
    joined = parts.select("file", F.col("owner").alias("block"), "at", F.array_join(F.col("parts.value"), "").alias("value"))
    return whole.unionByName(joined).where(F.get_json_object("value", "$.type") == "Feature")


def _begin(piece: str, bare: str, depth: int, at: int) -> int:
    """Where the feature begins in a piece: the brace that leads from outside to inside."""
    skip = bare.count("{") - (depth - OUTSIDE)
    while True:
        brace, quote = piece.find("{", at), piece.find('"', at)
        if 0 <= quote < brace:
            closed = TEXT.match(piece, quote)
            at = closed.end()
            continue
        if skip <= 0:
            return brace
        skip -= 1
        at = brace + 1
