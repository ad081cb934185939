"""Languages of feature descriptions by bit-sliced Bloom filters over letter trigrams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .records import DESCRIPTION, LANGUAGE, described, schema_of, written

UNDETERMINED = "und"
PIECE = 1 << 20
SPACE, CUT = 32, 0
# Odd multipliers of the slot hashes (fixed values, any large odd numbers do).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@cache
def letter_codes() -> np.ndarray:
    """Code point → code of its lower-case letter; everything but letters becomes a space."""
    codes = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x40000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            codes[c] = ord(low) if len(low) == 1 else c
    codes[CUT] = CUT
    return codes


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts as chunks of about ``PIECE`` characters: row numbers and strings.

    A text longer than a piece is cut with two characters of overlap, so each trigram is in
    exactly one piece.
    """
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        padded = f" {text} " if text else ""
        for at in range(0, max(len(padded) - 2, 0), PIECE):
            part = padded[at : at + PIECE + 2].replace("\0", " ")
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def trigrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of the parts and, for each, the number of its part.

    A trigram is three code points of lower-case letters, of which the first or the last may be a word border.
    """
    raw = np.frombuffer("\0".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_codes()[raw]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    good = np.flatnonzero((b != SPACE) & (b != CUT) & (a != CUT) & (c != CUT))
    wide = codes.astype(np.int64)
    grams = (wide[good] << 42) | (wide[good + 1] << 21) | wide[good + 2]
    starts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    return grams, np.searchsorted(starts, good, "right") - 1


@dataclass(frozen=True)
class LanguageFilters:
    """One Bloom filter per language, sliced by slot: bit ``l`` of a slot belongs to ``languages[l]``."""

    languages: tuple[str, ...]
    slots: np.ndarray
    hashes: int

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Per trigram the bit mask of the languages that contain it (or seem to)."""
        shift = np.uint64(64 - int(len(self.slots)).bit_length() + 1)
        found: np.ndarray | None = None
        for k in range(self.hashes):
            at = (grams.view(np.uint64) * np.uint64(MULTIPLIERS[k])) >> shift
            got = self.slots[at]
            found = got if found is None else found & got
        return found

    def false_rates(self) -> np.ndarray:
        """Per language the chance that a foreign trigram hits all its slots."""
        fill = [((self.slots >> self.slots.dtype.type(i)) & self.slots.dtype.type(1)).mean() for i in range(len(self.languages))]
        return np.array(fill) ** self.hashes


def learn_languages(
    features: DataFrame, attribute: str = DESCRIPTION, language: str = LANGUAGE, slot_bits: int = 19, hashes: int = 2,
    least_share: float = 4e-6, relative: float = 0.05,
) -> LanguageFilters:
    """Bit-sliced filters from all features with a language attribute.

    Every trigram of every such description is counted per language (combined in each
    task before the shuffle). A trigram enters the filter of a language if it makes up at
    least ``least_share`` of that language's trigrams, which bounds a filter to ``1 / least_share``
    entries whatever the size of the table, and if that is at least ``relative`` of its largest
    share in any language. The filters are merged with ``bit_or`` per slot, so at
    most ``2 ** slot_bits`` rows come back. At most 63 languages are allowed. Rows without language or
    text teach nothing; without any the result has no language.
    """
    texts = described(features, attribute, language).where(F.col(language).isNotNull())
    names = tuple(sorted(r[0] for r in texts.select(language).distinct().limit(65).collect()))
    if len(names) > 63:
        raise ValueError("more than 63 languages")
    kind = next(t for t, top in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(names) <= top)
    if not names:
        return LanguageFilters((), np.zeros(2, np.uint8), 1)
    number = {n: i for i, n in enumerate(names)}

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = [number[x] for x in batch.column(language).to_pylist()]
            for rows, parts in pieces(batch.column("text").to_pylist()):
                grams, of = trigrams(parts)
                own = np.array([labels[r] for r in rows], np.int32)[of]
                for i in np.unique(own):
                    keys, n = np.unique(grams[own == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(np.full(len(keys), i, np.int32)), pa.array(n.astype(np.int64))], ["gram", "language", "n"]
                    )

    counted = written(
        texts.mapInArrow(counts, "gram bigint, language int, n bigint").groupBy("gram").agg(
            *[F.sum(F.when(F.col("language") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(names))]
        ),
        "trigrams",
    )
    totals = counted.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]).first()
    total = [max(t or 0, 1) for t in totals]
    if not any(totals):
        return LanguageFilters(names, np.zeros(2, kind), 1)
    share = [F.col(f"n{i}") / F.lit(float(total[i])) for i in range(len(names))]
    top = F.greatest(*share) if len(names) > 1 else share[0]
    mask = sum(
        (F.when((s >= least_share) & (s >= F.lit(relative) * top), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, s in enumerate(share)),
        F.lit(0).cast("bigint"),
    )
    shift = 64 - slot_bits

    def slotted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = batch.column("mask").to_numpy(zero_copy_only=False)
            at = np.concatenate([((grams.view(np.uint64) * np.uint64(m)) >> np.uint64(shift)).astype(np.int64) for m in MULTIPLIERS[:hashes]])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(bits, hashes))], ["slot", "mask"])

    kept = counted.select("gram", mask.alias("mask")).where("mask <> 0").mapInArrow(slotted, "slot bigint, mask bigint")
    filled = kept.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots = np.zeros(1 << slot_bits, kind)
    slots[filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().astype(kind)
    return LanguageFilters(names, slots, hashes)


def predict_languages(features: DataFrame, filters: LanguageFilters, attribute: str = DESCRIPTION, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(dataset_key, feature_id, …, found, score)`` for every feature; ``keep`` names attributes to carry along.

    All trigrams of the whole description are looked up at once for all languages. The share of
    hits of a language is corrected for the false positives of its filter; the largest
    corrected share wins (ties: first in name order) and is the score, between 0 and 1. Descriptions that are null, or without
    a letter, are ``und`` with score 0; so are all when nothing was learned. Other
    columns are ignored, repeated rows answered each, an empty table gives no rows.
    """
    texts = described(features, attribute, *keep)
    shared, carried = texts.sparkSession.sparkContext.broadcast(filters), ("dataset_key", "feature_id", *keep)

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        kinds, false = len(known.languages), known.false_rates()
        one = known.slots.dtype.type(1)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            hits, seen = np.zeros((len(texts), kinds)), np.zeros(len(texts))
            for rows, parts in pieces(texts):
                grams, of = trigrams(parts)
                masks, at = known.masks(grams), np.array(rows, np.int64)
                np.add.at(seen, at, np.bincount(of, minlength=len(parts)))
                for i in range(kinds):
                    got = np.bincount(of, (masks >> known.slots.dtype.type(i)) & one, len(parts))
                    np.add.at(hits[:, i], at, got)
            lettered = seen > 0
            if kinds:
                share = hits / np.maximum(seen, 1)[:, None]
                true = np.clip((share - false) / (1 - np.minimum(false, 0.999)), 0, 1)
                best = true.argmax(axis=1)
                names = [known.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, true[np.arange(len(texts)), best], 0.0)
            else:
                names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(names, pa.string()), pa.array(score)], [*carried, "found", "score"],
            )

    return texts.mapInArrow(predicted, schema_of(texts, carried, ("found", StringType()), ("score", DoubleType())))
