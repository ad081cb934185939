"""Secrets in feature descriptions: fixed patterns, and Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from .records import DESCRIPTION, described, in_parts, schema_of

Span = tuple[int, int, str, bool, float]

# Fixed patterns. A key word is in either case, but only in ASCII.
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
RANDOM = "random"
KINDS = (*BASE_KINDS, RANDOM)
ASSIGNED = 6

# The characters a secret is made of; all others are one symbol, zero, which also stands before and after a run.
SYMBOLS = string.ascii_letters + string.digits + "+/_.=-"
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
NAMED_ID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
SIZE = len(SYMBOLS) + 1
CODES = np.zeros(256, np.uint8)
CODES[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(1, SIZE)
# Alphabets of random strings, narrow before wide: a sample belongs to the first that holds it.
FORMS = {
    "hex": string.digits + "abcdef",
    "upper_hex": string.digits + "ABCDEF",
    "upper": string.ascii_uppercase + string.digits,
    "mixed": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/=",
    "base64url": string.ascii_letters + string.digits + "-_",
}
PROSE, MADE = len(FORMS), len(FORMS) + 1
MODELS = len(FORMS) + 2
ALPHABETS = [frozenset(alphabet) for alphabet in FORMS.values()]

LEAST_LENGTH = 20
LEAST_SCORE = 16.0
LEAST_MEAN = 0.5
# A character's chance: after two others, after one, alone, and any. Fixed shares, so that no number of rows makes an unseen word look random.
SHARES = (0.5, 0.2, 0.25, 0.05)
# The ordinary models: what descriptions hold, and made identifiers.
PROSE_SHARE = 0.75
# A part takes along this many symbols of its alphabet on each side, which may have spoken against it.
MARGIN = 3
# Characters looked at together.
BLOCK = 1 << 17
MADE_ROWS = 4000
# Words of identifiers in this field, joined in the usual ways to made samples of ordinary identifiers.
IDENTIFIER_WORDS = (
    "station", "index", "layer", "month", "region", "basin", "value", "forecast", "trend", "date", "precip", "drought", "feature", "dataset", "boundary",
    "spi", "spei", "series", "level", "class", "source", "key", "name", "geojson", "http", "https", "www", "html", "path", "file", "data", "import",
)
SPAN_TYPE = ArrayType(
    StructType(
        [StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("base", BooleanType()),
         StructField("score", DoubleType())]
    )
)
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of the fixed patterns, leftmost and without overlap per kind, by start and kind."""
    found = [(m.start(), m.end(), "assign", m.start(1)) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def codes_of(text: str) -> np.ndarray:
    """One symbol per code point."""
    return CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)].copy()


def cells_of(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The cell (two symbols before, symbol) of every character, in blocks; a run starts without memory of the one before it."""
    for at in range(0, len(codes), BLOCK):
        own = codes[at : at + BLOCK].astype(np.int64)
        known = np.concatenate([np.zeros(2, np.uint8), codes[max(0, at - 2) : at + len(own)]])[-len(own) - 2 :]
        before, earlier = known[1:-1].astype(np.int64), known[:-2].astype(np.int64)
        earlier[before == 0] = 0
        yield (earlier * SIZE + before) * SIZE + own


def add_counts(counts: np.ndarray, text_codes: np.ndarray) -> None:
    for cells in cells_of(text_codes):
        counts += np.bincount(cells, minlength=SIZE**3)


def form_of(sample: str) -> int | None:
    for number, alphabet in enumerate(FORMS.values()):
        if set(sample) <= set(alphabet):
            return number
    return None


def made_secrets(rows: int, seed: int) -> list[list[str]]:
    """Random strings of every form, labelled as secrets."""
    random = np.random.default_rng(seed)
    out = []
    for alphabet in FORMS.values():
        letters = np.array(list(alphabet.replace("=", "")))
        out.append(["".join(random.choice(letters, n)) for n in random.integers(LEAST_LENGTH, 65, rows)])
    return out


def made_identifiers(rows: int, seed: int) -> list[str]:
    """Joined words, numbers, dates and versions, labelled as ordinary."""
    random = np.random.default_rng(seed)
    joins = (lambda w: "_".join(w), lambda w: "-".join(w), lambda w: ".".join(w), lambda w: "/".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]),
             lambda w: "_".join(w).upper(), lambda w: "".join(x.title() for x in w))
    out = []
    for _ in range(rows):
        words = [str(w) for w in random.choice(IDENTIFIER_WORDS, random.integers(2, 6))]
        number = str(random.integers(0, 10 ** int(random.integers(1, 18))))
        style = joins[int(random.integers(len(joins)))]
        out += [style(words), style([*words, number]), number, f"{random.integers(1900, 2100)}-{random.integers(1, 13):02d}-{random.integers(1, 29):02d}"]
        out += ["".join(map(str, random.integers(0, 10, random.integers(8, 30)))), f"v{random.integers(0, 20)}.{random.integers(0, 20)}.{random.integers(0, 20)}"]
    return [*out, *[symbol * 24 for symbol in SYMBOLS for _ in range(max(1, rows // 200))]]


@dataclass
class SecretModels:
    """Log-likelihood ratios per cell: one table for each form of random strings against ordinary identifiers."""

    ratios: np.ndarray

    @staticmethod
    def from_counts(counts: np.ndarray) -> SecretModels:
        """From counts of (model, two symbols before, symbol)."""
        n = counts.reshape(MODELS, SIZE, SIZE, SIZE).astype(np.float64)
        n[:, :, :, 0] = 0
        two, one, none, anything = SHARES
        # What was never seen leaves its share to the chance alone.
        alone = n.sum(axis=(1, 2)) + 1.0
        alone[:, 0] = 0
        alone = (alone / alone.sum(axis=1, keepdims=True))[:, None, :]
        pair = n.sum(axis=1)
        total = pair.sum(axis=2, keepdims=True)
        after = np.where(total > 0, pair / np.maximum(total, 1), alone)[:, None]
        total = n.sum(axis=3, keepdims=True)
        chances = two * np.where(total > 0, n / np.maximum(total, 1), after) + one * after + none * alone[:, None] + anything / (SIZE - 1)
        ordinary = PROSE_SHARE * chances[PROSE] + (1 - PROSE_SHARE) * chances[MADE]
        # Outside the alphabet of its form a random string has no symbol.
        inside = np.array([[False, *[s in own for s in SYMBOLS]] for own in ALPHABETS])
        random = np.where(inside[:, None, None, :], chances[:PROSE], anything / SIZE**2)
        ratios = np.log(random) - np.log(ordinary)
        ratios[:, :, :, 0] = 0
        return SecretModels(ratios.reshape(PROSE, -1).astype(np.float32))

    def scores(self, text: str, form: int) -> Iterator[np.ndarray]:
        """How much each character speaks for a random string of a form, in nats, in blocks."""
        return (self.ratios[form][cells] for cells in cells_of(codes_of(text)))

    def score(self, text: str) -> float:
        """The ratio of the best form over all of the text."""
        return max(float(sum(s.sum(dtype=np.float64) for s in self.scores(text, form))) for form in range(PROSE))

    def random_parts(self, text: str, least_length: int, least_score: float, least_mean: float) -> list[tuple[int, int, float]]:
        """(start, end, score) of the parts of a run of symbols that look random, without overlap."""
        parts = []
        for form in range(PROSE):
            if len(text) <= BLOCK:
                sums = np.cumsum(next(self.scores(text, form)), dtype=np.float64)
                if (sums - np.minimum(np.minimum.accumulate(sums), 0.0)).max() < least_score:
                    continue
            found = excursions((x for block in self.scores(text, form) for x in block.tolist()), least_score)
            for start, end, score in found:
                good = score >= least_mean * (end - start)
                low, high = max(0, start - MARGIN), min(len(text), end + MARGIN)
                while start > low and text[start - 1] in ALPHABETS[form]:
                    start -= 1
                while end < high and text[end] in ALPHABETS[form]:
                    end += 1
                if good and end - start >= least_length and not text[start:end].isdigit():
                    parts.append((start, end, score))
        out: list[tuple[int, int, float]] = []
        for start, end, score in sorted(parts, key=lambda p: (p[0], -p[2], p[1])):
            if out and start < out[-1][1]:
                if score > out[-1][2]:
                    out[-1] = (start, end, score)
            else:
                out.append((start, end, score))
        return out


def excursions(scores: Iterable[float], least: float) -> Iterator[tuple[int, int, float]]:
    """(start, end, sum) of the parts whose running sum reaches ``least``, each up to its peak, in one pass.

    A part ends where the sum falls to zero or by ``least`` below its peak.
    """
    start = end = 0
    total = best = 0.0
    for at, score in enumerate(scores):
        total += score
        if total > best:
            best, end = total, at + 1
        elif total <= 0 or best - total > least:
            if best >= least:
                yield start, end, best
            start, total, best = at + 1, 0.0, 0.0
    if best >= least:
        yield start, end, best


def learn_secrets(features: DataFrame, attribute: str = DESCRIPTION, made_rows: int = MADE_ROWS, seed: int = 7) -> SecretModels:
    """Character models of random strings and of ordinary text and identifiers, counted over all descriptions.

    Labelled as secret: what the fixed patterns find, from ``LEAST_LENGTH`` characters on, each by its form, and ``made_rows`` made random strings
    per form. Labelled as ordinary: every other run of letters, digits and marks, the names of attributes and layers, and made
    identifiers. Each task counts all its rows in tables of a fixed size, (number of symbols)³ per model; only sums of these
    tables reach the driver. Nulls, empties and an empty table leave the made samples.
    """
    texts = described(features, attribute)
    names = features.select(F.concat_ws(" ", F.col("dataset_key").cast("string"), F.map_keys("props")).alias("text")).distinct()

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((MODELS, SIZE**3), np.int64)
        for batch in in_parts(batches, most=1 << 20):
            codes = []
            for text in batch.column("text").to_pylist():
                own = codes_of(text)
                for start, end, _, at in base_spans(text):
                    own[start:end] = 0
                    form = form_of(text[at:end])
                    if form is not None and end - at >= LEAST_LENGTH:
                        add_counts(counts[form], codes_of(text[at:end]))
                codes += [own, np.zeros(2, np.uint8)]
            add_counts(counts[PROSE], np.concatenate(codes))
        model, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(model, pa.int32()), pa.array(cell, pa.int32()), pa.array(counts[model, cell], pa.int64())], ["model", "cell", "n"])

    schema = "model int, cell int, n bigint"
    found = texts.select("text").mapInArrow(counted, schema).unionByName(names.select("text").mapInArrow(counted, schema))
    sums = found.groupBy("model", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((MODELS, SIZE**3), np.int64)
    counts[sums.column("model").to_numpy(), sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    for form, made in enumerate(made_secrets(made_rows, seed)):
        add_counts(counts[form], codes_of(" ".join(made)))
    add_counts(counts[MADE], codes_of(" ".join(made_identifiers(made_rows, seed))))
    return SecretModels.from_counts(counts)


def all_spans(text: str, models: SecretModels, least_length: int, least_score: float, least_mean: float) -> list[Span]:
    """Base spans, and random parts of runs that overlap none of them."""
    base = base_spans(text)
    spans: list[Span] = [(s, e, k, True, models.score(text[at:e])) for s, e, k, at in base]
    # Base spans as stretches without overlap.
    starts: list[int] = []
    ends: list[int] = []
    for start, end, *_ in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for run in RUN.finditer(text):
        if NAMED_ID.fullmatch(run[0]):
            continue
        for start, end, score in models.random_parts(run[0], least_length, least_score, least_mean):
            start, end = start + run.start(), end + run.start()
            after = bisect_right(ends, start)
            if after == len(ends) or starts[after] >= end:
                spans.append((start, end, RANDOM, False, score))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(
    features: DataFrame, models: SecretModels, attribute: str = DESCRIPTION, least_length: int = LEAST_LENGTH, least_score: float = LEAST_SCORE,
    least_mean: float = LEAST_MEAN,
) -> DataFrame:
    """``(dataset_key, feature_id, spans)`` for every feature, over its whole description.

    ``spans`` lists kind, start, end (code points, end exclusive), whether a fixed pattern found it, and the log-likelihood ratio of a random
    string to an ordinary identifier, by start and then kind (assign, access, hex, random). Base spans always stay, whatever their score.
    Of other runs of letters, digits and ``+/_.=-``, the parts of at least ``least_length`` characters are added whose ratio is at least ``least_score`` in
    all and ``least_mean`` per character. A run that is one hyphenated identifier of 32 hex digits is ordinary, and so is a part of digits alone.
    Null and empty descriptions have no spans; repeated rows are answered each; an empty table gives no rows; other columns, whatever their
    names, are ignored. Work and memory grow with the length of a text, not with its square.
    """
    texts = described(features, attribute)
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = [
                [{"kind": k, "start": s, "end": e, "base": b, "score": score} for s, e, k, b, score in all_spans(t, shared.value, least_length, least_score, least_mean)]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("dataset_key"), batch.column("feature_id"), pa.array(rows, ARROW_SPANS)], ["dataset_key", "feature_id", "spans"])

    return texts.mapInArrow(found, schema_of(texts, ("dataset_key", "feature_id"), ("spans", SPAN_TYPE)))
