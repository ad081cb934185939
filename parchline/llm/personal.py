"""Personal data in feature descriptions: fixed patterns, and a trained character tagger on top."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .records import DESCRIPTION, described, schema_of
from .tagger import KINDS, TAGS, Tagger, classes_of

Span = tuple[int, int, str, bool]

# Fixed patterns. Where a search could start anew at every character of a long run, the run is entered at its
# start only; the matches are the same.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")

WINDOW = 160
OVERLAP = 64
STRIDE = WINDOW - OVERLAP
# Training: characters of a window, state size, passes, and the bounds of the sample.
LEARNED = 80
HIDDEN = 16
EPOCHS = 10
SAMPLE_ROWS = 6000
SAMPLE_WINDOWS = 500
MADE_ROWS = 400
ROWS_AT_ONCE = 1024
SPAN_TYPE = ArrayType(
    StructType(
        [StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("base", BooleanType())]
    )
)
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            after = found.end()
        at = text.find("@", max(at + 1, after))


def small(part: str) -> bool:
    kept = part.lstrip("0")
    return len(kept) <= 3 and int(kept or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, leftmost and without overlap per kind, by start and kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(s, e, "email", True) for s, e in emails(text)]
    if "+" in text:
        found += [(m.start(), m.end(), "phone", True) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    if HINT.search(text):
        found += [(m.start(), m.end(), "ip", True) for m in IP.finditer(text) if all(map(small, m.groups()))]
        for m in CARD.finditer(text):
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card", True))
    return sorted(found, key=span_order)


def span_order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def plausible(kind: str, part: str) -> bool:
    """What a tagged span must look like to be reported beside the fixed patterns."""
    digits = digits_of(part)
    if kind == "email":
        name, _, domain = part.partition("@")
        return bool(name) and "." in domain.strip(".") and not any(c.isspace() for c in part)
    if kind == "ip":
        groups = re.findall(r"[0-9]+", part)
        return len(groups) == 4 and all(map(small, groups)) and re.fullmatch(r"[0-9]+(?:(?:\.|\[\.\]|\(\.\))[0-9]+){3}", part) is not None
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 .-]+", part) is not None
    return 10 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", part) is not None and len(digits) < len(part)


def tags_of(length: int, spans: Iterable[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for start, end, kind in spans:
        tag = 1 + 2 * KINDS.index(kind)
        tags[start:end] = tag + 1
        tags[start] = tag
    return tags


def made_windows(windows: list[str], rows: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled windows with one made-up span of each kind in turn, so that no kind is missing."""
    rng = np.random.default_rng(seed)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdeghilmnorstuy"), int(rng.integers(3, 9))))
    out = []
    for i in range(rows):
        kind = KINDS[i % len(KINDS)]
        if kind == "email":
            value = f"{word()}{rng.choice(['.', '_', ''])}{word()}@{word()}.{rng.choice(['com', 'org', 'net', 'co.uk'])}"
        elif kind == "ip":
            value = ".".join(map(str, rng.integers(0, 256, 4)))
        elif kind == "card":
            body = str(rng.integers(2, 7)) + number(14)
            value = body + next(c for c in "0123456789" if luhn(body + c))
            if i % 8 >= 4:
                value = rng.choice([" ", "-"]).join(value[j : j + 4] for j in range(0, 16, 4))
        else:
            value = rng.choice([f"+{rng.integers(1, 99)} ({number(3)}) {number(3)}-{number(4)}", f"+{rng.integers(1, 99)}{number(9)}", f"+{rng.integers(1, 99)} {number(3)} {number(3)} {number(4)}"])
        around = windows[int(rng.integers(len(windows)))] if windows else " "
        cut = int(rng.integers(0, max(1, min(len(around), LEARNED - len(value) - 2))))
        left = around[:cut].rsplit(" ", 1)[0] + " " if cut else ""
        out.append(((left + value + " " + around[cut:])[:LEARNED], [(len(left), len(left) + len(value), kind)]))
    return out


def learn_personal(
    features: DataFrame, attribute: str = DESCRIPTION, sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS,
    made_rows: int = MADE_ROWS, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7
) -> Tagger:
    """Trains the tagger on labelled windows of a bounded sample.

    At most ``sample_rows`` features, those with the smallest hash of their key, give at most two windows of
    ``LEARNED`` characters each: one around a span of the fixed patterns, labelled with all spans in it, and one without;
    ``sample_windows`` of each are used.
    ``made_rows`` more windows carry made-up spans, so each kind is learned on any table, an empty one
    included.
    """
    texts = described(features, attribute)
    total = texts.count()
    rank = F.xxhash64("feature_id", "dataset_key")
    # A range of hashes that holds twice the sample on average.
    low = F.lit(min(2 * sample_rows * 2**64 // max(total, 1), 2**64 - 1) - 2**63)

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                spans = base_spans(text)
                if spans:
                    start, end = spans[own % len(spans)][:2]
                    at = max(0, min(start - own % (LEARNED // 2), len(text) - LEARNED))
                    at = at if end - at <= LEARNED else start
                    inside = [(s - at, e - at, k) for s, e, k, _ in spans if at <= s and e <= at + LEARNED]
                    out.append((own, text[at : at + LEARNED], ",".join(f"{s}:{e}:{k}" for s, e, k in disjoint(inside))))
                at = own % max(1, len(text) - LEARNED)
                if text and all(e <= at or s >= at + LEARNED for s, e, *_ in spans):
                    out.append((own, text[at : at + LEARNED], ""))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["rank", "window", "spans"]
            )

    chosen = texts.withColumn("rank", rank).where(F.col("rank") <= low).select("rank", "text")
    sample = chosen.mapInArrow(windows, "rank bigint, window string, spans string").distinct()
    rows = sample.orderBy("rank", "window").limit(2 * sample_rows).collect()
    spanned = [r for r in rows if r["spans"]]
    plain = [r for r in rows if not r["spans"]][:sample_windows]
    parse = lambda s: [(int(a), int(b), k) for a, b, k in (x.split(":") for x in s.split(",") if x)]
    labelled = [(r["window"], parse(r["spans"])) for r in [*spanned[:sample_windows], *plain]]
    labelled += made_windows([r["window"] for r in plain], made_rows, seed)
    codes, tags = np.zeros((len(labelled), LEARNED), np.uint8), np.zeros((len(labelled), LEARNED), np.int64)
    for row, (text, spans) in enumerate(labelled):
        codes[row, : len(text)] = classes_of(text)
        tags[row, : len(text)] = tags_of(len(text), spans)
    return Tagger.fresh(hidden, seed).fit(codes, tags, epochs, seed)


def disjoint(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for span in spans:
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges of windows (first, last) that hold a digit or an at sign.

    No reportable span lies in other windows, since every kind needs one of these characters.
    """
    found: list[tuple[int, int]] = []
    at = 0
    while (hint := HINT.search(text, at)) is not None:
        low = max(0, (hint.start() - WINDOW) // STRIDE + 1)
        high = hint.start() // STRIDE
        if found and low <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(found[-1][1], high))
        else:
            found.append((low, high))
        # The next hint that can matter lies in a later window.
        at = max(hint.start() + 1, (high + 1) * STRIDE)
    return found


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Spans that the tagger finds in each text.

    Windows overlap by ``OVERLAP`` characters. The scores of a character in several windows are averaged, with more
    weight near the middle of a window, and one Viterbi path is taken over each stretch of adjoining
    windows, so a span across a window border is decided once, with all that is known of it.
    """
    jobs = [(row, low, high) for row, text in enumerate(texts) for low, high in stretches(text)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    weight = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0).astype(np.float32)[:, None]
    group: list[tuple[int, int, int]] = []
    held = 0
    for job in [*jobs, None]:
        if job is not None:
            group.append(job)
            held += job[2] - job[1] + 1
        if group and (job is None or held >= ROWS_AT_ONCE):
            decode_group(texts, group, tagger, weight, out)
            group, held = [], 0
    return out


def decode_group(texts: list[str], group: list[tuple[int, int, int]], tagger: Tagger, weight: np.ndarray, out: list) -> None:
    parts = [texts[row][low * STRIDE : high * STRIDE + WINDOW] for row, low, high in group]
    codes = [classes_of(p) for p in parts]
    sums = [np.zeros((len(p), TAGS), np.float32) for p in parts]
    weights = [np.zeros((len(p), 1), np.float32) for p in parts]
    places = [(j, (k - low) * STRIDE) for j, (_, low, high) in enumerate(group) for k in range(low, high + 1) if (k - low) * STRIDE < len(parts[j])]
    for at in range(0, len(places), ROWS_AT_ONCE):
        some = places[at : at + ROWS_AT_ONCE]
        window = np.zeros((len(some), WINDOW), np.uint8)
        for i, (j, start) in enumerate(some):
            piece = codes[j][start : start + WINDOW]
            window[i, : len(piece)] = piece
        scores = tagger.emissions(np.ascontiguousarray(window.T))
        for i, (j, start) in enumerate(some):
            n = min(WINDOW, len(parts[j]) - start)
            sums[j][start : start + n] += scores[:n, i] * weight[:n]
            weights[j][start : start + n] += weight[:n]
    # Stretches of like length share a Viterbi run; the path of a padded end is cut off.
    order = sorted(range(len(parts)), key=lambda j: len(parts[j]))
    at = 0
    while at < len(order):
        longest = at
        while longest + 1 < len(order) and len(parts[order[longest + 1]]) <= 1.25 * len(parts[order[at]]) + 32:
            longest += 1
        members = order[at : longest + 1]
        top = max(len(parts[j]) for j in members)
        scores = np.zeros((top, len(members), TAGS), np.float32)
        scores[:, :, 1:] = -20.0
        for i, j in enumerate(members):
            scores[: len(parts[j]), i] = sums[j] / weights[j]
        paths = tagger.best_tags(scores)
        for i, j in enumerate(members):
            row, low, _ = group[j]
            out[row] += [(s + low * STRIDE, e + low * STRIDE, k) for s, e, k in runs_of(paths[: len(parts[j]), i])]
        at = longest + 1


def runs_of(path: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Spans of a tag path: a begin or a change of kind opens one."""
    inside = np.flatnonzero(path)
    start = last = None
    for at in inside.tolist():
        tag = int(path[at])
        if start is not None and at == last + 1 and (tag - 1) // 2 == kind and tag % 2 == 0:
            last = at
            continue
        if start is not None:
            yield start, last + 1, KINDS[kind]
        start, last, kind = at, at, (tag - 1) // 2
    if start is not None:
        yield start, last + 1, KINDS[kind]


def all_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Base spans of each text, and tagged spans that are plausible and overlap none of them."""
    out = []
    for text, tagged in zip(texts, tagged_spans(texts, tagger), strict=True):
        spans = base_spans(text)
        for start, end, kind in sorted(tagged):
            while start < end and text[start] in " \n.,;:":
                start += 1
            while end > start and text[end - 1] in " \n.,;:":
                end -= 1
            joined = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
            if start < end and not joined and plausible(kind, text[start:end]) and all(e <= start or s >= end for s, e, *_ in spans):
                spans.append((start, end, kind, False))
        out.append(sorted(spans, key=span_order))
    return out


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind."""
    parts, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_personal(features: DataFrame, tagger: Tagger, attribute: str = DESCRIPTION, keep: tuple[str, ...] = (), masked: bool = False) -> DataFrame:
    """``(dataset_key, feature_id, spans)`` for every feature, over its whole description.

    ``spans`` lists kind, start, end (code points, end exclusive) and whether a fixed pattern found it, by start and then kind
    (email, ip, card, phone). Base spans always stay; the tagger adds spans that overlap none of them and look like
    their kind. ``keep`` names attributes to carry along and ``masked`` adds the description with its
    spans replaced by ``<KIND>``. Null and empty descriptions have no spans; repeated rows are answered each; an empty
    table gives no rows; other columns are ignored.
    """
    texts = described(features, attribute, *keep)
    shared = texts.sparkSession.sparkContext.broadcast(tagger)

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("text").to_pylist()
            spans = all_spans(values, shared.value)
            rows = [[{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in own] for own in spans]
            columns = [*[batch.column(c) for c in ("dataset_key", "feature_id", *keep)], pa.array(rows, ARROW_SPANS)]
            names = ["dataset_key", "feature_id", *keep, "spans"]
            if masked:
                columns.append(pa.array([masked_text(t, s) for t, s in zip(values, spans, strict=True)], pa.string()))
                names.append("masked")
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [("spans", SPAN_TYPE)] + ([("masked", StringType())] if masked else [])
    return texts.mapInArrow(found, schema_of(texts, ("dataset_key", "feature_id", *keep), *fields))
