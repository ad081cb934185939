"""Byte strings that occur twice: a merge sort of sampled suffixes that knows common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .passages import merged
from .records import DESCRIPTION, described, in_parts, schema_of, written

LENGTH = 200
GRAM = 16
CHUNK = 1 << 20
SLICE = 24 << 20
TASK_SUFFIXES = 40_000
HOT = 200_000
SEED = 977
RUNS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, 256, np.uint64), rng.integers(0, 2**63, 8, np.uint64) | np.uint64(1)


BYTES, FACTORS = tables()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at every place, by doubling."""
    h, width, step = BYTES[data], 1, 0
    while width < GRAM:
        h = h[:-width] * FACTORS[step] + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width, step = 2 * width, step + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` adjoining values, in two passes over blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts ``data[bounds[i]:bounds[i + 1]]`` that stand for their strings of ``length`` bytes, and their hashes.

    Every such string has one anchor: the place, within it, of the leftmost of its grams with the least hash. Equal strings have
    their anchors at equal places, so two equal strings meet wherever two equal grams at anchors do.
    """
    places, hashes = [], []
    low = np.uint64(2 * CHUNK - 1)
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        h = gram_hashes(part)
        least = window_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        # A string may not reach over the end of its text.
        over = np.zeros(len(part) + 1, np.int32)
        near = bounds[(bounds > at) & (bounds < at + len(part) + length)] - at
        np.add.at(over, np.clip(near - length + 1, 0, len(part)), 1)
        np.add.at(over, np.minimum(near, len(part)), -1)
        fits = np.cumsum(over[: len(least)]) == 0
        found = np.unique(least[fits] & low).astype(np.int64)
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows, without copies."""
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    bounds = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return every[bounds[0] : bounds[-1]], bounds - bounds[0]


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the ``length`` bytes from each place on and then those before it, backwards; and how many of either there are.

    Bytes beyond the text are 255, which no UTF-8 text holds.
    """
    ahead, back = np.arange(length), np.arange(1, length - GRAM + 1)
    right = np.minimum(ends - places, length)
    left = np.minimum(places - starts, length - GRAM)
    out = np.full((len(places), length + len(back)), 255, np.uint8)
    for at in range(0, len(places), 4096):
        part = slice(at, at + 4096)
        here = places[part, None]
        out[part, :length] = np.where(ahead < right[part, None], data[np.minimum(here + ahead, len(data) - 1)], 255)
        out[part, length:] = np.where(back <= left[part, None], data[np.maximum(here - back, 0)], 255)
    return out, right, left


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 4096):
        a, b = rows[at - 1 : min(at + 4095, len(rows) - 1)], rows[at : at + 4096]
        differ = a != b
        out[at : at + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def packed_run(rows: np.ndarray, right: np.ndarray, left: np.ndarray, several: np.ndarray, names: np.ndarray, places: np.ndarray) -> bytes:
    """A sorted run, front coded: of each row only what follows the prefix it shares with the row before."""
    shared = common_prefixes(rows)
    tails = rows[np.arange(rows.shape[1]) >= shared[:, None]]
    parts = [np.array([len(rows), rows.shape[1]], "<u4"), shared.astype("<u2"), right.astype("<u2"), left.astype("<u2"), several.astype("u1"), names, places.astype("<u4"), tails]
    return b"".join(p.tobytes() for p in parts)


class Run:
    """Reads a packed run: rows one by one, the other columns as arrays."""

    def __init__(self, packed: bytes) -> None:
        n, self.width = np.frombuffer(packed, "<u4", 2).tolist()
        at = 8
        columns = []
        for kind, each in (("<u2", 1), ("<u2", 1), ("<u2", 1), ("u1", 1), ("u1", 16), ("<u4", 1)):
            columns.append(np.frombuffer(packed, kind, n * each, at))
            at += columns[-1].nbytes
        shared, self.right, self.left, self.several, names, self.places = columns
        self.names = names.reshape(n, 16)
        self.shared, self.packed, self.at, self.row, self.text = shared.tolist(), packed, at, 0, b""

    def next(self) -> tuple[int, bytes] | None:
        """(prefix shared with the row before, row)."""
        if self.row == len(self.shared):
            return None
        shared = self.shared[self.row]
        end = self.at + self.width - shared
        self.text = self.text[:shared] + self.packed[self.at : end]
        self.at, self.row = end, self.row + 1
        return shared, self.text


def first_difference(x: bytes, y: bytes, at: int) -> int:
    """The first place from ``at`` on where two rows of equal length differ."""
    end = len(x)
    while at < end:
        a, b = x[at : at + 16], y[at : at + 16]
        if a != b:
            for i, (p, q) in enumerate(zip(a, b, strict=True)):
                if p != q:
                    return at + i
        at += 16
    return end


def merged_runs(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, row, prefix shared with the row given before, row) of all runs in order, by a loser tree.

    Each run's head knows how much of the last winner it begins with. The head that shares more is the smaller one, and
    nothing is compared; only heads that share equally much are compared, from there on, and the loser
    notes where it differs. So no prefix is compared twice.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[bytes | None] = [None] * size
    known = [0] * size
    rows = [-1] * size

    def advance(s: int) -> None:
        got = runs[s].next()
        rows[s] += 1
        known[s], heads[s] = got if got else (0, None)

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        at = first_difference(x, y, known[a])
        if at == len(x) or x[at] < y[at]:
            known[b] = at
            return a, b
        known[a] = at
        return b, a

    for s in range(len(runs)):
        advance(s)
        known[s] = 0
    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while heads[best] is not None:
        yield best, rows[best], known[best], heads[best]
        advance(best)
        node = (best + size) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


class LeastOf:
    """Least value of any range of an array, by a table over powers of two."""

    def __init__(self, x: np.ndarray) -> None:
        self.rows = [x]
        width = 1
        while 2 * width <= len(x):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of ``x[low:high]``, elementwise; no range is empty."""
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for p in np.unique(power):
            at = power == p
            out[at] = np.minimum(self.rows[p][low[at]], self.rows[p][high[at] - (1 << int(p))])
        return out


def matches(rows: np.ndarray, shared: np.ndarray, right: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of sorted contexts, how far repeated strings around its place reach, to the left and to the right.

    Two places with equal contexts for ``l`` bytes before and ``r`` from them on hold an equal string of ``l + r`` bytes; it counts if
    that is at least ``length``. All such strings hold the place, so they join up to one stretch: the largest ``l`` and
    the largest ``r``. Rows that share ``r`` bytes adjoin in order; among them the longest common left part is with a neighbour in
    the order of the left contexts. So ``r`` goes down over the prefix lengths that occur, and at each the
    neighbours within the groups are looked up.
    """
    n = len(rows)
    reach_left, reach_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return reach_left, reach_right
    shared = np.minimum(shared, length)
    shared[1:] = np.minimum(shared[1:], np.minimum(right[1:], right[:-1]))
    back = np.ascontiguousarray(rows[:, length:])
    order = np.argsort(back.view(f"S{back.shape[1]}").ravel(), kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    common = common_prefixes(back[order])
    common[1:] = np.minimum(common[1:], np.minimum(left[order][1:], left[order][:-1]))
    least = LeastOf(common)
    for r in np.unique(shared)[::-1]:
        if r < GRAM:
            break
        joined = shared >= r
        several = joined.copy()
        several[:-1] |= joined[1:]
        some = np.flatnonzero(several)
        group = np.cumsum(~joined)[some]
        by = np.lexsort((place[some], group))
        some, group = some[by], group[by]
        pair = np.flatnonzero(group[1:] == group[:-1])
        a, b = some[pair], some[pair + 1]
        l = least.of(place[a] + 1, place[b] + 1)
        good = l + r >= length
        # A row is at most once the first and once the second of a pair.
        for side in (a[good], b[good]):
            reach_left[side] = np.maximum(reach_left[side], l[good])
            reach_right[side] = np.maximum(reach_right[side], r)
    return reach_left, reach_right


def repeated_bytes(features: DataFrame, attribute: str = DESCRIPTION, length: int = LENGTH, task_suffixes: int = TASK_SUFFIXES, hot: int = HOT) -> DataFrame:
    """Bytes of descriptions covered by a string of ``length`` bytes that also starts somewhere else.

    Descriptions are UTF-8 bytes; strings lie within one description but may recur in the same one,
    overlapping too. All is judged on the input.

    Suffixes are sorted at sampled places only: every string of ``length`` bytes has one anchor, the place of its least gram
    hash, and equal strings have it at the same place. Anchors whose gram is seen once, in all texts, cannot
    matter; counts with partial aggregates find them. Each task sorts the others of a slice of text by what follows
    and precedes them and sends them, front coded, as sorted runs to the task of their gram; there a loser tree merges
    the runs without comparing a known prefix again, and yields the common prefixes that ``matches`` needs.
    Equal contexts of one slice are sent once, and their places answered at once.

    Copies of a whole description are folded before anything is shuffled: they are repeated entirely. A gram at more than ``hot``
    anchors is not gathered: the strings around these anchors are counted by digest instead, which gives the same
    bytes. ``task_suffixes`` is the number of anchors per merging task.

    Returns one row per input row: ``dataset_key, feature_id, n_bytes, removed`` (maximal runs, start and end in bytes) and ``kept``
    (the other bytes joined). Null and empty descriptions have no bytes; repeated rows are copies of
    each other; an empty table gives no rows; other columns are ignored.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    texts = described(features, attribute).withColumn("content", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    # Never null, but said aloud: joins would add this filter on one use of the texts and not on the other.
    texts = texts.where(F.col("content").isNotNull())

    def anchored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, most=SLICE):
            data, bounds = buffer_of(batch.column("text"))
            place, hashes = anchors(data, bounds, length)
            row = np.searchsorted(bounds, place, "right") - 1
            # Of copies within a slice one is enough.
            seen: set[bytes] = set()
            first = np.array([not (c in seen or seen.add(c)) for c in batch.column("content").to_pylist()], bool)
            keep = first[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[keep].view(np.int64)), batch.column("content").take(pa.array(row[keep])), pa.array((place - bounds[row])[keep].astype(np.int32))],
                ["gram", "content", "place"],
            )

    found = texts.mapInArrow(anchored, "gram bigint, content binary, place int")
    # Written, so that the join shuffles both sides and a hot gram can be split.
    repeated = written(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > hot).alias("hot")), "grams")
    wanted = written(
        found.join(repeated, "gram").groupBy("content").agg(
            F.collect_set(F.when(~F.col("hot"), F.col("place"))).alias("places"), F.collect_set(F.when(F.col("hot"), F.col("place"))).alias("hot_places")
        ),
        "anchors",
    )
    total, any_hot = wanted.agg(F.sum(F.size("places")), F.max(F.size("hot_places"))).first()
    tasks = max(1, -(-(total or 0) // task_suffixes))
    # Both uses of this aggregate keep all its columns, so its shuffle is made once.
    whole = texts.groupBy("content").agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.min(F.struct("dataset_key", "feature_id")).alias("key"))
    asked = whole.join(wanted, "content")

    def sorted_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, most=SLICE):
            data, bounds = buffer_of(batch.column("text"))
            lists = batch.column("places")
            counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
            row = np.repeat(np.arange(len(batch)), counts)
            local = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(local):
                continue
            place = local + bounds[row]
            names = np.frombuffer(b"".join(batch.column("content").to_pylist()), np.uint8).reshape(-1, 16)
            # Dealt by the first gram, so places with equal grams meet.
            grams = np.zeros(len(place), np.uint64)
            for i in range(GRAM):
                grams = (grams ^ data[place + i]) * np.uint64(0x100000001B3)
            to = ((grams ^ (grams >> np.uint64(32))) % np.uint64(tasks)).astype(np.int64)
            for at in np.array_split(np.argsort(to, kind="stable"), max(1, -(-len(to) // 60_000))):
                yield from runs_of(data, bounds, row[at], place[at], local[at], to[at], names)

    def runs_of(data: np.ndarray, bounds: np.ndarray, row: np.ndarray, place: np.ndarray, local: np.ndarray, to: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        context, right, left = contexts(data, bounds[row], bounds[row + 1], place, length)
        order = np.argsort(context.view(f"S{context.shape[1]}").ravel(), kind="stable")
        order = order[np.argsort(to[order], kind="stable")]
        context, right, left, row, local, to = context[order], right[order], left[order], row[order], local[order], to[order]
        same = (common_prefixes(context) == context.shape[1]) & (np.concatenate([[-1], to[:-1]]) == to)
        first = np.flatnonzero(~same)
        several = np.diff(np.append(first, len(same))) > 1
        out: list[tuple] = []
        cuts = np.flatnonzero(np.diff(to[first])) + 1
        for part, many in zip(np.split(first, cuts), np.split(several, cuts), strict=True):
            out.append((int(to[part[0]]), packed_run(context[part], right[part], left[part], many, names[row[part]], local[part]), None, 0, 0))
        # Places with a twin in this slice are known to the full; they go where their text's hash says.
        twin = same.copy()
        twin[:-1] |= same[1:]
        for i in np.flatnonzero(twin & (right + left >= length)).tolist():
            name = names[row[i]].tobytes()
            out.append((int.from_bytes(name[:4], "little") % tasks, None, name, int(local[i] - left[i]), int(local[i] + right[i])))
        yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["task", "run", "content", "start", "end"])

    def merging(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, runs = None, []

        def answered() -> pa.RecordBatch:
            name, start, end = [], [], []
            if runs:
                opened = [Run(r) for r in runs]
                every = list(merged_runs(opened))
                of, at = np.array([e[0] for e in every]), np.array([e[1] for e in every])
                shared = np.array([e[2] for e in every], np.int64)
                rows = np.frombuffer(b"".join(e[3] for e in every), np.uint8).reshape(len(every), -1)
                first = np.cumsum([0] + [len(r.shared) for r in opened])[of] + at
                column = lambda c: np.concatenate([getattr(r, c) for r in opened])[first]
                right, left, several, names, places = column("right").astype(np.int64), column("left").astype(np.int64), column("several"), column("names"), column("places").astype(np.int64)
                lefts, rights = matches(rows, shared, right, left, length)
                hit = np.flatnonzero((lefts + rights >= length) & (several == 0))
                name, start, end = [n.tobytes() for n in names[hit]], places[hit] - lefts[hit], places[hit] + rights[hit]
            return pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["content", "start", "end"])

        for batch in batches:
            known = batch.filter(batch.column("content").is_valid())
            yield pa.RecordBatch.from_arrays([known.column(c) for c in ("content", "start", "end")], ["content", "start", "end"])
            sent = batch.filter(batch.column("run").is_valid())
            for to, run in zip(sent.column("task").to_pylist(), sent.column("run"), strict=True):
                if to != task:
                    if runs:
                        yield answered()
                    task, runs = to, []
                runs.append(run.as_py())
        if runs:
            yield answered()

    sent = asked.mapInArrow(sorted_runs, "task int, run binary, content binary, start int, end int")
    spans = sent.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(merging, "content binary, start int, end int")
    if any_hot:
        def strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_parts(batches, most=CHUNK):
                digests, names, starts = [], [], []
                for text, content, places in zip(*[batch.column(c).to_pylist() for c in ("text", "content", "hot_places")], strict=True):
                    raw = text.encode()
                    begins = {s for p in places for s in range(max(0, p - length + GRAM), min(p, len(raw) - length) + 1)}
                    for s in begins:
                        digests.append(hashlib.blake2b(raw[s : s + length], digest_size=16).digest())
                        names.append(content)
                        starts.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(names, pa.binary()), pa.array(starts, pa.int32())], ["digest", "content", "start"])

        every = asked.where(F.size("hot_places") > 0).mapInArrow(strings, "digest binary, content binary, start int")
        twice = every.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
        spans = spans.unionByName(every.join(twice, "digest", "left_semi").select("content", "start", (F.col("start") + length).alias("end")))
    runs = spans.groupBy("content").agg(F.collect_list(F.struct("start", "end")).alias("runs"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            sizes, removed, kept = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                raw, at, parts = text.encode(), 0, []
                joined = merged((r["start"], r["end"]) for r in own or [])
                for start, end in joined:
                    parts.append(raw[at:start])
                    at = end
                sizes.append(len(raw))
                removed.append([{"start": s, "end": e} for s, e in joined])
                kept.append(b"".join([*parts, raw[at:]]))
            key = batch.column("key")
            yield pa.RecordBatch.from_arrays(
                [key.field("dataset_key"), key.field("feature_id"), pa.array(sizes, pa.int64()), pa.array(removed, ARROW_RUNS), pa.array(kept, pa.binary())],
                ["dataset_key", "feature_id", "n_bytes", "removed", "kept"],
            )

    schema = schema_of(texts, ("dataset_key", "feature_id"), ("n_bytes", LongType()), ("removed", RUNS), ("kept", BinaryType()))
    single = whole.join(runs, "content", "left").where("copies = 1").mapInArrow(cut, schema)
    # Of a text with copies either all is repeated or, if it is too short, nothing.
    copied = written(texts.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content"), "copied")
    size = F.octet_length("text")
    brief = texts.select("dataset_key", "feature_id", "content", size.cast("int").alias("size"), F.when(size < length, F.col("text")).otherwise("").alias("rest"))
    long = F.col("size") >= length
    run = F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end")))
    several = brief.join(copied, "content", "left_semi").select(
        "dataset_key", "feature_id", F.col("size").cast("bigint").alias("n_bytes"), F.when(long, run).otherwise(F.array().cast(RUNS)).alias("removed"),
        F.col("rest").cast("binary").alias("kept"),
    )
    return single.union(several)
