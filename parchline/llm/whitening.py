"""Whitening of feature vectors: a spectrum kept up to date by rank-one updates, merged, and refined over all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import written

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
# Rows folded together before their updates, rows of a batch in memory, and spectra merged by one task.
BLOCK_ROWS = 1024
BATCH_ROWS = 2048
FAN = 16
EPS = np.finfo(np.float64).eps
ROUNDS = 60
LARGEST = 2**63 - 1
WIDEST_DECIMAL = 10**38


class Spectrum:
    """Eigenvalues (rising) and orthonormal eigenvectors (columns) of a sum of outer products, kept up by rank-one updates."""

    def __init__(self, width: int) -> None:
        self.values = np.zeros(width)
        self.vectors = np.eye(width)

    def add(self, row: np.ndarray) -> None:
        """Adds the outer product of ``row`` with itself."""
        z = self.vectors.T @ row
        size = float(np.sqrt((z * z).sum()))
        if size == 0.0:
            return
        d, u = self.values, self.vectors
        bound = 8 * EPS * max(float(d[-1]), size * size)
        # Deflation: among equal eigenvalues the axes are turned so that one of them carries the whole row ...
        equal = np.flatnonzero(np.diff(d) <= bound)
        if len(equal):
            z, u = self._turned(z, u, equal)
        # ... and an axis that carries nothing keeps its eigenvalue.
        moved = np.abs(z) * size > bound
        if not moved.any():
            return
        low, w = d[moved], z[moved]
        roots, gaps = secular_roots(low, w * w)
        # The row for which these roots are exact, so that the new axes are orthogonal however close roots are.
        apart = low[None, :] - low[:, None]
        np.fill_diagonal(apart, 1.0)
        ratio = -gaps / apart.T
        np.fill_diagonal(ratio, -np.diagonal(gaps))
        ratio = np.abs(ratio)
        w = np.copysign(np.sqrt(np.prod(ratio, axis=0)), w)
        axes = w[None, :] / gaps
        axes /= np.sqrt((axes * axes).sum(axis=1, keepdims=True))
        values, vectors = d.copy(), u.copy()
        values[moved] = roots
        vectors[:, moved] = u[:, moved] @ axes.T
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    @staticmethod
    def _turned(z: np.ndarray, u: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, u = z.copy(), u.copy()
        breaks = np.flatnonzero(np.diff(equal) > 1)
        firsts, lasts = equal[np.concatenate([[0], breaks + 1])], equal[np.concatenate([breaks, [len(equal) - 1]])] + 1
        for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
            part = z[first : last + 1]
            norm = float(np.sqrt((part * part).sum()))
            mirror = part.copy()
            mirror[-1] += math.copysign(norm, mirror[-1])
            weight = float((mirror * mirror).sum())
            if weight > 0:
                own = u[:, first : last + 1]
                u[:, first : last + 1] = own - np.outer(own @ mirror, mirror) * (2.0 / weight)
                z[first:last] = 0.0
                z[last] = -math.copysign(norm, part[-1])
        return z, u

    def add_rows(self, rows: np.ndarray, block_rows: int) -> None:
        """Adds centred rows. A block of more rows than dimensions is first turned into as many rows, with the same sum of outer products."""
        for at in range(0, len(rows), block_rows):
            block = rows[at : at + block_rows]
            if len(block) > block.shape[1]:
                block = np.linalg.qr(block, mode="r")
            for row in block:
                self.add(row)

    def merge(self, values: np.ndarray, vectors: np.ndarray) -> None:
        """Adds another spectrum, one eigenvector after the other."""
        for value, vector in zip(values.tolist(), vectors.T, strict=True):
            if value > 0:
                self.add(vector * math.sqrt(value))


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum of w / (d - root), for rising ``d`` and positive ``w``, and the matrix of d - root (root, d).

    Every root is found as a distance from the nearer of the two poles around it, by rational interpolation within a
    bracket that only shrinks.
    """
    k = len(d)
    upper = np.concatenate([d[1:], [d[-1] + w.sum()]])
    width = upper - d
    shifted = d[None, :] - d[:, None]
    middle = 1.0 + (w / (shifted - (width / 2)[:, None])).sum(axis=1)
    right = middle < 0
    right[-1] = False
    origin = np.where(right, upper, d)
    delta = d[None, :] - origin[:, None]
    low = np.where(right, -width / 2, np.where(middle < 0, width / 2, 0.0))
    high = np.where(right, 0.0, np.where(middle < 0, width, width / 2))
    tau = (low + high) / 2
    below = np.tril(np.ones((k, k), bool))
    near = np.arange(k)
    following = np.minimum(near + 1, k - 1)
    for _ in range(ROUNDS):
        gap = delta - tau[:, None]
        part = w / gap
        slope = part / gap
        f = 1.0 + part.sum(axis=1)
        low, high = np.where(f < 0, tau, low), np.where(f < 0, high, tau)
        done = np.abs(f) <= 4 * EPS * (1.0 + np.abs(part).sum(axis=1))
        if done.all():
            break
        left = np.where(below, slope, 0.0).sum(axis=1)
        beyond = slope.sum(axis=1) - left
        a, b = gap[near, near], gap[near, following]
        c = f - a * left - b * beyond
        mid = (a + b) * f - a * b * (left + beyond)
        end = a * b * f
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(mid * mid - 4 * end * c, 0.0))
            step = np.where(mid <= 0, (mid - root) / (2 * c), 2 * end / (mid + root))
            # The last root has a pole on one side only.
            last = tau[-1] + gap[-1, -1] + gap[-1, -1] ** 2 * left[-1] / (f[-1] - gap[-1, -1] * left[-1])
        new = tau + step
        new[-1] = last
        inside = (new > low) & (new < high)
        new = np.where(inside, new, (low + high) / 2)
        if (new == tau).all():
            break
        tau = np.where(done, tau, new)
    return origin + tau, delta - tau[:, None]


def whole_steps(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """floor(scale * value) + offset as whole numbers, held within 64 bits; plain integers where the machine's could overflow later."""
    scaled = np.floor(values * scale)
    if not len(scaled) or np.abs(scaled).max() < 2.0**52:
        return scaled.astype(np.int64) + offset
    held = lambda v: max(-LARGEST - 1, min(LARGEST, int(min(max(v, -1e19), 1e19)) + offset))
    return np.array([[held(v) for v in row] for row in scaled.tolist()], object)


class Centre:
    """Number of rows and exact sums of the whole table, from which every row is centred exactly before it is rounded."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        self.base = [s // n for s in sums]
        self.rest = [s - n * b for s, b in zip(sums, self.base, strict=True)]

    def distances(self, steps: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if steps.dtype != object and max(map(abs, self.base)) < 2**62:
            y = steps - np.array(self.base, np.int64)
            if not len(y) or self.n * (int(np.abs(y).max()) + 1) < math.isqrt(LARGEST // y.shape[1]):
                return self.n * y - np.array(self.rest, np.int64)
            steps = y.astype(object)
            return self.n * steps - np.array(self.rest, object)
        return self.n * (steps.astype(object) - np.array(self.base, object)) - np.array(self.rest, object)

    def centred(self, distances: np.ndarray) -> np.ndarray:
        return (distances / self.n).astype(np.float64)


def usable(values: F.Column) -> F.Column:
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return values.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrices(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            yield part, part.column("values").flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def cells(sums: np.ndarray) -> pa.RecordBatch:
    """A matrix of sums as rows (cell, value)."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], ["cell", "value"])


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of a matrix of fixed shape that ``part`` makes of a batch."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, values in matrices(batches, width):
            total += part(values)
        yield cells(total)

    found = rows.select("values").mapInArrow(work, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape)
    out.ravel()[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return out


def spectrum_of(rows: DataFrame, width: int, centre: Centre, scale: int, offset: int, block_rows: int, fan: int) -> Spectrum:
    """The spectrum of all centred rows: one per task, then merged ``fan`` at a time until one is left."""

    def packed(number: int, spectrum: Spectrum) -> pa.RecordBatch:
        arrays = [pa.array([[*a.ravel().tolist()]], pa.list_(pa.float64())) for a in (spectrum.values, spectrum.vectors)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *arrays], ["part", "values", "vectors"])

    def updated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, any_row = Spectrum(width), False
        for _, values in matrices(batches, width):
            any_row = any_row or len(values) > 0
            spectrum.add_rows(centre.centred(centre.distances(whole_steps(values, scale, offset))), block_rows)
        if any_row:
            yield packed(TaskContext.get().partitionId(), spectrum)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, spectrum = None, None
        for batch in batches:
            for part, values, vectors in zip(*[batch.column(c).to_pylist() for c in ("group", "values", "vectors")], strict=True):
                if part != number:
                    if spectrum is not None:
                        yield packed(number, spectrum)
                    number, spectrum = part, Spectrum(width)
                spectrum.merge(np.array(values), np.array(vectors).reshape(width, width))
        if spectrum is not None:
            yield packed(number, spectrum)

    schema = "part bigint, values array<double>, vectors array<double>"
    found = written(rows.select("values").mapInArrow(updated, schema), "spectra")
    most = found.agg(F.max("part")).head()[0] or 0
    while most > 0:
        most //= fan
        dealt = found.withColumn("group", F.floor(F.col("part") / fan)).repartition(most + 1, "group").sortWithinPartitions("group", "part")
        found = written(dealt.mapInArrow(merged, schema), "spectra")
    spectrum = Spectrum(width)
    for row in found.collect():
        spectrum.merge(np.array(row["values"]), np.array(row["vectors"]).reshape(width, width))
    return spectrum


def refined(rows: DataFrame, width: int, centre: Centre, spectrum: Spectrum, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz over all rows: (falling eigenvalues, eigenvectors as columns) of the covariance within the span of the spectrum's axes.

    The axes span all dimensions, so what the updates lost to rounding is put right. Each axis points to where its largest entry is positive.
    """
    basis = np.linalg.qr(spectrum.vectors)[0]

    def products(values: np.ndarray) -> np.ndarray:
        own = centre.centred(centre.distances(whole_steps(values, scale, offset))) @ basis
        return own.T @ own

    within = summed(rows, products, width, (width, width)) / centre.n
    values, turn = np.linalg.eigh((within + within.T) / 2)
    vectors = basis @ turn[:, ::-1]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(width)]
    return values[::-1], vectors * np.where(largest < 0, -1.0, 1.0)


def exact_sums(rows: DataFrame, scale: int, offset: int) -> tuple[int, int, list[int]]:
    """(dimensions, rows, sums of whole steps) of the vectors of the commonest length, of several the longest."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            lengths = np.diff(batch.column("values").offsets.to_numpy())
            for width in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == width))
                for part, values in matrices([own], width):
                    steps = whole_steps(values, scale, offset)
                    totals = [int(t) for t in (steps.astype(object) if len(steps) and abs(steps).max() > 2**40 else steps).sum(axis=0)]
                    known = sums.setdefault(width, [0] * (width + 1))
                    known[0] += len(part)
                    known[1:] = [a + b for a, b in zip(known[1:], totals, strict=True)]
        found = [(width, place, Decimal(v)) for width, own in sums.items() for place, v in enumerate(own)]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.decimal128(38, 0))], ["width", "place", "total"])

    totals = rows.select("values").mapInArrow(work, "width int, place int, total decimal(38,0)").groupBy("width", "place").agg(F.sum("total").alias("total"))
    first = totals.where("place = 0").sort(F.desc("total"), F.desc("width")).head()
    if first is None:
        return 0, 0, []
    sums = totals.where((F.col("width") == first["width"]) & (F.col("place") > 0)).sort("place").collect()
    return first["width"], int(first["total"]), [int(r["total"]) for r in sums]


def whitened_features(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, block_rows: int = BLOCK_ROWS, fan: int = FAN
) -> DataFrame:
    """Every feature's vector along the principal components of all of them, each with unit variance.

    ``vectors`` holds ``feature_id`` and ``values``, such as the months of a feature's series, or an embedding; other columns, whatever their names,
    are ignored. A value counts as the whole number of its steps, floor(``scale`` * value) + ``offset``, held within 64 bits. The covariance is over all
    rows, with their number as divisor, and every row is centred before it is multiplied, exactly.

    Each task updates eigenvalues and axes of its rows by rank-one updates (secular equation, deflation), ``block_rows`` rows at a time turned into at
    most as many rows as there are dimensions (1: every row by itself). Spectra are merged by further rank-one updates, ``fan`` to a task, and a
    Rayleigh-Ritz pass over all rows refines them. What reaches the driver has the size of one covariance, whatever the rows.

    Returns one row per feature and component, up to ``components`` by falling eigenvalue: ``feature_id, component`` (from 1), ``n``, ``deviation`` (sum over dimensions of
    (n * x - S)², exact; null beyond 38 digits), ``whitened``, ``explained`` (share of the total variance) and ``identity_error`` (the largest entry of
    the covariance of what is returned, less the identity). Components without variance are left out, so equal rows alone give none. Vectors that are null or
    empty, or hold a null or a non-finite entry, take no part, nor do those of another length than the commonest (of several the longest);
    repeated rows count and return each; a null key stays null; an empty table gives no rows.
    """
    rows = vectors.select("feature_id", F.col("values").cast("array<double>").alias("values"))
    rows = rows.where(usable(F.col("values")) & (F.size("values") > 0))
    id_type = rows.schema["feature_id"].dataType.simpleString()
    schema = f"feature_id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    width, n, sums = exact_sums(rows, scale, offset)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("values") == width)
    centre = Centre(n, sums)
    values, axes = refined(rows, width, centre, spectrum_of(rows, width, centre, scale, offset, block_rows, fan), scale, offset)
    kept = int((values[:components] > width * EPS * max(float(values[0]), 0.0)).sum())
    explained = values[:kept] / values.sum() if kept else values[:0]
    turn = axes[:, :kept] / np.sqrt(values[:kept])

    def along(steps: np.ndarray) -> np.ndarray:
        return centre.centred(centre.distances(steps)) @ turn

    def moments(batch: np.ndarray) -> np.ndarray:
        own = along(whole_steps(batch, scale, offset))
        return np.vstack([own.T @ own, own.sum(axis=0)])

    # The rows are centred already; what rounding leaves of their mean is taken out.
    found = summed(rows, moments, width, (kept + 1, kept)) / n
    error = float(np.abs(found[:kept] - np.outer(found[kept], found[kept]) - np.eye(kept)).max()) if kept else 0.0

    def white(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in matrices(batches, width):
            steps = whole_steps(own, scale, offset)
            far = centre.distances(steps)
            deviation = [d if d < WIDEST_DECIMAL else None for d in map(int, (far * far).sum(axis=1))]
            take = pa.array(np.repeat(np.arange(len(batch)), kept))
            decimals = pa.array([None if d is None else Decimal(d) for d in deviation], pa.decimal128(38, 0))
            size = len(batch) * kept
            yield pa.RecordBatch.from_arrays(
                [batch.column("feature_id").take(take), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(batch))), pa.array(np.full(size, n, np.int64)), decimals.take(take),
                 pa.array(along(steps).ravel()), pa.array(np.tile(explained, len(batch))), pa.array(np.full(size, error))],
                ["feature_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(white, schema)
