"""Monotonic trend of monthly series: Mann-Kendall with the Hamed-Rao (1998)
variance correction, and the Sen slope.

A series has at most one value per month, so its sorted values fit in one array
cell. Spark groups and shuffles the series; the statistics of one array are computed
by a small numpy kernel on Arrow batches in n log n: pairs are counted by a merge
sort, and the median slope is selected by such counts, so a series may have any length.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import trend_category, trend_label_en, trend_label_fa, trend_symbol
from ..functions.normal import normal_cdf
from .series import Keys

KERNEL_SCHEMA = T.StructType(
    [T.StructField("n", T.IntegerType())]
    + [T.StructField(name, T.DoubleType()) for name in ("s", "variance", "corrected", "slope", "z", "p")]
)
# Fixed value: two-sided 5 % point of the standard normal.
Z_CRITICAL = 1.959963984540054
# Pairs looked at one by one; where a series has more, the rank of candidate slopes is counted first.
LISTED_PAIRS = 1 << 19
SAMPLED_PAIRS = 1 << 16
# Up to here lagged products are summed directly, beyond by Fourier transform.
DIRECT_LAGS = 2048
EPS = float(np.finfo(float).eps)


def average_ranks(values: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties sharing their mean rank."""
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2.0)[inverse]


def inversions(places: np.ndarray, listed: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of pairs of a permutation whose larger member stands first; if ``listed``, also both members of each.

    A merge sort by widths: what a right half finds left of itself is looked up for all halves of a width at once.
    """
    size = 1 << max(0, int(places.size - 1).bit_length())
    runs = np.concatenate([places, np.arange(places.size, size)]).astype(np.int64)
    total, larger, smaller = 0, [], []
    width = 1
    while width < size:
        halves = runs.reshape(-1, 2, width)
        shift = np.arange(len(halves), dtype=np.int64)[:, None] * size
        left, right = halves[:, 0].ravel(), halves[:, 1].ravel()
        # Passed: how many of the left half come before a member of the right half.
        found = np.searchsorted((halves[:, 0] + shift).ravel(), (halves[:, 1] + shift).ravel())
        behind = (np.arange(len(halves))[:, None] * width + width).repeat(width, axis=1).ravel() - found
        count = int(behind.sum())
        total += count
        if listed and count:
            first = np.cumsum(behind) - behind
            larger.append(left[found.repeat(behind) + np.arange(count) - first.repeat(behind)])
            smaller.append(right.repeat(behind))
        runs = np.sort(runs.reshape(-1, 2 * width), axis=1).ravel()
        width *= 2
    nothing = np.zeros(0, np.int64)
    return total, np.concatenate([nothing, *larger]), np.concatenate([nothing, *smaller])


def kendall_score(y: np.ndarray, ties: np.ndarray) -> float:
    """Rising less falling pairs."""
    falling = inversions(np.argsort(y, kind="stable"))[0]
    n = y.size
    return float(n * (n - 1) // 2 - int((ties * (ties - 1) // 2).sum()) - 2 * falling)


@lru_cache(maxsize=2)
def _all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, k=1)


class Slopes:
    """Slopes of all pairs of a series, by rank, without listing more of them than ``LISTED_PAIRS`` or a few per value."""

    def __init__(self, y: np.ndarray) -> None:
        self.y, self.n = y, y.size
        self.pairs = self.n * (self.n - 1) // 2
        self.limit = max(LISTED_PAIRS, 4 * self.n)
        self.index = np.arange(self.n)

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (self.y[second] - self.y[first]) / (second - first)

    def order(self, slope: float) -> np.ndarray:
        """Values by their height over a line; of equal heights the later comes first, so that pairs up to ``slope`` stand inverted."""
        return np.lexsort((-self.index, self.y - slope * self.index))

    def up_to(self, slope: float) -> int:
        return inversions(self.order(slope))[0]

    def between(self, low: float, high: float) -> np.ndarray:
        """Slopes above ``low`` and up to ``high``, sorted: the pairs that change places between the two orders."""
        back = np.empty(self.n, np.int64)
        ahead = self.order(high)
        back[ahead] = self.index
        _, larger, smaller = inversions(back[self.order(low)], listed=True)
        first, second = ahead[larger], ahead[smaller]
        return np.sort(self.of(np.minimum(first, second), np.maximum(first, second)))

    def rounding(self, slope: float) -> float:
        """How far a slope may be off in a comparison of heights."""
        return 8 * EPS * (float(np.abs(self.y).max()) + abs(slope) * self.n)

    def median(self) -> float:
        if self.pairs <= self.limit:
            return float(np.median(self.of(*_all_pairs(self.n))))
        ranks = ((self.pairs - 1) // 2, self.pairs // 2)
        run = self._around(ranks[0])
        other = run if ranks[1] < run[1] else self._around(ranks[1])
        pick = lambda rank, run: float(run[2][min(rank - run[0], len(run[2]) - 1)])
        return (pick(ranks[0], run) + pick(ranks[1], other)) / 2

    def _around(self, rank: int) -> tuple[int, int, np.ndarray]:
        """Ranks (from 0, end exclusive) of a run of slopes that holds the one of ``rank``, and the sorted slopes, or one for all.

        A sample of pairs proposes a bracket, which then shrinks by counting until few enough pairs are left. A slope that more pairs than that
        share to within rounding stands for all of them.
        """
        random = np.random.default_rng(self.n)
        first = random.integers(0, self.n - 1, SAMPLED_PAIRS)
        second = random.integers(0, self.n, SAMPLED_PAIRS)
        good = first != second
        sample = np.sort(self.of(np.minimum(first, second)[good], np.maximum(first, second)[good]))
        steps = np.diff(self.y)
        low, high = float(steps.min()), float(steps.max())
        low, high = low - abs(low) - 1.0, high + abs(high) + 1.0
        below, upto = 0, self.pairs
        place = int((rank + 0.5) / self.pairs * len(sample))
        spread = int(1.5 * math.sqrt(len(sample))) + 2
        # The steepest pairs are neighbours, so no slope lies outside the first bracket.
        tried = [float(sample[place - spread])] if place >= spread else []
        tried += [float(sample[place + spread])] if place + spread < len(sample) else []
        while upto - below > self.limit:
            if tried:
                pivot = tried.pop(0)
            else:
                inside = sample[np.searchsorted(sample, low, "right") : np.searchsorted(sample, high, "left")]
                pivot = float(inside[len(inside) // 2]) if len(inside) else (low + high) / 2
            margin = self.rounding(pivot)
            # A shared slope is approached from both sides.
            pivot = pivot - margin if pivot - margin > low else pivot + margin
            if not low < pivot < high:
                pivot = (low + high) / 2
                if high - low <= 4 * self.rounding(pivot):
                    shared = sample[(sample >= low - margin) & (sample <= high + margin)]
                    return below, upto, shared[len(shared) // 2 :][:1] if len(shared) else np.array([pivot])
            count = self.up_to(pivot)
            if count <= rank:
                low, below = pivot, count
            else:
                high, upto = pivot, count
        return below, upto, self.between(low, high)


def lagged(centred: np.ndarray) -> np.ndarray:
    """Sums of products of values 1, 2, … places apart."""
    n = centred.size
    if n <= DIRECT_LAGS:
        return np.correlate(centred, centred, mode="full")[n:]
    size = 1 << (2 * n - 1).bit_length()
    return np.fft.irfft(np.abs(np.fft.rfft(centred, size)) ** 2, size)[1:n]


def pair_statistics(values: np.ndarray) -> tuple[int, float, float, float, float]:
    """n, score, tie-corrected variance, variance after Hamed-Rao, Sen slope of one series."""
    y = np.asarray(values, dtype=float)
    y = y[np.isfinite(y)]
    n = y.size
    if n < 2:
        return n, 0.0, 0.0, 0.0, 0.0
    _, ties = np.unique(y, return_counts=True)
    score = kendall_score(y, ties)
    slope = Slopes(y).median()
    ties = ties.astype(float)
    variance = (n * (n - 1.0) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18.0
    if n < 3:
        return n, score, variance, variance, slope
    ranks = average_ranks(y - slope * np.arange(1, n + 1))
    centred = ranks - ranks.mean()
    power = float(centred @ centred)
    if power == 0.0:
        return n, score, variance, math.nan, slope
    lags = np.arange(1, n)
    rho = lagged(centred) / power
    strong = np.abs(rho) > Z_CRITICAL / math.sqrt(n)
    weight = (n - lags) * (n - lags - 1.0) * (n - lags - 2.0)
    inflation = 1.0 + 2.0 / (n * (n - 1.0) * (n - 2.0)) * float((weight * rho)[strong].sum())
    return n, score, variance, variance * inflation, slope


def two_sided(score: float, variance: float) -> tuple[float | None, float | None]:
    """z with continuity correction and its two-sided probability; none without a variance."""
    if score == 0.0:
        return 0.0, 1.0
    if not variance > 0.0:
        return None, None
    z = (score - math.copysign(1.0, score)) / math.sqrt(variance)
    return z, math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(KERNEL_SCHEMA)
def _pair_statistics(values: pd.Series) -> pd.DataFrame:
    rows = [(*row, *two_sided(row[1], row[3])) for row in map(pair_statistics, values)]
    return pd.DataFrame(rows, columns=KERNEL_SCHEMA.names)


def _scored(series: DataFrame, keys: Keys, value: str) -> DataFrame:
    """One row per series; the array is ordered by month whatever order rows arrive in."""
    v = F.col(value)
    points = F.collect_list(F.when(v.isNotNull(), F.struct(F.col("date"), v.alias("v"))))
    ordered = F.transform(F.sort_array(points), lambda p: p["v"])
    # The kernel's cost is in Python, not in bytes: a fixed partition count keeps
    # adaptive execution from gathering many series in few tasks. Same one exchange.
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return series.repartition(tasks, *keys).groupBy(*keys).agg(ordered.alias("_values")).select(
        *keys, _pair_statistics("_values").alias("_k")
    )


def _z(score: Column, variance: Column) -> Column:
    step = F.when(score > 0, score - 1).when(score < 0, score + 1).otherwise(F.lit(0.0))
    return F.when(score == 0, F.lit(0.0)).when(variance > 0, step / F.sqrt(variance))


def trend_statistics(series: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Trend of each series with the corrected test (the plain one for two values).

    Where the corrected variance is not positive the test has no answer: p is 1.
    """
    k = F.col("_k")
    n = k["n"].cast("double")
    tested = _scored(series, keys, value).select(
        *keys,
        F.when(n >= 2, k["s"] / (n * (n - 1) / 2.0)).otherwise(0.0).alias("tau"),
        k["z"].alias("z"),
        k["slope"].alias("sen_slope"),
        F.coalesce(k["p"], F.lit(1.0)).alias("p_value"),
    )
    significant = F.abs(F.col("z")) > Z_CRITICAL
    direction = (
        F.when(significant & (F.col("z") > 0), "increasing")
        .when(significant & (F.col("z") < 0), "decreasing")
        .otherwise("no trend")
    )
    return with_trend_labels(tested.withColumn("trend", direction)).drop("z")


def with_trend_labels(stats: DataFrame) -> DataFrame:
    category = F.col("trend_category")
    return (
        stats.withColumn("trend_category", trend_category(F.col("sen_slope"), F.col("p_value")))
        .withColumn("trend_label_en", trend_label_en(category))
        .withColumn("trend_label_fa", trend_label_fa(category))
        .withColumn("trend_symbol", trend_symbol(category))
    )


def plain_trend(series: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """The simpler test: no tie or autocorrelation correction, approximate normal CDF."""
    k = F.col("_k")
    n = k["n"].cast("double")
    enough = k["n"] >= 2
    z = _z(k["s"], n * (n - 1) * (n * 2 + 5) / 18.0)
    slope = F.when(enough, k["slope"])
    return _scored(series, keys, value).select(
        *keys,
        F.when(enough, k["s"] / (n * (n - 1) / 2.0)).alias("tau"),
        F.when(enough, (F.lit(1.0) - normal_cdf(F.abs(z))) * 2.0).alias("p_value"),
        slope.alias("sen_slope"),
        F.when(~enough, "—")
        .when(slope > 0, "increasing")
        .when(slope < 0, "decreasing")
        .otherwise("stable")
        .alias("trend"),
    )
