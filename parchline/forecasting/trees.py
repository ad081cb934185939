"""Training of forests and boosted trees from cells.

A tree sees its inputs as bins, some thirty for each column, so rows with the same bins are one cell to it and a tree is grown from sums
per cell: weight, sum and sum of squares of the target. Lags have a few bins each and the other inputs of a month depend on its
date, so cells stay few however many rows there are. All passes over the rows are Spark jobs: one finds the bins, one or two gather the
cells. What they give is broadcast, bounded by ``MOST_UNITS``; the trees of a forest are dealt over tasks, and boosted trees, each of
which needs the one before, are grown by one task without a job in between.

Rows are drawn one by one, as MLlib draws them. Beyond ``MOST_UNITS`` rows those of a cell are dealt at random into lots, as many as the bound
allows, and lots are drawn. The rules of a tree are MLlib's, and so is the model that comes out.
"""

from __future__ import annotations

import json
import math
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Rows, or lots of rows, that are drawn for a tree: what is broadcast and held by a task.
MOST_UNITS = 1 << 22
MOST_LOTS = 256
# Quantiles from which the bins of a column are chosen, and the error of their ranks.
QUANTILES, ACCURACY = 1024, 4096
# Columns with few bins between them are counted together.
MOST_CODES = 128
# Nodes whose counts are held at once.
NODE_BLOCK = 2048
# Gains below this share of a node's mean square are rounding.
ROUNDING = 1e-13
TASKS_PER_CORE = 4
# The driver gathers the cells of one fit at a time.
GATHERING = threading.Lock()
NODES = "tree int, id int, prediction double, impurity double, weight double, total double, squares double, gain double, left int, right int, feature int, threshold double"


@dataclass(frozen=True)
class Rules:
    depth: int
    leaf: int
    least_gain: float
    columns: int
    share: float
    replaced: bool
    rate: float | None
    trees: int
    seed: int

    @staticmethod
    def of(estimator: RandomForestRegressor | GBTRegressor, width: int) -> Rules:
        boosted = isinstance(estimator, GBTRegressor)
        strategy = estimator.getFeatureSubsetStrategy()
        for asked, known in ((estimator.getMaxBins() <= 256, "at most 256 bins"), (estimator.getMinWeightFractionPerNode() == 0, "no least weight")):
            if not asked:
                raise ValueError(f"trees are grown with {known}")
        return Rules(
            estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain(),
            width if strategy == "all" else max(1, math.ceil(float(strategy) * width)), estimator.getSubsamplingRate(),
            not boosted and estimator.getBootstrap(), estimator.getStepSize() if boosted else None,
            estimator.getMaxIter() if boosted else estimator.getNumTrees(), estimator.getSeed(),
        )


def thresholds(rows: DataFrame, inputs: str, width: int, bins: int) -> list[np.ndarray]:
    """Between which values each column is cut: all of its values if they are few, else so that bins hold about as many rows."""
    at = vector_to_array(inputs)
    ranks = [k / QUANTILES for k in range(QUANTILES + 1)]
    found = rows.agg(*[F.percentile_approx(at[i], ranks, ACCURACY).alias(f"c{i}") for i in range(width)]).first()
    cuts = []
    for values in map(np.asarray, found):
        known = np.unique(values)
        if len(known) > bins:
            known_below = np.unique(values[[round(k * QUANTILES / bins) for k in range(1, bins)]])
            below = known_below[known_below < known[-1]]
        else:
            below = known[:-1]
        # Half-way to the next value, as MLlib cuts.
        cuts.append((below + known[np.searchsorted(known, below, side="right")]) / 2)
    return cuts


def combinations(cuts: list[np.ndarray]) -> int:
    return math.prod(len(c) + 1 for c in cuts)


def placed(rows: DataFrame, target: str, inputs: str, cuts: list[np.ndarray], lots: int, seed: int) -> DataFrame:
    """Each row's bins as one number, its lot and its target."""
    width = len(cuts)
    kind = ("int", np.int32) if combinations(cuts) < 2**31 else ("bigint", np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            n = batch.num_rows
            values = batch.column("inputs").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            code = np.zeros(n, np.int64)
            for i, cut in enumerate(cuts):
                code = code * (len(cut) + 1) + np.searchsorted(cut, values[:, i])
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(kind[1])), pa.array(rng.integers(0, lots, n, dtype=np.int32)), batch.column("y")], ["place", "lot", "y"])

    return rows.select(F.col(target).cast("double").alias("y"), vector_to_array(inputs).alias("inputs")).mapInArrow(place, f"place {kind[0]}, lot int, y double")


@dataclass
class Cells:
    """Bins of each cell, and the units that are drawn: rows, or lots with their count and sums."""

    bins: np.ndarray  # (column, cell)
    cuts: list[np.ndarray]
    of: np.ndarray  # the cell of each unit
    n: np.ndarray | None
    total: np.ndarray
    squares: np.ndarray | None
    # Columns that are counted together: a code for each cell, how many there are, and per column how codes add up to its bins.
    axes: list[tuple[np.ndarray, int, list[tuple[int, np.ndarray]]]] = field(default_factory=list)

    @staticmethod
    def gathered(code: np.ndarray, cuts: list[np.ndarray], n: np.ndarray | None, total: np.ndarray, squares: np.ndarray | None) -> Cells:
        """From the bins of each unit as one number."""
        # Units of one cell follow each other.
        order = np.argsort(code, kind="stable")
        code = code[order]
        n, total, squares = (x if x is None else x[order] for x in (n, total, squares))
        del order
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        of = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=len(code)))
        code = code[starts]
        bins = np.empty((len(cuts), len(starts)), np.uint8)
        for i in range(len(cuts) - 1, -1, -1):
            code, bins[i] = np.divmod(code, len(cuts[i]) + 1)
        return Cells(bins, cuts, of, n, total, squares).with_axes()

    def with_axes(self) -> Cells:
        """First fit, columns with few values before others: the season and helpers of a month go together."""
        axes: list[tuple[np.ndarray, list[int]]] = []
        for i in sorted(range(len(self.cuts)), key=lambda i: len(self.cuts[i])):
            for k, (codes, columns) in enumerate(axes):
                both = codes.astype(np.int64) * (len(self.cuts[i]) + 1) + self.bins[i]
                found = np.zeros((int(codes.max()) + 1) * (len(self.cuts[i]) + 1), bool)
                found[both] = True
                if found.sum() <= MOST_CODES:
                    axes[k] = ((np.cumsum(found) - 1).astype(np.uint8)[both], [*columns, i])
                    break
            else:
                axes.append((self.bins[i], [i]))
        for codes, columns in axes:
            size = int(codes.max()) + 1
            parts = []
            for i in columns:
                adds = np.zeros((size, len(self.cuts[i]) + 1))
                adds[codes, self.bins[i]] = 1.0
                parts.append((i, adds))
            self.axes.append((codes, size, parts))
        return self

    def sums(self, draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight, sum and sum of squares of each cell, where each unit counts as often as it was drawn."""
        drawn = slice(None) if draws is None else np.flatnonzero(draws)
        of, draws = self.of[drawn], 1.0 if draws is None else draws[drawn].astype(float)
        n, total = 1.0 if self.n is None else self.n[drawn], self.total[drawn]
        squares = total * total if self.squares is None else self.squares[drawn]
        return tuple(np.bincount(of, np.broadcast_to(draws * x, of.shape), minlength=self.bins.shape[1]) for x in (n, total, squares))


def grow(cells: Cells, sums: tuple[np.ndarray, np.ndarray, np.ndarray], rules: Rules, rng: np.random.Generator, answers: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The nodes of one tree, level by level. ``answers`` takes what the tree says of each cell."""
    columns, cuts = cells.bins, cells.cuts
    used = None if answers is not None else np.flatnonzero(sums[0])
    w, s, q = sums if used is None else [x[used] for x in sums]
    at = np.arange(len(w)) if used is None else used
    codes = [c if used is None else c[used] for c, _, _ in cells.axes]
    node, count, born = np.zeros(len(w), np.int64), 1, 1
    levels: list[dict[str, np.ndarray]] = []
    for depth in range(rules.depth + 1):
        weight, total, squares = (np.bincount(node, x, minlength=count) for x in (w, s, q))
        held = np.where(weight > 0, weight, 1.0)
        mean = total / held
        gain, feature, place = np.full(count, -np.inf), np.full(count, -1), np.full(count, -1)
        if depth < rules.depth:
            barred = None
            if rules.columns < len(cuts):
                barred = rng.random((count, len(cuts))).argsort(1).argsort(1) >= rules.columns
            for low in range(0, count, NODE_BLOCK):
                high = min(low + NODE_BLOCK, count)
                some = slice(None) if count <= NODE_BLOCK else np.flatnonzero((node >= low) & (node < high))
                sw, ss, sn = w[some], s[some], node[some] - low
                nw, ns = weight[low:high, None], total[low:high, None]
                for code, (_, size, parts) in zip(codes, cells.axes, strict=True):
                    key = sn * size
                    key += code[some]
                    counted, summed = (np.bincount(key, x, minlength=(high - low) * size).reshape(-1, size) for x in (sw, ss))
                    for i, adds in parts:
                        if adds.shape[1] < 2:
                            continue
                        lw, ls = ((x @ adds).cumsum(1)[:, :-1] for x in (counted, summed))
                        rw, rs = nw - lw, ns - ls
                        fits = (lw >= rules.leaf) & (rw >= rules.leaf) & (lw > 0) & (rw > 0)
                        if barred is not None:
                            fits &= ~barred[low:high, i, None]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            score = np.where(fits, ls * ls / lw + rs * rs / rw, -np.inf)
                        best = score.argmax(1)
                        won = (score[np.arange(high - low), best] - ns[:, 0] * mean[low:high]) / held[low:high]
                        better = won > gain[low:high]
                        gain[low:high][better], feature[low:high][better], place[low:high][better] = won[better], i, best[better]
        splits = (gain > np.maximum(0.0, ROUNDING * squares / held)) & (gain >= rules.least_gain)
        rank = np.cumsum(splits) - 1
        level = {
            "prediction": mean, "impurity": np.maximum(squares / held - mean * mean, 0.0), "weight": weight, "total": total, "squares": squares,
            "gain": np.where(splits, gain, -1.0), "left": np.where(splits, born + 2 * rank, -1), "right": np.where(splits, born + 2 * rank + 1, -1),
            "feature": np.where(splits, feature, -1), "threshold": np.array([cuts[f][p] if y else math.nan for f, p, y in zip(feature, place, splits, strict=True)]),
        }
        levels.append(level)
        if not splits.all():
            goes_on = splits[node]
            if answers is not None:
                ended = ~goes_on
                answers[at[ended]] = mean[node[ended]]
            if not splits.any():
                break
            node, w, s, q, at = (x[goes_on] for x in (node, w, s, q, at))
            codes = [c[goes_on] for c in codes]
        right = columns[feature[node], at] > place[node]
        node = 2 * rank[node] + right
        count = 2 * int(splits.sum())
        born += count
    return {k: np.concatenate([level[k] for level in levels]) for k in levels[0]}


def _nodes(tree: int, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    size = len(found["gain"])
    kinds = {"left": pa.int32(), "right": pa.int32(), "feature": pa.int32()}
    columns = {"tree": pa.array(np.full(size, tree), pa.int32()), "id": pa.array(np.arange(size), pa.int32())}
    columns |= {k: pa.array(v, kinds.get(k, pa.float64())) for k, v in found.items()}
    return pa.RecordBatch.from_arrays([columns[c.split()[0]] for c in NODES.split(", ")], [c.split()[0] for c in NODES.split(", ")])


def forest(cells: Cells, rules: Rules, trees: Iterator[int]) -> Iterator[pa.RecordBatch]:
    """Some trees of a forest, each with draws of its own."""
    for tree in trees:
        rng = np.random.default_rng([rules.seed, tree])
        draws = None
        if rules.replaced:
            draws = rng.poisson(rules.share, len(cells.of))
        elif rules.share < 1:
            draws = rng.random(len(cells.of)) < rules.share
        yield _nodes(tree, grow(cells, cells.sums(draws), rules, rng))


def boosted(cells: Cells, rules: Rules) -> Iterator[pa.RecordBatch]:
    """All trees: the first on the target, each other on the gradient that those before it leave."""
    whole = cells.sums(None)
    said, answer = np.zeros(cells.bins.shape[1]), np.empty(cells.bins.shape[1])
    for tree in range(rules.trees):
        rng = np.random.default_rng([rules.seed, tree])
        weight, total, squares = whole
        if rules.share < 1:
            # What is left out is less than what is drawn.
            weight, total, squares = (x - y for x, y in zip(whole, cells.sums(rng.random(len(cells.of), dtype=np.float32) >= rules.share), strict=True))
        if tree:
            squares = 4.0 * (squares + said * (said * weight - 2.0 * total))
            total = 2.0 * (total - said * weight)
        # A cell that was left out whole has no remainder of its sums.
        out = weight <= 0.5
        total[out], squares[out] = 0.0, 0.0
        yield _nodes(tree, grow(cells, (weight, total, squares), rules, rng, answer))
        said += answer if tree == 0 else rules.rate * answer


def gathered(rows: DataFrame, count: int, target: str, inputs: str, cuts: list[np.ndarray], seed: int) -> Cells | None:
    """The cells of all rows, or nothing if they are more than can be held."""
    if combinations(cuts) >= 2**63:
        return None
    table = placed(rows, target, inputs, cuts, MOST_LOTS, seed)
    if count > MOST_UNITS:
        known = table.select("place").distinct().count()
        if known > MOST_UNITS:
            return None
        lots = min(MOST_LOTS, MOST_UNITS // known)
        table = table.groupBy("place", F.pmod("lot", F.lit(lots)).alias("lot")).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("squares"))
    found = table.drop("lot").toArrow()
    code, n, total, squares = (found[c].to_numpy() if c in found.column_names else None for c in ("place", "n", "y", "squares"))
    del found
    return Cells.gathered(code, cuts, n, total, squares)


@dataclass
class GrownTrees:
    """A model in the form in which MLlib stores it; the driver holds no trees until it is loaded."""

    path: str
    kind: type
    weights: list[float]

    def loaded(self) -> Model:
        return self.kind.load(self.path)


def fit_trees(estimator: RandomForestRegressor | GBTRegressor, rows: DataFrame, count: int, width: int) -> GrownTrees | Model:
    """What ``estimator.fit`` gives, stored, from a few passes over the rows instead of one for each level of the trees.

    Rows of more than ``MOST_UNITS`` cells, or with more combinations of bins than a number tells apart, are left to MLlib, which holds none of them at one place.
    """
    spark, target, inputs = rows.sparkSession, estimator.getLabelCol(), estimator.getFeaturesCol()
    rules = Rules.of(estimator, width)
    cuts = thresholds(rows, inputs, width, estimator.getMaxBins())
    with GATHERING:
        cells = gathered(rows, count, target, inputs, cuts, rules.seed)
        shared = None if cells is None else spark.sparkContext.broadcast(cells)
        del cells
    if shared is None:
        return estimator.fit(rows)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = batch.column(0).to_pylist()
            if not trees:
                continue
            if rules.rate is None:
                yield from forest(shared.value, rules, trees)
            else:
                yield from boosted(shared.value, rules)

    many = min(rules.trees, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    started = spark.range(0, rules.trees, 1, many) if rules.rate is None else spark.range(0, 1, 1, 1)
    model = _stored(spark, estimator, started.mapInArrow(grown, NODES), width, rules)
    shared.destroy()
    return model


def _stored(spark: SparkSession, estimator: RandomForestRegressor | GBTRegressor, nodes: DataFrame, width: int, rules: Rules) -> GrownTrees:
    """Nodes in the form in which MLlib stores its models."""
    kind = RandomForestRegressionModel if rules.rate is None else GBTRegressionModel
    path = scratch_path(spark, "trees")
    inner = F.col("feature") >= 0
    cut = F.struct(
        F.col("feature").alias("featureIndex"), F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    nodes.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", F.array("weight", "total", "squares").alias("impurityStats"), F.col("weight").cast("bigint").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), cut.alias("split"),
    ).alias("nodeData")).write.parquet(f"{path}/data")
    given = {p.name: v for p, v in estimator._paramMap.items()}
    usual = {p.name: v for p, v in estimator._defaultParamMap.items()}
    common = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    of_tree = ("featuresCol", "labelCol", "predictionCol", "leafCol", "maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "minWeightFractionPerNode", "maxMemoryInMB", "cacheNodeIds", "checkpointInterval", "impurity", "seed")
    one = [{k: v for k, v in values.items() if k in of_tree} for values in (given, usual)]
    weights = [1.0 if rules.rate is None or tree == 0 else rules.rate for tree in range(rules.trees)]
    trees = [
        (tree, json.dumps({"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **common, "uid": f"{estimator.uid}_tree{tree}", "paramMap": one[0], "defaultParamMap": one[1]}), weight)
        for tree, weight in enumerate(weights)
    ]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    text = json.dumps({"class": f"org.apache.spark.ml.regression.{kind.__name__}", **common, "uid": estimator.uid, "paramMap": given, "defaultParamMap": usual, "numFeatures": width, "numTrees": rules.trees})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GrownTrees(path, kind, weights)
