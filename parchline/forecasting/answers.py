"""What a tree model says, as a table.

Of the inputs of a month to forecast only the lags differ between series; the season and the helpers' means follow from the calendar month.
Trees compare a lag with few thresholds, so their model is a table over calendar month and bins of the lags. All leads of a series
are then looked up in one pass, whatever the number of trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from .inputs import INPUT_WINDOW, SERIES
from .stages import Climatology, lag_of, month_value
from .trees import GrownTrees

# Entries of a table: with more, models are asked row by row.
MOST_ANSWERS = 1 << 22


def tree_nodes(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """Nodes of all trees, tree by tree and in order, from the form in which MLlib stores them."""
    node = "nodeData"
    found = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), f"{node}.id", f"{node}.prediction", F.col(f"{node}.leftChild").alias("left"), F.col(f"{node}.rightChild").alias("right"),
        F.col(f"{node}.split.featureIndex").alias("feature"), F.get(f"{node}.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    ).toArrow()
    columns = {c: found[c].to_numpy() for c in found.column_names}
    order = np.lexsort((columns["id"], columns["tree"]))
    return {c: v[order] for c, v in columns.items()}


@dataclass
class Answers:
    lags: list[int]
    cuts: list[np.ndarray]
    table: np.ndarray  # (calendar month, bins of each lag)

    @staticmethod
    def of(spark: SparkSession, model: GrownTrees | Model, columns: Sequence[str], climatology: Climatology) -> Answers | None:
        """The table of a tree model, or nothing if it is none or has too many thresholds."""
        if isinstance(model, GrownTrees):
            path, weights, kind = model.path, model.weights, model.kind
        elif isinstance(model, RandomForestRegressionModel | GBTRegressionModel):
            path, weights, kind = scratch_path(spark, "nodes"), model.treeWeights, type(model)
            model.write().save(path)
        else:
            return None
        boosted = kind is GBTRegressionModel
        places = {i: k for k, i in enumerate(i for i, c in enumerate(columns) if lag_of(c) is not None)}
        months = {i: np.array([month_value(c, m, climatology) for m in range(1, 13)]) for i, c in enumerate(columns) if i not in places}
        nodes = tree_nodes(spark, path)
        cuts = [np.unique(nodes["threshold"][nodes["feature"] == i]) for i in places]
        shape = (12, *[len(c) + 1 for c in cuts])
        if np.prod(shape, dtype=float) > MOST_ANSWERS:
            return None
        ranks = [{t: k + 1 for k, t in enumerate(c.tolist())} for c in cuts]
        table, one = np.zeros(shape), np.empty(shape)
        starts = np.flatnonzero(np.diff(nodes["tree"], prepend=-1))
        for start, end, weight in zip(starts, [*starts[1:], len(nodes["tree"])], weights, strict=True):
            prediction, left, right, feature, threshold = (nodes[c][start:end].tolist() for c in ("prediction", "left", "right", "feature", "threshold"))
            open_nodes = [(0, np.arange(12), [(0, size) for size in shape[1:]])]
            while open_nodes:
                node, at, box = open_nodes.pop()
                i = feature[node]
                if i < 0:
                    one[(at, *[slice(*side) for side in box])] = prediction[node]
                elif i in months:
                    goes_left = months[i][at] <= threshold[node]
                    open_nodes += [(child, some, box) for child, some in ((left[node], at[goes_left]), (right[node], at[~goes_left])) if len(some)]
                else:
                    k, cut = places[i], ranks[places[i]][threshold[node]]
                    low, high = box[k]
                    if low < cut:
                        open_nodes.append((left[node], at, [*box[:k], (low, min(high, cut)), *box[k + 1 :]]))
                    if cut < high:
                        open_nodes.append((right[node], at, [*box[:k], (max(low, cut), high), *box[k + 1 :]]))
            table += weight * one if boosted else one
        return Answers([lag_of(columns[i]) for i in places], cuts, table if boosted else table / len(weights))

    def ahead(self, recent: pa.ListArray, origin_month: np.ndarray, horizon: int) -> np.ndarray:
        """Forecasts (series, lead), each feeding those after it; NaN where nothing is known."""
        ends, values = recent.offsets.to_numpy()[1:], recent.values.to_numpy(zero_copy_only=False)
        size = np.diff(recent.offsets.to_numpy())
        back = max([1, *self.lags])
        known = np.full((len(size), back + horizon), np.nan)
        for k in range(1, back + 1):
            there = size >= k
            known[there, back - k] = values[ends[there] - k]
        for lead in range(horizon):
            now = back + lead
            seen = np.minimum(size + lead, INPUT_WINDOW)
            at = [np.searchsorted(cut, np.where(seen >= lag, known[:, now - lag], known[:, now - 1])) for lag, cut in zip(self.lags, self.cuts, strict=True)]
            known[:, now] = np.where(size > 0, self.table[((origin_month + lead) % 12, *at)], np.nan)
        return known[:, back:]


def looked_up(answers: Answers, origins: DataFrame, horizon: int) -> DataFrame:
    """(series, origin, path) of all leads."""
    spark = origins.sparkSession
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.broadcast(answers)
    keys = [*SERIES, "origin"]

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.ahead(batch.column("recent"), batch.column("month").to_numpy(), horizon)
            ends = pa.array(np.arange(0, found.size + 1, horizon), pa.int32())
            path = pa.ListArray.from_arrays(ends, pa.array(found.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], path], [*keys, "path"])

    rows = origins.select(*keys, F.col("recent").cast("array<double>").alias("recent"), F.month("origin").alias("month"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(ahead, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", path array<double>").checkpoint()
    shared.destroy()
    return out
