"""Pipeline stages of a stored forecast model.

A stored model is an MLlib ``PipelineModel``: a stage that makes the inputs from what a series has seen, the trained
regressor, and a stage that brings its answer back to the index's scale. The stages save their
parameters with the pipeline, so a stored version forecasts without the job that trained it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# calendar month -> column -> mean; at most twelve entries per helper.
Climatology = Mapping[int, Mapping[str, float]]


def inputs_of(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c != "y"]


def lag_of(column: str) -> int | None:
    """How many rows back a lag column looks."""
    head, _, steps = column.rpartition("_")
    return int(steps) if head == "y_lag" else None


def month_value(column: str, month: int, climatology: Climatology) -> float:
    """An input that only the calendar month decides: the season, or a helper's mean, 0 without one."""
    if column == "month_sin":
        return math.sin(month * (2.0 * math.pi) / 12.0)
    if column == "month_cos":
        return math.cos(month * (2.0 * math.pi) / 12.0)
    return float(climatology.get(month, {}).get(column, 0.0))


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose parameters are written and read with the pipeline."""

    def __init__(self, **values: object) -> None:
        super().__init__()
        self._set(**{k: v for k, v in values.items() if v is not None})


class MonthInputs(_Stage):
    """``inputs`` of the month in ``month`` from the values in ``recent`` (oldest first): lags, season and helpers."""

    columns = Param(Params._dummy(), "columns", "input columns, y aside", TypeConverters.toListString)
    climatology = Param(Params._dummy(), "climatology", "means per calendar month and helper, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, climatology: str | None = None) -> None:
        super().__init__(**self._input_kwargs)

    def known(self) -> Climatology:
        return climatology_of(self.getOrDefault("climatology"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = self.known()
        at = F.month("month")

        def value(column: str) -> Column:
            lag = lag_of(column)
            if lag is None:
                # Twelve numbers, picked by the month.
                return F.array(*[F.lit(month_value(column, m, known)) for m in range(1, 13)])[at - 1]
            seen = F.size("recent")
            return F.get("recent", F.when(seen >= lag, seen - lag).otherwise(seen - 1))

        return dataset.withColumn("inputs", array_to_vector(F.array(*[value(c).cast("double") for c in self.getOrDefault("columns")])))


class WindowInputs(_Stage):
    """``inputs`` from the standardized rows of ``window``, oldest first."""

    columns = Param(Params._dummy(), "columns", "columns of a window's row, y first", TypeConverters.toListString)
    climatology = Param(Params._dummy(), "climatology", "means per calendar month and helper, as JSON", TypeConverters.toString)
    means = Param(Params._dummy(), "means", "mean of each column over the training rows", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "deviation of each column over the training rows", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, climatology: str | None = None, means: list[float] | None = None, deviations: list[float] | None = None) -> None:
        super().__init__(**self._input_kwargs)

    def known(self) -> Climatology:
        return climatology_of(self.getOrDefault("climatology"))

    def flat(self) -> Column:
        centre, spread = (F.array(*[F.lit(v) for v in self.getOrDefault(p)]) for p in ("means", "deviations"))
        scaled = F.transform("window", lambda row: F.zip_with(F.zip_with(row, centre, lambda a, b: a - b), spread, lambda a, b: a / b))
        return F.flatten(scaled)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("inputs", array_to_vector(self.flat()))


class Unscaled(_Stage):
    """``predicted`` back from standardized values."""

    mean = Param(Params._dummy(), "mean", "mean of y", TypeConverters.toFloat)
    deviation = Param(Params._dummy(), "deviation", "deviation of y", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, mean: float | None = None, deviation: float | None = None) -> None:
        super().__init__(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("predicted", F.col("predicted") * self.getOrDefault("deviation") + self.getOrDefault("mean"))


def climatology_text(climatology: Climatology) -> str:
    return json.dumps({str(m): {c: float(v) for c, v in means.items()} for m, means in sorted(climatology.items())})


def climatology_of(text: str) -> Climatology:
    return {int(m): means for m, means in json.loads(text).items()}


def read_pipeline(path: str, makers: Mapping[type, Callable[[PipelineModel], object]]) -> object:
    """The stored pipeline, handed to the maker for the kind of its first stage."""
    pipeline = PipelineModel.load(path)
    make = makers.get(type(pipeline.stages[0]))
    if make is None:
        raise ValueError(f"no forecast model at {path}: it begins with {type(pipeline.stages[0]).__name__}")
    return make(pipeline)
