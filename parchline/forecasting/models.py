"""Forecast models on MLlib and the recursive multi-step forecast.

The models are MLlib's; trees are trained from cells (``trees``) and lines by MLlib. The recursion keeps one row per
(series, origin) with its recent values in an array, so one narrow pass, or one step a lead, serves
any number of series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .answers import Answers, looked_up
from .inputs import BASE_INPUTS, HORIZON, INPUT_WINDOW, SERIES, scaling, sequence_rows, supervised_rows
from .stages import Climatology, MonthInputs, Unscaled, WindowInputs, climatology_text, inputs_of, lag_of, month_value, read_pipeline
from .trees import GrownTrees, fit_trees

SEED = 42
# Expressions of one lead are nested in those of the next, so plans grow fast.
CHECKPOINT_EVERY = 2
# Every level of a tree is a job over the training rows: with fewer rows a task is mostly overhead, with more it is too large.
LEAST_TASK_ROWS, MOST_TASK_ROWS = 4096, 131_072


def _refuse(settings: object, **bounds: tuple[float, float]) -> None:
    """Settings are used as they are given or not at all."""
    for name, (least, most) in bounds.items():
        value = getattr(settings, name)
        if not least <= value <= most:
            raise ValueError(f"{name} of {type(settings).__name__} must lie between {least} and {most}, not {value}")


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 300
    depth: int = 10
    leaf: int = 2

    def __post_init__(self) -> None:
        _refuse(self, trees=(1, 1_000_000), depth=(0, 30), leaf=(1, 1_000_000))


@dataclass(frozen=True)
class BoostSettings:
    trees: int = 400
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.9
    column_share: float = 0.9

    def __post_init__(self) -> None:
        _refuse(self, trees=(1, 1_000_000), depth=(0, 30), rate=(1e-6, 1.0), row_share=(1e-6, 1.0), column_share=(1e-6, 1.0))


# Columns of training rows and of what a model answers.
COLUMNS = {"labelCol": "y", "featuresCol": "inputs", "predictionCol": "predicted", "seed": SEED}


def random_forest(settings: ForestSettings) -> RandomForestRegressor:
    """A forest whose trees see all columns at every split."""
    return RandomForestRegressor(numTrees=settings.trees, maxDepth=settings.depth, minInstancesPerNode=settings.leaf, featureSubsetStrategy="all", **COLUMNS)


def boosted_trees(settings: BoostSettings) -> GBTRegressor:
    """Boosted trees on a share of the rows and of the columns; a whole share is all of them."""
    columns = "all" if settings.column_share == 1 else repr(float(settings.column_share))
    return GBTRegressor(
        maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.rate, subsamplingRate=settings.row_share, featureSubsetStrategy=columns, **COLUMNS
    )


def training_tasks(count: int, cores: int) -> int:
    """Over how many tasks training rows are dealt: one per core where there are rows enough, more where tasks would grow too large."""
    return max(1, min(cores, -(-count // LEAST_TASK_ROWS)), -(-count // MOST_TASK_ROWS))


def _vector(values: Sequence[Column]) -> Column:
    return array_to_vector(F.array(*[v.cast("double") for v in values]))


def collected_climatology(table: DataFrame, columns: Sequence[str]) -> Climatology:
    """Twelve rows at most: calendar-month means of one source."""
    return {r["calendar_month"]: {c: float(r[c]) for c in columns} for r in table.select("calendar_month", *columns).collect()}


@dataclass
class TreeForecaster:
    """A tree model on the inputs of the month to forecast."""

    method: str
    estimator: object
    columns: Sequence[str] = BASE_INPUTS
    climatology: Climatology = field(default_factory=dict)
    model: GrownTrees | Model | None = None
    state: tuple[str, ...] = ("recent",)

    def fit(self, frame: DataFrame, cutoff: object | None = None, window: int = INPUT_WINDOW) -> int:
        """Fit on the rows up to the cutoff; returns how many there were."""
        rows, count = self.training(frame, cutoff, window)
        self.train(rows, count)
        return count

    def training(self, frame: DataFrame, cutoff: object | None = None, window: int = INPUT_WINDOW) -> tuple[DataFrame, int]:
        """Training rows, dealt over tasks by their number whatever the size in bytes, and how many there are."""
        used = inputs_of(self.columns)
        rows = supervised_rows(frame, used, window, cutoff).select("y", _vector([F.col(c) for c in used]).alias("inputs"))
        ensure_checkpoint_dir(frame.sparkSession)
        rows = rows.checkpoint()
        count = rows.count()
        return rows.repartition(training_tasks(count, frame.sparkSession.sparkContext.defaultParallelism)), count

    def train(self, rows: DataFrame, count: int) -> None:
        if count:
            self.model = fit_trees(self.estimator, rows, count, len(inputs_of(self.columns)))

    def loaded(self) -> Model:
        if isinstance(self.model, GrownTrees):
            self.model = self.model.loaded()
        return self.model

    def inputs(self) -> MonthInputs:
        return MonthInputs(columns=inputs_of(self.columns), climatology=climatology_text(self.climatology))

    def pipeline(self) -> PipelineModel:
        """What is stored: inputs of a month, and the trees."""
        return PipelineModel([self.inputs(), self.loaded()])

    @staticmethod
    def of(pipeline: PipelineModel) -> TreeForecaster:
        first, model = pipeline.stages
        method = "random_forest" if isinstance(model, RandomForestRegressionModel) else "boosted_trees"
        return TreeForecaster(method, None, ["y", *first.getOrDefault("columns")], first.known(), model)

    def predict(self, state: DataFrame, month: Column) -> DataFrame:
        return self.loaded().transform(self.inputs().transform(state.withColumn("month", month))).drop("inputs", "month")


@dataclass
class WindowForecaster:
    """Linear regression on the flattened, standardized window of past inputs."""

    method: str = "window_regression"
    columns: Sequence[str] = BASE_INPUTS
    climatology: Climatology = field(default_factory=dict)
    regularization: float = 0.01
    model: Model | None = None
    state: tuple[str, ...] = ("recent", "window")
    means: list[float] = field(default_factory=list)
    deviations: list[float] = field(default_factory=list)

    def fit(self, frame: DataFrame, cutoff: object | None = None, window: int = INPUT_WINDOW) -> int:
        rows, count = self.training(frame, cutoff, window)
        self.train(rows, count)
        return count

    def training(self, frame: DataFrame, cutoff: object | None = None, window: int = INPUT_WINDOW) -> tuple[DataFrame, int]:
        """Standardized training rows and how many there are."""
        if list(self.columns[:1]) != ["y"]:
            raise ValueError("the first column of a window is y")
        # Scaling uses the training rows only, so a backtest stays clean.
        past = frame if cutoff is None else frame.where(F.col("date") <= F.lit(cutoff).cast("date"))
        stats = scaling(past, self.columns, []).first()
        self.means = [float(stats[f"mean_{c}"]) for c in self.columns]
        self.deviations = [float(stats[f"std_{c}"]) for c in self.columns]
        rows = sequence_rows(frame, self.columns, window, cutoff).select(
            ((F.col("y") - self.means[0]) / self.deviations[0]).alias("y"), array_to_vector(self.inputs().flat()).alias("inputs")
        )
        ensure_checkpoint_dir(frame.sparkSession)
        rows = rows.checkpoint()
        return rows, rows.count()

    def train(self, rows: DataFrame, count: int) -> None:
        if count:
            self.model = LinearRegression(
                labelCol="y", featuresCol="inputs", predictionCol="predicted", regParam=self.regularization
            ).fit(rows)

    def inputs(self) -> WindowInputs:
        return WindowInputs(columns=list(self.columns), climatology=climatology_text(self.climatology), means=self.means, deviations=self.deviations)

    def pipeline(self) -> PipelineModel:
        """What is stored: standardized window, line, and the way back to the index's scale."""
        return PipelineModel([self.inputs(), self.model, Unscaled(mean=self.means[0], deviation=self.deviations[0])])

    @staticmethod
    def of(pipeline: PipelineModel) -> WindowForecaster:
        first, model, _ = pipeline.stages
        means, deviations = (list(first.getOrDefault(p)) for p in ("means", "deviations"))
        return WindowForecaster(columns=list(first.getOrDefault("columns")), climatology=first.known(), model=model, means=means, deviations=deviations)

    def leads(self, horizon: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights (lead, entry of the flat window) and constants (lead, calendar month of the origin) of all leads.

        The model is a line and every input of a later month is a number, an entry of the window or an earlier forecast. So each
        lead is again a line over the window at the origin: the one-step line, composed with itself once per lead.
        """
        width = len(self.columns)
        steps = len(self.model.coefficients) // width
        spread, centre = np.array(self.deviations), np.array(self.means)
        line = np.array(self.model.coefficients).reshape(steps, width)
        constant = centre[0] + spread[0] * (float(self.model.intercept) - float((line * (centre / spread)).sum()))
        line = line * (spread[0] / spread)
        size = steps * width
        # Each entry of a row as a line over the window, with a constant for each calendar month of the origin.
        rows = np.zeros((steps + horizon, width, size + 12))
        rows[:steps].reshape(size, size + 12)[:, :size] = np.eye(size)
        out = np.zeros((horizon, size + 12))
        for lead in range(1, horizon + 1):
            known = steps + lead - 1
            out[lead - 1] = np.tensordot(line, rows[lead - 1 : known], axes=2)
            out[lead - 1, size:] += constant
            for place, column in enumerate(self.columns):
                lag = lag_of(column)
                if column == "y":
                    rows[known, place] = out[lead - 1]
                elif lag is not None:
                    # A lag from before the first row is the row before, as it is for a single step.
                    rows[known, place] = rows[known - lag if known >= lag else known - 1, 0]
                else:
                    rows[known, place, size:] = [month_value(column, (month + lead - 1) % 12 + 1, self.climatology) for month in range(1, 13)]
        return out[:, :size], out[:, size:]

    def path(self, horizon: int) -> Column:
        """Forecasts of all leads from ``window`` and ``origin``, one dot product a lead; null where the window is not full."""
        weights, constants = self.leads(horizon)
        lines = F.array(*[
            F.struct(F.array(*[F.lit(v) for v in row]).alias("weights"), F.array(*[F.lit(v) for v in months]).alias("constants"))
            for row, months in zip(weights.tolist(), constants.tolist(), strict=True)
        ])
        month = F.month("origin") - 1

        def ahead(flat: Column) -> Column:
            return F.transform(
                lines, lambda line: F.aggregate(F.zip_with(flat, line["weights"], lambda a, b: a * b), F.get(line["constants"], month), lambda total, v: total + v)
            )

        # One array element binds the flat window, so that it is made once.
        flat = F.flatten(F.col("window").cast("array<array<double>>"))
        full = F.size("window") == weights.shape[1] // len(self.columns)
        return F.when(full, F.transform(F.array(flat), ahead)[0]).otherwise(F.array_repeat(F.lit(None).cast("double"), horizon))


def load_forecaster(path: str) -> TreeForecaster | WindowForecaster:
    """A forecaster from a stored version, with its scaling, columns and climatology."""
    return read_pipeline(path, {MonthInputs: TreeForecaster.of, WindowInputs: WindowForecaster.of})


def _longer(recent: Column, value: Column) -> Column:
    """The recent values with one more, at most as many as a window holds."""
    longer = F.concat(recent, F.array(value))
    return F.when(F.size(recent) < INPUT_WINDOW, longer).otherwise(F.slice(longer, 2, INPUT_WINDOW))


def recursive_forecast(
    forecaster: TreeForecaster | WindowForecaster, origins: DataFrame, horizon: int = HORIZON
) -> DataFrame:
    """(series, origin, lead_month, target_date, predicted), feeding forecasts back as lags.

    A linear model has a line per lead, trees have a table. Any other model takes one step a lead; its state is checkpointed every few
    leads, so neither the plan nor the cost of losing an executor grows with the horizon, and after the last, as what
    reads the path would ask the model again.
    """
    if isinstance(forecaster, WindowForecaster):
        state = origins.withColumn("path", forecaster.path(horizon))
    else:
        answers = Answers.of(origins.sparkSession, forecaster.model, inputs_of(forecaster.columns), forecaster.climatology)
        state = _step_by_step(forecaster, origins, horizon) if answers is None else looked_up(answers, origins, horizon)
    return state.select(*SERIES, "origin", F.posexplode("path").alias("_i", "predicted")).select(
        *SERIES,
        "origin",
        (F.col("_i") + 1).alias("lead_month"),
        F.add_months("origin", F.col("_i") + 1).alias("target_date"),
        "predicted",
    )


def _step_by_step(forecaster: TreeForecaster, origins: DataFrame, horizon: int) -> DataFrame:
    ensure_checkpoint_dir(origins.sparkSession)
    keep = (*SERIES, "origin", *forecaster.state, "path")
    state = origins.withColumn("path", F.array().cast("array<double>")).select(*keep)
    for lead in range(1, horizon + 1):
        scored = forecaster.predict(state, F.add_months("origin", lead))
        state = scored.select(
            *SERIES, "origin", _longer(F.col("recent"), F.col("predicted")).alias("recent"), F.concat("path", F.array("predicted")).alias("path")
        )
        if lead % CHECKPOINT_EVERY == 0 or lead == horizon:
            state = state.checkpoint()
    return state


def seasonal_forecast(series: DataFrame, cutoff: object | Column, horizon: int = HORIZON) -> DataFrame:
    """The baseline without a model: calendar-month means up to the cutoff.

    Months the series never had count as 0, as absent helpers do. One forecast of
    ``horizon`` months per series, from its last month up to the cutoff.
    """
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast("date")
    past = series.where(F.col("date") <= limit)
    means = past.groupBy(*SERIES, F.month("date").alias("_cal")).agg(F.avg("y").alias("_mean"))
    last = past.groupBy(*SERIES).agg(F.max("date").alias("origin"))
    leads = last.withColumn("lead_month", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "target_date", F.add_months("origin", F.col("lead_month"))
    )
    return leads.withColumn("_cal", F.month("target_date")).join(means, [*SERIES, "_cal"], "left").select(
        *SERIES, "origin", "lead_month", "target_date", F.coalesce("_mean", F.lit(0.0)).alias("predicted")
    )
