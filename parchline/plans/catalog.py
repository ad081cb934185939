"""Map, overview, series, indicator and forecast queries over the stored tables.

Every method returns a lazy DataFrame for one layer. Layer, month and index filters
are plain predicates on stored columns, so they reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..forecasting.evaluation import feedback_summary
from ..functions import props as P
from ..functions.calendar import month_label, require_month
from ..functions.classes import NOT_DROUGHT, is_drought_index, map_severity, severity
from ..functions.geo import overlaps, parse_bbox
from ..functions.keys import index_columns, method_label, method_rank, normalized_method, require_index, same_key
from ..functions.numeric import finite
from ..functions.text import repair_text
from ..operators.asof import effective_month
from ..operators.overview import class_counts, page, value_range
from ..operators.series import compacted, filled_between
from ..operators.trend import trend_statistics

FEATURE = ("dataset_key", "feature_id")
TREND_FIELDS = ("tau", "p_value", "sen_slope", "trend_category", "trend_label_en", "trend_label_fa", "trend_symbol")


@dataclass
class Catalog:
    """The stored tables, as DataFrames; forecast tables are optional."""

    datasets: DataFrame
    features: DataFrame
    series: DataFrame
    trends: DataFrame | None = None
    forecasts: DataFrame | None = None
    dataset_models: DataFrame | None = None
    models: DataFrame | None = None
    versions: DataFrame | None = None
    evaluation: DataFrame | None = None
    feedback: DataFrame | None = None

    # -- layers ---------------------------------------------------------------

    def list_datasets(self) -> DataFrame:
        return self.datasets.select(
            "dataset_key",
            F.coalesce("title", "dataset_key").alias("title"),
            "geom_type",
            month_label(F.col("min_date")).alias("min_month"),
            month_label(F.col("max_date")).alias("max_month"),
            "source_key",
            "source_title",
            "boundary_key",
            "boundary_title",
        ).orderBy("dataset_key")

    def source_layers(self, preferred: str = "terraclimate") -> DataFrame:
        """Layers of the preferred source, or of the first one, sorted by titles."""
        named = self.datasets.select(
            F.lower("dataset_key").alias("dataset_key"),
            F.lower(F.coalesce("source_key", "dataset_key")).alias("source_key"),
            F.coalesce("source_title", F.lower(F.coalesce("source_key", "dataset_key"))).alias("source_title"),
            F.coalesce("boundary_title", "title", "boundary_key", "dataset_key").alias("boundary_title"),
        )
        # One row: the preferred source when it exists, else the first by title.
        best = F.struct(
            (F.col("source_key") != preferred).alias("other"), F.lower("source_title").alias("t"), F.col("source_key").alias("k")
        )
        chosen = named.select(F.min(best)["k"]).scalar()
        return named.where(F.col("source_key") == chosen).orderBy(F.lower("source_title"), F.lower("boundary_title"))

    def meta(self) -> DataFrame:
        """One row per layer: features, extent, months, indices, forecast range."""
        extent = self.features.groupBy("dataset_key").agg(
            F.count("*").alias("feature_count"),
            F.min("minx").alias("minx"),
            F.min("miny").alias("miny"),
            F.max("maxx").alias("maxx"),
            F.max("maxy").alias("maxy"),
        )
        out = self.datasets.select(
            "dataset_key",
            F.coalesce("title", "dataset_key").alias("title"),
            "geom_type",
            month_label(F.col("min_date")).alias("min_month"),
            month_label(F.col("max_date")).alias("max_month"),
        ).join(extent, "dataset_key", "left").withColumn("feature_count", F.coalesce("feature_count", F.lit(0).cast("bigint")))
        out = out.withColumn("indices", F.array(*[F.lit(i) for i in index_columns(self.series.columns)]))
        if self.dataset_models is None:
            return out.withColumn("forecast_max_month", F.lit(None).cast("string"))
        ahead = forecast_range(self.dataset_models, ["dataset_key"])
        return out.join(ahead.select("dataset_key", "forecast_max_month"), "dataset_key", "left")

    def regions(self, level: str) -> DataFrame:
        """Ids and names in name order (binary order of UTF-8)."""
        return (
            self.features.where(same_key(F.col("dataset_key"), level))
            .select(F.col("feature_id").alias("id"), F.coalesce("name", "feature_id").alias("name"), F.col("dataset_key").alias("level"))
            .orderBy("name", "id")
        )

    # -- one month ------------------------------------------------------------

    def _values(self, level: str, index_name: str) -> DataFrame:
        index_name = require_index(self.series.columns, index_name)
        return self.series.where(same_key(F.col("dataset_key"), level)).select(
            *FEATURE, "date", finite(F.col(index_name)).alias("value")
        )

    def _chosen_method(self, level: str, index_name: str) -> Column:
        """Best-ranked method that forecasts this layer and index (a one-row subquery)."""
        method = normalized_method(F.col("method_name"))
        rows = self.dataset_models.where(same_key(F.col("dataset_key"), level) & (F.col("index_name") == index_name))
        return rows.select(F.min_by(method, F.struct(method_rank(method), method))).scalar()

    def _month_forecasts(self, level: str, index_name: str, month: str, method: str | None) -> DataFrame:
        wanted = F.lit(method.strip().lower()) if method and method.strip() else self._chosen_method(level, index_name)
        return self.forecasts.where(
            same_key(F.col("dataset_key"), level)
            & (F.col("index_name") == index_name)
            & (F.col("method_name") == wanted)
            & (F.col("target_date") == F.lit(require_month(month)))
        ).select("feature_id", finite(F.col("value")).alias("forecast"), F.lit(True).alias("is_prediction"))

    def map_data(
        self,
        level: str,
        index_name: str,
        month: str,
        method: str | None = None,
        bbox: str | None = None,
        limit: int | None = None,
        offset: int = 0,
    ) -> DataFrame:
        """Features with value, severity, trend and forecast override: all, or one page of them.

        A page is taken from the features alone, before anything is joined to it; ``total`` and ``truncated`` tell
        what else there is.
        """
        shown = self.features.where(same_key(F.col("dataset_key"), level))
        box = parse_bbox(bbox)
        if box:
            shown = shown.where(overlaps(box, *[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
        shown = page(shown, "feature_id", limit, offset)
        at_month = self._values(level, index_name).where(F.col("date") == F.lit(require_month(month)))
        attrs = P.map_attributes(F.col("props"))
        out = shown.withColumn("attrs", attrs).join(at_month.select(*FEATURE, "value"), list(FEATURE), "left")
        out = out.select(
            *FEATURE,
            F.coalesce(P.attribute(F.col("attrs"), "Mah_Name"), P.attribute(F.col("attrs"), "mah_name"), repair_text(F.coalesce("name", "feature_id"))).alias("name"),
            P.province(F.col("props")).alias("province"),
            P.country(F.col("props")).alias("country"),
            "attrs",
            "geometry",
            "value",
            F.col("value").isNotNull().alias("has_value"),
            map_severity(F.col("value"), index_name).alias("severity"),
            "total",
            "truncated",
        )
        if self.trends is not None:
            trends = self.trends.where(same_key(F.col("dataset_key"), level) & (F.col("index_name") == index_name))
            out = out.join(trends.select("feature_id", F.struct(*TREND_FIELDS).alias("trend")), "feature_id", "left")
        if self.forecasts is not None and self.dataset_models is not None:
            ahead = self._month_forecasts(level, index_name, month, method)
            out = with_forecast_override(out.join(ahead, "feature_id", "left"), index_name)
        return out.orderBy("feature_id")

    def map_total(self, level: str, bbox: str | None = None) -> DataFrame:
        """How many features the viewport holds; asked for on the first page only."""
        shown = self.features.where(same_key(F.col("dataset_key"), level))
        box = parse_bbox(bbox)
        if box:
            shown = shown.where(overlaps(box, *[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
        return shown.select(F.count("*").alias("total"))

    def overview(self, level: str, index_name: str, month: str, method: str | None = None) -> DataFrame:
        """Class counts (drought indices) or value range of one month.

        Forecasts are counted instead of observations when the month has any.
        """
        counter = class_counts if is_drought_index(index_name) else value_range
        at_month = self._values(level, index_name).where(F.col("date") == F.lit(require_month(month)))
        observed = counter(at_month, "value", keys=()).withColumn("prediction", F.lit(False))
        if self.forecasts is None or self.dataset_models is None:
            return observed
        ahead = self._month_forecasts(level, index_name, month, method).where(F.col("forecast").isNotNull())
        forecast = counter(ahead, "forecast", keys=()).withColumn("prediction", F.lit(True))
        any_forecast = ahead.select(F.count("*") > 0).scalar()
        return forecast.where(F.col("with_value") > 0).unionByName(observed.where(~any_forecast))

    # -- series ---------------------------------------------------------------

    def time_series(self, level: str, index_name: str, feature_id: str | None = None) -> DataFrame:
        """Complete monthly series of one feature, or of all features of a layer."""
        rows = self._values(level, index_name)
        if feature_id is not None:
            rows = rows.where(F.col("feature_id") == str(feature_id))
        return filled_between(rows, FEATURE)

    def compact_series(self, level: str, index_name: str, points: int, feature_id: str | None = None) -> DataFrame:
        return compacted(self.time_series(level, index_name, feature_id), FEATURE, points)

    def kpi(self, level: str, index_name: str, month: str | None = None, feature_id: str | None = None) -> DataFrame:
        """Indicators of every feature up to the effective month.

        Features without any value are returned with an error code.
        """
        rows = self._values(level, index_name)
        places = self.features.where(same_key(F.col("dataset_key"), level))
        if feature_id is not None:
            rows = rows.where(F.col("feature_id") == str(feature_id))
            places = places.where(F.col("feature_id") == str(feature_id))
        known = rows.where(F.col("value").isNotNull())
        if month:
            asked = places.select(*FEATURE, F.lit(require_month(month)).alias("requested"))
            resolved = effective_month(rows, asked, FEATURE).drop("value")
        else:
            blank = F.lit(None)
            resolved = places.select(
                *FEATURE, blank.cast("date").alias("requested"), blank.cast("date").alias("effective"), blank.cast("string").alias("note")
            )
        used = resolved.join(known, list(FEATURE), "left").where(
            F.col("date").isNull() | F.col("effective").isNull() | (F.col("date") <= F.col("effective"))
        )
        v = F.col("value")
        latest = F.max_by(v, "date")
        stats = used.groupBy(*FEATURE, "requested", "effective", "note").agg(
            F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), latest.alias("latest"), F.count(v).alias("_n")
        )
        trends = trend_statistics(known, FEATURE) if self.trends is None else self.trends.where(
            same_key(F.col("dataset_key"), level) & (F.col("index_name") == index_name)
        ).drop("index_name")
        shown = severity(F.col("latest")) if is_drought_index(index_name) else F.lit(NOT_DROUGHT)
        return (
            stats.join(trends, list(FEATURE), "left")
            .join(places.select(*FEATURE, F.coalesce("name", "feature_id").alias("feature")), list(FEATURE), "left")
            .select(
                *FEATURE,
                "feature",
                month_label(F.col("requested")).alias("requested_month"),
                month_label(F.col("effective")).alias("effective_month"),
                "note",
                "min",
                "max",
                "mean",
                "latest",
                F.when(F.col("latest").isNotNull(), shown).alias("severity"),
                *TREND_FIELDS,
                F.when(F.col("_n") == 0, "no_series").alias("error"),
            )
        )

    # -- forecasts ------------------------------------------------------------

    def prediction_summary(self, level: str, index_name: str, method: str | None = None) -> DataFrame:
        """One row per method: model, versions, freshness, realized errors, evaluation."""
        index_name = require_index(self.series.columns, index_name)
        here = same_key(F.col("dataset_key"), level) & (F.col("index_name") == index_name)
        if method:
            here = here & (F.col("method_name") == method.strip().lower())
        mine = self.dataset_models.where(here)
        observed = self._values(level, index_name).where(F.col("value").isNotNull()).groupBy("dataset_key").agg(
            F.max("date").alias("observed_max")
        )
        method_key = ["dataset_key", "index_name", "method_name"]
        out = (
            mine.join(self.models.drop("method_name", "index_name"), "model_key")
            .join(observed, "dataset_key", "left")
            .withColumn("method_label", method_label(F.col("method_name")))
            .withColumn("is_stale", F.coalesce(F.col("observed_max") > F.col("issue_date"), F.lit(False)))
            .withColumn("is_default", F.col("method_name") == self._chosen_method(level, index_name))
        )
        if method:
            out = out.withColumn("is_default", F.lit(True))
        if self.versions is not None:
            counted = self.versions.groupBy("model_key").agg(
                F.count("*").alias("version_count"), F.max("trained_at").alias("latest_version_trained_at")
            )
            out = out.join(counted, "model_key", "left").fillna({"version_count": 0})
        if self.feedback is not None:
            out = out.join(feedback_summary(self.feedback.where(here)), method_key, "left").fillna({"feedback_count": 0})
        if self.evaluation is not None:
            fields = [c for c in self.evaluation.columns if c not in method_key]
            leads = self.evaluation.where(here).groupBy(*method_key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("evaluation"))
            out = out.join(leads, method_key, "left")
        return out.orderBy(method_rank(F.col("method_name")), "method_name")

    def prediction_forecast(self, level: str, index_name: str, feature_id: str | None = None, method: str | None = None) -> DataFrame:
        """Forecast rows of one feature, or of all features of a layer."""
        rows = self.forecasts.where(same_key(F.col("dataset_key"), level) & (F.col("index_name") == index_name))
        if feature_id is not None:
            rows = rows.where(F.col("feature_id") == str(feature_id))
        if method:
            rows = rows.where(F.col("method_name") == method.strip().lower())
        return rows.withColumn("is_default", F.col("method_name") == self._chosen_method(level, index_name))

    def has_prediction(self, level: str, index_name: str, method: str | None = None) -> DataFrame:
        rows = self.dataset_models.where(same_key(F.col("dataset_key"), level) & (F.col("index_name") == index_name.lower()))
        if method:
            rows = rows.where(F.col("method_name") == method.strip().lower())
        return rows.select((F.count("*") > 0).alias("has_prediction"))

    def region_context(
        self, level: str, index_name: str, month: str, feature_id: str | None = None, points: int | None = None
    ) -> dict[str, DataFrame]:
        """Everything shown beside one region, each part as its own DataFrame; ``points`` bounds the series."""
        parts = {
            "meta": self.meta().where(same_key(F.col("dataset_key"), level)),
            "overview": self.overview(level, index_name, month),
        }
        if feature_id is not None:
            parts["kpi"] = self.kpi(level, index_name, month, feature_id)
            whole = points is None
            parts["series"] = self.time_series(level, index_name, feature_id) if whole else self.compact_series(level, index_name, points, feature_id)
            if self.forecasts is not None and self.dataset_models is not None:
                parts["forecast"] = self.prediction_forecast(level, index_name, feature_id)
        if self.models is not None and self.dataset_models is not None:
            parts["prediction_summary"] = self.prediction_summary(level, index_name)
        return parts


def forecast_range(dataset_models: DataFrame, groups: list[str]) -> DataFrame:
    """First and last forecast month per group."""
    return dataset_models.groupBy(*groups).agg(
        month_label(F.min("forecast_min_date")).alias("forecast_min_month"),
        month_label(F.max("forecast_max_date")).alias("forecast_max_month"),
        F.count("*").alias("models"),
    )


def with_forecast_override(rows: DataFrame, index_name: str) -> DataFrame:
    """Forecasts replace values wherever one exists, even a null one.

    Severity follows only a drought value that is not null.
    """
    given = F.coalesce(F.col("is_prediction"), F.lit(False))
    value = F.when(given, F.col("forecast")).otherwise(F.col("value"))
    fresh = given & F.col("forecast").isNotNull() if is_drought_index(index_name) else F.lit(False)
    return (
        rows.withColumn("severity", F.when(fresh, severity(F.col("forecast"))).otherwise(F.col("severity")))
        .withColumn("has_value", F.when(given, F.col("forecast").isNotNull()).otherwise(F.col("has_value")))
        .withColumn("value", value)
        .withColumn("is_prediction", given)
        .drop("forecast")
    )
