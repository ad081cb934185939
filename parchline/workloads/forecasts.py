"""Checked queries: model inputs, forecasts, errors, intervals and their tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..forecasting import evaluation as E, inputs as I, models as M
from ..functions.keys import method_rank
from ..operators import predictors as R
from ..plans.catalog import Catalog, forecast_range
from ..plans.forecast import TooFewRows, run_forecast, store_run
from ..session import scratch_path
from ..sources.store import TableStore
from .base import CUTOFF, dataset_models, datasets, features, query, rnd, rounded, seasonal, table, targets, wide

KEYS = ("dataset_key", "feature_id")
W = "PARTITION BY dataset_key, feature_id ORDER BY date"


def _predictors(spark, folder):
    """Two helpers by month: one full but for gaps, one almost absent."""
    d = F.trunc(F.to_date("o_orderdate"), "MM")
    monthly = table(spark, folder, "orders").groupBy(d.alias("date")).agg(F.count("*").cast("double").alias("n"))
    return monthly.select(
        "date",
        F.when(~F.month("date").isin(2, 5) | (F.year("date") > 1997), F.col("n")).alias("orders"),
        F.when(F.col("date") == F.lit("1995-02-01").cast("date"), F.col("n")).alias("rare"),
    )


PREDICTORS = """
    predictors AS (SELECT date, CASE WHEN month(date) NOT IN (2, 5) OR year(date) > 1997 THEN n END AS orders, CASE WHEN date = DATE '1995-02-01' THEN n END AS rare
                   FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*)::DOUBLE AS n FROM orders GROUP BY 1))"""


@query("lag_inputs", views="targets", sql=f"""
    SELECT dataset_key, feature_id, date, {rnd("y")} AS y, {", ".join(rnd(f"coalesce(lag(y, {k}) OVER w, y)") + f" AS y_lag_{k}" for k in (1, 3, 6))},
           {rnd("sin(2 * pi() * month(date) / 12)")} AS month_sin, {rnd("cos(2 * pi() * month(date) / 12)")} AS month_cos FROM targets WINDOW w AS ({W})""")
def lag_inputs(spark, folder):
    return rounded(I.with_lags(targets(spark, folder)), *I.BASE_INPUTS)


@query("predictor_join", views="targets", sql=f"""
    WITH {PREDICTORS} SELECT dataset_key, feature_id, date, orders FROM targets LEFT JOIN predictors USING (date)""")
def predictor_join(spark, folder):
    return targets(spark, folder).join(_predictors(spark, folder).select("date", "orders"), "date", "left").drop("y")


@query("helper_imputation", views="targets", sql=f"""
    WITH {PREDICTORS}, j AS (SELECT * FROM targets LEFT JOIN predictors USING (date)),
    c AS (SELECT *, avg((rare IS NOT NULL)::INT) OVER (PARTITION BY dataset_key) AS cr, avg(orders) OVER (PARTITION BY dataset_key, month(date)) AS om,
                 avg(rare) OVER (PARTITION BY dataset_key, month(date)) AS rm, median(orders) OVER (PARTITION BY dataset_key) AS od, median(rare) OVER (PARTITION BY dataset_key) AS rd FROM j)
    SELECT dataset_key, feature_id, date, {rnd("coalesce(orders, om, od, 0)")} AS orders, {rnd("CASE WHEN cr < 2e-2 THEN 0 ELSE coalesce(rare, rm, rd, 0) END")} AS rare FROM c""")
def helper_imputation(spark, folder):
    out = I.with_helpers(targets(spark, folder), _predictors(spark, folder), ["orders", "rare"])
    return rounded(out.drop("y"), "orders", "rare")


@query("helper_coverage", views="targets", sql=f"""
    WITH {PREDICTORS} SELECT dataset_key, {rnd("avg((orders IS NOT NULL)::INT)")} AS orders, {rnd("avg((rare IS NOT NULL)::INT)")} AS rare FROM targets LEFT JOIN predictors USING (date) GROUP BY 1""")
def helper_coverage(spark, folder):
    joined = targets(spark, folder).join(_predictors(spark, folder), "date", "left")
    return rounded(I.helper_coverage(joined, ["orders", "rare"]), "orders", "rare")


@query("climatology_lookup", views="seasonal", sql=f"""
    WITH {PREDICTORS}, c AS (SELECT month(date) AS m, coalesce(avg(orders), 0) AS orders, coalesce(avg(rare), 0) AS rare FROM predictors GROUP BY 1)
    SELECT dataset_key, feature_id, target_date, {rnd("coalesce(c.orders, 0)")} AS orders, {rnd("coalesce(c.rare, 0)")} AS rare FROM seasonal LEFT JOIN c ON c.m = month(target_date)""")
def climatology_lookup(spark, folder):
    means = R.climatology(_predictors(spark, folder), ["orders", "rare"], keys=())
    ahead = seasonal(spark, folder).select(*KEYS, "target_date", F.month("target_date").alias("calendar_month"))
    out = ahead.join(means, "calendar_month", "left").drop("calendar_month").fillna(0.0, ["orders", "rare"])
    return rounded(out, "orders", "rare")


@query("scaling", views="targets", sql=f"""
    SELECT dataset_key, {rnd("avg(y)")} AS mean_y, {rnd("CASE WHEN stddev_pop(y) > 1e-6 THEN stddev_pop(y) ELSE 1 END")} AS std_y, 1.0::DOUBLE AS mean_flat, 1.0::DOUBLE AS std_flat FROM targets GROUP BY 1""")
def scaling(spark, folder):
    frame = targets(spark, folder).withColumn("flat", F.lit(1.0))
    return rounded(I.scaling(frame, ["y", "flat"], ["dataset_key"]), "mean_y", "std_y", "mean_flat", "std_flat")


@query("standardized_inputs", views="targets", sql=f"""
    SELECT dataset_key, feature_id, date, {rnd("(y - avg(y) OVER (PARTITION BY dataset_key)) / stddev_pop(y) OVER (PARTITION BY dataset_key)")} AS y FROM targets""")
def standardized_inputs(spark, folder):
    frame = targets(spark, folder)
    return rounded(I.standardized(frame, I.scaling(frame, ["y"], ["dataset_key"]), ["y"], ["dataset_key"]), "y")


@query("pooled_layers", views="wide", sql=f"""
    SELECT dataset_key, feature_id, date, {rnd("CASE WHEN dataset_key = 'asia' THEN spi3 ELSE 0 END")} AS spi3, precip FROM wide""")
def pooled_layers(spark, folder):
    # Layers are stored apart, as they are in use; read from one plan, all five would meet in the same tasks.
    store = TableStore(spark, scratch_path(spark, "layers"))
    store.replace("series", wide(spark, folder), ["dataset_key"])
    rows = store.read("series").select("dataset_key", "feature_id", "date", "spi3", "precip")
    layer = lambda key: rows.where(F.col("dataset_key") == key).drop("dataset_key")
    # Only the first layer has an index; the others have an input that the first lacks.
    others = {key: layer(key).drop("spi3").withColumn("extra", F.lit(1.0)) for key in ("africa", "america", "europe", "middle_east")}
    return rounded(I.pooled_layers({"asia": layer("asia"), **others}), "spi3")


@query("supervised_rows", views="targets", sql=f"""
    SELECT dataset_key, feature_id, date, {rnd("y")} AS y, {rnd("l")} AS y_lag_1 FROM (SELECT *, row_number() OVER w AS r, coalesce(lag(y) OVER w, y) AS l FROM targets WINDOW w AS ({W}))
    WHERE r > 18 AND date <= DATE '{CUTOFF}'""")
def supervised_rows(spark, folder):
    rows = I.supervised_rows(I.with_lags(targets(spark, folder)), I.BASE_INPUTS, cutoff=CUTOFF)
    return rounded(rows.select(*KEYS, "date", "y", "y_lag_1"), "y", "y_lag_1")


@query("sequence_windows", views="targets", sql=f"""
    SELECT dataset_key, feature_id, date, {rnd("y")} AS y, {rnd("a")} AS oldest, {rnd("s")} AS total FROM
        (SELECT *, lag(y, 18) OVER w AS a, sum(y) OVER (ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING {''}) AS s0, count(*) OVER p AS n, sum(y) OVER p AS s FROM targets
         WINDOW w AS ({W}), p AS ({W} ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING)) WHERE n = 18""".replace("sum(y) OVER (ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING ) AS s0, ", ""))
def sequence_windows(spark, folder):
    rows = I.sequence_rows(targets(spark, folder), ["y"])
    values = F.flatten("window")
    out = rows.select(*KEYS, "date", "y", F.get(values, F.lit(0)).alias("oldest"), F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"))
    return rounded(out, "y", "oldest", "total")


@query("backtest_origins", views="targets", sql=f"""
    WITH h AS (SELECT *, row_number() OVER w AS r, max(date) OVER (PARTITION BY dataset_key, feature_id) AS last_date FROM targets WINDOW w AS ({W})),
    o AS (SELECT *, row_number() OVER w - 1 AS n FROM h WHERE date >= DATE '1998-08-01' AND date <= last_date - INTERVAL 12 MONTH WINDOW w AS ({W}))
    SELECT dataset_key, feature_id, date AS origin, {rnd("y")} AS latest FROM o WHERE n % 3 = 0 AND r >= 18""")
def backtest_origins(spark, folder):
    past = I.histories(targets(spark, folder), ["y"])
    out = I.backtest_origins(past, "1998-08-01").select(*KEYS, "origin", F.element_at("recent", -1).alias("latest"))
    return rounded(out, "latest")


@query("seasonal_forecast", views="seasonal", sql=f"""
    SELECT dataset_key, feature_id, target_date, lead_month, {rnd("predicted")} AS predicted FROM seasonal""")
def seasonal_forecast(spark, folder):
    out = M.seasonal_forecast(targets(spark, folder), CUTOFF)
    return rounded(out.drop("origin"), "predicted")


PAIRS = "pairs AS (SELECT s.dataset_key, s.feature_id, lead_month, target_date, s.predicted, t.y AS actual FROM seasonal s JOIN targets t ON t.feature_id = s.feature_id AND t.dataset_key = s.dataset_key AND t.date = target_date)"


def _pairs(spark, folder):
    return E.matched(M.seasonal_forecast(targets(spark, folder), CUTOFF), targets(spark, folder)).drop("origin")


@query("backtest_pairs", views="targets seasonal", sql=f"""
    WITH {PAIRS} SELECT dataset_key, feature_id, lead_month, target_date, {rnd("predicted")} AS predicted, {rnd("actual")} AS actual FROM pairs""")
def backtest_pairs(spark, folder):
    return rounded(_pairs(spark, folder), "predicted", "actual")


def _sev(v: str) -> str:
    from .sqltext import severity

    return severity(v)


@query("forecast_metrics", views="targets seasonal", sql=f"""
    WITH {PAIRS}, g AS (SELECT *, predicted - actual AS e FROM pairs)
    SELECT dataset_key, lead_month, {rnd("avg(abs(e))", 10)} AS mae, {rnd("sqrt(avg(e * e))")} AS rmse, {rnd("avg(e)", 10)} AS bias,
           {rnd("CASE WHEN var_pop(actual) > 0 THEN 1 - avg(e * e) / var_pop(actual) END")} AS r2,
           {rnd("CASE WHEN count(*) > 1 AND var_pop(actual) > 0 AND var_pop(predicted) > 0 THEN corr(actual, predicted) END")} AS correlation,
           {rnd(f"avg(({_sev('actual')} = {_sev('predicted')})::INT)")} AS drought_class_accuracy, count(*) AS sample_count FROM g GROUP BY 1, 2""")
def forecast_metrics(spark, folder):
    out = E.forecast_metrics(_pairs(spark, folder), ["dataset_key", "lead_month"])
    # Means of such multiples can be exact decimal ties at six digits; ten are past them.
    return rounded(rounded(out, "mae", "bias", digits=10), "rmse", "r2", "correlation", "drought_class_accuracy")


@query("exact_quantile", sql=f"SELECT event_type, {rnd('quantile_cont(value, 0.9)')} AS quantile FROM events GROUP BY 1")
def exact_quantile(spark, folder):
    return rounded(E.exact_quantile(table(spark, folder, "events"), ["event_type"], "value", 0.9), "quantile")


@query("interval_spreads", views="targets seasonal", sql=f"""
    WITH {PAIRS}, r AS (SELECT dataset_key, lead_month, abs(predicted - actual) AS e FROM pairs),
    own AS (SELECT dataset_key, lead_month, nullif(CASE WHEN count(*) >= 8 THEN quantile_cont(e, 0.9) WHEN count(*) >= 3 THEN 164e-2 * sqrt(avg(e * e)) END, 0) AS q,
                   CASE WHEN count(*) >= 3 THEN greatest(164e-2 * sqrt(avg(e * e)), 15e-2) END AS m FROM r GROUP BY 1, 2),
    pool AS (SELECT lead_month, nullif(CASE WHEN count(*) >= 8 THEN quantile_cont(e, 0.9) WHEN count(*) >= 3 THEN 164e-2 * sqrt(avg(e * e)) END, 0) AS q,
                    CASE WHEN count(*) >= 3 THEN greatest(164e-2 * sqrt(avg(e * e)), 15e-2) END AS m FROM r GROUP BY 1),
    s AS (SELECT dataset_key, CAST(k AS INTEGER) AS lead_month, CASE WHEN stddev_pop(y) > 1e-6 THEN stddev_pop(y) ELSE 1 END * (45e-2 + 5e-2 * k) AS f FROM targets, range(1, 25) t(k) GROUP BY 1, k)
    SELECT s.dataset_key, s.lead_month, {rnd("greatest(coalesce(own.q, pool.q, f), 15e-2)", 10)} AS backtest_q90, {rnd("greatest(coalesce(own.m, pool.m, f), 15e-2)")} AS rmse_164,
           {rnd("greatest(f, 15e-2)")} AS historical_spread
    FROM s LEFT JOIN own ON own.dataset_key = s.dataset_key AND own.lead_month = s.lead_month LEFT JOIN pool ON pool.lead_month = s.lead_month""")
def interval_spreads(spark, folder):
    out = E.interval_spreads(_pairs(spark, folder), targets(spark, folder), 24)
    return rounded(rounded(out, "backtest_q90", digits=10), "rmse_164", "historical_spread")


def _with_intervals(spark, folder):
    rows = seasonal(spark, folder)
    payload = E.interval_payload(
        F.col("value"),
        {"backtest_q90": F.lit(0.05) * F.col("lead_month"), "rmse_164": F.when(F.col("lead_month") % 2 == 0, F.lit(0.4))},
    )
    return rows.withColumn("intervals", payload)


@query("interval_payload", views="seasonal", sql=f"""
    SELECT dataset_key, feature_id, lead_month, {rnd("value - greatest(5e-2 * lead_month, 15e-2)", 8)} AS q90_lower, {rnd("CASE WHEN lead_month % 2 = 0 THEN value + 4e-1 END", 8)} AS rmse_upper,
           CASE WHEN value IS NOT NULL THEN 'Backtest Q90' END AS q90_label, CASE WHEN value IS NULL THEN 0 ELSE 1 + (lead_month % 2 = 0)::INT END AS methods FROM seasonal""")
def interval_payload(spark, folder):
    i = F.col("intervals")
    out = _with_intervals(spark, folder).select(
        *KEYS, "lead_month", F.try_element_at(i, F.lit("backtest_q90"))["lower"].alias("q90_lower"),
        F.try_element_at(i, F.lit("rmse_164"))["upper"].alias("rmse_upper"),
        F.try_element_at(i, F.lit("backtest_q90"))["label"].alias("q90_label"), F.size(i).alias("methods"),
    )
    # Means of multiples of 1/64 have up to eight decimals: six would round exact ties.
    return rounded(out, "q90_lower", "rmse_upper", digits=8)


@query("chosen_bounds", views="seasonal", sql=f"""
    SELECT dataset_key, feature_id, lead_month, {rnd("CASE WHEN value IS NOT NULL AND lead_month % 2 = 0 THEN value - 4e-1 ELSE lower END", 8)} AS bound_lower,
           {rnd("CASE WHEN value IS NOT NULL AND lead_month % 2 = 0 THEN 8e-1 ELSE 1 END")} AS band_width, 'RMSE x 1.64' AS bound_label FROM seasonal""")
def chosen_bounds(spark, folder):
    out = E.chosen_bounds(_with_intervals(spark, folder), " RMSE_164 ").select(*KEYS, "lead_month", "bound_lower", "band_width", "bound_label")
    return rounded(rounded(out, "bound_lower", digits=8), "band_width")


FEEDBACK = """
    feedback AS (SELECT s.dataset_key, s.index_name, s.method_name, m.model_key, s.feature_id, s.issue_date, s.target_date, s.lead_month, s.value AS predicted_value, w.spi3 AS actual_value
                 FROM seasonal s LEFT JOIN dataset_models m USING (dataset_key, index_name, method_name)
                 JOIN wide w ON w.dataset_key = s.dataset_key AND w.feature_id = s.feature_id AND w.date = s.target_date WHERE s.value IS NOT NULL AND w.spi3 IS NOT NULL)"""
FEEDBACK_OUT = f"""SELECT dataset_key, index_name, method_name, model_key, feature_id, issue_date, target_date, lead_month, {rnd("predicted_value")} AS predicted_value,
    {rnd("actual_value")} AS actual_value, {rnd("predicted_value - actual_value")} AS error, {rnd("abs(predicted_value - actual_value)")} AS absolute_error,
    {rnd("pow(predicted_value - actual_value, 2)")} AS squared_error FROM feedback"""
FEEDBACK_NUMBERS = ("predicted_value", "actual_value", "error", "absolute_error", "squared_error")


def actuals(spark, folder):
    return wide(spark, folder).select(*KEYS, F.lit("spi3").alias("index_name"), "date", F.col("spi3").alias("value"))


def _feedback(spark, folder):
    return E.realized_feedback(seasonal(spark, folder), dataset_models(spark, folder), actuals(spark, folder))


@query("realized_feedback", views="seasonal dataset_models wide", sql=f"WITH {FEEDBACK} {FEEDBACK_OUT}")
def realized_feedback(spark, folder):
    return rounded(_feedback(spark, folder), *FEEDBACK_NUMBERS)


@query("feedback_summary", views="seasonal dataset_models wide", sql=f"""
    WITH {FEEDBACK} SELECT dataset_key, index_name, method_name, count(*) AS feedback_count, {rnd("avg(abs(predicted_value - actual_value))", 10)} AS feedback_mae,
           {rnd("sqrt(avg(pow(predicted_value - actual_value, 2)))")} AS feedback_rmse, {rnd("avg(predicted_value - actual_value)", 10)} AS feedback_bias, max(target_date) AS last_realized FROM feedback GROUP BY 1, 2, 3""")
def feedback_summary(spark, folder):
    out = rounded(E.feedback_summary(_feedback(spark, folder)), "feedback_mae", "feedback_bias", digits=10)
    return rounded(out, "feedback_rmse")


def _models(spark, folder):
    """A model row per layer, as training would have stored it."""
    return dataset_models(spark, folder).select(
        "model_key", "method_name", "index_name", F.concat(F.lit("src_"), "dataset_key").alias("source_key"), F.lit(18).alias("input_window"), F.lit(12).alias("horizon"),
        F.lit("ready").alias("status"),
    )


def _versions(spark, folder):
    """Three versions for the layers of some suppliers, stamped by their orders."""
    months = F.array(*[F.lit(f"2000-0{m}-01 00:00:00").cast("timestamp") for m in (1, 2, 3)])
    return _models(spark, folder).where(F.length("source_key") % 2 == 0).select("model_key", F.explode(months).alias("trained_at"))


@query("method_models", views="dataset_models wide", sql="""
    SELECT m.dataset_key, m.method_name, m.model_key, 'src_' || m.dataset_key AS source_key, 'Seasonal Mean' AS method_label, 18 AS input_window, issue_date, observed_max,
           observed_max > issue_date AS is_stale, true AS is_default, CASE WHEN length('src_' || m.dataset_key) % 2 = 0 THEN 3 ELSE 0 END AS version_count
    FROM dataset_models m JOIN (SELECT dataset_key, max(date) AS observed_max FROM wide WHERE spi3 IS NOT NULL GROUP BY 1) w ON w.dataset_key = m.dataset_key WHERE m.dataset_key = 'asia'""")
def method_models(spark, folder):
    shelf = Catalog(
        datasets(spark, folder), features(spark, folder), wide(spark, folder), forecasts=seasonal(spark, folder),
        dataset_models=dataset_models(spark, folder), models=_models(spark, folder), versions=_versions(spark, folder),
    )
    out = shelf.prediction_summary("asia", "spi3")
    return out.select(
        "dataset_key", "method_name", "model_key", "source_key", "method_label", "input_window", "issue_date", "observed_max", "is_stale", "is_default",
        F.col("version_count").cast("int").alias("version_count"),
    )


@query("region_context", views="features wide seasonal", sql="""
    WITH f AS (SELECT min(feature_id) AS id FROM features WHERE dataset_key = 'asia'),
    k AS (SELECT date FROM wide JOIN f ON feature_id = id WHERE dataset_key = 'asia' AND spi3 IS NOT NULL)
    SELECT unnest(['meta', 'overview', 'kpi', 'prediction_summary']) AS part, 1::BIGINT AS rows, NULL::DATE AS first, NULL::DATE AS last
    UNION ALL SELECT 'series', (date_diff('month', min(date), max(date)) + 1)::BIGINT, min(date), max(date) FROM k
    UNION ALL SELECT 'forecast', count(*), min(target_date), max(target_date) FROM seasonal JOIN f ON feature_id = id WHERE dataset_key = 'asia'""")
def region_context(spark, folder):
    """How many rows each part of one region's page has, and the months they span."""
    shelf = Catalog(
        datasets(spark, folder), features(spark, folder), wide(spark, folder), forecasts=seasonal(spark, folder),
        dataset_models=dataset_models(spark, folder), models=_models(spark, folder), versions=_versions(spark, folder),
    )
    fid = features(spark, folder).where(F.col("dataset_key") == "asia").agg(F.min("feature_id")).first()[0]
    out = None
    for part, rows in shelf.region_context("asia", "spi3", "1999-02", fid).items():
        month = {"series": "date", "forecast": "target_date"}.get(part)
        span = [F.min(month), F.max(month)] if month else [F.lit(None).cast("date")] * 2
        one = rows.agg(F.lit(part).alias("part"), F.count("*").alias("rows"), span[0].alias("first"), span[1].alias("last"))
        out = one if out is None else out.unionByName(one)
    return out


@query("forecast_freshness", views="targets dataset_models", sql="""
    SELECT m.dataset_key, issue_date, max(t.date) AS observed_max, max(t.date) > issue_date AS is_stale FROM dataset_models m JOIN targets t USING (dataset_key) GROUP BY 1, 2""")
def forecast_freshness(spark, folder):
    seen = targets(spark, folder).groupBy("dataset_key").agg(F.max("date").alias("observed_max"))
    return dataset_models(spark, folder).join(seen, "dataset_key").select(
        "dataset_key", "issue_date", "observed_max", (F.col("observed_max") > F.col("issue_date")).alias("is_stale")
    )


@query("forecast_range", views="dataset_models", sql="""
    SELECT dataset_key, strftime(min(forecast_min_date), '%Y-%m') AS forecast_min_month, strftime(max(forecast_max_date), '%Y-%m') AS forecast_max_month, count(*) AS models FROM dataset_models GROUP BY 1""")
def forecast_range_query(spark, folder):
    return forecast_range(dataset_models(spark, folder), ["dataset_key"])


@query("forecast_rows", views="seasonal", sql=f"""
    SELECT feature_id, target_date, method_name, {rnd("value")} AS value, {rnd("lower")} AS lower, true AS is_default FROM seasonal WHERE dataset_key = 'europe'""")
def forecast_rows(spark, folder):
    shelf = Catalog(datasets(spark, folder), features(spark, folder), wide(spark, folder), forecasts=seasonal(spark, folder), dataset_models=dataset_models(spark, folder))
    return rounded(shelf.prediction_forecast("europe", "spi3").select("feature_id", "target_date", "method_name", "value", "lower", "is_default"), "value", "lower")


@query("preferred_method", sql="""
    WITH t AS (SELECT DISTINCT user_id, CASE event_id % 4 WHEN 0 THEN 'xgboost' WHEN 1 THEN 'random_forest' WHEN 2 THEN 'seasonal_mean' ELSE 'ar' END AS method_name FROM events)
    SELECT user_id, arg_min(method_name, {'r': CASE method_name WHEN 'random_forest' THEN 1 WHEN 'xgboost' THEN 2 ELSE 99 END, 'm': method_name}) AS method_name FROM t GROUP BY 1""")
def preferred_method(spark, folder):
    k = F.col("event_id") % 4
    name = F.when(k == 0, "xgboost").when(k == 1, "random_forest").when(k == 2, "seasonal_mean").otherwise("ar")
    rows = table(spark, folder, "events").select("user_id", name.alias("method_name"))
    return rows.groupBy("user_id").agg(F.min_by("method_name", F.struct(method_rank(F.col("method_name")), "method_name")).alias("method_name"))


@query("forecast_store", views="seasonal", sql=f"""
    SELECT dataset_key, index_name, method_name, feature_id, target_date, lead_month, {rnd("CASE WHEN dataset_key = 'asia' THEN value + 1 ELSE value END")} AS value FROM seasonal""")
def forecast_store(spark, folder):
    """Forecasts stored twice: the second run replaces one layer and leaves the others."""
    store = TableStore(spark, scratch_path(spark, "forecasts"))
    parts = ["dataset_key", "index_name", "method_name"]
    rows = seasonal(spark, folder)
    store.replace("forecasts", rows, parts)
    store.replace("forecasts", rows.where(F.col("dataset_key") == "asia").withColumn("value", F.col("value") + 1), parts)
    out = store.read("forecasts").select(*parts, "feature_id", "target_date", "lead_month", "value")
    return rounded(out, "value")


# -- trained models: SQL states the rows and what must hold of their numbers ------------


def _source_frame(spark, folder, helpers: bool = False):
    frame = I.with_lags(targets(spark, folder))
    if not helpers:
        return frame, list(I.BASE_INPUTS), {}
    predictors = _predictors(spark, folder)
    means = M.collected_climatology(R.climatology(predictors, ["orders"], keys=()), ["orders"])
    return I.with_helpers(frame, predictors, ["orders"]), [*I.BASE_INPUTS, "orders"], means


def _window_model(columns, means):
    return lambda: M.WindowForecaster(columns=columns, climatology=means)


def _judged(run, frame):
    """Forecast rows and whether their numbers are sound, or the status of a run that had too few rows."""
    if isinstance(run, TooFewRows):
        nothing = {c: F.lit(None).cast(t) for c, t in (("feature_id", "string"), ("target_date", "date"), ("lead_month", "int"), ("intervals", "int"), ("ordered", "boolean"), ("within", "boolean"))}
        return run.status().select("dataset_key", "method_name", "status", *[v.alias(c) for c, v in nothing.items()])
    seen = frame.agg(F.min("y").alias("least"), F.max("y").alias("most"))
    nested = F.forall(F.map_values("intervals"), lambda i: (i["lower"] <= F.col("value")) & (F.col("value") <= i["upper"]))
    return run.forecasts.join(F.broadcast(seen)).select(
        "dataset_key", "method_name", F.lit("ready").alias("status"), "feature_id", "target_date", "lead_month", F.size("intervals").alias("intervals"),
        (nested & (F.col("lower") <= F.col("value")) & (F.col("value") <= F.col("upper"))).alias("ordered"),
        F.when(F.col("method_name") == "random_forest", F.col("value").between(F.col("least"), F.col("most"))).otherwise(F.col("value").isNotNull()).alias("within"),
    )


def _forecast_sql(method: str) -> str:
    return f"""
    WITH last AS (SELECT dataset_key, feature_id, max(date) AS origin, unnest(range(1, 13)) AS k FROM targets GROUP BY 1, 2)
    SELECT dataset_key, '{method}' AS method_name, 'ready' AS status, feature_id, CAST(origin + to_months(CAST(k AS INTEGER)) AS DATE) AS target_date, CAST(k AS INTEGER) AS lead_month,
           3 AS intervals, true AS ordered, true AS within FROM last"""


@query("forecast_random_forest", views="targets", sql=_forecast_sql("random_forest"))
def forecast_random_forest(spark, folder):
    """Every series twelve months ahead; a forest's answers lie among the values it has seen."""
    frame, columns, means = _source_frame(spark, folder, helpers=True)

    def make():
        return M.TreeForecaster("random_forest", M.random_forest(M.ForestSettings()), columns, means)

    return _judged(run_forecast(frame, make, "shipments", "spi3"), frame)


@query("forecast_boosted_trees", views="targets", sql=_forecast_sql("boosted_trees"))
def forecast_boosted_trees(spark, folder):
    frame, columns, means = _source_frame(spark, folder)

    def make():
        return M.TreeForecaster("boosted_trees", M.boosted_trees(M.BoostSettings()), columns, means)

    return _judged(run_forecast(frame, make, "shipments", "spi3"), frame)


@query("forecast_window_regression", views="targets", sql=_forecast_sql("window_regression"))
def forecast_window_regression(spark, folder):
    """Train, backtest and forecast."""
    frame, columns, means = _source_frame(spark, folder)
    return _judged(run_forecast(frame, _window_model(columns, means), "shipments", "spi3"), frame)


@query("forecast_backtest", views="targets", sql="""
    WITH r AS (SELECT *, row_number() OVER w AS place, max(date) OVER (PARTITION BY dataset_key, feature_id) AS last, max(date) OVER () AS newest FROM targets
               WINDOW w AS (PARTITION BY dataset_key, feature_id ORDER BY date)),
    o AS (SELECT *, row_number() OVER (PARTITION BY dataset_key, feature_id ORDER BY date) - 1 AS n FROM r
          WHERE date >= newest - INTERVAL 36 MONTH AND date <= last - INTERVAL 12 MONTH),
    p AS (SELECT o.dataset_key, k::INTEGER AS lead_month FROM (SELECT *, unnest(range(1, 13)) AS k FROM o WHERE n % 3 = 0 AND place >= 18) o
          JOIN targets t ON t.dataset_key = o.dataset_key AND t.feature_id = o.feature_id AND t.date = o.date + to_months(k::INTEGER)),
    c AS (SELECT count(*) FILTER (WHERE date <= newest - INTERVAL 36 MONTH) AS training_rows, count(*) AS final_rows FROM r WHERE place > 18)
    SELECT dataset_key, lead_month, count(*) AS sample_count, true AS sound, training_rows, final_rows FROM p, c GROUP BY ALL""")
def forecast_backtest(spark, folder):
    """Pairs behind each layer's errors at each lead, and rows of the judged and of the final fit."""
    frame, columns, means = _source_frame(spark, folder)
    run = run_forecast(frame, _window_model(columns, means), "shipments", "spi3")
    mae, rmse, bias = F.col("mae"), F.col("rmse"), F.col("bias")
    sound = (mae >= 0) & (rmse >= mae - 1e-12) & (F.abs(bias) <= mae + 1e-12) & F.col("drought_class_accuracy").between(0.0, 1.0)
    return run.evaluation.select(
        "dataset_key", "lead_month", F.col("sample_count").cast("bigint").alias("sample_count"), sound.alias("sound"), F.lit(run.training_rows).cast("bigint").alias("training_rows"),
        F.lit(run.final_rows).cast("bigint").alias("final_rows"),
    )


@query("stored_model_forecasts", views="targets", sql="""
    WITH last AS (SELECT dataset_key, feature_id, max(date) AS origin, unnest(range(1, 13)) AS k FROM targets GROUP BY 1, 2)
    SELECT dataset_key, feature_id, CAST(origin + to_months(CAST(k AS INTEGER)) AS DATE) AS target_date, CAST(k AS INTEGER) AS lead_month, true AS same FROM last""")
def stored_model_forecasts(spark, folder):
    """A run is stored, its version read back without the job that trained it, and forecast with: the rows are those that were stored."""
    frame, columns, means = _source_frame(spark, folder, helpers=True)
    run = run_forecast(frame, _window_model(columns, means), "shipments", "spi3")
    store = TableStore(spark, scratch_path(spark, "runs"))
    version = store_run(store, run, "shipments", "spi3", actuals(spark, folder), dt.datetime(2024, 1, 1))
    path = store.read("model_versions").where(F.col("version_key") == version).first()["artifact_path"]
    model = M.load_forecaster(path)
    again = M.recursive_forecast(model, I.final_origins(I.histories(run.frame, model.columns))).select(*KEYS, "target_date", "lead_month", "predicted")
    stored = store.read("forecasts").select(*KEYS, "target_date", "lead_month", "value")
    both = stored.join(again, [*KEYS, "target_date", "lead_month"], "full")
    return both.select(*KEYS, "target_date", "lead_month", F.coalesce(F.abs(F.col("value") - F.col("predicted")) <= 1e-9, F.lit(False)).alias("same"))


@query("forecast_linear_one_lag", views="targets", sql=f"""
    WITH pairs AS (SELECT y, lag(y) OVER (PARTITION BY dataset_key, feature_id ORDER BY date) AS x FROM targets),
    line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM pairs WHERE x IS NOT NULL),
    last AS (SELECT dataset_key, feature_id, max(date) AS origin, arg_max(y, date) AS y, unnest(range(1, 13)) AS k FROM targets GROUP BY 1, 2)
    SELECT dataset_key, feature_id, CAST(k AS INTEGER) AS lead_month, CAST(origin + to_months(CAST(k AS INTEGER)) AS DATE) AS target_date,
           {rnd("pow(b, k) * y + a * (pow(b, k) - 1) / (b - 1)")} AS value FROM last, line""")
def forecast_linear_one_lag(spark, folder):
    """The recursion with a model that SQL can fit: a line on the value before, without penalty."""
    frame = targets(spark, folder).withColumn("y", F.col("y").cast("double"))
    model = M.WindowForecaster(columns=["y"], regularization=0.0)
    model.fit(frame, None, 1)
    ahead = M.recursive_forecast(model, I.final_origins(I.histories(frame, ["y"], 1)))
    return rounded(ahead.select("dataset_key", "feature_id", "lead_month", "target_date", F.col("predicted").alias("value")), "value")


@query("insufficient_rows", views="targets", sql="""
    SELECT DISTINCT dataset_key, 'spi3' AS index_name, 'window_regression' AS method_name, 'insufficient_rows' AS status, 1000000000 AS least_rows FROM targets""")
def insufficient_rows(spark, folder):
    """A run that asks for more rows than there are says so, layer by layer."""
    frame, columns, means = _source_frame(spark, folder)
    run = run_forecast(frame, lambda: M.WindowForecaster(columns=columns, climatology=means), "shipments", "spi3", least_rows=1_000_000_000)
    return run.status().drop("training_rows")
