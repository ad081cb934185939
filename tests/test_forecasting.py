"""Quantiles under skew, error rules, intervals, the stored-forecast queries, the recursion."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchline.forecasting import evaluation as E, inputs as I, models as M
from parchline.plans.catalog import Catalog
from parchline.plans.forecast import TooFewRows, run_forecast


def test_exact_quantile_on_skewed_groups(spark):
    rng = np.random.default_rng(8)
    groups = {"hot": rng.exponential(size=6000), "tied": np.repeat([1.0, 2.0, 5.0], [70, 20, 10]), "pair": np.array([1.0, 4.0]), "one": np.array([7.0]), "heavy": np.concatenate([np.full(900, 0.1), rng.normal(1e6, 10, 100)])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r["g"]: r["quantile"] for r in E.exact_quantile(df, ["g"], "v", q).collect()}
        for k, vs in groups.items():
            assert math.isclose(got[k], float(np.quantile(vs, q)), rel_tol=1e-12), (k, q)


def test_quantile_of_large_groups_looks_at_few_values(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=60_000), [1e12]])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", float(i % 3)) for i in range(30_000)], "g string, v double")
    for q in (0.05, 0.9):
        got = {r["g"]: r["quantile"] for r in E.exact_quantile(df, ["g"], "v", q, accuracy=1000).collect()}
        assert math.isclose(got["a"], float(np.quantile(values, q)), rel_tol=1e-12)
        assert got["b"] == float(np.quantile([i % 3 for i in range(30_000)], q))


def test_a_run_with_too_few_rows_says_so(spark):
    rows = [("a", "x", dt.date(2020 + i // 12, i % 12 + 1, 1), float(i)) for i in range(30)]
    frame = I.with_lags(spark.createDataFrame(rows, "dataset_key string, feature_id string, date date, y double"))
    run = run_forecast(frame, lambda: M.WindowForecaster(columns=list(I.BASE_INPUTS)), "s", "spi3", least_rows=500)
    assert isinstance(run, TooFewRows)
    status = run.status().collect()
    assert [(r.dataset_key, r.status, r.least_rows) for r in status] == [("a", "insufficient_rows", 500)] and status[0].training_rows < 500


def test_pooled_layers_take_the_inputs_of_the_first(spark):
    first = spark.createDataFrame([("x", 1, 2.0, None)], "feature_id string, date int, y double, rain double")
    second = spark.createDataFrame([("z", 1, 3.0, 5.0)], "feature_id string, date int, y double, wind double")
    got = [tuple(r) for r in I.pooled_layers({"a": first, "b": second}).collect()]
    assert got == [("a", "x", 1, 2.0, None), ("b", "z", 1, 3.0, 0.0)]
    with pytest.raises(ValueError):
        I.pooled_layers({})


def test_metrics_without_variance(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 0.0), ("b", 1.0, None)], "g string, actual double, predicted double")
    got = E.forecast_metrics(df, ["g"]).collect()
    assert len(got) == 1 and got[0]["r2"] is None and got[0]["correlation"] is None and got[0]["mae"] == 1.0


def test_spread_rules(spark):
    errors = {("a", 1): [0.5] * 9 + [2.0], ("a", 2): [1.0, 2.0, 2.0], ("b", 1): [1.0], ("b", 2): [0.0] * 9}
    rows = [(k, lead, 0.0, e) for (k, lead), es in errors.items() for e in es]
    pairs = spark.createDataFrame(rows, "dataset_key string, lead_month int, actual double, predicted double")
    history = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 5.0), ("b", 5.0)], "dataset_key string, y double")
    got = {(r["dataset_key"], r["lead_month"]): r for r in E.interval_spreads(pairs, history, 3).collect()}
    assert math.isclose(got["a", 1]["backtest_q90"], np.quantile([0.5] * 9 + [2.0], 0.9))
    assert math.isclose(got["a", 2]["backtest_q90"], 1.64 * math.sqrt(3.0))
    assert math.isclose(got["b", 1]["backtest_q90"], np.quantile([0.5] * 9 + [2.0, 1.0], 0.9))  # pooled
    assert math.isclose(got["b", 2]["backtest_q90"], np.quantile([0.0] * 9 + [1.0, 2.0, 2.0], 0.9))  # zero is absent
    assert math.isclose(got["a", 3]["backtest_q90"], 0.6) and math.isclose(got["b", 3]["historical_spread"], 0.6)
    assert got["b", 2]["rmse_164"] == 0.15


@pytest.fixture(scope="module")
def shelf(spark):
    d = dt.date
    sql = spark.createDataFrame
    interval = "map<string,struct<label:string,lower:double,upper:double>>"
    return Catalog(
        datasets=sql([("Demo", "Demo layer", "Point", d(2024, 1, 1), d(2024, 2, 1), "src", "Source", "poly", "Poly", None)], "dataset_key string, title string, geom_type string, min_date date, max_date date, source_key string, source_title string, boundary_key string, boundary_title string, metadata string"),
        features=sql([("Demo", "f1", "Feature 1", {}, None, 59.0, 36.0, 59.0, 36.0), ("Demo", "f2", None, {}, None, 60.0, 36.0, 60.0, 36.0)], "dataset_key string, feature_id string, name string, props map<string,string>, geometry string, minx double, miny double, maxx double, maxy double"),
        series=sql([("Demo", "f1", d(2024, 1, 1), -0.4), ("Demo", "f1", d(2024, 2, 1), -0.7)], "dataset_key string, feature_id string, date date, spi3 double"),
        forecasts=sql([
            ("Demo", "spi3", "lstm_attention", "f1", d(2024, 1, 1), d(2024, 3, 1), 1, -0.9, -1.2, -0.6, {"backtest_q90": ("Backtest Q90", -1.2, -0.6), "historical_spread": ("Historical Spread", -1.05, -0.75)}),
            ("Demo", "spi3", "lstm_attention", "f1", d(2024, 1, 1), d(2024, 4, 1), 2, -1.1, -1.5, -0.7, {"historical_spread": ("Historical Spread", -1.3, -0.9)}),
        ], f"dataset_key string, index_name string, method_name string, feature_id string, issue_date date, target_date date, lead_month int, value double, lower double, upper double, intervals {interval}"),
        dataset_models=sql([("Demo", "spi3", "lstm_attention", "m1", d(2024, 1, 1), d(2024, 3, 1), d(2024, 4, 1))], "dataset_key string, index_name string, method_name string, model_key string, issue_date date, forecast_min_date date, forecast_max_date date"),
        models=sql([("m1", "lstm_attention", "src", "spi3", 18, 12, "ready")], "model_key string, method_name string, source_key string, index_name string, input_window int, horizon int, status string"),
        versions=sql([("m1_20260101", "m1", dt.datetime(2026, 1, 1))], "version_key string, model_key string, trained_at timestamp"),
        evaluation=sql([("Demo", "spi3", "lstm_attention", 1, 0.2, 0.3)], "dataset_key string, index_name string, method_name string, lead_month int, mae double, rmse double"),
    )


def test_stored_forecasts(shelf):
    rows = shelf.prediction_forecast("demo", "spi3", "f1").orderBy("target_date").collect()
    assert (rows[0]["lower"], rows[0]["upper"], rows[0]["is_default"]) == (-1.2, -0.6, True)
    assert rows[0]["intervals"]["historical_spread"]["upper"] == -0.75
    summary = shelf.prediction_summary("demo", "spi3").collect()
    assert len(summary) == 1 and summary[0]["version_count"] == 1 and summary[0]["is_stale"] is True
    assert summary[0]["method_label"] == "LSTM + Attention" and summary[0]["evaluation"][0]["rmse"] == 0.3
    assert shelf.meta().first()["forecast_max_month"] == "2024-04"
    bounds = E.chosen_bounds(shelf.prediction_forecast("demo", "spi3"), "backtest_q90").orderBy("target_date").collect()
    assert [b["bound_lower"] for b in bounds] == [-1.2, -1.5]


def test_map_kpi_and_overview(shelf):
    shown = {r["feature_id"]: r for r in shelf.map_data("DEMO", "spi3", "2024-03").collect()}
    assert shown["f1"]["is_prediction"] and shown["f1"]["severity"] == "D1" and shown["f2"]["severity"] == "No Data"
    past = {r["feature_id"]: r for r in shelf.map_data("demo", "spi3", "2024-02").collect()}
    assert past["f1"]["value"] == -0.7 and not past["f1"]["is_prediction"] and past["f1"]["severity"] == "D0"
    assert shelf.overview("demo", "spi3", "2024-04").first()["prediction"] is True
    assert shelf.overview("demo", "spi3", "2024-01").first()["d0"] == 1
    kpi = {r["feature_id"]: r for r in shelf.kpi("demo", "spi3", "2030-01").collect()}
    assert kpi["f1"]["note"] == "clamped-to-end" and kpi["f1"]["latest"] == -0.7 and kpi["f2"]["error"] == "no_series"
    assert {"meta", "overview", "kpi", "series", "forecast", "prediction_summary"} == set(shelf.region_context("demo", "spi3", "2024-02", "f1"))


class Average:
    """A stand-in model: the mean of the lag inputs."""

    def transform(self, df):
        from pyspark.ml.functions import vector_to_array

        v = vector_to_array("inputs")
        return df.withColumn("predicted", (v[0] + v[1] + v[2]) / 3)


def test_recursion_against_a_loop(spark):
    y = [float(v) for v in np.random.default_rng(1).normal(size=30)]
    rows = [("d", "a", dt.date(2000 + i // 12, i % 12 + 1, 1), v) for i, v in enumerate(y)]
    frame = I.with_lags(spark.createDataFrame(rows, "dataset_key string, feature_id string, date date, y double"))
    caster = M.TreeForecaster("mean", None)
    caster.model = Average()
    got = [r["predicted"] for r in M.recursive_forecast(caster, I.final_origins(I.histories(frame, caster.columns)), 12).orderBy("lead_month").collect()]
    known = list(y)
    for _ in range(12):
        known.append((known[-1] + known[-3] + known[-6]) / 3)
    np.testing.assert_allclose(got, known[30:])


def test_readers_of_a_path_do_not_ask_the_model_again(spark, monkeypatch):
    monkeypatch.setattr("parchline.forecasting.answers.MOST_ANSWERS", 0)
    frame = monthly(spark, "a")
    caster = M.TreeForecaster("random_forest", M.random_forest(M.ForestSettings(trees=2, depth=2)))
    caster.fit(frame)
    ahead = M.recursive_forecast(caster, I.final_origins(I.histories(frame, caster.columns)), 3)
    assert ahead.count() == 3 and "UDF" not in ahead._jdf.queryExecution().executedPlan().toString()


def test_origins_need_history_and_room(spark):
    rows = [("d", "a", dt.date(2000 + i // 12, i % 12 + 1, 1), float(i)) for i in range(48)]
    frame = spark.createDataFrame(rows, "dataset_key string, feature_id string, date date, y double")
    got = I.backtest_origins(I.histories(frame, ["y"]), "2000-12-01").orderBy("origin").collect()
    assert [r["origin"] for r in got][0] == dt.date(2001, 6, 1) and all(r["origin"] <= dt.date(2002, 12, 1) for r in got)
    assert got[0]["recent"] == [float(v) for v in range(18)]
    assert I.supervised_rows(frame, ["y"], cutoff="2002-12-01").count() == 18
    assert I.sequence_rows(frame, ["y"]).count() == 30


@pytest.mark.parametrize(("name", "trees", "settings"), [("forecast_random_forest", "numTrees", "ForestSettings"), ("forecast_boosted_trees", "maxIter", "BoostSettings")])
def test_registered_tree_queries_train_the_defaults(spark, monkeypatch, name, trees, settings):
    from parchline.workloads import forecasts as W

    class Made(Exception):
        pass

    def caught(frame, make, *rest):
        raise Made(make())

    monkeypatch.setattr(W, "run_forecast", caught)
    with pytest.raises(Made) as made:
        getattr(W, name)(spark, "/root/testdata/sf0.001")
    regressor, default = made.value.args[0].estimator, getattr(M, settings)()
    assert (regressor.getOrDefault(trees), regressor.getMaxDepth()) == (default.trees, default.depth)


def test_settings_are_used_or_refused():
    assert M.random_forest(M.ForestSettings(trees=20, leaf=1)).getNumTrees() == 20
    boosted = M.boosted_trees(M.BoostSettings(trees=5, depth=1, rate=0.001, column_share=1.0))
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize(), boosted.getFeatureSubsetStrategy()) == (5, 1, 0.001, "all")
    for make in (lambda: M.ForestSettings(trees=0), lambda: M.BoostSettings(row_share=0.0), lambda: M.BoostSettings(column_share=1.5), lambda: M.BoostSettings(rate=-1.0)):
        with pytest.raises(ValueError):
            make()


def monthly(spark, series, months=60):
    rows = [("d", s, dt.date(2000 + i // 12, i % 12 + 1, 1), float(v)) for s in series for i, v in enumerate(np.random.default_rng(ord(s)).normal(size=months) + np.sin(np.arange(months)))]
    return I.with_lags(spark.createDataFrame(rows, "dataset_key string, feature_id string, date date, y double"))


HELPED = [*I.BASE_INPUTS, "rain"]
RAIN = {m: {"rain": m / 10} for m in range(1, 12)}


def test_lines_of_all_leads_match_single_steps(spark):
    """The stored pipeline forecasts one month at a time; a loop over it gives what the composed lines give at once."""
    frame = monthly(spark, "ab").withColumn("rain", F.month("date") / 10)
    model = M.WindowForecaster(columns=HELPED, climatology=RAIN)
    model.fit(frame, None, 4)
    origins = I.final_origins(I.histories(frame, HELPED, 4))
    found = {(r.feature_id, r.lead_month): r.predicted for r in M.recursive_forecast(model, origins, 9).collect()}
    for row in origins.collect():
        window, recent = [list(w) for w in row.window], list(row.recent)
        for lead in range(1, 10):
            one = spark.createDataFrame([(window,)], "window array<array<double>>")
            value = model.pipeline().transform(one).first()["predicted"]
            assert math.isclose(found[row.feature_id, lead], value, rel_tol=1e-9, abs_tol=1e-9)
            month = (row.origin.month + lead - 1) % 12 + 1
            lags = [recent[-k] if len(recent) >= k else recent[-1] for k in I.LAGS]
            window = [*window[1:], [value, *lags, math.sin(2 * math.pi * month / 12), math.cos(2 * math.pi * month / 12), RAIN.get(month, {}).get("rain", 0.0)]]
            recent.append(value)
    short = origins.withColumn("window", F.slice("window", 1, 3))
    assert all(r.predicted is None for r in M.recursive_forecast(model, short, 3).collect())


def test_stored_models_forecast_alike(spark, tmp_path):
    frame = monthly(spark, "ab").withColumn("rain", F.month("date") / 10)
    origins = I.final_origins(I.histories(frame, HELPED))
    casters = [
        M.TreeForecaster("random_forest", M.random_forest(M.ForestSettings(trees=3, depth=3)), HELPED, RAIN),
        M.TreeForecaster("boosted_trees", M.boosted_trees(M.BoostSettings(trees=3, depth=2, column_share=1.0)), HELPED, RAIN),
        M.WindowForecaster(columns=HELPED, climatology=RAIN),
    ]
    for caster in casters:
        caster.fit(frame)
        path = str(tmp_path / caster.method)
        caster.pipeline().write().save(path)
        again = M.load_forecaster(path)
        assert (again.method, list(again.columns), again.climatology) == (caster.method, HELPED, RAIN)
        rows = [sorted(tuple(r) for r in M.recursive_forecast(c, origins, 4).collect()) for c in (caster, again)]
        assert rows[0] == rows[1] and len(rows[0]) == 8
    with pytest.raises(ValueError):
        M.WindowForecaster(columns=["month_sin"]).fit(frame)


@pytest.mark.parametrize("count, cores, tasks", [(0, 8, 1), (1200, 8, 1), (63_106, 8, 8), (63_106, 64, 16), (5_000_000, 8, 39)])
def test_training_rows_are_dealt_by_their_number(count, cores, tasks):
    assert M.training_tasks(count, cores) == tasks


def test_small_training_rows_take_several_tasks(spark, monkeypatch):
    """A few hundred rows are a few kilobytes, which Spark alone would leave to one task."""
    monkeypatch.setattr(M, "LEAST_TASK_ROWS", 20)
    caster = M.TreeForecaster("random_forest", M.random_forest(M.ForestSettings(trees=2, depth=2)), list(I.BASE_INPUTS), {})
    rows, count = caster.training(monthly(spark, "ab"))
    assert count == 84
    assert rows.rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, 5) > 1
    assert rows.count() == count


def test_no_task_reads_several_pooled_layers(spark):
    """Layers that are parts of one table are joined to it alike; a union of such plans would be read side by side."""
    from parchline.workloads import QUERIES

    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = QUERIES["pooled_layers"](spark, "/root/testdata/sf0.001")
        counts = rows.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("dataset_key").alias("n")).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert max(r["n"] for r in counts) == 1
