"""Trees grown from cells: MLlib's trees where nothing is drawn, all rows in lots, and as many jobs for any number of trees."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from parchline.forecasting import answers as A, inputs as I, models as M, trees as T
from test_forecasting import HELPED, RAIN, monthly

COLUMNS = {"labelCol": "y", "featuresCol": "inputs", "predictionCol": "p", "seed": 5, "featureSubsetStrategy": "all"}


@pytest.fixture(scope="module")
def known(spark):
    """Rows with few values in each column, some of them twice, so that the bins are the values."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, k, 800) for k in (30, 12, 4, 1)]).astype(float)
    y = np.sin(x[:, 0] / 4) + x[:, 1] * x[:, 2] / 8 + rng.normal(size=800)
    rows = [(float(v), Vectors.dense(list(r))) for v, r in zip(y, x, strict=True)]
    return spark.createDataFrame([*rows, *rows[:50]], ["y", "inputs"]).repartition(3).localCheckpoint()


def said(model, rows):
    model = model.loaded() if isinstance(model, T.GrownTrees) else model
    return np.array([r.p for r in model.transform(rows).orderBy("y").select("p").collect()])


@pytest.mark.parametrize(("kind", "settings"), [
    (RandomForestRegressor, {"numTrees": 1, "maxDepth": 5, "bootstrap": False, "minInstancesPerNode": 3}),
    (GBTRegressor, {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1}),
])
def test_trees_are_mllibs_where_nothing_is_drawn(known, kind, settings):
    estimator = kind(**settings, **COLUMNS)
    mine, theirs = T.fit_trees(estimator, known, 850, 4).loaded(), estimator.fit(known)
    np.testing.assert_allclose(said(mine, known), said(theirs, known), atol=1e-9)
    assert (mine.totalNumNodes, mine.treeWeights, mine.uid) == (theirs.totalNumNodes, theirs.treeWeights, theirs.uid)
    np.testing.assert_allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)


def test_boosted_trees_take_no_job_of_their_own(spark, known):
    jobs = []
    for trees in (2, 9):
        spark.sparkContext.setJobGroup(f"boosted {trees}", "")
        caster = M.TreeForecaster("boosted_trees", M.boosted_trees(M.BoostSettings(trees=trees, depth=2)), ["y", "a", "b", "c", "d"])
        caster.train(known, 850)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosted {trees}")))
        assert caster.loaded().getNumTrees == trees
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[0] == jobs[1] > 0


def test_lots_hold_all_rows(known, monkeypatch):
    """With fewer units than rows, rows of a cell are drawn together; undrawn, sums and so trees are those of the rows."""
    estimator = GBTRegressor(maxIter=3, maxDepth=3, **COLUMNS)
    whole = said(T.fit_trees(estimator, known, 850, 4), known)
    monkeypatch.setattr(T, "MOST_UNITS", 845)
    cuts = T.thresholds(known, "inputs", 4, 32)
    cells = T.gathered(known, 850, "y", "inputs", cuts, 5)
    assert cells.n.sum() == 850 and len(cells.n) < 850
    np.testing.assert_allclose(said(T.fit_trees(estimator, known, 850, 4), known), whole, atol=1e-9)


def test_more_cells_than_can_be_held_are_left_to_mllib(known, monkeypatch):
    monkeypatch.setattr(T, "MOST_UNITS", 10)
    estimator = RandomForestRegressor(numTrees=2, maxDepth=3, **COLUMNS)
    assert T.gathered(known, 850, "y", "inputs", T.thresholds(known, "inputs", 4, 32), 5) is None
    np.testing.assert_allclose(said(T.fit_trees(estimator, known, 850, 4), known), said(estimator.fit(known), known))


def test_draws_are_of_rows(known):
    """A forest's trees draw each row about once, with replacement; boosted trees leave out a share, each tree its own."""
    cuts = T.thresholds(known, "inputs", 4, 32)
    cells = T.gathered(known, 850, "y", "inputs", cuts, 5)
    for estimator, mean, spread in ((RandomForestRegressor(numTrees=40, maxDepth=1, **COLUMNS), 850, 850**0.5), (GBTRegressor(maxIter=40, maxDepth=1, subsamplingRate=0.9, **COLUMNS), 765, 76.5**0.5)):
        rules = T.Rules.of(estimator, 4)
        found = T.forest(cells, rules, range(40)) if rules.rate is None else T.boosted(cells, rules)
        drawn = np.array([batch["weight"][0].as_py() for batch in found])
        assert len(set(drawn)) > 10 and abs(drawn.mean() - mean) < spread and 0.6 * spread < drawn.std() < 1.5 * spread


def test_columns_are_left_out_at_a_split(known):
    cells = T.gathered(known, 850, "y", "inputs", T.thresholds(known, "inputs", 4, 32), 5)
    rules = T.Rules.of(RandomForestRegressor(numTrees=30, maxDepth=2, **{**COLUMNS, "featureSubsetStrategy": "0.5"}), 4)
    assert rules.columns == 2
    assert {batch["feature"][0].as_py() for batch in T.forest(cells, rules, range(30))} == {0, 1, 2}


@pytest.mark.parametrize("make", [
    lambda: M.TreeForecaster("random_forest", M.random_forest(M.ForestSettings(trees=7, depth=6)), HELPED, RAIN),
    lambda: M.TreeForecaster("boosted_trees", M.boosted_trees(M.BoostSettings(trees=7, depth=4)), HELPED, RAIN),
])
def test_all_leads_are_looked_up(spark, monkeypatch, make):
    """What the table says is what the model says step by step; the model itself is not asked row by row. Short series take their last value for a lag."""
    frame = monthly(spark, "abcd").withColumn("rain", F.month("date") / 10)
    caster = make()
    caster.fit(frame)
    origins = I.histories(frame, HELPED).where("rows in (1, 2, 5, 18, 59, 60)").localCheckpoint()

    def ahead():
        return {(r.feature_id, r.origin, r.lead_month): r.predicted for r in M.recursive_forecast(caster, origins, 12).collect()}

    with monkeypatch.context() as m:
        m.setattr(A, "MOST_ANSWERS", 0)
        steps = ahead()
    monkeypatch.setattr(M.TreeForecaster, "predict", None)
    found = ahead()
    assert len(found) == 4 * 6 * 12 and found.keys() == steps.keys()
    assert max(abs(found[k] - steps[k]) for k in found) < 1e-9


def test_a_forest_takes_no_job_for_each_level(spark, known):
    jobs = []
    for depth in (2, 6):
        spark.sparkContext.setJobGroup(f"forest {depth}", "")
        caster = M.TreeForecaster("random_forest", M.random_forest(M.ForestSettings(trees=4, depth=depth)), ["y", "a", "b", "c", "d"])
        caster.train(known, 850)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest {depth}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[0] == jobs[1] > 0


def test_bins_come_back_from_one_number():
    cuts = [np.arange(3.0), np.arange(40.0), np.array([])]
    rng = np.random.default_rng(1)
    bins = np.column_stack([rng.integers(0, len(c) + 1, 500) for c in cuts])
    cells = T.Cells.gathered(np.ravel_multi_index(bins.T, [len(c) + 1 for c in cuts]), cuts, None, bins @ [1.0, 10.0, 100.0], None)
    np.testing.assert_array_equal(cells.bins[:, cells.of].T @ [1.0, 10.0, 100.0], cells.total)
    assert len(cells.total) == 500 and cells.bins.shape[1] == len({tuple(b) for b in bins})
