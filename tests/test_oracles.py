"""Every registered query against its SQL on the smallest tables."""

from functools import partial

import pytest

from oracle import compare, connect
from parchline.forecasting import models
from parchline.workloads import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, con, name, monkeypatch):
    # The tree queries train hundreds of deep trees; what SQL states of their rows holds for few shallow ones as well.
    monkeypatch.setattr(models, "ForestSettings", partial(models.ForestSettings, trees=5, depth=3))
    monkeypatch.setattr(models, "BoostSettings", partial(models.BoostSettings, trees=5, depth=2))
    result, rows = compare(spark, con, name, FOLDER)
    assert result == "ok", result


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
