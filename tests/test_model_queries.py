"""The registered model queries run the whole job: all trees, folds and trials."""

import inspect

import pytest

from __spark_entry__ import queries
from ledgerwise.catalog import model_queries
from ledgerwise.operators import models, search


class Called(Exception):
    pass


def arguments(monkeypatch, name, module, function, spark):
    """What a query passes to a function of a module, which is not run."""
    kept, real = {}, getattr(module, function)

    def called(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        kept.update(bound.arguments)
        raise Called

    rows = spark.createDataFrame([(1, 2000), (2, 2001)], "row_id int, filing_year int")
    monkeypatch.setattr(model_queries, "table", lambda *_: rows)
    monkeypatch.setattr(module, function, called)
    with pytest.raises(Called):
        queries()[name](spark, "")
    return kept


@pytest.mark.parametrize("name", ["boosted_trees_l4", "tree_importances_l13", "tree_contributions_l14", "permutation_importances_l14"])
def test_tree_queries_fit_all_trees(spark, monkeypatch, name):
    function = "walk_forward" if name == "boosted_trees_l4" else "fit_full"
    settings = arguments(monkeypatch, name, models, function, spark)["estimator"].fits([None])[0].settings
    assert (settings["n_estimators"], settings["max_depth"]) == (400, 6)


def test_calibration_has_the_default_folds(spark, monkeypatch):
    assert arguments(monkeypatch, "cross_validated_calibration_l9", models, "fit_scorer", spark)["cv"] == 5


def test_search_runs_all_trials(spark, monkeypatch):
    assert arguments(monkeypatch, "parameter_search_l11", search, "search", spark)["trials"] == 200
