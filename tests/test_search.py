"""Parameter search: proposals, models fitted together, and trials that a later run continues."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from ledgerwise.operators import metrics, models, search

FEATURES = ("a", "b", "flat")


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(2)
    rows = []
    for i in range(300):
        a, b = draw.gauss(5, 3), draw.gauss(0, 0.1)
        rows.append((i, 2000 + i % 5, float(draw.random() < 1 / (1 + math.exp(6 - a - 4 * b))), a, b, 7.0))
    schema = "row_id long, filing_year int, label double, a double, b double, flat double"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def test_models_fitted_together_equal_single_fits(table, monkeypatch):
    monkeypatch.setattr(search.boosting, "BLOCK_ROWS", 100)
    fits = [search.LinearFit(y, c, b) for y in (2002, 2004) for c in (1e-3, 0.5, 50.0) for b in (False, True)]
    fitted = search.fit_logistics(table, FEATURES, fits)
    for fit, own in zip(fits, fitted):
        train = table.where(f"filing_year < {fit.before}")
        single = models.fit_full(train, models.logistic(FEATURES, fit.c, balanced=fit.balanced))
        assert own.weights[1:] == pytest.approx(single.stages[-1].coefficients.toArray(), abs=2e-4)
        assert own.weights[0] == pytest.approx(single.stages[-1].intercept, abs=2e-4)
        scores = {r.row_id: r.s for r in single.transform(table).select("row_id", vector_to_array("rawPrediction")[1].alias("s")).collect()}
        rows = table.collect()
        made = own.margins(np.array([[r[f] for f in FEATURES] for r in rows]))
        assert made == pytest.approx([scores[r.row_id] for r in rows], abs=2e-3)


def test_one_class_is_refused(table):
    with pytest.raises(ValueError, match="both classes"):
        search.fit_logistics(table.where("label = 1"), FEATURES, [search.LinearFit(2003)])


def test_trials_equal_walk_forward_runs(table):
    years = search.usable_years(table, 5)
    sets = [{"c": 0.01, "balanced": False, "max_iter": 1000}, {"c": 10.0, "balanced": True, "max_iter": 1000}]
    found = search.evaluate(table, FEATURES, years, search.logistic_models(table, FEATURES, years, sets))
    for own, made in zip(sets, found):
        folds = metrics.fold_metrics(models.walk_forward(table, models.logistic(FEATURES, **own), 5))
        summary = {r.metric: r["mean"] for r in metrics.metric_summary(folds).collect()}
        assert made["folds"] == folds.count() == len(years)
        for name in ("pr_auc", "roc_auc", "recall_at_5_percent", "brier_skill_score"):
            assert made[name] == pytest.approx(summary[name], abs=1e-4)


def test_proposals_stay_in_range_and_follow_good_trials():
    space = search.TREE_SPACE
    finished = []
    for number in range(60):
        p = search.propose(space, number, finished, seed=1)
        assert p == search.propose(space, number, finished, seed=1)
        for name, kind in space.items():
            assert kind.low <= p[name] <= kind.high
        assert p["n_estimators"] % 50 == 0 and isinstance(p["max_depth"], int)
        finished.append((number, -abs(math.log(p["learning_rate"] / 0.02)) if number != 5 else float("nan"), p))

    def gap(trials):
        return sum(abs(math.log(t[2]["learning_rate"] / 0.02)) for t in trials) / len(trials)

    assert gap(finished[40:]) < 0.6 * gap(finished[:20])
    choices = [(k, float(k % 2), {"balanced": bool(k % 2)}) for k in range(40)]
    picked = [search.propose({"balanced": search.Choice((False, True))}, k, choices)["balanced"] for k in range(40, 60)]
    assert sum(picked) > 15


def test_a_later_run_continues(table, tmp_path):
    store = str(tmp_path / "trials")
    run = lambda n, **own: search.search(
        table, FEATURES, search.LOGISTIC_SPACE, search.logistic_models, n, 5, batch=3, **own
    )
    first = run(4, store=store).collect()
    assert sorted(r.number for r in first) == [0, 1, 2, 3]
    both = run(7, store=store).collect()
    assert [tuple(r) for r in both if r.number < 4] == [tuple(r) for r in first]
    assert sorted(r.number for r in both) == list(range(7))
    assert [r.value for r in both] == sorted((r.value for r in both), reverse=True)
    assert all(r.folds == 4 and set(json.loads(r.parameters)) == {"c", "balanced", "max_iter"} for r in both)


def test_trees_are_searched_too(table):
    space = {**search.TREE_SPACE, "n_estimators": search.Whole(4, 8, 2), "min_child_weight": search.Real(0.5, 1.0)}
    rows = search.search(table, ("a", "b"), space, search.tree_models, 3, 5).collect()
    assert len(rows) == 3 and all(0 < r.value <= 1 and r.folds == 4 for r in rows)


def test_linear_fits_use_the_tasks_of_all_cores(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(search.boosting, "task_number", lambda session, rows: asked.append(rows) or 3)
    rows = [(k, 2000 + k % 2, float(k % 3 == 0), float(k % 7)) for k in range(90)]
    frame = spark.createDataFrame(rows, "row_id long, filing_year int, label double, a double")
    early, whole = search.fit_logistics(frame, ["a"], [search.LinearFit(2001), search.LinearFit(2002)])
    assert asked == [90] and len(early.weights) == len(whole.weights) == 2
