"""Candidate review, and the hold-out evaluation that happens once."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerwise.operators import metrics, models, search, selection
from ledgerwise.plans import experiment

FEATURES = ("a", "b")


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(4)
    rows = []
    for i in range(480):
        a, b = draw.gauss(0, 1), draw.gauss(0, 1)
        rows.append((i, 2000 + i % 6, float(draw.random() < 1 / (1 + math.exp(1 - 2 * a))), a, b))
    return spark.createDataFrame(rows, "row_id long, filing_year int, label double, a double, b double").cache()


def trials_of(spark, values):
    rows = [
        (k, v, json.dumps({"c": 10.0 ** (k - 2), "balanced": k % 2 == 1, "max_iter": 500})) for k, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "number int, value double, parameters string")


@pytest.fixture(scope="module")
def reviewed(spark, table):
    trials = trials_of(spark, [0.5, 0.7, float("nan"), 0.6, None, 0.7])
    return experiment.review_candidates(trials, table, FEATURES, search.logistic_models, size=3, min_positives=5).cache()


def test_review_takes_the_best_trials_and_calibrates_them(table, reviewed):
    rows = {r.number: r for r in reviewed.collect()}
    assert sorted(rows) == [1, 3, 5]
    assert all(r.folds == 4 == r.calibrated_folds and r.eligible == (r.skill > 0) for r in rows.values())
    for number in (1, 3):
        predictions = models.walk_forward(
            table, models.logistic(FEATURES, **json.loads(rows[number].parameters)), 5, min_train_years=2,
            calibration="chronological_holdout",
        )
        folds = metrics.fold_metrics(predictions)
        summary = {r.metric: r["mean"] for r in metrics.metric_summary(folds).collect()}
        for name in ("roc_auc", "pr_auc", "brier_score", "brier_skill_score", "recall_at_5_percent"):
            assert rows[number][name] == pytest.approx(summary[name], abs=2e-4)
    choice = selection.select_candidate(reviewed).first()
    assert choice.status == "selected" and choice.candidate_count == 3


def parts(table):
    return table.where("filing_year < 2004"), table.where("filing_year >= 2004")


def run(guarded, development, holdout, contract, window=(2004, 2005)):
    def score(parameters, rows):
        return models.score_holdout(development, rows, models.logistic(FEATURES, **parameters), window)

    return guarded.evaluate(development, holdout, contract, window, score)


def test_hold_out_is_evaluated_once(spark, table, reviewed, tmp_path):
    development, holdout = parts(table)
    contract = models.artifact_contract(development, FEATURES, "x")
    guarded = experiment.GuardedHoldout(spark, str(tmp_path / "one"))
    with pytest.raises(RuntimeError, match="empty, not selected"):
        run(guarded, development, holdout, contract)
    assert guarded.select(reviewed, contract) == guarded.selected()["parameters"]
    with pytest.raises(RuntimeError, match="already started"):
        guarded.select(reviewed, contract)
    manifest = {r.name: r.rows for r in run(guarded, development, holdout, contract).collect()}
    assert manifest == {"predictions": 160, "summary": 1} and guarded.state() == "sealed"
    assert guarded.result("summary").first().test_period == "2004-2005"
    again = experiment.GuardedHoldout(spark, str(tmp_path / "one"))
    with pytest.raises(RuntimeError, match="sealed, not selected"):
        run(again, development, holdout, contract)


def test_gates_come_before_the_start(spark, table, reviewed, tmp_path):
    development, holdout = parts(table)
    contract = models.artifact_contract(development, FEATURES, "x")
    guarded = experiment.GuardedHoldout(spark, str(tmp_path / "gates"))
    with pytest.raises(RuntimeError, match="no candidate is eligible"):
        guarded.select(reviewed.withColumn("skill", F.lit(-0.1)), contract)
    guarded.select(reviewed, contract)
    other = models.artifact_contract(development.where("row_id <> 3"), FEATURES, "y")
    with pytest.raises(RuntimeError, match="mismatch: development_data, experiment_name"):
        run(guarded, development, holdout, other)
    with pytest.raises(ValueError, match="must end before"):
        run(guarded, table, holdout, contract)
    assert guarded.state() == "selected"


def test_a_lost_driver_leaves_its_state_visible(spark, table, reviewed, tmp_path):
    development, holdout = parts(table)
    contract = models.artifact_contract(development, FEATURES, "x")
    guarded = experiment.GuardedHoldout(spark, str(tmp_path / "crash"))
    guarded.select(reviewed, contract)
    with pytest.raises(KeyError):
        guarded.evaluate(development, holdout, contract, (2004, 2005), lambda *_: {}["lost"])
    assert guarded.state() == "started"
    with pytest.raises(RuntimeError, match="started, not selected"):
        run(guarded, development, holdout, contract)
    with pytest.raises(RuntimeError, match="started, not sealed"):
        guarded.result("summary")
    # Lost between scoring and sealing: the scored tables are sealed as they are.
    late = experiment.GuardedHoldout(spark, str(tmp_path / "late"))
    late.select(reviewed, contract)
    original, late.seal = late.seal, lambda: (_ for _ in ()).throw(KeyError("lost"))
    with pytest.raises(KeyError):
        run(late, development, holdout, contract)
    assert late.state() == "scored"
    late.seal = original
    assert late.seal().count() == 2 and late.state() == "sealed"
