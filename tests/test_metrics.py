import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from ledgerwise import fixed_values as fv
from ledgerwise.catalog import views
from ledgerwise.functions import numbers
from ledgerwise.operators import hypothesis, metrics, selection

SCHEMA = "test_year int, row_id long, true_label int, predicted_probability double"


def by_hand(rows):
    """All metrics of one year from pairwise and per-row definitions."""
    y, p = [r[2] for r in rows], [r[3] for r in rows]
    d = [int(v >= 0.5) for v in p]
    pos = [b for a, b in zip(y, p) if a]
    neg = [b for a, b in zip(y, p) if not a]
    out = {"roc_auc": None, "pr_auc": None}
    if pos and neg:
        out["roc_auc"] = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        steps, before = 0.0, 0
        for t in sorted(set(p), reverse=True):
            hit = sum(a for a, b in zip(y, p) if b >= t)
            steps += (hit - before) / len(pos) * hit / sum(b >= t for b in p)
            before = hit
        out["pr_auc"] = steps
    tp = sum(a and b for a, b in zip(y, d))
    fp, fn = sum(d) - tp, sum(y) - tp
    tn = len(y) - tp - fp - fn
    div = lambda a, b: a / b if b else 0.0
    out["precision"], out["recall"] = div(tp, tp + fp), div(tp, tp + fn)
    f = [div(2 * tp, 2 * tp + fp + fn), div(2 * tn, 2 * tn + fp + fn)]
    out["f1"] = f[0]
    seen = [v for v, c in ((f[0], 1), (f[1], 0)) if c in y or c in d]
    out["f1_macro"] = sum(seen) / len(seen)
    out["mcc"] = div(tp * tn - fp * fn, math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    recalls = [div(a, a + b) for a, b in ((tp, fn), (tn, fp)) if a + b]
    out["balanced_acc"] = sum(recalls) / len(recalls)
    out["brier_score"] = sum((a - b) ** 2 for a, b in zip(y, p)) / len(y)
    rate = sum(y) / len(y)
    out["naive_brier_score"] = rate * (1 - rate)
    out["brier_skill_score"] = 1 - out["brier_score"] / (rate * (1 - rate)) if 0 < rate < 1 else None
    n = max(1, math.ceil(len(y) * 0.05))
    queue = sorted(rows, key=lambda r: (-r[3], r[1]))[:n]
    found = sum(r[2] for r in queue)
    out["recall_at_5_percent"] = found / sum(y) if sum(y) else None
    out["precision_at_5_percent"] = found / n
    out["review_n_at_5_percent"] = n
    edges = numbers.bin_edges(10)
    bins = {}
    for a, b in zip(y, p):
        bins.setdefault(sum(b >= e for e in edges), []).append((a, b))
    gaps = {
        k: (len(v), abs(sum(a for a, _ in v) / len(v) - sum(b for _, b in v) / len(v)))
        for k, v in bins.items()
    }
    out["ece"] = sum(c * g for c, g in gaps.values()) / len(y)
    out["mce"] = max(g for _, g in gaps.values())
    return out


def case():
    draw = random.Random(11)
    rows, i = [], 0
    for year, size in ((2000, 37), (2001, 400), (2002, 1), (2003, 60), (2004, 50)):
        for _ in range(size):
            label = 0 if year == 2003 else int(draw.random() < 0.2)
            score = 0.5 if year == 2004 else draw.choice([0.1, 0.3, 0.6, 0.7, 1.0, 0.0, round(draw.random(), 2)])
            rows.append((year, i, label, score))
            i += 1
    draw.shuffle(rows)
    return rows


def test_fold_metrics_equal_definitions(spark):
    rows = case()
    df = metrics.apply_threshold(spark.createDataFrame(rows, SCHEMA).repartition(5))
    found = {r.test_year: r for r in metrics.fold_metrics(df).collect()}
    assert sorted(found) == [2000, 2001, 2002, 2003, 2004]
    for year, row in found.items():
        expected = by_hand([r for r in rows if r[0] == year])
        for name, value in expected.items():
            got = row[name]
            assert (got is None and value is None) or got == pytest.approx(value, abs=1e-12), (year, name)
        assert row.ece <= row.mce + 1e-12


def test_queue_rows_break_ties_by_row_id(spark):
    rows = case()
    queue = metrics.review_queue(spark.createDataFrame(rows, SCHEMA)).collect()
    for year in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == year]
        top = sorted(mine, key=lambda r: (-r[3], r[1]))[: max(1, math.ceil(len(mine) * 0.05))]
        assert {r.row_id for r in queue if r.test_year == year} == {r[1] for r in top}


def test_edges_go_up_for_the_error_and_down_for_the_curve(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.1), (1, 2, 1, 0.3), (1, 3, 1, 0.6)], SCHEMA)
    up = {r.bin for r in metrics.calibration_bins(df, 10, True).collect()}
    down = {r.bin for r in metrics.reliability_curve(df).collect()}
    # 0.3 is below its edge 0.30000000000000004, 0.6 below 0.6000000000000001.
    assert up == {1, 2, 5} and down == {0, 2, 5}


def test_threshold_search(spark):
    rows = [(1, i, int(s >= 0.42), s) for i, s in enumerate([0.1, 0.2, 0.42, 0.5, 0.9])]
    rows += [(2, 9, 0, 0.4)]
    validation = spark.createDataFrame(rows, SCHEMA)
    best = {r.test_year: r for r in metrics.best_threshold(validation).collect()}
    assert best[1].threshold == metrics.threshold_candidates()[20] and best[1].best_f1 == 1.0
    assert best[2].threshold == 0.5
    with pytest.raises(ValueError, match="validation"):
        metrics.best_threshold(validation, train=validation)


def test_threshold_counts_at_float_edges(spark):
    thresholds = metrics.threshold_candidates()
    scores = [0.0, 1.0] + thresholds + [t - 1e-12 for t in thresholds]
    df = spark.createDataFrame([(1, i, 1, s) for i, s in enumerate(scores)], SCHEMA)
    for r in metrics.threshold_sweep(df).collect():
        assert r.predicted == sum(s >= r.threshold for s in scores)


def test_summary_skips_undefined_folds(spark):
    df = metrics.apply_threshold(spark.createDataFrame(case(), SCHEMA))
    folds = metrics.fold_metrics(df)
    summary = {r.metric: r for r in metrics.metric_summary(folds).collect()}
    aucs = [r.roc_auc for r in folds.collect() if r.roc_auc is not None]
    assert summary["roc_auc"]["mean"] == pytest.approx(sum(aucs) / len(aucs), abs=1e-6)
    assert set(summary) == set(fv.METRICS)


def test_holm_is_monotone(spark):
    tests = spark.createDataFrame(
        [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.9)], "feature string, p_value double"
    )
    found = {r.feature: r.p_holm for r in hypothesis.holm(tests).collect()}
    assert found["a"] == pytest.approx(0.04) and found["c"] == pytest.approx(0.09)
    assert found["b"] == pytest.approx(0.09) and found["e"] == pytest.approx(0.9)
    assert found["d"] is None


def test_hypothesis_statistics_on_a_known_table(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, 1.0), (1, 4.0, None), (0, 3.0, 5.0), (0, 6.0, 4.0), (0, 9.0, float("nan"))]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    row = {r.feature: r for r in hypothesis.hypothesis_tests(df, ["a", "b"], "y").collect()}
    m1, m0, v1, v0 = 7 / 3, 6.0, 7 / 3, 9.0
    assert row["a"].cohens_d == pytest.approx((m1 - m0) / math.sqrt((2 * v1 + 2 * v0) / 4))
    assert row["a"].t_stat == pytest.approx((m1 - m0) / math.sqrt(v1 / 3 + v0 / 3))
    assert (row["b"].fraud_n, row["b"].clean_n) == (2, 2)
    assert row["b"].effect == "Large"
    corr = {(r.feature_a, r.feature_b): r.correlation for r in hypothesis.correlation_matrix(df, ["a", "b"]).collect()}
    assert corr["a", "b"] == corr["b", "a"] and corr["a", "a"] == pytest.approx(1.0)
    vif = hypothesis.variance_inflation(df, ["a", "b"]).collect()
    assert vif[0].vif == pytest.approx(1 / (1 - corr["a", "b"] ** 2))


def test_candidate_selection(spark):
    schema = "number int, value double, skill double, recall5 double, prauc double"
    rows = [(1, 0.5, 0.1, 0.2, 0.3), (2, 0.5, 0.1, 0.2, 0.3), (3, 0.9, -0.1, 0.9, 0.9),
            (4, float("nan"), float("nan"), 0.9, 0.9), (5, 0.4, 0.2, 0.2, 0.2)]
    trials = spark.createDataFrame(rows, schema)
    chosen = selection.select_candidate(trials).first()
    assert (chosen.status, chosen.selected_trial_number, chosen.eligible_count) == ("selected", 1, 3)
    none = selection.select_candidate(trials.where("number in (3, 4)")).first()
    assert (none.status, none.selected_trial_number) == ("no_eligible_candidate", None)
    assert [r.number for r in selection.top_trials(trials).collect()] == [3, 1, 2, 5]
    with pytest.raises(ValueError):
        selection.winner_row(trials, 99)


def test_sample_is_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    first = {r.row_id for r in selection.seeded_sample(df, "row_id", 50).collect()}
    again = {r.row_id for r in selection.seeded_sample(df.repartition(9), "row_id", 50).collect()}
    assert first == again and len(first) == 50


def test_calibration_summary(spark):
    folds = spark.createDataFrame(
        [(0.1, 0.2, 0.01, 0.1), (0.3, 0.2, 0.03, 0.2), (0.2, None, 0.02, 0.3)],
        "brier_score double, raw_brier_score double, ece double, mce double",
    )
    row = metrics.calibration_summary(folds).first()
    assert (row.folds_improved, row.folds_worsened, row.n_calibrated_folds) == (1, 1, 3)
    assert row.brier_improvement_mean == pytest.approx(0.0)


def test_variance_inflation_of_all_densities(spark):
    folder = "/root/testdata/sf0.001"
    names = list(fv.LEXICON_DENSITIES)
    rows = views.density_rows(spark, folder).select(*names).dropna().collect()
    values = np.array([tuple(r) for r in rows], float)
    got = {r.feature: r.vif for r in queries()["variance_inflation_all_a14"](spark, folder).collect()}
    assert set(got) == set(names)
    for k, name in enumerate(names):
        y, x = values[:, k], np.column_stack([np.ones(len(values)), np.delete(values, k, axis=1)])
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert got[name] == pytest.approx(((y - y.mean()) ** 2).sum() / (rest**2).sum(), rel=1e-5)
