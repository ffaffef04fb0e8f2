"""Calibration maps against fits that see all rows at once."""

import math
import random

import numpy as np
import pytest

from ledgerwise.operators import calibration, models


def rows(n, seed, decimals):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        s = round(draw.gauss(0, 2), decimals)
        out.append((s, float(draw.random() < 1 / (1 + math.exp(1 - 0.8 * s)))))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "score double, label double").repartition(4)


def isotonic_by_hand(data):
    """The max-min formula over all ranges of distinct scores."""
    xs = sorted({s for s, _ in data})
    n = np.array([sum(s == x for s, _ in data) for x in xs], float)
    p = np.array([sum(y for s, y in data if s == x) for x in xs])
    cn, cp = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(p)))
    k = len(xs)
    mean = [[(cp[b + 1] - cp[a]) / (cn[b + 1] - cn[a]) if b >= a else math.inf for b in range(k)] for a in range(k)]
    least = [[min(mean[a][b:]) for b in range(k)] for a in range(k)]
    return xs, [max(least[a][i] for a in range(i + 1)) for i in range(k)]


@pytest.mark.parametrize("n, decimals", [(300, 1), (120, 6), (40, 0), (1, 1)])
def test_isotonic_equals_the_max_min_formula(spark, n, decimals):
    data = rows(n, n, decimals)
    xs, ys = isotonic_by_hand(data)
    add = calibration.isotonic_map(calibration.score_counts(frame(spark, data)))
    made = {r.score: r.calibrated for r in add(frame(spark, data)).collect()}
    assert [made[x] for x in xs] == pytest.approx(ys)
    beyond = add(spark.createDataFrame([(-99.0, 0.0), (99.0, 0.0)], "score double, label double")).collect()
    assert sorted(r.calibrated for r in beyond) == pytest.approx([min(ys), max(ys)])


def test_isotonic_is_linear_between_blocks(spark):
    data = [(0.0, 0.0), (1.0, 0.0), (3.0, 1.0), (3.0, 0.0), (4.0, 1.0), (float("nan"), 1.0)]
    add = calibration.isotonic_map(calibration.score_counts(frame(spark, data)))
    found = add(spark.createDataFrame([(0.5, 0.0), (2.0, 0.0), (3.5, 0.0)], "score double, label double"))
    assert sorted(r.calibrated for r in found.collect()) == pytest.approx([0.0, 0.25, 0.75])


@pytest.mark.parametrize("smoothed", [True, False])
@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_sigmoid_equals_a_fit_on_all_rows(spark, smoothed, scale):
    data = [(s * scale, y) for s, y in rows(400, 9, 2)]
    slope, intercept = calibration.fit_sigmoid(calibration.score_counts(frame(spark, data)), smoothed)
    x, y = np.array([s for s, _ in data]) / scale, np.array([v for _, v in data])
    p, q = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (q + 2)) if smoothed else y
    w = np.zeros(2)
    for _ in range(100):
        m = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        g = np.array([((m - t) * x).sum(), (m - t).sum()])
        d = m * (1 - m)
        w = w - np.linalg.solve(np.array([[(d * x * x).sum(), (d * x).sum()], [(d * x).sum(), d.sum()]]), g)
    assert (slope * scale, intercept) == pytest.approx(tuple(w), rel=1e-5)


def test_separated_classes_have_a_finite_map(spark):
    data = [(float(k), float(k > 5)) for k in range(12)]
    slope, intercept = calibration.fit_sigmoid(calibration.score_counts(frame(spark, data)))
    assert 0 < slope < 100 and math.isfinite(intercept)


def test_cross_validated_maps_work_on_margins(spark):
    draw = random.Random(1)
    data = [(i, 2000 + i % 4, float(draw.random() < 1 / (1 + math.exp(-(i % 7 - 3)))), float(i % 7)) for i in range(200)]
    table = spark.createDataFrame(data, "row_id long, filing_year int, label double, a double")
    late, early = table.where("filing_year = 2003"), table.where("filing_year < 2003")
    for method in ("sigmoid", "isotonic"):
        scored = models.fit_scorer(models.logistic(["a"]), early, "cross_validation", method, cv=3)(late).collect()
        by_a = {i: s for i, s in ((r.row_id % 7, r.score) for r in scored)}
        values = [by_a[k] for k in sorted(by_a)]
        assert len(scored) == 50 and values == sorted(values) and 0 <= values[0] < 0.3 < 0.6 < values[-1] <= 1
