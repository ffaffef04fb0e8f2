"""Boosted trees against a plain booster that looks at one row and one threshold at a time."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwise.operators import boosting, models

FEATURES = ("a", "b", "c")


def data(n=500):
    draw = random.Random(11)
    rows = []
    for i in range(n):
        a, b, c = draw.gauss(0, 1), draw.randint(0, 5), draw.random()
        label = float(draw.random() < 1 / (1 + math.exp(1 - 2 * a * (b > 2) - c)))
        rows.append((i, 2000 + i % 5, label, a, float(b), round(c, 2)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    schema = "row_id long, filing_year int, label double, a double, b double, c double"
    return spark.createDataFrame(data(), schema).repartition(3).cache()


def plain_trees(rows, cuts, p, base):
    """Trees as nested tuples, grown row by row; without sampling."""
    values, labels = [r[3:] for r in rows], [r[2] for r in rows]
    margin, trees = [base] * len(rows), []

    def shrink(g):
        return math.copysign(max(abs(g) - p["reg_alpha"], 0), g)

    def grow(own, depth, g, h):
        total_g, total_h = sum(g[i] for i in own), sum(h[i] for i in own)
        best = (1e-6, None)
        if depth < p["max_depth"]:
            for f in range(len(FEATURES)):
                for cut in cuts[f]:
                    left = [i for i in own if values[i][f] <= cut]
                    lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                    if lh < p["min_child_weight"] or total_h - lh < p["min_child_weight"]:
                        continue
                    lam = p["reg_lambda"]
                    gain = shrink(lg) ** 2 / (lh + lam) + shrink(total_g - lg) ** 2 / (total_h - lh + lam)
                    gain -= shrink(total_g) ** 2 / (total_h + lam)
                    if gain > best[0] + 1e-7:
                        best = (gain, (f, cut))
        leaf = -p["learning_rate"] * shrink(total_g) / (total_h + p["reg_lambda"])
        if best[1] is None:
            return leaf
        f, cut = best[1]
        left = [i for i in own if values[i][f] <= cut]
        right = [i for i in own if values[i][f] > cut]
        children = grow(left, depth + 1, g, h), grow(right, depth + 1, g, h)
        if best[0] < p["gamma"] and not any(isinstance(c, tuple) for c in children):
            return leaf
        return f, float(cut), *children

    for _ in range(p["n_estimators"]):
        prob = [1 / (1 + math.exp(-m)) for m in margin]
        weight = [p["scale_pos_weight"] if y == 1 else 1.0 for y in labels]
        g = [w * (q - y) for w, q, y in zip(weight, prob, labels)]
        h = [w * q * (1 - q) for w, q in zip(weight, prob)]
        tree = grow(list(range(len(rows))), 0, g, h)
        trees.append(tree)
        for i, v in enumerate(values):
            at = tree
            while isinstance(at, tuple):
                at = at[2] if v[at[0]] <= at[1] else at[3]
            margin[i] += at
    return trees


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return float(tree.value[node])
    return int(tree.feature[node]), float(tree.threshold[node]), nested(tree, 2 * node + 1), nested(tree, 2 * node + 2)


def same(one, two):
    if isinstance(one, tuple) != isinstance(two, tuple):
        return False
    if not isinstance(one, tuple):
        return one == pytest.approx(two, abs=1e-6)
    return one[:2] == two[:2] and same(one[2], two[2]) and same(one[3], two[3])


@pytest.mark.parametrize(
    "parameters",
    [
        {"max_depth": 3},
        {"max_depth": 4, "gamma": 1.5, "reg_alpha": 0.7, "reg_lambda": 3.0, "min_child_weight": 2.5},
        {"max_depth": 2, "scale_pos_weight": 2.5, "reg_lambda": 0.0},
    ],
)
def test_trees_equal_a_plain_booster(table, monkeypatch, parameters):
    monkeypatch.setattr(boosting, "REBASE", 3)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    own = {**parameters, "n_estimators": 7, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0}
    boosters = boosting.fit_boosters(table, FEATURES, [boosting.Fit(None, own), boosting.Fit(2003, own)])
    for before, booster in zip((9999, 2003), boosters):
        rows = [r for r in data() if r[1] < before]
        settings = {**boosting.TREE_DEFAULTS, **own}
        pos = sum(r[2] for r in rows) * settings["scale_pos_weight"]
        assert booster.base == pytest.approx(math.log(pos / (len(rows) - sum(r[2] for r in rows))))
        plain = plain_trees(rows, booster.cuts, settings, booster.base)
        made = [nested(t) for t in booster.trees]
        assert all(same(x, y) for x, y in zip(made, plain)) and len(made) == len(plain)
        assert any(isinstance(t, tuple) for t in made)


def test_sampling_is_seeded_and_does_not_depend_on_partitions(table):
    own = {"n_estimators": 5, "max_depth": 3, "subsample": 0.6, "colsample_bytree": 0.4, "min_child_weight": 1}
    fits = [boosting.Fit(None, own), boosting.Fit(None, own, seed=7)]
    one, other = boosting.fit_boosters(table, FEATURES, fits)
    again = boosting.fit_boosters(table.repartition(7), FEATURES, fits[:1])[0]
    assert [nested(t) for t in one.trees] == [nested(t) for t in again.trees] != [nested(t) for t in other.trees]
    # One column of three a tree.
    assert all(len({f for f in t.feature.tolist() if f >= 0}) <= 1 for t in one.trees)


def test_scores_are_the_margins_of_the_rows(table):
    booster = boosting.fit_boosters(table, FEATURES, [boosting.Fit(None, {"n_estimators": 12, "max_depth": 4})])[0]
    got = {r.row_id: r.score for r in boosting.scored(table, booster).collect()}
    for r in data():
        margin = booster.base
        for tree in map(nested, booster.trees):
            while isinstance(tree, tuple):
                tree = tree[2] if r[3 + tree[0]] <= tree[1] else tree[3]
            margin += tree
        assert got[r[0]] == pytest.approx(1 / (1 + math.exp(-margin)))
    losses = [-math.log(got[r[0]] if r[2] else 1 - got[r[0]]) for r in data()]
    share = sum(r[2] for r in data()) / 500
    assert sum(losses) / 500 < -(share * math.log(share) + (1 - share) * math.log(1 - share))


def by_subsets(booster, values):
    """Shapley values from the margins expected for every set of known features."""

    def expected(tree, known, node=0):
        if tree.feature[node] < 0:
            return float(tree.value[node])
        f, children = int(tree.feature[node]), (2 * node + 1, 2 * node + 2)
        if f in known:
            return expected(tree, known, children[int(values[f] > tree.threshold[node])])
        return sum(tree.cover[c] / tree.cover[node] * expected(tree, known, c) for c in children)

    n = len(booster.features)
    margin = {
        s: booster.base + sum(expected(t, s) for t in booster.trees)
        for size in range(n + 1)
        for s in itertools.combinations(range(n), size)
    }
    out = []
    for j in range(n):
        total = 0.0
        for s in margin:
            if j not in s:
                w = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                total += w * (margin[tuple(sorted((*s, j)))] - margin[s])
        out.append(total)
    return out, margin[()]


@pytest.mark.parametrize("depth", [3, 5])
def test_contributions_equal_the_sum_over_all_subsets(table, depth):
    own = {"n_estimators": 6, "max_depth": depth, "min_child_weight": 1, "learning_rate": 0.3}
    booster = boosting.fit_boosters(table, FEATURES, [boosting.Fit(None, own)])[0]
    got = {r.row_id: r for r in boosting.tree_contributions(table, booster).collect()}
    for r in data()[:60]:
        values, empty = by_subsets(booster, r[3:])
        assert [got[r[0]][f] for f in FEATURES] == pytest.approx(values, abs=1e-9)
        assert got[r[0]].expected_margin == pytest.approx(empty)
        margin = booster.margins(np.array([r[3:]]))[0]
        assert sum(values) + empty == pytest.approx(margin)


def test_importances_of_all_kinds(table):
    with pytest.raises(ValueError, match="subsample"):
        models.boosted_trees(["a"], subsample=0)
    with pytest.raises(ValueError, match="learning_rate = 0, reg_alpha = -1"):
        models.boosted_trees(["a"], learning_rate=0, reg_alpha=-1)
    model = models.fit_full(table, models.boosted_trees(["a", "b", "c"], n_estimators=6, max_depth=3, scale_pos_weight=2.0))
    splits = [(int(f), t.gain[n], t.cover[n]) for t in model.trees for n, f in enumerate(t.feature) if f >= 0]
    for kind in ("gain", "cover", "weight"):
        made = {r.feature: r.importance for r in models.feature_importances(model, kind).collect()}
        for k, f in enumerate(FEATURES):
            own = [s for s in splits if s[0] == k]
            mean = sum(s[1 if kind == "gain" else 2] for s in own) / max(len(own), 1)
            assert made[f] == pytest.approx(len(own) if kind == "weight" else mean)
    permuted = {r.feature: r.importance for r in models.permutation_importances(table, model, FEATURES).collect()}
    assert permuted["a"] > 0.01 and permuted["a"] > permuted["c"]


def test_models_without_two_classes_have_no_trees(spark):
    rows = [(i, 2000 + i // 10, float(i >= 15), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, filing_year int, label double, a double")
    fits = [boosting.Fit(2001, {"n_estimators": 3}), boosting.Fit(1990), boosting.Fit(None, {"n_estimators": 3, "min_child_weight": 0.5})]
    early, none, full = boosting.fit_boosters(df, ["a"], fits)
    assert early.trees == none.trees == () and none.base == 0.0 and len(full.trees) == 3
    assert boosting.scored(df, early).where("score > 0.01").count() == 0


def test_walk_forward_with_trees(table):
    estimator = models.boosted_trees(FEATURES, n_estimators=8, max_depth=3, min_child_weight=1)
    plain = models.walk_forward(table, estimator, 5)
    calibrated = models.walk_forward(
        table, estimator, 5, raw_reference=True, min_train_years=2, calibration="chronological_holdout"
    )
    alone = boosting.fit_boosters(table, FEATURES, estimator.fits([2003]))[0]
    expected = boosting.scored(table.where("filing_year = 2003"), alone)
    for column in ("predicted_probability", "raw_probability"):
        own = plain if column == "predicted_probability" else calibrated
        both = own.where("test_year = 2003").join(expected, "row_id")
        assert both.count() == 100 and both.where(F.abs(F.col(column) - F.col("score")) > 1e-12).count() == 0
    assert sorted(r.test_year for r in plain.select("test_year").distinct().collect()) == [2001, 2002, 2003, 2004]
    assert sorted(r.test_year for r in calibrated.select("test_year").distinct().collect()) == [2002, 2003, 2004]
    with pytest.raises(ValueError, match="no such calibration"):
        models.walk_forward(table, estimator, 5, calibration="cross_validation")
    predictions, summary = models.score_holdout(table.where("filing_year < 2004"), table, estimator, (2004, 2004))
    assert predictions.count() == 100 and summary.first().test_n == 100


def test_a_tree_is_walked_once_and_margins_are_carried_on(table, monkeypatch):
    monkeypatch.setattr(boosting, "REBASE", 3)
    own = {"n_estimators": 8, "max_depth": 3, "min_child_weight": 1, "learning_rate": 0.3}
    booster = boosting.fit_boosters(table, FEATURES, [boosting.Fit(None, own)])[0]
    rows = np.array([r[3:] for r in data()])
    bins = np.ascontiguousarray(boosting._binned(rows, list(booster.cuts)).T)
    block = boosting._Block(np.zeros(len(rows)), np.arange(len(rows)), {None: bins}, {0: np.full(len(rows), booster.base)})
    for tree in booster.trees:
        block = boosting._moved({0: (None, tree)}, block)
    assert block.margin[0] == pytest.approx(booster.margins(rows), abs=1e-12)
    walked = []
    monkeypatch.setattr(boosting, "descend", lambda *a, walk=boosting.descend: walked.append(a) or walk(*a))
    growing = boosting._Growing(0, None, 1, [0, 1, 2], 1.0, 1.0, boosting._empty_tree(3), [0], [len(c) + 1 for c in booster.cuts])
    assert len(dict(boosting._level([growing], [block]))) == 1 and len(walked) == 1


def test_rows_use_all_cores_before_tasks_grow(spark):
    cores = spark.sparkContext.defaultParallelism
    assert boosting.task_number(spark, 100) == 1
    assert boosting.task_number(spark, cores * boosting.BLOCK_ROWS) == cores
    assert boosting.task_number(spark, 2 * cores * boosting.TASK_BLOCKS * boosting.BLOCK_ROWS) == 2 * cores


def test_tables_of_a_leaf_follow_the_definition():
    shares = np.array([[0.3, 0.6, 0.9], [0.5, 0.2, 0.4]])
    tables = boosting._outcome_tables(np.array([2.0, -1.0]), shares)
    for leaf, value in enumerate((2.0, -1.0)):
        for outcome in range(8):
            passed = [(outcome >> k) & 1 for k in range(3)]

            def weight(known):
                return value * math.prod(passed[k] if k in known else shares[leaf, k] for k in range(3))

            for j in range(3):
                gains = [
                    weight(order[: order.index(j) + 1]) - weight(order[: order.index(j)])
                    for order in itertools.permutations(range(3))
                ]
                assert tables[leaf, j, outcome] == pytest.approx(sum(gains) / 6)
