"""Parameter search by mean average precision over walk-forward folds.

Trials are proposed in batches: the first at random, later ones where good trials are dense and others are
not (tree-structured Parzen estimates, one parameter at a time). All trials and folds of a batch are fitted
together: linear models by Newton steps, each one pass over the rows for all models, boosted trees in
step (`boosting.fit_boosters`). A batch's predictions are evaluated in one go. The trial table may be kept
in a folder, where a later run reads it and continues.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.operators import boosting, folds, metrics
from ledgerwise.scale import cut_lineage

YEAR, ROW, LABEL = "filing_year", "row_id", "label"
# Trials of one batch, and random ones before the estimates start.
BATCH, STARTUP = 20, 20
# Draws from the estimate of good values, of which the best ratio is proposed.
CANDIDATES = 24
# Folds of all trials of a batch are numbered like years, of which there are 9,999.
SLOTS = 9_999


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    def outer(self, value: float) -> float:
        return min(max(math.exp(value) if self.log else value, self.low), self.high)


@dataclass(frozen=True)
class Whole:
    low: int
    high: int
    step: int = 1

    def inner(self, value: int) -> float:
        return float(value)

    def outer(self, value: float) -> int:
        steps = round((value - self.low) / self.step)
        return int(min(max(self.low + steps * self.step, self.low), self.high))


@dataclass(frozen=True)
class Choice:
    values: tuple


Space = dict[str, Real | Whole | Choice]

# Ranges of the searched parameters.
LOGISTIC_SPACE: Space = {
    "c": Real(1e-4, 100.0, log=True),
    "balanced": Choice((False, True)),
    "max_iter": Whole(500, 3000, 250),
}
TREE_SPACE: Space = {
    "n_estimators": Whole(200, 1200, 50),
    "learning_rate": Real(0.005, 0.20, log=True),
    "max_depth": Whole(3, 8),
    "min_child_weight": Real(1.0, 20.0),
    "subsample": Real(0.60, 1.00),
    "colsample_bytree": Real(0.60, 1.00),
    "gamma": Real(0.0, 10.0),
    "reg_alpha": Real(1e-8, 5.0, log=True),
    "reg_lambda": Real(1e-8, 20.0, log=True),
}


# Proposals


def _kernels(kind: Real | Whole, values: list) -> list[tuple[float, float]]:
    """Centre and width of the normal kernels of an estimate: one for each value, one for the range."""
    low, high = kind.inner(kind.low), kind.inner(kind.high)
    centres = sorted(kind.inner(v) for v in values)
    ends = [low, *centres, high]
    least = (high - low) / min(100.0, 1.0 + len(centres))
    widths = [max(b - a, c - b, least) for a, b, c in zip(ends, ends[1:], ends[2:])]
    return [*zip(centres, widths), ((low + high) / 2, high - low)]


def _density(kernels: list[tuple[float, float]], low: float, high: float, x: float) -> float:
    def normal(z: float) -> float:
        return 0.5 * (1 + math.erf(z / math.sqrt(2)))

    total = 0.0
    for centre, width in kernels:
        inside = normal((high - centre) / width) - normal((low - centre) / width)
        total += math.exp(-0.5 * ((x - centre) / width) ** 2) / (width * max(inside, 1e-12))
    return total / len(kernels)


def _propose_one(kind, good: list, other: list, draw: random.Random):
    if isinstance(kind, Choice):
        def share(values, v):
            return (1 + sum(x == v for x in values)) / (len(kind.values) + len(values))

        drawn = [draw.choices(kind.values, [share(good, v) for v in kind.values])[0] for _ in range(CANDIDATES)]
        return max(drawn, key=lambda v: share(good, v) / share(other, v))
    low, high = kind.inner(kind.low), kind.inner(kind.high)
    near, far = _kernels(kind, good), _kernels(kind, other)
    drawn = []
    while len(drawn) < CANDIDATES:
        centre, width = draw.choice(near)
        x = draw.gauss(centre, width)
        if low <= x <= high:
            drawn.append(x)
    return kind.outer(max(drawn, key=lambda x: _density(near, low, high, x) / max(_density(far, low, high, x), 1e-300)))


def _random_one(kind, draw: random.Random):
    if isinstance(kind, Choice):
        return draw.choice(kind.values)
    return kind.outer(draw.uniform(kind.inner(kind.low), kind.inner(kind.high)))


def propose(space: Space, number: int, finished: list[tuple[int, float | None, dict]], seed: int = 42) -> dict:
    """Parameters of one trial, the same for the same history of (number, value, parameters)."""
    draw = random.Random(f"{seed}:{number}")
    usable = sorted(
        (t for t in finished if t[1] is not None and math.isfinite(t[1])), key=lambda t: (-t[1], t[0])
    )
    if len(usable) < STARTUP:
        return {name: _random_one(kind, draw) for name, kind in space.items()}
    n = min(math.ceil(0.1 * len(usable)), 25)
    good, other = usable[:n], usable[n:]
    return {
        name: _propose_one(kind, [t[2][name] for t in good], [t[2][name] for t in other], draw)
        for name, kind in space.items()
    }


# Linear models, many at once


@dataclass(frozen=True)
class LinearFit:
    """A standardized, L2-penalized logistic regression on the rows of years before `before`."""

    before: int
    c: float = 1.0
    balanced: bool = False
    max_iter: int = 1000


@dataclass(frozen=True)
class Linear:
    """Intercept and coefficients of standardized features, and how to standardize."""

    mean: np.ndarray
    scale: np.ndarray  # 0 for a constant feature, which then counts nothing
    weights: np.ndarray  # the intercept first

    def margins(self, values: np.ndarray) -> np.ndarray:
        return self.weights[0] + ((values - self.mean) * self.scale) @ self.weights[1:]


def _moments(table: DataFrame, features, befores: list[int]) -> dict[int, tuple]:
    """Rows, positives, means and 1 / standard deviation of the rows before each of some years.

    One row a calendar year reaches the driver; yearly means and squares are merged there.
    """
    numbers = [F.col(f).cast("double") for f in features]
    rows = table.groupBy(YEAR).agg(
        F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("pos"),
        F.array(*[F.avg(x) for x in numbers]).alias("mean"),
        F.array(*[F.var_pop(x) * F.count(x) for x in numbers]).alias("squares"),
    ).collect()
    out = {}
    for before in befores:
        n, pos, mean, squares = 0, 0.0, np.zeros(len(numbers)), np.zeros(len(numbers))
        for r in rows:
            if r[YEAR] < before:
                gap = np.array(r.mean) - mean
                squares = squares + np.array(r.squares) + gap**2 * (n * r.n / (n + r.n))
                mean = mean + gap * (r.n / (n + r.n))
                n, pos = n + r.n, pos + r.pos
        spread = np.sqrt(squares / max(n - 1, 1))
        out[before] = n, pos, mean, np.divide(1.0, spread, out=np.zeros(len(spread)), where=spread > 1e-300)
    return out


def _row_blocks(features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = boosting.feature_matrix(batch, features)
            label = batch.column(LABEL).cast(pa.float64()).to_numpy(zero_copy_only=False)
            year = batch.column(YEAR).cast(pa.int64()).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict(
                {n: pa.array([x.tobytes()], pa.binary()) for n, x in (("values", values), ("label", label), ("year", year))}
            )

    return run


def _steps(width: int, groups: dict, blocks) -> Iterator[tuple[int, np.ndarray]]:
    """Of each open model: loss, gradient and upper half of the Hessian, summed over a task's rows.

    `groups` maps `before` to means, scales and the open models: number, weights, class weights.
    """
    sums: dict[int, np.ndarray] = {}
    for row in blocks:
        label = np.frombuffer(row["label"], np.float64)
        values = np.frombuffer(row["values"], np.float64).reshape(len(label), width)
        year = np.frombuffer(row["year"], np.int64)
        for before, (mean, scale, models) in groups.items():
            inside = year < before
            y = label[inside]
            if not len(y):
                continue
            x = np.column_stack((np.ones(len(y)), (values[inside] - mean) * scale))
            for number, weights, (negative, positive) in models:
                margin = x @ weights
                w = np.where(y == 1, positive, negative)
                p = boosting.sigmoid(margin)
                loss = w @ (np.logaddexp(0.0, margin) - y * margin)
                hessian = (x * (w * p * (1 - p))[:, None]).T @ x
                found = np.concatenate(([loss], x.T @ (w * (p - y)), hessian.ravel()))
                sums[number] = sums[number] + found if number in sums else found
    yield from sums.items()


@dataclass
class _State:
    weights: np.ndarray
    tried: np.ndarray
    step: np.ndarray | None = None
    loss: float = math.inf
    iterations: int = 0
    done: bool = False


def fit_logistics(table: DataFrame, features, fits: list[LinearFit], tolerance: float = 1e-9) -> list[Linear]:
    """Fit many logistic models with one pass over the rows for each Newton step of all of them.

    The objective of a model is its weighted mean log-loss plus half its squared coefficients times
    1 / (c rows); the intercept is free. Balanced models weigh each class by rows / (2 rows of the class).
    A step that does not lower the objective is halved. Models without rows or with one class are refused.
    """
    features = tuple(features)
    befores = list(dict.fromkeys(f.before for f in fits))
    known = _moments(table, features, befores)
    empty = [b for b in befores if not 0 < known[b][1] < known[b][0]]
    if empty:
        raise ValueError(f"no rows of both classes before {empty}")
    width = len(features)
    parts = boosting.task_number(table.sparkSession, known[max(befores)][0])
    packed = table.select(ROW, LABEL, YEAR, *features).repartition(parts, ROW).mapInArrow(
        _row_blocks(features), "values binary, label binary, year binary"
    )
    blocks = packed.rdd.persist(StorageLevel.MEMORY_AND_DISK)
    states, class_weights, penalties = [], [], []
    for fit in fits:
        n, pos, _, _ = known[fit.before]
        start = np.zeros(width + 1)
        own = (n / (2 * (n - pos)), n / (2 * pos)) if fit.balanced else (1.0, 1.0)
        share = pos * own[1] / n
        start[0] = math.log(share / (1 - share)) if 0 < share < 1 else 0.0
        states.append(_State(start, start))
        class_weights.append(own)
        penalties.append(1.0 / (fit.c * n))
    try:
        while not all(s.done for s in states):
            groups = {
                b: (known[b][2], known[b][3], [
                    (m, s.tried, class_weights[m]) for m, (s, f) in enumerate(zip(states, fits)) if f.before == b and not s.done
                ])
                for b in befores
            }
            groups = {b: g for b, g in groups.items() if g[2]}
            sums = blocks.mapPartitions(partial(_steps, width, groups))
            if blocks.getNumPartitions() > 1:
                sums = sums.reduceByKey(np.add, blocks.getNumPartitions())
            for m, found in sums.collect():
                _newton(states[m], found / known[fits[m].before][0], penalties[m], fits[m].max_iter, tolerance)
    finally:
        blocks.unpersist()
    return [Linear(known[f.before][2], known[f.before][3], s.weights) for f, s in zip(fits, states)]


def _newton(state: _State, found: np.ndarray, penalty: float, max_iter: int, tolerance: float) -> None:
    """Judge the step that was tried, and make the next one."""
    k = len(state.weights)
    ridge = np.full(k, penalty)
    ridge[0] = 0.0
    loss = found[0] + 0.5 * float(ridge @ state.tried**2)
    state.iterations += 1
    if not loss <= state.loss + 1e-14 and state.step is not None:
        state.step = state.step / 2
        if np.max(np.abs(state.step)) < tolerance or state.iterations >= max_iter:
            state.done = True
        state.tried = state.weights + state.step
        return
    state.weights, state.loss = state.tried, loss
    gradient = found[1 : k + 1] + ridge * state.weights
    hessian = found[k + 1 :].reshape(k, k) + np.diag(ridge + 1e-12)
    state.step = -np.linalg.solve(hessian, gradient)
    state.done = bool(np.max(np.abs(state.step)) < tolerance) or state.iterations >= max_iter
    state.tried = state.weights + state.step


# Batches


def _fold_scores(features, models: dict[int, list[tuple[int, object]]], maps: dict[int, tuple[float, float]]):
    """Rows of each year with the scores of all its models: slot, row id, label, score.

    Where there is a map for a slot, the score is the mapped probability.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = boosting.feature_matrix(batch, features)
            year = batch.column(YEAR).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for test_year, own in models.items():
                rows = np.flatnonzero(year == test_year)
                if not len(rows):
                    continue
                taken = pa.array(rows)
                ids, labels = batch.column(ROW).take(taken), batch.column(LABEL).take(taken).cast(pa.float64())
                for slot, model in own:
                    score = boosting.sigmoid(model.margins(values[rows]))
                    if slot in maps:
                        score = boosting.sigmoid(maps[slot][0] * score + maps[slot][1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), slot, np.int32)), ids, labels, pa.array(score)],
                        ["slot", ROW, LABEL, "score"],
                    )

    return run


def logistic_models(table: DataFrame, features, years: list[int], sets: list[dict]) -> list[list[Linear]]:
    fits = [LinearFit(year, **p) for p in sets for year in years]
    fitted = fit_logistics(table, features, fits)
    return [fitted[k : k + len(years)] for k in range(0, len(fitted), len(years))]


def tree_models(table: DataFrame, features, years: list[int], sets: list[dict]) -> list[list[boosting.Booster]]:
    fits = [boosting.Fit(year, p) for p in sets for year in years]
    fitted = boosting.fit_boosters(table, features, fits)
    return [fitted[k : k + len(years)] for k in range(0, len(fitted), len(years))]


def usable_years(table: DataFrame, min_positives: int) -> list[int]:
    """Test years with enough positives, and earlier rows of both classes."""
    rows = folds.walk_forward_folds(table, YEAR, LABEL, min_positives).collect()
    return sorted(r.test_year for r in rows if 0 < r.train_positives < r.train_n)


def slot_of(trial: int, fold: int, folds: int) -> int:
    """The number that stands for a fold of a trial where metrics expect a year."""
    return 1 + trial * folds + fold


def slot_scores(
    table: DataFrame, features, by_year: dict[int, list[tuple[int, object]]], maps: dict[int, tuple[float, float]]
) -> DataFrame:
    """Scores of the rows of each year by its models: slot, row_id, label, score."""
    kind = dict(table.dtypes)[ROW]
    return table.select(ROW, YEAR, LABEL, *features).where(F.col(YEAR).isin(list(by_year))).mapInArrow(
        _fold_scores(tuple(features), by_year, maps), f"slot int, {ROW} {kind}, {LABEL} double, score double"
    )


def evaluate(
    table: DataFrame,
    features,
    years: list[int],
    models: list[list],
    maps: dict[int, tuple[float, float]] | None = None,
) -> list[dict]:
    """Mean fold metrics of each trial, from one evaluation of all trials' predictions."""
    by_year = {
        year: [(slot_of(t, k, len(years)), own[k]) for t, own in enumerate(models)] for k, year in enumerate(years)
    }
    rows = slot_scores(table, features, by_year, maps or {})
    predictions = cut_lineage(
        metrics.apply_threshold(
            rows.select(
                F.col("slot").alias(metrics.YEAR), F.col(ROW).alias(metrics.ROW),
                F.col(LABEL).cast("int").alias(metrics.LABEL), F.col("score").alias(metrics.SCORE),
            )
        )
    )
    # At most as many rows as there are calendar years.
    found = {r[metrics.YEAR]: r for r in metrics.fold_metrics(predictions).collect()}
    out = []
    for t in range(len(models)):
        own = [found[s] for s in range(slot_of(t, 0, len(years)), slot_of(t + 1, 0, len(years))) if s in found]
        means = {}
        for name in fv.METRICS:
            values = [r[name] for r in own if r[name] is not None and math.isfinite(r[name])]
            means[name] = round(sum(values) / len(values), 6) if values else None
        out.append({"folds": len(own), **means})
    return out


TRIALS_SCHEMA = (
    "number int, value double, recall5 double, prauc double, skill double, roc_auc double, folds int, parameters string"
)


def search(
    table: DataFrame,
    features,
    space: Space,
    models: Callable[[DataFrame, tuple, list[int], list[dict]], list[list]],
    trials: int,
    min_positives: int = fv.MIN_POSITIVES_PER_FOLD,
    seed: int = 42,
    store: str | None = None,
    batch: int = BATCH,
) -> DataFrame:
    """The trial table, best first; `value` is the mean average precision over folds.

    Trials run uncalibrated: calibration does not change a ranking metric. With `store`, a folder, each
    batch's trials are appended to a Parquet table, and those found there count as done.
    """
    spark = table.sparkSession
    years = usable_years(table, min_positives)
    if not years:
        raise ValueError("no fold has enough positives and earlier rows")
    batch = max(1, min(batch, SLOTS // len(years)))
    rows: list[tuple] = []
    if store is not None:
        try:
            rows = [tuple(r) for r in spark.read.schema(TRIALS_SCHEMA).parquet(store).collect()]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    while len(rows) < trials:
        finished = [(r[0], r[1], json.loads(r[7])) for r in rows]
        start = max((r[0] for r in rows), default=-1) + 1
        numbers = range(start, start + min(batch, trials - len(rows)))
        sets = [propose(space, number, finished, seed) for number in numbers]
        found = evaluate(table, features, years, models(table, tuple(features), years, sets))
        fresh = [
            (
                number, m["pr_auc"], m["recall_at_5_percent"], m["pr_auc"], m["brier_skill_score"],
                m["roc_auc"], m["folds"], json.dumps(p, sort_keys=True),
            )
            for number, p, m in zip(numbers, sets, found)
        ]
        if store is not None:
            spark.createDataFrame(fresh, TRIALS_SCHEMA).coalesce(1).write.mode("append").parquet(store)
        rows += fresh
    return spark.createDataFrame(rows, TRIALS_SCHEMA).orderBy(F.desc_nulls_last("value"), "number")
