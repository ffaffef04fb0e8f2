"""Calibration maps fitted on histograms of scores, without a task or driver that holds all scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.scale import _count_below, _slices, cut_lineage

# Stacks of blocks that one task merges at a time.
MERGED = 16
_BLOCK = "slice int, low double, high double, weight double, total double"


def score_counts(scores: DataFrame, label: str = "label") -> DataFrame:
    """Rows `n` and positives `pos` of each distinct score; null and NaN are left out."""
    number = F.col("score").cast("double")
    return cut_lineage(
        scores.where(number.isNotNull() & ~F.isnan(number))
        .groupBy(number.alias("score"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).cast("double").alias("pos"))
    )


# Sigmoid


@dataclass
class _Map:
    """A map that is being fitted: the best one so far, the step from it that is tried, and targets."""

    slope: float
    intercept: float
    high: float
    low: float
    step: tuple[float, float] = (0.0, 0.0)
    loss: float = math.inf
    done: bool = False

    @property
    def tried(self) -> tuple[float, float]:
        return self.slope + self.step[0], self.intercept + self.step[1]

    def judge(self, sums, penalty: float, tolerance: float) -> None:
        """Take or halve the step that was tried, from the sums at its end."""
        slope, intercept = self.tried
        loss = sums.loss + penalty / 2 * slope**2
        if loss <= self.loss + 1e-12 * abs(loss):
            self.slope, self.intercept, self.loss = slope, intercept, loss
            matrix = np.array([[sums.h11 + penalty, sums.h12], [sums.h12, sums.h22]]) + 1e-12 * np.eye(2)
            step = -np.linalg.solve(matrix, np.array([sums.g1 + penalty * slope, sums.g2]))
            self.step = float(step[0]), float(step[1])
        else:
            self.step = self.step[0] / 2, self.step[1] / 2
        self.done = max(map(abs, self.step)) < tolerance * (1 + abs(self.slope) + abs(self.intercept))


def fit_sigmoids(
    counts: DataFrame, key: str, smoothed: bool = True, penalty: float = 0.0, tolerance: float = 1e-10
) -> dict[int, tuple[float, float]]:
    """Slope and intercept of the logistic map of a score for each key, all by the same Newton steps.

    `counts` holds key, score, n and pos; there are few keys (folds). A step of all maps is one aggregation.
    With smoothed targets a positive row counts as (p + 1) / (p + 2) of p positives and a negative one as
    1 / (q + 2) of q negatives, so that scores which separate the classes have a finite map.
    """
    maps: dict[int, _Map] = {}
    for row in counts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect():
        pos, neg = row.pos, row.n - row.pos
        high, low = ((pos + 1) / (pos + 2), 1 / (neg + 2)) if smoothed else (1.0, 0.0)
        maps[row[key]] = _Map(0.0, math.log((pos + 1) / (neg + 1)), high, low)
    target = F.col("pos") * F.col("_high") + (F.col("n") - F.col("pos")) * F.col("_low")
    margin = F.col("score") * F.col("_slope") + F.col("_intercept")
    p = 1 / (1 + F.exp(-margin))
    gap, spread = F.col("n") * p - target, F.col("n") * p * (1 - p)
    # log(1 + exp(m)) without overflow.
    loss = F.col("n") * (F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))) - target * margin
    kind = dict(counts.dtypes)[key]
    for _ in range(200):
        rows = [(k, *m.tried, m.high, m.low) for k, m in maps.items() if not m.done]
        if not rows:
            break
        tried = counts.sparkSession.createDataFrame(
            rows, f"{key} {kind}, _slope double, _intercept double, _high double, _low double"
        )
        sums = counts.join(F.broadcast(tried), key).groupBy(key).agg(
            F.sum(loss).alias("loss"), F.sum(gap * F.col("score")).alias("g1"), F.sum(gap).alias("g2"),
            F.sum(spread * F.col("score") * F.col("score")).alias("h11"),
            F.sum(spread * F.col("score")).alias("h12"), F.sum(spread).alias("h22"),
        )
        for row in sums.collect():
            maps[row[key]].judge(row, penalty, tolerance)
    return {k: (m.slope, m.intercept) for k, m in maps.items()}


def fit_sigmoid(counts: DataFrame, smoothed: bool = True) -> tuple[float, float]:
    """Slope and intercept for one table of score, n and pos."""
    return fit_sigmoids(counts.withColumn("_key", F.lit(0)), "_key", smoothed)[0]


# Isotonic


def pooled(low, high, weight, total) -> list[tuple[float, float, float, float]]:
    """Blocks in order of score, neighbours pooled until their means rise."""
    stack: list[tuple[float, float, float, float]] = []
    for block in zip(low, high, weight, total):
        while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
            last = stack.pop()
            block = (last[0], block[1], last[2] + block[2], last[3] + block[3])
        stack.append(block)
    return stack


def _pool(table: pa.Table) -> pa.Table:
    table = table.sort_by("low")
    columns = [table.column(n).to_pylist() for n in ("low", "high", "weight", "total")]
    blocks = pooled(*columns)
    names = ("low", "high", "weight", "total")
    return pa.table(
        {"slice": pa.array([table.column("slice")[0].as_py()] * len(blocks), pa.int32())}
        | {n: pa.array([b[k] for b in blocks], pa.float64()) for k, n in enumerate(names)}
    )


def isotonic_blocks(counts: DataFrame) -> DataFrame:
    """The rising step function nearest to the labels: low, high, weight, total of each block, by score.

    Slices at approximate quantiles of the scores are pooled on their own, and neighbouring slices merged,
    some at a time, until one is left. Pooling keeps only rising means: of n rows with labels 0 and 1 there
    are at most about n^(2/3) different ones, and a few dozen in practice, so the last merges are small.
    """
    slices = _slices(counts.sparkSession)
    cuts = [k / slices for k in range(1, slices)]
    bounds = counts.agg(F.percentile_approx("score", cuts, 10 * slices).alias("b")).scalar()
    parts = counts.withColumn("_bounds", bounds).select(
        _count_below(F.col("_bounds"), F.col("score"), slices).cast("int").alias("slice"),
        F.col("score").alias("low"), F.col("score").alias("high"),
        F.col("n").cast("double").alias("weight"), F.col("pos").alias("total"),
    )
    blocks = cut_lineage(parts.groupBy("slice").applyInArrow(_pool, _BLOCK))
    while slices > 1:
        slices = -(-slices // MERGED)
        merged = blocks.withColumn("slice", F.floor(F.col("slice") / MERGED).cast("int"))
        blocks = cut_lineage(merged.groupBy("slice").applyInArrow(_pool, _BLOCK))
    return blocks.drop("slice")


def isotonic_knots(counts: DataFrame) -> DataFrame:
    """Ends of the blocks with their means: score, value. Between knots a map is linear."""
    mean = F.col("total") / F.col("weight")
    blocks = isotonic_blocks(counts)
    return blocks.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("score"), mean.alias("value"))


def _interpolated(xs: np.ndarray, ys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column("score").cast(pa.float64()).to_numpy(zero_copy_only=False)
            yield batch.append_column("calibrated", pa.array(np.interp(score, xs, ys)))

    return run


def isotonic_map(counts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Add `calibrated` to a table with `score`: linear between the knots, flat beyond them."""
    knots = isotonic_knots(counts).orderBy("score").collect()
    xs, ys = np.array([k.score for k in knots]), np.array([k.value for k in knots])

    def add(df: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, ("calibrated", "double")])
        return df.mapInArrow(_interpolated(xs, ys), schema)

    return add


def sigmoid_map(counts: DataFrame, smoothed: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Add `calibrated` to a table with `score`."""
    slope, intercept = fit_sigmoid(counts, smoothed)
    return lambda df: df.withColumn("calibrated", 1 / (1 + F.exp(-(F.col("score") * slope + intercept))))
