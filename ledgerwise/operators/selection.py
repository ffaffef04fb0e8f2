"""Sorting, top-k and candidate selection over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions.numbers import nan_to_null


def sorted_by(df: DataFrame, keys: list[str], descending: bool = False) -> DataFrame:
    """Multi-key sort; a range exchange, not one task."""
    return df.orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys])


def top_rows(df: DataFrame, score: str, row_id: str, k: int = 50) -> DataFrame:
    """The k best rows, ties by row id; each task keeps only its own k."""
    return df.orderBy(F.desc(score), F.asc(row_id)).limit(k)


def top_importances(importances: DataFrame, k: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def mean_absolute_importance(contributions: DataFrame, columns) -> DataFrame:
    """Mean absolute contribution per feature, largest first; one pass, no row explosion."""
    means = contributions.agg(
        *[F.avg(F.abs(nan_to_null(F.col(c).cast("double")))).alias(c) for c in columns]
    )
    long = means.unpivot([], list(columns), "feature", "importance")
    return long.orderBy(F.desc("importance"), "feature")


def top_trials(
    trials: DataFrame, score: str = "value", k: int = fv.CANDIDATE_REVIEW_SIZE
) -> DataFrame:
    """Best finished trials with a finite score, ties by trial number."""
    value = F.col(score)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return trials.where(finite).orderBy(value.desc(), F.col("number").asc()).limit(k)


def is_eligible(skill: Column) -> Column:
    finite = ~F.isnan(skill) & (F.abs(skill) < F.lit(float("inf")))
    return F.coalesce(finite & (skill > 0), F.lit(False))


def select_candidate(candidates: DataFrame) -> DataFrame:
    """One row: the selected trial, or the status that none was eligible.

    Candidates need a positive skill; the best review recall wins, then PR-AUC, then the
    smaller trial number. `max_by` combines on the map side and needs no sort.
    """
    eligible = is_eligible(F.col("skill"))
    rank = F.struct("recall5", "prauc", (-F.col("number")).alias("order"))
    chosen = candidates.agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(eligible).alias("eligible_count"),
        F.max_by(F.struct("number", "recall5", "prauc", "skill"), F.when(eligible, rank)).alias("_s"),
    )
    none = F.col("eligible_count") == 0
    return chosen.select(
        F.when(none, "no_eligible_candidate").otherwise("selected").alias("status"),
        F.lit(fv.SELECTION_RULE).alias("selection_rule"),
        "candidate_count",
        "eligible_count",
        F.when(~none, F.col("_s.number")).alias("selected_trial_number"),
        F.when(~none, F.col("_s.recall5")).alias("recall5"),
        F.when(~none, F.col("_s.prauc")).alias("prauc"),
        F.when(~none, F.col("_s.skill")).alias("skill"),
    )


def winner_row(candidates: DataFrame, number: int, column: str = "number") -> DataFrame:
    """The one candidate row with the selected number; anything but one row fails."""
    found = candidates.where(F.col(column) == number)
    if found.limit(2).count() != 1:
        raise ValueError(f"expected exactly one candidate {number}")
    return found


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones on every run and partitioning: the smallest by a hash."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")).cast("binary"))
    return df.orderBy(mark, F.col(row_id)).limit(n)
