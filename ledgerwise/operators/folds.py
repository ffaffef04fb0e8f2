"""Walk-forward folds: test on one year, train on all earlier ones.

Row tables are aggregated to one row per calendar year first. Windows over such a year
table are unpartitioned on purpose: it has at most 9,999 rows (see `calendar_year`).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwise import fixed_values as fv
from ledgerwise.functions import dates
from ledgerwise.scale import calendar_year


def _earlier_years():
    return Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)


def _up_to_year():
    return Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def year_table(df: DataFrame, year: str, label: str) -> DataFrame:
    """Rows, positives and prevalence per year."""
    return df.groupBy(calendar_year(F.col(year)).alias("year")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("positives"),
        F.avg(label).alias("prevalence"),
    )


def walk_forward_folds(
    df: DataFrame, year: str, label: str, min_positives: int = fv.MIN_POSITIVES_PER_FOLD
) -> DataFrame:
    """One row per usable test year, with the size of its training set."""
    return (
        year_table(df, year, label)
        .withColumn("train_n", F.sum("rows").over(_earlier_years()))
        .withColumn("train_positives", F.sum("positives").over(_earlier_years()))
        .where((F.col("train_n") > 0) & (F.col("positives") >= min_positives))
        .select(
            F.col("year").alias("test_year"),
            "train_n",
            "train_positives",
            F.col("rows").alias("test_n"),
            F.col("positives").alias("test_positives"),
        )
    )


def fold_order(df: DataFrame, year: str, date: str) -> DataFrame:
    """Per test year: last training date, first test date, and whether the order is strict."""
    spans = df.groupBy(calendar_year(F.col(year)).alias("year")).agg(
        F.min(date).alias("test_start"), F.max(date).alias("_last")
    )
    return (
        spans.withColumn("train_end", F.max("_last").over(_earlier_years()))
        .where("train_end IS NOT NULL")
        .select(
            F.col("year").alias("test_year"),
            "train_end",
            "test_start",
            (F.col("train_end") < F.col("test_start")).alias("strictly_ordered"),
        )
    )


def check_fold_order(df: DataFrame, year: str, date: str) -> DataFrame:
    overlapping = fold_order(df, year, date).where("NOT strictly_ordered").count()
    if overlapping:
        raise ValueError(f"temporal overlap in {overlapping} folds")
    return df


def fold_overlap(df: DataFrame, year: str, date: str) -> DataFrame:
    """Per test year: training rows that are dated on or after the first test row.

    Rows are first counted per (year, day). Each such count is then offered to the later
    years it trains, an equality join on the year; no rows are paired.
    """
    cells = df.groupBy(calendar_year(F.col(year)).alias("year"), F.col(date).alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    starts = df.groupBy(calendar_year(F.col(year)).alias("test_year")).agg(
        F.min(date).alias("test_start")
    )
    last_year = starts.agg(F.max("test_year")).scalar()
    offered = cells.select(
        "day",
        "n",
        F.explode(
            F.when(F.col("year") < last_year, F.sequence(F.col("year") + 1, last_year))
        ).alias("test_year"),
    )
    overlap = F.sum(F.when(F.col("day") >= F.col("test_start"), F.col("n")).otherwise(0))
    # One row per calendar year on the right: bounded, so broadcast.
    return offered.join(F.broadcast(starts), "test_year").groupBy("test_year", "test_start").agg(
        overlap.alias("overlapping_train_rows"), F.sum("n").alias("train_n")
    )


def year_drift(df: DataFrame, stored_year: str = "filing_year", date: str = "filing_date") -> DataFrame:
    """One row: rows whose stored year is not the year of their date."""
    actual = F.year(dates.day_first_date(F.col(date)))
    differs = F.coalesce(actual != F.col(stored_year), F.lit(True))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(actual.isNull()).alias("invalid_filing_dates"),
        F.count_if(differs & actual.isNotNull()).alias("mismatch_count"),
        F.avg((differs & actual.isNotNull()).cast("double")).alias("mismatch_rate"),
    ).withColumn(
        "status",
        F.when((F.col("mismatch_count") == 0) & (F.col("invalid_filing_dates") == 0), "pass")
        .otherwise("fail"),
    )


def calibration_start_year(
    df: DataFrame, year: str, holdout_fraction: float = fv.CALIBRATION_HOLDOUT
) -> DataFrame:
    """One row: the first year of the late part that calibrates a model.

    It is the year at a fixed position of all rows sorted by year, read off the running
    row counts of the year table.
    """
    if not 0 < holdout_fraction < 1:
        raise ValueError("the share of years to calibrate on is not between 0 and 1")
    years = df.groupBy(calendar_year(F.col(year)).alias("year")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    total = F.sum("rows").over(Window.partitionBy())
    position = F.least(
        F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(1 - holdout_fraction))),
        F.col("_total") - 1,
    )
    return (
        years.withColumn("_upto", F.sum("rows").over(_up_to_year()))
        .withColumn("_total", total)
        .withColumn("_position", position)
        .agg(
            F.min(F.when(F.col("_upto") > F.col("_position"), F.col("year"))).alias(
                "calibration_start_year"
            ),
            F.max("_position").alias("split_position"),
            F.max("_total").alias("rows"),
            F.min("year").alias("first_year"),
        )
    )


def split_for_calibration(
    df: DataFrame, year: str, holdout_fraction: float = fv.CALIBRATION_HOLDOUT
) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the model and the later rows that fit its calibration map."""
    found = calibration_start_year(df, year, holdout_fraction).first()
    start = found.calibration_start_year
    if start is None or start <= found.first_year:
        raise ValueError("too few training years to set some aside for calibration")
    return df.where(F.col(year) < start), df.where(F.col(year) >= start)


def split_position(rows: int, holdout_fraction: float = fv.CALIBRATION_HOLDOUT) -> int:
    return min(max(1, math.ceil(rows * (1 - holdout_fraction))), rows - 1)


def late_start(years: list[tuple[int, int]], holdout_fraction: float = fv.CALIBRATION_HOLDOUT) -> int:
    """First year that calibrates, from (year, rows) in order of years; as `calibration_start_year`."""
    position, upto = split_position(sum(n for _, n in years), holdout_fraction), 0
    for year, n in years:
        upto += n
        if upto > position:
            break
    if len(years) < 2 or year <= years[0][0]:
        raise ValueError("too few training years to set some aside for calibration")
    return year


def temporal_audit(
    df: DataFrame,
    stored_year: str = "filing_year",
    date: str = "filing_date",
    label: str = "fraudulent",
    min_positives: int = fv.MIN_POSITIVES_PER_FOLD,
) -> DataFrame:
    """One row: year drift, and overlap over the folds that would be evaluated."""
    dated = df.select(
        F.col(stored_year),
        F.col(date),
        F.col(label),
        dates.day_first_date(F.col(date)).alias("_day"),
    ).withColumn("_year", F.year("_day"))
    usable = walk_forward_folds(dated, "_year", label, min_positives).select("test_year")
    overlap = fold_overlap(dated, "_year", "_day").join(F.broadcast(usable), "test_year")
    folds = overlap.agg(
        F.count(F.lit(1)).alias("evaluated_folds"),
        F.count_if(F.col("overlapping_train_rows") > 0).alias("folds_with_temporal_overlap"),
        F.coalesce(F.max("overlapping_train_rows"), F.lit(0)).alias("max_overlapping_train_rows"),
    )
    drift = year_drift(df, stored_year, date)
    audit = drift.withColumn("_f", folds.select(F.struct(*folds.columns)).scalar())
    clean = (F.col("status") == "pass") & (F.col("folds_with_temporal_overlap") == 0)
    return audit.select(*drift.columns, "_f.*").withColumn(
        "status", F.when(clean, "pass").otherwise("fail")
    )
