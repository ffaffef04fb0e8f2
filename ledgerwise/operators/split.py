"""Temporal split and window checks. Years always come from the filing date itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions import dates, numbers


def with_filing_year(df: DataFrame, column: str = "filing_date") -> DataFrame:
    return df.withColumn("filing_year", F.year(dates.day_first_date(F.col(column))))


def split_by_year(
    df: DataFrame, cutoff: int = fv.HOLDOUT_START_YEAR
) -> tuple[DataFrame, DataFrame]:
    """Development rows before the cutoff year, hold-out rows from it on."""
    year = F.year(dates.day_first_date(F.col("filing_date")))
    return df.where(year < cutoff), df.where(year >= cutoff)


def split_report(df: DataFrame, cutoff: int = fv.HOLDOUT_START_YEAR) -> DataFrame:
    """One row: sizes, ratios, and the rows that no split holds."""
    year = F.year(dates.day_first_date(F.col("filing_date")))
    counts = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(year < cutoff).alias("trainval_records"),
        F.count_if(year >= cutoff).alias("test_records"),
    )
    total = F.col("total_records")
    return counts.select(
        "*",
        (total - F.col("trainval_records") - F.col("test_records")).alias("lost_records"),
        F.bround(numbers.safe_ratio(F.col("trainval_records"), total), 4).alias("trainval_ratio"),
        F.bround(numbers.safe_ratio(F.col("test_records"), total), 4).alias("test_ratio"),
    )


def check_split(df: DataFrame, cutoff: int = fv.HOLDOUT_START_YEAR) -> DataFrame:
    """Fail when rows without a readable date would be lost."""
    report = split_report(df, cutoff).first()
    if report.lost_records:
        raise ValueError(f"split loses {report.lost_records} of {report.total_records} rows")
    return df


def select_window(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows filed in a closed range of years, whatever year is stored with them."""
    return df.where(F.year(dates.day_first_date(F.col("filing_date"))).between(first, last))


def window_report(df: DataFrame, first: int, last: int) -> DataFrame:
    inside = F.coalesce(
        F.year(dates.day_first_date(F.col("filing_date"))).between(first, last), F.lit(False)
    )
    return df.agg(
        F.count_if(inside).alias("selected"), F.count_if(~inside).alias("excluded")
    )


def order_report(
    development: DataFrame, holdout: DataFrame, window: tuple[int, int] = fv.FINAL_WINDOW
) -> DataFrame:
    """One row: is the hold-out strictly later, and does it span its whole window?"""
    date = dates.day_first_date(F.col("filing_date"))
    ends = development.agg(F.max(date).alias("development_end")).select("development_end")
    span = holdout.agg(F.min(date).alias("holdout_start"), F.max(date).alias("holdout_end"))
    return span.withColumn("development_end", ends.scalar()).select(
        "development_end",
        "holdout_start",
        "holdout_end",
        (F.col("development_end") < F.col("holdout_start")).alias("strictly_after"),
        (
            (F.year("holdout_start") == window[0]) & (F.year("holdout_end") == window[1])
        ).alias("spans_window"),
    )


def check_order(development: DataFrame, holdout: DataFrame, window=fv.FINAL_WINDOW) -> None:
    report = order_report(development, holdout, window).first()
    if not report.spans_window:
        raise ValueError(f"hold-out does not span the years {window[0]} to {window[1]}")
    if not report.strictly_after:
        raise ValueError("development and hold-out dates overlap")
