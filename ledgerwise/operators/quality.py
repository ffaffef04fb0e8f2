"""Quality rules on filings: text length, filing type and filing year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions import dates, keys, text
from ledgerwise.operators.contracts import enforce


def has_enough_words(mda: Column, min_words: int = fv.MIN_WORDS) -> Column:
    return text.has_words(mda, min_words)


def is_amended(filing_type: Column) -> Column:
    return F.coalesce(keys.type_code(filing_type).isin(*fv.AMENDED_FILING_TYPES), F.lit(False))


def filed_since(filing_date: Column, first_year: int = fv.FIRST_FILING_YEAR) -> Column:
    """Unreadable dates count as too early."""
    return F.coalesce(dates.multi_format_year(filing_date) >= first_year, F.lit(False))


def quality_flags(
    filings: DataFrame,
    first_year: int = fv.FIRST_FILING_YEAR,
    phrases: tuple[str, ...] = fv.REFERENCE_PHRASES,
) -> DataFrame:
    """One flag per removal reason. Rules are independent, so a row may break several."""
    mda = F.col("mda")
    return (
        filings.withColumn("_short", ~has_enough_words(mda))
        .withColumn(
            "reference_only",
            F.col("_short") & (text.phrase_matches(mda, phrases) >= fv.MIN_REFERENCE_PHRASES),
        )
        .withColumn("short_text", F.col("_short") & ~F.col("reference_only"))
        .withColumn("amended", is_amended(F.col("filing_type")))
        .withColumn("too_early", ~filed_since(F.col("filing_date"), first_year))
        .withColumn("keep", ~F.col("_short") & ~F.col("amended") & ~F.col("too_early"))
        .drop("_short")
    )


def metadata_filter(filings: DataFrame, first_year: int = fv.FIRST_FILING_YEAR) -> DataFrame:
    """The rules that need no text; apply them before the text work where that is possible."""
    return filings.where(
        ~is_amended(F.col("filing_type")) & filed_since(F.col("filing_date"), first_year)
    )


def quality_filter(filings: DataFrame, first_year: int = fv.FIRST_FILING_YEAR) -> DataFrame:
    """Rows that break no rule."""
    return metadata_filter(filings, first_year).where(has_enough_words(F.col("mda")))


def clean_and_filter(filings: DataFrame, first_year: int = fv.FIRST_FILING_YEAR) -> DataFrame:
    """Clean, normalize and filter, on batch or stream; text is touched once per kept row."""
    cleaned = metadata_filter(filings, first_year).withColumn("mda", text.clean_text(F.col("mda")))
    normalized = cleaned.withColumn("mda", text.normalize_text(F.col("mda")))
    return normalized.where(has_enough_words(F.col("mda")))


def quality_report(filings: DataFrame, **limits) -> DataFrame:
    """One row of removal counters; they may add up to more than the removed rows."""
    return quality_flags(filings, **limits).agg(
        F.count(F.lit(1)).alias("input_records"),
        F.count_if("keep").alias("output_records"),
        F.count_if("short_text").alias("short_mda_removed"),
        F.count_if("reference_only").alias("reference_only_removed"),
        F.count_if("amended").alias("amended_removed"),
        F.count_if("too_early").alias("pre1993_removed"),
    )


def check_filtered(filings: DataFrame, first_year: int = fv.FIRST_FILING_YEAR) -> DataFrame:
    """Re-check the output of the filter; fails if a bad row came through."""
    return enforce(filings, output_rules(first_year), "quality-checked filings")


def output_rules(first_year: int = fv.FIRST_FILING_YEAR) -> dict[str, Column]:
    return {
        "short_text": ~has_enough_words(F.col("mda")),
        "amended": is_amended(F.col("filing_type")),
        "too_early": ~filed_since(F.col("filing_date"), first_year),
    }
