"""Bring filings and enforcement periods into one clean form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions import dates, numbers, text
from ledgerwise.scale import cut_lineage, keep_first, later_copies


def combine(filings: DataFrame, others: DataFrame) -> DataFrame:
    """Union by name with missing columns as NULL and a source tag; no deduplication."""
    return filings.withColumn("source", F.lit("filings")).unionByName(
        others.withColumn("source", F.lit("labels")), allowMissingColumns=True
    )


def ingestion_report(filings: DataFrame, others: DataFrame) -> DataFrame:
    """One row: rows per input and combined, and whether the columns agree."""
    counts = combine(filings, others).agg(
        F.count_if(F.col("source") == "filings").alias("filing_records"),
        F.count_if(F.col("source") == "labels").alias("label_records"),
        F.count(F.lit(1)).alias("combined_records"),
    )
    return counts.withColumn(
        "schema_match", F.lit(set(filings.columns) == set(others.columns))
    )


def prepare_periods(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Raw period strings to typed columns. Unreadable values become NULL or 0."""
    return raw.select(
        seq,
        F.nullif(text.strip(F.col("cik")), F.lit("")).alias("cik"),
        dates.month_start(F.col("fraud_start")).alias("fraud_start"),
        dates.month_end(F.col("fraud_end")).alias("fraud_end"),
        numbers.integer_or_zero(F.col("certainty_start")).alias("certainty_start"),
        numbers.integer_or_zero(F.col("certainty_end")).alias("certainty_end"),
    )


def drop_incomplete(periods: DataFrame) -> DataFrame:
    return periods.dropna(subset=["cik", "fraud_start", "fraud_end"])


def drop_inverted(periods: DataFrame) -> DataFrame:
    return periods.where(F.col("fraud_start") <= F.col("fraud_end"))


def clean_periods(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Complete, non-inverted periods; the first of equal (cik, start, end) stays.

    Dates are parsed once; the typed rows are narrow.
    """
    valid = cut_lineage(drop_inverted(drop_incomplete(prepare_periods(raw, seq))))
    return keep_first(valid, ["cik", "fraud_start", "fraud_end"], seq)


def period_report(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: rows read and written, and why the others were dropped."""
    prepared = prepare_periods(raw, seq)
    complete = (
        F.col("cik").isNotNull() & F.col("fraud_start").isNotNull() & F.col("fraud_end").isNotNull()
    )
    inverted = complete & (F.col("fraud_start") > F.col("fraud_end"))
    kept = F.coalesce(complete & ~inverted, F.lit(False))
    # Rows per period are counted first, so repeated periods combine on the map side.
    per_period = prepared.groupBy(
        F.when(kept, F.struct("cik", "fraud_start", "fraud_end")).alias("period")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("cik").isNull()).alias("missing_cik"),
        F.count_if(F.col("fraud_start").isNull()).alias("missing_start"),
        F.count_if(F.col("fraud_end").isNull()).alias("missing_end"),
        F.count_if(inverted).alias("inverted"),
    )
    written = F.count_if(F.col("period").isNotNull())
    return per_period.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"),
        written.alias("rows_written"),
        F.coalesce(F.sum("missing_cik"), F.lit(0)).alias("missing_cik"),
        F.coalesce(F.sum("missing_start"), F.lit(0)).alias("missing_fraud_start"),
        F.coalesce(F.sum("missing_end"), F.lit(0)).alias("missing_fraud_end"),
        F.coalesce(F.sum("inverted"), F.lit(0)).alias("invalid_periods"),
        (
            F.coalesce(F.sum(F.when(F.col("period").isNotNull(), F.col("n"))), F.lit(0)) - written
        ).alias("duplicate_periods"),
    )


def deduplicate(df: DataFrame, keys=("cik", "filing_date"), seq: str = "seq") -> DataFrame:
    """First row per key in input order; NULL keys are equal, dates compare as written."""
    return keep_first(df, list(keys), seq)


def deduplication_report(df: DataFrame, keys=("cik", "filing_date"), seq: str = "seq") -> DataFrame:
    """One row: input, output and duplicate counts with the percentage."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_records"),
        F.count(F.lit(1)).alias("output_records"),
    )
    duplicates = F.col("input_records") - F.col("output_records")
    return totals.select(
        "input_records",
        "output_records",
        duplicates.alias("duplicate_records"),
        F.bround(
            numbers.ratio_or_zero(duplicates * F.lit(100.0), F.col("input_records")), 4
        ).alias("duplicate_percentage"),
    )


def duplicate_examples(
    df: DataFrame, keys=("cik", "filing_date"), seq: str = "seq", limit: int = 25
) -> DataFrame:
    """The first duplicates in input order, for the report."""
    narrow = df.select(seq, *keys)
    first = later_copies(narrow, list(keys), seq).orderBy(seq).limit(limit)
    return narrow.join(F.broadcast(first), seq, "left_semi")

