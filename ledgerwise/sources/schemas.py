"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

from ledgerwise import fixed_values as fv


def all_strings(columns) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


FILINGS = all_strings(fv.FILING_COLUMNS)
ENFORCEMENT = all_strings(fv.ENFORCEMENT_COLUMNS)

# The 17 fields of quality-checked filings, in order.
CHECKED_FILINGS = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("sic", T.StringType()),
        T.StructField("incorp_state", T.StringType()),
        T.StructField("filing_type", T.StringType()),
        T.StructField("fye", T.StringType()),
        T.StructField("filing_date", T.StringType()),
        T.StructField("reporting_date", T.TimestampNTZType()),
        T.StructField("url", T.StringType()),
        T.StructField("mda", T.StringType()),
        T.StructField("fraudulent", T.LongType()),
        T.StructField("matched_fraud_start", T.TimestampNTZType()),
        T.StructField("matched_fraud_end", T.TimestampNTZType()),
        T.StructField("certainty_start", T.DoubleType()),
        T.StructField("certainty_end", T.DoubleType()),
    ]
)

LEXICON = T.StructType(
    [T.StructField("CIK", T.StringType()), T.StructField("FILING_DATE", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in fv.LEXICON_COUNTS]
)
