"""Attach lexicon counts by company and year, and turn them into densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions import dates, keys, numbers
from ledgerwise.scale import BROADCAST_ROWS, attach_unique, checked_broadcast, union_all


def prepare_lexicon(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Keyed by company and filing year; rows without a readable date are dropped."""
    return raw.select(
        seq,
        keys.company_key_digits(F.col("CIK")).alias("cik"),
        dates.compact_date_year(F.col("FILING_DATE")).alias("lexicon_year"),
        *fv.LEXICON_COUNTS,
    ).dropna(subset=["lexicon_year"])


def required_keys(splits: list[DataFrame], year: str = "reporting_year") -> DataFrame:
    """Distinct (cik, year) of all splits.

    The left year is the reporting year although the lexicon side is keyed by filing
    year; the column is a parameter.
    """
    return union_all([df.select("cik", F.col(year).alias("lexicon_year")) for df in splits]).distinct()


def first_entries(lexicon: DataFrame, seq: str = "seq") -> DataFrame:
    """First entry per (cik, year) with the number of entries; no rows of a key meet."""
    return lexicon.groupBy("cik", "lexicon_year").agg(
        *[F.min_by(name, seq).alias(name) for name in fv.LEXICON_COUNTS],
        F.count(F.lit(1)).alias("entries"),
    )


def build_lookup(lexicon: DataFrame, needed: DataFrame, seq: str = "seq") -> DataFrame:
    """First entries of the needed keys.

    Where the keys are few enough to be broadcast, entries of other keys are dropped before they are
    grouped; otherwise entries are grouped first, so that a hot key is one row when it meets the keys.
    """
    keys = ["cik", "lexicon_year"]
    needed, small = checked_broadcast(needed.select(*keys))
    if small:
        return first_entries(lexicon.join(needed, keys, "left_semi"), seq)
    return first_entries(lexicon, seq).join(needed, keys, "left_semi")


def lookup_report(lookup: DataFrame) -> DataFrame:
    return lookup.agg(
        F.count(F.lit(1)).alias("lookup_entries"),
        F.coalesce(F.sum(F.col("entries") - 1), F.lit(0)).alias("duplicate_keys"),
    )


def attach_lexicon(
    filings: DataFrame,
    lookup: DataFrame,
    row_id: str = "seq",
    year: str = "reporting_year",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join with the lookup; unmatched rows keep NULL counts and densities."""
    right = lookup.drop("entries").withColumn("lexicon_matched", F.lit(True))
    joined = attach_unique(
        filings.withColumn("lexicon_year", F.col(year)),
        right,
        ["cik", "lexicon_year"],
        row_id,
        max_rows=max_rows,
    ).drop("lexicon_year")
    matched = joined.withColumn("lexicon_matched", F.coalesce("lexicon_matched", F.lit(False)))
    return add_densities(matched)


def add_densities(df: DataFrame) -> DataFrame:
    """Counts over the word count; NULL where there are no words."""
    return df.withColumns(
        {
            density: numbers.safe_ratio(F.col(count), F.col("N_Words"))
            for density, count in fv.LEXICON_DENSITIES.items()
        }
    )


def match_rate_report(attached: DataFrame, dataset: str = "dataset") -> DataFrame:
    return attached.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("lexicon_matched").alias("matched"),
        F.count_if(~F.col("lexicon_matched")).alias("unmatched"),
        F.bround(F.avg(F.col("lexicon_matched").cast("double")), 4).alias("match_rate"),
    )
