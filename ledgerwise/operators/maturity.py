"""Label maturity: how late enforcement records arrive after the filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwise import fixed_values as fv
from ledgerwise.functions import dates, keys
from ledgerwise.functions.numbers import safe_ratio
from ledgerwise.scale import attach_unique, calendar_year, exact_quantiles

_PERIOD = ["cik_key", "fraud_start_key", "fraud_end_key"]


def key_source_records(raw: DataFrame) -> DataFrame:
    """Typed keys and naive-UTC record time; rows without a full key are dropped."""
    return raw.select(
        "seq",
        keys.company_key(F.col("cik")).alias("cik_key"),
        dates.month_start(F.col("fraud_start")).alias("fraud_start_key"),
        dates.month_end(F.col("fraud_end")).alias("fraud_end_key"),
        dates.utc_timestamp(F.col("date_time")).alias("source_record_timestamp"),
    ).dropna(subset=_PERIOD)


def period_lookup(records: DataFrame) -> DataFrame:
    """First and last record time and record count per (company, start, end)."""
    return records.groupBy(*_PERIOD).agg(
        F.min("source_record_timestamp").alias("source_record_first"),
        F.max("source_record_timestamp").alias("source_record_last"),
        F.count(F.lit(1)).alias("source_record_count"),
    )


def source_metadata(records: DataFrame) -> DataFrame:
    """One row: size, periods and time range of the record source."""
    stamped = F.col("source_record_timestamp")
    per_period = records.groupBy(*_PERIOD).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(stamped).alias("first"),
        F.max(stamped).alias("last"),
        F.count_if(stamped.isNull()).alias("gaps"),
    )
    return per_period.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"),
        F.count(F.lit(1)).alias("unique_periods"),
        F.min("first").alias("timestamp_min"),
        F.max("last").alias("timestamp_max"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("missing_timestamps"),
    )


def link_periods(positives: DataFrame, periods: DataFrame, row_id: str = "seq") -> DataFrame:
    """Left join on the exact three-part key. `periods` must be unique on it.

    The job fails on a repeated period and on a positive without a period.
    """
    unique = periods.groupBy(*_PERIOD).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("source_record_first").alias("source_record_first"),
        F.max("source_record_last").alias("source_record_last"),
        F.max("source_record_count").alias("source_record_count"),
    ).withColumn(
        "source_record_first",
        F.when(F.col("_n") == 1, F.col("source_record_first")).otherwise(
            F.raise_error(F.lit("period keys are not unique")).cast("timestamp_ntz")
        ),
    ).drop("_n")
    keyed = positives.withColumns(
        {"fraud_start_key": F.col("matched_fraud_start"), "fraud_end_key": F.col("matched_fraud_end")}
    )
    linked = attach_unique(keyed, unique, _PERIOD, row_id)
    first = F.coalesce(
        "source_record_first",
        F.raise_error(F.lit("a positive label has no enforcement period")).cast("timestamp_ntz"),
    )
    return linked.withColumn("source_record_first", first).withColumn(
        "lag_days", dates.whole_days_between(F.col("filing_date"), F.col("source_record_first"))
    )


def yearly_delays(
    filings: DataFrame, positives: DataFrame, first_year: int, last_year: int
) -> DataFrame:
    """Per year of the range, also years without rows: filings, labels and their delay."""
    spine = filings.sparkSession.range(first_year, last_year + 1).select(
        F.col("id").cast("int").alias("filing_year")
    )
    per_filing_year = filings.groupBy(calendar_year(F.col("filing_year")).alias("filing_year")).agg(
        F.count(F.lit(1)).alias("filings")
    )
    year_close = dates.year_end(F.col("filing_year"))
    first = F.col("source_record_first")
    per_label_year = positives.groupBy(
        calendar_year(F.col("filing_year")).alias("filing_year")
    ).agg(
        F.count(F.lit(1)).alias("positive_labels"),
        F.count_if(first <= year_close).alias("known_by_year_end"),
        F.count_if(first > year_close).alias("recorded_after_year_end"),
        F.max("lag_days").alias("max_lag_days"),
    )
    quantiles = exact_quantiles(positives, ["filing_year"], "lag_days", (0.5, 0.9))
    joined = (
        spine.join(F.broadcast(per_filing_year), "filing_year", "left")
        .join(F.broadcast(per_label_year), "filing_year", "left")
        .join(F.broadcast(quantiles), "filing_year", "left")
    )

    def or_zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(name)

    return joined.select(
        "filing_year",
        or_zero("filings"),
        or_zero("positive_labels"),
        safe_ratio(F.coalesce("positive_labels", F.lit(0)), F.col("filings")).alias("recorded_rate"),
        or_zero("known_by_year_end"),
        or_zero("recorded_after_year_end"),
        F.element_at("quantiles", 1).alias("median_lag_days"),
        F.element_at("quantiles", 2).alias("p90_lag_days"),
        "max_lag_days",
    )


def delay_statistics(positives: DataFrame, fixed_date: str) -> DataFrame:
    """One row: delay of all labels, and labels recorded after a fixed date."""
    quantiles = exact_quantiles(positives, [], "lag_days", (0.5, 0.9, 0.95))
    totals = positives.agg(
        F.bool_and(F.col("lag_days") > 0).alias("all_after_filing"),
        F.max("lag_days").alias("max_days"),
        F.count_if(F.col("source_record_first") > F.to_date(F.lit(fixed_date))).alias(
            "recorded_after"
        ),
    ).withColumn("_q", quantiles.scalar())
    return totals.select(
        "all_after_filing",
        F.element_at("_q", 1).alias("median_days"),
        F.element_at("_q", 2).alias("p90_days"),
        F.element_at("_q", 3).alias("p95_days"),
        "max_days",
        "recorded_after",
    )


def known_by_year_end(positives: DataFrame, reference: DataFrame, first_year: int) -> DataFrame:
    """Labels known by the end of each year, up to the year of the newest source record.

    `reference` is one row with the newest record time in `timestamp_max`; if that lies before
    `first_year`, there are no rows. Records are counted per year they first appear in; a running
    sum over those years does the rest. A record on 31 December after midnight counts for the next
    year end.
    """
    year_of = F.year("source_record_first")
    late = F.col("source_record_first") > dates.year_end(year_of)
    counted = positives.groupBy(
        calendar_year((year_of + late.cast("int"))).alias("known_year")
    ).agg(F.count(F.lit(1)).alias("n"))
    last = calendar_year(F.year("timestamp_max"))
    spine = reference.where(last >= first_year).select(
        F.explode(F.sequence(F.lit(first_year), last)).alias("year")
    )
    # Years known before the spine starts still count: they fold into its first year.
    folded = counted.groupBy(F.greatest("known_year", F.lit(first_year)).alias("year")).agg(
        F.sum("n").alias("n")
    )
    upto = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spine.join(F.broadcast(folded), "year", "left").select(
        "year", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("labels_known")
    )


def maturity_cutoffs(
    positives: DataFrame,
    reference: DataFrame,
    first_year: int,
    last_year: int,
    probabilities=fv.MATURITY_QUANTILES,
) -> DataFrame:
    """Per quantile: rounded lag, cut-off date, and calendar years fully covered.

    `reference` is one row with the newest record time in `timestamp_max`.
    """
    quantiles = exact_quantiles(positives, [], "lag_days", probabilities)
    names = F.array(*[F.lit(f"p{int(p * 100)}") for p in probabilities])
    exploded = quantiles.select(
        F.explode(F.arrays_zip(names.alias("name"), F.col("quantiles").alias("q"))).alias("z")
    ).select(F.col("z.name").alias("quantile"), F.bround("z.q", 0).cast("int").alias("lag_days"))
    newest = reference.select("timestamp_max").scalar()
    dated = exploded.withColumn("reference_date", newest).withColumn(
        "cutoff", dates.minus_days(F.col("reference_date"), F.col("lag_days"))
    )
    years = F.filter(
        F.sequence(F.lit(first_year), F.lit(last_year)),
        lambda y: F.make_date(y, F.lit(12), F.lit(31)) <= F.col("cutoff"),
    )
    return dated.withColumn("years_covered", F.concat_ws(",", years.cast("array<string>")))


def linked_period_count(linked: DataFrame) -> DataFrame:
    """One row: positives and the distinct periods they link to."""
    per_period = linked.groupBy("cik_key", "matched_fraud_start", "matched_fraud_end").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_period.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("positive_labels"),
        F.count(F.lit(1)).alias("unique_linked_periods"),
    )
