"""Audits composed from operators: raw validation, label maturity, hypotheses, evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions import dates, keys
from ledgerwise.operators import hypothesis, maturity, validation
from ledgerwise.scale import cut_lineage, union_all


@dataclass(frozen=True)
class MaturityAudit:
    metadata: DataFrame
    linked: DataFrame
    yearly: DataFrame
    delays: DataFrame
    cutoffs: DataFrame
    known: DataFrame
    coverage: DataFrame


def maturity_audit(
    filings: DataFrame, source: DataFrame, first_year: int, last_year: int, fixed_date: str
) -> MaturityAudit:
    """Delay of the labels of a year window against the raw enforcement records.

    `filings` carry cik, filing_date text, fraudulent and the matched period.
    """
    records = maturity.key_source_records(source)
    periods = maturity.period_lookup(records)
    dated = filings.withColumns(
        {
            "cik_key": keys.company_key(F.col("cik")),
            "filing_date": dates.required_day_first_date(F.col("filing_date")),
        }
    ).withColumn("filing_year", F.year("filing_date"))
    window = dated.where(F.col("filing_year").between(first_year, last_year))
    positives = window.where(F.col("fraudulent") == 1).select(
        "seq", "cik_key", "filing_date", "filing_year", "matched_fraud_start", "matched_fraud_end"
    )
    linked = cut_lineage(maturity.link_periods(positives, periods))
    metadata = cut_lineage(maturity.source_metadata(records))
    return MaturityAudit(
        metadata=metadata,
        linked=linked,
        yearly=maturity.yearly_delays(window, linked, first_year, last_year),
        delays=maturity.delay_statistics(linked, fixed_date),
        cutoffs=maturity.maturity_cutoffs(linked, metadata, first_year, last_year),
        known=maturity.known_by_year_end(linked, metadata, first_year),
        coverage=maturity.linked_period_count(linked),
    )


def hypothesis_suite(df: DataFrame, features, label: str) -> dict[str, DataFrame]:
    """All tables of the hypothesis statistics, from one checkpointed feature table."""
    slim = cut_lineage(df.select(F.col(label), *features))
    return {
        "descriptive": hypothesis.descriptive_statistics(slim, features, label),
        "correlation": hypothesis.correlation_matrix(slim, features),
        "vif": hypothesis.variance_inflation(slim, features),
        "tests": hypothesis.hypothesis_tests(slim, features, label),
        "report": hypothesis.hypothesis_report(slim, features, label),
    }


def validation_suite(
    filings: DataFrame, labels: DataFrame, enforcement: DataFrame, enforcement_fields
) -> dict[str, DataFrame]:
    """Summaries per data set, totals, and how the three sets of companies overlap."""
    checked_rows = validation.enforcement_errors(enforcement, enforcement_fields)
    summaries = [
        validation.dataset_summary(
            validation.filing_errors(filings), "firm_years", fv.REQUIRED_FILING_FIELDS
        ),
        validation.dataset_summary(
            validation.label_errors(labels), "labels", fv.REQUIRED_FILING_FIELDS
        ),
        validation.dataset_summary(checked_rows, "aaer", fv.REQUIRED_ENFORCEMENT_FIELDS),
    ]
    return {
        "summaries": summaries[0].unionByName(summaries[1]).unionByName(summaries[2]),
        "totals": validation.totals_rollup(summaries),
        "overlap": validation.key_overlap(
            {"firm": filings, "label": labels, "aaer": enforcement}, F.col("cik")
        ),
    }


def evidence_snapshot(
    candidate: DataFrame,
    holdout: DataFrame,
    audit: MaturityAudit,
    importances: DataFrame,
    sources: dict[str, DataFrame],
) -> DataFrame:
    """One row: the selected candidate, its hold-out result, label delay, top features and fingerprints.

    All inputs are one-row results, but for the importances, which are cut to ten, and the sources, of which
    only the fingerprint is kept.
    """
    top = importances.orderBy(F.desc("importance"), "feature").limit(10).agg(
        F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False).alias("top")
    )
    prints = union_all(
        [keys.content_fingerprint(df).select(F.lit(name).alias("name"), "fingerprint") for name, df in sources.items()]
    ).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "fingerprint")))).alias("f"))
    found = F.round(F.col("h.recall_at_5_percent") * F.col("h.test_fraud_n")).cast("long")
    final = holdout.select(F.struct(*holdout.columns).alias("h")).select(
        F.struct(
            F.col("h.test_period").alias("period"), F.col("h.test_n").alias("filings"),
            F.col("h.test_fraud_n").alias("fraud_cases"), F.col("h.review_n_at_5_percent").alias("reviewed"),
            found.alias("fraud_found"), F.col("h.recall_at_5_percent").alias("recall_at_5"),
            F.col("h.precision_at_5_percent").alias("precision_at_5"), F.col("h.roc_auc").alias("roc_auc"),
            F.col("h.pr_auc").alias("pr_auc"), F.col("h.brier_skill_score").alias("brier_skill"),
            F.col("h.decision_threshold").alias("threshold"),
            F.col("h.threshold_tuned_on_test").alias("threshold_tuned_on_test"),
        )
    )
    cutoff = audit.cutoffs.where("quantile = 'p90'").agg(F.max("cutoff")).scalar()
    maturity = audit.delays.select(
        F.struct("median_days", "recorded_after", cutoff.alias("p90_cutoff"))
    )
    return candidate.select(
        F.col("number").alias("trial"),
        F.struct(
            "folds", F.col("recall_at_5_percent").alias("recall_at_5"),
            F.col("precision_at_5_percent").alias("precision_at_5"), "pr_auc",
            F.col("brier_skill_score").alias("brier_skill"),
        ).alias("development"),
        final.scalar().alias("final_test"),
        maturity.scalar().alias("label_maturity"),
        top.scalar().alias("top_features"),
        prints.scalar().alias("fingerprints"),
    )
