"""Reports, summaries, hypothesis statistics and label maturity."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.catalog import views as v
from ledgerwise.catalog.filter_queries import (
    CUTOFF,
    ENFORCEMENT_ERRORS_SQL,
    ENFORCEMENT_FIELDS,
    FILING_ERRORS_SQL,
    FIRST_YEAR,
    LABEL_ERRORS_SQL,
    QUALITY_FLAGS_SQL,
    COMMON_PHRASES,
)
from ledgerwise.catalog.join_queries import (
    KEYED_SQL,
    LABEL_VIEWS,
    LINK_SQL,
    keyed_filings,
    labeled,
    linked_positives,
    prepared_lexicon,
)
from ledgerwise.catalog.registry import query
from ledgerwise.functions import dates
from ledgerwise.operators import (
    folds,
    hypothesis,
    ingest,
    labeling,
    lexicon,
    quality,
    selection,
    split,
    validation,
)
from ledgerwise.operators import maturity as maturity_ops
from ledgerwise.plans import audits

C = F.col
FEATURES = list(fv.LEXICON_DENSITIES)
# Maturity audits look at the filings of these years.
YEARS, FIXED_DATE = (1997, 2000), "1999-12-31"


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


# Label maturity --------------------------------------------------------------------


@query(
    "period_record_times_a1",
    views=LABEL_VIEWS,
    sql=f"""WITH {LINK_SQL} SELECT cik_key, fs AS fraud_start_key, fe AS fraud_end_key, source_record_first,
            source_record_last, source_record_count FROM q""",
)
def _(spark, sf):
    return maturity_ops.period_lookup(maturity_ops.key_source_records(v.period_source(spark, sf)))


@query(
    "record_source_metadata_a2",
    views=LABEL_VIEWS,
    sql=f"""WITH {LINK_SQL} SELECT count(*) AS raw_rows, count(DISTINCT (cik_key, fs, fe)) AS unique_periods,
            min(record_time) AS timestamp_min, max(record_time) AS timestamp_max,
            count(*) FILTER (record_time IS NULL) AS missing_timestamps FROM r""",
)
def _(spark, sf):
    return maturity_ops.source_metadata(maturity_ops.key_source_records(v.period_source(spark, sf)))


@query(
    "yearly_label_delay_a24",
    views=LABEL_VIEWS,
    sql=f"""WITH {LINK_SQL},
      s AS (SELECT CAST(unnest(range({YEARS[0]}, {YEARS[1] + 1})) AS INTEGER) AS filing_year),
      f AS (SELECT CAST(right(filing_date, 4) AS INTEGER) AS filing_year, count(*) AS filings FROM filings GROUP BY 1),
      g AS (SELECT filing_year, count(*) AS positive_labels,
              count(*) FILTER (source_record_first <= make_date(filing_year, 12, 31)) AS known_by_year_end,
              count(*) FILTER (source_record_first > make_date(filing_year, 12, 31)) AS recorded_after_year_end,
              round(quantile_cont(lag_days, 0.5), 6) AS median_lag_days, round(quantile_cont(lag_days, 0.9), 6) AS p90_lag_days,
              max(lag_days) AS max_lag_days FROM linked GROUP BY 1)
      SELECT s.filing_year, coalesce(filings, 0) AS filings, coalesce(positive_labels, 0) AS positive_labels,
        round(coalesce(positive_labels, 0) / filings, 6) AS recorded_rate, coalesce(known_by_year_end, 0) AS known_by_year_end,
        coalesce(recorded_after_year_end, 0) AS recorded_after_year_end, median_lag_days, p90_lag_days, max_lag_days
      FROM s LEFT JOIN f USING (filing_year) LEFT JOIN g USING (filing_year)""",
)
def _(spark, sf):
    filings = split.with_filing_year(v.filings(spark, sf))
    yearly = maturity_ops.yearly_delays(filings, linked_positives(spark, sf), *YEARS)
    return rounded(yearly, 6, "recorded_rate", "median_lag_days", "p90_lag_days")


@query(
    "overall_label_delay_a25",
    views=LABEL_VIEWS,
    sql=f"""WITH {LINK_SQL}
      SELECT bool_and(lag_days > 0) AS all_after_filing, round(quantile_cont(lag_days, 0.5), 6) AS median_days,
        round(quantile_cont(lag_days, 0.9), 6) AS p90_days, round(quantile_cont(lag_days, 0.95), 6) AS p95_days,
        max(lag_days) AS max_days, count(*) FILTER (source_record_first > DATE '{FIXED_DATE}') AS recorded_after
      FROM linked""",
)
def _(spark, sf):
    delays = maturity_ops.delay_statistics(linked_positives(spark, sf), FIXED_DATE)
    return rounded(delays, 6, "median_days", "p90_days", "p95_days")


@query(
    "labels_known_by_year_a26",
    views=LABEL_VIEWS,
    sql=f"""WITH {LINK_SQL},
      y AS (SELECT CAST(unnest(range({YEARS[0]}, (SELECT max(year(record_time)) FROM r) + 1)) AS INTEGER) AS year)
      SELECT year, (SELECT count(*) FROM linked WHERE source_record_first <= make_date(year, 12, 31)) AS labels_known FROM y""",
)
def _(spark, sf):
    records = maturity_ops.key_source_records(v.period_source(spark, sf))
    newest = maturity_ops.source_metadata(records)
    return maturity_ops.known_by_year_end(linked_positives(spark, sf), newest, YEARS[0])


@query(
    "maturity_cutoffs_a27",
    views=LABEL_VIEWS,
    sql=f"""WITH {LINK_SQL},
      m AS (SELECT max(record_time) AS newest FROM r),
      t AS (SELECT unnest(['p90', 'p95']) AS quantile, unnest([quantile_cont(lag_days, 0.9), quantile_cont(lag_days, 0.95)]) AS lag FROM linked),
      c AS (SELECT quantile, CAST(round_even(lag, 0) AS INTEGER) AS lag_days, newest AS reference_date,
              newest - to_days(CAST(round_even(lag, 0) AS INTEGER)) AS cutoff FROM t, m)
      SELECT *, array_to_string(list_filter(range({YEARS[0]}, {YEARS[1] + 1}), lambda y: make_date(y, 12, 31) <= cutoff), ',') AS years_covered FROM c""",
)
def _(spark, sf):
    records = maturity_ops.key_source_records(v.period_source(spark, sf))
    newest = maturity_ops.source_metadata(records)
    return maturity_ops.maturity_cutoffs(linked_positives(spark, sf), newest, *YEARS)


@query(
    "linked_periods_a28",
    views=LABEL_VIEWS,
    sql=f"""WITH {LINK_SQL} SELECT count(*) AS positive_labels,
            count(DISTINCT (cik_key, matched_fraud_start, matched_fraud_end)) AS unique_linked_periods FROM linked""",
)
def _(spark, sf):
    return maturity_ops.linked_period_count(linked_positives(spark, sf))


def maturity(spark, sf):
    filings = labeled(spark, sf)
    return audits.maturity_audit(filings, v.period_source(spark, sf), *YEARS, FIXED_DATE)


@query(
    "maturity_audit_x5",
    views=LABEL_VIEWS,
    sql=f"""WITH {LINK_SQL},
      w AS (SELECT * FROM linked WHERE filing_year BETWEEN {YEARS[0]} AND {YEARS[1]})
      SELECT (SELECT count(DISTINCT (cik_key, fs, fe)) FROM r) AS unique_periods, count(*) AS positive_labels,
        count(DISTINCT (cik_key, matched_fraud_start, matched_fraud_end)) AS unique_linked_periods,
        round(quantile_cont(lag_days, 0.5), 6) AS median_days, max(lag_days) AS max_days FROM w""",
)
def _(spark, sf):
    audit = maturity(spark, sf)
    return rounded(
        audit.coverage.select(
            audit.metadata.select("unique_periods").scalar().alias("unique_periods"),
            "positive_labels",
            "unique_linked_periods",
            audit.delays.select("median_days").scalar().alias("median_days"),
            audit.delays.select("max_days").scalar().alias("max_days"),
        ),
        6,
        "median_days",
    )


# Validation and stage reports ------------------------------------------------------


def _summary_sql(dataset: str, errors_sql: str, columns: str, required) -> str:
    def has(error):
        return f"count(*) FILTER (list_contains(string_split(errors, ','), '{error}'))"

    empty = f"{has('empty_record')} + {has('empty_row')}"
    missing = " || ".join(
        [f"'\"missing_{f}\":' || {has('missing_' + f)}" + (" || ','" if i < len(required) - 1 else "")
         for i, f in enumerate(sorted(required))]
    ).replace('"missing_', '"')
    malformed = " + ".join(
        has(e) for e in (
            "malformed_filing_date", "malformed_reporting_date", "malformed_fraud_start", "malformed_fraud_end"
        )
    )
    return f"""SELECT '{dataset}' AS dataset, count(*) AS total_records, count(*) FILTER (errors = '') AS valid_records,
        count(*) FILTER (errors <> '') AS invalid_records, {empty} AS empty_records,
        {has('duplicate_filing')} + {has('duplicate_identifier')} AS duplicate_identifiers,
        {has('duplicate_id')} AS duplicate_ids, {has('duplicate_filing')} AS duplicate_filings,
        {has('invalid_filing_type')} AS invalid_filing_types, {malformed} AS malformed_dates,
        {has('malformed_row')} AS malformed_rows, '{{' || {missing} || '}}' AS missing_values,
        '{columns}' AS schema_fields, '' AS required_missing
      FROM ({errors_sql})"""


_FILING_COLUMNS = ",".join(sorted(fv.FILING_COLUMNS))
_SUMMARIES = {
    "firm_years": _summary_sql("firm_years", FILING_ERRORS_SQL, _FILING_COLUMNS, fv.REQUIRED_FILING_FIELDS),
    "labels": _summary_sql("labels", LABEL_ERRORS_SQL, _FILING_COLUMNS, fv.REQUIRED_FILING_FIELDS),
    "aaer": _summary_sql(
        "aaer", ENFORCEMENT_ERRORS_SQL, ",".join(sorted(ENFORCEMENT_FIELDS)), fv.REQUIRED_ENFORCEMENT_FIELDS
    ),
}
_ALL_SUMMARIES = " UNION ALL ".join(f"({s})" for s in _SUMMARIES.values())


def _suite(spark, sf):
    raw = v.raw_filings(spark, sf)
    return audits.validation_suite(raw, raw, v.raw_enforcement(spark, sf), ENFORCEMENT_FIELDS)


@query("validation_summary_a3", views="raw_filings", sql=_SUMMARIES["firm_years"])
def _(spark, sf):
    checked = validation.filing_errors(v.raw_filings(spark, sf))
    return validation.dataset_summary(checked, "firm_years", fv.REQUIRED_FILING_FIELDS)


@query(
    "validation_totals_a4",
    views="raw_filings raw_enforcement",
    sql=f"""SELECT coalesce(dataset, 'all') AS dataset, CAST(sum(total_records) AS BIGINT) AS total_records,
            CAST(sum(valid_records) AS BIGINT) AS valid_records, CAST(sum(invalid_records) AS BIGINT) AS invalid_records
            FROM ({_ALL_SUMMARIES}) GROUP BY ROLLUP (dataset)""",
)
def _(spark, sf):
    return _suite(spark, sf)["totals"]


@query("raw_validation_x7", views="raw_filings raw_enforcement", sql=_ALL_SUMMARIES)
def _(spark, sf):
    return _suite(spark, sf)["summaries"]


@query(
    "quality_report_a5",
    views="text_filings",
    sql=f"""SELECT count(*) AS input_records, count(*) FILTER (keep) AS output_records,
            count(*) FILTER (short_text) AS short_mda_removed, count(*) FILTER (reference_only) AS reference_only_removed,
            count(*) FILTER (amended) AS amended_removed, count(*) FILTER (too_early) AS pre1993_removed
            FROM ({QUALITY_FLAGS_SQL})""",
)
def _(spark, sf):
    return quality.quality_report(
        v.text_filings(spark, sf), first_year=FIRST_YEAR, phrases=COMMON_PHRASES
    )


_EVENT_KEYS = ["user_id", "event_type", "day"]


def event_rows(spark, sf):
    return v.table(spark, sf, "events").select(
        C("event_id").alias("seq"), "user_id", "event_type", F.to_date("ts").alias("day"), "value"
    )


@query(
    "deduplication_report_a6",
    sql="""WITH g AS (SELECT count(*) AS n FROM events GROUP BY user_id, event_type, CAST(ts AS DATE))
           SELECT CAST(sum(n) AS BIGINT) AS input_records, count(*) AS output_records,
           CAST(sum(n) - count(*) AS BIGINT) AS duplicate_records,
           round_even((sum(n) - count(*)) * 100.0::DOUBLE / sum(n), 4) AS duplicate_percentage FROM g""",
)
def _(spark, sf):
    return ingest.deduplication_report(event_rows(spark, sf), _EVENT_KEYS)


@query(
    "duplicate_examples_a6",
    sql="""SELECT event_id AS seq, user_id, event_type, CAST(ts AS DATE) AS day FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) > 1
           ORDER BY event_id LIMIT 25""",
)
def _(spark, sf):
    return ingest.duplicate_examples(event_rows(spark, sf), _EVENT_KEYS)


@query(
    "ingestion_report_a7",
    views="filings filings_b",
    sql="""SELECT (SELECT count(*) FROM filings) AS filing_records, (SELECT count(*) FROM filings_b) AS label_records,
           (SELECT count(*) FROM filings) + (SELECT count(*) FROM filings_b) AS combined_records, false AS schema_match""",
)
def _(spark, sf):
    return ingest.ingestion_report(v.filings(spark, sf), v.filings_b(spark, sf))


@query(
    "period_report_a8",
    views="period_source typed_periods clean_periods",
    sql="""SELECT count(*) AS rows_read, (SELECT count(*) FROM clean_periods) AS rows_written,
           count(*) FILTER (cik IS NULL) AS missing_cik, count(*) FILTER (fraud_start IS NULL) AS missing_fraud_start,
           count(*) FILTER (fraud_end IS NULL) AS missing_fraud_end, count(*) FILTER (fraud_start > fraud_end) AS invalid_periods,
           count(*) FILTER (fraud_start <= fraud_end) - (SELECT count(*) FROM clean_periods) AS duplicate_periods
           FROM typed_periods""",
)
def _(spark, sf):
    return ingest.period_report(v.period_source(spark, sf))


@query(
    "label_report_a9",
    views=LABEL_VIEWS,
    sql="""SELECT count(*) AS total_firm_years, CAST(sum(fraudulent) AS BIGINT) AS fraudulent_count,
           count(*) FILTER (fraudulent = 0) AS clean_count, round_even(avg(fraudulent), 6) AS fraud_rate,
           count(*) FILTER (reporting_date IS NULL) AS missing_reporting_date,
           count(*) FILTER (multiple_matches) AS multiple_matches,
           (SELECT count(DISTINCT cik) FROM clean_periods WHERE cik IN (SELECT cik FROM labeled)) AS matched_ciks,
           (SELECT count(DISTINCT cik) FROM clean_periods WHERE cik NOT IN (SELECT cik FROM labeled)) AS unmatched_ciks
           FROM labeled""",
)
def _(spark, sf):
    return labeling.label_report(labeled(spark, sf), v.clean_periods(spark, sf))


@query(
    "split_report_a10",
    views="filings",
    sql=f"""WITH y AS (SELECT CAST(right(filing_date, 4) AS INTEGER) AS y FROM filings)
            SELECT count(*) AS total_records, count(*) FILTER (y < {CUTOFF}) AS trainval_records,
            count(*) FILTER (y >= {CUTOFF}) AS test_records, 0::BIGINT AS lost_records,
            round_even(count(*) FILTER (y < {CUTOFF}) / count(*), 4) AS trainval_ratio,
            round_even(count(*) FILTER (y >= {CUTOFF}) / count(*), 4) AS test_ratio FROM y""",
)
def _(spark, sf):
    return split.split_report(v.filings(spark, sf), CUTOFF)


@query(
    "match_rates_a11",
    views="filings lexicon_source",
    sql=f"""WITH {KEYED_SQL},
            a AS (SELECT CASE WHEN filing_year < {CUTOFF} THEN 'trainval' ELSE 'test' END AS dataset, u.key IS NOT NULL AS hit
                  FROM k LEFT JOIN u ON k.cik = u.key AND k.reporting_year = u.yr)
            SELECT dataset, count(*) AS records, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) AS unmatched,
                   round_even(avg(CAST(hit AS DOUBLE)), 4) AS match_rate FROM a GROUP BY dataset""",
)
def _(spark, sf):
    filings = keyed_filings(spark, sf).withColumn(
        "dataset", F.when(C("filing_year") < CUTOFF, "trainval").otherwise("test")
    )
    lookup = lexicon.build_lookup(prepared_lexicon(spark, sf), lexicon.required_keys([filings]))
    return lexicon.match_rate_report(lexicon.attach_lexicon(filings, lookup))


# Hypothesis statistics -------------------------------------------------------------

_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, fraudulent AS label, {f} AS value FROM density_rows" for f in FEATURES
)
DENSITY_VIEWS = "lexicon_source density_rows"


@query(
    "class_descriptives_a12",
    views=DENSITY_VIEWS,
    sql=f"""SELECT feature, label, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std,
            round(median(value), 9) AS median, round(min(value), 9) AS min, round(max(value), 9) AS max
            FROM ({_LONG}) GROUP BY feature, label""",
)
def _(spark, sf):
    stats = hypothesis.descriptive_statistics(v.density_rows(spark, sf), FEATURES, "fraudulent")
    return rounded(stats, 9, "mean", "std", "median", "min", "max").select(
        "feature", "label", "n", "mean", "std", "median", "min", "max"
    )


_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM density_rows"
    for a, b in product(FEATURES, FEATURES)
)


@query("correlation_matrix_a13", views=DENSITY_VIEWS, sql=_CORR)
def _(spark, sf):
    return rounded(
        hypothesis.correlation_matrix(v.density_rows(spark, sf), FEATURES), 6, "correlation"
    )


@query(
    "variance_inflation_a14",
    views=DENSITY_VIEWS,
    sql="""WITH r AS (SELECT corr(negative_density, positive_density) AS ab, corr(negative_density, litigious_density) AS ac,
             corr(positive_density, litigious_density) AS bc FROM density_rows
             WHERE negative_density IS NOT NULL AND positive_density IS NOT NULL AND litigious_density IS NOT NULL),
           d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
           SELECT 'negative_density' AS feature, round((1 - bc * bc) / det, 6) AS vif FROM d
           UNION ALL SELECT 'positive_density', round((1 - ac * ac) / det, 6) FROM d
           UNION ALL SELECT 'litigious_density', round((1 - ab * ab) / det, 6) FROM d""",
)
def _(spark, sf):
    names = ["negative_density", "positive_density", "litigious_density"]
    return rounded(hypothesis.variance_inflation(v.density_rows(spark, sf), names), 6, "vif")


# A closed form for seven features would be no twin to read; a test holds it against regressions.
@query("variance_inflation_all_a14")
def _(spark, sf):
    vif = hypothesis.variance_inflation(v.density_rows(spark, sf), fv.LEXICON_DENSITIES)
    return rounded(vif, 6, "vif")


_CONTRAST = f"""
  m AS (SELECT feature, count(value) FILTER (label = 1) AS n1, count(value) FILTER (label = 0) AS n0,
        avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label = 0) AS m0,
        var_samp(value) FILTER (label = 1) AS v1, var_samp(value) FILTER (label = 0) AS v0 FROM ({_LONG}) GROUP BY feature),
  t AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d,
        (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t_stat,
        pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM m)"""


def _contrast(spark, sf):
    return hypothesis.class_contrast(v.density_rows(spark, sf), FEATURES, "fraudulent")


@query(
    "cohens_d_a15",
    views=DENSITY_VIEWS,
    sql=f"WITH {_CONTRAST} SELECT feature, n1 AS fraud_n, n0 AS clean_n, round(d, 6) AS cohens_d FROM t",
)
def _(spark, sf):
    return rounded(_contrast(spark, sf), 6, "cohens_d").select(
        "feature", "fraud_n", "clean_n", "cohens_d"
    )


@query(
    "percent_difference_a16",
    views=DENSITY_VIEWS,
    sql=f"WITH {_CONTRAST} SELECT feature, round((m1 - m0) / nullif(m0, 0) * 100, 6) AS diff_pct FROM t",
)
def _(spark, sf):
    return rounded(_contrast(spark, sf), 6, "diff_pct").select("feature", "diff_pct")


@query(
    "welch_t_a17",
    views=DENSITY_VIEWS,
    sql=f"""WITH {_CONTRAST} SELECT feature, round(m1, 9) AS mean_fraud, round(m0, 9) AS mean_clean,
            round(t_stat, 6) AS t_stat, round(df, 4) AS df FROM t""",
)
def _(spark, sf):
    contrast = rounded(_contrast(spark, sf), 9, "mean_fraud", "mean_clean")
    return rounded(contrast, 6, "t_stat").select(
        "feature", "mean_fraud", "mean_clean", "t_stat", F.round("df", 4).alias("df")
    )


@query("hypothesis_tests_a17")
def _(spark, sf):
    tests = hypothesis.hypothesis_tests(v.density_rows(spark, sf), FEATURES, "fraudulent")
    return hypothesis.round_results(tests)


@query(
    "effect_bands_a18",
    sql="""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_quantity - 25) / 25 < 0.2 THEN 'Negligible'
           WHEN abs(l_quantity - 25) / 25 < 0.5 THEN 'Small' WHEN abs(l_quantity - 25) / 25 < 0.8 THEN 'Medium'
           ELSE 'Large' END AS effect FROM lineitem""",
)
def _(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        hypothesis.effect_band((C("l_quantity") - 25) / 25).alias("effect"),
    )


@query("hypothesis_report_a19")
def _(spark, sf):
    return hypothesis.hypothesis_report(v.density_rows(spark, sf), FEATURES, "fraudulent")


@query("hypothesis_suite_x6")
def _(spark, sf):
    suite = audits.hypothesis_suite(v.density_rows(spark, sf), FEATURES, "fraudulent")
    tests = suite["tests"].select("feature", "cohens_d", "effect", "t_stat", "p_value", "p_holm")
    return tests.join(F.broadcast(suite["vif"]), "feature").join(
        F.broadcast(suite["descriptive"].where("label = 1").select("feature", "median")), "feature"
    )


# Year tables and importances -------------------------------------------------------


@query(
    "prevalence_by_year_a20",
    views="predictions",
    sql="""SELECT test_year AS year, count(*) AS rows, CAST(sum(true_label) AS BIGINT) AS positives,
           round(avg(true_label), 9) AS prevalence FROM predictions GROUP BY test_year""",
)
def _(spark, sf):
    return rounded(
        folds.year_table(v.predictions(spark, sf), "test_year", "true_label"), 9, "prevalence"
    )


@query(
    "year_drift_a31",
    views="filings",
    sql="""WITH d AS (SELECT CAST(right(filing_date, 4) AS INTEGER) <> CAST(right(reporting_date, 4) AS INTEGER) AS off FROM filings)
           SELECT count(*) AS rows, 0::BIGINT AS invalid_filing_dates, count(*) FILTER (off) AS mismatch_count,
           round(avg(CAST(off AS DOUBLE)), 9) AS mismatch_rate, CASE WHEN count(*) FILTER (off) = 0 THEN 'pass' ELSE 'fail' END AS status FROM d""",
)
def _(spark, sf):
    rows = v.filings(spark, sf).withColumn(
        "stored_year", F.year(dates.day_first_date(C("reporting_date")))
    )
    return rounded(folds.year_drift(rows, "stored_year"), 9, "mismatch_rate")


@query(
    "temporal_audit_x8",
    views="filings",
    sql="""WITH d AS (SELECT CAST(right(filing_date, 4) AS INTEGER) AS y, CAST(right(reporting_date, 4) AS INTEGER) AS stored,
             CAST(seq % 17 = 0 AS INTEGER) AS lab, CAST(strptime(filing_date, '%d-%m-%Y') AS DATE) AS day FROM filings),
           s AS (SELECT y, min(day) AS first_day FROM d GROUP BY y HAVING sum(lab) >= 5),
           o AS (SELECT s.y, count(*) FILTER (d.day >= s.first_day) AS n FROM s JOIN d ON d.y < s.y GROUP BY s.y)
           SELECT (SELECT count(*) FROM d) AS rows, 0::BIGINT AS invalid_filing_dates,
             (SELECT count(*) FROM d WHERE y <> stored) AS mismatch_count,
             round((SELECT avg(CAST(y <> stored AS DOUBLE)) FROM d), 9) AS mismatch_rate, 'fail' AS status,
             count(*) AS evaluated_folds, count(*) FILTER (n > 0) AS folds_with_temporal_overlap,
             max(n) AS max_overlapping_train_rows FROM o""",
)
def _(spark, sf):
    rows = v.filings(spark, sf).select(
        F.year(dates.day_first_date(C("reporting_date"))).alias("filing_year"),
        "filing_date",
        (C("seq") % 17 == 0).cast("int").alias("fraudulent"),
    )
    return rounded(folds.temporal_audit(rows, min_positives=5), 9, "mismatch_rate")


@query(
    "importance_ranking_a32",
    views=DENSITY_VIEWS,
    sql="SELECT feature, round(avg(abs(value)), 9) AS importance FROM ({}) GROUP BY feature".format(_LONG),
)
def _(spark, sf):
    return rounded(
        selection.mean_absolute_importance(v.density_rows(spark, sf), FEATURES), 9, "importance"
    )


@query(
    "distinct_years_a33",
    views="predictions",
    sql="SELECT DISTINCT test_year, true_label FROM predictions",
)
def _(spark, sf):
    return v.predictions(spark, sf).select("test_year", "true_label").distinct()
