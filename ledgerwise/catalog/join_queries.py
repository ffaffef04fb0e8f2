"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise.catalog import views as v
from ledgerwise.catalog.registry import query
from ledgerwise.functions import dates, keys
from ledgerwise.operators import (
    contracts,
    folds,
    ingest,
    labeling,
    lexicon,
    maturity,
    selection,
    validation,
)
from ledgerwise.scale import calendar_year, cut_lineage, written

C = F.col
LABEL_VIEWS = "filings typed_filings period_source typed_periods clean_periods matches labeled"


def labeled(spark, sf):
    filings = labeling.prepare_filings(v.filings(spark, sf))
    return labeling.label_filings(filings, v.clean_periods(spark, sf))


@query(
    "interval_label_j1",
    views=LABEL_VIEWS,
    sql="""SELECT seq, cik, fraudulent, matched_fraud_start, matched_fraud_end, certainty_start, certainty_end
           FROM labeled""",
)
def _(spark, sf):
    return labeled(spark, sf).select(
        "seq", "cik", "fraudulent", "matched_fraud_start", "matched_fraud_end",
        "certainty_start", "certainty_end",
    )


@query(
    "multiple_matches_j2",
    views=LABEL_VIEWS,
    sql="SELECT count(*) FILTER (multiple_matches) AS multiple_matches, count(*) AS filings FROM labeled",
)
def _(spark, sf):
    return labeled(spark, sf).agg(
        F.count_if("multiple_matches").alias("multiple_matches"),
        F.count(F.lit(1)).alias("filings"),
    )


@query(
    "company_overlap_j3",
    views="filings_b period_source typed_periods clean_periods",
    sql=f"""WITH f AS (SELECT DISTINCT {v.COMPANY_KEY_SQL.format('cik')} AS cik FROM filings_b),
            p AS (SELECT DISTINCT cik FROM clean_periods)
            SELECT count(*) FILTER (cik IN (SELECT cik FROM f)) AS matched_ciks,
                   count(*) FILTER (cik NOT IN (SELECT cik FROM f)) AS unmatched_ciks FROM p""",
)
def _(spark, sf):
    firms = v.filings_b(spark, sf).withColumn("cik", keys.company_key(C("cik")))
    return labeling.company_overlap(firms, v.clean_periods(spark, sf))


def keyed_filings(spark, sf):
    return v.filings(spark, sf).select(
        "seq",
        keys.company_key_digits(C("cik")).alias("cik"),
        F.year(dates.day_first_date(C("filing_date"))).alias("filing_year"),
        F.year(dates.day_first_date(C("reporting_date"))).alias("reporting_year"),
    )


def prepared_lexicon(spark, sf):
    return lexicon.prepare_lexicon(v.lexicon_source(spark, sf))


KEYED_SQL = f"""k AS (SELECT seq, {v.COMPANY_KEY_SQL.format('cik')} AS cik,
    CAST(right(filing_date, 4) AS INTEGER) AS filing_year,
    CAST(right(reporting_date, 4) AS INTEGER) AS reporting_year FROM filings),
  l AS (SELECT *, {v.COMPANY_KEY_SQL.format('CIK')} AS key, CAST(left(FILING_DATE, 4) AS INTEGER) AS yr FROM lexicon_source),
  u AS (SELECT *, count(*) OVER (PARTITION BY key, yr) AS entries FROM l
        QUALIFY row_number() OVER (PARTITION BY key, yr ORDER BY seq) = 1)"""


@query(
    "lexicon_attach_j4",
    views="filings lexicon_source",
    sql=f"""WITH {KEYED_SQL}
            SELECT k.seq, k.cik, k.reporting_year, u.key IS NOT NULL AS lexicon_matched, u.N_Words AS n_words,
                   round(u.N_Negative / nullif(u.N_Words, 0), 9) AS negative_density
            FROM k LEFT JOIN u ON k.cik = u.key AND k.reporting_year = u.yr""",
)
def _(spark, sf):
    filings = keyed_filings(spark, sf)
    lookup = lexicon.build_lookup(prepared_lexicon(spark, sf), lexicon.required_keys([filings]))
    return lexicon.attach_lexicon(filings, lookup).select(
        "seq", "cik", "reporting_year", "lexicon_matched",
        C("N_Words").alias("n_words"),
        F.round("negative_density", 9).alias("negative_density"),
    )


@query(
    "needed_lexicon_keys_j5",
    views="filings lexicon_source",
    sql=f"""WITH {KEYED_SQL}
            SELECT u.key AS cik, u.yr AS lexicon_year, u.entries, u.N_Words AS n_words FROM u
            WHERE EXISTS (SELECT 1 FROM k WHERE k.cik = u.key AND k.reporting_year = u.yr)""",
)
def _(spark, sf):
    needed = lexicon.required_keys([keyed_filings(spark, sf)])
    return lexicon.build_lookup(prepared_lexicon(spark, sf), needed).select(
        "cik", "lexicon_year", "entries", C("N_Words").alias("n_words")
    )


LINK_SQL = f"""r AS (SELECT {v.COMPANY_KEY_SQL.format('cik')} AS cik_key, {v.parse_month_sql('fraud_start')} AS fs,
      last_day({v.parse_month_sql('fraud_end')}) AS fe, CAST(record_time AS TIMESTAMP) AS record_time FROM period_source),
  q AS (SELECT cik_key, fs, fe, min(record_time) AS source_record_first, max(record_time) AS source_record_last,
        count(*) AS source_record_count FROM r GROUP BY ALL),
  linked AS (SELECT b.seq, b.cik AS cik_key, CAST(strptime(b.filing_date, '%d-%m-%Y') AS DATE) AS filing_date,
        CAST(right(b.filing_date, 4) AS INTEGER) AS filing_year, b.matched_fraud_start, b.matched_fraud_end,
        q.source_record_first, q.source_record_last, q.source_record_count,
        CAST(floor((epoch_us(q.source_record_first) - epoch_us(strptime(b.filing_date, '%d-%m-%Y'))) / 86400000000.0) AS BIGINT) AS lag_days
      FROM labeled b JOIN q ON b.cik = q.cik_key AND b.matched_fraud_start = q.fs AND b.matched_fraud_end = q.fe
      WHERE b.fraudulent = 1)"""


def linked_positives(spark, sf):
    records = maturity.key_source_records(v.period_source(spark, sf))
    positives = labeled(spark, sf).where("fraudulent = 1").select(
        "seq",
        C("cik").alias("cik_key"),
        dates.day_first_date(C("filing_date")).alias("filing_date"),
        "matched_fraud_start",
        "matched_fraud_end",
    ).withColumn("filing_year", F.year("filing_date"))
    return cut_lineage(maturity.link_periods(positives, maturity.period_lookup(records)))


@query(
    "exact_period_link_j6",
    views=LABEL_VIEWS,
    sql=f"""WITH {LINK_SQL}
            SELECT seq, cik_key, source_record_first, source_record_last, source_record_count, lag_days FROM linked""",
)
def _(spark, sf):
    return linked_positives(spark, sf).select(
        "seq", "cik_key", "source_record_first", "source_record_last", "source_record_count", "lag_days"
    )


@query(
    "orphan_records_j7",
    views="filings filings_b",
    sql="""WITH f AS (SELECT DISTINCT trim(cik) AS a, trim(filing_date) AS b, trim(reporting_date) AS c, trim(filing_type) AS d FROM filings),
           g AS (SELECT DISTINCT trim(cik) AS a, trim(filing_date) AS b, trim(reporting_date) AS c, trim(filing_type) AS d FROM filings_b)
           SELECT a AS cik, b AS filing_date, c AS reporting_date, d AS filing_type
           FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.a = g.a AND f.b = g.b AND f.c = g.c AND f.d = g.d)""",
)
def _(spark, sf):
    return validation.orphans(
        v.filings_b(spark, sf), v.filings(spark, sf), keys.record_identifier()
    ).select("key.*")


@query(
    "key_overlap_j8",
    views="filings filings_b period_source",
    sql="""WITH f AS (SELECT DISTINCT cik FROM filings), l AS (SELECT DISTINCT cik FROM filings_b),
           p AS (SELECT DISTINCT cik FROM period_source),
           u AS (SELECT cik, cik IN (SELECT cik FROM f) AS f, cik IN (SELECT cik FROM l) AS l, cik IN (SELECT cik FROM p) AS p
                 FROM (SELECT cik FROM f UNION SELECT cik FROM l UNION SELECT cik FROM p))
           SELECT count(*) FILTER (f) AS firm_unique, count(*) FILTER (l) AS label_unique, count(*) FILTER (p) AS aaer_unique,
             count(*) FILTER (f AND l) AS firm_label_overlap, count(*) FILTER (f AND NOT l) AS firm_not_in_label,
             count(*) FILTER (l AND NOT f) AS label_not_in_firm, count(*) FILTER (f AND p) AS firm_aaer_overlap,
             count(*) FILTER (f AND NOT p) AS firm_not_in_aaer, count(*) FILTER (p AND NOT f) AS aaer_not_in_firm,
             count(*) FILTER (l AND p) AS label_aaer_overlap, count(*) FILTER (l AND NOT p) AS label_not_in_aaer,
             count(*) FILTER (p AND NOT l) AS aaer_not_in_label FROM u""",
)
def _(spark, sf):
    sources = {
        "firm": v.filings(spark, sf),
        "label": v.filings_b(spark, sf),
        "aaer": v.period_source(spark, sf),
    }
    return validation.key_overlap(sources, C("cik"))


@query(
    "fold_overlap_j9",
    views="filings",
    sql="""WITH d AS (SELECT CAST(right(reporting_date, 4) AS INTEGER) AS y, CAST(strptime(filing_date, '%d-%m-%Y') AS DATE) AS day FROM filings),
           s AS (SELECT y, min(day) AS test_start FROM d GROUP BY y)
           SELECT s.y AS test_year, s.test_start, count(*) FILTER (d.day >= s.test_start) AS overlapping_train_rows,
                  count(*) AS train_n FROM s JOIN d ON d.y < s.y GROUP BY ALL""",
)
def _(spark, sf):
    # The stored year is the reporting year, so training rows reach into the test year.
    rows = v.filings(spark, sf).select(
        F.year(dates.day_first_date(C("reporting_date"))).alias("stored_year"),
        dates.day_first_date(C("filing_date")).alias("day"),
    )
    return folds.fold_overlap(rows, "stored_year", "day")


@query(
    "selected_candidate_j10",
    views="trials",
    sql="""SELECT number, value, recall5, prauc, skill FROM trials WHERE number =
           (SELECT number FROM trials WHERE skill > 0 ORDER BY recall5 DESC, prauc DESC, number LIMIT 1)""",
)
def _(spark, sf):
    trials = v.trials(spark, sf)
    chosen = selection.select_candidate(trials).first().selected_trial_number
    return selection.winner_row(trials, chosen).select("number", "value", "recall5", "prauc", "skill")


@query(
    "combine_sources_u1",
    views="filings filings_b",
    sql="""SELECT seq, cik, filing_type, filing_date, reporting_date, fye, 'filings' AS source, CAST(NULL AS DOUBLE) AS extra FROM filings
           UNION ALL SELECT seq, cik, filing_type, filing_date, reporting_date, fye, 'labels' AS source, extra FROM filings_b""",
)
def _(spark, sf):
    return ingest.combine(v.filings(spark, sf), v.filings_b(spark, sf))


@query(
    "combine_predictions_u2",
    views="predictions",
    sql="SELECT test_year, row_id, true_label, predicted_probability FROM predictions",
)
def _(spark, sf):
    from ledgerwise.operators.metrics import combine_predictions

    rows = v.predictions(spark, sf).select(
        calendar_year(C("test_year")).alias("test_year"), "row_id", "true_label", "predicted_probability"
    )
    # A fragment for each year, as folds leave them; each is read from its own folder.
    stored = written(rows, "fragments", "test_year", "row_id")
    years = stored.select("test_year").distinct().orderBy("test_year")
    return combine_predictions([stored.where(C("test_year") == r.test_year) for r in years.collect()])


@query(
    "distinct_key_union_u3",
    views="filings filings_b",
    sql="""SELECT cik, CAST(right(reporting_date, 4) AS INTEGER) AS lexicon_year FROM filings
           UNION SELECT cik, CAST(right(reporting_date, 4) AS INTEGER) AS lexicon_year FROM filings_b""",
)
def _(spark, sf):
    def with_year(df):
        return df.withColumn("reporting_year", F.year(dates.day_first_date(C("reporting_date"))))

    return lexicon.required_keys([with_year(v.filings(spark, sf)), with_year(v.filings_b(spark, sf))])


@query(
    "key_difference_u4",
    views="filings filings_b",
    sql="SELECT cik FROM filings_b EXCEPT SELECT cik FROM filings",
)
def _(spark, sf):
    return v.filings_b(spark, sf).select("cik").subtract(v.filings(spark, sf).select("cik"))


@query(
    "key_intersection_u5",
    views="filings filings_b",
    sql="SELECT cik FROM filings_b INTERSECT SELECT cik FROM filings",
)
def _(spark, sf):
    return v.filings_b(spark, sf).select("cik").intersect(v.filings(spark, sf).select("cik"))


@query(
    "label_value_set_u6",
    views="predictions",
    sql="""SELECT count(*) FILTER (true_label NOT IN (0, 1)) AS rows_outside,
           count(*) FILTER (true_label NOT IN (0, 1)) = 0 AS is_subset FROM predictions""",
)
def _(spark, sf):
    return contracts.values_outside(v.predictions(spark, sf), "true_label", (0, 1))
