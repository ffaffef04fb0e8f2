"""Order-dependent operators: deduplication, folds, sorts, top-k and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise.catalog import views as v
from ledgerwise.catalog.aggregate_queries import event_rows
from ledgerwise.catalog.filter_queries import _REPEATED
from ledgerwise.catalog.join_queries import KEYED_SQL, prepared_lexicon
from ledgerwise.catalog.registry import query
from ledgerwise.functions import dates, keys
from ledgerwise.operators import folds, hypothesis, ingest, lexicon, selection
from ledgerwise.scale import flag_later_copies

C = F.col


@query(
    "first_wins_dedup_w1",
    sql="""SELECT event_id AS seq, user_id, event_type, CAST(ts AS DATE) AS day, value FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) = 1""",
)
def _(spark, sf):
    return ingest.deduplicate(event_rows(spark, sf), ["user_id", "event_type", "day"])


@query(
    "period_dedup_w2",
    views="period_source typed_periods clean_periods",
    sql="SELECT * FROM clean_periods",
)
def _(spark, sf):
    return v.clean_periods(spark, sf)


@query(
    "repeated_identifier_w3",
    views="raw_filings",
    sql=f"SELECT seq, coalesce({_REPEATED}, false) AS repeated FROM raw_filings",
)
def _(spark, sf):
    identifier = keys.record_identifier()
    return flag_later_copies(
        v.raw_filings(spark, sf), identifier, keys.is_complete_identifier(identifier), "seq", "repeated"
    ).select("seq", "repeated")


@query(
    "first_entry_lookup_w4",
    views="filings lexicon_source",
    sql=f"WITH {KEYED_SQL} SELECT key AS cik, yr AS lexicon_year, entries, N_Words AS n_words, N_Negative AS n_negative FROM u",
)
def _(spark, sf):
    first = lexicon.first_entries(prepared_lexicon(spark, sf))
    return first.select(
        "cik", "lexicon_year", "entries", C("N_Words").alias("n_words"), C("N_Negative").alias("n_negative")
    )


@query(
    "walk_forward_folds_w5",
    views="predictions",
    sql="""WITH y AS (SELECT test_year, count(*) AS test_n, CAST(sum(true_label) AS BIGINT) AS test_positives FROM predictions GROUP BY 1),
           e AS (SELECT *, CAST(sum(test_n) OVER w AS BIGINT) AS train_n, CAST(sum(test_positives) OVER w AS BIGINT) AS train_positives FROM y
                 WINDOW w AS (ORDER BY test_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
           SELECT test_year, train_n, train_positives, test_n, test_positives FROM e WHERE train_n > 0 AND test_positives >= 30""",
)
def _(spark, sf):
    return folds.walk_forward_folds(v.predictions(spark, sf), "test_year", "true_label")


@query(
    "fold_order_w6",
    views="filings",
    sql="""WITH d AS (SELECT CAST(right(reporting_date, 4) AS INTEGER) AS y, CAST(strptime(filing_date, '%d-%m-%Y') AS DATE) AS day FROM filings),
           s AS (SELECT y, min(day) AS test_start, max(day) AS last FROM d GROUP BY y),
           e AS (SELECT y AS test_year, max(last) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS train_end, test_start FROM s)
           SELECT *, train_end < test_start AS strictly_ordered FROM e WHERE train_end IS NOT NULL""",
)
def _(spark, sf):
    rows = v.filings(spark, sf).select(
        F.year(dates.day_first_date(C("reporting_date"))).alias("stored_year"),
        dates.day_first_date(C("filing_date")).alias("day"),
    )
    return folds.fold_order(rows, "stored_year", "day")


@query(
    "calibration_start_w7",
    views="predictions",
    sql="""WITH o AS (SELECT test_year, row_number() OVER (ORDER BY test_year) - 1 AS pos, count(*) OVER () AS n FROM predictions)
           SELECT max(test_year) FILTER (pos = p) AS calibration_start_year, max(p) AS split_position, max(n) AS rows, min(test_year) AS first_year
           FROM (SELECT *, CAST(least(greatest(1, ceil(n * (1 - 0.2::DOUBLE))), n - 1) AS BIGINT) AS p FROM o)""",
)
def _(spark, sf):
    return folds.calibration_start_year(v.predictions(spark, sf), "test_year")


@query(
    "holm_adjustment_w8",
    sql="""WITH t AS (SELECT CAST(c_nationkey AS VARCHAR) AS feature, CAST(sum(c_custkey) % 997 AS DOUBLE) / 20000 AS p_value
             FROM customer GROUP BY c_nationkey),
           s AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS i, count(*) OVER () AS m FROM t)
           SELECT feature, p_value, round(least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY i)), 9) AS p_holm,
             least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY i)) < 0.05 AS significant_holm FROM s""",
)
def _(spark, sf):
    tests = v.table(spark, sf, "customer").groupBy(C("c_nationkey").cast("string").alias("feature")).agg(
        ((F.sum("c_custkey") % 997).cast("double") / 20000).alias("p_value")
    )
    return hypothesis.holm(tests).withColumn("p_holm", F.round("p_holm", 9))


@query(
    "multi_key_sort_w9",
    views="period_source typed_periods clean_periods",
    sql="SELECT cik, fraud_start, fraud_end, seq FROM clean_periods ORDER BY cik, fraud_start, fraud_end, seq",
)
def _(spark, sf):
    periods = v.clean_periods(spark, sf).select("cik", "fraud_start", "fraud_end", "seq")
    return selection.sorted_by(periods, ["cik", "fraud_start", "fraud_end", "seq"])


@query(
    "descending_sort_w10",
    sql="SELECT p_brand, count(*) AS parts, round(avg(p_retailprice), 6) AS price FROM part GROUP BY p_brand ORDER BY price DESC",
)
def _(spark, sf):
    brands = v.table(spark, sf, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("parts"), F.round(F.avg("p_retailprice"), 6).alias("price")
    )
    return selection.sorted_by(brands, ["price", "p_brand"], descending=True)


@query(
    "top_scored_rows_w11",
    views="predictions",
    sql="""SELECT row_id, test_year, true_label, predicted_probability FROM predictions
           ORDER BY predicted_probability DESC, row_id LIMIT 50""",
)
def _(spark, sf):
    rows = v.predictions(spark, sf).select("row_id", "test_year", "true_label", "predicted_probability")
    return selection.top_rows(rows, "predicted_probability", "row_id", 50)


@query(
    "top_importances_w12",
    sql="""SELECT p_type AS feature, round(avg(p_retailprice), 6) AS importance FROM part GROUP BY p_type
           ORDER BY importance DESC, feature LIMIT 10""",
)
def _(spark, sf):
    ranked = v.table(spark, sf, "part").groupBy(C("p_type").alias("feature")).agg(
        F.round(F.avg("p_retailprice"), 6).alias("importance")
    )
    return selection.top_importances(ranked)


@query(
    "top_trials_w13",
    views="trials",
    sql="SELECT number, value FROM trials WHERE isfinite(value) ORDER BY value DESC, number LIMIT 10",
)
def _(spark, sf):
    return selection.top_trials(v.trials(spark, sf)).select("number", "value")


@query(
    "gated_selection_w14",
    views="trials",
    sql="""WITH e AS (SELECT * FROM trials WHERE skill > 0 ORDER BY recall5 DESC, prauc DESC, number LIMIT 1)
           SELECT 'selected' AS status, (SELECT count(*) FROM trials) AS candidate_count,
             (SELECT count(*) FROM trials WHERE skill > 0) AS eligible_count, number AS selected_trial_number, recall5, prauc, skill FROM e""",
)
def _(spark, sf):
    return selection.select_candidate(v.trials(spark, sf)).drop("selection_rule")


@query(
    "seeded_sample_w15",
    views="predictions",
    sql="""SELECT row_id, test_year, predicted_probability FROM predictions
           ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id LIMIT 1000""",
)
def _(spark, sf):
    rows = v.predictions(spark, sf).select("row_id", "test_year", "predicted_probability")
    return selection.seeded_sample(rows, "row_id", 1000)
