"""Models on the labeled texts, and the composed jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.catalog import views as v
from ledgerwise.catalog.aggregate_queries import FEATURES, maturity
from ledgerwise.catalog.join_queries import KEYED_SQL
from ledgerwise.catalog.registry import query
from ledgerwise.catalog.text_queries import features_sql
from ledgerwise.functions import dates, keys
from ledgerwise.operators import boosting, features, hypothesis, metrics, models, search, selection
from ledgerwise.plans import audits, data_stages, experiment
from ledgerwise.scale import shared_folder, spread

C = F.col
MIN_POSITIVES = 3
TEXT_FEATURES = tuple(f for f in fv.TEXT_FEATURES if f != "mda_text_available")
# Fixed value: trials of the parameter search.
TRIALS = 200


def table(spark, sf):
    """Checkpointed feature table of the labeled texts."""
    rows = features.add_text_features(v.labeled_texts(spark, sf))
    return models.model_table(rows, TEXT_FEATURES, "fraudulent", "filing_year", "seq")


def _folds(predictions):
    return models.evaluated_folds(predictions)


@query("logistic_walk_forward_l2")
def _(spark, sf):
    return _folds(
        models.walk_forward(table(spark, sf), models.logistic(TEXT_FEATURES), MIN_POSITIVES)
    )


# Test years with enough positives and earlier rows of both classes, as every walk-forward run has them.
USABLE_SQL = f"""y AS (SELECT filing_year, count(*) AS n, sum(fraudulent) AS pos FROM labeled_texts GROUP BY filing_year),
           t AS (SELECT filing_year, pos, CAST(sum(n) OVER w AS BIGINT) AS train_n, sum(pos) OVER w AS train_pos FROM y
                 WINDOW w AS (ORDER BY filing_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
           usable AS (SELECT * FROM t WHERE pos >= {MIN_POSITIVES} AND train_pos > 0 AND train_pos < train_n)"""
SCORED_ROWS_SQL = f"""WITH {USABLE_SQL}
           SELECT seq AS row_id, filing_year AS test_year, fraudulent AS true_label, train_n, true AS has_score
           FROM labeled_texts JOIN usable USING (filing_year)"""


def scored_rows(predictions):
    """What SQL can know of predictions: which rows they are for, and that each has a probability."""
    return predictions.select(
        "row_id", "test_year", "true_label", C("train_n").cast("long").alias("train_n"),
        C("predicted_probability").between(0.0, 1.0).alias("has_score"),
    )


def boosted(spark, sf):
    return models.walk_forward(table(spark, sf), models.boosted_trees(TEXT_FEATURES), MIN_POSITIVES)


@query("boosted_trees_l4")
def _(spark, sf):
    return boosted(spark, sf)


@query("boosted_tree_rows_l4", views="labeled_texts", sql=SCORED_ROWS_SQL)
def _(spark, sf):
    return scored_rows(boosted(spark, sf))


@query("walk_forward_predictions_l6")
def _(spark, sf):
    return models.walk_forward(
        table(spark, sf), models.logistic(TEXT_FEATURES, balanced=True), MIN_POSITIVES
    )


@query("sigmoid_calibration_l7")
def _(spark, sf):
    return models.walk_forward(
        table(spark, sf),
        models.logistic(TEXT_FEATURES),
        MIN_POSITIVES,
        raw_reference=True,
        min_train_years=2,
        calibration="chronological_holdout",
    )


@query("isotonic_calibration_l8")
def _(spark, sf):
    rows = table(spark, sf)
    late = rows.agg(F.max("filing_year")).first()[0]
    scorer = models.fit_scorer(
        models.logistic(TEXT_FEATURES),
        rows.where(C("filing_year") < late),
        calibration="chronological_holdout",
        method="isotonic",
    )
    return scorer(rows.where(C("filing_year") == late))


@query("cross_validated_calibration_l9")
def _(spark, sf):
    rows = table(spark, sf)
    late = rows.agg(F.max("filing_year")).first()[0]
    scorer = models.fit_scorer(
        models.logistic(TEXT_FEATURES),
        rows.where(C("filing_year") < late),
        calibration="cross_validation",
    )
    return scorer(rows.where(C("filing_year") == late))


@query(
    "stratified_folds_l9",
    views="predictions",
    # Classes lie end to end; fold i gets as many rows of a class as places of it leave remainder i.
    sql="""WITH c AS (SELECT true_label, count(*) AS n, min(row_id) AS first FROM predictions GROUP BY true_label),
           o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
           f AS (SELECT true_label, i, floor((before + n - 1 - i) / 5.0) - floor((before - 1 - i) / 5.0) AS run
                 FROM o CROSS JOIN (SELECT unnest(range(5)) AS i)),
           e AS (SELECT true_label, i, sum(run) OVER (PARTITION BY true_label ORDER BY i) AS upto FROM f),
           r AS (SELECT row_id, true_label, row_number() OVER (PARTITION BY true_label ORDER BY row_id) AS k FROM predictions)
           SELECT row_id, true_label, CAST(count(*) FILTER (k > upto) AS INTEGER) AS fold
           FROM r JOIN e USING (true_label) GROUP BY row_id, true_label""",
)
def _(spark, sf):
    rows = v.predictions(spark, sf).select("row_id", "true_label")
    return models.stratified_folds(rows, 5, "true_label", "row_id")


@query("raw_and_calibrated_brier_l10")
def _(spark, sf):
    predictions = models.walk_forward(
        table(spark, sf),
        models.logistic(TEXT_FEATURES),
        MIN_POSITIVES,
        raw_reference=True,
        min_train_years=2,
        calibration="chronological_holdout",
    )
    return metrics.compare_calibration(predictions, "raw_probability", metrics.SCORE)


def logistic_search(spark, sf):
    return search.search(
        table(spark, sf), TEXT_FEATURES, search.LOGISTIC_SPACE, search.logistic_models, TRIALS, MIN_POSITIVES
    )


@query("parameter_search_l11")
def _(spark, sf):
    return logistic_search(spark, sf)


@query(
    "search_trials_l11",
    views="labeled_texts",
    sql=f"""WITH {USABLE_SQL}
            SELECT CAST(range AS INTEGER) AS number, CAST((SELECT count(*) FROM usable) AS INTEGER) AS folds,
                   true AS metrics_in_range, true AS parameters_in_range
            FROM range({TRIALS})""",
)
def _(spark, sf):
    parameters = F.from_json("parameters", "c double, balanced boolean, max_iter int")
    return logistic_search(spark, sf).withColumn("p", parameters).select(
        "number", "folds",
        (C("prauc").between(0, 1) & C("recall5").between(0, 1) & C("roc_auc").between(0, 1) & (C("skill") < 1)).alias(
            "metrics_in_range"
        ),
        (C("p.c").between(1e-4, 100) & C("p.balanced").isNotNull() & C("p.max_iter").between(500, 3000)).alias(
            "parameters_in_range"
        ),
    )


@query(
    "walk_forward_rows_l6",
    views="labeled_texts",
    sql=SCORED_ROWS_SQL,
)
def _(spark, sf):
    return scored_rows(
        models.walk_forward(table(spark, sf), models.logistic(TEXT_FEATURES, balanced=True), MIN_POSITIVES)
    )


@query(
    "full_refit_rows_l12",
    views="labeled_texts",
    sql="SELECT seq AS row_id, true AS has_prediction FROM labeled_texts",
)
def _(spark, sf):
    rows = table(spark, sf)
    model = models.fit_full(rows, models.logistic(TEXT_FEATURES))
    return model.transform(rows).select("row_id", C("prediction").isin(0.0, 1.0).alias("has_prediction"))


@query("full_refit_l12")
def _(spark, sf):
    rows = table(spark, sf)
    model = models.fit_full(rows, models.logistic(TEXT_FEATURES))
    return model.transform(rows).select("row_id", "prediction")


@query("tree_importances_l13")
def _(spark, sf):
    model = models.fit_full(table(spark, sf), models.boosted_trees(TEXT_FEATURES))
    gain, cover, splits = (
        models.feature_importances(model, kind).withColumnRenamed("importance", kind) for kind in ("gain", "cover", "weight")
    )
    return gain.join(cover, "feature").join(splits, "feature").orderBy(F.desc("gain"), "feature")


@query("linear_contributions_l14")
def _(spark, sf):
    rows = table(spark, sf)
    model = models.fit_full(rows, models.logistic(TEXT_FEATURES))
    contributions = models.linear_contributions(rows, model, TEXT_FEATURES)
    return selection.mean_absolute_importance(contributions, TEXT_FEATURES)


@query("tree_contributions_l14")
def _(spark, sf):
    rows = table(spark, sf)
    model = models.fit_full(rows, models.boosted_trees(TEXT_FEATURES))
    return selection.mean_absolute_importance(boosting.tree_contributions(rows, model), TEXT_FEATURES)


@query("permutation_importances_l14")
def _(spark, sf):
    rows = table(spark, sf)
    model = models.fit_full(rows, models.boosted_trees(TEXT_FEATURES))
    return models.permutation_importances(rows, model, TEXT_FEATURES)


def _holdout(spark, sf):
    rows = table(spark, sf)
    return models.score_holdout(
        rows.where(C("filing_year") < HELD_OUT[0]),
        rows.where(C("filing_year") >= HELD_OUT[0]),
        models.logistic(TEXT_FEATURES),
        HELD_OUT,
    )


@query("holdout_evaluation_l15")
def _(spark, sf):
    return _holdout(spark, sf)[1]


# Development years end before this one; two years are held out.
HELD_OUT = (2006, 2007)


def _review(spark, sf):
    """Feature rows, and the calibrated review of the best of all trials on the development years."""
    rows = table(spark, sf)
    development = rows.where(C("filing_year") < HELD_OUT[0])
    trials = search.search(
        development, TEXT_FEATURES, search.LOGISTIC_SPACE, search.logistic_models, TRIALS, MIN_POSITIVES
    )
    reviewed = experiment.review_candidates(
        trials, development, TEXT_FEATURES, search.logistic_models, min_positives=MIN_POSITIVES
    )
    return rows, development, reviewed


@query("candidate_review_w14")
def _(spark, sf):
    return _review(spark, sf)[2]


@query(
    "candidate_review_rows_w14",
    views="labeled_texts",
    sql=f"""WITH {USABLE_SQL},
            folds AS (SELECT count(*) AS n FROM usable u WHERE filing_year < {HELD_OUT[0]}
                      AND (SELECT count(*) FROM y WHERE y.filing_year < u.filing_year) >= 2)
            SELECT CAST(range + 1 AS INTEGER) AS place, CAST(n AS INTEGER) AS folds, true AS is_a_trial,
                   true AS metrics_in_range, true AS eligibility_follows_skill
            FROM range({fv.CANDIDATE_REVIEW_SIZE}), folds""",
)
def _(spark, sf):
    from pyspark.sql.window import Window

    # Ten candidates.
    place = F.row_number().over(Window.orderBy(F.desc("value"), "number"))
    return _review(spark, sf)[2].select(
        place.alias("place"), "folds", C("number").between(0, TRIALS - 1).alias("is_a_trial"),
        (C("recall5").between(0, 1) & C("prauc").between(0, 1) & (C("skill") < 1) & C("brier_score").between(0, 1)).alias(
            "metrics_in_range"
        ),
        (C("eligible") == (C("skill") > 0)).alias("eligibility_follows_skill"),
    )


def _guarded(spark, sf):
    """A review, and the one evaluation of the held-out years by its winner."""
    rows, development, reviewed = _review(spark, sf)
    contract = models.artifact_contract(development, TEXT_FEATURES, "logistic search over surface features")
    guarded = experiment.GuardedHoldout(spark, f"{shared_folder(spark)}/queries/hold-out-{uuid.uuid4().hex}")
    guarded.select(reviewed, contract)

    def score(parameters, held_out):
        return models.score_holdout(
            development, held_out, models.logistic(TEXT_FEATURES, **parameters), HELD_OUT
        )

    guarded.evaluate(development, rows, contract, HELD_OUT, score)
    return rows, development, reviewed, guarded


@query(
    "guarded_holdout_l15",
    views="labeled_texts",
    sql=f"""SELECT seq AS row_id, filing_year, fraudulent AS true_label, 0.5::DOUBLE AS decision_threshold, true AS has_score
            FROM labeled_texts WHERE filing_year BETWEEN {HELD_OUT[0]} AND {HELD_OUT[1]}""",
)
def _(spark, sf):
    predictions = _guarded(spark, sf)[3].result("predictions")
    return predictions.select(
        "row_id", "filing_year", "true_label", "decision_threshold",
        C("predicted_probability").between(0.0, 1.0).alias("has_score"),
    )


def _stage_tables(spark, sf):
    """Documents as filings with a company name, and orders as periods and lexicon."""
    key = C("doc_id")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (key * 37 % 2500).cast("int"))
    filings = spread(v.table(spark, sf, "documents"), "doc_id").select(
        key.alias("seq"),
        (key % 900).cast("string").alias("cik"),
        F.concat(F.lit("Firm "), (key % 900).cast("string")).alias("name"),
        F.when(key % 5 == 1, "10-K/A").otherwise("10-K").alias("filing_type"),
        F.date_format(day, "dd-MM-yyyy").alias("filing_date"),
        F.date_format(F.date_sub(day, 90), "dd-MM-yyyy").alias("reporting_date"),
        F.lit("1231").alias("fye"),
        C("text").alias("mda"),
    )
    return {
        "filings": filings,
        "periods": v.period_source(spark, sf),
        "lexicon": v.lexicon_source(spark, sf),
        "cutoff": 2000,
    }


@query("data_stages_x1")
def _(spark, sf):
    tables = data_stages.run_stages(_stage_tables(spark, sf), "split", acknowledge_holdout=True)
    both = tables["development"].withColumn("dataset", F.lit("trainval")).unionByName(
        tables["holdout"].withColumn("dataset", F.lit("test"))
    )
    return both.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("records"), F.sum("fraudulent").alias("positives")
    )


@query("development_features_x3")
def _(spark, sf):
    tables = data_stages.run_stages(
        _stage_tables(spark, sf), "development-features", acknowledge_holdout=True
    )
    return tables["features"].select("seq", "fraudulent", "lexicon_matched", *fv.MODEL_FEATURES)


@query(
    "split_features_x4",
    views="filings lexicon_source texts",
    sql=f"""WITH {KEYED_SQL}, f AS ({features_sql('texts')})
            SELECT k.seq, CASE WHEN filing_year < 1999 THEN 'trainval' ELSE 'test' END AS dataset,
                   u.key IS NOT NULL AS lexicon_matched, round(u.N_Positive / nullif(u.N_Words, 0), 9) AS positive_density,
                   coalesce(f.mda_text_available, 0.0) AS mda_text_available, f.mda_word_count, f.mda_gunning_fog,
                   f.mda_lexical_diversity
            FROM k LEFT JOIN u ON k.cik = u.key AND k.reporting_year = u.yr LEFT JOIN f ON f.seq = k.seq""",
)
def _(spark, sf):
    from ledgerwise.operators import split

    # Filings have the text of the document of their number, as far as there are documents.
    filings = v.filings(spark, sf).drop("mda").join(v.texts(spark, sf), "seq", "left").withColumns(
        {
            "reporting_date": dates.day_first_date(C("reporting_date")),
            "cik": keys.company_key(C("cik")),
        }
    )
    development, holdout = split.split_by_year(filings, 1999)
    full = data_stages.full_features(development, holdout, v.lexicon_source(spark, sf))
    return full.select(
        "seq", "dataset", "lexicon_matched",
        F.round("positive_density", 9).alias("positive_density"), "mda_text_available", "mda_word_count",
        *[F.round(n, 6).alias(n) for n in ("mda_gunning_fog", "mda_lexical_diversity")],
    )


@query("evidence_snapshot_x9")
def _(spark, sf):
    rows, development, reviewed, guarded = _guarded(spark, sf)
    winner = guarded.selected()
    model = models.fit_full(development, models.logistic(TEXT_FEATURES, **winner["parameters"]))
    contributions = models.linear_contributions(development, model, TEXT_FEATURES)
    importances = selection.mean_absolute_importance(contributions, TEXT_FEATURES)
    audit = maturity(spark, sf)
    return audits.evidence_snapshot(
        selection.winner_row(reviewed, winner["number"]), guarded.result("summary"), audit, importances,
        {"review": reviewed, "final_test": guarded.result("predictions"), "importances": importances},
    )


_PROFILE = " UNION ALL ".join(
    f"""SELECT '{name}' AS feature, fraudulent AS label, count({name}) AS n, round(avg({name}), 6) AS mean,
        round(stddev_samp({name}), 6) AS std FROM f GROUP BY fraudulent"""
    for name in fv.TEXT_FEATURES
)


@query(
    "text_class_profile",
    views="labeled_texts",
    sql=f"WITH f AS ({features_sql('labeled_texts', ', fraudulent, filing_year', 15)}) {_PROFILE}",
)
def _(spark, sf):
    rows = features.add_text_features(v.labeled_texts(spark, sf))
    return hypothesis.class_moments(rows, fv.TEXT_FEATURES, "fraudulent").select(
        "feature", "label", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )
