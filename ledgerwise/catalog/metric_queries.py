"""Ranking, classification and calibration metrics over the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.catalog import views as v
from ledgerwise.catalog.registry import query
from ledgerwise.functions import numbers
from ledgerwise.operators import metrics, models

C = F.col
DIGITS = 9


def rounded(df, *names):
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


def decided(spark, sf):
    return metrics.apply_threshold(v.predictions(spark, sf))


# Rank-based definitions, independent of the Spark form.
AUC_SQL = """auc AS (SELECT test_year,
    (sum(CASE WHEN true_label = 1 THEN rk END) - sum(true_label) * (sum(true_label) + 1) / 2.0)
      / (sum(true_label) * (count(*) - sum(true_label))) AS roc_auc
    FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY test_year, predicted_probability) - 1) / 2.0 AS rk
          FROM predictions WINDOW w AS (PARTITION BY test_year ORDER BY predicted_probability)) GROUP BY test_year)"""
AP_SQL = """ap AS (SELECT test_year, sum(dp * cp / cn) / max(tot) AS pr_auc FROM (
    SELECT test_year, dp, sum(dp) OVER w AS cp, sum(n) OVER w AS cn, sum(dp) OVER (PARTITION BY test_year) AS tot
    FROM (SELECT test_year, predicted_probability AS s, sum(true_label)::DOUBLE AS dp, count(*)::DOUBLE AS n FROM predictions GROUP BY ALL)
    WINDOW w AS (PARTITION BY test_year ORDER BY s DESC)) GROUP BY test_year)"""
CONFUSION_SQL = """cm AS (SELECT test_year, count(*) FILTER (true_label = 1 AND predicted_probability >= 0.5) AS tp,
    count(*) FILTER (true_label = 0 AND predicted_probability >= 0.5) AS fp,
    count(*) FILTER (true_label = 1 AND predicted_probability < 0.5) AS fn,
    count(*) FILTER (true_label = 0 AND predicted_probability < 0.5) AS tn FROM predictions GROUP BY test_year)"""
BRIER_SQL = """br AS (SELECT test_year, count(*) AS test_n, CAST(sum(true_label) AS BIGINT) AS test_fraud_n,
    avg(pow(predicted_probability - true_label, 2)) AS brier_score, var_pop(true_label) AS naive_brier_score
    FROM predictions GROUP BY test_year)"""
QUEUE_SQL = """qu AS (SELECT test_year, max(review_n) AS review_n, sum(true_label) FILTER (rn <= review_n) AS found,
    sum(true_label) AS positives FROM (
      SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY predicted_probability DESC, row_id) AS rn,
        greatest(1, (count(*) OVER (PARTITION BY test_year) * 5 + 99) // 100) AS review_n FROM predictions) GROUP BY test_year)"""
_EDGES = ", ".join(repr(e) + "::DOUBLE" for e in numbers.bin_edges(fv.CALIBRATION_BINS))


def bins_sql(compare: str) -> str:
    return f"""SELECT test_year, len(list_filter([{_EDGES}], lambda e: e {compare} predicted_probability)) AS bin, count(*) AS n,
        avg(true_label) AS prob_true, avg(predicted_probability) AS prob_pred FROM predictions GROUP BY ALL"""


ECE_SQL = f"""ce AS (SELECT test_year, sum(n * abs(prob_true - prob_pred)) / sum(n) AS ece,
    max(abs(prob_true - prob_pred)) AS mce FROM ({bins_sql('<=')}) GROUP BY test_year)"""


@query(
    "roc_auc_m1",
    views="predictions",
    sql=f"WITH {AUC_SQL} SELECT test_year, round(roc_auc, {DIGITS}) AS roc_auc FROM auc",
)
def _(spark, sf):
    ranked = metrics.ranking_metrics(v.predictions(spark, sf))
    return rounded(ranked, "roc_auc").select("test_year", "roc_auc")


@query(
    "average_precision_m2",
    views="predictions",
    sql=f"WITH {AP_SQL} SELECT test_year, round(pr_auc, {DIGITS}) AS pr_auc FROM ap",
)
def _(spark, sf):
    ranked = metrics.ranking_metrics(v.predictions(spark, sf))
    return rounded(ranked, "pr_auc").select("test_year", "pr_auc")


_F1 = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"
_NEG_F1 = "coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0)"
_CLASS_SQL = {
    "f1": _F1,
    "f1_macro": f"({_F1} + {_NEG_F1}) / 2",
    "precision": "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)",
    "recall": "coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)",
    "mcc": """coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn)
        / nullif(sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE) * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE), 0), 0)""",
    "balanced_acc": "(tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2",
}


def _class_sql(*names: str) -> str:
    return ", ".join(f"round({_CLASS_SQL[n]}, {DIGITS}) AS {n}" for n in names)


def _class_query(name: str, *columns: str, counts: str = ""):
    @query(
        name,
        views="predictions",
        sql=f"WITH {CONFUSION_SQL} SELECT test_year, {counts}{_class_sql(*columns)} FROM cm",
    )
    def _(spark, sf):
        extra = ["tp", "fp", "fn", "tn"] if counts else []
        found = metrics.classification_metrics(decided(spark, sf))
        return rounded(found, *columns).select("test_year", *extra, *columns)


_class_query("confusion_m3", "precision", "recall", "f1", counts="tp, fp, fn, tn, ")
_class_query("macro_f1_m4", "f1_macro")
_class_query("matthews_m5", "mcc")
_class_query("balanced_accuracy_m6", "balanced_acc")

_SKILL = "CASE WHEN naive_brier_score <> 0 THEN 1 - brier_score / naive_brier_score END"


def _brier_query(name: str, column: str, expression: str):
    @query(
        name,
        views="predictions",
        sql=f"WITH {BRIER_SQL} SELECT test_year, test_n, round({expression}, {DIGITS}) AS {column} FROM br",
    )
    def _(spark, sf):
        scores = metrics.brier_metrics(v.predictions(spark, sf))
        return rounded(scores, column).select("test_year", "test_n", column)


_brier_query("brier_score_m7", "brier_score", "brier_score")
_brier_query("naive_brier_m8", "naive_brier_score", "naive_brier_score")
_brier_query("brier_skill_m9", "brier_skill_score", _SKILL)


@query(
    "review_metrics_m10",
    views="predictions",
    sql=f"""WITH {QUEUE_SQL} SELECT test_year, CAST(review_n AS BIGINT) AS review_n_at_5_percent,
            round(found::DOUBLE / nullif(positives, 0), {DIGITS}) AS recall_at_5_percent,
            round(found::DOUBLE / review_n, {DIGITS}) AS precision_at_5_percent FROM qu""",
)
def _(spark, sf):
    found = metrics.review_metrics(v.predictions(spark, sf))
    return rounded(found, "recall_at_5_percent", "precision_at_5_percent")


@query(
    "review_queue_m10",
    views="predictions",
    sql="""SELECT test_year, row_id, true_label, predicted_probability FROM (
             SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY predicted_probability DESC, row_id) AS rn,
               greatest(1, (count(*) OVER (PARTITION BY test_year) * 5 + 99) // 100) AS review_n FROM predictions)
           WHERE rn <= review_n""",
)
def _(spark, sf):
    return metrics.review_queue(v.predictions(spark, sf)).select(
        "test_year", "row_id", "true_label", "predicted_probability"
    )


@query(
    "calibration_error_m11",
    views="predictions",
    sql=f"WITH {ECE_SQL} SELECT test_year, round(ece, {DIGITS}) AS ece, round(mce, {DIGITS}) AS mce FROM ce",
)
def _(spark, sf):
    return rounded(metrics.calibration_error(v.predictions(spark, sf)), "ece", "mce")


@query(
    "reliability_curve_m12",
    views="predictions",
    sql=f"""SELECT test_year, CAST(bin AS INTEGER) AS bin, n, round(prob_true, {DIGITS}) AS prob_true,
            round(prob_pred, {DIGITS}) AS prob_pred FROM ({bins_sql('<')})""",
)
def _(spark, sf):
    return rounded(metrics.reliability_curve(v.predictions(spark, sf)), "prob_true", "prob_pred")


@query(
    "calibration_gain_m13",
    views="predictions",
    sql=f"""SELECT test_year, round(avg(pow(predicted_probability - true_label, 2)), {DIGITS}) AS raw_brier_score,
            round(avg(pow(second_probability - true_label, 2)), {DIGITS}) AS calibrated_brier_score,
            round(avg(pow(predicted_probability - true_label, 2)) - avg(pow(second_probability - true_label, 2)), {DIGITS}) AS brier_improvement
            FROM predictions GROUP BY test_year""",
)
def _(spark, sf):
    compared = metrics.compare_calibration(
        v.predictions(spark, sf), "predicted_probability", "second_probability"
    )
    return rounded(compared, "raw_brier_score", "calibrated_brier_score", "brier_improvement")


_CANDIDATES = ", ".join(repr(t) + "::DOUBLE" for t in metrics.threshold_candidates())


@query(
    "best_threshold_m14",
    views="predictions",
    sql=f"""WITH t AS (SELECT unnest([{_CANDIDATES}]) AS threshold),
            f AS (SELECT test_year, threshold, coalesce(2.0::DOUBLE * count(*) FILTER (true_label = 1 AND predicted_probability >= threshold)
                    / nullif(count(*) FILTER (predicted_probability >= threshold) + sum(true_label), 0), 0) AS f1
                  FROM predictions, t GROUP BY ALL)
            SELECT test_year, threshold, round(f1, {DIGITS}) AS best_f1 FROM f
            QUALIFY row_number() OVER (PARTITION BY test_year ORDER BY f1 DESC, threshold) = 1""",
)
def _(spark, sf):
    return rounded(metrics.best_threshold(v.predictions(spark, sf)), "best_f1")


@query(
    "apply_threshold_m15",
    views="predictions",
    sql="""SELECT row_id, CAST(predicted_probability >= 0.5 AS INTEGER) AS predicted_label,
           0.5::DOUBLE AS decision_threshold FROM predictions""",
)
def _(spark, sf):
    return decided(spark, sf).select("row_id", "predicted_label", "decision_threshold")


_FOLD_SQL = f"""WITH {AUC_SQL}, {AP_SQL}, {CONFUSION_SQL}, {BRIER_SQL}, {QUEUE_SQL}, {ECE_SQL},
  fm AS (SELECT br.test_year, test_n, test_fraud_n, round(roc_auc, {DIGITS}) AS roc_auc, round(pr_auc, {DIGITS}) AS pr_auc,
    {_class_sql('f1', 'f1_macro', 'precision', 'recall')},
    round(found::DOUBLE / nullif(positives, 0), {DIGITS}) AS recall_at_5_percent,
    round(found::DOUBLE / review_n, {DIGITS}) AS precision_at_5_percent, {_class_sql('mcc', 'balanced_acc')},
    round(brier_score, {DIGITS}) AS brier_score, round(naive_brier_score, {DIGITS}) AS naive_brier_score,
    round({_SKILL}, {DIGITS}) AS brier_skill_score, CAST(review_n AS BIGINT) AS review_n_at_5_percent,
    round(ece, {DIGITS}) AS ece, round(mce, {DIGITS}) AS mce
  FROM br JOIN auc USING (test_year) JOIN ap USING (test_year) JOIN cm USING (test_year)
       JOIN qu USING (test_year) JOIN ce USING (test_year))"""


@query("fold_metrics_m17", views="predictions", sql=f"{_FOLD_SQL} SELECT * FROM fm")
def _(spark, sf):
    return rounded(metrics.fold_metrics(decided(spark, sf)), *fv.METRICS, "ece", "mce")


_SUMMARY = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round_even(avg({m}), 6) AS mean, round_even(stddev_pop({m}), 6) AS std FROM fm"
    for m in fv.METRICS
)


@query("fold_summary_a29", views="predictions", sql=f"{_FOLD_SQL} {_SUMMARY}")
def _(spark, sf):
    return metrics.metric_summary(metrics.fold_metrics(decided(spark, sf)))


@query(
    "calibration_summary_a30",
    views="predictions",
    sql=f"""WITH g AS (SELECT test_year, avg(pow(predicted_probability - true_label, 2)) AS b, avg(pow(second_probability - true_label, 2)) AS raw
              FROM predictions GROUP BY test_year), {ECE_SQL}
            SELECT count(*) AS n_calibrated_folds, round_even(avg(b), 6) AS brier_calibrated_mean, round_even(stddev_pop(b), 6) AS brier_calibrated_std,
              round_even(avg(raw), 6) AS brier_raw_mean, round_even(stddev_pop(raw), 6) AS brier_raw_std,
              round_even(avg(ece), 6) AS ece_mean, round_even(stddev_pop(ece), 6) AS ece_std,
              round_even(avg(mce), 6) AS mce_mean, round_even(stddev_pop(mce), 6) AS mce_std,
              round_even(avg(raw - b), 6) AS brier_improvement_mean, round_even(stddev_pop(raw - b), 6) AS brier_improvement_std,
              count(*) FILTER (raw - b > 0) AS folds_improved, count(*) FILTER (raw - b < 0) AS folds_worsened
            FROM g JOIN ce USING (test_year)""",
)
def _(spark, sf):
    rows = v.predictions(spark, sf)
    compared = metrics.compare_calibration(rows, "second_probability", "predicted_probability")
    folds = compared.withColumnRenamed("calibrated_brier_score", "brier_score").join(
        F.broadcast(metrics.calibration_error(rows)), "test_year"
    )
    return metrics.calibration_summary(folds)


def _describe_sql(groups: str = "") -> str:
    lead = f"{groups}, " if groups else ""
    tail = f" GROUP BY {groups}" if groups else ""
    return f"""SELECT {lead}count(predicted_probability) AS count, round(avg(predicted_probability), {DIGITS}) AS mean,
        round(stddev_samp(predicted_probability), {DIGITS}) AS std, min(predicted_probability) AS min,
        round(quantile_cont(predicted_probability, 0.25), {DIGITS}) AS q25, round(quantile_cont(predicted_probability, 0.5), {DIGITS}) AS q50,
        round(quantile_cont(predicted_probability, 0.75), {DIGITS}) AS q75, max(predicted_probability) AS max FROM predictions{tail}"""


@query("score_summary_a21", views="predictions", sql=_describe_sql())
def _(spark, sf):
    return rounded(metrics.describe_scores(v.predictions(spark, sf)), "mean", "std", "q25", "q50", "q75")


@query("score_summary_by_label_a21", views="predictions", sql=_describe_sql("true_label"))
def _(spark, sf):
    described = metrics.describe_scores(v.predictions(spark, sf), by_label=True)
    return rounded(described, "mean", "std", "q25", "q50", "q75")


@query(
    "score_quantiles_a22",
    views="predictions",
    sql=f"""SELECT unnest({list(fv.SCORE_QUANTILES)}::DOUBLE[]) AS quantile,
            round(unnest(quantile_cont(predicted_probability, {list(fv.SCORE_QUANTILES)})), {DIGITS}) AS score FROM predictions""",
)
def _(spark, sf):
    return rounded(metrics.score_quantiles(v.predictions(spark, sf)), "score")


@query(
    "counts_at_thresholds_a23",
    views="predictions",
    sql=f"""SELECT threshold, count(*) FILTER (predicted_probability >= threshold) AS predicted_positives
            FROM predictions, (SELECT unnest({list(fv.COUNT_THRESHOLDS)}::DOUBLE[]) AS threshold) GROUP BY threshold""",
)
def _(spark, sf):
    return metrics.counts_at_thresholds(v.predictions(spark, sf))


_PRIOR_SQL = """WITH y AS (SELECT test_year, count(*) AS n, sum(true_label) AS p FROM predictions GROUP BY test_year),
  e AS (SELECT test_year, p, sum(n) OVER w AS tn, sum(p) OVER w AS tp FROM y
        WINDOW w AS (ORDER BY test_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "prior_baseline_l1",
    views="predictions",
    sql=f"""{_PRIOR_SQL} SELECT r.test_year, r.row_id, r.true_label, round(e.tp::DOUBLE / e.tn, {DIGITS}) AS predicted_probability
            FROM predictions r JOIN e USING (test_year) WHERE e.tn > 0 AND e.p >= 5""",
)
def _(spark, sf):
    scored = models.prior_predictions(
        v.predictions(spark, sf), "test_year", "true_label", "row_id", min_positives=5
    )
    return rounded(scored, "predicted_probability")


@query(
    "balanced_weights_l3",
    views="predictions",
    sql=f"""SELECT row_id, true_label, round((SELECT count(*) FROM predictions) / (2.0::DOUBLE * count(*) OVER (PARTITION BY true_label)), {DIGITS}) AS weight
            FROM predictions""",
)
def _(spark, sf):
    weighted = models.balanced_weights(v.predictions(spark, sf), "true_label")
    return rounded(weighted.select("row_id", "true_label", "weight"), "weight")
