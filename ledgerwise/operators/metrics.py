"""Ranking and classification metrics per test year.

Input is a prediction table (test_year, row_id, true_label, predicted_probability and,
where a threshold was applied, predicted_label). All metrics start from partial
aggregates: rows are counted per year, or per (year, score), before anything is shuffled.
Running sums over scores are distributed (`running_totals`), because a year may hold a
third of all rows and calibrated scores may all be distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwise import fixed_values as fv
from ledgerwise.functions.numbers import (
    bin_edges,
    bin_index,
    nan_to_null,
    ratio_or_zero,
    safe_ratio,
)
from ledgerwise.scale import calendar_year, cut_lineage, exact_quantiles, running_totals, union_all

YEAR, ROW, LABEL = "test_year", "row_id", "true_label"
SCORE, DECISION = "predicted_probability", "predicted_label"


def apply_threshold(predictions: DataFrame, threshold: float = fv.DECISION_THRESHOLD) -> DataFrame:
    return predictions.withColumn(
        DECISION, (F.col(SCORE) >= F.lit(float(threshold))).cast("int")
    ).withColumn("decision_threshold", F.lit(float(threshold)))


def score_histogram(predictions: DataFrame, score: str = SCORE) -> DataFrame:
    """Rows and positives per distinct (year, score); written once, read several times.

    Where decisions were made, also the rows and positives that were decided for.
    """
    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    decided = {}
    if DECISION in predictions.columns:
        decided = {"decided": F.col(DECISION), "decided_pos": F.col(DECISION) * F.col(LABEL)}
    return cut_lineage(
        predictions.groupBy(calendar_year(F.col(YEAR)).alias(YEAR), F.col(score).alias("score")).agg(
            F.count(F.lit(1)).alias("n"),
            total(F.col(LABEL)).alias("pos"),
            *[total(value).alias(name) for name, value in decided.items()],
        )
    )


def ranked_scores(predictions: DataFrame) -> DataFrame:
    """Histogram with the rows and positives scored at least as high."""
    return running_totals(
        score_histogram(predictions),
        [YEAR],
        "score",
        {"n_upto": "n", "pos_upto": "pos"},
        descending=True,
    )


def ranking_metrics(predictions: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """ROC-AUC (ties count one half) and average precision (ties are one step).

    Both are NULL in a year with one class. `ranked` may pass in `ranked_scores`.
    """
    ranked = cut_lineage(ranked_scores(predictions)) if ranked is None else ranked
    totals = ranked.groupBy(YEAR).agg(
        F.sum("pos").alias("_p"), F.sum(F.col("n") - F.col("pos")).alias("_q")
    )
    # One row per calendar year: bounded, so broadcast.
    scored = ranked.join(F.broadcast(totals), YEAR)
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    neg_below = F.col("_q") - (F.col("n_upto") - F.col("pos_upto"))
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    summed = scored.groupBy(YEAR, "_p", "_q").agg(
        F.sum(pos * (neg_below + neg / 2)).alias("_wins"),
        F.sum(pos * F.col("pos_upto") / F.col("n_upto")).alias("_precision_steps"),
    )
    return summed.select(
        YEAR,
        F.when(both, F.col("_wins") / (F.col("_p").cast("double") * F.col("_q"))).alias("roc_auc"),
        F.when(both, F.col("_precision_steps") / F.col("_p")).alias("pr_auc"),
    )


def confusion(predictions: DataFrame) -> DataFrame:
    """tp, fp, fn, tn per year."""
    y, d = F.col(LABEL) == 1, F.col(DECISION) == 1
    return predictions.groupBy(calendar_year(F.col(YEAR)).alias(YEAR)).agg(
        F.count_if(y & d).alias("tp"),
        F.count_if(~y & d).alias("fp"),
        F.count_if(y & ~d).alias("fn"),
        F.count_if(~y & ~d).alias("tn"),
    )


def _f1(hit: Column, false_alarm: Column, miss: Column) -> Column:
    return ratio_or_zero(2 * hit, 2 * hit + false_alarm + miss)


def classification_columns() -> dict[str, Column]:
    """Metrics from tp, fp, fn, tn; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    pos_f1, neg_f1 = _f1(tp, fp, fn), _f1(tn, fn, fp)
    has_pos, has_neg = (tp + fp + fn) > 0, (tn + fp + fn) > 0
    macro = (
        F.when(has_pos & has_neg, (pos_f1 + neg_f1) / 2)
        .when(has_pos, pos_f1)
        .when(has_neg, neg_f1)
    )
    mcc_base = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    pos_recall, neg_recall = safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp)
    balanced = F.coalesce((pos_recall + neg_recall) / 2, pos_recall, neg_recall)
    return {
        "f1": pos_f1,
        "f1_macro": macro,
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "mcc": ratio_or_zero(tp * tn - fp * fn, mcc_base),
        "balanced_acc": balanced,
    }


def classification_metrics(predictions: DataFrame) -> DataFrame:
    counts = confusion(predictions)
    return counts.select(
        YEAR, "tp", "fp", "fn", "tn", *[c.alias(n) for n, c in classification_columns().items()]
    )


def brier_metrics(predictions: DataFrame) -> DataFrame:
    """Brier score, that of the yearly base rate, and the skill over it."""
    y = F.col(LABEL).cast("double")
    scores = predictions.groupBy(calendar_year(F.col(YEAR)).alias(YEAR)).agg(
        F.count(F.lit(1)).alias("test_n"),
        F.coalesce(F.sum(LABEL), F.lit(0)).cast("long").alias("test_fraud_n"),
        F.avg(F.pow(F.col(SCORE) - y, F.lit(2))).alias("brier_score"),
        F.avg(y).alias("_rate"),
    )
    naive = F.col("_rate") * (1 - F.col("_rate"))
    return scores.select(
        YEAR,
        "test_n",
        "test_fraud_n",
        "brier_score",
        naive.alias("naive_brier_score"),
        F.when(naive != 0, 1 - F.col("brier_score") / naive).alias("brier_skill_score"),
    )


def _review_size(rows: Column) -> Column:
    """ceil of the review share in integer arithmetic, at least 1."""
    return F.greatest(F.lit(1), F.floor((rows * fv.REVIEW_PERCENT + 99) / 100))


def queue_cutoffs(predictions: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Per year: the score and row id at which the review queue ends.

    The queue holds every row above `cut_score` and, of the rows on it, those up to
    `cut_row`. Only rows tied on the cut score are ranked by row id, again distributed.
    """
    ranked = cut_lineage(ranked_scores(predictions)) if ranked is None else ranked
    totals = ranked.groupBy(YEAR).agg(
        F.sum("n").alias("_rows"), F.sum("pos").alias("positives")
    )
    size = _review_size(F.col("_rows"))
    cut = (
        ranked.join(F.broadcast(totals), YEAR)
        .withColumn("review_n", size)
        .where((F.col("n_upto") >= F.col("review_n")) & (F.col("n_upto") - F.col("n") < F.col("review_n")))
        .select(
            YEAR,
            F.col("score").alias("cut_score"),
            "review_n",
            "positives",
            (F.col("pos_upto") - F.col("pos")).alias("above_positives"),
            (F.col("review_n") - (F.col("n_upto") - F.col("n"))).alias("needed"),
        )
    )
    cut = cut_lineage(cut)
    tied = cut_lineage(
        predictions.select(YEAR, ROW, F.col(LABEL).cast("long").alias("pos"), SCORE)
        .join(F.broadcast(cut.select(YEAR, "cut_score")), YEAR)
        .where(F.col(SCORE) == F.col("cut_score"))
        .select(YEAR, ROW, "pos", F.lit(1).cast("long").alias("n"))
    )
    order = running_totals(tied, [YEAR], ROW, {"n_upto": "n"})
    taken = (
        order.join(F.broadcast(cut.select(YEAR, "needed")), YEAR)
        .where(F.col("n_upto") <= F.col("needed"))
        .groupBy(YEAR)
        .agg(F.max(ROW).alias("cut_row"), F.sum("pos").alias("_tied_positives"))
    )
    return cut.join(F.broadcast(taken), YEAR).select(
        YEAR,
        "cut_score",
        "cut_row",
        F.col("review_n").cast("long").alias("review_n"),
        "positives",
        (F.col("above_positives") + F.col("_tied_positives")).alias("found"),
    )


def review_metrics(predictions: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Queue size, and recall and precision of the top five percent."""
    return queue_cutoffs(predictions, ranked).select(
        YEAR,
        F.col("review_n").alias("review_n_at_5_percent"),
        safe_ratio(F.col("found"), F.col("positives")).alias("recall_at_5_percent"),
        safe_ratio(F.col("found"), F.col("review_n")).alias("precision_at_5_percent"),
    )


def review_queue(predictions: DataFrame) -> DataFrame:
    """The rows of every year's queue; ties are broken by row id."""
    cut = queue_cutoffs(predictions).select(YEAR, "cut_score", "cut_row")
    inside = (F.col(SCORE) > F.col("cut_score")) | (
        (F.col(SCORE) == F.col("cut_score")) & (F.col(ROW) <= F.col("cut_row"))
    )
    return predictions.join(F.broadcast(cut), YEAR).where(inside).drop("cut_score", "cut_row")


def calibration_bins(predictions: DataFrame, n_bins: int, edge_goes_up: bool) -> DataFrame:
    """Per non-empty (year, bin): rows, observed rate and mean score."""
    index = bin_index(F.col(SCORE), bin_edges(n_bins), edge_goes_up)
    return predictions.groupBy(calendar_year(F.col(YEAR)).alias(YEAR), index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(LABEL).cast("double")).alias("prob_true"),
        F.avg(SCORE).alias("prob_pred"),
    )


def error_of_bins(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("prob_true") - F.col("prob_pred"))
    return bins.groupBy(YEAR).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"),
        F.max(gap).alias("mce"),
    )


def calibration_error(predictions: DataFrame, n_bins: int = fv.CALIBRATION_BINS) -> DataFrame:
    """Expected and maximum calibration error; empty bins count nowhere."""
    return error_of_bins(calibration_bins(predictions, n_bins, edge_goes_up=True))


def reliability_curve(predictions: DataFrame, n_bins: int = fv.CALIBRATION_BINS) -> DataFrame:
    """Observed rate and mean score per non-empty bin; edges fall into the lower bin."""
    return calibration_bins(predictions, n_bins, edge_goes_up=False)


def compare_calibration(predictions: DataFrame, raw: str, calibrated: str) -> DataFrame:
    """Brier score per year before and after calibration; positive means improved."""
    y = F.col(LABEL).cast("double")
    scores = predictions.groupBy(calendar_year(F.col(YEAR)).alias(YEAR)).agg(
        F.avg(F.pow(F.col(raw) - y, F.lit(2))).alias("raw_brier_score"),
        F.avg(F.pow(F.col(calibrated) - y, F.lit(2))).alias("calibrated_brier_score"),
    )
    return scores.withColumn(
        "brier_improvement", F.col("raw_brier_score") - F.col("calibrated_brier_score")
    )


def threshold_candidates() -> list[float]:
    return [0.01 + i * 0.01 for i in range(99)]


def threshold_sweep(predictions: DataFrame) -> DataFrame:
    """F1 per year at every candidate threshold.

    Scores are binned to the highest candidate they reach, so at most 100 counts per year
    are left before the running sum.
    """
    thresholds = threshold_candidates()
    cuts = F.array(*[F.lit(t) for t in thresholds])
    guess = F.least(F.greatest(F.floor(F.col(SCORE) * 100).cast("int"), F.lit(1)), F.lit(99))
    reached = (
        F.when(F.element_at(cuts, guess) > F.col(SCORE), guess - 1)
        .when((guess < 99) & (F.element_at(cuts, F.least(guess + 1, F.lit(99))) <= F.col(SCORE)), guess + 1)
        .otherwise(guess)
    )
    binned = predictions.groupBy(
        calendar_year(F.col(YEAR)).alias(YEAR), reached.alias("reached")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(LABEL), F.lit(0)).cast("long").alias("pos"),
    )
    per_year = binned.groupBy(YEAR).agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("positives")
    )
    spine = per_year.select(
        YEAR, "rows", "positives", F.posexplode(cuts).alias("_pos", "threshold")
    ).withColumn("reached", F.col("_pos") + 1)
    above = Window.partitionBy(YEAR).orderBy(F.col("reached").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = (
        spine.join(binned, [YEAR, "reached"], "left")
        .withColumn("predicted", F.sum(F.coalesce("n", F.lit(0))).over(above))
        .withColumn("tp", F.sum(F.coalesce("pos", F.lit(0))).over(above))
    )
    hit = F.col("tp").cast("double")
    f1 = ratio_or_zero(2 * hit, F.col("predicted") + F.col("positives"))
    return counted.select(YEAR, "rows", "positives", "threshold", "predicted", "tp", f1.alias("f1"))


def best_threshold(
    validation: DataFrame,
    train: DataFrame | None = None,
    default: float = fv.DECISION_THRESHOLD,
) -> DataFrame:
    """First threshold with the best F1 per year; the default in a one-class year.

    The scores must come from a validation table. Passing the training table itself is
    refused, because a threshold tuned in sample is not a result.
    """
    if train is not None and (train is validation or train.sameSemantics(validation)):
        raise ValueError("threshold search needs validation scores apart from the training data")
    best = threshold_sweep(validation).groupBy(YEAR, "rows", "positives").agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("_best"),
        F.max("f1").alias("best_f1"),
    )
    one_class = (F.col("positives") == 0) | (F.col("positives") == F.col("rows"))
    return best.select(
        YEAR,
        F.when(one_class, F.lit(default)).otherwise(F.col("_best")).alias("threshold"),
        F.when(~one_class, F.col("best_f1")).alias("best_f1"),
    )


def fold_metrics(predictions: DataFrame, n_bins: int = fv.CALIBRATION_BINS) -> DataFrame:
    """The full metric row per year. Every joined table has one row per calendar year.

    All but the ties at the end of the review queue follows from one histogram of (year, score).
    """
    counts = score_histogram(predictions)
    ranked = cut_lineage(
        running_totals(counts, [YEAR], "score", {"n_upto": "n", "pos_upto": "pos"}, descending=True)
    )
    n, pos, score = F.col("n"), F.col("pos"), F.col("score")
    sums = counts.groupBy(YEAR).agg(
        F.sum(n).alias("test_n"),
        F.sum(pos).alias("test_fraud_n"),
        F.sum(pos * F.pow(score - 1, F.lit(2)) + (n - pos) * F.pow(score, F.lit(2))).alias("_squares"),
        F.sum("decided_pos").alias("tp"),
        F.sum(F.col("decided") - F.col("decided_pos")).alias("fp"),
        F.sum(pos - F.col("decided_pos")).alias("fn"),
        F.sum(n - pos - F.col("decided") + F.col("decided_pos")).alias("tn"),
    )
    rate = F.col("test_fraud_n") / F.col("test_n")
    totals = sums.withColumns(
        {"brier_score": F.col("_squares") / F.col("test_n"), "naive_brier_score": rate * (1 - rate)}
    ).withColumn(
        "brier_skill_score",
        F.when(F.col("naive_brier_score") != 0, 1 - F.col("brier_score") / F.col("naive_brier_score")),
    ).select("*", *[c.alias(name) for name, c in classification_columns().items()])
    index = bin_index(score, bin_edges(n_bins), True)
    bins = counts.groupBy(YEAR, index.alias("bin")).agg(
        F.sum(n).alias("n"), (F.sum(pos) / F.sum(n)).alias("prob_true"), (F.sum(score * n) / F.sum(n)).alias("prob_pred")
    )
    tables = [totals, ranking_metrics(predictions, ranked), review_metrics(predictions, ranked), error_of_bins(bins)]
    joined = reduce(lambda a, b: a.join(F.broadcast(b), YEAR), tables)
    return joined.select(
        YEAR, "test_n", "test_fraud_n", *fv.METRICS, "review_n_at_5_percent", "ece", "mce"
    )


def metric_summary(folds: DataFrame, metrics=fv.METRICS) -> DataFrame:
    """Mean and population standard deviation over folds; undefined folds are skipped."""
    clean = folds.select(*[nan_to_null(F.col(m).cast("double")).alias(m) for m in metrics])
    stats = clean.agg(
        *[F.struct(F.avg(m).alias("mean"), F.stddev_pop(m).alias("std")).alias(m) for m in metrics]
    )
    return stats.unpivot([], list(metrics), "metric", "stats").select(
        "metric",
        F.bround("stats.mean", 6).alias("mean"),
        F.bround("stats.std", 6).alias("std"),
    )


def calibration_summary(folds: DataFrame) -> DataFrame:
    """One row: calibrated and raw Brier over folds, and how many folds improved."""
    gain = F.col("raw_brier_score") - F.col("brier_score")
    stats = []
    for name, column in (
        ("brier_calibrated", F.col("brier_score")),
        ("brier_raw", F.col("raw_brier_score")),
        ("ece", F.col("ece")),
        ("mce", F.col("mce")),
        ("brier_improvement", gain),
    ):
        value = nan_to_null(column)
        stats += [
            F.bround(F.avg(value), 6).alias(f"{name}_mean"),
            F.bround(F.stddev_pop(value), 6).alias(f"{name}_std"),
        ]
    return folds.agg(
        F.count(F.lit(1)).alias("n_calibrated_folds"),
        *stats,
        F.count_if(gain > 0).alias("folds_improved"),
        F.count_if(gain < 0).alias("folds_worsened"),
    )


def describe_scores(predictions: DataFrame, by_label: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles and max of the scores, overall or per class."""
    groups = [LABEL] if by_label else []
    moments = predictions.groupBy(*groups).agg(
        F.count(SCORE).alias("count"),
        F.avg(SCORE).alias("mean"),
        F.stddev_samp(SCORE).alias("std"),
        F.min(SCORE).alias("min"),
        F.max(SCORE).alias("max"),
    )
    quartiles = exact_quantiles(predictions, groups, SCORE, (0.25, 0.5, 0.75))
    if groups:
        # One row per class.
        joined = moments.join(F.broadcast(quartiles), groups)
    else:
        joined = moments.withColumn("quantiles", quartiles.scalar())
    return joined.select(
        *groups,
        "count", "mean", "std", "min",
        F.element_at("quantiles", 1).alias("q25"),
        F.element_at("quantiles", 2).alias("q50"),
        F.element_at("quantiles", 3).alias("q75"),
        "max",
    )


def score_quantiles(predictions: DataFrame, probabilities=fv.SCORE_QUANTILES) -> DataFrame:
    values = exact_quantiles(predictions, [], SCORE, probabilities)
    pairs = F.arrays_zip(
        F.array(*[F.lit(float(p)) for p in probabilities]).alias("quantile"),
        F.col("quantiles").alias("score"),
    )
    return values.select(F.explode(pairs).alias("q")).select(
        F.col("q.quantile").alias("quantile"), F.col("q.score").alias("score")
    )


def counts_at_thresholds(predictions: DataFrame, thresholds=fv.COUNT_THRESHOLDS) -> DataFrame:
    """Rows scored at or above each threshold, in one pass."""
    counts = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count_if(F.col(SCORE) >= F.lit(float(t))).alias("predicted_positives"),
        )
        for t in thresholds
    ]
    return predictions.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def combine_predictions(fragments: list[DataFrame]) -> DataFrame:
    return union_all(fragments)
