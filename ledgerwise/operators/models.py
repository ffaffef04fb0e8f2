"""Walk-forward models: linear ones of Spark ML, and boosted trees that grow for all folds in step.

The driver loops over folds, which are calendar years; fitting and scoring of each fold
are Spark jobs. The feature table is written once before the loop, so folds do not repeat
the text work and lost executors do not restart it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions import keys
from ledgerwise.functions.numbers import differing_keys
from ledgerwise.operators import boosting, contracts, folds, metrics
from ledgerwise.operators import calibration as calibration_maps
from ledgerwise.scale import cut_lineage, running_totals, union_all, written

YEAR, ROW, LABEL = "filing_year", "row_id", "label"
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Estimator:
    """How to build an unfitted pipeline for a training table of a given size.

    `weigh` adds the `weight` column that the pipeline uses, if it uses one.
    """

    features: tuple[str, ...]
    build: Callable[[int], Pipeline]
    weigh: Callable[[DataFrame], DataFrame] | None = None


def model_table(df: DataFrame, features, label: str, year: str, row_id: str) -> DataFrame:
    """Row id, year, label and features without gaps: written once, partitioned by year.

    A fold then reads only its own years.
    """
    slim = df.select(
        F.col(row_id).alias(ROW),
        F.col(year).alias(YEAR),
        F.col(label).cast("double").alias(LABEL),
        *features,
    )
    stored = written(slim, "model-table", YEAR, ROW)
    contracts.validate_target(stored.drop(ROW), features, LABEL)
    return contracts.fill_missing(stored, features)


def _assembler(features) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="raw_features")


def logistic(
    features, c: float = 1.0, max_iter: int = 1000, balanced: bool = False
) -> Estimator:
    """Standardized, L2-penalized logistic regression; `c` is the inverse penalty."""

    def build(rows: int) -> Pipeline:
        scaler = StandardScaler(
            inputCol="raw_features", outputCol="features", withMean=True, withStd=True
        )
        model = LogisticRegression(
            featuresCol="features", labelCol=LABEL, regParam=1.0 / (c * max(rows, 1)),
            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-6,
        )
        if balanced:
            model = model.setWeightCol("weight")
        return Pipeline(stages=[_assembler(features), scaler, model])

    return Estimator(tuple(features), build, balanced_weights if balanced else None)


@dataclass(frozen=True)
class Boosted:
    """Second-order boosted trees with the given parameters (`boosting.TREE_DEFAULTS` for the others)."""

    features: tuple[str, ...]
    parameters: dict
    seed: int = 42

    def fits(self, befores: list[int | None]) -> list[boosting.Fit]:
        return [boosting.Fit(before, self.parameters, self.seed) for before in befores]


def boosted_trees(features, seed: int = 42, **overrides) -> Boosted:
    boosting.validate_parameters({**boosting.TREE_DEFAULTS, **overrides})
    return Boosted(tuple(features), overrides, seed)


def balanced_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Add `weight` = rows / (2 * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_class_rows"))
    total = counts.agg(F.sum("_class_rows")).scalar()
    # Two classes: the broadcast has two rows.
    return df.join(F.broadcast(counts), label).withColumn(
        "weight", total / (F.lit(2.0) * F.col("_class_rows"))
    ).drop("_class_rows")


def prior_predictions(
    df: DataFrame, year: str, label: str, row_id: str, min_positives: int
) -> DataFrame:
    """Baseline: every test row gets the prevalence of all earlier years."""
    fold_table = folds.walk_forward_folds(df, year, label, min_positives).select(
        "test_year", (F.col("train_positives") / F.col("train_n")).alias("predicted_probability")
    )
    rows = df.select(
        F.col(year).alias("test_year"), F.col(row_id).alias("row_id"),
        F.col(label).cast("int").alias("true_label"),
    )
    return rows.join(F.broadcast(fold_table), "test_year")


def _fit(estimator: Estimator | Boosted, train: DataFrame) -> PipelineModel | boosting.Booster:
    if isinstance(estimator, Boosted):
        return boosting.fit_boosters(train, estimator.features, estimator.fits([None]))[0]
    weighted = estimator.weigh(train) if estimator.weigh else train
    return estimator.build(train.count()).fit(weighted)


def _score(model: PipelineModel | boosting.Booster, df: DataFrame) -> DataFrame:
    """(row_id, filing_year, label, score) with the probability of the positive class."""
    if isinstance(model, boosting.Booster):
        return boosting.scored(df, model)
    return model.transform(df).select(
        ROW, YEAR, LABEL, vector_to_array("probability")[1].alias("score")
    )


def _margin(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(row_id, filing_year, label, score) with the log-odds of a linear model."""
    return model.transform(df).select(
        ROW, YEAR, LABEL, vector_to_array("rawPrediction")[1].alias("score")
    )


def has_both_classes(df: DataFrame, label: str = LABEL) -> bool:
    row = df.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
    return row.low is not None and row.low != row.high


def fit_mapper(scores: DataFrame, method: str) -> Scorer:
    """Learn score -> probability: 'sigmoid' or 'isotonic' (clipped outside its range).

    Equal scores are merged into one weighted row per label first.
    """
    merged = scores.groupBy("score", LABEL).agg(F.count(F.lit(1)).cast("double").alias("w"))
    vectorize = VectorAssembler(inputCols=["score"], outputCol="score_vector")
    if method == "sigmoid":
        rows = scores.count()
        model = LogisticRegression(
            featuresCol="score_vector", labelCol=LABEL, weightCol="w",
            regParam=1.0 / (1e6 * max(rows, 1)), standardization=False, maxIter=200, tol=1e-9,
        ).fit(vectorize.transform(merged))
        return lambda df: model.transform(vectorize.transform(df)).select(
            *df.columns, vector_to_array("probability")[1].alias("calibrated")
        )
    if method == "isotonic":
        return calibration_maps.isotonic_map(calibration_maps.score_counts(scores, LABEL))
    raise ValueError(f"no such way to map scores: {method}")


def fit_scorer(
    estimator: Estimator,
    train: DataFrame,
    calibration: str | None = None,
    method: str = "sigmoid",
    cv: int = 5,
    holdout_fraction: float = fv.CALIBRATION_HOLDOUT,
) -> Scorer:
    """Fit on a training table and return a function that adds a `score` column.

    calibration: None, 'chronological_holdout' (map from the latest years, then refit on
    everything) or 'cross_validation' (mean over k models, each with a map of its margins on the
    fold it has not seen, with smoothed targets). Without both
    classes where they are needed, scores stay uncalibrated.
    """
    if isinstance(estimator, Boosted):
        return boosted_scorers(estimator, train, [None], calibration, method, holdout_fraction)[0]
    if calibration is None:
        model = _fit(estimator, train)
        return lambda df: _score(model, df)
    if calibration == "chronological_holdout":
        early, late = folds.split_for_calibration(train, YEAR, holdout_fraction)
        if not (has_both_classes(early) and has_both_classes(late)):
            return fit_scorer(estimator, train)
        mapper = fit_mapper(_score(_fit(estimator, early), late), method)
        full = _fit(estimator, train)
        return lambda df: _calibrated(mapper(_score(full, df)))
    if calibration == "cross_validation":
        return _cross_validated(estimator, train, method, cv)
    raise ValueError(f"no such calibration: {calibration}")


def boosted_scorers(
    estimator: Boosted,
    table: DataFrame,
    befores: list[int | None],
    calibration: str | None = None,
    method: str = "sigmoid",
    holdout_fraction: float = fv.CALIBRATION_HOLDOUT,
) -> list[Scorer]:
    """As `fit_scorer` on the rows of years before each of `befores` (all rows, if None).

    All models grow together, also those that are only fitted to make calibration maps.
    """
    if calibration not in (None, "chronological_holdout"):
        raise ValueError(f"boosted trees have no such calibration: {calibration}")
    # One row per calendar year.
    years = sorted(folds.year_table(table, YEAR, LABEL).collect(), key=lambda r: r.year)
    starts: dict[int | None, int] = {}
    for before in befores if calibration else []:
        own = [r for r in years if before is None or r.year < before]
        start = folds.late_start([(r.year, r.rows) for r in own], holdout_fraction)
        parts = [r for r in own if r.year < start], [r for r in own if r.year >= start]
        if all(0 < sum(r.positives for r in part) < sum(r.rows for r in part) for part in parts):
            starts[before] = start
    wanted = list(dict.fromkeys([*befores, *starts.values()]))
    boosters = dict(zip(wanted, boosting.fit_boosters(table, estimator.features, estimator.fits(wanted))))

    def scorer(before: int | None) -> Scorer:
        booster = boosters[before]
        if before not in starts:
            return lambda df: boosting.scored(df, booster)
        late = table.where(F.col(YEAR) >= starts[before])
        late = late if before is None else late.where(F.col(YEAR) < before)
        mapper = fit_mapper(boosting.scored(late, boosters[starts[before]]), method)
        return lambda df: _calibrated(mapper(boosting.scored(df, booster)))

    return _at_once(table.sparkSession, scorer, befores, 4)


def _calibrated(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.col("calibrated")).drop("calibrated")


def stratified_folds(df: DataFrame, k: int, label: str = LABEL, row_id: str = ROW) -> DataFrame:
    """Add `fold`: in row order, each class is cut into k runs of nearly equal length.

    Classes are laid end to end, the class of the first row first, and places are dealt to folds in
    turn; how many places a class gets in a fold is how long its run in that fold is.
    """
    numbered = running_totals(
        cut_lineage(df.withColumn("_one", F.lit(1))), [label], row_id, {"_rank": "_one"}
    )
    # One row for each of the classes of a classifier.
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first"))
    fold, offset = F.lit(None).cast("int"), 0
    for row in classes.orderBy("first").collect():
        places = [offset + i for i in range(k)]
        runs = [0] * k
        for at in places:
            runs[at % k] = len(range(at, offset + row.n, k))
        ends = [sum(runs[: i + 1]) for i in range(k)]
        passed = [(F.col("_rank") > end).cast("int") for end in ends[:-1]]
        own = reduce(lambda a, b: a + b, passed, F.lit(0))
        fold = F.when(F.col(label) == row[label], own).otherwise(fold)
        offset += row.n
    return numbered.withColumn("fold", fold).drop("_one", "_rank")


def _cross_validated(estimator: Estimator, train: DataFrame, method: str, cv: int) -> Scorer:
    if cv < 2:
        raise ValueError("cv must be at least 2")
    sizes = [r["count"] for r in train.groupBy(LABEL).count().collect()]
    k = min(cv, *sizes) if len(sizes) == 2 else 0
    if k < 2:
        return fit_scorer(estimator, train)
    dealt = cut_lineage(stratified_folds(train, k))

    def fit_part(fold: int):
        model = _fit(estimator, dealt.where(F.col("fold") != fold).drop("fold"))
        counts = calibration_maps.score_counts(_margin(model, dealt.where(F.col("fold") == fold)), LABEL)
        kinds = {"sigmoid": calibration_maps.sigmoid_map, "isotonic": calibration_maps.isotonic_map}
        return model, kinds[method](counts)

    parts = _at_once(train.sparkSession, fit_part, list(range(k)), k)

    def score(df: DataFrame) -> DataFrame:
        all_models = union_all([mapper(_margin(model, df)) for model, mapper in parts])
        return all_models.groupBy(ROW, YEAR, LABEL).agg(F.avg("calibrated").alias("score"))

    return score


def _at_once(spark: SparkSession, function, items: list, parallelism: int) -> list:
    """Submit the Spark jobs of several independent fits at the same time."""
    if not items:
        return []
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(function), items)


def walk_forward(
    table: DataFrame,
    estimator: Estimator,
    min_positives: int = fv.MIN_POSITIVES_PER_FOLD,
    threshold: float = fv.DECISION_THRESHOLD,
    raw_reference: bool = False,
    min_train_years: int = 1,
    parallelism: int = 4,
    **calibration,
) -> DataFrame:
    """Predictions of every fold, fitted on earlier years only.

    Chronological calibration needs two training years, so folds can be asked to have them.

    With `raw_reference`, an uncalibrated model is fitted too and its score is kept in
    `raw_probability`. Folds whose training years have one class are skipped.
    """
    # One row per calendar year.
    years = sorted(r[YEAR] for r in table.select(YEAR).distinct().collect())
    usable = [
        fold
        for fold in folds.walk_forward_folds(table, YEAR, LABEL, min_positives).orderBy("test_year").collect()
        if 0 < fold.train_positives < fold.train_n and sum(y < fold.test_year for y in years) >= min_train_years
    ]

    def fit_fold(fold) -> tuple[Scorer, ...]:
        train = table.where(F.col(YEAR) < fold.test_year)
        raw = (fit_scorer(estimator, train),) if raw_reference else ()
        return fit_scorer(estimator, train, **calibration), *raw

    if isinstance(estimator, Boosted):
        befores = [fold.test_year for fold in usable]
        kinds = [boosted_scorers(estimator, table, befores, **calibration)] if usable else []
        if raw_reference and usable:
            kinds.append(boosted_scorers(estimator, table, befores))
        fitted = list(zip(*kinds))
    else:
        # Folds are independent, so several are fitted at a time.
        fitted = _at_once(table.sparkSession, fit_fold, usable, parallelism)
    fragments = []
    for fold, (scorer, *raw) in zip(usable, fitted):
        test = table.where(F.col(YEAR) == fold.test_year)
        scored = scorer(test)
        if raw:
            plain = raw[0](test).select(ROW, F.col("score").alias("raw_probability"))
            scored = scored.join(plain, ROW)
        fragments.append(scored.withColumn("train_n", F.lit(fold.train_n)))
    if not fragments:
        raise ValueError("no fold has enough positives and earlier rows")
    predictions = metrics.combine_predictions(fragments).select(
        F.col(YEAR).alias(metrics.YEAR),
        F.col(ROW).alias(metrics.ROW),
        F.col(LABEL).cast("int").alias(metrics.LABEL),
        F.col("score").alias(metrics.SCORE),
        "train_n",
        *(["raw_probability"] if raw_reference else []),
    )
    return cut_lineage(metrics.apply_threshold(predictions, threshold))


def evaluated_folds(predictions: DataFrame) -> DataFrame:
    """Metric rows of a walk-forward run, with the raw Brier score when it was kept."""
    rows = metrics.fold_metrics(predictions)
    if "raw_probability" not in predictions.columns:
        return rows
    raw = metrics.compare_calibration(predictions, "raw_probability", metrics.SCORE)
    return rows.join(F.broadcast(raw.select(metrics.YEAR, "raw_brier_score")), metrics.YEAR)


def fit_full(table: DataFrame, estimator: Estimator | Boosted) -> PipelineModel | boosting.Booster:
    """A fresh model on all development rows. It holds no calibration map."""
    return _fit(estimator, table)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def feature_importances(model: boosting.Booster, kind: str = "gain") -> DataFrame:
    """Importance of every feature of fitted trees, largest first: 'gain', 'cover' or 'weight'."""
    spark = SparkSession.getActiveSession()
    rows = boosting.importances(model, kind)
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def linear_contributions(df: DataFrame, model: PipelineModel, features) -> DataFrame:
    """Exact contribution of each feature to the logit: coefficient times (x - mean) / std."""
    coefficients = model.stages[-1].coefficients.toArray()
    scaler = model.stages[1]
    means, spreads = scaler.mean.toArray(), scaler.std.toArray()
    return df.select(
        ROW,
        *[
            (
                F.lit(float(w)) * (F.col(name) - F.lit(float(m))) / F.lit(float(s) if s else 1.0)
            ).alias(name)
            for name, w, m, s in zip(features, coefficients, means, spreads)
        ],
    )


def _partners(df: DataFrame, features, seed: int) -> DataFrame:
    """Every row next to the features of another row, each row used once.

    Rows are numbered in row order and again in hash order, and joined by number.
    """
    table = cut_lineage(
        df.select(ROW, *features, F.xxhash64(F.lit(seed), F.col(ROW)).alias("_hash"))
        .withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    )
    by_row = running_totals(table.select(ROW, "_all", "_one"), ["_all"], ROW, {"_rank": "_one"})
    by_hash = running_totals(table, ["_all"], "_hash", {"_rank": "_one"})
    partner = by_hash.select("_rank", *[F.col(f).alias(f"{f}__other") for f in features])
    return by_row.select(ROW, "_rank").join(partner, "_rank").drop("_rank")


def permutation_importances(
    df: DataFrame, model: PipelineModel | boosting.Booster, features, seed: int = 42
) -> DataFrame:
    """Rise of the Brier score when one feature takes the values of other rows.

    Works for any model. All versions of the table are scored in one job per feature.
    """
    features = list(features)
    paired = cut_lineage(df.join(_partners(df, features, seed), ROW))
    gap = F.pow(F.col("score") - F.col(LABEL), F.lit(2))

    def brier(changed: str | None) -> float:
        rows = paired if changed is None else paired.withColumn(changed, F.col(f"{changed}__other"))
        return _score(model, rows).agg(F.avg(gap)).first()[0]

    scores = _at_once(df.sparkSession, brier, [None, *features], 4)
    rows = [(f, float(score - scores[0])) for f, score in zip(features, scores[1:])]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def score_holdout(
    development: DataFrame,
    holdout: DataFrame,
    estimator: Estimator,
    window: tuple[int, int],
    threshold: float = fv.DECISION_THRESHOLD,
    **calibration,
) -> tuple[DataFrame, DataFrame]:
    """Predictions and one metric row for a later window, at a fixed threshold.

    The model is rebuilt as in development: calibration map from the latest development
    years, then a refit on all of them. The whole window is one evaluation.
    """
    latest = development.agg(F.max(YEAR)).first()[0]
    test = holdout.where(F.col(YEAR).between(*window))
    if latest is None or latest >= window[0]:
        raise ValueError("development years must end before the hold-out window")
    calibration = {"calibration": "chronological_holdout", **calibration}
    scored = fit_scorer(estimator, development, **calibration)(test)
    predictions = cut_lineage(
        metrics.apply_threshold(
            scored.select(
                F.lit(window[1]).alias(metrics.YEAR),
                F.col(YEAR).alias("filing_year"),
                F.col(ROW).alias(metrics.ROW),
                F.col(LABEL).cast("int").alias(metrics.LABEL),
                F.col("score").alias(metrics.SCORE),
            ),
            threshold,
        )
    )
    summary = metrics.fold_metrics(predictions).drop(metrics.YEAR).withColumns(
        {
            "test_period": F.lit(f"{window[0]}-{window[1]}"),
            "decision_threshold": F.lit(float(threshold)),
            "threshold_tuned_on_test": F.lit(False),
        }
    )
    return predictions, summary


def artifact_contract(development: DataFrame, features, experiment: str) -> DataFrame:
    """One row: a string map of everything a stored candidate depends on."""
    entries = {
        "contract_version": F.lit(fv.EVALUATION_CONTRACT),
        "experiment_name": F.lit(experiment),
        "development_data": F.col("fingerprint"),
        "feature_schema": keys.schema_hash(tuple(features)),
        "calibration": F.lit(f"sigmoid:chronological_holdout:{fv.CALIBRATION_HOLDOUT}"),
        "selection": F.lit(f"{fv.CANDIDATE_REVIEW_SIZE}:{fv.SELECTION_RULE}"),
    }
    pairs = [part for name, value in entries.items() for part in (F.lit(name), value)]
    return keys.content_fingerprint(development).select(F.create_map(*pairs).alias("contract"))


def contract_mismatch(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: names of the contract entries that differ."""
    other = actual.select("contract").scalar()
    return expected.withColumn("_actual", other).select(
        differing_keys(F.col("contract"), F.col("_actual")).alias("differing")
    )


def require_same_contract(expected: DataFrame, actual: DataFrame) -> None:
    differing = contract_mismatch(expected, actual).first().differing
    if differing:
        raise RuntimeError("artifact contract mismatch: " + ", ".join(differing))
