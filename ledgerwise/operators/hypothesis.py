"""Hypothesis statistics over the features of two classes.

One aggregation yields the moments of every feature per class; everything else is
arithmetic on those few rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwise import fixed_values as fv
from ledgerwise.functions.numbers import nan_to_null, safe_ratio, student_t_p_value
from ledgerwise.scale import bracketed_quantiles


def class_moments(df: DataFrame, features, label: str) -> DataFrame:
    """(feature, label, n, mean, std, variance, min, max), without multiplying rows."""
    stats = []
    for name in features:
        value = nan_to_null(F.col(name).cast("double"))
        stats.append(
            F.struct(
                F.count(value).alias("n"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("std"),
                F.var_samp(value).alias("variance"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
            ).alias(name)
        )
    wide = df.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).agg(*stats)
    return wide.unpivot(["label"], list(features), "feature", "s").select(
        "feature", "label", "s.*"
    )


def descriptive_statistics(df: DataFrame, features, label: str) -> DataFrame:
    """Per feature and class: n, mean, std, median, min and max."""
    labelled = df.where(F.col(label).isin(0, 1)).select(F.col(label).alias("label"), *features)
    medians = bracketed_quantiles(labelled, ["label"], list(features), 0.5).unpivot(
        ["label"], list(features), "feature", "median"
    )
    # Two rows per feature on both sides.
    return class_moments(df, features, label).drop("variance").join(
        F.broadcast(medians), ["feature", "label"], "left"
    )


def correlation_matrix(df: DataFrame, features) -> DataFrame:
    """Pearson correlation of every ordered pair over the rows that have both values."""
    clean = df.select(*[nan_to_null(F.col(f).cast("double")).alias(f) for f in features])
    pairs = list(combinations(features, 2))
    stats = clean.agg(
        *[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)],
        *[F.corr(f, f).alias(f"_{i}") for i, f in enumerate(features)],
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells += [_cell(a, b, f"{i}"), _cell(b, a, f"{i}")]
    cells += [_cell(f, f, f"_{i}") for i, f in enumerate(features)]
    return stats.select(F.inline(F.array(*cells)))


def _cell(a: str, b: str, column: str) -> Column:
    return F.struct(
        F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{column}`").alias("correlation")
    )


def variance_inflation(df: DataFrame, features) -> DataFrame:
    """Variance inflation factors over the rows without gaps, largest first.

    Spark computes the correlations; the k by k matrix is inverted on the driver.
    """
    features = list(features)
    clean = df.select(*[nan_to_null(F.col(f).cast("double")).alias(f) for f in features]).dropna()
    pairs = list(combinations(range(len(features)), 2))
    row = clean.agg(*[F.corr(features[i], features[j]) for i, j in pairs]).first()
    matrix = np.eye(len(features))
    for (i, j), value in zip(pairs, row):
        matrix[i, j] = matrix[j, i] = np.nan if value is None else value
    try:
        factors = np.diag(np.linalg.inv(matrix))
    except np.linalg.LinAlgError:
        factors = np.full(len(features), np.inf)
    rows = [(f, float(v)) for f, v in zip(features, factors)]
    table = df.sparkSession.createDataFrame(rows, "feature string, vif double")
    return table.orderBy(F.desc("vif"), "feature")


def percent_difference(value: Column, base: Column) -> Column:
    return safe_ratio(value - base, base) * 100


def pooled_effect(n1, m1, v1, n0, m0, v0) -> Column:
    """Cohen's d; NULL with fewer than two rows in a class or without any spread."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / F.nullif(n1 + n0 - 2, F.lit(0)))
    return F.when((n1 >= 2) & (n0 >= 2), safe_ratio(m1 - m0, pooled))


def effect_band(d: Column) -> Column:
    size = F.abs(d)
    limit, name = fv.EFFECT_BANDS[0]
    band = F.when(size < limit, name)
    for limit, name in fv.EFFECT_BANDS[1:]:
        band = band.when(size < limit, name)
    return band.when(size.isNotNull(), fv.TOP_EFFECT_BAND)


def class_contrast(df: DataFrame, features, label: str) -> DataFrame:
    """Per feature: means of both classes, percent difference, Cohen's d, Welch t and df."""
    moments = class_moments(df, features, label)

    def of(cls: int, column: str) -> Column:
        return F.max(F.when(F.col("label") == cls, F.col(column)))

    sides = moments.groupBy("feature").agg(
        *[
            of(cls, c).alias(f"{c}{cls}")
            for cls in (1, 0)
            for c in ("n", "mean", "variance")
        ]
    )
    n1, m1, v1, n0, m0, v0 = (
        F.col(c).cast("double") for c in ("n1", "mean1", "variance1", "n0", "mean0", "variance0")
    )
    e1, e0 = v1 / F.nullif(n1, F.lit(0.0)), v0 / F.nullif(n0, F.lit(0.0))
    freedom = safe_ratio(
        F.pow(e1 + e0, F.lit(2)),
        safe_ratio(F.pow(e1, F.lit(2)), n1 - 1) + safe_ratio(F.pow(e0, F.lit(2)), n0 - 1),
    )
    d = pooled_effect(n1, m1, v1, n0, m0, v0)
    return sides.select(
        "feature",
        F.col("n1").alias("fraud_n"),
        F.col("n0").alias("clean_n"),
        m1.alias("mean_fraud"),
        m0.alias("mean_clean"),
        percent_difference(m1, m0).alias("diff_pct"),
        d.alias("cohens_d"),
        effect_band(d).alias("effect"),
        safe_ratio(m1 - m0, F.sqrt(e1 + e0)).alias("t_stat"),
        freedom.alias("df"),
    )


def holm(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """Holm step-down adjusted p-values. One row per test, so one window is enough."""
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.col(p).asc_nulls_last(), "feature")
    tested = F.count(p).over(everything)
    step = (tested - F.row_number().over(ordered) + 1) * F.col(p)
    running = F.max("_step").over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tests.withColumn("_step", step)
        .withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(running, F.lit(1.0))))
        .withColumn("significant_holm", F.col("p_holm") < fv.SIGNIFICANCE)
        .drop("_step")
    )


def hypothesis_tests(df: DataFrame, features, label: str) -> DataFrame:
    """Welch tests of every feature with Holm correction."""
    contrast = class_contrast(df, features, label)
    p_value = student_t_p_value(F.col("t_stat"), F.col("df"))
    return holm(contrast.withColumn("p_value", p_value))


def round_results(results: DataFrame) -> DataFrame:
    digits = {
        "mean_fraud": 6, "mean_clean": 6, "diff_pct": 1, "cohens_d": 3,
        "t_stat": 4, "p_value": 6, "p_holm": 6, "vif": 3,
    }
    return results.withColumns(
        {c: F.bround(c, d) for c, d in digits.items() if c in results.columns}
    )


def hypothesis_report(df: DataFrame, features, label: str) -> DataFrame:
    """One row: observations by class, tests and significant tests."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_observations"),
        F.count_if(F.col(label) == 1).alias("fraud_observations"),
        F.count_if(F.col(label) == 0).alias("clean_observations"),
    )
    tests = hypothesis_tests(df, features, label).agg(
        F.count(F.lit(1)).alias("features_tested"),
        F.count_if("significant_holm").alias("significant_features"),
    )
    both = tests.select(F.struct(*tests.columns)).scalar()
    return counts.withColumn("_t", both).select(*counts.columns, "_t.*")
