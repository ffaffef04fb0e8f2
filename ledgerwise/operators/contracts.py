"""Checks that a table must pass before the next step may use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerwise.functions.numbers import nan_to_null


def require_columns(df: DataFrame, columns, name: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} misses required columns: {missing}")
    return df


def schema_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns that only one of two tables has. A difference warns, it does not fail."""
    rows = [(c, "left_only") for c in left.columns if c not in right.columns]
    rows += [(c, "right_only") for c in right.columns if c not in left.columns]
    return left.sparkSession.createDataFrame(sorted(rows), "column_name string, side string")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that break each rule; one pass for all rules."""
    return df.agg(
        *[F.count_if(F.coalesce(broken, F.lit(False))).alias(n) for n, broken in rules.items()]
    )


def enforce(df: DataFrame, rules: dict[str, Column], name: str = "table") -> DataFrame:
    """Return the table, or fail with the rules it breaks."""
    counts = violations(df, rules).first().asDict()
    broken = {rule: n for rule, n in counts.items() if n}
    if broken:
        raise ValueError(f"{name} breaks its contract: {broken}")
    return df


def to_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast to a fixed output schema, in its column order; absent columns become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def fill_missing(df: DataFrame, columns, value: float = 0.0) -> DataFrame:
    """NULL and NaN both become the value."""
    return df.withColumns(
        {c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(value)) for c in columns}
    )


def missing_value_count(df: DataFrame, columns) -> DataFrame:
    """One row: how many feature cells would be filled."""
    gaps = [nan_to_null(F.col(c).cast("double")).isNull().cast("long") for c in columns]
    return df.agg(F.coalesce(F.sum(sum(gaps[1:], gaps[0])), F.lit(0)).alias("missing_values"))


def target_report(df: DataFrame, features, label: str) -> DataFrame:
    """One row: null labels, label set, empty features and duplicate rows.

    Duplicates are found on a hash of the row after grouping by it, so copies combine on
    the map side.
    """
    features = list(features)
    row_hash = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    copies = df.select(
        row_hash.alias("_row"),
        F.col(label),
        *[nan_to_null(F.col(c).cast("double")).isNotNull().alias(c) for c in features],
    ).groupBy("_row").agg(
        F.count(F.lit(1)).alias("_n"),
        F.first(label).alias(label),
        *[F.first(c).alias(c) for c in features],
    )
    present = [F.max(F.col(c).cast("int")) for c in features]
    empty = [F.when(F.coalesce(p, F.lit(0)) == 0, F.lit(c)) for p, c in zip(present, features)]
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col(label).isNull(), F.col("_n"))), F.lit(0)).alias("null_labels"),
        F.count_if(~F.col(label).isin(0, 1)).alias("other_labels"),
        F.count_if(F.col(label) == 0).alias("_zeros"),
        F.count_if(F.col(label) == 1).alias("_ones"),
        F.concat_ws(",", *empty).alias("empty_features"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).select(
        "rows",
        "null_labels",
        (
            (F.col("other_labels") == 0) & (F.col("_zeros") > 0) & (F.col("_ones") > 0)
        ).alias("labels_are_binary"),
        "empty_features",
        "duplicate_rows",
    )


def validate_target(df: DataFrame, features, label: str) -> DataFrame:
    """Fail unless labels are exactly {0, 1}, never null, and no feature is empty. One pass, no shuffle of rows."""
    require_columns(df, [*features, label])
    y = F.col(label)
    row = df.agg(
        F.count_if(y.isNull()), F.count_if(~y.isin(0, 1)), F.count_if(y == 0), F.count_if(y == 1),
        *[F.count(nan_to_null(F.col(c).cast("double"))) for c in features],
    ).first()
    if row[0]:
        raise ValueError(f"{row[0]} rows have no label")
    if row[1] or not row[2] or not row[3]:
        raise ValueError("labels must be exactly 0 and 1")
    empty = [name for name, n in zip(features, row[4:]) if not n]
    if empty:
        raise ValueError(f"features without any value: {','.join(empty)}")
    return df


def probability_rules(label: str, score: str) -> dict[str, Column]:
    """Rules for calibration inputs: binary labels, finite scores in [0, 1]."""
    p = F.col(score)
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf")))
    return {
        "not_binary": F.col(label).isNull() | ~F.col(label).isin(0, 1),
        "not_finite": ~finite,
        "out_of_range": finite & ((p < 0) | (p > 1)),
    }


def validate_probabilities(df: DataFrame, label: str, score: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError("calibration inputs are empty")
    return enforce(df, probability_rules(label, score), "predictions")


def values_outside(df: DataFrame, column: str, allowed: tuple) -> DataFrame:
    """One row: is the value set a subset of the allowed set?

    Values are grouped first, so a repeated value costs one row per task.
    """
    distinct = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return distinct.agg(
        F.coalesce(F.sum(F.when(~F.col(column).isin(*allowed), F.col("_n"))), F.lit(0)).alias(
            "rows_outside"
        ),
        (F.count_if(~F.col(column).isin(*allowed)) == 0).alias("is_subset"),
    )
