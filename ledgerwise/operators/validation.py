"""Row-level validation of raw records, with one summary per data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions import dates, keys, text
from ledgerwise.scale import flag_later_copies, union_all


def is_empty_record(fields) -> Column:
    """Every field is missing."""
    empty = F.lit(True)
    for name in fields:
        empty = empty & text.is_missing(F.col(f"`{name}`").cast("string"))
    return empty


def missing_fields(fields) -> Column:
    """Array of `missing_<field>` for the required fields without a value."""
    return F.array_compact(
        F.array(
            *[
                F.when(text.is_missing(F.col(f"`{name}`").cast("string")), F.lit(f"missing_{name}"))
                for name in sorted(fields)
            ]
        )
    )


def _errors(empty: Column, empty_name: str, checks: list[tuple[Column, str]], required) -> Column:
    """Empty records carry one error; others all that apply, in a fixed order."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in checks]))
    return F.when(empty, F.array(F.lit(empty_name))).otherwise(
        F.concat(missing_fields(required), found)
    )


def filing_errors(filings: DataFrame, seq: str = "seq") -> DataFrame:
    """Add `errors`: every rule a filing record breaks."""
    fields = [c for c in fv.FILING_COLUMNS if c in filings.columns]
    identifier = keys.record_identifier()
    flagged = flag_later_copies(
        filings, identifier, keys.is_complete_identifier(identifier), seq, "_repeated"
    )
    checks = [
        (~dates.is_strict_date(F.col("filing_date"), "dd-MM-yyyy"), "malformed_filing_date"),
        (~dates.is_strict_date(F.col("reporting_date"), "dd-MM-yyyy"), "malformed_reporting_date"),
        (~has_valid_type(F.col("filing_type")), "invalid_filing_type"),
        (F.col("_repeated"), "duplicate_filing"),
    ]
    errors = _errors(is_empty_record(fields), "empty_record", checks, fv.REQUIRED_FILING_FIELDS)
    return flagged.withColumn("errors", errors).drop("_repeated")


def has_valid_type(filing_type: Column) -> Column:
    """Trimmed code is on the list; case matters."""
    return F.coalesce(text.strip(filing_type).isin(*fv.VALID_FILING_TYPES), F.lit(False))


def label_errors(labels: DataFrame, seq: str = "seq") -> DataFrame:
    """Add `errors` for label records: no date or type rules."""
    fields = [c for c in fv.FILING_COLUMNS if c in labels.columns]
    identifier = keys.record_identifier()
    flagged = flag_later_copies(
        labels, identifier, keys.is_complete_identifier(identifier), seq, "_repeated"
    )
    errors = _errors(
        is_empty_record(fields),
        "empty_record",
        [(F.col("_repeated"), "duplicate_identifier")],
        fv.REQUIRED_FILING_FIELDS,
    )
    return flagged.withColumn("errors", errors).drop("_repeated")


def enforcement_errors(
    rows: DataFrame, fields, overflow: str = "_overflow", seq: str = "seq"
) -> DataFrame:
    """Add `errors` for delimited rows; a value past the last column is malformed."""
    row_id = F.coalesce(text.strip(F.col("id")), F.lit(""))
    flagged = flag_later_copies(rows, row_id, row_id != "", seq, "_repeated")
    empty = is_empty_record(fields) & F.col(overflow).isNull()
    checks = [
        (F.col("_repeated"), "duplicate_id"),
        (~dates.is_strict_date(F.col("fraud_start"), "MM-yyyy"), "malformed_fraud_start"),
        (~dates.is_strict_date(F.col("fraud_end"), "MM-yyyy"), "malformed_fraud_end"),
    ]
    malformed = F.when(F.col(overflow).isNotNull(), F.array(F.lit("malformed_row"))).otherwise(
        F.array().cast("array<string>")
    )
    errors = _errors(empty, "empty_row", checks, fv.REQUIRED_ENFORCEMENT_FIELDS)
    return flagged.withColumn(
        "errors", F.when(empty, errors).otherwise(F.concat(malformed, errors))
    ).drop("_repeated")


def _with_error(prefix: str) -> Column:
    hits = F.size(F.filter("errors", lambda e: e.startswith(prefix)))
    return F.coalesce(F.sum(hits), F.lit(0))


def dataset_summary(checked: DataFrame, dataset: str, required) -> DataFrame:
    """One row of counters over the `errors` arrays of a data set."""
    has = lambda error: F.count_if(F.array_contains("errors", error))
    empty = has("empty_record") + has("empty_row")
    return checked.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.size("errors") == 0).alias("valid_records"),
        F.count_if(F.size("errors") > 0).alias("invalid_records"),
        empty.alias("empty_records"),
        (has("duplicate_filing") + has("duplicate_identifier")).alias("duplicate_identifiers"),
        has("duplicate_id").alias("duplicate_ids"),
        has("duplicate_filing").alias("duplicate_filings"),
        has("invalid_filing_type").alias("invalid_filing_types"),
        _with_error("malformed_f").alias("_fraud_or_filing"),
        _with_error("malformed_reporting").alias("_reporting"),
        has("malformed_row").alias("malformed_rows"),
        F.to_json(
            F.struct(*[has(f"missing_{name}").alias(name) for name in sorted(required)])
        ).alias("missing_values"),
    ).select(
        F.lit(dataset).alias("dataset"),
        "total_records", "valid_records", "invalid_records", "empty_records",
        "duplicate_identifiers", "duplicate_ids", "duplicate_filings", "invalid_filing_types",
        (F.col("_fraud_or_filing") + F.col("_reporting")).alias("malformed_dates"),
        "malformed_rows", "missing_values",
        F.lit(",".join(sorted(set(checked.columns) - {"errors", "seq", "_overflow"}))).alias(
            "schema_fields"
        ),
        F.lit(
            ",".join(sorted(set(required) - set(checked.columns)))
        ).alias("required_missing"),
    )


def totals_rollup(summaries: list[DataFrame]) -> DataFrame:
    """Totals per data set and a grand total (dataset 'all')."""
    return (
        union_all(summaries)
        .rollup("dataset")
        .agg(
            F.sum("total_records").alias("total_records"),
            F.sum("valid_records").alias("valid_records"),
            F.sum("invalid_records").alias("invalid_records"),
        )
        .withColumn("dataset", F.coalesce("dataset", F.lit("all")))
    )


def orphans(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """Distinct keys of the left table that the right table does not have."""
    return _key_set(left, key).join(_key_set(right, key), "key", "left_anti")


def _key_set(df: DataFrame, key: Column) -> DataFrame:
    return df.select(key.alias("key")).distinct()


def key_overlap(sources: dict[str, DataFrame], key: Column) -> DataFrame:
    """One row: unique keys per source, pairwise overlaps and both differences.

    All sources are grouped together by key once; blank keys are ignored.
    """
    names = list(sources)
    tagged = union_all(
        [
            df.select(text.strip(key.cast("string")).alias("key"), F.lit(n).alias("source"))
            for n, df in sources.items()
        ]
    ).where(F.col("key") != "")
    per_key = tagged.groupBy("key").agg(
        *[F.max(F.col("source") == n).alias(n) for n in names]
    )
    out = [F.count_if(F.col(n)).alias(f"{n}_unique") for n in names]
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            out += [
                F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}_overlap"),
                F.count_if(F.col(a) & ~F.col(b)).alias(f"{a}_not_in_{b}"),
                F.count_if(~F.col(a) & F.col(b)).alias(f"{b}_not_in_{a}"),
            ]
    return per_key.agg(*out)
