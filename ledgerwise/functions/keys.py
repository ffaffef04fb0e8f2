"""Company keys, record ids and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions.dates import iso_date
from ledgerwise.functions.text import strip


def zero_fill(value: Column, width: int = 10) -> Column:
    """Pad on the left; longer values stay whole (lpad alone would cut them)."""
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


def _drop_decimal(value: Column) -> Column:
    return F.regexp_replace(value, r"\.0\z", "")


def company_key(value: Column) -> Column:
    """Trimmed, without a trailing `.0`, ten digits wide; NULL becomes ''."""
    return F.coalesce(zero_fill(_drop_decimal(strip(value.cast("string")))), F.lit(""))


def company_key_digits(value: Column) -> Column:
    """First run of digits, ten wide; NULL when there is none."""
    digits = F.regexp_extract(value.cast("string"), r"(\d+)", 1)
    return zero_fill(F.nullif(digits, F.lit("")))


def record_identifier(fields: tuple[str, ...] = fv.FILING_ID_FIELDS) -> Column:
    """Struct of the trimmed identifier parts; a missing part is ''."""
    parts = [
        F.coalesce(strip(F.col(name).cast("string")), F.lit("")).alias(name) for name in fields
    ]
    return F.struct(*parts)


def is_complete_identifier(identifier: Column, fields=fv.FILING_ID_FIELDS) -> Column:
    complete = F.lit(True)
    for name in fields:
        complete = complete & (identifier[name] != "")
    return complete


def type_code(value: Column) -> Column:
    return F.upper(strip(value))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with keys in alphabetical order. Fields must not be NULL."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered))


def sha256_json(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def stable_filing_id(
    cik: Column, filing_date: Column, reporting_date: Column, filing_type: Column
) -> Column:
    """SHA-256 id that does not depend on date style, case or key padding."""
    return sha256_json(
        cik=zero_fill(_drop_decimal(cik.cast("string"))),
        filing_date=iso_date(filing_date),
        reporting_date=iso_date(reporting_date),
        filing_type=type_code(filing_type),
    )


def schema_hash(columns: tuple[str, ...]) -> Column:
    """SHA-256 of the ordered column list as a JSON array."""
    return F.sha2(F.to_json(F.array(*[F.lit(name) for name in columns])), 256)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, fingerprint) that ignores row order but counts copies.

    A row is written as JSON with its NULLs and hashed with SHA-256. The four quarters of the row
    hashes are summed as decimals, so partial sums combine in any order.
    """
    row = F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]), {"ignoreNullFields": "false"})
    digest = F.sha2(row, 256)

    def total(quarter: int) -> Column:
        number = F.conv(F.substring(digest, 16 * quarter + 1, 16), 16, 10).cast("decimal(20,0)")
        return F.coalesce(F.sum(number).cast("string"), F.lit("0"))

    rows = F.count(F.lit(1))
    whole = F.concat_ws(":", F.lit(",".join(df.columns)), rows.cast("string"), *[total(k) for k in range(4)])
    return df.agg(rows.alias("rows"), F.sha2(whole, 256).alias("fingerprint"))
