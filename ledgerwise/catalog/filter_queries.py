"""Projections, predicates and data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.catalog import views as v
from ledgerwise.catalog.registry import query
from ledgerwise.catalog.scalar_queries import _PHRASE_SUM, COMMON_PHRASES
from ledgerwise.functions import dates, text
from ledgerwise.operators import contracts, ingest, quality, split, validation

C = F.col

# The derived text filings are dated 1990 to 1999.
FIRST_YEAR = fv.FIRST_FILING_YEAR
# Orders are dated 1995 to 2001.
CUTOFF, WINDOW = 1999, (1997, 1999)

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def missing_sql(column: str) -> str:
    return f"({column} IS NULL OR trim({column}, {_WS}) = '')"


_FIELDS = ("cik", "name", "filing_type", "filing_date", "reporting_date", "fye", "mda")
_EMPTY = " AND ".join(missing_sql(c) for c in _FIELDS)
_MISSING = ", ".join(
    f"CASE WHEN {missing_sql(c)} THEN 'missing_{c}' END" for c in fv.REQUIRED_FILING_FIELDS
)
_TYPES = ", ".join(f"'{t}'" for t in fv.VALID_FILING_TYPES)


def strict_sql(column: str, style: str) -> str:
    shape, parse = {
        "day": (r"\d{2}-\d{2}-\d{4}", f"try_strptime(trim({column}), '%d-%m-%Y')"),
        "month": (r"\d{2}-\d{4}", f"try_strptime('01-' || trim({column}), '%d-%m-%Y')"),
    }[style]
    return (
        f"coalesce(regexp_full_match(trim({column}), '{shape}') AND {parse} IS NOT NULL, false)"
    )


@query(
    "column_projection_f3",
    views="period_source",
    sql="SELECT cik, fraud_start, fraud_end, certainty_start, certainty_end FROM period_source",
)
def _(spark, sf):
    periods = contracts.require_columns(v.period_source(spark, sf), fv.PERIOD_COLUMNS, "periods")
    return periods.select(*fv.PERIOD_COLUMNS)


@query(
    "schema_difference_f2",
    views="filings filings_b",
    sql="""SELECT 'extra' AS column_name, 'right_only' AS side,
           (SELECT count(*) FROM filings) AS left_rows, (SELECT count(*) FROM filings_b) AS right_rows""",
)
def _(spark, sf):
    left, right = v.filings(spark, sf), v.filings_b(spark, sf)
    count = F.count(F.lit(1)).alias("n")
    return contracts.schema_difference(left, right).select(
        "*",
        left.agg(count).select("n").scalar().alias("left_rows"),
        right.agg(count).select("n").scalar().alias("right_rows"),
    )


@query(
    "missing_or_blank_f4",
    views="raw_filings",
    sql=f"SELECT seq, {missing_sql('cik')} AS cik_missing, {missing_sql('name')} AS name_missing FROM raw_filings",
)
def _(spark, sf):
    return v.raw_filings(spark, sf).select(
        "seq",
        text.is_missing(C("cik")).alias("cik_missing"),
        text.is_missing(C("name")).alias("name_missing"),
    )


@query("empty_record_f5", views="raw_filings", sql=f"SELECT seq FROM raw_filings WHERE {_EMPTY}")
def _(spark, sf):
    return v.raw_filings(spark, sf).where(validation.is_empty_record(_FIELDS)).select("seq")


@query(
    "required_values_f6",
    views="raw_filings",
    sql=f"SELECT seq, concat_ws(',', {_MISSING}) AS errors FROM raw_filings",
)
def _(spark, sf):
    missing = validation.missing_fields(fv.REQUIRED_FILING_FIELDS)
    return v.raw_filings(spark, sf).select("seq", F.concat_ws(",", missing).alias("errors"))


@query(
    "strict_date_f7",
    views="raw_filings",
    sql=f"SELECT seq, {strict_sql('filing_date', 'day')} AS filed_ok, {strict_sql('reporting_date', 'day')} AS reported_ok FROM raw_filings",
)
def _(spark, sf):
    return v.raw_filings(spark, sf).select(
        "seq",
        dates.is_strict_date(C("filing_date"), "dd-MM-yyyy").alias("filed_ok"),
        dates.is_strict_date(C("reporting_date"), "dd-MM-yyyy").alias("reported_ok"),
    )


@query(
    "filing_type_domain_f8",
    views="filings",
    sql=f"SELECT seq, filing_type FROM filings WHERE trim(filing_type) IN ({_TYPES})",
)
def _(spark, sf):
    return v.filings(spark, sf).where(validation.has_valid_type(C("filing_type"))).select(
        "seq", "filing_type"
    )


_COMPLETE = " AND ".join(f"NOT {missing_sql(c)}" for c in fv.FILING_ID_FIELDS)
_IDENTITY = ", ".join(f"trim({c}, {_WS})" for c in fv.FILING_ID_FIELDS)
_REPEATED = (
    f"({_COMPLETE} AND row_number() OVER (PARTITION BY {_COMPLETE}, {_IDENTITY} ORDER BY seq) > 1)"
)

FILING_ERRORS_SQL = f"""
    SELECT seq, CASE WHEN {_EMPTY} THEN 'empty_record' ELSE concat_ws(',', {_MISSING},
        CASE WHEN NOT {strict_sql('filing_date', 'day')} THEN 'malformed_filing_date' END,
        CASE WHEN NOT {strict_sql('reporting_date', 'day')} THEN 'malformed_reporting_date' END,
        CASE WHEN NOT coalesce(trim(filing_type) IN ({_TYPES}), false) THEN 'invalid_filing_type' END,
        CASE WHEN {_REPEATED} THEN 'duplicate_filing' END) END AS errors
    FROM raw_filings"""


@query("filing_errors_f9", views="raw_filings", sql=FILING_ERRORS_SQL)
def _(spark, sf):
    return validation.filing_errors(v.raw_filings(spark, sf)).select(
        "seq", F.concat_ws(",", "errors").alias("errors")
    )


LABEL_ERRORS_SQL = f"""
    SELECT seq, CASE WHEN {_EMPTY} THEN 'empty_record' ELSE concat_ws(',', {_MISSING},
        CASE WHEN {_REPEATED} THEN 'duplicate_identifier' END) END AS errors
    FROM raw_filings"""


@query("label_errors_f10", views="raw_filings", sql=LABEL_ERRORS_SQL)
def _(spark, sf):
    return validation.label_errors(v.raw_filings(spark, sf)).select(
        "seq", F.concat_ws(",", "errors").alias("errors")
    )


ENFORCEMENT_FIELDS = ("id", "cik", "fraud_start", "fraud_end")
_ROW_MISSING = ", ".join(
    f"CASE WHEN {missing_sql(c)} THEN 'missing_{c}' END" for c in fv.REQUIRED_ENFORCEMENT_FIELDS
)
ENFORCEMENT_ERRORS_SQL = f"""
    SELECT seq, concat_ws(',', CASE WHEN _overflow IS NOT NULL THEN 'malformed_row' END, {_ROW_MISSING},
        CASE WHEN NOT {missing_sql('id')} AND row_number() OVER (PARTITION BY trim(id) ORDER BY seq) > 1
             THEN 'duplicate_id' END,
        CASE WHEN NOT {strict_sql('fraud_start', 'month')} THEN 'malformed_fraud_start' END,
        CASE WHEN NOT {strict_sql('fraud_end', 'month')} THEN 'malformed_fraud_end' END) AS errors
    FROM raw_enforcement"""


@query("enforcement_errors_f11", views="raw_enforcement", sql=ENFORCEMENT_ERRORS_SQL)
def _(spark, sf):
    checked = validation.enforcement_errors(v.raw_enforcement(spark, sf), ENFORCEMENT_FIELDS)
    return checked.select("seq", F.concat_ws(",", "errors").alias("errors"))


@query(
    "drop_incomplete_f12",
    views="raw_enforcement",
    sql=f"""SELECT seq, cik, {v.parse_month_sql('fraud_start')} AS fraud_start,
            last_day({v.parse_month_sql('fraud_end')}) AS fraud_end FROM raw_enforcement
            WHERE cik IS NOT NULL AND {v.parse_month_sql('fraud_start')} IS NOT NULL
              AND {v.parse_month_sql('fraud_end')} IS NOT NULL""",
)
def _(spark, sf):
    typed = v.raw_enforcement(spark, sf).select(
        "seq",
        "cik",
        dates.month_start(C("fraud_start")).alias("fraud_start"),
        dates.month_end(C("fraud_end")).alias("fraud_end"),
    )
    return ingest.drop_incomplete(typed)


@query(
    "inverted_intervals_f13",
    views="period_source typed_periods",
    sql="SELECT seq, cik, fraud_start, fraud_end FROM typed_periods WHERE fraud_start <= fraud_end",
)
def _(spark, sf):
    prepared = ingest.prepare_periods(v.period_source(spark, sf))
    return ingest.drop_inverted(prepared).select("seq", "cik", "fraud_start", "fraud_end")


_WORDS = f"len(regexp_extract_all(mda, '[{fv.WORD_CHARS}]+'))"


@query(
    "min_word_filter_f14",
    views="texts",
    sql=f"SELECT seq FROM texts WHERE {_WORDS} >= 200",
)
def _(spark, sf):
    return v.texts(spark, sf).where(quality.has_enough_words(C("mda"))).select("seq")


_REFERENCE = f"({_WORDS} < 200 AND {_PHRASE_SUM} >= 2)"


@query(
    "reference_only_f15",
    views="texts",
    sql=f"SELECT seq, {_REFERENCE} AS reference_only FROM texts",
)
def _(spark, sf):
    flag = text.is_reference_only(C("mda"), COMMON_PHRASES)
    return v.texts(spark, sf).select("seq", flag.alias("reference_only"))


_AMENDED = "upper(trim(filing_type)) IN ('10-K/A', '10-K405/A', '10-KT/A')"


@query(
    "amended_exclusion_f16",
    views="filings",
    sql=f"SELECT seq, filing_type FROM filings WHERE NOT {_AMENDED}",
)
def _(spark, sf):
    return v.filings(spark, sf).where(~quality.is_amended(C("filing_type"))).select(
        "seq", "filing_type"
    )


_EARLY = f"NOT coalesce(filing_year >= {FIRST_YEAR}, false)"


@query(
    "min_year_filter_f17",
    views="text_filings",
    sql=f"SELECT seq, filing_date FROM text_filings WHERE NOT ({_EARLY})",
)
def _(spark, sf):
    return v.text_filings(spark, sf).where(quality.filed_since(C("filing_date"))).select(
        "seq", "filing_date"
    )


QUALITY_FLAGS_SQL = f"""
    SELECT seq, {_REFERENCE} AS reference_only, ({_WORDS} < 200 AND NOT {_REFERENCE}) AS short_text,
           {_AMENDED} AS amended, {_EARLY} AS too_early,
           ({_WORDS} >= 200 AND NOT {_AMENDED} AND NOT ({_EARLY})) AS keep
    FROM text_filings"""


@query("quality_rules_f18", views="text_filings", sql=QUALITY_FLAGS_SQL)
def _(spark, sf):
    flags = quality.quality_flags(v.text_filings(spark, sf), phrases=COMMON_PHRASES)
    return flags.select("seq", "reference_only", "short_text", "amended", "too_early", "keep")


@query(
    "quality_recheck_f19",
    views="text_filings",
    sql=f"""SELECT count(*) FILTER ({_WORDS} < 200) AS short_text, count(*) FILTER ({_AMENDED}) AS amended,
            count(*) FILTER ({_EARLY}) AS too_early,
            count(*) FILTER ({_WORDS} >= 200 AND NOT {_AMENDED} AND NOT ({_EARLY})) AS rows_after_filter,
            0::BIGINT AS violations_after_filter FROM text_filings""",
)
def _(spark, sf):
    filings = v.text_filings(spark, sf)
    before = contracts.violations(filings, quality.output_rules())
    kept = quality.quality_filter(filings)
    after = contracts.violations(kept, quality.output_rules()).select(
        (C("short_text") + C("amended") + C("too_early")).alias("n")
    )
    rows = kept.agg(F.count(F.lit(1)).alias("n"))
    return before.select(
        "*",
        rows.scalar().alias("rows_after_filter"),
        after.scalar().alias("violations_after_filter"),
    )


_YEAR = "CAST(right(filing_date, 4) AS INTEGER)"


@query(
    "temporal_split_f20",
    views="filings",
    sql=f"SELECT seq, CASE WHEN {_YEAR} < {CUTOFF} THEN 'trainval' ELSE 'test' END AS dataset FROM filings",
)
def _(spark, sf):
    development, holdout = split.split_by_year(v.filings(spark, sf), CUTOFF)
    return (
        development.withColumn("dataset", F.lit("trainval"))
        .unionByName(holdout.withColumn("dataset", F.lit("test")))
        .select("seq", "dataset")
    )


_RAW_DAY = """coalesce(CASE WHEN regexp_full_match(filing_date, '\\d{2}-\\d{2}-\\d{4}') THEN year(try_strptime(filing_date, '%d-%m-%Y')) END,
    CASE WHEN regexp_full_match(filing_date, '\\d{4}-\\d{2}-\\d{2}') THEN year(try_strptime(filing_date, '%Y-%m-%d')) END)"""


@query(
    "split_completeness_f21",
    views="raw_filings",
    sql=f"""SELECT count(*) AS total_records, count(*) FILTER (y < {CUTOFF}) AS trainval_records,
            count(*) FILTER (y >= {CUTOFF}) AS test_records, count(*) FILTER (y IS NULL) AS lost_records,
            round_even(count(*) FILTER (y < {CUTOFF}) / count(*), 4) AS trainval_ratio,
            round_even(count(*) FILTER (y >= {CUTOFF}) / count(*), 4) AS test_ratio
            FROM (SELECT {_RAW_DAY} AS y FROM raw_filings)""",
)
def _(spark, sf):
    return split.split_report(v.raw_filings(spark, sf), CUTOFF)


@query(
    "year_window_f22",
    views="filings",
    sql=f"SELECT seq, filing_date FROM filings WHERE {_YEAR} BETWEEN {WINDOW[0]} AND {WINDOW[1]}",
)
def _(spark, sf):
    return split.select_window(v.filings(spark, sf), *WINDOW).select("seq", "filing_date")


@query(
    "strictly_after_f23",
    views="filings",
    sql=f"""WITH d AS (SELECT CAST(strptime(filing_date, '%d-%m-%Y') AS DATE) AS day, {_YEAR} AS y FROM filings),
            e AS (SELECT max(day) FILTER (y < {CUTOFF}) AS development_end, min(day) FILTER (y >= {CUTOFF}) AS holdout_start,
                  max(day) FILTER (y >= {CUTOFF}) AS holdout_end FROM d)
            SELECT *, development_end < holdout_start AS strictly_after,
                   year(holdout_start) = {CUTOFF} AND year(holdout_end) = 2001 AS spans_window FROM e""",
)
def _(spark, sf):
    development, holdout = split.split_by_year(v.filings(spark, sf), CUTOFF)
    return split.order_report(development, holdout, (CUTOFF, 2001))


@query(
    "fill_missing_f24",
    views="lexicon_source density_rows",
    sql="SELECT seq, {} FROM density_rows".format(
        ", ".join(f"coalesce({n}, 0.0) AS {n}" for n in fv.LEXICON_DENSITIES)
    ),
)
def _(spark, sf):
    names = list(fv.LEXICON_DENSITIES)
    return contracts.fill_missing(v.density_rows(spark, sf).select("seq", *names), names)


@query(
    "target_checks_f25",
    views="lexicon_source density_rows",
    sql="""SELECT count(*) AS rows, count(*) FILTER (fraudulent IS NULL) AS null_labels,
           count(DISTINCT fraudulent) = 2 AND min(fraudulent) = 0 AND max(fraudulent) = 1 AS labels_are_binary,
           concat_ws(',', {}) AS empty_features,
           count(*) - count(DISTINCT (fraudulent, {})) AS duplicate_rows
           FROM density_rows""".format(
        ", ".join(f"CASE WHEN count({n}) = 0 THEN '{n}' END" for n in fv.LEXICON_DENSITIES),
        ", ".join(f"coalesce({n}, -1)" for n in fv.LEXICON_DENSITIES),
    ),
)
def _(spark, sf):
    rows = v.density_rows(spark, sf).select("fraudulent", *fv.LEXICON_DENSITIES)
    return contracts.target_report(rows, list(fv.LEXICON_DENSITIES), "fraudulent")


@query(
    "probability_checks_f26",
    sql="""SELECT count(*) FILTER (NOT CAST(l_linenumber AS INTEGER) IN (0, 1)) AS not_binary, 0::BIGINT AS not_finite,
           count(*) FILTER (l_quantity / 30 > 1) AS out_of_range FROM lineitem""",
)
def _(spark, sf):
    rows = v.table(spark, sf, "lineitem").withColumn("p", C("l_quantity") / 30)
    return contracts.violations(rows, contracts.probability_rules("l_linenumber", "p"))
