"""Derived views on the given tables, once for Spark and once as SQL.

Every view is a projection of whole tables. `seq` is the unique row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions import keys
from ledgerwise.operators import ingest
from ledgerwise.scale import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(value: Column) -> Column:
    return value.cast("string")


# Companies and filings -------------------------------------------------------------

_FILING_TYPE_SQL = """CASE left(o_orderpriority, 1) WHEN '1' THEN '10-K' WHEN '2' THEN '10-K/A'
    WHEN '3' THEN '10-K405' WHEN '4' THEN ' 10-k405/a ' ELSE '10-KT' END"""


def _filing_type() -> Column:
    digit = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(digit == "1", "10-K")
        .when(digit == "2", "10-K/A")
        .when(digit == "3", "10-K405")
        .when(digit == "4", " 10-k405/a ")
        .otherwise("10-KT")
    )


def filings(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        key.alias("seq"),
        _text(F.col("o_custkey")).alias("cik"),
        _filing_type().alias("filing_type"),
        F.date_format(day, "dd-MM-yyyy").alias("filing_date"),
        F.date_format(F.date_sub(day, 90), "dd-MM-yyyy").alias("reporting_date"),
        F.when(key % 4 == 0, "1231").when(key % 4 == 1, "630").when(key % 4 == 2, "0229")
        .otherwise("9999").alias("fye"),
    )


def filings_b(spark: SparkSession, sf: str) -> DataFrame:
    """A second source: closed orders, half of them under other companies."""
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    shifted = F.col("o_custkey") + F.when(key % 2 == 0, 700).otherwise(0)
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        key.alias("seq"),
        _text(shifted).alias("cik"),
        _filing_type().alias("filing_type"),
        F.date_format(day, "dd-MM-yyyy").alias("filing_date"),
        F.date_format(F.date_sub(day, 90), "dd-MM-yyyy").alias("reporting_date"),
        F.when(key % 4 == 0, "1231").when(key % 4 == 1, "630").when(key % 4 == 2, "0229")
        .otherwise("9999").alias("fye"),
        F.col("o_totalprice").alias("extra"),
    )


def raw_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Filings with gaps, bad dates, unknown types, empty records and repeated ids."""
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    alive = key % 97 != 0

    def field(value: Column) -> Column:
        return F.when(alive, value)

    return table(spark, sf, "orders").select(
        key.alias("seq"),
        field(F.when(key % 23 != 0, _text(F.col("o_custkey") % 50))).alias("cik"),
        field(
            F.when(key % 31 == 0, " \t").otherwise(F.concat(F.lit("Firm "), _text(F.col("o_custkey"))))
        ).alias("name"),
        field(_filing_type()).alias("filing_type"),
        field(
            F.when(key % 37 == 0, F.date_format(day, "d-M-yyyy"))
            .when(key % 41 == 0, "31-02-1999")
            .otherwise(F.date_format(F.trunc(day, "MM"), "dd-MM-yyyy"))
        ).alias("filing_date"),
        field(
            F.when(key % 43 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(
                F.date_format(F.trunc(day, "year"), "dd-MM-yyyy")
            )
        ).alias("reporting_date"),
        field(F.lit("1231")).alias("fye"),
        field(F.when(key % 47 == 0, "").otherwise(F.col("o_orderpriority"))).alias("mda"),
    )


def period_source(spark: SparkSession, sf: str) -> DataFrame:
    """Raw enforcement periods: closed orders; some inverted, some without certainty."""
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    certainty = F.when(key % 4 == 0, "").otherwise(_text(key % 4))
    stamp = F.date_format(F.date_add(day, (key % 2500).cast("int")), "yyyy-MM-dd'T'10:11:12")
    return spread(table(spark, sf, "orders"), "o_orderkey").where("o_orderstatus = 'F'").select(
        key.alias("seq"),
        _text(F.col("o_custkey")).alias("cik"),
        F.date_format(day, "MM-yyyy").alias("fraud_start"),
        F.date_format(F.add_months(day, (key % 30 - 3).cast("int")), "MM-yyyy").alias("fraud_end"),
        certainty.alias("certainty_start"),
        F.when(key % 3 == 0, "n/a").otherwise(_text(key % 5)).alias("certainty_end"),
        F.concat(stamp, F.when(key % 3 == 0, "-05:00").otherwise("")).alias("date_time"),
    )


def clean_periods(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = ingest.clean_periods(period_source(spark, sf))
    return cleaned.withColumn("cik", keys.company_key(F.col("cik")))


def lexicon_source(spark: SparkSession, sf: str, *more) -> DataFrame:
    key = F.col("o_orderkey")
    moduli = {
        "N_Negative": 97, "N_Positive": 89, "N_Uncertainty": 83, "N_Litigious": 79,
        "N_StrongModal": 73, "N_WeakModal": 71, "N_Constraining": 67,
    }
    words = F.when(key % 50 == 0, 0.0).otherwise(F.floor("o_totalprice").cast("double"))
    return table(spark, sf, "orders").select(
        key.alias("seq"),
        _text(F.col("o_custkey")).alias("CIK"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("FILING_DATE"),
        words.alias("N_Words"),
        *[(key % m).cast("double").alias(n) for n, m in moduli.items()],
        *more,
    )


def density_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The seven densities with a class label, for the hypothesis statistics."""
    from ledgerwise.operators.lexicon import add_densities

    label = (F.col("o_orderstatus") == "F").cast("int").alias("fraudulent")
    return add_densities(lexicon_source(spark, sf, label)).select(
        "seq", "fraudulent", *fv.LEXICON_DENSITIES
    )


def raw_enforcement(spark: SparkSession, sf: str) -> DataFrame:
    """Delimited rows as parsed: repeated ids, bad months, overflowing fields."""
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        key.alias("seq"),
        F.when(key % 53 == 0, " ").otherwise(_text(F.floor(key / 2))).alias("id"),
        F.when(key % 29 == 0, None).otherwise(_text(F.col("o_custkey"))).alias("cik"),
        F.when(key % 13 == 0, F.date_format(day, "M-yyyy"))
        .otherwise(F.date_format(day, "MM-yyyy")).alias("fraud_start"),
        F.when(key % 17 == 0, "13-1999").otherwise(F.date_format(day, "MM-yyyy")).alias("fraud_end"),
        F.when(key % 19 == 0, "extra").alias("_overflow"),
    )


# Texts -----------------------------------------------------------------------------


def texts(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("mda")
    )
    return spread(columns, "seq")


def raw_html(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "pages").select(
        F.col("page_id").alias("seq"), F.col("html").alias("mda")
    )
    return spread(columns, "seq")


def text_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as filings, with types and dates in several styles."""
    key = F.col("doc_id")
    day = F.date_add(F.lit("1990-01-01").cast("date"), (key * 37 % 3650).cast("int"))
    styles = ("dd-MM-yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy")
    written_date = F.when(key % 6 == 0, F.date_format(day, styles[0]))
    for i, style in enumerate(styles[1:], start=1):
        written_date = written_date.when(key % 6 == i, F.date_format(day, style))
    return spread(table(spark, sf, "documents"), "doc_id").select(
        key.alias("seq"),
        _text(key % 50).alias("cik"),
        F.when(key % 5 == 0, "10-K").when(key % 5 == 1, "10-K/A").when(key % 5 == 2, "10-K405")
        .when(key % 5 == 3, " 10-k405/a ").otherwise("10-KT").alias("filing_type"),
        written_date.otherwise("unknown").alias("filing_date"),
        F.col("text").alias("mda"),
    )


def labeled_texts(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("seq"), (1 - F.col("quality")).alias("fraudulent")
    )
    return texts(spark, sf).join(labels, "seq").withColumn(
        "filing_year", (2000 + F.col("seq") % 8).cast("int")
    )


# Predictions and trials ------------------------------------------------------------


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("test_year"),
        key.alias("row_id"),
        (key % 17 == 0).cast("int").alias("true_label"),
        ((key * 37 % 101) / F.lit(100.0)).alias("predicted_probability"),
        ((key * 53 % 101) / F.lit(100.0)).alias("second_probability"),
    )


def trials(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("number"),
        F.when(key % 13 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice") / 10000)
        .alias("value"),
        ((F.col("p_size") - 25) / F.lit(100.0)).alias("skill"),
        ((key % 40) / F.lit(100.0)).alias("recall5"),
        ((key % 7) / F.lit(10.0)).alias("prauc"),
    )


# SQL twins -------------------------------------------------------------------------

COMPANY_KEY_SQL = (
    "CASE WHEN length({0}) < 10 THEN lpad({0}, 10, '0') ELSE {0} END"
)


def parse_month_sql(column: str) -> str:
    return f"CAST(try_strptime('01-' || {column}, '%d-%m-%Y') AS DATE)"


def fiscal_sql(date: str, fye: str) -> str:
    def in_year(year: str) -> str:
        return (
            f"CAST(try_strptime(lpad(CAST({year} AS VARCHAR), 4, '0') || lpad({fye}, 4, '0'),"
            " '%Y%m%d') AS DATE)"
        )

    this, after = in_year(f"year({date})"), in_year(f"(year({date}) + 1)")
    return f"CASE WHEN {date} <= {this} THEN {this} WHEN {date} > {this} THEN {after} END"


_FYE_SQL = (
    "CASE o_orderkey % 4 WHEN 0 THEN '1231' WHEN 1 THEN '630' WHEN 2 THEN '0229' ELSE '9999' END"
)

VIEW_SQL = {
    "filings": f"""
        SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS cik,
               {_FILING_TYPE_SQL} AS filing_type,
               strftime(o_orderdate, '%d-%m-%Y') AS filing_date,
               strftime(o_orderdate - INTERVAL 90 DAY, '%d-%m-%Y') AS reporting_date,
               {_FYE_SQL} AS fye
        FROM orders""",
    "filings_b": f"""
        SELECT o_orderkey AS seq,
               CAST(o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 700 ELSE 0 END AS VARCHAR) AS cik,
               {_FILING_TYPE_SQL} AS filing_type,
               strftime(o_orderdate, '%d-%m-%Y') AS filing_date,
               strftime(o_orderdate - INTERVAL 90 DAY, '%d-%m-%Y') AS reporting_date,
               {_FYE_SQL} AS fye, o_totalprice AS extra
        FROM orders WHERE o_orderstatus = 'F'""",
    "raw_filings": f"""
        SELECT o_orderkey AS seq,
               CASE WHEN alive AND o_orderkey % 23 <> 0 THEN CAST(o_custkey % 50 AS VARCHAR) END AS cik,
               CASE WHEN alive THEN CASE WHEN o_orderkey % 31 = 0 THEN ' ' || chr(9)
                    ELSE 'Firm ' || CAST(o_custkey AS VARCHAR) END END AS name,
               CASE WHEN alive THEN {_FILING_TYPE_SQL} END AS filing_type,
               CASE WHEN alive THEN CASE WHEN o_orderkey % 37 = 0 THEN strftime(o_orderdate, '%-d-%-m-%Y')
                    WHEN o_orderkey % 41 = 0 THEN '31-02-1999'
                    ELSE strftime(date_trunc('month', o_orderdate), '%d-%m-%Y') END END AS filing_date,
               CASE WHEN alive THEN CASE WHEN o_orderkey % 43 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                    ELSE strftime(date_trunc('year', o_orderdate), '%d-%m-%Y') END END AS reporting_date,
               CASE WHEN alive THEN '1231' END AS fye,
               CASE WHEN alive THEN CASE WHEN o_orderkey % 47 = 0 THEN '' ELSE o_orderpriority END END AS mda
        FROM (SELECT *, o_orderkey % 97 <> 0 AS alive FROM orders)""",
    "period_source": """
        SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS cik,
               strftime(o_orderdate, '%m-%Y') AS fraud_start,
               strftime(o_orderdate + to_months(CAST(o_orderkey % 30 AS INTEGER) - 3), '%m-%Y') AS fraud_end,
               CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey % 4 AS VARCHAR) END AS certainty_start,
               CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS certainty_end,
               date_trunc('day', o_orderdate) + to_days(CAST(o_orderkey % 2500 AS INTEGER))
                 + INTERVAL '10:11:12' + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END
                 AS record_time
        FROM orders WHERE o_orderstatus = 'F'""",
    "typed_periods": f"""
        SELECT seq, cik, {parse_month_sql('fraud_start')} AS fraud_start,
               last_day({parse_month_sql('fraud_end')}) AS fraud_end,
               CAST(coalesce(try_cast(nullif(certainty_start, '') AS DOUBLE), 0) AS BIGINT) AS certainty_start,
               CAST(coalesce(try_cast(certainty_end AS DOUBLE), 0) AS BIGINT) AS certainty_end
        FROM period_source""",
    "clean_periods": f"""
        SELECT seq, {COMPANY_KEY_SQL.format('cik')} AS cik, fraud_start, fraud_end,
               certainty_start, certainty_end
        FROM typed_periods
        WHERE cik IS NOT NULL AND fraud_start IS NOT NULL AND fraud_end IS NOT NULL
          AND fraud_start <= fraud_end
        QUALIFY row_number() OVER (PARTITION BY cik, fraud_start, fraud_end ORDER BY seq) = 1""",
    "typed_filings": f"""
        SELECT seq, {COMPANY_KEY_SQL.format('cik')} AS cik, filing_type, filing_date,
               CAST(strptime(reporting_date, '%d-%m-%Y') AS DATE) AS reporting_date, fye,
               {fiscal_sql("CAST(strptime(reporting_date, '%d-%m-%Y') AS DATE)", "fye")} AS fiscal_end
        FROM filings""",
    "matches": """
        SELECT f.seq, count(*) AS n, arg_min(p.fraud_start, p.seq) AS matched_fraud_start,
               arg_min(p.fraud_end, p.seq) AS matched_fraud_end,
               arg_min(p.certainty_start, p.seq) AS certainty_start,
               arg_min(p.certainty_end, p.seq) AS certainty_end
        FROM typed_filings f JOIN clean_periods p ON f.cik = p.cik
         AND (f.reporting_date BETWEEN p.fraud_start AND p.fraud_end
              OR f.fiscal_end BETWEEN p.fraud_start AND p.fraud_end)
        GROUP BY f.seq""",
    "labeled": """
        SELECT f.*, CASE WHEN m.seq IS NULL THEN 0 ELSE 1 END AS fraudulent,
               m.matched_fraud_start, m.matched_fraud_end, m.certainty_start, m.certainty_end,
               coalesce(m.n > 1, false) AS multiple_matches
        FROM typed_filings f LEFT JOIN matches m ON f.seq = m.seq""",
    "lexicon_source": """
        SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS CIK,
               strftime(o_orderdate, '%Y%m%d') AS FILING_DATE,
               CASE WHEN o_orderkey % 50 = 0 THEN 0.0::DOUBLE ELSE floor(o_totalprice) END AS N_Words,
               CAST(o_orderkey % 97 AS DOUBLE) AS N_Negative, CAST(o_orderkey % 89 AS DOUBLE) AS N_Positive,
               CAST(o_orderkey % 83 AS DOUBLE) AS N_Uncertainty, CAST(o_orderkey % 79 AS DOUBLE) AS N_Litigious,
               CAST(o_orderkey % 73 AS DOUBLE) AS N_StrongModal, CAST(o_orderkey % 71 AS DOUBLE) AS N_WeakModal,
               CAST(o_orderkey % 67 AS DOUBLE) AS N_Constraining
        FROM orders""",
    "density_rows": """
        SELECT seq, CAST(o_orderstatus = 'F' AS INTEGER) AS fraudulent,
               N_Negative / nullif(N_Words, 0) AS negative_density,
               N_Positive / nullif(N_Words, 0) AS positive_density,
               N_Uncertainty / nullif(N_Words, 0) AS uncertainty_density,
               N_Litigious / nullif(N_Words, 0) AS litigious_density,
               N_WeakModal / nullif(N_Words, 0) AS weak_modal_density,
               N_StrongModal / nullif(N_Words, 0) AS strong_modal_density,
               N_Constraining / nullif(N_Words, 0) AS constraining_density
        FROM lexicon_source JOIN orders ON seq = o_orderkey""",
    "raw_enforcement": """
        SELECT o_orderkey AS seq,
               CASE WHEN o_orderkey % 53 = 0 THEN ' ' ELSE CAST(o_orderkey // 2 AS VARCHAR) END AS id,
               CASE WHEN o_orderkey % 29 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS cik,
               CASE WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%-m-%Y')
                    ELSE strftime(o_orderdate, '%m-%Y') END AS fraud_start,
               CASE WHEN o_orderkey % 17 = 0 THEN '13-1999' ELSE strftime(o_orderdate, '%m-%Y') END AS fraud_end,
               CASE WHEN o_orderkey % 19 = 0 THEN 'extra' END AS _overflow
        FROM orders""",
    "texts": "SELECT doc_id AS seq, text AS mda FROM documents",
    "raw_html": "SELECT page_id AS seq, html AS mda FROM pages",
    "text_filings": """
        SELECT doc_id AS seq, CAST(doc_id % 50 AS VARCHAR) AS cik,
               CASE doc_id % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' WHEN 2 THEN '10-K405'
                    WHEN 3 THEN ' 10-k405/a ' ELSE '10-KT' END AS filing_type,
               CASE doc_id % 6 WHEN 0 THEN strftime(day, '%d-%m-%Y') WHEN 1 THEN strftime(day, '%Y-%m-%d')
                    WHEN 2 THEN strftime(day, '%Y/%m/%d') WHEN 3 THEN strftime(day, '%m/%d/%Y')
                    WHEN 4 THEN strftime(day, '%Y') ELSE 'unknown' END AS filing_date,
               CASE WHEN doc_id % 6 < 5 THEN year(day) END AS filing_year,
               text AS mda
        FROM (SELECT *, DATE '1990-01-01' + CAST(doc_id * 37 % 3650 AS INTEGER) AS day FROM documents)""",
    "labeled_texts": """
        SELECT d.doc_id AS seq, d.text AS mda, CAST(1 - l.quality AS INTEGER) AS fraudulent,
               CAST(2000 + d.doc_id % 8 AS INTEGER) AS filing_year
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "predictions": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS test_year, o_orderkey AS row_id,
               CAST(o_orderkey % 17 = 0 AS INTEGER) AS true_label,
               (o_orderkey * 37 % 101) / 100.0::DOUBLE AS predicted_probability,
               (o_orderkey * 53 % 101) / 100.0::DOUBLE AS second_probability
        FROM orders""",
    "trials": """
        SELECT p_partkey AS number,
               CASE WHEN p_partkey % 13 = 0 THEN 'NaN'::DOUBLE ELSE p_retailprice / 10000 END AS value,
               (p_size - 25) / 100.0::DOUBLE AS skill, (p_partkey % 40) / 100.0::DOUBLE AS recall5,
               (p_partkey % 7) / 10.0::DOUBLE AS prauc
        FROM part""",
}


def with_views(names: list[str], body: str) -> str:
    """The body after a WITH list of the named views, in the given order."""
    if not names:
        return body
    views = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in names)
    if body.lstrip().upper().startswith("WITH "):
        rest = body.lstrip()[5:]
        return f"WITH {views},\n{rest}"
    return f"WITH {views}\n{body}"
