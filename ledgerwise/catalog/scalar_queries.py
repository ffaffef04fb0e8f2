"""Date, key and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.catalog import views as v
from ledgerwise.catalog.registry import query
from ledgerwise.functions import dates, keys, numbers, text
from ledgerwise.operators import models

C = F.col


@query(
    "period_start_date_d1",
    views="period_source",
    sql=f"SELECT seq, {v.parse_month_sql('fraud_start')} AS period_start FROM period_source",
)
def _(spark, sf):
    return v.period_source(spark, sf).select(
        "seq", dates.month_start(C("fraud_start")).alias("period_start")
    )


@query(
    "period_end_date_d2",
    views="period_source",
    sql=f"SELECT seq, last_day({v.parse_month_sql('fraud_end')}) AS period_end FROM period_source",
)
def _(spark, sf):
    return v.period_source(spark, sf).select(
        "seq", dates.month_end(C("fraud_end")).alias("period_end")
    )


_DAY_FIRST = """coalesce(CASE WHEN regexp_full_match({0}, '\\d{{2}}-\\d{{2}}-\\d{{4}}') THEN CAST(try_strptime({0}, '%d-%m-%Y') AS DATE) END,
    CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_strptime({0}, '%Y-%m-%d') AS DATE) END)"""


@query(
    "day_first_date_d3",
    views="raw_filings",
    sql=f"""SELECT seq, {_DAY_FIRST.format('filing_date')} AS filed,
            {_DAY_FIRST.format('reporting_date')} AS reported FROM raw_filings""",
)
def _(spark, sf):
    return v.raw_filings(spark, sf).select(
        "seq",
        dates.day_first_date(C("filing_date")).alias("filed"),
        dates.day_first_date(C("reporting_date")).alias("reported"),
    )


@query(
    "required_date_d4",
    views="filings",
    sql="SELECT seq, CAST(strptime(filing_date, '%d-%m-%Y') AS DATE) AS filed FROM filings",
)
def _(spark, sf):
    return v.filings(spark, sf).select(
        "seq", dates.required_day_first_date(C("filing_date")).alias("filed")
    )


@query(
    "multi_format_year_d5",
    views="text_filings",
    sql="SELECT seq, CAST(filing_year AS INTEGER) AS filing_year FROM text_filings",
)
def _(spark, sf):
    return v.text_filings(spark, sf).select(
        "seq", dates.multi_format_year(C("filing_date")).alias("filing_year")
    )


@query(
    "filing_and_reporting_year_d6",
    views="filings",
    sql="""SELECT seq, CAST(year(strptime(filing_date, '%d-%m-%Y')) AS INTEGER) AS filing_year,
           CAST(year(strptime(reporting_date, '%d-%m-%Y')) AS INTEGER) AS reporting_year FROM filings""",
)
def _(spark, sf):
    return v.filings(spark, sf).select(
        "seq",
        F.year(dates.required_day_first_date(C("filing_date"))).alias("filing_year"),
        F.year(dates.required_day_first_date(C("reporting_date"))).alias("reporting_year"),
    )


@query(
    "compact_date_year_d7",
    views="lexicon_source",
    sql="""SELECT seq, CAST(year(try_strptime(FILING_DATE, '%Y%m%d')) AS INTEGER) AS lexicon_year
           FROM lexicon_source""",
)
def _(spark, sf):
    return v.lexicon_source(spark, sf).select(
        "seq", dates.compact_date_year(C("FILING_DATE").cast("int")).alias("lexicon_year")
    )


@query(
    "fiscal_year_end_d8",
    views="filings typed_filings",
    sql="SELECT seq, reporting_date, fye, fiscal_end FROM typed_filings",
)
def _(spark, sf):
    reported = dates.day_first_date(C("reporting_date"))
    return v.filings(spark, sf).select(
        "seq",
        reported.alias("reporting_date"),
        "fye",
        dates.fiscal_year_end(reported, C("fye")).alias("fiscal_end"),
    )


@query(
    "record_time_utc_d9",
    views="period_source",
    sql="SELECT seq, CAST(record_time AS TIMESTAMP) AS record_time FROM period_source",
)
def _(spark, sf):
    return v.period_source(spark, sf).select(
        "seq", dates.utc_timestamp(C("date_time")).alias("record_time")
    )


@query(
    "whole_day_delay_d10",
    sql="""SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-05 06:00:00') - epoch_us(ts)) / 86400000000.0)
           AS BIGINT) AS days FROM events""",
)
def _(spark, sf):
    moment = F.lit("2024-01-05 06:00:00").cast("timestamp_ntz")
    return v.table(spark, sf, "events").select(
        "event_id", dates.whole_days_between(C("ts"), moment).alias("days")
    )


@query(
    "date_minus_days_d11",
    sql="""SELECT o_orderkey, o_orderdate - to_days(CAST(o_orderkey % 2500 AS INTEGER)) AS moved
           FROM orders""",
)
def _(spark, sf):
    return v.table(spark, sf, "orders").select(
        "o_orderkey", dates.minus_days(C("o_orderdate"), C("o_orderkey") % 2500).alias("moved")
    )


@query(
    "year_end_date_d12",
    sql="SELECT o_orderkey, make_date(year(o_orderdate), 12, 31) AS year_close FROM orders",
)
def _(spark, sf):
    return v.table(spark, sf, "orders").select(
        "o_orderkey", dates.year_end(F.year("o_orderdate")).alias("year_close")
    )


@query(
    "iso_date_d13",
    sql="SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
)
def _(spark, sf):
    return v.table(spark, sf, "orders").select(
        "o_orderkey", dates.iso_date(C("o_orderdate")).alias("iso")
    )


_KEY_INPUT = """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) || '.0'
    WHEN o_orderkey % 3 = 1 THEN ' ' || CAST(o_custkey AS VARCHAR)
    WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || '98765432109' END AS cik FROM orders"""


def _key_input(spark, sf):
    key, company = C("o_orderkey"), C("o_custkey").cast("string")
    return v.table(spark, sf, "orders").select(
        key.alias("seq"),
        F.when(key % 3 == 0, F.concat(company, F.lit(".0")))
        .when(key % 3 == 1, F.concat(F.lit(" "), company))
        .when(key % 7 == 0, None)
        .otherwise(F.concat(company, F.lit("98765432109")))
        .alias("cik"),
    )


@query(
    "company_key_p15",
    sql=f"""SELECT seq, coalesce({v.COMPANY_KEY_SQL.format("regexp_replace(trim(cik), '[.]0$', '')")}, '') AS company
            FROM ({_KEY_INPUT})""",
)
def _(spark, sf):
    return _key_input(spark, sf).select("seq", keys.company_key(C("cik")).alias("company"))


@query(
    "company_key_digits_p16",
    sql=f"""SELECT seq, {v.COMPANY_KEY_SQL.format("nullif(regexp_extract(cik, '([0-9]+)', 1), '')")} AS company
            FROM ({_KEY_INPUT})""",
)
def _(spark, sf):
    return _key_input(spark, sf).select("seq", keys.company_key_digits(C("cik")).alias("company"))


_WS_SQL = "' ' || chr(9) || chr(10) || chr(13)"


@query(
    "record_identifier_p17",
    views="raw_filings",
    sql=f"""SELECT seq, coalesce(trim(cik, {_WS_SQL}), '') AS id_cik, coalesce(trim(filing_date, {_WS_SQL}), '') AS id_filed,
            coalesce(trim(reporting_date, {_WS_SQL}), '') AS id_reported, coalesce(trim(filing_type, {_WS_SQL}), '') AS id_type,
            coalesce(trim(cik, {_WS_SQL}) <> '' AND filing_date <> '' AND reporting_date <> '' AND trim(filing_type) <> '', false) AS complete
            FROM raw_filings""",
)
def _(spark, sf):
    identified = v.raw_filings(spark, sf).select("seq", keys.record_identifier().alias("id"))
    return identified.select(
        "seq",
        C("id.cik").alias("id_cik"),
        C("id.filing_date").alias("id_filed"),
        C("id.reporting_date").alias("id_reported"),
        C("id.filing_type").alias("id_type"),
        keys.is_complete_identifier(C("id")).alias("complete"),
    )


@query(
    "stable_filing_id_p23",
    views="filings",
    sql=f"""SELECT seq, sha256('{{"cik":"' || {v.COMPANY_KEY_SQL.format('cik')}
            || '","filing_date":"' || strftime(strptime(filing_date, '%d-%m-%Y'), '%Y-%m-%d')
            || '","filing_type":"' || upper(trim(filing_type))
            || '","reporting_date":"' || strftime(strptime(reporting_date, '%d-%m-%Y'), '%Y-%m-%d')
            || '"}}') AS filing_id FROM filings""",
)
def _(spark, sf):
    return v.filings(spark, sf).select(
        "seq",
        keys.stable_filing_id(
            C("cik"),
            dates.required_day_first_date(C("filing_date")),
            dates.required_day_first_date(C("reporting_date")),
            C("filing_type"),
        ).alias("filing_id"),
    )


@query("dataset_fingerprint_p24")
def _(spark, sf):
    return keys.content_fingerprint(v.table(spark, sf, "lineitem"))


@query(
    "feature_schema_hash_p25",
    sql="SELECT count(*) AS rows, sha256('{}') AS schema_hash FROM documents".format(
        "[" + ",".join(f'"{name}"' for name in fv.MODEL_FEATURES) + "]"
    ),
)
def _(spark, sf):
    return v.texts(spark, sf).agg(
        F.count(F.lit(1)).alias("rows"), keys.schema_hash(fv.MODEL_FEATURES).alias("schema_hash")
    )


@query(
    "type_code_p26",
    views="filings",
    sql="SELECT seq, upper(trim(filing_type)) AS type_code FROM filings",
)
def _(spark, sf):
    return v.filings(spark, sf).select("seq", keys.type_code(C("filing_type")).alias("type_code"))


@query(
    "integer_or_zero_n1",
    views="period_source",
    sql="""SELECT seq, CAST(coalesce(try_cast(nullif(certainty_start, '') AS DOUBLE), 0) AS BIGINT) AS start_certainty,
           CAST(coalesce(try_cast(certainty_end AS DOUBLE), 0) AS BIGINT) AS end_certainty FROM period_source""",
)
def _(spark, sf):
    return v.period_source(spark, sf).select(
        "seq",
        numbers.integer_or_zero(C("certainty_start")).alias("start_certainty"),
        numbers.integer_or_zero(C("certainty_end")).alias("end_certainty"),
    )


@query(
    "lexicon_densities_n2",
    views="lexicon_source density_rows",
    sql="""SELECT seq, negative_density, positive_density, uncertainty_density, litigious_density,
           weak_modal_density, strong_modal_density, constraining_density FROM density_rows""",
)
def _(spark, sf):
    from ledgerwise.operators.lexicon import add_densities

    return add_densities(v.lexicon_source(spark, sf)).select("seq", *fv.LEXICON_DENSITIES)


@query(
    "math_functions_n3",
    sql="""SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + l_quantity), 6) AS log1p_quantity,
           CAST(ceil(l_extendedprice * 0.05) AS BIGINT) AS ceil_share, abs(l_discount - l_tax) AS gap,
           round(sqrt(l_extendedprice), 6) AS root, least(greatest(l_discount, 0.02), 0.07) AS clipped
           FROM lineitem""",
)
def _(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(F.log1p("l_quantity"), 6).alias("log1p_quantity"),
        F.ceil(C("l_extendedprice") * F.lit(0.05)).alias("ceil_share"),
        F.abs(C("l_discount") - C("l_tax")).alias("gap"),
        F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        numbers.clip(C("l_discount"), 0.02, 0.07).alias("clipped"),
    )


@query(
    "half_even_rounding_n4",
    sql="SELECT o_orderkey, round_even((o_orderkey % 1000) / 8.0::DOUBLE, 2) AS rounded FROM orders",
)
def _(spark, sf):
    return v.table(spark, sf, "orders").select(
        "o_orderkey", numbers.half_even((C("o_orderkey") % 1000) / F.lit(8.0), 2).alias("rounded")
    )


@query(
    "standardize_n5",
    sql="""SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
           / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS z FROM orders""",
)
def _(spark, sf):
    prices = v.table(spark, sf, "orders").select("o_orderkey", C("o_totalprice").alias("z"))
    return numbers.standardize(prices, ["z"]).withColumn("z", F.round("z", 6))


_EDGES = [repr(e) + "::DOUBLE" for e in numbers.bin_edges(10)]


@query(
    "score_bins_n6",
    views="predictions",
    sql=f"""SELECT row_id, CAST(len(list_filter([{', '.join(_EDGES)}], lambda e: e <= predicted_probability)) AS INTEGER) AS bin
            FROM predictions""",
)
def _(spark, sf):
    return v.predictions(spark, sf).select(
        "row_id", numbers.bin_index(C("predicted_probability"), numbers.bin_edges(10)).alias("bin")
    )


# The fixed phrases do not occur in the test texts, so frequent ones stand in.
COMMON_PHRASES = ("the ", "de la", " and", "der ", "license", "que ", " on ", " en ")
_PHRASE_SUM = " + ".join(
    f"CAST(contains(lower(mda), '{p}') AS INTEGER)" for p in COMMON_PHRASES
)


@query(
    "phrase_matches_n7",
    views="texts",
    sql=f"SELECT seq, CAST({_PHRASE_SUM} AS INTEGER) AS phrases FROM texts",
)
def _(spark, sf):
    return v.texts(spark, sf).select(
        "seq", text.phrase_matches(C("mda"), COMMON_PHRASES).alias("phrases")
    )


@query(
    "canonical_json_n8",
    sql="""SELECT c_custkey, '{"name":"' || c_name || '","nation":' || CAST(c_nationkey AS VARCHAR)
           || ',"segment":"' || c_mktsegment || '"}' AS canonical FROM customer""",
)
def _(spark, sf):
    return v.table(spark, sf, "customer").select(
        "c_custkey",
        keys.canonical_json(
            segment=C("c_mktsegment"), nation=C("c_nationkey"), name=C("c_name")
        ).alias("canonical"),
    )


@query(
    "differing_keys_n9",
    sql="""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority <> '1-URGENT' THEN 'priority' END,
           CASE WHEN o_orderstatus <> 'F' THEN 'status' END, 'year') AS differing FROM orders""",
)
def _(spark, sf):
    actual = F.create_map(
        F.lit("status"), C("o_orderstatus"), F.lit("priority"), C("o_orderpriority")
    )
    expected = F.create_map(
        F.lit("status"), F.lit("F"), F.lit("priority"), F.lit("1-URGENT"), F.lit("year"), F.lit("any")
    )
    return v.table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat_ws(",", numbers.differing_keys(expected, actual)).alias("differing"),
    )


@query(
    "contract_mismatch_l16",
    sql="SELECT 'development_data,feature_schema' AS differing, count(*) AS rows FROM orders",
)
def _(spark, sf):
    expected = models.artifact_contract(v.table(spark, sf, "orders"), ("a", "b"), "ranking")
    closed = v.table(spark, sf, "orders").where("o_orderstatus = 'F'")
    actual = models.artifact_contract(closed, ("b", "a"), "ranking")
    rows = v.table(spark, sf, "orders").agg(F.count(F.lit(1))).select("count(1)").scalar()
    return models.contract_mismatch(expected, actual).select(
        F.concat_ws(",", "differing").alias("differing"), rows.alias("rows")
    )
