"""Sources, sinks and streams. Each query writes whole tables and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise import fixed_values as fv
from ledgerwise.catalog import views as v
from ledgerwise.catalog.registry import query
from ledgerwise.operators import contracts
from ledgerwise.scale import shared_folder
from ledgerwise.sources import readers, schemas, writers
from ledgerwise.streaming import incremental

C = F.col


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/queries/{name}-{uuid.uuid4().hex}"


@query(
    "json_array_source_s1",
    views="filings",
    sql="SELECT cik, filing_type, filing_date, reporting_date, fye FROM filings",
)
def _(spark, sf):
    # One array a file, of as many records as a task has.
    path = _folder(spark, "json-array")
    rows = v.filings(spark, sf).select(
        F.to_json(F.struct("cik", "filing_type", "filing_date", "reporting_date", "fye")).alias("value")
    )

    def as_array(batches):
        import pandas as pd

        first = True
        for batch in batches:
            lead = pd.Series(", ", index=batch.index)
            lead.iloc[:1] = "[" if first else ", "
            yield pd.DataFrame({"value": lead + batch["value"]})
            first = False
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    rows.mapInPandas(as_array, "value string").write.text(path)
    schema = schemas.all_strings(("cik", "filing_type", "filing_date", "reporting_date", "fye"))
    return readers.read_json_records(spark, path, schema)


_ENFORCEMENT_FIELDS = ("id", "cik", "fraud_start", "fraud_end", "certainty_start", "certainty_end")


@query(
    "delimited_source_s2",
    views="period_source",
    sql="""SELECT CAST(seq AS VARCHAR) AS id, cik, fraud_start, fraud_end, nullif(certainty_start, '') AS certainty_start, certainty_end,
           'order "' || seq || '";' || chr(10) || 'next line' AS respondents
           FROM period_source""",
)
def _(spark, sf):
    path = _folder(spark, "delimited")
    columns = [
        C("seq").cast("string") if name == "id"
        else C(name) if name in _ENFORCEMENT_FIELDS
        # A quoted field with quotes, a separator and a line end.
        else F.format_string('"order ""%d"";\nnext line"', "seq") if name == "respondents"
        else F.lit("")
        for name in fv.ENFORCEMENT_COLUMNS
    ]
    lines = v.period_source(spark, sf).select(F.concat_ws(";", *columns).alias("value"))

    def with_preamble(batches):
        # Two lines to skip at the head of every file.
        import pandas as pd

        yield pd.DataFrame({"value": ["exported records", "id;columns"]})
        yield from batches

    lines.mapInPandas(with_preamble, "value string").write.text(path)
    return readers.read_delimited(spark, path).select(*_ENFORCEMENT_FIELDS, "respondents")


@query(
    "csv_projection_s3",
    views="lexicon_source",
    sql="SELECT CIK, FILING_DATE, N_Words, N_Negative FROM lexicon_source",
)
def _(spark, sf):
    path = _folder(spark, "lexicon")
    source = v.lexicon_source(spark, sf).drop("seq")
    writers.save(source, path, "csv")
    return readers.read_csv(
        spark, path, schemas.LEXICON, ["CIK", "FILING_DATE", "N_Words", "N_Negative"]
    )


@query(
    "parquet_projection_s4",
    sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
)
def _(spark, sf):
    columns = ["l_orderkey", "l_linenumber", "l_quantity"]
    return readers.read_parquet(spark, f"{sf}/lineitem.parquet", columns)


@query(
    "generic_save_load_s5",
    sql="""SELECT kind, c_custkey, c_name, c_acctbal FROM customer
           CROSS JOIN (SELECT unnest(['json', 'csv', 'parquet']) AS kind)""",
)
def _(spark, sf):
    source = v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    loaded = []
    for kind in ("json", "csv", "parquet"):
        path = _folder(spark, kind)
        writers.save(source, path, kind)
        loaded.append(
            readers.load(spark, path, kind, source.schema).withColumn("kind", F.lit(kind))
        )
    return loaded[0].unionByName(loaded[1]).unionByName(loaded[2])


@query(
    "parquet_sink_by_year_s6",
    views="filings",
    sql="""SELECT seq, cik, CAST(right(filing_date, 4) AS INTEGER) AS filing_year FROM filings""",
)
def _(spark, sf):
    path = _folder(spark, "by-year")
    rows = v.filings(spark, sf).select(
        "seq", "cik", F.substring("filing_date", 7, 4).cast("int").alias("filing_year")
    )
    writers.write_parquet(rows, path, partition_by="filing_year")
    return readers.read_parquet(spark, path, ["seq", "cik", "filing_year"])


@query(
    "pinned_schema_sink_s7",
    views="filings",
    sql="SELECT cik, filing_type, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS BIGINT) AS fraudulent FROM filings",
)
def _(spark, sf):
    path = _folder(spark, "pinned")
    filings = v.filings(spark, sf).withColumn("reporting_date", F.lit(None).cast("timestamp_ntz"))
    writers.write_parquet(filings, path, schemas.CHECKED_FILINGS)
    return readers.read_parquet(spark, path, ["cik", "filing_type", "city", "fraudulent"])


@query(
    "fixed_schema_s8",
    views="filings typed_filings period_source typed_periods clean_periods matches labeled",
    sql="""SELECT cik, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS state,
           CAST(NULL AS VARCHAR) AS sic, CAST(NULL AS VARCHAR) AS incorp_state, filing_type, fye, filing_date,
           CAST(reporting_date AS TIMESTAMP) AS reporting_date, CAST(NULL AS VARCHAR) AS url,
           CAST(NULL AS VARCHAR) AS mda, CAST(fraudulent AS BIGINT) AS fraudulent,
           CAST(matched_fraud_start AS TIMESTAMP) AS matched_fraud_start,
           CAST(matched_fraud_end AS TIMESTAMP) AS matched_fraud_end,
           CAST(certainty_start AS DOUBLE) AS certainty_start, CAST(certainty_end AS DOUBLE) AS certainty_end
           FROM labeled""",
)
def _(spark, sf):
    from ledgerwise.catalog.join_queries import labeled

    return contracts.to_schema(labeled(spark, sf), schemas.CHECKED_FILINGS)


@query(
    "json_report_sink_s9",
    views="text_filings",
    sql="SELECT count(*) AS input_records, CAST(NULL AS VARCHAR) AS note FROM text_filings",
)
def _(spark, sf):
    path = _folder(spark, "report")
    report = v.text_filings(spark, sf).agg(
        F.count(F.lit(1)).alias("input_records"), F.lit(None).cast("string").alias("note")
    )
    writers.write_json_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query(
    "csv_table_sink_s10",
    views="predictions",
    sql="SELECT test_year, count(*) AS rows FROM predictions GROUP BY test_year",
)
def _(spark, sf):
    path = _folder(spark, "metric-table")
    rows = v.predictions(spark, sf).groupBy("test_year").agg(F.count(F.lit(1)).alias("rows"))
    writers.write_csv_table(rows, path)
    return readers.read_csv(
        spark,
        path,
        T.StructType([T.StructField("test_year", T.IntegerType()), T.StructField("rows", T.LongType())]),
    )


@query("markdown_summary_s11")
def _(spark, sf):
    from ledgerwise.catalog.aggregate_queries import maturity

    path = _folder(spark, "markdown")
    audit = maturity(spark, sf)
    lines = writers.maturity_markdown(audit.delays, audit.cutoffs, audit.coverage)
    writers.write_markdown(lines, path)
    return spark.read.text(path)


@query("input_files_s12")
def _(spark, sf):
    names = ["orders.parquet", "documents.parquet", "labels.parquet", "absent.parquet"]
    return readers.check_files(spark, sf, names)


@query("json_root_kind_s13")
def _(spark, sf):
    path = _folder(spark, "root")
    rows = v.table(spark, sf, "nation").select(F.to_json(F.struct("n_name")).alias("value"))
    rows.write.text(path)
    file = spark.read.text(path).select("_metadata.file_path").first()[0]
    kind = readers.json_root_kind(spark, file)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.lit(kind).alias("root_kind"))


def _sealed(spark, sf):
    sealed = writers.SealedFolder(spark, _folder(spark, "sealed"))
    sealed.begin({"purpose": "hold-out"})
    return sealed.commit(
        {
            "predictions": v.predictions(spark, sf),
            "summary": v.predictions(spark, sf).groupBy("test_year").count(),
        }
    )


@query("sealed_folder_s14")
def _(spark, sf):
    return _sealed(spark, sf)


@query(
    "sealed_rows_s14",
    views="predictions",
    sql="""SELECT 'predictions' AS name, count(*) AS rows, 'complete' AS status FROM predictions
           UNION ALL SELECT 'summary', count(DISTINCT test_year), 'complete' FROM predictions""",
)
def _(spark, sf):
    return _sealed(spark, sf).select("name", "rows", "status")


@query(
    "stream_first_seen_t2",
    sql="SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
)
def _(spark, sf):
    schema = v.table(spark, sf, "events").schema
    stream = incremental.file_stream(spark, sf, schema, "events.parquet").withColumn(
        "day", F.to_date("ts")
    )
    keys = ["user_id", "event_type", "day"]
    return incremental.run_available(incremental.first_seen(stream, keys), "first-seen").select(*keys)


@query(
    "stream_first_by_sequence_t2",
    sql="""SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM events
           GROUP BY user_id, event_type, CAST(ts AS DATE)""",
)
def _(spark, sf):
    schema = v.table(spark, sf, "events").schema
    stream = incremental.file_stream(spark, sf, schema, "events.parquet").withColumn(
        "day", F.to_date("ts")
    )
    keys = ["user_id", "event_type", "day"]
    log = incremental.run_log(incremental.first_by_sequence(stream, keys, "event_id"), "first-by-sequence")
    return incremental.current_firsts(log, keys, "event_id")


@query("stream_clean_filter_t1")
def _(spark, sf):
    from ledgerwise.catalog.filter_queries import FIRST_YEAR

    schema = v.table(spark, sf, "documents").schema
    stream = incremental.file_stream(spark, sf, schema, "documents.parquet").select(
        C("doc_id").alias("seq"),
        C("text").alias("mda"),
        F.when(C("doc_id") % 5 == 1, "10-K/A").otherwise("10-K").alias("filing_type"),
        F.concat((C("doc_id") % 10 + 1990).cast("string"), F.lit("-01-15")).alias("filing_date"),
    )
    cleaned = incremental.clean_and_filter(stream, first_year=FIRST_YEAR)
    return incremental.run_available(cleaned, "clean-filter").select(
        "seq", "filing_type", "filing_date", F.length("mda").alias("characters")
    )
