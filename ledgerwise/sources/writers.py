"""Sinks: Parquet, JSON, CSV, Markdown and a write-once sealed folder."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.functions.keys import content_fingerprint
from ledgerwise.operators.contracts import to_schema
from ledgerwise.scale import union_all


def write_parquet(
    df: DataFrame, path: str, schema: T.StructType | None = None, partition_by: str | None = None
) -> None:
    """Snappy Parquet with one schema for all files; partitioned by year when asked."""
    out = to_schema(df, schema) if schema is not None else df
    writer = out.write.mode("errorifexists").option("compression", "snappy")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """A report table as JSON lines; absent values are written as null."""
    report.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv_table(table: DataFrame, path: str) -> None:
    """A result table (metrics, folds) as headed CSV in one file."""
    table.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def save(df: DataFrame, path: str, kind: str) -> None:
    """Generic save as 'json' lines, 'csv' or 'parquet', in parallel."""
    if kind == "json":
        df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    elif kind == "csv":
        df.write.mode("errorifexists").option("header", True).option("emptyValue", '""').csv(path)
    elif kind == "parquet":
        write_parquet(df, path)
    else:
        raise ValueError(f"Unsupported kind: {kind}")


def maturity_markdown(delays: DataFrame, cutoffs: DataFrame, linked: DataFrame) -> DataFrame:
    """Lines of the Markdown summary of a label-maturity audit (line_no, value)."""
    title = linked.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("line_no"), F.lit("# Label maturity").alias("value")),
                F.struct(F.lit(2).alias("line_no"), F.lit("").alias("value")),
                F.struct(
                    F.lit(3).alias("line_no"),
                    F.format_string(
                        "- %d positive labels link to %d enforcement periods.",
                        "positive_labels", "unique_linked_periods",
                    ).alias("value"),
                ),
            )
        )
    )
    delay = delays.select(
        F.lit(4).alias("line_no"),
        F.format_string(
            "- Median observed delay: %.0f days; %d labels were recorded after the fixed date.",
            "median_days", "recorded_after",
        ).alias("value"),
    )
    cut = cutoffs.select(
        (F.lit(5) + F.substring("quantile", 2, 2).cast("int")).alias("line_no"),
        F.format_string(
            "- %s lag: %d days; filings on or before %s meet this threshold.",
            "quantile", "lag_days", F.date_format("cutoff", "yyyy-MM-dd"),
        ).alias("value"),
    )
    return union_all([title, delay, cut])


def write_markdown(lines: DataFrame, path: str) -> None:
    """Lines of a summary in order, as one text file."""
    lines.orderBy("line_no").select("value").coalesce(1).write.mode("errorifexists").text(path)


def exclusive_marker(spark: SparkSession, path: str, content: dict) -> None:
    """Create a small file that must not exist: of two drivers only one can."""
    java = spark.sparkContext._jvm
    marker = java.org.apache.hadoop.fs.Path(path)
    files = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        stream = files.create(marker, False)
    except Py4JJavaError as error:
        raise RuntimeError(f"evaluation was already started: {path}") from error
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()


class SealedFolder:
    """Write-once results: a start marker, data sets, and a manifest with fingerprints.

    Starting a second time fails, and so does sealing without a start.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def begin(self, metadata: dict[str, str]) -> None:
        """Create the marker file exclusively, so that of two drivers only one can start."""
        exclusive_marker(self.spark, f"{self.path}/started/marker.json", {"metadata": metadata})

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Write all tables; each only once."""
        try:
            self.spark.read.json(f"{self.path}/started").first()
        except AnalysisException as error:
            raise RuntimeError("begin() must come before commit()") from error
        for name, table in tables.items():
            table.write.mode("errorifexists").parquet(f"{self.path}/data/{name}")

    def seal(self, names: list[str]) -> DataFrame:
        """Write the manifest of what was written."""
        parts = [
            content_fingerprint(self.spark.read.parquet(f"{self.path}/data/{name}")).withColumn("name", F.lit(name))
            for name in names
        ]
        manifest = union_all(parts).withColumn("status", F.lit("complete"))
        manifest.write.mode("errorifexists").json(f"{self.path}/complete")
        return self.spark.read.schema("name string, rows bigint, fingerprint string, status string").json(
            f"{self.path}/complete"
        )

    def commit(self, tables: dict[str, DataFrame]) -> DataFrame:
        """Write all tables, then the manifest."""
        self.write(tables)
        return self.seal(list(tables))
