"""Sources: JSON arrays, delimited text with a preamble, CSV, Parquet, file metadata."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.sources import records
from ledgerwise.sources.schemas import ENFORCEMENT, LEXICON


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType, lines: bool = False
) -> DataFrame:
    """Records of JSON arrays, or of JSON lines. An array of any size is read by many tasks."""
    if lines:
        return spark.read.schema(schema).json(path)
    return records.read_json_arrays(spark, path, schema)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType = ENFORCEMENT,
    separator: str = ";",
    skip_lines: int = 2,
) -> DataFrame:
    """All-string delimited text without header, less the first lines of every file.

    Files stay splittable, also where quoted fields hold line ends. `seq` is unique and grows along each
    file. A field past the last column appears in `_overflow`, an empty field is NULL.
    """
    body = records.quoted_lines(spark, path, separator, skip_lines)
    wide = T.StructType([*schema.fields, T.StructField("_overflow", T.StringType())])
    options = {"sep": separator, "mode": "PERMISSIVE", "escape": '"'}
    parsed = F.from_csv("record", _ddl(wide), options)
    # A blank extra field parses to NULL, so lines without quotes are counted as well.
    fields = F.size(F.split("record", F.lit(re.escape(separator)), -1))
    blank_extra = ~F.col("record").contains('"') & (fields > len(schema.fields))
    rows = body.where(F.length("record") > 0).select("seq", parsed.alias("r"), blank_extra.alias("_blank"))
    return rows.select("seq", "r.*", "_blank").withColumn(
        "_overflow", F.coalesce("_overflow", F.when(F.col("_blank"), F.lit("")))
    ).drop("_blank")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns=None) -> DataFrame:
    """Headed CSV with an explicit schema; only the chosen columns are parsed."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LEXICON)


def read_parquet(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load(spark: SparkSession, path: str, kind: str, schema: T.StructType | None = None) -> DataFrame:
    """Generic load of 'json' lines, 'csv' or 'parquet'."""
    if kind == "json":
        return read_json_records(spark, path, schema, lines=True)
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"Unsupported kind: {kind}")


def check_files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Presence and size of expected files. Contents are not read."""
    expected = spark.createDataFrame([(n,) for n in names], "name string")
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "{" + ",".join(names) + "}")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    )
    # At most one row per expected name.
    return expected.join(F.broadcast(found), "name", "left").select(
        "name",
        F.col("length").isNotNull().alias("exists"),
        (F.coalesce("length", F.lit(0)) > 0).alias("readable"),
        F.coalesce("length", F.lit(0)).alias("size_bytes"),
    )


def json_root_kind(spark: SparkSession, path: str) -> str:
    """'array', 'object' or 'unknown', from the first non-blank byte of a file.

    Reads bytes up to that one on the driver, not the file.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        byte = stream.read()
        while byte >= 0 and byte in b" \t\r\n\xef\xbb\xbf":
            byte = stream.read()
    finally:
        stream.close()
    return {ord("["): "array", ord("{"): "object"}.get(byte, "unknown")
