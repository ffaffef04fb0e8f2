"""From raw documents to tokens: filter by quality, drop frequent lines and near-duplicates, mix, encode.

Each stage takes the documents that the last one kept and returns documents, the last one tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.llm import bpe, cotraining, lines, mixing, near_dups
from ledgerwise.llm.common import table
from ledgerwise.scale import written


def carried(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """Documents whose other columns have names that no operator uses, and those names."""
    names = {c: f"_carried_{k}" for k, c in enumerate(docs.columns) if c not in own}
    return docs.withColumnsRenamed(names), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; the labels are those of `sf_dir`."""
    model = cotraining.learn_quality(docs, table(spark, sf_dir, "labels"))
    own = ("doc_id", "text", "source", "lang")
    renamed, names = carried(docs, own)
    scored = cotraining.scored(renamed, model, keep=(*own[1:], *names.values()))
    accepted = scored.where(F.col("score") >= cotraining.THRESHOLD)
    return accepted.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten of them share; `n_chars` is the new length."""
    renamed, names = carried(docs, ("doc_id", "text"))
    done = lines.drop_frequent_lines(renamed, keep=tuple(names.values()))
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*[made.get(c, F.col(names.get(c, c))).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, by five words and a similarity of 0.8.

    Rows are told apart by all they hold, as ids may be null or repeated; of rows that repeat whole one
    stays. A group keeps its row with the smallest id, one without an id only if none has one.
    """
    renamed, names = carried(docs, ("doc_id", "text"))
    # Nulls leave a hash as it is, but no trace in JSON.
    rest = F.to_json(F.struct("doc_id", F.col("text").isNull().alias("blank"), *names.values()))
    rows = renamed.withColumn("_row", F.xxhash64("text", rest))
    groups = near_dups.near_duplicates(rows, words=5, percent=80, id_column="_row")
    groups = groups.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = groups.join(rows.select("_row", "doc_id").distinct(), "_row").groupBy("component_id")
    kept = first.agg(F.min(order)["_row"].alias("_row")).select("_row")
    one_each = rows.dropDuplicates(["_row"]).join(kept, "_row", "left_semi")
    return one_each.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixing.mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text that they decode to."""
    return bpe.encoded(docs, digests=True)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokens", tokens),
]
# The first stage fits a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each one keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
QUERY_SQL: dict[str, str] = {}
