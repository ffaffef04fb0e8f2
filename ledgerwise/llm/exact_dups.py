"""Exact duplicates: groups of one 128-bit content hash, with their bytes compared.

DataFrame functions only. Texts of documents that are alone under their hash are never shuffled; of
the others, each task sends each distinct text once. What is joined and grouped is narrow: ids,
hashes and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm.common import text_bytes
from ledgerwise.scale import attach_unique, checked_broadcast, cut_lineage, written

CONTENT = "_content"


def content_hash(text: Column) -> Column:
    """128 bits of a text's bytes."""
    return F.unhex(F.md5(text))


def colliding_hashes(texts: DataFrame) -> DataFrame:
    """Hashes that several different texts have, as column `_hash`; `texts` has `_hash` and `_text`.

    Grouping by hash and text compares bytes. Only hashes of several rows are looked at, and each task
    first merges the copies it reads, so a group of copies costs one row a task.
    """
    counts = texts.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    repeated, _ = checked_broadcast(counts.where("_n > 1").select("_hash"))
    distinct = texts.join(repeated, "_hash", "left_semi").groupBy("_hash", "_text").agg(F.lit(1).alias("_one"))
    return distinct.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")


def with_content(
    docs: DataFrame, text_column: str = "text", hashed: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """Add `_content`, a key that two rows share exactly when their texts are the same bytes.

    Null counts as empty. The key is the 128-bit hash; for the texts of a hash that different texts
    share, it is the hash and the whole text.
    """
    text = text_bytes(text_column)
    hashes = docs.select(hashed(text).alias("_hash"), text.alias("_text"))
    colliding = cut_lineage(colliding_hashes(hashes))
    if colliding.isEmpty():
        return docs.withColumn(CONTENT, hashed(text))
    found, _ = checked_broadcast(colliding.withColumn("_shared", F.lit(True)))
    marked = docs.withColumn("_hash", hashed(text)).join(found, "_hash", "left")
    key = F.when(F.col("_shared"), F.concat("_hash", text)).otherwise(F.col("_hash"))
    return marked.withColumn(CONTENT, key).drop("_hash", "_shared")


def exact_duplicates(
    docs: DataFrame,
    largest: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256; dropped rows too.

    Texts are equal when their bytes are; null counts as empty. The row with the smallest id stays, or
    with `largest` the one with the largest id, and `keep_id` is its id. A row without an id stays only
    if no row of its group has one; its `keep_id` is null. Of rows that repeat an id and a text, one
    stays. Other columns are not read, and may have any name. No rows give no rows.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows = with_content(source, "text", hashed).select(
        "doc_id", CONTENT, F.sha2(text_bytes("text"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Once written, the row numbers no longer depend on how often the texts are read.
    rows = written(rows, "content")
    nearest = F.max if largest else F.min
    order = F.struct(
        F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull(), "doc_id", "_row"
    )
    groups = rows.groupBy(CONTENT).agg(F.count(F.lit(1)).alias("group_size"), nearest(order).alias("_stays"))
    several = groups.where("group_size > 1").select(
        CONTENT, "group_size", F.col("_stays.doc_id").alias("_keep"), F.col("_stays._row").alias("_first")
    )
    joined = attach_unique(rows, several, [CONTENT], "_row")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_first"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
