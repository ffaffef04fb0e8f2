"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Sources get targets in words; a source that would exceed its cap stops there and the excess is
shared again by weight. Targets are dealt as blocks of equal size: by highest quotients among the
sources, then within each source among its shards. In a shard the documents form one stream of
words in a seeded order, and the shard's quota of blocks is a run of that stream from a seeded
start, around its end if need be, so that documents stay whole but at the two ends of the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwise.llm.common import WORD
from ledgerwise.scale import checked_broadcast, cut_lineage

# Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
BLOCK_WORDS = 16
# Documents of one shard on average, until a source has MAX_SHARDS; then shards grow.
SHARD_DOCS, MAX_SHARDS = 128, 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white-space characters; null is 0."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(words, r"[\x20\x09-\x0D]+", "")).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Rank of every source by code point, null last, from 0, without sorting in one task.

    Range partitions are in order; a rank is the rows of earlier partitions and the rows before
    in one's own. Where the cuts lie doesn't change the ranks.
    """
    dealt = cut_lineage(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    # One row for each partition.
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return (
        dealt.withColumn("_row", F.row_number().over(inside))
        .join(offsets, "_part")
        .withColumn("rank", F.col("_before") + F.col("_row") - 1)
        .drop("_part", "_row", "_before")
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """Columns source, name, source_size, docs and target for a table of sources with their sizes.

    The excess of capped sources is shared again by weight until no source is above its cap. Each
    round is one pass over the source table and gives the driver one row.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = cut_lineage(
        _ranked(sizes).withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size"))
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:
        # A source is capped when its weight times the rate passes its cap.
        over = F.col("cap") <= F.col("weight") * F.lit(rate)
        row = sources.agg(
            F.sum(F.when(over, 1).otherwise(0)),
            F.sum(F.when(over, F.col("cap")).otherwise(0)),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))),
        ).first()
        if row[0] is None or row[0] == capped or not row[2]:
            break
        capped = row[0]
        rate = (total * SHARE_PERCENT / 100 - row[1]) / row[2]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(rate)))
    return sources.select("source", "name", "source_size", "docs", target.alias("target"))


def apportioned(entries: DataFrame, group: list[str], share: str, seats: str, order: str) -> DataFrame:
    """Sainte-Laguë seats: `seats` of each group go to the highest quotients share / (2 k + 1).

    Rounding share / unit, where a unit is one seat's worth, is right but for a few seats of
    difference, at most half as many as there are entries. Only the quotients that can decide those
    few are listed and ranked; equal quotients go by `order`.
    """
    by = Window.partitionBy(*group)
    counted = entries.withColumn("_sum", F.sum(share).over(by)).withColumn("_n", F.count(F.lit(1)).over(by))
    unit = F.when(F.col(seats) > 0, F.col("_sum") / F.col(seats))
    near = counted.withColumn("_ideal", F.coalesce(F.col(share) / unit, F.lit(0.0)))
    near = near.withColumn("_near", F.floor(F.col("_ideal") + 0.5).cast("long"))
    near = near.withColumn("_missing", F.col(seats) - F.sum("_near").over(by))
    # No entry's seats are further from the rounded ones than this.
    reach = (F.ceil(F.col("_ideal") * F.col("_n") / F.greatest(F.col(seats), F.lit(1))) + 1).cast("long")
    first = F.when(F.col("_missing") > 0, F.col("_near")).otherwise(
        F.greatest(F.col("_near") - reach, F.lit(0))
    )
    last = F.when(F.col("_missing") > 0, F.col("_near") + reach - 1).otherwise(F.col("_near") - 1)
    none = F.array().cast("array<bigint>")
    listed = F.when((F.col("_missing") != 0) & (last >= first), F.sequence(first, last)).otherwise(none)
    options = near.where("_missing <> 0").withColumn("_seat", F.explode(listed)).withColumn(
        "_quotient", F.col(share) / (2 * F.col("_seat") + 1)
    )
    best = Window.partitionBy(*group).orderBy(F.col("_quotient").desc(), F.col(order).asc())
    worst = Window.partitionBy(*group).orderBy(F.col("_quotient").asc(), F.col(order).desc())
    place = F.when(F.col("_missing") > 0, F.row_number().over(best)).otherwise(F.row_number().over(worst))
    moved = (
        options.withColumn("_place", place)
        .where(F.col("_place") <= F.abs("_missing"))
        .groupBy(*group, order)
        .agg(F.sum(F.signum("_missing")).cast("long").alias("_moved"))
    )
    keys = list(dict.fromkeys([*group, order]))
    return near.join(moved, keys, "left").select(
        *entries.columns, (F.col("_near") + F.coalesce("_moved", F.lit(0))).alias("quota")
    )


def mixed(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    seed: int = 0,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    keep: dict[str, str] | None = None,
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and the run it lies in.

    `taken` counts the words that the mix takes from the row, at most twice its size. The words of
    the row are number `begins` to `begins + size` of its shard's stream of `stream` words, and the
    run takes `run` words from number `start`, going on at 0 after the end. Null texts have size 0
    and nothing is taken; a null source is a source of its own, ranked last; rows with equal or
    null ids are rows of their own, in an order that texts decide; rows that agree in both may
    change places, but not results. No rows give no rows. `keep` names columns to carry along, and
    what to call them; other columns are not read.
    """
    keep = keep or {}
    text = F.coalesce(F.col(text_column), F.lit(""))
    marked = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(f" {seed}"))
    # A null source gets a name that no source can have, for joins.
    source = F.col(source_column).cast("string")
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        source.alias("_source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).alias("name"),
        word_count(text).alias("size"),
        F.md5(marked.cast("binary")).alias("_mark"),
        F.xxhash64(text).alias("_text"),
        *[F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)],
    )
    narrow = cut_lineage(rows.select("_source", "name", "size", "_mark"))
    sizes = narrow.groupBy(F.col("_source").alias("source"), "name").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")
    )
    targets = source_targets(sizes).withColumn("_all", F.lit(0))
    blocks = F.floor(F.sum("target").over(Window.partitionBy("_all")) / block_words + 0.5).cast("long")
    dealt = apportioned(targets.withColumn("_blocks", blocks), ["_all"], "target", "_blocks", "name")
    shards = F.least(F.ceil(F.col("docs") / SHARD_DOCS), F.lit(MAX_SHARDS)).cast("long")
    dealt, _ = checked_broadcast(
        dealt.select("name", "source_size", "target", F.col("quota").alias("_blocks"), shards.alias("_shards"))
    )
    number = F.conv(F.substring("_mark", 1, 8), 16, 10).cast("long")

    def in_shards(table: DataFrame) -> DataFrame:
        placed = table.join(dealt, "name").withColumn("shard", number % F.col("_shards"))
        return placed.withColumn("_stream", F.concat_ws(" ", F.col("shard"), "name"))

    streams = in_shards(narrow).groupBy("_stream", "name", "shard", "_blocks", "target", "source_size").agg(
        F.sum("size").alias("stream")
    )
    streams = streams.withColumn("share", F.col("target") * F.col("stream") / F.greatest("source_size", F.lit(1)))
    quotas = apportioned(streams, ["name"], "share", "_blocks", "shard")
    run = F.least(F.col("quota") * block_words, CAP * F.col("stream"))
    begin = F.md5(F.concat_ws(" ", "_stream", F.lit(seed)).cast("binary"))
    start = F.conv(F.substring(begin, 1, 8), 16, 10).cast("long")
    start = F.when(F.col("stream") > 0, F.pmod(start * block_words, F.col("stream"))).otherwise(F.lit(0))
    quotas = quotas.select("_stream", "stream", run.alias("run"), start.alias("start"))
    # The key of a stream holds its source and shard, so that rows are dealt out by both.
    order = Window.partitionBy("_stream").orderBy("_mark", "_text", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ordered = in_shards(rows).withColumn("begins", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    done = ordered.join(quotas, "_stream")
    return done.select(
        "doc_id", "size", "source_size", "target", taken().alias("taken"), "begins", "stream", "run",
        "start", *[F.col(f"_keep_{k}").alias(name) for k, name in enumerate(keep.values())],
    )


def mixed_texts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of documents: a row for each time that a text is taken.

    A text that the run takes whole stays as it is. Of a text at an end of the run the words inside
    the run stay, joined by blanks. `n_chars` is the length of what stays.
    """
    carried = {c: f"_carried_{k}" for k, c in enumerate(docs.columns)}
    mix = mixed(docs, seed=seed, keep=carried)
    own = F.col(carried["text"])
    size, begins, stream = F.col("size"), F.col("begins"), F.col("stream")
    turns = F.floor(F.col("run") / stream).cast("int")
    end = F.col("start") + F.col("run") - turns * stream
    whole = F.struct(F.lit(0).cast("long").alias("first"), size.alias("last"))
    direct = F.struct(
        F.greatest(F.col("start") - begins, F.lit(0)).alias("first"),
        (F.least(begins + size, end, stream) - begins).alias("last"),
    )
    around = F.struct(
        F.lit(0).cast("long").alias("first"), (F.least(begins + size, end - stream) - begins).alias("last")
    )
    pieces = F.concat(F.array_repeat(whole, turns), F.array(direct, around))
    pieces = F.filter(pieces, lambda p: p["last"] > p["first"])
    taken_rows = mix.where("taken > 0").withColumn("_piece", F.explode(pieces))
    first, last = F.col("_piece.first"), F.col("_piece.last")
    words = F.regexp_extract_all(own, F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.slice(words, (first + 1).cast("int"), (last - first).cast("int")), " ")
    text = F.when(last - first == size, own).otherwise(part)
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return taken_rows.select(*[made.get(c, F.col(name)).alias(c) for c, name in carried.items()])


def taken() -> Column:
    """Words of a row inside the run: whole turns of the stream and the part of a turn."""
    size, begins, stream = F.col("size"), F.col("begins"), F.col("stream")
    turns = F.when(stream > 0, F.floor(F.col("run") / stream)).otherwise(F.lit(0)).cast("long")
    rest = F.col("run") - turns * stream
    return (turns * size + overlap(begins, size, F.col("start"), rest, stream)).cast("long")


def overlap(begins: Column, size: Column, start: Column, length: Column, stream: Column) -> Column:
    """Common words of [begins, begins + size) and a run of `length` <= `stream` words from `start`."""
    zero = F.lit(0)
    end = start + length
    direct = F.greatest(F.least(begins + size, F.least(end, stream)) - F.greatest(begins, start), zero)
    around = F.greatest(F.least(begins + size, end - stream) - begins, zero)
    return direct + around
