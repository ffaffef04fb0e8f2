"""Building blocks that keep every operator whole under skew.

Assumptions behind them: one key may hold a third of all rows, tables are wide because
they carry the filing text, and an executor may be lost at any time. So: aggregate before
shuffling, broadcast only after a size check, salt the keys that are hot, and never give
one task a whole group.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows of narrow, fixed-width columns; a few dozen MB at most.
BROADCAST_ROWS = 1_000_000
# A key is hot above this share, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.002
SALTS = 64
# Files of one partition of a partitioned table.
PARTS = 16
# Bytes of a batch of texts that a Python worker gets at once.
PYTHON_BATCH = 2 << 20
# Slices per group for distributed running totals; grows with the cluster between these.
MIN_SLICES, MAX_SLICES = 64, 4096


def spread(df: DataFrame, key: str, bytes_per_core: int = 16 << 20) -> DataFrame:
    """Spread a small scan over all cores before work that is heavy per row.

    A few large row groups would keep most cores idle. Where the input fills the cluster
    anyway, the table is returned as it is and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores, key) if size < cores * bytes_per_core else df


def bound_python_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of PYTHON_BATCH bytes, where the session does not name its own size.

    A batch is held several times over by each worker, and Spark's 64 MB hold thousands of filings.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):
        spark.conf.set(name, PYTHON_BATCH)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Check the size before broadcasting. Stops reading once the limit is passed."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """A narrow table, materialized once, hinted for broadcast if its size allows it.

    Without the materialization the size check and the join would each compute it.
    """
    narrow = cut_lineage(df)
    small = fits_broadcast(narrow, max_rows)
    return (F.broadcast(narrow) if small else narrow), small


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than a share of all rows: at most 1 / share of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    return counts.where(F.col("_rows") > total * F.lit(share)).select(*keys)


def attach_unique(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    row_id: str,
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join many rows to a narrow table that is unique on the keys."""
    right, small = checked_broadcast(right, max_rows)
    return join_unique(left, right, small, keys, row_id, how)


def join_unique(
    left: DataFrame,
    right: DataFrame,
    small: bool,
    keys: list[str],
    row_id: str,
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """As `attach_unique`, for a right side that went through `checked_broadcast`.

    A small right side is broadcast. Otherwise both sides are shuffled, and only the hot
    keys of the left side are spread over salts, to which their one right row is copied.
    """
    if small:
        return left.join(right, keys, how)
    # Both sides use the hot keys, which are few; each would scan the left table for them.
    hot = F.broadcast(cut_lineage(hot_keys(left, keys).withColumn("_hot", F.lit(True))))
    # Rows with a NULL key match nothing, so they may lie anywhere.
    anywhere = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.coalesce("_hot", F.lit(False)))
    salt = F.when(anywhere, F.pmod(F.xxhash64(row_id), F.lit(salts))).otherwise(F.lit(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted_left = left.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    salted_right = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Sequence number of the first row of every key; NULL keys are equal.

    `min` combines on the map side, so a hot key costs one row per task.
    """
    return df.groupBy(*keys).agg(F.min(seq).alias(seq)).select(seq)


def later_copies(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Sequence numbers of the rows that are not the first of their key."""
    return df.select(seq).join(first_per_key(df, keys, seq), seq, "left_anti")


def keep_first(
    df: DataFrame, keys: list[str], seq: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """First row per key, by the unique column `seq`.

    Only keys and sequence numbers are shuffled to find the later copies. When those are
    few, the wide rows are not shuffled at all; when they are many, the wide rows move
    once, by `seq`, which cannot be skewed.
    """
    narrow = df.select(seq, *[k for k in keys if k != seq])
    losers, _ = checked_broadcast(later_copies(narrow, keys, seq), max_rows)
    return df.join(losers, seq, "left_anti")


def flag_later_copies(
    df: DataFrame, identifier: Column, applies: Column, seq: str, flag: str
) -> DataFrame:
    """Boolean column: the row repeats an identifier seen at a smaller `seq`."""
    narrow = df.select(F.col(seq), identifier.alias("_id"), applies.alias("_applies"))
    losers = later_copies(narrow.where("_applies"), ["_id"], seq)
    marked, _ = checked_broadcast(losers.withColumn("_later", F.lit(True)))
    return df.join(marked, seq, "left").withColumn(
        flag, F.coalesce(F.col("_later"), F.lit(False))
    ).drop("_later")


def calendar_year(year: Column) -> Column:
    """The year, checked to be one of 9,999 calendar years.

    Tables grouped by the checked column have a proven size bound, so they may be
    broadcast or go through one window.
    """
    message = F.concat(F.lit("not a calendar year: "), year.cast("string"))
    return F.when(year.between(1, 9999) | year.isNull(), year).otherwise(
        F.raise_error(message).cast("int")
    )


def _slices(spark: SparkSession) -> int:
    """A power of two near the number of cores, so that one huge group uses them all."""
    cores = spark.sparkContext.defaultParallelism
    return min(MAX_SLICES, max(MIN_SLICES, 1 << (cores - 1).bit_length()))


def _count_below(bounds: Column, value: Column, slices: int) -> Column:
    """How many of the sorted bounds lie below the value, by halving; slices is 2^k."""
    steps = [slices >> k for k in range(1, slices.bit_length())]

    def halve(below: Column, step: Column) -> Column:
        return below + F.when(F.element_at(bounds, below + step) < value, step).otherwise(0)

    return F.aggregate(F.array(*[F.lit(step) for step in steps]), F.lit(0), halve)


def _place(table: DataFrame, order: str) -> Column:
    """A number that grows with the order column; of texts, that of their first seven bytes."""
    if dict(table.dtypes)[order] != "string":
        return F.col(order)
    start = F.rpad(F.hex(F.substring(F.col(order).cast("binary"), 1, 7)), 14, "0")
    return F.conv(start, 16, 10).cast("long")


def running_totals(
    table: DataFrame,
    groups: list[str],
    order: str,
    totals: dict[str, str],
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Inclusive running sums per group, without putting a group into one task.

    `table` must hold each (groups, order) pair once and few groups (years, features). It
    is read several times, so callers pass the result of `cut_lineage`.
    Approximate quantiles cut every group into slices of about equal size. Sums inside a
    slice come from a window over that slice, and the sum of all earlier slices is added
    from a table of one row per slice. The result is exact; only the cuts are approximate.
    """
    slices = slices or _slices(table.sparkSession)
    cuts = [k / slices for k in range(1, slices)]
    place = _place(table, order)
    bounds = table.groupBy(*groups).agg(
        F.percentile_approx(place, cuts, 10 * slices).alias("_bounds")
    )
    below = _count_below(F.col("_bounds"), place, slices)
    sliced = table.join(F.broadcast(bounds), groups).withColumn(
        "_slice", -below if descending else below
    ).drop("_bounds")

    per_slice = sliced.groupBy(*groups, "_slice").agg(
        *[F.sum(source).alias(f"_all_{name}") for name, source in totals.items()]
    )
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = per_slice.select(
        *groups,
        "_slice",
        *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in totals],
    )
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*groups, "_slice").orderBy(direction).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = sliced.withColumns(
        {f"_in_{name}": F.sum(source).over(inside) for name, source in totals.items()}
    )
    # At most `slices` rows per group, so this broadcast is bounded like `bounds` is.
    return running.join(F.broadcast(offsets), [*groups, "_slice"]).select(
        *table.columns,
        *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in totals],
    )


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, probabilities: tuple[float, ...]
) -> DataFrame:
    """Exact interpolated quantiles per group, as one array column `quantiles`.

    Works on the histogram of distinct values with distributed running totals, so no
    task holds the values of a group. NULL and NaN are left out.
    """
    by = groups or ["_all"]
    source = df if groups else df.withColumn("_all", F.lit(0))
    number = F.col(value).cast("double")
    histogram = cut_lineage(
        source.where(number.isNotNull() & ~F.isnan(number))
        .groupBy(*by, number.alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    sizes = histogram.groupBy(*by).agg(F.sum("_n").alias("_size"))
    ranked = running_totals(histogram, by, "_value", {"_upto": "_n"}).join(
        F.broadcast(sizes), by
    )
    picks = []
    for i, p in enumerate(probabilities):
        position = (F.col("_size") - 1) * F.lit(float(p))
        for name, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            holds = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(holds, F.col("_value"))).alias(f"_{name}{i}"))
    picked = ranked.groupBy(*by, "_size").agg(*picks)
    values = []
    for i, p in enumerate(probabilities):
        position = (F.col("_size") - 1) * F.lit(float(p))
        step = position - F.floor(position)
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        values.append(low + (high - low) * step)
    return picked.select(*groups, F.array(*values).alias("quantiles"))


def bracketed_quantiles(
    df: DataFrame, groups: list[str], columns: list[str], probability: float, accuracy: int = 10_000
) -> DataFrame:
    """Exact interpolated quantile of each column per group: groups, and a column of the same name.

    Approximate quantiles a little below and above bracket the wanted ranks. A second pass counts what lies
    below each bracket and keeps only the values inside it, a few in ten thousand and ties, which are few
    when counted. So values are neither multiplied nor shuffled. NULL and NaN are left out. There are few
    groups (classes); their bounds are broadcast.
    """
    by = groups or ["_all"]
    df = df if groups else df.withColumn("_all", F.lit(0))

    def number(name: str) -> Column:
        value = F.col(f"`{name}`").cast("double")
        return F.when(~F.isnan(value), value)

    # The error of an approximate quantile is at most 1 / accuracy of the rows. Where that is hardly more than
    # one row, the bracket is the whole range.
    ends = [max(0.0, probability - 2 / accuracy), min(1.0, probability + 2 / accuracy)]
    bounds = []
    for name in columns:
        value = number(name)
        low, high = (F.percentile_approx(value, F.lit(end), accuracy) for end in ends)
        few = F.count(value) * F.lit(2 / accuracy) < 3
        bounds.append(
            F.struct(
                F.when(few | F.lit(ends[0] == 0), F.min(value)).otherwise(low).alias("low"),
                F.when(few | F.lit(ends[1] == 1), F.max(value)).otherwise(high).alias("high"),
                F.count(value).alias("size"),
            ).alias(f"_{name}")
        )
    bounds = cut_lineage(df.groupBy(*by).agg(*bounds))
    sides = df.join(F.broadcast(bounds), by)

    def bound(name: str, which: str) -> Column:
        return F.col(f"`_{name}`.`{which}`")

    below = sides.groupBy(*by).agg(
        *[F.count_if(number(n) < bound(n, "low")).alias(n) for n in columns]
    )
    inside = [
        F.when(number(n).between(bound(n, "low"), bound(n, "high")), F.struct(F.lit(k).alias("at"), number(n).alias("value")))
        for k, n in enumerate(columns)
    ]
    counted = cut_lineage(
        sides.select(*by, F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("x"))
        .groupBy(*by, "x.at", "x.value").agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counted, [*by, "at"], "value", {"_upto": "_n"})
    places = F.explode(
        F.array(*[
            F.struct(F.lit(k).alias("at"), F.lit(n).alias("name"), F.col(f"`{n}`").alias("below"), bound(n, "size").alias("size"))
            for k, n in enumerate(columns)
        ])
    ).alias("p")
    sized = below.join(F.broadcast(bounds), by).select(*by, places).select(*by, "p.*")
    position = (F.col("size") - 1) * F.lit(float(probability))
    upto, before = F.col("below") + F.col("_upto"), F.col("below") + F.col("_upto") - F.col("_n")

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < upto), F.col("value")))

    picked = ranked.join(F.broadcast(sized), [*by, "at"]).groupBy(*by, "name", "size").agg(
        at_rank(F.floor(position)).alias("low"), at_rank(F.ceil(position)).alias("high")
    )
    step = position - F.floor(position)
    missing = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    low, high = F.coalesce("low", missing), F.coalesce("high", missing)
    values = picked.select(*by, "name", (low + (high - low) * step).alias("value"))
    return values.groupBy(*by).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in columns]
    ).select(*groups, *[f"`{n}`" for n in columns])


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent, as in local tests, a temporary folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="ledgerwise-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(
    df: DataFrame,
    name: str,
    partition_by: str | None = None,
    row_id: str | None = None,
    compression: str = "snappy",
) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later steps read only the columns and partitions they need, and lost executors do not
    repeat the work that produced it. Rows are dealt out by partition and a hash of the row id, so
    each partition is written by at most PARTS tasks, and nothing is read twice to find ranges.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    if partition_by:
        part = F.pmod(F.xxhash64(row_id), F.lit(PARTS))
        df.repartition(F.col(partition_by), part).write.partitionBy(partition_by).parquet(path, compression=compression)
    else:
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder, known to Spark as the place of reliable checkpoints."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, which survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
