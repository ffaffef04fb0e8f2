"""Structured Streaming forms of cleaning, quality filtering and deduplication."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ledgerwise.operators import quality
from ledgerwise.scale import shared_folder

# Buckets of keys that share one piece of state.
BUCKETS = 4096


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, name_glob: str = "*.parquet"
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name_glob)
        .option("maxFilesPerTrigger", 1000)
        .parquet(folder)
    )


def clean_and_filter(filings: DataFrame, **limits) -> DataFrame:
    """Stateless: the batch function works on a stream as it is."""
    return quality.clean_and_filter(filings, **limits)


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The whole record that first brings each key, across all batches and runs.

    The state holds every key for ever, as exact deduplication of an endless input must; set
    `spark.sql.streaming.stateStore.providerClass` to the RocksDB provider where it outgrows memory.
    """
    return stream.dropDuplicates(keys)


def first_by_sequence(stream: DataFrame, keys: list[str], seq: str, buckets: int = BUCKETS) -> DataFrame:
    """A log of the smallest sequence number of each key: keys, `seq`, and the number it replaces or null.

    Records may arrive late: an earlier one that comes in a later batch or run gives a correction. Tasks first
    keep the smallest number of each key of a piece of their input, so a hot key reaches its state as a few
    rows a task. Keys are dealt to buckets by their hash; the state holds one number for every key for ever, as
    one Arrow table a bucket, so that Python works on tables, not on keys. A batch writes the buckets again in
    which a key is new or corrected. A run that goes on from an earlier one must keep its number of buckets.
    Null keys are equal; records without a number are left out. `current_firsts` reads the log.
    """
    kinds = dict(stream.dtypes)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    slim = stream.select(bucket, *keys, seq).where(F.col(seq).isNotNull())
    fields = ", ".join(f"`{n}` {kinds[n]}" for n in [*keys, seq])
    by = ["_bucket", *keys]

    def smallest(batches):
        for batch in batches:
            least = pa.Table.from_batches([batch]).group_by(by).aggregate([(seq, "min")])
            yield from least.rename_columns([*by, seq]).select([*by, seq]).cast(batch.schema).to_batches()

    # Keys travel as rows of one Arrow stream a piece: pandas would change their types.
    def packed(batches):
        for batch in smallest(batches):
            order = pc.sort_indices(batch, sort_keys=[("_bucket", "ascending")])
            batch = batch.take(order)
            numbers = batch.column("_bucket").to_numpy()
            starts = np.flatnonzero(np.diff(numbers, prepend=-1))
            ends = [*starts[1:].tolist(), len(numbers)]
            pieces = [_to_bytes(batch.slice(a, b - a).drop_columns(["_bucket"])) for a, b in zip(starts.tolist(), ends)]
            yield pa.RecordBatch.from_pydict({"_bucket": pa.array(numbers[starts], pa.int32()), "rows": pa.array(pieces, pa.binary())})

    def corrected(_, pieces, state):
        fresh = pa.concat_tables(_from_bytes(rows) for piece in pieces for rows in piece["rows"])
        known = _from_bytes(state.get[0]) if state.exists else fresh.slice(0, 0)
        ages = [known.append_column("_new", pa.array(np.zeros(len(known), bool))), fresh.append_column("_new", pa.array(np.ones(len(fresh), bool)))]
        both = pa.concat_tables(ages)
        old = pc.if_else(both["_new"], pa.scalar(None, both.schema.field(seq).type), both[seq])
        least = both.append_column("_old", old).group_by(keys).aggregate([(seq, "min"), ("_old", "min")])
        least = least.rename_columns([*keys, seq, "replaces"])
        changed = least.filter(pc.fill_null(pc.less(least[seq], least["replaces"]), True))
        if len(changed):
            state.update((_to_bytes(least.select([*keys, seq]).cast(fresh.schema)),))
            yield pd.DataFrame({"rows": [_to_bytes(changed)]})

    def unpacked(batches):
        for batch in batches:
            for rows in batch.column("rows"):
                table = _from_bytes(rows.as_py())
                columns = [table[n].combine_chunks() for n in [*keys, seq]] + [table["replaces"].cast(pa.int64()).combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, [*keys, seq, "replaces"])

    return (
        slim.mapInArrow(packed, "_bucket int, rows binary")
        .groupBy("_bucket")
        .applyInPandasWithState(corrected, "rows binary", "rows binary", "update", GroupStateTimeout.NoTimeout)
        .mapInArrow(unpacked, f"{fields}, replaces long")
    )


def _to_bytes(rows: pa.Table | pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write(rows)
    return out.getvalue()


def _from_bytes(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def current_firsts(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The smallest sequence number of each key, after all corrections."""
    return log.groupBy(*keys).agg(F.min(seq).alias(seq))


def first_seen_within(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Bounded state: copies that arrive within the delay of the first are dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def run_log(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """As `run_available`, for a stream of updates: each batch's rows are written under its number.

    A batch that is repeated after a loss overwrites what it had written.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/data/batch={number}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{base}/progress")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{base}/data")


def run_available(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Process everything that is there, then read back all that runs on this base have written.

    `base` is the caller's folder for output, progress and state: a later run, or one after a lost
    driver, goes on from the last committed batch. Without it the run is one of its own, in a new
    folder below the shared one.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/progress")
        .option("path", f"{base}/data")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")
