"""Records that do not end where lines do, read in parallel from splittable files.

A file is read as lines (or other pieces that end with one character), in splits. Whether a line end also
ends a record depends on all that comes before it: on whether a quote is open and how many brackets are.
Per line that is a small function of the state before it, so tasks sum up their split, the states at the
starts of splits follow from a table of one row a split, and a second pass cuts the records. Only pieces
of records that cross the border of a split are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerwise.scale import cut_lineage

WHOLE, CLOSES, OPENS, BETWEEN = range(4)
_STEPS = ["to0", "to1", "d0", "d1"]


def pieces(spark: SparkSession, path: str, ends_with: str) -> DataFrame:
    """Pieces of text files with their file, split and a number that grows within a split."""
    return spark.read.option("lineSep", ends_with).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _splits(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """Rows of each split in order, split after split; a split lies within one task."""

    def rows():
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("file", "block", *columns)]
            yield from zip(*lists)

    for key, group in groupby(rows(), key=lambda row: row[:2]):
        yield key, (row[2:] for row in group)


def _summaries(skip: int):
    """Per split: the state it ends in and the change of depth, for either state at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), rows in _splits(batches, [*_STEPS, "bytes"]):
            ends, depth, total = [0, 1], [0, 0], 0
            for k, (to0, to1, d0, d1, length) in enumerate(rows):
                total += length
                if block == 0 and k < skip:
                    continue
                for start in (0, 1):
                    depth[start] += (d0, d1)[ends[start]]
                    ends[start] = (to0, to1)[ends[start]]
            yield pa.RecordBatch.from_pydict(
                {"file": [file], "block": pa.array([block], pa.int64()), "bytes": pa.array([total], pa.int64())}
                | {n: pa.array([x], pa.int64()) for n, x in zip(_STEPS, (*ends, *depth))}
            )

    return run


def split_states(summaries: DataFrame) -> DataFrame:
    """The quote state and depth at the start of each split: file, block, quoted, depth.

    Also `last`, whether it is the last split of its file, and `total`, the bytes of all pieces of the file.
    """
    whole = Window.partitionBy("file")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A split turns the state over, keeps it, or ends in one state whatever it starts with. The last kind
    # forgets what was before; from there on turns are counted.
    flips = F.sum(F.when((F.col("to0") == 1) & (F.col("to1") == 0), 1).otherwise(0))
    counted = summaries.withColumns({"_flips": flips.over(upto), "_before": F.coalesce(flips.over(earlier), F.lit(0))})
    fixed = F.when(F.col("to0") == F.col("to1"), (F.col("to0") + F.col("_flips")) % 2)
    last = F.coalesce(F.last(fixed, ignorenulls=True).over(earlier), F.lit(0))
    known = counted.withColumn("quoted", ((last + F.col("_before")) % 2).cast("long"))
    change = F.when(F.col("quoted") == 1, F.col("d1")).otherwise(F.col("d0"))
    return known.withColumn("depth", F.coalesce(F.sum(change).over(earlier), F.lit(0))).select(
        "file", "block", "quoted", "depth",
        (F.col("block") == F.max("block").over(whole)).alias("last"), F.sum("bytes").over(whole).alias("total"),
    )


def _with_last(rows):
    """Rows, and whether each is the last one."""
    before = None
    for row in rows:
        if before is not None:
            yield before, False
        before = row
    if before is not None:
        yield before, True


def _cut(glue: str, skip: int):
    """Records, and pieces of those that cross a border of the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), rows in _splits(batches, ["seq", "value", *_STEPS, "quoted", "depth", "base", "open"]):
            out: list[tuple[int, int, str]] = []
            held: list[str] = []
            inside = None
            for k, ((seq, value, to0, to1, d0, d1, quoted, depth, base, left_open), last) in enumerate(_with_last(rows)):
                if inside is None:
                    state, level = quoted, depth
                    # A file begins at the begin of a record.
                    inside = block > 0 and not (state == 0 and level == base)
                if block == 0 and k < skip:
                    continue
                if not held:
                    first = seq
                if last and left_open:
                    held.append(value)
                    break
                held.append(value + glue)
                level += (d0, d1)[state]
                state = (to0, to1)[state]
                if state == 0 and level == base:
                    out.append((CLOSES if inside else WHOLE, first, "".join(held)))
                    held, inside = [], False
                if len(out) >= 1000:
                    yield _found(file, block, out)
                    out = []
            if held:
                out.append((BETWEEN if inside else OPENS, first, "".join(held)))
            if out:
                yield _found(file, block, out)

    return run


def _found(file: str, block: int, out: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds, numbers, texts = zip(*out)
    return pa.RecordBatch.from_pydict(
        {
            "file": [file] * len(out),
            "block": pa.array([block] * len(out), pa.int64()),
            "kind": pa.array(kinds, pa.int32()),
            "seq": pa.array(numbers, pa.int64()),
            "record": pa.array(texts, pa.string()),
        }
    )


def assembled(lines: DataFrame, glue: str, skip: int = 0, left_open: Column | None = None) -> DataFrame:
    """Records as text: seq (that of the first piece) and record, with `glue` after each piece.

    `left_open` tells, from `total` bytes of pieces with their ends, `size` of the file and `base`, whether
    the file ends without the ending that its last piece seems to have, and that would end a record.

    `lines` are `pieces` with `to0`, `to1` (the quote state after the piece, by that before it), `d0`, `d1`
    (the change of depth) and `base`, the depth between records. The first `skip` pieces of a file count
    nothing; they must lie in its first split. What a file leaves open at its end comes as a record.
    """
    counted = lines.withColumn("bytes", (F.octet_length("value") + 1).cast("long"))
    summaries = cut_lineage(
        counted.select("file", "block", *_STEPS, "bytes").mapInArrow(
            _summaries(skip), "file string, block long, bytes long, " + ", ".join(f"{n} long" for n in _STEPS)
        )
    )
    # One row a split, as in the list of files that the driver has; the order of lines is kept.
    states = F.broadcast(cut_lineage(split_states(summaries)))
    found = lines.join(states, ["file", "block"]).select(
        "file", "block", "seq", "value", *_STEPS, "quoted", "depth", "base",
        (F.col("last") & (F.lit(False) if left_open is None else left_open)).alias("open"),
    )
    cut = found.mapInArrow(_cut(glue, skip), "file string, block long, kind int, seq long, record string")
    whole = cut.where(F.col("kind") == WHOLE).select("seq", "record")
    parts = cut_lineage(cut.where(F.col("kind") != WHOLE))
    # A piece that opens a record starts a group, which the next pieces of the file go on with. Numbers are
    # found without the texts; two pieces a split.
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == OPENS)
    numbered = parts.select(
        "file", "block", "kind", F.sum(F.when(F.col("kind") == OPENS, 1).otherwise(0)).over(order).alias("_group")
    )
    groups = parts.join(numbered, ["file", "block", "kind"]).groupBy("file", "_group")
    joined = groups.agg(
        F.min("seq").alias("seq"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "").alias("record"),
    )
    return whole.unionByName(joined.select("seq", "record"))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of JSON files that hold one array of objects, or objects one after the other.

    Files are cut at closing braces, so one array of any size is read by many tasks. A record that is no
    valid JSON has only nulls.
    """
    lines = pieces(spark, path, "}")
    # What a backslash escapes is never a quote that counts.
    plain = F.regexp_replace("value", r"(?s)\\.", "")

    def change(text: Column) -> Column:
        outside = F.regexp_replace(text, r'(?s)"[^"]*("|$)', "")
        return _count(outside, "[{") - _count(outside, "]")

    odd = _count(plain, '"') % 2
    base = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "seq").alias("_head"))
    # One row a file.
    arrays = base.select("file", F.col("_head").rlike(r"^[\s\x{FEFF}]*\[").cast("long").alias("base"))
    counted = lines.withColumns(
        {
            "to0": odd.cast("long"),
            "to1": (1 - odd).cast("long"),
            # The brace at the end of the piece closes an object where no string is open.
            "d0": (change(plain) - (1 - odd)).cast("long"),
            "d1": (change(F.concat(F.lit('"'), plain)) - odd).cast("long"),
        }
    ).join(F.broadcast(cut_lineage(arrays)), "file")
    # After the last object of an array comes a bracket, so the last piece closes nothing.
    unfinished = (F.col("base") == 1) | (F.col("total") == F.col("size") + 1)
    records = assembled(counted, "}", left_open=unfinished)
    bare = F.regexp_replace("record", r"^[\s,\[\x{FEFF}]+", "")
    kept = records.select(bare.alias("record")).where(F.col("record").rlike(r"[^\s\]}]"))
    return kept.select(F.from_json("record", schema).alias("r")).select("r.*")


def quoted_lines(spark: SparkSession, path: str, separator: str, skip: int) -> DataFrame:
    """Records of delimited text, whose quoted fields may hold line ends: seq and record.

    A quote opens a field only at its start, and two quotes in a quoted field are one.
    """
    lines = pieces(spark, path, "\n")
    start = "(?:^|" + "".join(f"\\x{{{ord(c):x}}}" for c in separator) + ")"
    done = rf'(?s){start}"[^"]*+(?:""[^"]*+)*+"'

    def open_after(text: Column) -> Column:
        return F.regexp_replace(text, done, ";").rlike(f'(?s){start}"').cast("long")

    counted = lines.withColumns(
        {
            "to0": open_after(F.col("value")),
            "to1": open_after(F.concat(F.lit('"'), "value")),
            "d0": F.lit(0).cast("long"), "d1": F.lit(0).cast("long"), "base": F.lit(0).cast("long"),
        }
    )
    records = assembled(counted, "\n", skip)
    return records.select("seq", F.regexp_replace("record", r"\r?\n$", "").alias("record"))
