"""Line deduplication through a sharded minimal perfect hash.

The distinct line hashes of the corpus are dealt into shards. Each shard holds a minimal perfect
hash over its hashes and two compact arrays in its order: fingerprints and document counts.
Documents do not join lines. A block of documents sends each shard the distinct hashes of its
lines once, the shard probes its arrays, and the block gets back which of them are frequent. A
line that a third of all documents hold therefore costs one entry for each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm import common
from ledgerwise.scale import written

# ASCII white space, as it may stand at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
# Documents whose lines share one set of messages to the shards.
BLOCK_BYTES = 4 << 20
# Slots for each hash on the first level of a minimal perfect hash.
ROOM = 2


def line_keys(text: bytes) -> list[bytes]:
    """Every line without white space at its ends and with A-Z in lower case."""
    return [line.strip(BLANKS) for line in text.lower().split(b"\n")]


def line_hashes(keys: list[bytes], min_points: int) -> np.ndarray:
    """64-bit hashes of line keys; 0 stands for a key too short to be counted."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(
        (
            digest(key) | 1 if len(key) >= min_points and _points(key) >= min_points else 0
            for key in keys
        ),
        np.uint64,
        len(keys),
    )


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


@dataclass(frozen=True)
class PerfectHash:
    """Maps n known hashes one to one to 0..n-1; unknown hashes to anything or to -1.

    On each level the hashes that have a slot to themselves are placed; the others go to the next
    level. A hash's number is the count of occupied slots before its own.
    """

    levels: list[np.ndarray]

    @staticmethod
    def build(hashes: np.ndarray) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            size = ROOM * len(left) + 1
            slots = _slots(left, len(levels), size)
            counts = np.bincount(slots, minlength=size)
            levels.append(counts == 1)
            left = left[counts[slots] > 1]
        return PerfectHash(levels)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        found, before = np.full(len(hashes), -1, np.int64), 0
        for depth, level in enumerate(self.levels):
            slots = _slots(hashes, depth, len(level))
            ranks = np.cumsum(level) - 1
            here = level[slots] & (found < 0)
            found[here] = before + ranks[slots[here]]
            before += int(level.sum())
        return found


def _slots(hashes: np.ndarray, depth: int, size: int) -> np.ndarray:
    salted = common.mix64(hashes + np.uint64(0x9E3779B97F4A7C15 * (depth + 1) % (1 << 64)))
    return (salted % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class LineIndex:
    """One shard: minimal perfect hash, 16-bit fingerprints and document counts."""

    perfect: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray) -> LineIndex:
        perfect = PerfectHash.build(hashes)
        numbers = perfect.numbers(hashes)
        marks, sums = np.empty(len(hashes), np.uint16), np.empty(len(hashes), np.uint32)
        marks[numbers], sums[numbers] = _marks(hashes), np.minimum(counts, 0xFFFFFFFF)
        return LineIndex(perfect, marks, sums)

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Document counts; 0 for a hash whose fingerprint says that it is not indexed."""
        numbers = self.perfect.numbers(hashes)
        if not len(self.counts):
            return np.zeros(len(hashes), np.uint32)
        known = (numbers >= 0) & (self.fingerprints[numbers] == _marks(hashes))
        return np.where(known, self.counts[numbers], 0)


def _marks(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.uint16)


def _blocks(min_points: int):
    """Pack the line hashes of a task's documents into blocks of bounded size, named by their content."""

    def block(keys, hashes):
        name = xxhash.xxh3_64(b"".join(k.to_bytes(8, "little", signed=True) for k in keys))
        lengths = np.array([len(h) // 8 for h in hashes], np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([np.uint64(name.intdigest()).astype(np.int64)], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())),
                pa.array([lengths.tolist()], pa.list_(pa.int32())),
                pa.array([b"".join(hashes)], pa.binary()),
            ],
            ["block", "keys", "lengths", "hashes"],
        )

    def run(batches):
        keys, hashes, size = [], [], 0
        for part in common.slices(batches):
            for key, text in zip(part.column("_key").to_pylist(), common.blobs(part.column("text"))):
                keys.append(key)
                hashes.append(line_hashes(line_keys(text), min_points).tobytes())
                size += len(hashes[-1]) + 8
                if size >= BLOCK_BYTES:
                    yield block(keys, hashes)
                    keys, hashes, size = [], [], 0
        if keys:
            yield block(keys, hashes)

    return run


def _messages(shards: int):
    """For each block and shard: the distinct hashes of the block's lines, and their documents."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                flat = np.frombuffer(row["hashes"], np.uint64)
                owner = np.repeat(np.arange(len(row["lengths"])), row["lengths"])
                order = np.lexsort((owner, flat))
                flat, owner = flat[order], owner[order]
                first = np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])][: len(flat)]
                hashes, counts = np.unique(flat[first], return_counts=True)
                hashes, counts = hashes[hashes != 0], counts[hashes != 0].astype(np.uint32)
                shard = (common.mix64(hashes) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                parts = [p for p in np.split(order, cuts) if len(p)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(shard[p[0]]) for p in parts], pa.int32()),
                        pa.array([row["block"]] * len(parts), pa.int64()),
                        pa.array([hashes[p].tobytes() for p in parts], pa.binary()),
                        pa.array([counts[p].tobytes() for p in parts], pa.binary()),
                    ],
                    ["shard", "block", "hashes", "counts"],
                )

    return run


def _shard_replies(min_documents: int):
    """Build a shard's index from all its messages, then probe it with each of them."""

    def run(messages: pa.Table) -> pa.Table:
        got = [np.frombuffer(b, np.uint64) for b in messages.column("hashes").to_pylist()]
        hashes, owner = np.unique(np.concatenate(got), return_inverse=True)
        counts = np.concatenate(
            [np.frombuffer(b, np.uint32) for b in messages.column("counts").to_pylist()]
        )
        index = LineIndex.build(hashes, np.bincount(owner, counts, len(hashes)).astype(np.int64))
        replies = [h[index.probe(h) >= min_documents] for h in got]
        table = pa.table(
            {
                "block": messages.column("block"),
                "frequent": pa.array([r.tobytes() for r in replies], pa.binary()),
            }
        )
        return table.filter(pa.array([len(r) > 0 for r in replies], pa.bool_()))

    return run


def _masks(batches):
    """For documents that lose lines: one bit for each line, set where the line goes."""
    for batch in batches:
        for row in batch.to_pylist():
            frequent = np.unique(np.frombuffer(b"".join(row["replies"]), np.uint64))
            gone = np.isin(np.frombuffer(row["hashes"], np.uint64), frequent)
            ends = np.cumsum(row["lengths"])
            pairs = [
                (key, np.packbits(gone[end - n : end]).tobytes())
                for key, n, end in zip(row["keys"], row["lengths"], ends.tolist())
                if gone[end - n : end].any()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pairs], pa.int64()),
                    pa.array([p[1] for p in pairs], pa.binary()),
                ],
                ["_key", "mask"],
            )


def _rewrite(batches):
    for part in common.slices(batches):
        lines, dropped, texts = [], [], []
        for text, mask in zip(common.blobs(part.column("text")), part.column("mask").to_pylist()):
            own = text.split(b"\n")
            lines.append(len(own))
            if mask is None:
                dropped.append(0)
                texts.append(text)
                continue
            gone = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(own)).astype(bool)
            dropped.append(int(gone.sum()))
            texts.append(b"\n".join(own[k] for k in np.flatnonzero(~gone).tolist()))
        rest = [n for n in part.schema.names if n not in ("text", "mask")]
        yield pa.RecordBatch.from_arrays(
            [
                *[part.column(n) for n in rest],
                pa.array(lines, pa.int64()),
                pa.array(dropped, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ],
            [*rest, "n_lines", "n_dropped", "kept_text"],
        )


def frequent_line_masks(docs: DataFrame, min_documents: int, min_points: int) -> DataFrame:
    """Columns `_key` and `mask` for the documents that hold lines of many documents.

    `docs` has `_key` (a hash of id and text) and `text` as bytes. Rows are documents, so a
    repeated row counts again; equal rows get equal masks.
    """
    spark = docs.sparkSession
    blocks = written(
        docs.mapInArrow(
            _blocks(min_points), "block long, keys array<long>, lengths array<int>, hashes binary"
        ),
        "line-blocks",
    )
    # A shard's hashes fit one task: one shard for each shuffle partition.
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    messages = blocks.mapInArrow(
        _messages(shards), "shard int, block long, hashes binary, counts binary"
    )
    replies = messages.groupBy("shard").applyInArrow(
        _shard_replies(min_documents), "block long, frequent binary"
    )
    # A block has one reply from each shard at most, together no larger than the block.
    replies = replies.groupBy("block").agg(F.collect_list("frequent").alias("replies"))
    return blocks.join(replies, "block").mapInArrow(_masks, "_key long, mask binary").dropDuplicates(
        ["_key"]
    )


def drop_frequent_lines(
    docs: DataFrame,
    min_documents: int = 10,
    min_points: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_text, and the columns named in `keep`.

    Lines end at a line feed. Two lines are the same when they agree without white space at their
    ends and in lower case (A-Z). A line of at least `min_points` code points that at least
    `min_documents` rows hold is dropped everywhere, also from those that repeat it. A null text
    counts as empty: one empty line, which is never dropped by default. Ids may be null or
    repeated; each row is a document. Other columns are not read. No rows give no rows.
    """
    docs = docs.select(
        F.col(id_column).alias("doc_id"),
        common.text_bytes(text_column).alias("text"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    docs = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    masks = frequent_line_masks(docs.select("_key", "text"), min_documents, min_points)
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n not in ("_key", "text"))
    done = (
        docs.join(masks, "_key", "left")
        .drop("_key")
        .mapInArrow(_rewrite, f"{kinds}, n_lines long, n_dropped long, kept_text string")
    )
    return done.select(
        "doc_id", "n_lines", "n_dropped", "kept_text", *[F.col(f"_keep_{c}").alias(c) for c in keep]
    )
