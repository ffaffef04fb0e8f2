"""Word ids that hold for a whole corpus, without a table of all words in any one place.

Blocks of texts number their own distinct words and tell each shard of the dictionary, chosen by the
hash of a word, which of them they hold and how often. A shard compares bytes, counts and numbers its
words, and answers each block. Shards number by the bytes of the written blocks, so one shard is of
one size at every size of the corpus; a frequent word costs one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm import common
from ledgerwise.scale import checked_broadcast, written

SHARD_BYTES = 16 << 20
WORDS_A_ROW = 1 << 16
_MESSAGE = "field string, shard int, block long, words binary, lengths binary, counts binary"
_ANSWER = "field string, shard int, block long, ids binary, words binary, lengths binary, counts binary"


def compact(values: np.ndarray) -> bytes:
    """Numbers from 0 in the narrowest type that holds them all, after a byte that names its width."""
    highest = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if not highest >> (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def expand(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def byte_table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


def word_spans(data: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and which bytes are in words; `outside` marks separating bytes."""
    inside = ~outside[data]
    edges = np.diff(inside.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), inside


def packed_words(data: np.ndarray | bytes, lengths: np.ndarray) -> pa.Array:
    """Words from their bytes laid end to end; 64-bit offsets, so that no text is too long."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def numbered(parts: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the distinct words, and those, in order of appearance."""
    if not parts:
        return np.empty(0, np.int32), packed_words(b"", np.empty(0, np.int32))
    coded = (pa.concat_arrays(parts) if len(parts) > 1 else parts[0]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def unpacked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words laid end to end, and the length of each."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    return np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def segments(text: bytes, cut_after: np.ndarray, limit: int = common.SLICE_BYTES) -> Iterator[np.ndarray]:
    """A text in parts of about `limit` bytes that end with a byte at which it may be cut."""
    data = np.frombuffer(text, np.uint8)
    first = 0
    while len(data) - first > limit:
        size, last = limit, None
        while last is None:
            window = np.flatnonzero(cut_after[data[first : first + size]])
            if len(window):
                last = first + int(window[-1]) + 1
            elif first + size >= len(data):
                last = len(data)
            size *= 2
        yield data[first:last]
        first = last
    if first < len(data):
        yield data[first:]


def one_row(record: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([record[f.name]], f.type) for f in schema], schema=schema)


def word_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words, which hold no white space."""
    apart = np.full(len(data) + len(lengths), 10, np.uint8)
    apart[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data
    return common.hash_words([apart.tobytes()])[0]


def in_hash_order(codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words renumbered by their hashes: those of one shard are neighbours, whatever the number of shards."""
    order = np.argsort(word_hashes(*unpacked(words)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes], words.take(pa.array(order))


def _spans(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    ends = [0, *cuts.tolist(), len(sorted_values)]
    return [(a, b) for a, b in zip(ends, ends[1:]) if b > a]


def _messages(bits: int):
    """A block's words in order of their hashes, cut by the first bits of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                lengths, counts = expand(row["lengths"]), expand(row["counts"])
                if not len(lengths):
                    continue
                data, ends = np.frombuffer(row["words"], np.uint8), np.concatenate(([0], np.cumsum(lengths)))
                hashes = word_hashes(data, lengths)
                shard = (hashes >> np.uint64(64 - bits) if bits else np.zeros_like(hashes)).astype(np.int32)
                spans = _spans(shard)
                yield pa.RecordBatch.from_pydict(
                    {
                        "field": pa.array([row["field"]] * len(spans), pa.string()),
                        "shard": pa.array([int(shard[a]) for a, _ in spans], pa.int32()),
                        "block": pa.array([row["block"]] * len(spans), pa.int64()),
                        "words": pa.array([data[ends[a] : ends[b]].tobytes() for a, b in spans], pa.binary()),
                        "lengths": pa.array([compact(lengths[a:b]) for a, b in spans], pa.binary()),
                        "counts": pa.array([compact(counts[a:b]) for a, b in spans], pa.binary()),
                    }
                )
            common.released()

    return run


def _answers(min_count: int):
    """Number the words of one shard and answer every block; rows without a block list the words.

    Ids are from 1 within the shard, 0 for words that are too rare; of listed words, the number before the first.
    """

    def run(table: pa.Table) -> pa.Table:
        lengths = [expand(x) for x in table.column("lengths").to_pylist()]
        data = b"".join(table.column("words").to_pylist())
        codes, words = numbered([packed_words(data, np.concatenate(lengths))])
        totals = np.zeros(len(words), np.int64)
        np.add.at(totals, codes, np.concatenate([expand(x) for x in table.column("counts").to_pylist()]))
        kept = totals >= min_count
        ids = np.where(kept, np.cumsum(kept), 0)[codes]
        ends = np.cumsum([len(n) for n in lengths]).tolist()
        listed, totals = words.filter(pa.array(kept)), totals[kept]
        parts = range(0, len(listed), WORDS_A_ROW)
        shown = [unpacked(listed.slice(k, WORDS_A_ROW)) for k in parts]
        n, none = table.num_rows, [None] * table.num_rows
        answered = {
            "field": pa.array([table.column("field")[0].as_py()] * (n + len(parts)), pa.string()),
            "shard": pa.array([table.column("shard")[0].as_py()] * (n + len(parts)), pa.int32()),
            "block": pa.array([*table.column("block").to_pylist(), *[None] * len(parts)], pa.int64()),
        }
        packed = {
            "ids": [*[compact(ids[a:b]) for a, b in zip([0, *ends], ends)], *[compact(np.array([k])) for k in parts]],
            "words": [*none, *[x.tobytes() for x, _ in shown]],
            "lengths": [*none, *[compact(x) for _, x in shown]],
            "counts": [*none, *[compact(totals[k : k + WORDS_A_ROW]) for k in parts]],
        }
        common.released()
        return pa.table(answered | {name: pa.array(values, pa.binary()) for name, values in packed.items()})

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words = packed_words(row["words"], expand(row["lengths"]))
            first = row["before"] + int(expand(row["ids"])[0]) + 1
            yield pa.RecordBatch.from_pydict(
                {
                    "field": pa.array([row["field"]] * len(words), pa.string()),
                    "id": pa.array(np.arange(first, first + len(words))),
                    "word": words.cast(pa.binary()),
                    "count": pa.array(expand(row["counts"])),
                }
            )


def ids_of(answers: list[dict] | None) -> np.ndarray:
    """The global id of each word of a block, 0 for those that are too rare."""
    found = [np.empty(0, np.int64)]
    for answer in sorted(answers or [], key=lambda a: a["shard"]):
        own = expand(answer["ids"])
        found.append(np.where(own == 0, 0, own + answer["before"]))
    return np.concatenate(found)


def build(blocks: DataFrame, min_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """Answers for the blocks, and the dictionary.

    `blocks` is a written table with `block`, `field` (words of different fields are different; may be
    null), and the block's distinct words `in_hash_order`: `words` laid end to end, `lengths` and `counts` (`compact`).
    Answers are one row a block: `block` and `answers`, for `ids_of`. The dictionary has field, id (from 1,
    without gaps), word (bytes) and count of all words that occur `min_count` times.
    """
    total = blocks.agg(
        F.coalesce(F.sum(F.length("words") + F.length("lengths") + F.length("counts")), F.lit(0))
    ).first()[0]
    bits = max(0, -(-total // SHARD_BYTES) - 1).bit_length()
    messages = blocks.select("block", "field", "words", "lengths", "counts").mapInArrow(_messages(bits), _MESSAGE)
    answered = written(messages.groupBy("field", "shard").applyInArrow(_answers(min_count), _ANSWER), "dictionary", compression="zstd")
    listed = answered.where(F.col("block").isNull())
    # A byte names the width of the numbers that follow.
    width = F.conv(F.hex(F.substring("lengths", 1, 1)), 16, 10).cast("long")
    n_words = ((F.length("lengths") - 1) / width).cast("long")
    sizes = listed.groupBy("field", "shard").agg(F.sum(n_words).alias("_words"))
    # One row a shard of some megabytes: few rows, even for a large corpus.
    earlier = "coalesce(sum(_words) OVER (ORDER BY field, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    before, _ = checked_broadcast(sizes.select("field", "shard", F.expr(earlier).alias("before")))
    same = F.col("l.field").eqNullSafe(F.col("r.field")) & (F.col("l.shard") == F.col("r.shard"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.alias("l").join(before.alias("r"), same, "left").select("l.*", F.coalesce("before", F.lit(0)).alias("before"))

    replies = placed(answered.where(F.col("block").isNotNull())).groupBy("block").agg(
        F.collect_list(F.struct("shard", "before", "ids")).alias("answers")
    )
    entries = placed(listed).mapInArrow(_listed, "field string, id long, word binary, count long")
    return replies, entries
