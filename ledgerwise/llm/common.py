"""Helpers that several operators of this subpackage share.

Texts reach Python tasks as UTF-8 bytes, in slices of bounded size, so that memory follows the
slice and the longest single text, never the partition. A word is a run of bytes other than
the six ASCII white-space characters; A-Z count as a-z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A character that is not white space, as contracts state it.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Two prime fields below 2^31, and a base for each.
_FIELDS = ((2147483647, 1103527590), (2147483629, 48271 * 40503))
# Texts are hashed in pieces of about so many bytes; words beyond the second number are hashed whole.
PIECE_BYTES, LONG_WORD = 1 << 20, 1 << 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_remainder(key: Column, modulus: int) -> Column:
    """CRC-32 of a key written as text, modulo a number; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_bytes(text: str | Column) -> Column:
    """A text as bytes; null is empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("binary"), F.lit(b""))


@cache
def _trim():
    """The C library's function that returns free memory, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda kept: 0


def released() -> None:
    """Give back memory that is no longer used: an executor's workers wait for tasks side by side."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about `limit` bytes of one column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        filled = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), batch.num_rows]
        for first, last in zip(cuts, cuts[1:]):
            if last > first:
                yield batch.slice(first, last - first)
    released()
    released()


def mix64(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one, so that every bit depends on all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@cache
def _powers(prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse in a prime field, for the places of a piece."""
    out = []
    for factor in (base % prime, pow(base, -1, prime)):
        powers = np.ones(1, np.uint64)
        while len(powers) < PIECE_BYTES:
            step = np.uint64(pow(factor, len(powers), prime))
            powers = np.concatenate((powers, powers * step % np.uint64(prime)))
        out.append(powers[:PIECE_BYTES].astype(np.uint32))
    return out[0], out[1]


def _piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words of a piece: polynomials over two prime fields, which have no bad inputs known.

    A field's polynomial is summed up along the piece, and a word's value is the difference of two sums,
    shifted back to the word's start. Sums of a piece stay below 2^60.
    """
    wide, parts = data.astype(np.uint64) + np.uint64(1), []
    for prime, base in _FIELDS:
        up, down = _powers(prime, base)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(wide * up[: len(data)], out=sums[1:])
        parts.append((sums[ends] - sums[starts]) % np.uint64(prime) * down[starts] % np.uint64(prime))
    return mix64(parts[0] | (parts[1] << np.uint64(32)))


def hash_words(texts: list[bytes], prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and where each text's words begin.

    With `prefix`, hashes of the first so many bytes of each word. Texts are hashed in pieces that end
    between words, so that beside the texts only a piece and the hashes take memory. A word of more than
    LONG_WORD bytes is hashed by itself.
    """
    joined = b"\n".join(texts)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    found, begins, first = [], [], 0
    while first < len(joined):
        last = min(first + PIECE_BYTES, len(joined))
        data = np.frombuffer(joined[first:last].lower(), np.uint8)
        edges = np.diff((~_SPACE[data]).view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if last < len(joined) and len(ends) and ends[-1] == len(data):
            # The last word may go on: it belongs to the next piece, or is longer than a piece.
            if starts[-1] > 0:
                last, starts, ends = first + int(starts[-1]), starts[:-1], ends[:-1]
            else:
                while last < len(joined) and not _SPACE[joined[last]]:
                    rest = np.flatnonzero(_SPACE[np.frombuffer(joined[last : last + PIECE_BYTES], np.uint8)])
                    last = last + int(rest[0]) if len(rest) else min(last + PIECE_BYTES, len(joined))
                ends = np.array([last - first])
        stops = ends if prefix is None else np.minimum(ends, starts + prefix)
        long = np.flatnonzero(stops - starts > LONG_WORD)
        shown = stops.copy()
        shown[long] = starts[long]
        hashes = _piece_hashes(data, starts, shown)
        for k in long.tolist():
            word = joined[first + int(starts[k]) : first + int(stops[k])].lower()
            hashes[k] = xxhash.xxh3_64_intdigest(word)
        found.append(hashes)
        begins.append(starts + first)
        first = last
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(begins), offsets)


def chain(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of sequences, each extended by one more word."""
    return mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + following)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of all runs of `words` words of each text.

    A text of fewer words has one, the whole sequence; a text without words has none.
    """
    hashes, bounds = hash_words(texts)
    starts = max(0, len(hashes) - words + 1)
    runs = np.full(starts, words, np.uint64)
    for k in range(words):
        runs = chain(runs, hashes[k : k + starts])
    sets = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = last - first
        if n >= words:
            sets.append(np.unique(runs[first : last - words + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for k in range(first, last):
                whole = chain(whole, hashes[k : k + 1])
            sets.append(whole)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def blobs(column: pa.Array) -> list[bytes]:
    """The values of a binary or string column as bytes; null is empty."""
    return [value if value is not None else b"" for value in column.cast(pa.binary()).to_pylist()]
