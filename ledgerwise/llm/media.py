"""Media columns: what stored bytes are, found by their signatures and confirmed by their structure.

An Aho-Corasick automaton over the magic bytes of known formats finds every place where an object
may begin. A validator of the format then follows the object's own headers and lengths. Only
objects that pass are reported: the one at the start gives the true type of the column value, the
others are embedded media to carve out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm import common
from ledgerwise.scale import written

# Fixed values of the formats: magic bytes, and where they stand in the object.
MAGIC = {
    "audio/wav": [(b"RIFF", 0)],
    "image/png": [(b"\x89PNG\r\n\x1a\n", 0)],
    "image/gif": [(b"GIF87a", 0), (b"GIF89a", 0)],
    "image/bmp": [(b"BM", 0)],
    "image/jpeg": [(b"\xff\xd8\xff", 0)],
    "application/gzip": [(b"\x1f\x8b\x08", 0)],
    "application/zip": [(b"PK\x03\x04", 0)],
    "application/pdf": [(b"%PDF-", 0)],
}
RATE = 16_000
BLOCK = 64


def _u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def wav_length(data: bytes, start: int) -> int:
    """Length of a RIFF/WAVE object whose chunks fill it and which has a format before its data."""
    if data[start + 8 : start + 12] != b"WAVE":
        return 0
    end, at, has_format, has_data = start + 8 + _u32(data, start + 4), start + 12, False, False
    while at + 8 <= end <= len(data):
        name, size = data[at : at + 4], _u32(data, at + 4)
        has_format |= name == b"fmt " and size >= 16
        has_data |= name == b"data" and has_format
        at += 8 + size + size % 2
    return end - start if at == end and has_data else 0


def png_length(data: bytes, start: int) -> int:
    """Length of a PNG object that begins with IHDR, has right checksums and ends with IEND."""
    at = start + 8
    if data[at + 4 : at + 8] != b"IHDR":
        return 0
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        body = data[at + 4 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(body) != int.from_bytes(
            data[at + 8 + size : at + 12 + size], "big"
        ):
            return 0
        at += 12 + size
        if body[:4] == b"IEND":
            return at - start
    return 0


def gif_length(data: bytes, start: int) -> int:
    """Length of a GIF object whose blocks lead to its trailer."""
    at = start + 13
    if at > len(data):
        return 0
    if data[start + 10] & 0x80:
        at += 3 << ((data[start + 10] & 7) + 1)
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return at + 1 - start
        if kind == 0x2C and at + 10 <= len(data):
            packed = data[at + 9]
            at += 11 + ((3 << ((packed & 7) + 1)) if packed & 0x80 else 0)
        elif kind == 0x21:
            at += 2
        else:
            return 0
        while at < len(data) and data[at]:
            at += 1 + data[at]
        at += 1
    return 0


def bmp_length(data: bytes, start: int) -> int:
    """Length of a BMP object whose sizes, offsets and pixel rows agree."""
    if start + 54 > len(data) or _u32(data, start + 14) != 40:
        return 0
    total, pixels = _u32(data, start + 2), _u32(data, start + 10)
    width, height, planes, bits, packing = struct.unpack_from("<iihhI", data, start + 18)
    if width <= 0 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packing:
        return 0
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    fits = pixels >= 54 and pixels + rows <= total and start + total <= len(data)
    return total if fits else 0


def gzip_length(data: bytes, start: int) -> int:
    """Length of a gzip member that unpacks and whose checksum is right."""
    unpacker = zlib.decompressobj(31)
    try:
        for at in range(start, len(data), 1 << 16):
            unpacker.decompress(data[at : at + (1 << 16)])
            if unpacker.eof:
                return min(at + (1 << 16), len(data)) - len(unpacker.unused_data) - start
    except zlib.error:
        return 0
    return 0


class Marks:
    """End marks of a value, each found once, so that a value full of beginnings is not searched for each."""

    # A cross reference with its place and the end mark; the number of an object.
    STARTXREF = re.compile(rb"startxref\s+(\d{1,12})\s+%%EOF")
    OBJECT = re.compile(rb"(?<!\d)(\d++)\s++\d++\s++obj")

    def __init__(self, data: bytes):
        self.data = data

    def places(self, mark: bytes) -> np.ndarray:
        return np.array([m.start() for m in re.finditer(re.escape(mark), self.data)], np.int64)

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """End of the first directory that says that its object begins at a place."""
        ends: dict[int, int] = {}
        for at in self.places(b"PK\x05\x06").tolist():
            if at + 22 <= len(self.data):
                comment = int.from_bytes(self.data[at + 20 : at + 22], "little")
                ends.setdefault(at - _u32(self.data, at + 12) - _u32(self.data, at + 16), at + 22 + comment)
        return ends

    @cached_property
    def jpeg_ends(self) -> np.ndarray:
        return self.places(b"\xff\xd9")

    @cached_property
    def pdf(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of end marks and of cross reference words; start, end and named place of whole marks;
        and for each byte whether a cross reference may stand there."""
        whole = [(m.start(), m.end(), int(m[1])) for m in self.STARTXREF.finditer(self.data)]
        target = np.zeros(len(self.data) + 1, bool)
        target[self.places(b"xref")] = True
        for m in self.OBJECT.finditer(self.data):
            target[m.start(1) : m.end(1)] = True
        marks = np.array(whole, np.int64).reshape(-1, 3)
        return self.places(b"%%EOF"), self.places(b"startxref"), marks, target

    @cached_property
    def named(self) -> np.ndarray:
        """Distinct places that cross references name, counted from the object's begin."""
        return np.unique(self.pdf[2][:, 2])


def _from(places: np.ndarray, start: int) -> int:
    """The first of some places that is not before another; -1 if there is none."""
    k = int(np.searchsorted(places, start))
    return int(places[k]) if k < len(places) else -1


def jpeg_length(data: bytes, start: int, marks: Marks | None = None) -> int:
    """Length of a JPEG object: segments up to a scan, then coded data up to the end marker."""
    marks = marks or Marks(data)
    at = start + 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2:
            return 0
        at += 2 + size
        if kind == 0xDA:
            end = _from(marks.jpeg_ends, at)
            return end + 2 - start if end >= 0 else 0
    return 0


def zip_length(data: bytes, start: int, marks: Marks | None = None) -> int:
    """Length of a ZIP object whose end record points at its directory."""
    end = (marks or Marks(data)).zip_ends.get(start)
    return end - start if end is not None else 0


def pdf_length(data: bytes, start: int, marks: Marks | None = None) -> int:
    """Length of a PDF object: a version, a cross reference and its last end mark.

    The first end mark counts in any case. A later one counts if its cross reference is where it says,
    and behind the end before: an update; or before it, if the first mark names none: a linearised file.
    """
    if not data[start + 5 : start + 6].isdigit():
        return 0
    marks = marks or Marks(data)
    ends, words, whole, target = marks.pdf
    end, word = _from(ends, start), _from(words, start)
    if end < 0 or word < 0 or word + 9 > end:
        return 0
    if not target[np.minimum(start + marks.named, len(data))].any():
        return end + 5 - start
    k = int(np.searchsorted(whole[:, 0], start))
    linear = k < len(whole) and whole[k, 1] <= end + 5 and whole[k, 2] == 0
    last, rest = end + 5, whole[np.searchsorted(whole[:, 0], end + 5) :]
    named = start + rest[:, 2]
    for mark in np.flatnonzero(target[np.minimum(named, len(data))] & (named < rest[:, 0])).tolist():
        place = int(named[mark])
        if last <= place or (linear and start < place < last):
            last, linear = int(rest[mark, 1]), False
    return last - start


VALIDATORS: dict[str, Callable[..., int]] = {
    "audio/wav": wav_length,
    "image/png": png_length,
    "image/gif": gif_length,
    "image/bmp": bmp_length,
    "image/jpeg": jpeg_length,
    "application/gzip": gzip_length,
    "application/zip": zip_length,
    "application/pdf": pdf_length,
}
MARKED = {"image/jpeg", "application/zip", "application/pdf"}


def _length(kind: str, data: bytes, start: int, marks: Marks) -> int:
    return VALIDATORS[kind](data, start, marks) if kind in MARKED else VALIDATORS[kind](data, start)


@cache
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, places in MAGIC.items():
        for magic, offset in places:
            automaton.add_word(magic.decode("latin-1"), (kind, len(magic), offset))
    automaton.make_automaton()
    return automaton


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """Confirmed objects as (start, length, type), in order and without overlap.

    An object inside another one is not reported, but by `nested`. Where two
    objects begin at the same place, the longer one counts, then the first type by name.
    """
    hits = [
        (end + 1 - size - offset, kind)
        for end, (kind, size, offset) in _automaton().iter(data.decode("latin-1"))
    ]
    found, covered, marks = [], 0, Marks(data)
    best: dict[int, tuple[int, str]] = {}
    for start, kind in sorted(hits):
        if start < covered:
            continue
        length = _length(kind, data, start, marks)
        if length > 0 and (start not in best or length > best[start][0]):
            best[start] = (length, kind)
            covered = max(covered, start + length)
    for start in sorted(best):
        found.append((start, *best[start]))
    return found


def nested(data: bytes) -> list[tuple[int, int, str, int, int]]:
    """All confirmed objects as (start, length, type, parent, depth), in order, also those inside others.

    `parent` is the place in this list of the smallest object that holds the whole one, -1 for none;
    `depth` is how many do. Of objects that begin at the same place all count, longer ones first.
    """
    hits = {
        (end + 1 - size - offset, kind)
        for end, (kind, size, offset) in _automaton().iter(data.decode("latin-1"))
    }
    marks = Marks(data)
    spans = [(start, _length(kind, data, start, marks), kind) for start, kind in hits if start >= 0]
    found, around = [], []
    for start, length, kind in sorted((s for s in spans if s[1] > 0), key=lambda s: (s[0], -s[1], s[2])):
        # Those that end before this one begins hold nothing that follows.
        around = [k for k in around if found[k][0] + found[k][1] > start]
        holders = [k for k in around if found[k][0] + found[k][1] >= start + length]
        parent = min(holders, key=lambda k: (found[k][1], -k), default=-1)
        around.append(len(found))
        found.append((start, length, kind, parent, len(holders)))
    return found


def _carve_rows(batches):
    for part in common.slices(batches, "media"):
        for key, value in zip(part.column("id").to_pylist(), part.column("media").to_pylist()):
            rows = (
                {"id": key, "object": k, "start": a, "length": n, "kind": t, "parent": p, "depth": d, "carved": value[a : a + n]}
                for k, (a, n, t, p, d) in enumerate(nested(value or b""))
            )
            # One object at a time, so that copies of a deep nest are not held at once.
            for row in rows:
                yield pa.RecordBatch.from_pylist([row], _carved_schema(part.schema.field("id").type))


def _carved_schema(key: pa.DataType) -> pa.Schema:
    longs = [(name, pa.int64()) for name in ("object", "start", "length")]
    ends = [("kind", pa.string()), ("parent", pa.int64()), ("depth", pa.int64()), ("carved", pa.binary())]
    return pa.schema([("id", key), *longs, *ends])


def carved(df: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """A row for each confirmed object, nested ones included, with its bytes.

    Columns id, object (its number in its media), start, length, kind, parent, depth and carved. Media
    that are null or hold no object have no row.
    """
    source = df.select(F.col(id_column).alias("id"), F.col(media_column).cast("binary").alias("media"))
    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(
        _carve_rows,
        f"id {kind}, object long, start long, length long, kind string, parent long, depth long, carved binary",
    )


def _sniff_rows(batches):
    for part in common.slices(batches, "media"):
        types, starts, lengths, kinds = [], [], [], []
        for value, declared in zip(part.column("media").to_pylist(), part.column("declared").to_pylist()):
            objects = sniff(value or b"")
            at_start = objects and objects[0][0] == 0
            types.append(objects[0][2] if at_start else declared)
            starts.append([o[0] for o in objects])
            lengths.append([o[1] for o in objects])
            kinds.append([o[2] for o in objects])
        rest = part.schema.names
        yield pa.RecordBatch.from_arrays(
            [
                *[part.column(n) for n in rest],
                pa.array(types, pa.string()),
                pa.array(starts, pa.list_(pa.int64())),
                pa.array(lengths, pa.list_(pa.int64())),
                pa.array(kinds, pa.list_(pa.string())),
            ],
            [*rest, "media_type", "starts", "lengths", "kinds"],
        )


def sniff_media(
    df: DataFrame, id_column: str, media_column: str, type_column: str
) -> DataFrame:
    """Per row: id, media, declared, media_type, and arrays starts, lengths and kinds.

    `media_type` is the type of a confirmed object at the first byte, else the declared type. The
    arrays list all confirmed objects, embedded ones included, to be carved out. Null or empty
    media have no objects and keep their declared type, which may be null. Repeated rows and ids
    are answered one by one; other columns are not read; no rows give no rows.
    """
    source = df.select(
        F.col(id_column).alias("id"),
        F.col(media_column).cast("binary").alias("media"),
        F.col(type_column).cast("string").alias("declared"),
    )
    kinds = dict(source.dtypes)
    return source.mapInArrow(
        _sniff_rows,
        f"id {kinds['id']}, media binary, declared string, media_type string, "
        "starts array<long>, lengths array<long>, kinds array<string>",
    )


def wav_of(payload: bytes) -> bytes:
    """A mono recording of 8-bit samples; the samples are the payload."""
    pad = len(payload) % 2
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\x00" * pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(data: bytes, start: int, length: int) -> bytes:
    """The samples of a confirmed recording at a place in stored bytes."""
    at = start + 12
    while at < start + length:
        size = _u32(data, at + 4)
        if data[at : at + 4] == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return b""


def _store_texts(batches):
    for part in common.slices(batches):
        texts = common.blobs(part.column("text"))
        media = [wav_of(t + b"\x00" * ((-len(t)) % BLOCK if t else BLOCK)) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(media, pa.binary()),
                pa.array(["application/octet-stream"] * len(texts), pa.string()),
            ],
            ["doc_id", "n_bytes", "media", "declared"],
        )


def _features(samples: np.ndarray, objects: int) -> str:
    """Loudness and roughness of the samples, in integers, so that they agree everywhere."""
    wide = samples.astype(np.int64)
    steps = int(np.abs(np.diff(wide)).sum())
    return (
        f"samples={len(wide)};sum={int(wide.sum())};energy={int((wide * wide).sum())};"
        f"steps={steps};peak={int(wide.max())};objects={objects}"
    )


def _read_back(batches):
    for part in common.slices(batches, "media"):
        rows = []
        for row in part.to_pylist():
            data, objects = row["media"], list(zip(row["starts"], row["lengths"], row["kinds"]))
            first = next((o for o in objects if o[0] == 0 and o[2] == "audio/wav"), None)
            payload = wav_samples(data, first[0], first[1]) if first else b""
            rows.append(
                {
                    "id": row["id"],
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-BLOCK:]),
                    "media_bytes": len(data),
                    "media_sha256": hashlib.sha256(data).hexdigest(),
                    "feature": _features(np.frombuffer(payload, np.uint8), len(objects) + len(nested(payload))),
                    "media_type": row["media_type"],
                    "n_bytes": int(row["declared"].rpartition("=")[2]),
                }
            )
        yield pa.RecordBatch.from_pylist(rows, _READ_BACK)


_READ_BACK = pa.schema(
    [
        ("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
        ("feature", pa.string()), ("media_type", pa.string()), ("n_bytes", pa.int64()),
    ]
)


def texts_as_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store texts as recordings of 8-bit samples, read them back by their signature, describe them.

    A text is its UTF-8 bytes and zero bytes up to a positive multiple of 64. It is stored with a
    wrong declared type, which sniffing has to correct before the samples can be read back. Null
    counts as empty. Equal texts give equal values; ids may be null or repeated, other columns are
    not read, and no rows give no rows. The feature counts the recording and all objects in its payload.
    """
    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), common.text_bytes(text_column).alias("text")
    )
    stored = source.mapInArrow(
        _store_texts, "doc_id long, n_bytes long, media binary, declared string"
    )
    stored = stored.withColumn("declared", F.concat("declared", F.lit(";text="), F.col("n_bytes")))
    stored = written(stored.drop("n_bytes"), "media")
    back = sniff_media(stored, "doc_id", "media", "declared").mapInArrow(
        _read_back,
        "id long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, media_type string, n_bytes long",
    )
    return back.select(F.col("id").alias("doc_id"), *[c for c in back.columns if c != "id"])
