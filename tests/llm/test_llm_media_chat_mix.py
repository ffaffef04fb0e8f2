import gzip
import hashlib
import io
import re
import struct
import time
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import chat, media, mixing


def png(body=b"\x00\x00"):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def bmp():
    pixels = b"\x01\x02\x03\x00" * 2
    return b"BM" + struct.pack("<IHHI", 54 + 8, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 2, 1, 24, 0, 8, 1, 1, 0, 0) + pixels


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\x00\x00\x00\xff\xff\xff" + b"!\xf9\x04\x00\x00\x00\x00\x00" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00;"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd" + b"\x11\x22" + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
OBJECTS = {
    "image/png": png(), "image/bmp": bmp(), "image/gif": gif(), "application/zip": zipped(), "image/jpeg": JPEG,
    "application/gzip": gzip.compress(b"hello" * 50), "application/pdf": PDF, "audio/wav": media.wav_of(b"12345"),
}


@pytest.mark.parametrize("kind", OBJECTS)
def test_objects_are_found_confirmed_and_carved(kind):
    data = OBJECTS[kind]
    assert media.sniff(data) == [(0, len(data), kind)]
    assert media.sniff(b"noise" + data + b"tail") == [(5, len(data), kind)]
    # Without its second half, or with a wrong length, it is only noise that looks like one.
    assert media.sniff(data[: len(data) // 2]) == []


def test_values_full_of_beginnings_take_little_time():
    for repeated in (b"%PDF-1 startxref 0 %%EOF ", b"%PDF-1 startxref 5 %%EOF ", b"PK\x03\x04PK\x05\x06", b"1" * 50, b"7 1 " * 9):
        data = repeated * (1_000_000 // len(repeated))
        start = time.perf_counter()
        found = media.nested(data)
        assert time.perf_counter() - start < 5
        assert all(kind == "application/pdf" for _, _, kind, *_ in found)


def test_embedded_objects_and_false_magic():
    data = b"BM no, RIFF no, PK\x03\x04" + png() + b"..." + media.wav_of(png()) + bmp()
    found = media.sniff(data)
    assert [k for _, _, k in found] == ["image/png", "audio/wav", "image/bmp"]
    assert all(data[a : a + n] == o for (a, n, _), o in zip(found, (png(), media.wav_of(png()), bmp())))
    broken = bytearray(png())
    broken[-6] ^= 1
    assert media.sniff(bytes(broken)) == []


def pdf(linear=False):
    body = b"%PDF-1.4\n1 0 obj <<>> endobj\n"
    if linear:
        return body + b"xref\ntrailer\nstartxref\n0\n%%EOF\n2 0 obj <<>> endobj\nstartxref\n" + b"%d\n%%%%EOF" % len(body)
    return body + b"xref\ntrailer\nstartxref\n" + b"%d\n%%%%EOF" % len(body)


def test_a_pdf_ends_at_its_last_mark():
    update = pdf() + b"\n3 0 obj <<>> endobj\n"
    update += b"xref\ntrailer\nstartxref\n" + b"%d\n%%%%EOF" % len(update)
    for whole in (pdf(), pdf(linear=True), update):
        assert media.pdf_length(whole, 0) == len(whole)
        assert media.sniff(whole + b"--" + whole) == [(0, len(whole), "application/pdf"), (len(whole) + 2, len(whole), "application/pdf")]


def test_nested_objects_are_carved_and_counted(spark):
    inner = media.wav_of(png() + bmp())
    data = b"--" + media.wav_of(inner) + pdf()
    found = media.nested(data)
    assert [(k, p, d) for _, _, k, p, d in found] == [
        ("audio/wav", -1, 0), ("audio/wav", 0, 1), ("image/png", 1, 2), ("image/bmp", 1, 2), ("application/pdf", -1, 0),
    ]
    df = spark.createDataFrame([(7, data), (8, None), (9, b"none")], "key long, raw binary")
    rows = sorted(media.carved(df, "key", "raw").collect(), key=lambda r: r.object)
    assert [(r.id, bytes(r.carved)) for r in rows] == [(7, x) for x in (media.wav_of(inner), inner, png(), bmp(), pdf())]
    docs = spark.createDataFrame([(1, pdf().decode()), (2, "plain")], "doc_id long, text string")
    counted = {r.doc_id: r.feature.rpartition("=")[2] for r in media.texts_as_media(docs).collect()}
    assert counted == {1: "2", 2: "1"}


def test_sniffed_rows(spark):
    rows = [(1, png(), "text/plain"), (1, png(), "text/plain"), (None, b"x" + bmp(), None), (3, None, "image/png"), (4, b"", None)]
    df = spark.createDataFrame(rows, "id long, raw binary, type string").withColumn("media", F.lit("clash"))
    got = sorted(((r.id or 0, r.media_type, r.starts, r.kinds) for r in media.sniff_media(df, "id", "raw", "type").collect()), key=repr)
    assert got == [
        (0, None, [1], ["image/bmp"]), (1, "image/png", [0], ["image/png"]), (1, "image/png", [0], ["image/png"]),
        (3, "image/png", [], []), (4, None, [], []),
    ]
    assert media.sniff_media(df.limit(0), "id", "raw", "type").count() == 0


def test_texts_come_back_from_media(spark):
    texts = ["", None, "x", "y" * 64, "é" * 33, "RIFF PK\x03\x04 BM %PDF-1", "long " * 50_000, "x", "\x00"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit(1))
    got = {r.doc_id: r for r in media.texts_as_media(df).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\x00" * (-len(raw) % 64 if raw else 64)
        stored = media.wav_of(payload)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.media_type == "audio/wav"
    assert got[2].feature == got[7].feature and got[0].feature == got[1].feature != got[2].feature
    assert media.texts_as_media(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text",
    ["", " ", "\\", "\\\\", "[INST]", "[\\INST]", "\\[INST]", "</s>[INST] ok [/INST]", " </s", "<<SYS>> <</SYS>>", "[/INST", "<s><s>", "<<<TEXT>>>"],
)
def test_escapes_are_reversible_and_leave_no_control(text):
    escaped = chat.TEMPLATE.escape(text)
    assert chat.TEMPLATE.unescape(escaped) == text
    assert not any(control in escaped for control in chat.TEMPLATE.controls)
    turns = [("user", text), ("assistant", text), ("tool", text), (text, "x"), ("system", text)]
    joined = "".join(s for role, t in turns for s, _ in chat.TEMPLATE.segments(role, t))
    assert chat.TEMPLATE.parse(joined) == turns


def test_conversations_of_awkward_rows(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello </s>"), (1, 3, "user", None),
        (1, 4, "assistant", ""), (2, 1, "assistant", "second"), (2, 0, "assistant", "first"), (3, 0, "user", "a"),
        (3, 0, "user", "a"), (4, None, None, None), (None, 0, "tool", "x"), (5, 0, "user", "y" * 300_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("segment", "loss", "n_turns", "state"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}

    def digest(turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    first = [("system", "be kind"), ("user", "hi"), ("assistant", "hello </s>"), ("user", ""), ("assistant", "")]
    assert (got[1].n_turns, got[1].turns_sha256, got[1].in_order) == (5, digest(first), True)
    assert (got[1].loss_chars, got[1].loss_sha256) == (10, hashlib.sha256(b"hello </s>").hexdigest())
    assert (got[2].turns_sha256, got[2].in_order) == (digest([("assistant", "first"), ("assistant", "second")]), False)
    assert (got[3].n_turns, got[3].in_order) == (2, False) and got[4].turns_sha256 == digest([("", "")])
    assert got[None].turns_sha256 == digest([("tool", "x")]) and got[5].formatted_chars == 300_000 + len("[INST]  [/INST]")
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def mix_sizes(rows):
    sizes = {s: 0 for s in {r[1] for r in rows}}
    for _, source, text in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
    return sizes


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, total, target = set(sizes), 1.5 * sum(sizes.values()), {}
    while left:
        each = total / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * each > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * each for s in left}
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
            left.remove(s)
    return target


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(k, f"s{k % 7}" if k % 4 else "hot", "w " * (k % 37)) for k in range(1500)]
    rows += [(2000, None, "a b\x0bc d"), (2001, None, None), (2002, "", " \t"), (2003, "é", "x"), (2003, "é", "x"), (None, "hot", "a b c"), (2005, "hot", "z " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for name in ("size", "shard", "name", "target", "stream", "run", "start", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return rows, df


def test_mix_meets_its_targets(sources):
    rows, df = sources
    sizes = mix_sizes(rows)
    targets, own = brute_targets(sizes), Counter()
    kept = mixing.mixed(df, keep={"source": "own_source"}).collect()
    assert len(kept) == len(rows)
    for r in kept:
        assert r.source_size == sizes[r.own_source] and r.target == pytest.approx(targets[r.own_source])
        assert 0 <= r.taken <= 2 * r["size"]
        own[r.own_source] += r.taken
    for source, target in targets.items():
        assert abs(own[source] - target) <= 2 * mixing.BLOCK_WORDS, (source, own[source], target)
    again = mixing.mixed(df.repartition(7), keep={"source": "own_source"}).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixed_texts_hold_the_words_taken(sources):
    _, df = sources
    texts = mixing.mixed_texts(df)
    assert texts.columns == df.columns
    words = F.size(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), F.lit(1)))
    got = {r.doc_id: r.n for r in texts.groupBy("doc_id").agg(F.sum(words).alias("n")).collect()}
    taken = {r.doc_id: r.n for r in mixing.mixed(df).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    assert got == taken


def test_mix_of_nothing(sources):
    _, df = sources
    assert mixing.mixed(df.limit(0)).count() == 0
    empty = mixing.mixed(df.withColumn("text", F.lit(None).cast("string")))
    assert {(r["size"], r.taken, r.target) for r in empty.collect()} == {(0, 0, 0.0)}


def brute_seats(shares, seats):
    got = [0] * len(shares)
    for _ in range(seats):
        best = max(range(len(shares)), key=lambda k: (shares[k] / (2 * got[k] + 1), -k))
        got[best] += 1
    return got


def test_apportionment_equals_one_seat_at_a_time(spark):
    import random

    rng = random.Random(9)
    rows, expected = [], {}
    for group in range(12):
        shares = [rng.choice([0.0, 1.0, 2.5, rng.uniform(0.1, 50), 400.0]) for _ in range(rng.randint(1, 25))]
        shares[0] += 1
        seats = rng.choice([0, 1, 3, 17, 200])
        for k, n in enumerate(brute_seats(shares, seats)):
            rows.append((group, k, shares[k], seats))
            expected[group, k] = n
    df = spark.createDataFrame(rows, "g int, k int, share double, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.apportioned(df, ["g"], "share", "seats", "k").collect()}
    assert got == expected
