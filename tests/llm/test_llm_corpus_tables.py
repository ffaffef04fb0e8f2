"""Exact duplicates, the filter audit and collocations on small, awkward tables."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import collocations, dictionary, exact_dups, filter_audit

DOCS = "doc_id long, text string, lang string, source string, _row string, _content string, kept string"


def frame(spark, rows, parts=3):
    full = [(*r, *["x"] * (7 - len(r))) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def weak(text):
    """A hash of few bits, so that different texts share it."""
    return F.substring(F.unhex(F.md5(text)), 1, 1)


AWKWARD = [
    (5, "same"), (3, "same"), (None, "same"), (5, "same"), (9, None), (8, ""), (7, "only"), (None, "no id"), (None, "no id"),
    *[(100 + k, f"text {k % 300}") for k in range(900)], (2000, "long " * 200_000), (2001, "long " * 200_000),
]


@pytest.mark.parametrize("hashed", [exact_dups.content_hash, weak, lambda text: F.lit(b"0")])
@pytest.mark.parametrize("largest", [True, False])
def test_exact_duplicates_whatever_the_hash(spark, hashed, largest):
    rows = [(i, t) for i, t in AWKWARD]
    got = exact_dups.exact_duplicates(frame(spark, rows), largest, hashed=hashed).collect()
    assert len(got) == len(rows)
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in ids}
    kept = Counter()
    for r in got:
        own = ids[digest[r.text_sha256]]
        known = [i for i in own if i is not None]
        stays = (max if largest else min)(known) if known else None
        assert (r.keep_id, r.group_size) == (stays, len(own))
        assert not r.kept or r.doc_id == stays
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)


def test_empty_tables(spark):
    docs = frame(spark, []).where("doc_id is not null")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dups.exact_duplicates(docs).collect() == []
    assert filter_audit.filter_audit(docs, labels).collect() == []
    assert collocations.collocations(docs).collect() == []


def audit_by_hand(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    facts = []
    for i, t, lang in rows:
        t = t or ""
        words = [w for w in t.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        failed = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        failed += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        failed += "E" * (i is not None and i > first[t])
        own = [(q, x) for d, q, x in labels if d == i and i is not None]
        facts.append((lang or "", failed, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = {}
    shares = Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for k, own in enumerate(order):
            for part in {f[0] for f in facts}:
                of = [f for f in facts if f[0] == part]
                left = [f for f in of if not set(order[:k]) & set(f[1])]
                removed = [f for f in left if own in f[1]]
                shares[part, own] += len(removed)
                out[part, order, k + 1] = (
                    len(left) - len(removed), len(removed), sum(own in f[1] for f in of) - len(removed),
                    sum(f[1] == own for f in of), sum(f[2] for f in removed), sum(f[3] for f in removed), own,
                )
    return {k: (*v[:-1], shares[k[0], v[-1]]) for k, v in out.items()}


def audit_rows():
    draw = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "d$", "e", "été", "x|y"] + [f"w{k}" for k in range(200)]
    rows = [(None, None, None), (1, "", "en"), (2, "", "en"), (2, "", None), (None, "", "de"), (3, "A B\vC", "")]
    for i in range(4, 120):
        n = draw.choice([3, 99, 100, 101, 240])
        rows.append((i, draw.choice([" ", "\n", "\t "]).join(draw.choices(words, k=n)), draw.choice(["en", "de", None])))
        if i % 3 == 0:
            rows.append((i + 500, rows[-1][1], draw.choice(["en", "de"])))
    rows.append((900, "word " * 300_000, "en"))
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 600, 2)]
    return rows, labels + labels[:40] + [(None, 1, 1), (8, 1, 1), (8, 0, 0)]


@pytest.mark.parametrize("hashed", [exact_dups.content_hash, weak])
def test_filter_audit_equals_brute_force(spark, monkeypatch, hashed):
    rows, labels = audit_rows()
    original = exact_dups.with_content
    monkeypatch.setattr(exact_dups, "with_content", lambda docs: original(docs, hashed=hashed))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(frame(spark, rows), table).collect()
    made = {(r.part, r.filter_order, r.step): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got}
    assert len(got) == len(made) and made == audit_by_hand(rows, labels)


def test_document_terms_are_the_words_of_the_documents(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "SHARD_BYTES", 2000)
    rows, _ = audit_rows()
    docs = frame(spark, rows)
    matrix, entries = filter_audit.document_terms(docs, ("doc_id", "text"), block_bytes=5000)
    spelled = {r.id: bytes(r.word).decode() for r in entries.collect()}
    totals = {r.id: r["count"] for r in entries.collect()}
    assert sorted(spelled) == list(range(1, len(spelled) + 1)) and len(set(spelled.values())) == len(spelled)
    found = Counter()
    shards = matrix.collect()
    assert len(shards) > 3
    for s in shards:
        indptr, indices = np.frombuffer(s.indptr, np.int64), np.frombuffer(s.indices, np.uint32)
        data = np.frombuffer(s.data, np.uint32)
        for k, text in enumerate(s.text):
            own = {spelled[j + 1]: n for j, n in zip(indices[indptr[k] : indptr[k + 1]].tolist(), data[indptr[k] : indptr[k + 1]].tolist())}
            expected = Counter(w for w in (text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w)
            assert own == expected
            found.update(expected)
    assert {spelled[i]: n for i, n in totals.items()} == found
    assert sum(len(s.doc_id) for s in shards) == len(rows)


def test_numbers_are_packed_in_the_narrowest_type():
    for values in ([], [0, 255], [256, 1], [70_000], [1 << 40, 3]):
        packed = dictionary.compact(np.array(values, np.int64))
        assert dictionary.expand(packed).tolist() == values
    assert len(dictionary.compact(np.arange(256))) == 257


def test_segments_cut_only_where_allowed():
    cut = dictionary.byte_table(b" ")
    for text in (b"", b"a" * 50, b"ab cd " * 20, b"x" * 30 + b" y" * 30):
        parts = [bytes(p.tobytes()) for p in dictionary.segments(text, cut, 10)]
        assert b"".join(parts) == text and all(p.endswith(b" ") for p in parts[:-1])


def phrases_by_hand(rows, min_count, top):
    breaks = {ord(c): 10 for c in ".,;:!?\v\f\r"}
    lower = {c: c + 32 for c in range(65, 91)}
    counts = {}
    for _, text, lang in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in (text or "").translate(lower).translate(breaks).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            for size in (1, 2, 3):
                own.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in frequent.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in frequent.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows():
    draw = random.Random(5)
    words = ["New", "york", "CITY", "the", "of", "été", "x y", "a\vb"] + [f"w{k}" for k in range(12)]
    rows = [(None, None, None), (1, "", "en"), (2, "...", "en"), (3, None, "empty")]
    for i in range(120):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!"]) for _ in range(60))
        rows.append((i % 40, text + "new york city " * (i % 3), draw.choice(["en", "de", None])))
    rows += [(7, "the end of it " * 40_000, "en"), (8, "same same same same", "tie"), (8, "same same same same", "tie")] * 4
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(dictionary, "SHARD_BYTES", 500)
        monkeypatch.setattr(collocations, "TOP_SLICE", 20)
    rows = phrase_rows()
    sizes = {"block_bytes": 2000, "partition_size": 1000} if small else {}
    got = collocations.collocations(frame(spark, rows), 10, 50, **sizes).collect()
    assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, 10, 50)


@pytest.mark.parametrize("bits", [21, 3])
def test_trie_counts_bursts_and_spills(monkeypatch, bits):
    monkeypatch.setattr(collocations, "LEAF", 50)
    draw = np.random.default_rng(1)
    trie, want, got = collocations.Node(0), Counter(), Counter()
    spills, deep = 0, False

    def out(entries):
        for a, r, n in zip(*(x.tolist() for x in entries)):
            got[a, (r >> 32) & 0xFFFFFFFF, r & 0xFFFFFFFF] += n

    for _ in range(30):
        n = 500
        tokens = np.where(draw.random(n) < 0.1, 0, np.minimum(draw.zipf(1.3, n), 40))
        ids = np.where(np.arange(40) % 7 == 6, 0, np.arange(40) + (1 << 31))
        own = [int(ids[t - 1]) if t else 0 for t in tokens.tolist()]
        want.update((a, b, 0) for a, b in zip(own, own[1:]) if a and b)
        want.update(t for t in zip(own, own[1:], own[2:]) if all(t))
        trie.add(*collocations.phrases_of(tokens, ids, bits))
        deep |= any(isinstance(c, collocations.Node) for c in trie.children)
        while trie.size > 1500:
            spills += 1
            out(trie.spill(0.5))
    assert spills > 1 and deep
    out(trie.spill(1.0))
    assert trie.size == 0 and got == want


def test_products_beyond_64_bits_are_exact(spark):
    big = 10**14 + 7
    phrases = spark.createDataFrame([(1, 2, 0, big)], "w1 long, w2 long, w3 long, a long")
    words = spark.createDataFrame([("en", 1, b"x", big + 5), ("en", 2, b"y", big + 9)], "field string, id long, word binary, count long")
    row = collocations.scored_phrases(phrases, words).first()
    assert row.score == 10**6 * big * big // ((big + 5) * (big + 9))
