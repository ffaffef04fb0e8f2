"""The registered queries on whole tables: against their SQL, or against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import check_queries
from ledgerwise.llm import bpe, cotraining, media
from ledgerwise.llm.common import crc_remainder, table
from ledgerwise.llm.queries import QUERIES, QUERY_SQL

FOLDER = "/root/testdata/sf0.001"
BY_NUMBER = {int(re.match(r"op(\d+)_", name)[1]): name for name in QUERIES}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in table(spark, FOLDER, "documents").collect()}


def rows(spark, number):
    return {r[0]: r for r in QUERIES[BY_NUMBER[number]](spark, FOLDER).collect()}


def test_every_operator_has_one_query():
    assert sorted(BY_NUMBER) == list(range(1, 14)) and len(QUERIES) == 13


@pytest.mark.parametrize("name", sorted(QUERY_SQL))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert check_queries.compare(df, QUERY_SQL[name], check_queries.connect(FOLDER)) == []


def test_op2_counts_and_gain_over_the_base(spark, documents):
    got = rows(spark, 2)
    tokens = {i: (r.text or "").encode().lower().split() + [None] for i, r in documents.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    total, distinct = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(own), total)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)


def test_op3_returns_what_was_stored(spark, documents):
    got = rows(spark, 3)
    assert got.keys() == documents.keys()
    for i, d in documents.items():
        raw = (d.text or "").encode()
        payload = raw + b"\x00" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(media.wav_of(payload)).hexdigest()


def test_op5_follows_the_labels(spark):
    """On the larger table, as the smallest has too few labels to learn words from."""
    folder = FOLDER.replace("0.001", "0.01")
    got = {r[0]: r for r in QUERIES[BY_NUMBER[5]](spark, folder).collect()}
    labels = table(spark, folder, "labels").collect()
    assert len(got) == table(spark, folder, "documents").count()
    clean = [got[r.doc_id].accepted for r in labels if r.quality == 1 and r.toxic == 0]
    junk = [got[r.doc_id].accepted for r in labels if r.quality == 0]
    toxic = [got[r.doc_id].accepted for r in labels if r.toxic == 1]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(junk) <= 0.1 * len(junk) and sum(toxic) <= 0.2 * len(toxic)


def test_op5_is_right_on_labels_that_it_has_not_seen(spark):
    """Learned from the labels of half of the ids, read on the other half."""
    folder = FOLDER.replace("0.001", "0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    unseen = crc_remainder(F.col("doc_id"), 2) == 1
    model = cotraining.learn_quality(docs, labels.where(~unseen))
    rows = cotraining.scored(docs.join(labels.where(unseen).select("doc_id"), "doc_id", "left_semi"), model)
    got = {r.doc_id: r.score >= cotraining.THRESHOLD for r in rows.collect()}
    held = labels.where(unseen).collect()
    clean = [got[r.doc_id] for r in held if r.quality == 1 and r.toxic == 0]
    junk = [got[r.doc_id] for r in held if r.quality == 0]
    toxic = [got[r.doc_id] for r in held if r.quality == 1 and r.toxic == 1]
    print(len(held), sum(clean) / len(clean), sum(junk) / len(junk), sum(toxic) / len(toxic))
    assert sum(clean) >= 0.95 * len(clean) and sum(junk) <= 0.1 * len(junk) and sum(toxic) <= 0.6 * len(toxic)


def test_op6_meets_targets(spark, documents):
    got = rows(spark, 6)
    sizes, taken, target = Counter(), Counter(), {}
    for i, d in documents.items():
        r = got[i]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0d]+", d.text or "")) and 0 <= r.taken <= 2 * r["size"]
        sizes[d.source] += r["size"]
        taken[d.source] += r.taken
        target[d.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - t) <= 32 and t <= 2 * sizes[s] + 1e-6 for s, t in target.items())


def test_op9_equals_the_library(spark, documents):
    library, got = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY)), rows(spark, 9)
    for i, d in documents.items():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]
        assert tuple(got[i])[1:] == (len(ids), *digests)


def test_op10_is_right_on_held_out_documents(spark, documents):
    got = rows(spark, 10)
    held = [(got[i].lang_pred, d.lang) for i, d in documents.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 20
