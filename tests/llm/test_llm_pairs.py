import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import binary_codes, common, near_dups
from ledgerwise.llm.components import components


def closed(ids, links):
    """Smallest id that links reach, by brute force."""
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute(docs, words, percent=80):
    sets = {i: shingles(t, words) for i, t in docs.items()}
    links = [
        (a, b)
        for a in docs
        for b in docs
        if a < b and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    least = closed(docs, links)
    return {i: (len(sets[i]), least[i]) for i in docs}


def test_components_of_a_chain_a_star_and_loops(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 140)]
    links = [*chain, *chain[:5], *star, (7, 7), (None, 3), (200, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_that_go_early_are_rarely_similar():
    assert near_dups.least_agreement(64, 0.8, 1e-5) < near_dups.least_agreement(64, 0.8, 1e-2)
    for bits in (64, 512, 1024):
        agree = near_dups.least_agreement(bits, 0.8, 1e-5)
        # A pair of similarity 0.8 agrees in a bit with probability 0.9; one of 0.3 with 0.65.
        assert agree < 0.9 * bits and (bits < 512 or agree > 0.65 * bits)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(400)]
    docs, number = {}, 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(12, 150))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs[number] = " ".join(copy)
            number += rng.randint(1, 3)
    docs[number + 1] = docs[0].upper().replace(" ", "\t\n")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df, words=words).collect()}
    assert got == brute(docs, words)


def test_near_duplicates_of_awkward_rows(spark):
    long = " ".join(f"x{k % 977}y{k}" for k in range(40_000))
    rows = [
        (5, "one two three", 1), (3, "One  TWO\nthree", 2), (3, "One  TWO\nthree", 2), (None, "one two three", 3),
        (7, None, 4), (8, "", 5), (9, " \t\n", 6), (10, "word", 7), (11, "WORD", 8), (12, long, 9), (13, long + " end", 9),
        (14, " ", 1), (15, "É", 1), (16, "é", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long")
    for name in ("bucket", "component", "hub", "a", "b", "shingles", "n_shingles"):
        df = df.withColumn(name, F.lit(0))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(df, 2).collect())
    assert [g for g in got if g[0] not in (12, 13)] == [
        (-1, 2, None, False), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (7, 0, 7, True),
        (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (14, 1, 14, True),
        (15, 1, 15, True), (16, 1, 16, True),
    ]
    assert [(g[0], g[2]) for g in got if g[0] in (12, 13)] == [(12, 12), (13, 12)]
    assert near_dups.near_duplicates(df.limit(0), 2).count() == 0


def test_words_are_split_and_hashed_as_bytes_split():
    texts = ["a B\x0bc", "", "  ", "É é x", "same same", "x" * 3000]
    hashes, bounds = common.hash_words([t.encode() for t in texts])
    words = [w for t in texts for w in t.encode().lower().split()]
    assert len(hashes) == len(words) and np.diff(bounds).tolist() == [len(t.encode().split()) for t in texts]
    assert len(set(hashes.tolist())) == len(set(words))
    assert hashes.tolist() == [common.hash_words([w])[0][0] for w in words]


def mirrored(steps):
    """Two words whose polynomial hashes agree modulo 2^64, whatever the base."""
    one, two = "a", "b"
    for _ in range(steps):
        one, two = one + two, two + one
    return one, two


def test_words_that_collide_in_machine_arithmetic_stay_apart(spark):
    one, two = mirrored(11)
    hashes, _ = common.hash_words([f"{one} {two}".encode()])
    assert hashes[0] != hashes[1]
    rows = [(1, f"{one} {two} {one}"), (2, f"{two} {one} {two}"), (3, f"{one} {two} {one}")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    # Both hold the same two pairs of words; other pairs are other pairs.
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}
    rows = [(1, f"{one} x {one}"), (2, f"{two} x {two}")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert all(r.kept for r in got)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    draw = np.random.default_rng(2)
    words = ["".join(chr(97 + x) for x in draw.integers(0, 26, n)) for n in draw.integers(1, 30, 400)] + ["y" * 9000, "Z" * 300]
    texts = [" ".join(draw.choice(words, n)).encode() for n in (0, 1, 700, 30)] + [b"\n", b"q" * 5000]
    monkeypatch.setattr(common, "LONG_WORD", 200)
    plain, bounds = common.hash_words(texts)
    short, _ = common.hash_words(texts, 3)
    flat = [w.lower() for t in texts for w in t.split()]
    assert len(set(plain.tolist())) == len(set(flat)) == len(set(zip(plain.tolist(), flat)))
    monkeypatch.setattr(common, "PIECE_BYTES", 1000)
    assert all((a == b).all() for a, b in zip((plain, bounds), common.hash_words(texts)))
    assert (short == common.hash_words(texts, 3)[0]).all()


def vectors(rng, n, size):
    out = []
    for _ in range(n):
        base = rng.standard_normal(size)
        out.append(base)
        for _ in range(rng.integers(0, 4)):
            out.append(base + rng.standard_normal(size) * rng.uniform(0.02, 0.45))
    return out


@pytest.mark.parametrize("size", [64, 24, 100])
def test_vector_links_against_all_pairs(spark, size):
    rng = np.random.default_rng(size)
    rows = [(k, [float(x) for x in v], int(k % 2)) for k, v in enumerate(vectors(rng, 150, size))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in binary_codes.near_vectors(df).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    links = [(a, b) for a, _, x in rows for b, _, y in rows if a < b and x == y and unit[a] @ unit[b] >= 0.93]
    degree = {i: 0 for i in unit}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert all(got[i].n_links <= degree[i] for i in unit)
    # The fixture is full of pairs near the threshold, where codes differ most.
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(degree.values()) > 100
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vector_groups_larger_than_a_chunk_and_equal_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    rows = [(k, [float(x) for x in base + 0.02 * rng.standard_normal(64)], 1) for k in range(1500)]
    rows += [(2000 + k, [float(x) for x in base], 1) for k in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = binary_codes.near_vectors(df).agg(
        F.min("n_links"), F.max("n_links"), F.max("component_id"), F.sum(F.col("kept").cast("int"))
    ).first()
    assert tuple(got) == (1599, 1599, 0, 1)


def test_awkward_vectors(spark):
    one, nan = [1.0, 0.0, 0.0], float("nan")
    rows = [
        (1, one, 1), (2, [2.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1),
        (7, [0.0, 0.0, 0.0], 1), (8, [1.0, nan, 0.0], 1), (9, [1.0, None, 0.0], 1), (10, [float("inf"), 0.0, 0.0], 1),
        (11, [1.0, 0.0], 1), (None, one, 1), (12, [1e300, 1e300, 0.0], 1), (13, [1e-300, 1e-300, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("mark", "unit", "code", "size", "node", "copies", "links"):
        df = df.withColumn(name, F.lit("x"))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in binary_codes.near_vectors(df).collect())
    assert got == [
        (0, 0, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7),
        (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 0, 11), (12, 1, 12), (13, 1, 12),
    ]
    assert binary_codes.near_vectors(df.limit(0)).count() == 0
