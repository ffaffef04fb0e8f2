import collections
import hashlib
import math
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwise.llm import bpe, class_lm, cotraining, language, lines

CLASHING = ("text_", "key", "mask", "block", "shard", "ids", "size", "label", "classes", "score", "name", "rate")


@pytest.fixture(scope="module")
def awkward(spark):
    long = "\n".join(f"line {k} of a very long text" for k in range(20_000))
    rows = [
        (1, "Same line\nother 1", "en", "a"), (2, "  SAME LINE \t\nother 2", "en", "a"), (2, "  SAME LINE \t\nother 2", "en", "a"),
        (None, "same line", "en", None), (4, None, None, "b"), (5, "", "fr", "b"), (6, "\n\n", None, "b"), (7, long, "en", "c"),
        (8, "!!! 123 ???", "en", "c"), (9, "É é\x0bx", "fr", None), (10, "same line\nsame line\n", "fr", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df


def brute_lines(rows, least):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (t or "").split("\n")] for _, t in rows]
    held = collections.Counter(k for own in keys for k in set(own))
    out = []
    for (i, t), own in zip(rows, keys):
        split = (t or "").split("\n")
        kept = [x for x, k in zip(split, own) if not k or held[k] < least]
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 3, 5])
def test_frequent_lines_equal_brute_force(awkward, least):
    got = lines.drop_frequent_lines(awkward, min_documents=least).collect()
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows, least)
    assert lines.drop_frequent_lines(awkward.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_probes_know_strangers():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    perfect = lines.PerfectHash.build(hashes)
    assert sorted(perfect.numbers(hashes).tolist()) == list(range(len(hashes)))
    index = lines.LineIndex.build(hashes, np.arange(len(hashes)))
    assert index.probe(hashes).tolist() == list(range(len(hashes)))
    strangers = np.setdiff1d(rng.integers(0, 1 << 63, 5000).astype(np.uint64), hashes)
    assert (index.probe(strangers) > 0).mean() < 0.01
    assert lines.LineIndex.build(hashes[:0], np.empty(0)).probe(hashes[:3]).tolist() == [0, 0, 0]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def test_bpe_equals_the_library_on_random_texts(library):
    rng = random.Random(1)
    parts = [
        "a", "the", "'s", "'LL", " ", "\n", "\x00", "\x1c", "\x85", " ", "é", "é", "İ", "ß", "Σ", "ς", "ΟΔΟΣ", "1",
        "²", "½", "٣", "日本", "한", "가", "😀", "‍", "<|endoftext|>", "<|startoftext|>", "<|", "...", "_", "Ǆ", "ﬁ", "Å",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñ'") for _ in range(rng.randint(1, 70))) for _ in range(1500)]
    texts += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    encoder = bpe.encoder_of(open(public_tokenizers.path(bpe.VOCABULARY), encoding="utf-8").read())
    for text, ids, own in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids == own.ids, ascii(text)
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_awkward_rows(awkward, library):
    got = bpe.encoded(awkward, digests=True).collect()
    expected = []
    for row in awkward.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text))
        expected.append((row.doc_id, ids, len(ids), *digests))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert bpe.encoded(awkward.limit(0)).count() == 0


def brute_phrases(sample, symbols):
    text, count, at = "".join(map(chr, sample)), 0, 0
    while at < len(symbols):
        size = 1
        while at + size < len(symbols) and "".join(map(chr, symbols[at : at + size + 1])) in text:
            size += 1
        count, at = count + 1, at + size
    return count


def test_suffix_automaton_counts_longest_phrases():
    rng = random.Random(4)
    texts = {"x": ["abracadabra banana"], "y": ["cabbage dadaist " * 3]}
    model = language.LanguageModel.learn(texts)
    for _ in range(50):
        text = "".join(rng.choice("abcdnrz !") for _ in range(rng.randint(1, 40)))
        symbols = model.symbol_of[[ord(c) for c in text]]
        got = model.phrases(symbols[:, None].astype(np.int32))[:, 0]
        for k, name in enumerate(model.names):
            learned = model.symbol_of[[ord(c) for c in " ".join(texts[name])]]
            assert got[k] == brute_phrases(learned, symbols)


def test_languages_of_awkward_rows(spark, awkward):
    words = {"en": "the house and garden of that man with this", "fr": "la maison et le jardin de cet homme avec ça"}
    rows = [(k, " ".join(random.Random(k).choices(words[l].split(), k=40)), l) for k in range(40) for l in words]
    model = language.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.identified(awkward, model).collect()}
    assert {(4, "und", False), (5, "und", False), (6, "und", False), (8, "und", False)} <= got
    plain = spark.createDataFrame([(1, "The Garden, and THE man"), (2, "le jardin de la maison")], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identified(plain, model).collect()}
    assert (found[1].lang_pred, found[2].lang_pred) == ("en", "fr") and 0 < found[1].score <= 1
    empty = language.learn_languages(awkward.limit(0))
    assert {r.lang_pred for r in language.identified(awkward, empty).collect()} == {"und"}
    assert language.identified(awkward.limit(0), model).count() == 0


def test_languages_are_learned_from_whole_texts(spark):
    rng = random.Random(6)
    header, copy = ("".join(rng.choices("abcdef   ", k=2_500)) for _ in range(2))
    tongues = {"aa": "abcdef   ", "zz": "uvwxyz   "}
    text = lambda l, n: "".join(rng.choices(tongues[l], k=n))
    rows = [(None, header + text(l, 4_000), l) for l in tongues for _ in range(40)] + [(k, copy, "zz") for k in range(20)]
    schema = "doc_id long, text string, lang string"
    model = language.learn_languages(spark.createDataFrame(rows, schema))
    assert all(size > 32_000 for size in model.sizes)
    held_out = spark.createDataFrame([(k, text(l, 300), l) for l in tongues for k in range(20)], schema)
    found = {r.doc_id: r.lang_pred for r in language.identified(held_out.where("lang = 'zz'"), model).collect()}
    assert found == dict.fromkeys(range(20), "zz")
    short = spark.createDataFrame([(k, f"only words {k}", "aa") for k in range(9)] * 3, schema)
    assert language.learn_languages(short).sizes == [9 * len("only words 0") + 8]
    again = language.learn_languages(spark.createDataFrame(rows[::-1], schema).repartition(7))
    assert all((a == b).all() for a, b in zip(model.edges, again.edges))


def test_large_alphabets_take_little_memory(monkeypatch):
    rng = random.Random(8)
    texts = {
        "zh": ["".join(chr(0x4E00 + int(3400 * rng.random() ** 3)) for _ in range(40_000))],
        "en": ["".join(rng.choice("abcdefghij klm") for _ in range(40_000))],
    }
    model = language.LanguageModel.learn(texts)
    held = sum(part.nbytes for table in model.tables for part in table if isinstance(part, np.ndarray))
    assert held < 40 << 20
    ask = [texts["zh"][0][100:400].encode(), b"abc fed klm" * 20, "一丁x".encode()]
    found = model.predict(ask)
    assert found[0][:2] == ["zh", "en"]
    monkeypatch.setattr(language, "FULL_CELLS", 0)
    assert language.LanguageModel.learn(texts).predict(ask) == found


def test_texts_longer_than_the_sample_are_learned_whole(spark):
    rows = [("aa", "abc " * 40), ("aa", "abcd " * 50), ("bb", "xyz " * 10), ("bb", "xy " * 60)]
    model = language.learn_languages(spark.createDataFrame(rows, "lang string, text string"), points=100)
    # Of the first language the shortest text, of the second the only one that fits.
    assert dict(zip(model.names, model.sizes)) == {"aa": 160, "bb": 40}


def test_long_runs_of_unseen_words_take_linear_time():
    draw = np.random.default_rng(4)
    moves = draw.random((class_lm.CLASSES, class_lm.CLASSES)) ** 8
    unseen = draw.random(class_lm.CLASSES) ** 4
    model = class_lm.ClassModel(10, 5, np.ones(class_lm.CLASSES), unseen, moves / moves.sum(axis=1, keepdims=True))

    class Sent:
        value = model

    def scores(texts):
        columns = {"doc_id": range(len(texts)), "held_out": [False] * len(texts), "n_tokens": [1] * len(texts), "n_known": [0] * len(texts), "base_score": [0.0] * len(texts), "emitted": [0.0] * len(texts), "sequence": [bytes(t) for t in texts]}
        batch = pa.RecordBatch.from_pydict({n: pa.array(list(v)) for n, v in columns.items()})
        return [x for b in class_lm._scores(7, Sent)(iter([batch])) for x in b.column("score").to_pylist()]

    texts = [[int(x) for x in np.where(draw.random(n) < 0.7, class_lm.NO_CLASS, draw.integers(0, 64, n))] for n in (1, 2, 50, 300)]
    guess = (model.transitions * unseen).argmax(axis=1)
    for text, made in zip(texts, scores(texts)):
        state, total = 7, 0.0
        for c in text:
            if c == class_lm.NO_CLASS:
                total, state = total + math.log10(model.transitions[state] @ unseen), int(guess[state])
            else:
                total, state = total + math.log10(model.transitions[state, c]), c
        assert made == pytest.approx(total)
    start = time.perf_counter()
    assert math.isfinite(scores([[class_lm.NO_CLASS] * 1_000_000])[0])
    assert time.perf_counter() - start < 5


def test_class_scores_base_and_probabilities(spark, awkward):
    docs = awkward.withColumn("held_out", F.col("doc_id") == 9)
    got = class_lm.class_scores(docs).collect()
    tokens = [((r.text or "").encode().lower().split() + [None], r.doc_id == 9 or r.doc_id is None) for r in awkward.collect()]
    counts = collections.Counter(w for own, held in tokens for w in own if not held)
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted(
        (len(own), sum(counts[w] > 0 for w in own), round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), 6))
        for own, _ in tokens
    )
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert all(r.train_tokens == total and r.score <= 0 and r.perplexity >= 1 for r in got)
    nothing = class_lm.class_scores(awkward.withColumn("held_out", F.lit(True))).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, round(r.score, 9)) for r in nothing} == {(0, 0, 0.0, 0.0)}
    assert class_lm.class_scores(docs.limit(0)).count() == 0


def test_class_scores_are_probabilities(spark):
    """Over all words that may follow, known ones and one event for the rest, they sum to one."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    train = [(k, " ".join(rng.choices(words, k=30))) for k in range(60)]
    known = sorted({w for _, t in train for w in t.split()})
    # Texts of one word, of no word, and of two: P(end), and P(w) P(end after w).
    ask = [(1000, "")] + [(1001 + k, w) for k, w in enumerate([*known, "stranger"])]
    ask += [(2000 + 100 * i + j, f"{a} {b}") for i, a in enumerate([*known, "stranger"]) for j, b in enumerate([*known, "stranger"])]
    df = spark.createDataFrame([*((i, t, False) for i, t in train), *((i, t, True) for i, t in ask)], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: 10**r.score for r in class_lm.class_scores(df).collect()}
    total = sum(got[i] for i, _ in ask)
    assert 0 < total < 1
    # P(no word) + sum over first words of P(first) = 1, and P(w, end) <= P(w).
    assert got[1000] + sum(got[i] for i, t in ask if t and " " not in t) < 1


def test_exchange_finds_words_with_like_neighbours(spark):
    rng = random.Random(5)
    left, right = [f"l{k}" for k in range(20)], [f"r{k}" for k in range(20)]
    texts = [(k, " ".join(rng.choice(left) + " " + rng.choice(right) for _ in range(50)), k % 5 == 0) for k in range(100)]
    df = spark.createDataFrame(texts, "doc_id long, text string, held_out boolean")
    sums = class_lm.class_scores(df).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    # The base has to choose among 41 words, the classes among 20.
    assert sums[1] / sums[2] < math.log10(1 / 38) and sums[0] / sums[2] > math.log10(1 / 24)


def test_co_training_separates_and_handles_awkward_rows(spark, awkward):
    rng = random.Random(6)
    good, bad = [f"good{k}" for k in range(50)], [f"awful{k}" for k in range(50)]
    rows, labels = [], []
    for k in range(300):
        fine = k % 3 > 0
        text = " ".join(rng.choices(good if fine else [*good, *bad], k=40)) if fine or k % 2 else "BUY!! NOW!! " * 20
        rows.append((k, text, "en", "site" if fine else "farm"))
        if k % 2 or k % 3 == 0:
            labels.append((k, int(fine), 0))
    labels += [(None, 1, 0), (1, None, 0), (5, 1, None), (3, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("label", F.lit("clash"))
    model = cotraining.learn_quality(docs, known)
    got = {r.doc_id: r for r in cotraining.scored(docs, model).collect()}
    assert np.mean([(got[k].score >= 0.5) == (k % 3 > 0) for k in range(300)]) > 0.97
    assert all(0 <= s <= 1 for r in got.values() for s in (r.text_score, r.page_score, r.score))
    assert cotraining.scored(awkward, model).count() == awkward.count()
    assert cotraining.scored(awkward.limit(0), model).count() == 0
    flat = cotraining.learn_quality(docs, known.limit(0))
    assert {round(r.score, 6) for r in cotraining.scored(awkward, flat).collect()} == {1.0}
    one = cotraining.learn_quality(docs, known.where("quality = 1"))
    assert {r.score >= 0.5 for r in cotraining.scored(awkward, one).collect()} == {True}


def test_views_teach_each_other_over_the_whole_corpus(spark):
    """Junk of a kind that no label shows is only known by its source, in a few of many unlabelled documents."""
    rng = random.Random(9)
    good, old, new = ([f"{w}{k}" for k in range(60)] for w in ("fine", "junk", "novel"))
    rows, labels = [], []
    for k in range(600):
        fine = k % 2 == 0
        rows.append((k, " ".join(rng.choices(good if fine else old, k=30)), "en", "site" if fine else "farm"))
        labels.append((k, int(fine), 0))
    for k in range(1000, 5000):
        rows.append((k, " ".join(rng.choices(good, k=30)), "en", "site"))
    for k in range(5000, 5060):
        rows.append((k, " ".join(rng.choices(new, k=30)), "en", "farm"))
    rows += [(k, " ".join(rng.choices(new, k=30)), "en", None) for k in range(6000, 6020)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def text_scores(rounds):
        model = cotraining.learn_quality(docs, known, rounds=rounds)
        return [r.text_score for r in cotraining.scored(docs.where("doc_id >= 6000"), model).collect()]

    assert np.mean(text_scores(0)) > np.mean(text_scores(3)) + 0.2 and np.mean(text_scores(3)) < 0.3


def test_one_document_of_an_id_is_learned_from(spark, monkeypatch):
    rows = [(1, f"text number {k}", "en", "a") for k in range(3000)] + [(k, "other words", "en", "b") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)], "doc_id long, quality int, toxic int")
    seen = {}

    def learned(text_rows, page_rows, labels, surest, rounds):
        seen["rows"] = len(text_rows), len(page_rows), len(labels)
        return cotraining.View(np.empty(0, np.uint32), np.empty(0), 0.0)

    monkeypatch.setattr(cotraining, "co_train", learned)
    cotraining.learn_quality(docs, known, sample=10)
    assert seen["rows"] == (10, 10, 10)
    cotraining.learn_quality(docs, known)
    assert seen["rows"] == (39, 39, 39)
