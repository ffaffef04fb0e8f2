import math
import random
import re
import string

import pytest

from ledgerwise import fixed_values as fv
from ledgerwise.catalog import views
from ledgerwise.operators.features import add_text_features
from ledgerwise.operators.lexicon import add_densities

WORD = re.compile(fv.SURFACE_WORD)


def by_hand(value):
    """The 16 features, one word and one character at a time."""
    value = (value or "").strip()
    words = WORD.findall(value)
    parts = [p for p in re.split("[.!?]+", value) if p.strip()]
    if not words or not parts:
        return [None] * 15 + [0.0]
    syllable_list = []
    for word in words:
        lowered = word.lower()
        groups = len(re.findall("[aeiouy]+", lowered))
        syllable_list.append(max(1, groups - (lowered[-1] == "e" and groups > 1)))
    n, s = len(words), len(parts)
    asw, asyl = n / s, sum(syllable_list) / n
    hard = sum(x >= 3 for x in syllable_list) / n
    letters = [c for c in value if c.isalpha()]
    share = lambda test: sum(map(test, value)) / len(value)
    return [
        float(len(value)), float(n), float(s), asw, math.log1p(n),
        206.835 - 1.015 * asw - 84.6 * asyl, 0.39 * asw + 11.8 * asyl - 15.59,
        0.4 * (asw + 100 * hard), hard, share(str.isdigit),
        share(lambda c: c in string.punctuation),
        sum(c.isupper() for c in letters) / len(letters) if letters else 0.0,
        sum(map(len, words)) / n,
        sum(len(WORD.findall(p)) >= 25 for p in parts) / s,
        len({w.lower() for w in words}) / n, 1.0,
    ]


def check(spark, samples):
    df = spark.createDataFrame(list(enumerate(samples)), "seq int, mda string")
    rows = {r.seq: r for r in add_text_features(df).collect()}
    assert len(rows) == len(samples)
    for i, sample in enumerate(samples):
        found = [rows[i][name] for name in fv.TEXT_FEATURES]
        for name, a, b in zip(fv.TEXT_FEATURES, found, by_hand(sample)):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-12), (name, sample[:80])


def test_known_sentence(spark):
    value = "This is a simple sentence. Another sentence contains 123 numbers!"
    df = spark.createDataFrame([(value,)], "mda string")
    row = add_text_features(df).first()
    assert (row.mda_word_count, row.mda_sentence_count, row.mda_text_available) == (9.0, 2.0, 1.0)
    assert row.mda_digit_ratio > 0


def test_missing_text_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([("A short disclosure.",), ("",), (None,), ("123 456",)], "mda string")
    out = add_text_features(df)
    assert out.columns == ["mda", *fv.TEXT_FEATURES]
    rows = out.collect()
    assert [r.mda_text_available for r in rows] == [1.0, 0.0, 0.0, 0.0]
    assert rows[1].mda_word_count is None


def test_counting_patterns_equal_word_by_word_counts(spark):
    draw = random.Random(7)
    alphabet = "aeiouyAEIOUYbcdxzBT'' .!?é² 12-"
    samples = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 120))) for _ in range(400)]
    samples += ["ae" * 30_000, "b" * 50_000, "babe" * 20_000, "e", "eee e be ble", "a'e e'a x'"]
    check(spark, samples)


def test_real_documents(spark):
    texts = [r.mda for r in views.texts(spark, "/root/testdata/sf0.001").collect()]
    check(spark, texts)


def test_density_is_null_without_words(spark):
    columns = ", ".join(f"{n} double" for n in fv.LEXICON_COUNTS)
    df = spark.createDataFrame([(0.0,) + (1.0,) * 7, (10.0,) + (1.0,) * 7], columns)
    rows = add_densities(df).collect()
    assert rows[0].negative_density is None and rows[1].litigious_density == 0.1
