"""Text-surface features of a filing, as native column expressions.

Words and sentences are counted on the whole text with a handful of regular expressions
over the space-joined lower-case words, instead of one expression per word. The counting
patterns are checked against the per-word function `text.syllables` in the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.functions import text

# Over lower-case words joined by single spaces: V is a vowel, C anything else in a word.
_V, _C = "[aeiouy]", "[^aeiouy ]"
_START, _END = "(?<![^ ])", r"(?=\x20|\z)"
_NO_VOWEL_WORD = f"{_START}{_C}++{_END}"
_SILENT_E_WORD = f"{_START}{_C}*+(?:{_V}++{_C}++)++{_V}*e{_END}"
# Three syllables or more: four vowel groups, or three that do not end the word in e.
_COMPLEX_WORD = (
    f"{_START}{_C}*+(?:{_V}++{_C}++){{2}}"
    f"(?:{_V}++{_C}++{_V}|{_V}++{_C}++{_END}|{_V}*[aiouy]{_END})"
)


def _vowel_groups(joined: Column) -> Column:
    """Each run up to and including a vowel group becomes one character."""
    marked = F.regexp_replace(F.concat(joined, F.lit(" a")), f"[^aeiouy]*+{_V}++", "x")
    return F.length(marked) - 1


def _matches(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def add_text_features(df: DataFrame, text_column: str = "mda") -> DataFrame:
    """Append the 16 features; NULL features and availability 0 without usable text."""
    mda = text.strip(F.col(text_column))
    staged = (
        df.withColumn("_mda", mda)
        .withColumn("_words", text.surface_words(F.col("_mda")))
        .withColumn("_joined", F.lower(F.array_join("_words", " ")))
        .withColumn("_sentences", text.sentences(F.col("_mda")))
        .withColumn("_n_words", F.size("_words"))
        .withColumn("_n_sentences", F.size("_sentences"))
    )
    usable = F.coalesce(
        (F.length("_mda") > 0) & (F.col("_n_words") > 0) & (F.col("_n_sentences") > 0),
        F.lit(False),
    )
    joined = F.col("_joined")
    words = F.when(usable, F.col("_n_words")).cast("double")
    sentence_count = F.when(usable, F.col("_n_sentences")).cast("double")
    syllable_count = (
        _vowel_groups(joined)
        - _matches(joined, _SILENT_E_WORD)
        + _matches(joined, _NO_VOWEL_WORD)
    )
    long_sentences = F.size(
        F.filter(
            "_sentences", lambda s: _matches(s, fv.SURFACE_WORD) >= fv.LONG_SENTENCE_WORDS
        )
    )
    letters = F.length("_joined") - (F.col("_n_words") - 1)
    diversity = F.size(F.array_distinct(F.split("_joined", " ")))
    counted = staged.select(
        *df.columns,
        words.alias("_w"),
        sentence_count.alias("_s"),
        (words / sentence_count).alias("_asw"),
        (syllable_count / words).alias("_asyl"),
        (_matches(joined, _COMPLEX_WORD) / words).alias("_complex"),
        F.when(usable, F.length("_mda")).cast("double").alias("_chars"),
        F.when(usable, text.digit_ratio(F.col("_mda"))).alias("_digit"),
        F.when(usable, text.punctuation_ratio(F.col("_mda"))).alias("_punct"),
        F.when(usable, text.uppercase_ratio(F.col("_mda"))).alias("_upper"),
        (letters / words).alias("_wlen"),
        (long_sentences / sentence_count).alias("_long"),
        (diversity / words).alias("_diversity"),
        usable.cast("double").alias("_available"),
    )
    asw, asyl, complex_ratio = F.col("_asw"), F.col("_asyl"), F.col("_complex")
    values = (
        F.col("_chars"),
        F.col("_w"),
        F.col("_s"),
        asw,
        F.log1p("_w"),
        F.lit(206.835) - F.lit(1.015) * asw - F.lit(84.6) * asyl,
        F.lit(0.39) * asw + F.lit(11.8) * asyl - F.lit(15.59),
        F.lit(0.4) * (asw + F.lit(100) * complex_ratio),
        complex_ratio,
        F.col("_digit"),
        F.col("_punct"),
        F.col("_upper"),
        F.col("_wlen"),
        F.col("_long"),
        F.col("_diversity"),
        F.col("_available"),
    )
    return counted.select(
        *df.columns, *[value.alias(name) for name, value in zip(fv.TEXT_FEATURES, values)]
    )
