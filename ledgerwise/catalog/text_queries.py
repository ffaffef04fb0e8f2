"""Text cleaning, normalization, counting and the 16 text-surface features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.catalog import views as v
from ledgerwise.catalog.registry import query
from ledgerwise.functions import text
from ledgerwise.operators import features

C = F.col

# The whitespace set and class as SQL.
_WS = "[" + fv.WHITESPACE_CLASS + "]"
_NOT_WS = "[^" + fv.WHITESPACE_CLASS + "]"
_TRIM_SET = " || ".join(f"chr({ord(ch)})" for ch in fv.WHITESPACE)


def strip_sql(value: str) -> str:
    return f"trim({value}, {_TRIM_SET})"


def _per_row(name, view, function, sql_expression=None):
    sql = None
    if sql_expression is not None:
        sql = f"SELECT seq, {sql_expression} AS result FROM {view}"

    @query(name, views=view if sql else "", sql=sql)
    def _(spark, sf):
        return getattr(v, view)(spark, sf).select("seq", function(C("mda")).alias("result"))


_per_row("unescape_html_p1", "raw_html", text.unescape_html)
_per_row(
    "strip_tags_p2", "raw_html", text.strip_tags, "regexp_replace(mda, '<[^>]+>', ' ', 'g')"
)
_per_row("unicode_nfkc_p3", "texts", text.normalize_unicode)
# SQL patterns cannot subtract newline and tab from category C, so its ranges are listed.
_CONTROL = r"[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{9f}\p{Cf}\p{Co}]"
_per_row(
    "remove_controls_p4",
    "raw_html",
    text.remove_control_characters,
    f"regexp_replace(mda, '{_CONTROL}', '', 'g')",
)
_TIDY = strip_sql(
    "regexp_replace(regexp_replace(regexp_replace(@, '\\r\\n?', chr(10), 'g'),"
    " '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
)
_per_row("tidy_lines_p5", "raw_html", text.tidy_lines, _TIDY.replace("@", "mda"))
_per_row("clean_text_p6", "raw_html", text.clean_text)
_per_row(
    "plain_quotes_p7", "texts", text.normalize_quotes, "translate(mda, '“”‘’', '\"\"''''')"
)
_per_row("plain_dashes_p8", "texts", text.normalize_dashes, "translate(mda, '–—−', '---')")
_per_row("plain_ellipsis_p9", "texts", text.normalize_ellipsis, "replace(mda, '…', '...')")
_SPACING = (
    f"regexp_replace(regexp_replace(@, '{_WS}+([,.;:!?])', '\\1', 'g'),"
    f" '([,.;:!?])({_NOT_WS})', '\\1 \\2', 'g')"
)
_per_row("punctuation_spacing_p10", "texts", text.normalize_spacing, _SPACING.replace("@", "mda"))


def _collapse_sql(value: str) -> str:
    for mark in ("!", "[?]", ";", ":", ","):
        plain = mark.strip("[]")
        value = f"regexp_replace({value}, '{mark}{{2,}}', '{plain}', 'g')"
    return f"replace({value}, '__ELLIPSIS__', '...')"


_per_row("repeated_punctuation_p11", "texts", text.collapse_punctuation, _collapse_sql("mda"))
_COLLAPSE_WS = strip_sql(f"regexp_replace(@, '{_WS}+', ' ', 'g')")
_per_row("collapse_whitespace_p12", "texts", text.collapse_whitespace, _COLLAPSE_WS.replace("@", "mda"))


# NFKC has no SQL twin for all characters; on ASCII text it changes nothing.
_NORMALIZED = _COLLAPSE_WS.replace("@", _collapse_sql(_SPACING.replace("@", "mda")))


@query("normalize_text_p13")
def _(spark, sf):
    return v.texts(spark, sf).select("seq", text.normalize_text(C("mda")).alias("result"))


@query(
    "normalize_ascii_text_p13",
    views="texts",
    sql=f"""SELECT seq, {_NORMALIZED} AS result
            FROM (SELECT seq, regexp_replace(mda, '[^\\x{{0}}-\\x{{7f}}]', ' ', 'g') AS mda FROM texts)""",
)
def _(spark, sf):
    ascii_only = F.regexp_replace("mda", r"[^\x00-\x7f]", " ")
    return v.texts(spark, sf).select("seq", text.normalize_text(ascii_only).alias("result"))


_per_row(
    "word_count_p14",
    "texts",
    text.word_count,
    f"CAST(len(regexp_extract_all(mda, '[{fv.WORD_CHARS}]+')) AS INTEGER)",
)

_SURFACE_SQL = fv.SURFACE_WORD.replace("'", "''")


@query(
    "surface_words_p18",
    views="texts",
    sql=f"""SELECT seq, CAST(len(w) AS INTEGER) AS words, array_to_string(w, ' ') AS joined
            FROM (SELECT seq, regexp_extract_all(mda, '{_SURFACE_SQL}') AS w FROM texts)""",
)
def _(spark, sf):
    words = v.texts(spark, sf).select("seq", text.surface_words(C("mda")).alias("w"))
    return words.select(
        "seq", F.size("w").alias("words"), F.array_join("w", " ").alias("joined")
    )


_SENTENCES_SQL = (
    "list_filter(list_transform(regexp_split_to_array(@, '[.!?]+'), lambda s: "
    + strip_sql("s")
    + "), lambda s: s <> '')"
)


@query(
    "sentence_split_p19",
    views="texts",
    sql=f"""SELECT seq, CAST(len(s) AS INTEGER) AS sentences, array_to_string(s, '|') AS joined
            FROM (SELECT seq, {_SENTENCES_SQL.replace('@', 'mda')} AS s FROM texts)""",
)
def _(spark, sf):
    split = v.texts(spark, sf).select("seq", text.sentences(C("mda")).alias("s"))
    return split.select(
        "seq", F.size("s").alias("sentences"), F.array_join("s", "|").alias("joined")
    )


def _syllables_sql(word: str) -> str:
    groups = f"len(regexp_extract_all({word}, '[aeiouy]+'))"
    return (
        f"greatest({groups} - CASE WHEN ends_with({word}, 'e') AND {groups} > 1 THEN 1 ELSE 0 END, 1)"
    )


@query(
    "syllable_counts_p20",
    views="texts",
    sql=f"""SELECT word, count(*) AS uses, CAST(max({_syllables_sql('lower(word)')}) AS INTEGER) AS syllables
            FROM (SELECT unnest(regexp_extract_all(mda, '{_SURFACE_SQL}')) AS word FROM texts) GROUP BY word""",
)
def _(spark, sf):
    words = v.texts(spark, sf).select(F.explode(text.surface_words(C("mda"))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    return counted.withColumn("syllables", text.syllables(C("word")))


_UPPER, _LETTER = r"\p{Lu}", r"\p{L}"


def _class_share(value: str, char_class: str) -> str:
    return f"length(regexp_replace({value}, '[^{char_class}]+', '', 'g'))"


@query(
    "character_ratios_p21",
    views="texts",
    sql=f"""SELECT seq, round({_class_share('mda', fv.DIGIT_CHARS)} / length(mda), 9) AS digit_ratio,
            round({_class_share('mda', fv.PUNCTUATION_CHARS)} / length(mda), 9) AS punctuation_ratio,
            round(coalesce({_class_share('mda', _UPPER)}
              / nullif({_class_share('mda', _LETTER)}, 0), 0.0), 9) AS uppercase_ratio
            FROM texts""",
)
def _(spark, sf):
    mda = C("mda")
    return v.texts(spark, sf).select(
        "seq",
        F.round(text.digit_ratio(mda), 9).alias("digit_ratio"),
        F.round(text.punctuation_ratio(mda), 9).alias("punctuation_ratio"),
        F.round(text.uppercase_ratio(mda), 9).alias("uppercase_ratio"),
    )


def features_sql(source: str, extra: str = "", digits: int = 6) -> str:
    """SQL body that computes the 16 features of a view, one word at a time, rounded."""
    figures, marks = fv.DIGIT_CHARS, fv.PUNCTUATION_CHARS
    return f"""WITH base AS (
        SELECT *, {strip_sql('mda')} AS t FROM {source}),
    parts AS (
        SELECT *, regexp_extract_all(t, '{_SURFACE_SQL}') AS w, {_SENTENCES_SQL.replace('@', 't')} AS s FROM base),
    counts AS (
        SELECT *, len(w)::DOUBLE AS nw, len(s)::DOUBLE AS ns,
               list_transform(w, lambda x: {_syllables_sql('lower(x)')}) AS syl,
               coalesce(len(w) > 0 AND len(s) > 0, false) AS usable FROM parts),
    rates AS (
        SELECT *, nw / ns AS asw, list_sum(syl) / nw AS asyl,
               len(list_filter(syl, lambda x: x >= 3)) / nw AS cplx FROM counts)
    SELECT seq{extra},
        CASE WHEN usable THEN length(t)::DOUBLE END AS mda_char_count,
        CASE WHEN usable THEN nw END AS mda_word_count,
        CASE WHEN usable THEN ns END AS mda_sentence_count,
        CASE WHEN usable THEN round(asw, {digits}) END AS mda_avg_sentence_words,
        CASE WHEN usable THEN round(ln(1 + nw), {digits}) END AS mda_log_word_count,
        CASE WHEN usable THEN round(206.835::DOUBLE - 1.015::DOUBLE * asw - 84.6::DOUBLE * asyl, {digits}) END AS mda_flesch_reading_ease,
        CASE WHEN usable THEN round(0.39::DOUBLE * asw + 11.8::DOUBLE * asyl - 15.59::DOUBLE, {digits}) END AS mda_flesch_kincaid_grade,
        CASE WHEN usable THEN round(0.4::DOUBLE * (asw + 100 * cplx), {digits}) END AS mda_gunning_fog,
        CASE WHEN usable THEN round(cplx, {digits}) END AS mda_complex_word_ratio,
        CASE WHEN usable THEN round({_class_share('t', figures)} / length(t), {digits}) END AS mda_digit_ratio,
        CASE WHEN usable THEN round({_class_share('t', marks)} / length(t), {digits}) END AS mda_punctuation_ratio,
        CASE WHEN usable THEN round(coalesce({_class_share("t", _UPPER)} / nullif({_class_share("t", _LETTER)}, 0), 0.0), {digits}) END AS mda_uppercase_ratio,
        CASE WHEN usable THEN round(list_sum(list_transform(w, lambda x: length(x))) / nw, {digits}) END AS mda_avg_word_length,
        CASE WHEN usable THEN round(len(list_filter(s, lambda x: len(regexp_extract_all(x, '{_SURFACE_SQL}')) >= 25)) / ns, {digits}) END AS mda_long_sentence_ratio,
        CASE WHEN usable THEN round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / nw, {digits}) END AS mda_lexical_diversity,
        CAST(usable AS DOUBLE) AS mda_text_available
    FROM rates"""


def rounded_features(df):
    return df.withColumns({name: F.round(name, 6) for name in fv.TEXT_FEATURES})


@query("text_features_p22", views="texts", sql=features_sql("texts"))
def _(spark, sf):
    return rounded_features(features.add_text_features(v.texts(spark, sf))).drop("mda")


@query(
    "feature_append_f27",
    views="labeled_texts",
    sql=features_sql("labeled_texts", ", fraudulent, filing_year"),
)
def _(spark, sf):
    return rounded_features(features.add_text_features(v.labeled_texts(spark, sf))).drop("mda")
