"""Text functions. Every function takes and returns Columns.

Only HTML-entity decoding and NFKC have no Spark builtin; both live in one Arrow UDF each,
only the rows that need them travel to Python, and there they are changed one by one.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerwise import fixed_values as fv

_SPACE = f"[{fv.WHITESPACE_CLASS}]"
_NON_ASCII = r"[^\x00-\x7F]"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def is_missing(value: Column) -> Column:
    """True for NULL and for strings that hold only whitespace."""
    return value.isNull() | (strip(value) == "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def _one_by_one(change: Callable[[str], str], texts: pa.Array) -> pa.Array:
    """Apply a function to the texts of a batch. Only one text at a time is a Python string."""
    return pa.array((None if text is None else change(text) for text in (t.as_py() for t in texts)), pa.string())


@F.arrow_udf(StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return _one_by_one(html.unescape, texts)


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return _one_by_one(lambda text: unicodedata.normalize("NFKC", text), texts)


@F.arrow_udf(StringType())
def _decode_markup(texts: pa.Array) -> pa.Array:
    tag = re.compile("<[^>]+>")

    def decode(text: str) -> str:
        return unicodedata.normalize("NFKC", tag.sub(" ", html.unescape(text)))

    return _one_by_one(decode, texts)


def _through_python(text: Column, needed: Column, udf, otherwise: Column) -> Column:
    """Send only the rows that need it through the UDF; the others stay in the JVM.

    The UDF is declared nondeterministic, which it is not, so that the optimizer computes
    its column once. Otherwise a filter on the result would be pushed below it, and the
    text would go through Python a second time. Chain such functions over columns
    (`withColumn`), not inside one expression.
    """
    return F.coalesce(udf.asNondeterministic()(F.when(needed, text)), otherwise)


def unescape_html(text: Column) -> Column:
    return _through_python(text, text.contains("&"), _unescape, text)


def normalize_unicode(text: Column) -> Column:
    """NFKC. ASCII text is already normalized."""
    return _through_python(text, text.rlike(_NON_ASCII), _nfkc, text)


def decode_markup(text: Column) -> Column:
    """Entities decoded, then tags replaced by a space, then NFKC."""
    needed = text.contains("&") | text.rlike(_NON_ASCII)
    return _through_python(text, needed, _decode_markup, strip_tags(text))


def _where_found(text: Column, marks: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """The text, changed where one of the marks occurs; without them the change would change nothing.

    Finding a mark is far cheaper than a regular expression over the whole text. The text is bound to a
    lambda's variable, so that chained steps do not repeat it.
    """

    def changed(value: Column) -> Column:
        found = reduce(lambda a, b: a | b, [value.contains(mark) for mark in marks])
        return F.when(found, change(value)).otherwise(value)

    return F.transform(F.array(text), changed)[0]


def remove_control_characters(text: Column) -> Column:
    """Drop Unicode category C except newline and tab."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]+", "")


def tidy_lines(text: Column) -> Column:
    """LF line ends, single spaces, at most one blank line, no outer whitespace."""
    steps = (
        (("\r",), r"\r\n?", "\n"),
        (("\t", "  "), r"[ \t]+", " "),
        (("\n\n\n",), r"\n{3,}", "\n\n"),
    )
    for marks, pattern, new in steps:
        text = _where_found(text, marks, lambda t, p=pattern, n=new: F.regexp_replace(t, p, n))
    return strip(text)


def clean_text(text: Column) -> Column:
    """The whole cleaning step; a missing text becomes the empty string."""
    cleaned = tidy_lines(remove_control_characters(decode_markup(text)))
    return F.coalesce(cleaned, F.lit(""))


def normalize_quotes(text: Column) -> Column:
    return _where_found(text, tuple("“”‘’"), lambda t: F.translate(t, "“”‘’", "\"\"''"))


def normalize_dashes(text: Column) -> Column:
    return _where_found(text, tuple("–—−"), lambda t: F.translate(t, "–—−", "---"))


def normalize_ellipsis(text: Column) -> Column:
    return F.replace(text, F.lit("…"), F.lit("..."))


def normalize_spacing(text: Column) -> Column:
    """No whitespace before a punctuation mark, one space after it."""
    text = F.regexp_replace(text, f"{_SPACE}+([,.;:!?])", "$1")
    return F.regexp_replace(text, f"([,.;:!?])([^{fv.WHITESPACE_CLASS}])", "$1 $2")


def collapse_punctuation(text: Column) -> Column:
    """Runs of one mark become one mark; full stops, and so ellipses, stay.

    The marker word of the source format is read as an ellipsis.
    """
    doubled = tuple(2 * mark for mark in "!?;:,")
    text = _where_found(text, doubled, lambda t: F.regexp_replace(t, r"([!?;:,])\1+", "$1"))
    return F.replace(text, F.lit("__ELLIPSIS__"), F.lit("..."))


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{_SPACE}+", " "))


def normalize_text(text: Column) -> Column:
    """The whole normalization step, in its fixed order; NULL becomes ''."""
    steps = (
        normalize_unicode,
        normalize_quotes,
        normalize_dashes,
        normalize_ellipsis,
        normalize_spacing,
        collapse_punctuation,
        collapse_whitespace,
    )
    for step in steps:
        text = step(text)
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of Unicode words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[{fv.WORD_CHARS}]+")), F.lit(0))


def has_words(text: Column, least: int) -> Column:
    """`word_count(text) >= least`. Reading ends at that word, and no word is copied."""
    if least <= 0:
        return F.lit(True)
    word = f"[^{fv.WORD_CHARS}]*+[{fv.WORD_CHARS}]++"
    return F.coalesce(text.rlike(rf"\A(?:{word}){{{least}}}+"), F.lit(False))


def phrase_matches(text: Column, phrases: tuple[str, ...] = fv.REFERENCE_PHRASES) -> Column:
    """How many of the phrases occur, ignoring case."""
    lowered = F.lower(text)
    found = [F.coalesce(lowered.contains(phrase), F.lit(False)).cast("int") for phrase in phrases]
    return sum(found[1:], found[0])


def is_reference_only(
    text: Column,
    phrases: tuple[str, ...] = fv.REFERENCE_PHRASES,
    min_phrases: int = fv.MIN_REFERENCE_PHRASES,
    min_words: int = fv.MIN_WORDS,
) -> Column:
    """A short text that only points to another document."""
    return (word_count(text) < min_words) & (phrase_matches(text, phrases) >= min_phrases)


def surface_words(text: Column) -> Column:
    """Array of ASCII words, with at most one inner apostrophe."""
    return F.regexp_extract_all(text, F.lit(fv.SURFACE_WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Array of the non-blank parts between sentence marks."""
    parts = F.transform(F.split(text, "[.!?]+"), strip)
    return F.filter(parts, lambda part: part != "")


def syllables(word: Column) -> Column:
    """Vowel groups of one word, less a silent final e, at least 1."""
    lowered = F.lower(word)
    groups = F.regexp_count(lowered, F.lit("[aeiouy]+"))
    silent = (lowered.endswith("e") & (groups > 1)).cast("int")
    return F.greatest(groups - silent, F.lit(1))


def count_characters(text: Column, char_class: str) -> Column:
    """How many characters of the text are in a regex class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def _per_character(count: Column, text: Column) -> Column:
    """A count over the length of the text; NaN for the empty text, which has no share, and NULL for NULL."""
    share = count / F.nullif(F.length(text), F.lit(0))
    return F.coalesce(share, F.when(text.isNotNull(), F.lit(math.nan)))


def digit_ratio(text: Column) -> Column:
    """Share of digits. ASCII other than digits is skipped before the long class is tried."""
    others = rf"(?:[\x00-/:-\x7f]++|[^{fv.DIGIT_CHARS}])++"
    return _per_character(F.length(F.regexp_replace(text, others, "")), text)


def punctuation_ratio(text: Column) -> Column:
    return _per_character(count_characters(text, fv.PUNCTUATION_CHARS), text)


def uppercase_ratio(text: Column) -> Column:
    """Uppercase share of the letters; 0 when there are no letters, as in an empty text or NULL."""
    letters = count_characters(text, r"\p{L}")
    share = count_characters(text, r"\p{Lu}") / F.nullif(letters, F.lit(0))
    return F.coalesce(share, F.lit(0.0))
