import html
import math
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

import check_queries
from __spark_entry__ import oracle_sql, queries
from ledgerwise import fixed_values as fv
from ledgerwise.functions import text

C = F.col


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("a&amp;b <b>x</b> ﬁ \r\n\n\n\nz\x07", "a&b x fi \n\nz"),
        (None, ""),
        ("  \t　", ""),
        ("plain <i>t</i>", "plain t"),
        ("a\rb", "ab"),
        ("&lt;p&gt;x", "x"),
        ("tab\t\tand  space", "tab and space"),
    ],
)
def test_clean_text(one, raw, expected):
    assert one(text.clean_text(C("s")), s=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("1,000.50", "1, 000. 50"),
        ("!!", "! !"),
        ("a,b!!c", "a, b! !c"),
        ("a , b…c", "a, b. .. c"),
        ("“q” ‘s’ x—y", "\"q\" 's' x-y"),
        (" many  spaces\n here ", "many spaces here"),
        ("__ELLIPSIS__", "..."),
        (None, ""),
    ],
)
def test_normalize_text(one, raw, expected):
    assert one(text.normalize_text(C("s")), s=raw) == expected


def test_cleaning_equals_step_by_step_python(spark):
    samples = [
        "<p>Café &eacute; &#8220;x&#8221;</p>\n\n\n\nend",
        "no markup at all",
        "&nbsp;&nbsp;½ ① <br/>​zero",
        "x < y and y > z & w",
        "Ångström\t\t\u0000nul",
    ]

    def expected(value):
        decoded = unicodedata.normalize("NFKC", re.sub("<[^>]+>", " ", html.unescape(value)))
        kept = "".join(c for c in decoded if c in "\n\t" or unicodedata.category(c)[0] != "C")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", kept)).strip()

    rows = spark.createDataFrame(list(enumerate(samples)), "i int, s string")
    found = {r.i: r.c for r in rows.select("i", text.clean_text(C("s")).alias("c")).collect()}
    assert found == {i: expected(s) for i, s in enumerate(samples)}


def test_word_count_is_unicode(one):
    assert one(text.word_count(C("s")), s="naïve café x_1 中文 - 12") == 5
    assert one(text.word_count(C("s")), s=None) == 0


def test_reference_only(one):
    pointer = "Incorporated by reference to the Annual Report."
    assert one(text.is_reference_only(C("s")), s=pointer) is True
    assert one(text.is_reference_only(C("s")), s=pointer + " word" * 200) is False
    assert one(text.is_reference_only(C("s")), s="annual report only") is False


@pytest.mark.parametrize(
    "word, count", [("simple", 1), ("sentence", 2), ("agree", 1), ("the", 1), ("rhythm", 1),
                    ("isn't", 1), ("numbers", 2), ("area", 2), ("xkcd", 1), ("Able", 1)],
)
def test_syllables(one, word, count):
    assert one(text.syllables(C("s")), s=word) == count


def test_digit_ratio_counts_other_digits(one):
    sample = "1²①٣x\U0001f101 ab"
    assert one(text.digit_ratio(C("s")), s=sample) == sum(map(str.isdigit, sample)) / len(sample)


def test_character_ratios_of_texts_without_characters(spark, tmp_path):
    samples = ["", None, "", " \n", "12", "!", "Ab1.", "É²"]
    documents = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    documents.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    name, connection = "character_ratios_p21", duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries()[name](spark, str(tmp_path))
    assert check_queries.compare(found, oracle_sql()[name], connection) == []
    empty = [(r.digit_ratio, r.punctuation_ratio, r.uppercase_ratio) for r in found.where("seq IN (0, 2)").collect()]
    assert len(empty) == 2 and all(math.isnan(d) and math.isnan(p) and u == 0 for d, p, u in empty)


def test_strip_uses_the_full_whitespace_set(one):
    assert one(text.strip(C("s")), s=fv.WHITESPACE + "x y" + fv.WHITESPACE) == "x y"


@pytest.mark.parametrize("least", [0, 1, 3, 200, 5000])
def test_has_words_equals_the_count(spark, least):
    values = [None, "", " .", "one", "a b", "á_1, ß-中文 x", "w " * 199, "w " * 200, "w, " * 4999, "\n" + "é. " * 5000]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(
        text.has_words(F.col("v"), least).alias("found"), (text.word_count(F.col("v")) >= least).alias("counted")
    )
    assert all(r.found is r.counted for r in rows.collect())
