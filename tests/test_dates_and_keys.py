import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerwise.functions import dates, keys, numbers

C = F.col


@pytest.mark.parametrize(
    "value, ok", [("15-03-2020", True), ("1-2-2019", False), ("31-02-2019", False),
                  (" 15-03-2020 ", True), (None, False), ("", False), ("2020-03-15", False)],
)
def test_strict_day(one, value, ok):
    assert one(dates.is_strict_date(C("s"), "dd-MM-yyyy"), s=value) is ok


@pytest.mark.parametrize("value, ok", [("03-2020", True), ("3-2020", False), ("13-2020", False)])
def test_strict_month(one, value, ok):
    assert one(dates.is_strict_date(C("s"), "MM-yyyy"), s=value) is ok


def test_month_bounds(one):
    assert one(dates.month_start(C("s")), s="2-2020") == dt.date(2020, 2, 1)
    assert one(dates.month_end(C("s")), s=" 02-2020 ") == dt.date(2020, 2, 29)
    for bad in ("", "2020", "13-2020", "a-b", None):
        assert one(dates.month_start(C("s")), s=bad) is None


@pytest.mark.parametrize(
    "value, year",
    [("15-03-2020", 2020), ("2019-12-31", 2019), ("2018/1/2", 2018), ("12/31/2017", 2017),
     ("31/12/2016", 2016), ("1995", 1995), ("not-a-date", None), ("31-02-2019", None), (None, None)],
)
def test_multi_format_year(one, value, year):
    assert one(dates.multi_format_year(C("s")), s=value) == year


@pytest.mark.parametrize(
    "day, fye, expected",
    [
        ("2018-03-15", "1231", "2018-12-31"),
        ("2018-11-10", "0630", "2019-06-30"),
        ("2018-11-10", "630", "2019-06-30"),
        ("2018-06-30", "0630", "2018-06-30"),
        ("2019-03-10", "0229", None),
        ("2020-02-10", "0229", "2020-02-29"),
        ("2020-03-10", "0229", None),
        ("2018-03-15", "1231.0", None),
        ("2018-03-15", "9999", None),
        ("2018-03-15", None, None),
    ],
)
def test_fiscal_year_end(one, day, fye, expected):
    found = one(dates.fiscal_year_end(C("d").cast("date"), C("f")), d=day, f=fye)
    assert found == (expected and dt.date.fromisoformat(expected))


def test_record_times_are_naive_utc(one):
    assert one(dates.utc_timestamp(C("s")), s="2024-12-19T21:08:41") == dt.datetime(2024, 12, 19, 21, 8, 41)
    assert one(dates.utc_timestamp(C("s")), s="2017-01-18T08:24:41-05:00") == dt.datetime(2017, 1, 18, 13, 24, 41)
    assert one(dates.utc_timestamp(C("s")), s="soon") is None


def test_record_times_ignore_the_session_zone(spark, one):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = one(dates.utc_timestamp(C("s")).cast("string"), s="2024-12-19T21:08:41")
        assert found == "2024-12-19 21:08:41"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_required_date_fails(one):
    assert one(dates.required_day_first_date(C("s")), s="15-03-2020") == dt.date(2020, 3, 15)
    with pytest.raises(Exception, match="invalid filing date"):
        one(dates.required_day_first_date(C("s")), s="not-a-date")


def test_lag_floors_towards_the_past(one):
    lag = dates.whole_days_between(C("a").cast("timestamp_ntz"), C("b").cast("timestamp_ntz"))
    assert one(lag, a="2019-07-18 00:00:00", b="2024-12-19 00:00:00") == 1981
    assert one(lag, a="2020-01-02 00:00:00", b="2020-01-01 12:00:00") == -1


@pytest.mark.parametrize(
    "value, key", [("1750.0", "0000001750"), (" 1750 ", "0000001750"), (None, ""),
                   ("123456789012", "123456789012"), ("", "0000000000")],
)
def test_company_key(one, value, key):
    assert one(keys.company_key(C("s")), s=value) == key


@pytest.mark.parametrize("value, key", [("CIK 1750.0", "0000001750"), ("none", None), (None, None)])
def test_company_key_digits(one, value, key):
    assert one(keys.company_key_digits(C("s")), s=value) == key


def test_filing_ids_agree_for_equivalent_inputs(one):
    def filing_id(cik, filed, reported, kind):
        column = keys.stable_filing_id(
            C("c"), dates.day_first_date(C("f")), dates.day_first_date(C("r")), C("t")
        )
        return one(column, c=cik, f=filed, r=reported, t=kind)

    first = filing_id("0000001750", "2019-07-18", "2018-12-31", "10-K")
    assert first == filing_id("1750", "18-07-2019", "31-12-2018", " 10-k ")
    payload = {"cik": "0000001750", "filing_date": "2019-07-18", "filing_type": "10-K",
               "reporting_date": "2018-12-31"}
    encoded = json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()
    assert first == hashlib.sha256(encoded).hexdigest()


def test_json_hash_ignores_argument_order(one):
    assert one(keys.sha256_json(a=C("x"), b=C("y")), x="1", y="2") == one(
        keys.sha256_json(b=C("y"), a=C("x")), x="1", y="2"
    )


def test_fingerprint_ignores_order_but_counts_copies(spark):
    def mark(rows):
        return keys.content_fingerprint(spark.createDataFrame(rows, "a int, b string")).first()

    assert mark([(1, "x"), (2, "y")]) == mark([(2, "y"), (1, "x")])
    assert mark([(1, "x"), (2, "y")]) != mark([(1, "x"), (1, "x")])
    assert mark([(1, "x")]) != mark([(1, "x"), (1, "x")])


def test_bin_edges_follow_the_step():
    assert numbers.bin_edges(10)[2] == 0.30000000000000004
    with pytest.raises(ValueError):
        numbers.bin_edges(0)


def test_differing_keys(one):
    expected = F.create_map(F.lit("a"), C("x"), F.lit("b"), F.lit("2"))
    actual = F.create_map(F.lit("a"), F.lit("1"), F.lit("c"), F.lit("3"))
    assert one(numbers.differing_keys(expected, actual), x="1") == ["b", "c"]


@pytest.mark.parametrize(
    "t, df, p", [(2.0, 10, 0.07338803477074045), (0.0, 5, 1.0), (12.706204736174694, 1, 0.05),
                 (1.959963984540054, 1e9, 0.05), (-2.0, 10, 0.07338803477074045)],
)
def test_student_t_tail(t, df, p):
    assert numbers.two_sided_t(t, df) == pytest.approx(p, rel=1e-6)


def test_integer_or_zero(one):
    for value, expected in (("3", 3), ("2.9", 2), ("", 0), (None, 0), ("n/a", 0), ("NaN", 0)):
        assert one(numbers.integer_or_zero(C("s")), s=value) == expected


def test_student_t_tail_of_many_degrees_of_freedom():
    """At t = 2 the tail falls towards the normal one, 0.0455002638963584, from above."""
    for df in (2e4, 1e6, 1e9, 1e11, 1e12):
        p = numbers.two_sided_t(2.0, df)
        assert p == pytest.approx(0.0455002638963584 + 2 * 0.05399096651318806 * 10 / (4 * df), abs=1e-9)
    # Both ways to compute it agree where one takes over from the other.
    assert numbers.two_sided_t(2.5, 9_999) == pytest.approx(numbers.two_sided_t(2.5, 10_001), rel=1e-5)
    assert numbers._nearly_normal_tail(3.0, 9_999) == pytest.approx(numbers.two_sided_t(3.0, 9_999), rel=1e-8)


def test_integers_keep_64_bits(one):
    assert one(numbers.integer_or_zero(C("s")), s="3000000000") == 3_000_000_000
    assert one(numbers.integer_or_zero(C("s")), s="1e300") == 0


def test_fingerprint_tells_where_a_null_stands(spark):
    def mark(row):
        return keys.content_fingerprint(spark.createDataFrame([row], "a string, b string")).first()

    assert mark(("x", None)) != mark((None, "x"))
