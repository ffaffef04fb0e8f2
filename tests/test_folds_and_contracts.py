import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerwise.operators import contracts, folds, ingest, quality, split, validation
from ledgerwise.sources import schemas


def test_folds_train_on_earlier_years_only(spark):
    rows = [(2000, 1)] * 40 + [(2001, 1)] * 29 + [(2002, 1)] * 30 + [(2002, 0)] * 5
    df = spark.createDataFrame(rows, "y int, label int")
    found = folds.walk_forward_folds(df, "y", "label").collect()
    assert [(r.test_year, r.train_n, r.test_n) for r in found] == [(2002, 69, 35)]


def test_overlap_is_rejected(spark):
    d = dt.date
    df = spark.createDataFrame(
        [(2018, d(2018, 3, 1)), (2018, d(2019, 2, 1)), (2019, d(2018, 12, 1))], "y int, day date"
    )
    with pytest.raises(ValueError, match="temporal overlap"):
        folds.check_fold_order(df, "y", "day")
    assert folds.fold_overlap(df, "y", "day").first().overlapping_train_rows == 1
    ordered = df.withColumn("y", F.year("day"))
    assert folds.check_fold_order(ordered, "y", "day") is ordered


def test_audit_flags_year_drift(spark):
    df = spark.createDataFrame(
        [("15-03-2020", "31-12-2019", 2019, 1)],
        "filing_date string, reporting_date string, filing_year long, fraudulent long",
    )
    row = folds.year_drift(df).first()
    assert (row.mismatch_count, row.status) == (1, "fail")
    audit = folds.temporal_audit(df).first()
    assert (audit.status, audit.evaluated_folds) == ("fail", 0)


@pytest.mark.parametrize("sizes", [[10], [3, 1], [2, 2, 6], [1] * 30, [100, 5, 40, 1, 7]])
def test_calibration_start_is_a_sorted_position(spark, sizes):
    years = [2000 + i for i, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame([(y,) for y in years], "y int")
    position = min(max(1, math.ceil(len(years) * (1 - 0.2))), len(years) - 1)
    found = folds.calibration_start_year(df, "y").first()
    assert (found.calibration_start_year, found.split_position) == (sorted(years)[position], position)
    assert folds.split_position(len(years)) == position


def test_calibration_split_cannot_be_empty(spark):
    df = spark.createDataFrame([(2000,)] * 5, "y int")
    with pytest.raises(ValueError, match="too few training years"):
        folds.split_for_calibration(df, "y")


def test_window_uses_dates_not_stored_years(spark):
    df = spark.createDataFrame(
        [("31-12-2018", 2018), ("01-01-2019", 2000), ("31-12-2022", 2022), ("01-01-2023", 2023)],
        "filing_date string, filing_year long",
    )
    kept = split.select_window(df, 2019, 2022).orderBy("filing_year").collect()
    assert [r.filing_date for r in kept] == ["01-01-2019", "31-12-2022"]
    report = split.window_report(df, 2019, 2022).first()
    assert (report.selected, report.excluded) == (2, 2)


def test_filing_and_reporting_year_differ(spark):
    df = spark.createDataFrame([("15-03-2020", "31-12-2019")], "filing_date string, reporting_date string")
    row = split.with_filing_year(df).first()
    assert row.filing_year == 2020


def test_split_refuses_to_lose_rows(spark):
    df = spark.createDataFrame([("15-03-2020",), ("bad",), (None,)], "filing_date string")
    assert split.split_report(df).first().lost_records == 2
    with pytest.raises(ValueError, match="loses 2 of 3"):
        split.check_split(df)


def test_holdout_must_come_later(spark):
    def table(*days):
        return spark.createDataFrame([(d,) for d in days], "filing_date string")

    split.check_order(table("31-12-2018"), table("01-01-2019", "31-12-2022"))
    with pytest.raises(ValueError, match="overlap"):
        split.check_order(table("05-01-2019"), table("01-01-2019", "31-12-2022"))
    with pytest.raises(ValueError, match="span"):
        split.check_order(table("31-12-2018"), table("01-01-2019", "31-12-2021"))


def test_required_columns_and_rules(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "label int, p double")
    with pytest.raises(ValueError, match="misses required columns: \\['x'\\]"):
        contracts.require_columns(df, ["label", "x"])
    with pytest.raises(ValueError, match="not_binary"):
        contracts.validate_probabilities(df, "label", "p")
    good = spark.createDataFrame([(1, 0.0), (0, 1.0)], "label int, p double")
    assert contracts.validate_probabilities(good, "label", "p") is good
    with pytest.raises(ValueError, match="empty"):
        contracts.validate_probabilities(good.where("label > 5"), "label", "p")


def test_schema_difference(spark):
    left = spark.createDataFrame([(1, 2)], "a int, b int")
    right = spark.createDataFrame([(1, 2)], "b int, c int")
    rows = {tuple(r) for r in contracts.schema_difference(left, right).collect()}
    assert rows == {("a", "left_only"), ("c", "right_only")}


def test_fixed_schema(spark):
    df = spark.createDataFrame([("1", 1, "2019-01-01")], "cik string, fraudulent int, reporting_date string")
    out = contracts.to_schema(df, schemas.CHECKED_FILINGS)
    assert out.schema.simpleString() == schemas.CHECKED_FILINGS.simpleString() and len(out.columns) == 17
    assert out.first().reporting_date == dt.datetime(2019, 1, 1)


def test_target_checks(spark):
    schema = "label int, a double, b double"
    good = spark.createDataFrame([(0, 1.0, 1.0), (1, None, 2.0), (1, None, 2.0)], schema)
    assert contracts.target_report(good, ["a", "b"], "label").first().duplicate_rows == 1
    assert contracts.validate_target(good, ["a", "b"], "label") is good
    for rows, message in (
        ([(0, 1.0, 1.0), (None, 1.0, 1.0)], "no label"),
        ([(0, 1.0, 1.0), (2, 1.0, 1.0)], "exactly 0 and 1"),
        ([(1, 1.0, 1.0)], "exactly 0 and 1"),
        ([(0, 1.0, None), (1, 1.0, float("nan"))], "without any value: b"),
    ):
        with pytest.raises(ValueError, match=message):
            contracts.validate_target(spark.createDataFrame(rows, schema), ["a", "b"], "label")


def test_fill_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,)], "a double")
    assert [r.a for r in contracts.fill_missing(df, ["a"]).collect()] == [0.0, 0.0, 2.0]
    assert contracts.missing_value_count(df, ["a"]).first().missing_values == 2


def test_filing_errors(spark):
    schema = "seq int, cik string, name string, filing_type string, filing_date string, reporting_date string, mda string"
    rows = [
        (1, "1", "A", "10-K", "15-03-2020", "31-12-2019", "text"),
        (2, "1 ", "A", "10-K", "15-03-2020", "31-12-2019", "text"),
        (3, None, " ", "", "", None, "\t"),
        (4, "2", "A", "10-k", "1-2-2019", "31-12-2019", ""),
        (5, None, "A", "10-K", "15-03-2020", "31-12-2019", "text"),
        (6, None, "A", "10-K", "15-03-2020", "31-12-2019", "text"),
    ]
    checked = validation.filing_errors(spark.createDataFrame(rows, schema))
    found = {r.seq: r.errors for r in checked.collect()}
    assert found[1] == [] and found[2] == ["duplicate_filing"] and found[3] == ["empty_record"]
    assert found[4] == ["missing_mda", "malformed_filing_date", "invalid_filing_type"]
    assert found[5] == found[6] == ["missing_cik"]
    row = validation.dataset_summary(checked, "x", ("cik", "mda")).first()
    assert (row.valid_records, row.invalid_records, row.empty_records) == (1, 5, 1)
    assert (row.malformed_dates, row.duplicate_filings) == (1, 1)
    assert row.missing_values == '{"cik":2,"mda":1}'


def test_quality_rules_are_independent(spark):
    long_text = "word " * 200
    rows = [
        (1, long_text, "10-K", "2000"),
        (2, "short", " 10-k/a ", "1990"),
        (3, "Incorporated by reference to the annual report", "10-K", "2000"),
        (4, long_text, "10-K", "unknown"),
    ]
    df = spark.createDataFrame(rows, "seq int, mda string, filing_type string, filing_date string")
    report = quality.quality_report(df).first()
    assert (report.short_mda_removed, report.reference_only_removed) == (1, 1)
    assert (report.amended_removed, report.pre1993_removed, report.output_records) == (1, 2, 1)
    kept = quality.quality_filter(df)
    assert [r.seq for r in quality.check_filtered(kept).collect()] == [1]
    with pytest.raises(ValueError, match="breaks its contract"):
        quality.check_filtered(df)


def test_dedup_compares_dates_as_written(spark):
    rows = [(1, "1", "15-03-2020"), (2, "1", "2020-03-15"), (3, "1", "15-03-2020")]
    df = spark.createDataFrame(rows, "seq int, cik string, filing_date string")
    assert sorted(r.seq for r in ingest.deduplicate(df).collect()) == [1, 2]
    report = ingest.deduplication_report(df).first()
    assert (report.duplicate_records, report.duplicate_percentage) == (1, 33.3333)
    assert [r.seq for r in ingest.duplicate_examples(df).collect()] == [3]
