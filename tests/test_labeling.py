import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerwise.operators import ingest, labeling
from ledgerwise.plans import audits
from ledgerwise.operators import maturity

FILINGS = "seq int, cik string, reporting_date date, fye string"
PERIODS = "seq int, cik string, fraud_start date, fraud_end date, certainty_start int, certainty_end int"


def end_of_year(day, fye):
    if fye is None or len(fye) > 4:
        return None
    padded = fye.rjust(4, "0")
    try:
        this = dt.date(day.year, int(padded[:2]), int(padded[2:]))
        return this if day <= this else this.replace(year=day.year + 1)
    except ValueError:
        return None


def by_hand(filings, periods):
    out = {}
    for seq, cik, day, fye in filings:
        fiscal = day and end_of_year(day, fye)
        hits = [
            p for p in sorted(periods)
            if p[1] == cik and any(d is not None and p[2] <= d <= p[3] for d in (day, fiscal))
        ]
        out[seq] = (int(bool(hits)), hits[0][2:6] if hits else (None,) * 4, len(hits) > 1)
    return out


def random_case(whole_months, seed):
    draw = random.Random(seed)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(draw.randint(0, 1200))
    company = lambda: draw.choice(["hot", "hot", "a", "b", "c"])
    periods = []
    for seq in range(60):
        start = day()
        end = start + dt.timedelta(draw.randint(0, 400))
        if whole_months:
            start = start.replace(day=1)
            end = (end.replace(day=28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)
        periods.append((seq, company(), start, end, seq % 4, seq % 3))
    draw.shuffle(periods)
    filings = [
        (seq, company(), day() if seq % 11 else None, draw.choice(["1231", "630", "0229", "9999", None]))
        for seq in range(400)
    ]
    return filings, periods


@pytest.mark.parametrize("max_rows", [0, 1_000_000])
@pytest.mark.parametrize("whole_months", [True, False])
def test_equals_pairwise_matching(spark, whole_months, max_rows):
    filings, periods = random_case(whole_months, 5)
    labeled = labeling.label_filings(
        spark.createDataFrame(filings, FILINGS), spark.createDataFrame(periods, PERIODS), "seq", max_rows
    )
    found = {
        r.seq: (
            r.fraudulent,
            (r.matched_fraud_start, r.matched_fraud_end, r.certainty_start, r.certainty_end),
            r.multiple_matches,
        )
        for r in labeled.collect()
    }
    assert found == by_hand(filings, periods)
    assert sum(v[0] for v in found.values()) > 20


def test_intervals_are_closed(spark):
    period = [(1, "a", dt.date(2001, 3, 1), dt.date(2001, 4, 30), 1, 1)]
    days = [dt.date(2001, 2, 28), dt.date(2001, 3, 1), dt.date(2001, 4, 30), dt.date(2001, 5, 1)]
    filings = [(i, "a", d, None) for i, d in enumerate(days)]
    labeled = labeling.label_filings(
        spark.createDataFrame(filings, FILINGS), spark.createDataFrame(period, PERIODS)
    )
    assert [r.fraudulent for r in labeled.orderBy("seq").collect()] == [0, 1, 1, 0]


def test_period_cleaning_counts(spark):
    raw = spark.createDataFrame(
        [
            (1, "5", "01-2000", "03-2000", "1", ""),
            (2, "5", "1-2000", "3-2000", "2", "x"),
            (3, " ", "01-2000", "03-2000", "1", "1"),
            (4, "6", "05-2000", "03-2000", "1", "1"),
            (5, "7", "bad", "03-2000", "1", "1"),
        ],
        "seq int, cik string, fraud_start string, fraud_end string, certainty_start string, certainty_end string",
    )
    kept = ingest.clean_periods(raw).collect()
    assert [(r.seq, r.cik, r.certainty_start, r.certainty_end) for r in kept] == [(1, "5", 1, 0)]
    report = ingest.period_report(raw).first()
    assert (report.rows_read, report.rows_written, report.missing_cik) == (5, 1, 1)
    assert (report.missing_fraud_start, report.invalid_periods, report.duplicate_periods) == (1, 1, 1)


def source(spark, rows):
    return spark.createDataFrame(
        rows, "seq int, cik string, fraud_start string, fraud_end string, date_time string"
    )


def test_exact_link_and_lag(spark):
    periods = maturity.period_lookup(
        maturity.key_source_records(
            source(
                spark,
                [(1, "1750.0", "11-2015", "02-2020", "2024-12-19T00:00:00"),
                 (2, "1750", "11-2015", "02-2020", "2024-12-20T00:00:00"),
                 (3, "1750", None, "02-2020", "2024-12-20T00:00:00")],
            )
        )
    )
    assert periods.first().source_record_count == 2
    positives = spark.createDataFrame(
        [(1, "0000001750", dt.date(2019, 7, 18), dt.date(2015, 11, 1), dt.date(2020, 2, 29))],
        "seq int, cik_key string, filing_date date, matched_fraud_start date, matched_fraud_end date",
    )
    assert maturity.link_periods(positives, periods).first().lag_days == 1981
    other = positives.withColumn("cik_key", F.lit("0000000001"))
    with pytest.raises(Exception, match="no enforcement period"):
        maturity.link_periods(other, periods).collect()
    with pytest.raises(Exception, match="not unique"):
        maturity.link_periods(positives, periods.union(periods)).collect()


def test_maturity_audit_keeps_years_without_rows(spark):
    filings = spark.createDataFrame(
        [(1, "1", "18-07-2019", 1, dt.date(2019, 1, 1), dt.date(2019, 12, 31)),
         (2, "2", "18-07-2021", 0, None, None)],
        "seq int, cik string, filing_date string, fraudulent int, matched_fraud_start date, matched_fraud_end date",
    )
    records = source(spark, [(1, "1", "01-2019", "12-2019", "2021-07-18T00:00:00")])
    audit = audits.maturity_audit(filings, records, 2019, 2022, "2020-12-31")
    yearly = {r.filing_year: r for r in audit.yearly.collect()}
    assert sorted(yearly) == [2019, 2020, 2021, 2022]
    assert yearly[2019].positive_labels == 1 and yearly[2019].median_lag_days == 731
    assert yearly[2020].filings == 0 and yearly[2020].recorded_rate is None
    assert {r.year: r.labels_known for r in audit.known.collect()} == {2019: 0, 2020: 0, 2021: 1}
    cut = {r["quantile"]: r for r in audit.cutoffs.collect()}["p90"]
    assert (cut.lag_days, cut.cutoff, cut.years_covered) == (731, dt.datetime(2019, 7, 18), "")
    delays = audit.delays.first()
    assert delays.all_after_filing and delays.recorded_after == 1


@pytest.mark.parametrize("max_rows", [0, 1_000_000])
@pytest.mark.parametrize("limit", [0, 12, 1000])
def test_lists_and_cells_give_the_same_matches(spark, monkeypatch, limit, max_rows):
    monkeypatch.setattr(labeling, "LISTED_PERIODS", limit)
    filings, periods = random_case(False, 8)
    found = labeling.match_periods(
        spark.createDataFrame(filings, FILINGS), spark.createDataFrame(periods, PERIODS), "seq", max_rows
    ).collect()
    expected = {seq: (*values, many) for seq, (hit, values, many) in by_hand(filings, periods).items() if hit}
    assert {r.seq: tuple(r)[1:] for r in found} == expected and len(found) == len(expected)


def test_periods_of_small_companies_are_not_multiplied(spark, monkeypatch):
    monkeypatch.setattr(labeling, "period_cells", None)
    filings, periods = random_case(True, 5)
    labeled = labeling.label_filings(spark.createDataFrame(filings, FILINGS), spark.createDataFrame(periods, PERIODS))
    assert {r.seq: r.fraudulent for r in labeled.collect()} == {s: v[0] for s, v in by_hand(filings, periods).items()}
