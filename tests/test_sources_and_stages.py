import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ledgerwise import fixed_values as fv
from ledgerwise.operators import models
from ledgerwise.plans import data_stages
from ledgerwise.sources import readers, schemas, writers
from ledgerwise.streaming import incremental


def write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"cik": "1750"},\n {"cik": "2", "mda": "x"}\n]')
    rows = readers.read_json_records(spark, str(tmp_path / "a.json"), schemas.FILINGS).collect()
    assert [(r.cik, r.mda) for r in rows] == [("1750", None), ("2", "x")]
    assert readers.json_root_kind(spark, str(tmp_path / "a.json")) == "array"
    (tmp_path / "o.json").write_text(' \n{"cik": 1}')
    assert readers.json_root_kind(spark, str(tmp_path / "o.json")) == "object"
    (tmp_path / "e.json").write_text("  ")
    assert readers.json_root_kind(spark, str(tmp_path / "e.json")) == "unknown"


def test_delimited_files_skip_their_own_preamble(spark, tmp_path):
    fields = schemas.all_strings(("id", "cik", "note"))
    write_lines(tmp_path / "a.csv", ["title", "id;cik;note", "1;10;x", '2;11;"a;b"', "3;12;"])
    write_lines(tmp_path / "b.csv", ["title", "id;cik;note", "4;13;y;", "5;14;z;extra", "1;10;x"])
    rows = readers.read_delimited(spark, str(tmp_path), fields).collect()
    found = {(r.id, r.cik, r.note, r._overflow) for r in rows}
    assert found == {
        ("1", "10", "x", None), ("2", "11", "a;b", None), ("3", "12", None, None),
        ("4", "13", "y", ""), ("5", "14", "z", "extra"),
    }
    assert len(rows) == 6 and len({r.seq for r in rows}) == 6


def test_split_files_skip_only_the_first_lines(spark, tmp_path):
    write_lines(tmp_path / "big.csv", ["title", "columns"] + [f"{i};{i % 7}" for i in range(20_000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.read_delimited(spark, str(tmp_path / "big.csv"), schemas.all_strings(("id", "k")))
        assert df.rdd.getNumPartitions() > 3
        assert sorted(int(r.id) for r in df.collect()) == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_file_checks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    found = {r.name: (r.exists, r.size_bytes) for r in readers.check_files(spark, str(tmp_path), ["a.txt", "b.txt"]).collect()}
    assert found == {"a.txt": (True, 3), "b.txt": (False, 0)}


def test_sealed_folder_works_once(spark, tmp_path):
    sealed = writers.SealedFolder(spark, str(tmp_path / "result"))
    with pytest.raises(RuntimeError, match="begin"):
        sealed.commit({"t": spark.range(3)})
    sealed.begin({"by": "test"})
    manifest = sealed.commit({"t": spark.range(3)}).first()
    assert (manifest.name, manifest.rows, manifest.status) == ("t", 3, "complete")
    with pytest.raises(RuntimeError, match="already started"):
        writers.SealedFolder(spark, str(tmp_path / "result")).begin({"by": "again"})
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sealed.commit({"t": spark.range(3)})


def stage_tables(spark):
    body = "The company reports strong growth in many markets. " * 40
    filings = [
        (1, "10.0", "A", "10-K", "15-03-2001", "31-12-2000", "1231", f"<p>{body}</p>"),
        (2, "10", "A", "10-K", "16-03-2002", "31-12-2001", "1231", body),
        (3, "10", "A", "10-K", "16-03-2002", "31-12-2001", "1231", body),
        (4, "11", "B", "10-K/A", "16-03-2002", "31-12-2001", "1231", body),
        (5, "12", "C", "10-K", "16-03-2002", "31-12-2001", "1231", "too short"),
        (6, "13", "D", "10-K", "16-03-2005", "31-12-2004", "1231", body),
    ]
    names = "seq int, cik string, name string, filing_type string, filing_date string, reporting_date string, fye string, mda string"
    periods = [(1, "10", "06-2000", "06-2001", "1", "1"), (2, "99", "06-2000", "06-2001", "1", "1")]
    lexicon = [(1, "10", "20000501", 100.0) + (5.0,) * 7, (2, "13", "20040501", 0.0) + (5.0,) * 7]
    counts = ", ".join(f"{n} double" for n in fv.LEXICON_COUNTS)
    return {
        "filings": spark.createDataFrame(filings, names),
        "periods": spark.createDataFrame(
            periods, "seq int, cik string, fraud_start string, fraud_end string, certainty_start string, certainty_end string"
        ),
        "lexicon": spark.createDataFrame(lexicon, f"seq int, CIK string, FILING_DATE string, {counts}"),
        "cutoff": 2004,
    }


def test_stages_end_to_end(spark):
    tables = data_stages.run_stages(stage_tables(spark), "development-features", acknowledge_holdout=True)
    rows = {r.seq: r for r in tables["features"].collect()}
    assert sorted(rows) == [1, 2]
    assert (rows[1].fraudulent, rows[1].matched_fraud_start) == (1, dt.date(2000, 6, 1))
    assert rows[1].lexicon_matched and rows[1].negative_density == 0.05
    assert rows[2].fraudulent == 0 and not rows[2].lexicon_matched and rows[2].negative_density is None
    assert rows[1].mda_word_count == 320 and "<p>" not in rows[1].mda
    assert [r.seq for r in tables["holdout"].collect()] == [6]
    full = data_stages.full_features(tables["development"], tables["holdout"], stage_tables(spark)["lexicon"])
    assert {(r.seq, r.dataset) for r in full.collect()} == {(1, "trainval"), (2, "trainval"), (6, "test")}


def test_stages_resume(spark, tmp_path, monkeypatch):
    store, tables = str(tmp_path / "stages"), stage_tables(spark)
    first = data_stages.run_stages(tables, "split", True, store)
    plain = data_stages.run_stages(tables, "split", True)
    for name in ("checked", "normalized", "development", "holdout"):
        assert first[name].exceptAll(plain[name]).count() == 0 == plain[name].exceptAll(first[name]).count()
    ran = []
    for name, stage in list(data_stages.STAGES.items()):
        monkeypatch.setitem(data_stages.STAGES, name, lambda t, n=name, f=stage: ran.append(n) or f(t))
    again = data_stages.run_stages(tables, "split", True, store)
    assert ran == [] and again["holdout"].collect() == first["holdout"].collect()
    data_stages.run_stages({**tables, "cutoff": 2001}, "split", True, store)
    assert ran == ["split"]
    data_stages.run_stages({**tables, "periods": tables["periods"].where("seq = 2")}, "merge-labels", False, store)
    assert ran == ["split", "ingest-labels", "merge-labels"]


def test_words_are_looked_for_once(spark):
    made = data_stages.run_stages(stage_tables(spark), "split", True)
    for name in ("checked", "development", "holdout"):
        plan = made[name].drop("mda")._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan and "regexp" not in plan


def test_the_lexicon_join_moves_no_text(spark):
    tables = {k: t for k, t in stage_tables(spark).items() if k != "cutoff"}
    filings = tables["filings"].withColumn("reporting_date", F.to_date("reporting_date", "dd-MM-yyyy"))
    full = data_stages.full_features(filings.where("seq < 6"), filings.where("seq = 6"), tables["lexicon"])
    assert full.columns[-len(fv.TEXT_FEATURES):] == list(fv.TEXT_FEATURES)
    plan = full.select("seq", "lexicon_matched", "mda_word_count")._jdf.queryExecution().optimizedPlan().toString()
    # Above the join, which is written first, nothing is left to do on texts.
    assert "Join" in plan and "regexp" not in plan[: plan.index("Join")]


def test_a_replaced_table_is_used(spark):
    labelled = data_stages.run_stages(stage_tables(spark), "normalize")
    other = labelled["normalized"].withColumn("mda", F.lit("one word " * 300))
    assert {r.mda for r in data_stages.STAGES["quality-check"]({"normalized": other})["checked"].collect()} == {"one word " * 300}


def test_holdout_gate(spark):
    with pytest.raises(RuntimeError, match="acknowledged"):
        data_stages.run_stages({}, "split")
    with pytest.raises(ValueError, match="Unknown stage"):
        data_stages.run_stages({}, "train-model")
    assert not any("model" in name for name in data_stages.STAGES)


def test_stream_deduplicates_across_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "k string, v int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).coalesce(1).write.parquet(folder)
    spark.createDataFrame([("a", 2), ("c", 2)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = incremental.run_available(incremental.first_seen(stream, ["k"]), "test")
    assert sorted(r.k for r in out.collect()) == ["a", "b", "c"]


def test_stream_goes_on_where_the_last_run_ended(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "base")
    schema = "k string, v int"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        out = incremental.run_available(incremental.first_seen(stream, ["k"]), "test", base)
        return sorted((r.k, r.v) for r in out.collect())

    assert run([("a", 1), ("b", 1)]) == [("a", 1), ("b", 1)]
    assert run([("a", 2), ("c", 2)]) == [("a", 1), ("b", 1), ("c", 2)]


def test_stream_cleaning_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    filings = stage_tables(spark)["filings"]
    filings.write.parquet(folder)
    stream = incremental.file_stream(spark, folder, filings.schema)
    streamed = incremental.run_available(incremental.clean_and_filter(stream), "clean")
    batch = incremental.clean_and_filter(filings)
    assert sorted(streamed.collect()) == sorted(batch.collect()) and batch.count() == 4


def test_bounded_stream_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("a", dt.datetime(2024, 1, 1, 0, i)) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    df.write.parquet(folder)
    stream = incremental.file_stream(spark, folder, df.schema)
    out = incremental.run_available(incremental.first_seen_within(stream, ["k"], "ts", "1 hour"), "within")
    assert out.count() == 1


def separable(spark, years=range(2000, 2006), size=40):
    rows = []
    for year in years:
        for i in range(size):
            label = int(i % 4 == 0)
            rows.append((len(rows), year, label, label * 2.0 + (i * 7 % 11) / 6.0, float(i % 5), None if i % 9 else 1.0))
    return spark.createDataFrame(rows, "seq int, year int, y int, a double, b double, c double")


@pytest.fixture(scope="module")
def table(spark):
    return models.model_table(separable(spark), ["a", "b", "c"], "y", "year", "seq")


def test_walk_forward_with_calibration(table):
    predictions = models.walk_forward(
        table, models.logistic(["a", "b", "c"]), min_positives=5, raw_reference=True,
        min_train_years=2, calibration="chronological_holdout",
    )
    folds = models.evaluated_folds(predictions).collect()
    assert sorted(r.test_year for r in folds) == [2002, 2003, 2004, 2005]
    assert all(r.roc_auc > 0.9 and r.raw_brier_score is not None for r in folds)
    assert predictions.count() == 160


def test_calibration_strategies(spark, table):
    estimator = models.logistic(["a", "b"], balanced=True)
    late, early = table.where("filing_year = 2005"), table.where("filing_year < 2005")
    for options in (
        {"calibration": "cross_validation", "cv": 3},
        {"calibration": "chronological_holdout", "method": "isotonic"},
        {},
    ):
        scored = models.fit_scorer(estimator, early, **options)(late)
        assert scored.count() == 40 and scored.where("score < 0 or score > 1 or score is null").count() == 0
    dealt = models.stratified_folds(table.select("row_id", "label"), 5).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in dealt if r.label == 1.0} == {12}
    with pytest.raises(ValueError, match="no such calibration"):
        models.fit_scorer(estimator, early, calibration="other")


def test_single_class_falls_back(spark):
    rows = [(i, 2000 + i // 10, float(i < 5), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id int, filing_year int, label double, a double")
    scorer = models.fit_scorer(models.logistic(["a"]), df, calibration="chronological_holdout")
    assert scorer(df).count() == 30


def test_partners_are_a_permutation(table):
    pairs = models._partners(table, ["a"], 1).join(table.select("row_id", "a"), "row_id").collect()
    assert len(pairs) == table.count()
    assert sorted(r.a for r in pairs) == sorted(r["a__other"] for r in pairs)
    assert any(r.a != r["a__other"] for r in pairs)


def test_linear_contributions_sum_to_the_margin(table):
    model = models.fit_full(table, models.logistic(["a", "b"]))
    parts = models.linear_contributions(table, model, ["a", "b"])
    from pyspark.ml.functions import vector_to_array

    margin = model.transform(table).select("row_id", vector_to_array("rawPrediction")[1].alias("m"))
    gap = parts.join(margin, "row_id").select(
        F.abs(F.col("a") + F.col("b") + float(model.stages[-1].intercept) - F.col("m")).alias("g")
    )
    assert gap.agg(F.max("g")).first()[0] < 1e-9


def test_holdout(table):
    predictions, summary = models.score_holdout(
        table.where("filing_year < 2004"), table.where("filing_year >= 2004"), models.logistic(["a", "b"]), (2004, 2005)
    )
    row = summary.first()
    assert predictions.count() == row.test_n == 80 and row.test_period == "2004-2005"
    with pytest.raises(ValueError, match="must end before"):
        models.score_holdout(table, table, models.logistic(["a"]), (2004, 2005))


def test_model_is_saved(table, tmp_path):
    from pyspark.ml import PipelineModel

    path = os.path.join(tmp_path, "model")
    models.save_model(models.fit_full(table, models.logistic(["a"])), path)
    assert PipelineModel.load(path).transform(table).count() == table.count()


def test_contract_gate(spark, table):
    expected = models.artifact_contract(table, ["a", "b"], "x")
    models.require_same_contract(expected, models.artifact_contract(table, ["a", "b"], "x"))
    with pytest.raises(RuntimeError, match="development_data, feature_schema"):
        models.require_same_contract(expected, models.artifact_contract(table.where("label = 1"), ["b", "a"], "x"))


def test_stratified_folds_are_runs_in_row_order(spark):
    """Counts and order of unshuffled stratified folds, for classes of uneven sizes."""
    labels = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame(list(enumerate(labels)), "row_id long, label double")
    got = [r.fold for r in models.stratified_folds(df, 3).orderBy("row_id").collect()]
    # Class 1 comes first, with 4 rows at places 0 to 3: folds get 2, 1 and 1 of them. Class 0 has
    # places 4 to 11: folds get 2, 3 and 3.
    assert [f for f, y in zip(got, labels) if y == 1.0] == [0, 0, 1, 2]
    assert [f for f, y in zip(got, labels) if y == 0.0] == [0, 0, 1, 1, 1, 2, 2, 2]


def test_labels_known_by_year_end_run_to_the_newest_record(spark):
    from datetime import datetime

    from ledgerwise.operators import maturity

    first = [(datetime(1995, 5, 1),), (datetime(1998, 12, 31),), (datetime(1998, 12, 31, 8),)]
    positives = spark.createDataFrame(first, "source_record_first timestamp")

    def known(newest):
        reference = spark.createDataFrame([(newest,)], "timestamp_max timestamp")
        return [tuple(r) for r in maturity.known_by_year_end(positives, reference, 1997).orderBy("year").collect()]

    assert known(datetime(2000, 2, 1)) == [(1997, 1), (1998, 2), (1999, 3), (2000, 3)]
    assert known(datetime(1996, 2, 1)) == []


def test_string_row_ids_in_the_review_queue(spark):
    from ledgerwise.operators import metrics

    rows = [(2000, f"id{k:03d}", int(k % 5 == 0), (k * 37 % 100) / 100) for k in range(100)]
    df = spark.createDataFrame(rows, "test_year int, row_id string, true_label int, predicted_probability double")
    assert metrics.review_metrics(df).count() == 1


def test_stream_keeps_the_smallest_number_of_a_key(spark, tmp_path):
    def file(name, rows):
        spark.createDataFrame(rows, "seq long, key string, day int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    def run():
        schema = spark.read.parquet(str(tmp_path / "in" / "*")).schema
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        log = incremental.run_log(incremental.first_by_sequence(stream, ["key", "day"], "seq"), "x", str(tmp_path / "out"))
        return log, {(r.key, r.day): r.seq for r in incremental.current_firsts(log, ["key", "day"], "seq").collect()}

    late = [(k, "hot" if k % 3 else f"k{k}", 1) for k in range(50, 500)] + [(7, None, None), (9, None, None), (None, "hot", 1)]
    file("b", late)
    log, found = run()
    assert found[("hot", 1)] == 50 and found[(None, None)] == 7 and log.where("replaces is not null").count() == 0
    early = [(k, "hot" if k % 3 else f"k{k}", 1) for k in range(0, 50)] + [(3, None, None), (600, "k51", 1)]
    file("a", early)
    log, found = run()
    expected = {}
    for seq, key, day in late + early:
        if seq is not None:
            expected[key, day] = min(seq, expected.get((key, day), seq))
    assert found == expected
    assert {(r.key, r.seq, r.replaces) for r in log.where("replaces is not null").collect()} == {("hot", 1, 50), (None, 3, 7)}


@pytest.mark.parametrize("buckets", [1, 7])
def test_smallest_numbers_are_kept_for_many_keys_of_a_bucket(spark, tmp_path, buckets):
    schema = "seq long, key string, day date"

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        firsts = incremental.first_by_sequence(stream, ["key", "day"], "seq", buckets)
        return incremental.run_log(firsts, "x", str(tmp_path / "out"))

    def file(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    day = dt.date(2001, 2, 3)
    late = [(k, f"k{k % 300}", day if k % 300 else None) for k in range(1000, 2000)]
    file("b", late)
    assert run().count() == 300
    early = [(k, f"k{k}", day if k else None) for k in range(0, 20)] + [(5000, "k40", day), (900, "new", day)]
    file("a", early)
    log = run()
    assert log.count() == 300 + 21
    least = {k % 300: k for k in reversed(range(1000, 2000))}
    replaced = {(r.key, r.seq): r.replaces for r in log.where("batch = 1").collect()}
    assert replaced == {**{(f"k{k}", k): least[k] for k in range(20)}, ("new", 900): None}
    expected = {}
    for seq, key, when in late + early:
        expected[key, when] = min(seq, expected.get((key, when), seq))
    assert {(r.key, r.day): r.seq for r in incremental.current_firsts(log, ["key", "day"], "seq").collect()} == expected
