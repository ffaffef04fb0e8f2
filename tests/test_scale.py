import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwise import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, with repeated values."""
    draw = random.Random(3)
    rows = [
        (i, "hot" if i % 3 == 0 else f"k{draw.randint(0, 40)}", draw.choice([0.1, 0.5, draw.random()]))
        for i in range(6000)
    ]
    return spark.createDataFrame(rows, "seq long, key string, value double").repartition(7), rows


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_are_exact(skewed, descending):
    df, rows = skewed
    table = scale.cut_lineage(df.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")))
    found = {
        (r.key, r.value): r.upto
        for r in scale.running_totals(table, ["key"], "value", {"upto": "n"}, descending, 16).collect()
    }
    for key in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == key]
        for value in set(values):
            inside = sum(v >= value if descending else v <= value for v in values)
            assert found[key, value] == inside
    assert len(found) == len({(r[1], r[2]) for r in rows})


def test_quantiles_equal_linear_interpolation(skewed):
    df, rows = skewed
    probabilities = (0.0, 0.25, 0.5, 0.9, 0.995, 1.0)
    found = {r.key: r.quantiles for r in scale.exact_quantiles(df, ["key"], "value", probabilities).collect()}
    for key, quantiles in found.items():
        expected = np.quantile([r[2] for r in rows if r[1] == key], probabilities)
        assert quantiles == pytest.approx(list(expected), abs=1e-12)
    overall = scale.exact_quantiles(df, [], "value", (0.5,)).first().quantiles[0]
    assert overall == pytest.approx(np.quantile([r[2] for r in rows], 0.5))


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "v double")
    assert scale.exact_quantiles(df, [], "v", (0.5,)).first().quantiles == [1.5]


@pytest.mark.parametrize("max_rows", [0, scale.BROADCAST_ROWS])
def test_keep_first_on_both_paths(skewed, max_rows):
    df, rows = skewed
    kept = scale.keep_first(df, ["key"], "seq", max_rows)
    expected = {}
    for seq, key, _ in rows:
        expected.setdefault(key, seq)
    assert {r.key: r.seq for r in kept.collect()} == expected
    assert kept.count() == len(expected)
    assert scale.keep_first(kept, ["key"], "seq", max_rows).count() == len(expected)


def test_keep_first_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, None, "y")], "seq int, a string, b string")
    assert sorted(r.seq for r in scale.keep_first(df, ["a", "b"], "seq").collect()) == [1, 3]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("max_rows", [0, scale.BROADCAST_ROWS])
def test_attach_unique_on_both_paths(spark, skewed, how, max_rows):
    df, rows = skewed
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("absent", 4)], "key string, x int")
    joined = scale.attach_unique(df, right, ["key"], "seq", how, max_rows)
    table = {"hot": 1, "k1": 2, "k2": 3}
    expected = {s: table.get(k) for s, k, _ in rows if how == "left" or k in table}
    assert {r.seq: r.x for r in joined.collect()} == expected
    assert joined.count() == len(expected)


def test_hot_keys(skewed):
    df, _ = skewed
    assert [r.key for r in scale.hot_keys(df, ["key"], 0.2).collect()] == ["hot"]


def test_salted_join_does_not_collapse_onto_one_task(spark, skewed):
    df, _ = skewed
    right = spark.createDataFrame([("hot", 1)], "key string, x int")
    plan = scale.attach_unique(df, right, ["key"], "seq", "left", 0)
    text = plan._jdf.queryExecution().toString()
    assert "_salt" in text and "CartesianProduct" not in text


def test_calendar_year_bound(spark):
    df = spark.createDataFrame([(2000,), (123456,)], "y int")
    with pytest.raises(Exception, match="calendar year"):
        df.select(scale.calendar_year(F.col("y"))).collect()


def test_spread_leaves_large_inputs_alone(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "Repartition" not in scale.spread(df, "doc_id", 0)._jdf.queryExecution().toString()
    assert "Repartition" in scale.spread(df, "doc_id")._jdf.queryExecution().toString()


def test_running_totals_by_text(spark):
    import hashlib

    names = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(500)] + ["", "a", "ab"]
    df = spark.createDataFrame([(k % 2, n, 1) for k, n in enumerate(names)], "g int, name string, n int")
    got = {(r.g, r.name): r.upto for r in scale.running_totals(df, ["g"], "name", {"upto": "n"}).collect()}
    for g in (0, 1):
        for rank, name in enumerate(sorted(n for k, n in enumerate(names) if k % 2 == g), 1):
            assert got[g, name] == rank


def test_null_keys_are_spread_and_kept(spark):
    left = spark.createDataFrame([(None if k % 3 else "k", k) for k in range(300)], "key string, id int")
    right = spark.createDataFrame([("k", 1), ("other", 2)], "key string, v int")
    joined = scale.join_unique(left, right, False, ["key"], "id")
    assert joined.count() == 300 and joined.where("v = 1").count() == 100


@pytest.mark.parametrize("probability", [0.0, 0.1, 0.5, 0.999, 1.0])
@pytest.mark.parametrize("accuracy", [20, 500, 10_000])
def test_bracketed_quantiles_are_exact(spark, probability, accuracy):
    draw = random.Random(8)
    rows = [
        (k % 2, draw.choice([0.0, draw.gauss(0, 1)]), draw.choice([None, float("nan"), draw.random()]), None)
        for k in range(5000)
    ]
    df = spark.createDataFrame(rows, "g int, a double, b double, none double").repartition(5)
    found = {r.g: r for r in scale.bracketed_quantiles(df, ["g"], ["a", "b", "none"], probability, accuracy).collect()}
    for g in (0, 1):
        for k, name in ((1, "a"), (2, "b")):
            values = [r[k] for r in rows if r[0] == g and r[k] is not None and r[k] == r[k]]
            assert found[g][name] == pytest.approx(np.quantile(values, probability), abs=1e-12)
        assert found[g]["none"] is None
    whole = scale.bracketed_quantiles(df, [], ["a"], probability, accuracy).first()
    assert tuple(whole) == pytest.approx((np.quantile([r[1] for r in rows], probability),), abs=1e-12)


def test_python_gets_small_batches_unless_the_session_names_a_size(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    other = spark.newSession()
    scale.bound_python_batches(other)
    assert other.conf.get(name).rstrip("b") == str(scale.PYTHON_BATCH)
    other.conf.set(name, 123_456)
    scale.bound_python_batches(other)
    assert other.conf.get(name).rstrip("b") == "123456"
