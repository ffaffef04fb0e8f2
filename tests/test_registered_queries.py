import pytest

import check_queries
from __spark_entry__ import entry, oracle_sql, queries
from ledgerwise.catalog import model_queries

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ORACLES = oracle_sql()
# A minute or more each: tools/check_queries.py compares them, other tests cover what they call.
SLOW = {"boosted_tree_rows_l4", "search_trials_l11"}
# The smallest data has one usable fold only.
FOLDS = {"candidate_review_rows_w14", "guarded_holdout_l15", "walk_forward_rows_l6"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW - FOLDS))
def test_query_equals_its_sql(spark, name):
    problems = check_queries.compare(queries()[name](spark, FOLDER), ORACLES[name], check_queries.connect(FOLDER))
    # The smallest data has no year with 30 positives, so that fold table may be empty.
    allowed = ["no rows"] if name == "walk_forward_folds_w5" else []
    assert [p for p in problems if p not in allowed] == []


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_model_query_equals_its_sql(spark, monkeypatch, name):
    monkeypatch.setattr(model_queries, "TRIALS", 20)
    assert check_queries.compare(queries()[name](spark, LARGER), ORACLES[name], check_queries.connect(LARGER)) == []


def test_entry_is_lazy_and_not_empty(spark):
    df = entry(spark)
    assert df.columns == ["feature", "label", "n", "mean", "std"] and df.count() == 32
