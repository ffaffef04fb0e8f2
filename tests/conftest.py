import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from ledgerwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def one(spark):
    """Evaluate column functions on one row of literal values."""

    def evaluate(column, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
        return row.select(column.alias("result")).first()[0]

    return evaluate
