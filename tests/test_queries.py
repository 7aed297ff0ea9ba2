import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracles  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check_oracles.database(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_agrees_with_its_sql(spark, db, name):
    agrees, note = check_oracles.compare(spark, db, SF_DIR, name)
    assert agrees, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
