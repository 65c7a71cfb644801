"""Every registered query: against DuckDB where it has check SQL, else it must return rows."""
import os

import pytest

from dawnscore.check import compare, connect
from dawnscore.plans import load_all
from dawnscore.plans.registry import ORACLE, QUERIES

load_all()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EMPTY_AT_TINY_SCALE = {"d17_single_window", "f15_cross_site_pool", "l10_site_macro_auc"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    state, rows, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_DIR)
    assert state in ("ok", "rows-only"), note
    assert rows > 0 or name in EMPTY_AT_TINY_SCALE


def test_contract():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 283


def test_flagship(spark):
    import __spark_entry__ as entry
    rows = {r["stream"]: r["macro"] for r in entry.entry(spark).collect()}
    assert set(rows) == {"pa", "pb", "blend", "rescued"}
    assert all(0 <= v <= 1 for v in rows.values())
