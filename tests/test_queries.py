"""Every registered core query, against its SQL where there is one; the entry point."""

import re
from pathlib import Path

import pytest

from palimpsest.plans import catalog
from tests.compare import same_rows

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    if name in ORACLES:
        same_rows(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["user_id", "event_type", "event_id", "day", "gap"]
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_core_stands_alone():
    for p in (ROOT / "palimpsest").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(?:from|import)\s+palimpsest\.llm", p.read_text(), re.M), p
