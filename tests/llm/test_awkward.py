"""Every query of the subpackage on empty tables, on rows of nulls and on repeated rows."""

import pytest

from palimpsest.llm import queries

QUERIES = queries.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls(spark, null_folder, name):
    QUERIES[name](spark, null_folder).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_repeated_rows(spark, twice_folder, name):
    QUERIES[name](spark, twice_folder).collect()
