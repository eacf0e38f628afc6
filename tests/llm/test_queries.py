"""Every registered query of the subpackage on a small data set, with its SQL where there is one."""

import pytest

from palimpsest.llm import mixing, proportion_sample, queries
from tests.compare import same_rows

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()

COLUMNS = {
    "p1_found": ["plan_id", "task_type"], "p2_found": ["row_id_a", "row_id_b"], "p3_found": ["tab", "row_id", "task_idx", "defect"], "p4_found": ["index_a", "index_b"],
    "p5_found": ["item_kind", "row_id", "turn_idx", "cut"], "p6_found": ["doc_id", "item_id"], "p7_found": ["plan_id", "source"], "p8_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in ORACLES:
        same_rows(df, duck, ORACLES[name])
    else:
        df.collect()
    if name in COLUMNS:
        assert df.count() == df.distinct().count()


@pytest.mark.parametrize(("name", "module"), [("p1_found", proportion_sample), ("p7_found", mixing)])
def test_found_comes_from_the_draw(spark, folder, monkeypatch, name, module):
    """Without the flight nothing is drawn of most rows, and they would be found as well."""
    found = QUERIES[name](spark, folder).count()
    monkeypatch.setattr(module, "balanced_sample", lambda units, group, key, *_: units.where("pi >= 1").select(*group, key))
    assert QUERIES[name](spark, folder).count() > found
