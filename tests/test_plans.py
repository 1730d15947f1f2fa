"""The physical plans are the ones wanted: top-k pages, pruned scans, pushed filters, no cross products of tables."""

from __future__ import annotations

import pytest

from quarrygraph.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_top_k(spark):
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["page_after_key"](spark, DATA))


def test_scans_read_what_is_needed(spark):
    text = plan(registry.QUERIES["usage_summary_by_project"](spark, DATA))
    assert "l_tax" not in text and "l_shipdate" not in text and "o_totalprice" not in text
    assert "PushedFilters" in text and "o_orderstatus" in text


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"stream_dirty_paths"}))
def test_no_cartesian_products_of_tables(spark, name):
    text = plan(registry.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text
    if name not in ("recent_events", "evidence_summary"):  # beside one row
        assert "BroadcastNestedLoopJoin" not in text
    if name != "batch_plans":
        assert "Python" not in text and "Pandas" not in text
