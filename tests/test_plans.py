"""Plan-level scale checks: no Cartesian products or nested-loop joins, filters reach the scan."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

HEADLINE = ["user_cf", "user_cf_big", "candidates", "recommend", "keyword_search", "bm25_search", "hybrid_search",
            "metadata_candidates", "cart_retrieval", "co_cart_weights", "sequence_samples", "cold_start",
            "personal_plus_global", "item_similarity_table"]


@pytest.mark.parametrize("name", HEADLINE)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_date_filter_is_pushed_to_the_scan(spark):
    plan = E.queries()["filter_events"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
