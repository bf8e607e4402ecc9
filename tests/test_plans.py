"""What the plans look like: scans read what they need, and nothing that won't scale is in them."""

from __future__ import annotations

import pytest

from tabulith.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
#: Queries of formats, pages, models and services, where Python has its place, or that run parts of themselves at once.
PYTHON = ("tx", "tb1", "tb2_", "tb11", "sc", "sk", "ml", "rf1", "ud4", "ud8", "ud6")


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(PYTHON)))
def test_no_python_and_no_cartesian_product(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL))
    for node in ("CartesianProduct", "MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMap"):
        assert node not in plan, node


def test_scans_are_pruned(spark):
    plan = _plan(QUERIES["j4_membership"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_counting_combines_before_the_shuffle(spark):
    plan = _plan(QUERIES["ag23_distinct_papers"](spark, SMALL))
    before, after = plan.rindex("HashAggregate"), plan.index("Exchange")
    assert plan.index("HashAggregate") < after < before


def test_windows_of_a_rank_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(QUERIES["tk2_topk_per_group"](spark, SMALL))
