"""Plans of the operators' queries hold no pairwise joins and no
row-at-a-time functions."""

from __future__ import annotations

import re

import pytest

from tasklane.llm import registry

_BAD = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython")
NATIVE = {"op6_license_scan"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_plan_of_query(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not _BAD.findall(plan)
    if name in NATIVE:
        assert not re.search("Python|Arrow|Pandas", plan)
