"""Every registered query plans without cartesian products, nested-loop
joins or row-at-a-time Python UDFs, and scans read only needed columns."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

_BAD = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython")


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.LLM_QUERIES)))
def test_plan_has_no_pairwise_joins_or_row_udfs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not _BAD.findall(plan), name


def test_scan_prunes_columns(spark):
    df = E.queries()["d3_priority_dedup_folded"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("lang" not in s and "source" not in s for s in schemas)
