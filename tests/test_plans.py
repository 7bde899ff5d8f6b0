"""Plan shape: the scale properties the design relies on, checked on executed plans (sf0.001)."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def _plan(spark, key):
    import __spark_entry__ as E

    df = E.entry(spark) if key == "entry" else E.queries()[key](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["entry", "topk_values", "type_issues", "histogram_30", "chart_pie", "chart_box",
                                 "duplicate_rows", "kpi_values", "kpi_comparative",
                                 "quality_quick", "quality_report"])
def test_no_cartesian_products(spark, key):
    plan = _plan(spark, key)
    assert "CartesianProduct" not in plan, key
    # a nested-loop join is only allowed with a join condition (e.g. a key compared with a
    # literal table name on a one-row-per-table side); an unconditioned one is a cross join
    for line in plan.splitlines():
        if "BroadcastNestedLoopJoin" in line:
            assert re.search(r"BroadcastNestedLoopJoin \w+, \w+, \(", line), (key, line.strip())


@pytest.mark.parametrize("key", ["topk_values", "type_issues", "sample_values"])
def test_first_k_is_limited_before_the_shuffle(spark, key):
    plan = _plan(spark, key)
    assert re.search(r"WindowGroupLimit .*Partial", plan), key


def test_narrow_charts_read_only_their_columns(spark):
    plan = _plan(spark, "chart_scatter")
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"l_quantity:double,l_extendedprice:double"}
    assert "PushedFilters: [IsNotNull(o_orderdate)]" in _plan(spark, "chart_line")
