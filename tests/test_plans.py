"""Physical plans: what must be pruned, pushed, broadcast or shuffled, and what must not."""

import pytest

from polyframe.plans import pushed_filters, read_schema
from polyframe.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    frame.collect()  # the final plan is known after the run
    return frame._jdf.queryExecution().executedPlan().toString(), frame


@pytest.mark.parametrize(
    ("name", "has", "lacks"),
    [
        ("topk", ["TakeOrderedAndProject"], ["Exchange rangepartitioning"]),
        ("dedup_latest", ["WindowGroupLimit"], []),
        ("unpivot", ["Expand"], ["Union"]),
        ("join_semi", ["LeftSemi"], []),
        ("join_anti", ["LeftAnti"], []),
        ("join_broadcast", ["BroadcastHashJoin"], ["SortMergeJoin"]),
        ("join_range", [], ["NestedLoop", "Cartesian"]),
        ("join_as_of", ["Window"], ["Join", "Cartesian"]),
        ("merge_rewrite", ["FullOuter"], ["NestedLoop", "Cartesian"]),
        ("pivot_single", ["pivotfirst"], []),
        ("sql_exists", ["LeftSemi"], []),
        ("sql_correlated_scalar", ["Join"], ["NestedLoop", "Cartesian"]),
        ("cube_grouping_id", ["Expand", "partial_count"], []),
        ("pandas_udf", ["ArrowEvalPython"], ["BatchEvalPython"]),
    ],
)
def test_operators(spark, name, has, lacks):
    text, _ = plan(spark, name)
    assert [x for x in has if x not in text] == []
    assert [x for x in lacks if x in text] == []


@pytest.mark.parametrize("name", ["tpch_q1", "tpch_q6", "agg_basic", "filter_and_or", "row_number", "window_tumbling", "math_trig", "string_regex"])
def test_no_python_and_codegen(spark, name):
    text, _ = plan(spark, name)
    assert "Python" not in text and "*(1)" in text


def test_filters_and_columns_reach_the_scan(spark):
    _, frame = plan(spark, "tpch_q6")
    pushed = " ".join(pushed_filters(frame))
    assert all(c in pushed for c in ("l_shipdate", "l_discount", "l_quantity"))
    assert set(read_schema(frame)) == {"l_shipdate", "l_discount", "l_quantity", "l_extendedprice"}
    _, frame = plan(spark, "flagship")
    assert any("l_shipdate" in f for f in pushed_filters(frame))
    assert not {"l_tax", "o_totalprice", "c_acctbal", "p_retailprice"} & set(read_schema(frame))
