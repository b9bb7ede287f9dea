"""What the plans of all registered queries must and must not hold."""

import pytest
from plans import plan_text

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairing_of_everything_and_no_row_udf(spark, name):
    plan = plan_text(QUERIES[name](spark, SF))
    for forbidden in ("CartesianProduct", "NestedLoop", "BatchEvalPython"):
        assert forbidden not in plan


@pytest.mark.parametrize("name", ["similar_products", "catalog_page"])
def test_top_rows_without_a_full_sort(spark, name):
    plan = plan_text(QUERIES[name](spark, SF))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("name", ["compare_prompts", "compare_answers", "compare_requests_valid"])
def test_requests_are_cut_to_size_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_text(QUERIES[name](spark, SF))
