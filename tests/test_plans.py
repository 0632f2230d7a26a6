"""Plans that the design counts on: no Python, few columns read, one row of a key leaves a task."""

from __future__ import annotations

import re

import pytest

from basketlake.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize("name", ["latest_products", "latest_prices", "latest_snapshots", "upsert_promotion_items", "links_until_stop"])
def test_the_limit_of_a_rank_is_below_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit.*Partial", plan(QUERIES[name](spark, DATA)))


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["orphan_prices"](spark, DATA))
    assert "ReadSchema: struct<l_partkey:bigint>" in text
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(p_size,25\)", text)
