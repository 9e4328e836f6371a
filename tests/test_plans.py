"""What has to hold of the physical plans for the work to scale."""

import os

import pytest
from pyspark.sql import functions as F

from panelwright.functions.order_stats import top_per_key
from panelwright.operators import anomaly, change, coverage, trend
from panelwright.operators.bins import to_wide
from panelwright.plans import panels

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_limited_before_the_shuffle(spark):
    df = top_per_key(spark.range(100).selectExpr("id % 3 as k", "id"), ["k"], [F.desc("id")], 4)
    text = plan(df)
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_trends_shuffle_once_after_the_panel(spark):
    written = change.settle(panels.supp_year(spark, SF))
    assert plan(trend.fit_trends(written)).count("Exchange hashpartitioning") == 1


def test_change_and_grid_shuffle_once(spark, indicators):
    written = change.settle(panels.supp_year(spark, SF))
    assert plan(change.change_from_previous(written)).count("Exchange hashpartitioning") == 1
    grid = plan(coverage.coverage_grid(written, panels.settings(spark)))
    assert grid.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in grid
    assert plan(to_wide(written, ["place_id"], ["ship/share_r"])).count("Exchange hashpartitioning") == 1


def test_scales_are_broadcast_and_rows_stay_where_they_are(spark):
    changes = change.with_own_scale(change.change_from_previous(panels.user_day(spark, SF)))
    # The panel's own shuffle and one on the series: the statistics need no other.
    assert plan(changes).count("Exchange hashpartitioning") == 2
    changes = change.settle(changes)
    text = plan(anomaly.detect_spikes(changes, change.change_scales(changes)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    # The worst change per place, then the worst places: both combined before the shuffle.
    assert text.count("Exchange hashpartitioning") == 2 and "partial_max_by" in text


def test_scans_read_only_what_they_need(spark):
    text = plan(panels.cust_year(spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp" in text
    finished = plan(panels.table(spark, SF, "orders").where(F.col("o_orderstatus") == "F").select("o_custkey"))
    assert "EqualTo(o_orderstatus,F)" in finished


def test_no_query_needs_python_rows_or_cross_joins(spark):
    import __spark_entry__ as entry

    for name in ("yoy_change", "trends", "coverage_grid", "coverage_grid_wide", "second_source_latest", "lineage_checks", "merge_catalog", "priority_scores", "payload_points"):
        text = plan(entry.queries()[name](spark, SF))
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
            assert operator not in text, (name, operator)


def test_units_are_counted_from_the_rows_that_are_put_on_the_axis(spark):
    from panelwright.operators import quality

    # the panel's own aggregation has been written, not left to be done once more
    text = plan(quality.one_step_unit(panels.cust_year(spark, SF)).panel)
    assert "HashAggregate" not in text and "orders.parquet" not in text
