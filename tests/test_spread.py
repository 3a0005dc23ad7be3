"""Queries whose rows cost much more than their move deal them to all tasks, however few files or row groups a table has."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cfg_finders", "prs_dates", "scr_pairs", "str_query_hints", "win_pairs"])
def test_rows_are_dealt_to_all_tasks(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= plan.count("FileScan") and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["tree_family", "tree_people"])
def test_trees_are_sent_to_no_task_whole(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan


def test_a_body_is_parsed_once(spark):
    """A filter on the route does not repeat the parse in front of it."""
    plan = E.queries()["val_notices"](spark, SF)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("parseJson") == 1
    assert "REPARTITION_BY_NUM" in plan.executedPlan().toString()


def test_notices_are_read_in_full_only_where_kept(spark):
    """A drain keeps the notices of a batch as they came; names and dates are parsed of a person's last notice of a URL alone."""
    from kinfold.plans import jobs
    from kinfold.streaming import drain

    held, trees = jobs._held(spark, SF)
    kept = {}
    got = drain.drain_tables(jobs._responses(spark, SF), held, None, trees, stage=lambda rows, tag: kept.setdefault(tag, rows))
    assert {"url", "row_key", "seq"} <= set(kept["notices"].columns) and "parsed_name" not in kept["notices"].columns
    assert "parsed_name" in got.notices.columns and "n" not in got.notices.columns
