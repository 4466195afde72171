"""Shapes of plans: no nested loops, scans read only what is used, sums combine before they are shuffled."""

import re

import pytest

from halocline.plans import roster

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return roster.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


#: Those that prepare tables before there is a plan are held to the same in test_observed.py.
PREPARED = ("obs_event_located", "obs_event_parts", "obs_distance", "obs_smoothed", "obs_text_files", "obs_band_rows", "obs_record_rows", "obs_mesh_text")


@pytest.mark.parametrize("name", [n for n in roster.QUERIES if not n.endswith(("_v", "_serial")) and n not in PREPARED])
def test_no_nested_loops(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


@pytest.mark.parametrize("name", ["obs_node_value", "obs_halo_exchange", "obs_event_cell"])
def test_scans_and_sums(spark, name):
    p = plan(spark, name)
    read = re.search(r"ReadSchema: struct<(.*)>", p)[1]
    assert {c.split(":")[0] for c in read.split(",")} <= {"l_orderkey", "l_linenumber", "l_extendedprice", "event_id", "event_type", "value"}
    assert "partial_sum" in p and "Python" not in p and "Pandas" not in p


@pytest.mark.parametrize("name", ["local_points_wide", "mesh_nodes_wide", "mesh_cells_wide"])
def test_plans_stay_small(spark, name):
    """Index maps once grew to hundreds of thousands of characters and beyond what can be compiled."""
    assert max(map(len, plan(spark, name).splitlines())) < 12_000


@pytest.mark.parametrize("name", ["mesh_nodes_serial", "mesh_cells_serial", "mesh_nodes_wide"])
def test_numbering_holds_no_part_in_one_window(spark, name):
    """Points are ranked within a row of the grid; what a window holds of a whole part are counts per row."""
    windows = [x for x in plan(spark, name).splitlines() if "Window [" in x]
    assert windows
    for w in windows:
        by = w.split("],")[1]
        assert "iy" in by or "row_number" not in w, w


def test_hash_packs_before_its_one_task(spark):
    p = plan(spark, "content_uid")
    assert p.index("SinglePartition" if "SinglePartition" in p else "RoundRobinPartitioning(1)") < p.index("FlatMapGroupsInPandas")
