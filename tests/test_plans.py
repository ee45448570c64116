"""Shape of the plans: no nested loops, no Python outside the named operators, pushdown."""

import os

import pytest

import __spark_entry__ as entry
from sightings.operators import alerts
from sightings.plans import fixtures
from sightings.plans.queries import QUERIES
from sightings.session import cut

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["f6_valid", "j1_exclusions", "j2_frame_pairs", "j3_asof_state", "j4_flags",
     "j5_match_plates", "j6_route_review", "w1_tag_presence", "w7_capture_health", "a1_nms"],
)
def test_no_nested_loops_and_no_python(spark, name):
    p = plan(spark, name)
    for bad in ("NestedLoop", "CartesianProduct", "Python", "Pandas", "ArrowEval"):
        assert bad not in p, p


def test_scan_reads_only_needed_columns(spark):
    p = plan(spark, "w5_warmed_up")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" not in p
    assert "ReadSchema: struct<event_id:bigint>" in p


def test_no_window_over_a_whole_camera(spark):
    """Every window over detections or frames is cut by time slice; those over one row per
    slice read an aggregate."""
    p = plan(spark, "w5_warmed_up")
    assert "windowspecdefinition(cam" in p and "_slice" in p


def test_entry_and_registry(spark):
    assert len(entry.entry(spark).take(1)) == 1
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_no_task_holds_all_cameras_for_states(spark):
    assert "SinglePartition" not in plan(spark, "j3_asof_state")


def test_variants_of_one_small_file_are_many_tasks(spark, tmp_path):
    spark.range(1, 40).selectExpr(
        "id as c_custkey", "concat('C', id) as c_name", "cast(1 as int) as c_nationkey", "'m' as c_mktsegment"
    ).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    d = QUERIES["x11_edit_variants"](spark, str(tmp_path))
    assert d.rdd.getNumPartitions() > 1
    # Eight letters: all replacements, deletions and insertions of a plate, without repeats.
    n = {r["plate"]: r["count"] for r in d.groupBy("plate").count().collect()}
    assert len(n) == 39 and all(8 * 35 + 1 + 9 * 36 - 8 < v <= 8 * 36 + 9 * 36 + 8 for v in n.values())


def test_marks_of_one_file_of_events_are_many_tasks(spark, tmp_path):
    spark.range(60).selectExpr("id as event_id", "id % 7 as user_id").coalesce(1).write.parquet(
        str(tmp_path / "events.parquet")
    )
    p = fixtures.prepared(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" in p, p


def test_states_of_written_frames(spark, tmp_path):
    spark.range(300).selectExpr("id as event_id", "id % 7 as user_id").write.parquet(
        str(tmp_path / "events.parquet")
    )
    whole = fixtures.frame_states(spark, str(tmp_path)).orderBy("frame_id").collect()
    of = fixtures.frame_states(spark, str(tmp_path), cut(fixtures.frames(spark, str(tmp_path))))
    assert whole and of.orderBy("frame_id").collect() == whole


def test_departures_are_not_gathered_by_the_driver(spark):
    """Their tables are small files with long rows, and are as many as tracks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "512k")
        dims = [fixtures.dim(spark, n) for n in ("priorities_t", "sounds_t")]
        states = cut(spark.range(100_000).selectExpr(
            "id as frame_id", "'home' as mode", "'on' as vehicle_detector", "'on' as person_detector",
            "'outside' as dog_status", "'off' as vacation_mode",
        ))
        leaving = cut(spark.range(50_000).selectExpr(
            "id as frame_id", "'deck' as cam", "cast(timestamp_seconds(id) as timestamp_ntz) as frame_ts", "0 as det_no",
            "'dog' as tag", "0.5D as prob", "9 as age", "concat('deck|dog|', id) as track_id", "concat('dog ', id) as msg",
            "cast(null as double) as iou", "cast(null as string) as ignore", "true as departed", "-1 as prior_priority",
        ))
        told = alerts.pushes(alerts.departure_alerts(leaving, states, *dims))
        p = told._jdf.queryExecution().executedPlan().toString()
        # Tables of tags are; those of frames have a number as their key.
        assert "BroadcastExchange HashedRelationBroadcastMode(List(input[0, bigint" not in p, p
        assert told.count() == 50_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
