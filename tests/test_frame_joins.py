"""Tables that Spark sizes too small are never sent whole through the driver."""

import pytest
from pyspark.sql import functions as F

from trackweave.operators import venue as vn
from trackweave.operators.gapfill import frame_spine
from trackweave.operators.intervals import covered_blocks, flag_frames
from trackweave.queries import load
from trackweave.queries.views import view

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_with_frames_are_merged(spark):
    videos = spark.createDataFrame([(1, 40, 1920, 1080), (2, 0, 1920, 1080)], "video_id long, n_frames long, img_w long, img_h long")
    spine = frame_spine(videos, chunk=16)
    assert sorted(r.frame_id for r in spine.collect()) == list(range(40))
    some = spark.createDataFrame([(1, 3, 5)], "video_id long, start_frame long, end_frame long")
    flagged = flag_frames(spine.select("video_id", "frame_id"), some, "inside")
    assert "BroadcastHashJoin" not in plan(flagged)
    assert [r.frame_id for r in flagged.where("inside").orderBy("frame_id").collect()] == [3, 4, 5]


@pytest.mark.parametrize("name", ["frames", "camera_flow", "trace", "track", "gt_centers", "pred_jumps"])
def test_joins_with_views_are_merged(spark, name):
    other = spark.range(1000).selectExpr("id AS video_id")
    assert "BroadcastHashJoin" not in plan(view(spark, SF_DIR, name).join(other, "video_id"))


@pytest.mark.parametrize("name", ["j6_overlap_labels", "u4_concat_traces", "j17_trace_drift"])
def test_queries_over_frames_do_not_broadcast_them(spark, name):
    assert "Join [video_id" in plan(load()[0][name](spark, SF_DIR))
    joins = [line for line in plan(load()[0][name](spark, SF_DIR)).splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "frame_id" in line]


def test_totals_of_few_large_groups_are_still_broadcast(spark):
    scores = view(spark, SF_DIR, "scores")
    assert "BroadcastHashJoin" in plan(scores.join(scores.groupBy("model").agg({"score_true": "max"}), "model"))


def test_long_intervals_make_a_row_per_block_not_per_frame(spark):
    spans = [(1, 3, 5), (1, -70, -1), (1, 64, 127), (1, 100, 1_000_000), (2, 63, 64), (2, 9, 8), (2, None, 4), (3, 5, 5)]
    some = spark.createDataFrame(spans, "video_id long, start_frame long, end_frame long")
    assert covered_blocks(some, "bits").count() < 16_000
    frames = [(v, f) for v in (1, 2, 3, 4) for f in (*range(-72, 140), 999_999, 1_000_000, 1_000_001, None)]
    flagged = flag_frames(spark.createDataFrame(frames, "video_id long, frame_id long"), some, "inside").collect()
    known = [(v, a, b) for v, a, b in spans if a is not None]
    assert len(flagged) == len(frames)
    assert all(r.inside == (r.frame_id is not None and any(v == r.video_id and a <= r.frame_id <= b for v, a, b in known)) for r in flagged)


def test_selected_tracks_are_scored_once(spark):
    """Each reader of the scores sorted and joined all detections again, in one stage."""
    made = plan(load()[0]["a5_candidate_pool"](spark, SF_DIR))
    assert made.count("events.parquet") <= 2 and made.count("Sort [") <= 8


def test_calibrated_positions_merge_frames_and_splines(spark):
    """Frames made from a row per video, and their splines, were taken to be as small as that and sent through the driver."""
    flow = spark.range(2).select(F.col("id").alias("video_id"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("frame_id"))
    flow = flow.select("*", (F.col("frame_id") * 2.0).alias("cum_dx"), (F.col("frame_id") * 3.0).alias("cum_dy"))
    points = spark.createDataFrame([(0, 6.0 * k, 9.0 * k, 60.0 * k, 90.0 * k) for k in range(5)], "video_id long, cum_dx double, cum_dy double, venue_x double, venue_y double")
    made = vn.predict(flow, points, limits=(1500.0, 1600.0))
    joins = [line for line in plan(made).splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "BuildLeft" in line or "LeftOuter" in line] and "SortMergeJoin [video_id#" in plan(made)
    got = {r.frame_id: (r.venue_x, r.venue_y) for r in made.collect()}
    assert len(got) == made.count() == 100 and got[4] == pytest.approx((80.0, 120.0)) and got[99] == pytest.approx((1499.0, 1599.0))
